"""Reference lists as typed columns.

A reference line becomes one row by native column expressions that depend on the style of its document (a six-row
dimension, joined by broadcast). Nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import dims
from foliospark.functions.text import first_match, key_letters, let, staged, strip_particles, text_of
from foliospark.operators.citations import acronym_pair, listed_names, marked_authors, names_between_marks, with_trimmed_link

# Words of institutions.
INSTITUTION = (
    "(?i)\\b(Organization|Organisation|Organisasi|Ministry|Kementerian|Department|Departemen|Institute|Institut|University|Universitas|Agency|Agensi|Badan|Dinas|Komisi|Commission|Council|Dewan|"
    "Association|Asosiasi|Perhimpunan|Ikatan|Committee|Panitia|Bureau|Biro|Corporation|Corp\\.?|Inc\\.?|Foundation|Yayasan|Center|Centre|Pusat|Bank|WHO|UNESCO|UNICEF|UNDP|WWF|FAO|World|National|Nasional|"
    "Federal|State|Pemerintah|Government|Perusahaan|PT\\.?|Fakultas|Faculty|Sekolah|School|Rumah\\s+Sakit|Hospital|Perpustakaan|Library|Laboratorium|Laboratory)\\b"
)
CAP = "[\\p{Lu}\\p{Lo}][\\p{L}'\\-]+"
# Shapes of personal names.
PERSONAL = [
    f"^{CAP},\\s*(\\p{{Lu}}\\.\\s*)+$", f"^{CAP},\\s*{CAP}(\\s+{CAP})?$", f"^(\\p{{Lu}}\\.\\s*)+{CAP}$", f"^{CAP}\\s+\\p{{Lu}}{{1,3}}$",
    f"^(?:(?:[Bb]in|[Ii]bn|[Bb]inti|[Aa]l|[Ee]l|[Dd]a|[Tt]en|[Tt]er|[Vv]an|[Dd]er|[Dd]en|[Vv]on|[Dd]e|[Ll]a|[Ll]e|[Dd]u|[Dd]os|[Dd]as|[Dd]o)\\s+)+{CAP}$",
]
JOURNAL_WORDS = "(?i)\\b(journal|jurnal|review|quarterly|annals?|transactions|majalah\\s+ilmiah)\\b"
INITIALS = "^(?:(?:[A-Z]\\.?|Md\\.?|Mst\\.?)\\s*)+$"


#: White space at either end, or a word that neither begins with a capital nor joins such words.
SMALL_WORD = "^\\s|(?:^|\\s)(?!\\s)(?![\\p{Lu}\\p{Lo}]|(?i:of|the|and|dan|untuk|bagi|ng|sa|at|para|de|la|del)(?:\\s|\\z))"


# Expressions over arrays' elements keep their whole step out of Spark's generated code, so what every line goes through has none (no ``let`` either);
# shared values are columns of an earlier step.
def _bare_name(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(text_of(c)), "\\.$", "")


def _is_institution(s: Column) -> Column:
    named = s.rlike("^[A-Z]{2,8}$") | acronym_pair(s).isNotNull() | s.rlike(INSTITUTION)
    return (s != "") & (named | (s.contains(" ") & ~s.contains(",") & ~s.rlike("|".join(PERSONAL)) & ~s.rlike(SMALL_WORD)))


def institutional(c: Column | str) -> Column:
    """Whether an author string names an institution rather than a person."""
    return let(_bare_name(c), _is_institution)


#: Initials, as an element of a list whose elements a control character parts.
_ELEMENT = "(?:(?:[A-Z]\\.?|Md\\.?|Mst\\.?)\\s*)+"


def _inverted(parts: Column) -> Column:
    """Names of a list in which a surname waits for the initials that follow it; initials without a surname before them are left out."""
    text = F.regexp_replace(F.array_join(parts, "\u0001"), f"^{_ELEMENT}(?:\u0001{_ELEMENT})*(?:\u0001|\\z)", "")
    text = F.regexp_replace(text, f"\u0001({_ELEMENT})(?:\u0001{_ELEMENT})*(?=\u0001|\\z)", ", $1")
    return F.array_remove(F.split(text, "\u0001"), "")


def _first_inverted(parts: Column) -> Column:
    """``Last, First, Other Name``: the first comma belongs to the first author."""
    second = F.get(parts, F.lit(1))
    return F.when((F.size(parts) >= 2) & ~second.contains(" "), F.concat(F.array(F.concat_ws(", ", F.get(parts, F.lit(0)), second)), F.slice(parts, 3, 2**30))).otherwise(parts)


PERSON = f"(?:\\p{{Lu}}\\.\\s*){{1,3}}{CAP}"
SEVERAL = f"^{PERSON}(?:\\s*,?\\s*(?:and|&)\\s*{PERSON}|\\s*,\\s*{PERSON})+$"


def with_authors(rows: DataFrame, segment: str, form: str) -> DataFrame:
    """``rows`` with authors, the names of an author segment by the style's author form."""
    form = F.col(form)
    rows = staged(rows, __clean=F.trim(F.regexp_replace(F.trim(text_of(segment)), "\\.\\s*$", "")))
    clean = F.col("__clean")
    rows = staged(rows, __name=_bare_name(F.regexp_replace(clean, ",\\s*$", "")), __marked=marked_authors(clean))
    rows = staged(rows, __whole=~clean.rlike(SEVERAL) & _is_institution(F.col("__name")), __parts=names_between_marks(F.col("__marked")))
    parts = F.col("__parts")
    rows = staged(rows, __names=F.when(form == "first-inverted", _first_inverted(parts)).when(form == "non-inverted", parts).when(form == "vancouver", listed_names(clean)).otherwise(_inverted(parts)))
    inverted = ~F.coalesce(form.isin("first-inverted", "non-inverted", "vancouver"), F.lit(False))
    named = F.when(inverted & (F.size("__names") == 0), F.array(clean)).otherwise(F.col("__names"))
    rows = staged(rows, authors=F.when(clean == "", F.array().cast("array<string>")).when(F.col("__whole"), F.array(clean)).otherwise(named))
    return rows.drop("__clean", "__name", "__marked", "__whole", "__parts", "__names")


#: A bare year that is no part of a DOI or link. The look behind follows the match, so that only years pay for it.
BARE_YEAR = "\\b((?:19|20)\\d{2}[a-z]?)\\b(?<!\\b10\\.[\\d.]{4,20}(?=/))(?<!\\b10\\.[\\d.]{4,20}/\\S{1,200})(?<!//\\S{1,200})"


def year_of(line: Column | str, year_in_parens: Column | None = None) -> Column:
    dotted = first_match(line, "\\.\\s*(\\d{4}[a-z]?)\\.\\s")
    rest = F.coalesce(first_match(line, "\\((\\d{4}[a-z]?|n\\.d\\.)\\)"), first_match(line, BARE_YEAR))
    return rest if year_in_parens is None else F.coalesce(F.when(~F.coalesce(year_in_parens, F.lit(True)), dotted), rest)


def with_doi(rows: DataFrame, line: str) -> DataFrame:
    """``rows`` with the DOI of a line; only lines that hold the start of any are searched."""
    found = F.coalesce(first_match(line, "(?i)https?://(?:dx\\.)?doi\\.org/(10\\.\\d{4,}/\\S+)"), first_match(line, "(?i)doi:\\s*(10\\.\\d{4,}/\\S+)"), first_match(line, "\\b(10\\.\\d{4,}/\\S+)"))
    return with_trimmed_link(staged(rows, doi=F.when(F.col(line).contains("10."), found)), "doi").withColumn("doi", F.nullif("doi", F.lit("")))


def holds(low: Column, words: str) -> Column:
    """Whether a text in lower case holds any of some words, which is cheaper to see than a pattern that begins with one of them."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words.split("|")])


def source_type(line: Column | str) -> Column:
    return let(text_of(line), lambda s: _type_of(s, F.lower(s)))


def _type_of(s: Column, low: Column) -> Column:
    journal = [
        "\\b\\d{1,4}\\s*\\(\\s*[\\w-]+\\s*\\)\\s*,\\s*\\d+[-–]\\d+", ",\\s*\\d{1,4}\\s*,\\s*(?:pp?\\.\\s*)?e?\\d{2,}(?:[-–]\\d+)?\\b", "(?i)\\bvolume\\s+\\d+\\s*,\\s*article\\s+\\d+",
        "(?i)\\bvol\\.?\\s*\\d+\\s*,\\s*(?:no\\.?\\s*\\d+\\s*,\\s*)?pp?\\.\\s*\\d+",
    ]
    tail = F.trim(first_match(s, "\\.\\s*([^.]+)\\.\\s*$"))
    publisher = tail.isNotNull() & (F.length(tail) < 60) & ~tail.rlike("\\d") & ~tail.rlike(JOURNAL_WORDS)
    has = lambda words, pattern: holds(low, words) & s.rlike(pattern)
    return (
        F.when(has("skripsi|tesis|disertasi|thesis|dissertation", "(?i)\\b(skripsi|tesis|disertasi|thesis|dissertation)\\b"), "thesis")
        .when(has("isbn", "(?i)\\bISBN\\b"), "book")
        .when(has("journal|jurnal|review|quarterly|annal|transactions|majalah", JOURNAL_WORDS) | s.rlike("|".join(f"(?:{p})" for p in journal)), "journal-article")
        .when(has("prosiding|proceedings|conference|seminar|konferensi|symposium", "(?i)\\b(prosiding|proceedings|conference|seminar\\s+nasional|konferensi|symposium)\\b"), "conference")
        .when(s.rlike("(?i)\\bIn\\s+[^()]+\\(Eds?\\.?\\)|\\(pp\\.\\s*\\d+|\\bDalam\\s+[^()]+\\(Ed\\.?\\)"), "book-chapter")
        .when(has("retrieved from|diakses dari|diakses pada|accessed on", "(?i)\\b(retrieved from|diakses dari|diakses pada|accessed on)\\b") | (s.rlike("(?i)https?://") & ~s.rlike("(?i)doi\\.org")), "website")
        .when(has("laporan|working|policy", "(?i)\\b(laporan\\s+(tahunan|penelitian)?|working\\s+paper|policy\\s+brief)\\b"), "report")
        .when(publisher, "book")
        .otherwise("unknown")
    )


def title_of(after: Column, quote: Column, plain: Column) -> Column:
    """The title in what follows the authors (and the year): quoted where the style quotes, else up to a full stop, a question or exclamation mark; plain: what follows, without stops in front."""
    end = "^(.*?)([.?!])\\s"
    upto = lambda t: F.when(t.rlike(end), F.concat(F.regexp_extract(t, end, 1), F.replace(F.regexp_extract(t, end, 2), F.lit("."), F.lit("")))).otherwise(F.substring_index(t, ".", 1))
    double = F.trim(F.regexp_replace(first_match(after, '["“]([^"”]+)["”]'), "[,.]$", ""))
    single = F.trim(first_match(after, "'([^']+)'"))
    return F.nullif(F.trim(F.coalesce(F.when(quote == "double", double), F.when(quote == "single", single), upto(plain))), F.lit(""))


# Shapes of volume, issue and pages, in the order in which they count.
SHAPES = {
    "pages": "\\b(\\d{1,4})\\s*\\(\\s*([\\w-]+)\\s*\\)\\s*,\\s*(\\d+)[-–](\\d+)",
    "eid": "(?i)\\b(\\d{1,4})\\s*\\(\\s*([\\w-]+)\\s*\\)\\s*,\\s*(e\\d{3,})\\b",
    "word": "(?i)\\b(\\d{1,4})\\s*(?:\\(\\s*([\\w-]+)\\s*\\))?\\s*,\\s*Article\\s+([A-Za-z]?\\d+)\\b",
    "vol": "(?i)\\bvol\\.?\\s*(\\d+)\\s*(?:,\\s*no\\.?\\s*(\\d+))?\\s*,\\s*pp?\\.\\s*(\\d+)(?:[-–](\\d+))?",
    "bare": ",\\s*(\\d{1,4})\\s*,\\s*(?:pp?\\.\\s*)?(e?\\d{2,})(?:[-–](\\d+))?\\b",
}
JOURNAL_END = "(?i),\\s*\\d|\\bvol\\.?\\s*\\d|https?://|\\bdoi\\b\\s*:"


def bibliographic(rows: DataFrame, want: set[str]) -> DataFrame:
    """``rows`` (raw, __low, title) with those of journal, issn, eissn, volume, issue, pages, article_number and publisher that are wanted."""
    raw, low = F.col("raw"), F.col("__low")
    more: dict[str, Column] = {}
    if want & {"journal", "publisher"}:
        at = F.instr(raw, F.coalesce("title", F.lit("")))
        rows = staged(rows, __after=F.when(F.col("title").isNotNull() & (at > 0), F.substring(raw, at + F.length("title"), F.lit(2**31 - 1))))
    if "journal" in want:
        rows = staged(rows, __named=F.regexp_replace("__after", "^[.,\"”'\\s]+", ""))
        rows = staged(rows, __journal=F.trim(F.regexp_replace(F.get(F.split("__named", F.when(F.col("__named").rlike(JOURNAL_END), JOURNAL_END).otherwise("[.,]"), 2), F.lit(0)), "[.,;:\\s]+$", "")))
        more["journal"] = F.when(F.length("__journal").between(3, 149), F.col("__journal"))
    if "publisher" in want:
        unlinked = F.regexp_replace(F.regexp_replace("__after", "^[?!.]?\\s*", "."), "(?i)\\s*(?:https?://\\S+|doi:\\s*10\\.\\d{4,}/\\S+)\\s*\\.?\\s*$", "")
        rows = staged(rows, __tail=F.trim(first_match(unlinked, "\\.\\s*([^.]+)\\.\\s*$")))
        more["publisher"] = F.when(F.length("__tail").between(2, 79) & ~F.col("__tail").rlike("\\d") & ~F.col("__tail").rlike(JOURNAL_WORDS), F.col("__tail"))
    if "issn" in want:
        more["issn"] = F.when(low.contains("issn"), F.upper(first_match(raw, "(?i)(?<![-e])\\bissn\\b\\s*[:.]?\\s*(\\d{4}-\\d{3}[\\dXx])")))
    if "eissn" in want:
        more["eissn"] = F.when(low.contains("issn"), F.upper(first_match(raw, "(?i)\\be-?issn\\b\\s*[:.]?\\s*(\\d{4}-\\d{3}[\\dXx])")))
    if want & {"volume", "issue", "pages", "article_number"}:
        kind = F.coalesce(*[F.when(raw.rlike(p), F.lit(k)) for k, p in SHAPES.items()])
        groups = F.coalesce(*[F.when(F.col("__kind") == k, F.array(*[first_match(raw, p, n) if n <= p.count("(") - p.count("(?") - p.count("\\(") else F.lit(None).cast("string") for n in (1, 2, 3, 4)])) for k, p in SHAPES.items()])
        rows = staged(staged(rows, __kind=kind), __g=groups)
        g = lambda n: F.get("__g", F.lit(n - 1))
        is_ = lambda *k: F.coalesce(F.col("__kind").isin(*k), F.lit(False))
        number_only = F.coalesce(g(2).rlike("(?i)^e\\d+$") | (F.length(g(2)) >= 5), F.lit(False))
        joined = lambda a, b: F.when(a.isNotNull(), F.concat_ws("-", a, b))
        more["volume"] = g(1)
        more["issue"] = F.when(~is_("bare"), g(2))
        more["pages"] = F.when(is_("pages", "vol"), joined(g(3), g(4))).when(is_("bare") & (g(3).isNotNull() | ~number_only), joined(g(2), g(3)))
        more["article_number"] = F.when(is_("eid", "word"), g(3)).when(is_("bare") & g(3).isNull() & number_only, g(2))
    rows = staged(rows, **{k: more[k] for k in sorted(want & more.keys())})
    return rows.drop("__kind", "__after", "__g", "__named", "__tail", "__journal")


def reference_lines(docs: DataFrame) -> DataFrame:
    """doc_id, style_id, line_no (from 1) and raw of the lines of reference_text that aren't blank."""
    rows = docs.select("doc_id", "style_id", F.posexplode(F.split(text_of("reference_text"), "\n")).alias("pos", "line"))
    return rows.select("doc_id", "style_id", (F.col("pos") + 1).alias("line_no"), F.trim(F.when(F.col("line").contains("\r"), F.regexp_replace("line", "\\r$", "")).otherwise(F.col("line"))).alias("raw")).where("raw <> ''")


COLUMNS = ["doc_id", "line_no", "raw", "style_id", "family", "author_form", "num_label", "authors", "is_institutional", "author_count", "first_author", "year", "title", "journal", "issn", "eissn", "volume", "issue", "pages", "article_number", "publisher", "doi", "source_type"]
OF_AUTHORS = {"authors", "is_institutional", "author_count", "first_author"}
OF_JOURNALS = {"journal", "issn", "eissn", "volume", "issue", "pages", "article_number", "publisher"}


def parsed(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All lines with what could be read; ``ok`` says whether that makes a reference, ``reason`` why not.

    columns: those that are wanted, all where none are named. The year is read in any case, the title also where there is no year, all else
    only where it is wanted. A generator stands between the stages, so Spark can't leave them out itself.
    """
    want = set(COLUMNS if columns is None else columns)
    style = F.broadcast(dims.styles(lines.sparkSession)).drop("et_al_from", "separator", "ref_order", "full_up_to", "italics", "case_mode")
    rows = lines.join(style, "style_id")
    numeric = F.col("family") == "numeric"
    label = F.when(F.col("ref_prefix") == "bracket", "^\\[(\\d{1,9})\\]\\s*").when(F.col("ref_prefix") == "dot", "^(\\d{1,9})\\.\\s*")
    num_label = (F.when(label == "^\\[(\\d{1,9})\\]\\s*", first_match("raw", "^\\[(\\d{1,9})\\]\\s*")).when(label.isNotNull(), first_match("raw", "^(\\d{1,9})\\.\\s*"))).cast("int")
    rest = (F.when(F.col("ref_prefix") == "bracket", F.regexp_replace("raw", "^\\[\\d+\\]\\s*", "")).when(F.col("ref_prefix") == "dot", F.regexp_replace("raw", "^\\d+\\.\\s*", "")).otherwise(F.col("raw")))
    rows = staged(rows, num_label=num_label, rest=rest)
    quote_at = '^([^"“]*)["“]'
    before_quote = F.regexp_replace(first_match("rest", quote_at), ",\\s*$", "")
    no_parens = ~F.coalesce("year_in_parens", F.lit(True))
    dated = "^(.*?)\\.\\s*(\\d{4}[a-z]?)\\.\\s"
    in_parens = "^(.*?)\\((\\d{4}[a-z]?|n\\.d\\.)\\)"
    way = (
        F.when(numeric & (F.col("author_form") == "non-inverted"), F.when(F.col("rest").rlike(quote_at), "quote").otherwise("dot"))
        .when(numeric, F.when(F.col("rest").contains(". "), "stop").otherwise("whole"))
        .when(no_parens & F.col("raw").rlike(dated), "dated")
        .when(~no_parens & F.col("raw").rlike(in_parens), "parens")
        .when(F.col("raw").rlike(quote_at), "quoted")
    )
    rows = staged(rows, way=way)
    pick = lambda **by: F.coalesce(*[F.when(F.col("way") == k, c) for k, c in by.items()])
    rows = staged(
        rows,
        who=pick(quote=before_quote, dot=F.substring_index("rest", ".", 1), stop=F.substring_index("rest", ". ", 1), whole=F.col("rest"), dated=first_match("raw", dated), parens=F.trim(first_match("raw", in_parens)), quoted=F.regexp_replace(first_match("raw", quote_at), "\\.\\s*$", "")),
    )
    behind = lambda p: F.regexp_replace("raw", p, "")
    after_who = F.substring(F.col("rest"), F.length("who") + 1, F.lit(2**31 - 1))
    rows = staged(rows, after=pick(quote=after_who, dot=after_who, stop=after_who, whole=after_who, dated=behind(dated), parens=behind(in_parens), quoted=F.regexp_extract("raw", '(["“].*)$', 1)))
    comma_year = F.coalesce(first_match("raw", ",\\s*((?:19|20)\\d{2})\\b"), first_match("raw", BARE_YEAR.replace("[a-z]?", "")))
    year = F.when(numeric, year_of("rest")).otherwise(pick(dated=first_match("raw", dated, 2), parens=first_match("raw", in_parens, 2), quoted=comma_year))
    rows = staged(rows, year=year, plain=F.regexp_replace("after", "^[.\\s]+", ""))
    title = title_of(F.col("after"), F.coalesce("title_quote", F.lit("none")), F.col("plain"))
    rows = staged(rows, title=title if want & {"title", "journal", "publisher"} else F.when(F.col("year").isNull(), title), __low=F.lower("raw")).drop("plain")
    if want & OF_AUTHORS:
        rows = with_authors(rows, "who", "author_form")
    if "doi" in want:
        rows = with_doi(rows, "raw")
    if "source_type" in want:
        rows = staged(rows, source_type=_type_of(F.col("raw"), F.col("__low")))
    if want & OF_JOURNALS:
        rows = bibliographic(rows, want & OF_JOURNALS)
    unread = F.col("way").isNull() | (~numeric & (F.coalesce("who", F.lit("")) == ""))
    reason = F.when(unread, "no author and year in the style's form").when(F.col("year").isNull() & F.col("title").isNull(), "neither year nor title")
    rows = staged(rows.drop("__low"), reason=reason)
    if want & OF_AUTHORS:
        rows = staged(rows, first_author=F.get("authors", F.lit(0)), author_count=F.size("authors"))
        rows = staged(rows, __name=_bare_name("first_author"))
        rows = staged(rows, is_institutional=(F.col("author_count") == 1) & _is_institution(F.col("__name"))).drop("__name")
    return rows.withColumn("ok", F.col("reason").isNull())


def build_refs(lines: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(references, failures); of the references all columns or those named, with doc_id, line_no and raw."""
    rows = parsed(lines, columns)
    names = COLUMNS if columns is None else [c for c in COLUMNS if c in {"doc_id", "line_no", "raw", *columns}]
    return rows.where("ok").select(*names), rows.where("not ok").select("doc_id", "line_no", F.col("raw").alias("text"), "reason")


def parse_stats(lines: DataFrame) -> DataFrame:
    """doc_id with how many lines were found, read and not read."""
    return parsed(lines, []).groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def surname_of_ref(author: Column | str, form: Column | str) -> Column:
    a, form = F.trim(text_of(author)), (F.col(form) if isinstance(form, str) else form)
    last = F.element_at(F.split(a, "\\s+"), -1)
    return F.when(form == "non-inverted", last).when(form == "vancouver", F.coalesce(first_match(a, "^(.+?)\\s+[A-Z]{1,3}$"), a)).when(a.contains(","), F.trim(F.substring_index(a, ",", 1))).otherwise(last)


def initial_of_ref(author: Column | str, form: Column | str) -> Column:
    a, form = F.trim(text_of(author)), (F.col(form) if isinstance(form, str) else form)
    given = F.when(form == "non-inverted", first_match(a, "^(\\S+)\\s+\\S")).when(form == "vancouver", first_match(a, "\\s(\\p{Lu}{1,3})$")).otherwise(first_match(a, "^[^,]*,\\s*(\\S+)"))
    return F.nullif(F.upper(F.substring(F.replace(given, F.lit("."), F.lit("")), 1, 1)), F.lit(""))


LEADING_INITIALS = "^(?:\\p{Lu}\\.\\s+|\\p{Lu}{1,4}\\s+)+(?=\\S+$)"


def surname_of_token(token: Column | str) -> Column:
    """The surname of a name in a citation: initials before it are left out."""
    t = F.regexp_replace(F.trim(text_of(token)), "['’]s$", "")
    return F.regexp_replace(t, LEADING_INITIALS, "")


def initial_of_token(token: Column | str) -> Column:
    t = F.trim(text_of(token))
    return F.when(t.rlike(LEADING_INITIALS), F.upper(F.substring(t, 1, 1)))


def match_key(name: Column, is_institution: Column) -> Column:
    """Letters and digits of a name, without particles or an article in front."""
    full = F.coalesce(acronym_pair(name)["full"], name)
    return F.when(is_institution, key_letters(F.regexp_replace(full, "(?i)^(the|a|an)\\s+", ""))).otherwise(key_letters(strip_particles(name)))


ACRONYM_TEXT = "((?:(?:[\\p{Lu}\\p{Lo}][\\p{L}'’\\-]*|of|the|and|dan|untuk|bagi|ng|sa|at|para|de|la|del)\\s+){1,8}[\\p{Lu}\\p{Lo}][\\p{L}'’\\-]*)\\s*[\\(\\[]([A-Z]{2,8})[\\)\\]]"


def acronym_map(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, acronym (lower case) and full_name: the last mention of ``Full Name (ACR)`` in a document counts."""
    found = F.regexp_extract_all(text_of(text), F.lit(ACRONYM_TEXT), F.lit(0))
    # Texts without a bracketed acronym, which is soon seen, aren't searched for names before one.
    rows = df.where(text_of(text).rlike("[\\(\\[][A-Z]{2,8}[\\)\\]]")).select("doc_id", F.posexplode(found).alias("k", "m"))
    name = F.regexp_replace(F.regexp_replace(F.trim(first_match("m", ACRONYM_TEXT, 1)), "(?i)^(?:The|A|An)\\s+", ""), "[.,;:]$", "")
    return rows.groupBy("doc_id", F.lower(first_match("m", ACRONYM_TEXT, 2)).alias("acronym")).agg(F.max_by(name, "k").alias("full_name"))


def resolve_acronyms(rows: DataFrame, name: str, acronyms: DataFrame) -> DataFrame:
    """``rows`` with the institution's full name in place of a bare acronym: from the document, else from the fixed dictionary."""
    spark = rows.sparkSession
    bare = F.when(F.trim(name).rlike("^[A-Z]{2,8}$"), F.lower(F.trim(name)))
    own = acronyms.select(F.col("doc_id").alias("__d"), F.col("acronym").alias("__a"), F.col("full_name").alias("__own"))
    known = F.broadcast(dims.acronyms(spark)).select(F.lower("acronym").alias("__k"), F.col("full_name").alias("__known"))
    out = rows.withColumn("__bare", bare)
    out = out.join(own, (F.col("doc_id") == F.col("__d")) & (F.col("__bare") == F.col("__a")), "left").join(known, F.col("__bare") == F.col("__k"), "left")
    return out.withColumn(name, F.coalesce("__own", "__known", name)).drop("__bare", "__d", "__a", "__own", "__k", "__known")
