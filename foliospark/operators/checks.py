"""Validation checks that give issue rows, and the orders they look at.

An issue is (doc_id, issue_code, severity, code, correction): what is wrong, how bad, the text it is about and how it should read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import dims
from foliospark.functions.text import let, text_of
from foliospark.operators.citations import acronym_pair
from foliospark.operators.refs import surname_of_ref

ISSUE = ["doc_id", "issue_code", "severity", "code", "correction"]

# Titles of issues by code, in English and Indonesian; others show their code.
TITLES = {
    "NUM_LABEL_MISSING": ("Number missing", "Nomor tidak ada"),
    "NUM_DANGLING": ("Number not in the reference list", "Nomor tidak ada di daftar referensi"),
    "NUM_NOT_SEQUENTIAL": ("Numbers are not sequential", "Nomor tidak berurutan"),
    "NUM_ORDER_MISMATCH": ("References are not in order of citation", "Urutan referensi tidak sesuai urutan sitasi"),
    "REF_UNCITED": ("Reference not cited", "Referensi tidak disitasi"),
    "LONG_AUTHOR_LIST": ("Long author list", "Daftar penulis panjang"),
    "COLLISION_SAME_PERSON": ("Same author and year need a and b", "Penulis dan tahun sama perlu huruf a dan b"),
    "COLLISION_DIFFERENT_PEOPLE": ("Different authors with one surname and year", "Penulis berbeda dengan nama belakang dan tahun sama"),
    "WRONG_SEPARATOR": ("Wrong separator between authors", "Pemisah penulis salah"),
    "ET_AL_MISSING": ("et al. is missing", "et al. tidak ada"),
    "ET_AL_UNNEEDED": ("et al. is not needed", "et al. tidak perlu"),
    "GROUP_NOT_ALPHABETICAL": ("Citations in one group are not alphabetical", "Sitasi dalam satu kurung tidak alfabetis"),
    "CITATION_NOT_IN_LIST": ("Citation not in the reference list", "Sitasi tidak ada di daftar referensi"),
    "POSSIBLE_MISMATCH": ("Possible mismatch", "Kemungkinan tidak cocok"),
    "CITATION_AMBIGUOUS": ("Citation fits several references", "Sitasi cocok dengan beberapa referensi"),
    "ACRONYM_BEFORE_FULL": ("Acronym before its full name", "Singkatan sebelum nama lengkap"),
    "LIST_NOT_ALPHABETICAL": ("Reference list is not alphabetical", "Daftar referensi tidak alfabetis"),
    "DUPLICATE_DOI": ("Same DOI in several references", "DOI sama pada beberapa referensi"),
    "DUPLICATE_TITLE": ("References are nearly the same", "Referensi hampir sama"),
    "AMBIGUOUS_YEAR": ("Same author and year without a letter", "Penulis dan tahun sama tanpa huruf"),
    "MIXED_STYLE": ("Citation styles are mixed", "Gaya sitasi bercampur"),
    "METADATA_INCOMPLETE": ("Metadata incomplete", "Metadata tidak lengkap"),
    "FORMAT_NO_SPACE_BEFORE_PAREN": ("No space before the parenthesis", "Tidak ada spasi sebelum kurung"),
    "FORMAT_ET_AL_CASE": ("et al. is written wrongly", "Penulisan et al. salah"),
    "FORMAT_MISSING_OPEN_PAREN": ("Parenthesis without a partner", "Kurung tanpa pasangan"),
    "FORMAT_MULTIPLE_AUTHORS_BEFORE_ET_AL": ("Two names before et al.", "Dua nama sebelum et al."),
    "FORMAT_NO_SPACE_AROUND_AMPERSAND": ("No space around &", "Tidak ada spasi di sekitar &"),
    "FORMAT_EXTRA_SPACE_IN_PAREN": ("Space inside the parenthesis", "Spasi di dalam kurung"),
    "FORMAT_NO_SPACE_AFTER_PAREN": ("No space after the parenthesis", "Tidak ada spasi setelah kurung"),
    "INSTITUTION_ACRONYM_ONLY": ("Institution is only an acronym", "Lembaga hanya berupa singkatan"),
    "ITALIC": ("Italics", "Huruf miring"),
    "CASE": ("Capitals in the title", "Huruf besar pada judul"),
    "DOI_NONE": ("No DOI", "Tanpa DOI"),
    "DOI_UNVERIFIED": ("DOI cannot be verified", "DOI tidak dapat diverifikasi"),
    "DOI_NOT_FOUND": ("DOI not found", "DOI tidak ditemukan"),
    "DOI_MISMATCH": ("DOI valid, metadata differ", "DOI valid, metadata tidak sesuai"),
    "DOI_VALID": ("DOI valid, metadata fit", "DOI valid & metadata sesuai"),
}
MESSAGES = [(lang, code, titles[k]) for code, titles in TITLES.items() for k, lang in enumerate(("en", "id"))]

# Fields that references of a type need, and groups of which one is enough.
NEEDED = {"journal-article": (["journal", "volume"], [("pages", "article_number")]), "book": (["publisher"], []), "report": (["publisher"], [])}


def issues(rows: DataFrame, code: str, severity: str, text: Column, correction: Column | None = None) -> DataFrame:
    fixed = F.lit(None).cast("string") if correction is None else correction
    return rows.select("doc_id", F.lit(code).alias("issue_code"), F.lit(severity).alias("severity"), text.cast("string").alias("code"), fixed.alias("correction"))


def first_appearance(matches: DataFrame) -> DataFrame:
    """doc_id, line_no and rank of the references in the order in which they are first cited. matches: doc_id, position, seq, line_no."""
    first = matches.where("line_no is not null").groupBy("doc_id", "line_no").agg(F.min(F.struct("position", "seq")).alias("at"))
    return first.select("doc_id", "line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "line_no")).alias("rank"))


def numbering_check(refs: DataFrame) -> DataFrame:
    """doc_id, sequential (1, 2, 3, ... in list order) and n_missing labels."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return refs.withColumn("n", F.row_number().over(w)).groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("n") == F.col("num_label"), F.lit(False))).alias("sequential"), F.count_if(F.col("num_label").isNull()).alias("n_missing"))


def citation_order_check(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id and in_order: whether numbers follow the order of first citation."""
    ranked = first_appearance(matches).join(refs.select("doc_id", "line_no", "num_label"), ["doc_id", "line_no"])
    w = Window.partitionBy("doc_id").orderBy("rank")
    rising = ranked.withColumn("up", F.col("num_label") > F.lag("num_label").over(w))
    return rising.groupBy("doc_id").agg(F.bool_and(F.coalesce("up", F.lit(True))).alias("in_order"))


def list_key() -> Column:
    """What a reference list is sorted by: the institution without article and acronym, else the first author's surname."""
    full = F.coalesce(acronym_pair("first_author")["full"], "first_author")
    return F.regexp_replace(F.lower(text_of(F.when(F.col("is_institutional"), full).otherwise(surname_of_ref("first_author", "author_form")))), "^(the|a|an)\\s+", "")


def alphabetical_check(refs: DataFrame) -> DataFrame:
    """doc_id, sorted and the number of references out of place: base-letter order, one author before several, then the year."""
    keyed = refs.withColumn("key", list_key())
    now = Window.partitionBy("doc_id").orderBy("line_no")
    due = Window.partitionBy("doc_id").orderBy(F.expr("collate(key, 'UNICODE_CI_AI')"), F.expr("coalesce(author_count, 1) <> 1"), F.coalesce("year", F.lit("")), "line_no")
    placed = keyed.withColumn("n", F.row_number().over(now)).withColumn("due", F.row_number().over(due))
    return placed.groupBy("doc_id").agg(F.bool_and(F.col("n") == F.col("due")).alias("sorted"), F.count_if(F.col("n") != F.col("due")).alias("n_misplaced"))


def group_order_check(parts: DataFrame) -> DataFrame:
    """Citation groups of several parts that aren't alphabetical: doc_id, position, raw and the parts in order."""
    part = F.struct(F.lower("first_author").alias("key"), "part_no", "part")
    g = parts.where("type = 'parenthetical'").dropDuplicates(["doc_id", "position", "part_no"]).groupBy("doc_id", "position", "raw").agg(F.collect_list(part).alias("p"))
    due, now = F.array_sort("p"), F.array_sort("p", lambda a, b: (a["part_no"] - b["part_no"]).cast("int"))
    text = F.concat(F.lit("("), F.array_join(F.transform(due, lambda x: x["part"]), "; "), F.lit(")"))
    return g.where(F.transform(due, lambda x: x["part_no"]) != F.transform(now, lambda x: x["part_no"])).select("doc_id", "position", "raw", text.alias("corrected"))


def acronym_first_use(parts: DataFrame, acronyms: DataFrame) -> DataFrame:
    """Institutions whose first citation has the bare acronym: doc_id, position, acronym and full_name. acronyms: doc_id, acronym, full_name."""
    pair = acronym_pair("first_author")
    bare = F.when(F.trim("first_author").rlike("^[A-Z]{2,8}$"), F.trim("first_author"))
    rows = parts.withColumn("acr", F.lower(F.coalesce(pair["acronym"], bare))).where("acr is not null").withColumn("is_full", pair.isNotNull())
    known = acronyms.select("doc_id", F.col("acronym").alias("acr"), "full_name")
    fixed = F.broadcast(dims.acronyms(parts.sparkSession)).select(F.lower("acronym").alias("acr"), F.col("full_name").alias("known_name"))
    rows = rows.join(known, ["doc_id", "acr"], "left").join(fixed, "acr", "left").withColumn("full_name", F.coalesce("full_name", "known_name")).where("is_full or full_name is not null")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "acr").orderBy("position"))).where("n = 1 and not is_full")
    return first.select("doc_id", "position", F.upper("acr").alias("acronym"), "full_name", "raw")


def compressed_runs(numbers: Column) -> Column:
    """Sorted distinct numbers as text, three or more in a row as a range: 1-3, 5."""
    text = lambda a, b: F.when(b - a >= 2, F.concat(a.cast("string"), F.lit("-"), b.cast("string"))).when(b > a, F.concat(a.cast("string"), F.lit(", "), b.cast("string"))).otherwise(a.cast("string"))

    def runs(x: Column) -> Column:
        first = F.filter(x, lambda n, k: F.coalesce(F.get(x, k - 1) + 1 != n, F.lit(True)))
        last = F.filter(x, lambda n, k: F.coalesce(F.get(x, k + 1) - 1 != n, F.lit(True)))
        return F.array_join(F.zip_with(first, last, text), ", ")

    return let(F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))), runs)


ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def bookmark_names(refs: DataFrame) -> DataFrame:
    """doc_id, line_no and a readable name unique in its document: Surname2020, Surname2020_2."""
    plain = F.regexp_replace(F.translate(F.when(F.col("is_institutional"), F.col("first_author")).otherwise(surname_of_ref("first_author", "author_form")), *ACCENTS), "[^A-Za-z0-9]", "")
    base = F.substring(F.concat(F.when(plain == "", "Ref").otherwise(plain), F.regexp_replace(F.coalesce("year", F.lit("")), "[^A-Za-z0-9]", "")), 1, 32)
    named = refs.withColumn("base", base).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", F.lower("base")).orderBy("line_no")))
    return named.select("doc_id", "line_no", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "n")).alias("bookmark"))


def _with_style(rows: DataFrame, docs: DataFrame) -> DataFrame:
    style = F.broadcast(dims.styles(rows.sparkSession)).select("style_id", "family", "et_al_from", "separator", "full_up_to", "ref_order")
    return rows.join(docs.select("doc_id", "style_id"), "doc_id").join(style, "style_id")


def separator_issues(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """``and`` where the style has ``&`` inside parentheses, and the other way round."""
    rows = _with_style(parts.where("type = 'parenthetical'"), docs)
    bad = rows.where("(separator = '&' and used_and and not used_amp and size(authors) > 1) or (separator = 'and' and used_amp)")
    fixed = F.when(F.col("separator") == "&", F.regexp_replace("part", "(?i)\\s+(and|dan)\\s+", " & ")).otherwise(F.regexp_replace("part", "\\s*&\\s*", " and "))
    return issues(bad, "WRONG_SEPARATOR", "error", F.col("part"), fixed)


def et_al_missing(parts: DataFrame, docs: DataFrame) -> DataFrame:
    rows = _with_style(parts, docs).where("not has_et_al and author_count >= et_al_from")
    return issues(rows, "ET_AL_MISSING", "error", F.col("part"), F.concat(F.col("first_author"), F.lit(" et al.")))


def et_al_unneeded(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """``et al.`` for a source of at most two authors."""
    n = refs.select("doc_id", "line_no", F.col("author_count").alias("ref_authors"))
    rows = matches.where("has_et_al and line_no is not null").join(n, ["doc_id", "line_no"]).where("ref_authors <= 2")
    return issues(rows, "ET_AL_UNNEEDED", "error", F.col("part"))


def long_author_lists(refs: DataFrame, docs: DataFrame) -> DataFrame:
    rows = _with_style(refs.drop("style_id", "family"), docs).where("author_count > full_up_to")
    return issues(rows, "LONG_AUTHOR_LIST", "suggestion", F.col("raw"))


def missing_fields() -> Column:
    """Names of the fields that a reference of its type lacks; none for an unknown type."""
    gone = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    always = [F.when(gone(c), F.lit(c)) for c in ("first_author", "year", "title")]
    always.append(F.when((F.col("source_type") == "website") & ~F.col("raw").rlike("(?i)https?://"), F.lit("url")))
    for kind, (each, groups) in NEEDED.items():
        always += [F.when((F.col("source_type") == kind) & gone(c), F.lit(c)) for c in each]
        always += [F.when((F.col("source_type") == kind) & gone(a) & gone(b), F.lit(f"{a}|{b}")) for a, b in groups]
    return F.when(F.col("source_type") == "unknown", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*always)))


def completeness(refs: DataFrame) -> DataFrame:
    """doc_id, line_no, source_type and missing of references that lack fields."""
    return refs.withColumn("missing", missing_fields()).where(F.size("missing") > 0).select("doc_id", "line_no", "source_type", "raw", "missing")


def institution_acronym_only(refs: DataFrame, acronyms: DataFrame) -> DataFrame:
    """References whose institution is only an acronym that neither the document nor the dictionary explains."""
    bare = F.regexp_replace(F.trim("first_author"), "\\.$", "")
    rows = refs.where(bare.rlike("^[A-Z]{2,8}$")).withColumn("acronym", F.lower(bare))
    rows = rows.join(acronyms.select("doc_id", "acronym"), ["doc_id", "acronym"], "left_anti").where(~F.upper("acronym").isin(*dims.ACRONYMS))
    return issues(rows, "INSTITUTION_ACRONYM_ONLY", "suggestion", F.col("raw"))


def span_coverage(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, para_no, span and the share of the span's characters that are italic. spans: doc_id, para_no, span, start, end.

    Runs tell how many italic characters stand before their start; the ends of spans look that up at the last run that starts at or before them, by
    one window over runs and ends in order of place, so a paragraph costs the sum of both, not the product. Null where no character is covered.
    """
    before = Window.partitionBy("doc_id", "para_no").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    sized = runs.select("doc_id", "para_no", "run_no", F.length(text_of("text")).alias("size"), F.coalesce("italic", F.lit(False)).alias("italic"))
    told = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    run = F.struct(told(F.col("size")).alias("at"), "size", "italic", told(F.when(F.col("italic"), F.col("size")).otherwise(0)).alias("slanted"))
    marks = sized.select("doc_id", "para_no", run.alias("run")).select("doc_id", "para_no", F.col("run.at").alias("place"), "run", F.lit(None).cast("string").alias("span"), F.lit(None).cast("int").alias("side"))
    side = lambda c, k: F.struct(F.greatest(F.col(c), F.lit(0)).cast("long").alias("place"), F.lit(k).alias("side"))
    ends = spans.select("doc_id", "para_no", "span", F.inline(F.array(side("start", 0), side("end", 1)))).withColumn("run", F.lit(None).cast(marks.schema["run"].dataType))
    upto = Window.partitionBy("doc_id", "para_no").orderBy("place", F.col("span").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = marks.unionByName(ends).withColumn("met", F.last("run", ignorenulls=True).over(upto)).where("span is not null and met is not null")
    inside = F.least(F.col("place") - F.col("met.at"), F.col("met.size").cast("long"))
    found = met.select("doc_id", "para_no", "span", "side", (F.col("met.at") + inside).alias("covered"), (F.col("met.slanted") + F.when(F.col("met.italic"), inside).otherwise(0)).alias("slanted"))
    gone = lambda c: F.max(F.when(F.col("side") == 1, F.col(c))) - F.max(F.when(F.col("side") == 0, F.col(c)))
    return found.groupBy("doc_id", "para_no", "span").agg((gone("slanted") / F.nullif(gone("covered"), F.lit(0))).alias("coverage"))


#: The columns of references that italics are told by.
OF_ITALICS = ("title", "source_type", "style_id")


def italic_spans(refs: DataFrame) -> DataFrame:
    """doc_id, para_no, span, start and end of what the style has a rule for: whole lines of styles without italics; title and journal of articles, title of books, title and book of chapters."""
    rows = refs if "style_id" in refs.columns else refs.withColumn("style_id", F.lit("apa7"))
    slanted = F.broadcast(dims.styles(refs.sparkSession)).select("style_id", "italics")
    rows = rows.join(slanted, "style_id").select("doc_id", F.col("line_no").alias("para_no"), text_of("raw").alias("raw"), "title", "source_type", "italics")
    rows = rows.withColumn("at", F.when(F.col("title") != "", F.nullif(F.instr("raw", F.col("title")), F.lit(0))) - 1)
    # The journal is what stands between the title and a comma with a number; the book between the editors and its pages.
    rows = rows.withColumn("rest", F.expr("substring(raw, at + length(title) + 1)")).withColumn("skip", F.length(F.regexp_extract("rest", "^[.\\s]+", 0)))
    rows = rows.withColumn("journal", F.trim(F.regexp_extract(F.expr("substring(rest, skip + 1)"), "^([^,]+),\\s*\\d", 1)))
    editors = "(?i)\\(Eds?\\.\\)\\s*,\\s*"
    rows = rows.withColumn("behind", F.nullif(F.regexp_instr("raw", F.lit(editors)), F.lit(0)) - 1 + F.length(F.regexp_extract("raw", editors, 0)))
    rows = rows.withColumn("book", F.regexp_replace(F.regexp_replace(F.expr("substring(raw, behind + 1)"), "(?is)\\(pp\\.\\s*\\d.*$", ""), "[,.\\s]+$", ""))
    kind, plain = F.col("source_type"), ~F.coalesce("italics", F.lit(True))
    span = lambda name, start, size: F.struct(F.lit(name).alias("span"), start.cast("int").alias("start"), (start + size).cast("int").alias("end"))
    made = F.array(
        F.when(plain & (F.trim("raw") != ""), span("whole", F.lit(0), F.length("raw"))),
        F.when(~plain & kind.isin("journal-article", "book", "book-chapter") & F.col("at").isNotNull(), span("title", F.col("at"), F.length("title"))),
        F.when(~plain & (kind == "journal-article") & (F.col("journal") != ""), span("journal", F.col("at") + F.length("title") + F.col("skip"), F.length("journal"))),
        F.when(~plain & (kind == "book-chapter") & (F.col("book") != ""), span("book", F.col("behind"), F.length("book"))),
    )
    return rows.select("doc_id", "para_no", F.inline(F.array_compact(made)))


def italic_issues(runs: DataFrame, refs: DataFrame) -> DataFrame:
    """Names in italics to less than 60 percent that the style has in italics (journals, books), titles of articles and chapters that are to over 40, and any over 4 in a style without."""
    spans = italic_spans(refs)
    found = spans.join(span_coverage(runs, spans), ["doc_id", "para_no", "span"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    # Only lines that have runs say anything about italics.
    found = found.join(runs.where(F.trim("text") != "").select("doc_id", "para_no").distinct(), ["doc_id", "para_no"], "left_semi")
    found = found.join(refs.select("doc_id", F.col("line_no").alias("para_no"), "source_type", "raw"), ["doc_id", "para_no"])
    slanted = F.col("span").isin("journal", "book") | ((F.col("span") == "title") & (F.col("source_type") == "book"))
    bad = F.when(F.col("span") == "whole", F.col("coverage") > 0.04).when(slanted, F.col("coverage") < 0.6).otherwise(F.col("coverage") > 0.4)
    return issues(found.where(bad), "ITALIC", "suggestion", F.col("raw"), F.col("span"))


#: The issue that a DOI's status gives; where no DOI is expected, none.
DOI_ISSUES = {"no_doi": ("DOI_NONE", "info"), "unverified": ("DOI_UNVERIFIED", "warning"), "not_found": ("DOI_NOT_FOUND", "error"), "mismatch": ("DOI_MISMATCH", "warning"), "valid": ("DOI_VALID", "success")}


def doi_issues(statuses: DataFrame, refs: DataFrame) -> DataFrame:
    """One issue for each reference with the status of its DOI (doc_id, line_no, status), about the link or, without one, author and year."""
    rows = statuses.join(refs.select("doc_id", "line_no", "doi", "first_author", "year"), ["doc_id", "line_no"])
    pick = lambda k: F.coalesce(*[F.when(F.col("status") == s, F.lit(v[k])) for s, v in DOI_ISSUES.items()])
    about = F.coalesce(F.concat(F.lit("https://doi.org/"), F.col("doi")), F.concat_ws(", ", F.coalesce("first_author", F.lit("-")), "year"))
    return rows.where(F.col("status").isin(*DOI_ISSUES)).select("doc_id", pick(0).alias("issue_code"), pick(1).alias("severity"), about.alias("code"), F.lit(None).cast("string").alias("correction"))


def title_case_ratio(title: Column | str) -> Column:
    """The share of the words of four letters or more, the first left out, that begin with a capital; null without such words."""
    words = F.filter(F.slice(F.split(F.trim(text_of(title)), "\\s+"), 2, 2**30), lambda w: F.regexp_replace(w, "[^\\p{L}]", "").rlike("^.{4,}$") & ~w.rlike("^\\p{Lu}+$"))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.rlike("^[^\\p{L}]*\\p{Lu}"))) / F.size(words))


def case_issues(refs: DataFrame) -> DataFrame:
    """Titles in title case (over 60 percent) where the style has sentence case, and the other way round (under 15)."""
    mode = F.broadcast(dims.styles(refs.sparkSession)).select("style_id", "case_mode")
    rows = refs.join(mode, "style_id").withColumn("ratio", title_case_ratio("title"))
    bad = ((F.col("case_mode") == "sentence") & (F.col("ratio") > 0.6)) | ((F.col("case_mode") == "title") & (F.col("ratio") < 0.15))
    return issues(rows.where(bad), "CASE", "suggestion", F.col("title"), F.col("case_mode"))


def fingerprint() -> Column:
    return F.concat_ws("‖", "issue_code", F.coalesce("code", "correction"))


def all_issues(parts: list[DataFrame]) -> DataFrame:
    """All issue tables together, each finding once."""
    out = parts[0].select(*ISSUE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*ISSUE))
    rest = [c for c in ISSUE if c != "doc_id"]
    first = out.withColumn("fingerprint", fingerprint()).groupBy("doc_id", "fingerprint").agg(F.min(F.struct(*rest)).alias("x"))
    return first.select("doc_id", *[f"x.{c}" for c in rest], "fingerprint")


def without_dismissed(found: DataFrame, dismissed: DataFrame) -> DataFrame:
    return found.join(dismissed.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti")


def localised(found: DataFrame, lang: str = "en") -> DataFrame:
    """Issues with a title in a language, in English where it has none, else the code."""
    dim = found.sparkSession.createDataFrame(MESSAGES, "lang string, issue_code string, title string")
    own = F.broadcast(dim.where(F.col("lang") == lang)).select("issue_code", F.col("title").alias("own"))
    english = F.broadcast(dim.where("lang = 'en'")).select("issue_code", F.col("title").alias("english"))
    return found.join(own, "issue_code", "left").join(english, "issue_code", "left").withColumn("title", F.coalesce("own", "english", "issue_code")).drop("own", "english")


def located(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Issues with source and line of their text (references before article); where it isn't found, of its first 50 characters, else nulls."""
    d = docs.select("doc_id", "article", "reference_text")
    rows = found.join(d, "doc_id", "left").withColumn("whole", F.trim("code")).withColumn("needle", F.substring("whole", 1, 50))
    at = lambda n, c: F.nullif(F.when(F.length(n) > 0, F.expr(f"locate({n}, {c})")), F.lit(0))
    hit = lambda source, n, c: F.struct(F.lit(source).alias("source"), F.size(F.split(F.substring(F.col(c), F.lit(1), at(n, c)), "\n")).alias("line"))
    tries = [F.when(at(n, c).isNotNull(), hit(source, n, c)) for n in ("whole", "needle") for source, c in (("references", "reference_text"), ("article", "article"))]
    rows = rows.withColumn("hit", F.coalesce(*tries))
    return rows.withColumn("source", F.col("hit.source")).withColumn("line", F.col("hit.line")).drop("article", "reference_text", "whole", "needle", "hit")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("doc_id", F.asc_nulls_last("source"), F.asc_nulls_last("line"), "issue_code")
