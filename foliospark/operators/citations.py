"""In-text citations: numeric, author-date, narrative, author-page; malformed ones; style signals; captions and links.

Input: ``doc_id`` and an article text. One projection with native patterns finds all matches of a document with their
positions; rows come from explodes, so extraction itself shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import dims
from foliospark.functions.text import find_all, first_match, let, staged, text_of

# Patterns of the citation forms.
NUMBERS = "\\d+(?:\\s*[,\\-–]\\s*\\d+)*"
NAME = "[\\p{Lu}\\p{Lo}][\\p{L}'’.\\-]+"
SMALL = "van|der|den|von|de|la|le|du|bin|ibn|binti|al|el|da|dos|das|do|ter|ten"
YEAR = "\\d{4}[a-z]?|n\\.d\\."
NARRATIVE = (
    f"(?<![\\p{{L}}\\p{{N}}])(?:(?:{SMALL})\\s+)?{NAME}"
    f"(?:(?:\\s*,\\s*(?:and|dan)\\s+|\\s*,\\s*|\\s*&\\s*|\\s+(?:and|dan|of|for|the|ng|sa|at|para|{SMALL})\\s+|(?<!\\p{{L}}{{2,40}}\\.)[ \\t]+){NAME}){{0,9}}"
    f"(?:\\s+et\\s+al\\.?)?(?:\\s*\\[[A-Za-z]{{2,8}}\\])?\\s*,?\\s*\\((?:{YEAR})[,)]"
)
EDITORIAL = "(?i)^(received|revised|accepted|submitted|published|available\\s+online|in\\s+press|first\\s+published)\\s*:"
PARENTHESES = "\\([^()]+?\\)"


def number_list(inner: Column) -> Column:
    """The numbers of ``1, 3-5``; a range that runs backwards gives none."""
    chunk = lambda c: F.trim(c)
    a = lambda c: first_match(c, "^(\\d{1,9})\\s*[-–]\\s*\\d{1,9}$").cast("int")
    b = lambda c: first_match(c, "^\\d{1,9}\\s*[-–]\\s*(\\d{1,9})$").cast("int")
    one = lambda c: first_match(c, "^(\\d{1,9})$").cast("int")
    empty = F.array().cast("array<int>")

    def numbers(c: Column) -> Column:
        c = chunk(c)
        return F.when(a(c) <= b(c), F.sequence(a(c), F.greatest(a(c), b(c)))).when(one(c).isNotNull(), F.array(one(c))).otherwise(empty)

    return F.flatten(F.transform(F.split(inner, ","), numbers))


def numeric_citations(df: DataFrame, text: str = "article") -> DataFrame:
    """doc_id, position, raw, form and numbers; parentheses count only in documents without brackets."""
    # Parentheses are looked for only where there are no brackets.
    brackets, parens = find_all(text, f"\\[{NUMBERS}\\]"), find_all("t", f"\\({NUMBERS}\\)")
    rows = df.select("doc_id", F.col(text).alias("t"), brackets.alias("b")).select(
        "doc_id", F.when(F.size("b") > 0, "bracket").otherwise("paren").alias("form"), F.explode(F.when(F.size("b") > 0, F.col("b")).otherwise(parens)).alias("m")
    )
    inner = F.expr("substring(m.raw, 2, length(m.raw) - 2)")
    return rows.select("doc_id", F.col("m.position").alias("position"), F.col("m.raw").alias("raw"), "form", number_list(inner).alias("numbers"))


def acronym_pair(c: Column | str) -> Column:
    """full and acronym of ``Full Name (ACR)`` or ``[ACR]``, null where there is none."""
    pattern = "^(.+?)\\s*[\\(\\[]([A-Z]{2,8})[\\)\\]]"
    return F.when(text_of(c).rlike(pattern), F.struct(F.trim(first_match(c, pattern, 1)).alias("full"), first_match(c, pattern, 2).alias("acronym")))


def listed_names(c: Column) -> Column:
    """What stands between commas, trimmed, without empty pieces."""
    return F.array_remove(F.split(F.trim(c), " *, *"), "")


def marked_authors(c: Column | str) -> Column:
    """An author text whose ampersands, and/dan became a control character."""
    return F.regexp_replace(F.trim(text_of(c)), "(?i)\\s*&\\s*|\\s+and\\s+|\\s+dan\\s+", "\u0001")


def names_between_marks(s: Column) -> Column:
    """Names between commas and marks (``marked_authors``); what follows the last mark is one name."""
    names = lambda x: listed_names(F.translate(x, "\u0001", ","))
    last = F.substring_index(s, "\u0001", -1)
    before = F.substring(s, F.lit(1), F.length(s) - F.length(last) - 1)
    return F.when(s.contains("\u0001"), F.concat(names(before), F.array_remove(F.array(F.trim(last)), ""))).otherwise(names(s))


def with_authors(rows: DataFrame, part: str) -> DataFrame:
    """``rows`` with columns about the author side of a citation, the column ``part``."""
    part = F.col(part)
    et_al = part.rlike("(?i)et\\s+al\\.?")
    clean = F.trim(F.regexp_replace(part, "(?i)\\s*,?\\s*et\\s+al\\.?", ""))
    rows = staged(rows, __clean=clean, has_et_al=et_al, used_amp=part.contains("&"), used_and=part.rlike("(?i)\\b(and|dan)\\b"))
    c = F.col("__clean")
    rows = staged(rows, __marked=marked_authors(c), __pair=acronym_pair(c).isNotNull())
    rows = staged(rows, authors=F.when(F.col("__pair"), F.array(c)).otherwise(names_between_marks(F.col("__marked")))).drop("__clean", "__marked", "__pair")
    n = F.size("authors")
    return rows.withColumns({"author_count": F.when(F.col("has_et_al"), F.greatest(n, F.lit(3))).otherwise(n), "first_author": F.get("authors", F.lit(0))})


PART = ["doc_id", "position", "raw", "part_no", "part", "year", "page_info", "grouped", "authors", "author_count", "first_author", "has_et_al", "used_amp", "used_and", "type"]


def paren_citations(df: DataFrame, text: str = "article") -> DataFrame:
    """doc_id, position, raw, content of parenthetical author-date groups; decimals and editorial dates are no years."""
    rows = df.select("doc_id", F.explode(find_all(text, PARENTHESES)).alias("m"))
    rows = rows.select("doc_id", F.col("m.position").alias("position"), F.col("m.raw").alias("raw"), F.trim(F.expr("substring(m.raw, 2, length(m.raw) - 2)")).alias("content"))
    dated = F.col("content").rlike("(?<![.\\d])\\d{4}[a-z]?\\b|(?i:\\bn\\.d\\.)")
    editorial = F.forall(F.split("content", ";"), lambda s: F.trim(s).rlike(EDITORIAL))
    return rows.where(dated & ~F.col("content").rlike("^[\\d\\s,.\\-–:;]+$") & ~editorial)


def parse_parts(groups: DataFrame) -> DataFrame:
    """One row for each part and year of the groups: part_no, part, authors and what goes with them, year, page_info, grouped."""
    tail = f",?\\s*(?<![.\\d])({YEAR})(?:\\s*[,:]\\s*(.+))?$"
    rows = groups.select("doc_id", "position", "raw", F.posexplode(F.split("content", ";")).alias("part_no", "part")).withColumn("part", F.trim("part"))
    who = F.trim(F.regexp_replace(F.regexp_replace("part", tail, ""), ",\\s*$", ""))
    rows = staged(rows, first_year=first_match("part", tail, 1), tail=F.trim(first_match("part", tail, 2)), who=who)
    rows = rows.where(F.col("first_year").isNotNull() & F.regexp_replace("who", f"(?i)^(?:{SMALL})\\s+", "").rlike("^[\\p{Lu}\\p{Lo}]"))
    more = F.split("tail", "\\s*,\\s*")
    rows = staged(rows, more=more, grouped=F.coalesce(F.forall(more, lambda t: t.rlike("(?i)^(\\d{4}[a-z]?|n\\.d\\.)$")), F.lit(False)))
    years = F.when(F.col("grouped"), F.concat(F.array("first_year"), "more")).otherwise(F.array("first_year"))
    rows = rows.select("*", F.explode(years).alias("year"), F.when(~F.col("grouped"), F.col("tail")).alias("page_info"), F.lit("parenthetical").alias("type"))
    return with_authors(rows, "who").select(*PART)


def narrative_matches(df: DataFrame, text: str = "article") -> DataFrame:
    """doc_id, start, found and rest (60 characters from the end of the match on) of all matches of ``NARRATIVE``.

    No name holds an opening parenthesis, so a match lies between two of them, of which the second has a year behind it; the text
    before others isn't searched for names.
    """
    before_year = find_all("t", f"(?<![^(])[^(]++(?=\\((?:{YEAR})[,)])")
    rows = df.select("doc_id", text_of(text).alias("t")).select("doc_id", "t", F.explode(before_year).alias("m"))
    year = F.regexp_extract(F.expr("substring(t, m.position + length(m.raw) + 1, 8)"), f"^\\((?:{YEAR})[,)]", 0)
    rows = staged(rows, whole=F.concat("m.raw", year))
    rows = staged(rows, found=F.regexp_extract("whole", NARRATIVE, 0)).where("found <> ''")
    start = F.col("m.position") + F.length("whole") - F.length("found")
    return rows.select("doc_id", start.alias("start"), "found", F.expr("substring(t, m.position + length(whole), 60)").alias("rest"))


def narrative_citations(df: DataFrame, text: str = "article") -> DataFrame:
    """``Author et al. (2020)``: the same columns as parsed parts, one row for each year in the parentheses.

    Words that open a sentence and places are taken off, as is the end of a sentence before; author lists of over eight words are no
    citations.
    """
    rows = narrative_matches(df, text)
    stop = "|".join([*dims.SKIP_WORDS, *dims.PLACE_WORDS])
    name = F.regexp_replace(F.trim(F.regexp_replace("found", f"\\s*,?\\s*\\((?:{YEAR})[,)]$", "")), "^(The|A|An)\\s+", "")
    name = let(name, lambda n: F.coalesce(first_match(n, "^(?:.*[\\p{L}]{4,})\\.\\s+(.+)$", 1), n))
    name = F.trim(F.regexp_replace(name, f"^(?:(?:(?i:{stop})|al|et|cf),?\\s+){{1,4}}", ""))
    # (2020, 2021): further years follow the comma that ended the match.
    further = F.when(F.col("found").endswith(","), first_match("rest", "^,?\\s*((?:\\d{4}[a-z]?\\s*,?\\s*)+)\\)", 1))
    more = F.filter(F.split(further, "[\\s,]+"), lambda y: y.rlike("^\\d{4}[a-z]?$"))
    years = F.concat(F.array(first_match("found", f"\\(({YEAR})[,)]$", 1)), F.coalesce(more, F.array().cast("array<string>")))
    rows = staged(rows, part=name, years=years)
    rows = rows.where((F.col("part") != "") & (F.size(F.split("part", "\\s+")) <= 8) & ~F.lower("part").isin(*dims.SKIP_WORDS))
    position = F.col("start") + F.greatest(F.expr("locate(part, found)") - 1, F.lit(0))
    rows = rows.select("doc_id", position.alias("position"), F.col("found").alias("raw"), F.lit(0).alias("part_no"), "part", F.explode("years").alias("year"), F.lit(None).cast("string").alias("page_info"), (F.size("years") > 1).alias("grouped"), F.lit("narrative").alias("type"))
    return with_authors(rows, "part").select(*PART)


def author_date_citations(df: DataFrame, text: str = "article") -> DataFrame:
    """Parenthetical and narrative citations together. A narrative match needs a name before its parenthesis, so the two never share a year."""
    return parse_parts(paren_citations(df, text)).unionByName(narrative_citations(df, text))


def author_page_citations(df: DataFrame, text: str = "article") -> DataFrame:
    """``(Smith 45)``: position, raw, part_no, part, page and the author columns; groups with a four-digit year are none."""
    rows = df.select("doc_id", F.explode(find_all(text, PARENTHESES)).alias("m"))
    rows = rows.select("doc_id", F.col("m.position").alias("position"), F.col("m.raw").alias("raw"), F.trim(F.expr("substring(m.raw, 2, length(m.raw) - 2)")).alias("content"))
    rows = rows.where(~F.col("content").rlike("(?<![.\\d])\\d{4}\\b")).select("doc_id", "position", "raw", F.posexplode(F.split("content", ";")).alias("part_no", "part"))
    pattern = "^(.+?),?\\s+(\\d+(?:[-–]\\d+)?)$"
    rows = rows.withColumn("part", F.trim("part")).where(F.col("part").rlike(pattern))
    rows = staged(rows, who=F.trim(first_match("part", pattern, 1)), page=first_match("part", pattern, 2))
    return with_authors(rows, "who").drop("who")


def citation_context(text: Column, start: Column, end: Column) -> Column:
    """A piece of text around a match that can be searched for: back to a parenthesis, a full stop or 60 characters, on to the closing parenthesis or 40."""
    before = F.substring(text, F.greatest(start - 59, F.lit(1)), F.least(start, F.lit(60)))
    head = F.regexp_extract(before, "([^(.]*)$", 1)
    tail = F.regexp_extract(F.substring(text, end + 1, F.lit(40)), "^([^).]*\\)?)", 1)
    return F.trim(F.concat(head, F.substring(text, start + 1, end - start), tail))


CITED = "(?:[\\p{Lu}\\p{Lo}][^()]{1,140}?\\d{4}[a-z]?|\\d{4}[a-z]?)"


def malformed_citations(df: DataFrame, text: str = "article") -> DataFrame:
    """doc_id, issue_type, position, raw and suggestion of badly typed citations, in order of position."""
    return malformed_rows(df, text).orderBy("doc_id", "position")


def malformed_rows(df: DataFrame, text: str = "article") -> DataFrame:
    """``malformed_citations`` in no order."""
    base = df.select("doc_id", text_of(text).alias("t"))

    def branch(kind: str, pattern: str, keep: Column | None = None, raw: Column | None = None, suggestion: Column | None = None, sign: str | None = None) -> DataFrame:
        rows = (base if sign is None else base.where(F.col("t").rlike(sign))).select("doc_id", "t", F.explode(find_all("t", pattern)).alias("x")).select("doc_id", "t", F.col("x.raw").alias("m"), F.col("x.position").alias("position"))
        rows = rows if keep is None else rows.where(keep)
        around = citation_context(F.col("t"), F.col("position"), F.col("position") + F.length("m"))
        rows = rows.withColumn("raw", around if raw is None else raw)
        return rows.select("doc_id", F.lit(kind).alias("issue_type"), "position", "raw", (F.lit(None).cast("string") if suggestion is None else suggestion).alias("suggestion"))

    m = F.col("m")
    proper = F.regexp_replace(F.col("raw"), "(?i)\\bet\\s+al\\.?", "et al.")
    pair = "(?<![\\p{L}\\p{N}])([\\p{Lu}\\p{Lo}][\\p{L}'\\-]+)\\s*,\\s*([\\p{Lu}\\p{Lo}][\\p{L}'\\-]+)\\s*,?\\s*([Ee]t\\s+[Aa]l\\.?)"
    opening = F.lower(first_match("m", pair, 1)).isin(*dims.SKIP_WORDS, *dims.PLACE_WORDS, "recently", "currently", "generally", "also", "then", "again")
    after = F.substring(F.col("t"), F.col("position") + 1, F.lit(80))
    found = [
        branch("no_space_before_paren", "[\\p{L}\\p{N}'’\\-]*\\p{L}\\([\\p{Lu}\\p{Lo}][^()]{2,140}?\\d{4}[a-z]?[^()]{0,20}\\)", raw=m, suggestion=F.regexp_replace(m, "\\(", " ("), sign="\\p{L}\\([\\p{Lu}\\p{Lo}]"),  # a word is searched for to its end from each of its letters
        branch("et_al_case", "(?i)\\bet\\s+al\\.?", keep=m != "et al.", suggestion=proper),
        branch("multiple_authors_before_et_al", pair, keep=~opening & ~first_match("m", pair, 2).rlike("^[A-Z]\\.?$"), suggestion=F.replace(F.col("raw"), m, F.concat(first_match("m", pair, 1), F.lit(" et al.")))),
        branch("no_space_around_ampersand", "[\\p{Lu}\\p{Lo}][\\p{L}'\\-]+\\s?&\\s?[\\p{Lu}\\p{Lo}][\\p{L}'\\-]+", keep=~m.contains(" & ") & after.rlike("\\d{4}"), suggestion=F.replace(F.col("raw"), m, F.regexp_replace(m, "\\s?&\\s?", " & "))),
        branch("extra_space_in_paren", f"\\( +{CITED}\\)|\\({CITED} +\\)", raw=m, suggestion=F.regexp_replace(F.regexp_replace(m, "^\\(\\s+", "("), "\\s+\\)$", ")")),
        branch("no_space_after_paren", f"\\({CITED}\\)\\p{{L}}", raw=F.expr("right(m, 22)")),
        unopened_parentheses(base),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def unopened_parentheses(base: DataFrame) -> DataFrame:
    """Closing parentheses after a year that no opening one belongs to.

    The balance starts again at each such parenthesis, so one is unopened where the running sum reaches a new minimum.
    """
    # Texts whose parentheses all follow each other in pairs, which one look tells, have none.
    rows = base.where(~F.col("t").rlike("\\A[^()]*+(?:\\([^()]*+\\)[^()]*+)*+\\z")).select("doc_id", "t", F.explode(find_all("t", "[()]")).alias("x")).select("doc_id", "t", F.col("x.raw").alias("c"), F.col("x.position").alias("at"))
    w = Window.partitionBy("doc_id").orderBy("at")
    rows = rows.withColumn("sum", F.sum(F.when(F.col("c") == "(", 1).otherwise(-1)).over(w))
    rows = rows.withColumn("least", F.least(F.lit(0), F.coalesce(F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rows = rows.withColumn("opened", F.max(F.when(F.col("c") == "(", F.col("at"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    bad = rows.where((F.col("c") == ")") & (F.col("sum") < F.col("least"))).withColumn("from", F.greatest(F.col("at") - 90, F.lit(0)))
    bad = bad.where(F.expr("substring(t, from + 1, at - from + 1)").rlike("(?i)(?:\\d{4}[a-z]?|et\\s+al\\.?,?\\s*\\d{4}[a-z]?)\\)$"))
    bad = bad.withColumn("near", F.when(F.col("opened") >= F.col("from"), F.col("opened")).otherwise(F.col("from") - F.length(F.regexp_extract(F.expr("substring(t, greatest(from - 40, 0) + 1, least(from, 40))"), "(\\S*)$", 1))))
    bad = bad.withColumn("raw", F.trim(F.expr("substring(t, near + 1, at - near + 1)"))).withColumn("inner", F.expr("substring(raw, 1, length(raw) - 1)"))
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(F.col("inner"), F.lit(")"), F.lit(";")), ";\\s*;", ";"), "^;\\s*", ""), "\\s*;\\s*$", "")
    suggestion = F.when(F.col("inner").contains(")"), F.concat(F.when(fixed.startswith("("), F.lit("")).otherwise(F.lit("(")), fixed, F.lit(")")))
    return bad.select("doc_id", F.lit("missing_open_paren").alias("issue_type"), F.col("near").alias("position"), "raw", suggestion.alias("suggestion"))


# The shapes of citations in a text; of bare numbers also what stands before them.
BRACKETED = "\\[\\d{1,3}(?:\\s*[,\\-–]\\s*\\d{1,3})*\\]"
BARE = "(?:\\d+\\.\\d+\\s*)?\\((?:Joint\\s+)?\\d{1,3}(?:\\s*[,\\-–]\\s*\\d{1,3})*\\)"
DATED = "\\([\\p{Lu}\\p{Lo}][^()]*?,?\\s*\\d{4}[a-z]?\\)"
PAGED = "\\([\\p{Lu}\\p{Lo}][\\p{L}'\\-]+\\s+\\d+(?:[-–]\\d+)?\\)"


def mixed_style(df: DataFrame, text: str = "article") -> DataFrame:
    """doc_id, counts of four citation shapes and whether at least two are used.

    Bare numbers, (1), behind a decimal score or as joint ranks are no citations, nor are three or more that count up at 25 to 400
    characters from each other; they are used from five on, if above .3 of the author-date ones. Author-page ones are used where no
    author-date one is.
    """
    base = df.select("doc_id", text_of(text).alias("t"))
    counts = base.select("doc_id", *[F.regexp_count("t", F.lit(p)).alias(n) for p, n in ((BRACKETED, "bracket"), (DATED, "author_date"), (PAGED, "author_page"))])
    bare = base.select("doc_id", F.explode(find_all("t", BARE)).alias("x")).where(F.col("x.raw").startswith("(") & ~F.lower("x.raw").contains("joint"))
    bare = bare.select("doc_id", F.col("x.position").alias("at"), F.regexp_replace("x.raw", "\\D", "").cast("decimal(38,0)").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("at")
    gap = F.col("at") - F.lag("at").over(w)
    follows = F.coalesce((F.col("n") == F.lag("n").over(w) + 1) & (gap >= 25) & (gap < 400), F.lit(False))
    runs = bare.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(w)).groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("k"))
    parens = runs.where("k < 3").groupBy("doc_id").agg(F.sum("k").alias("paren"))
    out = counts.join(parens, "doc_id", "left").withColumn("paren", F.coalesce("paren", F.lit(0)).cast("int"))
    used = [F.col("bracket") > 0, (F.col("paren") >= 5) & (F.col("paren") > 0.3 * F.col("author_date")), F.col("author_date") > 0, (F.col("author_page") > 0) & (F.col("author_date") == 0)]
    return out.select("doc_id", "bracket", "paren", "author_date", "author_page", (sum(u.cast("int") for u in used) >= 2).alias("mixed"))


# Weights of the signals in a reference line, (style, pattern, weight).
LINE_SIGNALS = [
    ("ieee", "^\\[\\d+\\]", 4.0), ("vancouver", "^\\d+\\.\\s", 3.0), ("mla9", "^\\d+\\.\\s", -0.5), ("apa7", "\\(\\d{4}[a-z]?\\)", 1.0), ("harvard", "\\(\\d{4}[a-z]?\\)", 1.0),
    ("chicago", "^[^.]+\\.\\s\\d{4}[a-z]?\\.\\s", 3.0), ("chicago", '"[^"]+"', 1.0), ("ieee", '"[^"]+"', 1.0), ("mla9", '"[^"]+"', 1.0), ("harvard", "(?<!\\p{L})'[^']+'", 2.0),
    ("mla9", "(?i)\\bvol\\.\\s*\\d", 2.0), ("ieee", "(?i)\\bvol\\.\\s*\\d", 1.0), ("mla9", "(?i)\\bno\\.\\s*\\d", 1.0), ("mla9", "(?i)\\bpp\\.\\s*\\d", 1.0), ("chicago", "(?i)\\bpp\\.\\s*\\d", 0.5), ("harvard", "(?i)\\bpp\\.\\s*\\d", 0.5),
    ("harvard", "(?i)\\d+\\(\\d+\\),\\s*pp\\.", 2.5), ("apa7", "\\d+\\(\\d+\\),\\s*\\d+[-–]\\d+", 2.5), ("vancouver", "\\d{4};\\d+\\(\\d+\\):\\d+", 4.0), ("vancouver", "^(?:\\d+\\.\\s*)?\\p{Lu}[\\p{L}'\\-]+\\s\\p{Lu}{1,3},", 2.0), ("ieee", "^(?:\\[\\d+\\]\\s*)?(?:\\p{Lu}\\.\\s*)+\\p{Lu}[\\p{L}'\\-]+,", 2.0),
]
STYLE_ORDER = ["apa7", "harvard", "chicago", "mla9", "ieee", "vancouver"]


def detect_style(parts: DataFrame) -> DataFrame:
    """doc_id, style_id and confidence from the article's citations and the reference lines (doc_id, article, reference_text)."""
    article = text_of("article")
    brackets, parens = F.regexp_count(article, F.lit("\\[\\d+(?:\\s*[,\\-–]\\s*\\d+)*\\]")), F.regexp_count(article, F.lit("\\(\\d+(?:\\s*[,\\-–]\\s*\\d+)*\\)"))
    dated = F.regexp_count(article, F.lit("\\(\\p{Lu}[^()]*?\\d{4}[a-z]?[^()]*\\)|\\p{L}\\s*\\(\\d{4}[a-z]?\\)"))
    paged = F.regexp_count(article, F.lit("\\(\\p{Lu}[^()\\d]*\\s\\d{1,3}(?:[-–]\\d{1,3})?\\)"))
    in_text = {s: [] for s in STYLE_ORDER}
    for s in ("ieee", "vancouver"):
        in_text[s].append(F.when(F.col("brackets") > 0, 3.0).otherwise(0.0))
    in_text["vancouver"].append(F.when((F.col("brackets") == 0) & (F.col("parens") > 2) & (F.col("dated") == 0), 1.0).otherwise(0.0))
    in_text["mla9"].append(F.when(F.col("paged") > F.col("dated"), 3.0).otherwise(0.0))
    for s in ("apa7", "harvard", "chicago"):
        in_text[s].append(F.when(F.col("dated") > 0, 1.0).otherwise(0.0))
    rows = parts.select("doc_id", brackets.alias("brackets"), parens.alias("parens"), dated.alias("dated"), paged.alias("paged"), F.filter(F.transform(F.split(text_of("reference_text"), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    harvard_pages = "(?i)\\d+\\(\\d+\\),\\s*pp\\."

    def weight(style: str) -> Column:
        signals = [(p, w) for s, p, w in LINE_SIGNALS if s == style]

        def of(line: Column) -> Column:
            total = F.lit(0.0)
            for p, w in signals:
                fits = line.rlike(p) & (~line.rlike(harvard_pages) if style == "apa7" and w == 2.5 else F.lit(True))
                total = total + F.when(fits, w).otherwise(0.0)
            return total

        return F.aggregate("lines", F.lit(0.0), lambda a, line: a + of(line)) + sum(in_text[style], F.lit(0.0))

    quoted = F.exists("lines", lambda x: x.rlike("\"[^\"]+\"|(?<!\\p{L})'[^']+'"))
    plain = {"apa7": F.when(~quoted, 1.5).otherwise(0.0)}
    scores = F.array(*[F.struct((weight(s) + plain.get(s, F.lit(0.0))).alias("score"), F.lit(-k).alias("rank"), F.lit(s).alias("style")) for k, s in enumerate(STYLE_ORDER)])
    rows = rows.withColumn("scores", scores).withColumn("best", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.greatest(s["score"], F.lit(0.0)))
    confidence = F.when((F.size("lines") == 0) | (total <= 0), 0).otherwise(F.floor(100 * F.col("best.score") / total + 0.5)).cast("int")
    return rows.select("doc_id", F.col("best.style").alias("style_id"), confidence.alias("confidence"))


def cross_family_citations(df: DataFrame, family: str, text: str = "article") -> DataFrame:
    """Citations in the shapes of the other families: doc_id, family, position and raw, none inside a citation of the primary family."""
    numeric = numeric_citations(df, text).where("form = 'bracket'").select("doc_id", F.lit("numeric").alias("family"), "position", "raw")
    dated = author_date_citations(df, text).select("doc_id", F.lit("author-date").alias("family"), "position", "raw").distinct()
    paged = author_page_citations(df, text).select("doc_id", F.lit("author-page").alias("family"), "position", "raw").distinct()
    rows = numeric.unionByName(dated).unionByName(paged).withColumn("end", F.col("position") + F.length("raw"))
    w = Window.partitionBy("doc_id").orderBy("position", F.desc("end"))
    mine = F.when(F.col("family") == family, F.col("end"))
    before, behind = F.max(mine).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min(F.when(F.col("family") == family, F.col("position"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(before, F.lit(0)) <= F.col("position")) & (behind.isNull() | (behind >= F.col("end")))
    return rows.withColumn("apart", apart).where((F.col("family") != family) & F.col("apart")).select("doc_id", "family", "position", "raw")


CAPTION = "(?iu)^(figure|fig\\.|gambar|table|tabel)\\s*(\\d+(?:\\.\\d+)?)\\s*[.:\\-–]"
MENTION = "(?iu)\\b(?:figure|fig\\.|gambar|table|tabel)\\s*\\d+(?:\\.\\d+)?"


def _object_type(c: Column) -> Column:
    return F.when(F.lower(c).startswith("tab"), "table").otherwise("figure")


def figure_table_links(paragraphs: DataFrame) -> DataFrame:
    """doc_id, object_type, number, para_no and position of each mention and the paragraph of its caption (null where there is none)."""
    caption = paragraphs.where(F.trim("text").rlike(CAPTION)).select("doc_id", "para_no", _object_type(first_match(F.trim("text"), CAPTION, 1)).alias("object_type"), first_match(F.trim("text"), CAPTION, 2).alias("number"))
    captions = caption.groupBy("doc_id", "object_type", "number").agg(F.min("para_no").alias("caption_para"))
    found = paragraphs.select("doc_id", "para_no", F.trim("text").rlike(CAPTION).alias("is_caption"), F.explode(find_all("text", MENTION)).alias("x"))
    found = found.where(~(F.col("is_caption") & (F.col("x.position") == 0)))
    mention = found.select("doc_id", "para_no", F.col("x.position").alias("position"), _object_type(F.col("x.raw")).alias("object_type"), F.regexp_extract("x.raw", "(\\d+(?:\\.\\d+)?)$", 1).alias("number"))
    return mention.join(captions, ["doc_id", "object_type", "number"], "left")


def trimmed_link(c: Column) -> Column:
    """A link without the punctuation of the sentence it stands in; a closing bracket stays where its opening one is in the link."""
    s = F.regexp_replace(c, "[.,;]+$", "")
    for open_, close in (("\\(", "\\)"), ("\\[", "\\]")):
        s = let(s, _without_unopened(open_, close))
    return F.regexp_replace(s, "[.,;]+$", "")


def with_trimmed_link(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` whose column ``name`` is trimmed as ``trimmed_link`` does it, step by step."""
    bare = F.regexp_replace(name, "[.,;]+$", "")
    rows = staged(rows, **{name: bare})
    for open_, close in (("\\(", "\\)"), ("\\[", "\\]")):
        c = F.col(name)
        rows = staged(rows, **{name: F.when(c.contains(close[1:]), _without_unopened(open_, close)(c)).otherwise(c)})
    return staged(rows, **{name: bare})


def _without_unopened(open_: str, close: str):
    extra = lambda x: F.regexp_count(x, F.lit(close)) > F.regexp_count(x, F.lit(open_))
    return lambda x: F.when(extra(x), F.regexp_replace(x, f"{close}[.,;]*$", "")).otherwise(x)


def external_links(refs: DataFrame, text: str = "raw") -> DataFrame:
    """doc_id, line_no, position and url of links and bare DOIs; a DOI inside a link is not listed again."""
    found = refs.select("doc_id", "line_no", F.explode(find_all(text, "https?://\\S+|(?<![/\\w.])10\\.\\d{4,9}/\\S+")).alias("x"))
    link = trimmed_link(F.col("x.raw"))
    url = F.when(F.col("x.raw").startswith("10."), F.concat(F.lit("https://doi.org/"), link)).otherwise(link)
    return found.select("doc_id", "line_no", F.col("x.position").alias("position"), url.alias("url"))
