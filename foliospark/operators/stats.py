"""Statistics of reference lists and citations. Grouped aggregates by doc_id with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import dice_bigram, first_match, js_round, let, normalize_doi, normalize_title, staged, text_of, word_count
from foliospark.session import settled

percent = lambda part, whole: F.when(whole > 0, js_round(100.0 * part / whole)).otherwise(0.0).cast("int")


def year_number(c: Column | str = "year") -> Column:
    return first_match(c, "^(\\d{4})").cast("int")


def source_key() -> Column:
    """What tells sources apart: the DOI, else the normalised title."""
    return F.coalesce(normalize_doi("doi"), F.nullif(normalize_title("title"), F.lit("")))


def duplicate_dois(refs: DataFrame) -> DataFrame:
    return refs.where("doi is not null").groupBy("doc_id", F.lower("doi").alias("doi")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("line_no")).alias("lines")).where("n > 1")


#: References of a document up to which all its pairs are compared in place; longer lists go through a join.
IN_PLACE = 64


def near_duplicates(refs: DataFrame) -> DataFrame:
    """Pairs in a document with similar titles (25 characters or more, Dice .88) and first authors (.5); a missing author is similar to none.

    Exact. Lists of up to ``IN_PLACE`` such titles are compared pair by pair where they are; those of longer lists meet in ``_met_titles``.
    """
    r = refs.where("length(title) >= 25 and doc_id is not null").select("doc_id", "line_no", normalize_title("title").alias("t"), normalize_title("first_author").alias("w"))
    r = settled(r.withColumn("crowd", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))))
    few = r.where(F.col("crowd") <= IN_PLACE).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "t", "w")).alias("x")).where("size(x) > 1")
    entry = lambda x: F.struct(x["line_no"].alias("line_no"), x["t"].alias("t"), x["w"].alias("w"), numbered_bigrams(x["t"]).alias("tg"), numbered_bigrams(x["w"]).alias("wg"))

    def alike(a: Column, b: Column) -> Column:
        n, m = F.size(a["tg"]), F.size(b["tg"])
        can = (a["line_no"] < b["line_no"]) & (11 * F.greatest(n, m) <= 14 * F.least(n, m)) & (_alike(a["w"], b["w"], a["wg"], b["wg"]) >= 0.5)
        return F.when(can, F.struct(a["line_no"].alias("line_no"), b["line_no"].alias("line_b"), _alike(a["t"], b["t"], a["tg"], b["tg"]).alias("similarity")))

    pairs = lambda x: F.flatten(F.transform(x, lambda a: F.filter(F.transform(x, lambda b: alike(a, b)), lambda p: p["similarity"] >= 0.88)))
    near = few.select("doc_id", F.inline(let(F.transform("x", entry), pairs)))
    many = r.where(F.col("crowd") > IN_PLACE)
    b = many.select("doc_id", F.col("line_no").alias("line_b"), F.col("t").alias("t_b"), F.col("w").alias("w_b"))
    met = _met_titles(many).join(many, ["doc_id", "line_no"]).join(b, ["doc_id", "line_b"])
    met = met.withColumn("similarity", dice_bigram("t", "t_b")).where(F.col("similarity") >= 0.88).where(dice_bigram("w", "w_b") >= 0.5)
    return near.unionByName(met.select("doc_id", "line_no", "line_b", "similarity"))


def numbered_bigrams(t: Column) -> Column:
    """Bigrams of a normalised text; those that come again are numbered, so two texts share as many as Dice counts. None under three characters."""
    again = lambda grams: F.transform(grams, lambda g, k: F.when(F.array_position(grams, g) == k + 1, g).otherwise(F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), k), lambda h: h == g)).cast("string"))))
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) >= 3, let(grams, again)).otherwise(F.array().cast("array<string>"))


def _alike(x: Column, y: Column, x_grams: Column, y_grams: Column) -> Column:
    """``dice_bigram`` of two normalised texts whose numbered bigrams are at hand."""
    shared = 2.0 * F.size(F.array_intersect(x_grams, y_grams)) / (F.length(x) + F.length(y) - 2)
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when((F.length(x) < 3) | (F.length(y) < 3), F.lit(0.0)).otherwise(shared)


def _met_titles(r: DataFrame) -> DataFrame:
    """doc_id, line_no and line_b of all pairs of titles (t) that may be similar.

    Bigrams are numbered by occurrence, so Dice counts common ones. Of titles of x <= y bigrams with Dice .88, 11 y <= 14 x, and at least
    ceil(11 n / 14) of either's n are common. So they share one of the first n - ceil(11 n / 14) + 1 in any one order; here
    those that fewest titles of the document have come first.
    """
    t = F.col("t")
    grams = F.when(F.length(t) < 3, F.filter(F.array(t), lambda x: x != "")).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))
    split = staged(r.select("doc_id", "line_no", "t"), grams=grams).select("doc_id", "line_no", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counted = split.groupBy("doc_id", "line_no", "n", "gram").agg(F.count(F.lit(1)).cast("int").alias("times"))
    tokens = counted.select("doc_id", "line_no", "n", "gram", F.explode(F.sequence(F.lit(1), "times")).alias("k"))
    tokens = tokens.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "gram", "k")))
    tokens = tokens.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy("held", "gram", "k")))
    keys = tokens.where("held > 1 and at <= n - (11 * n + 13) div 14 + 1").select("doc_id", "line_no", "n", "gram", "k")
    other = keys.select("doc_id", F.col("line_no").alias("line_b"), F.col("n").alias("n_b"), "gram", "k")
    return keys.join(other, ["doc_id", "gram", "k"]).where("line_no < line_b and 11 * greatest(n, n_b) <= 14 * least(n, n_b)").select("doc_id", "line_no", "line_b").distinct()


def ambiguous_years(refs: DataFrame) -> DataFrame:
    """Authors with several works of one year without letters behind it."""
    plain = F.regexp_replace("year", "[a-z]$", "")
    g = refs.where(F.col("year").rlike("^\\d{4}")).groupBy("doc_id", F.lower("first_author").alias("author"), plain.alias("year"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("year").rlike("[a-z]$")).alias("lettered")).where("n > 1 and not lettered").drop("lettered")


def year_histogram(refs: DataFrame) -> DataFrame:
    """doc_id, year (null: unknown) and n."""
    return refs.groupBy("doc_id", year_number().alias("year")).agg(F.count(F.lit(1)).alias("n"))


def type_breakdown(refs: DataFrame) -> DataFrame:
    counts = refs.groupBy("doc_id", "source_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.withColumn("pct", percent(F.col("n"), total))


def ref_stats(refs: DataFrame, docs: DataFrame, citations: DataFrame) -> DataFrame:
    """One row a document: references, unique sources, ages, types, DOI coverage, citations and their density.

    docs: doc_id, article, as_of_year. citations: doc_id and n (citations in one instance).
    """
    years = docs.select("doc_id", "as_of_year")
    of_type = lambda *t: percent(F.count_if(F.col("source_type").isin(*t)), F.count(F.lit(1)))
    journal = F.col("source_type") == "journal-article"
    age = F.col("as_of_year") - year_number()
    r = refs.join(years, "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct(source_key()).alias("unique_sources"), F.count_if(year_number().isNull()).alias("unknown_years"), F.median(age).alias("median_age"),
        F.count("doi").alias("n_doi"), percent(F.count("doi"), F.count(F.lit(1))).alias("doi_pct"), F.count_if(journal).alias("n_journal"),
        percent(F.count_if(journal & F.col("doi").isNotNull()), F.count_if(journal)).alias("journal_doi_pct"), of_type("journal-article").alias("journal_pct"), of_type("book", "book-chapter").alias("book_pct"), of_type("website").alias("website_pct"),
    )
    return r.join(densities(docs, citations), "doc_id")


def densities(docs: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, n_words, n_paragraphs, n_citations and the citations for 1,000 words and for a paragraph. citations: doc_id and n (citations in one instance)."""
    c = citations.groupBy("doc_id").agg(F.sum("n").alias("n_citations"))
    words = docs.select("doc_id", word_count("article").alias("n_words"), F.size(F.filter(F.split(text_of("article"), "\n+"), lambda p: F.trim(p) != "")).alias("n_paragraphs"))
    out = words.join(c, "doc_id", "left").withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))
    return out.withColumns({"per_1000_words": F.when(F.col("n_words") > 0, js_round(1000.0 * F.col("n_citations") / F.col("n_words"), 1)).otherwise(0.0), "per_paragraph": F.when(F.col("n_paragraphs") > 0, js_round(1.0 * F.col("n_citations") / F.col("n_paragraphs"), 1)).otherwise(0.0)})


def citation_count(numeric: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """doc_id and n of each citation instance: the numbers in brackets, or one for each part."""
    if numeric is not None:
        return numeric.select("doc_id", F.size("numbers").alias("n"))
    return parts.groupBy("doc_id", "position").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "n")


def cited_counts(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, line_no and times_cited of every reference; 0 where never; with first author and year where they were read."""
    n = matches.where("line_no is not null").groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n"))
    return refs.join(n, ["doc_id", "line_no"], "left").select("doc_id", "line_no", *[c for c in ("first_author", "year") if c in refs.columns], F.coalesce("n", F.lit(0)).alias("times_cited"))


def top_k(counts: DataFrame, by: str, label: str, k: int, least: int = 1) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(by), label)
    return counts.where(F.col(by) >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def most_cited(counts: DataFrame, k: int = 5) -> DataFrame:
    return top_k(counts, "times_cited", "line_no", k)


def dominant_authors(refs: DataFrame, k: int = 5) -> DataFrame:
    return top_k(refs.where("first_author is not null").groupBy("doc_id", "first_author").agg(F.count(F.lit(1)).alias("n")), "n", "first_author", k, 2)


def dominant_journals(refs: DataFrame, k: int = 5) -> DataFrame:
    named = refs.where("journal is not null").groupBy("doc_id", F.lower("journal").alias("journal")).agg(F.count(F.lit(1)).alias("n"))
    return top_k(named, "n", "journal", k, 2)


def year_range(refs: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """References in, out of and of unknown relation to a range, both ends included; percent in of the known and of all."""
    y = year_number()
    inside = y.between(first, last)
    return refs.groupBy("doc_id").agg(
        F.count_if(inside).alias("in_range"), F.count_if(~inside).alias("out_of_range"), F.count_if(y.isNull()).alias("unknown"),
        percent(F.count_if(inside), F.count(y)).alias("pct_of_known"), percent(F.count_if(inside), F.count(F.lit(1))).alias("pct_of_all"),
    )


def recency(lines: DataFrame, as_of_year: Column | int, years: int = 10) -> DataFrame:
    """Reference lines with any four-digit year, without one, and recent ones (as_of_year - year <= years)."""
    y = first_match("raw", "\\b((?:19|20)\\d{2})\\b").cast("int")
    as_of = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    recent = F.count_if(as_of - y <= years)
    return lines.groupBy("doc_id").agg(F.count(y).alias("with_year"), (F.count(F.lit(1)) - F.count(y)).alias("without_year"), recent.alias("recent"), percent(recent, F.count(y)).alias("recent_pct"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues by severity and category; an issue in several categories counts in each."""
    code = F.col("issue_code")
    labels = F.array_compact(F.array(
        F.when(code.rlike("DANGLING|NOT_IN_LIST|UNCITED|MISMATCH|AMBIGUOUS|COLLISION"), F.lit("matching")), F.when(code.rlike("ORDER|SEQUENTIAL|ALPHABETICAL"), F.lit("order")),
        F.when(code.rlike("FORMAT|SEPARATOR|ET_AL|STYLE|ITALIC|CASE"), F.lit("format")), F.when(code.rlike("DUPLICATE|METADATA|LABEL|AUTHOR_LIST|AMBIGUOUS_YEAR"), F.lit("references")), F.when(code.rlike("DOI"), F.lit("doi")),
    ))
    rows = issues.select("doc_id", "severity", F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("other")))).alias("category"))
    return rows.groupBy("doc_id", "severity", "category").agg(F.count(F.lit(1)).alias("n"))


def diff_summary(diff: DataFrame) -> DataFrame:
    counts = diff.groupBy("pair_id").pivot("type", ["add", "del", "modified", "same"]).count()
    return counts.select("pair_id", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("add", "added"), ("del", "deleted"), ("modified", "modified"), ("same", "unchanged"))])


def unique_sources(refs: DataFrame) -> DataFrame:
    """Distinct sources over the whole corpus, exact by document and approximate over all."""
    return refs.agg(F.count(F.lit(1)).alias("n_refs"), F.approx_count_distinct(source_key(), 0.01).alias("approx_sources"))


