"""References against registries: documents, journals with coverage, proceedings, DOI metadata.

Tiers run in order and each sees only what the one before left. The similarity tier comes in two ways. ``metadata_matches`` blocks on title words
in a shuffle join, which misses pairs whose long words all differ. ``exact_metadata_matches`` finds every pair of a least score: what authors,
years, journals and pages can give at most leaves a least similarity of titles, for which two titles must share one of their rarest
bigrams. ``doi_candidates`` asks the same join for ever lower scores until the k best of a reference are sure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import compare_author, compare_volume_pages, compare_year, dice_bigram, leading_int, let, normalize_doi, normalize_isbn, normalize_issn, normalize_title, surname, year_covered
from foliospark.session import settled

FOUND, PROBABLE, SOURCE_ONLY, UNKNOWN = "SCOPUS", "PROBABLE_SCOPUS", "SCOPUS_SOURCE_ONLY", "UNKNOWN"
SURE, LIKELY = 0.93, 0.80
DOI_NOT_EXPECTED = ("book", "book-chapter", "thesis", "report", "website")


def title_keys(title: Column | str) -> Column:
    """Words of at least five characters of a normalised title, or the whole title where it has none."""
    t = normalize_title(title)
    words = F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) >= 5))
    return F.when(F.size(words) > 0, words).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def doi_matches(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, line_no and the registry title of references whose DOI is registered; of equal DOIs the last row."""
    known = documents.select(normalize_doi("doi").alias("k"), "doi", "title").where("k is not null").groupBy("k").agg(F.max(F.struct("doi", "title")).alias("d"))
    return refs.select("doc_id", "line_no", normalize_doi("doi").alias("k")).where("k is not null").join(known, "k").select("doc_id", "line_no", F.col("d.doi").alias("matched_doi"), F.col("d.title").alias("matched_title"))


def _scored(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct pairs that share a title key, with the columns of both sides (registry ones with r_)."""
    left = refs.select("doc_id", "line_no", F.explode(title_keys("title")).alias("k"))
    names = ["doi", "title", "first_author", "journal", "year", "volume", "pages", "article_number"]
    reg = documents.select(*names).distinct().withColumn("rid", F.xxhash64(*names))
    right = reg.select("rid", F.explode(title_keys("title")).alias("k"))
    pairs = left.join(right, "k").select("doc_id", "line_no", "rid").distinct()
    mine = refs.select("doc_id", "line_no", *names)
    return pairs.join(mine, ["doc_id", "line_no"]).join(reg.select("rid", *[F.col(c).alias(f"r_{c}") for c in names]), "rid")


WEIGHTS = {"title": 0.60, "author": 0.15, "journal": 0.10, "year": 0.10, "place": 0.05}


def _title_score() -> Column:
    """Dice of two titles whose numbered bigrams are at hand."""
    shared = 2.0 * F.size(F.array_intersect("grams", "r_grams")) / (F.size("grams") + F.size("r_grams"))
    return F.when((F.col("t") != "") & (F.col("t") == F.col("r_t")), 1.0).otherwise(F.coalesce(shared, F.lit(0.0)))


def _metadata_score(title: Column | None = None) -> Column:
    pages, r_pages = F.coalesce(F.nullif("pages", F.lit("")), "article_number"), F.coalesce(F.nullif("r_pages", F.lit("")), "r_article_number")
    return (
        0.60 * (dice_bigram("title", "r_title") if title is None else title) + 0.15 * compare_author("first_author", "r_first_author") + 0.10 * dice_bigram("journal", "r_journal")
        + 0.10 * compare_year("year", "r_year") + 0.05 * compare_volume_pages("volume", pages, "r_volume", r_pages)
    )


def _best(rows: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("score", F.col("r_doi").alias("doi"), F.col("r_title").alias("title")), F.struct("score", F.col("rid")))
    found = rows.groupBy("doc_id", "line_no").agg(best.alias("b"))
    return found.select("doc_id", "line_no", F.col("b.score").alias("confidence"), F.col("b.doi").alias("matched_doi"), F.col("b.title").alias("matched_title"))


def metadata_matches(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, line_no, confidence and the registry document of the best candidate of each reference, among those that share a long title word."""
    return _best(_scored(refs, documents).withColumn("score", _metadata_score()))


def numbered_grams(title: Column | str) -> Column:
    """Bigrams of a normalised title as an array; those that come again are numbered, so two titles share as many as Dice counts. Null under three characters."""
    again = lambda grams: F.transform(grams, lambda g, k: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), k), lambda h: h == g)).cast("string")))
    grams = lambda t: let(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))), again)
    return let(normalize_title(title), lambda t: F.when(F.length(t) >= 3, grams(t)))


def title_grams(rows: DataFrame, key: str, title: str = "title") -> DataFrame:
    """key, token and n (of all its tokens) of every numbered bigram of a title."""
    found = rows.select(key, (F.col("grams") if "grams" in rows.columns else numbered_grams(title)).alias("grams"))
    return found.select(key, F.explode("grams").alias("token"), F.size("grams").cast("long").alias("n"))


#: Entries of one token that a task is to meet at most on the side of references; tokens of more are dealt out by salt.
SPREAD = 20_000


def gram_entries(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' tokens (key, token, n, place, salts): ``place`` counts a title's tokens from the rarest over both sides on."""
    sides = [title_grams(left, "lid"), title_grams(right, "rid")]
    often = sides[0].select("token").unionByName(sides[1].select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    out = []
    for rows, key in zip(sides, ("lid", "rid"), strict=True):
        ranked = rows.join(often, "token").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("c", "token")))
        out.append(ranked.withColumn("salts", F.ceil(F.col("c") / SPREAD).cast("int")).drop("c"))
    return out[0], out[1]


def similar_titles(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct (lid, rid) of all pairs whose titles have a Dice similarity of ``least`` (above 0), and some others.

    left, right: entries with lid or rid. With o shared tokens of n and m, Dice is 2 * o / (n + m); so o is at least n * least / (2 - least), and of both
    titles one of the first n - o + 1 tokens is shared, in any one order. At the first shared one, what follows on either side bounds o.
    """
    ratio = least / (2.0 - least)
    prefix = lambda rows: rows.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * ratio - 1e-9) + 1)
    a = prefix(left).select("lid", "token", F.col("n").alias("ln"), F.col("place").alias("lp"), F.pmod(F.xxhash64("lid"), F.col("salts")).alias("salt"))
    b = prefix(right).select("rid", "token", F.col("n").alias("rn"), F.col("place").alias("rp"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1).cast("array<long>")).alias("salt"))
    need = least * (F.col("ln") + F.col("rn")) / 2 - 1e-9
    met = a.join(b, ["token", "salt"]).where((F.least("ln", "rn") >= ratio * F.greatest("ln", "rn") - 1e-9) & (1 + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) >= need))
    return met.select("lid", "rid").distinct()


NAMES = ["doi", "title", "first_author", "journal", "year", "volume", "pages", "article_number"]
#: What a score is made of; rows that are alike in these are one entry.
SCORED = NAMES[1:]


def _entries(rows: DataFrame, key: str, names: list[str], **more: Column) -> DataFrame:
    """Distinct rows by ``names`` as a checkpoint with a key, the year, the normalised title and what ``more`` aggregates."""
    found = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in more.items()])
    return settled(found.withColumns({key: F.monotonically_increasing_id(), "y": leading_int("year"), "t": normalize_title("title")}))


def _titles(entries: DataFrame, key: str) -> DataFrame:
    """Distinct normalised titles of entries with a key and their bigrams, as a checkpoint."""
    found = entries.where("t <> ''").select("t").distinct()
    return settled(found.select(F.monotonically_increasing_id().alias(key), "t", numbered_grams("t").alias("grams")))


def title_pairs(left: DataFrame, right: DataFrame, grams: tuple[DataFrame, DataFrame], least: float) -> DataFrame:
    """t, r_t and dice of all pairs of distinct titles (``_titles``) that are equal or have a similarity of ``least``."""
    equal = left.select("t").join(right.select("t"), "t").select("t", F.col("t").alias("r_t"), F.lit(1.0).alias("dice"))
    met = similar_titles(*grams, least).join(left, "lid").join(right.select("rid", F.col("t").alias("r_t"), F.col("grams").alias("r_grams")), "rid").where("t <> r_t")
    return equal.unionByName(met.select("t", "r_t", _title_score().alias("dice")).where(F.col("dice") >= least - 1e-9))


def _best_title(least: float) -> float:
    """A least similarity of titles as ``similar_titles`` takes it."""
    return min(1.0, max(least, 1e-6))


def exact_metadata_matches(refs: DataFrame, documents: DataFrame, least: float = LIKELY) -> DataFrame:
    """As ``metadata_matches``, over all pairs: the best registry document of each reference that has one of score ``least`` or more.

    References that are alike in all that is scored are one entry, and so are registry rows, of which the one that wins ties stays; titles are compared once for
    each pair of distinct ones. So what is compared grows with the different entries, not with their copies. What an entry can give beside the title
    (no author, journal or volume and pages: nothing for these) and equal, neighbouring or other years leave a least title similarity.
    """
    left = _entries(refs, "lid", SCORED)
    has = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs]).isNotNull()
    give = lambda kind, *cs: F.when(has(*cs), WEIGHTS[kind]).otherwise(0.0)
    row = F.xxhash64(*NAMES)
    most = F.round(give("author", "first_author") + give("journal", "journal") + give("place", "volume", "pages", "article_number"), 2)
    right = _entries(documents, "rid", SCORED, row=F.max(row), doi=F.max_by("doi", row)).withColumn("most", most)
    highest = right.agg(F.max("most")).first()[0]
    lt, rt = _titles(left, "lid"), _titles(right, "rid")
    lowest = lambda share: (least - (highest or 0.0) - WEIGHTS["year"] * share) / WEIGHTS["title"]
    pairs = settled(title_pairs(lt, rt, tuple(settled(g) for g in gram_entries(lt, rt)), _best_title(lowest(1.0))))
    apart = F.abs(F.col("y") - F.col("r_y"))
    year = F.coalesce(F.when(apart == 0, 1.0).when(apart == 1, 0.5), F.lit(0.0))
    known = right.select("row", "most", F.col("doi").alias("r_doi"), F.col("y").alias("r_y"), *[F.col(c).alias(f"r_{c}") for c in [*SCORED, "t"]])
    rows = None
    # Years are join keys where titles alone would bring together what no year can save.
    for share, ways in ((1.0, (0,)), (0.5, (-1, 1)), (0.0, ())):
        if lowest(share) > 1.0 + 1e-9:
            continue
        met = left.join(pairs.where(F.col("dice") >= lowest(share) - 1e-9), "t")
        if ways:
            met = met.withColumn("r_y", F.explode(F.array(*[F.col("y") + d for d in ways]))).join(known, ["r_t", "r_y"])
        else:
            met = met.join(known, "r_t").where(year == 0)
        met = met.where(F.col("dice") * WEIGHTS["title"] + F.col("most") + WEIGHTS["year"] * share >= least - 1e-9)
        met = met.select("lid", "row", "r_doi", "r_title", _metadata_score(F.col("dice")).alias("score")).where(F.col("score") >= least - 1e-9)
        rows = met if rows is None else rows.unionByName(met)
    names = ["doc_id", "line_no"]
    if rows is None:
        return refs.where("false").select(*names, F.lit(0.0).alias("confidence"), F.col("doi").alias("matched_doi"), F.col("title").alias("matched_title"))
    best = rows.groupBy("lid").agg(F.max_by(F.struct("score", "r_doi", "r_title"), F.struct("score", "row")).alias("b"))
    found = _of_rows(refs.select(*names, *SCORED), left.join(best, "lid").select(*SCORED, "b"), SCORED)
    return found.select(*names, F.col("b.score").alias("confidence"), F.col("b.r_doi").alias("matched_doi"), F.col("b.r_title").alias("matched_title"))


def _of_rows(rows: DataFrame, entries: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with what is known of their entry; nulls are alike."""
    e = entries.select(*[F.col(c).alias(f"e_{c}") for c in names], *[c for c in entries.columns if c not in names])
    alike = F.lit(True)
    for c in names:
        alike = alike & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    return rows.join(e, alike).drop(*[f"e_{c}" for c in names])


def source_matches(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, line_no, source_title, covered (null: unknown) and discontinued: by ISSN, then eISSN, then journal title; of equal keys the last row."""
    order = F.col("load_order") if "load_order" in sources.columns else F.lit(0)
    src = sources.select(normalize_issn("issn").alias("i"), normalize_issn("eissn").alias("e"), F.nullif(normalize_title("title"), F.lit("")).alias("t"), F.struct(order.alias("o"), "title", "coverage", "discontinued").alias("s"))
    by_issn = src.select(F.explode(F.array_compact(F.array("i", "e"))).alias("k"), "s").groupBy("k").agg(F.max("s").alias("s"))
    by_title = src.where("t is not null").groupBy(F.col("t").alias("k")).agg(F.max("s").alias("s"))
    r = refs.select("doc_id", "line_no", "year", normalize_issn("issn").alias("a"), normalize_issn("eissn").alias("b"), F.nullif(normalize_title("journal"), F.lit("")).alias("c"))
    for key, table in (("a", by_issn), ("b", by_issn), ("c", by_title)):
        r = r.join(table.select(F.col("k").alias(key), F.col("s").alias(f"s_{key}")), key, "left")
    r = r.withColumn("s", F.coalesce("s_a", "s_b", "s_c")).where("s is not null")
    return r.select("doc_id", "line_no", F.col("s.title").alias("source_title"), year_covered(F.col("s.coverage"), "year").alias("covered"), F.coalesce("s.discontinued", F.lit(False)).alias("discontinued"))


def proceedings_matches(refs: DataFrame, proceedings: DataFrame, isbn: str = "isbn") -> DataFrame:
    known = proceedings.select(normalize_isbn("isbn").alias("k"), F.struct("title", "year", "publisher").alias("p")).where("k is not null").groupBy("k").agg(F.max("p").alias("p"))
    return refs.withColumn("k", normalize_isbn(isbn)).join(known, "k").select("doc_id", "line_no", "p.*")


def registry_matches(refs: DataFrame, documents: DataFrame, sources: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, line_no, status, confidence, method, matched_title and discontinued_warning of every reference; ``exact``: similarity over all pairs."""
    first = doi_matches(refs, documents).withColumn("tier1", F.lit(True))
    rest = refs.join(first.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti")
    second = (exact_metadata_matches if exact else metadata_matches)(rest, documents).select("doc_id", "line_no", "confidence", F.col("matched_title").alias("meta_title"))
    third = source_matches(rest, sources)
    rows = refs.select("doc_id", "line_no").join(first.select("doc_id", "line_no", "tier1", "matched_title"), ["doc_id", "line_no"], "left")
    rows = rows.join(second, ["doc_id", "line_no"], "left").join(third, ["doc_id", "line_no"], "left")
    c = F.coalesce("confidence", F.lit(0.0))
    listed = F.col("source_title").isNotNull()
    late = listed & F.coalesce(~F.col("covered"), F.lit(False))
    status = F.when(F.col("tier1") | (c >= SURE), FOUND).when(c >= LIKELY, PROBABLE).when(listed & ~late, SOURCE_ONLY).otherwise(UNKNOWN)
    method = F.when(F.col("tier1"), "DOI_EXACT").when(c >= SURE, "METADATA_MATCH").when(c >= LIKELY, "METADATA_MATCH_PARTIAL").when(late, "JOURNAL_FOUND_YEAR_NOT_COVERED").when(listed, "JOURNAL_IN_SOURCE_LIST").otherwise("NO_RELIABLE_MATCH")
    title = F.when(F.col("tier1"), F.col("matched_title")).when(c >= LIKELY, F.col("meta_title")).otherwise(F.col("source_title"))
    warn = (status == SOURCE_ONLY) & F.coalesce("discontinued", F.lit(False))
    return rows.select("doc_id", "line_no", status.alias("status"), F.when(F.col("tier1"), F.lit(1.0)).otherwise(c).alias("confidence"), method.alias("method"), title.alias("matched_title"), warn.alias("discontinued_warning"))


def work_years() -> Column:
    return F.array_compact(F.array(*[F.col(c) for c in ("issued", "published", "published_print", "published_online", "created")]))


def doi_status(refs: DataFrame, works: DataFrame, known_from: int | None = None, known_to: int | None = None) -> DataFrame:
    """doc_id, line_no, status and which of title, year and author differ from the DOI's metadata.

    no_doi (not where the source type has none), unverified (the year lies outside the snapshot), not_found, mismatch, valid.
    """
    w = works.groupBy(normalize_doi("doi").alias("k")).agg(F.max(F.struct("title", work_years().alias("years"), F.get("authors", F.lit(0))["family"].alias("family"))).alias("w"))
    rows = refs.withColumn("k", normalize_doi("doi")).join(w, "k", "left")
    y = leading_int("year")
    title_ok = F.col("w.title").isNull() | F.col("title").isNull() | (dice_bigram("title", "w.title") > 0.6)
    year_ok = y.isNull() | (F.size("w.years") == 0) | F.array_contains("w.years", y)
    author_ok = F.col("w.family").isNull() | F.col("first_author").isNull() | F.lower("first_author").contains(F.lower("w.family"))
    outside = (F.lit(False) if known_from is None else y < known_from) | (F.lit(False) if known_to is None else y > known_to)
    status = (
        F.when(F.col("k").isNull(), F.when(F.col("source_type").isin(*DOI_NOT_EXPECTED), "not_expected").otherwise("no_doi"))
        .when(F.col("w").isNull(), F.when(outside, "unverified").otherwise("not_found"))
        .when(title_ok & year_ok & author_ok, "valid")
        .otherwise("mismatch")
    )
    flag = lambda ok: F.when(F.col("w").isNotNull(), ok)
    return rows.select("doc_id", "line_no", status.alias("status"), flag(title_ok).alias("title_ok"), flag(year_ok).alias("year_ok"), flag(author_ok).alias("author_ok"))


#: Scores down to which the k best DOI candidates are looked for in turn.
LEVELS = (0.8, 0.6, 0.4)


def _candidate_score(title: Column) -> Column:
    half = lambda a, b, s: F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.5)).otherwise(s)
    return 0.60 * title + 0.25 * half("first_author", "r_first_author", compare_author("first_author", "r_first_author")) + 0.15 * half("year", "r_year", compare_year("year", "r_year"))


def _by_author_and_year(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(lid, rid) that hold the k best pairs among those whose titles share nothing.

    Without a title, a score depends on author and year alone; so of the works of one author and year, the k of smallest DOI are enough. They
    are kept for every author, no author and any author, each with every year, no year and any year. A reference looks up its
    authors (those whose names share a bigram with its own) and years (its own, both neighbours, none, any).
    """
    name = lambda: F.when(F.col("first_author").isNull(), F.lit("\u0000")).otherwise(surname("first_author"))
    any_, none = "\u0001", "\u0000"
    year = lambda c: F.coalesce(c.cast("string"), F.lit(none))
    w = right.select("rid", "doi", F.explode(F.array_distinct(F.array(name(), F.lit(any_)))).alias("who"), year(F.col("y")).alias("own"))
    w = w.select("rid", "doi", "who", F.explode(F.array("own", F.lit(any_))).alias("when"))
    few = w.withColumn("n", F.row_number().over(Window.partitionBy("who", "when").orderBy("doi", "rid"))).where(F.col("n") <= k).select("who", "when", "rid")
    names = lambda df: df.where("first_author is not null").select(surname("first_author").alias("name")).distinct()
    grams = lambda df, key: title_grams(df.withColumn(key, F.col("name")), key, "name").select(key, F.substring("token", 1, 2).alias("gram")).distinct()
    alike = grams(names(left), "mine").join(grams(names(right), "who"), "gram").select("mine", "who").distinct()
    mine = left.select("lid", name().alias("mine"), F.explode(F.array_distinct(F.array(year(F.col("y")), year(F.col("y") - 1), year(F.col("y") + 1), F.lit(none), F.lit(any_)))).alias("when"))
    fixed = mine.select("lid", "when", F.explode(F.array_distinct(F.array("mine", F.lit(none), F.lit(any_)))).alias("who"))
    return fixed.unionByName(mine.join(alike, "mine").select("lid", "when", "who")).join(few, ["who", "when"]).select("lid", "rid").distinct()


def doi_candidates(refs: DataFrame, works: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """The k best DOI candidates of references without one, rank from 1: .60 title, .25 author, .15 year; what is missing counts half. Ties: by DOI.

    Over all pairs. References of one title, author and year are one entry, and so are works, of which the k of smallest DOI stay. In turn for each of
    ``LEVELS``, all pairs of such a score are found by the titles that it asks for; entries whose k-th candidate reaches it are finished, and only the
    others go on. Those left at the end are compared with all works that share a bigram, and with the best ones by author and year. ``least`` ends the
    search early: candidates below it aren't given; a corpus with many references that have no match should set it.
    """
    names = ["title", "first_author", "year"]
    docs = works.select("doi", "title", F.get("authors", F.lit(0))["family"].alias("first_author"), F.get(work_years(), F.lit(0)).cast("string").alias("year")).distinct()
    open_refs = refs.where("doi is null").select("doc_id", "line_no", *names)
    left = _entries(open_refs, "lid", names)
    first = Window.partitionBy(*names).orderBy("doi")
    docs = docs.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    right = _entries(docs, "rid", names, dois=F.array_sort(F.collect_list(F.struct("doi"))))
    lt, rt = _titles(left, "lid"), _titles(right, "rid")
    grams = tuple(settled(g) for g in gram_entries(lt, rt))
    top = Window.partitionBy("lid").orderBy(F.desc("score"), "r_doi", "rid")
    of = ["rid", "dois", F.col("y").alias("r_y"), *[F.col(c).alias(f"r_{c}") for c in [*names, "t"]]]

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("score", F.round(_candidate_score(F.col("dice")), 9)).where(F.col("score") >= least)
        rows = rows.select("lid", "rid", "r_title", "score", F.explode("dois.doi").alias("r_doi"))
        return rows.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)

    done: list[DataFrame] = []
    open_ = left
    # Years that aren't known count half on either side, as neighbouring ones do.
    apart = F.abs(F.col("y") - F.col("r_y"))
    year = F.when(F.col("year").isNull() | F.col("r_year").isNull(), 0.5).when(apart == 0, 1.0).when(apart == 1, 0.5).otherwise(0.0)
    for level in [x for x in LEVELS if x > least] + [least]:
        last = level == least
        whole = last and least < LEVELS[-1]
        title = 1e-6 if whole else _best_title((level - 0.40) / 0.60)
        mine = lt.join(open_.select("t").distinct(), "t", "left_semi")
        pairs = title_pairs(mine, rt, (grams[0].join(mine.select("lid"), "lid", "left_semi"), grams[1]), title)
        rows = open_.join(pairs, "t").join(right.select(*of), "r_t")
        if whole:
            met = _by_author_and_year(open_, right.withColumn("doi", F.get("dois", F.lit(0))["doi"]), k)
            more = met.join(open_, "lid").join(right.select(*of), "rid").join(pairs.withColumnsRenamed({"t": "p_t", "r_t": "p_r"}), (F.col("t") == F.col("p_t")) & (F.col("r_t") == F.col("p_r")), "left_anti")
            rows = rows.unionByName(more.withColumn("dice", F.lit(0.0)))
        else:
            rows = rows.where(0.60 * F.col("dice") + 0.25 + 0.15 * F.coalesce(year, F.lit(0.0)) >= level - 1e-9)
        found = settled(ranked(rows))
        if last:
            done.append(found)
            break
        sure = settled(found.where((F.col("rank") == k) & (F.col("score") > level + 1e-9)).select("lid"))
        done.append(found.join(sure, "lid", "left_semi"))
        open_ = settled(open_.join(sure, "lid", "left_anti"))
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    lists = out.groupBy("lid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("r_doi").alias("doi"), F.col("r_title").alias("title"), "score"))).alias("c"))
    found = _of_rows(open_refs, left.join(lists, "lid").select(*names, "c"), names)
    return found.select("doc_id", "line_no", F.inline("c")).select("doc_id", "line_no", "rank", "doi", "title", "score")
