"""More queries: operators that the first set leaves out, and exact versions with SQL over all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import checks as ck
from foliospark.operators import citations, convert, diff, matching, prep, refs, registry, rules, stats, terms
from foliospark.plans import corpus
from foliospark.plans.queries import DATED, KEYED, OF_NUMBERS, SQL, TERM, W, apa, apa_refs, f, numeric, numeric_issues, numeric_refs, pct, query, term_paragraphs, version_pairs
from foliospark.session import settled

# ---- spans

#: Three spans for each reference: where they begin and end, and how bad what they mark is.
MARKS = f"""{f}, s AS (SELECT doc_id, CAST(line_no * 11 + k * (partkey % 13) AS int) AS b, CAST(line_no * 11 + k * (partkey % 13) + suppkey % 17 + k AS int) AS e, (partkey + k) % 3 AS bad FROM f, (VALUES (1), (2), (3)) v(k))"""


def marks(spark, sf_dir):
    k = F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("k")
    start = (F.col("line_no") * 11 + F.col("k") * (F.col("partkey") % 13)).cast("int")
    bad = F.element_at(F.array(F.lit("suggestion"), F.lit("warning"), F.lit("error")), ((F.col("partkey") + F.col("k")) % 3 + 1).cast("int"))
    return corpus.facts(spark, sf_dir).select("*", k).select("doc_id", start.alias("start"), (start + F.col("suppkey") % 17 + F.col("k")).cast("int").alias("end"), bad.alias("severity"))


@query(f"""{MARKS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b, e DESC) AS n FROM s), d AS (SELECT doc_id, list(struct_pack(b := b, e := e) ORDER BY b, e DESC) AS l FROM s GROUP BY doc_id),
g AS (SELECT doc_id, list_reduce(list_prepend(struct_pack(b := -1, e := 0, t := []::STRUCT(b INT, e INT)[]), list_transform(l, lambda x: struct_pack(b := x.b, e := x.e, t := []::STRUCT(b INT, e INT)[]))),
 lambda a, x: CASE WHEN x.b >= a.e THEN struct_pack(b := x.b, e := x.e, t := list_append(a.t, struct_pack(b := x.b, e := x.e))) ELSE a END) AS r FROM d)
SELECT doc_id, t.b AS "start", t.e AS "end" FROM (SELECT doc_id, unnest(r.t) AS t FROM g) u""")
def j23_accepted_spans(spark, sf_dir):
    return matching.accepted_spans(marks(spark, sf_dir).drop("severity"))


@query(f"""{MARKS}, m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s),
i AS (SELECT *, sum(CASE WHEN upto IS NULL OR b >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(b) AS "start", max(e) AS "end", CASE max(bad) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'suggestion' END AS severity FROM i GROUP BY doc_id, island""")
def j23_merged_spans(spark, sf_dir):
    return matching.merged_spans(marks(spark, sf_dir))


# ---- registry over all pairs

#: Dice of every title of a reference (i) and every work (doi) that share a bigram, by counts of bigrams; of names of authors too.
ALIKE = f"""WITH m AS ({corpus.MISPRINTS}), w AS ({corpus.PART_WORKS}), n(t) AS (SELECT DISTINCT title FROM m UNION SELECT title FROM w UNION SELECT lower(surname) FROM m UNION SELECT lower(family) FROM w),
g AS (SELECT t, unnest(list_transform(range(1, length(t)), lambda i: substring(t, CAST(i AS int), 2))) AS x FROM n), k AS (SELECT t, x, count(*) AS c FROM g GROUP BY ALL),
p AS (SELECT a.t AS i, b.t AS j, 2.0 * sum(least(a.c, b.c)) / any_value(length(a.t) + length(b.t) - 2) AS dice FROM k a JOIN k b USING (x) GROUP BY a.t, b.t),
s AS (SELECT m.doc_id, m.line_no, m.partkey, w.doi, w.title, CASE WHEN m.title = w.title THEN 1.0::DOUBLE ELSE t.dice END AS dice, CASE WHEN m.surname = w.family THEN 1.0::DOUBLE ELSE coalesce(e.dice, 0) END AS who,
 CASE abs(m.y - w.issued) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS yr FROM m JOIN p t ON t.i = m.title JOIN w ON w.title = t.j LEFT JOIN p e ON e.i = lower(m.surname) AND e.j = lower(w.family) WHERE t.dice >= 0.4)"""


@query(f"{ALIKE} SELECT doc_id, CAST(line_no AS int) AS line_no, round(max(0.60 * dice + 0.15 * who + 0.10 * yr), 6) AS confidence FROM s WHERE 0.60 * dice + 0.15 * who + 0.10 * yr >= 0.8 - 1e-9 GROUP BY ALL")
def j13_exact_matches(spark, sf_dir):
    """The best registry document by metadata over all pairs, where it reaches the score of a probable match; titles have misprints."""
    works = corpus.part_works(spark, sf_dir)
    none = F.lit(None).cast("string")
    known = works.select("doi", "title", F.get("authors", F.lit(0))["family"].alias("first_author"), none.alias("journal"), F.col("issued").cast("string").alias("year"), none.alias("volume"), none.alias("pages"), none.alias("article_number"))
    found = registry.exact_metadata_matches(corpus.misprinted_refs(spark, sf_dir), known)
    return found.select("doc_id", "line_no", F.round("confidence", 6).alias("confidence"))


@query(f"""{ALIKE}, c AS (SELECT doc_id, line_no, doi, title, 0.60 * dice + 0.25 * who + 0.15 * yr AS score FROM s WHERE partkey % 5 = 0), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY round(score, 9) DESC, doi) AS rank FROM c WHERE round(score, 9) >= 0.7)
SELECT doc_id, CAST(line_no AS int) AS line_no, CAST(rank AS int) AS rank, doi, title, round(score, 6) AS score FROM best WHERE rank <= 5""")
def j20_doi_candidates(spark, sf_dir):
    """The five best works, over all pairs, for each reference without a DOI; candidates of a score of .7 or more."""
    found = registry.doi_candidates(corpus.misprinted_refs(spark, sf_dir), corpus.part_works(spark, sf_dir), least=0.7)
    return found.withColumn("score", F.round("score", 6))


# ---- versions


@query("""
WITH p AS (SELECT doc_id AS pair_id, unnest(string_split(text, chr(10))) AS x FROM documents), n AS (SELECT pair_id, count(*) AS n FROM p GROUP BY ALL)
SELECT pair_id, n - CASE WHEN n >= 3 THEN 1 ELSE 0 END - CASE WHEN n >= 5 THEN 1 ELSE 0 END AS unchanged, CASE WHEN n >= 3 THEN 1 ELSE 0 END + CASE WHEN n >= 5 THEN 1 ELSE 0 END AS old_changed, CASE WHEN n >= 3 THEN 1 ELSE 0 END + 1 AS new_changed FROM n""")
def d3_anchors(spark, sf_dir):
    """How many paragraphs of both versions are anchors, and how many of each aren't."""
    n = stats.diff_summary(diff.diff_rows(version_pairs(spark, sf_dir)))
    return n.select("pair_id", "unchanged", (F.col("deleted") + F.col("modified")).alias("old_changed"), (F.col("added") + F.col("modified")).alias("new_changed"))


# ---- italics


def rich_runs(spark, sf_dir):
    """Runs of the reference lines: the journal in italics in even documents, the title too in those that four divides."""
    facts = corpus.facts(spark, sf_dir).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "title", "journal")
    r = apa_refs(spark, sf_dir, "year").select("doc_id", "line_no", "raw").join(facts, ["doc_id", "line_no"])
    cut = lambda a, b: F.expr(f"substring(raw, {a}, {b})")
    t, j = "instr(raw, title)", "instr(raw, journal)"
    pieces = [(cut("1", f"{t} - 1"), F.lit(False)), (F.col("title"), F.col("doc_id") % 4 == 0), (cut(f"{t} + length(title)", f"{j} - {t} - length(title)"), F.lit(False)), (F.col("journal"), F.col("doc_id") % 2 == 0), (cut(f"{j} + length(journal)", "length(raw)"), F.lit(False))]
    runs = F.array(*[F.struct(x.alias("text"), i.alias("italic")) for x, i in pieces])
    return r.select("doc_id", F.col("line_no").alias("para_no"), F.posexplode(runs).alias("run_no", "x")).select("doc_id", "para_no", "run_no", "x.*")


@query(f"{f} SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'journal' ELSE 'title' END AS span, count(*) AS n FROM ok WHERE doc_id % 4 <> 2 GROUP BY ALL")
def v7_italics(spark, sf_dir):
    found = ck.italic_issues(rich_runs(spark, sf_dir), apa_refs(spark, sf_dir, *ck.OF_ITALICS))
    return found.groupBy("doc_id", F.col("correction").alias("span")).agg(F.count(F.lit(1)).alias("n"))


# ---- all issues


def doi_statuses(spark, sf_dir):
    return registry.doi_status(apa_refs(spark, sf_dir, "doi", "title", "year", "first_author", "source_type"), corpus.works(spark, sf_dir))


@query(f"""{W}, s AS (SELECT ok.doc_id, line_no, CASE WHEN ok.doi IS NULL THEN 'DOI_NONE' WHEN w.doi IS NULL THEN 'DOI_NOT_FOUND' WHEN year = 'n.d.' OR CAST(year AS int) = issued THEN 'DOI_VALID' ELSE 'DOI_MISMATCH' END AS issue_code,
 CASE WHEN ok.doi IS NULL THEN surname || ', ' || initial || CASE WHEN n_authors = 1 THEN '' ELSE '.' END || ', ' || year ELSE 'https://doi.org/' || ok.doi END AS code FROM ok LEFT JOIN w USING (doi)),
i AS (SELECT doc_id, 'ITALIC' AS issue_code, line_no FROM ok WHERE doc_id % 4 <> 2)
SELECT doc_id, issue_code, count(DISTINCT code) AS n FROM s WHERE issue_code <> 'DOI_NONE' GROUP BY ALL UNION ALL SELECT doc_id, issue_code, count(*) FROM i GROUP BY ALL""")
def v10_doi_and_italic_issues(spark, sf_dir):
    """Issues of DOIs that are there and of italics in the table of all issues, by code."""
    r = settled(apa_refs(spark, sf_dir, *ck.OF_ITALICS, "doi", "first_author", "year"))
    found = ck.all_issues([ck.doi_issues(doi_statuses(spark, sf_dir), r), ck.italic_issues(rich_runs(spark, sf_dir), r)])
    return found.where("issue_code <> 'DOI_NONE'").groupBy("doc_id", "issue_code").agg(F.count(F.lit(1)).alias("n"))


@query(SQL["v10_numeric_issues"].replace("SELECT doc_id, issue_code, count(*) AS n FROM i GROUP BY ALL", "SELECT doc_id, issue_code, count(*) AS n FROM i WHERE issue_code <> 'REF_UNCITED' GROUP BY ALL"))
def j21_without_dismissed(spark, sf_dir):
    """What is left of the issues of numbers where those of references that aren't cited have been dismissed."""
    found = settled(numeric_issues(spark, sf_dir, codes=OF_NUMBERS))  # those dismissed and those left
    left = ck.without_dismissed(found, found.where("issue_code = 'REF_UNCITED'").select("doc_id", "fingerprint"))
    return left.groupBy("doc_id", "issue_code").agg(F.count(F.lit(1)).alias("n"))


# ---- author-page citations, proceedings, overrides


def paged(spark, sf_dir):
    """Manuscripts whose cited references are named by surname and page."""
    cite = F.concat(F.lit(" It holds ("), "surname", F.lit(" "), "first_page", F.lit(")."))
    rows = corpus.facts(spark, sf_dir).where("cited").withColumn("first_page", F.substring_index("pages", "-", 1)).where("length(first_page) < 4")
    return rows.groupBy("doc_id").agg(F.array_join(F.collect_list(cite), "").alias("article"))


@query(f"{f} SELECT doc_id, lower(surname) AS name, split_part(pages, '-', 1) AS page, count(*) AS n FROM f WHERE cited AND length(split_part(pages, '-', 1)) < 4 GROUP BY ALL")
def c5_author_page(spark, sf_dir):
    found = citations.author_page_citations(paged(spark, sf_dir))
    return found.groupBy("doc_id", F.lower("first_author").alias("name"), "page").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{f}, c AS (SELECT doc_id, surname FROM f WHERE cited AND length(split_part(pages, '-', 1)) < 4)
SELECT c.doc_id, CAST(ok.line_no AS int) AS line_no, count(*) AS n FROM c JOIN ok ON c.doc_id = ok.doc_id AND c.surname = ok.surname GROUP BY ALL""")
def j8_author_page_matches(spark, sf_dir):
    """Every reference with the cited name counts."""
    found = matching.author_page_matches(citations.author_page_citations(paged(spark, sf_dir)), apa_refs(spark, sf_dir, *matching.KEY_COLUMNS))
    return found.where("line_no is not null").groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n"))


@query(f"{f}, v AS (SELECT partkey, max(title) AS title FROM f WHERE partkey % 3 = 0 GROUP BY ALL) SELECT f.doc_id, CAST(f.line_no AS int) AS line_no, v.title FROM f JOIN v USING (partkey)")
def j16_proceedings(spark, sf_dir):
    """References with an ISBN, written with dashes there and without in the list of volumes."""
    facts = corpus.facts(spark, sf_dir)
    volumes = facts.where("partkey % 3 = 0").groupBy("partkey").agg(F.max("title").alias("title")).select(F.format_string("978%010d", "partkey").alias("isbn"), "title", F.lit("2001").alias("year"), F.lit("P").alias("publisher"))
    named = facts.select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.regexp_replace(F.format_string("978%010d", "partkey"), "^(...)(.)(....)", "$1-$2-$3-").alias("isbn"))
    return registry.proceedings_matches(named, volumes).select("doc_id", "line_no", "title")


@query(f"{f} SELECT doc_id, CAST(line_no AS int) AS line_no, CASE WHEN partkey % 4 = 0 THEN 'local' ELSE 'international' END AS origin, CASE WHEN partkey % 4 = 0 THEN 'manual' ELSE 'low' END AS origin_confidence FROM ok")
def j22_overrides(spark, sf_dir):
    """Guessed origins, and those that were set by hand for every fourth part."""
    by_hand = corpus.facts(spark, sf_dir).where("partkey % 4 = 0").select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.lit("local").alias("origin"))
    return rules.with_origin(apa_refs(spark, sf_dir, "year"), by_hand).select("doc_id", "line_no", "origin", "origin_confidence")


@query(f"{DATED} SELECT doc_id, count(*) AS n_parts, CAST(sum(CASE WHEN surname = 'Nobody' THEN 0 ELSE 1 END) AS bigint) AS n_known FROM c GROUP BY ALL")
def r10_resolved_acronyms(spark, sf_dir):
    """Citations of institutions by acronyms, with the full names that their manuscript gives."""
    names = F.element_at(F.array(*[F.lit(x) for x in corpus.SURNAMES]), (F.col("suppkey") % 8 + 1).cast("int"))
    texts = corpus.facts(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.collect_set(F.concat(F.lit("The "), names, F.lit(" Research Council ("), F.upper(names.substr(1, 3)), F.lit(") did it"))), ". ").alias("text"))
    cited = citations.author_date_citations(apa(spark, sf_dir)).select("doc_id", F.upper(F.substring("first_author", 1, 3)).alias("first_author"))
    found = refs.resolve_acronyms(cited, "first_author", refs.acronym_map(texts))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.col("first_author").endswith("Research Council").cast("long")).alias("n_known"))


# ---- terms

CELLS = f"""{f}, t AS (SELECT DISTINCT doc_id, lower(surname) || ' effect' AS norm, left(lower(surname), 2) || 'e' AS acr FROM f),
c AS (SELECT doc_id, CASE line_no % 5 WHEN 0 THEN lower(surname) || ' effect' WHEN 1 THEN 'total ' || lower(surname) || ' effect score' WHEN 2 THEN substring(lower(surname), 2, 3) WHEN 3 THEN left(lower(surname), 2) || 'e' ELSE 'zzz' END AS label, line_no % 5 AS k
 FROM f WHERE doc_id % 3 <> 0 AND line_no % 4 <> 3)"""


@query(f"{CELLS} SELECT DISTINCT t.doc_id, t.norm FROM t JOIN c ON t.doc_id = c.doc_id AND (contains(c.label, t.norm) OR contains(t.norm, c.label) OR c.label = t.acr)")
def m8_table_evidence(spark, sf_dir):
    """Terms that rows of tables name in any of four ways; tables of other kinds and rows without numbers don't count."""
    facts = corpus.facts(spark, sf_dir)
    name, k = F.lower("surname"), F.col("line_no") % 5
    acr = F.concat(F.substring("surname", 1, 2), F.lit("E"))
    label = F.when(k == 0, F.concat("surname", F.lit(" Effect"))).when(k == 1, F.concat(F.lit("Total "), "surname", F.lit("-Effect Score"))).when(k == 2, F.substring("surname", 2, 3)).when(k == 3, acr).otherwise("zzz")
    cells = facts.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "Notes").otherwise("Factor loading").alias("header"), label.alias("label"), F.when(F.col("line_no") % 4 == 3, F.array(F.lit("-"))).otherwise(F.array(F.lit(" "), F.lit("0.71"))).alias("numbers"))
    norm = F.concat(name, F.lit(" effect")).alias("norm")
    return terms.table_evidence(cells, facts.select("doc_id", norm), facts.select("doc_id", norm, acr.alias("acronym")).distinct())


@query(f"""{f}, s AS (SELECT doc_id, CASE WHEN partkey % 2 = 0 THEN 'Digital Literacy Skill' ELSE 'Digital Literacy Skills' END AS surface FROM f),
n AS (SELECT doc_id, surface, count(*) AS n FROM s GROUP BY ALL) SELECT doc_id, 'digital literacy skill' AS norm, count(*) AS n_surfaces, max(n) AS most FROM n GROUP BY doc_id HAVING count(*) > 1""")
def m5_inconsistent(spark, sf_dir):
    """One term that is written in the singular and in the plural."""
    p = corpus.facts(spark, sf_dir).select("doc_id", F.col("line_no").alias("para_no"), F.concat(F.lit("Digital Literacy Skill"), F.when(F.col("partkey") % 2 == 0, "").otherwise("s"), F.lit(" grows here.")).alias("text"))
    found = terms.inconsistent_terms(terms.mentions(p))
    return found.select("doc_id", "norm", "n_surfaces", F.array_max(F.transform("surfaces", lambda s: s["n"])).alias("most"))


@query(f"""{f}, t AS (SELECT doc_id, 'work life balance' AS norm, count(*) AS n, bool_or(partkey % 3 = 0) AS defined FROM f GROUP BY doc_id) SELECT doc_id, norm FROM t WHERE n >= 2 AND NOT defined""")
def m15_undefined(spark, sf_dir):
    """A term that hypotheses, measures and results speak of, in the documents that nowhere say what it means."""
    said = F.concat(F.lit("Work Life Balance predicts loyalty in the structural model, on a scale of five (p < 0.05)."), F.when(F.col("partkey") % 3 == 0, " Work Life Balance is defined as the degree to which people rest well.").otherwise(""))
    p = corpus.facts(spark, sf_dir).select("doc_id", F.col("line_no").alias("para_no"), said.alias("text"))
    found = settled(terms.mentions(p))  # read for scores and for definitions
    return terms.undefined_terms(terms.variable_scores(found), terms.definitions(found)).select("doc_id", "norm")


# ---- formats, maps and the cascade

#: What a tail of an article does wrong, by the rest of doc_id by eight; none for 0.
FAULTS = ("", "no_space_before_paren", "et_al_case", "missing_open_paren", "multiple_authors_before_et_al", "no_space_around_ampersand", "extra_space_in_paren", "no_space_after_paren")
TAILS = ("(Miller, 2001) it", "(Miller, 2001) it", "(Miller Et al, 2001) it", "Miller, 2001) it", "(Miller, Ode, et al., 2001) it", "(Miller&Ode, 2001) it", "( Miller, 2001) it", "(Miller, 2001)it")
FAULT = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(FAULTS)) + " END"


@query(f"{f} SELECT DISTINCT doc_id, {FAULT} AS issue_type, CAST(1 AS bigint) AS n FROM f WHERE doc_id % 8 <> 0")
def c6_format_kinds(spark, sf_dir):
    """One malformed citation of each kind (C6 to C12) at the end of numeric articles."""
    tail = F.element_at(F.array(*[F.lit(f" As said{'' if k == 1 else ' '}{x} holds.") for k, x in enumerate(TAILS)]), (F.col("doc_id") % 8 + 1).cast("int"))
    found = citations.malformed_citations(numeric(spark, sf_dir).withColumn("article", F.concat("article", tail)))
    return found.groupBy("doc_id", "issue_type").agg(F.count(F.lit(1)).alias("n"))


LABEL = "surname || ', ' || initial || CASE WHEN n_authors = 1 THEN '' ELSE '.' END || ', ' || year"

SQL["j9_citation_map"] = f"""{KEYED}, x AS (SELECT doc_id, CASE WHEN k = 1 THEN ref_line END AS c_line, lower(surname) || ', ' || year AS cite_label, count(*) AS n FROM m GROUP BY ALL),
r AS (SELECT doc_id, line_no, {LABEL} AS ref_label FROM ok)
SELECT coalesce(x.doc_id, r.doc_id) AS doc_id, CAST(coalesce(c_line, line_no) AS int) AS line_no, cite_label, ref_label, coalesce(n, 0) AS times_cited, c_line IS NOT NULL AND line_no IS NOT NULL AS matched
FROM x FULL JOIN r ON x.doc_id = r.doc_id AND x.c_line = r.line_no"""


@query(f"{KEYED} SELECT doc_id, lower(surname) || '_' || year AS link_key, CAST(coalesce(max(first_line), -1) AS int) AS line_no, count(*) AS n FROM (SELECT c.*, g.first_line FROM c LEFT JOIN g USING (doc_id, surname, year)) z GROUP BY ALL")
def j11_link_keys(spark, sf_dir):
    """Citations by link key, with the first reference of that key."""
    found = matching.links(citations.author_date_citations(apa(spark, sf_dir)), apa_refs(spark, sf_dir, *matching.KEY_COLUMNS))
    return found.groupBy("doc_id", "link_key").agg(F.max(F.coalesce("line_no", F.lit(-1))).alias("line_no"), F.count(F.lit(1)).alias("n"))


SQL["j17_registry_matches"] = f"""{W}, s AS ({corpus.SOURCES}), y AS (SELECT ok.*, w.title AS known, CAST(CASE WHEN year = 'n.d.' THEN NULL ELSE year END AS int) AS y FROM ok LEFT JOIN w USING (doi)),
l AS (SELECT y.*, s.title AS listed, discontinued, CASE WHEN s.title IS NULL THEN 'none' WHEN y IS NULL THEN 'open' WHEN (CASE WHEN coverage LIKE '%;%' THEN y BETWEEN 1995 AND 1997 OR y = 2000 ELSE y BETWEEN 1996 AND 2005 END) THEN 'open' ELSE 'late' END AS cover FROM y LEFT JOIN s ON s.title = y.journal)
SELECT doc_id, CAST(line_no AS int) AS line_no, CASE WHEN known IS NOT NULL THEN 'SCOPUS' WHEN cover = 'open' THEN 'SCOPUS_SOURCE_ONLY' ELSE 'UNKNOWN' END AS status, CASE WHEN known IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
 CASE WHEN known IS NOT NULL THEN 'DOI_EXACT' WHEN cover = 'late' THEN 'JOURNAL_FOUND_YEAR_NOT_COVERED' WHEN cover = 'open' THEN 'JOURNAL_IN_SOURCE_LIST' ELSE 'NO_RELIABLE_MATCH' END AS method, coalesce(known, listed) AS matched_title,
 known IS NULL AND cover = 'open' AND coalesce(discontinued, false) AS discontinued_warning FROM l"""


# ---- densities, the registry rule, indicators

SAID = "CASE WHEN year IS NULL OR NOT cited THEN 0 WHEN n_authors = 1 THEN 5 ELSE 7 END"


@query(f"""{DATED}, p AS (SELECT doc_id, count(*) AS n FROM c GROUP BY ALL), w AS (SELECT doc_id, 6 + sum({SAID}) + CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 0 END AS words FROM f GROUP BY doc_id)
SELECT doc_id, floor(1000.0 * coalesce(n, 0) / words * 10 + 0.5) / 10 AS per_1000_words, floor(coalesce(n, 0) / 2.0 * 10 + 0.5) / 10 AS per_paragraph FROM w LEFT JOIN p USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM ok)""")
def a10_densities(spark, sf_dir):
    """Citations for 1,000 words and for a paragraph; every article has two."""
    parts = stats.citation_count(parts=citations.author_date_citations(apa(spark, sf_dir)))
    listed = apa_refs(spark, sf_dir, "year").select("doc_id").distinct()
    return stats.densities(apa(spark, sf_dir), parts).join(listed, "doc_id", "left_semi").select("doc_id", "per_1000_words", "per_paragraph")


@query(f"""{f}, s AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN partkey % 3 = 0 THEN 'SCOPUS' WHEN partkey % 3 = 1 THEN 'SCOPUS_SOURCE_ONLY' ELSE 'UNKNOWN' END AS st FROM ok),
g AS (SELECT doc_id, count(*) AS n, count(st) AS known, count(*) FILTER (WHERE st LIKE 'SCOPUS%') AS good FROM s GROUP BY ALL), a AS (SELECT doc_id, CASE WHEN known > 0 THEN floor(1000.0 * good / n + 0.5) / 10 END AS actual FROM g)
SELECT doc_id, v.name AS rule_set, 'registry' AS rule_id, actual, v.least AS required, coalesce(actual >= v.least, false) AS pass FROM a, (VALUES ('half', 50.0::DOUBLE), ('most', 80.0::DOUBLE)) v(name, least)""")
def a20_registry_rule(spark, sf_dir):
    """The share of references that the registry knows, under two rule sets; every fifth document has no results and fails."""
    third = F.col("partkey") % 3
    statuses = corpus.facts(spark, sf_dir).where("doc_id % 5 <> 0").select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.when(third == 0, "SCOPUS").when(third == 1, "SCOPUS_SOURCE_ONLY").otherwise("UNKNOWN").alias("status"))
    sets = spark.createDataFrame([("half", None, None, None, None, None, None, 50.0), ("most", None, None, None, None, None, None, 80.0)], "rule_set string, min_count int, years int, years_min_pct double, source_type string, type_min_pct double, intl_min_pct double, registry_min_pct double")
    return rules.evaluate_rules(rules.with_origin(apa_refs(spark, sf_dir, "year", "source_type")), sets, apa(spark, sf_dir), statuses)


@query(f"{f} SELECT doc_id, 'short video addiction' AS norm, count(DISTINCT line_no % 4) AS n_indicators FROM f GROUP BY doc_id")
def m12_indicators(spark, sf_dir):
    """Codes that carry the acronym of a term count as its indicators, each once; those of another acronym don't."""
    p = corpus.facts(spark, sf_dir).select("doc_id", F.col("line_no").alias("para_no"), F.concat(F.lit("Short Video Addiction (SVA) loads on SVA"), (F.col("line_no") % 4 + 1).cast("string"), F.lit(" and on XYZ1.")).alias("text"))
    return terms.indicator_parents(p, terms.acronym_pairs(p)).select("doc_id", "norm", "n_indicators")


# ---- sections, structure and checklist

#: How many words of abstract and how many keywords a document has, and whether it has a method and results.
STRUCTURE = f"""{f}, s AS (SELECT doc_id, count(*) AS n, count(year) AS dated, 145 + 10 * (doc_id % 13) AS a, 1 + doc_id % 7 AS k, doc_id % 3 <> 0 AS method, doc_id % 5 <> 0 AS results, doc_id % 2 = 0 AS named FROM f GROUP BY doc_id)"""


def structured(spark, sf_dir):
    """Manuscripts as paragraphs: title, authors, abstract, keywords, up to four sections, and a line for each reference."""
    d = F.col("doc_id")
    words = lambda x, n: F.trim(F.repeat(F.lit(x), n.cast("int")))
    facts = corpus.facts(spark, sf_dir)
    whole = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        (0, F.lit("A Study of Many Parts in Use")), (1, F.when(d % 2 == 0, "a.miller@site.org, Faculty of Trade").otherwise("By A. Miller")),
        (2, F.concat(F.lit("Abstract: "), words("word ", 145 + 10 * (d % 13)))), (3, F.concat(F.lit("Keywords: part"), F.repeat(F.lit(", part"), (d % 7).cast("int")))),
        (4, F.lit("1. INTRODUCTION")), (5, words("Parts are used here. ", F.col("n"))), (6, F.when(d % 3 != 0, "2. METHOD")), (7, F.when(d % 3 != 0, "It was counted.")),
        (8, F.when(d % 5 != 0, "3. RESULTS AND DISCUSSION")), (9, F.when(d % 5 != 0, "All held.")), (10, F.lit("4. CONCLUSION")), (11, F.lit("So be it.")), (12, F.lit("REFERENCES")),
    ]
    rows = whole.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("para_no"), x.alias("text")) for k, x in parts])).alias("x")).select("doc_id", "x.*").where("text is not null")
    listed = F.concat("surname", F.lit(", A."), F.coalesce(F.concat(F.lit(" ("), "year", F.lit(").")), F.lit("")), F.lit(" T."))
    return rows.unionByName(facts.select("doc_id", (F.col("line_no") + 12).cast("int").alias("para_no"), listed.alias("text")))


KEYS = "(VALUES ('abstract', 2), ('keywords', 3), ('introduction', 4), ('method', 6), ('results_discussion', 8), ('conclusion', 10), ('references', 12)) v(key, start_para)"
THERE = "(key <> 'method' OR method) AND (key <> 'results_discussion' OR results)"


@query(f"""{STRUCTURE}, h AS (SELECT * FROM s, {KEYS} WHERE {THERE})
SELECT doc_id, key, CAST(start_para AS int) AS start_para, CAST(coalesce(lead(start_para) OVER (PARTITION BY doc_id ORDER BY start_para), n + 13) AS int) AS end_para FROM h""")
def p13_sections(spark, sf_dir):
    return prep.sections(structured(spark, sf_dir)).select("doc_id", "key", F.col("start_para").cast("int").alias("start_para"), F.col("end_para").cast("int").alias("end_para"))


@query(f"""{STRUCTURE} SELECT doc_id, key, CAST(CASE key WHEN 'abstract' THEN a WHEN 'keywords' THEN k WHEN 'introduction' THEN 4 * n WHEN 'method' THEN 3 WHEN 'results_discussion' THEN 2 WHEN 'conclusion' THEN 3 ELSE 3 * n + dated END AS int) AS words,
CAST(CASE key WHEN 'introduction' THEN n WHEN 'references' THEN NULL WHEN 'keywords' THEN CASE WHEN k >= 3 THEN 1 ELSE 0 END WHEN 'results_discussion' THEN 0 ELSE 1 END AS int) AS sentences FROM s, {KEYS} WHERE {THERE}""")
def p14_section_texts(spark, sf_dir):
    """Words of every section, and sentences, which have three words at least; reference lists have no sentences to speak of."""
    p = structured(spark, sf_dir)
    found = prep.section_text(prep.sections(p), p)
    return found.select("doc_id", "key", F.col("words").cast("int").alias("words"), F.when(F.col("key") != "references", F.col("sentences")).cast("int").alias("sentences"))


@query(f"""{STRUCTURE} SELECT doc_id, 'A Study of Many Parts in Use' AS title, CAST(7 AS int) AS title_words, CAST(a AS int) AS abstract_words, CAST(k AS int) AS keyword_count,
 concat_ws(',', CASE WHEN NOT method THEN 'method' END, CASE WHEN NOT results THEN 'results,discussion' END) AS missing,
 CAST(CASE WHEN named THEN 4 ELSE 3 END + 1 + a + 1 + k + 2 + 4 * n + CASE WHEN method THEN 5 ELSE 0 END + CASE WHEN results THEN 6 ELSE 0 END + 5 AS bigint) AS total_words,
 CAST(9 + CASE WHEN method THEN 2 ELSE 0 END + CASE WHEN results THEN 2 ELSE 0 END + n AS bigint) AS paragraph_count, n AS reference_count, named AS has_email, named AS has_affiliation FROM s""")
def a22_structure(spark, sf_dir):
    found = prep.doc_stats(structured(spark, sf_dir)).withColumn("missing", F.array_join("missing", ","))
    counts = [F.col(c).cast("int").alias(c) for c in ("title_words", "abstract_words", "keyword_count")] + [F.col(c).cast("long").alias(c) for c in ("total_words", "paragraph_count", "reference_count")]
    return found.select("doc_id", "title", "missing", "has_email", "has_affiliation", *counts)


@query(f"""{STRUCTURE}, y AS (SELECT doc_id, CAST(CASE WHEN year = 'n.d.' THEN NULL ELSE year END AS int) AS y FROM f), r AS (SELECT doc_id, {pct('count(*) FILTER (WHERE y >= 1997)', 'count(y)')} AS recent FROM y GROUP BY doc_id),
c AS (SELECT doc_id, check_id, CASE check_id WHEN 'title' THEN true WHEN 'abstract' THEN a BETWEEN 150 AND 250 WHEN 'keywords' THEN k BETWEEN 3 AND 6 WHEN 'imrad' THEN method AND results WHEN 'references' THEN n >= 20 WHEN 'recency' THEN coalesce(recent >= 50, false) ELSE named END AS pass
 FROM s JOIN r USING (doc_id), (VALUES ('title'), ('abstract'), ('keywords'), ('imrad'), ('references'), ('recency'), ('email'), ('affiliation')) v(check_id))
SELECT doc_id, check_id, pass FROM c""")
def v9_submission(spark, sf_dir):
    """All checks; what is recent comes from the reference lines."""
    p = structured(spark, sf_dir)
    recent = stats.recency(p.where("para_no > 12").select("doc_id", F.col("text").alias("raw")), 2002, 5)
    return prep.checklist(prep.doc_stats(p), recent)


# ---- conversion

@query(f"""{f}, d AS (SELECT doc_id, count(*) AS k FROM f GROUP BY doc_id), o AS (SELECT f.*, CASE WHEN cited THEN 0 WHEN k >= 3 AND line_no <= 3 THEN 1 WHEN doc_id % 7 = 0 AND line_no = 1 THEN 2 ELSE 3 END AS turn FROM f JOIN d USING (doc_id))
SELECT doc_id, CAST(line_no AS int) AS line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn, line_no) AS int) AS rank, turn < 3 AS cited FROM o""")
def k3_citation_order(spark, sf_dir):
    """The new places of references in a list by first citation, those that aren't cited after the others."""
    r = numeric_refs(spark, sf_dir, *matching.KEY_COLUMNS, "num_label")
    order = convert.new_order(r, matching.resolve_any(convert.citation_events(numeric(spark, sf_dir)), r), "ieee")
    return order.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "rank", "cited")


@query(f"""{f}, b AS (SELECT *, CASE WHEN year <> 'n.d.' THEN year END AS y FROM f)
SELECT doc_id, CAST(line_no AS int) AS line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lower(surname), coalesce(y, ''), line_no) AS int) AS rank,
 surname || ', ' || initial || '.' || CASE n_authors WHEN 2 THEN ', & Lee, K.' WHEN 3 THEN ', Brown, B., & Lee, K.' ELSE '' END || ', "' || title || '," ' || journal || ', vol. ' || volume || ', no. ' || issue || ', pp. ' || pages || coalesce(', ' || y, '') || '.' || coalesce(' doi: ' || doi, '') AS line FROM b""")
def k4_apa_references(spark, sf_dir):
    """Numbered references with the authors as an author-date style has them, by the alphabet."""
    r = settled(numeric_refs(spark, sf_dir, *matching.KEY_COLUMNS, "num_label", "authors"))  # read for citations, the order and the lines
    order = convert.new_order(r, matching.resolve_any(convert.citation_events(numeric(spark, sf_dir)), r), "apa7")
    return convert.converted_references(r, order, "apa7").select("doc_id", F.col("line_no").cast("int").alias("line_no"), "rank", "line")


@query(f"""{f}, b AS (SELECT doc_id, line_no, cited, surname || CASE n_authors WHEN 1 THEN '' WHEN 2 THEN ' & Lee' ELSE ' et al.' END || ', ' || CASE WHEN year IS NULL THEN 'n.d.' ELSE year END AS said FROM f)
SELECT doc_id, 'Introduction' || chr(10) || 'This order is studied here.' || coalesce(string_agg(' See (' || said || ').', '' ORDER BY line_no) FILTER (WHERE cited), '')
 || CASE WHEN count(*) >= 3 THEN ' In sum (' || string_agg(said, '; ' ORDER BY line_no) FILTER (WHERE line_no <= 3) || ').' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' But see [99, 1].' ELSE '' END AS article FROM b GROUP BY doc_id""")
def k7_apa_articles(spark, sf_dir):
    """Articles whose numbers became names and years; a citation with an unknown number stays as it is."""
    return convert.convert(numeric(spark, sf_dir), numeric_refs(spark, sf_dir, *matching.KEY_COLUMNS, "num_label", "authors"), "apa7")[0].select("doc_id", "article")


# ---- roles of terms


@query(f"""{f}, e AS (SELECT DISTINCT doc_id, {TERM.format('partkey')} AS a, {TERM.format('suppkey')} AS b FROM f WHERE partkey % 5 <> suppkey % 5),
x AS (SELECT doc_id, a AS norm, b AS other, 1 AS said FROM e UNION ALL SELECT doc_id, b, a, 2 FROM e)
SELECT doc_id, norm, CASE bit_or(said) WHEN 1 THEN 'predictor' WHEN 2 THEN 'outcome' ELSE 'intermediate' END AS roles, string_agg(DISTINCT other, ',' ORDER BY other) AS related_to FROM x GROUP BY doc_id, norm""")
def m11_roles(spark, sf_dir):
    """Terms that only predict, are only predicted, or both, with the terms they are related to."""
    found = terms.roles(terms.paragraph_relations(term_paragraphs(spark, sf_dir)))
    return found.select("doc_id", "norm", F.array_join("roles", ",").alias("roles"), F.array_join("related_to", ",").alias("related_to"))


@query(f"""{f}, t AS (SELECT doc_id, {TERM.format('partkey')} AS norm, true AS measured FROM f UNION ALL SELECT doc_id, {TERM.format('suppkey')}, false FROM f),
g AS (SELECT doc_id, norm, 2 * count(*) AS n, bool_or(measured) AS measured FROM t GROUP BY ALL),
s AS (SELECT doc_id, norm, n, round(CASE WHEN measured THEN 0.25 ELSE 0 END + 0.20 + 0.10 * least(1.0, n / 5.0), 2) AS score FROM g
 UNION ALL SELECT doc_id, 'basic attitude scale', count(*), round(0.25 + 0.10 * least(1.0, count(*) / 5.0), 2) FROM f GROUP BY doc_id HAVING count(*) >= 2)
SELECT doc_id, norm, n AS n_mentions, CAST(score AS DOUBLE) AS score, CASE WHEN norm LIKE '%scale' THEN 'INSTRUMENT' WHEN score >= 0.5 THEN 'CANDIDATE_VARIABLE' ELSE 'GENERAL_CONCEPT' END AS type FROM s""")
def m9_types(spark, sf_dir):
    """Scores by evidence (M7) and types, an instrument among them; how a term is measured defines it, too."""
    p = term_paragraphs(spark, sf_dir)
    found = settled(terms.mentions(p))
    typed = terms.classify(terms.variable_scores(found), terms.definitions(found), terms.acronym_pairs(p))
    return typed.select("doc_id", "norm", F.col("n_mentions").cast("long").alias("n_mentions"), "score", "type")
