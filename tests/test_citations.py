import random

from pyspark.sql import functions as F

from foliospark.operators import citations, matching, refs


def article(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, article string")


def names(df):
    return sorted((r["doc_id"], r["part"], r["year"]) for r in df.collect())


def test_narrative_names(spark):
    df = article(
        spark,
        "However, Riand and Radil (2022) found it.",
        "bagi Indonesian MSMEs. Suseno (2025) menyatakan.",
        "Outside Nigeria, Syed et al. (2024) did so.",
        "Menurut Institute of International Finance and Deloitte (2023), ini.",
        "Grouped Author (2020, 2024, 2026a) here.",
        None,
        "",
    )
    assert names(citations.narrative_citations(df)) == [
        (0, "Riand and Radil", "2022"),
        (1, "Suseno", "2025"),
        (2, "Syed et al.", "2024"),
        (3, "Institute of International Finance and Deloitte", "2023"),
        (4, "Grouped Author", "2020"),
        (4, "Grouped Author", "2024"),
        (4, "Grouped Author", "2026a"),
    ]


def test_parenthetical_parts(spark):
    df = article(spark, "(Smith & Jones, 2020; Lee et al., 2021a, p. 5)", "(Received: July 03, 2023; Revised: May 1, 2023)", "(p = 0.4330)", "(APA, 2023a, 2023b)")
    got = citations.parse_parts(citations.paren_citations(df)).select("doc_id", "first_author", "author_count", "year", "page_info").collect()
    assert sorted(map(tuple, got), key=str) == [(0, "Lee", 3, "2021a", "p. 5"), (0, "Smith", 2, "2020", None), (3, "APA", 1, "2023a", None), (3, "APA", 1, "2023b", None)]


def test_positions_point_at_matches(spark):
    df = article(spark, "Ünïcode [1], then [2, 4-6] and (Smith, 2020).")
    for found in (citations.numeric_citations(df), citations.paren_citations(df)):
        rows = found.join(df, "doc_id").select(F.expr("substring(article, position + 1, length(raw)) = raw").alias("ok")).collect()
        assert rows and all(r["ok"] for r in rows)
    assert [r["numbers"] for r in citations.numeric_citations(df).orderBy("position").collect()] == [[1], [2, 4, 5, 6]]


def test_parentheses_count_only_without_brackets(spark):
    df = article(spark, "(1) and [2]", "(1) alone")
    assert {(r["doc_id"], r["form"]) for r in citations.numeric_citations(df).collect()} == {(0, "bracket"), (1, "paren")}


def test_unopened_parenthesis(spark):
    df = article(spark, "as (Ann, 2020; Bob, 2021); Cid, 2022) said", "(fine, 2020)")
    got = citations.malformed_citations(df).where("issue_type = 'missing_open_paren'").collect()
    assert [(r["doc_id"], r["suggestion"]) for r in got] == [(0, "(Ann, 2020; Bob, 2021; Cid, 2022)")]


def test_reference_columns(spark):
    lines = spark.createDataFrame(
        [
            (1, "apa7", 1, "Smith, J., & Jones, K. (2020). Some title? Journal A, 205, 107590."),
            (1, "apa7", 2, "Doe, A. (2021). Other title. Journal B, 12(3), 100-120. https://doi.org/10.1234/ab(1)."),
            (1, "apa7", 3, "no year here"),
            (1, "ieee", 4, '[7] J. Smith and A. Doe, "A title," Journal C, vol. 3, no. 2, pp. 1-9, 2019.'),
        ],
        "doc_id long, style_id string, line_no int, raw string",
    )
    good, bad = refs.build_refs(lines)
    got = {r["line_no"]: r for r in good.collect()}
    assert (got[1]["title"], got[1]["journal"], got[1]["volume"], got[1]["article_number"], got[1]["pages"], got[1]["author_count"]) == ("Some title?", "Journal A", "205", "107590", None, 2)
    assert (got[2]["doi"], got[2]["pages"], got[2]["issue"], got[2]["source_type"]) == ("10.1234/ab(1)", "100-120", "3", "journal-article")
    assert (got[4]["num_label"], got[4]["first_author"], got[4]["year"], got[4]["title"]) == (7, "J. Smith", "2019", "A title")
    assert [r["line_no"] for r in bad.collect()] == [3]


def test_years_of_dois_are_no_years(spark):
    texts = ['[1] J. Smith, "A title," Journal C, vol. 3. doi: 10.1942/p7', '[2] J. Smith, "A title," Journal C, vol. 3, 1996. doi: 10.1942/p7', '[3] J. Smith, "A title," Journal C. https://a.org/2019/x', '[4] J. Smith, "A title," Journal C. doi: 10.1016/j.x.2019.05', '[5] J. Smith, "A title," Journal C, pp. 1-10.2003.']
    rows = refs.build_refs(spark.createDataFrame([(1, "ieee", k + 1, t) for k, t in enumerate(texts)], "doc_id long, style_id string, line_no int, raw string"))[0]
    assert [r["year"] for r in rows.orderBy("line_no").collect()] == [None, "1996", None, None, "2003"]


def test_matching_statuses(spark):
    docs = spark.createDataFrame(
        [(1, "(Zhang, 2020) (Smith, 2020) (Nobody, 1999) (Garciaa, 2021)", "Smith, J. (2020). T. Journal A, 1(1), 1-2.\nZhang, A. (2020). U. Journal A, 1(1), 3-4.\nZhang, B. (2020). V. Journal A, 1(1), 5-6.\nGarcia, B. (2021). W. Journal A, 1(1), 7-8.", "apa7", 2022)],
        "doc_id long, article string, reference_text string, style_id string, as_of_year int",
    )
    r = refs.build_refs(refs.reference_lines(docs))[0]
    m = matching.author_date_matches(citations.author_date_citations(docs), r)
    assert {x["first_author"]: x["status"] for x in m.collect()} == {"Zhang": "ambiguous", "Smith": "exact", "Nobody": "none", "Garciaa": "suggestion"}
    assert sorted(x["line_no"] for x in matching.author_date_uncited(r, m).collect()) == [2, 3]


def test_matching_reads_references_once(spark):
    docs = spark.createDataFrame([(1, "(Smith, 2020)", "Smith, J. (2020). T. Journal A, 1(1), 1-2.", "apa7", 2022)], "doc_id long, article string, reference_text string, style_id string, as_of_year int")
    r = refs.build_refs(refs.reference_lines(docs.withColumnRenamed("article", "a")), list(matching.KEY_COLUMNS))[0]
    m = matching.author_date_matches(citations.author_date_citations(docs), r)
    assert "author_form" not in m._jdf.queryExecution().analyzed().toString()
    assert [(x["status"], x["line_no"]) for x in m.collect()] == [("exact", 1)]


def test_narrative_matches_are_those_of_the_whole_text(spark):
    rng, bits = random.Random(5), ["Smith", " and ", "Lee", ", ", " (2001)", " (2001, 2002)", "(n.d.)", " (see", ") ", "(", "et al.", " said. ", "van ", "\n", "É", " [WHO]", "(1999,", "x", " 5 ", "de la ", "& ", " (2010a)", "."]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(3000)] + [(9000, None), (9001, "("), (9002, "Smith (2001)(2002)")]
    df = spark.createDataFrame(rows, "doc_id long, article string")
    whole = df.select("doc_id", F.coalesce("article", F.lit("")).alias("t")).select("doc_id", "t", F.explode(citations.find_all("t", citations.NARRATIVE)).alias("m"))
    whole = whole.select("doc_id", F.col("m.position").alias("start"), F.col("m.raw").alias("found"), F.expr("substring(t, m.position + length(m.raw), 60)").alias("rest"))
    want = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, citations.narrative_matches(df).collect())) == want and len(want) > 500
