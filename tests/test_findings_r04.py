"""Steps that the findings of round 4 name."""

import time

from pyspark.sql import functions as F

from foliospark.operators import citations, terms
from foliospark.plans import further, queries
from foliospark.session import settled


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    ends = settled(spark.range(1_000_000).select("id", F.lit("the same text in each of many rows").alias("text")))
    joined = spark.range(1_000_000).selectExpr("id * 2 AS id").join(ends, "id").agg(F.count("text"))
    assert "Broadcast" not in executed(joined)
    few = settled(spark.range(10))
    assert "BroadcastHashJoin" in executed(spark.range(2_000_000).join(few, "id").agg(F.count("id")))


def test_roles_read_edges_once(spark):
    edges = spark.createDataFrame([(1, "PREDICTS", "a b", "c d", False), (1, "MEDIATES", "c d", "a b,e f", False)], "doc_id long, type string, subject string, object string, inferred boolean")
    found = terms.roles(edges)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {(r["norm"], *r["roles"], *r["related_to"]) for r in found.collect()} == {("a b", "predictor", "c d"), ("c d", "mediator", "outcome", "a b")}


def test_definitions_look_for_each_pattern_once_where_a_piece_of_it_stands(spark):
    texts = [
        "Work Life Balance IS  not. Work Life Balance is  the ease of all who rest well.", "Work Life Balance Proposes that people rest.", "Work Life Balance indikator; it indicators of ease for many.",
        "The New Basic Scale was used to measure Work Life Balance.", "Work Life Balance acts as a mediator in all that we do.", "Work Life Balance was here.",
    ]
    found = terms.mentions(spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, para_no int, text string"))
    defined = terms.definitions(found)
    assert {r["type"] for r in defined.collect()} == {"conceptual", "operational", "role"}
    plan = defined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr(") == len(terms.DEFINITIONS) + 1 or plan.count("RegExpInStr") == len(terms.DEFINITIONS) + 1


def test_issues_of_some_codes_need_nothing_of_others(spark, monkeypatch):
    made = []
    for module in (queries, further):
        monkeypatch.setattr(module, "settled", lambda df, plain=queries.settled: made.append(df.columns) or plain(df))
    monkeypatch.setattr(queries.stats, "near_duplicates", lambda r: 1 / 0)
    found = {r["issue_code"] for r in queries.QUERIES["v10_numeric_issues"](spark, "/root/testdata/sf0.001").select("issue_code").distinct().collect()}
    assert found == {"NUM_DANGLING", "NUM_ORDER_MISMATCH", "REF_UNCITED"} and made[1] == ["doc_id", "line_no", "raw", "num_label"]
    made.clear()
    queries.QUERIES["v10_author_date_issues"](spark, "/root/testdata/sf0.001")
    assert made[1] == ["doc_id", "line_no", "raw", "author_form", "is_institutional", "author_count", "first_author", "year"]


def test_references_are_read_with_the_columns_that_are_used(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries.refs, "build_refs", lambda lines, columns=None, plain=queries.refs.build_refs: asked.append(columns) or plain(lines, columns))
    for name in ("v7_italics", "v10_doi_and_italic_issues", "k4_apa_references", "v3_et_al_unneeded"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked and all(c is not None for c in asked)


def test_a_long_word_is_not_searched_from_each_of_its_letters(spark):
    df = spark.createDataFrame([(1, "a" * 300_000), (2, "We saw it(Miller, 2001) and ((b) c) Ode, 2002) too (d).")], "doc_id long, article string")
    began = time.time()
    found = {(r["doc_id"], r["issue_type"]) for r in citations.malformed_rows(df).collect()}
    assert found == {(2, "no_space_before_paren"), (2, "missing_open_paren")} and time.time() - began < 40


def test_texts_of_small_documents_are_compared_in_place(spark, monkeypatch):
    words = ["a", "ab", "abc", "b c", "xabcx", "c", "", "zzz", "b cd"]
    inner = spark.createDataFrame([(d, w) for d in (1, 2) for w in words[: 5 * d]], "doc_id long, inner string")
    outer = spark.createDataFrame([(d, w) for d in (1, 2) for w in words[3 - d :]], "doc_id long, outer string")
    want = {(d, i, o) for d in (1, 2) for i in words[: 5 * d] for o in words[3 - d :] if i and i in o}
    found = lambda: sorted(map(tuple, terms.contained(inner, outer).collect()))
    assert found() == sorted(want)
    monkeypatch.setattr(terms, "IN_PLACE", 0)
    assert found() == sorted(want)
    monkeypatch.setattr(terms, "IN_PLACE", 64)
    monkeypatch.setattr(terms, "_windows", lambda c, sizes: F.lit(None).cast("array<string>"))
    assert found() == sorted(want)
