import json

from foliospark.operators import checks, terms
from foliospark.sources import readers, sinks


def test_text_and_paragraph_scans(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.txt").write_text("one\ntwo")
    assert [r["text"] for r in readers.read_manuscripts(spark, str(tmp_path / "m")).collect()] == ["one\ntwo"]
    (tmp_path / "p.json").write_text(json.dumps({"doc_id": 1, "paragraphs": ["A", "B"], "tableCount": 2}))
    got = readers.read_paragraphs(spark, str(tmp_path / "p.json")).collect()
    assert [(r["para_no"], r["text"], r["table_count"], r["image_count"]) for r in got] == [(0, "A", 2, 0), (1, "B", 2, 0)]


def test_runs_of_one_flag_merge(spark, tmp_path):
    runs = [(1, 0, 0, "a", True), (1, 0, 1, "b", True), (1, 0, 2, "", False), (1, 0, 3, "c", None), (1, 0, 4, "d", False)]
    spark.createDataFrame(runs, "doc_id long, para_no int, run_no int, text string, italic boolean").write.parquet(str(tmp_path / "runs"))
    got = readers.read_runs(spark, str(tmp_path / "runs")).orderBy("run_no").collect()
    assert [(r["text"], r["italic"]) for r in got] == [("ab", True), ("cd", False)]


def test_compact_registries(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([["1234-5678", None, "J", 1, "2019-2020", "Journal"], ["8765-4321", "1111-2222", "K", 0, "", "Journal", 1, "note", "old"]]))
    a, b = readers.read_registry_sources(spark, str(tmp_path / "s.json")).orderBy("load_order").collect()
    assert (a["active"], a["discontinued"], a["history_note"]) == (True, False, None)
    assert (b["active"], b["discontinued"], b["history_note"], b["related_title"]) == (False, True, "note", "old")
    (tmp_path / "p.json").write_text(json.dumps([["978-1-60423-846-4", "Proc", 2010, "Press"]]))
    assert readers.read_registry_proceedings(spark, str(tmp_path / "p.json")).first()["year"] == 2010


def test_works_documents_and_rules(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"doi": "10.1/AB", "title": ["T"], "author": [{"family": "F"}], "issued": {"date-parts": [[2020, 1]]}, "published-print": {"date-parts": [[2021]]}}))
    w = readers.read_doi_works(spark, str(tmp_path / "w.json")).first()
    assert (w["doi"], w["title"], w["issued"], w["published_print"], w["created"]) == ("10.1/ab", "T", 2020, 2021, None)
    (tmp_path / "d.json").write_text(json.dumps({"doi": "10.1/x", "firstAuthor": "A", "articleNumber": "7"}))
    assert readers.read_registry_documents(spark, str(tmp_path / "d.json")).first()["article_number"] == "7"
    (tmp_path / "r.json").write_text(json.dumps({"rule_set": "s", "minCount": {"enabled": True}, "origin": {"enabled": False, "minPercent": 5}}))
    r = readers.read_rules(spark, str(tmp_path / "r.json")).first()
    assert (r["min_count"], r["intl_min_pct"], r["years"]) == (20, None, None)


def test_sinks(spark, tmp_path):
    issues = spark.createDataFrame([(1, "REF_UNCITED", "error", "x", None)], "doc_id long, issue_code string, severity string, code string, correction string")
    sinks.write_report({"issues": issues}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/issues")).where("issue_code = 'REF_UNCITED'").count() == 1
    sinks.write_converted(spark.createDataFrame([(1, "a", "r", 0)], "doc_id long, article string, reference_text string, more int"), str(tmp_path / "conv"))
    assert spark.read.parquet(str(tmp_path / "conv")).columns == ["doc_id", "article", "reference_text"]


def test_italics_and_table_evidence(spark):
    refs = spark.createDataFrame([(1, 1, "A title. Journal X, 1(2), 3-4.", "A title", "Journal X", "journal-article")], "doc_id long, line_no int, raw string, title string, journal string, source_type string")
    runs = lambda *r: spark.createDataFrame([(1, 1, k, t, i) for k, (t, i) in enumerate(r)], "doc_id long, para_no int, run_no int, text string, italic boolean")
    assert checks.italic_issues(runs(("A title. ", False), ("Journal X", True), (", 1(2), 3-4.", False)), refs).count() == 0
    assert checks.italic_issues(runs(("A title. Journal X, 1(2), 3-4.", False)), refs).count() == 1
    cells = spark.createDataFrame([(1, "Path coefficient", "Job Satisfaction")], "doc_id long, header string, label string")
    named = spark.createDataFrame([(1, "job satisfaction"), (1, "other term")], "doc_id long, norm string")
    assert [r["norm"] for r in terms.table_evidence(cells, named).collect()] == ["job satisfaction"]


def test_rows_meet_terms_in_four_ways(spark):
    cells = spark.createDataFrame(
        [(1, "Factor Loading", "Academic Self-Regulation", ["0.8"]), (1, "CR", "Self Regulation", ["x", "0.7"]), (1, "AVE", " asr ", ["0.7"]), (1, "Path", "Brand Image", ["1"]), (1, "R²", "Brand Image", ["n/a"]), (2, "β, VIF and beta", "Total Brand Images Score", ["1"]), (2, "alpha", "  ", ["1"])],
        "doc_id long, header string, label string, numbers array<string>",
    )
    named = spark.createDataFrame([(1, "academic self regulation"), (1, "active sport role"), (1, "brand image"), (2, "brand image"), (2, "job role"), (None, "x y")], "doc_id long, norm string")
    acronyms = spark.createDataFrame([(1, "active sport role", "ASR"), (2, "job role", "ASR")], "doc_id long, norm string, acronym string")
    got = {(r.doc_id, r.norm) for r in terms.table_evidence(cells, named, acronyms).collect()}
    assert got == {(1, "academic self regulation"), (1, "active sport role"), (2, "brand image")}
    only = terms.table_evidence(cells.where("trim(label) = 'Self Regulation'"), named).collect()
    assert [r.norm for r in only] == ["academic self regulation"]


def test_containment_equals_all_comparisons(spark):
    import random

    rng = random.Random(2)
    inner, outer = ([(rng.randint(1, 3), "".join(rng.choice("ab ") for _ in range(rng.randint(0, n)))) for _ in range(120)] for n in (5, 14))
    got = {tuple(r) for r in terms.contained(spark.createDataFrame(inner, "doc_id long, inner string"), spark.createDataFrame(outer, "doc_id long, outer string")).collect()}
    assert got == {(d, a, b) for d, a in inner if a for e, b in outer if d == e and a in b}


def test_italics_of_each_kind(spark):
    lines = [
        ("apa7", "Smith, J. (2020). A title. Journal X, 1(2), 3-4.", "A title", "journal-article", "Journal X", ["journal"]),
        ("apa7", "Smith, J. (2020). A book. Publisher.", "A book", "book", "A book", ["title"]),
        ("apa7", "Smith, J. (2020). A chapter. In K. Lee (Ed.), The Whole Book (pp. 1-9). Publisher.", "A chapter", "book-chapter", "The Whole Book", ["book"]),
        ("vancouver", "Smith J. A title. J X. 2020;1(2):3-4.", "A title", "journal-article", "", []),
        ("apa7", "Smith, J. (2020). A thesis. University.", "A thesis", "thesis", "A thesis", []),
    ]
    refs = spark.createDataFrame([(1, k, raw, title, kind, style) for k, (style, raw, title, kind, *_) in enumerate(lines)], "doc_id long, line_no int, raw string, title string, source_type string, style_id string")
    cut = lambda k, raw, part, on: [(1, k, n, t, i) for n, (t, i) in enumerate([(raw.partition(part)[0], not on), (part, on), (raw.partition(part)[2], not on)] if part else [(raw, not on)])]
    runs = lambda on: spark.createDataFrame([r for k, (_, raw, _, _, part, _) in enumerate(lines) for r in cut(k, raw, part, on)], "doc_id long, para_no int, run_no int, text string, italic boolean")
    right = {(r.code, r.correction) for r in checks.italic_issues(runs(True), refs).collect()}
    assert right == set()
    wrong = {(r.code, r.correction) for r in checks.italic_issues(runs(False), refs).collect()}
    assert wrong == {(lines[0][1], "journal"), (lines[0][1], "title"), (lines[1][1], "title"), (lines[2][1], "book"), (lines[2][1], "title"), (lines[3][1], "whole")}
