from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import checks, diff, prep, registry


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_dice(spark):
    assert one(spark, text.dice_bigram("a", "b"), a="night", b="nacht") == 0.25
    assert one(spark, text.dice_bigram("a", "b"), a="", b="") == 0.0
    assert one(spark, text.dice_bigram("a", "b"), a="Same-Title!", b="same title") < 1
    assert one(spark, text.dice_bigram("a", "b"), a="Ab!", b="ab") == 1.0


def test_coverage_is_three_valued(spark):
    covered = text.year_covered("c", "y")
    assert one(spark, covered, c="2019-2020; 2011-2015", y="2016") is False
    assert one(spark, covered, c="2019-2020; 2011", y="2011a") is True
    assert one(spark, covered, c="", y="2016") is None
    assert one(spark, covered, c="2019-2020", y="n.d.") is None


def test_headings(spark):
    tail = "\nSmith, J. (2020). A title long enough to count.\n"
    rows = [(k, f"Text before.\n{h}{tail}") for k, h in enumerate(["References", "Refernces", "Bibliograpy", "Preference", "Conference", "REFERENCE", "5. Daftar Pustaka:"])]
    found = prep.find_reference_heading(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["heading_is_typo"] for r in found} == {0: False, 1: True, 2: True, 5: False, 6: False}


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([(1, "As Smith et al. found it works. Short one. See fig. 3 for all of it!")], "doc_id long, text string")
    assert [r["sentence"] for r in prep.sentences(df).collect()] == ["As Smith et al. found it works.", "See fig. 3 for all of it!"]


def test_runs(spark):
    df = spark.createDataFrame([([3, 1, 2, 5, 7, 8],)], "n array<int>")
    assert df.select(checks.compressed_runs(F.col("n")).alias("x")).first()["x"] == "1-3, 5, 7, 8"


def test_registry_cascade(spark):
    refs = spark.createDataFrame(
        [(1, 1, "10.1/x", "Any", "A, B", "J", None, None, "2020", None, None, None), (1, 2, None, "Deep learning for crop yield", "Smith, J.", "Crops", None, None, "2020", "1", "2-3", None), (1, 3, None, "Unrelated", None, "Known Journal", None, None, "2016", None, None, None)],
        "doc_id long, line_no int, doi string, title string, first_author string, journal string, issn string, eissn string, year string, volume string, pages string, article_number string",
    )
    docs = spark.createDataFrame(
        [("https://doi.org/10.1/X", "Whatever", None, None, None, None, None, None, None, None, None), (None, "Deep-learning for crop yield", "Smith, J.", "Crops", None, None, "2020", "1", None, "2-3", None)],
        "doi string, title string, first_author string, journal string, issn string, eissn string, year string, volume string, issue string, pages string, article_number string",
    )
    src = spark.createDataFrame([("1234-5678", None, "Known journal", "2019-2020", False)], "issn string, eissn string, title string, coverage string, discontinued boolean")
    got = {r["line_no"]: (r["status"], r["method"]) for r in registry.registry_matches(refs, docs, src).collect()}
    assert got == {1: ("SCOPUS", "DOI_EXACT"), 2: ("SCOPUS", "METADATA_MATCH"), 3: ("UNKNOWN", "JOURNAL_FOUND_YEAR_NOT_COVERED")}


words = st.lists(st.sampled_from(["a", "b", "cc", "d d", "e\n"]), max_size=8)


@settings(max_examples=80, deadline=None)
@given(words, words)
def test_scripts_give_both_versions_back(old, new):
    script = diff.edit_script(" ".join(old), " ".join(new))
    assert "".join(t for k, t in script if k != "add") == " ".join(old)
    assert "".join(t for k, t in script if k != "del") == " ".join(new)
