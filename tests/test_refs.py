"""Parsing of reference lines: shapes that count literal parentheses, and steps that Spark can write as code."""

from pyspark.sql import functions as F

from foliospark.functions import dims
from foliospark.functions.text import SPACES, any_word, squeeze
from foliospark.operators import prep, refs, rules


def lines(spark, *raw):
    return spark.createDataFrame([(1, "apa7", k + 1, x) for k, x in enumerate(raw)], "doc_id int, style_id string, line_no int, raw string")


def test_article_numbers(spark):
    found = refs.build_refs(lines(spark, "Smith, A. (2001). A title. Journal of X, 12(3), Article 45.", "Lee, K. (2002). Other title. Journal of Y, 7(2), e1234."))[0]
    assert [(r.volume, r.issue, r.pages, r.article_number) for r in found.orderBy("line_no").collect()] == [("12", "3", None, "45"), ("7", "2", None, "e1234")]


def test_names_without_array_functions(spark):
    found = refs.build_refs(lines(spark, "A., Smith, B. C., D., & Lee, K. (2001). T.", "World Health Organization. (2001). T.", "some Great Trust (2001). T."), ["authors", "is_institutional"])[0]
    assert [(r.authors, r.is_institutional) for r in found.orderBy("line_no").collect()] == [(["Smith, B. C.", "Lee, K"], False), (["World Health Organization"], True), (["some Great Trust"], False)]


def test_every_step_is_generated_code(spark):
    """An expression over an array's elements would keep its whole step out of generated code: this was the most costly part of a line."""
    found = rules.with_origin(refs.build_refs(lines(spark, "Smith, A. (2001). A title."))[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "*(" in plan


def test_words_share_beginnings(spark):
    texts = [f"x{w}y" for w in dims.LOCAL_WORDS] + ["", "bps", "jaart", "kemen", "a university"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = rows.orderBy("k").select(rows.t.rlike(any_word(dims.LOCAL_WORDS)).alias("x")).collect()
    assert [r.x for r in got] == [any(w in t for w in dims.LOCAL_WORDS) for t in texts]


def test_every_heading_opens_as_listed(spark):
    """Paragraphs are looked at by pattern only if they open as some heading does; none may be lost by that."""
    words = ["Abstract: x", "abſtrak x", "Kata  kunci: x", "KEYWORDS", "1. Pendahuluan", "BAB II LATAR BELAKANG", "3.1 Research Methods", "IV. Metodologi penelitian", "2) Hasil dan Pembahasan", "RESULTS & DISCUSSION", "5 Temuan", "6. Findings",
             "7: Diskusi", "Chapter 8. Conclusions and Suggestions", "SIMPULAN", "9. Kesimpulan", "PENUTUP", "Acknowledgements", "Ucapan terima kasih", "Daftar Pustaka", "Reference list", "Bibliography", "Nothing here", "", None]
    rows = spark.createDataFrame([(k, 0, w) for k, w in enumerate(words)], "doc_id int, para_no int, text string")
    alone = {r.doc_id: r.s.key for r in rows.select("doc_id", prep.section_of("text").alias("s")).collect() if r.s}
    found = prep.sections(rows)
    assert {r.doc_id: r.key for r in found.collect()} == alone and len(alone) == 22
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()


def test_squeezed_texts(spark):
    """Texts that are left as they are would have been left so by the pattern too."""
    texts = ["", " ", "a", " a b ", "a  b", "a\tb", "a\n\nb\r", "\x0ba\x0c", "é é", "é  b", "a​b", "﻿a", "a b c d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    got = rows.select(squeeze("t").alias("a"), F.trim(F.regexp_replace("t", SPACES, " ")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
