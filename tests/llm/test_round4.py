"""Regression tests of the findings on CPU seconds, disk and memory."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers

from foliospark.llm import alignment, jaccard_join
from foliospark.plans import queries


def _set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))


def test_sketches_lose_no_link_and_tell_other_pairs(spark):
    """Whole sets travel only for pairs that may link: before, all named pairs were fetched, 64 times the bytes."""
    rng = np.random.default_rng(7)
    rows, pairs, linked = [], [], set()
    for k, (n, kept) in enumerate([(1, 1), (5, 5), (40, 36), (300, 268), (300, 280), (3000, 2700), (700, 600), (300, 0), (3000, 300), (900, 450)]):
        x = _set(rng, n)
        y = np.unique(np.r_[x[:kept], _set(rng, n - kept)])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            linked.add((2 * k, 2 * k + 1))
        apart = len(x) + len(y) - 2 * both
        assert jaccard_join.bits_apart(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= apart
        rows += [(2 * k, len(x), bytearray(jaccard_join.sketch(x))), (2 * k + 1, len(y), bytearray(jaccard_join.sketch(y)))]
        pairs.append((2 * k, 2 * k + 1))
    cut = spark.createDataFrame(rows, "doc_id long, n long, sketch binary")
    left = {(r.a, r.b) for r in jaccard_join.plausible(spark.createDataFrame(pairs, "a long, b long"), cut, 80).collect()}
    assert linked and linked <= left
    assert not left & {(14, 15), (16, 17), (18, 19)}
    long, short_ = _set(rng, 5000), _set(rng, 200)
    assert jaccard_join.bits_apart(jaccard_join.sketch(long), jaccard_join.sketch(short_)) <= len(long) + len(short_)


def test_runs_and_bytes_of_tokens_are_those_of_the_plain_way():
    pattern = re.compile(r"\S{600}|\s{600}")
    for text in ("", "a", " ", "a" * 599, "a" * 600, "b " + "a" * 600 + " c", " " * 599, " " * 600, "a" + "\u2003\n" * 300 + "a", "a b " * 400, "\x1c" * 600, "\u200b" * 600):
        assert alignment.has_long_run(text) == (pattern.search(text) is not None)
    side = alignment.ByteSide(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "a", "na\u00efve caf\u00e9 <|endoftext|> 12", "\U0001f600" * 3, "x" * 700):
        ids = side.encode(text)
        assert side.joined(ids) == b"".join(side.bytes[k] for k in ids) == (" " + text).encode()


def test_order_of_citations_renders_manuscripts_once(spark):
    """the plan that is left reads settled tables; before, it rendered the manuscripts three times."""
    plan = queries.QUERIES["w3_citation_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "p_partkey" not in plan
