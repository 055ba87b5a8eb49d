"""Mixing sources to target weights by temperature.

A source's share of the tokens, raised to an exponent between 0 and 1 and normalised, is its weight: 1
leaves the corpus as it is, 0 makes all sources equal. The exponent is bisected to meet a target entropy of
the weights or a limit on how often a source repeats. The weights are then realised on a token budget: a
source gets whole epochs of its documents and, for what remains, a prefix of a block permutation.

Block permutation: a document's hash puts it into one of its source's blocks of about ``block_rows``
documents, at most ``most_blocks`` of them; blocks come in hash order, documents in hash order within their block. Token sums of blocks decide which
blocks are in; only the one block of a source in which the budget ends is looked at document by
document. So a source with a third of all rows is spread over its many blocks, and what one task orders is ``most_blocks`` sums or one
block's documents, some numbers each (a source of 10**11 documents has 1.5 million in a block).

What reaches the driver is one row for each source; more than ``most_sources`` raise an error.

Defined results: null text has 0 tokens, null source is a source of its own, sources without tokens get weight 0 and
leave the mix, repeated rows are mixed as often as they come, ties in hash order fall together (a
document is in when its block's sum up to and including its ties is within the budget), an empty table gives an empty
table; other columns stay as they are. An added column of a name that the input has is left out; the input's column stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import written


def word_tokens(text: str = "text") -> Column:
    """White-space words of a text, the token measure of the mix."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\r\\f]+", " "))
    return F.when(words == "", F.lit(0)).otherwise(F.size(F.split(words, " "))).cast("long")


def weights_at(tokens: list[int], exponent: float) -> list[float]:
    raised = [t**exponent if t > 0 else 0.0 for t in tokens]
    total = sum(raised)
    return [r / total if total else 0.0 for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisected(tokens: list[int], budget: int, target_entropy: float | None = None, repetition_limit: float | None = None, rounds: int = 60) -> float:
    """The exponent: smallest within the repetition limit, or that whose weights have the target entropy.

    Both measures fall as the exponent grows. A target outside what 0 to 1 can reach gives the nearer end.
    """

    def above(x: float) -> bool:
        w = weights_at(tokens, x)
        if target_entropy is not None:
            return entropy(w) > target_entropy
        return max((v * budget / t for v, t in zip(w, tokens, strict=True) if t > 0), default=0.0) > repetition_limit

    low, high = 0.0, 1.0
    if not above(low):
        return low
    if above(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) else (low, middle)
    return high


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    repetition_limit: float | None = None,
    budget: int | None = None,
    seed: int = 17,
    block_rows: int = 1024,
    most_blocks: int = 1 << 16,
    most_sources: int = 100_000,
) -> DataFrame:
    """The rows of ``docs`` in the mix, once for each epoch they are in, with mix_source_tokens, mix_weight, mix_tokens, mix_epoch, mix_block,
    mix_block_mark and mix_mark.

    Reading order within a source is (mix_epoch, mix_block_mark, mix_mark). The budget is the corpus' tokens where none is given.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give a target entropy or a repetition limit")
    spark = docs.sparkSession
    mark = F.xxhash64(F.lit(seed), *[F.col(c) for c in ("doc_id", "text") if c in docs.columns])
    # The input's columns travel in one, so no name of theirs meets one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", word_tokens().alias("mix_tokens"), mark.alias("mix_mark"))
    slim = written(rows.select("source", "mix_tokens", "mix_mark"), "mix-tokens")  # words are counted once for all sums
    totals = slim.groupBy("source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    tokens = [r["tokens"] for r in totals]
    budget = sum(tokens) if budget is None else budget
    exponent = bisected(tokens, budget, target_entropy, repetition_limit)
    weights = weights_at(tokens, exponent)
    plan = [
        (r["source"], r["tokens"], w, *divmod(int(w * budget), r["tokens"]), min(most_blocks, max(1, -(-r["n_docs"] // block_rows))))
        for r, w in zip(totals, weights, strict=True)
        if r["tokens"]
    ]
    plan_df = spark.createDataFrame(plan, "mix_source string, mix_source_tokens long, mix_weight double, mix_epochs long, mix_rest long, mix_blocks long")
    # One row for each source, at most most_sources of some 60 bytes: small enough to broadcast, whatever the corpus.

    def in_blocks(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan_df), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("mix_block", F.pmod(F.xxhash64("mix_mark"), F.col("mix_blocks")))

    placed = in_blocks(slim)
    blocks = (
        placed.groupBy("mix_source", "mix_block", "mix_rest")
        .agg(F.sum("mix_tokens").alias("size"))
        .withColumn("mix_block_mark", F.xxhash64(F.lit(seed), "mix_source", "mix_block"))
    )
    w = Window.partitionBy("mix_source").orderBy("mix_block_mark", "mix_block")
    blocks = blocks.withColumn("upto", F.sum("size").over(w)).select(
        F.col("mix_source").alias("b_source"),
        F.col("mix_block").alias("b_block"),
        "mix_block_mark",
        (F.col("mix_rest") - F.col("upto") + F.col("size")).alias("room"),
        "size",
    )
    same = F.col("mix_source").eqNullSafe(F.col("b_source")) & (F.col("mix_block") == F.col("b_block"))
    # Documents of the block in which a source's remainder ends: about block_rows for each source.
    ending = placed.select("mix_source", "mix_block", "mix_mark", "mix_tokens").join(blocks.where("room > 0 and room < size"), same)
    in_block = Window.partitionBy("mix_source").orderBy("mix_mark")
    last = (
        ending.groupBy("mix_source", "mix_mark", "room")
        .agg(F.sum("mix_tokens").alias("t"))
        .withColumn("sum", F.sum("t").over(in_block))
        .where("sum <= room")
        .groupBy("mix_source")
        .agg(F.max("mix_mark").alias("last_mark"))
        .withColumnRenamed("mix_source", "l_source")
    )
    ends = blocks.join(last, F.col("b_source").eqNullSafe(F.col("l_source")), "left").select(
        "b_source",
        "b_block",
        "mix_block_mark",
        F.when(F.col("room") >= F.col("size"), F.lit(2**63 - 1)).when(F.col("room") > 0, F.col("last_mark")).alias("upto_mark"),
    )
    chosen = in_blocks(rows).join(ends, same)
    copies = F.col("mix_epochs") + F.coalesce((F.col("mix_mark") <= F.col("upto_mark")).cast("long"), F.lit(0))
    out = chosen.withColumn("mix_copies", copies).where("mix_copies > 0").withColumn("mix_epoch", F.explode(F.expr("sequence(1L, mix_copies)")))
    added = [c for c in ("mix_source_tokens", "mix_weight", "mix_tokens", "mix_epoch", "mix_block", "mix_block_mark", "mix_mark") if c not in docs.columns]
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *added)
