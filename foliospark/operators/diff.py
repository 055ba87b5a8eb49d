"""Comparison of two versions of a document.

1. Anchors. Paragraphs (pair_id, side old or new, para_no, text) are reduced to digests; those of one pair meet in one group, where a longest common
   subsequence is found in memory that grows with the root of the table, texts aren't there. Equal beginnings and ends need no table.
2. Gaps. The paragraphs between two anchors are told by running counts. Within a gap, two paragraphs are compared only where they share a word that is
   rare enough to matter: similarity is a share of common characters, so of each paragraph the words that come first in one order (rarest first, spaces last) and
   hold all but a sixth of its characters must meet. Candidates are spread over the cluster and scored.
3. Pairing. The pair of greatest similarity comes first, ties by old and then by new place. Pairs that are best for both of their paragraphs are taken in
   rounds, which gives the same pairs as taking them one by one.
4. Paired paragraphs get a word-level edit script.

Gaps have no bound on their size. The alignments need a traceback, so they run in Python over Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import text_of
from foliospark.session import settled, ship_package

SIMILAR = 0.3
SCRIPT = "array<struct<type:string,text:string>>"


def tokens(text: Column | str) -> Column:
    """Words and the spaces between them, in order."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("\\S+|\\s+"), F.lit(0))


def _rows_below(x: np.ndarray, y: np.ndarray, last: np.ndarray, keep: int) -> list[np.ndarray]:
    """Rows of the table of longest common subsequences, for x from its end on: every ``keep``-th one, the first of x last. ``last``: the row behind x."""
    row, kept = last, []
    for i in range(len(x) - 1, -1, -1):
        # Best of skipping here and of taking an equal pair; running maxima from the right skip in the other list.
        take = np.where(y == x[i], row[1:] + 1, 0)
        row = np.r_[np.maximum.accumulate(np.maximum(row[:-1], take)[::-1])[::-1], 0].astype(np.int32)
        if i % keep == 0:
            kept.append(row)
    return kept


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists, as pairs of places, of several the one that skips in ``a`` first.

    Of the table, every root-th row is kept; the walk through it makes the rows between two of these again, so memory is the length of one list times
    the root of the other's.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    start = [(k, k) for k in range(head)]
    a, b = a[head:], b[head:]
    if not a or not b:
        return start
    number = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([number[v] for v in a]), np.array([number[v] for v in b])
    keep = max(1, int(len(x) ** 0.5))
    marks = _rows_below(x, y, np.zeros(len(y) + 1, dtype=np.int32), keep)[::-1]
    out, i, j, block, table = [], 0, 0, -1, []
    while i < len(x) and j < len(y):
        if i // keep != block:
            block = i // keep
            end = min(len(x), (block + 1) * keep)
            below = marks[block + 1] if block + 1 < len(marks) else np.zeros(len(y) + 1, dtype=np.int32)
            table = [*_rows_below(x[block * keep : end], y, below, 1)[::-1], below]
        k = i - block * keep
        if x[i] == y[j] and table[k][j] == table[k + 1][j + 1] + 1:
            out.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif table[k + 1][j] >= table[k][j + 1]:
            i += 1
        else:
            j += 1
    return start + out


def edit_script(old: str, new: str) -> list[tuple[str, str]]:
    """(same, del or add; text) over words and spaces; neighbours of one type are one."""
    a, b = re.findall(r"\S+|\s+", old or ""), re.findall(r"\S+|\s+", new or "")
    steps: list[tuple[str, str]] = []
    i = j = 0
    for p, q in [*_common(a, b), (len(a), len(b))]:
        steps += [("del", t) for t in a[i:p]] + [("add", t) for t in b[j:q]]
        if p < len(a):
            steps.append(("same", a[p]))
        i, j = p + 1, q + 1
    merged: list[tuple[str, str]] = []
    for kind, text in steps:
        if merged and merged[-1][0] == kind:
            merged[-1] = (kind, merged[-1][1] + text)
        else:
            merged.append((kind, text))
    return merged


def similarity(old: str, new: str) -> float:
    """Characters of common words and spaces over the characters of both texts, each side counted."""
    if not old and not new:
        return 1.0
    script = edit_script(old, new)
    same = 2 * sum(len(t) for k, t in script if k == "same")
    return same / max(1, same + sum(len(t) for k, t in script if k != "same"))


def anchors(paragraphs: DataFrame) -> DataFrame:
    """pair_id, old_idx and new_idx of equal paragraphs that both versions have in one order, as many as there can be."""
    ship_package(paragraphs.sparkSession)

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def common(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in batches:
            yield pd.Series([[{"a": i, "b": j} for i, j in _common(list(x), list(y))] for x, y in zip(old, new, strict=True)])

    # One row for each pair: many small pairs share a batch.
    own = F.struct("para_no", F.md5(text_of("text").cast("binary")).alias("digest"))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, own))).alias(side)
    both = paragraphs.groupBy("pair_id").agg(of("old"), of("new")).where("size(old) > 0 and size(new) > 0")
    met = both.select("pair_id", F.col("old.para_no").alias("old"), F.col("new.para_no").alias("new"), common("old.digest", "new.digest").alias("met"))
    each = F.transform("met", lambda m: F.struct(F.get("old", m["a"]).cast("int").alias("old_idx"), F.get("new", m["b"]).cast("int").alias("new_idx")))
    return met.select("pair_id", F.inline(each))


def _word_entries(rows: DataFrame) -> DataFrame:
    """pair_id, side, gap, para_no, token, size (characters of the paragraph) and above (those of the tokens before it, rarest first).

    A token that comes again is numbered, so what two paragraphs share is a set of tokens. Spaces come last of all.
    """
    words = rows.select("pair_id", "side", "gap", "para_no", F.length(text_of("text")).alias("size"), F.explode(tokens("text")).alias("word"))
    counted = words.groupBy("pair_id", "side", "gap", "para_no", "size", "word").agg(F.count(F.lit(1)).cast("int").alias("times"))
    counted = counted.withColumn("often", F.sum("times").over(Window.partitionBy("pair_id", "gap", "word")))
    each = counted.select("*", F.explode(F.sequence(F.lit(1), "times")).alias("again"))
    order = Window.partitionBy("pair_id", "side", "gap", "para_no").orderBy(F.trim("word") == "", "often", "word", "again").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum(F.length("word")).over(order), F.lit(0))
    return each.select("pair_id", "side", "gap", "para_no", F.struct("word", "again").alias("token"), "size", above.alias("above"))


def gap_candidates(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Distinct pair_id, gap, old_idx and new_idx of paragraphs of one gap that may be similar; none that is gets lost.

    Two paragraphs of n and m characters that are similar have at least similar * (n + m) / 2 characters in common tokens, and so at least
    n * similar / (2 - similar). With tokens in one order, the first common one has that much at or behind it in both.
    """
    ratio = similar / (2 - similar)
    both = Window.partitionBy("pair_id", "gap")
    sided = rows.withColumn("sides", F.size(F.collect_set("side").over(both))).where("sides = 2").drop("sides")
    e = _word_entries(sided).where(F.col("size") - F.col("above") >= F.col("size") * ratio - 1e-9)
    side = lambda s, key, n, above: e.where(F.col("side") == s).select("pair_id", "gap", "token", F.col("para_no").alias(key), F.col("size").alias(n), F.col("above").alias(above))
    met = side("old", "old_idx", "n", "n_above").join(side("new", "new_idx", "m", "m_above"), ["pair_id", "gap", "token"])
    need = similar * (F.col("n") + F.col("m")) / 2 - 1e-9
    fits = (F.least("n", "m") >= ratio * F.greatest("n", "m") - 1e-9) & (F.least(F.col("n") - F.col("n_above"), F.col("m") - F.col("m_above")) >= need)
    empty = sided.where(text_of("text") == "")
    blank = empty.where("side = 'old'").select("pair_id", "gap", F.col("para_no").alias("old_idx")).join(empty.where("side = 'new'").select("pair_id", "gap", F.col("para_no").alias("new_idx")), ["pair_id", "gap"])
    return met.where(fits).select("pair_id", "gap", "old_idx", "new_idx").unionByName(blank).distinct()


def paired(scored: DataFrame, rounds: int = 1000) -> DataFrame:
    """pair_id, old_idx and new_idx that greedy choice by similarity takes, from (pair_id, old_idx, new_idx, similarity)."""
    first = lambda key: Window.partitionBy("pair_id", key).orderBy(F.desc("similarity"), "old_idx", "new_idx")
    left, taken = settled(scored), None
    for _ in range(rounds):
        if not left.take(1):
            break
        ranked = left.withColumn("a", F.row_number().over(first("old_idx"))).withColumn("b", F.row_number().over(first("new_idx")))
        now = settled(ranked.where("a = 1 and b = 1").select("pair_id", "old_idx", "new_idx"))
        taken = now if taken is None else taken.unionByName(now)
        left = left.join(now.select("pair_id", "old_idx"), ["pair_id", "old_idx"], "left_anti").join(now.select("pair_id", "new_idx"), ["pair_id", "new_idx"], "left_anti")
        left = settled(left)
    else:
        raise RuntimeError(f"paragraphs are not paired after {rounds} rounds")
    return scored.select("pair_id", "old_idx", "new_idx").where("false") if taken is None else taken


def _sided(rows: DataFrame) -> DataFrame:
    return settled(rows.select("pair_id", "side", F.col("para_no").cast("int").alias("para_no"), "text"))


def diff_rows(paragraphs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """As ``diff_paragraphs``, without the texts."""
    return _diff_rows(_sided(paragraphs), similar)


def _diff_rows(rows: DataFrame, similar: float) -> DataFrame:
    ship_package(rows.sparkSession)
    fixed = settled(anchors(rows))
    ends = fixed.select("pair_id", F.inline(F.array(F.struct(F.lit("old").alias("side"), F.col("old_idx").alias("para_no")), F.struct(F.lit("new").alias("side"), F.col("new_idx").alias("para_no")))), F.lit(1).alias("anchor"))
    upto = Window.partitionBy("pair_id", "side").orderBy("para_no").rowsBetween(Window.unboundedPreceding, -1)
    # Places are found without texts; only paragraphs that are no anchors are read again with theirs.
    placed = rows.select("pair_id", "side", "para_no").join(ends, ["pair_id", "side", "para_no"], "left").withColumn("gap", F.coalesce(F.sum(F.coalesce("anchor", F.lit(0))).over(upto), F.lit(0)).cast("int"))
    placed = settled(placed)
    loose = settled(placed.where("anchor is null").drop("anchor").join(rows, ["pair_id", "side", "para_no"]))

    @F.pandas_udf("double")
    def scored(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in pairs:
            yield pd.Series([similarity(a or "", b or "") for a, b in zip(old, new, strict=True)], dtype="float64")

    met = gap_candidates(loose, similar).join(_texts(loose, "old"), ["pair_id", "old_idx"]).join(_texts(loose, "new"), ["pair_id", "new_idx"])
    met = met.select("pair_id", "old_idx", "new_idx", scored("old_text", "new_text").alias("similarity")).where(F.col("similarity") >= similar)
    pairs = paired(met)

    new = placed.where("side = 'new'").select("pair_id", "gap", F.col("para_no").alias("new_idx"), "anchor")
    partner = fixed.select("pair_id", "old_idx", "new_idx").unionByName(pairs)
    new = new.join(partner, ["pair_id", "new_idx"], "left")
    kind = F.when(F.col("anchor") == 1, "same").when(F.col("old_idx").isNotNull(), "modified").otherwise("add")
    new = new.select("pair_id", "gap", kind.alias("type"), "old_idx", "new_idx")
    gone = placed.where("side = 'old'").select("pair_id", "gap", F.col("para_no").alias("old_idx")).join(partner.select("pair_id", "old_idx"), ["pair_id", "old_idx"], "left_anti")
    gone = gone.select("pair_id", "gap", F.lit("del").alias("type"), "old_idx", F.lit(None).cast("int").alias("new_idx"))
    place = F.when(F.col("type") == "del", 0).when(F.col("type") == "same", 2).otherwise(1)
    order = Window.partitionBy("pair_id").orderBy("gap", place, F.coalesce("new_idx", "old_idx"))
    return new.unionByName(gone).select("pair_id", (F.row_number().over(order) - 1).alias("seq"), "type", "old_idx", "new_idx")


def _texts(rows: DataFrame, side: str) -> DataFrame:
    return rows.where(F.col("side") == side).select("pair_id", F.col("para_no").alias(f"{side}_idx"), F.col("text").alias(f"{side}_text"))


def diff_paragraphs(paragraphs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """pair_id, seq, type (same, del, add, modified), old_idx, new_idx and both texts for every pair of versions.

    In each gap, deleted paragraphs come first, then those of the new version in their order. A null text is empty.
    """
    rows = _sided(paragraphs)
    found = settled(_diff_rows(rows, similar)).join(_texts(rows, "old"), ["pair_id", "old_idx"], "left").join(_texts(rows, "new"), ["pair_id", "new_idx"], "left")
    texts_ = [F.when(F.col(k).isNotNull(), text_of(t)).alias(t) for k, t in (("old_idx", "old_text"), ("new_idx", "new_text"))]
    return found.select("pair_id", "seq", "type", "old_idx", "new_idx", *texts_)


def word_diff(diff: DataFrame) -> DataFrame:
    """Modified rows with their edit script, an array of (type, text)."""
    ship_package(diff.sparkSession)

    @F.pandas_udf(SCRIPT)
    def script(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in pairs:
            yield pd.Series([[{"type": k, "text": t} for k, t in edit_script(a, b)] for a, b in zip(old, new, strict=True)])

    return diff.where("type = 'modified'").select("pair_id", "seq", "old_idx", "new_idx", script("old_text", "new_text").alias("script"))
