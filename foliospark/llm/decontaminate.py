"""Benchmark decontamination with a BM25 index of the test items and block-max pruning.

The items are indexed, the training passages are the queries: windows of ``2 * stride`` words, one every
``stride`` words, so that any run of ``stride`` words (no item has more) lies whole in a window. Impacts
are BM25 weights divided by the item's own total, so one threshold, ``share``, serves all items: a passage
hits an item when it holds that share of the item's BM25 weight.

Pruning as in block-max WAND: a window whose terms' largest impacts can't reach the threshold is skipped,
then a block of items whose block maxima can't reach it; only what is left is scored exactly. All windows of
a slice of texts go through these steps together, in arrays. Nothing above the threshold is lost, as every bound is an upper
bound.

A hit is verified by overlap: of the item's question and of its answer, each, a share ``overlap`` of the words has to
be covered by five-word runs (shorter parts: the whole part) that the window has too. An item's answer is what follows its
last question mark, else its last sentence, else its second half.

The index is collected and sent to the tasks only in shards of at most ``shard_terms`` postings; items are
spread over as many shards as that needs and every shard sees all passages.

Defined results: null or empty text has no passages; items without words are never hit; equal items are hit alike;
repeated documents give repeated hits once for each (doc_id, item_id); an empty table on either side gives no hits; columns other
than doc_id, text, item_id aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import slices, written

_WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
BLOCK = 16  # items in a block
RUN = 5  # words in a run that counts as overlap


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    text = (text or "").strip()
    mark = text.rfind("?")
    if 0 <= mark < len(text) - 1:
        parts = text[: mark + 1], text[mark + 1 :]
    else:
        cut = max(text.rfind(end, 0, -1) for end in (". ", "! ", ".\n", "!\n", "?\n", "? ", "\n")) if text else -1
        parts = (text[: cut + 1], text[cut + 1 :]) if cut >= 0 else ("", text)
    question, answer = words_of(parts[0]), words_of(parts[1])
    if len(question) < 3 or len(answer) < 3:
        both = question + answer
        question, answer = both[: (len(both) + 1) // 2], both[(len(both) + 1) // 2 :]
    return question, answer


def postings(items: DataFrame) -> DataFrame:
    """item_id, question, answer and for each term tf and df; the inverted index as a table."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [question_and_answer(t) for t in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"], "question": [q for q, _ in parts], "answer": [a for _, a in parts]})

    parts = items.select("item_id", "text").mapInPandas(split, "item_id long, question array<string>, answer array<string>")
    words = F.concat("question", "answer")
    return parts.withColumn("n_words", F.size(words)).where("n_words > 0")


@dataclass
class ItemIndex:
    """One shard: term numbers, impacts by item, block maxima by term, and the items' words for the check."""

    items: list[int]
    parts: list[tuple[list[int], list[int]]]
    terms: dict[str, int]
    stride: int
    top: np.ndarray = field(default=None)
    block_start: np.ndarray = field(default=None)
    block_of: np.ndarray = field(default=None)
    block_max: np.ndarray = field(default=None)
    item_start: np.ndarray = field(default=None)
    item_of: np.ndarray = field(default=None)
    impact: np.ndarray = field(default=None)

    @classmethod
    def of(cls, rows: list, df: dict[str, int], n_items: int, mean_words: float) -> ItemIndex:
        """rows: (item_id, question, answer); df: items with a term, over all shards."""
        terms: dict[str, int] = {}
        term, item, value, parts = [], [], [], []
        for k, (_, question, answer) in enumerate(rows):
            tf: dict[str, int] = {}
            for w in [*question, *answer]:
                tf[w] = tf.get(w, 0) + 1
            length = sum(tf.values())
            raw = {
                w: np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean_words))
                for w, n in tf.items()
            }
            total = sum(raw.values())
            for w, v in raw.items():
                term.append(terms.setdefault(w, len(terms)))
                item.append(k)
                value.append(v / total)
            parts.append(([terms[w] for w in question], [terms[w] for w in answer]))
        index = cls([r[0] for r in rows], parts, terms, max([64, *(len(q) + len(a) for q, a in parts)]))
        term, item, value = np.array(term), np.array(item), np.array(value)
        order = np.lexsort((item, term))
        term, item, value = term[order], item[order], value[order]
        index.item_start = np.searchsorted(term, np.arange(len(terms) + 1))
        index.item_of, index.impact = item, value
        index.top = np.maximum.reduceat(value, index.item_start[:-1])
        block = item // BLOCK
        first = np.flatnonzero(np.r_[True, (np.diff(term) > 0) | (np.diff(block) > 0)])
        index.block_of, index.block_max = block[first], np.maximum.reduceat(value, first)
        index.block_start = np.searchsorted(term[first], np.arange(len(terms) + 1))
        return index

    def retrieve(self, windows: np.ndarray, terms: np.ndarray, n_windows: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, score) of all pairs at or above the threshold; windows and terms are distinct pairs, ordered."""
        share = share - 1e-9
        bound = np.bincount(windows, self.top[terms], minlength=n_windows)
        alive = bound[windows] >= share
        windows, terms = windows[alive], terms[alive]
        pair, at = _expand(self.block_start, terms)
        n_blocks = -(-len(self.items) // BLOCK)
        cell, inverse = _cells(windows[pair] * n_blocks + self.block_of[at])
        alive_cells = np.bincount(inverse, self.block_max[at], minlength=len(cell)) >= share
        hot = cell[alive_cells]
        if not len(hot):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        use = np.isin(windows, np.unique(hot // n_blocks))
        windows, terms = windows[use], terms[use]
        pair, at = _expand(self.item_start, terms)
        window, item = windows[pair], self.item_of[at]
        in_hot = np.isin(window * n_blocks + item // BLOCK, hot)
        cell, inverse = _cells(window[in_hot] * len(self.items) + item[in_hot])
        score = np.bincount(inverse, self.impact[at[in_hot]], minlength=len(cell))
        good = score >= share
        return cell[good] // len(self.items), cell[good] % len(self.items), score[good]


def _cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and each key's place among them."""
    return np.unique(keys, return_inverse=True)


def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of terms, the entries of its list: (which term entry, place in the lists)."""
    sizes = starts[terms + 1] - starts[terms]
    which = np.repeat(np.arange(len(terms)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[terms], sizes)


def covered(part: list[int], window: list[int]) -> float:
    """The share of a part's words that lie in runs of RUN words (or the whole, if shorter) which the window has."""
    if not part:
        return 1.0
    n = min(RUN, len(part))
    there = {tuple(window[k : k + n]) for k in range(len(window) - n + 1)}
    marks = np.zeros(len(part), dtype=bool)
    for k in range(len(part) - n + 1):
        if tuple(part[k : k + n]) in there:
            marks[k : k + n] = True
    return float(marks.mean())


def hits_in(texts: list[str], index: ItemIndex, share: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text number, item number, score, question overlap, answer overlap) of every verified hit."""
    get, stride = index.terms.get, index.stride
    ids = [[get(w, -1) for w in words_of(t)] for t in texts]
    sizes = np.array([len(x) for x in ids])
    if not sizes.sum():
        return
    flat = np.concatenate([np.array(x, dtype=np.int64) for x in ids])
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[doc]
    n_windows = np.maximum(1, -(-sizes // stride) - 1)
    first = np.cumsum(n_windows) - n_windows
    known = flat >= 0
    flat, doc, place = flat[known], doc[known], place[known]
    step = place // stride
    n_terms = len(index.terms)
    # A word lies in the window that starts at its step and in the one before.
    here, before = step < n_windows[doc], step >= 1
    keys = np.unique(np.r_[(first[doc] + step)[here] * n_terms + flat[here], (first[doc] + step - 1)[before] * n_terms + flat[before]])
    window, item, score = index.retrieve(keys // n_terms, keys % n_terms, int(n_windows.sum()), share)
    of_window = np.searchsorted(first, window, side="right") - 1
    for w, d, i, s in zip(window.tolist(), of_window.tolist(), item.tolist(), score.tolist(), strict=True):
        begin = (w - int(first[d])) * stride
        part = ids[d][begin : begin + 2 * stride]
        question, answer = index.parts[i]
        q, a = covered(question, part), covered(answer, part)
        if q >= overlap and a >= overlap:
            yield d, i, s, q, a


def contamination(docs: DataFrame, items: DataFrame, share: float = 0.6, overlap: float = 0.6, shard_terms: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the best verified passage for each pair of document and item."""
    parts = written(postings(items), "items")
    size = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n_items, n_words = size[0], size[1]
    shards = max(1, -(-n_words // shard_terms))
    terms = parts.select("item_id", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term"), F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("shard"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = None
    for shard in range(shards):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard
        rows = [(r[0], list(r[1]), list(r[2])) for r in parts.where(mine).select("item_id", "question", "answer").collect()]
        rows.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2]))
        df = {r["term"]: r["df"] for r in counts.join(terms.where(F.col("shard") == shard).select("term").distinct(), "term", "left_semi").collect()}
        found = _against(docs, ItemIndex.of(rows, df, n_items, n_words / n_items) if rows else None, share, overlap)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), F.desc("question_overlap"), F.desc("answer_overlap"))
    return out.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def _against(docs: DataFrame, index: ItemIndex | None, share: float, overlap: float) -> DataFrame:
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].tolist()]
            rows = []
            for begin, end in slices(texts) if index else ():
                for d, i, s, q, a in hits_in(texts[begin:end], index, share, overlap):
                    doc_id = batch["doc_id"].iloc[begin + d]
                    rows.append((None if pd.isna(doc_id) else int(doc_id), index.items[i], s, q, a))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(found, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def clean(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without a verified hit. What is found is small next to the corpus; it is written once."""
    leaks = written(contamination(docs, items, **settings).select("doc_id").distinct(), "leaks")
    return docs.alias("d").join(leaks.alias("leak"), F.col("d.doc_id").eqNullSafe(F.col("leak.doc_id")), "left_anti")
