"""Spelling variant grouping by Bloom-guided neighbourhoods.

Words are counted natively. The words that differ from a word by one code point are found in these steps:

1. Every word gets a 64-bit polynomial hash of its code points. The vocabulary's hashes are put into blocked Bloom filters, one for
   each word length (cut by hash where one filter is larger than ``FILTER_BYTES``), built where the hashes are.
2. Filters are broadcast in rounds of at most ``FILTER_BYTES``; a word takes part in the rounds of its own length and of the one below. Tasks
   generate its edits (each code point deleted, each replaced by each larger letter of the alphabet) as hashes only, by
   arithmetic on prefix hashes, and probe them. An insertion is the other word's deletion and a smaller letter the other word's replacement, so
   each pair is generated once.
3. Only positives, (hash of the word, hash of the edit), shuffle to joins with the vocabulary by hash. Both words are then compared
   themselves, so neither false positives of the filters nor equal hashes of different words give a pair, and no pair is lost.

A word's form is its near word of largest count (ties: first in code-point order) where that count is at least ``ratio`` times its own;
``root`` follows forms, whose counts grow by ``ratio`` a step, to the last, with pointers that double each round.

Defined results: a null text has no words; a null doc_id reads as an empty string where a run is spoilt; repeated rows
count again; a word of any length is one word (edits of long words are probed in pieces of ``PIECE``); a table without words gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import forget, written
from foliospark.llm.suffix_dedup import mixed

ALPHABET = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS, BLOCK_BITS, PROBES = 16, 512, 6
FILTER_BYTES = 1 << 25
#: Bytes of one part of a filter: a part is built by one task.
PART_BYTES = 1 << 19
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C55)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def spoilt(run: Column, doc_id: Column, every: int = 31) -> Column:
    """The lower-case run, without one of its code points where ``every`` divides crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word and n of the words of whole texts. Shorter runs can't give such words, so the pattern leaves them out."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run")).select(spoilt(F.col("run"), F.col("doc_id")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and the lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), lengths


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)]) for b in (BASE, INVERSE))


def prefix_sums(codes: np.ndarray, lengths: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place within its word, sum before it, sum of the whole word) of every code point: a word's hash is the sum of mixed code times base ** place."""
    opens = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(opens, lengths)
    total = np.r_[np.uint64(0), np.cumsum(mixed(codes) * power[place])]
    start = total[np.repeat(opens, lengths)]
    return place, total[:-1] - start, np.repeat(total[opens + lengths] - total[opens], lengths)


def word_hashes(words: list[str]) -> np.ndarray:
    codes, lengths = code_points(words)
    power, _ = powers(int(lengths.max(initial=0)))
    opens = np.cumsum(lengths) - lengths
    total = np.r_[np.uint64(0), np.cumsum(mixed(codes) * power[np.arange(len(codes)) - np.repeat(opens, lengths)])]
    return total[opens + lengths] - total[opens]


def _blocks(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and 54 bits that name six places in it."""
    x = mixed(hashes ^ np.uint64(0x5BF0363546290C4F))
    return (x >> np.uint64(32)).astype(np.int64) % blocks, mixed(x)


class Filter:
    """A blocked Bloom filter: all bits of a hash are in one block of 512."""

    def __init__(self, blocks: int, words: np.ndarray | None = None):
        self.blocks, self.words = blocks, np.zeros(blocks * BLOCK_BITS // 64, dtype=np.uint64) if words is None else words

    def add(self, hashes: np.ndarray) -> None:
        block, bits = _blocks(hashes, self.blocks)
        for _ in range(PROBES):
            bit = (bits & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(self.words, block * 8 + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            bits = bits >> np.uint64(9)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the filter; those that fail a bit aren't looked at again."""
        block, bits = _blocks(hashes, self.blocks)
        left = np.arange(len(hashes))
        for _ in range(PROBES):
            bit = (bits & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
            good = (self.words[block * 8 + (bit >> 6)] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            left, block, bits = left[good], block[good], bits[good] >> np.uint64(9)
        out = np.zeros(len(hashes), dtype=bool)
        out[left] = True
        return out


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(33)).astype(np.int64) % parts


def hashed(vocabulary: DataFrame) -> DataFrame:
    """word, n, length and h (hash) of every word."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["word"].tolist()
            yield batch.assign(length=np.array([len(w) for w in words], dtype=np.int32), h=word_hashes(words).view(np.int64))

    return vocabulary.select("word", "n").mapInPandas(add, "word string, n long, length int, h long")


def shard_plan(sizes: dict[int, int], part_bytes: int, filter_bytes: int) -> list[dict[int, tuple[int, int, int, int]]]:
    """Rounds of filters: length -> (parts in all, blocks of a part, first part, end part) of those a round holds.

    Every part has at most ``part_bytes`` and a round at most ``filter_bytes``.
    """
    rounds: list[dict] = [{}]
    room = filter_bytes
    for length, n in sorted(sizes.items()):
        blocks = max(1, -(-n * BITS // BLOCK_BITS))
        parts = -(-blocks * BLOCK_BITS // (part_bytes * 8))
        blocks = -(-blocks // parts)
        size, first = blocks * BLOCK_BITS // 8, 0
        while first < parts:
            if room < size:
                rounds.append({})
                room = filter_bytes
            end = min(parts, first + room // size)
            rounds[-1][length] = (parts, blocks, first, end)
            room -= (end - first) * size
            first = end
    return rounds


def build_filters(words: DataFrame, plan: dict[int, tuple[int, int, int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """(length, part) -> the bits of a round's filters; each part is built by one task from the hashes that are dealt to it."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, h = batch["length"].to_numpy(), batch["h"].to_numpy(dtype=np.int64).view(np.uint64)
            part = np.full(len(batch), -1, dtype=np.int32)
            for k, (parts, _, first, end) in plan.items():
                mine = length == k
                p = _part(h[mine], parts)
                part[mine] = np.where((p >= first) & (p < end), p, -1)
            yield pd.DataFrame({"length": length, "part": part, "h": h.view(np.int64)})[part >= 0]

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, None
        done = lambda: pd.DataFrame({"length": [now[0]], "part": [now[1]], "bits": [made.words.tobytes()]}).astype({"length": "int32", "part": "int32"})
        for batch in batches:
            for key, rows in batch.groupby(["length", "part"], sort=True):
                if key != now:
                    if made is not None:
                        yield done()
                    now, made = key, Filter(plan[key[0]][1])
                made.add(rows["h"].to_numpy(dtype=np.int64).view(np.uint64))
        if made is not None:
            yield done()

    dealt = words.where(F.col("length").isin(list(plan))).select("length", "h").mapInPandas(keyed, "length int, part int, h long").distinct()
    parts = dealt.repartition("length", "part").sortWithinPartitions("length", "part").mapInPandas(built, "length int, part int, bits binary")
    return {(r["length"], r["part"]): np.frombuffer(r["bits"], dtype=np.uint64) for r in parts.toLocalIterator()}


def edits(words: list[str], alphabet: np.ndarray, deletions: bool, replacements: bool, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word number, hash of an edit, change of length) of all edits, at most some ``most`` at a time.

    Deletion of place i: the sum before it, and the sum after it divided by the base. Replacement: the difference at that place.
    """
    codes, lengths = code_points(words)
    power, inverse = powers(int(lengths.max(initial=0)))
    place, before, whole = prefix_sums(codes, lengths, power)
    who, letters = np.repeat(np.arange(len(words)), lengths), mixed(alphabet.astype(np.uint64))
    if deletions:
        for begin in range(0, len(codes), most):
            at = slice(begin, begin + most)
            own = mixed(codes[at]) * power[place[at]]
            yield who[at], before[at] + (whole[at] - before[at] - own) * inverse[1], -1
    if replacements:
        larger = len(alphabet) - np.searchsorted(alphabet, codes, side="right")
        step = max(1, most // max(1, len(alphabet)))
        for begin in range(0, len(codes), step):
            at = np.arange(begin, min(len(codes), begin + step))
            row = np.repeat(at, larger[at])
            letter = len(alphabet) - larger[row] + np.arange(len(row)) - np.repeat(np.cumsum(larger[at]) - larger[at], larger[at])
            yield who[row], whole[row] + (letters[letter] - mixed(codes[row])) * power[place[row]], 0


def positives(words: DataFrame, plan: dict, filters, alphabet: np.ndarray) -> DataFrame:
    """Distinct (a, b): hash of a word and hash of an edit that a filter of this round may hold."""

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = filters.value
        for batch in batches:
            for length, rows in batch.groupby("length"):
                names, own = rows["word"].tolist(), rows["h"].to_numpy(dtype=np.int64)
                step = max(1, PIECE // (8 * max(1, length) * 16))
                for k in range(0, len(names), step):
                    found = [np.zeros((2, 0), dtype=np.int64)]
                    for who, h, change in edits(names[k : k + step], alphabet, length - 1 in plan, length in plan):
                        parts, blocks, first, end = plan[length + change]
                        part = _part(h, parts) if parts > 1 else np.zeros(len(h), dtype=np.int64)
                        for p in range(first, end):
                            if (length + change, p) not in known:
                                continue
                            mine = np.flatnonzero(part == p) if parts > 1 else slice(None)
                            x, y = who[mine], h[mine]
                            good = Filter(blocks, known[length + change, p]).holds(y)
                            found.append(np.stack([own[k + x[good]], y[good].view(np.int64)]))
                    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                    yield pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    lengths = sorted({k for k in plan} | {k + 1 for k in plan})
    return words.where(F.col("length").isin(lengths)).select("word", "length", "h").mapInPandas(probed, "a long, b long")


def near_pairs(words: DataFrame, alphabet: list[int] = ALPHABET, part_bytes: int = PART_BYTES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, near, near_n of all ordered pairs of words that differ by one code point. ``words``: a written table of ``hashed``."""
    spark, letters = words.sparkSession, np.array(sorted(alphabet), dtype=np.int64)
    sizes = {r["length"]: r["k"] for r in words.groupBy("length").agg(F.count(F.lit(1)).alias("k")).collect()}
    met: DataFrame | None = None
    for plan in shard_plan(sizes, part_bytes, filter_bytes):
        if not plan:
            continue
        filters = spark.sparkContext.broadcast(build_filters(words, plan))
        found = written(positives(words, plan, filters, letters), "positives")
        filters.destroy()
        met = found if met is None else met.unionByName(found)
    side = lambda key, names: words.select(F.col("h").alias(key), F.col("word").alias(names[0]), F.col("n").alias(names[1]))
    if met is None:
        met = spark.createDataFrame([], "a long, b long")
    pairs = met.join(side("b", ("near", "near_n")), "b").join(side("a", ("word", "n")), "a")
    pairs = pairs.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.inline(F.array(F.struct("word", "n", "near", "near_n"), back)))


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """word and root of every word that has a form; ``forms``: word, form (written). Counts grow along forms, so there is no cycle."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        now = moved
        if not now.where("moved").take(1):
            return now.select("word", "root")
    raise RuntimeError(f"forms are not followed to the end after {most_rounds} rounds")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, part_bytes: int = PART_BYTES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    words = written(hashed(word_counts(docs, least_length, least_count)), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    # The same pair twice (two words of one hash) counts once. A word of m code points has at most 180 * m + 90 near words, so dealing by word is even.
    near = near_pairs(words, part_bytes=part_bytes, filter_bytes=filter_bytes).repartition("word").groupBy("word", "n", "near", "near_n").agg(F.lit(1).alias("once"))
    near = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    close = -F.col("best.less") >= ratio * F.col("n")
    near = written(near.select("word", "n_near", F.when(close, F.col("best.near")).alias("form"), F.when(close, -F.col("best.less")).alias("form_n")), "near")
    tops = roots(near.where("form is not null"))
    out = words.select("word", "n").join(near, "word", "left").join(tops, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
