"""N-gram Jaccard join: components of documents whose shingle sets are similar.

Exact for the threshold: two documents link when 100 * |intersection| >= percent * |union|. Set relations are used to
skip work, among lists and among answers:

1. Equal sets are one class; only its document of smallest id, the representative, goes on.
2. Band keys (minima of the shingle hashes under 16 permutations, two to a band) give each representative a few highly similar
   sets, the pivots of its keys. These pairs are verified and make first components: what is known of a set
   now serves the sets like it.
3. Each representative enters its prefix (the shingles that come first in one order for all sets, as many as a set
   of such similarity must share one of) into index lists, with its size and position. Shingles that many prefixes hold
   come last in the order. A list whose sets are all in one component is skipped whole. In the others, entries are ordered
   by size, so the blocks of sets too small or too large are skipped by a binary search, and only entries outside the list's largest component
   look for partners; pairs of one component, pairs whose
   positions leave too few shingles, and in lists of frequent shingles pairs with too many different parity bits are skipped. What
   is left is held against sketches (a parity bit for each shingle), which tell most pairs without a link by a small part of the bytes, and
   then verified by intersecting whole sets.
4. Verified links join the components. The first pass over the lists names for each entry only its nearest set of another component, by
   these bounds; most links are found so, and the second pass, which names all that is left, finds most lists to be of one component.

A link inside a component is never needed to find components, so none is lost that matters: ``component_id`` is
that of all links.

Words are what stands between ASCII white space, A-Z in lower case. Sets hold 64-bit hashes of shingles.

Defined results: null, empty or blank text has an empty set, is linked with nothing and is its own component; a text of fewer
than ``width`` words has one shingle; rows of one doc_id count as one document (its rows share a component); a null
doc_id is left alone with a null component; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import forget, slices, small_side, written
from foliospark.llm.components import components
from foliospark.llm.suffix_dedup import BASES, PIECE, mixed, prefix_hashes, range_hash

BANDS, ROWS = 8, 2
#: Shingles that this many sets hold count as frequent. Tasks are told those of largest count one by one, at most so many (2 MB),
#: and the others by a filter of so many bits (8 MB) that holds as many as it can at eight bits each, those of larger counts first.
FREQUENT, MOST_FREQUENT, FILTER_BITS = 2, 1 << 18, 1 << 26
#: Rounds of first comparisons; bands in which a set must have the same pivot.
STAR_ROUNDS, SHARED = 1, 3
#: Passes over the index lists in which each entry names its nearest one only, before that in which all are named.
NEAREST_ROUNDS = 1
_MULTIPLIERS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _plain_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of lower-case bytes that end in a blank, and where each begins."""
    blank = _blank(data)
    begin, end = np.flatnonzero(~blank & np.r_[True, blank[:-1]]), np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    return range_hash(prefix_hashes(data), begin, end), begin


def _long_hash(word: np.ndarray) -> np.ndarray:
    """The same hash of one word that is longer than a piece: sums of its blocks, each times the power its place asks for."""
    total, base = 0, int(BASES[0])
    for at in range(0, len(word), PIECE):
        total += int(prefix_hashes(word[at : at + PIECE])[-1]) * pow(base, at, 1 << 64)
    return mixed(np.array([total % (1 << 64)], dtype=np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of UTF-8 bytes that end in a blank, A-Z lower-case, and where each begins.

    Long bytes are hashed in pieces of some ``PIECE`` that end at blanks, so no more than a piece is held in wider numbers.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    lower = lambda x: np.where((x >= 65) & (x <= 90), x + np.uint8(32), x)
    if len(data) <= PIECE:
        return _plain_hashes(lower(data))
    hashes, begins, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        ends = np.flatnonzero(_blank(data[at:stop]))
        if len(ends):
            stop = at + int(ends[-1]) + 1
            h, b = _plain_hashes(lower(data[at:stop]))
        else:  # one word goes on beyond the piece
            while not _blank(data[stop - 1 : stop]).any():
                more = np.flatnonzero(_blank(data[stop : stop + PIECE]))
                stop = stop + int(more[0]) + 1 if len(more) else min(len(data), stop + PIECE)
            h, b = _long_hash(lower(data[at : stop - 1])), np.zeros(1, dtype=np.int64)
        hashes.append(h)
        begins.append(b + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(begins)


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The ordered distinct shingle hashes of each text."""
    parts = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    hashes, word = word_hashes(b"".join(parts))
    owner = np.searchsorted(np.cumsum([len(p) for p in parts]), word, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    rolled = np.zeros(max(0, len(word) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C55) + hashes[k : k + len(rolled)])
    out = []
    for n, f in zip(n_words.tolist(), first.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[f : f + n - width + 1]))
        elif n:
            x = np.full(1, n, dtype=np.uint64)
            for k in range(n):
                x = mixed(x * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[f + k])
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_size(n: np.ndarray | int, percent: int):
    """How many first shingles of a set of n a similar set must share one of."""
    return n - -(-n * percent // 100) + 1


def _sets(batch: pd.DataFrame, width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc_ids, sets) of a batch, some at a time."""
    ids, texts = batch["doc_id"].tolist(), ["" if t is None else t for t in batch["text"].tolist()]
    for begin, end in slices(texts):
        yield ids[begin:end], shingle_sets(texts[begin:end], width)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), s0 and s1 (digest of the set) and the band keys of every row."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, sets in _sets(batch, width):
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                s0, s1 = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
                keys: list[list[int]] = [[] for _ in sets]
                if len(full):
                    flat = np.concatenate(sets)
                    opens = (np.cumsum(sizes) - sizes)[full]
                    s0[full] = np.add.reduceat(mixed(flat), opens)
                    s1[full] = np.bitwise_xor.reduceat(mixed(flat + np.uint64(0x9E3779B97F4A7C55)), opens)
                    least = [np.minimum.reduceat(mixed(flat * m), opens) for m in _MULTIPLIERS]
                    bands = [mixed(least[b * ROWS] + mixed(least[b * ROWS + 1]) * np.uint64(3) + np.uint64(b)) for b in range(BANDS)]
                    for k, row in zip(full.tolist(), np.stack(bands, axis=1).view(np.int64).tolist(), strict=True):
                        keys[k] = row
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"), "n": sizes, "s0": s0.view(np.int64), "s1": s1.view(np.int64), "bands": keys})

    return docs.mapInPandas(signed, "doc_id long, n long, s0 long, s1 long, bands array<long>")


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits, by which shingles are counted; shingles that share them count together, which only touches the order."""
    return hashes >> np.uint64(32)


class Frequent:
    """What tasks know of frequent shingles: the most frequent ones, rarest first, and a filter for the others.

    The filter has a slice for each bucket of hashes, so every counting task makes its slices alone.
    """

    def __init__(self, most: np.ndarray, buckets: int, slices: dict[int, bytes]):
        self.most, self.buckets, self.size = most, buckets, slice_bits(buckets)
        self.bits = np.zeros(buckets * self.size // 8, dtype=np.uint8)
        for bucket, raw in slices.items():
            self.bits[bucket * self.size // 8 : (bucket + 1) * self.size // 8] = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        hashes = short(hashes)
        base = (hashes % np.uint64(self.buckets)).astype(np.int64) * self.size
        found = np.ones(len(hashes), dtype=bool)
        for place in _places(hashes, self.size):
            at = base + place
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def slice_bits(buckets: int) -> int:
    return FILTER_BITS // buckets // 8 * 8


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Three bits of a slice for each hash."""
    a, b = mixed(hashes), mixed(hashes ^ np.uint64(0x5BF0363546290C4F)) | np.uint64(1)
    for k in range(3):
        yield ((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64)


def frequent_shingles(docs: DataFrame, width: int, buckets: int) -> Frequent:
    """Counts the shingles of all sets and tells which are frequent.

    Hashes travel as packed arrays; a task counts those of its buckets and makes filter slices for several least counts, of which the
    lowest that fits is taken. What reaches the driver has a fixed bound. Which shingles are told decides the order, not the result.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, sets in _sets(batch, width):
                flat = short(np.concatenate([*sets, np.zeros(0, np.uint64)])).astype(np.uint32)
                yield _split(flat % np.uint32(buckets), {"hashes": flat})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = slice_bits(buckets)
        for bucket, parts in _by_bucket(batches, {"hashes": np.uint32}):
            value, count = np.unique(parts["hashes"], return_counts=True)
            value = value.astype(np.uint64)
            rows = []
            for level in range(1, 40):
                mine = value[count >= FREQUENT**level]
                if not len(mine):
                    break
                bits = np.zeros(size, dtype=np.uint8)
                for place in _places(mine, size):
                    bits[place] = 1
                rows.append((None, len(mine), level, bucket, zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)))
            yield pd.DataFrame(rows, columns=["hash", "n", "level", "bucket", "bits"]).astype({"hash": "Int64", "level": "Int32", "bucket": "Int32"})
            many = count >= 2 * FREQUENT
            yield pd.DataFrame({"hash": value[many].view(np.int64), "n": count[many].astype(np.int64), "level": None, "bucket": None, "bits": None}).astype({"level": "Int32", "bucket": "Int32"})

    dealt = docs.mapInPandas(packed, "bucket int, hashes binary").repartition("bucket").sortWithinPartitions("bucket")
    made = dealt.mapInPandas(counted, "hash long, n long, level int, bucket int, bits binary")
    found = written(made, "frequent")
    sizes = {r["level"]: r["n"] for r in found.where("level is not null").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    level = min((k for k, n in sizes.items() if n <= FILTER_BITS // 8), default=None)
    slices_ = {} if level is None else {r["bucket"]: bytes(r["bits"]) for r in found.where(F.col("level") == level).select("bucket", "bits").toLocalIterator()}
    of_count = found.where("level is null").groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(MOST_FREQUENT)
    least, room = 1 << 62, MOST_FREQUENT
    for r in of_count.toLocalIterator():
        room -= r["k"]
        if room < 0:
            break
        least = r["n"]
    rows = found.where((F.col("n") >= least) & F.col("level").isNull()).select("hash", "n").toArrow().to_pandas()
    return Frequent(rows.sort_values(["n", "hash"])["hash"].to_numpy(dtype=np.int64).view(np.uint64), buckets, slices_)


def _split(bucket: np.ndarray, columns: dict[str, np.ndarray], steps: str = "") -> pd.DataFrame:
    """One row for each bucket, with that bucket's entries of every column as bytes; of column ``steps`` the differences, which compress."""
    order = np.argsort(bucket, kind="stable")
    value, opens = np.unique(bucket[order], return_index=True)
    ends = np.r_[opens[1:], len(order)]
    out = {"bucket": value.astype(np.int32)}
    for name, x in columns.items():
        x = x[order]
        if name == steps:
            x = np.diff(x, prepend=0)
            x[opens] = columns[name][order][opens]
        out[name] = [x[b:e].tobytes() for b, e in zip(opens.tolist(), ends.tolist(), strict=True)]
    return pd.DataFrame(out)


def _by_bucket(batches: Iterator[pd.DataFrame], kinds: dict[str, type], steps: str = "") -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """What ``_split`` made, bucket by bucket, from rows ordered by bucket: a task holds one bucket at a time."""
    parts: dict[str, list] = {name: [] for name in kinds}
    now = None
    joined = lambda: {name: np.concatenate(x) for name, x in parts.items()}
    for batch in batches:
        for k, bucket in enumerate(batch["bucket"].tolist()):
            if bucket != now and now is not None:
                yield now, joined()
                parts = {name: [] for name in kinds}
            now = bucket
            for name, kind in kinds.items():
                x = np.frombuffer(batch[name].iat[k], dtype=kind)
                parts[name].append(np.cumsum(x) if name == steps else x)
    if now is not None:
        yield now, joined()


class Order:
    """The one order of shingles: by hash, then those the filter holds, by hash, then the most frequent ones, rarest first."""

    def __init__(self, frequent: Frequent):
        self.frequent = frequent
        self.by_hash = np.argsort(frequent.most)
        self.sorted = frequent.most[self.by_hash]

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The place among the most frequent ones, -1 for others."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        hashes = short(hashes)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.by_hash[at], -1)

    def prefix(self, hashes: np.ndarray, size: int) -> np.ndarray:
        place, held = self.place(hashes), self.frequent.holds(hashes)
        out = hashes[(place < 0) & ~held][:size]
        if len(out) < size:
            out = np.r_[out, hashes[(place < 0) & held][: size - len(out)]]
        if len(out) < size:
            most = place >= 0
            out = np.r_[out, hashes[most][np.argsort(place[most])][: size - len(out)]]
        return out


def parities(hashes: np.ndarray, size: int = 256) -> bytes:
    """``size`` bits, a power of two: whether an odd number of hashes falls on each. Two sets differ in at least as many elements as bits."""
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """As many parity bits as the set has elements, or more, up to twice as many: a 64th or a 32nd of its bytes."""
    return parities(hashes, max(256, 1 << (len(hashes) - 1).bit_length()))


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many parity bits two sets differ; the longer sketch is folded to the size of the shorter one."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def prefixes(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """doc_id, n, the prefix (packed hashes, in order), the parity bits and the sketch of every row with a set."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = Order(frequent.value)
        for batch in batches:
            for ids, sets in _sets(batch, width):
                rows = [(int(i), len(s), order.prefix(s, prefix_size(len(s), percent)).tobytes(), parities(s), sketch(s)) for i, s in zip(ids, sets, strict=True) if len(s) and not pd.isna(i)]
                yield pd.DataFrame(rows, columns=["doc_id", "n", "prefix", "bits", "sketch"])

    return docs.mapInPandas(cut, "doc_id long, n long, prefix binary, bits binary, sketch binary")


def list_pairs(token: np.ndarray, doc: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, bits: np.ndarray, percent: int, nearest: bool = False, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs from index lists, by the skips that the module names. bits: [entries, 4], zeros where an entry has none.

    ``nearest``: for each entry of a list only the pair that is furthest below its bound.
    """
    order = np.lexsort((n, token))
    token, doc, n, at, comp, bits = token[order], doc[order], n[order], at[order], comp[order], bits[order]
    opens = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    mixed_list = np.minimum.reduceat(comp, opens) != np.maximum.reduceat(comp, opens)
    sizes = np.diff(np.r_[opens, len(token)])
    live = np.repeat(mixed_list, sizes)
    token, doc, n, at, comp, bits = token[live], doc[live], n[live], at[live], comp[live], bits[live]
    if not len(token):
        return
    number = np.cumsum(np.r_[False, token[1:] != token[:-1]]).astype(np.int64)
    # Of the component that most entries of a list are in, none looks for a partner: those of other components find it.
    by_comp = np.lexsort((comp, number))
    runs = np.flatnonzero(np.r_[True, (number[by_comp][1:] != number[by_comp][:-1]) | (comp[by_comp][1:] != comp[by_comp][:-1])])
    held = np.diff(np.r_[runs, len(by_comp)])
    largest = np.lexsort((held, number[by_comp][runs]))
    largest = largest[np.r_[np.diff(number[by_comp][runs][largest]) != 0, True]]
    seeks = comp != comp[by_comp][runs[largest]][number]
    reach = int(n.max()) + 2
    key = number * reach + n
    who = np.flatnonzero(seeks)
    # Sets of less than n * percent / 100 or more than n * 100 / percent shingles can't link with one of n: those entries are skipped.
    start = np.searchsorted(key, (number * reach)[who] + -(-n[who] * percent // 100), side="left")
    count = np.searchsorted(key, (number * reach)[who] + np.minimum(n[who] * 100 // percent, reach - 1), side="right") - start
    total = np.cumsum(count)
    begin = 0
    while begin < len(who):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")))
        c = count[begin:stop]
        x = np.repeat(who[begin:stop], c)
        y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c - start[begin:stop], c)
        once = ~seeks[y] | (x < y)
        x, y = x[once], y[once]
        need = -(-(n[x] + n[y]) * percent // (100 + percent))
        # Such sets share one of the first n - need + 1 of both, so other common places needn't name the pair again.
        good = (comp[x] != comp[y]) & (at[x] <= n[x] - need) & (at[y] <= n[y] - need) & (1 + np.minimum(n[x] - at[x] - 1, n[y] - at[y] - 1) + np.minimum(at[x], at[y]) >= need)
        x, y, need = x[good], y[good], need[good]
        # Sets that link differ in at most so many elements; parity bits that differ are no more than these.
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1)
        room = n[x] + n[y] - 2 * need - apart
        close = room >= 0
        x, y, room = x[close], y[close], room[close]
        if nearest and len(x):
            first = np.lexsort((-room, x))
            first = first[np.r_[True, np.diff(x[first]) != 0]]
            x, y = x[first], y[first]
        yield np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])
        begin = stop


def candidates(entries: DataFrame, filter_, percent: int, buckets: int, nearest: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of representatives in different components that the index lists leave; ``nearest``: one an entry at most.

    entries: doc_id, n, prefix, bits, comp. filter_: the broadcast of what is known of frequent shingles. Frequent shingles of which all entries are in one component are left out before the
    lists are made, by a small count of their own, so large groups of similar sets make no long lists.
    """
    spark, frequent = entries.sparkSession, filter_.value.most
    dead = np.zeros(0, dtype=np.uint64)
    told = spark.sparkContext.broadcast(np.sort(frequent))
    if len(frequent):

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                token = np.frombuffer(b"".join(batch["prefix"]), dtype=np.uint64)
                comp = np.repeat(batch["comp"].to_numpy(dtype=np.int64), [len(p) // 8 for p in batch["prefix"]])
                at = np.minimum(np.searchsorted(told.value, short(token)), len(told.value) - 1)
                known = told.value[at] == short(token)
                frame = pd.DataFrame({"hash": token[known].view(np.int64), "comp": comp[known]})
                yield frame.groupby("hash")["comp"].agg(low="min", high="max").reset_index()

        alone = entries.select("prefix", "comp").mapInPandas(spread, "hash long, low long, high long").groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high")
        dead = np.sort(alone.select("hash").toArrow()["hash"].to_numpy().astype(np.int64).view(np.uint64))
    gone = spark.sparkContext.broadcast(dead)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = Order(filter_.value)
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.iloc[begin : begin + 1000]
                sizes = np.array([len(p) // 8 for p in part["prefix"]])
                token = np.frombuffer(b"".join(part["prefix"]), dtype=np.uint64)
                place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                row = np.repeat(np.arange(len(part)), sizes)
                if len(gone.value):
                    at = np.minimum(np.searchsorted(gone.value, token), len(gone.value) - 1)
                    stay = gone.value[at] != token
                    token, place, row = token[stay], place[stay], row[stay]
                bits = np.frombuffer(b"".join(part["bits"]), dtype=np.uint64).reshape(-1, 4)[row]
                bits[~(filter_.value.holds(token) | (order.place(token) >= 0))] = 0  # lists of rare shingles don't need them
                who = {c: part[c].to_numpy(dtype=np.int64)[row] for c in ("doc_id", "n", "comp")}
                yield _split(token % np.uint64(buckets), {"token": token, "doc": who["doc_id"], "n": who["n"].astype(np.int32), "at": place.astype(np.int32), "comp": who["comp"] ^ who["doc_id"], "bits": bits}, "doc")

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"token": np.uint64, "doc": np.int64, "n": np.int32, "at": np.int32, "comp": np.int64, "bits": np.uint64}
        told = np.zeros((0, 2), np.int64)
        for _, x in _by_bucket(batches, kinds, "doc"):
            for a, b in list_pairs(x["token"], x["doc"], x["n"].astype(np.int64), x["at"].astype(np.int64), x["comp"] ^ x["doc"], x["bits"].reshape(-1, 4), percent, nearest):
                if not len(a):
                    continue
                # What this task has named lately isn't named again; the pairs of all tasks are made distinct below.
                every, first = np.unique(np.concatenate([told, np.stack([a, b], axis=1)]), axis=0, return_index=True)
                fresh = every[first >= len(told)]
                told = every if len(every) <= 200_000 else fresh
                yield pd.DataFrame({"a": fresh[:, 0], "b": fresh[:, 1]})

    lists = entries.mapInPandas(listed, "bucket int, token binary, doc binary, n binary, at binary, comp binary, bits binary").repartition("bucket").sortWithinPartitions("bucket")
    return lists.mapInPandas(paired, "a long, b long").distinct()


def _pair_ids(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-ids")


def plausible(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose sketches leave room for a link, so the whole sets of the others needn't travel.

    Sets that link differ in few elements; parity bits that differ are no more than these, so no link is lost.
    """
    told = _pair_ids(pairs)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, n, m, x, y in zip(*[batch[c] for c in ("a", "b", "n", "m", "x", "y")], strict=True):
                need = -(-(n + m) * percent // (100 + percent))
                if bits_apart(x, y) <= n + m - 2 * need:
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"])

    sketches = cut.select("doc_id", "n", "sketch").join(small_side(told)[0], "doc_id", "left_semi")
    left = sketches.select(F.col("doc_id").alias("a"), "n", F.col("sketch").alias("x"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInPandas(near, "a long, b long").distinct(), "pairs")
    forget(told)
    return out


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents that link, by intersecting their whole sets, as a written table. ``pairs`` is one, too."""
    told = _pair_ids(pairs)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, sets in _sets(batch, width):
                yield pd.DataFrame({"doc_id": ids, "members": [s.tobytes() for s in sets]})

    sets = written(docs.join(small_side(told)[0], "doc_id", "left_semi").mapInPandas(packed, "doc_id long, members binary"), "pair-sets")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"])

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(linked, "a long, b long").distinct(), "links")
    forget(told, sets)
    return out


def first_components(classes: DataFrame, docs: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """node and root of components by verified links among highly similar sets; what is missing is found later, nothing here has to be complete.

    In each round the sets of a band key are compared with its pivot, the set of smallest hash under a new seed, where that is in
    another component. A key of one component is left out, so a group of n similar sets costs n comparisons a round, never n * n.
    """
    bands = classes.select("class_id", "bands")
    known = written(links, "links")
    roots = written(components(known), "roots")
    for r in range(STAR_ROUNDS):
        placed = bands.join(roots, F.col("class_id") == F.col("node"), "left").select("class_id", F.coalesce("root", "class_id").alias("comp"), F.posexplode("bands").alias("band", "key"))
        pivot = F.min_by(F.struct("class_id", "comp"), F.xxhash64(F.lit(r), "class_id")).alias("p")
        pivots = placed.groupBy("band", "key").agg(pivot, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").drop("low", "high")
        near = placed.join(pivots, ["band", "key"]).where("comp <> p.comp")
        # One seed for all bands, so sets that share several keys mostly get one pivot there; partial counts leave one row for each such pair.
        near = near.groupBy(F.least("class_id", "p.class_id").alias("a"), F.greatest("class_id", "p.class_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        near = near.where(F.col("shared") >= SHARED)
        stars = written(near.select("a", "b"), "stars")
        found = verified(stars, docs, width, percent)
        if not found.take(1):
            break
        both = written(known.unionByName(found), "links")
        forget(known, found, stars)
        known = both
        roots = written(components(known), "roots")
    return roots


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id of an equal set) and class_size of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    signed = written(signatures(docs, width), "signatures")
    full = signed.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("s0", "s1").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.first("bands").alias("bands")), "classes")
    # Rows of one doc_id are one document: their classes are linked.
    same_id = full.groupBy("doc_id").agg(F.min_by("s0", "s0").alias("low"), F.max("s0").alias("high")).where("low <> high").select("doc_id")
    repeated = full.join(same_id, "doc_id").join(classes, ["s0", "s1"]).select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))

    roots = first_components(classes, docs, repeated, width, percent)

    frequent = frequent_shingles(docs, width, buckets)
    told = spark.sparkContext.broadcast(frequent)
    comps = classes.join(roots, F.col("class_id") == F.col("node"), "left").select(F.col("class_id").alias("doc_id"), F.coalesce("root", "class_id").alias("comp"))
    comps = written(comps.distinct(), "representatives")  # the sets of rows of one doc_id may have one representative
    cut = written(prefixes(docs, told, width, percent).join(small_side(comps)[0].select("doc_id"), "doc_id"), "prefixes")
    for nearest in [True] * NEAREST_ROUNDS + [False]:
        reps, _ = small_side(comps)
        named = written(candidates(cut.drop("sketch").join(reps, "doc_id"), told, percent, buckets, nearest), "pairs")
        pairs = plausible(named, cut, percent)
        found = verified(pairs, docs, width, percent)
        up = reps.select(F.col("doc_id").alias("node"), "comp")
        between = found.join(up.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(up.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        tops = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        joined = written(comps.join(tops, F.col("comp") == F.col("node"), "left").select("doc_id", F.coalesce("root", "comp").alias("comp")), "representatives")
        forget(named, pairs, found, comps)
        comps = joined
    forget(cut)
    whole = written(
        classes.join(comps.select(F.col("doc_id").alias("class_id"), F.col("comp").alias("component_id")), "class_id").select("s0", "s1", "class_id", "class_size", "component_id"),
        "class-components",
    )
    forget(classes)
    out = signed.select("doc_id", "n", "s0", "s1").join(whole, ["s0", "s1"], "left")
    known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    own = lambda c, other: F.when(known, F.col(c)).otherwise(other).alias(c)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        own("component_id", F.col("doc_id")),
        own("class_id", F.col("doc_id")),
        own("class_size", F.lit(1).cast("long")),
    )


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which none is similar to one of smaller doc_id in its component; rows without shingles stay."""
    found = written(jaccard_components(docs, width, percent).where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.alias("d").join(found.alias("gone"), F.col("d.doc_id") == F.col("gone.doc_id"), "left_anti")
