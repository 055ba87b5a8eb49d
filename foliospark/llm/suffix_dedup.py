"""Removal of long repeated passages by a hash-compared suffix sort.

Every byte covered by a ``length``-byte string that starts anywhere else too is removed. All strings of a text
are looked at, in these steps:

1. Anchors. The k-gram of smallest hash in a window of ``length`` bytes is its anchor; equal windows have equal
   anchors at the same place. Neighbouring windows of one anchor form a run. A run is reduced to the anchor's
   hash and a digest of its bytes: some two rows for each 300 bytes of text.
2. Runs of equal digests (128 bits of BLAKE2b over all bytes) are one class, counted with partial sums (a hot group of copies stays one row for each
   task). All windows of a class of several runs repeat.
3. Only anchors with several classes need more. One run of each such class is fetched and the suffixes that start at its
   windows are sorted, within anchor and distance to the anchor: a mergesort whose comparisons find the common
   extension of two suffixes by binary search over prefix polynomial hashes. Neighbours that share ``length`` bytes repeat.
   As all windows of a run hold its anchor, the first and last that repeat bound what is removed; these two are
   verified byte by byte. Anchors with more than ``largest_group`` classes aren't sorted in one task: there windows are counted by
   such 128-bit digests in a shuffle, which spreads any group.
4. The removed ranges of a document come together and are cut out of its text.

Defined results: a null text is empty; a text shorter than ``length`` keeps all bytes; repeated rows count as occurrences of their
strings and each gets its result; documents of equal doc_id are told apart by their text; an empty table gives an
empty table; other columns are not read. Very long texts are hashed in pieces of ``PIECE`` windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import written

BASES = (np.uint64(0x9E3779B97F4A7C55), np.uint64(0xC2B2AE3D27D4EB4F))
PIECE = 1 << 19
KEPT_POWERS = PIECE + 1024
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse modulo 2**64. Those that a piece needs are kept for the life of a worker, more aren't."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        size = 1 << int(n).bit_length() if n <= KEPT_POWERS else n
        base = BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        have = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b, dtype=np.uint64)]) for b in (base, inverse))
        if n <= KEPT_POWERS:
            _POWERS[which] = have
    return have


def prefix_hashes(data: np.ndarray, which: int = 0) -> np.ndarray:
    """P[i]: the polynomial of the first i bytes, so (P[j] - P[i]) / base**i is that of bytes i to j."""
    power, _ = powers(which, len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    _, inverse = powers(which, len(prefix))
    return mixed((prefix[end] - prefix[begin]) * inverse[begin])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every i, by running minima within blocks from both sides."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, owner_end: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, anchor hash) of the runs in joined texts.

    owner_end[i] is the end of the text that byte i belongs to; windows that cross it don't count.
    """
    n_windows = len(data) - length + 1
    none = np.zeros(0, dtype=np.int64)
    if n_windows <= 0:
        return none, none, none, none.astype(np.uint64)
    prefix = prefix_hashes(data)
    start = np.arange(len(data) - k + 1)
    grams = range_hash(prefix, start, start + k)
    bits = np.uint64(len(data).bit_length())
    ranked = (grams >> bits << bits) | start.astype(np.uint64)
    anchor = (sliding_least(ranked, length - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    window = np.flatnonzero(np.arange(n_windows) + length <= owner_end[:n_windows])
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    at = anchor[window]
    opens = np.r_[True, (np.diff(at) != 0) | (np.diff(window) != 1)]
    first, last, at = window[opens], window[np.r_[opens[1:], True]], at[opens]
    return first, last, at, grams[at]


def digests_of(raw: bytes, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Collision-resistant digests of byte ranges; they stand for the bytes wherever equality alone is asked."""
    return [hashlib.blake2b(raw[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), end.tolist(), strict=True)]


class SuffixSort:
    """Sorts suffixes of a buffer, cut at ``length`` bytes, within groups."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = prefix_hashes(data)
        self.power, _ = powers(0, len(data))

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes from a and from b have equal hashes."""
        return (self.prefix[a + n] - self.prefix[a]) * self.power[b] == (self.prefix[b + n] - self.prefix[b]) * self.power[a]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common extension, by binary search over the hashes."""
        out = np.full(len(a), self.length, dtype=np.int64)
        open_ = np.flatnonzero(~self.same(a, b, np.full(len(a), self.length)))
        a, b = a[open_], b[open_]
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.length - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.same(a, b, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        out[open_] = low
        return out

    def below(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; equal ones as ``or_equal`` says."""
        n = self.extension(a, b)
        differ = n < self.length
        at = np.minimum(n, self.length - 1)
        return np.where(differ, self.data[a + at] < self.data[b + at], or_equal)

    def sort(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order that sorts ``suffix`` within ``group`` (ordered): mergesort, all merges of a level at once."""
        order = np.arange(len(suffix))
        opens = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[opens, len(group)])
        begin, size = np.repeat(opens, sizes), np.repeat(sizes, sizes)
        place = np.arange(len(suffix)) - begin
        width = 1
        while width < sizes.max(initial=0):
            run = place // width
            left = run % 2 == 0
            other = begin + (run + np.where(left, 1, -1)) * width
            other_end = np.minimum(other + width, begin + size)
            moves = np.flatnonzero((other < begin + size) & (size > width))
            low, high = other[moves].copy(), np.maximum(other_end[moves], other[moves])
            mine, from_left = suffix[order[moves]], left[moves]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                # Before an element of a left run stand the smaller ones of the right run; of a right run, also the equal ones.
                before = self.below(suffix[order[middle]], mine[open_], ~from_left[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = np.arange(len(suffix))
            run_start = begin[moves] + np.minimum(run[moves], run[moves] + np.where(from_left, 1, -1)) * width
            own_start = begin[moves] + run[moves] * width
            target[moves] = run_start + (moves - own_start) + (low - other[moves])
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order


def repeated_bounds(contents: list[bytes], leads: np.ndarray, groups: np.ndarray, length: int, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """First and last window that repeats among the runs of the same group, -1 where none does.

    contents: bytes of the runs, whose anchors stand at ``leads``. Suffixes are sorted some ``most`` at a time, in
    whole (group, distance to the anchor) buckets.
    """
    sizes = np.array([len(c) for c in contents])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    sorter = SuffixSort(data, length)
    n_windows = sizes - length + 1
    first, last = np.full(len(contents), -1), np.full(len(contents), -1)
    # Windows by distance to the anchor: lead down to lead - n_windows + 1.
    furthest = leads.max(initial=0)
    step = max(1, most // max(1, len(contents)))
    for at in range(int((leads - n_windows + 1).min(initial=0)), int(furthest) + 1, step):
        low = np.maximum(at, leads - n_windows + 1)
        count = np.maximum(0, np.minimum(at + step - 1, leads) - low + 1)
        owner = np.repeat(np.arange(len(contents)), count)
        distance = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]
        bucket = groups[owner] * (int(furthest) + 1) + distance
        by_bucket = np.argsort(bucket, kind="stable")
        owner, distance, bucket = owner[by_bucket], distance[by_bucket], bucket[by_bucket]
        shared = np.zeros(len(bucket), dtype=bool)
        equal = bucket[1:] == bucket[:-1]
        shared[1:] |= equal
        shared[:-1] |= equal
        owner, distance, bucket = owner[shared], distance[shared], bucket[shared]
        if not len(owner):
            continue
        suffix = base[owner] + leads[owner] - distance
        order = sorter.sort(suffix, bucket)
        suffix, owner, bucket = suffix[order], owner[order], bucket[order]
        pair = np.flatnonzero(bucket[1:] == bucket[:-1])
        pair = pair[sorter.extension(suffix[pair], suffix[pair + 1]) >= length]
        twin = np.full(len(suffix), -1)
        twin[pair + 1] = suffix[pair]
        twin[pair] = suffix[pair + 1]
        hit = np.flatnonzero(twin >= 0)
        window = suffix - base[owner]
        while len(hit):  # bounds that verification refutes are dropped and looked for again
            order = hit[np.lexsort((window[hit], owner[hit]))]
            opens = np.r_[True, np.diff(owner[order]) != 0]
            ends = order[opens], order[np.r_[opens[1:], True]]
            both = np.unique(np.r_[ends])
            wrong = [i for i in both.tolist() if data[suffix[i] : suffix[i] + length].tobytes() != data[twin[i] : twin[i] + length].tobytes()]
            if wrong:
                hit = np.setdiff1d(hit, wrong)
                continue
            who = owner[ends[0]]
            first[who] = np.where(first[who] < 0, window[ends[0]], np.minimum(first[who], window[ends[0]]))
            last[who] = np.maximum(last[who], window[ends[1]])
            break
    return first, last


RUN = "doc_id long, th long, h long, c binary, first long, lead int, span int"


def _pieces(rows: Iterator[tuple], length: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, th, offset, bytes) of some PIECE bytes together; long texts in overlapping pieces."""
    held, size = [], 0
    for doc_id, th, raw in rows:
        for at in range(0, max(1, len(raw) - length + 1), PIECE):
            piece = raw[at : at + PIECE + length - 1]
            if held and size + len(piece) > PIECE:
                yield held
                held, size = [], 0
            held.append((doc_id, th, at, piece))
            size += len(piece)
    if held:
        yield held


def text_runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """One row for each run of windows of one anchor."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((d, h, t.encode("utf-8", "surrogatepass")) for d, h, t in zip(batch["doc_id"], batch["th"], batch["text"], strict=True))
            for pieces in _pieces(rows, length):
                sizes = np.array([len(p[3]) for p in pieces])
                ends = np.cumsum(sizes)
                owner = np.repeat(np.arange(len(pieces)), sizes)
                raw = b"".join(p[3] for p in pieces)
                first, last, anchor, h = runs_of(np.frombuffer(raw, dtype=np.uint8), ends[owner], length, k)
                who = owner[first]
                shift = np.array([p[2] for p in pieces], dtype=np.int64) - (ends - sizes)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([pieces[i][0] for i in who.tolist()], dtype="Int64"),
                        "th": np.array([p[1] for p in pieces], dtype=np.int64)[who],
                        "h": h.view(np.int64),
                        "c": digests_of(raw, first, last + length),
                        "first": first + shift[who],
                        "lead": (anchor - first).astype(np.int32),
                        "span": (last - first).astype(np.int32),
                    }
                )

    return docs.mapInPandas(runs, RUN)


def _packed(docs: DataFrame) -> DataFrame:
    """The texts compressed, for a shuffle."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield batch.assign(text=[packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]).rename(columns={"text": "packed"})

    return docs.mapInPandas(pack, "doc_id long, th long, packed binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def _contents(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """h, c, lead, n, k and the bytes of one run of each contested class."""
    wanted = reps.groupBy(F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t")).agg(F.collect_list(F.struct("h", "c", "lead", "n", "k", F.col("rep.first").alias("first"), "span")).alias("runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, runs in zip(batch["packed"], batch["runs"], strict=True):
                raw = unpack(packed)
                rows += [(r["h"], r["c"], r["lead"], r["n"], r["k"], raw[r["first"] : r["first"] + r["span"] + length]) for r in runs]
            yield pd.DataFrame(rows, columns=["h", "c", "lead", "n", "k", "raw"])

    # Rows of equal doc_id and text would give the same runs again; one of them is enough.
    joined = _packed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    return joined.select("packed", "runs").mapInPandas(cut, "h long, c binary, lead int, n long, k long, raw binary").dropDuplicates(["h", "c", "lead"])


def _sorted_bounds(contents: DataFrame, length: int) -> DataFrame:
    """h, c, lead, lo and hi: the first and last window of each class that repeats within its anchor's group."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["h", "c", "lead", "raw"])
        groups = np.unique(frame["h"].to_numpy(), return_inverse=True)[1]
        lo, hi = repeated_bounds(frame["raw"].tolist(), frame["lead"].to_numpy().astype(np.int64), groups, length)
        return frame[["h", "c", "lead"]].assign(lo=lo.astype(np.int64), hi=hi.astype(np.int64))[lo >= 0]

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, group = [], 0, None
        for batch in batches:
            for h, c, lead, raw in zip(batch["h"], batch["c"], batch["lead"], batch["raw"], strict=True):
                if h != group and size > 500_000:
                    yield solve(held)
                    held, size = [], 0
                group = h
                held.append((h, c, lead, raw))
                size += len(raw)
        if held:
            yield solve(held)

    ordered = contents.select("h", "c", "lead", "raw").repartition("h").sortWithinPartitions("h")
    return ordered.mapInPandas(bounds, "h long, c binary, lead int, lo long, hi long")


def _counted_bounds(contents: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many classes: windows counted by 128-bit digests in a shuffle."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, c, lead, raw in zip(batch["h"], batch["c"], batch["lead"], batch["raw"], strict=True):
                start = np.arange(len(raw) - length + 1)
                yield pd.DataFrame({"h": h, "c": [c] * len(start), "lead": lead, "at": start, "w": digests_of(raw, start, start + length)})

    windows = written(contents.select("h", "c", "lead", "raw").mapInPandas(digests, "h long, c binary, lead int, at long, w binary"), "windows")
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
    return windows.join(twice, "w", "left_semi").groupBy("h", "c", "lead").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))


def repeated_ranges(docs: DataFrame, length: int = 400, k: int = 100, largest_group: int = 1 << 16) -> DataFrame:
    """doc_id, th (hash of the text) and ranges (begin, end) of all repeated bytes, for keyed documents that have some."""
    runs = written(text_runs(docs, length, k), "runs")
    rep = F.min(F.struct("doc_id", "th", "first")).alias("rep")
    classes = written(runs.groupBy("h", "c", "lead", "span").agg(F.count(F.lit(1)).alias("n"), rep), "run-classes")
    contested = written(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "contested")
    fetched = written(_contents(docs, classes.join(contested, "h"), length), "run-texts")
    found = _sorted_bounds(fetched.where(F.col("k") <= largest_group), length)
    if fetched.where(F.col("k") > largest_group).take(1):
        found = found.unionByName(_counted_bounds(fetched.where(F.col("k") > largest_group), length))
    whole = classes.where("n > 1").select("h", "c", "lead", F.lit(0).cast("long").alias("lo"), F.col("span").cast("long").alias("hi"))
    alone = fetched.where("n = 1").select("h", "c", "lead")
    outcome = written(whole.unionByName(found.join(alone, ["h", "c", "lead"], "left_semi")), "outcomes")
    hit = runs.join(outcome, ["h", "c", "lead"])
    ranges = hit.select("doc_id", "th", F.struct((F.col("first") + F.col("lo")).alias("begin"), (F.col("first") + F.col("hi") + length).alias("end")).alias("range"))
    return ranges.groupBy("doc_id", "th").agg(F.collect_set("range").alias("ranges"))


def merged(ranges: list) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 100, largest_group: int = 1 << 16, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; ``with_text``: also ranges and the bytes that are kept."""
    keyed = _keyed(docs)
    ranges = written(repeated_ranges(keyed, length, k, largest_group), "ranges").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "ranges")
    joined = _packed(keyed).join(ranges, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, packed, found in zip(batch["doc_id"], batch["packed"], batch["ranges"], strict=True):
                raw = unpack(packed)
                spans = [] if found is None else merged(list(found))
                kept = [raw[b:e] for b, e in zip([0, *(e for _, e in spans)], [*(b for b, _ in spans), len(raw)], strict=True)]
                whole = b"".join(kept)
                row = (None if pd.isna(doc_id) else int(doc_id), len(raw), len(raw) - len(whole), len(spans), hashlib.sha256(whole).hexdigest())
                rows.append((*row, [{"begin": b, "end": e} for b, e in spans], whole) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["ranges", "kept"] if with_text else [])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    more = ", ranges array<struct<begin:long,end:long>>, kept binary" if with_text else ""
    return joined.select("doc_id", "packed", "ranges").mapInPandas(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
