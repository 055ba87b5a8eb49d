"""Cross-tokenizer alignment: tokens of two tokenizers grouped at the byte offsets where both end a token.

1. Both libraries encode a whole text; each token stands for some bytes, so tokens have byte offsets.
2. Divide and conquer. Of an interval of A's tokens, a bisect in B's offsets tells whether an end near the middle is shared; where not,
   ever wider surroundings of the middle are tried. At the shared end nearest to the middle the interval is cut, and both halves go on;
   an interval without a shared end inside is a leaf: a group. All intervals of a level are worked on together, as arrays.
3. Every A token of a group is linked with every B token of it. Of a document, the distinct linked id pairs and how often each
   occurs are kept, packed; links aren't listed.
4. Pairs are counted over documents: in tasks first, then in a shuffle. The counts of the ``head`` most frequent pairs are broadcast (17 bytes
   each); rarer pairs, none of which is in many documents, join their counts in a shuffle. Both give the sums of a document.

Texts of over ``LONG`` characters are encoded in chunks, cut only at a single space between two ASCII letters, across which neither tokenizer has a
token. A document whose distinct pairs may be more than ``PAIRS`` is counted in pieces by A's id.

Defined results: texts that are null or empty, or whose tokens' bytes don't join to a space and the text on either side, have no tokens:
zeros and an empty string; repeated rows count as documents of their own and each gets its row; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices, written

LONG, CHUNK = 200_000, 100_000
PAIRS = 4_000_000
HEAD = 1_000_000
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Pieces of text on which merging one by one is slow; tokenizers handles them well.
LONG_RUN = 600
_LONG_SPACE = re.compile(r"\s{600}")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def has_long_run(text: str) -> bool:
    """Whether ``LONG_RUN`` characters stand together that all are white space or all are not."""
    return max(map(len, text.split()), default=0) >= LONG_RUN or _LONG_SPACE.search(text) is not None


def joined_bytes(table: list[bytes], ids: list[int]) -> bytes:
    """The bytes of tokens, one after the other."""
    return b"".join(itemgetter(*ids)(table)) if len(ids) > 1 else b"".join([table[k] for k in ids])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunks(text: str) -> list[str]:
    """The text in chunks of some ``CHUNK`` characters that begin with the space before a letter (but the first); their join is the text."""
    if len(text) <= LONG:
        return [text]
    out, begin = [], 0
    while len(text) - begin > CHUNK:
        cut = _CUT.search(text, begin + CHUNK)
        if cut is None:
            break
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]]


class ByteSide:
    """A byte-level tokenizer file: ids of a space and the text.

    Where its merges are in the order of its ids and it splits by the usual pattern, the same vocabulary runs in tiktoken, which gives equal ids in a
    fraction of the time; texts with very long runs, and other files, go through tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.load(open(path, encoding="utf-8"))
        letters, vocabulary = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for entry, k in vocabulary.items():
            self.bytes[k] = entry.encode() if entry in special else bytes(letters[c] for c in entry)
        self.fast = None
        split = spec["pre_tokenizer"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        plain = split and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"]
        if plain and [vocabulary[m] for m in merges] == list(range(256, 256 + len(merges))):
            import tiktoken

            ranks = {self.bytes[k]: k for entry, k in vocabulary.items() if entry not in special}
            self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(chunks(text)):
            part = part if k else " " + part
            if self.fast is not None and not has_long_run(part):
                out += self.fast.encode_ordinary(part)
            else:
                out += self.library.encode(part, add_special_tokens=False).ids
        return out

    def joined(self, ids: list[int]) -> bytes:
        """The bytes of tokens, one after the other."""
        try:
            return joined_bytes(self.bytes, ids) if self.fast is None else self.fast.decode_bytes(ids)
        except KeyError:  # an id that tiktoken doesn't have
            return joined_bytes(self.bytes, ids)


class PieceSide:
    """A piece model, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.encode("utf-8").replace("▁".encode(), b" ") for k, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        short = [k for k, t in enumerate(texts) if len(t) <= LONG or not self.cuts]
        done = dict(zip(short, self.library.encode([texts[k] for k in short], num_threads=1), strict=True))
        for k, text in enumerate(texts):
            if k in done:
                out.append(done[k])
            else:
                out.append([i for n, part in enumerate(chunks(text)) for i in self.library.encode(part[1:] if n else part)])
        return out


@lru_cache(maxsize=2)
def _sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a_path), PieceSide(b_path)


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of A's ends are cuts. low, high: the token ranges of the texts; the last end of each is shared."""
    cut = np.zeros(len(a_ends), dtype=bool)
    cut[high - 1] = True
    reach = np.zeros(len(low), dtype=np.int64)
    while len(low):
        inner = high - low > 1
        low, high, reach = low[inner], high[inner], reach[inner]
        if not len(low):
            break
        middle = (low + high - 2) // 2
        begin, end = np.maximum(low, middle - reach), np.minimum(high - 1, middle + reach + 1)
        size = end - begin
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)
        near = np.searchsorted(b_ends, a_ends[at])
        hit = np.flatnonzero(b_ends[near] == a_ends[at])
        owner = np.repeat(np.arange(len(low)), size)[hit]
        away = np.abs(at[hit] - middle[owner])
        order = np.lexsort((away, owner))
        first = order[np.r_[True, np.diff(owner[order]) > 0]] if len(order) else order
        split, where = owner[first], at[hit][first]
        cut[where] = True
        lost = np.ones(len(low), dtype=bool)
        lost[split] = False
        lost &= size < high - 1 - low  # a window over all inner ends without a shared one: a leaf
        low, high, reach = (
            np.r_[low[split], where + 1, low[lost]],
            np.r_[where + 1, high[split], high[lost]],
            np.r_[np.zeros(2 * len(split), dtype=np.int64), reach[lost] * 4 + 1],
        )
    return cut


class Aligned:
    """Texts of which both sides' bytes join to a space and the text, aligned: ids, group numbers and the first group of each text."""

    def __init__(self, a: list[list[int]], b: list[list[int]], a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.n_a, self.n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        self.a, self.b = (np.fromiter(chain.from_iterable(side), dtype=np.int64, count=int(n.sum())) for side, n in ((a, self.n_a), (b, self.n_b)))
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        stops = np.cumsum(self.n_a)
        cut = shared_ends(a_ends, b_ends, stops - self.n_a, stops)
        self.a_group = np.cumsum(np.r_[0, cut[:-1]]).astype(np.int64)
        self.b_group = np.searchsorted(a_ends[cut], b_ends)
        self.n_groups = int(cut.sum())
        self.a_in, self.b_in = np.bincount(self.a_group, minlength=self.n_groups), np.bincount(self.b_group, minlength=self.n_groups)
        self.first = self.a_group[stops - self.n_a]
        self.of_text = np.diff(np.r_[self.first, self.n_groups])
        self.links = np.add.reduceat(self.a_in * self.b_in, self.first)

    def written_groups(self) -> np.ndarray:
        """Numbers of what is written, in order: 2 * id (+ 1 for the last of its side in a group) of A; of B, after all of A's."""
        a_last, b_last = np.cumsum(self.a_in), np.cumsum(self.b_in)
        out = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        a_code, b_code = self.a * 2, self.b * 2
        a_code[a_last - 1] += 1
        b_code[b_last - 1] += 1
        out[np.arange(len(self.a)) + (b_last - self.b_in)[self.a_group]] = a_code
        out[np.arange(len(self.b)) + a_last[self.b_group]] = b_code + self.b_offset
        return out

    b_offset = 0


def expanded(a: np.ndarray, a_group: np.ndarray, a_times: np.ndarray, b: np.ndarray, b_group: np.ndarray, b_times: np.ndarray, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair number, times) of all pairs of an A and a B entry of one group; entries are ordered by group."""
    base = int(b_group[0]) if len(b_group) else 0
    of_group = np.bincount(b_group - base)
    many = of_group[a_group - base]
    start = (np.cumsum(of_group) - of_group)[a_group - base]
    i = np.repeat(np.arange(len(a)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many - start, many)
    return a_group[i], a[i] * b_size + b[j], a_times[i] * b_times[j]


def totals(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of times of each."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def grouped_times(ids: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (id, group) with the number of each, ordered by group."""
    key, times = np.unique(group * size + ids, return_counts=True)
    return key % size, key // size, times


def linked_pairs(x: Aligned, a_size: int, b_size: int, most: int = PAIRS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, piece, pair numbers, times) of every text, pair numbers distinct over the pieces of a text."""
    begin, held = 0, np.cumsum(x.links)
    while begin < len(x.links):
        end = max(begin + 1, int(np.searchsorted(held, (held[begin - 1] if begin else 0) + most, side="right")))
        low, high = x.first[begin], x.first[begin] + int(x.of_text[begin:end].sum())
        a_at, b_at = slice(*np.searchsorted(x.a_group, [low, high])), slice(*np.searchsorted(x.b_group, [low, high]))
        if end == begin + 1 and x.links[begin] > most:
            a, b = grouped_times(x.a[a_at], x.a_group[a_at], a_size), grouped_times(x.b[b_at], x.b_group[b_at], b_size)
            many = (np.searchsorted(b[1], a[1], side="right") - np.searchsorted(b[1], a[1], side="left")).sum()
            pieces = max(1, -(-int(many) // most))
            for p in range(pieces):
                mine = a[0] % pieces == p
                _, keys, times = expanded(a[0][mine], a[1][mine], a[2][mine], *b, b_size)
                yield (begin, p, *totals(keys, times))
        else:
            one = np.ones(max(a_at.stop - a_at.start, b_at.stop - b_at.start), dtype=np.int64)
            group, keys, _ = expanded(x.a[a_at], x.a_group[a_at], one[: a_at.stop - a_at.start], x.b[b_at], x.b_group[b_at], one[: b_at.stop - b_at.start], b_size)
            text = np.repeat(np.arange(begin, end), x.of_text[begin:end])[group - low]
            keys, times = np.unique(text.astype(np.int64) << 32 | keys, return_counts=True)
            bounds = np.searchsorted(keys >> 32, np.arange(begin, end + 1))
            for k in range(begin, end):
                mine = slice(bounds[k - begin], bounds[k - begin + 1])
                yield k, 0, keys[mine] & 0xFFFFFFFF, times[mine]
        begin = end


def packed(x: np.ndarray, steps: bool) -> bytes:
    """Numbers as bytes, byte planes one after the other, compressed; ``steps``: the differences of ordered ones."""
    x = np.diff(x, prepend=0) if steps else x
    width = 4 if steps or not len(x) or x.max() < 1 << 32 else 8
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes, steps: bool) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    x = np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel().astype(np.int64)
    return np.cumsum(x) if steps else x


ROW = "row_id long, doc_id long, piece int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned_rows(docs: DataFrame, a_path: str, b_path: str, most: int = PAIRS) -> DataFrame:
    """One row for each document (and for each further piece of its pairs) with counts, digest and packed pairs."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_side, b_side = _sides(a_path, b_path)
        a_size, b_size = len(a_side.bytes), len(b_side.bytes)
        if a_size * b_size >= 1 << 32:
            raise ValueError("more than 2**32 pairs of ids")
        a_sizes, b_sizes = (np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (a_side, b_side))
        marks = [b"%d%c" % (k, c) for k in range(a_size) for c in b",|"] + [b"%d%c" % (k, c) for k in range(b_size) for c in b",;"]
        nothing = (0, 0, 0, 0, "", None, None)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].tolist()]
            rows = batch["row_id"].tolist()
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"].tolist()]
            for begin, end in slices(texts):
                part, out, kept, a, b = texts[begin:end], [], [], [], []
                for k, (text, b_ids) in enumerate(zip(part, b_side.encode_all(part), strict=True)):
                    whole = (" " + text).encode("utf-8", "surrogatepass")
                    good = bool(text) and joined_bytes(b_side.bytes, b_ids) == whole
                    a_ids = a_side.encode(text) if good else []
                    if good and a_side.joined(a_ids) == whole:
                        kept.append(begin + k)
                        a.append(a_ids)
                        b.append(b_ids)
                    else:
                        out.append((rows[begin + k], ids[begin + k], 0, *nothing))
                if kept:
                    x = Aligned(a, b, a_sizes, b_sizes)
                    x.b_offset = 2 * a_size
                    written_, at = x.written_groups(), np.cumsum(x.n_a + x.n_b)
                    for k, piece, pairs, times in linked_pairs(x, a_size, b_size, most):
                        if piece:
                            stats = nothing[:5]
                        else:
                            text = joined_bytes(marks, written_[at[k] - x.n_a[k] - x.n_b[k] : at[k]].tolist())
                            stats = (int(x.n_a[k]), int(x.n_b[k]), int(x.of_text[k]), int(x.links[k]), hashlib.sha256(text[:-1]).hexdigest())
                        out.append((rows[kept[k]], ids[kept[k]], piece, *stats, packed(pairs, True), packed(times, False)))
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])
                yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").mapInPandas(align, ROW)


def pair_counts(rows: DataFrame, b_size: int, held: int = 1_000_000) -> DataFrame:
    """pair, n (documents that hold it) and best (whether n is the highest of its A id). A document's pairs are distinct over its pieces."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, fresh, waiting = (np.zeros(0, dtype=np.int64),) * 2, [], 0

        def merged():
            new = np.concatenate([*fresh, np.zeros(0, dtype=np.int64)])
            return totals(np.r_[have[0], new], np.r_[have[1], np.ones(len(new), dtype=np.int64)])

        for batch in batches:
            for raw in batch["pairs"]:
                fresh.append(unpacked(raw, True))
                waiting += len(fresh[-1])
                if waiting >= 2 * held:
                    have, fresh, waiting = merged(), [], 0
                    if len(have[0]) > held:
                        yield pd.DataFrame({"pair": have[0], "n": have[1]})
                        have = (have[0][:0], have[1][:0])
        have = merged()
        yield pd.DataFrame({"pair": have[0], "n": have[1]})

    found = rows.where("pairs is not null").select("pairs").mapInPandas(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = found.withColumn("a", F.expr(f"pair div {b_size}"))
    highest = found.groupBy("a").agg(F.max("n").alias("most"))
    return found.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD, most: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    b_size = len(_sides(a_path, b_path)[1].bytes)
    rows = written(aligned_rows(docs, a_path, b_path, most), "aligned")
    counts = written(pair_counts(rows, b_size), "pair-counts")
    # The least count at which all pairs of it and above fit in the head.
    least, room = 1, head
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    if counts.count() > head:
        least = 1 << 62
        for r in by_count.orderBy(F.desc("n")).limit(head).toLocalIterator():
            room -= r["k"]
            if room < 0:
                break
            least = r["n"]
    told = counts.where(F.col("n") >= least).toArrow()
    pair, n, best = (told[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    known = spark.sparkContext.broadcast((pair[order], n[order], best[order].astype(bool)))

    def looked_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = known.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        return at, (keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, n, best = known.value
        for batch in batches:
            sums = []
            for raw, raw_times in zip(batch["pairs"], batch["times"], strict=True):
                if raw is None:
                    sums.append((0, 0))
                    continue
                at, held = looked_up(unpacked(raw, True))
                at, times = at[held], unpacked(raw_times, False)[held]
                sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            yield batch.drop(columns=["pairs", "times"]).assign(n_best=[s[0] for s in sums], count_sum=[s[1] for s in sums])

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row_id, raw, raw_times in zip(batch["row_id"], batch["pairs"], batch["times"], strict=True):
                pairs = unpacked(raw, True)
                left = ~looked_up(pairs)[1]
                yield pd.DataFrame({"row_id": row_id, "pair": pairs[left], "times": unpacked(raw_times, False)[left]})

    kinds = ", ".join(c for c in ROW.split(", ") if c.split()[0] not in ("pairs", "times"))
    sums = rows.mapInPandas(summed, f"{kinds}, n_best long, count_sum long")
    columns = ["n_best", "count_sum"]
    more = sums.where("piece > 0").select("row_id", *columns)
    if least > 1:
        tail = rows.where("pairs is not null").select("row_id", "pairs", "times").mapInPandas(rare, "row_id long, pair long, times long")
        tail = tail.join(counts.where(F.col("n") < least), "pair")
        more = more.unionByName(tail.select("row_id", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")))
    out = sums.where("piece = 0")
    if least > 1 or rows.where("piece > 0").take(1):
        more = more.groupBy("row_id").agg(*[F.sum(c).alias(f"more_{c}") for c in columns])
        out = out.join(more, "row_id", "left")
        out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in columns])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *columns, "groups_sha256")
