"""Token-ID output in directly addressable codes.

Ids are cut into 8-bit chunks by level: level 0 holds the lowest chunk of every id, level k the chunks
of the ids that need more than k. A bitmap at each level says which ids continue, and a directory of
ones before every 512 bits gives the place in the next level. Any single id is read by following at
most four chunks, without decoding its neighbours.

A file set is a Parquet folder of segments in ascending doc_id order (shard, segment): whole documents,
about ``SEGMENT_IDS`` ids each, with the binary code, the doc_ids and the lengths. Spark's own writer commits
it, so a lost executor's shard is written again.

Defined results: a null text counts as empty and gives the end id only; documents of equal doc_id are
ordered by text; a null doc_id comes first; an empty table gives no segments; other columns are not read. The running sums go over
one small row for each shard, and for each segment of a shard, never over documents.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import scratch_path, slices

MAGIC = b"DAC1"
BITS = 512  # between two entries of a rank directory
SEGMENT_IDS = 1 << 18
REMEMBERED = 300_000  # words in a worker's memory
SEGMENT = "shard int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, code binary"


def encode_ids(ids: np.ndarray) -> bytes:
    """The code of unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        more = (rest >> 8) > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.r_[0, np.cumsum(more)]
        ranks = ones[np.arange(0, len(rest) + 1, BITS)].astype("<u4")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<B", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(part for _, *parts in levels for part in parts)


class DirectCodes:
    """Reads a code: ``codes[i]`` follows one id through the levels, ``all()`` decodes them together."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a code of this format")
        n_levels, at = code[4], 5 + 8 * code[4]
        self.levels = []
        for (n,) in struct.iter_unpack("<Q", code[5:at]):
            chunks = np.frombuffer(code, np.uint8, n, at)
            bits = np.frombuffer(code, np.uint8, (n + 7) // 8, at + n)
            ranks = np.frombuffer(code, "<u4", n // BITS + 1, at + n + len(bits))
            at += n + len(bits) + 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))
        assert len(self.levels) == n_levels

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BITS
            within = np.unpackbits(bits[block * BITS // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(within[: i - block * BITS].sum())
        return value

    def all(self) -> np.ndarray:
        above = None
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if above is not None:
                here[np.flatnonzero(np.unpackbits(bits, count=len(here), bitorder="little"))] |= above << np.uint32(8)
            above = here
        return above


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Characters on which Python's patterns and case rules agree with the tokenizer's, and which its normaliser keeps.
PLAIN = frozenset("".join(map(chr, range(32, 127))) + "\t\n\r" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\r0-9{_LETTERS}]+")


# The normaliser and splitter that ``_PRE_TOKEN`` stands for on plain characters.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Encodes texts pre-token by pre-token and remembers frequent ones.

    For the normaliser and splitter above, texts of plain characters without special strings are cut
    here and the library's model encodes the new pre-tokens; other texts, and all texts of other tokenizers, go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = tokenizer_of(path), {}
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = spec["model"]["type"] == "BPE" and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Byte-level alphabets write printable Latin-1 bytes as themselves and the others from U+0100 on.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        letter = {**{b: chr(b) for b in kept}, **{b: chr(256 + k) for k, b in enumerate(moved)}}
        self.letters = {ord(c): "".join(letter[b] for b in c.encode()) for c in PLAIN}

    def _ids(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(word.translate(self.letters))]).tobytes()
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def _plain(self, text: str) -> np.ndarray:
        words = _PRE_TOKEN.findall(text.lower())
        ids = list(map(self.known.get, words))
        if None in ids:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            ids = [self.known.get(w) or self._ids(w) if i is None else i for w, i in zip(words, ids, strict=True)]
        return np.frombuffer(b"".join(ids), dtype="<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [
            self._plain(t) if self.by_word and set(t) <= PLAIN and not any(s in t for s in self.special) else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4")
            for t in texts
        ]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> None:
    """Encodes (doc_id, text), adds the end id to every document and writes the file set in doc_id order.

    One range shuffle by doc_id; a shard is one range. Its rows stream through the encoder in batches.
    """

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, shard, number = WordEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0
        end = np.array([end_id], dtype="<u4")

        def row() -> pd.DataFrame:
            whole = np.concatenate(ids)
            return pd.DataFrame({"shard": [shard], "segment": [number], "n_ids": [len(whole)], "doc_ids": [list(doc_ids)], "lengths": [[len(x) for x in ids]], "code": [encode_ids(whole)]})

        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].tolist()]
            for begin, upto in slices(texts):
                for doc_id, one in zip(batch["doc_id"].tolist()[begin:upto], encoder.encode(texts[begin:upto]), strict=True):
                    doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                    ids.append(np.r_[one, end])
                    held += len(ids[-1])
                    if held >= SEGMENT_IDS or len(ids) >= 4096:
                        yield row()
                        number, held = number + 1, 0
                        ids, doc_ids = [], []
        if ids:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(segments, SEGMENT).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard and segment of every document, read from a file set.

    ``start`` adds up lengths: within a segment in the task, over the segments of a shard and over shards
    in two windows that see one small row for each segment or shard.
    """
    files = spark.read.schema(SEGMENT).parquet(path)

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, segment, doc_ids, lengths, code in zip(batch["shard"], batch["segment"], batch["doc_ids"], batch["lengths"], batch["code"], strict=True):
                ids = DirectCodes(code).all().astype("<u4")
                lengths = np.asarray(lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in doc_ids], dtype="Int64"), "within": ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(crcs, dtype=np.int64)})
                yield out.assign(shard=np.int32(shard), segment=np.int32(segment))

    rows = files.select("shard", "segment", "doc_ids", "lengths", "code").mapInPandas(
        decoded, "doc_id long, within long, n_tokens long, ids_crc32 long, shard int, segment int"
    )
    sizes = files.select("shard", "segment", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_shard = sizes.withColumn("segment_start", before(Window.partitionBy("shard").orderBy("segment"))).drop("n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).withColumn("shard_start", before(Window.orderBy("shard"))).drop("n_ids")
    return (
        rows.join(in_shard, ["shard", "segment"])
        .join(shards, "shard")
        .select("doc_id", (F.col("shard_start") + F.col("segment_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")
    )


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the file set (in the shared folder where no path is given) and returns what reading it gives."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, tokenizer_path, path, end_id)
    return read_token_files(spark, path)
