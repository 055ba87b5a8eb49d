"""Exact deduplication with streaming keyed state.

Rows become (digest of the normalised text, stable identifier, content locator). A streaming query reads
these with a keyed state in RocksDB, on disk and without expiry: for each digest the count and the row that
stays, with its locator. Later batches only touch the keys they bring. On hits (digests of several
rows) the full texts are compared; digests whose texts differ are grouped by the text itself.

With a ``state_dir`` the state lasts: a later run brings new rows only, goes on from the state of the runs before it, and compares
the texts of the digests that its rows touch. Without one the state is deleted at the end of the run.

Texts are equal when identical after lower-casing A-Z. The row with the largest identifier stays, among equal
identifiers the one with the largest locator.

Defined results: a null text counts as empty; equal texts form one group; rows with equal identifier and
locator can't be told apart and all stay or all go; a null identifier ranks lowest; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import dropped, exists, scratch_path, small_side, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each store reserves 4 MB for its list of files, however few keys it has.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bits of the filter that tells the scan which digests repeat (8 MB). With more repeated digests than it can hold, more texts are compared.
FILTER_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> Column:
    """A-Z in lower case, all else as it is. A text of ASCII only takes the faster way to the same result."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def keyed_state(spark: SparkSession, digests: DataFrame, path: str, files_per_batch: int | None = None, state_dir: str | None = None) -> DataFrame:
    """digest, n and keeper of every digest in the Parquet folder ``path``, by a streaming query over those of its files that the state doesn't know yet.

    The state goes to the shared folder as changes, not as whole stores. Without ``state_dir`` it is deleted once the last state of
    every key is written. With it, a column ``touched`` tells whether this run brought rows of the key.
    """
    at = state_dir or scratch_path(spark, "dedup-state")
    batches: list[int] = []
    before = {k: spark.conf.get(k, None) for k in STATE}
    reader = spark.readStream.schema(digests.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(path).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("keeper"))

    def keep(batch: DataFrame, number: int) -> None:
        batches.append(number)
        batch.write.mode("overwrite").parquet(f"{at}/updates/batch={number}")

    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{at}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not state_dir:
        dropped(spark, f"{at}/checkpoint")
    if not digests.take(1):  # no file had a row, so no batch ran
        none = spark.createDataFrame([], state.schema)
        return written(none.withColumn("touched", F.lit(False)) if state_dir else none, "dedup-keepers")
    updates = spark.read.schema(state.schema).parquet(f"{at}/updates")
    if state_dir:
        updates = spark.read.schema(f"{state._jdf.schema().toDDL()}, batch long").parquet(f"{at}/updates")
        touched = F.max(F.col("batch") >= min(batches, default=1 << 62)).alias("touched")
        return written(updates.groupBy("digest").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"), touched), "dedup-keepers")
    # Each batch gives the new state of its keys; count and keeper only grow.
    last = updates.groupBy("digest").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper")) if files_per_batch else updates.select("digest", "n", "keeper")
    last = written(last, "dedup-keepers")
    dropped(spark, at)
    return last


def _slot(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS)) + 1


def hit_filter(hits: DataFrame) -> DataFrame:
    """part and bits: a bit for each slot that a repeated digest falls on. At most FILTER_BITS / 32768 rows of 4 KB, whatever the corpus."""
    slot = _slot("digest")
    return hits.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def texts_of_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """row, digest and whole text of the rows whose digest repeats, and of a few others that fall on a bit of one.

    The digest is made again in the scan and looked up in the filter, so other texts never leave their task.
    """
    made = rows.select(F.struct("id", "place").alias("row"), digest_of("text").alias("digest"), normalised("text").alias("whole"))
    placed = made.withColumns({"part": F.bitmap_bucket_number(_slot("digest")), "at": F.bitmap_bit_position(_slot("digest"))})
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    told = F.broadcast(hit_filter(hits))
    return placed.join(told, "part").where(F.getbit(byte, F.pmod("at", F.lit(8)).cast("int")) == 1).select("row", "digest", "whole")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    locator: list[Column] | None = None,
    files_per_batch: int | None = None,
    state_dir: str | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    ``locator``: columns that place a row in its input, such as file path and row number; they tell rows of
    equal identifier apart and serve to find the full text again. One pass over the texts makes digests, a second one checks the bytes of
    hits: the least and the greatest text of a repeated digest, with partial results in each task.

    ``state_dir``: a folder that all executors share, in which digests and state last. Then ``docs`` holds the rows that are new, ``earlier``
    those of the runs before (their texts are read where a digest is hit), and the result has the rows of all runs, since new rows change
    groups and keepers of old ones. A run that failed after its digests were written is repeated with an empty ``docs``.
    """
    spark = docs.sparkSession
    place = F.struct(*[c.alias(f"p{k}") for k, c in enumerate(locator or [])], F.lit(0).alias("p")).alias("place")
    rows = docs.select(F.col(id_col).alias("id"), "text", place)
    path = f"{state_dir}/digests" if state_dir else scratch_path(spark, "dedup-digests")
    collisions = f"{state_dir}/collisions"
    known = bool(state_dir) and exists(spark, collisions)
    if known and earlier is None:
        raise ValueError("the state holds rows of earlier runs: give these rows as earlier")
    rows.select(digest_of("text").alias("digest"), F.struct("id", "place").alias("row")).write.mode("append").parquet(path)
    digests = spark.read.parquet(path)
    state = keyed_state(spark, digests, path, files_per_batch, state_dir)

    if earlier is not None:
        rows = rows.unionByName(earlier.select(F.col(id_col).alias("id"), "text", place))
    hits = state.where("n > 1 and touched" if state_dir else "n > 1").select("digest")
    if known:
        hits = hits.unionByName(spark.read.schema("digest binary").parquet(collisions)).distinct()
    texts = texts_of_hits(rows, hits)
    differing = written(texts.groupBy("digest").agg(F.min("whole").alias("least"), F.max("whole").alias("most")).where("least <> most").select("digest"), "dedup-collisions")
    if state_dir:
        differing.write.mode("append").parquet(collisions)

    out = digests.join(state, "digest").select("row", "digest", "n", "keeper")
    if differing.take(1):  # equal digests of different texts: the texts decide
        few, _ = small_side(differing)
        apart = texts.join(few, "digest")
        by_text = apart.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("keeper"))
        out = out.join(few, "digest", "left_anti").unionByName(apart.join(by_text, ["digest", "whole"]).select("row", "digest", "n", "keeper"))
    return out.select(
        F.col("row.id").alias(id_col),
        F.col("keeper.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("row").eqNullSafe(F.col("keeper")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
