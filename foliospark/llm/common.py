"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from foliospark.session import ship_package


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent, a session in one process (tests) gets a temporary folder; any other raises, since its executors
    wouldn't see such a folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    Compressed by zstd, whose buffers are on the heap; those of the default codec are as large as the largest page, lie outside, and stay.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and no plan reads any more."""
    for df in tables:
        dropped(df.sparkSession, df.scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str], most_chars: int = 250_000):
    """Index ranges of consecutive texts with about ``most_chars`` characters each, one text at least."""
    begin = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > most_chars:
            yield begin, k
            begin, held = k, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


#: Rows of a few numbers each that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` (written, rows of a few numbers), marked for broadcast where counting shows at most ``most`` rows, and whether it is."""
    from pyspark.sql import functions as F

    small = df.limit(most + 1).count() <= most
    return (F.broadcast(df) if small else df), small
