"""What a Spark session needs to run this package's Python parts."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS, BATCH_BYTES = 1_000, 2_000_000


def spark_bytes(setting: str) -> int:
    """A number of Spark's settings, with or without a unit of bytes."""
    digits, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", setting.strip().lower()).groups()
    return int(digits) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit]


def ship_package(spark: SparkSession) -> SparkSession:
    """Puts the folder of this package on the Python path of the workers, where it isn't yet, and bounds what they are sent at once.

    Enough where executors see that folder; elsewhere the package is shipped with ``--py-files`` as usual. Batches hold ``BATCH_ROWS``
    texts at most, and where Spark can bound bytes, ``BATCH_BYTES``; smaller settings stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = spark.conf.get(key)
        except PySparkException:  # this Spark has no such setting
            continue
        if not 0 < spark_bytes(now) <= most:
            spark.conf.set(key, str(most))
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        known["PYTHONPATH"] = ":".join([*paths, root])
    return spark


def broadcast_by_measure(spark: SparkSession) -> SparkSession:
    """From now on joins broadcast a side only by the size that was measured when it was shuffled, up to the threshold that the session has, or by a hint.

    Before that, Spark takes the size of files for the size of their rows, which in compressed columns with few values may be a hundred times larger:
    tables of some MB on disk would fill the driver.
    """
    key, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    most = spark.conf.get(key)
    if spark_bytes(most) > 0:
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, most)
        spark.conf.set(key, "-1")
    return spark


def settled(df: DataFrame) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder of ``spark.checkpoint.dir``: several consumers read the columns they need, and its lineage ends there.

    Only a session in one process gets a temporary folder where none is set; any other raises. Joins of the session go by ``broadcast_by_measure`` from then on.
    """
    spark = broadcast_by_measure(df.sparkSession)
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="foliospark-"))
    path = f"{spark.sparkContext.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
