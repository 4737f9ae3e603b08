"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: dict[str, str] = {}


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write and read back: cuts the lineage without a copy on one executor's disk."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all machines share")
        folder = _LOCAL.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="tables-"))
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bytes(spark, path: str, data: bytes) -> None:
    """One file in any store that Spark writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark, path: str) -> bytes:
    """One small file from any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
