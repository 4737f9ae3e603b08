"""Incremental ingest as a structured stream: micro-batches, idempotent upserts, failures with tries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; what is left of ties goes by the whole row."""
    rest = [F.desc(c) for c, kind in rows.dtypes if c not in (key, *order) and not kind.startswith("map")]
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order], *rest)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def upsert_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, order: str):
    """Load files that are new since the last call into a table with one row a key, the latest.

    Each micro-batch is written to a folder named by its number, so a batch that
    is run again replaces itself; readers take the latest row of a key, of equal
    ``order`` that of the last batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, [order]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.option("basePath", target).parquet(target), key, [order, "batch"]).drop("batch")


def pending(worklist: DataFrame, crawl_log: DataFrame, failures: DataFrame, mode: str = "all", most: int = 3, key: str = "id") -> DataFrame:
    """What an interrupted crawl has still to do: all but logged ones, or, in retry mode, failures with tries left."""
    if mode == "retry":
        return worklist.join(failures.filter(F.col("tries") < most).select(key), key, "left_semi")
    return worklist.join(crawl_log.select(key).distinct(), key, "left_anti")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window of event time; an extension, with a watermark for late rows."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
