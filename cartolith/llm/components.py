"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_paths, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b).

    Large: every node sends its larger neighbours to the smallest of itself and
    its neighbours.  Small: every node sends itself and its smaller neighbours
    there.  A node's neighbours are never gathered: a minimum is aggregated and
    joined back, and AQE may split the join at a node with many edges.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        sent = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = down.join(least, F.col("a") == F.col("k"))
        sent = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return sent.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Nodes that are their own root are listed too.  A logarithmic number of
    rounds; each is written to the shared folder, and only a count and a
    checksum of the edges reach the driver.
    """
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        after = written(_stars(_stars(now, True), False), "edges")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        drop_paths(edges.sparkSession, now)
        now, done, seen = after, seen == tuple(mark), tuple(mark)
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
