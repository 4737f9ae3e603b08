"""Measures of a 2-d layout: boxes, hulls, purity, containment, fidelity, density."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_bbox(closed: DataFrame, members: DataFrame, points: DataFrame) -> DataFrame:
    """(node, x0, y0, x1, y1, cx, cy, n) over each subtree; a node's own points are summed up before they climb."""
    own = members.join(points.select(F.col("id").alias("item"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "item")
    part = own.groupBy("node").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    up = closed.join(part, "node").groupBy(F.col("ancestor").alias("node"))
    return up.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.sum("sx") / F.sum("n")).alias("cx"), (F.sum("sy") / F.sum("n")).alias("cy"), F.sum("n").alias("n"))


def core_bbox(points: DataFrame, group: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    q = lambda c, p: F.percentile(F.col(c).cast("double"), p)
    return points.groupBy(group).agg(q("x", low).alias("x0"), q("y", low).alias("y0"), q("x", high).alias("x1"), q("y", high).alias("y1"))


def value_at(df: DataFrame, column: str, place) -> DataFrame:
    """One row ``value``: the value at place ``place(n)`` (from 0) in ascending order of those that aren't null.

    Counts of distinct values are summed by range; only the range that holds the
    place is then put in order, so no task sees all values.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    bounds = sorted(set(counts.select(F.col("value").cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("value").cast("double"))) if bounds else F.lit(0)
    dealt = counts.withColumn("part", part)
    ranges = dealt.groupBy("part").agg(F.sum("n").alias("held"))  # `parts` rows
    below = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.select("part", "held", below.alias("below"), F.sum("held").over(Window.partitionBy()).alias("total")).withColumn("at", place(F.col("total")))
    there = placed.filter("at >= below AND at < below + held")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    seen = dealt.join(F.broadcast(there), "part").withColumn("upto", upto + F.col("below"))
    return seen.filter("upto > at").agg(F.min("value").alias("value"))


def index_quantile(df: DataFrame, column: str, p: float) -> DataFrame:
    """The value at place floor((n-1) p), not interpolated."""
    return value_at(df, column, lambda n: F.floor((n - 1) * p))


def hull(points: np.ndarray) -> np.ndarray | None:
    """Half-planes (a, b, c), a x + b y + c <= 0 inside, of the convex hull; null if it is flat."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return None

    ring = _ring(p) if len(p) > 3 else p[[0, 1, 2]]
    if len(p) == 3 and (p[1, 0] - p[0, 0]) * (p[2, 1] - p[0, 1]) - (p[1, 1] - p[0, 1]) * (p[2, 0] - p[0, 0]) < 0:
        ring = p[[0, 2, 1]]
    if len(ring) < 3:
        return None
    d = np.roll(ring, -1, axis=0) - ring
    normal = np.stack([d[:, 1], -d[:, 0]], axis=1) / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
    return np.c_[normal, -(normal * ring).sum(axis=1)]



def trimmed_hulls(grouped: DataFrame, keep: float = 0.95) -> DataFrame:
    """(node, planes) of (node, x, y): hull of the points within the ``keep`` quantile of the distance to the centroid.

    The quantile is an aggregate; only points inside it reach the grouped step.
    """
    mid = grouped.groupBy("node").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = grouped.join(mid, "node").withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    cut = d.groupBy("node").agg(F.percentile("d", keep).alias("cut"))
    inside = d.join(cut, "node").filter("d <= cut")
    # A group that keeps fewer than three points takes all.
    few = d.groupBy("node").agg(F.count("*").alias("all")).join(inside.groupBy("node").agg(F.count("*").alias("in")), "node", "left").filter(F.coalesce("in", F.lit(0)) < 3).select("node")
    inside = inside.select("node", "x", "y").join(few, "node", "left_anti").unionByName(d.select("node", "x", "y").join(few, "node"))
    # The extreme point of each of 64 directions bounds what a group's task gets; hulls of chunks are merged.
    chunked = inside.withColumn("chunk", F.pmod(F.xxhash64("x", "y"), F.lit(16)))

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(pdf[["x", "y"]].to_numpy(float), axis=0)
        on = _ring(p)
        return pd.DataFrame({"node": pdf["node"].iloc[0], "x": on[:, 0], "y": on[:, 1]})

    corners = chunked.groupBy("node", "chunk").applyInPandas(ring, "node string, x double, y double")

    def planes(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "planes": [None if h is None else h.tolist()]})

    return corners.groupBy("node").applyInPandas(planes, "node string, planes array<array<double>>")


def _ring(p: np.ndarray) -> np.ndarray:
    """Corner points of the hull; all points if there are few."""
    if len(p) < 4:
        return p

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def inside(planes, x, y, slack: float = 1e-9):
    return F.forall(planes, lambda e: e[0] * x + e[1] * y + e[2] <= slack)


def box_purity(points: DataFrame, group: str, boxes: DataFrame) -> DataFrame:
    """(group, purity): share of the points in a group's box that are its own.  Boxes are few and broadcast if small."""
    b = boxes.withColumnRenamed(group, "_g")
    j = points.join(b, (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")))
    return j.groupBy(F.col("_g").alias(group)).agg(F.avg((F.col(group) == F.col("_g")).cast("int")).alias("purity"))


def containment(points: DataFrame, group: str, parent: str, boxes: DataFrame) -> DataFrame:
    """(group, containment): share of a group's points inside its parent's box."""
    j = points.join(boxes.withColumnRenamed(parent, "_p"), F.col(parent) == F.col("_p"))
    ok = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    return j.groupBy(group).agg(F.avg(ok.cast("int")).alias("containment"))


def territory_spearman(pairs: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """Correlation of ordinal ranks of two distances over territory pairs (a few thousand rows)."""
    ra, rb = (F.row_number().over(Window.orderBy(c, *order)).cast("double") for c in (a, b))
    return pairs.select(ra.alias("ra"), rb.alias("rb")).agg(F.corr("ra", "rb").alias("spearman"))


def rank_correlation(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of two given ranks (by group); null under two rows or without spread."""
    grouped = df.groupBy(*(by or []))
    return grouped.agg(F.when(F.count("*") >= 2, F.nullif(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(float("nan")))).alias("spearman"))


def order_agreement(stored: DataFrame, live: DataFrame, least: int = 3) -> DataFrame:
    """(id, n, by_votes, by_name): stored tag order against live votes and against the alphabet.

    ``stored`` is (id, tags), ``live`` (id, tag, votes); only tags that both have
    count, and an item needs ``least`` of them and of stored tags.  Ties in
    votes keep the stored order.
    """
    each = stored.filter(F.size("tags") >= least).select("id", F.posexplode("tags").alias("place", "tag")).join(live, ["id", "tag"])
    own = lambda *order: F.row_number().over(Window.partitionBy("id").orderBy(*order))
    ranked = each.select("id", own("place").alias("s"), own(F.desc("votes"), "place").alias("v"), own(F.lower("tag"), "place").alias("a"))
    counted = ranked.groupBy("id").agg(F.count("*").alias("n"), F.corr(F.col("s").cast("double"), F.col("v").cast("double")).alias("by_votes"), F.corr(F.col("s").cast("double"), F.col("a").cast("double")).alias("by_name"))
    return counted.filter(F.col("n") >= least)


def purity_baseline(points: DataFrame, sizes: list[int], keep: float = 0.95, reps: int = 3, seed: int = 0) -> DataFrame:
    """(bin, expected): mean hull purity of random groups of each size, drawn ``reps`` times by a seeded hash.

    ``points`` is (id, x, y).  Sizes are the bins of ``scalar.size_bin``, a dozen;
    each draw is a top-k of the bin's size.
    """
    draws = None
    for size in sizes:
        for r in range(reps):
            one = points.orderBy(F.xxhash64("id", F.lit(f"{seed}/{size}/{r}")), "id").limit(size).select(F.lit(f"{size}/{r}").alias("node"), "id", "x", "y")
            draws = one if draws is None else draws.unionByName(one)
    hulls = trimmed_hulls(draws.select("node", "x", "y"), keep).filter("planes IS NOT NULL")
    within = inside(F.col("planes"), F.col("x"), F.col("y"))
    every = points.crossJoin(F.broadcast(hulls)).filter(within).groupBy("node").agg(F.count("*").alias("n"))  # a few dozen hulls
    own = draws.join(hulls, "node").filter(within).groupBy("node").agg(F.count("*").alias("own"))
    return every.join(own, "node").groupBy(F.split_part("node", F.lit("/"), F.lit(1)).cast("int").alias("bin")).agg(F.avg(F.col("own") / F.col("n")).alias("expected"))


def purity_lift(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """(group, purity, expected, lift) of (group, size, purity): against random groups of the size's bin."""
    from ..functions.scalar import size_bin

    return observed.withColumn("bin", size_bin(F.col("size"))).join(baseline, "bin").select("group", "purity", "expected", F.try_divide(F.col("purity"), F.col("expected")).alias("lift"))


def display_layout(vectors: DataFrame, kind: str = "plain", labels: DataFrame | None = None, weight: float = 0.3, inner: int = 5) -> DataFrame:
    """(item, x, y): the first two principal components; this is no manifold layout.

    ``supervised`` appends the item's territory (item, label) as a one-hot vector
    of ``weight``; ``chained`` reduces to ``inner`` dimensions first.
    """
    from .vectors import pca

    if kind == "supervised":
        known = sorted(r[0] for r in labels.select("label").distinct().limit(4097).collect())
        if len(known) > 4096:
            raise ValueError("a supervised layout takes 4,096 territories at most")
        hot = F.transform(F.array(*map(F.lit, known)), lambda k: F.when(k == F.col("label"), F.lit(float(weight))).otherwise(0.0))
        vectors = vectors.join(labels, "item", "left").select("item", F.concat(F.transform("features", lambda x: x.cast("double")), F.when(F.col("label").isNotNull(), hot).otherwise(F.array_repeat(F.lit(0.0), len(known)))).alias("features"))
    elif kind == "chained":
        vectors = pca(vectors, inner)[0]
    elif kind != "plain":
        raise ValueError(f"unknown layout {kind!r}; known: chained, plain, supervised")
    flat = pca(vectors, 2)[0]
    return flat.select("item", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
