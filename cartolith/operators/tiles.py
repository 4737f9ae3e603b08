"""Quadtree tile pyramid: cells, per-tile selection, bounds, viewport lookup, statistics.

Points are (id, x, y, category, importance).  Nothing here knows what they stand for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def importance_rank(df: DataFrame, value: str = "importance", key: str = "id", out: str = "importance", top: int = 65535, partitions: int | None = None) -> DataFrame:
    """Ordinal rank of ``value`` (ties by ``key``) scaled to 0..top, halves to even; one row has ``top``.

    Rank is a row's place in its range of values plus the sizes of lower
    ranges: the table is range-partitioned, so no task sorts all of it.
    """
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n_parts <= 1:
        bounds = []
    else:
        bounds = sorted(set(df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / n_parts for i in range(1, n_parts)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(value).cast("double"))) if bounds else F.lit(0)
    dealt = df.withColumn("_p", part)
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    below = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(value, key)) - 1 + F.col("_below")
    scaled = F.when(F.col("_all") == 1, F.lit(top)).otherwise(F.bround(rank / (F.col("_all") - 1) * top).cast("int"))
    return dealt.join(F.broadcast(offsets), "_p").withColumn(out, scaled).drop("_p", "_below", "_all")


def root_box(points: DataFrame) -> DataFrame:
    """One row (minx, miny, maxx, maxy); upper edges are moved out a little so that all points are inside."""
    b = points.agg(*[f(F.col(c).cast("double")).alias(n) for n, f, c in (("minx", F.min, "x"), ("miny", F.min, "y"), ("hx", F.max, "x"), ("hy", F.max, "y"))])
    up = lambda lo, hi: F.col(hi) + 1e-9 * (F.col(hi) - F.col(lo)) + 1e-12
    return b.select("minx", "miny", up("minx", "hx").alias("maxx"), up("miny", "hy").alias("maxy"))


def cell(v: Column, lo: Column, hi: Column, n: Column) -> Column:
    return F.least(F.greatest(((v.cast("double") - lo) / F.greatest(hi - lo, F.lit(1e-12)) * n).cast("long"), F.lit(0)), n - 1)


def tile_bounds(z: Column, tx: Column, ty: Column, box: tuple[Column, Column, Column, Column]) -> list[Column]:
    minx, miny, maxx, maxy = box
    n = F.pow(F.lit(2.0), z)
    w, h = (maxx - minx) / n, (maxy - miny) / n
    return [minx + tx * w, miny + ty * h, minx + (tx + 1) * w, miny + (ty + 1) * h]


def assign(points: DataFrame, max_zoom: int) -> DataFrame:
    """A row for each point and zoom, with its tile; the box is one broadcast row."""
    z = points.crossJoin(F.broadcast(root_box(points))).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom))))
    n = F.pow(F.lit(2.0), F.col("z")).cast("long")
    return z.withColumn("tx", cell(F.col("x"), F.col("minx"), F.col("maxx"), n)).withColumn("ty", cell(F.col("y"), F.col("miny"), F.col("maxy"), n))


TILE = ["z", "tx", "ty"]


def select_naive(assigned: DataFrame, limit: int, grid: int) -> DataFrame:
    w = Window.partitionBy(*TILE).orderBy(F.desc("importance"), "id")
    return assigned.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def select_stratified(assigned: DataFrame, limit: int, grid: int) -> DataFrame:
    """The best of each cell of a grid over the tile first, then the best of the rest, ``limit`` in all.

    A point that isn't among the best ``limit`` of its cell can't be chosen, so
    rows are cut by cell, which spreads a crowded tile over tasks, before the
    tile's own window.
    """
    x0, y0, x1, y1 = tile_bounds(F.col("z"), F.col("tx"), F.col("ty"), tuple(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    g = F.lit(grid).cast("long")
    cut = assigned.withColumn("_gx", cell(F.col("x"), x0, x1, g)).withColumn("_gy", cell(F.col("y"), y0, y1, g))
    best = [F.desc("importance"), F.asc("id")]
    cut = cut.withColumn("_r", F.row_number().over(Window.partitionBy(*TILE, "_gx", "_gy").orderBy(*best))).filter(F.col("_r") <= limit)
    first = F.col("_r") <= max(1, limit // (grid * grid))
    w = Window.partitionBy(*TILE).orderBy(F.desc("_first"), *best)
    return cut.withColumn("_first", first).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_gx", "_gy", "_r", "_first", "_k")


STRATEGIES: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {"naive": select_naive, "stratified": select_stratified}


def tile_pyramid(points: DataFrame, max_zoom: int = 5, limit: int = 1000, grid: int = 8, strategy: str = "stratified") -> DataFrame:
    """(z, tx, ty, id, x, y, category, importance, is_leaf): the deepest zoom has all points, the others ``limit`` a tile."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    rows = assign(points, max_zoom)
    upper = STRATEGIES[strategy](rows.filter(F.col("z") < max_zoom), limit, grid)
    names = [*TILE, "id", "x", "y", "category", "importance"]
    return upper.select(*names, F.lit(False).alias("is_leaf")).unionByName(rows.filter(F.col("z") == max_zoom).select(*names, F.lit(True).alias("is_leaf")))


def viewport_tiles(box: DataFrame, z: int, view: tuple[float, float, float, float]) -> DataFrame:
    """The tiles at zoom ``z`` that a rectangle meets; its corners are clamped to the map."""
    n = F.lit(2**z).cast("long")
    c = lambda v, lo, hi: cell(F.lit(v), F.col(lo), F.col(hi), n)
    b = box.select(c(view[0], "minx", "maxx").alias("x0"), c(view[1], "miny", "maxy").alias("y0"), c(view[2], "minx", "maxx").alias("x1"), c(view[3], "miny", "maxy").alias("y1"))
    return b.select(F.lit(z).alias("z"), F.explode(F.sequence("x0", "x1")).alias("tx"), "y0", "y1").select("z", "tx", F.explode(F.sequence("y0", "y1")).alias("ty"))


def redundancy(pyramid: DataFrame, points: DataFrame) -> DataFrame:
    """One row: records of all tiles for each point."""
    return pyramid.agg(F.count("*").alias("records")).crossJoin(points.agg(F.count("*").alias("points"))).withColumn("redundancy", F.try_divide(F.col("records"), F.col("points")))


def stats_per_zoom(pyramid: DataFrame) -> DataFrame:
    return pyramid.groupBy("z").agg(F.count_distinct("tx", "ty").alias("tiles"), F.count("*").alias("points"))


def occupancy(pyramid: DataFrame, box: DataFrame, side: int = 32) -> DataFrame:
    """Cells of a ``side`` x ``side`` grid over the map that a zoom's points touch."""
    n = F.lit(side).cast("long")
    placed = pyramid.crossJoin(F.broadcast(box))
    gx, gy = cell(F.col("x"), F.col("minx"), F.col("maxx"), n), cell(F.col("y"), F.col("miny"), F.col("maxy"), n)
    return placed.groupBy("z").agg(F.count_distinct(gx * side + gy).alias("cells")).withColumn("share", F.round(F.col("cells") / (side * side), 6))
