"""The query side of a map: visible labels, active ancestors, search, nearest points, verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalar import fold_text, smoothstep


def visible_labels(nodes: DataFrame, min_show: float = 0.002, min_full: float = 0.005, max_full: float = 0.175, max_show: float = 0.25, descend: float = 0.0012, least: float = 0.02) -> DataFrame:
    """(node, depth, opacity) of (node, parent, f, is_leaf, pruned): a walk from the root's children.

    A node is drawn by its footprint unless pruned; its children are visited if
    it is pruned or large enough.  A round a level of the tree.
    """
    known = nodes.select("node", "parent", "f", "is_leaf", "pruned")
    root = known.filter("parent IS NULL").select(F.col("node").alias("r"))
    level = known.join(root, F.col("parent") == F.col("r")).drop("r").withColumn("depth", F.lit(1))
    seen = level
    for depth in range(2, 64):
        open_ = level.filter(F.col("pruned") | (F.col("f") > descend)).select(F.col("node").alias("p"))
        level = known.join(open_, F.col("parent") == F.col("p")).drop("p").withColumn("depth", F.lit(depth))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    fade = F.when(F.col("is_leaf"), 1.0).otherwise(1 - smoothstep(max_full, max_show, F.col("f")))
    shown = seen.filter(~F.col("pruned") & (F.col("f") > min_show)).withColumn("opacity", F.least(smoothstep(min_show, min_full, F.col("f")), fade))
    return shown.filter(F.col("opacity") > least).select("node", "depth", "opacity")


def active_ancestor(closed: DataFrame, nodes: DataFrame, low: float = 0.002, high: float = 0.25) -> DataFrame:
    """(node, active): the first ancestor up that is drawn at its size, or else the one below the root."""
    depth = closed.groupBy("node").agg(F.max("hops").alias("depth"))
    up = closed.join(nodes.select(F.col("node").alias("ancestor"), "f", "is_leaf", "pruned"), "ancestor").join(depth, "node")
    good = ~F.col("pruned") & (F.col("f") > low) & (F.col("is_leaf") | (F.col("f") < high)) & (F.col("hops") < F.col("depth"))
    top = F.min_by("ancestor", F.when(F.col("hops") == F.greatest(F.col("depth") - 1, F.lit(0)), F.col("hops")))
    return up.groupBy("node").agg(F.coalesce(F.min_by("ancestor", F.when(good, F.col("hops"))), top).alias("active"))


def name_search(items: DataFrame, query: str, limit: int | None = 8) -> DataFrame:
    """(id, name, tier, reviews): where the first match begins, 0 the name, 1 a word, 2 elsewhere; by reviews, then id.

    ``items`` has ``folded``; the query is folded here.  An empty query finds nothing.
    """
    q = F.lit(fold_text(query))
    at = F.instr(F.col("folded"), q)
    tier = F.when(at == 1, 0).when(F.substring(F.col("folded"), at - 1, F.lit(1)) == " ", 1).otherwise(2)
    found = items.filter((F.length(q) > 0) & (at > 0)).withColumn("tier", tier).orderBy("tier", F.desc("reviews"), "id").select("id", "name", "tier", "reviews")
    return found if limit is None else found.limit(limit)


def label_search(terms: DataFrame, query: str, limit: int | None = 4) -> DataFrame:
    """(node, rank, size) of (node, position, folded, size), the root's terms left out by the caller.

    A term that is the query counts 0, one that begins with it 10, others with
    it 20, plus the term's position; the best term is a node's rank; larger
    nodes come first among equals.
    """
    q = F.lit(fold_text(query))
    at = F.instr(F.col("folded"), q)
    tier = F.when(F.col("folded") == q, 0).when(at == 1, 10).otherwise(20) + F.col("position")
    best = terms.filter((F.length(q) > 0) & (at > 0)).groupBy("node").agg(F.min(tier).alias("rank"), F.max("size").alias("size")).orderBy("rank", F.desc("size"), "node")
    return best if limit is None else best.limit(limit)


def pruned(nodes: DataFrame, least: float = fixed.PRUNE_PURITY) -> DataFrame:
    """``nodes`` (node, parent, purity, ...) with ``pruned``: no place of its own, as its purity is known, low, and it has children."""
    parents = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("_has", F.lit(True))
    low = F.col("purity").isNotNull() & (F.col("purity") < least)
    return nodes.join(parents, "node", "left").withColumn("pruned", F.coalesce(low & F.col("_has"), F.lit(False))).drop("_has")


def on_screen(labels: DataFrame, width: float, height: float, margin: float = fixed.CULL_MARGIN) -> DataFrame:
    """Labels (px, py, ...) whose place is on the canvas or within ``margin`` pixels of it."""
    return labels.filter(F.col("px").between(-margin, width + margin) & F.col("py").between(-margin, height + margin))


def territories(nodes: DataFrame) -> DataFrame:
    """(node, territory): the root's children by size, the largest 0, ties by node."""
    root = nodes.filter("parent IS NULL").select(F.col("node").alias("r"))
    top = nodes.join(F.broadcast(root), F.col("parent") == F.col("r"))
    return top.select("node", (F.row_number().over(Window.partitionBy("r").orderBy(F.desc("size"), "node")) - 1).alias("territory"))


def weakest(labelled: DataFrame, most: int = 5) -> DataFrame:
    """The largest nodes below the root whose label is weak or missing."""
    return labelled.filter("parent IS NOT NULL").filter(F.col("confidence").isin("weak", "none")).orderBy(F.desc("size"), "node").limit(most)


def frontier_score(nodes: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """(node, score): w1 adjacency + w2 quality + w3 (1 - ownership), of shares from 0 to 1."""
    a, q, o = weights
    return nodes.select("node", (a * F.coalesce("adjacency", F.lit(0.0)) + q * F.coalesce("quality", F.lit(0.0)) + o * (1 - F.coalesce("ownership", F.lit(0.0)))).alias("score"))


def density_overlay(points: DataFrame, cell: float, reach: int = 2) -> DataFrame:
    """(gx, gy, density): a kernel density of (x, y, weight) on a grid of ``cell``; weights count by log(1 + weight).

    Weights are summed by cell, and each cell gives to the (2 reach + 1)^2
    around it by a Gaussian of one cell.
    """
    held = points.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.sum(F.log1p("weight")).alias("w"))
    step = F.sequence(F.lit(-reach), F.lit(reach))
    spread = held.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    kernel = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / 2.0)
    return spread.groupBy((F.col("cx") + F.col("dx")).alias("gx"), (F.col("cy") + F.col("dy")).alias("gy")).agg(F.sum(F.col("w") * kernel).alias("density"))


def nearest_point(cursors: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(cursor, id): the nearest point strictly within ``radius``, ties by id, or -1.

    Points are binned in cells of the radius' side; a cursor looks in nine.
    """
    c = lambda v: F.floor(F.col(v) / radius)
    near = F.sequence(F.lit(-1), F.lit(1))
    looks = cursors.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("cursor", F.col("x").alias("qx"), F.col("y").alias("qy"), (c("x") + F.col("dx")).alias("bx"), (c("y") + F.col("dy")).alias("by"))
    j = looks.join(points.select("id", "x", "y", c("x").alias("bx"), c("y").alias("by")), ["bx", "by"])
    d = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    best = j.withColumn("d", d).filter(F.col("d") < radius * radius).groupBy("cursor").agg(F.min(F.struct("d", "id"))["id"].alias("id"))
    return cursors.select("cursor").join(best, "cursor", "left").select("cursor", F.coalesce("id", F.lit(-1)).alias("id"))


def neighbour_verdict(neighbours: DataFrame, points: DataFrame, span: float, least: int = 3) -> DataFrame:
    """(src, spread, verdict): mean distance of a point's neighbours to their centre, as a share of the map."""
    j = neighbours.join(points.select(F.col("id").alias("dst"), "x", "y"), "dst")
    mid = j.groupBy("src").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).filter(F.col("n") >= least)
    s = j.join(mid, "src").groupBy("src").agg((F.avg(F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2))) / span).alias("spread"))
    return s.select("src", "spread", F.when(F.col("spread") < 0.05, "cohesive").when(F.col("spread") < 0.14, "partly").otherwise("scattered").alias("verdict"))


def place_labels(candidates: DataFrame, pad: float = 3.0, char: float = 0.55) -> DataFrame:
    """(view, node, drawn): labels in order of size, skipped where they meet one already drawn.

    Greedy by nature: a view has a few hundred candidates, each view is a group.
    A text is as wide as its characters times ``char`` times its height.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "node"], ascending=[False, True])
        boxes, drawn = [], []
        for x, y, text, px in zip(pdf["px"], pdf["py"], pdf["label"], pdf["height"]):
            w = len(text) * char * px
            box = (x - w / 2 - pad, y - px / 2 - pad, x + w / 2 + pad, y + px / 2 + pad)
            free = all(box[2] <= b[0] or b[2] <= box[0] or box[3] <= b[1] or b[3] <= box[1] for b in boxes)
            boxes += [box] * free
            drawn.append(free)
        return pdf.assign(drawn=drawn)[["view", "node", "drawn"]]

    return candidates.groupBy("view").applyInPandas(run, "view long, node string, drawn boolean")


def merged_results(labels: DataFrame, games: DataFrame, total: int = 8, most_labels: int = 3) -> DataFrame:
    """Labels first (3 at most), then items up to 8 results."""
    a = labels.orderBy("rank", F.desc("size"), "node").limit(most_labels).select(F.lit(0).alias("kind"), F.col("node").cast("string").alias("key"), F.row_number().over(Window.orderBy("rank", F.desc("size"), "node")).alias("k"))
    b = games.select(F.lit(1).alias("kind"), F.col("id").cast("string").alias("key"), F.row_number().over(Window.orderBy("tier", F.desc("reviews"), "id")).alias("k"))
    return a.unionByName(b).orderBy("kind", "k").limit(total)
