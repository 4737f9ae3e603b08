"""Cluster trees: closure, paths, roll-ups, labels against siblings, nesting, building.

Nodes are (node, parent), the root's parent is null; members are (item, node),
each item with its deepest node.  Closures are of nodes, never of items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parent tables of up to this many nodes are sent to every task; larger ones are closed by joins.
SENT_NODES = 200_000

#: Edges of spanning forests that one task takes, or four times as many as there are points.
MOST_EDGES = 4_000_000


def closure(nodes: DataFrame, most_depth: int = 100, sent: int = SENT_NODES) -> DataFrame:
    """(node, ancestor, hops), each node its own ancestor at 0; a climb ends after ``most_depth`` hops.

    A parent table of ``sent`` rows at most is broadcast and each node climbs in
    its own task.  Beyond that rounds of joins double the reach, each written
    before the next.
    """
    from ..plans.storage import stored

    spark = nodes.sparkSession
    known = nodes.select("node", "parent")
    held = known.limit(sent + 1).toPandas()
    if len(held) <= sent:
        parents = spark.sparkContext.broadcast({n: None if p is None or p != p else p for n, p in zip(held["node"].tolist(), held["parent"].astype(object).tolist())})

        def climb(batches):
            up = parents.value
            for pdf in batches:
                out: list = [[], [], []]
                for node in pdf["node"].tolist():
                    at, hops = node, 0
                    while at is not None and hops <= most_depth:
                        for c, v in zip(out, (node, at, hops)):
                            c.append(v)
                        at, hops = up.get(at), hops + 1
                        at = at if at in up else None  # a parent that is no node is no ancestor
                yield pd.DataFrame(dict(zip(("node", "ancestor", "hops"), out)))

        kind = nodes.schema["node"].dataType.simpleString()
        return known.select("node").mapInPandas(climb, f"node {kind}, ancestor {kind}, hops int")
    reach = known.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops"))
    step = known.join(known.select(F.col("node").alias("ancestor")), F.col("parent") == F.col("ancestor")).select("node", "ancestor", F.lit(1).alias("hops"))
    step, span = stored(step, "closure"), 1
    while span < most_depth:
        far = step.select(F.col("node").alias("m"), F.col("ancestor").alias("a"), F.col("hops").alias("h"))
        further = step.filter(F.col("hops") == span).join(far, F.col("ancestor") == F.col("m")).select("node", F.col("a").alias("ancestor"), (F.col("hops") + F.col("h")).alias("hops"))
        further = stored(further, "closure")
        if further.isEmpty():
            break
        step, span = stored(step.unionByName(further), "closure"), 2 * span
    return reach.unionByName(step.filter(F.col("hops") <= most_depth))


def paths(closed: DataFrame, names: DataFrame) -> DataFrame:
    """(node, path): names from the root down."""
    j = closed.join(names.select(F.col("node").alias("ancestor"), "name"), "ancestor")
    return j.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("o"), "name"))), lambda x: x["name"]), " > ").alias("path"))


def sizes(closed: DataFrame, members: DataFrame) -> DataFrame:
    """(node, size): items of the whole subtree."""
    own = members.groupBy("node").agg(F.count("*").alias("n"))
    return closed.join(own, "node", "left").groupBy(F.col("ancestor").alias("node")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("size"))


def tree_stats(nodes: DataFrame, closed: DataFrame, sized: DataFrame) -> DataFrame:
    """(depth, nodes, leaves, fan_out, biggest_share)."""
    depth = closed.groupBy("node").agg(F.max("hops").alias("depth"))
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    total = sized.agg(F.max("size").alias("total"))
    j = depth.join(kids, "node", "left").join(sized, "node").crossJoin(F.broadcast(total))
    return j.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if(F.col("children").isNull()).alias("leaves"), F.avg("children").alias("fan_out"), (F.max("size") / F.first("total")).alias("biggest_share"))


def branch_histogram(nodes: DataFrame) -> DataFrame:
    """(children, nodes): how many nodes have so many children; leaves have none."""
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    return nodes.select("node").join(kids, "node", "left").groupBy(F.coalesce("children", F.lit(0)).cast("long").alias("children")).agg(F.count("*").alias("nodes"))


def landing_depth(closed: DataFrame, members: DataFrame) -> DataFrame:
    """(depth, items): at what depth items' own nodes lie."""
    depth = closed.groupBy("node").agg(F.max("hops").alias("depth"))
    return members.groupBy("node").agg(F.count("*").alias("n")).join(depth, "node").groupBy("depth").agg(F.sum("n").alias("items"))


def transition_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation").agg(F.count("*").alias("nodes"))


def repeat_rate(nodes: DataFrame, terms: DataFrame, first: int = 3) -> DataFrame:
    """(checked, repeats, rate): nodes that share one of their first terms with one of their parent's."""
    tops = terms.filter(F.col("k") <= first).groupBy("node").agg(F.collect_set("term").alias("own"))
    above = tops.withColumnsRenamed({"node": "parent", "own": "up"})
    j = nodes.filter("parent IS NOT NULL").join(above, "parent").join(tops, "node", "left")
    return j.agg(F.count("*").alias("checked"), F.count_if(F.coalesce(F.arrays_overlap("own", "up"), F.lit(False))).alias("repeats")).withColumn("rate", F.try_divide(F.col("repeats"), F.col("checked")))


def leaf_owner(items: DataFrame, members: DataFrame, closed: DataFrame) -> DataFrame:
    """(item, node): each item's deepest holder; raises if an item has none."""
    depth = closed.groupBy("node").agg(F.max("hops").alias("d"))
    owner = members.join(depth, "node").groupBy("item").agg(F.max_by("node", F.struct("d", "node")).alias("node"))
    lost = items.select("item").join(owner, "item", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} items have no cluster")
    return owner


def territory_labels(nodes: DataFrame, closed: DataFrame, members: DataFrame) -> DataFrame:
    """(item, territory): place of the item's ancestor below the root among the root's children, -1 for the root's own."""
    root = nodes.filter("parent IS NULL").select(F.col("node").alias("r"))
    top = nodes.join(F.broadcast(root), F.col("parent") == F.col("r")).select(F.col("node").alias("ancestor"), (F.row_number().over(Window.partitionBy("r").orderBy("node")) - 1).alias("t"))
    below = closed.join(top, "ancestor").select("node", "t")
    return members.join(below, "node", "left").select("item", F.coalesce("t", F.lit(-1)).alias("territory"))


# -- condensed trees ---------------------------------------------------------------


def condensed_nodes(rows: DataFrame, points: int) -> DataFrame:
    """(node, parent, size, lam) of condensed rows (parent, child, lam, size).

    Children from ``points`` up are clusters, those below are points that fall
    out.  The root is the smallest parent of a cluster, or ``points``; its size
    is ``points`` and its parent null.
    """
    inner = rows.filter(F.col("child") >= points).select(F.col("child").alias("node"), "parent", "size", F.col("lam").cast("double").alias("lam"))
    root = inner.agg(F.coalesce(F.min("parent"), F.lit(points)).cast("long").alias("node"))
    return root.select("node", F.lit(None).cast("long").alias("parent"), F.lit(points).cast("long").alias("size"), F.lit(None).cast("double").alias("lam")).unionByName(inner.select(F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.col("size").cast("long").alias("size"), "lam"))


def condensed_members(rows: DataFrame, points: int) -> DataFrame:
    """(item, node, lam): the points of a condensed tree, with the cluster that they fall out of."""
    return rows.filter(F.col("child") < points).select(F.col("child").alias("item"), F.col("parent").alias("node"), F.col("lam").cast("double").alias("lam"))


def condensed_stats(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """(measure, key, n): branching and depth histograms, clusters below the root, their least and greatest size."""
    long = lambda c: F.col(c).cast("long")
    branching = branch_histogram(nodes).select(F.lit("branching").alias("measure"), long("children").alias("key"), long("nodes").alias("n"))
    depth = closed.groupBy("node").agg(F.max("hops").alias("depth")).groupBy("depth").agg(F.count("*").alias("n"))
    depth = depth.select(F.lit("depth").alias("measure"), long("depth").alias("key"), long("n").alias("n"))
    below = nodes.filter("parent IS NOT NULL")
    one = lambda name, value: below.agg(value.cast("long").alias("n")).select(F.lit(name).alias("measure"), F.lit(0).cast("long").alias("key"), "n")
    return branching.unionByName(depth).unionByName(one("clusters", F.count("*"))).unionByName(one("least", F.min("size"))).unionByName(one("greatest", F.max("size")))


def assign_noise(nodes: DataFrame, members: DataFrame, vectors: DataFrame, strategy: str = "soft") -> DataFrame:
    """(item, node, moved): with ``soft``, the root's own items go to the leaf of nearest centroid; with ``keep`` all stay.

    Centroids are means of the leaves' own items; ties go to the smaller node.
    Without a leaf that has items all stay.
    """
    from .neighbours import centroids, nearest_centroid

    if strategy not in ("soft", "keep"):
        raise ValueError(f"unknown strategy {strategy!r}; known: keep, soft")
    stay = members.select("item", "node", F.lit(False).alias("moved"))
    root = nodes.filter("parent IS NULL").select("node")
    leaves = nodes.select("node").join(nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("node")), "node", "left_anti").join(root, "node", "left_anti")
    held = members.join(leaves, "node")
    if strategy == "keep" or held.isEmpty():
        return stay
    v = vectors.select(F.col("id").alias("item"), "features")
    centres = centroids(held.join(v, "item").select(F.col("node").alias("label"), "features"))
    loose = members.join(root, "node", "left_semi").join(v, "item").select(F.col("item").alias("id"), "features")
    near = nearest_centroid(loose, centres).select(F.col("id").alias("item"), F.col("group").alias("node"), F.lit(True).alias("moved"))
    return stay.join(root, "node", "left_anti").select("item", "node", "moved").unionByName(near)


def condensed_tree(vectors: DataFrame, min_size: int = 25, min_samples: int = 5, most: int = 20_000, block: int | None = None) -> DataFrame:
    """Condensed rows (parent, child, lam, size) of density clustering: items by place in order of id, clusters from their number up.

    Mutual reachability distances, a minimum spanning tree, single linkage, and
    splits into parts of ``min_size``.  Up to ``most`` points one task does it
    all.  Beyond that blocks meet blocks, for the distances to near points and
    for spanning forests: an edge of the whole tree is one of the forest of the
    two blocks that it joins.  One task then has the edges, not the distances.
    Equal distances go by the places of their points, so the rows don't depend
    on the blocks.
    """
    from ..plans.storage import stored
    from .neighbours import block_pairs, placed

    n = vectors.count()
    schema = "parent long, child long, lam double, size long"
    if n <= most:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            m = np.stack([np.asarray(v, float) for v in pdf.sort_values("id")["features"]])
            return pd.DataFrame(_condensed(m, min_size, min_samples), columns=["parent", "child", "lam", "size"])

        return vectors.select("id", "features").groupBy(F.lit(1).alias("_one")).applyInPandas(run, schema)
    points, k = placed(vectors).select("place", "features"), min(min_samples, n)

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        same = a is b
        rows, cols = _nearest(np.stack(a["features"]), None if same else np.stack(b["features"]), k)
        sides = [(a["place"], rows)] if same else [(a["place"], rows), (b["place"], cols)]
        return pd.concat([pd.DataFrame({"place": p, "near": list(x)}) for p, x in sides])

    core = block_pairs(points, n, near, "place long, near array<double>", block).groupBy("place").agg(F.array_sort(F.flatten(F.collect_list("near")))[k - 1].alias("core"))
    points = stored(points.join(core, "place"), "core-distances")

    def forest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        same = a is b
        side = lambda x: (x["place"].to_numpy(), np.stack(x["features"]), x["core"].to_numpy())
        return pd.DataFrame(dict(zip("abd", _forest(side(a), None if same else side(b)))))

    edges = stored(block_pairs(points, n, forest, "a long, b long, d double", block), "forests")
    while (held := edges.count()) > max(MOST_EDGES, 4 * n):
        groups = -(-held // max(MOST_EDGES // 2, 2 * n))
        thinned = edges.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(groups))).applyInPandas(lambda pdf: pd.DataFrame(dict(zip("abd", _kruskal(*(pdf[c].to_numpy() for c in "abd"))))), edges.schema)
        edges = stored(thinned, "forests")

    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_condense(n, *_kruskal(*(pdf[c].to_numpy() for c in "abd")), min_size), columns=["parent", "child", "lam", "size"])

    return edges.groupBy(F.lit(1).alias("_one")).applyInPandas(condense, schema)


def _nearest(a: np.ndarray, b: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Squares of the k smallest distances of each row to the other block's, and of its rows to these; without ``b`` among themselves, 0 to itself."""
    from .neighbours import smallest, square_distances, tiles_of

    same, b = b is None, a if b is None else b
    rows: dict = {}
    cols: dict = rows if same else {}
    for i, j in tiles_of(len(a), len(b), same):
        d = square_distances(a[i], b[j])
        rows[i.start] = smallest(rows.get(i.start), d, k)
        if not same or i != j:
            cols[j.start] = smallest(cols.get(j.start), d.T, k)
    joined = lambda x: np.concatenate([x[at] for at in sorted(x)])
    return joined(rows), None if same else joined(cols)


def _forest(a: tuple, b: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, d), d squared, of the spanning forest of mutual reachability between two blocks (places, rows, squares of core distances), or within one."""
    from .neighbours import square_distances, tiles_of

    same, b, found = b is None, a if b is None else b, []
    for i, j in tiles_of(len(a[0]), len(b[0]), same):
        d = square_distances(a[1][i], b[1][j])
        np.maximum(d, a[2][i][:, None], out=d)
        np.maximum(d, b[2][j][None, :], out=d)
        found.append(_prim(d, a[0][i], None if same and i == j else b[0][j]))
    return _kruskal(*(np.concatenate(x) for x in zip(*found)))


def _prim(d: np.ndarray, rows: np.ndarray, cols: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, d) of the spanning tree of the points ``rows`` (all pairs of them) or of ``rows`` against ``cols``; a is below b.

    Places ascend, those of ``cols`` are above those of ``rows``.  Of equal
    distances the edge of smaller places counts as shorter.
    """
    p = len(rows)
    names = rows if cols is None else np.concatenate([rows, cols])
    far = d if cols is None else np.ascontiguousarray(d.T)
    best, link, left = np.full(len(names), np.inf), np.full(len(names), -1), np.ones(len(names), bool)
    at, out = 0, []
    left[0] = False
    for _ in range(len(names) - 1):
        if cols is None:
            reach, to = d[at], slice(0, p)
        elif at < p:
            reach, to = d[at], slice(p, None)
        else:
            reach, to = far[at - p], slice(0, p)
        known, by, free = best[to], link[to], left[to]
        nearer = ((reach < known) | ((reach == known) & (at < by))) & free
        known[nearer], by[nearer] = reach[nearer], at
        at = int(np.argmin(best))
        ties = np.flatnonzero(best == best[at])
        if len(ties) > 1:
            low = np.minimum(link[ties], ties)
            ties = ties[low == low.min()]
            at = int(ties[np.argmin(np.maximum(link[ties], ties))])
        out.append((link[at], at, best[at]))
        best[at], left[at] = np.inf, False
    x, y, w = (np.array([e[c] for e in out], kind) for c, kind in enumerate((int, int, float)))
    return names[np.minimum(x, y)], names[np.maximum(x, y)], w


def _kruskal(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the edges that a spanning forest of them needs, by (d, a, b)."""
    order = np.lexsort((b, a, d))
    a, b, d = a[order], b[order], d[order]
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, kept = list(range(len(names))), []

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist())):
        x, y = find(x), find(y)
        if x != y:
            up[y] = x
            kept.append(k)
            if len(kept) == len(names) - 1:
                break
    return a[kept], b[kept], d[kept]


def _condensed(m: np.ndarray, min_size: int, min_samples: int) -> list[tuple[int, int, float, int]]:
    k = min(min_samples, len(m))
    core = np.partition(_nearest(m, None, k)[0], k - 1, axis=1)[:, k - 1]
    return _condense(len(m), *_forest((np.arange(len(m)), m, core), None), min_size)


def _condense(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, min_size: int) -> list[tuple[int, int, float, int]]:
    """Condensed rows of a spanning tree over ``n`` points, whose edges come in order, distances squared."""
    # Single linkage: joined groups are numbered from n up.
    up, size, kids = list(range(n)), [1] * n, {}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    top = {i: i for i in range(n)}
    for x, y, w in zip(a.tolist(), b.tolist(), np.sqrt(d).tolist()):
        x, y = find(x), find(y)
        node = n + len(kids)
        kids[node] = (top[x], top[y], w)
        size.append(size[top[x]] + size[top[y]])
        up[y] = x
        top[x] = node
    # From the root down: a split into two large parts makes clusters, small parts fall out.
    rows, number = [], n
    todo = [(n + len(kids) - 1, n)] if n > 1 else []

    def points(node):
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                yield x
            else:
                stack += kids[x][:2]

    while todo:
        node, cluster = todo.pop()
        if node < n:
            rows.append((cluster, node, float("inf"), 1))
            continue
        a, b, d = kids[node]
        lam = 1 / d if d > 0 else float("inf")
        large = [x for x in (a, b) if size[x] >= min_size]
        for x in (a, b):
            if x not in large:
                rows += [(cluster, p, lam, 1) for p in points(x)]
        if len(large) == 2:
            for x in large:
                number += 1
                rows.append((cluster, number, lam, size[x]))
                todo.append((x, number))
        elif large:
            todo.append((large[0], cluster))
    return rows


def coverage(closed: DataFrame, members: DataFrame, profile: DataFrame, most: int = 20) -> DataFrame:
    """(node, term, coverage): share of a subtree's items that carry the term among their first tags."""
    tagged = profile.filter(F.col("rank") < most).select("item", F.col("tag").alias("term")).join(members, "item")
    own = tagged.groupBy("node", "term").agg(F.count("*").alias("n"))  # items hold one node: partial sums stay small
    n = closed.join(own, "node").groupBy(F.col("ancestor").alias("node"), "term").agg(F.sum("n").alias("n"))
    return n.join(sizes(closed, members), "node").select("node", "term", (F.col("n") / F.col("size")).alias("coverage"))


def sibling_terms(nodes: DataFrame, covered: DataFrame, top: int = 10) -> DataFrame:
    """(node, k, term, score, coverage, rest): score against the mean coverage of the siblings, those without counting 0."""
    kids = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("siblings"))
    own = covered.join(nodes.filter("parent IS NOT NULL"), "node").join(kids, "parent")
    total = F.sum("coverage").over(Window.partitionBy("parent", "term"))
    rest = (total - F.col("coverage")) / F.when(F.col("siblings") > 1, F.col("siblings") - 1)
    e = 1e-3
    score = F.when(F.col("siblings") == 1, F.col("coverage")).otherwise(F.col("coverage") * F.log((F.col("coverage") + e) / (F.col("rest") + e)))
    # Sums of other rows' doubles leave dust where there is nothing left.
    scored = own.withColumn("rest", F.when(F.abs(rest) < 1e-12, 0.0).otherwise(rest)).withColumn("score", F.round(score, 9))
    w = Window.partitionBy("node").orderBy(F.desc("score"), "term")
    return scored.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top).select("node", "k", "term", "score", "coverage", "rest")


def label_quality(terms: DataFrame, phrase_terms: int = 3) -> DataFrame:
    """(node, label, coverage, lift, confidence) from the top term and the first positive ones."""
    lift = F.when(F.col("rest").isNull() | (F.col("rest") <= 1e-9), 999.0).otherwise(F.least(F.col("coverage") / F.col("rest"), F.lit(999.0)))
    first = terms.filter("k = 1").select("node", F.round("coverage", 4).alias("coverage"), F.round(lift, 3).alias("lift"))
    tier = F.when(F.col("coverage") < 0.25, "none").when(F.col("lift") >= 4, "strong").when(F.col("lift") >= 2, "normal").otherwise("weak")
    words = terms.filter(F.col("score") > 0).withColumn("p", F.row_number().over(Window.partitionBy("node").orderBy("k"))).filter(F.col("p") <= phrase_terms)
    named = words.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), " / ").alias("label"))
    return first.join(named, "node", "left").select("node", F.coalesce("label", F.lit("unnamed")).alias("label"), "coverage", "lift", tier.alias("confidence"))


def path_relation(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(node, relation): a child's top term against its parent's: repeat, refinement or novel."""
    tops = terms.filter("k = 1").select("node", F.col("term").alias("top"))
    lists = terms.groupBy("node").agg(F.collect_set("term").alias("terms"))
    j = nodes.filter("parent IS NOT NULL").join(tops, "node").join(tops.select(F.col("node").alias("parent"), F.col("top").alias("ptop")), "parent").join(lists.select(F.col("node").alias("parent"), "terms"), "parent")
    return j.select("node", F.when(F.col("top") == F.col("ptop"), "repeat").when(F.array_contains("terms", F.col("top")), "refinement").otherwise("novel").alias("relation"))


def nesting(fine: DataFrame, coarse: DataFrame, straddle: float = 0.9) -> DataFrame:
    """(fine, coarse, purity, straddles): each fine group in the coarse one that most of its items have."""
    f = fine.groupBy("fine").agg(F.count("*").alias("n"))
    both = fine.join(coarse, "item").groupBy("fine", "coarse").agg(F.count("*").alias("c"))
    best = both.groupBy("fine").agg(F.max(F.struct(F.col("c"), (-F.col("coarse")).alias("g"))).alias("m"))
    return f.join(best, "fine", "left").select("fine", (-F.col("m.g")).alias("coarse"), (F.coalesce("m.c", F.lit(0)) / F.col("n")).alias("purity"), (F.coalesce("m.c", F.lit(0)) / F.col("n") < straddle).alias("straddles"))


def nearest_kept(closed: DataFrame, kept: DataFrame) -> DataFrame:
    """(node, kept): the closest ancestor that stays, itself included."""
    j = closed.join(kept.select(F.col("node").alias("ancestor")), "ancestor")
    return j.groupBy("node").agg(F.min_by("ancestor", "hops").alias("kept"))


def validate_manifest(nodes: DataFrame) -> DataFrame:
    """(node, problem): missing fields, dangling parents, boxes and centroids of the wrong size, cycles.

    A node that lacks a field (a column, or its value) is judged by nothing else but cycles.
    """
    lost = [c for c in ("node", "parent") if c not in nodes.columns]
    if lost:
        raise ValueError(f"a manifest needs the fields {', '.join(lost)}")
    kinds = {"label": "string", "bbox": "array<double>", "centroid": "array<double>", "size": "long"}
    nodes = nodes.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in nodes.columns})
    gone = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in kinds])
    absent = nodes.filter(gone != "").select("node", F.concat(F.lit("missing "), gone).alias("problem"))
    whole = nodes.filter(gone == "")
    parent = whole.filter("parent IS NOT NULL").join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", F.concat(F.lit("parent "), F.col("parent").cast("string"), F.lit(" not in manifest")).alias("problem"))
    box = whole.filter(F.size("bbox") != 4).select("node", F.lit("bbox is not 4 numbers").alias("problem"))
    mid = whole.filter(F.size("centroid") != 2).select("node", F.lit("centroid is not 2 numbers").alias("problem"))
    known = nodes.select("node", "parent")
    rooted = known.filter("parent IS NULL").select("node")
    loose = nodes.filter("parent IS NOT NULL").join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("node")
    reach, count = rooted.union(loose), -1
    for _ in range(100):  # a level of the tree each
        more = known.join(reach.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").union(reach).distinct()
        n = more.count()
        if n == count:
            break
        reach, count = more, n
    cycle = known.join(reach, "node", "left_anti").select("node", F.lit("cycle").alias("problem"))
    return parent.unionByName(box).unionByName(mid).unionByName(cycle).unionByName(absent)


# -- building trees ---------------------------------------------------------------


def _communities(m: np.ndarray, k: int, resolution: float, seed: int) -> np.ndarray:
    """Modularity communities of a group's own neighbour graph: moves to a fixed point, then merged groups again."""
    n = len(m)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    edges: dict[tuple[int, int], float] = {}
    for at in range(0, n, 1024):
        sims = m[at : at + 1024] @ m.T
        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -np.inf
        near = np.argpartition(-sims, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
        for i, row in enumerate(near):
            for j in row.tolist():
                w = float(sims[i, j])
                if w > 0:
                    e = (min(at + i, j), max(at + i, j))
                    edges[e] = max(edges.get(e, 0.0), w)
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        graph[a][b] = graph[b][a] = w
    return _settled(graph, np.zeros(n), resolution, seed)


def _settled(graph: list[dict[int, float]], own: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """Communities of a weighted graph whose nodes have weights of their ``own``: moves, merging, and again."""
    names = np.arange(len(graph))
    while True:
        size = len(graph)
        degree = np.array([sum(g.values()) for g in graph]) + 2 * own
        total = degree.sum() or 1.0
        group, held = list(range(size)), degree.copy()
        order = np.random.default_rng(seed).permutation(size).tolist()
        moved = any_move = True
        any_move = False
        while moved:
            moved = False
            for i in order:
                links: dict[int, float] = {}
                for j, w in graph[i].items():
                    links[group[j]] = links.get(group[j], 0.0) + w
                g = group[i]
                held[g] -= degree[i]
                gain = lambda c: links.get(c, 0.0) - resolution * degree[i] * held[c] / total  # noqa: B023, E731
                best = max(sorted(links), key=gain, default=g)
                if best != g and gain(best) > gain(g) + 1e-12:
                    group[i], moved, any_move = best, True, True
                held[group[i]] += degree[i]
        labels, index = np.unique(group, return_inverse=True)
        names = index[names]
        if not any_move:
            return names
        merged: list[dict[int, float]] = [{} for _ in labels]
        inner = np.zeros(len(labels))
        np.add.at(inner, index, own)
        for i, g in enumerate(graph):
            for j, w in g.items():
                if index[i] == index[j]:
                    inner[index[i]] += w / 2
                else:
                    merged[index[i]][index[j]] = merged[index[i]].get(index[j], 0.0) + w
        graph, own = merged, inner


#: Groups of up to this many vectors are split in one task; larger ones by jobs over all tasks.
TASK_ROWS = 100_000


def _split_levels(vectors: DataFrame, split, min_split: int, min_size: int, max_depth: int, large=None, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): level by level, all groups of a depth that fit a task in one grouped pass.

    Groups over ``task_rows`` are split by ``large(items)``, (item, part) of
    (item, features), a few at each level.  Groups under ``min_size`` stay with
    the parent; fewer than two kept: a leaf.  Sizes of nodes alone reach the driver.
    """
    from ..plans.storage import stored

    now = stored(vectors.select("item", "features").withColumn("node", F.lit("0")), "level")
    nodes, held = [("0", None, 0)], []
    schema = "item long, features array<double>, node string, part int"
    for depth in range(max_depth):
        sized = stored(now.groupBy("node").agg(F.count("*").alias("n")), "sizes")
        big = sized.filter(F.col("n") >= min_split).select("node", "n")
        held.append(now.join(big, "node", "left_anti").select("item", "node"))
        if big.isEmpty():
            now = None
            break
        fit = big.filter(F.col("n") <= task_rows) if large else big
        parts = [now.join(fit.select("node"), "node").groupBy("node").applyInPandas(lambda pdf: _parts(pdf, split, min_size), schema)]
        for r in big.filter(F.col("n") > task_rows).orderBy("node").collect() if large else []:  # rows / task_rows at most
            mine = stored(now.filter(F.col("node") == r["node"]), "large-group")
            part = stored(large(mine.select("item", "features")), "large-parts")
            kept = part.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
            number = kept.select("part", (F.row_number().over(Window.orderBy("part")) - 1).cast("int").alias("number"))  # parts of one group
            enough = kept.limit(2).count() == 2
            named = part.join(number, "part", "left").select("item", F.coalesce("number", F.lit(-1)).alias("part") if enough else F.lit(-1).alias("part"))
            parts.append(mine.join(named, "item").select("item", F.transform("features", lambda x: x.cast("double")).alias("features"), "node", "part"))
        made = parts[0]
        for more in parts[1:]:
            made = made.unionByName(more)
        made = stored(made, "level")
        kept = {(r["node"], r["part"]) for r in made.filter("part >= 0").select("node", "part").distinct().collect()}
        nodes += [(f"{n}.{p}", n, depth + 1) for n, p in sorted(kept)]
        held.append(made.filter("part < 0").select("item", "node"))
        now = made.filter("part >= 0").select("item", "features", F.concat_ws(".", "node", F.col("part").cast("string")).alias("node"))
    if now is not None:
        held.append(now.select("item", "node"))
    members = held[0]
    for h in held[1:]:
        members = members.unionByName(h)
    return vectors.sparkSession.createDataFrame(nodes, "node string, parent string, depth int"), members


def kmeans_parts(items: DataFrame, k: int, seed: int = 0, rounds: int = 20, sample: int = 20_000) -> DataFrame:
    """(item, part) by spherical k-means over all tasks; a round moves k centroids, no more, to and from the driver."""
    first = items.select("item", "features").orderBy(F.xxhash64("item", F.lit(seed)), "item").limit(sample).toPandas()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    m = unit(np.array([np.asarray(v, float) for v in first["features"]]))
    part = _kmeans(m, k, seed)
    c = unit(np.stack([m[part == j].sum(axis=0) for j in np.unique(part)]))
    spark = items.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(c)

        def run(batches, sent=sent):
            sums, counts = np.zeros_like(sent.value), np.zeros(len(sent.value))
            for pdf in batches:
                x = unit(np.array([np.asarray(v, float) for v in pdf["features"]]).reshape(len(pdf), -1))
                at = np.argmax(x @ sent.value.T, axis=1) if len(x) else np.zeros(0, int)
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=len(counts))
            yield pd.DataFrame({"sums": [sums.tobytes()], "counts": [counts.tobytes()]})

        total = items.select("features").mapInPandas(run, "sums binary, counts binary").rdd.map(lambda r: (np.frombuffer(r["sums"]).copy(), np.frombuffer(r["counts"]).copy())).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        sums, counts = total[0].reshape(c.shape), total[1]
        new = np.where(counts[:, None] > 0, unit(sums), c)
        done = np.abs(new - c).max() < 1e-6
        c = new
        if done:
            break
    sent = spark.sparkContext.broadcast(c)

    def place(batches):
        for pdf in batches:
            x = unit(np.array([np.asarray(v, float) for v in pdf["features"]]).reshape(len(pdf), -1))
            yield pd.DataFrame({"item": pdf["item"], "part": np.argmax(x @ sent.value.T, axis=1).astype("int32") if len(x) else np.zeros(0, "int32")})

    return items.select("item", "features").mapInPandas(place, "item long, part int")


def community_parts(items: DataFrame, k: int = 20, resolution: float = 1.0, seed: int = 0, rounds: int = 20, task_rows: int = TASK_ROWS) -> DataFrame:
    """(item, part): modularity communities of the neighbour graph over all tasks.

    Half of the nodes, by a hash of node and round, may move in a round, each to
    the neighbouring community of most gain.  When few move, communities become
    nodes; a merged graph of ``task_rows`` edges at most is settled on the driver.
    """
    from ..plans.storage import stored
    from .neighbours import knn_cosine, knn_graph, knn_index

    v = items.select(F.col("item").alias("id"), "features")
    near = knn_index(v, k) if items.count() > TASK_ROWS else knn_cosine(v, k)
    half = stored(knn_graph(near), "edges")
    names = stored(items.select(F.col("item").alias("node"), F.col("item").alias("name")), "names")
    inner = None
    while True:
        both = half.select("a", "b", "w").unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"))
        if inner is not None:
            degree = degree.join(inner, "node", "full_outer").select("node", (F.coalesce("d", F.lit(0.0)) + 2 * F.coalesce("own", F.lit(0.0))).alias("d"))
        degree = stored(degree, "degrees")
        total = degree.agg(F.sum("d")).first()[0] or 1.0
        label = stored(degree.select("node", F.col("node").alias("g"), "d"), "labels")
        size, moved_any = label.count(), False
        for r in range(rounds):
            held = label.groupBy("g").agg(F.sum("d").alias("held"))
            links = both.join(label.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node"), "g").agg(F.sum("w").alias("w"))
            own = label.select("node", F.col("g").alias("now"), "d")
            cand = links.join(held, "g").join(own, "node")
            inside = F.when(F.col("g") == F.col("now"), F.col("d")).otherwise(0.0)
            gain = F.col("w") - resolution * F.col("d") * (F.col("held") - inside) / total
            best = cand.select("node", "now", "d", "g", gain.alias("gain")).groupBy("node", "now", "d").agg(F.max_by(F.struct("g", "gain"), F.struct(F.round("gain", 12), -F.col("g"))).alias("best"), F.max(F.when(F.col("g") == F.col("now"), F.col("gain"))).alias("stay"))
            alone = best.join(held, F.col("now") == F.col("g"), "left").select("node", "now", "d", "best", F.coalesce("stay", -resolution * F.col("d") * (F.col("held") - F.col("d")) / total).alias("stay"))
            turn = F.pmod(F.xxhash64("node", F.lit(r), F.lit(seed)), F.lit(2)) == 0
            better = turn & (F.col("best.gain") > F.col("stay") + 1e-12)
            after = alone.select("node", F.when(better, F.col("best.g")).otherwise(F.col("now")).alias("g"), "d", better.alias("moved"))
            lone = own.join(links.select("node").distinct(), "node", "left_anti").select("node", F.col("now").alias("g"), "d", F.lit(False).alias("moved"))
            label = stored(after.unionByName(lone), "labels")
            moved = label.filter("moved").count()
            label = label.select("node", "g", "d")
            moved_any = moved_any or moved > 0
            if moved * 1000 < size and r % 2:
                break
        groups = label.select(F.col("node").alias("name"), F.col("g").alias("to"))
        names = stored(names.join(groups, "name", "left").select("node", F.coalesce("to", "name").alias("name")), "names")
        g = label.select("node", "g")
        ends = half.join(g.withColumnsRenamed({"node": "a", "g": "ga"}), "a").join(g.withColumnsRenamed({"node": "b", "g": "gb"}), "b")
        loops = ends.filter("ga = gb").groupBy(F.col("ga").alias("node")).agg(F.sum("w").alias("own"))
        if inner is not None:
            loops = loops.unionByName(inner.join(g, "node").groupBy(F.col("g").alias("node")).agg(F.sum("own").alias("own"))).groupBy("node").agg(F.sum("own").alias("own"))
        inner = stored(loops, "loops")
        half = stored(ends.filter("ga <> gb").groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("w").alias("w")), "edges")
        if half.limit(task_rows + 1).count() <= task_rows or not moved_any:
            break
    if half.limit(task_rows + 1).count() <= task_rows:
        rows, loops = half.toPandas(), {r["node"]: r["own"] for r in inner.join(half.select(F.col("a").alias("node")).union(half.select("b")).distinct(), "node").collect()}
        ids = sorted(set(rows["a"]) | set(rows["b"]))
        at = {n: i for i, n in enumerate(ids)}
        graph: list[dict[int, float]] = [{} for _ in ids]
        for a, b, w in rows.itertuples(index=False):
            graph[at[a]][at[b]] = graph[at[b]][at[a]] = w
        if ids:
            settled = _settled(graph, np.array([loops.get(n, 0.0) for n in ids]), resolution, seed)
            final = items.sparkSession.createDataFrame([(int(n), int(ids[int(np.flatnonzero(settled == settled[i])[0])])) for i, n in enumerate(ids)], "name long, to long")
            names = names.join(final, "name", "left").select("node", F.coalesce("to", "name").alias("name"))
    number = names.select("name").distinct().select("name", (F.dense_rank().over(Window.orderBy("name")) - 1).cast("int").alias("part"))  # a row a community
    return names.join(number, "name").select(F.col("node").alias("item"), "part")


def _parts(pdf: pd.DataFrame, split, min_size: int) -> pd.DataFrame:
    pdf = pdf.sort_values("item")
    part = split(np.array([np.asarray(v, float) for v in pdf["features"]]))
    labels, index, counts = np.unique(part, return_inverse=True, return_counts=True)
    kept = counts >= min_size
    number = np.where(kept, np.cumsum(kept) - 1, -1)
    out = number[index] if kept.sum() >= 2 else np.full(len(pdf), -1)
    return pdf.assign(part=out.astype("int32"))[["item", "features", "node", "part"]]


def community_tree(vectors: DataFrame, k: int = 20, resolution: float = 1.0, max_depth: int = 5, min_split: int = 120, min_size: int = 30, seed: int = 0, task_rows: int = TASK_ROWS):
    return _split_levels(vectors, lambda m: _communities(m, k, resolution, seed), min_split, min_size, max_depth, lambda v: community_parts(v, k, resolution, seed), task_rows)


def _kmeans(m: np.ndarray, k: int, seed: int, rounds: int = 30) -> np.ndarray:
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    c = m[np.random.default_rng(seed).choice(len(m), min(k, len(m)), replace=False)]
    part = np.zeros(len(m), int)
    for _ in range(rounds):
        new = np.argmax(m @ c.T, axis=1)
        if (new == part).all():
            break
        part = new
        for j in range(len(c)):
            if (part == j).any():
                v = m[part == j].sum(axis=0)
                c[j] = v / max(np.linalg.norm(v), 1e-9)
    return part


def kmeans_tree(vectors: DataFrame, k: int = 8, max_depth: int = 5, min_leaf: int = 30, min_split: int = 120, seed: int = 0, task_rows: int = TASK_ROWS):
    return _split_levels(vectors, lambda m: _kmeans(m, max(2, min(k, len(m) // min_leaf)), seed), min_split, min_leaf, max_depth, lambda v: kmeans_parts(v, k, seed), task_rows)


def silhouette(m: np.ndarray, part: np.ndarray, sample: int = 3000, seed: int = 0) -> float:
    """Mean silhouette by Euclidean distance, over a sample of ``sample`` rows (all of fewer).

    Of each row: the mean distance to the rows of its own part, and to those of
    the part where that is least; their difference over the larger one.
    """
    if len(m) > sample:
        rows = np.sort(np.random.default_rng(seed).choice(len(m), sample, replace=False))
        m, part = m[rows], part[rows]
    labels, at, counts = np.unique(part, return_inverse=True, return_counts=True)
    if len(labels) < 2:
        return -1.0
    sq, total, found = (m * m).sum(axis=1), np.eye(len(labels))[at], []
    for lo in range(0, len(m), 512):
        d = np.sqrt(np.maximum(sq[lo : lo + 512, None] + sq[None, :] - 2 * m[lo : lo + 512] @ m.T, 0))
        d[np.arange(len(d)), lo + np.arange(len(d))] = 0
        sums, own = d @ total, at[lo : lo + 512]
        rows = np.arange(len(d))
        a = sums[rows, own] / np.maximum(counts[own] - 1, 1)
        means = sums / counts
        means[rows, own] = np.inf
        b = means.min(axis=1)
        found.append(np.where(counts[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0))
    return float(np.concatenate(found).mean())


def bic_split(m: np.ndarray, part: np.ndarray) -> float:
    """Bayes information of the parts as spherical Gaussians of one variance, less that of one Gaussian."""
    n, d = m.shape

    def information(p):
        labels, at, counts = np.unique(p, return_inverse=True, return_counts=True)
        centres = np.stack([m[at == j].mean(axis=0) for j in range(len(labels))])
        variance = ((m - centres[at]) ** 2).sum() / max(n - len(labels), 1) / max(d, 1)
        if variance <= 0:
            return -np.inf
        fit = (counts * np.log(counts / n) - counts * d / 2 * np.log(2 * np.pi * variance) - (counts - 1) * d / 2).sum()
        return fit - len(labels) * (d + 1) / 2 * np.log(n)

    if len(np.unique(part)) < 2 or n <= len(np.unique(part)):
        return -np.inf
    return float(information(part) - information(np.zeros(n, int)))


def gated_tree(vectors: DataFrame, k_min: int = 2, k_max: int = 12, max_depth: int = 6, min_leaf: int = 30, min_split: int = 120, threshold: float = 0.03, tolerance: float = 0.85, seed: int = 0, criterion: str = "silhouette"):
    """K-means with the number of parts chosen by ``criterion``, silhouette or bic: the largest within ``tolerance`` of the best, or no split."""
    score = {"silhouette": silhouette, "bic": bic_split}[criterion]

    def split(m):
        tried = {}
        for k in range(k_min, min(k_max, len(m) // min_leaf) + 1):
            part = _kmeans(m, k, seed)
            counts = np.unique(part, return_counts=True)[1]
            if len(counts) == k and counts.min() >= min_leaf:
                tried[k] = (score(m, part), part)
        best = max((s for s, _ in tried.values()), default=-1.0)
        if not tried or best < threshold:
            return np.zeros(len(m), int)
        return tried[max(k for k, (s, _) in tried.items() if s >= tolerance * best)][1]

    return _split_levels(vectors, split, min_split, min_leaf, max_depth)


def collapse(nodes: list[tuple[int, int | None, int]], min_branch: int, spine_ratio: float = 0.5, max_depth: int = 6) -> list[tuple[int, int | None, int]]:
    """Simplify a condensed tree of (node, parent, size); the node table alone, which is small.

    A child with ``spine_ratio`` of the size of the node that is being divided
    is that node's own mass: its children stand in its place, at any depth, and
    without children it is no branch.  Children under ``min_branch`` are left
    out.  Where one child is left, its branches take its place if it has any.
    Depth is capped.
    """
    kids: dict = {}
    size = {n: s for n, _, s in nodes}
    root = next(n for n, p, _ in nodes if p is None)
    for n, p, _ in nodes:
        kids.setdefault(p, []).append(n)

    def branches(n):
        spine, todo, out = spine_ratio * max(size[n], 1), list(kids.get(n, [])), []
        while todo:
            c = todo.pop()
            if size[c] >= spine:
                todo += kids.get(c, [])
            elif size[c] >= min_branch:
                out.append(c)
        return sorted(out, key=lambda c: (-size[c], c))

    kept, todo = [(root, None, size[root])], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if depth >= max_depth:
            continue
        found = branches(node)
        while len(found) == 1 and (below := branches(found[0])):
            found = below
        for c in found:
            kept.append((c, node, size[c]))
            todo.append((c, depth + 1))
    return kept
