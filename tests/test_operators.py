import ast
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartolith.functions import scalar
from cartolith.operators import catalog, hierarchy, layout, neighbours, tiles, view
from cartolith.sources import tables
from cartolith.streaming import ingest

# By the published rule: "benchmark" and "soundtrack" drop a name anywhere, "wallpaper" only as a whole word, "beta" and "trailer" not alone.
KEEP = ["Movie Studio Tycoon", "The DLC Conspiracy", "Artwork Thief", "Trailer Park Racing", "Demolition Derby", "Beta Colony", "Wolf Wallpapers", "Storm [Beta]", "Dune Trailer"]
DROP = ["Space Rally Demo", "Moon Farm - Soundtrack", "River City (DLC)", "Harbour OST", "Castle Playtest", "Iron Fleet Season Pass", "Old Town Artbook", "Sky Teaser", "Grid Test Server", "Benchmark Mountain Rally", "Soundtrack of Silence"]


@pytest.mark.parametrize("name,want", [(n, None) for n in KEEP] + [(n, "name_pattern") for n in DROP])
def test_name_filter(spark, name, want):
    df = spark.createDataFrame([(name,)], "name string")
    got = df.select(catalog.drop_reason(F.col("name"), F.array(F.lit("Action")), F.lit(10), ["Utilities"]).alias("r")).first()["r"]
    assert got == want


@pytest.mark.parametrize("name,genres,reviews,want", [("A", ["x"], 9, "few_reviews"), ("A", ["x"], 10, None), ("A", ["soft", "ware"], 99, "software_genre"), ("A", ["soft", "x"], 99, None), ("", ["x"], 99, "no_name"), (None, [], 0, "no_name"), ("A", [], None, "few_reviews")])
def test_drop_rules(spark, name, genres, reviews, want):
    df = spark.createDataFrame([(name, genres, reviews)], "n string, g array<string>, r int")
    assert df.select(catalog.drop_reason(F.col("n"), F.col("g"), F.col("r"), ["soft", "ware"]).alias("x")).first()["x"] == want


def test_parse_tags(spark):
    rows = [("a, b ,,c",), ("",), ("[]",), (None,), ("{'Indie': 10, 'Maze': 99}",), ("['x', 'y']",), ("{broken",)]
    got = [r["t"] for r in spark.createDataFrame(rows, "v string").select(scalar.parse_tags(F.col("v")).alias("t")).collect()]
    assert got == [["a", "b", "c"], [], [], [], ["Maze", "Indie"], ["x", "y"], []]


def test_tile_codec_round_trip():
    p = pd.DataFrame({"x": np.float32([1, 2]), "y": np.float32([3, 4]), "id": [7, 2**32 - 1], "category": [0, 5], "importance": [65535, 0]})
    for inter in (False, True):
        assert (tables.decode_tile(tables.encode_tile(p, interleaved=inter)).to_numpy() == p.to_numpy()).all()
    assert len(tables.decode_tile(tables.encode_tile(p.iloc[:0]))) == 0
    with pytest.raises(ValueError):
        tables.decode_tile(b"x" * 40)


def test_neighbour_codec():
    d = pd.DataFrame({"dst": [1, 2, 3, 4]})
    assert tables.decode_neighbours(tables.encode_neighbours(d, 2)).tolist() == [[1, 2], [3, 4]]


def box(spark, *v):
    return spark.createDataFrame([tuple(map(float, v))], "minx double, miny double, maxx double, maxy double")


def test_viewport_case(spark):
    got = tiles.viewport_tiles(box(spark, 0, 0, 8, 8), 2, (0.1, 0.1, 3.9, 3.9))
    assert {(r.tx, r.ty) for r in got.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_pyramid_invariants(spark):
    p = tiles.importance_rank(tables.synthetic_points(spark, 3000, 20, 5))
    pyr = tiles.tile_pyramid(p, 3, 50, 4).cache()
    assert pyr.filter("is_leaf").groupBy("id").count().filter("count <> 1").isEmpty() and pyr.filter("is_leaf").count() == 3000
    assert pyr.filter("NOT is_leaf").groupBy("z", "tx", "ty").count().agg(F.max("count")).first()[0] <= 50
    b = tiles.root_box(p)
    naive = tiles.tile_pyramid(p, 3, 50, 4, "naive")
    a, n = ({r.z: r.cells for r in tiles.occupancy(x, b, 16).collect()} for x in (pyr, naive))
    assert a[0] >= n[0]
    with pytest.raises(ValueError):
        tiles.tile_pyramid(p, 1, 10, 4, "other")


def test_rank_of_one_and_none(spark):
    one = spark.createDataFrame([(1, 5.0)], "id long, importance double")
    assert tiles.importance_rank(one).first()["importance"] == 65535
    assert tiles.importance_rank(one.limit(0)).count() == 0


def test_blocked_knn_equals_broadcast(spark):
    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(60)], "id long, features array<double>")
    a = neighbours.knn_cosine(v, 5).select("src", "dst", "rank").toPandas()
    b = neighbours.knn_cosine(v, 5, broadcast_bytes=0, block_rows=16).select("src", "dst", "rank").toPandas()
    key = ["src", "rank"]
    assert a.sort_values(key).values.tolist() == b.sort_values(key).values.tolist() and (a.src != a.dst).all()


def test_hull_and_collapse():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)
    planes = layout.hull(square)
    assert len(planes) == 4 and all(a * 1 + b * 1 + c <= 1e-9 for a, b, c in planes) and any(a * 3 + b + c > 0 for a, b, c in planes)
    assert layout.hull(square[:2]) is None and layout.hull(np.array([[0, 0], [1, 1], [2, 2], [3, 3]], float)) is None
    tree = [(0, None, 100), (1, 0, 90), (2, 0, 10), (3, 1, 40), (4, 1, 35), (5, 3, 5)]
    assert hierarchy.collapse(tree, 10) == [(0, None, 100), (3, 0, 40), (4, 0, 35), (2, 0, 10)]


def test_community_tree_invariants(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(4, 8)) * 5
    v = spark.createDataFrame([(i, (centres[i % 4] + r.normal(size=8)).tolist()) for i in range(240)], "item long, features array<double>")
    nodes, members = hierarchy.community_tree(v, k=10)
    m = members.toPandas()
    assert sorted(m["item"]) == list(range(240)) and m.groupby(m["item"] % 4)["node"].nunique().max() == 1
    assert nodes.filter("depth = 1").count() >= 2


def test_gated_tree_without_a_split(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)], "item long, features array<double>")
    nodes, members = hierarchy.gated_tree(v, threshold=-1.0)
    assert nodes.count() == 1 and members.count() == 120


def test_gated_tree_query_takes_the_defaults(spark, monkeypatch):
    from cartolith.plans import registry

    given, tree = [], hierarchy.gated_tree
    monkeypatch.setattr(hierarchy, "gated_tree", lambda *a, **k: given.append((len(a), k)) or tree(*a, **k))
    assert registry.QUERIES["gated_tree"](spark, "/root/testdata/sf0.001").count() >= 1 and given == [(1, {})]


def test_labels_do_not_meet(spark):
    c = spark.createDataFrame([(1, "a", 0.0, 0.0, "aaaa", 10.0, 5), (1, "b", 2.0, 0.0, "bbbb", 10.0, 4), (1, "c", 90.0, 0.0, "cc", 10.0, 1)], "view long, node string, px double, py double, label string, height double, size long")
    assert {r.node: r.drawn for r in view.place_labels(c).collect()} == {"a": True, "b": False, "c": True}


def test_stream_upsert(spark, tmp_path):
    src, target, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, at long, v string").write.parquet(src)
    schema = "id long, at long, v string"
    assert {(r.id, r.v) for r in ingest.upsert_stream(spark, src, schema, target, ck, "id", "at").collect()} == {(1, "a"), (2, "b")}
    spark.createDataFrame([(1, 2, "c")], schema).write.mode("append").parquet(src)
    assert {(r.id, r.v) for r in ingest.upsert_stream(spark, src, schema, target, ck, "id", "at").collect()} == {(1, "c"), (2, "b")}


def test_points_loader(spark, tmp_path):
    p = str(tmp_path / "p.parquet")
    spark.createDataFrame([(1, 0.5, 0.25, 3)], "k long, x double, y double, c long").write.parquet(p)
    with pytest.raises(ValueError, match="--columns"):
        tables.load_points(spark, p)
    got = tables.load_points(spark, p, {"id": "k", "category": "c", "importance": "x"}).first()
    assert (got.id, got.category) == (1, 3)


def test_manifest_refused(spark, tmp_path):
    bad = spark.createDataFrame([(1, 99, "a", [0.0] * 4, [0.0] * 2, 1)], "node long, parent long, label string, bbox array<double>, centroid array<double>, size long")
    with pytest.raises(ValueError, match="not in manifest"):
        tables.write_manifest(bad, str(tmp_path / "m"))


def test_nothing_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1] / "cartolith"
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), f
    assert math.isclose(scalar.effective_weight(0.5), 0.5)
