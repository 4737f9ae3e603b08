"""Rules and formats with pinned values: names, tiles, trees, archives, exports, the command line."""

import gzip
import json
import sqlite3
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartolith import __main__ as cli
from cartolith.functions import fixed, scalar
from cartolith.operators import catalog, hierarchy, layout, neighbours, tiles, vectors, view
from cartolith.plans.storage import read_bytes
from cartolith.sources import export, store, tables, trees
from cartolith.sources import vectors as archives
from cartolith.streaming import ingest

KEEP = ["A Movie About Bees", "DLC Hunters", "Touch No Artwork", "Trailer Park Tycoon", "Blue Eyes - Interactive Movie", "Demographics 2", "Hosted", "SDK Wars", "Ostrich Run", "Map Pack Rally", "Closed Beta Story", "Level Editor Deluxe"]
DROP = ["Playable Teaser of Rust", "Bees Demo", "Bees (Demo)", "My Demo Game", "Rally Benchmark Tool", "Bees: Test Server", "Wallpaper Machine", "Bees Soundtrack", "Bees + OST", "Bees: OST 2", "Bees (DLC)", "Bees - DLC", "Bees – dlc one", "Bees DLC Pack", "Bees Playtest", "Bees - Season Pass", "Bees Artbook", "Bees Art Book", "Music Pack One", "Bees Content Pack", "Episode 3 Pack", "Bees Beta Test", "Bees SDK", "Bees Dedicated Server", "Bees Original Score", "Bees Trailer Pack"]


def test_names(spark):
    df = spark.createDataFrame([(n, n in KEEP) for n in KEEP + DROP], "name string, keep boolean")
    got = df.withColumn("reason", catalog.drop_reason(F.col("name"), F.array(F.lit("Action")), F.lit(50))).collect()
    assert {r["name"] for r in got if r["reason"] is None} == set(KEEP)
    assert {r["reason"] for r in got} == {None, "name_pattern"}


def test_drop_order(spark):
    rows = [("7", "", ["Action"], 500), ("x", "", ["Action"], 5), ("8", "Good", ["Utilities", "Short"], 5), ("9", "Good", ["Utilities", "Action"], 9), ("10", "Good", [], 10)]
    df = spark.createDataFrame(rows, "i string, name string, g array<string>, n int")
    got = [r[0] for r in df.orderBy(F.length("i"), "i").select(catalog.drop_reason(F.col("name"), F.col("g"), F.col("n"), item_id=F.col("i"))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, ["no_name", "software_genre", "few_reviews", "bad_appid", None]))


def test_columns_of_the_catalog():
    assert len(fixed.CSV_COLUMNS) == 40 and fixed.CSV_COLUMNS[7:9] == ["Discount", "DLC count"] and fixed.CSV_COLUMNS[37] == "Tags"


def csv_file(folder, rows):
    lines = [",".join(fixed.CSV_COLUMNS[:7] + ["DiscountDLC count"] + fixed.CSV_COLUMNS[9:])]
    for r in rows:
        cells = {**dict.fromkeys(fixed.CSV_COLUMNS, ""), **r}
        lines.append(",".join('"' + str(cells[c]).replace('"', '""') + '"' for c in fixed.CSV_COLUMNS))
    lines.append('"1","short line"')
    (folder / "games.csv").write_text("\n".join(lines) + "\n")
    return str(folder / "games.csv")


def test_ingest_from_csv(spark, tmp_path, capsys):
    rows = [
        {"AppID": 3, "Name": "Bee \"Land\"", "About the game": "line one\nline two", "Positive": "30", "Negative": "10.0", "Price": "2.5", "Genres": "Action,Indie", "Tags": "Bees,Land,Sun"},
        {"AppID": "?", "Name": "Lost", "Positive": 99, "Genres": "Action"},
        {"AppID": 5, "Name": "Bees Demo", "Positive": 99, "Genres": "Action"},
        {"AppID": 6, "Name": "Tool", "Positive": 99, "Genres": "Utilities"},
        {"AppID": 7, "Name": "Quiet", "Positive": 4, "Genres": "Action"},
    ]
    path = csv_file(tmp_path, rows)
    spark.createDataFrame([("3", "All about bees"), ("no", "x"), ("9", None)], "appID string, short_description string").write.parquet(str(tmp_path / "short"))
    db = str(tmp_path / "c.db")
    assert cli.main(["ingest", path, db, "--short", str(tmp_path / "short")]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said == {"dropped": {"bad_appid": 1, "name_pattern": 1, "software_genre": 1, "few_reviews": 1}, "malformed": 1}
    with sqlite3.connect(db) as c:
        got = c.execute("SELECT appid, name, short_desc, long_desc, tags, review_count, review_score, price FROM games").fetchall()
    assert got == [(3, 'Bee "Land"', "All about bees", "line one\nline two", '["Bees","Land","Sun"]', 40, 0.75, 2.5)]
    back = store.read_sqlite(spark, db, "games", 3)
    assert [tuple(r) for r in back.select("appid", "name").collect()] == [(3, 'Bee "Land"')]
    scan = catalog.ordered_scan(back.withColumnRenamed("appid", "id"), min_tags=3).collect()
    assert scan[0]["tags"] == ["Bees", "Land", "Sun"] and catalog.ordered_scan(back.withColumnRenamed("appid", "id"), min_tags=4).count() == 0
    with pytest.raises(ValueError, match="Tags"):
        tables.require_columns(back.drop("tags"), ["Tags"])


def test_store_and_look_up(spark, tmp_path):
    t = store.open_store(spark, f"file://{tmp_path}/s")
    assert {k: v.count() for k, v in t.items()} == {"games": 0, "failures": 0, "crawl_log": 0}
    store.replace_table(spark.createDataFrame([(2, "http 429", 1), (1, "no_data", 2)], "appid long, status string, tries long"), f"file://{tmp_path}/s", "failures")
    assert store.open_store(spark, f"file://{tmp_path}/s")["failures"].count() == 2

    def fetch(i):
        if i == 4:
            raise OSError("x" * 300)
        return {1: (200, {"name": "A", "tags": {"u": 1, "v": 5}, "positive": 3, "negative": 1}), 2: (429, None), 3: (200, {"name": None})}[i]

    got = {r.id: r for r in store.look_up(spark.range(1, 5), fetch, delay=0, tries=2, back_off=0).collect()}
    assert got[1].status == "ok" and got[1].tags == ["v", "u"] and got[2].status == "http 429" and got[3].status == "no_data" and got[4].status == "x" * 200


def test_tile_bytes():
    """Each byte by the published layout: header, then blocks, with bit 0 set; interleaved records without it."""
    pdf = pd.DataFrame({"x": [1.5, -2.0, 0.25], "y": [0.5, 4.0, -8.0], "id": [7, 8, 4_000_000_000], "category": [1, 2, 3], "importance": [65535, 0, 9]})
    head = lambda flag: struct.pack("<4sHHI4f", b"ATLS", 1, flag, 3, -2.0, -8.0, 1.5, 4.0)
    blocks = head(1) + struct.pack("<3f3f3I3I3H", *pdf.x, *pdf.y, *pdf.id, *pdf.category, *pdf.importance) + b"\0\0"
    records = head(0) + b"".join(struct.pack("<ffIIH", *r) for r in pdf.itertuples(index=False))
    assert tables.encode_tile(pdf) == blocks and tables.encode_tile(pdf, interleaved=True) == records
    for data in (blocks, records, gzip.compress(blocks, 6)):
        assert tables.decode_tile(data).astype("float64").equals(pdf.astype("float64"))
    for wrong in (b"NOPE" + blocks[4:], blocks[:4] + b"\2\0" + blocks[6:]):
        with pytest.raises(ValueError):
            tables.decode_tile(wrong)
    empty = tables.encode_tile(pdf.iloc[:0])
    assert empty == struct.pack("<4sHHI4f", b"ATLS", 1, 1, 0, 0, 0, 0, 0) and len(tables.decode_tile(empty)) == 0


def test_neighbour_bytes():
    data = tables.encode_neighbours(pd.DataFrame({"dst": [1, 2, 0, 2, 0, 1]}), 2)
    assert data == struct.pack("<4sHHI6I", b"AKNN", 1, 2, 3, 1, 2, 0, 2, 0, 1)
    assert tables.decode_neighbours(data, slice(1, 2)).tolist() == [[0, 2]]
    with pytest.raises(ValueError):
        tables.decode_neighbours(data[:4] + b"\2\0" + data[6:])


def test_tiles_from_the_command_line(spark, tmp_path, capsys):
    r = np.random.default_rng(0)
    n = 600
    np.savez(tmp_path / "p.npz", x=r.normal(size=n).astype("float32"), y=r.normal(size=n).astype("float32"), id=np.arange(n, dtype="uint32"), category=r.integers(0, 5, n).astype("uint32"), weight=r.random(n))
    out = str(tmp_path / "out")
    assert cli.main(["tiles", "build", str(tmp_path / "p.npz"), out, "--max-zoom", "2", "--max-points", "50", "--columns", '{"importance": "weight"}']) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["n_points"] == n and said["tiles_per_zoom"]["0"] == 1 and said["points_per_zoom"]["0"] == 50 and said["points_per_zoom"]["2"] == n
    assert cli.main(["tiles", "inspect", out]) == 0 and json.loads(capsys.readouterr().out)["layout"] == "soa"
    top = export.read_tile(spark, out, 0, 0, 0)
    assert len(top) == 50 and set(top.columns) == {"x", "y", "id", "category", "importance"}
    total = sum(len(tables.decode_tile(p.read_bytes())) for p in (tmp_path / "out" / "2").rglob("*.bin"))
    assert total == n
    np.savez(tmp_path / "short.npz", x=np.zeros(3), y=np.zeros(3))
    with pytest.raises(ValueError, match="--columns"):
        tables.load_points(spark, str(tmp_path / "short.npz"))


def test_vector_archives(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 0.5, -1.0]) for i in (3, 1, 2)], "id long, features array<double>")
    path = str(tmp_path / "v.npz")
    archives.save_vectors(v, path, {"holdout": True})
    back, meta = archives.load_vectors(spark, path)
    assert meta == {"holdout": True} and [tuple(r) for r in back.collect()] == [(i, [float(i), 0.5, -1.0]) for i in (1, 2, 3)]


def test_trees_as_json(spark, tmp_path):
    nodes = spark.createDataFrame([(0, None, 0, 3), (1, 0, 1, 2), (2, 0, 1, 1)], "node long, parent long, depth int, size long")
    members = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "item long, node long")
    terms = spark.createDataFrame([(1, 1, "b", 0.5), (1, 2, "a", 0.25)], "node long, k int, term string, score double")
    path = str(tmp_path / "t.json")
    trees.save_tree(nodes, members, path, {"n": 3}, terms)
    raw = json.loads(read_bytes(spark, path))
    assert raw["root"] == 0 and raw["nodes"]["0"]["children"] == [1, 2] and raw["nodes"]["1"]["members"] == [10, 11] and raw["nodes"]["1"]["terms"] == [["b", 0.5], ["a", 0.25]]
    n, m, t, meta = trees.load_tree(spark, path)
    assert meta == {"n": 3} and {(r.node, r.parent, r.size) for r in n.collect()} == {(0, None, 3), (1, 0, 2), (2, 0, 1)}
    assert {tuple(r) for r in m.collect()} == {(10, 1), (11, 1), (12, 2)} and {(r.k, r.term) for r in t.collect()} == {(1, "b"), (2, "a")}


def test_collapse():
    tree = lambda *rows: hierarchy.collapse(list(rows), 10)
    # 1 holds the mass of 0 and 2 half of 1, but 2 is no half of 0: children of a spine are measured against 0.
    assert {n for n, _, _ in tree((0, None, 100), (1, 0, 80), (2, 1, 45), (3, 1, 30), (4, 2, 22), (5, 2, 15))} == {0, 2, 3, 4, 5} - {4, 5} | {4, 5}
    assert {n for n, _, _ in tree((0, None, 100), (1, 0, 80), (2, 1, 45), (3, 1, 30), (4, 3, 12), (5, 3, 11))} == {0, 2, 3, 4, 5}
    assert tree((0, None, 100), (1, 0, 40)) == [(0, None, 100), (1, 0, 40)]  # a lone leaf stays
    assert tree((0, None, 100), (1, 0, 40), (2, 1, 15), (3, 1, 12)) == [(0, None, 100), (2, 0, 15), (3, 0, 12)]  # a lone branch gives way
    assert tree((0, None, 100), (1, 0, 60)) == [(0, None, 100)]  # a spine without children is the root's rest
    assert tree((0, None, 100), (1, 0, 20), (2, 0, 9)) == [(0, None, 100), (1, 0, 20)]
    deep = [(0, None, 10**6)] + [x for d in range(8) for x in ((2 * d + 1, 2 * d - 1 if d else 0, 10**6 // 3 ** (d + 1)), (2 * d + 2, 2 * d - 1 if d else 0, 10**6 // 3 ** (d + 1)))]
    assert max(n for n, _, _ in hierarchy.collapse(deep, 10, max_depth=3)) == 6


def test_closure_both_ways(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(100, 5), (101, 100), (200, 999)]
    nodes = spark.createDataFrame(rows, "node long, parent long")
    sent, joined = ({tuple(r) for r in hierarchy.closure(nodes, sent=k).collect()} for k in (1000, 0))
    up = dict(rows)
    want = set()
    for n in up:
        at, hops = n, 0
        while at in up:
            want.add((n, at, hops))
            at, hops = up[at], hops + 1
    assert sent == joined == want


def test_density_clusters():
    r = np.random.default_rng(2)
    m = np.concatenate([r.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    rows = hierarchy._condensed(m, 10, 3)
    clusters = [x for x in rows if x[1] >= len(m)]
    assert len(clusters) == 4 and sorted(x[3] for x in clusters)[:3] >= [10, 10, 10] and max(x[3] for x in clusters) >= 80
    leaves = {x[1] for x in clusters} - {x[0] for x in clusters}
    own = {leaf: {x[1] // 40 for x in rows if x[0] == leaf and x[1] < len(m)} for leaf in leaves}
    assert len(leaves) == 3 and all(len(g) == 1 for g in own.values()) and sorted(x[1] for x in rows if x[1] < len(m)) == list(range(len(m)))


def test_density_clusters_by_blocks(spark):
    """More points than one task takes: the same rows by blocks, with equal vectors and equal distances too."""
    r = np.random.default_rng(4)
    m = np.concatenate([r.normal(c, 0.1, (50, 3)) for c in ((0, 0, 0), (5, 5, 0), (9, 0, 4))] + [np.full((12, 3), 7.0), r.integers(0, 3, (30, 3)).astype(float)])
    v = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(m)], "id long, features array<double>").repartition(5)
    one = sorted(map(tuple, hierarchy.condensed_tree(v, 6, 3).collect()))
    by_blocks = sorted(map(tuple, hierarchy.condensed_tree(v, 6, 3, most=100, block=50).collect()))
    assert [x[:2] + x[3:] for x in one] == [x[:2] + x[3:] for x in by_blocks] and np.allclose([x[2] for x in one], [x[2] for x in by_blocks])
    assert sorted(x[1] for x in one if x[1] < len(m)) == list(range(len(m))) and any(np.isinf(x[2]) for x in one)


def test_svd_by_slices(spark, monkeypatch):
    """Cosines are those of a dense SVD, and no broadcast array is larger than a slice of the basis."""
    from pyspark import SparkContext

    from cartolith.operators import vectors

    r = np.random.default_rng(5)
    m = (r.random((60, 4)) @ r.random((4, 40))) * (r.random((60, 40)) < 0.4)
    cells = [(i, f"t{j:02}", float(m[i, j])) for i, j in np.argwhere(m).tolist()]
    df, sent, send = spark.createDataFrame(cells, "item long, tag string, ppmi double").repartition(3), [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, v: sent.append(getattr(v, "nbytes", 0)) or send(self, v))
    got, values = vectors.svd_embedding(df, 39, slice_bytes=8 * 40 * 5)
    f = np.array([x["features"] for x in got.orderBy("item").collect()])
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = (u * s)[:, :39]
    want = want[(m != 0).any(axis=1)]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert 0 < max(sent) <= 8 * 40 * 5 and np.allclose(values, s[:39]) and np.allclose(f @ f.T, want @ want.T, atol=1e-6)
    assert vectors.svd_embedding(df.limit(0))[0].count() == 0


@pytest.mark.parametrize("rows,kind", [(2300, "apart"), (60, "equal"), (60, "ids"), (8, "apart"), (1, "apart"), (0, "apart")])
def test_contrast_is_of_all_points(spark, tmp_path, rows, kind):
    """As the SQL has it: over 2,000 points too, with equal vectors, equal ids, too few points."""
    import duckdb

    from cartolith.plans import registry
    from check_oracles import rows as compared

    r = np.random.default_rng(6)
    at = [i // 3 if kind == "equal" else i for i in range(rows)]
    m = r.normal(size=(rows, 64)).astype("float32")
    table = pd.DataFrame({"vec_id": [i // 2 if kind == "ids" else i for i in range(rows)], "embedding": [m[i].tolist() for i in at], "label": 0})
    spark.createDataFrame(table if rows else [], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert compared(registry.density_contrast(spark, str(tmp_path)).toPandas()) == compared(db.execute(registry.ORACLES["density_contrast"]).df())


def test_large_groups_are_split_over_tasks(spark):
    """Trees whose root is too large for a task: the planted groups come out, sizes add up."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(4, 12))
    m = np.concatenate([c + 0.15 * r.normal(size=(60, 12)) for c in centres])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "item long, features array<double>").repartition(3)
    for make in (lambda: hierarchy.kmeans_parts(v, 12), lambda: hierarchy.community_parts(v, 8, task_rows=20), lambda: hierarchy.community_parts(v, 8)):
        parts = {x["item"]: x["part"] for x in make().collect()}
        assert sorted(parts) == list(range(240))
        groups = [{parts[i] for i in range(60 * g, 60 * g + 60)} for g in range(4)]
        assert all(not (a & b) for i, a in enumerate(groups) for b in groups[:i]) and len(set().union(*groups)) <= 12
    for tree in (hierarchy.kmeans_tree(v, 4, task_rows=100), hierarchy.community_tree(v, 8, task_rows=100)):
        nodes, members = tree
        assert sorted(x["item"] for x in members.collect()) == list(range(240))
        assert nodes.filter("depth = 1").count() >= 2 and {x["node"] for x in members.collect()} <= {x["node"] for x in nodes.collect()}


def test_search_tiers(spark):
    items = spark.createDataFrame([(1, "Fire Red", "fire red", 5), (2, "Red", "red", 1), (3, "Old Red", "old red", 9), (4, "It's o'n", "it s o n", 1)], "id long, name string, folded string, reviews long")
    assert [(r.id, r.tier) for r in view.name_search(items, "Ré").collect()] == [(2, 0), (3, 1), (1, 2)]
    assert view.name_search(items, "o'n").first().id == 4 and view.name_search(items, "!").count() == 0
    terms = spark.createDataFrame([(1, 0, "red bees", 9), (2, 1, "red", 1), (3, 0, "the red", 5), (4, 0, "red bees", 50), (5, 2, "hundred", 7)], "node long, position int, folded string, size long")
    assert [(r.node, r["rank"]) for r in view.label_search(terms, "red").collect()] == [(2, 1), (4, 10), (1, 10), (3, 20)]
    assert view.label_search(terms, "it's").count() == 0


def test_votes_weigh_the_neighbours_rank(spark):
    near = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3)], "src long, dst long, rank int")
    profile = spark.createDataFrame([(1, "own", 0), (1, "hid", 1), (2, "p", 0), (3, "hid", 9), (4, "hid", 9), (4, "own", 0)], "item long, tag string, rank int")
    masked = spark.createDataFrame([(1, "hid")], "item long, tag string")
    # hid: 1/2 + 1/3 of a vote, p: 1; the places of tags don't count.
    assert neighbours.masked_precision(near, profile, masked, top=1).first().hits == 0
    assert neighbours.masked_precision(near.filter("rank > 1"), profile, masked, top=1).first().hits == 1


def test_last_batch_wins_ties(spark, tmp_path):
    schema = "id long, at long, v string"
    source, target, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    for k, v in enumerate(("first", "second")):
        spark.createDataFrame([(1, 5, v), (2, k, v)], schema).write.mode("append").parquet(source)
        got = {r.id: r.v for r in ingest.upsert_stream(spark, source, schema, target, check, "id", "at").collect()}
        assert got == {1: v, 2: v}


def test_index_recall(spark):
    """The index against brute force: most neighbours of clustered vectors, all of them where every cell is looked into."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(30, 16))
    m = np.concatenate([c + 0.4 * r.normal(size=(40, 16)) for c in centres])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, features array<double>")
    exact = neighbours.knn_cosine(v, 10)
    assert neighbours.recall(neighbours.knn_index(v, 10, cells=30, probes=5), exact).first().recall >= 0.9
    every = neighbours.knn_index(v, 10, cells=6, probes=6, queries=v.filter("id % 50 = 0"), block_rows=50)
    assert neighbours.recall(every, exact.filter("src % 50 = 0")).first().recall == 1.0
    assert neighbours.recall(neighbours.knn_index(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS features"), 10), neighbours.knn_cosine(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS features"), 10)).first().recall >= 0.9


def test_pooling_and_batches(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    got = df.select(vectors.pooled(F.col("t"), F.col("m")).alias("a"), vectors.pooled(F.col("t"), F.col("m"), "cls").alias("b")).first()
    assert got.a == [2.0, 3.0] and got.b == [1.0, 2.0]
    texts = spark.createDataFrame([(i, "x" * ((7 * i) % 11)) for i in range(20)], "id long, text string").coalesce(1)
    seen = [tuple(r) for r in vectors.encoded_by_length(texts, lambda ts: [[float(len(t)), float(max(map(len, ts)))] for t in ts], batch=5).collect()]
    assert [i for i, _ in seen] == list(range(20)) and all(v[0] == (7 * i) % 11 for i, v in seen) and {v[1] for _, v in seen} == {2.0, 5.0, 7.0, 10.0} | {v[1] for _, v in seen}
    assert vectors.dims_for_variance([0.5, 0.3, 0.2], 0.8) == 2 and vectors.loading_share([[3.0, 4.0]], 1) == [9 / 25]


def test_values_at_places(spark):
    vals = [5, 1, 1, 1, 9, 7, None, 3, 3, 8]
    df = spark.createDataFrame([(v,) for v in vals], "v int")
    known = sorted(v for v in vals if v is not None)
    assert catalog.upper_median(df, "v").first()[0] == known[len(known) // 2]
    for p in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert layout.index_quantile(df, "v", p).first().value == known[int((len(known) - 1) * p)]
    assert layout.index_quantile(df.limit(0), "v", 0.5).first().value is None


def test_manifest_fields_and_report(spark):
    nodes = spark.createDataFrame([(1, None, [0.0] * 4, [0.0] * 2)], "node long, parent long, bbox array<double>, centroid array<double>")
    assert {r.problem for r in hierarchy.validate_manifest(nodes).collect()} == {"missing label, size"}
    with pytest.raises(ValueError, match="parent"):
        hierarchy.validate_manifest(nodes.drop("parent"))
    row = lambda name, tagp, clean: {"name": name, "dims": 8, "genre_lift": 1.2, "toptag": 0.5, "tagp": tagp, "method": "m", "clean": clean}
    text = export.report([row("a", 0.1, True), row("b", 0.3, True), row("c", 0.9, False)], 1234, 0.75)
    assert text.index("`b`") < text.index("`a`") < text.index("Circular") < text.index("`c`") and "1,234" in text and "75.0%" in text
    meta = spark.createDataFrame([("x", True, None, None), ("x_holdout", None, None, None), ("h", True, True, False), ("y", False, None, None)], "name string, holdout boolean, half_a boolean, half_b boolean")
    assert {r.name: r.clean for r in vectors.is_clean(meta).collect()} == {"x": True, "x_holdout": True, "h": False, "y": False}
    assert vectors.best_of(spark.createDataFrame([(1, 0.2, 5), (2, 0.1, 3), (3, 0.1, 4)], "k int, noise double, forks int")).first().k == 3


def test_viewer_files(spark, tmp_path):
    items = spark.createDataFrame([(i, 100 + i, f"n{i}", ["a", "b", "c", "d", "e", "f"], 10 * i, 0.5, "1 May, 2019", 1.5) for i in range(4)], "row long, id long, name string, tags array<string>, review_count long, review_score double, release_date string, price double")
    places = spark.createDataFrame([(i, float(i), float(-i)) for i in range(4)], "row long, x double, y double")
    near = spark.createDataFrame([(i, j, k + 1) for i in range(4) for k, j in enumerate(j for j in range(4) if j != i)], "src long, dst long, rank int")
    nodes = spark.createDataFrame([(0, None, "all", [0.0] * 4, [0.0] * 2, 4)], "node long, parent long, label string, bbox array<double>, centroid array<double>, size long")
    points = spark.createDataFrame([(i, float(i), float(-i), 0, i) for i in range(4)], "id long, x double, y double, category long, importance int")
    said = export.export_viewer(items, nodes, places, near, str(tmp_path), k=2, points=points, max_zoom=1, limit=10)
    assert said == {"shards": 1, "items": 4, "neighbours": 4, "categories": 1}
    shard, index, manifest = (json.loads((tmp_path / f).read_text()) for f in ("meta/0000.json", "search.json", "manifest.json"))
    assert shard["from"] == 0 and shard["appids"] == [100, 101, 102, 103] and shard["tags"][0] == list("abcde") and shard["years"] == [2019] * 4
    assert index["n"] == 4 and index["x"] == [0.0, 1.0, 2.0, 3.0] and manifest["n_points"] == 4 and manifest["categories"][0]["id"] == 0
    assert tables.decode_neighbours((tmp_path / "knn.bin").read_bytes()).tolist() == [[1, 2], [0, 2], [0, 1], [0, 1]]
    assert (tmp_path / "tiles" / "0" / "0" / "0.bin").exists()


def test_tile_cache_and_shards(spark, tmp_path):
    points = spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 3, i) for i in range(60)], "id long, x double, y double, category long, importance int")
    export.write_tile_directory(points, str(tmp_path / "t"), max_zoom=1, limit=10, compress=True)
    cache = export.TileCache(spark, str(tmp_path / "t"), most=2)
    assert len(cache.get(0, 0, 0)) == 10 and len(cache.get(0, 0, 0)) == 10 and cache.get(1, 0, 0) is not None and cache.get(9, 9, 9) is None
    assert (cache.hits, cache.fetched, cache.evicted) == (1, 3, 1) and cache.get(0, 0, 0) is not None and cache.fetched == 4
    tables.write_shards(points, str(tmp_path / "s"), rows=16)
    got = tables.read_shards(spark, str(tmp_path / "s"), [3, 17, 18], rows=16)
    assert sorted(r.id for r in got.collect()) == [3, 17, 18]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and len({r.f for r in got.select(F.input_file_name().alias("f")).distinct().collect()}) == 2


def test_windowed_counts_as_a_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    rows = [(f"2024-01-01 0{h}:10:00", t, 1.5) for h in (1, 1, 2, 5) for t in ("a", "b")]
    spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window.start.hour, r.event_type): (r.n, r.total) for r in spark.table("windowed").collect()}
    assert sorted(got.values()) == [(1, 1.5)] * 4 + [(2, 3.0)] * 2 and len(got) == 6


def test_pending_work(spark):
    work = spark.range(1, 7)
    log, failed = spark.createDataFrame([(1, "t"), (2, "t"), (1, "u")], "id long, at string"), spark.createDataFrame([(3, 1), (4, 3), (5, 2)], "id long, tries int")
    assert sorted(r.id for r in ingest.pending(work, log, failed).collect()) == [3, 4, 5, 6]
    assert sorted(r.id for r in ingest.pending(work, log, failed, "retry").collect()) == [3, 5]


def test_now_in_utc(spark):
    import datetime

    said = datetime.datetime.fromisoformat(spark.range(1).select(scalar.utc_now()).first()[0])
    assert abs((datetime.datetime.now(datetime.timezone.utc) - said).total_seconds()) < 120


def test_sizes_of_baselines(spark):
    sizes = [1, 50, 51, 4000, 4001]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n int").select(scalar.size_bin(F.col("n"))).collect()]
    assert got == [50, 50, 100, 4000, 10_000]
    p = tiles.importance_rank(spark.range(30).select("id", (F.col("id") % 3).cast("double").alias("importance")))
    assert sorted(r.importance for r in p.collect())[-1] == 65535
