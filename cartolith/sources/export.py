"""Files for a map's viewer: tile directories, points and manifest, metadata shards, search index, neighbours, reports."""

from __future__ import annotations

import gzip
import json
import time
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scalar
from ..operators import layout, tiles
from ..plans.storage import read_bytes, write_bytes
from . import tables


def _write_files(files: DataFrame) -> int:
    """Write (path, data) from the tasks that hold them; gives how many bytes were written."""

    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            sizes = []
            for path, data in zip(pdf["path"], pdf["data"]):
                store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at, compression=None) as out:
                    out.write(bytes(data))
                sizes.append(len(data))
            yield pd.DataFrame({"n": sizes})

    return files.select("path", "data").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_tile_directory(points: DataFrame, folder: str, max_zoom: int = 5, limit: int = 1000, grid: int = 8, strategy: str = "stratified", compress: bool = False, interleaved: bool = False) -> dict:
    """``z/x/y.bin`` (``.gz``) for each tile, and ``tiles.json``; gives the latter."""
    spark, began = points.sparkSession, time.time()
    pyramid = tiles.tile_pyramid(points, max_zoom, limit, grid, strategy)
    box = tiles.root_box(points).first()
    bounds = [box[c] for c in ("minx", "miny", "maxx", "maxy")]
    cols = tiles.tile_bounds(F.col("z"), F.col("tx"), F.col("ty"), tuple(F.lit(float(b)) for b in bounds))
    encoded = tables.encode_tiles(pyramid, compress, interleaved, cols)
    end = ".bin.gz" if compress else ".bin"
    name = F.concat_ws("/", F.lit(folder.rstrip("/")), F.col("z").cast("string"), F.col("tx").cast("string"), F.concat(F.col("ty").cast("string"), F.lit(end)))
    total = _write_files(encoded.select(name.alias("path"), F.col("payload").alias("data")))
    stats = {r["z"]: r for r in tiles.stats_per_zoom(pyramid).collect()}
    n = points.count()
    meta = {
        "version": 1,
        "bounds": bounds,
        "max_zoom": max_zoom,
        "max_points": limit,
        "strategy": strategy,
        "layout": "aos" if interleaved else "soa",
        "gzip": compress,
        "n_points": n,
        "n_tiles": sum(r["tiles"] for r in stats.values()),
        "tiles_per_zoom": {str(z): r["tiles"] for z, r in sorted(stats.items())},
        "points_per_zoom": {str(z): r["points"] for z, r in sorted(stats.items())},
        "redundancy": sum(r["points"] for r in stats.values()) / max(n, 1),
        "bytes_total": total,
        "seconds": {"total": round(time.time() - began, 2)},
    }
    write_bytes(spark, f"{folder.rstrip('/')}/tiles.json", json.dumps(meta, indent=2).encode())
    return meta


def read_tile(spark: SparkSession, folder: str, z: int, x: int, y: int) -> pd.DataFrame:
    """One tile of a directory, as the viewer fetches it."""
    meta = json.loads(read_bytes(spark, f"{folder}/tiles.json"))
    return tables.decode_tile(read_bytes(spark, f"{folder}/{z}/{x}/{y}.bin{'.gz' if meta['gzip'] else ''}"))


class TileCache:
    """Tiles of a directory on demand; the least recently used of more than ``most`` goes.  A tile that isn't there is None."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 64):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most
        self.meta = json.loads(read_bytes(spark, f"{self.folder}/tiles.json"))
        self.held: OrderedDict[tuple[int, int, int], pd.DataFrame | None] = OrderedDict()
        self.hits = self.fetched = self.evicted = 0

    def get(self, z: int, x: int, y: int) -> pd.DataFrame | None:
        key = (z, x, y)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        path = f"{self.folder}/{z}/{x}/{y}.bin{'.gz' if self.meta['gzip'] else ''}"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        self.held[key] = tables.decode_tile(read_bytes(self.spark, path)) if there else None
        self.fetched += 1
        if len(self.held) > self.most:
            self.held.popitem(last=False)
            self.evicted += 1
        return self.held[key]


def measured(nodes: DataFrame, measures: DataFrame | None, own: DataFrame) -> DataFrame:
    """Nodes with bbox, centroid, purity and containment: measured ones, or else those of the node's own points.

    ``measures`` is (node, bbox, centroid, purity, containment), ``own`` what
    ``layout.node_bbox`` gives.
    """
    box = own.select("node", F.array("x0", "y0", "x1", "y1").alias("_box"), F.array("cx", "cy").alias("_mid"))
    j = nodes.join(box, "node", "left")
    if measures is None:
        return j.withColumns({"bbox": F.col("_box"), "centroid": F.col("_mid"), "purity": F.lit(None).cast("double"), "containment": F.lit(None).cast("double")}).drop("_box", "_mid")
    m = measures.select("node", "bbox", "centroid", "purity", "containment")
    return j.join(m, "node", "left").withColumns({"bbox": F.coalesce("bbox", "_box"), "centroid": F.coalesce("centroid", "_mid")}).drop("_box", "_mid")


def with_extras(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items (id, ...) with score, release date and price of the catalog, null where it has none."""
    return items.join(catalog.select("id", "review_score", "release_date", "price").dropDuplicates(["id"]), "id", "left")


def export_points(items: DataFrame, owners: DataFrame, places: DataFrame, folder: str) -> DataFrame:
    """``points.parquet``: (x, y, id, category, importance) of (id, review_count), (item, node) and (item, x, y)."""
    j = items.select(F.col("id").alias("item"), F.col("review_count").cast("double").alias("importance")).join(owners, "item").join(places, "item")
    rows = j.select(F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.col("item").alias("id"), F.col("node").alias("category"), "importance")
    rows.write.mode("overwrite").parquet(f"{folder}/points.parquet")
    return rows


def export_viewer(items: DataFrame, nodes: DataFrame, places: DataFrame, neighbours: DataFrame, folder: str, k: int = 10, points: DataFrame | None = None, max_zoom: int = 5, limit: int = 1000) -> dict:
    """All files of the viewer.

    ``items`` is (row, id, name, tags, review_count, review_score, release_date,
    price), ``row`` counting from 0; ``places`` (row, x, y); ``neighbours``
    (src, dst, rank) of rows; ``nodes`` has the manifest's columns.  Shards are
    bounded groups; the search index and the manifest are lists of the catalog
    that the viewer loads whole, streamed to their one file.
    """
    spark, root = items.sparkSession, folder.rstrip("/")
    shard = F.floor(F.col("row") / fixed.SHARD_ROWS)
    rec = F.struct("row", "name", "id", F.slice("tags", 1, fixed.SHARD_TAGS).alias("tags"), "review_count", F.round(F.coalesce("review_score", F.lit(0.0)), 3).alias("score"), scalar.year_of(F.col("release_date")).alias("year"), "price")
    held = items.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(rec)).alias("r"))
    field = lambda c: F.transform("r", lambda x: x[c])
    body = F.struct((F.col("shard") * fixed.SHARD_ROWS).alias("from"), field("name").alias("names"), field("id").alias("appids"), field("tags").alias("tags"), field("review_count").alias("reviews"), field("score").alias("scores"), field("year").alias("years"), field("price").alias("prices"))
    path = F.concat(F.lit(f"{root}/meta/"), F.lpad(F.col("shard").cast("string"), 4, "0"), F.lit(".json"))
    _write_files(held.select(path.alias("path"), F.encode(F.to_json(body, {"ignoreNullFields": "false"}), "UTF-8").alias("data")))
    index: dict[str, list] = {c: [] for c in ("names", "appids", "x", "y", "reviews", "years")}
    for r in items.join(places, "row").orderBy("row").select("name", "id", F.round("x", 3), F.round("y", 3), "review_count", scalar.year_of(F.col("release_date"))).toLocalIterator():
        for c, v in zip(index.values(), r):
            c.append(v)
    write_bytes(spark, f"{root}/search.json", json.dumps({"n": len(index["names"]), **index}, ensure_ascii=False, separators=(",", ":")).encode())
    lists = neighbours.filter(F.col("rank") <= k).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("d")).orderBy("src")
    ids = np.array([[x["dst"] for x in r["d"]] + [r["src"]] * (k - len(r["d"])) for r in lists.toLocalIterator()], "<u4").reshape(-1, k)
    write_bytes(spark, f"{root}/knn.bin", tables.encode_neighbours(pd.DataFrame({"dst": ids.ravel()}), k))
    wrong = tables.validate(nodes)
    if wrong:
        raise ValueError("; ".join(wrong))
    n = places.count()
    box = tiles.root_box(places).first()
    extent = [layout.index_quantile(places, c, p).first()["value"] for p in (0.005, 0.995) for c in ("x", "y")]
    manifest = {
        "version": 2,
        "bounds": [box[c] for c in ("minx", "miny", "maxx", "maxy")],
        "core_extent": [float(v) if v is not None else None for v in extent],
        "max_zoom": max_zoom,
        "n_points": n,
        "meta_shard": fixed.SHARD_ROWS,
        "gzip_tiles": False,
        "categories": [r.asDict(recursive=True) for r in nodes.withColumnRenamed("node", "id").orderBy("id").toLocalIterator()],
    }
    write_bytes(spark, f"{root}/manifest.json", json.dumps(manifest).encode())
    if points is not None:
        write_tile_directory(points, f"{root}/tiles", max_zoom, limit)
    return {"shards": held.count(), "items": len(index["names"]), "neighbours": len(ids), "categories": len(manifest["categories"])}


def report(rows: list[dict], items: int, baseline: float) -> str:
    """Markdown tables of embedding variants by tag prediction, those that saw the masked tags apart."""
    head = ["| variant | dims | genre lift | top-tag | tag pred @5 | method |", "| --- | ---: | ---: | ---: | ---: | --- |"]
    line = lambda r: f"| `{r['name']}` | {r['dims']} | {r['genre_lift']:.2f}x | {r['toptag'] * 100:.1f}% | {r['tagp'] * 100:.1f}% | {r['method']} |"
    order = sorted(rows, key=lambda r: (-r["tagp"], r["name"]))
    out = ["# Embedding variants", "", f"{items:,} items; random pairs share a genre {baseline * 100:.1f}% of the time.", "", "## Results", "", *head, *[line(r) for r in order if r["clean"]]]
    if any(not r["clean"] for r in rows):
        out += ["", "## Circular on tag prediction", "", "Built from inputs that hold the masked tags; not comparable with the table above.", "", *head, *[line(r) for r in order if not r["clean"]]]
    return "\n".join(out) + "\n"


def gzip_bytes(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)
