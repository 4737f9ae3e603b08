"""Readers and writers: pinned CSV, points, tiles, manifests, neighbour blocks, shards."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed


def read_csv_pinned(spark: SparkSession, path: str, names: list[str] = fixed.CSV_COLUMNS, wanted: list[str] | None = None) -> DataFrame:
    """A CSV file whose header line can't be trusted: columns are named by position.

    Malformed lines are left out; ``malformed_lines`` gives them.  Lines are
    parsed whole whatever columns are wanted, so the same ones count as malformed.
    """
    df = _pinned(spark, path, names).option("mode", "DROPMALFORMED").csv(path)
    return df.select(*[f"`{w}`" for w in wanted]) if wanted else df


def _pinned(spark: SparkSession, path: str, names: list[str], more: str | None = None):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([more] if more else [])]])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("columnPruning", False)


def malformed_lines(spark: SparkSession, path: str, names: list[str] = fixed.CSV_COLUMNS) -> DataFrame:
    """(line): what ``read_csv_pinned`` leaves out of the file."""
    bad = _pinned(spark, path, names, "_line").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    whole = F.length(F.concat_ws("", *[f"`{n}`" for n in names])) >= 0  # Spark refuses to read the bad line alone
    return bad.filter(F.col("_line").isNotNull() & whole).select(F.col("_line").alias("line"))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


POINT = ("id", "x", "y", "category", "importance")


def load_points(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Points from Parquet, CSV, TSV or npz by suffix; ``columns`` maps logical names to those of the file."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "npz":
        from .vectors import read_npz_columns

        df = read_npz_columns(spark, path)
    else:
        raise ValueError(f"can't read points from .{kind}: parquet, csv, tsv and npz are known")
    names = {n: (columns or {}).get(n, n) for n in POINT}
    missing = [v for v in names.values() if v not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; map them with --columns")
    kinds = {"id": "long", "x": "float", "y": "float", "category": "long", "importance": "double"}
    return df.select(*[F.col(v).cast(kinds[n]).alias(n) for n, v in names.items()])


# -- tiles: 28-byte header, then blocks of one field each -----------------------

_HEAD = struct.Struct(fixed.TILE_HEADER)
_ROW = np.dtype(fixed.TILE_FIELDS)


def encode_tile(pdf: pd.DataFrame, bbox: tuple | None = None, interleaved: bool = False) -> bytes:
    n = len(pdf)
    box = bbox or ((pdf.x.min(), pdf.y.min(), pdf.x.max(), pdf.y.max()) if n else (0, 0, 0, 0))
    rows = np.zeros(n, _ROW)
    for f in _ROW.names:
        rows[f] = pdf[f].to_numpy()
    head = _HEAD.pack(fixed.TILE_MAGIC, fixed.TILE_VERSION, 0 if interleaved else fixed.TILE_BLOCKS, n, *map(float, box))
    if interleaved:
        return head + rows.tobytes()
    body = b"".join(rows[f].tobytes() for f in _ROW.names)
    return head + body + b"\0" * (-len(body) % 4)


def decode_tile(data: bytes) -> pd.DataFrame:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    magic, version, flags, n, *_ = _HEAD.unpack_from(data)
    if magic != fixed.TILE_MAGIC:
        raise ValueError(f"not a tile: magic {magic!r}")
    if version != fixed.TILE_VERSION:
        raise ValueError(f"a tile of version {version}; known: {fixed.TILE_VERSION}")
    if not flags & fixed.TILE_BLOCKS:
        rows = np.frombuffer(data, _ROW, n, _HEAD.size)
        return pd.DataFrame({f: rows[f] for f in _ROW.names})
    at, out = _HEAD.size, {}
    for f in _ROW.names:
        out[f] = np.frombuffer(data, _ROW[f], n, at)
        at += n * _ROW[f].itemsize
    return pd.DataFrame(out)


def encode_tiles(pyramid: DataFrame, compress: bool = False, interleaved: bool = False, bounds: list | None = None) -> DataFrame:
    """(z, tx, ty, n, payload): a tile a group; upper tiles are bounded by the selection, leaf tiles by the zoom.

    ``bounds``, four columns of z, tx and ty, go to the header; else the box of the points does.
    """
    edges = ["_x0", "_y0", "_x1", "_y1"] if bounds else []
    pyramid = pyramid.withColumns(dict(zip(edges, bounds))) if bounds else pyramid

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = encode_tile(pdf.sort_values("id"), tuple(pdf[edges].iloc[0]) if edges else None, interleaved=interleaved)
        return pd.DataFrame({"z": [pdf.z.iloc[0]], "tx": [pdf.tx.iloc[0]], "ty": [pdf.ty.iloc[0]], "n": [len(pdf)], "payload": [gzip.compress(data, 6, mtime=0) if compress else data]})

    return pyramid.groupBy("z", "tx", "ty").applyInPandas(run, "z int, tx long, ty long, n long, payload binary")


def decode_tiles(tiles: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for z, tx, ty, data in zip(pdf.z, pdf.tx, pdf.ty, pdf.payload):
                d = decode_tile(bytes(data))
                yield d.assign(z=z, tx=tx, ty=ty)[["z", "tx", "ty", *_ROW.names]].astype({"id": "int64", "category": "int64", "importance": "int32"})

    return tiles.select("z", "tx", "ty", "payload").mapInPandas(run, "z int, tx long, ty long, x float, y float, id long, category long, importance int")


def tiles_as_json(pyramid: DataFrame) -> DataFrame:
    p = F.struct("x", "y", "id", F.col("category").alias("cluster"), "importance")
    return pyramid.groupBy("z", "tx", "ty").agg(F.to_json(F.array_sort(F.collect_list(p), lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1))).alias("points"))


def tiles_from_json(tiles: DataFrame) -> DataFrame:
    kind = "array<struct<x:float,y:float,id:bigint,cluster:bigint,importance:int>>"
    return tiles.select("z", "tx", "ty", F.inline(F.from_json("points", kind)))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """A Parquet table partitioned by zoom: a viewport reads the partitions and row groups that it meets."""
    tiles.repartition("z", "tx").sortWithinPartitions("tx", "ty").write.mode("overwrite").partitionBy("z").parquet(path)


# -- neighbour blocks and shards -------------------------------------------------

_KNN = struct.Struct(fixed.NEIGHBOUR_HEADER)


def encode_neighbours(pdf: pd.DataFrame, k: int) -> bytes:
    """``dst`` of rows sorted by (src, rank), k a row."""
    return _KNN.pack(fixed.NEIGHBOUR_MAGIC, fixed.NEIGHBOUR_VERSION, k, len(pdf) // k) + pdf["dst"].to_numpy("<u4").tobytes()


def decode_neighbours(data: bytes, rows: slice = slice(None)) -> np.ndarray:
    """Neighbours of all rows, or of a slice of them."""
    magic, version, k, n = _KNN.unpack_from(data)
    if magic != fixed.NEIGHBOUR_MAGIC or version != fixed.NEIGHBOUR_VERSION:
        raise ValueError("not a neighbour table of this version")
    return np.frombuffer(data, "<u4", n * k, _KNN.size).reshape(n, k)[rows]


def with_shard(df: DataFrame, key: str = "id", rows: int = fixed.SHARD_ROWS) -> DataFrame:
    return df.withColumn("shard", F.lpad(F.floor(F.col(key) / rows).cast("string"), 4, "0"))


def write_shards(df: DataFrame, path: str, key: str = "id", rows: int = fixed.SHARD_ROWS) -> None:
    """A Parquet table with a folder for each shard."""
    with_shard(df, key, rows).repartition("shard").sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, keys: list[int], key: str = "id", rows: int = fixed.SHARD_ROWS) -> DataFrame:
    """The rows of a few keys; only their shards' folders are read."""
    shards = sorted({f"{k // rows:04d}" for k in keys})
    return spark.read.parquet(path).filter(F.lpad(F.col("shard").cast("string"), 4, "0").isin(shards) & F.col(key).isin(list(keys)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.inline("categories"))


def validate(nodes: DataFrame) -> list[str]:
    """The first ten problems of a manifest."""
    from ..operators.hierarchy import validate_manifest

    return [f"{r['node']}: {r['problem']}" for r in validate_manifest(nodes).orderBy("node", "problem").limit(10).collect()]


def write_manifest(nodes: DataFrame, path: str) -> None:
    """Refuses a manifest with problems and names the first ten."""
    if wrong := validate(nodes):
        raise ValueError("; ".join(wrong))
    nodes.write.mode("overwrite").json(path)


def synthetic_points(spark: SparkSession, n: int, clusters: int = 60, seed: int = 0) -> DataFrame:
    """Gaussian clusters of unequal sizes with Pareto importance; an own distribution, the same for a seed."""
    c = F.floor(F.pow(F.rand(seed), 2.0) * clusters).cast("long")
    df = spark.range(n).withColumn("category", c)
    spread = 0.6 + 3.4 * F.pmod(F.xxhash64("category"), F.lit(97)) / 97
    centre = lambda k: F.pmod(F.xxhash64("category", F.lit(k)), F.lit(1000)) / 10.0 - 50
    df = df.withColumn("x", (centre(1) + spread * F.randn(seed + 1)).cast("float")).withColumn("y", (centre(2) + spread * F.randn(seed + 2)).cast("float"))
    return df.withColumn("importance", F.pow(1 - F.rand(seed + 3), -1 / 1.2) - 1)
