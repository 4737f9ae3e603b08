"""Vector and column archives (npz): read in a task, written from a checked size."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import read_bytes, write_bytes

#: An archive is one file that one process writes: at most so many numbers.
MOST_NUMBERS = 500_000_000


def _kinds(data: bytes) -> dict[str, np.dtype]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k].dtype for k in z.files if z[k].ndim == 1}


def read_npz_columns(spark: SparkSession, path: str) -> DataFrame:
    """The one-dimensional arrays of an archive as columns."""
    kinds = _kinds(read_bytes(spark, path))
    spark_kind = {"f": "double", "i": "bigint", "u": "bigint", "U": "string", "b": "boolean"}
    schema = ", ".join(f"`{k}` {spark_kind[v.kind]}" for k, v in kinds.items())
    if not schema:
        raise ValueError(f"no one-dimensional arrays in {path}")

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
                    cols = {k: z[k] for k in kinds}
                if len({len(v) for v in cols.values()}) > 1:
                    raise ValueError("arrays of different lengths")
                wide = {k: v.astype("float64") if v.dtype.kind == "f" else v.astype("int64") if v.dtype.kind in "iu" else v for k, v in cols.items()}
                n = len(next(iter(wide.values())))
                for at in range(0, max(n, 1), 100_000):
                    yield pd.DataFrame({k: v[at : at + 100_000] for k, v in wide.items()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def load_vectors(spark: SparkSession, path: str, ids: str = "appids", values: str = "X") -> tuple[DataFrame, dict]:
    """(id, features) of 32-bit numbers and the archive's meta data."""
    with np.load(io.BytesIO(read_bytes(spark, path)), allow_pickle=False) as z:
        meta = json.loads(str(z["meta"])) if "meta" in z.files else {}

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
                    key, x = z[ids].astype("int64"), z[values].astype("float32")
                for at in range(0, len(key), 10_000):
                    yield pd.DataFrame({"id": key[at : at + 10_000], "features": list(x[at : at + 10_000])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, features array<float>"), meta


def save_vectors(vectors: DataFrame, path: str, meta: dict | None = None, ids: str = "appids", values: str = "X") -> None:
    """Half-precision vectors by id, with meta data, as one compressed archive; for larger tables write Parquet."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if size["n"] * (size["d"] or 0) > MOST_NUMBERS:
        raise ValueError(f"{size['n']} x {size['d']} numbers are too many for one archive; write Parquet")
    local = vectors.select("id", "features").toPandas().sort_values("id")
    out = io.BytesIO()
    x = np.array([np.asarray(v, "float32") for v in local["features"]], "float32").reshape(len(local), -1)
    np.savez_compressed(out, **{values: x.astype("float16"), ids: local["id"].to_numpy("int64"), "meta": np.array(json.dumps(meta or {}))})
    write_bytes(vectors.sparkSession, path, out.getvalue())
