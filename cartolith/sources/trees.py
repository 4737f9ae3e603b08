"""Cluster trees as JSON: one object of nodes, each with its parent, children, depth and members."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import read_bytes, write_bytes

NODE = "node long, parent long, depth int, size long, label string, confidence string, purity double"


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(nodes, members, terms, meta): members are (item, node), terms (node, k, term, score)."""
    meta = json.loads(read_bytes(spark, path)).get("meta", {})
    text = spark.read.text(path, wholetext=True)

    def each(rows_of, columns):
        def run(batches):
            for pdf in batches:
                for value in pdf["value"]:
                    rows = [r for key, rec in json.loads(value)["nodes"].items() for r in rows_of(int(key), rec)]
                    for at in range(0, len(rows), 50_000):
                        yield pd.DataFrame(rows[at : at + 50_000], columns=columns).convert_dtypes()

        return run

    node = each(lambda k, r: [(k, r.get("parent"), r.get("depth"), r.get("size", len(r.get("members", []))), r.get("label"), r.get("confidence"), r.get("purity"))], [c.split()[0] for c in NODE.split(", ")])
    member = each(lambda k, r: [(int(m), k) for m in r.get("members", [])], ["item", "node"])
    term = each(lambda k, r: [(k, i + 1, t, float(s)) for i, (t, s) in enumerate(r.get("terms") or [])], ["node", "k", "term", "score"])
    return text.mapInPandas(node, NODE), text.mapInPandas(member, "item long, node long"), text.mapInPandas(term, "node long, k int, term string, score double"), meta


def save_tree(nodes: DataFrame, members: DataFrame, path: str, meta: dict | None = None, terms: DataFrame | None = None) -> None:
    """Write (node, parent, depth, size, ...) and (item, node) as one JSON object; the tree of a map, so of bounded size."""
    spark = nodes.sparkSession
    held = members.groupBy("node").agg(F.sort_array(F.collect_list("item")).alias("members"))
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sort_array(F.collect_list("node")).alias("children"))
    rows = nodes.join(held, "node", "left").join(kids, "node", "left")
    if terms is not None:
        named = terms.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "term", "score"))).alias("terms"))
        rows = rows.join(named, "node", "left")
    out, root = {}, None
    for r in rows.orderBy("node").toLocalIterator():
        rec = {k: v for k, v in r.asDict().items() if k != "node" and v is not None}
        rec["parent"], rec["members"], rec["children"] = r["parent"], list(r["members"] or []), list(r["children"] or [])
        if terms is not None:
            rec["terms"] = [[t["term"], t["score"]] for t in r["terms"] or []]
        out[str(r["node"])] = rec
        root = r["node"] if r["parent"] is None else root
    write_bytes(spark, path, json.dumps({"meta": meta or {}, "root": root, "nodes": out}).encode())
