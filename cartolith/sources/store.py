"""The catalog's tables: as Parquet under one folder, or read from and written to a SQLite file."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table; identifiers, texts, JSON lists, counts and times as the catalog's files have them.
TABLES = {
    "games": "appid long, name string, short_desc string, long_desc string, tags string, genres string, release_date string, review_count long, review_score double, price double, fetched_at string",
    "failures": "appid long, status string, tries long",
    "crawl_log": "appid long, fetched_at string, n_tags long",
}
_SQL = {"long": "INTEGER", "string": "TEXT", "double": "REAL"}


def open_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables, made empty where they aren't there yet."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, schema in TABLES.items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(hadoop).exists(path):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
        out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return out


def replace_table(rows: DataFrame, folder: str, name: str) -> None:
    """Write a table anew, in order of its key, so a reader's filters skip row groups."""
    wanted = [c.split()[0] for c in TABLES[name].split(", ")]
    rows.select(*wanted).repartitionByRange("appid").sortWithinPartitions("appid").write.mode("overwrite").parquet(f"{folder}/{name}")


def read_sqlite(spark: SparkSession, path: str, name: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file that all machines reach; each task reads one range of identifiers."""
    schema = TABLES[name]
    columns = [c.split()[0] for c in schema.split(", ")]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"SELECT min(appid), max(appid) FROM {name}").fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)

    def run(batches):
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for pdf in batches:
                for k in pdf["id"]:
                    found = db.execute(f"SELECT {', '.join(columns)} FROM {name} WHERE appid >= ? AND appid < ? ORDER BY appid", (low + int(k) * step, low + (int(k) + 1) * step))
                    while rows := found.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=columns).convert_dtypes()

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def write_sqlite(rows: DataFrame, path: str, name: str) -> None:
    """Rows by key into a SQLite file, one replaced for another; streamed through the driver, its only writer."""
    fields = [c.split() for c in TABLES[name].split(", ")]
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("PRAGMA synchronous=NORMAL")
        db.execute(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(c + ' ' + _SQL[k] + (' PRIMARY KEY' if c == 'appid' else '') for c, k in fields)})")
        if name == "games":
            db.execute("CREATE INDEX IF NOT EXISTS games_reviews ON games (review_count)")
        put = f"INSERT OR REPLACE INTO {name} VALUES ({', '.join('?' * len(fields))})"
        held: list = []
        for r in rows.select(*[c for c, _ in fields]).toLocalIterator():
            held.append(tuple(r))
            if len(held) == 10_000:
                db.executemany(put, held)
                db.commit()
                held.clear()
        db.executemany(put, held)


LOOKED_UP = "id long, status string, name string, tags array<string>, positive long, negative long"


def look_up(worklist: DataFrame, fetch, delay: float = 1.05, tries: int = 3, back_off: float = 60.0) -> DataFrame:
    """Answers of ``fetch(id)`` for a work list: (id, status, name, tags, positive, negative).

    ``fetch`` gives (HTTP status, object or None).  Status 429 waits and tries
    again; an answer that is no object or has no name is ``no_data``; other
    errors become the status, cut to 200 characters.  Repartition the list to
    one task to keep a rate limit of one caller.
    """

    def one(i):
        import time

        for k in range(tries):
            try:
                code, body = fetch(i)
            except Exception as e:  # noqa: BLE001  (whatever the network throws is a status)
                return (i, str(e)[:200], None, None, None, None)
            if code != 429:
                break
            if k + 1 < tries:
                time.sleep(back_off)
        if code == 429:
            return (i, "http 429", None, None, None, None)
        if not isinstance(body, dict) or body.get("name") is None:
            return (i, "no_data", None, None, None, None)
        tags = body.get("tags") or {}
        ordered = [t for t, _ in sorted(tags.items(), key=lambda x: -int(x[1]))] if isinstance(tags, dict) else list(tags)
        return (i, "ok", str(body["name"]), ordered, int(body.get("positive") or 0), int(body.get("negative") or 0))

    def run(batches):
        import time

        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rows.append(one(int(i)))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LOOKED_UP.split(", ")])

    return worklist.select(F.col("id").cast("long").alias("id")).mapInPandas(run, LOOKED_UP)
