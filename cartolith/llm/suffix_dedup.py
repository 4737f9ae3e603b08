"""Removal of repeated passages: bytes covered by a window that also starts elsewhere.

1. Anchors.  Each 200-byte window has an anchor, its 48-byte string of smallest
   hash (the leftmost of equals).  Equal windows have equal anchors at the same
   offset, so a window can only repeat where its anchor does; windows that
   follow each other share theirs, about one anchor for 76 bytes.
2. Stretches of text around anchors that occur more than once are gathered by
   anchor, equal stretches once with their count.
3. The stretches of an anchor are ordered as suffixes by linear grouping
   (``RepeatedWindows.java``), where windows that occur twice become neighbours.
   Groups too large for a task are split by the bytes that windows at nearby
   offsets must share, down to single windows.
4. Covered bytes go back to the documents.

Copies of a whole text are known by its digest and take part once; texts are told
apart by 128 bits of it.

Switches by size change the way, never the result; tests cover both sides:
``GROUP`` stretches of an anchor (ordered at once, or split by content) and
``SEGMENT`` bytes of a text (looked at in one go).

Defined cases: a null text is empty; texts under 200 bytes keep all; a text that
two rows have is removed from both, if it has 200 bytes; rows that share an
identifier, null or not, are told apart by their texts; bytes that aren't a
whole character are removed all the same, judgement is by bytes; texts of any
length are taken whole; an empty table gives no row; further columns, whatever
their names, are left out.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_paths, shared_folder, written
from .jaccard_join import SLOTS, slot_counts
from .textbytes import splitmix

WINDOW, ANCHOR = 200, 48
#: Distinct stretches of an anchor that one task orders; about 300 bytes each.
GROUP = 2048
#: Bytes of a text that are looked at in one go; windows across the cut are seen by the next.
SEGMENT = 1 << 20
_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_R_INVERSE = _U(pow(int(_R), -1, 1 << 64))
_BYTE = splitmix(np.arange(256, dtype=_U) + _U(55_001))
_MAX = (1 << 63) - 1


def _powers(base, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006  (a cache for the process)
    have = held.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, _U)
        p[0] = 1
        have = held[int(base)] = np.multiply.accumulate(p)
    return have[:n]


def window_anchors(data: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``data`` (at least one) the smallest hash of an ``anchor``-byte string in it, and whether it begins with that."""
    n, w = len(data), window - anchor + 1
    with np.errstate(over="ignore"):
        upto = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * _powers(_R, n), out=upto[1:])
        h = splitmix((upto[anchor:] - upto[:-anchor]) * _powers(_R_INVERSE, n - anchor + 1))
    # Sliding minimum: blocks of w, smallest so far from either end.
    m = len(h)
    blocks = np.r_[h, np.full((-m) % w, _U(0xFFFFFFFFFFFFFFFF))].reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: m - w + 1], left[w - 1 : m])
    return least, h[: m - w + 1] == least


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of stretches of windows with one anchor at one place."""
    out = []
    for at in range(0, max(1, len(data) - WINDOW + 1), SEGMENT):
        part = data[at : at + SEGMENT + WINDOW - 1]
        if len(part) < WINDOW:
            break
        a, begins = window_anchors(part)
        first = np.r_[0, np.flatnonzero((a[1:] != a[:-1]) | begins[:-1]) + 1]
        out.append((a[first].view(np.int64), first + at, np.diff(np.r_[first, len(a)])))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans, sorted."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], axis=1)


# -- the suffix order on the JVM ------------------------------------------------


def register_covered(spark: SparkSession, name: str = "covered_by_repeats") -> str:
    """Compile the Java source beside this file with the compiler that Spark brings, and register it.

    The jar goes to the shared folder, from which executors fetch it.
    """
    jvm = spark.sparkContext._jvm
    source = (Path(__file__).parent / "RepeatedWindows.java").read_text()
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(source)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as jar:
        for k, v in dict(compiler.getBytecodes()).items():
            jar.writestr(k.replace(".", "/") + ".class", bytes(v))
    where = f"{shared_folder(spark)}/repeated-windows-{hashlib.sha1(source.encode()).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}.jar"
    path = jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sql(f"ADD JAR '{where}'")
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    made = loader.loadClass("RepeatedWindows").getDeclaredConstructor(None).newInstance(None)
    spark._jsparkSession.udf().register(name, made, spark._jsparkSession.parseDataType(T.ArrayType(T.IntegerType()).json()))
    return name


# -- stages ------------------------------------------------------------------------


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(anchor, t, u, times): the distinct anchors of each text and how many runs they have in it."""

    def run(batches):
        for batch in batches:
            t, u, out = batch.column("t").to_pylist(), batch.column("u").to_pylist(), []
            for k, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                a, c = np.unique(runs(np.frombuffer(data, np.uint8))[0], return_counts=True)
                out.append((a, np.full(len(a), t[k]), np.full(len(a), u[k]), c.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["anchor", "t", "u", "times"])

    return texts.select("t", "u", "text").mapInArrow(run, "anchor long, t long, u long, times int")


def _stretches(texts: DataFrame) -> DataFrame:
    """(anchor, c, stretch, windows, t, u, at): the stretches of each text around its anchors in ``anchors``.

    A stretch that a text has several times comes once, with all its places.
    """

    def run(batches):
        for batch in batches:
            out = []
            for t, u, data, wanted in zip(batch.column("t").to_pylist(), batch.column("u").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("anchors")):
                a, first, n = runs(np.frombuffer(data, np.uint8))
                keep = np.isin(a, wanted.values.to_numpy(zero_copy_only=False))
                places: dict[tuple[int, bytes], list[int]] = {}
                for x, f, k in zip(a[keep].tolist(), first[keep].tolist(), n[keep].tolist()):
                    places.setdefault((x, data[f : f + k + WINDOW - 1]), []).append(f)
                for (x, s), at in places.items():
                    c = int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)
                    out.append((x, c, s, len(s) - WINDOW + 1, t, u, at))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["anchor", "c", "stretch", "windows", "t", "u", "at"])

    return texts.mapInArrow(run, "anchor long, c long, stretch binary, windows int, t long, u long, at array<int>")


def _ordered(groups: DataFrame, key: list[str], covered: str) -> DataFrame:
    """(anchor, c, lo, hi): covered bytes of the distinct stretches of each group, which is bounded."""
    one = groups.groupBy(*key).agg(F.collect_list(F.struct("c", "off", "stretch", "windows", "times")).alias("g"))
    one = one.filter((F.size("g") > 1) | (F.col("g")[0]["times"] > 1))
    got = one.withColumn("o", F.call_udf(covered, *[F.transform("g", lambda x: x["stretch"]), F.transform("g", lambda x: x["windows"]), F.transform("g", lambda x: F.least(x["times"], F.lit(2)).cast("int"))], F.lit(WINDOW)))
    spans = got.filter(F.size("o") > 0).select("anchor", "g", F.explode(F.transform(F.sequence(F.lit(0), F.expr("CAST(size(o) DIV 3 AS INT) - 1")), lambda i: F.struct(F.col("o")[3 * i].alias("i"), F.col("o")[3 * i + 1].alias("lo"), F.col("o")[3 * i + 2].alias("hi")))).alias("x"))
    spans = spans.withColumn("m", F.col("g")[F.col("x.i")])
    return spans.select("anchor", "m.c", (F.col("m.off") + F.col("x.lo")).alias("lo"), (F.col("m.off") + F.col("x.hi")).alias("hi"))


def _covered_stretches(spark: SparkSession, found: DataFrame, group: int) -> list[DataFrame]:
    """(anchor, c, lo, hi) over all anchors; large groups are split by content."""
    covered = register_covered(spark)
    distinct = found.groupBy("anchor", "c").agg(F.first("stretch").alias("stretch"), F.first("windows").alias("windows"), F.sum(F.size("at")).alias("times"))
    held = written(distinct.withColumn("off", F.lit(0)), "stretches")
    sizes = held.groupBy("anchor").agg(F.count("*").alias("k"), F.max("times").alias("most")).filter("k > 1 OR most > 1")
    small = held.join(sizes.filter(F.col("k") <= group).select("anchor"), "anchor")
    out = [_ordered(small, ["anchor"], covered)]
    large = sizes.filter(F.col("k") > group).select("anchor")
    rest = held.join(large, "anchor")
    if large.isEmpty():
        return out
    for width in (32, 1):
        # Windows of one anchor at nearby offsets share most bytes: those are the key.
        # The anchor's own place in a stretch isn't kept; its first windows decide the offset class.
        pieces = written(_pieces(rest, width), "pieces")
        grouped = written(pieces.groupBy("anchor", "cls", "core", "c2").agg(F.first("stretch").alias("stretch"), F.first("windows").alias("windows"), F.sum("times").alias("times")), "distinct-pieces")
        n = grouped.groupBy("anchor", "cls", "core").agg(F.count("*").alias("k"), F.max("times").alias("most")).filter("k > 1 OR most > 1")
        fit = grouped.join(n.filter(F.col("k") <= group).select("anchor", "cls", "core"), ["anchor", "cls", "core"])
        out.append(_ordered_pieces(fit, pieces, covered))
        heavy = n.filter(F.col("k") > group).select("anchor", "cls", "core")
        if width == 1 or heavy.isEmpty():
            break
        rest = pieces.join(heavy, ["anchor", "cls", "core"]).select("anchor", "c", "off", "stretch", "windows", "times")
    return out


def _pieces(df: DataFrame, width: int) -> DataFrame:
    """Cut stretches into pieces of windows whose anchor offsets fall in one class of ``width``.

    (anchor, cls, core, c2, c, off, stretch, windows, times): ``core`` is a
    digest of the bytes that all windows of the class have in common.
    """

    def run(batches):
        for batch in batches:
            out = []
            for anchor, c, off, s, n, times in zip(*(batch.column(k).to_pylist() for k in ("anchor", "c", "off", "stretch", "windows", "times"))):
                data = np.frombuffer(s, np.uint8)
                with np.errstate(over="ignore"):
                    upto = np.zeros(len(data) + 1, _U)
                    np.cumsum(_BYTE[data] * _powers(_R, len(data)), out=upto[1:])
                    h = splitmix((upto[ANCHOR:] - upto[:-ANCHOR]) * _powers(_R_INVERSE, len(data) - ANCHOR + 1)).view(np.int64)
                spots = np.flatnonzero(h == anchor)
                cls = {}
                for w in range(n):  # the leftmost place of the anchor in the window
                    k = spots[np.searchsorted(spots, w)] - w
                    cls.setdefault((int(k) // width, int(spots[np.searchsorted(spots, w)])), []).append(w)
                for (q, _), ws in cls.items():
                    lo, hi = ws[0], ws[-1]
                    spot = int(spots[np.searchsorted(spots, lo)])
                    core = s[max(0, spot - q * width) : spot - q * width - width + 1 + WINDOW]
                    piece = s[lo : hi + WINDOW]
                    out.append((anchor, q, hashlib.blake2b(core, digest_size=12).hexdigest(), hashlib.blake2b(piece, digest_size=12).hexdigest(), c, off + lo, piece, hi - lo + 1, times))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["anchor", "cls", "core", "c2", "c", "off", "stretch", "windows", "times"])

    return df.select("anchor", "c", "off", "stretch", "windows", "times").mapInArrow(run, "anchor long, cls int, core string, c2 string, c long, off int, stretch binary, windows int, times long")


def _ordered_pieces(fit: DataFrame, pieces: DataFrame, covered: str) -> DataFrame:
    """Covered bytes of distinct pieces, brought back to every stretch that has them by a join."""
    key = F.concat_ws("/", "cls", "core", "c2")
    marked = _ordered(fit.withColumn("c", key).withColumn("off", F.lit(0)), ["anchor", "cls", "core"], covered)
    back = pieces.select("anchor", key.alias("piece"), "c", "off")
    return marked.withColumnRenamed("c", "piece").join(back, ["anchor", "piece"]).select("anchor", "c", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))


def _filtered_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents (id, text, ...) with the text only where ``wanted`` may have the id; a bitmap of fixed size tells."""
    slot = lambda ids: (splitmix(ids.astype(np.int64).view(_U)) & _U(SLOTS - 1)).astype(np.int64)
    bits = np.packbits(slot_counts(wanted, lambda b: slot(b.column(0).to_numpy(zero_copy_only=False)), ["id"]) > 0)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        wants = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wants[slot(batch.column("id").to_numpy(zero_copy_only=False))]))
            if batch.num_rows:
                yield batch

    return docs.mapInArrow(run, docs.schema)


def _text_keys() -> dict[str, Column]:
    """Two numbers of 64 bits, each from one half of the digest."""
    return {"t": F.xxhash64(F.left("digest", F.lit(32))), "u": F.xxhash64(F.right("digest", F.lit(32)))}


def repeated_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (id, digest, n_bytes, t, u); spans (t, u, s, id) of texts with covered bytes.

    Texts that two rows or more have are covered whole and aren't in ``spans``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX)).alias("id"), text.alias("text")).withColumn("digest", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long"))
    keyed = keyed.withColumns(_text_keys())
    long = keyed.filter(F.col("n_bytes") >= WINDOW)
    rows = written(keyed.select("id", "digest", "n_bytes", "t", "u"), "texts")
    # Anchors of more than one text, or more than once in one.
    anchors = written(_anchor_rows(long), "anchors")
    ends = [f(c).alias(f"{n}{c}") for n, f in (("a", F.min), ("b", F.max)) for c in ("t", "u")]
    again = anchors.groupBy("anchor").agg(*ends, F.max("times").alias("m")).filter("at <> bt OR au <> bu OR m > 1").select("anchor")
    # A text that several rows have is looked at in the row of its smallest id.
    first = rows.filter(F.col("n_bytes") >= WINDOW).groupBy("t", "u").agg(F.min("id").alias("id"))
    wanted = anchors.join(again, "anchor").groupBy("t", "u").agg(F.collect_set("anchor").alias("anchors"))  # a text's own, distinct in `anchors`
    wanted = written(wanted.join(first, ["t", "u"]).select("id", "t", "u", "anchors"), "wanted")
    picked = _filtered_texts(long.select("id", "t", "u", "text"), wanted).join(wanted, ["id", "t", "u"]).select("t", "u", "text", "anchors")
    found = written(_stretches(picked), "stretches-found")
    drop_paths(spark, anchors)
    parts = _covered_stretches(spark, found, group)
    marks = parts[0]
    for p in parts[1:]:
        marks = marks.union(p)
    marks = marks.groupBy("anchor", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("m"))
    at = found.select("anchor", "c", "t", "u", "at").join(marks, ["anchor", "c"])
    spans = at.groupBy("t", "u").agg(F.collect_list(F.struct("at", "m")).alias("s"))
    return rows, written(spans.join(wanted.select("t", "u", "id"), ["t", "u"]).select("id", "t", "u", "s"), "spans")


def spans_array(pieces) -> np.ndarray:
    """Union of the spans that the pieces (at, m) of one text cover."""
    out = [np.array([[a + x["lo"], a + x["hi"]] for x in p["m"] for a in p["at"]], np.int64) for p in pieces]
    return _merged(np.concatenate(out))


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = False, group: int = GROUP) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans, kept_sha256.

    ``full`` adds digest (SHA-256 of the text), kept (the remaining bytes) and
    kept_text (the remaining whole characters); the last two are null where
    nothing was removed.
    """
    rows, spans = repeated_spans(spark, docs, id_col, text_col, group)
    copies = rows.filter(F.col("n_bytes") >= WINDOW).groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").select("digest")
    copied = rows.join(copies, "digest", "left_semi")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX)).alias("id"), text.alias("text")).withColumn("digest", F.sha2("text", 256)).withColumns(_text_keys())
    cut = _filtered_texts(keyed.select("id", "t", "u", "text"), spans).join(spans, ["id", "t", "u"])

    def run(batches):
        for batch in batches:
            out = []
            for i, t, h, data, s in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), batch.column("u").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("s").to_pylist()):
                u = spans_array(s)
                edges = np.r_[0, u.ravel(), len(data)].tolist()
                pieces = [data[a:b] for a, b in zip(edges[0::2], edges[1::2])]
                kept = b"".join(pieces)
                whole = "".join(x.decode("utf-8", "ignore") for x in pieces) if full else ""
                out.append((i, t, h, int((u[:, 1] - u[:, 0]).sum()), len(u), hashlib.sha256(kept).hexdigest(), kept if full else b"", whole))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["id", "t", "u", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])

    made = written(cut.select("id", "t", "u", "text", "s").mapInArrow(run, "id long, t long, u long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string"), "kept")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = copied.select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), F.lit(b"").alias("kept"), F.lit("").alias("kept_text"), "digest")
    single = rows.join(copies, "digest", "left_anti")
    zero = F.lit(0).cast("long")
    rest = single.join(made, ["id", "t", "u"], "left").select("id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"), "kept", "kept_text", "digest")
    both = whole.unionByName(rest).withColumn(id_col, F.nullif(F.col("id"), F.lit(_MAX)))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return both.select(*names, "digest", "kept", "kept_text") if full else both.select(*names)
