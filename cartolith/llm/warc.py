"""WARC archives: writing, reading back, and revisit resolution by payload digest.

Archives are ``.warc.gz`` files of WARC/1.1 records, one gzip member a record,
rolled at a size, in the folder that driver and executors share.  Payloads never
pass a shuffle by digest: only headers do, so a payload that a third of all
pages have costs a counted group of small rows, not a heap of bodies.

Each file begins with a warcinfo record.  A revisit names the response's record,
URI and date; all records of a call have the date of the call.

Defined cases: a null payload is empty; a null identifier sorts below all
others; of rows that repeat an identifier and a payload each one is written,
and all that carry the keeper's identifier are responses; where those have
different URIs, revisits name the greatest; a null URI gives no such field;
payloads of any length are written whole; an empty table gives no archive and no
row; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

MANIFEST = "path string, records long, bytes long"
RECORD = "record_key long, target string, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string, stored_bytes long"
_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def dedup_decisions(headers: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """For (key, url, payload_bytes, payload_digest) the record type and the response's key and URI.

    Headers alone are shuffled by digest; the group's largest key is found by a
    partial aggregate before the shuffle.  Keepers are dealt anew before the join
    so that AQE can split a digest that very many pages have.
    """
    heads = headers.groupBy("key", "payload_bytes", "payload_digest").agg(F.max("url").alias("url"))
    best = F.max(F.struct(F.col("key").alias("keeper"), F.col("url").alias("keeper_url"))).alias("best")
    keeper = (
        heads.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(best, F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "best.keeper", "best.keeper_url")
        .hint("rebalance")
        .hint("merge")
    )
    # A group of two keys or more has one that isn't null, and nulls sort first: keepers have a key.
    revisit = F.col("keeper").isNotNull() & ~F.col("key").eqNullSafe(F.col("keeper"))
    return heads.join(keeper, "payload_digest", "left").select(
        "key",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
        F.when(revisit, F.col("keeper_url")).alias("refers_to_url"),
    )


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}:{digest}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in fields if v is not None]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _uri(url: str | None) -> str | None:
    """A header field can't hold line ends or other control characters."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def encode_record(key, url, digest: str, payload: bytes, record_type: str, refers_to, date: str, refers_to_url: str | None = None, payload_bytes: int | None = None) -> bytes:
    """A response with its payload, or a revisit whose fresh headers name the response."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    block = _STATUS + b"Content-Length: %d\r\n\r\n" % (len(payload) if payload_bytes is None else payload_bytes)
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{b32}"), ("X-Record-Key", key)]
    if record_type == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", _uri(refers_to_url)), ("WARC-Refers-To-Date", date)]
    else:
        block += payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return _header(fields) + block + b"\r\n\r\n"


def file_record(name: str, date: str) -> bytes:
    """The warcinfo record that a file begins with."""
    block = b"software: cartolith\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'file:' + name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return _header(fields) + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 32 << 20, level: int = 5, date: str | None = None) -> DataFrame:
    """Write (key, url, payload_digest, payload, record_type, refers_to, refers_to_url, payload_bytes); the manifest of the files.

    ``date`` (by default the time of the call, UTC) is that of all records.

    A file's name is new for each attempt of a task and the manifest lists the
    files of attempts that succeeded, so a task that is run again adds no record.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = path = None
        n = size = 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload_digest", "payload", "record_type", "refers_to", "refers_to_url", "payload_bytes"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, n, size = f"{root}/{name}", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                    out.write(gzip.compress(file_record(name, date), level))
                data = encode_record(r[0], r[1], r[2], r[3] or b"", r[4], r[5], date, r[6], r[7])
                out.write(gzip.compress(data, level))
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(records.mapInArrow(run, MANIFEST), "warc-manifest")


def parse_records(stream):
    """(header fields, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b":")
            head[k.decode().lower()] = v.strip().decode()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block


def read_archives(manifest: DataFrame, folder: str, partitions: int) -> DataFrame:
    """The records of all archives; length and SHA-1 are those of the payload as read."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for head, block in parse_records(plain):
                        if head["warc-type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        response = head["warc-type"] == "response"
                        stated = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                        digest = hashlib.sha1(payload).hexdigest() if response else stated
                        if digest != stated:
                            raise ValueError(f"{path}: a payload's digest isn't the stated one")
                        key = head.get("x-record-key")
                        rows.append((None if key is None else int(key), head.get("warc-target-uri"), head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), len(payload) if response else None, digest, len(block)))
                names = [f.split()[0] for f in RECORD.split(", ")]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    # Written: both sides of the later join read it, and archives are parsed once.
    return written(manifest.select("path").repartition(partitions).mapInArrow(run, RECORD), "warc-records")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the length and the key of the response that it refers to.

    Headers are shuffled by digest.  Each digest with revisits has one response
    to refer to, so the right side has one row a key; it is dealt anew before the
    join so that AQE can split a hot digest.  Nothing is broadcast: the size of
    what archives hold can't be told from that of their manifest.
    """
    answers = (
        records.filter("record_type = 'response'")
        .groupBy("payload_digest", F.col("record_id").alias("refers_to_id"))
        .agg(F.max("record_key").alias("answer_key"), F.max("payload_bytes").alias("answer_bytes"))
        .hint("rebalance")
        .hint("merge")
    )
    revisits = records.filter("record_type = 'revisit'").join(answers, ["payload_digest", "refers_to_id"], "left")
    names = ("record_key", "target", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return (
        records.filter("record_type = 'response'")
        .select(*names[:5], F.lit(None).cast("long").alias("refers_to"))
        .unionByName(revisits.select("record_key", "target", F.col("answer_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("answer_key").alias("refers_to")))
        .select(*names)
    )


def deduplicated_archives(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 1000) -> tuple[DataFrame, str]:
    """Decide, write archives with fresh headers; (manifest, folder)."""
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    heads = rows.select("key", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")
    decisions = dedup_decisions(heads, min_bytes).filter("record_type = 'revisit'").withColumnsRenamed({"key": "k", "payload_digest": "d"})
    # Only revisits are joined back, by key and digest: one row each.
    joined = rows.join(decisions, F.col("key").eqNullSafe(F.col("k")) & (F.col("payload_digest") == F.col("d")), "left")
    records = joined.select("key", "url", "payload_digest", F.when(F.col("record_type").isNull(), F.col("payload")).alias("payload"), F.coalesce("record_type", F.lit("response")).alias("record_type"), "refers_to", "refers_to_url", F.octet_length("payload").cast("long").alias("payload_bytes"))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return write_archives(records, folder), folder
