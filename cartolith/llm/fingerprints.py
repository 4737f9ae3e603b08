"""Document fingerprints by one-permutation MinHash.

Each shingle is hashed once.  The top bits choose one of ``BINS`` bins, a bin
keeps its smallest hash, and an empty bin copies from the first filled bin of
its own fixed random order of bins (optimal densification).  ``BITS``
bits of each bin's rehashed minimum are packed into a hexadecimal string; a likeness is the share
of equal bins, corrected for the ``2**-BITS`` that agree by chance.

Defined cases: a null text is empty; a text without words has the empty
fingerprint, is like another such text with 1.0 and like any other text with
0.0; documents of one doc_id are ordered by their texts; a null doc_id comes
below all others; the only document of a table is its own next one; an empty
table gives no row; texts of any length are taken whole; further columns,
whatever their names, are left out.  Texts that fill few bins are densified by
another loop, with the same values.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import batches as byte_batches
from .textbytes import shingles, splitmix

BINS, BITS, WORDS = 1024, 4, 5


@lru_cache(1)
def bin_orders(bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Each bin's order of all bins, and each bin's place in that order."""
    keys = splitmix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(77_777_777)).reshape(bins, bins)
    np.fill_diagonal(keys, 0)  # a filled bin is the first of its own order
    order = np.argsort(keys, axis=1, kind="stable").astype(np.int16)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(bins, dtype=np.int16)[None, :], axis=1)
    return order, place


def signatures(sets: list[np.ndarray], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Packed-bit values, one row of ``bins`` a set; a row of zeros for an empty set."""
    order, place = bin_orders(bins)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    sizes = np.array([len(s) for s in sets])
    held_hash, filled = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    if not sizes.sum():
        return np.zeros((len(sets), bins), np.uint8)
    hashes = np.concatenate(sets)
    key = np.repeat(np.arange(len(sets)) * bins, sizes) + (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # sorted sets: the smallest of a bin comes first
    held_hash.ravel()[key[first]] = hashes[first]
    filled.ravel()[key[first]] = True
    held = filled.sum(axis=1)
    for d in np.flatnonzero((held > 0) & (held < 64)):
        mine = np.flatnonzero(filled[d])
        held_hash[d] = held_hash[d, mine[np.argmin(place[:, mine], axis=1)]]
    rows, cols = np.nonzero(~filled & (held >= 64)[:, None])
    attempt = 0
    while len(rows):
        pick = order[cols, attempt]
        good = filled[rows, pick]
        held_hash[rows[good], cols[good]] = held_hash[rows[good], pick[good]]
        rows, cols, attempt = rows[~good], cols[~good], attempt + 1
    # The bits are those of the hash times an odd number of the bin: where two
    # hashes agree in one bin's bits by chance, they needn't in the next.
    odd = splitmix(np.arange(bins, dtype=np.uint64) + np.uint64(123_457)) | np.uint64(1)
    return ((held_hash * odd) >> np.uint64(64 - bits)).astype(np.uint8)


def packed(codes: np.ndarray, empty: np.ndarray, bits: int = BITS) -> list[str]:
    both = (codes[:, 0::2] << bits) | codes[:, 1::2]
    return ["" if e else row.tobytes().hex() for row, e in zip(both, empty)]


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray, bits: int = BITS) -> np.ndarray:
    chance = 2.0**-bits
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), found)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` gives way to the first as many code points of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids, texts: list[str], before: str):
    """Rows for texts in ascending order; ``before`` precedes the first."""
    others = [before, *texts[:-1]]
    changed = [edited(t, o) for t, o in zip(texts, others)]
    every = [x.encode("utf-8", "surrogatepass") for x in [before, *texts, *changed]]
    sets = shingles(every, WORDS)
    n, codes, empty = len(texts), signatures(sets), np.array([not len(s) for s in sets])
    own, new, prev = slice(1, n + 1), slice(n + 1, None), slice(0, n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in every[new]], pa.string()),
            pa.array(packed(codes[own], empty[own]), pa.string()),
            pa.array(packed(codes[new], empty[new]), pa.string()),
            pa.array(likeness(codes[own], codes[new], empty[own], empty[new])),
            pa.array(likeness(codes[own], codes[prev], empty[own], empty[prev])),
        ],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def fingerprint_neighbours(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and its edited text, in one shuffle by id ranges.

    The bounds of the ranges are quantiles of the ids, so each range is a sorted
    stretch of the table.  A copy of the row before each stretch goes with it;
    these copies are as many as there are ranges.
    """
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), order.alias("place"), F.coalesce(text_col, F.lit("")).alias("text"))
    bounds = sorted({int(x) for x in rows.select("place").approxQuantile("place", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    inside = F.lit(0) if not bounds else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("place")))
    rows = rows.withColumn("part", inside)
    tops = sorted((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("place").alias("top")).collect())  # one a range
    if not tops:
        return spark.createDataFrame([], SCHEMA)
    lead = [(tops[i][0], tops[i - 1][1]) for i in range(len(tops))]
    leads = spark.createDataFrame(lead, "to_part int, top long")
    before = rows.select("place", "text").join(F.broadcast(leads), F.col("place") == F.col("top")).groupBy("to_part").agg(F.max("text").alias("text"))
    both = rows.select("part", F.lit(False).alias("ahead"), "doc_id", "place", "text").unionByName(
        before.select(F.col("to_part").alias("part"), F.lit(True).alias("ahead"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("place"), "text")
    )
    dealt = both.repartition(max(1, len(tops)), "part").sortWithinPartitions("part", F.desc("ahead"), "place", "text")

    def run(batches):
        last = ""
        for batch in batches:
            ahead, ids, texts = (batch.column(c).to_pylist() for c in ("ahead", "doc_id", "text"))
            at = 0
            while at < len(texts):
                if ahead[at]:
                    last, at = texts[at], at + 1
                    continue
                end = at
                while end < len(texts) and not ahead[end]:
                    end += 1
                for a, b in byte_batches(texts[at:end], 400_000):
                    yield _rows(ids[at + a : at + b], texts[at + a : at + b], last)
                    last = texts[at + b - 1]
                at = end

    return dealt.mapInArrow(run, SCHEMA)
