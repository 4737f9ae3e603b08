"""Exact Jaccard join of documents' shingle sets in the metric space of Jaccard distance.

1. Sets that are equal become one.  A fixed-size count of all shingles gives a
   total order of shingles, rare ones first.  Linked sets share one of their
   first ``n - ceil(s n) + 1`` shingles.
2. Documents are pivots: of the sets that have a shingle among their first, the
   one of smallest number is the pivot, and a set is dealt to the regions of all
   pivots that it meets so, near its own or beyond the boundary.  Two linked sets
   are in one region at least, so a region never has to look outside.  A set that
   may be within the similarity of its pivot, by a lower bound of their distance
   (sketches of parities), joins the pivot's family; that is a test a member, whatever the region's size.
3. What is left in a region are sets of different families.  Small regions test
   their pairs; large ones are split by shingle and into rings of size, with a
   window for the boundary, and rings that are large yet by new pivots, over the next common
   shingle that linked sets must have.  Families are disjoint groups that no
   link leaves.
4. A family is joined exactly: sets go to the Voronoi region of their nearest
   pivot and, by the triangle inequality, to every other whose distance is within
   ``2 d`` of that; regions are split again until they are small, and small ones
   are joined by counting common shingles.  Families too heavy for a task are
   split in the same way by a shuffle, and what can't be split further is joined
   block against block.

All pivots can't be measured for all sets: unrelated texts are at a distance of
1 from each other, windows of ``2 d`` around such a distance hold the corpus.  So
a set meets only the pivots it shares a first shingle with; all others are
farther from it than ``d``.

Switches by size change the way, never the result; tests cover both sides:
``SMALL_REGION`` sets (pairs or a split), ``BITS`` of a sketch, ``leaf`` sets and ``task_shingles`` of a family, four levels of shuffled splits
and none that triples a family's weight (then blocks).

Defined cases: texts that are null, empty or without words have no set, are
linked with nothing and are their own component; texts under k words are one
shingle; repeated rows and equal sets are linked; rows that share an identifier
are told apart by their texts; a null identifier takes part with the largest
value and is shown as null; an empty table gives none; texts of any length are
taken whole; further columns, whatever their names, are left alone.  Shingles
are 60-bit hashes, sets and texts are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import components
from .textbytes import batches as byte_batches
from .textbytes import shingles, splitmix

#: Slots of the corpus-wide count and of bitmaps; slices that their partial counts are dealt in.
COUNTED, SLOTS, SLICES = 1 << 22, 1 << 20, 64
#: Shares of the slots, by their counts, at which a shingle's class of rareness rises.
CLASS_SHARES = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 15 / 16, 31 / 32, 63 / 64, 255 / 256)
#: Members of a region whose pairs are tested at once.
SMALL_REGION = 512
#: Shingles of a family that one task takes: 8 bytes each.
TASK_SHINGLES = 3_000_000
_MAX = (1 << 63) - 1
_U = np.uint64


# -- counts of fixed size over the whole corpus ------------------------------


def slot_counts(df: DataFrame, slots_of, columns: list[str], slots: int = SLOTS) -> np.ndarray:
    """How often each of ``slots`` slots occurs; a task's own count of a slot stops at 255.

    A byte a slot and task, whatever the input.  ``slots_of(batch)`` gives slot
    numbers.  Partial counts are added slice by slice, by streaming: first those
    of 256 tasks each, then what that leaves, so no task reads those of all.
    """
    width = slots // SLICES
    names, schema = ["slice", "grp", "counts"], "slice int, grp int, counts binary"

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(slots, np.int32)
        for batch in batches:
            found = slots_of(batch)
            if len(found) * 16 > slots:
                total += np.bincount(found, minlength=slots).astype(np.int32)
            else:
                at, n = np.unique(found, return_counts=True)
                total[at] += n.astype(np.int32)
        if total.any():
            small = np.minimum(total, 255).astype(np.uint8)
            group = pa.array([TaskContext.get().partitionId() >> 8] * SLICES, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), group, pa.array([small[i * width : (i + 1) * width].tobytes() for i in range(SLICES)], pa.binary())], names=names)

    def add(kind):
        def run(batches):
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k, g, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    held[k, g] = held.get((k, g), 0) + np.frombuffer(data, kind).astype(np.int64)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int32()), pa.array([g for _, g in held], pa.int32()), pa.array([np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes() for v in held.values()], pa.binary())], names=names)

        return run

    total = np.zeros(slots, np.uint32)
    groups = df.select(*columns).mapInArrow(count, schema).repartition("slice", "grp").mapInArrow(add(np.uint8), schema)
    parts = groups.withColumn("grp", F.lit(0)).repartition("slice").mapInArrow(add("<u4"), schema)
    for r in parts.collect():  # SLICES rows, 4 bytes a slot
        total[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], "<u4")
    return total


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def shingle_classes(docs: DataFrame, k: int, text_col: str) -> np.ndarray:
    """Rareness class of each slot, from 0 to 15: where its count stands among those of all slots."""

    def slots_of(batch):
        texts = _texts(batch.column(0))
        found = [s for a, b in byte_batches(texts) for s in shingles(texts[a:b], k)]
        return (np.concatenate(found) & _U(COUNTED - 1)).astype(np.int64) if found else np.zeros(0, np.int64)

    counts = slot_counts(docs, slots_of, [text_col], COUNTED)
    np.minimum(counts, 65_535, out=counts)
    # From a histogram: the driver holds a few copies of the counts less than by sorting them.
    upto = np.cumsum(np.bincount(counts, minlength=65_536))
    cuts = np.searchsorted(upto, np.array(CLASS_SHARES) * COUNTED, side="left")
    return np.searchsorted(cuts, np.arange(65_536), side="left").astype(np.uint8)[counts]


def ordered_sets(texts: list[bytes], k: int, classes: np.ndarray) -> list[np.ndarray]:
    """Shingles as keys whose order is class, then hash: the first are the rarest."""
    out = []
    for a, b in byte_batches(texts):
        for s in shingles(texts[a:b], k):
            keys = (classes[(s & _U(COUNTED - 1)).astype(np.int64)].astype(_U) << _U(60)) | (s >> _U(4))
            out.append(np.unique(keys))
    return out


#: Bits of the sketch that regions are tested with.
BITS = 256


def parities(keys: np.ndarray) -> np.ndarray:
    """A sketch of ``BITS`` bits or more, a power of two that is no less than the set's size.

    A shingle turns over the bit that its hash names, so two sketches of one
    size differ in no more bits than the sets in shingles.
    """
    bits = max(BITS, 1 << (len(keys) - 1).bit_length())
    at = (splitmix(keys) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").view("<u8")


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer bits: ``words`` words of 64."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def set_key(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.astype("<u8").tobytes(), digest_size=16).digest()


def prefix_size(n: int, num: int, den: int) -> int:
    return n + (-num * n) // den + 1


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, text): a row is known by its identifier and the digest of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX)).alias("id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))


def signatures(docs: DataFrame, k: int, num: int, den: int, classes, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n, set_key, prefix, sketch): set size, identity of the set, first shingles in the order, parities."""

    def run(batches):
        for batch in batches:
            sets = ordered_sets(_texts(batch.column(2)), k, classes.value)
            prefixes = [s[: prefix_size(len(s), num, den) + 1].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array([parities(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                names=["id", "text_key", "n", "set_key", "prefix", "sketch"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, text_key binary, n long, set_key binary, prefix array<long>, sketch binary")


# -- first level: regions of pivots that share a first shingle -----------------


def may_link(x: bytes, y: bytes, nx: int, ny: int, num: int, den: int) -> bool:
    """Whether sketches allow a link: they bound the sets' symmetric difference from below."""
    if den * min(nx, ny) < num * max(nx, ny):
        return False
    words = min(len(x), len(y)) // 8
    apart = int(np.bitwise_count(folded(np.frombuffer(x, "<u8"), words) ^ folded(np.frombuffer(y, "<u8"), words)).sum())
    return apart * (den + num) <= (nx + ny) * (den - num)


def _dealt(tokens: DataFrame) -> DataFrame:
    """(region, pivot, sid, n, ts) of (region, sid, n, t): sets dealt to the pivots they share shingles ``ts`` with."""
    held = tokens.groupBy("region", "t").agg(F.count("*").alias("members"), F.min("sid").alias("pivot")).filter("members > 1")
    return tokens.join(held, ["region", "t"]).groupBy("region", "pivot", "sid").agg(F.first("n").alias("n"), F.collect_list("t").alias("ts"))


def _of_several(rows: DataFrame) -> DataFrame:
    """Rows of the regions that hold more than one family, with the region's ``members``."""
    several = rows.groupBy("region", "pivot").agg(F.count("*").alias("members"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").drop("a", "b")
    return written(rows.join(several, ["region", "pivot"]), "mixed-regions")


def _mixed(dealt: DataFrame, family: DataFrame) -> DataFrame:
    """Members (but the pivots, which are done) of regions that hold more than one family, with their family's ``root``."""
    rows = dealt.filter("pivot <> sid").join(family.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return _of_several(written(rows, "region-members"))


def _rings(large: DataFrame, num: int, den: int) -> DataFrame:
    """Large regions split by shared shingle and by size.

    The size is the distance from the empty set, and linked sets' differ by
    num/den at most.  A ring is as wide as that; a set is in its own and, beyond
    the boundary, in the next.  Rings are a little wider than needed, so rounding
    loses no link.
    """
    width = float(np.log(den / num)) * (1 + 1e-6)
    ring = F.floor(F.log(F.col("n")) / F.lit(width))
    each = large.drop("members", "region").withColumn("pivot", F.explode("ts")).drop("ts")
    return _of_several(each.withColumn("region", F.explode(F.array(ring, ring + 1))))


def linked_members(n: np.ndarray, root: np.ndarray, sketches: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one region whose sizes and sketches allow a link and whose families differ.

    Pairs are tested with ``BITS`` bits first, and those that pass with more as
    far as both sketches reach.
    """
    bits = np.stack([folded(x, BITS // 64) for x in sketches])
    apart = np.zeros((len(n), len(n)), np.int64)
    for k in range(BITS // 64):
        apart += np.bitwise_count(bits[:, None, k] ^ bits[None, :, k])
    both = n[:, None] + n[None, :]
    fit = (apart * (den + num) <= both * (den - num)) & (den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :]))
    i, j = np.nonzero(np.triu(fit & (root[:, None] != root[None, :]), 1))
    words, least = 2 * BITS // 64, np.array([len(x) for x in sketches])
    while len(i) and (more := np.minimum(least[i], least[j]) >= words).any():
        held = {k: folded(sketches[k], words) for k in np.unique(np.r_[i[more], j[more]]).tolist()}
        good = np.ones(len(i), bool)
        good[more] = [np.bitwise_count(held[x] ^ held[y]).sum() * (den + num) <= (n[x] + n[y]) * (den - num) for x, y in zip(i[more].tolist(), j[more].tolist())]
        i, j, words = i[good], j[good], 2 * words
    union, out = Union(len(n)), []
    for x, y in zip(i.tolist(), j.tolist()):
        if union.find(x) != union.find(y):
            union.join(x, y)
            out.append((x, y))
    return out


def _region_links(mixed: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that join, in small regions, the sets of different families which may be linked: fewer than members."""
    small = mixed.filter(F.col("members") <= SMALL_REGION).join(reps.select("sid", "sketch"), "sid")
    groups = small.groupBy("region", "pivot").agg(F.collect_list(F.struct("n", "sid", "root", "sketch")).alias("g"))

    def test(batches):
        for batch in batches:
            column, found = batch.column(0), []
            ends, rows = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten()
            n, sid, root = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            sketches = [np.frombuffer(x, "<u8") for x in rows.field(3).to_pylist()]
            for lo, hi in zip(ends[:-1], ends[1:]):
                for i, j in linked_members(n[lo:hi], root[lo:hi], sketches[lo:hi], num, den):
                    found.append(sorted((int(sid[lo + i]), int(sid[lo + j]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return groups.select("g").mapInArrow(test, "a long, b long")


def _tested(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and whole sketches allow a link."""
    side = lambda c: reps.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def test(batches):
        for batch in batches:
            keep = [may_link(x, y, m, n, num, den) for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    fit = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(fit).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(test, "a long, b long")


def families(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root): disjoint groups of sets that hold all links; a set without a possible link isn't in them."""
    upto = lambda more: F.expr(f"CAST(n - (({num} * n + {den - 1}) DIV {den}) + {more} AS INT)")
    star = lambda df: df.filter("pivot <> sid").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    first = reps.select(F.lit(0).cast("long").alias("region"), "sid", "n", F.explode(F.slice("prefix", F.lit(1), upto(1))).alias("t"))
    dealt = written(_dealt(first), "regions")
    family = written(components(written(_tested(star(dealt), reps, num, den), "near")), "families")
    mixed = _mixed(dealt, family)
    small = F.col("members") <= SMALL_REGION
    found, large = _region_links(mixed, reps, num, den), mixed.filter(~small)
    if not large.isEmpty():
        ringed = _rings(large, num, den)
        found, large = found.union(_region_links(ringed, reps, num, den)), ringed.filter(~small)
    if 2 * num > den and not large.isEmpty():
        # Linked sets have a second common shingle among one more of their first: rings that
        # are large yet are split by it, or unrelated texts would meet in common phrases.
        next_ = large.select(F.xxhash64("pivot", "region").alias("region"), "sid", F.col("pivot").alias("own")).join(reps.select("sid", "n", "prefix"), "sid")
        next_ = next_.select("region", "sid", "n", "own", F.explode(F.slice("prefix", F.lit(1), upto(2))).alias("t"))
        second = written(_dealt(next_.filter("t <> own").select("region", "sid", "n", "t")), "second-regions")
        rest = _mixed(second, family)
        found = found.union(_tested(star(second), reps, num, den)).union(_region_links(rest, reps, num, den))
        large = rest.filter(~small)
    known = family.select(F.col("root").alias("a"), F.col("node").alias("b")).filter("a <> b")
    return components(known.union(found).union(star(large)))


# -- second level: documents as pivots ----------------------------------------


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def common_counts(sets: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """How many shingles of ``pivot`` each set has."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])


def join_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int, union: Union) -> None:
    """Exact: link every pair of ``left`` and ``right`` that is similar enough.

    Common shingles are counted by products of 0/1 matrices, some columns at a time.
    """
    if max(len(left), len(right)) > 1024:
        parts = lambda x: [x[i : i + 1024] for i in range(0, len(x), 1024)]
        same = left is right
        for i, x in enumerate(parts(left)):
            for y in parts(right)[i if same else 0 :]:
                join_block(sets, x, y, num, den, union)
        return
    rows = np.unique(np.r_[left, right])
    if len(rows) < 2:
        return
    if len(rows) <= 4:
        for i in left.tolist():
            for j in right.tolist():
                if i < j or (j < i and not (i in right and j in left)):
                    c = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                    if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                        union.join(i, j)
        return
    sizes = np.array([len(sets[i]) for i in rows])
    keys, where, held = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
    rank = np.cumsum(held > 1) - 1  # shingles of one set alone are never common
    own = np.repeat(np.arange(len(rows)), sizes)
    good = held[where] > 1
    own, col = own[good], rank[where[good]]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    width = 4096
    a, b = np.searchsorted(rows, left), np.searchsorted(rows, right)
    common = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int((held > 1).sum()), width):
        lo, hi = np.searchsorted(col, [start, start + width])
        block = np.zeros((len(rows), width), np.float32)
        block[own[lo:hi], col[lo:hi] - start] = 1
        common += block[a] @ block[b].T
    total = sizes[a][:, None] + sizes[b][None, :]
    for i, j in zip(*np.nonzero(den * common >= num * (total - common))):
        if a[i] != b[j]:
            union.join(int(rows[a[i]]), int(rows[b[j]]))


def voronoi_join(sets: list[np.ndarray], num: int, den: int, union: Union, members: np.ndarray | None = None, pivots: int = 8, leaf: int = 64, seen: dict | None = None) -> None:
    """Link all similar pairs of ``members`` by splitting them into Voronoi regions with windows.

    ``seen`` counts the regions joined, the members of split regions and how
    many more their windows added.
    """
    members = np.arange(len(sets)) if members is None else members
    m = len(members)
    seen = {"regions": 0, "split": 0, "windows": 0} if seen is None else seen
    if m <= leaf:
        seen["regions"] += 1
        join_block(sets, members, members, num, den, union)
        return
    reach = 1 - num / den
    mine = [sets[i] for i in members]
    sizes = np.array([len(s) for s in mine])
    far, at, columns = np.full(m, 2.0), 0, []
    for _ in range(pivots):  # each pivot is the set farthest from those before
        c = common_counts(mine, mine[at])
        d = 1 - c / (sizes + sizes[at] - c)
        for i in np.flatnonzero(den * c >= num * (sizes + sizes[at] - c)):
            union.join(int(members[at]), int(members[i]))
        columns.append(d)
        far = np.minimum(far, d)
        at = int(np.argmax(far))
        if far[at] <= 0:
            break
    dist = np.stack(columns, axis=1)
    window = dist <= dist.min(axis=1)[:, None] + 2 * reach + 1e-9
    if window.sum(axis=0).max() <= 0.8 * m:
        seen["split"] += m
        seen["windows"] += int(window.sum()) - m
        for k in range(window.shape[1]):
            voronoi_join(sets, num, den, union, members[window[:, k]], pivots, leaf, seen)
        return
    # No split: block against block, those with no member inside each other's windows left out.
    order = np.argsort(dist[:, 0], kind="stable")
    blocks = [order[i : i + leaf] for i in range(0, m, leaf)]
    for i, x in enumerate(blocks):
        for y in blocks[i:]:
            gap = np.maximum(dist[x].min(axis=0) - dist[y].max(axis=0), dist[y].min(axis=0) - dist[x].max(axis=0))
            if gap.max() <= reach + 1e-9:
                join_block(sets, members[x], members[y], num, den, union)


def _read_sets(batch, column: str = "keys") -> list[np.ndarray]:
    return [np.frombuffer(b, "<u8") for b in batch.column(column).to_pylist()]


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, text) of the documents whose identifiers ``wanted`` has, and of some others.

    A bitmap of fixed size keeps most other documents out of the shuffle that follows.
    """
    slot = lambda ids: (splitmix(ids.astype(np.int64).view(_U)) & _U(SLOTS - 1)).astype(np.int64)
    bits = np.packbits(slot_counts(wanted, lambda b: slot(b.column(0).to_numpy(zero_copy_only=False)), ["id"]) > 0)
    held = docs.sparkSession.sparkContext.broadcast(bits)  # 128 kB

    def run(batches):
        wants = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wants[slot(batch.column(0).to_numpy(zero_copy_only=False))]))
            if batch.num_rows:
                yield batch

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, text_key binary, text string")


def with_sets(rows: DataFrame, k: int, classes) -> DataFrame:
    """(cell, sid, keys, n) of (cell, sid, text, n)."""

    def run(batches):
        for batch in batches:
            sets = ordered_sets(_texts(batch.column("text")), k, classes.value)
            yield batch.select(["cell", "sid"]).append_column("keys", pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())).append_column("n", batch.column("n"))

    return rows.select("cell", "sid", "text", "n").mapInArrow(run, "cell string, sid long, keys binary, n long")


def _linked(num: int, den: int, k: int = 0, classes=None):
    """A function for mapInArrow on rows (cell, sid, keys, part) sorted by cell: links (a, b) of each cell.

    ``part`` is null where the whole cell is joined; in a pair of blocks it is 0
    or 1.  With ``classes``, keys are texts yet, which take half the room of
    their sets in a shuffle.
    """

    def links(sids, sets, parts):
        if classes is not None:
            good = [i for i in range(len(sids)) if not i or sids[i] != sids[i - 1]]
            sids, sets, parts = ([x[i] for i in good] for x in (sids, sets, parts))
            if len(sids) < 2:
                return []
            sets = ordered_sets(sets, k, classes.value)
        union = Union(len(sets))
        if parts[0] is None:
            voronoi_join(sets, num, den, union)
        else:
            side = np.array(parts)
            if (side == 0).any() and (side == 1).any():
                join_block(sets, np.flatnonzero(side == 0), np.flatnonzero(side == 1), num, den, union)
        out = [(sids[union.find(i)], sids[i]) for i in range(len(sids))]
        return [(a, b) for a, b in out if a != b]

    def run(batches):
        cell, sids, sets, parts = None, [], [], []
        for batch in batches:
            found = []
            content = _read_sets(batch) if classes is None else _texts(batch.column("keys"))
            for c, s, data, p in zip(batch.column("cell").to_pylist(), batch.column("sid").to_pylist(), content, batch.column("part").to_pylist()):
                if c != cell:
                    if len(sids) > 1:
                        found += links(sids, sets, parts)
                    cell, sids, sets, parts = c, [], [], []
                if classes is not None or not sids or sids[-1] != s:  # a set may come twice
                    sids.append(s), sets.append(data), parts.append(p)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        if len(sids) > 1 and (found := links(sids, sets, parts)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return run


def _join_cells(cells: DataFrame, num: int, den: int, k: int = 0, classes=None) -> DataFrame:
    return cells.select("cell", "sid", "keys", "part").repartition(F.col("cell")).sortWithinPartitions("cell", "sid").mapInArrow(_linked(num, den, k, classes), "a long, b long")


def _join_blocks(rest: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Links of heavy cells (cell, sid, keys, w), each joined block against block."""
    blocks = F.ceil(F.col("w") / F.lit(most // 3)).cast("int")
    mine = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rest.withColumn("blocks", blocks).withColumn("own", mine).select("*", other.alias("other"))
    pair = F.concat_ws("|", "cell", F.least("own", "other"), F.greatest("own", "other"))
    between = dealt.filter("own <> other").select(pair.alias("cell"), "sid", "keys", (F.col("own") > F.col("other")).cast("int").alias("part"))
    within = dealt.filter("own = other").select(pair.alias("cell"), "sid", "keys", F.lit(None).cast("int").alias("part"))
    return written(_join_cells(between, num, den).union(_join_cells(within, num, den)), "links")


def split_heavy(cells: DataFrame, num: int, den: int, most: int, pivots: int = 16, levels: int = 4) -> list[DataFrame]:
    """Links of cells too heavy for a task, which a shuffle splits into Voronoi regions with windows.

    Cells that are still heavy after ``levels`` splits are joined block against block.
    """
    out, reach = [], 1 - num / den
    for level in range(levels + 1):
        weight = cells.groupBy("cell").agg(F.sum("n").alias("w"))
        heavy = written(weight.filter(F.col("w") > most), "heavy-cells")
        light = cells.join(heavy, "cell", "left_anti").withColumn("part", F.lit(None).cast("int"))
        out.append(written(_join_cells(light, num, den), "links"))
        if heavy.isEmpty():
            return out
        rest = cells.join(heavy, "cell")
        if level == levels:
            return [*out, _join_blocks(rest, num, den, most)]
        picks = rest.groupBy("cell").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("sid", F.lit(31 * level + j)), "sid"))["sid"] for j in range(pivots)])).alias("p"))
        chosen = picks.select("cell", F.explode("p").alias("sid")).join(rest.select("cell", "sid", "keys"), ["cell", "sid"]).dropDuplicates(["cell", "sid"])
        chosen = chosen.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("sid", "keys"))).alias("pivots"))  # `pivots` sets a cell

        def deal(batches):
            for batch in batches:
                rows = []
                for cell, sid, data, n, ps in zip(*(batch.column(c).to_pylist() for c in ("cell", "sid", "keys", "n", "pivots"))):
                    own = np.frombuffer(data, "<u8")
                    c = np.array([np.intersect1d(own, np.frombuffer(p["keys"], "<u8"), assume_unique=True).size for p in ps])
                    d = 1 - c / (n + np.array([len(p["keys"]) // 8 for p in ps]) - c)
                    rows += [(f"{cell}/{k}", sid, data, n) for k in np.flatnonzero(d <= d.min() + 2 * reach + 1e-9).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.int64()))], names=["cell", "sid", "keys", "n"])

        before = rest.agg(F.sum("n")).first()[0]
        after = written(rest.select("cell", "sid", "keys", "n").join(chosen, "cell").select("cell", "sid", "keys", "n", "pivots").mapInArrow(deal, "cell string, sid long, keys binary, n long"), "cells")
        if after.agg(F.sum("n")).first()[0] > 3 * before:
            return [*out, _join_blocks(rest, num, den, most)]  # windows that hold nearly all don't split
        cells = after
    return out


# -- the operator ----------------------------------------------------------------


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES, full: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id) per row: sets are linked at a similarity of num/den or more.

    ``full`` adds ``text_key``, the MD5 of the text as binary, and ``component``,
    a number that is one component's alone also where rows share identifiers
    (null without a set).
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    classes = spark.sparkContext.broadcast(shingle_classes(docs, k, text_col))  # 1 MB
    signed = written(signatures(docs, k, num, den, classes, id_col, text_col), "signatures")
    one = signed.filter("n > 0").groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    reps = written(one.select(F.monotonically_increasing_id().alias("sid"), "set_key", "row.id", "row.text_key", "n", "prefix", "sketch"), "sets")
    family = written(families(reps, num, den), "families")
    wanted = written(reps.join(family.select(F.col("node").alias("sid"), "root"), "sid").select("sid", "id", "text_key", "n", "root"), "wanted-sets")
    weight = wanted.groupBy("root").agg(F.sum("n").alias("w"))
    heavy = written(weight.filter(F.col("w") > task_shingles).select("root"), "heavy-families")
    rows = texts_of(docs, wanted, id_col, text_col)
    cell = F.col("root").cast("string").alias("cell")
    light = rows.join(wanted.join(heavy, "root", "left_anti"), ["id", "text_key"]).select(cell, "sid", F.col("text").alias("keys"), F.lit(None).cast("int").alias("part"))
    links = written(_join_cells(light, num, den, k, classes), "links")
    if not heavy.isEmpty():
        cells = written(with_sets(rows.join(wanted.join(heavy, "root"), ["id", "text_key"]).select(cell, "sid", "text", "n"), k, classes), "family-sets")
        for p in split_heavy(cells.dropDuplicates(["cell", "sid"]), num, den, task_shingles):
            links = links.union(p)
        links = components(links).select(F.col("root").alias("a"), F.col("node").alias("b"))
    # A family that one task joined has star edges already: its members' root is unique.
    roots = links.select(F.col("b").alias("sid"), F.col("a").alias("root")).filter("sid <> root").distinct()
    least = reps.select("sid", "id", "set_key").join(roots, "sid", "left").select(F.coalesce("root", "sid").alias("root"), "id", "set_key")
    named = least.groupBy("root").agg(F.min("id").alias("component_id"))
    by_set = written(least.join(named, "root").select("set_key", "component_id", F.col("root").alias("component")), "named-sets")
    every = signed.select("id", "text_key", "n", "set_key").join(by_set, "set_key", "left")
    shown = lambda c: F.nullif(c, F.lit(_MAX))
    out = every.select(shown(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), shown(F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))).alias("component_id"), "text_key", "component")
    return out if full else out.drop("text_key", "component")
