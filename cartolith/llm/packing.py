"""Best-fit decreasing packing of token sequences into fixed windows.

Pieces of one length can stand for each other, so what best-fit decreasing does
depends on how many pieces of each length there are, and on nothing else.  The
packing is therefore planned from a histogram of at most ``window`` counts, a
size that doesn't grow with the corpus, and is the one that the sequential
algorithm makes over all pieces of the corpus; every piece then finds its place
by its rank among the pieces of its length.

Defined cases: a null text is empty and has the end id alone; repeated rows,
also of one identifier, are packed each; a null identifier stays null; texts of
any length are encoded whole; an empty table gives no piece; further columns,
whatever their names, are left out.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task string, nth long"


class CapacityTree:
    """Segment tree over remaining capacities: the smallest occupied one that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.full = [False] * (2 * self.leaves)

    def put(self, capacity: int, occupied: bool) -> None:
        i = self.leaves + capacity
        self.full[i] = occupied
        while i > 1:
            i >>= 1
            self.full[i] = self.full[2 * i] or self.full[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = self.leaves + need
        if self.full[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(counts: dict[int, int], window: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts[length]`` pieces.

    Rows (length, first rank, ranks, first sequence, offset): rank ``first + i``
    of that length lies in sequence ``first sequence + i`` at that offset.
    Windows filled alike are kept as one group; a piece that leaves room for
    its like is followed by it, as its window is then the tightest.
    """
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity: (first sequence, windows)
    rows, sequences = [], 0

    def put(capacity: int, first: int, windows: int) -> None:
        if windows and capacity:
            open_[capacity].append((first, windows))
            tree.put(capacity, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = window, sequences
                windows = -(-left // (window // length))
                sequences += windows
            else:
                first, windows = open_[capacity].pop()
                if not open_[capacity]:
                    tree.put(capacity, False)
            each = capacity // length
            whole = min(windows, left // each)
            for j in range(each if whole else 0):
                rows.append((length, rank, whole, first, window - capacity + j * length))
                rank += whole
            left -= whole * each
            put(capacity - each * length, first, whole)
            first, windows = first + whole, windows - whole
            if windows and 0 < left < each:
                for j in range(left):
                    rows.append((length, rank, 1, first, window - capacity + j * length))
                    rank += 1
                put(capacity - left * length, first, 1)
                first, windows, left = first + 1, windows - 1, 0
            put(capacity, first, windows)
    return rows


def pieces(docs: DataFrame, encoder, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each document and the end id, cut into full windows and a rest.

    ``encoder()`` makes, once a task, a function from text to its ids as
    little-endian uint32 bytes.
    """

    def run(batches):
        encode, end, step = encoder(), end_id.to_bytes(4, "little"), 4 * window
        task, seen = None, defaultdict(int)
        import uuid

        task = uuid.uuid4().hex
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    for c, v in zip(cols, (doc, at // 4, n, zlib.crc32(part), len(ids) // 4, seen[n])):
                        c.append(v)
                    seen[n] += 1
            arrays = [pa.array(c, pa.int64()) for c in cols]
            arrays.insert(5, pa.array([task] * len(cols[0]), pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PIECE.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def pack(spark: SparkSession, docs: DataFrame, encoder, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset in it; see ``plan``."""
    cut = written(pieces(docs, encoder, window, end_id, id_col, text_col), "pieces")
    # A row for each task and length; ranks are given without gathering a length in one task.
    held = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    by_length: dict[int, list] = defaultdict(list)
    for length, *row in plan(counts, window):
        by_length[length].append(row)
    tables = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})
    ranked = cut.join(offsets, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length).tolist():
                mine, rows = length == n, tables.value[n]
                at = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                sequence[mine] = rows[at, 2] + rank[mine] - rows[at, 0]
                offset[mine] = rows[at, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


#: Plain white space; texts with any other are encoded in one go.
_SPACE = " \t\r\n"
_CHUNK = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class LibraryEncoder:
    """Ids of the tokenizers library for a byte-level BPE file, as little-endian uint32 bytes.

    Such a file's pattern never joins what lies before white space to it, so the
    stretches that begin with white space are encoded each by the library and
    remembered, ``keep`` of them of ``longest`` characters at most.
    """

    def __init__(self, path: str, keep: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # A byte-level vocabulary writes a character for a byte; added tokens stand for their own text.
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(t) for t in vocab]
        for i, t in added.items():
            self.sizes[i] = len(t.encode())
        self.keep, self.longest = keep, longest
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new stretches: those that begin with white space and end without are encoded in one go.

        Each id stands for a known number of bytes, which tells where a stretch ends.
        """
        joined = [c for c in chunks if c[0] in _SPACE and c[-1] not in _SPACE]
        ids = self._ids("".join(joined)) if joined else np.zeros(0, "<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) for c in joined])) + 1
        raw, ends = ids.tobytes(), ends.tolist()
        got = {c: raw[4 * i : 4 * j] for c, i, j in zip(joined, [0, *ends], ends)}
        got |= {c: self._ids(c).tobytes() for c in chunks if c not in got}
        if len(self.known) + len(got) > self.keep:
            self.known.clear()
        self.known |= {c: x for c, x in got.items() if len(c) <= self.longest}
        return got

    def __call__(self, text: str) -> bytes:
        if _OTHER_SPACE.search(text):
            return self._ids(text).tobytes()
        chunks = _CHUNK.findall(text)
        found = list(map(self.known.get, chunks))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            got = self._learn(list(dict.fromkeys([chunks[i] for i in new])))
            for i in new:
                found[i] = got[chunks[i]]
        return b"".join(found)


@functools.cache
def _encoder(path: str) -> LibraryEncoder:
    """One a process: what it remembers serves the worker's next tasks too."""
    return LibraryEncoder(path)


def library_encoder(path: str):
    """An encoder for ``pack``: the tokenizers library with the byte-level BPE file at ``path``."""
    return lambda: _encoder(path)
