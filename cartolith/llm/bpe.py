"""BPE encoding by a priority queue of merge ranks over a doubly linked symbol list; decoding.

Reads a vocabulary file of the tokenizers library (model BPE with a word-end
suffix; NFC, white-space folding and lower case; a splitting expression).
Defined cases: a null text is empty; a text without tokens has no ids and
decodes to the empty string; repeated rows, also of one identifier, are encoded
each; a null identifier stays null; texts of any length are encoded whole; an
empty table gives no row; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Longer pieces aren't remembered: they hardly ever come again.
LONGEST = 64


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], more = chr(more), more + 1
    return [names[b] for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge adjacent symbols, lowest rank first and leftmost among equals.

    ``ranks`` gives the rank of a pair ``a << 32 | b`` and ``made`` the symbol
    that a rank makes.  The queue holds ``rank << 32 | place``.  An entry is
    stale, and skipped, if the pair at its place isn't the one of that rank any more.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [a << 32 | b for a, b in zip(symbols, symbols[1:])]
    queue = [ranks[p] << 32 | i for i, p in enumerate(pairs) if p in ranks]
    heapq.heapify(queue)
    symbols = [*symbols]
    while queue:
        entry = heapq.heappop(queue)
        r, i = entry >> 32, entry & 0xFFFFFFFF
        j = after[i]
        left = symbols[i]
        if left < 0 or j >= n or ranks.get(left << 32 | symbols[j]) != r:
            continue
        new = symbols[i] = made[r]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(new << 32 | symbols[k])) is not None:
                heapq.heappush(queue, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := ranks.get(symbols[h] << 32 | new)) is not None:
            heapq.heappush(queue, r << 32 | h)
    return [s for s in symbols if s >= 0]


class WordBPE:
    """Encoder and decoder for one vocabulary file; remembers at most ``keep`` pieces of ``LONGEST`` characters at most."""

    def __init__(self, path: str, keep: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [vocab[a + b] for a, b in merges]
        self.ranks = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (vocab | self.special).items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols, suffix = byte_symbols(), model["end_of_word_suffix"] or ""
        self.inner, self.last = [vocab[s] for s in symbols], [vocab[s + suffix] for s in symbols]
        self.keep = keep
        self.known: dict[str, tuple[bytes, str]] = {}

    def piece(self, piece: str) -> tuple[bytes, str]:
        """Ids, as bytes, and decoded text of what lies between two splits."""
        data = piece.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        ids = merge(symbols, self.ranks, self.made)
        got = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)
        if len(piece) <= LONGEST:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[piece] = got
        return got

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order; the file states no decoder, so spaces lie between."""
        names = self.names
        return " ".join([names[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """All ids as little-endian uint32 bytes, and the decoded text."""
        known, out = self.known, []
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append((struct.pack("<I", self.special[part]), part))
            elif part:
                plain = unicodedata.normalize("NFC", part)
                # Lower case goes character by character; only for a capital sigma does lower() look at neighbours.
                plain = "".join([c.lower() for c in plain]) if "\u03a3" in plain else plain.lower()
                out += [known.get(p) or self.piece(p) for p in self.split.findall(plain)]
        return b"".join([i for i, _ in out]), " ".join([d for _, d in out])


@functools.cache
def _coder(path: str) -> WordBPE:
    """One encoder a process: what it remembers serves the worker's next tasks too."""
    return WordBPE(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Per document the ids and decoded text (``full``), or their digests."""
    schema = "doc_id long, ids array<long>, decoded string" if full else SCHEMA

    def run(batches):
        import numpy as np

        coder = _coder(path)
        for batch in batches:
            out = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            if full:
                rest = [pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i, _ in out], pa.list_(pa.int64())), pa.array([d for _, d in out], pa.string())]
            else:
                rest = [pa.array([len(i) // 4 for i, _ in out], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in out], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
