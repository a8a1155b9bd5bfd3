"""Packing along a space-filling curve.

A document's token ids are counted in a hashed vector that is projected, with random signs, to
``DIMS`` numbers; their cells give its key on a Hilbert curve.  Documents are range-sorted by the
key (equal keys by id, so that copies are split over tasks too) and their tokens laid end to end;
every ``LENGTH`` tokens end a sequence, and what is left at a task's end is cut into sequences of
powers of two, which need no padding.

NULL and empty texts: the end token alone.  Repeated rows are packed each.  NULL ids come first.
Empty table: empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from importflow.llm import rows, tokens, words
from importflow.session import store

LENGTH = 1024
END = 0
DIMS = 4
BITS = 10               # of each dimension
SPREAD = 2.0            # how far the projections are stretched before they are cut into cells
BYTES_OF_TASK = 64 << 20    # of token ids


@lru_cache(maxsize=2)
def _signs(size: int) -> np.ndarray:
    """For each token (hashed to ``size`` entries) a sign in each dimension."""
    bits = words.mix(np.arange(size, dtype=np.uint64) * np.uint64(2654435761))
    return np.stack([1.0 - 2.0 * (bits >> np.uint64(7 * d + 3) & np.uint64(1)).astype(float) for d in range(DIMS)], 1)


def project(ids: np.ndarray, first: np.ndarray, size: int = 1 << 16) -> np.ndarray:
    """Per document the signed sums of the root of its token counts, over the vector's length."""
    docs = len(first) - 1
    text = np.repeat(np.arange(docs, dtype=np.int64), np.diff(first))
    pairs, uses = np.unique(text * size + ids % size, return_counts=True)
    text, token = pairs // size, pairs % size
    norm = np.sqrt(np.maximum(np.diff(first), 1))
    signs, weight = _signs(size), np.sqrt(uses)
    return np.stack(
        [np.bincount(text, signs[token, d] * weight, minlength=docs) / norm for d in range(DIMS)], 1
    )


def cells(points: np.ndarray) -> np.ndarray:
    """Points as cells of the cube, by a curve that fills it evenly for about normal numbers."""
    share = 1 / (1 + np.exp(-SPREAD * points))
    return np.minimum(share * (1 << BITS), (1 << BITS) - 1).astype(np.uint64)


def hilbert(cell: np.ndarray) -> np.ndarray:
    """Place of each cell on the Hilbert curve (Skilling's transform, all rows at once)."""
    x = [cell[:, d].copy() for d in range(cell.shape[1])]
    n, one = len(x), np.uint64(1)
    q = 1 << (BITS - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            flip = (x[i] & np.uint64(q)) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(cell), np.uint64)
    q = 1 << (BITS - 1)
    while q > 1:
        turn = np.where((x[n - 1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    key = np.zeros(len(cell), np.uint64)
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = key << one | ((x[i] ^ turn) >> np.uint64(b) & one)
    return key


def encode(df: DataFrame, doc_id: str, text: str, vocabulary: str | None) -> DataFrame:
    """doc_id, curve (the Hilbert key), ids: the document's token ids with the end token, packed
    in 2 bytes each where all of them fit, else in 4 (then ``wide``)."""

    def work(unit):
        found = tokens.encoder(vocabulary)(unit.column("text").fill_null("").to_pylist())
        found = [np.array([*x, END], np.int64) for x in found]
        first = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        keys = hilbert(cells(project(np.concatenate(found), first)))
        wide = [bool(x.max() > 0xFFFF) for x in found]
        return rows.batch(
            doc_id=unit.column("doc_id"), curve=keys.astype(np.int64), wide=pa.array(wide, pa.bool_()),
            ids=pa.array([x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(found, wide)], pa.binary()),
        )

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.map_units(source, "text", work, "doc_id long, curve long, wide boolean, ids binary")


class _Packer:
    """Lays documents end to end and cuts sequences; columns of pieces gather until taken."""

    FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, part: int, length: int):
        self.length, self.sequence, self.filled = length, part << 40, 0
        self.pieces: list[tuple] = []
        self.open: list[tuple] = []     # pieces of the sequence that is not full yet

    def add(self, doc, ids: np.ndarray):
        start, total = 0, len(ids)
        while start < total:
            n = min(total - start, self.length - self.filled)
            self.open.append((doc, start, ids[start:start + n], total, self.filled))
            start += n
            self.filled += n
            if self.filled == self.length:
                self._close(self.length)

    def _close(self, size: int):
        """End a sequence with the first ``size`` open tokens; the others open the next."""
        rest, kept = [], 0
        for doc, start, ids, total, _ in self.open:
            n = min(len(ids), size - kept)
            if n:
                piece = ids[:n].astype("<u4").tobytes()
                self.pieces.append((doc, start, n, zlib.crc32(piece), total, self.sequence, kept))
                kept += n
            if n < len(ids):
                rest.append((doc, start + n, ids[n:], total, None))
        self.open, self.sequence, self.filled = rest, self.sequence + 1, self.filled - size

    def finish(self):
        while self.filled:
            self._close(1 << (self.filled.bit_length() - 1))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.pieces)) or [[]] * len(self.FIELDS)
        self.pieces = []
        return rows.batch(**{f: pa.array(c, pa.int64()) for f, c in zip(self.FIELDS, columns)})


def pack(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
    vocabulary: str | None = None, task_bytes: int = BYTES_OF_TASK,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    encoded = store(encode(df, doc_id, text, vocabulary), "token-ids")
    total = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    tasks = max(int(total // task_bytes) + 1, encoded.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("curve"), F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    dealt = encoded.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches):
        packer = _Packer(TaskContext.get().partitionId(), length)
        for unit in batches:
            for doc, wide, ids in zip(*(unit.column(c).to_pylist() for c in ("doc_id", "wide", "ids"))):
                packer.add(doc, np.frombuffer(ids, "<u4" if wide else "<u2"))
            yield packer.take()
        packer.finish()
        yield packer.take()

    fields = ", ".join(f"{f} long" for f in _Packer.FIELDS)
    return dealt.mapInArrow(run, fields)
