"""Arrow plumbing the operators share: text columns as bytes, units of bounded size, output batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from importflow.session import scratch_path

UNIT_BYTES = 2 << 20    # text that is worked on at once; one longer text makes a unit of its own


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end and where each row begins; NULL counts as empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, "<i4")[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if content is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(content, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def ids_of(column: pa.Array) -> np.ndarray:
    """Integer ids as int64; NULL counts as the smallest."""
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def give_back() -> None:
    """Return freed memory to the system, as a worker lives on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc keeps what lies between used blocks
    if trim:
        trim(0)


def units(batches: Iterator[pa.RecordBatch], text: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices whose texts have at most ``size`` bytes (or that have one row)."""
    size = size or UNIT_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def gathered(batches: Iterator[pa.RecordBatch], text: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Like ``units``, but small batches are put together up to ``size`` first."""
    size = size or UNIT_BYTES
    waiting, held, unit = [], 0, None
    for unit in units(batches, text, size):
        here = int(text_bytes(unit.column(text))[1][-1])
        if waiting and held + here > size:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, held = [], 0
        waiting.append(unit)
        held += here
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
    waiting = unit = None
    give_back()


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns)
    )


def map_units(
    df: DataFrame, text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
    size: int | None = None,
) -> DataFrame:
    """Apply ``work`` to every unit of a partition."""

    def run(batches):
        for unit in gathered(batches, text, size):
            result = work(unit)
            if result is not None and result.num_rows:
                yield result

    return df.mapInArrow(run, schema)


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of equal ``key`` of a partition sorted by it, one group at a time."""
    current, parts = None, []
    for rows in batches:
        if not rows.num_rows:
            continue
        keys = rows.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if parts and keys[a] != current:
                yield current, pa.Table.from_batches(parts)
                parts = []
            current = keys[a]
            parts.append(rows.slice(a, b - a))
    if parts:
        yield current, pa.Table.from_batches(parts)
    parts = None
    give_back()


class Scratch:
    """Tables written below one folder of the shared folder, to be deleted together when no result
    reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, scratch_path(spark, name), 0

    def store(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
