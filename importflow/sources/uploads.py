"""Uploaded objects: their sizes, without reading them, and put and get by key."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from importflow.functions import object_key_parts

BLOCK_BYTES = 1 << 20   # of an object's lines that travel as one row
MOVES = 16              # objects moved to their keys at a time
LOOKUPS = 32            # keys asked for at a time


def list_uploads(spark: SparkSession, root: str, pattern: str = "source.csv") -> DataFrame:
    """(object_key, path, length) of the objects below ``root``.

    A missing object has no row, nor has an empty one: Spark's listing leaves it out.  No
    caller tells the two apart.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )
    return found.select(
        object_key_parts("path")["object_key"].alias("object_key"), "path", "length"
    )


def look_up(spark: SparkSession, root: str, keys: list[str], pattern: str = "*") -> list[tuple[str, int, int]]:
    """(key, number of files, length) of those of ``keys`` that are there, each asked for by name.

    The work follows the keys and not what lies below ``root``.  Empty files do not count; a key
    that names a folder has the number of its files that match ``pattern``.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def ask(key: str) -> tuple[str, int, int] | None:
        target = path(f"{root}/{key}")
        if not fs.exists(target):
            return None
        named = [(s.getPath().getName(), s) for s in fs.listStatus(target) if s.isFile() and s.getLen() > 0]
        sizes = [s.getLen() for name, s in named if not name.startswith(("_", ".")) and fnmatchcase(name, pattern)]
        return key, len(sizes), max(sizes, default=0)

    with ThreadPool(LOOKUPS) as pool:       # names and sizes only
        return [found for found in pool.map(ask, keys) if found]


def get_objects(spark: SparkSession, paths) -> DataFrame:
    """Whole objects as bytes, one row each."""
    return spark.read.format("binaryFile").load(paths).select(
        object_key_parts("path")["object_key"].alias("object_key"), "content"
    )


def put_lines(lines: DataFrame, path: str, by: list[str], order: list[str], line_sep: str = "\n") -> None:
    """Write the ``line`` column as text objects, one per combination of ``by``."""
    (
        lines.repartition(*by).sortWithinPartitions(*by, *order).select(*by, "line")
        .write.mode("overwrite").partitionBy(*by).option("lineSep", line_sep).text(path)
    )


def _blocks(line_sep: str, size: int) -> Callable:
    """Consecutive lines of a key joined to blocks of about ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, lines, held = None, 0, [], 0

        def block():
            return {"slot": key, "first": first, "text": line_sep.join(lines)}

        for batch in batches:
            done = []
            for k, place, line in zip(*(batch.column(c).to_pylist() for c in ("slot", "place", "line"))):
                if lines and (k != key or held >= size):
                    done.append(block())
                    lines, held = [], 0
                if not lines:
                    key, first = k, place
                lines.append(line)
                held += len(line)
            if done:
                yield pa.RecordBatch.from_pylist(done, SHAPE)
        if lines:
            yield pa.RecordBatch.from_pylist([block()], SHAPE)

    return run


SHAPE = pa.schema([("slot", pa.string()), ("first", pa.int64()), ("text", pa.string())])


def put_objects(
    lines: DataFrame, root: str, key: str, order: str, line_sep: str = "\n", block_bytes: int = BLOCK_BYTES,
) -> int:
    """Write the ``line`` column as one object per ``key`` (a path below ``root``) in the order of the
    integer ``order``; returns how many.  An object that is there is replaced.

    Lines are sorted in ranges that may cut a key, and joined to blocks; what the one task that writes
    an object gets is a stream of blocks.  Objects are staged and moved to their keys once all are
    written, so a key never names half an object.  Where the store copies to move, a move costs a copy.
    """
    spark = lines.sparkSession
    laid = lines.select(F.hex(F.encode(key, "UTF-8")).alias("slot"), F.col(order).cast("long").alias("place"), "line")
    blocks = laid.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").mapInArrow(
        _blocks(line_sep, block_bytes), "slot string, first long, text string")
    staged = f"{root}/_staging-{uuid.uuid4().hex}"
    (
        blocks.repartition("slot").sortWithinPartitions("slot", "first").select("slot", "text")
        .write.partitionBy("slot").option("lineSep", line_sep).text(staged)
    )
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(path(staged)) if s.getPath().getName().startswith("slot=")]

    def move(folder) -> None:
        parts = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{folder}: an object in {len(parts)} parts")
        target = path(f"{root}/{bytes.fromhex(folder.getName()[5:]).decode()}")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        if not fs.rename(parts[0], target):
            raise OSError(f"cannot move an object to {target}")

    with ThreadPool(MOVES) as pool:     # names only; no content comes to the driver
        pool.map(move, folders)
    fs.delete(path(staged), True)
    return len(folders)


def object_lines(spark: SparkSession, root: str, pattern: str, line_sep: str = "\n") -> DataFrame:
    """(object_key, line) of the text objects below ``root`` that match the glob ``pattern``."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return spark.read.option("lineSep", line_sep).text(f"{root}/{pattern}").select(
        F.substr(name, F.locate(base, name) + len(base)).alias("object_key"), F.col("value").alias("line"))
