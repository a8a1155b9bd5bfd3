"""Repeated passages: every window of ``length`` words that also begins earlier in the corpus.

Super-k-mers: a window's minimiser is the least hash of its ``PICK``-word pieces; consecutive
windows that share it travel as one packed string of words to the bucket of the minimiser, where
the windows of all strings are sorted and all but the earliest of equal ones are marked.  Before
they travel, a task marks what is repeated among the texts it works on, so of a passage that a
third of all documents hold, each unit of text sends one copy.  Buckets hold about
``BUCKET_BYTES`` each, as their number follows the corpus.  What goes to each is counted first: one
that a frequent minimiser fills beyond ``HEAVY`` times that is split by a hash of whole windows into
parts of that size, so equal windows still meet.

Windows are found equal by 64-bit hashes of words, then compared word by word.

NULL or empty text: no words, nothing removed.  NULL ids: before all others, told apart by their
text.  Rows that repeat an id are one document: with the same text they get the same result; if
their texts differ, a word is removed from each where a window at its place in any was marked.
Empty table: empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from importflow.llm import rows, words

LENGTH = 20
PICK = 4
UNIT_BYTES = 4 << 20        # of text that is packed together
BUCKET_BYTES = 4 << 20      # of packed strings; they are about three times the text
HEAVY = 4
_COPIES = 3

_CODEC = "zstd"


def row_id(doc_id: str, text: str) -> Column:
    unnamed = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64(F.col(text)), 2)
    return F.coalesce(F.col(doc_id).cast("long"), unnamed)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def pack(columns: list[np.ndarray], body: bytes) -> bytes:
    """Integer columns of one length and a string, compressed."""
    head = np.array([len(columns[0]), len(body)], "<i8").tobytes()
    plain = head + b"".join(c.astype("<i8").tobytes() for c in columns) + body
    return len(plain).to_bytes(8, "little") + pa.compress(plain, _CODEC, asbytes=True)


def unpack(blob: bytes, width: int) -> tuple[list[np.ndarray], bytes]:
    plain = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), _CODEC, asbytes=True)
    count, _ = np.frombuffer(plain, "<i8", 2)
    table = np.frombuffer(plain, "<i8", count * width, 16).reshape(width, count)
    return list(table), plain[16 + 8 * width * count:]


def later_copies(keys: np.ndarray, hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int):
    """Which windows (in order of document and place) equal one that comes before them.

    ``at`` is where each begins among ``hashes``.  A window never counts as a copy of one at the
    same place of the same document.
    """
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])[:len(ranked)]
    earliest = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else order
    other = (doc[earliest] != doc[order]) | (place[earliest] != place[order])
    first, second = earliest[other], order[other]
    same = np.ones(len(first), bool)
    for k in range(length):
        same &= hashes[at[first] + k] == hashes[at[second] + k]
    copies = np.zeros(len(keys), bool)
    copies[second[same]] = True
    if not same.all():      # different windows of one hash: compare all of that hash by their words
        groups: dict = {}
        clash = np.isin(keys, keys[second[~same]])
        for i in np.flatnonzero(clash).tolist():
            window = hashes[at[i]:at[i] + length].tobytes()
            spot = groups.setdefault(window, (doc[i], place[i]))
            copies[i] = spot != (doc[i], place[i])
    return copies


def stretches(doc: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows in order as stretches of words: doc, begin, end."""
    if not len(doc):
        return rows.batch(doc=doc, begin=place, end=place)
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(doc) - 1]])
    return rows.batch(doc=doc[first], begin=place[first], end=place[last] + length)


def minimisers(hashes: np.ndarray, length: int) -> np.ndarray:
    """The least hash of a piece of each window."""
    return least(words.windows(hashes, min(PICK, length)), length - min(PICK, length) + 1)


def bucket_of(signs: np.ndarray, buckets: int) -> np.ndarray:
    return (words.mix(signs) % np.uint64(buckets)).astype(np.int64)


def loads(unit: pa.RecordBatch, buckets: int, length: int) -> pa.RecordBatch | None:
    """By bucket that the unit has (bucket, whole, alone): bytes of its different super-k-mers, and of
    all their windows, each by itself."""
    data, offsets = rows.text_bytes(unit.column("text"))
    starts, ends, first = words.word_spans(data, offsets)
    at = np.flatnonzero(words.whole_windows(first, length))
    if not len(at):
        return None
    hashes = words.span_hashes(data, starts, ends)
    signs = minimisers(hashes, length)[at]
    line = words.owner(first)[at]
    cut = (signs[1:] != signs[:-1]) | (at[1:] != at[:-1] + 1) | (line[1:] != line[:-1])
    begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
    stop = np.concatenate([begin[1:], [len(at)]])
    alone = np.add.reduceat(ends[at + length - 1] - starts[at], begin)
    keys = words.windows(hashes, length)[at]
    same = words.mix(keys[begin] ^ words.mix(keys[stop - 1] ^ (stop - begin).astype(np.uint64)))
    once = np.unique(same, return_index=True)[1]
    bucket, spot = np.unique(bucket_of(signs[begin[once]], buckets), return_inverse=True)
    whole = (ends[at[stop - 1] + length - 1] - starts[at[begin]])[once]
    return rows.batch(bucket=bucket, whole=np.bincount(spot, whole), alone=np.bincount(spot, alone[once]))


def heavy_parts(df: DataFrame, buckets: int, length: int, bucket_bytes: int) -> dict[int, int]:
    """The buckets to split and into how many parts each."""
    found = rows.map_units(
        df.select("text"), "text", lambda unit: loads(unit, buckets, length),
        "bucket long, whole double, alone double", UNIT_BYTES,
    )
    counted = found.groupBy("bucket").agg(F.sum("whole").alias("whole"), F.sum("alone").alias("alone"))
    return {r["bucket"]: int(r["alone"] // bucket_bytes) + 1
            for r in counted.where(F.col("whole") > HEAVY * bucket_bytes).collect()}


def super_kmers(unit: pa.RecordBatch, buckets: int, length: int, heavy: dict[int, int]) -> pa.RecordBatch | None:
    """Packed strings by bucket (kind 0), and the stretches already found in the unit (kind 1).

    Parts of ``heavy`` buckets are numbered behind all buckets.
    """
    ids = rows.ids_of(unit.column("doc"))
    order = np.argsort(ids, kind="stable")
    ids, unit = ids[order], unit.take(pa.array(order))
    plain = [b" ".join(t.split()) for t in rows.texts_of(*rows.text_bytes(unit.column("text")))]
    whole = b"".join(plain)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
    data = np.frombuffer(whole, np.uint8)
    starts, ends, first = words.word_spans(data, offsets)
    at = np.flatnonzero(words.whole_windows(first, length))
    if not len(at):
        return None
    hashes = words.span_hashes(data, starts, ends)
    owner = words.owner(first)
    doc, place = ids[owner[at]], at - first[owner[at]]
    keys = words.windows(hashes, length)[at]
    copies = later_copies(keys, hashes, at, doc, place, length)
    out = []
    if copies.any():
        found = stretches(doc[copies], place[copies], length)
        out.append((0, 1, pack([c.to_numpy() for c in found.columns], b"")))
    at, doc, place, keys = at[~copies], doc[~copies], place[~copies], keys[~copies]
    if len(at):
        signs = minimisers(hashes, length)[at]
        line = owner[at]
        cut = (signs[1:] != signs[:-1]) | (at[1:] != at[:-1] + 1) | (line[1:] != line[:-1])
        bucket = bucket_of(signs, buckets)
        if heavy:
            split, parts = np.array(sorted(heavy.items()), np.int64).T
            spot = np.minimum(np.searchsorted(split, bucket), len(split) - 1)
            mine = np.flatnonzero(split[spot] == bucket)
            spot = spot[mine]
            part = (words.mix(keys[mine]) % parts[spot].astype(np.uint64)).astype(np.int64)
            bucket[mine] = buckets + (np.cumsum(parts) - parts)[spot] + part
        cut |= bucket[1:] != bucket[:-1]
        begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
        stop = np.concatenate([begin[1:], [len(at)]])
        bucket = bucket[begin]
        ranked = np.argsort(bucket, kind="stable")
        left, right = starts[at[begin]], ends[at[stop - 1] + length - 1]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[ranked])) + 1, [len(ranked)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            mine = ranked[a:b]
            body = b"".join([whole[x:y] for x, y in zip(left[mine].tolist(), right[mine].tolist())])
            columns = [doc[begin[mine]], place[begin[mine]], right[mine] - left[mine]]
            out.append((int(bucket[mine[0]]), 0, pack(columns, body)))
    return rows.batch(
        bucket=[x[0] for x in out], kind=[x[1] for x in out], blob=pa.array([x[2] for x in out], pa.binary())
    )


def sort_bucket(blobs: list[bytes], length: int) -> pa.RecordBatch:
    """The stretches of all but the earliest of equal windows in the packed strings of a bucket."""
    parts = [unpack(b, 3) for b in blobs]
    doc, place, size = (np.concatenate([p[0][k] for p in parts]) for k in range(3))
    data = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(size)])
    starts, ends, first = words.word_spans(data, offsets)
    hashes = words.span_hashes(data, starts, ends)
    count = np.diff(first) - length + 1        # windows of each string
    order = np.lexsort((place, doc))
    count = count[order]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(first[:-1][order], count) + step
    doc, place = np.repeat(doc[order], count), np.repeat(place[order], count) + step
    copies = later_copies(words.windows(hashes, length)[at], hashes, at, doc, place, length)
    return stretches(doc[copies], place[copies], length)


def repeated(df: DataFrame, length: int = LENGTH, bucket_bytes: int | None = None) -> DataFrame:
    """Stretches of words (doc, begin, end) that later copies of windows cover; ``df`` has doc, text."""
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total * _COPIES // (bucket_bytes or BUCKET_BYTES)) + 16
    heavy = heavy_parts(df, buckets, length, bucket_bytes or BUCKET_BYTES)

    def sort_all(batches):
        for _, group in rows.by_group(batches, "bucket"):
            kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
            for kind, blob in zip(kinds, blobs):
                if kind == 1:
                    doc, begin, end = unpack(blob, 3)[0]
                    yield rows.batch(doc=doc, begin=begin, end=end)
            strings = [b for k, b in zip(kinds, blobs) if k == 0]
            if strings:
                yield sort_bucket(strings, length)

    packed = rows.map_units(
        df.select("doc", "text"), "text", lambda unit: super_kmers(unit, buckets, length, heavy),
        "bucket long, kind long, blob binary", UNIT_BYTES,
    )
    # what a unit found itself belongs to no bucket: deal it out evenly
    packed = packed.withColumn(
        "bucket", F.when(F.col("kind") == 1, -1 - F.pmod(F.xxhash64("blob"), F.lit(buckets))).otherwise(F.col("bucket"))
    )
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(sort_all, "doc long, begin long, end long")


def keep_words(text: bytes, stretches_: list[dict] | None) -> tuple[int, int, list[bytes]]:
    found = text.split()
    if not stretches_:
        return len(found), 0, found
    turns = np.zeros(len(found) + 1, np.int64)
    for s in stretches_:
        turns[min(s["begin"], len(found))] += 1
        turns[min(s["end"], len(found))] -= 1
    gone = np.cumsum(turns[:-1]) > 0
    return len(found), int(gone.sum()), [found[i] for i in np.flatnonzero(~gone).tolist()]


def remove_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by a space (kept_text), or with
    ``digest`` their SHA-256 (kept_sha256)."""
    source = df.select(F.col(doc_id).alias("doc_id"), row_id(doc_id, text).alias("doc"), F.col(text).alias("text"))
    marks = repeated(source, length).groupBy("doc").agg(
        F.collect_list(F.struct("begin", "end")).alias("gone")      # no more than the document has words
    )
    joined = source.join(marks, "doc", "left").select("doc_id", "text", "gone")
    last = "kept_sha256" if digest else "kept_text"

    def finish(unit):
        texts = rows.texts_of(*rows.text_bytes(unit.column("text")))
        done = [keep_words(t, g) for t, g in zip(texts, unit.column("gone").to_pylist())]
        kept = [b" ".join(d[2]) for d in done]
        values = [hashlib.sha256(k).hexdigest() if digest else k.decode("utf-8", "replace") for k in kept]
        return rows.batch(
            doc_id=unit.column("doc_id"), n_words=[d[0] for d in done], n_removed=[d[1] for d in done],
            **{last: values},
        )

    kind = source.schema["doc_id"].dataType.simpleString()
    return rows.map_units(joined, "text", finish, f"doc_id {kind}, n_words long, n_removed long, {last} string")
