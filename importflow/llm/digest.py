"""Quartile digests: texts that share most of their byte triplets get digests that differ little.

Within every ``SPAN`` consecutive bytes (3: just the one) the triplets that hold the first are hashed
to ``BUCKETS`` counters.  The digest writes for each counter in which quarter of the text's counters it lies (two
bits), before them a checksum, the length on a logarithmic scale, and the quartiles' ratios.  The
difference of two digests sums the steps between quarters, an opposite quarter counting double,
and bounded steps of length and ratios; likeness is 1 less its share of ``MOST``, 0 at the least.

NULL and empty texts: the digest of the empty text.  Equal texts have equal digests.  Order of
documents, where it matters: ascending id, NULL first, rows of one id by a hash of their text.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from importflow.llm import rows
from importflow.session import store

BUCKETS = 512
SPAN = 3
MOST = 1.625 * BUCKETS      # what quarters drawn by chance differ by; no likeness from there on
LENGTH_BASE = 1.1
UNIT = 1 << 20

_STEPS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text's triplets fall in each bucket."""
    texts, total = len(offsets) - 1, len(data)
    text = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)     # bytes from here to the text's end
    wide = np.concatenate([data, np.zeros(SPAN, np.uint8)]).astype(np.uint32)
    found = np.zeros(texts * BUCKETS, np.int64)
    for salt, (j, k) in enumerate(combinations(range(1, SPAN), 2), 1):
        with np.errstate(over="ignore"):
            key = wide[:total] | wide[j:total + j] << np.uint32(8) | wide[k:total + k] << np.uint32(16)
            key = (key ^ np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA77)
        bucket = (key >> np.uint32(16)) % np.uint32(BUCKETS)
        whole = left > k
        found += np.bincount(text[whole] * BUCKETS + bucket[whole], minlength=len(found))
    return found.reshape(texts, BUCKETS)


def digests(texts: list[bytes]) -> list[str]:
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    table = counts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    ranked = np.sort(table, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    quarter = (table > q1).astype(np.uint8) + (table > q2) + (table > q3)
    four = quarter.reshape(len(texts), -1, 4)
    body = four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6
    length = np.floor(np.log(np.maximum(sizes, 1)) / np.log(LENGTH_BASE)).astype(int) & 255
    ratio = lambda a, b: (np.where(b > 0, 15 * a // np.maximum(b, 1), 0)).ravel().astype(int)
    low, mid = ratio(q1, q3), ratio(q2, q3)
    return [
        f"{zlib.crc32(t) & 255:02x}{n:02x}{a:x}{b:x}{code.tobytes().hex()}"
        for t, n, a, b, code in zip(texts, length.tolist(), low.tolist(), mid.tolist(), body)
    ]


def _parts(digest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digest)), np.uint8).reshape(len(digest), -1)
    codes = np.stack([raw[:, 3:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(digest), -1)
    return raw[:, :3].astype(int), codes


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Pairwise likeness, 0 to 1, of two lists of digests."""
    if not left:
        return np.zeros(0)
    (a, x), (b, y) = _parts(left), _parts(right)
    apart = np.abs(a[:, 1] - b[:, 1])
    apart = np.minimum(apart, 256 - apart)
    low, mid = np.abs((a[:, 2] >> 4) - (b[:, 2] >> 4)), np.abs((a[:, 2] & 15) - (b[:, 2] & 15))
    total = _STEPS[x, y].sum(axis=1) + np.minimum(apart, 24) + np.minimum(low, 8) + np.minimum(mid, 8)
    return 1 - np.minimum(total + (a[:, 0] != b[:, 0]), MOST) / MOST


def edit(text: str, other: str) -> str:
    """The last half of ``text`` replaced by the begin of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


OUT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(ids: list, texts: list[str], following: list[str]) -> dict:
    """The result columns of texts, each with the one that follows it (the next of the list, but for the last)."""
    own = [_encoded(t) for t in [*texts, following[-1]]]
    changed = [_encoded(edit(t, f)) for t, f in zip(texts, following)]
    prints, edited = digests(own), digests(changed)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": prints[:-1], "edited_fingerprint": edited,
        "near_edited": likeness(prints[:-1], edited), "near_next": likeness(prints[:-1], prints[1:]),
    }


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def compare_neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text and of its edit with the next one's begin, and their likenesses.

    Ranges of ids are sorted, each in a task.  A task does not have the text that follows its
    last, so it hands on its first and its last text; these few rows, two for each task at most,
    are put together afterwards.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part, first, held = TaskContext.get().partitionId(), None, None
        for unit in rows.gathered(batches, "text", UNIT):
            ids, texts = unit.column("doc_id").to_pylist(), unit.column("text").to_pylist()
            if held is None:
                first = texts[0]
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if len(texts) > 1:
                done = _compare(ids[:-1], texts[:-1], texts[1:])
                yield _rows(done, part, None, None)
            held = ids[-1], texts[-1]
        if held:
            yield _rows({"doc_id": [held[0]]}, part, [first], [held[1]])

    def _rows(done, part, head, tail):
        n = len(done["doc_id"])
        fields = dict(f.rsplit(" ", 1) for f in OUT.split(", "))
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        columns = {"doc_id": pa.array(done["doc_id"], arrow_kind)}
        columns |= {f: pa.array(done[f], types[t]) if f in done else pa.nulls(n, types[t]) for f, t in fields.items()}
        nothing = pa.nulls(n, pa.string())
        return rows.batch(
            **columns, part=pa.array([part] * n, pa.int64()),
            head=pa.array(head, pa.string()) if head else nothing,
            tail=pa.array(tail, pa.string()) if tail else nothing,
        )

    arrow_kind = to_arrow_type(source.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, {OUT}, part long, head string, tail string"
    done = store(dealt.mapInArrow(run, schema), "digests")
    ends = done.where(F.col("tail").isNotNull())
    # as many rows as there are tasks: which task follows which
    places = sorted(r[0] for r in ends.select("part").collect())
    after = dict(zip(places, places[1:] + places[:1]))
    if not after:
        return done.select("doc_id", *[f.rsplit(" ", 1)[0] for f in OUT.split(", ")])
    follows = df.sparkSession.createDataFrame(list(after.items()), "part long, next long")
    heads = ends.select(F.col("part").alias("next"), F.col("head").alias("following"))
    pairs = ends.select("doc_id", "part", "tail").join(follows, "part").join(heads, "next").select(
        "doc_id", F.col("tail").alias("text"), "following"
    )

    def finish(unit):
        each = zip(*(unit.column(c).to_pylist() for c in ("doc_id", "text", "following")))
        done = [_compare([i], [t], [f]) for i, t, f in each]
        joined = {k: [x for d in done for x in d[k]] for k in done[0]}
        return rows.batch(**joined | {"doc_id": pa.array(joined["doc_id"], arrow_kind)})

    last = rows.map_units(pairs, "text", finish, f"doc_id {kind}, {OUT}", UNIT)
    return done.where(F.col("tail").isNull()).select(*last.columns).unionByName(last)
