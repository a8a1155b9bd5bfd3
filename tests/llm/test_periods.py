"""Periodic runs against a search of every lag, on texts full of repeats and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from importflow.llm import periods, queries, words
from importflow.session import apply_settings

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("runs", StringType()),
    StructField("collapsed", LongType()),
])


@pytest.fixture(scope="module")
def session(spark):
    return apply_settings(spark)


def every_run(found, least=12):
    """All maximal stretches with each period, then the shortest period of each."""
    runs = {}
    for p in range(1, len(found) // 2 + 1):
        i = 0
        while i + p < len(found):
            j = i
            while j + p < len(found) and found[j] == found[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                runs.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in runs.items())


def collapse(found, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(found) if k not in gone)


def repetitive(rng):
    text = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(3)
        size = rng.randrange(1, 40)
        if kind == 0:
            text += [f"u{rng.randrange(10**6)}" for _ in range(size)]
        elif kind == 1:
            text += [rng.choice("ab") for _ in range(size)]
        else:
            piece = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            text += (piece * 30)[:size]
    return text


def test_runs_against_every_lag():
    rng = random.Random(5)
    texts = [repetitive(rng) for _ in range(400)] + [[], ["a"], ["a"] * 11, ["a"] * 12, list("ab") * 6, list("abc") * 500]
    data = np.frombuffer(" ".join(" ".join(t) for t in texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(" ".join(t)) + 1 for t in texts])
    offsets[-1] -= 1
    starts, ends, first = words.word_spans(data, offsets)
    start, length, period = periods.find(words.span_hashes(data, starts, ends), first)
    line = np.searchsorted(first, start, "right") - 1
    got = [[] for _ in texts]
    for k in range(len(start)):
        got[line[k]].append((int(start[k] - first[line[k]]), int(length[k]), int(period[k])))
    assert got == [every_run(t) for t in texts]


def test_slow_splitting_is_finished_alone():
    """A segment that loses one word a round: nested pairs around the run."""
    pairs = [f"n{i}" for i in range(60)]
    text = [w for i, w in enumerate(pairs) for w in [w] + pairs[:i][-1:]] + ["x", "y", "z"] * 8
    codes = np.unique(text, return_inverse=True)[1].astype(np.int64)
    begin, end = periods.segments(codes, np.array([0, len(text)]), 12)
    held = {k for a, b in zip(begin, end) for k in range(a, b)}
    assert all(k in held for s, n, p in every_run(text) for k in range(s, s + n))
    whole = periods.peel(codes.tolist(), 12)
    for a, b in whole:
        part = codes[a:b].tolist()
        assert b - a >= 12 and all(part.count(c) >= 2 for c in set(part))
    assert {k for a, b in whole for k in range(a, b)} <= held


def test_the_query_against_brute_force(session):
    rng = random.Random(9)
    ids = list(range(60)) + [-7, 10**12, 2**62]
    rows = [(i, " \n".join(repetitive(rng)), "x", 1) for i in ids]
    rows += [(70, None, None, None), (71, "", None, None), (72, " \t ", None, None), (None, "a " * 30, None, None),
             (73, "z " * 40_000, None, None), (73, "z " * 40_000, None, None), (None, None, None, None)]
    frame = session.createDataFrame(rows, SCHEMA)
    changed = frame.withColumn("text", periods.rewritten("doc_id", "text"))
    got = [tuple(r) for r in periods.summary(periods.with_runs(changed, keep=["doc_id"])).collect()]
    want = []
    for doc_id, text, _, _ in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and found:
            g, n = h // 10, len(found)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
        runs = every_run(found) if len(found) < 1000 else [(0, len(found), 1)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
                     hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(collapse(found, runs).encode()).hexdigest()))
    assert sum(r[1] for r in want) > 60
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_all_columns_stay_and_clashing_ones_give_way(session):
    frame = session.createDataFrame([(1, "a b " * 8 + "c", "old", 5)], SCHEMA)
    row = periods.with_runs(frame).collect()[0]
    assert row.asDict(True) == {"doc_id": 1, "text": "a b " * 8 + "c", "collapsed": "a b c",
                                "runs": [{"start": 0, "length": 16, "period": 2}]}
    none = session.createDataFrame([], SCHEMA)
    assert periods.summary(periods.with_runs(none, keep=["doc_id"])).collect() == []


def test_crc32_in_sql():
    import duckdb

    for text in ("0", "7", "-12", "123456789"):
        got = duckdb.sql(f"SELECT {queries.crc32_sql(repr(text))}").fetchall()[0][0]
        assert got == zlib.crc32(text.encode())
