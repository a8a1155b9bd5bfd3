"""The conversation trie against one built turn by turn, also with every part cut small."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from importflow.llm import rows, tries
from importflow.operators import skew
from importflow.session import apply_settings

SCHEMA = StructType([
    StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
    StructField("text", StringType()), StructField("node", StringType()), StructField("depth", LongType()),
])


@pytest.fixture(scope="module")
def session(spark):
    return apply_settings(spark)


def by_hand(said):
    """The rows of the trie of ``said``: conv_id, turn, role, text."""
    turns = defaultdict(list)
    for c, t, role, text in said:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) % 100 * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(c - base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    totals = {}
    for s in sorted(members, key=len, reverse=True):
        own = (len(members[s]) - 1) * (len(s[-1][1]) if s else 0)
        totals[s] = (sum(totals[k][0] for k in kids[s]) if kids[s] else 1, own + sum(totals[k][1] for k in kids[s]))
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), *totals[s],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(s)).encode()).hexdigest())
        for s, m in members.items())


def told(frame):
    return sorted(tuple(r) for r in frame.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ).collect())


def plain(said):
    return [(*x, "n", 1) for x in said]


def some(seed, convs):
    rng = random.Random(seed)
    said = []
    for c in convs:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            said.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["é", "no", "漢字 x", "", None, "yes"])))
    rng.shuffle(said)
    return said


def test_against_a_trie_by_hand(session):
    said = some(3, [*range(180), -3, -100, -250, 10**15, 7_000_100, 7_000_155])
    said += [(None, 1, "user", "x"), (None, None, None, None), (500, None, "user", "first"), (500, 2, "user", "then"),
             (501, 1, "user", "long " * 50_000), (502, 1, "user", "long " * 50_000)]
    frame = session.createDataFrame(plain(said), SCHEMA)
    assert told(tries.prefix_trie(frame)) == by_hand(said)


def test_one_long_conversation_and_many_copies(session, monkeypatch):
    """A chain of thousands of nodes takes few rounds, in segments; many ends of one node go in pieces."""
    monkeypatch.setattr(tries, "ENDS_A_ROW", 7)
    monkeypatch.setattr(skew, "PIECE_ROWS", 20)
    said = [(900, t, "user", f"step {t % 5}") for t in range(1500)]
    said += [(c, t, "user", "all the same") for c in range(1, 400) for t in range(3)]
    frame = session.createDataFrame(plain(said), SCHEMA)
    assert told(tries.prefix_trie(frame, limit=50)) == by_hand(said)


def test_rows_that_repeat_and_no_rows(session):
    said = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 1, "u", "b")] * 3
    got = told(tries.prefix_trie(session.createDataFrame(plain(said), SCHEMA)))
    assert got == by_hand(said) and got[-1][1] == max(r[1] for r in got)
    assert told(tries.prefix_trie(session.createDataFrame([], SCHEMA))) == []


def test_totals_of_random_trees(session):
    """Rake and compress alone, on chains, stars and random trees."""
    rng = random.Random(1)
    for shape in (lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(max(0, i - 4), i), lambda i: rng.randrange(i)):
        parent = {i: shape(i) if i else None for i in range(300)}
        value = {i: rng.randrange(-5, 50) for i in parent}
        total = dict(value)
        for i in sorted(parent, reverse=True):
            if i:
                total[parent[i]] += total[i]
        name = lambda i: None if i is None else i.to_bytes(4, "big")
        frame = session.createDataFrame(
            [(name(i), name(p), value[i]) for i, p in parent.items()], "node binary, parent binary, v long")
        scratch = rows.Scratch(session, "trees")
        got = tries.subtree_totals(frame, scratch, ["v"]).collect()
        assert {int.from_bytes(r.node, "big"): r.v for r in got} == total and len(got) == 300
        assert scratch.count < 4 * 25
