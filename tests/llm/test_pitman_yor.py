"""The Pitman-Yor model: seatings against their law by enumeration, scores against a plain calculation."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from importflow.llm import pitman_yor as model
from importflow.llm import words
from importflow.session import apply_settings

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("score", StringType()),
    StructField("held_out", LongType()),
])


@pytest.fixture(scope="module")
def session(spark):
    return apply_settings(spark)


def law(c, p, others, d, theta):
    """Probability of each number of tables of c customers: all seatings, one customer after another."""
    weight = {1: 1.0}
    for i in range(1, c):
        following = Counter()
        for t, w in weight.items():
            following[t] += w * (i - d * t)
            following[t + 1] += w * p * (theta + d * (others + t))
        weight = following
    total = sum(weight.values())
    return {t: w / total for t, w in weight.items()}


@pytest.mark.parametrize("c, p, others, d, sweeps", [
    (2, 0.1, 3, 0.7, 5), (5, 0.3, 2, 0.5, 12), (9, 0.02, 200, 0.8, 12), (60, 0.02, 20, 0.6, 60)])
def test_seatings_follow_their_law(c, p, others, d, sweeps):
    """The more customers, the more sweeps it takes."""
    n, theta = 10_000, 1.0
    owner, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    name = words.mix(np.arange(n).astype(np.uint64))
    for sweep in range(sweeps):
        owner, at = model.reseat(
            np.full(n, c), np.full(n, p), np.full(n, others), owner, at, d, theta, model._seeds(name, sweep), not sweep)
    seen = np.bincount(1 + np.bincount(owner, minlength=n))
    for t, want in law(c, p, others, d, theta).items():
        got = seen[t] / n if t < len(seen) else 0
        assert abs(got - want) < 0.02, (t, got, want)


def test_stretches_give_what_single_steps_give(monkeypatch):
    rng = np.random.default_rng(3)
    n = 3000
    seeds = words.mix(np.arange(n).astype(np.uint64))
    c, p, base = rng.integers(1, 300, n), rng.random(n) * 0.5, rng.random(n) * 20
    c[:3] = 5000
    found = []
    for steps, stretch in ((6000, 1), (2, 100), (32, 1 << 19)):
        monkeypatch.setattr(model, "STEPS", steps)
        monkeypatch.setattr(model, "STRETCH", stretch)
        found.append(model.propose(c, p, base, 0.7, seeds))
    owner, at = found[0]
    assert len(at) > 2 * n and ((at >= 1) & (at < c[owner])).all() and (np.diff(at)[np.diff(owner) == 0] > 0).all()
    for other in found[1:]:
        assert np.array_equal(other[0], owner) and np.array_equal(other[1], at)


def test_products_of_normalisers():
    rng = random.Random(2)
    c = np.array([2, 7, 50, 1000])
    base, slope = np.array([0.3, 2.0, 0.01, 5.0]), np.array([0.5, 0.2, 0.79, 0.6])
    openings = [sorted(rng.sample(range(1, n), min(n - 1, 9))) for n in c.tolist()]
    owner = np.repeat(np.arange(4), [len(x) for x in openings])
    got = model.normalisers(owner, np.concatenate(openings), c, base, slope)
    for k, n in enumerate(c.tolist()):
        t, want = 1, 0.0
        for i in range(1, n):
            want += math.log(i + base[k] - slope[k] * t)
            t += i in openings[k]
        assert abs(got[k] - want) < 1e-6


def tokens_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def test_scores_against_a_plain_calculation(session):
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "É", "漢字", *[f"w{k}" for k in range(30)]]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(150)]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    rows += [(200, None, None, None), (201, "", None, None), (202, " \t\n", None, None), (None, "the null id", None, None),
             (3, texts[3], None, None), (203, "long " * 100_000, None, None), (None, None, None, None)]
    rows += [(i, "never seen before the of", None, None) for i in range(1000, 1040)]
    frame = session.createDataFrame(rows, SCHEMA)
    train = ~model.held_out()
    fitted = model.learn(frame.where(train))
    got = {}
    for r in model.score(frame, fitted, train).collect():
        got.setdefault(r.doc_id, []).append(r)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in got}
    single, pairs = Counter(), Counter()
    for i, text, _, _ in rows:
        if not held[i]:
            single.update(tokens_of(text))
            pairs.update(zip([0, *tokens_of(text)], tokens_of(text)))
    total, kinds = sum(single.values()), len(single)
    assert (fitted.tokens, fitted.kinds, fitted.texts) == (total, kinds, single[None])
    assert any(held.values())

    def name(word):
        if word in (0, None):
            return int((model.START if word == 0 else model.END).astype(np.int64))
        data = np.frombuffer(word.encode(), np.uint8)
        return int(words.span_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])

    said = {r.word: r for r in fitted.vocabulary.collect()}
    tables = {(r.word, r.following): r.t for r in fitted.pairs.collect()}
    for s in range(model.SAMPLES):      # every state is a whole one
        p = sum(said[name(w)].p[s] for w in single) + fitted.unknown[s]
        assert abs(p - 1) < 1e-9
        for head in (0, "the", "w3"):
            after = {w: n for (h, w), n in pairs.items() if h == head}
            t = {w: tables.get((name(head), name(w)), [1] * model.SAMPLES)[s] for w in after}
            assert said[name(head)].t[s] == sum(t.values())
            assert all(1 <= t[w] <= n for w, n in after.items())

    def likely(head, word):
        heads = single[None] if head == 0 else single[head]
        values = []
        for s in range(model.SAMPLES):
            above = said[name(word)].p[s] if single[word] else fitted.unknown[s]
            t = said[name(head)].t[s] if heads else 0
            n = pairs[head, word]
            own = max(n - fitted.discount * tables.get((name(head), name(word)), [1] * 9)[s], 0) if n else 0
            values.append((own + (1 + fitted.discount * t) * above) / (1 + heads))
        return sum(values) / len(values)

    for i, text, _, _ in rows:
        found = tokens_of(text)
        base = sum(math.log10((single[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in found)
        score = sum(math.log10(likely(h, w)) for h, w in zip([0, *found], found))
        known = sum(single[w] > 0 for w in found)
        assert any(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(found), known, total)
            and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
            for r in got[i]), (i, text and text[:50])
    assert sum(map(len, got.values())) == len(rows)


def test_the_model_beats_plain_counts_on_texts_it_has_not_seen(session):
    rng = random.Random(8)
    chain = {w: rng.sample(range(60), 4) for w in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(80):
            out.append(f"w{w}")
            w = rng.choice(chain[w])
        return " ".join(out)

    frame = session.createDataFrame([(i, text(), "", 0) for i in range(300)], SCHEMA)
    train = ~model.held_out()
    got = {r.held_out: r for r in model.perplexity(model.score(frame, model.learn(frame.where(train)), train)).collect()}
    assert got[True].perplexity < 6 < 40 < got[True].base_perplexity
    assert got[True].perplexity < 1.5 * got[False].perplexity


def test_without_training_text_and_without_rows(session):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    frame = session.createDataFrame([(i, "a b", "", 0) for i in held], SCHEMA)
    train = ~model.held_out()
    fitted = model.learn(frame.where(train))
    rows = model.score(frame, fitted, train).collect()
    assert len(rows) == len(held) and all((r.n_known, r.train_tokens, r.score) == (0, 0, 0.0) for r in rows)
    none = session.createDataFrame([], SCHEMA)
    assert model.score(none, model.learn(none), F.lit(True)).collect() == []


def test_units_ask_in_few_bytes_and_in_order():
    """Words and pairs with their counts in training text; a checksum takes less than its eight bytes."""
    rng = random.Random(6)
    texts = [" ".join(f"W{rng.randrange(3000)}" for _ in range(400)) for _ in range(100)]
    learned = [rng.random() < 0.7 for _ in texts]
    unit = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": texts, "__train": learned})
    asked = model._ask(unit, "text", "__train", ["doc_id", "text"], 3)
    told = [model.unpack(b) for _, b in sorted(zip(asked.column("bucket").to_pylist(), asked.column("blob").to_pylist()))]
    known, keys = (np.concatenate([model.of_steps(t[k]) for t in told]) for k in (0, 1))
    single, pairs = {None}, Counter()
    for text, mine in zip(texts, learned):
        for pair in zip([0, *tokens_of(text)], tokens_of(text)):
            single.add(pair[1])
            pairs[pair] += mine
    assert len(known) == len(single) + 1 and len(keys) == len(pairs)
    assert (known[1:] > known[:-1]).all() and (keys[1:] > keys[:-1]).all()
    assert Counter(np.concatenate([t[2] for t in told]).tolist()) == Counter(pairs.values())
    assert sum(map(len, asked.column("blob").to_pylist())) < 7.5 * (len(known) + len(keys))
    numbered, number = model.Text(unit, "text").numbered()
    number = np.unique(number)
    assert np.array_equal(numbered, known)
    assert np.array_equal(np.sort(words.chain(known[number // len(known)], known[number % len(known)])), keys)


def test_sweeps_move_no_row_for_each_pair_and_none_for_words_seen_once(session, monkeypatch):
    """Pairs stay packed by bucket between sweeps; a word that is there once is only counted."""
    kept = []
    store = model.rows.Scratch.store

    def watch(self, df):
        stored = store(self, df)
        kept.append((self.folder, stored.columns, stored.count()))
        return stored

    monkeypatch.setattr(model.rows.Scratch, "store", watch)
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(300)) + f" once{i}" for i in range(60)]
    found = Counter(pair for t in texts for pair in zip([0, *tokens_of(t)], tokens_of(t)))
    again = {pair for pair, n in found.items() if n > 1}
    assert len(again) > 1200
    frame = session.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    fitted = model.learn(frame)
    assert fitted.kinds == 40 + 60 + 1 and fitted.vocabulary.count() == fitted.kinds + 1
    states = [n for folder, columns, n in kept if "pitman-yor-pairs" in folder]
    assert len(states) == model.BURN + model.SAMPLES - 1 and max(states) < len(again) / 2
    vocabularies = [n for _, columns, n in kept if "dish" in columns]
    assert vocabularies and set(vocabularies) == {40 + 2}


def test_packed_pairs_come_back_as_they_were():
    rng = np.random.default_rng(5)
    names = np.sort(rng.integers(0, 2**63, 50).astype(np.uint64))
    at = rng.choice(2500, 400, replace=False)
    head, word, c = names[at // 50], names[at % 50], rng.integers(2, 90, 400)
    pairs = model.Seated.of(head, word, c)
    pairs.owner, pairs.at = np.array([3, 3, 9]), np.array([1, 4, 1])
    pairs.states.append(pairs.tables())
    got = model.Seated.unpacked(pairs.packed())
    assert sorted(zip(got.known[got.head], got.known[got.word], got.c)) == sorted(zip(head, word, c))
    assert got.owner.tolist() == [3, 3, 9] and got.at.tolist() == [1, 4, 1] and got.tables().tolist() == got.states[0].tolist()
    assert got.by_head(got.c).sum() == got.by_word(got.c).sum() == c.sum()


def test_pairs_of_a_bucket_are_seated_alike_in_any_portions():
    rng = np.random.default_rng(7)
    names = np.sort(rng.integers(0, 2**63, 50).astype(np.uint64))
    at = rng.choice(2500, 400, replace=False)
    c, p, others = rng.integers(2, 90, 400), rng.random(400) * 0.1, rng.integers(0, 300, 400)
    found = []
    for together in (7, 399, 1 << 18):
        pairs = model.Seated.of(names[at // 50], names[at % 50], c)
        for sweep in range(3):
            pairs.reseat(p, others, sweep, 0.7, 1.0, together)
        found.append((pairs.owner.tolist(), pairs.at.tolist()))
    assert len(found[0][0]) > 400 and found[0] == found[1] == found[2]
