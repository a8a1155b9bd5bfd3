"""A hierarchical Pitman-Yor model of words, fitted by Gibbs sampling, and the log10 probability of texts.

Every word is a restaurant for the words that follow it; all of them have one parent, whose own base is
uniform over the known words and one unknown.  A word seen c times after a context sits there at some
tables; each table is one customer of the parent.  A sweep reseats, at both levels, all customers of a
word in a restaurant: they come in one after another, and a new table is opened with probability
p (theta + d T) against i - d t for one of the t tables that i customers use, p the parent's
probability and T all tables of the restaurant.  That seating is a proposal; the ratio of the products
of its normalisers to that of the seating before decides whether it is taken (Metropolis within Gibbs),
so that seatings are drawn from the model's own law.  The first sweep takes every
proposal.  As usual for sampling on many machines, T and p are those from the start of the sweep.  Words seen once after a context have one table and are only
counted.  A seating takes time in proportion to its customers, memory in proportion to its tables.  The probabilities of SAMPLES states after BURN sweeps are averaged.

What travels: units of text send their different word pairs, packed, to buckets that add them up; the
heads of frequent words are split over several.  Pairs seen twice or more stay packed by bucket: in every
sweep the vocabulary tells each bucket the restaurants' totals of the words it once asked for, and only
words with more tables than pairs come back as rows.  Words seen once are not drawn for.  For scoring, units send their pairs once more and each is
told counts and tables, so no text asks for a pair twice.  Words and pairs are told apart by 64-bit
checksums.  Draws depend on checksums and sweep only: a task that runs again draws the same.

NULL or empty text: the end alone.  Texts of any length are read whole; one longer than a unit is a unit
of its own, with memory in proportion.  A NULL id is of the training part.  Repeated rows count as often
as they come.  Other columns are not read, whatever their names.  Without training text every word is
unknown.  Empty table: no row.
"""

from __future__ import annotations

import gc
import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from importflow.llm import rows, words

UNIT_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20     # of text whose pairs meet in one bucket
BURN = 2                    # sweeps before the first state that counts
SAMPLES = 2
CONCENTRATION = 1.0         # theta, at both levels
ROWS = 1 << 18              # pairs or words that are seated together
HOME_WORDS = 1 << 17        # words of the vocabulary that answer together
STEPS = 32                  # customers that are seated one by one, before whole stretches are
STRETCH = 1 << 19           # customers in such stretches, of all words together
START, END = (words.mix(np.array([k], np.uint64))[0] for k in (101, 102))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _steps(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def pack(*arrays: np.ndarray) -> bytes:
    plain = pickle.dumps(arrays, 5)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def steps_of(x: np.ndarray) -> np.ndarray:
    """Checksums in rising order as their differences, byte by byte: the high bytes are all zero."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def of_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.T).view(np.uint64).ravel(), dtype=np.uint64)


def small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest takes."""
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the checksums, so that those in order are in order of their buckets."""
    return (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def tallied(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in order and how often each is there."""
    ranked = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    return ranked[first], np.diff(np.append(first, len(x)))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values in order, a place of each, and the number of each element's value."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[first], order[first], inverse


# --- seating ---------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x, by Stirling's series eight places on."""
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def uniform(seeds: np.ndarray, turn: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = words.mix(seeds ^ words.mix(np.asarray(turn, np.uint64) * _STEP + np.uint64(7)))
    return ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normalisers(owner: np.ndarray, at: np.ndarray, c: np.ndarray, base: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """For every seating the sum of log(i + base - slope * t) over its customers after the first, i
    being before them at t tables; ``at``: i at each opening, in order, of seating ``owner``."""
    k = np.bincount(owner, minlength=len(c))
    first = np.cumsum(k + 1) - (k + 1)
    line = np.repeat(np.arange(len(c)), k + 1)
    low, high = np.ones(len(line)), c[line].astype(float)
    inner = first[owner] + _steps(k) + 1
    low[inner] = at + 1
    high[inner - 1] = at + 1
    shift = base[line] - slope[line] * (_steps(k + 1) + 1)
    return np.add.reduceat(log_gamma(high + shift) - log_gamma(low + shift), first)


def propose(c: np.ndarray, p: np.ndarray, base: np.ndarray, discount: float, seeds: np.ndarray):
    """Seat ``c`` customers one after another: (owner, at) of all openings after the first table."""
    slope = discount * (1 - p)
    t = np.ones(len(c))
    owner, at = [], []
    order = np.argsort(-c, kind="stable")
    upto = len(c) - np.searchsorted(c[order][::-1], np.arange(STEPS + 2), "right")     # with more than i customers
    for i in range(1, STEPS + 1):
        now = order[:upto[i]]
        if not len(now):
            break
        opened = now[uniform(seeds[now], i) * (i + base[now] - slope[now] * t[now]) < base[now] + p[now] * discount * t[now]]
        t[opened] += 1
        owner.append(opened)
        at.append(np.full(len(opened), i))
    now, i = order[:upto[STEPS + 1]], np.full(len(c), STEPS + 1)
    while len(now):
        # A stretch of customers of every word at once.  More tables make an opening likelier, so taking t
        # too low and counting openings again and again ends at what seating one by one gives.
        n = np.minimum(c[now] - i[now], STRETCH // len(now) + 1)
        line = np.repeat(now, n)
        k = i[line] + _steps(n)
        drawn = uniform(seeds[line], k)
        first = np.cumsum(n) - n
        before, opened = np.zeros(len(line)), None
        while True:
            tables = t[line] + before
            again = drawn * (k + base[line] - slope[line] * tables) < base[line] + p[line] * discount * tables
            if opened is not None and np.array_equal(again, opened):
                break
            opened = again
            passed = np.cumsum(opened) - opened
            before = passed - np.repeat(passed[first], n)
        owner.append(line[opened])
        at.append(k[opened])
        t[now] += np.add.reduceat(opened.astype(np.int64), first)
        i[now] += n
        now = now[i[now] < c[now]]
    owner, at = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (owner, at))
    order = np.lexsort((at, owner))
    return owner[order], at[order]


def reseat(c, p, others, owner, at, discount: float, concentration: float, seeds: np.ndarray, first: bool = False):
    """One draw for each word of a restaurant: c customers (1 at least), the parent's probability p,
    tables of the restaurant's ``others``, and the openings so far.  Returns the openings after it.
    ``first``: nobody is seated yet, so the proposal is the seating."""
    if not len(c):
        return owner, at
    base = p * (concentration + discount * others)
    new_owner, new_at = propose(c, p, base, discount, seeds)
    if first:
        return new_owner, new_at
    slope = discount * (1 - p)
    ratio = normalisers(new_owner, new_at, c, base, slope) - normalisers(owner, at, c, base, slope)
    taken = np.log(uniform(seeds, 0)) < ratio
    new, old = taken[new_owner], ~taken[owner]
    owner, at = np.concatenate([new_owner[new], owner[old]]), np.concatenate([new_at[new], at[old]])
    order = np.argsort(owner, kind="stable")
    return owner[order], at[order]


def read_openings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = rows.text_bytes(column)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), np.frombuffer(data.tobytes(), "<i8")


def write_openings(owner: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]) * 8
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(at.astype("<i8").tobytes())])


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ROWS or so: a draw takes as many steps as its longest seating."""
    waiting, held = [], 0
    for batch in batches:
        if waiting and held + batch.num_rows > ROWS:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, held = [], 0
        if batch.num_rows:
            waiting.append(batch)
            held += batch.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _seeds(name: np.ndarray, sweep: int) -> np.ndarray:
    return words.mix(name ^ words.mix(np.full(1, sweep + 11, np.uint64)))


# --- pairs of words in units of text ---------------------------------------------------------------


class Text:
    """The tokens of a unit: words in lower case and an end for each text, each with the word before."""

    def __init__(self, unit: pa.RecordBatch, text: str):
        data, offsets = rows.text_bytes(unit.column(text))
        data = np.frombuffer(data.tobytes().translate(words.LOWER.tobytes()), np.uint8)
        starts, ends, first = words.word_spans(data, offsets)
        self.sizes = np.diff(first) + 1
        stops = np.cumsum(self.sizes) - 1
        self.token = np.full(int(self.sizes.sum()), END, np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[stops] = False
        self.token[inner] = words.span_hashes(data, starts, ends)
        self.before = np.concatenate([self.token[-1:], self.token[:-1]])
        self.before[stops + 1 - self.sizes] = START
        self.line = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The unit's words and the start in order, and for each token's pair a number: that of the
        word before times their count, and that of the word."""
        number, found = pd.factorize(self.token)
        known = np.append(found, START)
        order = np.argsort(known)
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(len(known))
        word = place[number]
        head = np.concatenate([word[-1:], word[:-1]])
        head[np.cumsum(self.sizes) - self.sizes] = place[-1]
        return known[order], head * len(known) + word


def counted_words(train: DataFrame, text: str) -> DataFrame:
    def work(unit):
        found, n = tallied(Text(unit, text).token)
        return rows.batch(word=signed(found), n=n)

    return rows.map_units(train.select(text), text, work, "word long, n long", UNIT_BYTES).groupBy("word").agg(
        F.sum("n").alias("c"))


def _slices(place: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if len(place) and place.max() < 1 << 16:
        place = place.astype(np.uint16)     # sorted by digits
    order = np.argsort(place, kind="stable")
    ranked = place[order]
    cut = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [len(ranked)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b > a:
            yield int(ranked[a]), [c[order[a:b]] for c in columns]


_SHAPE = "kind int, bucket long, other long, word long, h long, f long, blob binary"


def _shaped(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    empty = {"bucket": 0, "other": -1, "word": 0, "h": 0, "f": 0}
    plain = {c: pa.array(columns[c] if c in columns else np.full(n, x), pa.int64()) for c, x in empty.items()}
    return rows.batch(kind=np.full(n, kind, np.int32), **plain, blob=pa.array(columns.get("blob", [None] * n), pa.binary()))


class Seated:
    """Pairs of a bucket: their words in order, for each pair the numbers of its head and word among these,
    count and openings, and its tables in the states that count."""

    def __init__(self, known, head, word, c, opened, at, *states):
        self.known, self.head, self.word, self.c, self.at, self.states = known, head, word, c, at, list(states)
        self.owner = np.repeat(np.arange(len(c)), opened)

    @classmethod
    def of(cls, head: np.ndarray, word: np.ndarray, c: np.ndarray) -> Seated:
        known, _, number = distinct(np.concatenate([head, word]))
        head, word = number[:len(c)], number[len(c):]
        order = np.argsort(head, kind="stable")
        return cls(known, head[order], word[order], c[order], np.zeros(len(c), np.int64), np.zeros(0, np.int64))

    @classmethod
    def unpacked(cls, blob: bytes) -> Seated:
        known, *others = unpack(blob)
        return cls(of_steps(known), *[x.astype(np.int64) for x in others])

    def packed(self) -> bytes:
        opened = np.bincount(self.owner, minlength=len(self.c))
        return pack(steps_of(self.known), *[small(x) for x in (self.head, self.word, self.c, opened, self.at, *self.states)])

    def tables(self) -> np.ndarray:
        return 1 + np.bincount(self.owner, minlength=len(self.c))

    def reseat(self, p, others, sweep: int, discount: float, concentration: float, together: int = ROWS) -> None:
        name = words.chain(self.known[self.head], self.known[self.word])
        owners, places = [], []
        for a in range(0, len(self.c), together):
            part = slice(a, a + together)
            low, high = np.searchsorted(self.owner, [a, a + together])
            owner, at = reseat(self.c[part], p[part], others[part], self.owner[low:high] - a, self.at[low:high], discount,
                               concentration, _seeds(name[part], sweep), not sweep)
            owners.append(owner + a)
            places.append(at)
        self.owner, self.at = np.concatenate(owners), np.concatenate(places)

    def by_head(self, n: np.ndarray) -> np.ndarray:
        return np.bincount(self.head, n, len(self.known)).astype(np.int64)

    def by_word(self, n: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, n, len(self.known)).astype(np.int64)


def tallies(train: DataFrame, text: str, buckets: int, heavy: dict[int, int], homes: int) -> DataFrame:
    """From all pairs, by bucket; a pair is seen again each time after its first.  Kind 0: those seen again,
    as ``Seated``; kind 1: a word of these, how often it was before a word again (h) and how often it
    followed one again (f); kind 2: to ``bucket`` of the words, the words that the pairs of ``other`` have;
    kind 3: how many pairs have count 1 (h) and 2 (f).  Kinds 1 and 3 come in parts, to be added up."""
    split = np.array(sorted(heavy), np.uint64)
    parts = np.array([heavy[h] for h in sorted(heavy)], np.int64)
    behind = buckets + np.cumsum(parts) - parts

    def send(unit):
        known, number = Text(unit, text).numbered()
        number, n = tallied(number)
        head, word = known[number // len(known)], known[number % len(known)]
        place = bucket_of(head, buckets)
        if len(split):
            spot = np.minimum(np.searchsorted(split, head), len(split) - 1)
            mine = np.flatnonzero(split[spot] == head)
            spot = spot[mine]
            keys = words.chain(head[mine], word[mine])
            place[mine] = behind[spot] + (words.mix(keys) % parts[spot].astype(np.uint64)).astype(np.int64)
        out = []
        for bucket, (h, w, m) in _slices(place, head, word, n):
            cut = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            out.append((bucket, pack(steps_of(h[cut]), small(np.diff(np.append(cut, len(h)))), w, small(m))))
        return rows.batch(bucket=[b for b, _ in out], blob=pa.array([x for _, x in out], pa.binary()))

    def add_up(batches):
        for bucket, group in rows.by_group(batches, "bucket"):
            told = [unpack(b) for b in group.column("blob").to_pylist()]
            head = np.concatenate([np.repeat(of_steps(t[0]), t[1]) for t in told])
            word, n = (np.concatenate([t[k] for t in told]) for k in (2, 3))
            told = group = None
            keys, at, inverse = distinct(words.chain(head, word))
            count = np.bincount(inverse, n, len(keys)).astype(np.int64)
            n = keys = inverse = None
            sizes = [(count == 1).sum()], [(count == 2).sum()]
            often = np.flatnonzero(count > 1)
            pairs = Seated.of(head[at[often]], word[at[often]], count[often])
            asked = list(_slices(bucket_of(pairs.known, homes), pairs.known))
            yield _shaped(0, bucket=[bucket], blob=[pairs.packed()])
            yield _shaped(1, word=signed(pairs.known), h=pairs.by_head(pairs.c - 1), f=pairs.by_word(pairs.c - 1))
            yield _shaped(2, bucket=[home for home, _ in asked], other=[bucket] * len(asked),
                          blob=[pack(steps_of(x)) for _, (x,) in asked])
            yield _shaped(3, h=sizes[0], f=sizes[1])

    sent = rows.map_units(train.select(text), text, send, "bucket long, blob binary", UNIT_BYTES)
    dealt = sent.repartition(_partitions(train.sparkSession, buckets), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add_up, _SHAPE)


def _partitions(spark: SparkSession, buckets: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)


def release(spark: SparkSession) -> None:
    """Shuffle files of tables that are done with go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- the model -------------------------------------------------------------------------------------


class Model:
    """What scoring needs: word, c, p, t (a list with one value per state) of every word, those pairs
    with more than one table in a state, and numbers that hold for all."""

    def __init__(self, vocabulary: DataFrame, pairs: DataFrame, discount: float, unknown: list[float],
                 tokens: int, kinds: int, texts: int, concentration: float):
        self.vocabulary, self.pairs, self.discount, self.unknown = vocabulary, pairs, discount, unknown
        self.tokens, self.kinds, self.texts, self.concentration = tokens, kinds, texts, concentration


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else 0.5


def _buckets(df: DataFrame, text: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET_BYTES + 16


_VOCABULARY = "word long, c long, heads long, follows long, opened binary, tables long, dish long"


def learn(
    train: DataFrame, text: str = "text", burn: int = BURN, samples: int = SAMPLES, concentration: float = CONCENTRATION,
) -> Model:
    """Fit the model to all texts of ``train``."""
    spark = train.sparkSession
    start, end = (int(x.astype(np.int64)) for x in (START, END))
    lasting, passing = rows.Scratch(spark, "pitman-yor"), None
    counts = rows.Scratch(spark, "pitman-yor-counts").store(counted_words(train, text))
    # A word that is there once has one table at either level whatever is drawn: it is only counted.
    single = (F.col("c") == 1) & (F.col("word") != end)
    tokens, kinds, singles = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(single)).first()
    texts = sum(r["c"] for r in counts.where(F.col("word") == end).collect())
    buckets = _buckets(train, text)
    # words that would take more than a bucket by themselves: fewer than there are buckets
    heavy = {np.uint64(r["word"] % 2**64): r["c"] * buckets // tokens + 1
             for r in counts.where(F.col("c") * buckets > tokens).collect()}
    if heavy.pop(END, None):
        heavy[START] = texts * buckets // tokens + 1
    homes = (kinds - singles) // HOME_WORDS + 16
    tallied_once = rows.Scratch(spark, "pitman-yor-tallies")
    told = tallied_once.store(tallies(train, text, buckets, {int(k): v for k, v in heavy.items()}, homes))
    release(spark)
    discount = _discount(*[x or 0 for x in told.where("kind = 3").agg(F.sum("h"), F.sum("f")).first()])
    zero = F.lit(0).cast("long")
    # Before each token is a word or the start, and each word is before a token: less the pairs seen
    # again, that is how many words follow it and how many it follows.
    heads = F.when(F.col("word") == end, zero).otherwise(F.col("c"))
    vocabulary = counts.where(~single).select("word", "c", heads.alias("heads"), F.col("c").alias("follows")).unionAll(
        spark.range(1 if texts else 0).select(F.lit(start), zero, F.lit(texts).cast("long"), zero)
    ).unionAll(told.where("kind = 1").select("word", zero, -F.col("h"), -F.col("f"))).groupBy("word").agg(
        *[F.sum(c).alias(c) for c in ("c", "heads", "follows")])
    vocabulary = lasting.store(vocabulary.select("*", F.lit(None).cast("binary").alias("opened"), zero.alias("tables"),
                                                 zero.alias("dish")))
    ones, twos = vocabulary.agg(*[F.count_if(F.col("follows") == k) for k in (1, 2)]).first()
    above = _discount(ones + singles, twos)
    pairs, asked = told.where("kind = 0"), told.where("kind = 2")
    states: list[str] = []
    unknown: list[float] = []
    p_single: list[float] = []
    seats = 0
    for sweep in range(burn + samples):
        extra = pairs.where("kind = 1").groupBy("word").agg(F.sum("h").alias("h"), F.sum("f").alias("f"))
        joined = vocabulary.join(extra.hint("shuffle_hash"), "word", "left")
        total = seats if sweep else kinds
        former, lasting = lasting, rows.Scratch(spark, "pitman-yor")
        vocabulary = lasting.store(_reseat_root(joined, states, sweep, total, kinds, above, concentration))
        former.drop()
        customers, seats = (int(x or 0) + singles for x in vocabulary.agg(F.sum("dish"), F.sum("tables")).first())
        rest = (concentration + above * seats) / (kinds + 1)
        p = (F.col("dish") - above * F.col("tables") + rest) / (concentration + customers)
        if sweep >= burn:
            vocabulary = vocabulary.withColumns({f"p{sweep}": p, f"t{sweep}": F.col("ctx")})
            unknown.append(rest / (concentration + customers))
            p_single.append((1 - above + rest) / (concentration + customers))
            states = [*states, f"p{sweep}", f"t{sweep}"]
        if sweep == burn + samples - 1:
            break
        old, passing = passing, rows.Scratch(spark, "pitman-yor-pairs")
        answers = _tell(asked, vocabulary.select("word", "ctx", p.alias("p")), homes, buckets)
        pairs = passing.store(_reseat_pairs(
            pairs.where("kind = 0"), answers, buckets, sweep, sweep >= burn, discount, concentration))
        if old:
            old.drop()
        release(spark)
        vocabulary = vocabulary.drop("ctx")
    kept = lasting.store(_with_tables(pairs.where("kind = 0"), samples))
    tallied_once.drop()
    if passing:
        passing.drop()
    joined = extra = answers = asked = told = pairs = None
    release(spark)
    vocabulary = vocabulary.select(
        "word", "c", F.array(*[c for c in states if c[0] == "p"]).alias("p"), F.array(*[c for c in states if c[0] == "t"]).alias("t")
    ).unionAll(counts.where(single).select(
        "word", "c", F.array(*[F.lit(x) for x in p_single]), F.array(*[F.lit(1).cast("long") for _ in p_single])))
    return Model(vocabulary, kept, discount, unknown, tokens, kinds, texts, concentration)


def _reseat_root(joined: DataFrame, states: list[str], sweep: int, total: int, kinds: int, discount: float, concentration: float):
    """The parent's customers as its children's tables stand (dish), and its own tables drawn anew."""
    kept = "".join(f", {c} {'double' if c[0] == 'p' else 'long'}" for c in states)

    def run(batches):
        for batch in _large(batches):
            n = batch.num_rows
            word, heads, follows, h, f, tables = (
                rows.ids_of(batch.column(c).fill_null(0)) for c in ("word", "heads", "follows", "h", "f", "tables"))
            dish = follows + f
            owner, at = read_openings(batch.column("opened"))
            live = at < dish[owner]
            owner, at = owner[live], at[live]
            some = np.flatnonzero(dish > 1)
            line = np.full(n, -1)
            line[some] = np.arange(len(some))
            held = line[owner] >= 0
            tables = np.where(tables > 0, tables, np.minimum(dish, 1))
            owner, at = reseat(
                dish[some], np.full(len(some), 1 / (kinds + 1)), np.maximum(total - tables[some], 0), line[owner[held]], at[held],
                discount, concentration, _seeds(word.view(np.uint64)[some], sweep), not sweep)
            opened = np.bincount(some[owner], minlength=n) if len(some) else np.zeros(n, np.int64)
            yield rows.batch(
                word=word, c=batch.column("c"), heads=heads, follows=follows,
                opened=write_openings(some[owner] if len(some) else owner, at, n),
                tables=np.minimum(dish, 1) + opened, dish=dish, ctx=heads + h,
                **{c: batch.column(c) for c in states})

    return joined.mapInArrow(run, f"{_VOCABULARY}, ctx long{kept}")


def _tell(asked: DataFrame, vocabulary: DataFrame, homes: int, buckets: int) -> DataFrame:
    """To each bucket of pairs, ctx and p of its words, one answer from each bucket of words, in order."""
    home = F.shiftright(F.shiftrightunsigned("word", 32) * F.lit(homes).cast("long"), 32)      # as bucket_of
    known = vocabulary.select(
        home.alias("bucket"), F.lit(-1).cast("long").alias("other"), "word", "ctx", "p", F.lit(None).cast("binary").alias("blob"))
    asks = asked.select(
        "bucket", "other", "word", F.lit(0).cast("long").alias("ctx"), F.lit(0.0).alias("p"), "blob")

    def run(batches):
        for bucket, group in rows.by_group(batches, "bucket"):
            other = group.column("other").to_numpy()
            mine, others = group.filter(pa.array(other < 0)), group.filter(pa.array(other >= 0))
            word = mine.column("word").to_numpy().view(np.uint64)
            order = np.argsort(word)
            word, ctx, p = word[order], mine.column("ctx").to_numpy()[order], mine.column("p").to_numpy()[order]
            for to, blob in zip(others.column("other").to_pylist(), others.column("blob").to_pylist()):
                spot = np.searchsorted(word, of_steps(unpack(blob)[0]))
                yield rows.batch(bucket=[to], other=[bucket], blob=pa.array([pack(small(ctx[spot]), p[spot])], pa.binary()))

    return known.unionAll(asks).repartition(_partitions(asked.sparkSession, buckets), "bucket").sortWithinPartitions(
        "bucket").mapInArrow(run, "bucket long, other long, blob binary")


def _reseat_pairs(pairs: DataFrame, answers: DataFrame, buckets: int, sweep: int, counts: bool, discount: float, concentration: float):
    """Kind 0: the pairs of a bucket seated anew; kind 1: the tables that a word's pairs have beyond one each,
    as head (h) and as word that follows (f), in parts.  ``counts``: keep the tables there were."""
    def run(batches):
        for bucket, group in rows.by_group(batches, "bucket"):
            state, *told = group.column("blob").to_pylist()
            told = [unpack(x) for x in told]
            now = Seated.unpacked(state)
            if not len(now.c):
                continue
            ctx, p = (np.concatenate([x[k] for x in told]) for k in (0, 1))
            tables = now.tables()
            if counts:
                now.states.append(tables)
            now.reseat(p[now.word], ctx[now.head].astype(np.int64) - tables, sweep, discount, concentration)
            more = now.tables() - 1
            h, f = now.by_head(more), now.by_word(more)
            some = np.flatnonzero(h + f)
            yield _shaped(0, bucket=[bucket], blob=[now.packed()])
            yield _shaped(1, word=signed(now.known)[some], h=h[some], f=f[some])

    columns = ["bucket", "other", "blob"]
    return pairs.select(columns).unionAll(answers.select(columns)).repartition(
        _partitions(pairs.sparkSession, buckets), "bucket").sortWithinPartitions("bucket", "other").mapInArrow(run, _SHAPE)


def _with_tables(pairs: DataFrame, samples: int) -> DataFrame:
    """Pairs with more than one table in a state: word, following, t."""
    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                now = Seated.unpacked(blob)
                t = np.stack([*now.states, now.tables()][:samples], 1)
                some = np.flatnonzero((t > 1).any(axis=1))
                lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * samples, pa.array(t[some].ravel(), pa.int64()))
                yield rows.batch(word=signed(now.known)[now.head[some]], following=signed(now.known)[now.word[some]], t=lists)

    return pairs.select("blob").mapInArrow(run, "word long, following long, t array<long>")


# --- scoring ---------------------------------------------------------------------------------------


def _name(unit: pa.RecordBatch, columns: list[str]) -> int:
    """A checksum of the unit, by which both scans of the texts know it."""
    digest = hashlib.blake2b(digest_size=8)
    for c in columns:
        data, offsets = rows.text_bytes(unit.column(c).cast(pa.string()))
        digest.update(offsets.tobytes())
        digest.update(data.tobytes())
        digest.update(str(unit.column(c).null_count).encode())
    return int.from_bytes(digest.digest(), "little", signed=True)


def _ask(unit: pa.RecordBatch, text: str, train: str, columns: list[str], buckets: int) -> pa.RecordBatch:
    """A unit's words, and its pairs with their counts in training text, in order."""
    whole = Text(unit, text)
    known, _ = tallied(np.append(whole.token, START))     # a word is before another or the start is
    learned = unit.column(train).to_numpy(zero_copy_only=False).astype(bool)[whole.line]
    every = words.chain(whole.before, whole.token)
    keys, n = tallied(every)
    others, m = tallied(every[~learned])
    n[np.searchsorted(keys, others)] -= m
    home, place = bucket_of(known, buckets), bucket_of(keys, buckets)
    out = {b: [w, np.zeros(0, np.uint64), np.zeros(0, np.int64)] for b, (w,) in _slices(home, known)}
    for b, (k, m) in _slices(place, keys, n):
        out[b] = [out[b][0] if b in out else np.zeros(0, np.uint64), k, m]
    return rows.batch(
        bucket=list(out), kind=[2] * len(out), unit=[_name(unit, columns)] * len(out),
        blob=pa.array([pack(steps_of(w), steps_of(k), small(m)) for w, k, m in out.values()], pa.binary()))


def _packed(kind: int, buckets: int):
    """Rows of the model as blobs by bucket: kind 0 words, kind 1 pairs."""
    def run(batches):
        for batch in _large(batches):
            lists = [c for c in ("p", "t") if c in batch.schema.names]
            values = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in lists]
            word = rows.ids_of(batch.column("word")).view(np.uint64)
            if kind == 0:
                columns = [word, rows.ids_of(batch.column("c")), *values]
            else:
                columns = [words.chain(word, rows.ids_of(batch.column("following")).view(np.uint64)), *values]
            order = np.argsort(columns[0])
            columns = [x[order] for x in columns]
            out = [(b, pack(steps_of(x[0]), *[y if y.dtype == float else small(y) for y in x[1:]]))
                   for b, x in _slices(bucket_of(columns[0], buckets), *columns)]
            yield rows.batch(bucket=[b for b, _ in out], kind=[kind] * len(out), unit=[0] * len(out),
                             blob=pa.array([x for _, x in out], pa.binary()))
    return run


def _answers(batches: Iterator[pa.RecordBatch], states: int) -> Iterator[pa.RecordBatch]:
    """For every unit: count, p and t of its words, count and tables of its pairs."""
    for bucket, group in rows.by_group(batches, "bucket"):
        kinds = group.column("kind").to_pylist()
        told: dict[int, list] = {0: [], 1: [], 2: []}
        for kind, blob in zip(kinds, group.column("blob").to_pylist()):
            first, *others = unpack(blob)
            if kind == 2:
                others[0] = of_steps(others[0])
            told[kind].append((of_steps(first), *others))
        none = np.zeros((0, states))
        empty = np.zeros(0, np.uint64)
        word, c = (np.concatenate([x[k] for x in told[0]] or [empty]) for k in (0, 1))
        p, t = (np.concatenate([x[k] for x in told[0]] or [none]) for k in (2, 3))
        order = np.append(np.argsort(word), len(word))
        word = word[order[:-1]]
        c, p, t = np.append(c, 0)[order], np.vstack([p, np.zeros((1, states))])[order], np.vstack([t, np.zeros((1, states))])[order]
        keys, _, inverse = distinct(np.concatenate([x[1] for x in told[2]] or [empty]))
        count = np.bincount(inverse, np.concatenate([x[2] for x in told[2]] or [empty]), len(keys)).astype(np.int64)
        tables = np.repeat(np.minimum(count, 1)[:, None], states, 1)
        for key, seen in told[1]:
            spot = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            held = keys[spot] == key if len(keys) else np.zeros(len(key), bool)
            tables[spot[held]] = seen[held]
        # few values of p differ: they are sent as numbers of the values that a unit's words have
        coded = [distinct(p[:, s]) for s in range(states)]
        names = [u for u, kind in zip(group.column("unit").to_pylist(), kinds) if kind == 2]
        a = 0
        for unit, (asked, pairs, _) in zip(names, told[2]):
            spot = np.searchsorted(word, asked)
            spot = np.where(np.append(word, [0])[spot] == asked, spot, len(word)) if len(word) else np.zeros(len(asked), np.int64)
            mine = inverse[a:a + len(pairs)]
            a += len(pairs)
            told_p = []
            for values, _, number in coded:
                used, which = np.unique(number[spot], return_inverse=True)
                told_p += [values[used], small(which)]
            blob = pack(small(c[spot]), told_p, small(t[spot]), small(count[mine]), small(tables[mine]))
            yield rows.batch(unit=[unit], kind=[1], bucket=[bucket], blob=pa.array([blob], pa.binary()))


def _marked(group: pa.Table, model: dict, doc_id: str, text: str, train: str) -> Iterator[pa.RecordBatch]:
    """The scores of a unit from its texts and the buckets' answers."""
    told, units = {}, []
    for kind, bucket, blob in zip(*(group.column(c).to_pylist() for c in ("kind", "bucket", "blob"))):
        if kind:
            told[bucket] = unpack(blob)
        else:
            units.append(pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0])
    theta, d, states = model["concentration"], model["discount"], len(model["unknown"])
    for unit in units:
        whole = Text(unit, text)
        known, number = whole.numbered()
        inverse, number = pd.factorize(number)
        head, word = number // len(known), number % len(known)
        keys = words.chain(known[head], known[word])
        ranked = np.argsort(keys)
        home, place = (bucket_of(x, model["buckets"]) for x in (known, keys[ranked]))
        c, p, t = np.zeros(len(known), np.int64), np.zeros((len(known), states)), np.zeros((len(known), states))
        for b, (mine,) in _slices(home, np.arange(len(known))):
            c[mine], coded, t[mine] = told[b][:3]
            for s in range(states):
                p[mine, s] = coded[2 * s][coded[2 * s + 1]]
        count, tables = np.zeros(len(keys), np.int64), np.zeros((len(keys), states))
        for b, (mine,) in _slices(place, ranked):
            count[mine], tables[mine] = told[b][3:]
        customers = np.where(known[head] == START, model["texts"], c[head])
        above = np.where((c[word] > 0)[:, None], p[word], model["unknown"])
        own = np.maximum(count[:, None] - d * tables, 0) * (count > 0)[:, None]
        likely = ((own + (theta + d * t[head]) * above) / (theta + customers)[:, None]).mean(axis=1)
        plain = np.log10((c[word] + 0.1) / (model["tokens"] + 0.1 * (model["kinds"] + 1)))
        first = np.cumsum(whole.sizes) - whole.sizes
        yield rows.batch(**{doc_id: unit.column(doc_id)}, held_out=pa.array(~unit.column(train).to_numpy(zero_copy_only=False).astype(bool)),
                         n_tokens=whole.sizes, n_known=np.add.reduceat((c[word] > 0)[inverse].astype(np.int64), first),
                         train_tokens=np.full(len(first), model["tokens"]),
                         base_score=np.add.reduceat(plain[inverse], first), score=np.add.reduceat(np.log10(likely)[inverse], first))


def score(df: DataFrame, model: Model, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; ``train`` must
    hold for the rows the model was learned from, as pairs are counted once more."""
    spark = df.sparkSession
    given = df.select(doc_id, text, train.alias("__train"))
    buckets = _buckets(df, text)
    columns, states = [doc_id, text], len(model.unknown)
    shape = "bucket long, kind long, unit long, blob binary"
    asked = rows.map_units(given, text, lambda unit: _ask(unit, text, "__train", columns, buckets), shape, UNIT_BYTES)
    everything = asked.unionAll(model.vocabulary.mapInArrow(_packed(0, buckets), shape)).unionAll(
        model.pairs.mapInArrow(_packed(1, buckets), shape))
    dealt = everything.repartition(_partitions(spark, buckets), "bucket").sortWithinPartitions("bucket")
    answers = dealt.mapInArrow(lambda b: _answers(b, states), "unit long, kind long, bucket long, blob binary")

    def keep(unit):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, unit.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(unit)
        return rows.batch(unit=[_name(unit, columns)], kind=[0], bucket=[0], blob=pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    texts = rows.map_units(given, text, keep, "unit long, kind long, bucket long, blob binary", UNIT_BYTES)
    shared = {"concentration": model.concentration, "discount": model.discount, "unknown": model.unknown,
              "buckets": buckets, "texts": model.texts, "tokens": model.tokens, "kinds": model.kinds}

    def mark(batches):
        for _, group in rows.by_group(batches, "unit"):
            yield from _marked(group, shared, doc_id, text, "__train")

    kind = df.schema[doc_id].dataType.simpleString()
    return answers.unionAll(texts).repartition(_partitions(spark, buckets), "unit").sortWithinPartitions("unit").mapInArrow(
        mark, f"`{doc_id}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    checksum = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(checksum % 10 == 0, F.lit(False))


def perplexity(scored: DataFrame) -> DataFrame:
    """By held_out: perplexity per token of the model and of the plain counts."""
    tokens = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(
        tokens.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"))
