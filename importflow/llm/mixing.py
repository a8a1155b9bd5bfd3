"""Mixing documents to target weights by iterative proportional fitting.

Token sums by source, language and topic are raked until they meet the target share of every
source, language and topic at once; a document's weight is the product of the three factors.  It
is sampled with a probability that is such a product too, 1 at most, raked with that bound inside:
cells at probability 1 stay there and the others are raked to what is left of each margin, until the
expected tokens meet the budget and the target shares.  A source, language or topic whose target
is more than it has is taken whole, and the others share the rest of the budget in proportion to
their targets.  Targets bent that way, and margins that stay off, are logged as a warning and
stand in ``Weights.allowed`` and ``Weights.off``.

Sources may be many: their sums lie in a table with a row for each, and each round is one pass
over it that returns a sum for each language and topic.  Languages times topics must be few
(``MOST_CELLS``; more are refused).

Topic, unless the rows have one: the cell of the hashed bag of the text's longer words among
``2 ** TOPIC_BITS`` cells cut by random planes.  NULL text: no tokens, topic 0.  NULL source or
language: counted as the empty string.  A source without tokens: factor 1.  Whether a document is
drawn hangs on its id and text alone, so repeated rows share their lot.  Empty table: empty result.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from importflow.llm import rows, words
from importflow.session import store

TOPIC_BITS = 3
TOPIC_WORD = 6          # bytes of a word that counts for the topic
MOST_CELLS = 100_000
ROUNDS = 30
DRAW_ROUNDS = 200       # of the bounded raking, which are more where it has little room
STALLED = 10            # rounds without a lower error after which it ends: the margins exclude each other
CLOSE = 1e-6            # relative error of every margin at which the rounds end
OFF = 1e-3              # relative error of a drawn margin from which on it is reported
FLATTEN = 0.7           # shares without a target: observed share to this power
KEEP = 0.5              # expected share of the tokens that is kept
SEED = 17
_WHOLE = 1e12           # factor of a group that is taken whole

log = logging.getLogger(__name__)


def measure(unit: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    data, offsets = rows.text_bytes(unit.column(text))
    starts, ends, first = words.word_spans(data, offsets)
    long = ends - starts >= TOPIC_WORD
    hashes, total = words.span_hashes(data, starts, ends), words.per_text(long, first)
    topic = np.zeros(len(total), np.int64)
    for bit in range(TOPIC_BITS):
        ones = words.per_text(long & ((hashes >> np.uint64(7 + 11 * bit) & np.uint64(1)) == 1), first)
        topic = topic * 2 + (2 * ones > total)
    return {"__mix_topic": topic, "__mix_tokens": np.diff(first)}


def with_topics(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with __mix_topic and __mix_tokens (words)."""
    keep = [c for c in df.columns if keep_text or c != text]
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)

    def work(unit):
        return rows.batch(**{c: unit.column(c) for c in keep}, **measure(unit, text))

    return rows.map_units(df, text, work, f"{shown}, __mix_topic long, __mix_tokens long")


def draw(doc_id: str, text: str, seed: int = SEED) -> Column:
    """A number from 0 to 1 for each row, from its id and text."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 53)) / float(1 << 53)


def _flattened(sums: dict, targets: dict | None) -> dict:
    """Target shares: as given (others share nothing), else the observed flattened."""
    wanted = {k: targets.get(k, 0.0) for k in sums} if targets else {k: v**FLATTEN for k, v in sums.items()}
    total = sum(wanted.values())
    return {k: v / total if total else 1 / len(wanted) for k, v in wanted.items()}


class Weights:
    """Factors of languages and topics, of weight and of probability, and a table of the sources'.

    ``error``: largest relative error of the weights' margins; ``off``: that of the expected tokens'
    margins; ``allowed``: the largest budget, as a share, at which no target is more than there is.
    """

    def __init__(self, sources: DataFrame, langs: dict, topics: dict, drawn_langs: dict, drawn_topics: dict, keep: float,
                 error: float, off: float, allowed: float):
        self.sources, self.langs, self.topics, self.keep = sources, langs, topics, keep
        self.drawn_langs, self.drawn_topics = drawn_langs, drawn_topics
        self.error, self.off, self.allowed = error, off, allowed

    def apply(self, df: DataFrame, source: str, lang: str, topic: str) -> DataFrame:
        """The rows with __mix_weight and __mix_probability."""
        def pick(column, factors):
            if not factors:
                return F.lit(1.0)
            pairs = [x for k, v in factors.items() for x in (F.lit(k), F.lit(float(v)))]
            return F.coalesce(F.create_map(*pairs)[column], F.lit(0.0))

        def product(factor, otherwise, langs, topics):
            small = pick(F.coalesce(F.col(lang), F.lit("")), langs) * pick(F.col(topic), topics)
            return F.coalesce(F.col(factor), F.lit(otherwise)) * small

        joined = df.join(self.sources, F.coalesce(F.col(source), F.lit("")) == F.col("__source"), "left")
        return joined.withColumn("__mix_weight", product("__factor", 1.0, self.langs, self.topics)).withColumn(
            "__mix_probability",
            F.least(F.lit(1.0), product("__drawn", float(self.keep), self.drawn_langs, self.drawn_topics)),
        ).drop("__source", "__factor", "__drawn")


def rake(
    df: DataFrame, source: str, lang: str, topic: str, tokens: str, keep: float = KEEP,
    source_targets: DataFrame | None = None, lang_targets: dict | None = None, topic_targets: dict | None = None,
) -> Weights:
    """Fit weights to the margins.  ``source_targets`` has __source and share; default: flattened."""
    cells = df.groupBy(
        F.coalesce(F.col(source), F.lit("")).alias("__source"), F.coalesce(F.col(lang), F.lit("")).alias("__lang"),
        F.col(topic).alias("__mix_topic"),
    ).agg(F.sum(tokens).cast("double").alias("mass"))
    cells = store(cells, "mix-cells")
    few = cells.groupBy("__lang", "__mix_topic").agg(F.sum("mass").alias("mass")).limit(MOST_CELLS + 1).collect()
    if len(few) > MOST_CELLS:
        raise ValueError("more languages and topics than can be raked")
    total = sum(r["mass"] or 0 for r in few)
    place = {(r["__lang"], r["__mix_topic"]): i for i, r in enumerate(few)}
    if not total:
        none = cells.select("__source", F.lit(1.0).alias("__factor"), F.lit(float(keep)).alias("__drawn")).distinct()
        return Weights(none, {}, {}, {}, {}, keep, 0.0, 0.0, 1.0)
    sums_l, sums_t = {}, {}
    for r in few:
        sums_l[r["__lang"]] = sums_l.get(r["__lang"], 0) + r["mass"]
        sums_t[r["__mix_topic"]] = sums_t.get(r["__mix_topic"], 0) + r["mass"]
    want_l, want_t = _flattened(sums_l, lang_targets), _flattened(sums_t, topic_targets)
    numbers = cells.sparkSession.createDataFrame([(*k, i) for k, i in place.items()], "__lang string, __mix_topic long, k long")
    table = cells.join(numbers, ["__lang", "__mix_topic"]).groupBy("__source").agg(
        F.collect_list("k").alias("k"), F.collect_list("mass").alias("mass"), F.sum("mass").alias("tokens")
    )
    wanted = F.pow("tokens", FLATTEN)
    if source_targets is not None:
        table, wanted = table.join(source_targets, "__source", "left"), F.coalesce("share", F.lit(0.0))
    table = store(table.withColumn("wanted", wanted).select("__source", "k", "mass", "tokens", "wanted"), "mix-sources")
    all_wanted = table.agg(F.sum("wanted")).first()[0]
    if not all_wanted:
        raise ValueError("no source has a target")
    langs, topics = list(sums_l), list(sums_t)
    of_l = np.array([langs.index(l) for l, _ in place])
    of_t = np.array([topics.index(t) for _, t in place])
    goal_l, goal_t = np.array([want_l[x] for x in langs]) * total, np.array([want_t[x] for x in topics]) * total
    b, c = np.ones(len(langs)), np.ones(len(topics))

    def factors(part, small):
        """The cells of a batch of sources, the source of each, and the sources' factors."""
        ks, masses = part.column("k"), part.column("mass")
        own = np.repeat(np.arange(part.num_rows), ks.value_lengths().to_numpy())
        k, mass = ks.flatten().to_numpy(), masses.flatten().to_numpy()
        now = np.bincount(own, mass * small[k], minlength=part.num_rows)
        goal = part.column("wanted").to_numpy() * (total / all_wanted)
        return k, mass, own, np.where(now > 0, goal / np.where(now > 0, now, 1), 1.0)

    def sums_with(small):
        def run(batches):
            found = np.zeros(len(place))
            for part in batches:
                k, mass, own, factor = factors(part, small)
                found += np.bincount(k, mass * factor[own], minlength=len(found))
            yield rows.batch(k=np.arange(len(found)), mass=found)

        passed = table.mapInArrow(run, "k long, mass double").groupBy("k").agg(F.sum("mass")).collect()
        result = np.zeros(len(place))
        for k, mass in passed:
            result[k] = mass
        return result

    error = np.inf
    for _ in range(ROUNDS):
        mass = sums_with(b[of_l] * c[of_t])      # after the sources were met
        now_l = np.bincount(of_l, mass * b[of_l] * c[of_t], minlength=len(b))
        now_t = np.bincount(of_t, mass * b[of_l] * c[of_t], minlength=len(c))
        met = [np.abs(n - g)[g > 0] / g[g > 0] for n, g in ((now_l, goal_l), (now_t, goal_t))]
        error = max(float(m.max()) if len(m) else 0.0 for m in met)
        if error < CLOSE:
            break
        b = b * _ratio(goal_l, now_l)
        c = c * _ratio(goal_t, np.bincount(of_t, mass * b[of_l] * c[of_t], minlength=len(c)))
    small = b[of_l] * c[of_t]

    # what is drawn: targets that the groups can give, raked with probability 1 as the bound
    budget = keep * total
    have = np.array([r["mass"] or 0 for r in few], float)
    have_l, have_t = np.bincount(of_l, have, len(b)), np.bincount(of_t, have, len(c))
    draw_l, draw_t = _given(goal_l, have_l, budget), _given(goal_t, have_t, budget)
    level = _level(lambda at: table.agg(
        F.sum(F.when(F.col("wanted") * at >= F.col("tokens"), F.col("tokens"))),
        F.sum(F.when(F.col("wanted") * at < F.col("tokens"), F.col("wanted"))),
    ).first(), all_wanted, budget)
    least = table.where("wanted > 0").agg(F.min(F.col("tokens") / F.col("wanted"))).first()[0] * all_wanted / total
    allowed = min([least, *((h / g)[g > 0].min() for h, g in ((have_l, goal_l), (have_t, goal_t)))])
    # a group without tokens has nothing to be whole
    whole_l, whole_t = (draw_l >= have_l) & (have_l > 0), (draw_t >= have_t) & (have_t > 0)
    p, q = np.where(whole_l, _WHOLE, b), np.where(whole_t, _WHOLE, c)

    def drawn_factors(part, small):
        """Like ``factors``, where the least of 1 and the product is drawn."""
        k, mass, own, _ = factors(part, small)
        tokens = part.column("tokens").to_numpy()
        goal = np.minimum(tokens, part.column("wanted").to_numpy() * level)
        factor = bounded(mass, small[k], own, goal)
        return k, mass, own, np.where(tokens > 0, np.where(goal >= tokens, _WHOLE, factor), keep)

    def drawn_with(small):
        """Of each language and topic, the tokens at probability 1 and the others that are drawn."""
        def run(batches):
            found = np.zeros((2, len(place)))
            for part in batches:
                k, mass, own, factor = drawn_factors(part, small)
                chance = factor[own] * small[k]
                full = chance >= 1
                found[0] += np.bincount(k, mass * full, minlength=len(place))
                found[1] += np.bincount(k, mass * np.where(full, 0, chance), minlength=len(place))
            yield rows.batch(k=np.arange(len(place)), full=found[0], rest=found[1])

        passed = table.mapInArrow(run, "k long, full double, rest double").groupBy("k").agg(
            F.sum("full"), F.sum("rest")).collect()
        result = np.zeros((2, len(place)))
        for k, full, rest in passed:
            result[:, k] = full, rest
        return result

    off, seen = np.inf, []
    while len(seen) < DRAW_ROUNDS:
        now = drawn_with(p[of_l] * q[of_t])         # after the sources were met
        met = [np.abs(np.bincount(of, now.sum(axis=0), len(g)) - g)[g > 0] / g[g > 0] for of, g in ((of_l, draw_l), (of_t, draw_t))]
        off = max(float(m.max()) if len(m) else 0.0 for m in met)
        seen.append(off)
        if off < CLOSE or len(seen) > STALLED and off > 0.99 * seen[-1 - STALLED]:
            break
        step = np.where(whole_l, 1.0, _step(draw_l, *(np.bincount(of_l, x, len(p)) for x in now)))
        rest = np.minimum(now[1] * step[of_l], have - now[0])
        p, q = p * step, q * np.where(whole_t, 1.0, _step(draw_t, *(np.bincount(of_t, x, len(q)) for x in (now[0], rest))))
    drawn = p[of_l] * q[of_t]
    if allowed < keep:
        log.warning("the mix keeps %.4f of the tokens, its targets allow %.4f: groups below their target are taken whole", keep, allowed)
    if off > OFF:
        log.warning("the margins of the drawn mix are off by %.2g of themselves: no draw meets them together", off)

    def source_factors(batches):
        for part in batches:
            yield rows.batch(
                __source=part.column("__source"), __factor=factors(part, small)[3], __drawn=drawn_factors(part, drawn)[3]
            )

    sources = store(table.mapInArrow(source_factors, "__source string, __factor double, __drawn double"), "mix-factors")
    return Weights(sources, dict(zip(langs, b)), dict(zip(topics, c)), dict(zip(langs, p)), dict(zip(topics, q)), keep,
                   error, off, float(allowed))


def _ratio(goal, now):
    return np.where(now > 0, goal / np.where(now > 0, now, 1), 1.0)


def _step(goal, full, rest):
    """What to multiply factors by, so that ``rest`` fills up what the tokens at probability 1 leave
    of the goal; less than they leave, and all come down in proportion."""
    up = np.where(rest > 0, (goal - full) / np.where(rest > 0, rest, 1), 1.0)
    return np.where(goal < full + rest, np.maximum(up, _ratio(goal, full + rest)), np.maximum(up, 1.0))


def _level(sums, wanted: float, budget: float) -> float:
    """The factor on all targets at which the groups, each at most whole, give the budget.  ``sums``
    tells, at a factor, the tokens of whole groups and the targets of the others."""
    level = budget / wanted
    for _ in range(1000):       # ends when no further group becomes whole
        full, rest = (float(x or 0) for x in sums(level))
        if not rest:
            return level
        higher = (budget - full) / rest
        if higher <= level * (1 + 1e-12):
            return level
        level = higher
    return level


def _given(want: np.ndarray, have: np.ndarray, budget: float) -> np.ndarray:
    """Targets in proportion to ``want``, none more than there is, that sum to the budget if they can."""
    level = _level(lambda at: (have[want * at >= have].sum(), want[want * at < have].sum()), want.sum(), budget)
    return np.minimum(have, want * level)


def bounded(mass: np.ndarray, weight: np.ndarray, own: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Of each group, the factor at which the sum of mass * min(1, factor * weight) meets the goal."""
    full = np.zeros(len(mass), bool)
    factor = np.zeros(len(goal))
    while True:     # cells only ever become full
        left = goal - np.bincount(own, mass * full, minlength=len(goal))
        rest = np.bincount(own, np.where(full, 0, mass * weight), minlength=len(goal))
        factor = np.where(rest > 0, np.maximum(factor, left / np.where(rest > 0, rest, 1)), factor)
        more = ~full & (factor[own] * weight >= 1)
        if not more.any():
            return factor
        full |= more


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
        keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled for every row."""
    drawn = df.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"),
        F.col(text).alias("text"), draw(doc_id, text, seed).alias("__mix_draw"),
    )
    measured = store(with_topics(drawn, "text", keep_text=False), "mix-documents")
    weights = rake(measured, "source", "lang", "__mix_topic", "__mix_tokens", keep)
    return weights.apply(measured, "source", "lang", "__mix_topic").select(
        "doc_id", "source", "lang", F.col("__mix_topic").alias("topic"), F.col("__mix_tokens").alias("n_tokens"),
        F.col("__mix_weight").alias("weight"), F.col("__mix_probability").alias("probability"),
        (F.col("__mix_draw") < F.col("__mix_probability")).alias("sampled"),
    )


def sample(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
           keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` that the mix draws, with their own columns."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    narrow = df.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    weights = rake(with_topics(narrow, "text", keep_text=False), "source", "lang", "__mix_topic", "__mix_tokens", keep)
    whole = with_topics(df.withColumn("__mix_draw", draw(doc_id, text, seed)), text)
    drawn = weights.apply(whole, source, lang, "__mix_topic")
    return drawn.where(F.col("__mix_draw") < F.col("__mix_probability")).select(*columns)
