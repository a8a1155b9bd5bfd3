"""Quality rules whose failures are weighed by host.

Each text is measured and held against five rules: words, word length, symbols, repeated lines and
repeated words.  Texts that break any are summed by host (one row per host leaves each task), a beta
prior is fitted to the rates of all hosts by their moments, every host's rate is shrunk towards it,
and the hosts' verdicts are joined back.  The limit comes from the prior: a host is rejected if its
shrunk rate lies more than ``DEVIATIONS`` of the prior's standard deviations above the prior's mean
and most of its texts fail; ``MAX_HOST_RATE`` is the highest limit.

NULL text: measured as empty, so it fails on its length.  NULL host: a host of its own, as is
each distinct value.  Repeated rows count each.  A text of any length is measured whole.  Columns
other than those asked for are not read, so their names cannot clash.  Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from importflow.llm import rows, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MIN_WORDS = 50              # fewer words fail
MAX_REPEAT_PERCENT = 50     # a larger share of words in repeated 3-word windows fails
MAX_SYMBOL_PERCENT = 10     # more symbols to a word
MAX_DUP_LINE_PERCENT = 30   # of the lines with a word
WORD_CHARS = (3, 10)        # code points to a word
DEVIATIONS = 2              # of the prior, above its mean
MIN_HOST_RATE = 0.5         # no host is rejected whose shrunk rate is lower
MAX_HOST_RATE = 0.8         # every host is whose shrunk rate is higher

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def lines_of(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the words that lie in a 3-word window which the text has twice or more."""
    covered = np.zeros(len(hashes), bool)
    at = np.flatnonzero(words.whole_windows(first, 3))
    if len(at):
        text = words.owner(first)[at].astype(np.uint64)
        keys = words.windows(hashes, 3)[at] ^ words.mix(text)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return words.per_text(covered, first)


def measure(unit: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    data, offsets = rows.text_bytes(unit.column(text))
    starts, ends, first = words.word_spans(data, offsets)
    visible = ~words.IS_SPACE[data] & ((data & 0xC0) != 0x80)
    lines = np.array([lines_of(t) for t in rows.texts_of(data, offsets)], np.int64).reshape(-1, 2)
    return {
        "n_words": np.diff(first),
        "word_chars": words.per_text(visible, offsets),
        "n_symbols": words.per_text(SYMBOLS[data], offsets),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeated_words(words.span_hashes(data, starts, ends), first),
        "n_lines": lines[:, 0],
    }


def with_measures(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and its measures."""
    kept = df.select(*keep, text).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name in keep)

    def work(unit):
        return rows.batch(**{c: unit.column(c) for c in keep}, **measure(unit, text))

    return rows.map_units(df.select(*dict.fromkeys([*keep, text])), text, work, f"{out}, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def rules_failed() -> Column:
    """How many of the five rules a text breaks."""
    shortest, longest = WORD_CHARS
    rules = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        ~F.col("word_chars").between(shortest * F.col("n_words"), longest * F.col("n_words")),
    ]
    return sum((rule.cast("long") for rule in rules[1:]), rules[0].cast("long"))


def host_verdicts(measured: DataFrame, host: str, failed: Column) -> DataFrame:
    """One row per host: host, n_docs, n_failed, shrunk_rate, host_limit, host_ok.

    The prior Beta(a, b) has the mean m of the hosts' rates weighted by rows and the variance v
    that is left of theirs after what chance alone would give; a + b = m (1 - m) / v - 1, held
    between 1 and 1e6 (all hosts alike: v is 0 or less, and every rate is shrunk to the mean).
    """
    hosts = measured.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")
    )
    totals = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("h"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q"),
    )
    mean = F.col("f") / F.col("n")
    chance = mean * (1 - mean)
    # sum of n_i (r_i - m)^2 over the hosts, less its expectation when all hosts share one rate
    left = (F.col("q") - F.col("f") * mean - chance * (F.col("h") - 1)) / F.col("n")
    weight = F.when(left > 0, F.least(F.greatest(chance / left - 1, F.lit(1.0)), F.lit(1e6))).otherwise(1e6)
    prior = totals.select(mean.alias("__mean"), weight.alias("__weight"), chance.alias("__chance"))
    rate = (F.col("n_failed") + F.col("__mean") * F.col("__weight")) / (F.col("n_docs") + F.col("__weight"))
    high = F.col("__mean") + DEVIATIONS * F.sqrt(F.col("__chance") / (F.col("__weight") + 1))
    limit = F.greatest(F.lit(MIN_HOST_RATE), F.least(F.lit(MAX_HOST_RATE), high))
    # the prior is one row
    return hosts.join(F.broadcast(prior)).select(
        host, "n_docs", "n_failed", rate.alias("shrunk_rate"), limit.alias("host_limit"),
        (rate <= limit).alias("host_ok"),
    )


def judge(measured: DataFrame, host: str) -> DataFrame:
    """The measured rows with base_failed, kept and rules_failed."""
    measured = measured.withColumn("base_failed", base_failed()).withColumn("__broken", rules_failed())
    verdicts = host_verdicts(measured, host, F.col("__broken") > 0).select(F.col(host).alias("__host"), "host_ok")
    joined = measured.join(verdicts, F.col(host).eqNullSafe(F.col("__host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).withColumn(
        "rules_failed", F.col("__broken")
    ).drop("__host", "host_ok", "__broken")
