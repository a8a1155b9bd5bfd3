"""Periodic runs of words: stretches that repeat themselves with a shortest period.

Recursive frequency splitting: a run holds its period at least twice, so every word of it occurs at
least twice in any segment around it.  A text starts as one segment; words that occur too rarely
within their segment are cut out, which splits it, and the parts are counted anew until nothing
changes or a part is too short for a run.  Most of a text is gone after a few rounds.  The segments
that survive are lag-scanned: a run of period p and length l matches itself p words on over l - p
words, so of every ``max(min_length - p, p)`` places one is looked at, and a match there is extended
both ways by bisection over prefix hashes.  That is n log n looks for a segment of n words and all
its lags.  What is found is held against the words once more; a collision of prefix hashes repeats
the scan with another base.  Words are told apart by 64-bit hashes.

Rounds over all segments of a unit come first; a segment that goes on losing a word a round is
finished by itself, counting the smaller part of each split only.

NULL or empty text: no words, no runs, an empty text.  Very long texts are one unit of their own and
take memory in proportion to their length.  Repeated rows each get their result.  Columns named like
the two results give way to them.  Empty table: empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from importflow.llm import rows, words

MIN_LENGTH = 12     # words of the shortest run
RARE = 2            # a run of any period has each of its words this often at least
ROUNDS = 12         # over all segments together, before slow ones are finished alone
LOOKS = 1 << 20     # places looked at together
BASES = ((1_000_003, 48_271), (16_807, 69_621), (39_373, 630_360_016))
_MOD = np.uint64((1 << 31) - 1)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def peel(codes: list[int], min_length: int) -> list[tuple[int, int]]:
    """Bounds of the stable segments of one segment; counts only the smaller part of each split."""
    places: dict[int, list[int]] = {}
    for i, code in enumerate(codes):
        places.setdefault(code, []).append(i)
    counts = Counter(codes)
    work = [(0, len(codes), counts, [c for c, n in counts.items() if n < RARE])]
    done = []
    while work:
        low, high, counts, rare = work.pop()
        while rare and high - low >= min_length:
            code = rare.pop()
            if not 0 < counts.get(code, 0) < RARE:
                continue
            at = places[code][bisect_left(places[code], low)]
            del counts[code]
            small = (low, at) if at - low < high - at - 1 else (at + 1, high)
            part = Counter(codes[small[0]:small[1]])
            for c, n in part.items():
                left = counts[c] - n
                if left:
                    counts[c] = left
                else:
                    del counts[c]
                if 0 < left < RARE:
                    rare.append(c)
            work.append((*small, part, [c for c, n in part.items() if n < RARE]))
            low, high = (at + 1, high) if small[0] == low else (low, at)
        if high - low >= min_length:
            done.append((low, high))
    return done


def segments(codes: np.ndarray, first: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the segments of all texts in which every word occurs often enough."""
    kinds = int(codes.max()) + 1 if len(codes) else 1
    place, part = np.arange(len(codes)), words.owner(first)
    begins, ends = [], []

    def close(place, part):
        if len(place):
            cut = np.flatnonzero(part[1:] != part[:-1]) + 1
            begins.append(place[np.concatenate([[0], cut])])
            ends.append(place[np.concatenate([cut - 1, [len(place) - 1]])] + 1)

    for _ in range(ROUNDS):
        if not len(place):
            break
        key = part * kinds + codes[place]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
        rare = np.zeros(len(place), bool)
        rare[order] = np.repeat(np.diff(edge) < RARE, np.diff(edge))
        changed = np.zeros(int(part[-1]) + 1, bool)
        changed[part[rare]] = True
        settled = ~changed[part]
        close(place[settled], part[settled])
        left = ~settled & ~rare
        place, part = place[left], part[left]
        if len(place):
            cut = np.concatenate([[False], (place[1:] != place[:-1] + 1) | (part[1:] != part[:-1])])
            part = np.cumsum(cut)
            long = np.bincount(part)[part] >= min_length
            place, part = place[long], part[long]
            part = np.cumsum(np.concatenate([[False], part[1:] != part[:-1]])) if len(part) else part
    if len(place):
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(place)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            found = peel(codes[place[a]:place[a] + b - a].tolist(), min_length)
            begins += [np.array([place[a] + x for x, _ in found], np.int64)]
            ends += [np.array([place[a] + y for _, y in found], np.int64)]
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    keep = end - begin >= min_length
    order = np.argsort(begin[keep])
    return begin[keep][order], end[keep][order]


class Prefixes:
    """Hashes of all prefixes of a row of codes, to compare stretches of any length."""

    def __init__(self, codes: np.ndarray, bases: tuple[int, int]):
        self.powers, self.sums = [], []
        values = codes.astype(np.uint64) + np.uint64(1)
        for base in bases:
            power = np.ones(len(codes) + 1, np.uint64)
            size = 1
            while size <= len(codes):
                step = power[size - 1] * np.uint64(base) % _MOD
                power[size:2 * size] = power[:min(size, len(power) - size)] * step % _MOD
                size *= 2
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(values % _MOD * power[:-1] % _MOD, out=total[1:])
            self.powers.append(power)
            self.sums.append(total % _MOD)

    def equal(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` codes from ``at`` equal those ``lag`` further on."""
        same = np.ones(len(at), bool)
        for power, total in zip(self.powers, self.sums):
            here = (total[at + size] + _MOD - total[at]) % _MOD
            there = (total[at + lag + size] + _MOD - total[at + lag]) % _MOD
            same &= here * power[lag] % _MOD == there
        return same

    def reach(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many codes from ``at`` on (or before it) equal those ``lag`` further on, up to ``most``."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            half = (low[open_] + high[open_] + 1) // 2
            same = self.equal(at[open_] - (half if back else 0), lag[open_], half)
            low[open_] = np.where(same, half, low[open_])
            high[open_] = np.where(same, high[open_], half - 1)


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the groups of the given sizes."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def lag_scan(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int, bases) -> tuple[np.ndarray, ...]:
    """start, length and period of all runs in the segments."""
    prefixes = Prefixes(codes, bases)
    found = []
    lags = (end - begin) // 2
    part, lag = np.repeat(np.arange(len(begin)), lags), _steps(lags) + 1
    stride = np.maximum(min_length - lag, lag)
    looks = (end[part] - begin[part] - lag - 1) // stride + 1
    upto = np.cumsum(looks)
    a = 0
    while a < len(part):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LOOKS, "right")))
        p, n = lag[a:b], looks[a:b]
        low, high = np.repeat(begin[part[a:b]], n), np.repeat(end[part[a:b]], n)
        step, least = np.repeat(p, n), np.repeat(stride[a:b], n)
        at = low + _steps(n) * least
        hit = codes[at] == codes[at + step]
        at, step, least, low, high = at[hit], step[hit], least[hit], low[hit], high[hit]
        after = prefixes.reach(at, step, high - step - at, False)
        before = prefixes.reach(at, step, at - low, True)
        long = after + before >= least
        start, length = (at - before)[long], (after + before + step)[long]
        found.append(_shortest(start, length, step[long]))
        a = b
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return _shortest(*(np.concatenate([f[k] for f in found]) for k in range(3)))


def _shortest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per stretch, with its shortest period, by start and period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    once = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[:len(start)]
    start, length, period = start[once], length[once], period[once]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _holds(codes: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether each stretch has its period word by word; one at a time, so memory stays that of the longest."""
    return all(
        np.array_equal(codes[s:s + n - p], codes[s + p:s + n])
        for s, n, p in zip(start.tolist(), length.tolist(), period.tolist())
    )


def find(hashes: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """start (among all words), length and period of the runs of all texts, by start and period."""
    codes = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    begin, end = segments(codes, first, min_length)
    size = end - begin
    # the segments laid end to end; bounds keep every comparison within one
    inner = codes[np.repeat(begin, size) + _steps(size)]
    last = np.cumsum(size)
    for bases in BASES:
        start, length, period = lag_scan(inner, last - size, last, min_length, bases)
        if _holds(inner, start, length, period):
            moved = np.searchsorted(last, start, "right")
            return start + begin[moved] - (last - size)[moved] if len(start) else start, length, period
    raise RuntimeError("prefix hashes collide for all bases")


def scan(unit: pa.RecordBatch, text: str, min_length: int) -> tuple[pa.Array, pa.Array]:
    """The runs of every text of a unit, and its words without the repeats."""
    data, offsets = rows.text_bytes(unit.column(text))
    starts, ends, first = words.word_spans(data, offsets)
    start, length, period = find(words.span_hashes(data, starts, ends), first, min_length)
    line = np.searchsorted(first, start, "right") - 1
    turns = np.zeros(len(starts) + 1, np.int64)
    np.add.at(turns, start + period, 1)
    np.add.at(turns, start + length, -1)
    gone = np.cumsum(turns[:-1]) > 0
    held = set(line.tolist())
    whole = []
    for i, content in enumerate(rows.texts_of(data, offsets)):
        found = content.split()
        if i in held:
            found = [found[k] for k in np.flatnonzero(~gone[first[i]:first[i + 1]]).tolist()]
        whole.append(b" ".join(found))
    fields = [start - first[line], length, period]
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(line, np.arange(len(first))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"]),
    )
    return runs, pa.array(whole, pa.binary()).cast(pa.string())


def with_runs(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH,
    runs: str = "runs", collapsed: str = "collapsed",
) -> DataFrame:
    """The columns ``keep`` (by default all) with the runs of each text, by start, then period, and
    its words joined by a space without those that only repeat: of a run all after its first period."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in (runs, collapsed)]
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema)

    def work(unit):
        return rows.batch(**{c: unit.column(c) for c in kept}, **dict(zip((runs, collapsed), scan(unit, text, min_length))))

    return rows.map_units(
        df.select(*dict.fromkeys([*kept, text])), text, work, f"{out}`{runs}` {RUNS}, `{collapsed}` string"
    )


def rewritten(doc_id: str, text: str) -> Column:
    """The text with its end made periodic where the id's checksum says so: h = crc32(id), g = h div 10;
    if h is a multiple of 10, word i >= a is word a + (i - a) mod p, a = g mod n,
    p = 1 + (n - a) div (3 + g mod 8).  Without an id or without words the text stays as it is."""
    checksum = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(checksum / 10)
    found = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def turn(w):
        a = F.pmod(g, F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + F.pmod(i - a, p))))

    # a list of one list, so that the words are taken out of the text once
    lists = F.filter(F.array(found), lambda w: F.size(w) > 0)
    periodic = F.array_join(F.get(F.transform(lists, turn), F.lit(0)), " ")
    return F.when((F.pmod(checksum, F.lit(10)) == 0) & F.col(text).isNotNull(), F.coalesce(periodic, F.col(text))).otherwise(F.col(text))


def summary(found: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Digest columns in place of the runs and the collapsed text: n_runs, the longest run (ties: the
    smallest start, then period) with its exponent, and checksums of all runs and of the text."""
    largest = F.aggregate(
        runs, F.get(F.col(runs), F.lit(0)),
        lambda best, x: F.when(x["length"] > best["length"], x).otherwise(best),   # they come by start and period
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    given = found.withColumn("__best", largest)
    best = F.col("__best")
    return given.select(
        *[c for c in found.columns if c not in (runs, collapsed)],
        F.size(runs).cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(collapsed).cast("binary"), 256).alias("collapsed_sha256"),
    )
