"""Language identification with unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary that consist of lower-case letters, at a word's
begin or inside it.  Each language gives every piece a probability; the probability of a word is
the sum over all ways to cut it into pieces (a forward algorithm), that of a text the product over
its words, and the score of a language its share of the sum over the languages.

Learning: expectation maximisation over the word counts of a sample, ``max_docs`` documents for
each language (about; all if there are fewer), of the ``max_langs`` most frequent languages.  The
sample is a choice by the hash of the id.  Only (piece, language) sums reach the driver.

Texts in no learned language: a text's log probability a letter is held against what the language's
own sampled documents have.  Their mean, the variance of a word about it and that from document to
document give the least that a text of so many letters may have (``WIDTH`` standard deviations
below).  A model learned with ``usual`` gives texts below it the score 0.

NULL text, or text without a letter: ``und`` with score 0.  NULL language: not learned from.  No
language learned: every text is ``und``.  Empty table: empty result.  A run of more than
``RUN`` letters is taken as several.  Equal texts get equal results.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from importflow.llm import rows
from importflow.session import store

UNKNOWN = "und"
RUN = 32                    # letters of a word that are scored at once
MAX_DOCS = 2000             # documents a language is learned from
MAX_LANGS = 200
ROUNDS = 3                  # of expectation maximisation
SMOOTH = 0.05               # added to the count of every piece
STRANGE = 1e-4              # probability of a letter that is no piece, in every language
WIDTH = 20                  # standard deviations that a text may lie below its language's own
MOST_CACHED = 150_000       # words whose scores a task keeps

_WORDS = re.compile(r"[^\W\d_]{1,%d}" % RUN)
_MARK = "▁"
_TURN = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def pieces(path: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of all beginnings of pieces, the number of the piece each is (or -1), and their count."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    known = {_MARK}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        body = piece.removeprefix(_MARK)
        if body.isalpha() and body == body.lower() and not model.is_control(i):
            known.add(piece)
    known = sorted(known)
    begins = {p[:k]: -1 for p in known for k in range(1, len(p))}
    begins |= {p: i for i, p in enumerate(known)}
    texts, numbers = list(begins), np.array(list(begins.values()), np.int64)
    keys = np.zeros(len(texts), np.uint64)
    for at, letters in _matrices(texts):
        h = np.zeros(len(at), np.uint64)
        for k in range(1, letters.shape[1]):    # the mark before a word is a letter of its own here
            h = _grow(h, letters[:, k])
        keys[at] = h
    order = np.argsort(keys)
    return keys[order], numbers[order], len(known)


def _grow(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ letter) * _TURN
        return h ^ (h >> np.uint64(29))


def _matrices(words: list[str]):
    """Words of equal length as a matrix of letters, with the place of each in the list."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, np.concatenate(
            [np.full((len(at), 1), ord(_MARK), np.uint64), letters[starts[at][:, None] + np.arange(n)]], axis=1
        )


def _arcs(matrix: np.ndarray, path: str | None):
    """(begin, end, words, pieces): which pieces (-1: a strange letter) cover begin..end of which words."""
    keys, numbers, _ = pieces(path)
    count, length = matrix.shape
    for begin in range(length):
        live, h = np.arange(count), np.zeros(count, np.uint64)
        for end in range(begin + 1, length + 1):
            h = _grow(h, matrix[live, end - 1])
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            found = keys[at] == h
            number = np.where(found, numbers[at], -1)
            if end == begin + 1:
                yield begin, end, live, number
            elif (number >= 0).any():
                yield begin, end, live[number >= 0], number[number >= 0]
            live, h = live[found], h[found]
            if not len(live):
                break


def _forward(matrix, shares, path):
    """Sums over the segmentations of each word's beginnings; and the arcs."""
    count, length = matrix.shape
    alpha = np.zeros((length + 1, count, shares.shape[1]))
    alpha[0] = 1
    arcs = []
    for begin, end, who, number in _arcs(matrix, path):
        chance = np.where((number >= 0)[:, None], shares[number], STRANGE)
        alpha[end][who] += alpha[begin][who] * chance
        arcs.append((begin, end, who, number, chance))
    return alpha, arcs


def word_scores(words: list[str], shares: np.ndarray, path: str | None = None) -> np.ndarray:
    """Log probability of each word in each language."""
    result = np.zeros((len(words), shares.shape[1]))
    for at, matrix in _matrices(words):
        for block in range(0, len(at), 20_000):
            part = slice(block, block + 20_000)
            result[at[part]] = np.log(_forward(matrix[part], shares, path)[0][-1])
    return result


def expected(words: list[str], counts: np.ndarray, shares: np.ndarray, path: str | None = None) -> np.ndarray:
    """Expected number of uses of each piece in each language, over all segmentations."""
    total = np.zeros_like(shares)
    for at, matrix in _matrices(words):
        for block in range(0, len(at), 5_000):
            here = at[block:block + 5_000]
            alpha, arcs = _forward(matrix[block:block + 5_000], shares, path)
            beta = np.zeros_like(alpha)
            beta[-1] = counts[here] / alpha[-1]
            for begin, end, who, number, chance in reversed(arcs):
                beta[begin][who] += chance * beta[end][who]
            for begin, end, who, number, chance in arcs:
                real = number >= 0
                uses = (alpha[begin][who] * chance * beta[end][who])[real]
                for k in range(shares.shape[1]):
                    total[:, k] += np.bincount(number[real], uses[:, k], minlength=len(total))
    return total


def learn(
    labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS, vocabulary: str | None = None, usual: bool = False,
) -> dict:
    """The languages and the probability of each piece in each, from labelled rows; with ``usual``
    also what scores are usual in each."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang")
    )
    counts = (
        known.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(max_langs).collect()
    )
    langs = sorted(r[0] for r in counts)
    size = pieces(vocabulary)[2]
    if not langs:
        return {"langs": [], "shares": np.zeros((size, 0)), "vocabulary": vocabulary}
    chosen, number = F.lit(False), F.lit(-1)
    part = F.pmod(F.xxhash64("__id"), F.lit(1_000_000))
    for lang_value, n in counts:
        mine = F.col("__lang") == lang_value
        chosen = chosen | (mine & (part < int(max_docs / n * 1_000_000) + 1))
        number = F.when(mine, langs.index(lang_value)).otherwise(number)

    def words_of(unit):
        total: dict = {}
        for k, t in zip(unit.column("__lang").to_pylist(), unit.column("__text").to_pylist()):
            for w in _WORDS.findall(t.lower()):
                total[k, w] = total.get((k, w), 0) + 1
        if not total:
            return None
        return rows.batch(
            lang=pa.array([k for k, _ in total], pa.int32()), word=[w for _, w in total],
            uses=pa.array(total.values(), pa.int64()),
        )

    sample = known.where(chosen).select("__text", number.cast("int").alias("__lang"))
    found = rows.map_units(sample, "__text", words_of, "lang int, word string, uses long")
    table = store(found.groupBy("word", "lang").agg(F.sum("uses").alias("uses")), "language-words")
    shares = np.full((size, len(langs)), 1 / size)
    for _ in range(ROUNDS):
        shares = _next_shares(table, shares, vocabulary)
    model = {"langs": langs, "shares": shares, "vocabulary": vocabulary}
    return model | {"usual": _usual(sample, model)} if usual else model


def _usual(sample: DataFrame, model: dict) -> np.ndarray:
    """By language: mean score a letter, its variance from document to document, and a word's a letter.

    Each document counts by its letters; a word has one more, the mark before it.
    """
    def sums(batches):
        scores = _Scores(model)
        for unit in rows.gathered(batches, "__text"):
            found = [_WORDS.findall(t.lower()) for t in unit.column("__text").to_pylist()]
            at = [[scores[w] for w in ws] for ws in found]
            table, out = scores.settle(), []
            for k, ws, places in zip(unit.column("__lang").to_pylist(), found, at):
                if ws:
                    s, n = table[places, k], np.fromiter(map(len, ws), float, len(ws)) + 1
                    out.append((k, s.sum(), n.sum(), s.sum() ** 2 / n.sum(), s @ s, s @ n, n @ n))
            scores.trim()
            if out:
                yield rows.batch(**dict(zip(names, map(list, zip(*out)))))

    names = ["lang", "s", "n", "ssn", "ss", "sn", "nn"]
    shape = "lang long, " + ", ".join(f"{c} double" for c in names[1:])
    result = np.full((3, len(model["langs"])), np.inf)      # a language without words bounds nothing
    result[0] = 0
    # seven numbers a language
    totals = sample.mapInArrow(sums, shape).groupBy("lang").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()
    for lang, s, n, ssn, ss, sn, nn in totals:
        mean = s / n
        result[:, lang] = mean, max(ssn / n - mean ** 2, 0), (ss - 2 * mean * sn + mean ** 2 * nn) / n
    return result


def is_usual(score: float, letters: int, usual: np.ndarray) -> bool:
    """Whether a text of so many letters may have this score in a language of such ``usual`` scores."""
    mean, between, within = usual
    return score / letters >= mean - WIDTH * np.sqrt(between + within / letters)


def _next_shares(table: DataFrame, shares: np.ndarray, path: str | None) -> np.ndarray:
    size, langs = shares.shape

    def count(batches):
        total = np.zeros((size, langs))
        for part in batches:
            words = part.column("word").to_pylist()
            weights = np.zeros((len(words), langs))
            weights[np.arange(len(words)), part.column("lang").to_numpy()] = part.column("uses").to_numpy()
            total += expected(words, weights, shares, path) if words else 0
        piece, lang = np.nonzero(total)
        yield rows.batch(piece=piece, lang=lang, uses=total[piece, lang])

    spread = table.repartition(table.sparkSession.sparkContext.defaultParallelism)
    sums = spread.mapInArrow(count, "piece long, lang long, uses double")
    total = np.full((size, langs), SMOOTH)
    # one row for each piece of the vocabulary and language at most
    for piece, lang, uses in sums.groupBy("piece", "lang").agg(F.sum("uses")).collect():
        total[piece, lang] += uses
    return total / total.sum(axis=0)


class _Scores(dict):
    """Word to the row of its scores; words not met yet wait for the next ``settle``."""

    def __init__(self, model):
        super().__init__()
        self.model, self.waiting = model, []
        self.rows = np.zeros((0, len(model["langs"])))

    def __missing__(self, word):
        self[word] = place = len(self)
        self.waiting.append(word)
        return place

    def settle(self) -> np.ndarray:
        if self.waiting:
            new = word_scores(self.waiting, self.model["shares"], self.model["vocabulary"])
            self.rows = np.concatenate([self.rows, new])
            self.waiting = []
        return self.rows

    def trim(self):
        if len(self) > MOST_CACHED:
            self.clear()
            self.rows = self.rows[:0]


def guess(texts: list[str | None], scores: _Scores) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; a text unlike all languages has score 0 if the model knows
    what is usual."""
    langs, usual = scores.model["langs"], scores.model.get("usual")
    found = [_WORDS.findall(t.lower()) if t else [] for t in texts]
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    places = [[scores[w] for w in words] for words in found]
    table = scores.settle()
    labels, shares = [], np.zeros(len(texts))
    for i, (words, at) in enumerate(zip(found, places)):
        if not any(c.isalpha() for w in words for c in w):
            labels.append(UNKNOWN)
            continue
        total = table[at].sum(axis=0)
        best = int(total.argmax())
        labels.append(langs[best])
        if usual is None or is_usual(total[best], sum(map(len, words)) + len(words), usual[:, best]):
            shares[i] = 1 / np.exp(total - total[best]).sum()
    scores.trim()
    return labels, shares


def identify(
    df: DataFrame, model: dict, text: str = "text", predicted: str = "lang_pred", score: str = "score",
    min_score: float | None = None,
) -> DataFrame:
    """Every row with its language and score; with ``min_score``, only the rows that reach it
    in a learned language, without the two columns."""
    keep = [c for c in df.columns if min_score is not None or c not in (predicted, score)]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    if min_score is None:
        shown += f", `{predicted}` string, `{score}` double"

    def run(batches):
        scores = _Scores(model)
        for unit in rows.gathered(batches, text):
            labels, shares = guess(unit.column(text).to_pylist(), scores)
            columns = {c: unit.column(c) for c in keep}
            if min_score is None:
                yield rows.batch(**columns, **{predicted: labels, score: shares})
            else:
                good = [x != UNKNOWN and y >= min_score for x, y in zip(labels, shares.tolist())]
                yield rows.batch(**columns).filter(pa.array(good, pa.bool_()))

    return source.mapInArrow(run, shown)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the documents that is not learned from; so is a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))
