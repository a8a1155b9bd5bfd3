"""Secret scans with a linear-chain conditional random field over tokens.

Three fixed patterns give the base spans.  On a sample their tokens are labelled begin, inside or
outside, and a field is fitted to the labels: what a token is like (shape, length, share of
digits, how often it changes between digits, capitals and small letters), what stands next to it
(assignment signs, quotes, words that announce a secret) and what the file is like (share of digits,
assignments).  So that the field learns more than the patterns, each base secret is also shown with
other values in its place, of any length and alphabet, and with its announcing words changed or
gone; ordinary texts are shown with look-alikes in them (dates, versions, names of files, phone
numbers, long identifiers, plain words behind announcing ones).  Tokens outside the base spans that
look like secrets are not called outside: their windows are left out.  How far begin is held back
is chosen on a part of the windows that is not fitted to: the least that reaches ``PRECISION`` there.
Decoding by Viterbi finds further spans; those that overlap no base span are added as kind ``field``.

Decoding is exact.  Where a token's own score for outside beats the others by more than any
neighbours could make good, the best path has outside there, so only the stretches between such
tokens are searched.

The field is fitted on about ``SAMPLE`` documents (chosen by a hash of the text), of each at most
``WINDOWS`` stretches of ``WIDTH`` tokens and ``VARIANTS`` of each; scans cover all texts whole,
however long.  NULL and empty texts: no spans.  Repeated rows get equal results.  Other columns than
the text are passed on or not read, whatever their names.  Empty table: empty result, with no field.
A sample without base spans: a field that adds none.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from importflow.llm import rows

# The patterns of the base spans.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")      # 20 characters or more
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "field")

KEYWORDS = {b"password", b"passwd", b"pwd", b"secret", b"token", b"key", b"apikey", b"api_key", b"auth",
            b"bearer", b"credential", b"credentials", b"private", b"access", b"pass", b"passphrase", b"passcode"}

SAMPLE = 20_000
WINDOWS = 6
WIDTH = 17
MOST_WINDOWS = 3000     # that the field is fitted to
STEPS = 120
VARIANTS = 12           # of each secret that the sample shows
LOOKALIKES = 2          # put into each text of the sample
CONTEXT = 80            # bytes on each side of a variant
UNIT = 1 << 20          # bytes of text that are cut into tokens at once
PRECISION = 0.99        # of the tokens marked in windows that the field was not fitted to
CAUTIONS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)     # what may be taken from the score of begin

OUTSIDE, BEGIN, INSIDE = range(3)

# A byte's class: 0 white space, 1 inside words, 2 other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")] = 1
_CLASS[128:] = 1
# What is counted in a token: digits, upper, lower, beyond ASCII; in signs =, :, quotes.
_COUNTED = np.zeros((4, 256), bool)
_COUNTED[0, list(b"0123456789=")] = True
_COUNTED[1, 65:91] = _COUNTED[1, ord(":")] = True
_COUNTED[2, 97:123] = True
_COUNTED[2, list(b"\"'")] = True
_COUNTED[3, 128:] = True
_ALPHABET = np.full(256, 0, np.uint8)       # 1 digit, 2 capital, 3 small letter
_ALPHABET[48:58], _ALPHABET[65:91], _ALPHABET[97:123] = 1, 2, 3

_LENGTHS = np.array([3, 6, 9, 16, 20, 24, 32, 40, 64])
_CHANGES = np.array([2, 4, 7, 11, 16])
SHAPES, SIZES, DIGITS, MIXES, BEFORE, AFTER, FILES = 10, len(_LENGTHS) + 1, 5, len(_CHANGES) + 1, 6, 4, 6
_SIZES_OF = (SHAPES * SIZES, DIGITS, MIXES * SIZES, BEFORE, AFTER, FILES, SHAPES * BEFORE, MIXES * BEFORE)
_FIRST_OF = np.concatenate([[0], np.cumsum(_SIZES_OF)])
FEATURES = int(_FIRST_OF[-1])


class Tokens:
    """The tokens of the texts of a unit and a code for what each shows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        kind = _CLASS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge[-1] = True
        turn = np.ones(len(data) + 1, bool)
        turn[1:-1] = kind[1:] != kind[:-1]
        turn |= edge
        cuts = np.flatnonzero(turn)
        real = kind[cuts[:-1]] > 0 if len(data) else np.zeros(0, bool)
        self.start, self.end = cuts[:-1][real], cuts[1:][real]
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.sign = kind[self.start] == 2
        self.code = self._codes() if len(self.start) else np.zeros(0, np.int64)

    def _codes(self):
        n, size = len(self.start), self.end - self.start
        # white space behind a token counts as nothing
        digit, upper, lower, far = (np.add.reduceat(c[self.data], self.start, dtype=np.int64) for c in _COUNTED)
        alphabet = _ALPHABET[self.data]
        turns = np.zeros(len(alphabet), bool)
        turns[1:] = (alphabet[1:] != alphabet[:-1]) & (alphabet[1:] > 0) & (alphabet[:-1] > 0)
        mix = np.searchsorted(_CHANGES, np.add.reduceat(turns, self.start, dtype=np.int64), "right")
        d, u, l = digit > 0, upper > 0, lower > 0
        capital = u & l & (upper == 1) & (self.data[self.start] < 91)
        shape = np.select(
            [self.sign, far > 0, ~d & ~u & l, capital & ~d, ~d & u & ~l, d & ~u & ~l, d & ~u & l, d & u & ~l, d & u & l],
            [0, 9, 1, 2, 3, 4, 5, 6, 7], 8,
        )
        length = np.searchsorted(_LENGTHS, size, "right")
        share = np.minimum(np.ceil(4 * digit / np.maximum(size, 1)), 4).astype(np.int64)
        share[self.sign] = 0
        begin = np.zeros(n, bool)
        begin[self.first[:-1][np.diff(self.first) > 0]] = True
        stop = np.concatenate([begin[1:], [True]])
        assign = self.sign & ((digit > 0) | (upper > 0))
        quote = self.sign & (lower > 0)
        one, two, three = (self._back(k, begin) for k in (1, 2, 3))
        near = self.start == np.concatenate([[-1], self.end[:-1]])
        by_quote = one(quote) & ~one(assign)
        set_one, set_two = one(assign), by_quote & two(assign)
        known = self._announces(assign, quote)
        keyed = (set_one & (two(known) | (two(quote) & three(known)))) | (set_two & three(known))
        before = np.select([begin, keyed, set_one | set_two, by_quote & near, near], [0, 3, 2, 1, 4], 5)
        touch = np.concatenate([near[1:], [False]]) & ~stop
        ahead = lambda flags: np.concatenate([flags[1:], [False]]) & ~stop
        after = np.select([ahead(assign), touch & ahead(quote), touch], [3, 1, 2], 0)
        file = self._file(assign, np.where(self.sign, 0, digit))[self.text]
        return self._join(shape * SIZES + length, share, mix, before, after, file)

    def _back(self, k: int, begin):
        """Flags of the token ``k`` places before, in the same text."""
        reach = np.zeros(len(self.start), bool)
        reach[k:] = self.text[k:] == self.text[:-k]

        def shifted(flags):
            moved = np.zeros(len(flags), bool)
            moved[k:] = flags[:-k]
            return moved & reach

        return shifted

    def _announces(self, assign, quote):
        """Words before an assignment that announce a secret."""
        n = len(self.start)
        nearby = np.zeros(n, bool)
        nearby[:-1] |= assign[1:]
        nearby[:-2] |= assign[2:] & quote[1:-1]
        nearby &= ~self.sign & (self.end - self.start < 40)
        found = np.zeros(n, bool)
        at = np.flatnonzero(nearby)
        for i, a, b in zip(at.tolist(), self.start[at].tolist(), self.end[at].tolist()):
            word = self.data[a:b].tobytes().lower()
            found[i] = any(part in KEYWORDS for part in (word, *re.split(rb"[-_/+]", word)))
        return found

    def _file(self, assign, digit):
        size = np.maximum(np.diff(self.offsets), 1)
        many = np.bincount(self.text, digit, minlength=len(size))
        share = np.select([many * 100 < size, many * 20 < size], [0, 1], 2)
        held = np.bincount(self.text[assign], minlength=len(size)) > 0
        return share * 2 + held

    @staticmethod
    def _join(look, share, mix, before, after, file):
        return ((((look * DIGITS + share) * MIXES + mix) * BEFORE + before) * AFTER + after) * FILES + file


def features_of(code: np.ndarray) -> np.ndarray:
    """The places of a code's features among the field's weights."""
    rest, file = np.divmod(code, FILES)
    rest, after = np.divmod(rest, AFTER)
    rest, before = np.divmod(rest, BEFORE)
    rest, mix = np.divmod(rest, MIXES)
    look, share = np.divmod(rest, DIGITS)
    shape, size = np.divmod(look, SIZES)
    parts = [look, share, mix * SIZES + size, before, after, file, shape * BEFORE + before, mix * BEFORE + before]
    return np.stack([p + f for p, f in zip(parts, _FIRST_OF)], axis=-1)


def base_matches(text: bytes, long: bool, sets: bool) -> list[tuple[int, int, int, int]]:
    """Base spans as (start, kind, end, start of the secret itself), in bytes."""
    found = []
    if sets:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if long:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def base_spans(tokens: Tokens) -> list[list[tuple[int, int, int, int]]]:
    """Per text; only texts that can match are searched."""
    count = len(tokens.offsets) - 1
    long = np.bincount(tokens.text[tokens.end - tokens.start >= 20], minlength=count) > 0
    signs = (tokens.data == ord("=")) | (tokens.data == ord(":"))
    running = np.concatenate([[0], np.cumsum(signs)])
    sets = np.diff(running[tokens.offsets]) > 0
    found: list = [[]] * count
    for i in np.flatnonzero(long | sets).tolist():
        text = tokens.data[tokens.offsets[i]:tokens.offsets[i + 1]].tobytes()
        found[i] = base_matches(text, bool(long[i]), bool(sets[i]))
    return found


def labels_of(tokens: Tokens, spans) -> np.ndarray:
    """Begin and inside for the tokens of each secret itself, outside for the others."""
    labels = np.zeros(len(tokens.start), np.int64)
    for i, mine in enumerate(spans):
        origin = tokens.offsets[i]
        for _, _, end, secret in mine:
            a = np.searchsorted(tokens.end, origin + secret, "right")
            b = np.searchsorted(tokens.start, origin + end, "left")
            labels[a:b] = INSIDE
            labels[a:a + 1] = BEGIN
    return labels


_HEX, _SMALL = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
_LETTERS = _SMALL + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FORMS = (_HEX, _HEX.upper(), _SMALL, _LETTERS, _LETTERS, _LETTERS + "_-", _LETTERS + "+/")
_SETS = (" = ", "=", ": ", ":", ' = "', "='", '": "', ': "')


def _random_value(rnd: random.Random, least: int) -> str:
    form, size = rnd.choice(_FORMS), rnd.randint(least, 48)
    while True:
        value = "".join(rnd.choices(form, k=size))
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            break
    if rnd.random() < 0.3:
        value = "".join(rnd.choices(_SMALL[10:], k=rnd.randint(2, 4))) + rnd.choice("_-") + value
    return value


def _announcing(rnd: random.Random) -> str:
    names = [k.decode() for k in rnd.sample(sorted(KEYWORDS), rnd.randint(1, 2))]
    name = rnd.choice("_-").join(names)
    return rnd.choice((name, name.upper(), name.capitalize()))


def _lookalike(rnd: random.Random, near: list[str]) -> str:
    """What is no secret though it has digits, capitals, length or an announcing word; made of words ``near``."""
    some = [rnd.choice(near) for _ in range(rnd.randint(2, 4))]
    n = rnd.randrange
    return rnd.choice((
        lambda: f"{1970 + n(80)}-{1 + n(12):02}-{1 + n(28):02}T{n(24):02}:{n(60):02}:{n(60):02}Z",
        lambda: f"{1970 + n(80)}{1 + n(12):02}{1 + n(28):02}",
        lambda: f"v{n(20)}.{n(30)}.{n(90)}-rc{n(9)}",
        lambda: "".join(w.capitalize() for w in some) + str(n(100)),
        lambda: "-".join(some) + f"-{1970 + n(80)}",
        lambda: "_".join(w.upper() for w in some) + f"_{n(100)}",
        lambda: "/".join(["", *some, str(n(10000))]),
        lambda: f"IMG_{1970 + n(80)}{1 + n(12):02}{1 + n(28):02}_{n(10 ** 6):06}.jpg",
        lambda: f"+{1 + n(99)}-{n(1000)}-{n(10 ** 7):07}",
        lambda: f"{n(10 ** 13):013}",
        lambda: f"{rnd.choice(some)[:3].upper()}-{1970 + n(80)}-{n(10 ** 6):06}",
        lambda: f"{some[0]}{n(100)}@{some[1]}{n(100)}.example.com",
        lambda: f"{_announcing(rnd)}{rnd.choice(_SETS[:4])}{some[0]}",
        lambda: f"{some[0]}{rnd.choice(_SETS)}{n(10 ** rnd.randint(1, 9))}",
        lambda: "".join(rnd.choices(_HEX, k=7)),
        lambda: "".join(some),
    ))()


def _whole_words(left: bytes, right: bytes) -> tuple[bytes, bytes]:
    return left[left.find(b" ") + 1:] if b" " in left else b"", right[:right.rfind(b" ") + 1]


def _shown(made: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and labels of values between what stands round them: (left, value, right, secret?, file)."""
    texts = [left + value + right for left, value, right, _, _ in made]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    tokens = Tokens(np.frombuffer(b"".join(texts), np.uint8), offsets)
    labels = labels_of(tokens, [
        [(len(left), 0, len(left) + len(value), len(left))] if secret else [] for left, value, _, secret, _ in made
    ])
    out = []
    for i, (left, _, _, _, file) in enumerate(made):
        at = int(np.searchsorted(tokens.end, offsets[i] + len(left), "right"))
        part = slice(max(int(tokens.first[i]), at - WIDTH // 2), min(int(tokens.first[i + 1]), at + WIDTH // 2 + 1))
        out.append((tokens.code[part] // FILES * FILES + file, labels[part]))
    return [w for w in out if len(w[0])]


def _variants(text: bytes, spans, file: int, rnd: random.Random):
    """Each base secret with other values, announced as it is, otherwise, or not at all."""
    done = 0
    for start, _, end, secret in spans:
        if start < done:        # a pattern within another one's span
            continue
        done = end
        left, right = _whole_words(text[max(0, start - CONTEXT):start], text[end:end + CONTEXT])
        own = text[start:secret].decode("ascii", "replace")
        for k in range(VARIANTS):
            lead = (own, _announcing(rnd) + rnd.choice(_SETS), "")[k % 3]
            yield left + lead.encode(), _random_value(rnd, 12 if lead else 20).encode(), right, True, file


def windows_of(unit: pa.RecordBatch, text: str) -> pa.RecordBatch | None:
    """Stretches of codes and labels: round secrets and their variants, tokens with digits or of
    length, look-alikes, and ordinary places."""
    tokens = Tokens(*rows.text_bytes(unit.column(text)))
    if not len(tokens.start):
        return None
    base = base_spans(tokens)
    labels = labels_of(tokens, base)
    size = tokens.end - tokens.start
    rest = tokens.code // (FILES * AFTER * BEFORE)
    mix, digits = rest % MIXES, rest // MIXES % DIGITS
    odd = ((size >= 16) | (digits > 0)) & (labels == OUTSIDE)
    likely = (labels == OUTSIDE) & (size >= 16) & (digits > 0) & (mix >= 3)
    out, made = [], []
    for i in range(len(tokens.offsets) - 1):
        a, b = int(tokens.first[i]), int(tokens.first[i + 1])
        if a == b:
            continue
        hits, likes = np.flatnonzero(labels[a:b] == BEGIN) + a, np.flatnonzero(odd[a:b]) + a
        plain = [a + (b - a) * k // 3 for k in (1, 2)]
        for at in [*hits[:WINDOWS].tolist(), *likes[:: max(1, len(likes) // 3)][:3].tolist(), *plain][:WINDOWS]:
            left = max(a, at - WIDTH // 2)
            part = slice(left, min(b, left + WIDTH))
            if not likely[part].any():
                out.append((tokens.code[part], labels[part]))
        whole = tokens.data[tokens.offsets[i]:tokens.offsets[i + 1]].tobytes()
        file = int(tokens.code[a] % FILES)
        rnd = random.Random(zlib.crc32(whole))
        made += _variants(whole, base[i][:WINDOWS], file, rnd)
        near = [w.decode("utf-8", "replace") for w in whole[:20 * CONTEXT].split()[1:-1] if w.isalpha()]
        for _ in range(LOOKALIKES if near else 0):
            at = rnd.randrange(len(whole))
            left, right = _whole_words(whole[max(0, at - CONTEXT):at], whole[at:at + CONTEXT])
            if not base_matches(left + b" " + right, True, True):
                made.append((left, _lookalike(rnd, near).encode() + b" ", right, False, file))
    out += _shown(made)
    return rows.batch(
        secret=pa.array([bool(l.any()) for _, l in out], pa.bool_()),
        code=pa.array([c.tolist() for c, _ in out], pa.list_(pa.int64())),
        label=pa.array([l.tolist() for _, l in out], pa.list_(pa.int64())),
    )


class Field:
    """Weights of features by state and of steps between states."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, caution: float = 0.0):
        self.weights, self.steps, self.caution = weights, steps, caution
        codes = np.arange(SHAPES * SIZES * DIGITS * MIXES * BEFORE * AFTER * FILES)
        self.scores = sum(weights[f] for f in features_of(codes).T)
        self.scores[:, BEGIN] -= caution
        lost = np.array([
            (steps[:, x][:, None] + steps[x, :] - steps[:, OUTSIDE][:, None] - steps[OUTSIDE, :]).max()
            for x in (BEGIN, INSIDE)
        ])
        lead = self.scores[:, [OUTSIDE]] - self.scores[:, [BEGIN, INSIDE]]
        self.surely_outside = (lead > lost).all(axis=1)

    def __reduce__(self):       # the scores of all codes are made again where the field is used
        return Field, (self.weights, self.steps, self.caution)

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best path's state of every token (texts begin and end as if outside)."""
        states = np.zeros(len(tokens.code), np.int64)
        open_ = np.flatnonzero(~self.surely_outside[tokens.code])
        if not len(open_):
            return states
        text = tokens.text[open_]
        cut = np.flatnonzero((np.diff(open_) > 1) | (text[1:] != text[:-1])) + 1
        first = np.concatenate([[0], cut])
        count = np.diff(np.concatenate([first, [len(open_)]]))
        for n in np.unique(count).tolist():
            at = open_[first[count == n]][:, None] + np.arange(n)
            states[at] = self._paths(self.scores[tokens.code[at]])
        return states

    def _paths(self, scores: np.ndarray) -> np.ndarray:
        runs, n, _ = scores.shape
        best = scores[:, 0] + self.steps[OUTSIDE]
        came = np.zeros((n, runs, 3), np.int64)
        for t in range(1, n):
            ways = best[:, :, None] + self.steps
            came[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        path = np.zeros((runs, n), np.int64)
        path[:, -1] = (best + self.steps[:, OUTSIDE]).argmax(axis=1)
        for t in range(n - 1, 0, -1):
            path[:, t - 1] = came[t, np.arange(runs), path[:, t]]
        return path


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def expectations(scores: np.ndarray, steps: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By forward and backward sums the probability of each state at each token, and of each two
    states at neighbouring tokens; ``real`` tells the tokens of each sequence from what fills it up."""
    width = scores.shape[1]
    scores = np.where(real[:, :, None], scores, 0.0)
    both = real[:, 1:] & real[:, :-1]
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, width):
        moved = _log_sum(ahead[:, t - 1][:, :, None] + steps, 1) + scores[:, t]
        ahead[:, t] = np.where(real[:, t][:, None], moved, ahead[:, t - 1])
    for t in range(width - 2, -1, -1):
        moved = _log_sum(steps + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(real[:, t + 1][:, None], moved, 0.0)
    total = _log_sum(ahead[:, -1], 1)
    share = np.exp(ahead + back - total[:, None, None])
    share[~real] = 0
    pair = np.exp(
        ahead[:, :-1, :, None] + steps + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
    )
    pair[~both] = 0
    return share, pair


def fit(sequences: list[tuple[list[int], list[int]]]) -> Field:
    """Maximum likelihood with a small penalty, by gradient steps of adapted size."""
    weights, steps = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    if not sequences:
        weights[:, OUTSIDE] = 1e3
        return Field(weights, steps)
    n, width = len(sequences), max(len(c) for c, _ in sequences)
    codes, labels = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    real = np.zeros((n, width), bool)
    for i, (c, l) in enumerate(sequences):
        codes[i, :len(c)], labels[i, :len(c)], real[i, :len(c)] = c, l, True
    places = features_of(codes)
    seen = np.zeros((n, width, 3))
    np.put_along_axis(seen, labels[:, :, None], 1.0, axis=2)
    seen[~real] = 0
    both = real[:, 1:] & real[:, :-1]
    seen_steps = np.array([[(both & (labels[:, :-1] == a) & (labels[:, 1:] == b)).sum() for b in range(3)] for a in range(3)])
    moments = [np.zeros_like(weights), np.zeros_like(steps)]
    flat = places[real].ravel()
    for _ in range(STEPS):
        scores = weights[places].sum(axis=2)
        share, pair = expectations(scores, steps, real)
        pull = (seen - share)[real]
        gradient = np.stack(
            [np.bincount(flat, np.repeat(pull[:, s], places.shape[2]), minlength=FEATURES) for s in range(3)], 1
        ) - 0.02 * weights
        turns = [(weights, gradient), (steps, seen_steps - pair.sum(axis=(0, 1)) - 0.02 * steps)]
        for (value, g), m in zip(turns, moments):
            m += g * g
            value += 0.5 * g / np.sqrt(m + 1e-8)
    return Field(weights, steps)


def learn(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """Fit the field to the base spans of a sample; a fifth of the windows sets its caution."""
    source = df.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = source.count()
    part = int(sample / max(total, 1) * 1_000_000) + 1
    some = source.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < part)
    found = rows.map_units(
        some, "text", lambda unit: windows_of(unit, "text"), "secret boolean, code array<long>, label array<long>", UNIT
    ).withColumn("turn", F.xxhash64("code", "label"))
    scratch = rows.Scratch(df.sparkSession, "secret-windows")
    found = scratch.store(found)
    # half of the windows show secrets, if the sample has as many
    chosen = [
        found.where(kind).orderBy("turn").limit(MOST_WINDOWS // 2).collect()
        for kind in (F.col("secret"), ~F.col("secret"))
    ]
    scratch.drop()
    if not chosen[0]:
        return fit([])
    windows = [(r["code"], r["label"]) for rows_ in chosen for r in rows_]
    field = fit([w for i, w in enumerate(windows) if i % 5])
    return Field(field.weights, field.steps, caution(field, windows[::5]))


def caution(field: Field, windows: list[tuple[list[int], list[int]]]) -> float:
    """The least of ``CAUTIONS`` at which ``PRECISION`` of the tokens marked in the windows are secrets."""
    for least in CAUTIONS:
        careful = Field(field.weights, field.steps, least)
        marked = wrong = 0
        for code, label in windows:
            path = careful._paths(careful.scores[np.array(code)][None])[0] != OUTSIDE
            marked += path.sum()
            wrong += (path & (np.array(label) == OUTSIDE)).sum()
        if wrong <= (1 - PRECISION) * marked:
            return least
    return CAUTIONS[-1]


def find(unit_text: pa.Array, field: Field) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Per text its bytes (empty where nothing was found) and all spans (start, kind, end) in bytes."""
    tokens = Tokens(*rows.text_bytes(unit_text))
    base = base_spans(tokens)
    spans = [[(a, k, b) for a, k, b, _ in mine] for mine in base]
    states = field.decode(tokens)
    marked = states != OUTSIDE
    begins = marked & ((states == BEGIN) | ~np.concatenate([[False], marked[:-1]]))
    at = np.flatnonzero(begins | (marked & np.concatenate([[True], tokens.text[1:] != tokens.text[:-1]])[:len(marked)]))
    for i in at.tolist():
        j, text = i + 1, int(tokens.text[i])
        while j < len(states) and states[j] == INSIDE and tokens.text[j] == text:
            j += 1
        a, b = int(tokens.start[i] - tokens.offsets[text]), int(tokens.end[j - 1] - tokens.offsets[text])
        if not any(a < y and x < b for x, _, y in spans[text]):
            spans[text] = [*spans[text], (a, 3, b)]
    return [
        (tokens.data[tokens.offsets[i]:tokens.offsets[i + 1]].tobytes() if mine else b"", sorted(mine))
        for i, mine in enumerate(spans)
    ]


def in_characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as spans of code points."""
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    place = np.concatenate([starts - 1, starts[-1:]])      # of the code point that begins at each byte
    return [(int(place[a]), k, int(place[b])) for a, k, b in spans]


def scan(df: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: array of (start, kind, end) in code points, by start, then kind."""
    kind = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def work(unit):
        found = [in_characters(t, s) if s else [] for t, s in find(unit.column("text"), field)]
        spans = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in mine] for mine in found]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        return rows.batch(doc_id=unit.column("doc_id"), spans=pa.array(spans, kind))

    return rows.map_units(source, "text", work, f"doc_id {kind}, spans array<struct<start: long, kind: string, end: long>>", UNIT)


def summary(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans in one string."""
    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(name):
        return F.filter("spans", lambda s: s["kind"] == name)

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def redact(df: DataFrame, field: Field, text: str = "text", size: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """Every row with its spans replaced by ``mark`` (overlapping ones together), ``size`` set anew."""
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    put = mark.encode()

    def work(unit):
        changed, old = {}, unit.column(text)
        for i, (whole, spans) in enumerate(find(old, field)):
            if spans:
                parts, done = [], 0
                for a, _, b in spans:
                    if a >= done:
                        parts += [whole[done:a], put]
                    done = max(done, b)
                changed[i] = b"".join([*parts, whole[done:]]).decode("utf-8", "replace")
        if not changed:
            return unit
        texts = old.to_pylist()
        for i, new in changed.items():
            texts[i] = new
        columns = {c: unit.column(c) for c in unit.schema.names}
        columns[text] = pa.array(texts, old.type)
        if size in columns:
            sizes = columns[size].to_pylist()
            for i, new in changed.items():
                sizes[i] = len(new)
            columns[size] = pa.array(sizes, columns[size].type)
        return rows.batch(**columns)

    return rows.map_units(df, text, work, shown, UNIT)
