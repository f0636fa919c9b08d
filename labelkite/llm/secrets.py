"""Secrets in texts: patterns of known forms, and a battery of randomness tests on other strings.

The known forms are three patterns. The battery looks at every other long string of letters, digits
and ``+/_-`` that has a digit; ``=`` ends a string, so the value of ``NAME=VALUE`` is one of its own. Its encoding is inferred (hex, base 32, base 36, base 64), and three
tests say how well it looks like independent, even draws from that alphabet: chi-squared of the
character counts, runs above and below the middle of the alphabet, and serial correlation. Each gives a
z-score of the departure from randomness, and the score is the largest.

A string of more than 128 characters is tested in overlapping stretches of each class length, from its
start to its end, and those that pass are united: a secret after or before ordinary characters of the same
run is found, and of these only what shares a stretch with it is marked.

A short string of ordinary text can pass such tests by luck, so a score is compared with ordinary text
of the same length: the letters of each document's own words, all of them but those of the strings that
are tested themselves, cut into consecutive strings of that length and tested in the same way. The share of ordinary strings that look at least as random is the
candidate's p-value, and the Benjamini-Hochberg rule over all candidates keeps the share of false
discoveries below ``rate``. Both distributions are counts by length class and score, over all
documents; only these counts, at most some thousands, reach the driver.

Nulls: a null text is an empty one. Each row has its own result, whether ids repeat or are null. An
empty table, or one without candidates, gives no added spans. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The three known forms.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
KINDS = ["assign", "access", "hex", "random"]

# With up to six signs of padding, as base 32 has; after another "=" the next string begins.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,6}")
NOT_LETTERS = bytes(c for c in range(256) if not (c < 128 and chr(c).isalpha()))
LENGTHS = np.array([20, 24, 28, 32, 40, 48, 64, 96, 128])  # first length of each class
WHOLE = 1 << 20  # what a string counts, shared by its stretches
SCORES = 64  # score classes of 1/8 each
RATE = 0.01
POOL = 1 << 18  # characters whose strings are scored at a time

# The alphabets, in order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _tables() -> tuple[np.ndarray, list[tuple[np.ndarray, int, int]]]:
    """By character code: bits of the alphabets it is in; and for each alphabet its places, its bits and its size.

    Hex and base 36 are in one case, either one: they have a bit for each.
    """
    fits, places = np.zeros(256, np.uint8), []
    bit = 1
    for name, letters in ALPHABETS.items():
        place, bits = np.zeros(256, np.int32), 0
        for t in (letters, letters.upper()) if name in ("hex", "base36") else (letters,):
            codes = np.frombuffer(t.encode(), np.uint8)
            fits[codes] |= bit
            place[codes] = np.arange(len(codes))
            bits, bit = bits | bit, bit << 1
        places.append((place, bits, len(letters)))
    for a, b in (("-", "+"), ("_", "/")):
        fits[ord(a)] = fits[ord(b)]
        for place, _, _ in places:
            place[ord(a)] = place[ord(b)]
    return fits, places


FITS, PLACES = _tables()


def symbols(s: str) -> tuple[np.ndarray, int] | None:
    """The string as numbers in the smallest alphabet that has all its characters, and the alphabet's size."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    for name, letters in ALPHABETS.items():
        for t in (s, s.lower()) if name in ("hex", "base36") and (s.isupper() or s.islower()) else (s,):
            if set(t) <= set(letters):
                place = {c: i for i, c in enumerate(letters)}
                return np.array([place[c] for c in t]), len(letters)
    return None


def departures(x: np.ndarray, m: int) -> np.ndarray:
    """For each row the largest of three z-scores that say how far from even, independent draws of 0..m-1 it is."""
    rows, n = x.shape
    if n < 8:
        return np.full(rows, np.inf)
    counts = np.bincount((x + m * np.arange(rows)[:, None]).ravel(), minlength=rows * m).reshape(rows, m)
    expected = n / m
    chi = ((counts - expected) ** 2).sum(1) / expected
    free = m - 1
    # Wilson and Hilferty: the cube root of chi-squared is about normal.
    z_even = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5
    high = x >= m / 2
    a = high.sum(1)
    b = n - a
    mean = 2 * a * b / n + 1
    spread = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    z_runs = np.abs(1 + (high[:, 1:] != high[:, :-1]).sum(1) - mean) / spread**0.5
    # The sums of the serial correlation, times n: whole numbers.
    total, x64 = counts @ np.arange(m), x.astype(np.int64)
    square = n * (counts @ np.arange(m) ** 2) - total**2
    ends = x64[:, 0] + x64[:, -1]
    pairs = n * (x64[:, 1:] * x64[:, :-1]).sum(1) - total * (2 * total - ends) + (n - 1) * total**2 / n
    z_serial = np.abs(pairs) / np.maximum(square, 1) * n**0.5
    z = np.maximum(np.maximum(z_even, z_runs), z_serial)
    return np.where((a == 0) | (b == 0) | (square == 0), np.inf, z)


def departure(x: np.ndarray, m: int) -> float:
    return float(departures(np.asarray(x)[None], m)[0])


def score_classes(strings: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """Class of the departure of each (chosen) row of characters, 0 the most random; -1 if it fits no alphabet."""
    size = len(strings) if chosen is None else len(chosen)
    out = np.full(size, -1, np.int8)
    step = max(1, POOL // max(1, strings.shape[1]))
    for start in range(0, size, step):
        part = strings[start : start + step] if chosen is None else strings[chosen[start : start + step]]
        fits = np.bitwise_and.reduce(FITS[part], 1)
        for place, bits, m in PLACES:
            rows = np.flatnonzero(fits & bits)
            fits[rows] = 0
            if len(rows):
                d = departures(place[part[rows]], m)
                out[start + rows] = np.minimum(np.maximum(d, 0.0) * 8, SCORES - 1).astype(np.int8)
    return out


def score_class(s: str) -> int | None:
    """Class of a string's departure, 0 the most random; None if it is no candidate."""
    got = symbols(s)
    if got is None:
        return None
    d = departure(*got)
    return int(min(max(d, 0.0) * 8, SCORES - 1))


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, "right")) - 1


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the known forms, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(word in low for word in NAMES):  # a quick look before the slow pattern
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(found)


def stretches(s: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length class, starts, score classes)`` of the stretches with a digit of a string above all length classes.

    They have the exact lengths of the classes, begin a quarter of their length apart, and the last of
    each length ends where the string does: each character is in stretches of each length.
    """
    codes = np.frombuffer(s, np.uint8)
    digits = np.concatenate([[0], np.cumsum((codes >= ord("0")) & (codes <= ord("9")), dtype=np.int32)])
    for k, n in enumerate(LENGTHS.tolist()):
        starts = np.unique(np.append(np.arange(0, len(s) - n + 1, n // 4), len(s) - n))
        starts = starts[digits[starts + n] > digits[starts]]
        yield k, starts, score_classes(np.lib.stride_tricks.sliding_window_view(codes, n), starts)


def tested(text: str) -> Iterator[Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """For each string with a digit its parts: ``(length class, starts, ends, score classes)``.

    A string up to the longest class is one part, with its padding; a longer one is tested in stretches.
    Parts that overlap known spans, or fit no alphabet, are left out.
    """
    borders = None
    for m in CANDIDATE.finditer(text):
        if any(c.isdigit() for c in m[0]):
            if borders is None:
                known = united((a, b) for a, _, b in known_spans(text))
                borders = np.array([*known, (len(text) + 1, len(text) + 1)])
            yield _parts(m, borders)


def _parts(m: re.Match, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    s = m[0].rstrip("=")
    parts, whole = stretches(s.encode()), len(s) <= LENGTHS[-1]
    if whole:
        score = score_class(s)
        parts = [(length_class(len(s)), np.array([0]), np.array([-1 if score is None else score]))]
    for k, starts, scores in parts:
        starts = starts + m.start()
        ends = starts + (len(s) if whole else LENGTHS[k])
        ends[ends == m.start() + len(s)] = m.end()
        keep = (known[np.searchsorted(known[:, 1], starts, "right"), 0] >= ends) & (scores >= 0)
        if keep.any():
            yield k, starts[keep], ends[keep], scores[keep]


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, end, length class, score class)`` of all parts of the strings tested, apart from known spans."""
    return [
        (a, b, k, score)
        for parts in tested(text)
        for k, *columns in parts
        for a, b, score in zip(*(c.tolist() for c in columns))
    ]


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, with those that overlap or touch made one."""
    done: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if done and a <= done[-1][1]:
            done[-1] = (done[-1][0], max(b, done[-1][1]))
        else:
            done.append((a, b))
    return done


def discoveries(text: str, limits: list[int]) -> list[tuple[int, int]]:
    """``(start, end)`` of the strings, or of the united stretches of a string, that pass."""
    found = []
    for parts in tested(text):
        passed = []
        for k, starts, ends, scores in parts:
            starts, ends = starts[scores <= limits[k]], ends[scores <= limits[k]]
            if len(starts):
                gap = np.flatnonzero(starts[1:] > ends[:-1]) + 1  # in order, of one length
                passed += zip(starts[np.append(0, gap)].tolist(), ends[np.append(gap - 1, -1)].tolist())
        found += united(passed)
    return found


def ordinary_letters(text: str) -> bytes:
    """The letters of the whole text, without the strings that are tested themselves."""
    parts, end = [], 0
    for m in CANDIDATE.finditer(text):
        if any(c.isdigit() for c in m[0]):
            parts.append(text[end : m.start()])
            end = m.end()
    parts.append(text[end:])
    return "".join(parts).encode("utf-8", "replace").translate(None, NOT_LETTERS)


def ordinary_counts(letters: list[bytes]) -> np.ndarray:
    """Counts by (length class, score class) of the consecutive strings of each length of each text's letters."""
    counts = np.zeros((len(LENGTHS), SCORES), np.int64)
    for k, n in enumerate(LENGTHS.tolist()):
        strings = np.frombuffer(b"".join(x[: len(x) // n * n] for x in letters), np.uint8).reshape(-1, n)
        scores = score_classes(strings)
        counts[k] += np.bincount(scores[scores >= 0], minlength=SCORES)
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of candidates (0) and ordinary strings (1) by length and score class, one set for a task.

    A candidate counts ``WHOLE``, or its stretches together do, so that a long one weighs as much as a short one.
    """
    counts = np.zeros((2, len(LENGTHS), SCORES), np.int64)
    letters, held = [], 0
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            for parts in tested(text):
                own = {k: np.bincount(scores, minlength=SCORES) for k, _, _, scores in parts}
                n = int(sum(x.sum() for x in own.values()))
                for k, x in own.items():
                    counts[0, k] += max(1, WHOLE // n) * x
            letters.append(ordinary_letters(text))
            held += len(letters[-1])
            if held >= POOL or len(letters) >= POOL:
                counts[1] += ordinary_counts(letters)
                letters, held = [], 0
    counts[1] += ordinary_counts(letters)
    what, k, score = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int32()) for x in (what, k, score)] + [pa.array(counts[what, k, score])],
        ["what", "length", "score", "n"],
    )


def thresholds(docs: DataFrame, text: str = "text", rate: float = RATE) -> list[int]:
    """For each length class the score class up to which a candidate is a discovery; -1 for none."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = rows.mapInArrow(_counted, "what int, length int, score int, n long")
    table = np.zeros((2, len(LENGTHS), SCORES))
    for r in counts.groupBy("what", "length", "score").agg(F.sum("n").alias("n")).collect():
        table[r["what"], r["length"], r["score"]] = r["n"]
    return benjamini_hochberg(table[0], table[1], rate)


def benjamini_hochberg(found: np.ndarray, null: np.ndarray, rate: float) -> list[int]:
    """Thresholds by length class from counts by (length class, score class)."""
    p = (1 + np.cumsum(null, 1)) / (1 + null.sum(1, keepdims=True))
    order = np.argsort(p, axis=None, kind="stable")
    ranks = np.cumsum(found.ravel()[order])
    total = found.sum()
    passed = (found.ravel()[order] > 0) & (p.ravel()[order] <= rate * ranks / max(total, 1))
    cut = p.ravel()[order][passed].max(initial=-1.0)
    return [int(np.count_nonzero(row <= cut)) - 1 for row in p]


def spans(docs: DataFrame, limits: list[int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)``: array of ``(start, kind, end)`` in characters; ``kind`` indexes ``KINDS``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            out = []
            for value in batch.column(1):
                content = value.as_py()
                known = known_spans(content)
                more = [(a, 3, b) for a, b in discoveries(content, limits)]
                out.append([{"start": a, "kind": kind, "end": b} for a, kind, b in sorted(known + more)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(span))], ["doc_id", "spans"]
            )

    rows = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return rows.mapInArrow(found, "doc_id long, spans array<struct<start:int,kind:int,end:int>>")
