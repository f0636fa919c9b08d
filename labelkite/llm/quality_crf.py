"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its potentials are weights of its own features and of those of the lines
before and after, and of the label of the line before. Lines are learned from document labels: all
lines of a document have its label at first; then lines of bad documents that the field itself finds
good are taken as such, as long as most of the text stays bad. A document's quality is the mean of the
forward-backward marginals of its lines, weighted by length, mapped to a probability by a logistic
curve.

The field is fitted on at most ``per_class`` documents of each label, of which only line features reach
the driver. Scoring is one pass without a shuffle over whole texts.

Nulls: a null text is an empty one; texts without a line that has a character get the share of good
labels. Null, other or conflicting labels are not learned from. Without labelled rows of both kinds
every score is that share, or 0.5. Ids may repeat in the documents: each row has its score. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.llm import bytehash, labelled
from labelkite.llm.words import SOLID, Words

PER_CLASS = 1500
ROUNDS = 120
THRESHOLD = 0.3

SIGNS = b"#$%&*|~^=+_<>@\\/"


def _kinds() -> list[np.ndarray]:
    """Bytes of a kind: lower, upper, digit, ASCII sign, odd sign, bar, exclamation, beyond ASCII, blank."""
    b = np.arange(256)
    lower, upper = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)
    digit = (b >= 48) & (b <= 57)
    return [
        lower, upper, digit, (b > 32) & (b < 127) & ~(lower | upper | digit),
        np.isin(b, list(SIGNS)), b == ord("|"), b == ord("!"), b >= 128, b == 32,
    ]


KINDS = _kinds()


def line_features(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, row and length of each line that is not empty."""
    starts, ends = bytehash.runs(raw != 10, borders)
    size = (ends - starts).astype(float)
    row = np.searchsorted(borders, starts, "right") - 1
    if not len(starts):
        return np.zeros((0, 0)), row, size

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        return (sums[ends] - sums[starts]) / size

    kinds = [share(k) for k in KINDS]
    words = Words.of(raw, borders, SOLID)
    line = np.searchsorted(starts, words.starts, "right") - 1
    n = np.bincount(line, minlength=len(starts))
    some = np.maximum(n, 1)
    again = np.zeros(len(line), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((words.hash, line))
    new = np.ones(len(line), bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=len(starts))
    length = np.bincount(line, words.ends - words.starts, len(starts))
    hashes = bytehash.hashes(raw, starts, ends)
    order = np.lexsort((hashes, row))
    seen = np.zeros(len(starts), bool)
    seen[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    last = raw[ends - 1]
    features = [
        *kinds,
        kinds[1] / np.maximum(kinds[0] + kinds[1], 1e-9),
        np.bincount(line, again, len(starts)) / some,
        distinct / some,
        np.minimum(length / some / 10, 3),
        np.log1p(size) / 5,
        (n <= 2).astype(float),
        np.isin(last, [46, 33, 63]).astype(float),
        seen.astype(float),
    ]
    return np.stack(features, 1), row, size


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and after (0 at a document's ends), and 1."""
    same = row[1:] == row[:-1]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


class Chains:
    """Lines of several documents, one after the other, walked place by place in all of them at once."""

    def __init__(self, row: np.ndarray):
        self.n = len(row)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if self.n else np.zeros(0, int)
        sizes = np.diff(np.concatenate([starts, [self.n]]))
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[order], sizes[order]
        self.longest = int(sizes.max(initial=0))
        # How many documents have more than t lines.
        self.active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(self.longest), "right")
        self.inner = np.flatnonzero(np.concatenate([[False], row[1:] == row[:-1]])) if self.n else starts

    def marginals(self, score: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of label 1 for each line, and of each pair of labels for each line but a first one."""
        unary = np.exp(np.stack([-0.5 * score, 0.5 * score], 1).clip(-30, 30))
        move = np.exp(step)
        ahead, back = unary.copy(), np.ones((self.n, 2))
        for t in range(self.longest):
            at = self.starts[: self.active[t]] + t
            if t:
                ahead[at] *= ahead[at - 1] @ move
            ahead[at] /= ahead[at].sum(1, keepdims=True)
        for t in range(self.longest - 2, -1, -1):
            at = self.starts[: self.active[t + 1]] + t
            b = (unary[at + 1] * back[at + 1]) @ move.T
            back[at] = b / b.sum(1, keepdims=True)
        both = ahead * back
        pairs = ahead[self.inner - 1][:, :, None] * move * (unary[self.inner] * back[self.inner])[:, None, :]
        return both[:, 1] / both.sum(1), pairs / pairs.sum((1, 2), keepdims=True)


@dataclass
class Field:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    slope: float
    shift: float
    empty: float

    def line_chances(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        full = with_neighbours((x - self.mean) / self.spread, row)
        return Chains(row).marginals(full @ self.weights, self.step)[0]

    def means(self, x: np.ndarray, row: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean of the lines' chances of each document, and its length."""
        total = np.bincount(row, size, n)
        good = np.bincount(row, size * self.line_chances(x, row), n) if len(row) else np.zeros(n)
        return good / np.maximum(total, 1), total

    def scores(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        n = len(borders) - 1
        x, row, size = line_features(raw, borders)
        if not len(row):
            return np.full(n, self.empty)
        mean, total = self.means(x, row, size, n)
        z = self.slope * mean + self.shift
        return np.where(total > 0, 1 / (1 + np.exp(-z.clip(-30, 30))), self.empty)


def _descend(params: list[np.ndarray], gradient, rounds: int, rate: float) -> list[np.ndarray]:
    """Adam on a list of arrays; ``gradient`` gives the direction upwards."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        for i, g in enumerate(gradient(params)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params


def fit_field(x: np.ndarray, row: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Fit on lines; ``row`` indexes ``label``, the documents' labels."""
    share = float(label.mean()) if len(label) else 0.5
    if not len(row) or share in (0.0, 1.0):
        width = x.shape[1] if len(row) else len(KINDS) + 8
        base = min(max(share, 1e-6), 1 - 1e-6)
        flat = np.log(base / (1 - base))
        return Field(np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2)), 0.0, flat, share)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    full = with_neighbours((x - mean) / spread, row)
    chains = Chains(row)
    # Both labels weigh the same, whatever their number of lines.
    weight = np.where(label[row] == 1, 1 / max(1, (label[row] == 1).sum()), 1 / max(1, (label[row] == 0).sum()))
    wish = label[row].astype(float)

    def gradient(params):
        weights, step = params
        p, pairs = chains.marginals(full @ weights, step)
        q = np.stack([1 - wish, wish], 1)
        wanted = q[chains.inner - 1][:, :, None] * q[chains.inner][:, None, :]
        return [
            full.T @ (weight * (wish - p)) - 1e-3 * weights,
            ((wanted - pairs) * weight[chains.inner][:, None, None]).sum(0) - 1e-3 * step,
        ]

    params = [np.zeros(full.shape[1]), np.zeros((2, 2))]
    total = np.bincount(row, size, len(label))
    for half in (0, 1):
        params = _descend(params, gradient, rounds // 2, 0.1)
        if half == 0:
            p, _ = chains.marginals(full @ params[0], params[1])
            good = (p > 0.8) & (label[row] == 0)
            mostly = np.bincount(row, size * good, len(label)) <= 0.5 * total
            wish = np.where(good & mostly[row], 1.0, wish)
    field = Field(mean, spread, *params, 1.0, 0.0, share)
    m, total = field.means(x, row, size, len(label))
    m, y = m[total > 0], label[total > 0].astype(float)

    def curve(params):
        error = y - 1 / (1 + np.exp(-(params[0] * m + params[1]).clip(-30, 30)))
        return [np.array((error * m).mean() - 1e-4 * params[0]), np.array(error.mean())]

    slope, shift = _descend([np.array(4.0), np.array(-2.0)], curve, 400, 0.1)
    field.slope, field.shift = float(slope), float(shift)
    return field


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, borders = bytehash.text_bytes(batch.column(1))
        out = []
        for a, b in bytehash.slices(borders):
            x, row, size = line_features(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
            for i in range(b - a):
                mine = row == i
                out.append((x[mine].ravel().tolist(), size[mine].tolist()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([o[0] for o in out], pa.list_(pa.float64())),
                pa.array([o[1] for o in out], pa.list_(pa.float64())),
            ],
            ["doc_id", "label", "features", "sizes"],
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    per_class: int = PER_CLASS,
    most_chars: int | None = labelled.MOST_CHARS,
) -> Field:
    """A field fitted on a bounded sample of the labelled learning rows."""
    chosen = labelled.sample(docs, labels, "quality", per_class, id, text, most_chars)
    rows = chosen.select("doc_id", "text", "label").mapInArrow(
        _features_of, "doc_id long, label int, features array<double>, sizes array<double>"
    )
    found = rows.orderBy("doc_id").toArrow().to_pydict()
    label = np.array(found["label"], np.int64)
    counts = [len(s) for s in found["sizes"]]
    row = np.repeat(np.arange(len(label)), counts)
    size = np.array([s for sizes in found["sizes"] for s in sizes], float)
    flat = np.array([v for f in found["features"] for v in f], float)
    x = flat.reshape(len(row), -1) if len(row) else np.zeros((0, 0))
    return fit_field(x, row, size, label)


def score(text: str, field: Field) -> Column:
    """Quality of each text, from 0 to 1."""

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            raw, borders = bytehash.text_bytes(column)
            parts = [
                field.scores(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
                for a, b in bytehash.slices(borders)
            ]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return scored(F.col(text))


def good_documents(docs: DataFrame, field: Field, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.where(score(text, field) >= threshold)
