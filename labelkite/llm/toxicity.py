"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

Voters are lexicons and patterns. Lexicon entries are words and beginnings of words that the learning
rows' toxic documents have far more often than the others; they are cut into lexicons by
significance, each of which votes on whether a document has one of its entries. Patterns vote on signs
such as shouting or a high share of lexicon words. The label model estimates each voter's accuracy, and
the correlation of voters given the label by latent kinds of documents. Its posterior labels, not the
given ones, train the logistic classifier that scores all texts.

Everything is learned from at most ``per_class`` learning rows of each label; statistics of their words
are summed by Spark, and at most ``ENTRIES`` entries reach the driver. Scoring is one pass without a
shuffle over whole texts.

Nulls: a null text is an empty one and gets the score of a document without any sign. Null, other or
conflicting labels are not learned from; without labelled rows of both kinds, every score is the share
of toxic ones, or 0. Ids may repeat: each row has its score. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.llm import bytehash, labelled
from labelkite.llm.words import ALPHANUMERIC, Words
from labelkite.shared import written

PER_CLASS = 2000
ENTRIES = 512
LEXICONS = 16
BEGINNINGS = range(4, 10)  # bytes
LEAST_DOCS = 4
LEAST_Z = 4.0
LEAST_RATIO = 5.0  # share of toxic documents with an entry by that of the others
ROUNDS = 30
KINDS = 8, 8  # latent kinds of toxic and of other documents
GIVEN = 0.9  # accuracy of the given labels


def entries_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word number and hash of each word, and of each beginning of a longer word."""
    at, found = [np.arange(len(words.hash))], [words.hash]
    for n in BEGINNINGS:
        longer = np.flatnonzero(words.ends - words.starts > n)
        a = words.starts[longer]
        at.append(longer)
        found.append(bytehash.mixed(bytehash.hashes(words.raw, a, a + n) + np.uint64(n)))
    return np.concatenate(at), np.concatenate(found)


def _distinct_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, borders = bytehash.text_bytes(batch.column(0))
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in bytehash.slices(borders):
            words = Words.of(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a], ALPHANUMERIC)
            at, h = entries_of(words)
            row = words.row[at]
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[new].view(np.int64)), pa.array(labels[a:b][row[new]], pa.int32())], ["entry", "label"]
            )


def pattern_signs(raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """By row: share of capitals among letters, exclamation marks and question marks by character."""
    n = np.maximum(np.diff(borders), 1)

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind, dtype=np.int64)])
        return sums[borders[1:]] - sums[borders[:-1]]

    upper = count((raw >= 65) & (raw <= 90))
    lower = count((raw >= 97) & (raw <= 122))
    return np.stack([upper / np.maximum(upper + lower, 1), count(raw == 33) / n, count(raw == 63) / n], 1)


@dataclass
class Lexicon:
    known: np.ndarray  # hashes of the entries, in order
    rank: np.ndarray  # rank of each by significance

    def inputs(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """What voters and classifier see: entries (yes or no), numbers of them, and the signs."""
        words = Words.of(raw, borders, ALPHANUMERIC)
        n = words.per_row()
        there = np.zeros((len(n), len(self.known)))
        hits = np.zeros(len(n))
        if len(self.known):
            at, h = entries_of(words)
            spot = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[spot] == h
            there[words.row[at[hit]], self.rank[spot[hit]]] = 1
            hits = np.bincount(words.row[np.unique(at[hit])], minlength=len(n))
        numbers = [np.log1p(there.sum(1)), np.log1p(hits), np.log1p(100 * hits / np.maximum(n, 1)), np.log1p(n) / 5]
        return np.concatenate([there, np.stack(numbers, 1), pattern_signs(raw, borders)], 1)


def votes(x: np.ndarray, entries: int) -> np.ndarray:
    """0 or 1 of each voter: the lexicons, then the patterns."""
    there, (some, hits, density), signs = x[:, :entries], x[:, entries : entries + 3].T, x[:, entries + 4 :]
    lexicons = [part.any(1) for part in np.array_split(there, LEXICONS, 1)]
    patterns = [
        some > 0, some > np.log(2.5), some > np.log(6.5), hits > np.log(3.5),
        density > np.log1p(0.3), density > np.log1p(0.6), density > np.log1p(1.2),
        signs[:, 0] > 0.5, signs[:, 1] > 0.01, signs[:, 2] > 0.01,
    ]
    return np.stack([*lexicons, *patterns], 1).astype(float)


def posterior_labels(v: np.ndarray, given: np.ndarray, kinds: tuple[int, int] = KINDS, rounds: int = ROUNDS) -> np.ndarray:
    """Chance of a toxic label for each row of votes, by a generative model with correlated voters.

    Documents of a label come in several latent kinds. Within a kind each voter has its own chance to
    vote and votes alone; the kinds make the voters of a label correlated, as lexicons of one language
    are. They start as the documents whose first voter is the same. Chances and kinds are estimated by expectation-maximisation. The given label is one voter more,
    of a fixed accuracy, which ties the kinds to the labels.
    """
    toxic, other = kinds
    first = np.where(v.any(1), v.argmax(1), v.shape[1])
    r = np.zeros((len(v), toxic + other))
    for label, n, start in ((1, toxic, 0), (0, other, toxic)):
        rows = np.flatnonzero(given == label)
        which, place, count = np.unique(first[rows], return_inverse=True, return_counts=True)
        rank = np.empty(len(which), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(which))
        r[rows, start + np.minimum(rank[place], n - 1)] = 1
    is_toxic = np.arange(toxic + other) < toxic
    agrees = is_toxic[None, :] == (given == 1)[:, None]
    says = np.where(agrees, np.log(GIVEN), np.log(1 - GIVEN))
    for _ in range(rounds):
        size = r.sum(0) + 1
        p = ((r.T @ v + 0.1) / (size + 0.2)[:, None]).clip(1e-4, 1 - 1e-4)
        z = v @ np.log(p).T + (1 - v) @ np.log(1 - p).T + np.log(size / size.sum()) + says
        r = np.exp(z - z.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
    return r[:, :toxic].sum(1)


@dataclass
class Scorer:
    lexicon: Lexicon
    weights: np.ndarray
    shift: float

    def scores(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        z = self.shift + self.lexicon.inputs(raw, borders) @ self.weights
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def fit_classifier(x: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic weights for soft targets, by Adam with a little shrinkage."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, s = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        error = target - 1 / (1 + np.exp(-(x @ w + b).clip(-30, 30)))
        g = np.append(x.T @ error / len(x) - 1e-4 * w, error.mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    return w, float(b)


def _lexicon(rows: DataFrame, n_toxic: int, n_other: int) -> Lexicon:
    """The entries that toxic documents have most significantly more often."""
    found = rows.select("text", "label").mapInArrow(_distinct_entries, "entry long, label int")
    counts = found.groupBy("entry").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (n_toxic + 1 - a)) - F.log(b / (n_other + 1 - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    best = (
        counts.where(F.col("a") >= LEAST_DOCS)
        .select("entry", z.alias("z"), (a * (n_other + 1) / (b * (n_toxic + 1))).alias("ratio"))
        .where((F.col("z") >= LEAST_Z) & (F.col("ratio") >= LEAST_RATIO))
        .orderBy(F.desc("z"), "entry")
        .limit(ENTRIES)
        .collect()
    )
    h = np.array([r["entry"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Lexicon(h[order], np.arange(len(h))[order])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    per_class: int = PER_CLASS,
    most_chars: int | None = labelled.MOST_CHARS,
) -> Scorer:
    """A classifier trained on posterior labels of a bounded sample of the learning rows."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~labelled.held_out(id))
    share = known.agg(F.avg("toxic")).first()[0]
    rows = written(labelled.sample(docs, labels, "toxic", per_class, id, text, most_chars), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not n1 or not n0:
        base = min(max(float(share or 0.0), 1e-6), 1 - 1e-6)
        return Scorer(empty, np.zeros(7), float(np.log(base / (1 - base))))
    lexicon = _lexicon(rows, n1, n0)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, borders = bytehash.text_bytes(batch.column(1))
            x = lexicon.inputs(raw, borders)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"]
            )

    table = rows.select("doc_id", "text", "label").mapInArrow(seen, "doc_id long, label int, x array<double>")
    found = table.orderBy("doc_id").toArrow()
    label = found["label"].to_numpy()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(label), -1)
    v = votes(x, len(lexicon.known))
    target = posterior_labels(v, label)
    weights, shift = fit_classifier(x, target)
    # The sample has another share of toxic rows than all learning rows.
    base = min(max(float(share), 1e-6), 1 - 1e-6)
    own = n1 / (n1 + n0)
    shift += float(np.log(base / (1 - base)) - np.log(own / (1 - own)))
    return Scorer(lexicon, weights, shift)


def score(text: str, scorer: Scorer) -> Column:
    """Chance that each text is toxic."""

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            raw, borders = bytehash.text_bytes(column)
            parts = [
                scorer.scores(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
                for a, b in bytehash.slices(borders)
            ]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return scored(F.col(text))
