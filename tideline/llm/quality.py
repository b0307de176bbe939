"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train an additive model: every feature of a text is
cut into quantile bins, each bin has a weight, and the sum goes through the logistic
function. The weights minimise the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the sigmoid loss, which bounds what a single text adds: where the second term falls below zero the step goes back along it.
The class prior is estimated from the same data: a first model tells positives from
unlabelled text, and where it finds positives densest the ratio of the two densities,
unlabelled over positive, is the prior. Each half of the rows is judged by the other half's
model, as a model finds the rows that it was fitted to denser than they are.

Features are computed by one pass over the texts; only a bounded sample of feature rows
(``max_rows`` positives and as many unlabelled) is fitted, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import NOT_BLANK, pieces
from tideline.session import materialise

BINS = 16
#: Feature rows of each kind that are fitted.
MAX_ROWS = 20_000
STEPS = 600
RATE = 0.05
#: Decay of the weights, over the number of positives.
DECAY = 0.25

_UPPER, _LOWER_CASE, _DIGIT, _END, _COMMA, _SYMBOL, _FEED, _BEYOND = range(8)
_KIND = np.full(256, _SYMBOL)
_KIND[0x41:0x5B] = _UPPER
_KIND[0x61:0x7B] = _LOWER_CASE
_KIND[0x30:0x3A] = _DIGIT
_KIND[[ord(c) for c in ".?"]] = _END
_KIND[[ord(c) for c in ",;:'\"()-"]] = _COMMA
_KIND[[0x20, 0x09]] = -1
_KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = _FEED
_KIND[0x80:] = _BEYOND

FEATURES = (
    "bytes words upper lower digit end comma symbol feed beyond word_size sentence_words repeated "
    "distinct most_common pair_distinct longest_word symbol_words single_words"
).split()


def _share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    return part / np.maximum(of, 1)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return np.diff(sums[offsets])


def _distinct(text: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its most common one occurs."""
    most, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(values):
        order = np.lexsort((values, text))
        text, values = text[order], values[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (values[1:] != values[:-1])]))
        np.maximum.at(most, text[new], np.diff(np.append(new, len(text))))
        distinct = np.bincount(text[new], minlength=n)
    return distinct, most


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for every text."""
    out = [np.empty((0, len(FEATURES)), np.float32)]
    for first, end, words in pieces(texts, NOT_BLANK, lower=False):
        n = end - first
        offsets = words.offsets
        kind = _KIND[words.data]
        size = np.diff(offsets)
        counts = [_per_text(kind == k, offsets) for k in range(8)]
        count = words.counts
        text = np.repeat(np.arange(n), count)
        hashes = words.hashes()
        inside = text[1:] == text[:-1]
        repeated = np.bincount(text[1:][inside & (hashes[1:] == hashes[:-1])], minlength=n)
        distinct, most = _distinct(text, hashes, n)
        pairs = (hashes[:-1] * np.uint64(3) + hashes[1:])[inside]
        pair_distinct, _ = _distinct(text[1:][inside], pairs, n)
        length = words.ends - words.starts
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, text, length)
        last = kind[words.ends - 1] if len(length) else np.empty(0, int)
        symbol_words = np.bincount(text[last == _SYMBOL], minlength=n)
        single = np.bincount(text[length == 1], minlength=n)
        letters = counts[_UPPER] + counts[_LOWER_CASE] + counts[_BEYOND]
        out.append(
            np.column_stack(
                [
                    np.log1p(size),
                    np.log1p(count),
                    _share(counts[_UPPER], letters),
                    _share(counts[_LOWER_CASE], size),
                    _share(counts[_DIGIT], size),
                    _share(counts[_END], count),
                    _share(counts[_COMMA], count),
                    _share(counts[_SYMBOL], size),
                    _share(counts[_FEED], count),
                    _share(counts[_BEYOND], size),
                    _share(np.bincount(text, weights=length, minlength=n), count),
                    np.log1p(_share(count, counts[_END])),
                    _share(repeated, count),
                    _share(distinct, np.power(np.maximum(count, 1), 0.8)),
                    _share(most, count),
                    _share(pair_distinct, count),
                    np.log1p(longest),
                    _share(symbol_words, count),
                    _share(single, count),
                ]
            ).astype(np.float32)
        )
    return np.concatenate(out)


@dataclass
class Model:
    """Weights of the bins; ``edges`` cut each feature."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, features: np.ndarray) -> np.ndarray:
        cut = [np.searchsorted(e, column) for e, column in zip(self.edges, features.T, strict=True)]
        return np.column_stack(cut) if len(features) else np.empty((0, len(self.edges)), int)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[np.arange(len(self.edges)), bins].sum(axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return _logistic(self.margin(self.bins(features)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(model: Model, parts, decay: float) -> None:
    """Adam over the weights; ``parts(margins)`` gives the loss gradients of both samples' margins."""
    size = model.weights.size
    flat = np.append(model.weights.reshape(-1), model.bias)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        gradient = parts(flat)
        gradient[:size] += decay * flat[:size]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        flat = flat - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = flat[:size].reshape(model.weights.shape), float(flat[size])


def _gradient(places: np.ndarray, slope: np.ndarray, size: int) -> np.ndarray:
    """Gradient over weights and bias of a mean of losses with the given slopes of the margin."""
    slope = slope / max(1, len(slope))
    weights = np.bincount(places.reshape(-1), np.repeat(slope, places.shape[1]), minlength=size)
    return np.append(weights[:size], slope.sum())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Model for feature rows of positives and of unlabelled texts; the prior is estimated if not given."""
    both = np.concatenate([positive, unlabelled])
    if not len(both):
        both = np.zeros((1, len(FEATURES)), np.float32)
    grid = np.arange(1, BINS) / BINS
    # half of the cuts stand in the outer tenths, where junk differs
    grid = np.unique(np.concatenate([grid, [0.01, 0.02, 0.03, 0.05, 0.08, 0.92, 0.95, 0.97, 0.98, 0.99]]))
    edges = np.quantile(both, grid, axis=0).T
    width = edges.shape[1] + 1
    model = Model(edges, np.zeros((edges.shape[0], width)), 0.0, 0.5)
    if not len(positive) or not len(unlabelled):
        return model
    shift = np.arange(edges.shape[0]) * width
    p, u = model.bins(positive) + shift, model.bins(unlabelled) + shift
    if prior is None:
        judged = []
        for half in (0, 1):
            _tell_apart(model, p[half::2], u[half::2])
            flat = np.append(model.weights.reshape(-1), model.bias)
            judged.append([flat[rows[1 - half :: 2]].sum(axis=1) + flat[-1] for rows in (p, u)])
        prior = float(np.mean([_prior(*halves) for halves in judged]))
    model.prior = prior
    size = model.weights.size

    def risk(flat: np.ndarray) -> np.ndarray:
        at_p, at_u = flat[p].sum(axis=1) + flat[-1], flat[u].sum(axis=1) + flat[-1]
        p_good, u_good = _logistic(at_p), _logistic(at_u)
        away = _gradient(u, u_good * (1 - u_good), size) - prior * _gradient(p, p_good * (1 - p_good), size)
        if u_good.mean() - prior * p_good.mean() < 0:
            return -away
        return away - prior * _gradient(p, p_good * (1 - p_good), size)

    model.weights[:], model.bias = 0, 0.0
    _descend(model, risk, DECAY / len(p))
    return model


def _tell_apart(model: Model, p: np.ndarray, u: np.ndarray) -> None:
    """Fit the model to positives against unlabelled texts."""
    size = model.weights.size

    def loss(flat: np.ndarray) -> np.ndarray:
        at_p, at_u = flat[p].sum(axis=1) + flat[-1], flat[u].sum(axis=1) + flat[-1]
        return _gradient(p, -_logistic(-at_p), size) + _gradient(u, _logistic(at_u), size)

    model.weights[:], model.bias = 0, 0.0
    _descend(model, loss, 64 * DECAY / max(1, len(p)))


def _prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of the shares of unlabelled and positive texts above a cut that 3 of 10 positives pass."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0.02, 0.7, 18))
    above_u = np.array([(unlabelled >= c).mean() for c in cuts])
    above_p = np.array([(positive >= c).mean() for c in cuts])
    return float(np.clip((above_u / above_p).min(), 0.01, 0.99))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id, as text, leaves 1 when divided by 3."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(F.encode(text, "UTF-8")) % 3 == 1, F.lit(False))


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = text_features(batch.column(1))
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))], names=["doc_id", "features"]
        )


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, features) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_with_features, f"doc_id {kind}, features array<float>")


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Feature rows, by hash of the id at most about ``most`` of them."""
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < (most << 20) // n)
    found = rows.select("features").toArrow()["features"].combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def train(features: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows that are not held out: labels.quality = 1 is positive, all texts are unlabelled.

    Rows without an id are not learnt from; labels that repeat or contradict each other count
    as positive if any of them does; without positives or texts every score is 0.5.
    """
    seen = features.where(F.col("doc_id").isNotNull() & ~held_out())
    trusted = labels.where("quality = 1").select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).distinct()
    positive = _sample(seen.join(trusted, "doc_id", "left_semi"), max_rows)
    return fit(positive, _sample(seen, max_rows))


def _score(shared):
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(shared.value.score(text_features(batch)), pa.float64())

    return score


def _score_features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.score(rows), pa.float64())], names=["doc_id", "score"]
            )

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    The score depends on the text alone; null is scored as the empty text. A null doc_id is
    not held out. An empty table gives no rows. Other columns are not read.
    """
    features = materialise(feature_table(docs))
    shared = docs.sparkSession.sparkContext.broadcast(train(features, labels, max_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = features.mapInArrow(_score_features(shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts."""
    features = materialise(feature_table(docs))
    shared = docs.sparkSession.sparkContext.broadcast(train(features, labels, max_rows))
    # only the text goes to Python, and only the score comes back
    return docs.where(_score(shared)(F.col("text")) >= 0.5)
