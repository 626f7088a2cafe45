"""Quality classifier learned from trusted positives and unlabelled text.

A small network is trained with the non-negative unbiased risk of positive-unlabelled learning: the risk on negatives is
the risk of unlabelled text less the positives' share of it, and is kept from falling below zero. The class prior comes
from the best bin: the share of unlabelled text above a score, divided by the share of held-back positives above it.
Negative labels are never read. Features are computed from whole texts; only the fit uses a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from matchloom.llm.common import encoded, give_back, pieces, small_batches, until_end
from matchloom.session import materialise

#: Bounds of the fitted sample: rows of trusted positives and of unlabelled text.
MAX_POSITIVE, MAX_UNLABELLED = 20_000, 40_000
THRESHOLD = 0.7
HELD_OUT = 2

# character classes: lower, upper, beyond ASCII, digit, blank, line end, sentence marks, other symbols
_CLASSES = 8
_CLASS = np.full(256, 7, dtype=np.uint8)
for _code, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _CLASS[list(_chars)] = _code
_CLASS[128:] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t")] = 4
_CLASS[list(b"\n\r\x0b\x0c")] = 5
_CLASS[list(b".,;:'\"?-()")] = 6


def _features(text: str | None) -> np.ndarray:
    data = encoded(text)
    steps = np.zeros(_CLASSES * _CLASSES)
    words = distinct = repeats = lines = distinct_lines = packed = distinct_pairs = top = 0
    for piece in pieces(data):
        kinds = _CLASS[np.frombuffer(piece, dtype=np.uint8)]
        steps += np.bincount(kinds[:-1] * np.uint8(_CLASSES) + kinds[1:], minlength=len(steps))
        found = piece.split()
        words += len(found)
        distinct += len(set(found))
        repeats += sum(map(eq, found, found[1:]))
        distinct_pairs += len(set(zip(found, found[1:])))
        rows = piece.split(b"\n")
        lines += len(rows)
        distinct_lines += len(set(rows))
        top += max(map(len, rows))
        packed += len(zstandard.ZstdCompressor(level=1).compress(piece))
    n = max(len(data), 1)
    w = max(words, 1)
    extra = [np.log1p(words), np.log1p(len(data)), len(data) / w / 10, distinct / w, repeats / w, distinct_pairs / w]
    extra += [np.log1p(lines), distinct_lines / max(lines, 1), packed / n, top / n, np.log1p(w / max(distinct, 1))]
    return np.concatenate([np.sqrt(steps / max(steps.sum(), 1)), extra]).astype(np.float32)


def features(text: Column | str) -> Column:
    """Shares of character class pairs, word and line repetition and length of a whole text, as array<float>."""

    @pandas_udf("array<float>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in until_end(batches):
            yield pd.Series([_features(t) for t in texts], dtype=object)

    return compute(text)


@dataclass(frozen=True)
class Model:
    """Network of one hidden layer over standardised features, and the prior it was trained with."""

    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self.layers, _standard(rows, self.mean, self.scale))[1])


def _standard(rows, mean, scale):
    return np.clip((rows - mean) / scale, -8, 8)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(layers, rows):
    w1, b1, w2, b2 = layers
    hidden = np.maximum(rows @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2[0]


def _train(positive, unlabelled, prior, seed, steps=1200, hidden=32, batch=1024, rate=3e-3, decay=1e-4):
    """Minimise the non-negative risk; with ``prior`` None the two samples are merely told apart."""
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    layers = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden)]
    layers += [rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(batch, len(positive)))]
        u = unlabelled[rng.integers(0, len(unlabelled), min(batch, len(unlabelled)))]
        rows = np.concatenate([p, u])
        hid, z = _forward(layers, rows)
        zp, zu = z[: len(p)], z[len(p) :]
        if prior is None:
            slope = np.concatenate([-_sigmoid(-zp) / len(p), _sigmoid(zu) / len(u)])
        else:
            as_negative = np.concatenate([-prior * _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)])
            risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if risk < 0:  # step back up instead of fitting below zero
                slope = -as_negative
            else:
                slope = as_negative
                slope[: len(p)] -= prior * _sigmoid(-zp) / len(p)
        back = np.outer(slope, layers[2]) * (hid > 0)
        grads = [rows.T @ back + decay * layers[0], back.sum(0), hid.T @ slope + decay * layers[2], slope.sum(keepdims=True)]
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def estimate_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray) -> float:
    """Best bin estimate: least ratio of the unlabelled to the positive share above a score, with a margin for small bins."""
    cuts = np.quantile(positive_scores, np.linspace(0, 0.95, 96))
    p = np.array([(positive_scores >= c).mean() for c in cuts])
    u = np.array([(unlabelled_scores >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive_scores)) + 1 / np.sqrt(len(unlabelled_scores)))
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> Model:
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = _standard(positive, mean, scale), _standard(unlabelled, mean, scale)
    apart = _train(p[::2], u[::2], None, seed, steps=400)
    back_p, back_u = p[1::2] if len(p) > 1 else p, u[1::2] if len(u) > 1 else u
    prior = estimate_prior(_forward(apart, back_p)[1], _forward(apart, back_u)[1])
    return Model(mean, scale, _train(p, u, prior, seed), prior)


def _sample(rows: DataFrame, bound: int, salt: int) -> np.ndarray:
    """At most ``bound`` feature rows, chosen by a hash of the doc_id, about all of them if there are fewer."""
    count = rows.count()
    if not count:
        return np.zeros((0, 1))
    share = min(1.0, 1.1 * bound / count)
    rank = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 40))
    some = rows.withColumn("_rank", rank).where(F.col("_rank") <= int(share * (1 << 40)))
    got = some.orderBy("_rank", "doc_id").limit(bound).select("features").toArrow()  # as floats: as rows it takes ten times as much
    if not got.num_rows:
        return np.zeros((0, 1))
    values = np.concatenate([np.asarray(part.flatten()) for part in got.column(0).chunks])
    return values.reshape(got.num_rows, -1).astype(np.float64)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label is learned from: crc32 of the doc_id as text leaves 2 modulo 4; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame) -> Model | None:
    """Fit from ``measured`` (doc_id, features) and ``labels`` (doc_id, quality), both outside the held-out fold. Trusted
    positives are documents labelled 1 and never otherwise. None if there is no positive or no document."""
    open_rows = measured.where("doc_id is not null").where(~held_out())
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    positive = _sample(open_rows.join(trusted, "doc_id"), MAX_POSITIVE, 1)
    unlabelled = _sample(open_rows, MAX_UNLABELLED, 2)
    model = fit_arrays(positive, unlabelled) if len(positive) and len(unlabelled) else None
    del positive, unlabelled
    give_back()  # the driver lives on, too
    return model


def score_column(model: Model | None, column: str = "features") -> Column:
    """Score of a feature array, 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    @pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows.to_numpy()).astype(np.float64)) if len(rows) else [], dtype="float64")

    return score(F.col(column))


def text_score_column(model: Model, text: Column | str) -> Column:
    """Score of a text: features and network in one worker, so that no second one is held beside it."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in until_end(batches):
            rows = [_features(t) for t in texts]
            yield pd.Series(model.score(np.stack(rows).astype(np.float64)) if rows else [], dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``, repeated ones included.

    Null and empty texts are scored as empty texts. Without positive labels every score is 0.5. An empty table gives an
    empty result. Columns other than doc_id and text are not read.
    """
    measured = materialise(small_batches(docs).select("doc_id", features("text").alias("features")), "features")
    model = fit(measured, labels)
    scored = measured.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold; all rows if there is nothing to learn from."""
    model = fit(materialise(small_batches(docs).select("doc_id", features("text").alias("features")), "features"), labels)
    if model is None:
        return docs
    return docs.where(text_score_column(model, F.col("text")) >= THRESHOLD)
