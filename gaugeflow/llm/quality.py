"""Quality classifier by positive-unlabelled learning.

A linear score of text statistics is fitted so that the non-negative unbiased
risk is least: ``prior * loss(P, +) + max(0, loss(U, -) - prior * loss(P, -))``
with trusted positives P, unlabelled web text U and the logistic loss.  Negative
labels are never used.  The score is the logistic of the linear value and so
estimates the probability of label 1.

The class prior is estimated from P and U: a score is fitted on one half of each
to tell them apart, and among the other halves the share of U above a bound by the
share of P above it comes down to the prior where the bound leaves positives
alone; the bound is that of least upper confidence limit.

Only byte and word statistics of the whole text are inputs, scaled by their mean
and deviation over all texts of the training folds.  P is a sample of at most
``positives`` labelled rows of least hash.  U is all texts of the training folds,
dealt into blocks of about ``unlabelled`` rows: a task estimates the prior and fits
a model on a block, and the mean of the models by rows is the model.  Every text is
scored.

Defined results: null and empty texts have the statistics of no words and get a
score like any other; documents whose id is null are scored, belong to remainder
0 and are never fitted on; labels without a document and null labels are ignored;
without training labels every score is 0.5, without one of 1 among them every score
is 0; repeated rows get equal scores; a column named as the score's gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.words import NOT_SPACE, Words, column_bytes, grams

#: Labelled rows of a sample, and unlabelled rows of a block.
POSITIVES, UNLABELLED = 8_000, 16_000
FOLDS = 5
THRESHOLD = 0.3

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_PUNCT = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
#: Bytes per histogram slice; bounds the temporary arrays.
_SLICE = 1 << 19
N_SHAPE = 12


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics per text: word shape and repetition, then the share of each byte."""
    rows = len(offsets) - 1
    seen = np.zeros((rows, 256), np.float64)
    for low in range(0, len(data), _SLICE):
        high = min(len(data), low + _SLICE)
        first, last = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
        size = np.diff(np.clip(offsets[first : last + 1], low, high))
        place = np.repeat(np.arange(last - first) << 8, size)
        seen[first:last] += np.bincount(place + data[low:high], minlength=(last - first) << 8).reshape(-1, 256)
    words = Words(data, offsets, NOT_SPACE)
    count = words.counts()
    three, row = grams(words.hash, 3), words.row_of()
    again = np.zeros(len(words.hash), bool)
    if len(again) > 1:
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[again], minlength=rows)
    distinct, most, runs = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for r in np.flatnonzero(count):
        begin, end = words.first[r], words.first[r + 1]
        ordered = np.sort(words.hash[begin:end])
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        distinct[r], most[r] = len(edge) - 1, np.diff(edge).max()
        if end - begin > 2:
            runs[r] = 1 - len(np.unique(three[begin : end - 2])) / (end - begin - 2)
    some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    letters = seen[:, _UPPER].sum(1) + seen[:, _LOWER].sum(1)
    spaces = seen[:, 32] + seen[:, 9:14].sum(1)
    shape = np.stack(
        [
            np.log1p(count),
            np.log1p((size - spaces) / some),
            distinct / some,
            most / some,
            repeats / some,
            runs,
            seen[:, _UPPER].sum(1) / np.maximum(letters, 1),
            np.log1p(seen[:, _PUNCT].sum(1) / some),
            seen[:, _DIGIT].sum(1) / size,
            seen[:, 10] / some,
            seen[:, 128:].sum(1) / size,
            letters / size,
        ],
        1,
    )
    return np.concatenate([shape, np.sqrt(seen / size[:, None])], 1).astype(np.float32)


@dataclass
class Model:
    """Scores features; ``prior`` and ``risk`` tell how it was fitted."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float
    risk: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -6, 6) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    mean: np.ndarray,
    deviation: np.ndarray,
    *,
    steps: int = 400,
    rate: float = 0.02,
    decay: float = 1e-3,
) -> Model:
    """Minimise the non-negative risk by full gradient steps.

    Where the negative part of the risk falls below 0 its gradient is reversed,
    which undoes the over-fit that drove it there.
    """
    scale = 1 / np.maximum(deviation, 1e-4)
    p, u = (np.clip((x - mean) * scale, -6, 6) for x in (positive, unlabelled))
    weight, bias = np.zeros(p.shape[1], np.float32), np.log(prior / (1 - prior))
    m, v = np.zeros(len(weight) + 1), np.zeros(len(weight) + 1)
    risk = 0.0
    for step in range(1, steps + 1):
        gp, gu = p @ weight + bias, u @ weight + bias
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        plus = prior * np.logaddexp(0, -gp).mean()
        minus = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        risk = plus + max(0.0, minus)
        dp_plus, dp_minus, du = prior * (sp - 1) / len(p), -prior * sp / len(p), su / len(u)
        if minus >= 0:
            dp = dp_plus + dp_minus
        else:
            dp, du = -dp_minus, -du
        grad = np.append(p.T @ dp.astype(np.float32) + u.T @ du.astype(np.float32) + decay * weight, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1].astype(np.float32), bias - move[-1]
    return Model(mean, scale, weight, float(bias), float(prior), float(risk))


def _above(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The share of ``scores`` at or above each of ``bounds``."""
    return 1 - np.searchsorted(np.sort(scores), bounds, "left") / len(scores)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> float:
    """The share of positives among ``unlabelled``, from 0.01 to 0.99; of few rows all are in both halves."""
    half = lambda x: (x[::2], x[1::2]) if len(x) >= 40 else (x, x)
    (p, own), (u, other) = half(positive), half(unlabelled)
    model = fit(p, u, 0.5, mean, deviation)
    bounds = np.unique(model.score(own))
    in_p, in_u = _above(model.score(own), bounds), _above(model.score(other), bounds)
    # the confidence limits of both shares at a level of 0.1
    slack = np.sqrt(np.log(40) / 2 / len(own)) + np.sqrt(np.log(40) / 2 / len(other))
    best = np.argmin((in_u + slack) / in_p)
    return float(np.clip(in_u[best] / in_p[best], 0.01, 0.99))


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; 0 is held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % FOLDS, F.lit(0))


def _rows_of(batch: list[bytes]) -> np.ndarray:
    """Features from their bytes, in an order that doesn't depend on that of the rows."""
    return np.frombuffer(b"".join(sorted(batch)), np.float32).reshape(len(batch), N_SHAPE + 256)


def _as_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([r.tobytes() for r in features(*column_bytes(texts))], pa.binary())


def _sampled_features(docs: DataFrame, chosen: DataFrame) -> np.ndarray:
    """Features of the documents whose ids are in ``chosen``, a bounded list; one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_as_bytes(batch.column(0))], names=["x"])

    texts = docs.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))
    return _rows_of(texts.select("__text").mapInArrow(run, "x binary").toArrow().column("x").to_pylist())


def _exact(c: str) -> Column:
    """A sum that doesn't depend on the order of the tasks."""
    return F.sum(F.col(c).cast("decimal(28,12)")).cast("double")


def _moments(texts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and population deviation of the features of all ``texts``, one column, in one aggregate."""
    width = N_SHAPE + 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, width)), 0
        for batch in batches:
            x = features(*column_bytes(batch.column(0))).astype(np.float64)
            total += np.stack([x.sum(0), (x * x).sum(0)])
            n += len(x)
        if n:
            columns = [np.arange(width), np.full(width, n), total[0], total[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "n", "one", "two"])

    sums = texts.mapInArrow(run, "place long, n long, one double, two double").groupBy("place")
    rows = sums.agg(F.sum("n").cast("double"), _exact("one"), _exact("two")).orderBy("place").collect()
    if not rows:
        return 0, np.zeros(width, np.float32), np.zeros(width, np.float32)
    _, n, one, two = np.array(rows, np.float64).T
    mean = one / n
    return int(n[0]), mean.astype(np.float32), np.sqrt(np.maximum(two / n - mean**2, 0)).astype(np.float32)


def _fitted(texts: DataFrame, positive: np.ndarray, blocks: int, mean: np.ndarray, deviation: np.ndarray) -> Model:
    """The mean of the models fitted on the blocks of ``texts`` (__id, __text)."""
    sent = texts.sparkSession.sparkContext.broadcast((positive, mean, deviation))  # ``positives`` rows at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_bytes(batch.column(1))], names=["block", "x"])

    def fit_block(block: pa.Table) -> pa.Table:
        p, *scaling = sent.value
        u = _rows_of(block.column("x").to_pylist())
        model = fit(p, u, estimated_prior(p, u, *scaling), *scaling)
        values = np.array([*model.weight, model.bias, model.prior, model.risk], np.float64) * len(u)
        return pa.table({"place": np.arange(len(values)), "n": np.full(len(values), len(u)), "value": values})

    # the number of a row spreads those of one id
    block = F.pmod(F.xxhash64("__id", F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
    rows = texts.select(block, "__text").mapInArrow(measure, "block long, x binary").repartition(blocks, "block")
    found = rows.groupBy("block").applyInArrow(fit_block, "place long, n long, value double")
    sums = found.groupBy("place").agg(F.sum("n").cast("double"), _exact("value")).orderBy("place").collect()
    _, n, value = np.array(sums, np.float64).T
    *weight, bias, prior, risk = (value / n).tolist()
    return Model(mean, 1 / np.maximum(deviation, 1e-4), np.array(weight, np.float32), bias, prior, risk)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> Model | float:
    """A model fitted on the training folds; without one to fit, the score of all texts."""
    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    ids = lambda df: df.where((fold(F.col("__id")) != 0) & F.col("__id").isNotNull())
    known = ids(labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")))
    known = known.where(F.col("__label").isNotNull())
    least = known.where("__label = 1").select("__id").distinct().join(ids(named.select("__id")), "__id", "left_semi")
    p = _sampled_features(named, least.orderBy(F.xxhash64("__id"), "__id").limit(positives))
    if not len(p):
        return 0.5 if known.join(named, "__id", "left_semi").isEmpty() else 0.0
    n, mean, deviation = _moments(ids(named).select("__text"))
    return _fitted(ids(named), p, max(1, round(n / unlabelled)), mean, deviation)


def scored(docs: DataFrame, model: Model | float, *, text_col: str = "text", score_col: str = "__score") -> DataFrame:
    """``docs`` with a score of each whole text in ``score_col``."""
    docs = docs.drop(score_col)
    if isinstance(model, float):
        return docs.withColumn(score_col, F.lit(model))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(features(*column_bytes(batch.column(at))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, score_col]
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{columns}, {score_col} double")


def report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(light, model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model | float, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = scored(plain, model, text_col=f"c{docs.columns.index(text_col)}")
    return found.where(F.col("__score") >= threshold).select(*plain.columns).toDF(*docs.columns)
