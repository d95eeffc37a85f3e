"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of whole texts (shares of byte classes, word lengths, repetition, spread of bytes) are
transformed towards normality (logarithms and logits).  Each class has a mean and a covariance that is
shrunk towards the pooled one and its diagonal; a score is the logistic of the difference of Mahalanobis
log-densities, from Cholesky factors that are computed once on the driver and sent with the task.

Sums for the covariances come from every labelled row through Spark's own aggregates, so that fitting has
no sample bound; the driver gets 2 x (d + 1)^2 numbers.

Defined results: a null text scores as an empty one; with fewer than two classes to learn from, every score is the
share of the one there is (0.5 without any).  Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import shingles, text_buffers, word_table

SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.05
#: Densities of many dependent statistics are too sure of themselves; their difference is divided by this.
HEAT = 4.0

#: Classes of bytes: fixed values.
_CLASS = np.zeros(256, np.uint8)
for _c, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), [32], [10, 13, 9], b".", b",", b"!?", b"|", b"#$%&*", b"-'\"();:", range(128, 256)]):
    _CLASS[list(_bytes)] = _c + 1
N_CLASSES = 13
FEATURES = N_CLASSES + 9


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics a text."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float64)
    hashed, start, end, per_text = word_table(data, offsets)
    grams, begin = shingles(hashed, per_text, 3)
    lengths = (end - start).astype(np.float64)
    upper = np.zeros(0)
    if len(start):
        kind = _CLASS[data]
        capital = np.concatenate([[0], np.cumsum(kind == 2)])
        mark = np.concatenate([[0], np.cumsum((kind >= 8) & (kind <= 10))])
        upper = (capital[end] - capital[start]) > 1
        marked = (mark[end] - mark[start]) > 0
    for i in range(n):
        own = data[offsets[i] : offsets[i + 1]]
        size = len(own)
        share = np.bincount(_CLASS[own], minlength=N_CLASSES)[:N_CLASSES]
        out[i, :N_CLASSES] = np.log((share + 0.5) / (size - share + 2.0))
        a, b = per_text[i], per_text[i + 1]
        words = b - a
        out[i, N_CLASSES] = np.log1p(size)
        if not words:
            continue
        own_lengths = lengths[a:b]
        distinct = len(np.unique(hashed[a:b]))
        g = grams[begin[i] : begin[i + 1]]
        repeated = len(g) - len(np.unique(g))
        p = share[share > 0] / size
        loud, odd = upper[a:b].sum(), marked[a:b].sum()
        out[i, N_CLASSES + 1 :] = (
            np.log(own_lengths.mean()),
            np.log1p(own_lengths.std()),
            np.log(own_lengths.max()),
            np.log(distinct / words) + 0.1 * np.log(words),
            np.log((repeated + 0.5) / (len(g) + 1.0)),
            -(p * np.log(p)).sum(),
            np.log((loud + 0.5) / (words - loud + 2.0)),
            np.log((odd + 0.5) / (words - odd + 2.0)),
        )
    return out


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of every text; a map without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1)).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), flat.cast(pa.list_(pa.float32()))], names=[key, "x"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, x array<float>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / HEAT, -700, 700)))


def fit(labelled: DataFrame, label: str = "label") -> Discriminant:
    """From (x, label 0/1) rows; one aggregate that combines before its shuffle."""
    d = FEATURES
    one = F.concat(F.col("x").cast("array<double>"), F.array(F.lit(1.0)))
    flat = labelled.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), one.alias("v"))
    flat = flat.select("label", F.posexplode("v").alias("i", "a"), "v").select("label", "i", *[(F.col("a") * F.col("v")[j]).alias(f"s{j}") for j in range(d + 1)])
    rows = flat.groupBy("label", "i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(d + 1)]).collect()
    sums = np.zeros((2, d + 1, d + 1))
    for r in rows:
        sums[r["label"], r["i"]] = [r[f"s{j}"] for j in range(d + 1)]
    n = sums[:, d, d]
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    if min(n) < 2:
        return Discriminant(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), share)
    means = sums[:, d, :d] / n[:, None]
    covariances = sums[:, :d, :d] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.tensordot(n / n.sum(), covariances, 1)
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - SHRINK_POOLED) * covariances[k] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(constants), share)


def score(rows: DataFrame, model: Discriminant, key: str = "doc_id") -> DataFrame:
    """(key, score) of feature rows."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=[key, "score"])

    return rows.select(key, "x").mapInArrow(run, f"`{key}` {kind}, score double")
