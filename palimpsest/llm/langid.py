"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte n-grams of lower-cased text in which digits, marks and blanks count as
one blank symbol.  Each hashes to a row of an embedding table; a text is the mean of its rows;
a linear softmax on that mean gives the languages.  Both tables are trained together by
stochastic gradient descent in numpy.  As the model is linear in the mean, embedding and
softmax fold into one table of logits a bucket, which is all that prediction needs.

Calibration: a temperature fitted on samples that training didn't see, then a rejection
threshold: the QUANTILE-th score of their right predictions, at most CEILING.  A prediction
below the threshold, or one of `und`, is rejected.

Training takes a bounded sample: the TRAIN_DOCS rows with the smallest hash of their key and text.  Tasks count the n-grams of their
whole texts; the driver gets these counts, packed.  Half of the steps take whole texts, the others draws of a few n-grams of
them, so that short texts are known as well.  Prediction reads whole texts.

Defined results: a null text, or one without letters, is `und` with score 0; so is every text when
there is nothing to learn from.  Rows that repeat are predicted each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, tidy
from .words import text_buffers

TRAIN_DOCS = 2000
LEAST_STEPS = 400
BUCKETS = 1 << 15
WIDTH = 16
ORDERS = (3, 4, 5)
QUANTILE = 0.001
CEILING = 0.4

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:256] = np.arange(128, 256)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that begins at each byte, for each order; n-grams past the end wrap onto blanks."""
    folded = _FOLD[data]
    if len(data) > 1:  # upper-case letters of the Latin-1 block, in UTF-8
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][upper] += 32
    padded = np.concatenate([folded, np.full(max(ORDERS), 32, np.uint32)])
    out, rolled = [], np.zeros(len(data), np.uint32)
    for j in range(max(ORDERS)):
        rolled = rolled * np.uint32(0x01000193) + padded[j : j + len(data)] + np.uint32(1)
        if j + 1 in ORDERS:
            mixed = rolled ^ (rolled >> np.uint32(15))
            mixed *= np.uint32((0x9E3779B1 + 2 * j) & 0xFFFFFFFF)
            out.append((mixed >> np.uint32(17)).astype(np.int32))
    return out


#: One n-gram bucket of a text and how often it stands there.
_COUNT = np.dtype([("gram", "<u2"), ("times", "<u4")])


def counts(data: np.ndarray) -> np.ndarray:
    """The n-gram counts of one text, by bucket; long texts in pieces, which share no n-gram."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), 1 << 18):
        for g in grams(data[at : at + (1 << 18)]):
            total += np.bincount(g, minlength=BUCKETS)
    some = np.flatnonzero(total)
    out = np.zeros(len(some), _COUNT)
    out["gram"], out["times"] = some, total[some]
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, packed counts, h) of (lang, text, h) rows."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        packed = [zlib.compress(counts(data[b:e]).tobytes(), 1) for b, e in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["lang", "grams", "h"])


@dataclass
class Model:
    """What prediction needs: languages, logits of each bucket, the softmax's bias, the threshold."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    threshold: float


def fit(rows: Iterable[tuple[str, np.ndarray]], seed: int = 7, epochs: int = 4, rate: float = 0.5, batch: int = 32) -> Model:
    """Trains on (language, n-gram counts) rows; every fifth row calibrates."""
    # of each text its buckets and the running share of its n-grams that they hold
    rows = [(lang, g["gram"].copy(), (np.cumsum(g["times"], dtype=np.float64) / g["times"].sum(dtype=np.float64)).astype(np.float32)) for lang, g in rows if len(g)]
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    random = np.random.default_rng(seed)
    label = np.array([languages.index(lang) for lang, _, _ in rows])
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 25 else np.zeros(len(rows), bool)
    embed = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight = random.normal(0, 0.3, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    train = np.flatnonzero(~held)
    # small samples are gone through more often
    epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(train), 1)))
    steps = epochs * -(-len(train) // batch)
    step = 0
    for _ in range(epochs):
        order = random.permutation(train)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            lr = rate * (1 - step / steps)
            step += 1
            # whole texts, or draws of many lengths
            whole = random.random() < 0.5
            pieces, weights = [], []
            for i in pick:
                if whole:
                    pieces.append(rows[i][1])
                    weights.append(np.diff(rows[i][2], prepend=np.float32(0)))
                else:
                    n = int(2 ** random.uniform(3, 9))
                    pieces.append(_drawn(rows[i], random.random(n)))
                    weights.append(np.full(n, 1 / n))
            sizes = np.array([len(p) for p in pieces])
            flat, share = np.concatenate(pieces), np.concatenate(weights).astype(np.float32)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(embed[flat] * share[:, None], begin, axis=0)
            z = mean @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), label[pick]] -= 1
            p /= len(pick)
            back = p @ weight.T
            weight -= lr * (mean.T @ p)
            bias -= lr * p.sum(0)
            spread = np.repeat(back.astype(np.float32), sizes, axis=0) * share[:, None]
            order_in = np.argsort(flat, kind="stable")
            flat_in = flat[order_in]
            cut = np.flatnonzero(np.concatenate([[True], flat_in[1:] != flat_in[:-1]]))
            # the rate of embeddings counts texts, not n-grams
            embed[flat_in[cut]] -= lr * len(pick) * np.add.reduceat(spread[order_in], cut, axis=0) * 8
    logits = embed @ weight
    check = np.flatnonzero(held) if held.any() else train
    z = np.zeros((len(check), len(languages)))
    for j, i in enumerate(check):  # short draws and whole texts in turn
        if j % 2:
            z[j] = logits[_drawn(rows[i], random.random(max(8, 24 * (j % 8))))].mean(0) + bias
        else:
            z[j] = np.diff(rows[i][2], prepend=np.float32(0)) @ logits[rows[i][1]] + bias
    best, heat = np.inf, 1.0
    for t in np.geomspace(0.2, 8, 40):
        y = z / t
        y = y - y.max(1, keepdims=True)
        loss = -(y[np.arange(len(check)), label[check]] - np.log(np.exp(y).sum(1))).mean() + 1e-6 * abs(np.log(t))
        if loss < best:
            best, heat = loss, t
    y = z / heat
    p = np.exp(y - y.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == label[check]
    threshold = min(CEILING, float(np.quantile(p.max(1)[right], QUANTILE))) if right.any() else CEILING
    return Model(languages, (logits / heat).astype(np.float32), (bias / heat).astype(np.float32), threshold)


def _drawn(row: tuple[str, np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """n-grams of a text at random places from 0 to 1."""
    return row[1][np.minimum(np.searchsorted(row[2], at), len(row[1]) - 1)]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits a model on the bounded sample of rows with a text and a language."""
    rows = docs.filter(F.col(text).isNotNull() & (F.length(text) > 0) & F.col(lang).isNotNull())
    rows = rows.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    # about TRAIN_DOCS rows have a hash below this bound, so that few others are counted; a margin makes sure of enough
    n = rows.count()
    share = min(1.0, 1.2 * (TRAIN_DOCS + 200) / max(n, 1))
    rows = rows.filter(F.col("h") <= int((1 << 64) * share) - (1 << 63) - 1)
    last = rows.select("h").orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).collect()[0][0]
    if last is None:
        return fit([])
    picked = rows.filter(F.col("h") <= last).select("lang", "text", "h").mapInArrow(_count_grams, "lang string, grams binary, h long").collect()
    picked = sorted(picked, key=lambda r: (r["h"], r["lang"]))[:TRAIN_DOCS]
    model = fit((r["lang"], np.frombuffer(zlib.decompress(r["grams"]), _COUNT)) for r in picked)
    del picked
    release()
    return model


def scores(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and calibrated score of each text of a column."""
    data, offsets = text_buffers(column)
    n, width = len(offsets) - 1, len(model.languages)
    best, score = np.zeros(n, np.int64), np.zeros(n)
    if not width:
        return ["und"] * n, score
    for i in range(n):
        own = data[offsets[i] : offsets[i + 1]]
        total = np.zeros(width, np.float64)
        count = 0
        for at in range(0, len(own), 1 << 18):  # long texts in pieces, which share no n-gram
            for g in grams(own[at : at + (1 << 18)]):
                total += np.bincount(g, minlength=BUCKETS) @ model.logits if len(g) > BUCKETS // 4 else model.logits[g].sum(0, dtype=np.float64)
                count += len(g)
        if count:
            z = total / count + model.bias
            p = np.exp(z - z.max())
            best[i], score[i] = z.argmax(), p.max() / p.sum()
    lettered = np.array([x is not None and any(map(str.isalpha, x)) for x in column.to_pylist()], bool) if n else np.zeros(0, bool)
    score[~lettered] = 0
    return [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score, rejected: a map without a shuffle."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = scores(model, batch.column(len(keep)))
            rejected = [x == "und" or s < model.threshold for x, s in zip(lang, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return source.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double, rejected boolean")
