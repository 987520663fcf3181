"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

Features of a text are indicators (present or not) of hashed n-grams: 1 to 3
neighbouring words (A-Z lower-cased), as many word *shapes* (letter case, trailing marks, same word as before)
and character 4-grams. Each indicator is scaled by the log ratio of how often it
occurs in documents of label 1 and of label 0, rows are brought to length one,
and a linear support vector machine is fitted by dual coordinate descent.
Margins become probabilities by a logistic curve fitted on rows that the
machine has not seen.

The model is fitted on a bounded sample of the labelled rows: the ``most_rows``
with the least hash of their id. The features of these rows (distinct bucket
numbers) are all that reaches the driver. Scoring reads every whole text.

Defined results: null and empty texts have no features and score the curve's
value at the intercept; labels other than 0 and 1 are ignored, so are labels of
unknown documents; a document with several labels counts as 1 if any is; if a
label class is missing, all texts score the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capaflow.llm.common import in_batches, kept_beside, pieces, random_words, splitmix, utf8_buffers, word_hashes, word_spans

BUCKETS = 1 << 18
WORD_ORDERS = (1, 2, 3)
SHAPE_ORDERS = (1, 2, 3)
CHAR_ORDER = 4
_KIND = np.zeros(256, np.uint8)  # 1 lower-case letter or above ASCII, 2 upper-case letter, 3 digit, 4 other mark
_KIND[0x21:0x7F] = 4
_KIND[0x30:0x3A] = 3
_KIND[0x41:0x5B] = 2
_KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1


def feature_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each row of a piece, concatenated, and their offsets."""
    rows = len(off) - 1
    found: list[np.ndarray] = []
    kind_of = np.int32 if rows * BUCKETS < 1 << 31 else np.int64  # a piece of fewer rows sorts short keys
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)

    def add(h: np.ndarray, row: np.ndarray) -> None:
        found.append(row.astype(kind_of) * kind_of(BUCKETS) + (h * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(kind_of))

    with np.errstate(over="ignore"):
        starts, ends, row = word_spans(data, off)
        if len(starts):
            kind = _KIND[data]
            shape = kind[starts].astype(np.uint64)
            for k in (1, 2):  # kinds of the first letters and the marks that end the word
                inner = np.minimum(starts + k, ends - 1)
                shape = shape * np.uint64(8) + kind[inner]
            for k in (1, 2):
                place = np.maximum(ends - k, starts)
                shape = shape * np.uint64(256) + np.where(kind[place] >= 3, data[place], 0).astype(np.uint64)
            word = word_hashes(data, starts, ends)
            again = np.zeros(len(word), np.uint64)
            again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
            shape = splitmix(shape * np.uint64(4) + again + np.uint64(1))
            for of, orders, seed in ((shape, SHAPE_ORDERS, 53), (word, WORD_ORDERS, 59)):
                factors = random_words(max(orders, default=0), seed)
                for n in orders:
                    m = len(of) - n + 1
                    if m <= 0:
                        continue
                    h = np.full(m, n, np.uint64)
                    for k in range(n):
                        h += of[k:k + m] * factors[k]
                    inside = row[:m] == row[n - 1:]
                    add(h[inside], row[:m][inside])
        m = len(data) - CHAR_ORDER + 1
        if m > 0:
            h = np.zeros(m, np.uint64)
            for k in range(CHAR_ORDER):
                h <<= np.uint64(8)
                h |= data[k:k + m]
            byte_row = np.repeat(np.arange(rows, dtype=kind_of), np.diff(off))
            inside = byte_row[:m] == byte_row[CHAR_ORDER - 1:]
            add(h[inside] + np.uint64(1 << 40), byte_row[:m][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    key = np.concatenate(found)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key % BUCKETS).astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(key // BUCKETS, minlength=rows))))


@dataclass
class Model:
    weights: np.ndarray    # per bucket, with the log-count ratio multiplied in
    ratios: np.ndarray     # for the length of a row
    intercept: float
    slope: float           # of the logistic curve over margins
    offset: float
    constant: float | None = None  # the score of every text if there was nothing to learn

    def scores(self, sets: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        row = np.repeat(np.arange(n), np.diff(off))
        total = np.bincount(row, self.weights[sets], n)
        length = np.sqrt(np.bincount(row, self.ratios[sets] ** 2, n))
        margin = np.divide(total, length, out=np.zeros(n), where=length > 0) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t > 0]), minlength=BUCKETS) + smooth
    q = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t < 0]), minlength=BUCKETS) + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                            size: int, epochs: int = 30, tolerance: float = 1e-3, seed: int = 3) -> np.ndarray:
    """Weights (the last is the intercept) of the L2-regularised hinge loss: one dual variable at a time,
    clipped to [0, cost], the weights kept up to date."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + w[-1]) - 1.0
            bound = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            if bound == 0.0:
                continue
            worst = max(worst, abs(bound))
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[rows[i]] += step * values[i]
            w[-1] += step
        if worst < tolerance:
            break
    return w


def logistic_curve(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, by Newton steps on slightly smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 4.0, calibrate: float = 0.25) -> Model:
    """The model from distinct feature buckets of each row and labels 0 / 1 (rows in any fixed order)."""
    none = np.zeros(BUCKETS)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(none, none, 0.0, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    y = np.where(labels > 0, 1.0, -1.0)

    def train(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, t = [rows[i] for i in which], y[which]
        r = log_count_ratios(own, t)
        values = [r[x] / max(1e-12, float(np.sqrt((r[x] ** 2).sum()))) for x in own]
        share = np.where(t > 0, 0.5 / (t > 0).mean(), 0.5 / (t < 0).mean())  # both classes weigh the same
        return dual_coordinate_descent(own, values, t, cost * share, BUCKETS), r

    def model(w: np.ndarray, r: np.ndarray) -> Model:
        return Model(w[:-1] * r, r, float(w[-1]), 1.0, 0.0)

    every = np.arange(len(y))
    unseen = every % max(2, round(1 / calibrate)) == 0
    slope, offset = 1.0, 0.0
    if len(set(y[unseen])) == 2 and len(set(y[~unseen])) == 2:
        part = model(*train(every[~unseen]))
        sets = [rows[i] for i in every[unseen]]
        off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        p = np.clip(part.scores(np.concatenate(sets), off), 1e-12, 1 - 1e-12)
        slope, offset = logistic_curve(np.log(p / (1 - p)), y[unseen] > 0)
    out = model(*train(every))
    out.slope, out.offset = slope, offset
    return out


def sample_features(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature buckets and labels of the sample, in order of ids.

    The sample is drawn among ids alone, and its ids (``most_rows`` at most, so
    broadcast) then pick the texts: no other text leaves its place.
    """
    ids = labelled_ids(labels, label).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    drawn = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    sample = sample.dropDuplicates(["doc_id"])  # an id that occurs again is one document

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8_buffers(batch.column(1))
            for lo, hi, part, o in pieces(data, off):
                sets, ends = feature_sets(part, o)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists],
                                                 names=["doc_id", "label", "features"])

    rows = sample.select("doc_id", "text", F.col("label").cast("int").alias("label"))
    got = in_batches(rows, work, "doc_id long, label int, features array<int>").toArrow().sort_by("doc_id")
    features = got.column("features").combine_chunks()
    off = features.offsets.to_numpy()
    return np.split(features.values.to_numpy().astype(np.int64), off[1:-1]) if len(features) else [], got.column("label").to_numpy()


def labelled_ids(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and label of the labelled documents."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
            .where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 6000) -> Model:
    return fit(*sample_features(docs, labels, label, most_rows))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), cut: float = 0.7) -> DataFrame:
    """Per row the kept columns, score and predicted."""
    keep = kept_beside(keep, ("score", "predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    fields = [f"`{c}` {t}" for c, t in rows.dtypes[1:]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8_buffers(batch.column(0))
            for lo, hi, part, o in pieces(data, off):
                score = shared.value.scores(*feature_sets(part, o))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[1:]), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                    names=[*keep, "score", "predicted"])

    return in_batches(rows, work, ", ".join([*fields, "score double, predicted int"]))
