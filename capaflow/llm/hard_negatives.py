"""Hard negatives by Fagin's threshold algorithm.

Vectors become integer vectors (every component times ``scale``, rounded down), scores are
integer inner products. An anchor's positives are its highest-scoring other
rows of the same label; the negatives of a positive are the highest-scoring rows of another
label whose score lies in the positive's window, from ``low`` to ``high`` percent of
the positive's score.

Rows are dealt over the tasks and cut to segments. A segment keeps, for every dimension, its rows
sorted by that component (the candidate lists). For an anchor the lists of its non-zero
dimensions are read from the end where the component has the anchor's sign, some places a round in all lists;
rows met for the first time are scored in full (random access). What an unseen row can score at
most is the inner product of the anchor with the last values read (the threshold).
Positives end once the threshold falls strictly below the last place; negatives once it falls
strictly below the last place of every window, or below the window itself. Places found
are carried from segment to segment of a task, so later segments end sooner, and only they leave the task.

Anchors are handled in blocks of a bounded number of bytes: every task gets a block, never all anchors.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; rows of
different length are never compared; a row with the anchor's id is not its positive; other rows
with equal ids count each; equal anchor rows are one anchor; a positive with a negative score has
an empty window; scores are exact as long as they fit 64 bits; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capaflow.llm.common import Scratch, in_batches

_EXACT = 1 << 53
SEGMENT_ROWS = 8192
FIRST_DEPTH = 16


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, x): the rows that take part, with integer components."""
    e = F.col("e")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~F.exists(
        e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
                        F.col(f"`{embedding}`").cast("array<double>").alias("e"))
            .where(F.coalesce(usable, F.lit(False)))
            .select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("x")))


class Lists:
    """Rows sorted by every component; a threshold search reads them from the anchor's side."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, label: np.ndarray):
        self.x, self.ids, self.label = x, ids, label
        self.most = float(np.abs(x.astype(np.float64)).max(initial=0))
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()   # one line for each dimension

    def search(self, anchor: np.ndarray, done, take) -> int:
        """Gives ``take(rows, scores)`` all rows that ``done(threshold)`` does not rule out; the number of rows scored."""
        n, scored = len(self.ids), 0
        dims = np.flatnonzero(anchor)
        if not len(dims):                   # every score is zero
            take(np.arange(n), np.zeros(n, np.int64))
            return n
        a = anchor[dims]
        # sums that stay below 2**53 are exact in doubles, whose products are faster
        exact = np.float64 if float(np.abs(a.astype(np.float64)).sum()) * self.most < _EXACT else np.int64
        weights = a.astype(exact)
        up, line = (a > 0)[:, None], dims[:, None]
        seen = np.zeros(n, bool)
        at, depth = 0, FIRST_DEPTH
        while at < n:
            stop = min(n, at + depth)
            places = np.arange(at, stop)
            read = self.order[line, np.where(up, n - 1 - places, places)]
            rows = read.ravel()
            rows = np.unique(rows[~seen[rows]])
            seen[rows] = True
            if len(rows):
                scored += len(rows)
                take(rows, (self.x[rows][:, dims].astype(exact) @ weights).astype(np.int64))
            if scored == n or done(int((self.x[read[:, -1], dims] * weights).sum())):
                break
            at, depth = stop, depth * 2
        return scored


@dataclass
class Places:
    """The first k of a list by falling score, then id."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:
            on = score >= self.score[-1]
            score, ids = score[on], ids[on]
        if len(score):
            score, ids = np.concatenate((self.score, score)), np.concatenate((self.ids, ids))
            order = np.lexsort((ids, -score))[:self.k]
            self.score, self.ids = score[order], ids[order]

    def beyond(self, threshold: int) -> bool:
        return len(self.score) == self.k and threshold < self.score[-1]


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, ids, label) of at most ``most`` rows of one length."""
    held: dict[int, list] = {}

    def close(dim: int):
        rows = held.pop(dim)
        return (np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]))

    for batch in batches:
        size = np.diff(batch.column(2).offsets.to_numpy())
        ids, label = (batch.column(c).to_numpy().astype(np.int64) for c in (0, 1))
        flat = batch.column(2).flatten().to_numpy().astype(np.int64)
        end = np.cumsum(size)
        for dim in np.unique(size).tolist():
            on = np.flatnonzero(size == dim)
            for lo in range(0, len(on), 1024):
                some = on[lo:lo + 1024]
                x = flat[(end[some] - dim)[:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((x, ids[some], label[some]))
                if sum(len(r[1]) for r in held[dim]) >= most:
                    yield close(dim)
    for dim in list(held):
        yield close(dim)


def _positives(anchors: list, k: int, most: int):
    """Work: the task's first k rows of each anchor's label."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Places(k) for _ in anchors]
        for x, ids, label in _segments(batches, most):
            by_label: dict[int, Lists] = {}
            for (_, own, mine, a), places in zip(anchors, found, strict=True):
                if len(a) != x.shape[1]:
                    continue
                if mine not in by_label:
                    on = np.flatnonzero(label == mine)
                    by_label[mine] = Lists(x[on], ids[on], label[on])
                lists = by_label[mine]

                def take(rows: np.ndarray, score: np.ndarray, lists=lists, own=own, places=places) -> None:
                    other = lists.ids[rows] != own
                    places.add(score[other], lists.ids[rows][other])

                lists.search(a, places.beyond, take)
        yield _batch(["anchor", "other", "score"], [
            (np.full(len(p.ids), a[0]), p.ids, p.score) for a, p in zip(anchors, found, strict=True)])
    return work


def _negatives(anchors: list, positives: dict[int, list[tuple[int, int]]], k: int, low: int, high: int, most: int):
    """Work: the task's first k rows of other labels in the window of each (anchor, positive)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(a[0], n): Places(k) for a in anchors for n, (_, p) in enumerate(positives.get(a[0], [])) if p >= 0}
        for x, ids, label in _segments(batches, most):
            lists = Lists(x, ids, label)
            for number, _, mine, a in anchors:
                windows = [(p, found[number, n]) for n, (_, p) in enumerate(positives.get(number, [])) if p >= 0]
                if not windows or len(a) != x.shape[1]:
                    continue

                def take(rows: np.ndarray, score: np.ndarray, lists=lists, mine=mine, windows=windows) -> None:
                    other = lists.label[rows] != mine
                    score, who = score[other], lists.ids[rows][other]
                    for p, places in windows:
                        on = (low * p <= 100 * score) & (100 * score <= high * p)
                        places.add(score[on], who[on])

                def done(threshold: int, windows=windows) -> bool:
                    return all(places.beyond(threshold) or 100 * threshold < low * p for p, places in windows)

                lists.search(a, done, take)
        yield _batch(["anchor", "positive", "other", "score"], [
            (np.full(len(p.ids), number), np.full(len(p.ids), n), p.ids, p.score) for (number, n), p in found.items()])
    return work


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def hard_negatives(rows: DataFrame, is_anchor: str, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                   scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   block_bytes: int = 16 << 20, segment_rows: int = SEGMENT_ROWS, task_bytes: int = 64 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is an SQL condition on ``vec_id`` and ``label``. A block of anchors takes about ``block_bytes`` in
    every task; rows are dealt to as many tasks as the session has cores, or more, so that none reads over ``task_bytes``.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    usable = scratch.stage(integer_vectors(rows, vec_id, embedding, label, scale).withColumn("row", F.monotonically_increasing_id()))
    total = usable.agg(F.coalesce(F.sum(8 * F.size("x") + 16), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    spread = usable.repartition(tasks, F.xxhash64("row")).select("vec_id", "label", "x")
    chosen = scratch.stage(usable.where(is_anchor).select("vec_id", "label", "x").distinct().withColumn("anchor", F.monotonically_increasing_id()))
    weight = chosen.agg(F.coalesce(F.sum(8 * F.size("x") + 64 * (1 + positives * (1 + negatives))), F.lit(0))).first()[0]
    blocks = max(1, -(-weight // block_bytes))
    result = None
    for block in range(blocks):
        mine = chosen.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block)
        anchors = [(r.anchor, r.vec_id, r.label, np.array(r.x, np.int64)) for r in mine.toLocalIterator()]
        near = in_batches(spread, _positives(anchors, positives, segment_rows), "anchor long, other long, score long")
        near = scratch.stage(_first(near, ["anchor"], positives))
        ranked: dict[int, list[tuple[int, int]]] = {}
        for r in near.orderBy("anchor", "rank").toLocalIterator():
            ranked.setdefault(r.anchor, []).append((r.other, r.score))
        far = in_batches(spread, _negatives(anchors, ranked, negatives, low, high, segment_rows),
                         "anchor long, positive long, other long, score long")
        far = _first(far, ["anchor", "positive"], negatives).withColumnRenamed("other", "negative_id").withColumnRenamed("score", "negative_score")
        near = near.select("anchor", (F.col("rank") - 1).cast("long").alias("positive"), F.col("other").alias("positive_id"),
                           F.col("score").alias("positive_score"))
        found = scratch.stage(far.join(near, ["anchor", "positive"]).join(mine.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        result = found if result is None else result.union(found)
    return scratch.result(result)


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key by falling score, then id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
