"""Ranked lexical search by the Best Position Algorithm.

Every document is ranked for every item by the sum of the impacts of the item's terms. Documents are
read once to postings (document, its number of terms, the wanted terms and how
often it holds each); from these come the statistics of the collection, over all
documents. Then every task cuts its documents to segments and, for each segment,

* sorts each wanted term's documents by impact (the impact list), and keeps
  for every (term, document) its place in that list (direct access);
* answers each item by best positions: reads the first places of each
  list that are not seen yet, looks up the documents found there in
  all lists of the item, which gives their whole scores and marks their places as seen,
  and moves each list's best position to the end of its contiguous seen
  places. No unseen document scores more than the impacts behind the best
  positions together; the search of a segment ends when that falls strictly below the k-th
  best score so far, so equal scores are never lost. The number of places read at once
  doubles with every round.

The k best of a task are carried from segment to segment, so later segments end
sooner, and only they leave the task. All impacts and scores are 64-bit integers.

Items are handled in blocks of a bounded number of distinct (item, term) rows; the
block's terms are what every task gets. Terms meet by a 64-bit hash and then byte by byte.

Defined results: a null text has no terms; an item without terms, or whose terms
occur nowhere, has no rows; equal rows of the items are one item, rows with equal ids and other texts
are items of their own; every row of the documents is a document of its own,
also with an id that occurs again; among equal scores a document without id comes last; documents
and items of any length are read whole; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capaflow.llm.common import Scratch, in_batches, pieces, utf8_buffers, word_hashes

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_IN_TERM = np.ones(256, bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _IN_TERM[_first:_last + 1] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_IMPACT_BITS = 40
_NO_ID = np.iinfo(np.int64).max


def term_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of every term of texts that lie one after the other in ``data``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_TERM[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] |= inside[edge + 1]
    ends[edge - 1] |= inside[edge]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(off, starts, "right") - 1


class Vocabulary:
    """Numbers of the wanted terms: found by hash, confirmed byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        size = np.array([len(t) for t in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum(size)
        self.data, self.start, self.size = data, end - size, size
        h = word_hashes(data, self.start, end) if len(raw) else np.zeros(0, np.uint64)
        self.number = np.argsort(h)
        self.hash = h[self.number]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the spans, number of the term) for the spans that are wanted terms."""
        if not len(self.hash) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        which = np.flatnonzero(self.hash[at] == h)
        number = self.number[at[which]]
        right = (ends - starts)[which] == self.size[number]
        which, number = which[right], number[right]
        same = np.ones(len(which), bool)
        longest = int(self.size[number].max(initial=0))
        for k in range(longest):
            on = np.flatnonzero(self.size[number] > k)
            same[on] &= _FOLD[data[starts[which[on]] + k]] == self.data[self.start[number[on]] + k]
        return which[same], number[same]


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n (its terms with repeats), terms and times (wanted terms only)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(terms)
        for batch in batches:
            data, off = utf8_buffers(batch.column(1))
            n, count, number, times = [], [], [], []
            for lo, hi, d, o in pieces(data, off):
                starts, ends, row = term_spans(d, o)
                n.append(np.bincount(row, minlength=hi - lo))
                which, term = words.find(d, starts, ends)
                key, tf = np.unique(row[which] * max(1, len(terms)) + term, return_counts=True)
                count.append(np.bincount(key // max(1, len(terms)), minlength=hi - lo))
                number.append(key % max(1, len(terms)))
                times.append(tf)
            at = np.concatenate(([0], np.cumsum(np.concatenate(count)))).astype(np.int32) if count else np.zeros(1, np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x).astype(np.int32) if x else [], pa.int32()))
                     for x in (number, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return in_batches(docs, work, "doc_id long, n long, terms array<int>, times array<int>")


class Segment:
    """Impact lists of some documents, sorted, with direct access by (term, document)."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, terms: int):
        order = np.argsort((term << _IMPACT_BITS) + ((1 << _IMPACT_BITS) - 1 - impact), kind="stable")
        self.doc, self.impact, self.ids = doc[order], impact[order], ids
        term = term[order]
        self.begin = np.searchsorted(term, np.arange(terms + 1))
        key = term * len(ids) + self.doc
        self.place = np.argsort(key)
        self.key = key[self.place]

    def best(self, terms: np.ndarray, times: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int,
             counted: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of ``top`` and this segment, by best positions."""
        size = (self.begin[terms + 1] - self.begin[terms])
        terms, times, size = terms[size > 0], times[size > 0], size[size > 0]
        if not len(terms):
            return top
        first = self.begin[terms]
        seen_from = np.concatenate(([0], np.cumsum(size)))[:-1]
        seen = np.zeros(int(size.sum()), bool)
        best, depth = np.zeros(len(terms), np.int64), 1
        last = len(self.key) - 1
        while True:
            open_ = np.flatnonzero(best < size)
            bound = int((times[open_] * self.impact[first[open_] + best[open_]]).sum())
            if bound == 0 or (len(top[0]) == k and bound < top[0][-1]):
                break
            found = []
            for j in open_:
                a, b = best[j], min(size[j], best[j] + depth)
                unseen = np.flatnonzero(~seen[seen_from[j] + a:seen_from[j] + b])
                found.append(self.doc[first[j] + a + unseen])
            docs = np.unique(np.concatenate(found))
            wanted = terms[:, None] * len(self.ids) + docs[None, :]
            at = np.minimum(np.searchsorted(self.key, wanted), last)
            j, d = np.nonzero(self.key[at] == wanted)
            place = self.place[at[j, d]]
            seen[seen_from[j] + place - first[j]] = True
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, d, times[j] * self.impact[place])
            if counted is not None:
                counted["looked_up"] = counted.get("looked_up", 0) + len(docs)
            top = merged(top, (score, self.ids[docs]), k)
            for j in open_:
                rest = seen[seen_from[j] + best[j]:seen_from[j] + size[j]]
                step = int(np.argmin(rest))
                best[j] = best[j] + step if not rest[step] else size[j]
            depth *= 2
        return top


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest positive scores of both, equal ones by ascending id."""
    score, ids = b
    on = score > 0
    if len(a[0]) == k:
        on &= score >= a[0][-1]
    if not on.any():
        return a
    score, ids = np.concatenate((a[0], score[on])), np.concatenate((a[1], ids[on]))
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, words: int, k: int, most: int):
    """mapInArrow work: the k best documents of the task's postings for each item (item number, terms, times)."""
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
        held: list[tuple] = []

        def close() -> Segment:
            ids, n, count, term, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            doc = np.repeat(np.arange(len(ids)), count)
            m = 100 - 75 + (75 * n * documents) // max(1, words)
            impact = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
            on = impact > 0
            return Segment(doc[on], term[on], impact[on], ids, len(weights))

        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy().astype(np.int64)
            for lo in range(0, len(ids), 1024):
                part = batch.slice(lo, 1024)
                count = np.diff(part.column(2).offsets.to_numpy()).astype(np.int64)
                held.append((ids[lo:lo + 1024], part.column(1).to_numpy().astype(np.int64), count,
                             part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy().astype(np.int64)))
                if sum(len(h[3]) + len(h[0]) for h in held) >= most:
                    yield close()
        if held:
            yield close()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = [none] * len(items)
        for segment in segments(batches):
            for i, (_, terms, times) in enumerate(items):
                top[i] = segment.best(terms, times, top[i], k)
        for lo in range(0, len(items), 4096):
            part = [(items[i][0], *top[i]) for i in range(lo, min(lo + 4096, len(items)))]
            ids = np.concatenate([p[2] for p in part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([p[0] for p in part], [len(p[1]) for p in part]), pa.int64()),
                 pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(np.concatenate([p[1] for p in part]), pa.int64())],
                names=["item", "doc_id", "score"])
    return work


def wanted_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of items(item, text)."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM_PATTERN), 0)
    return items.select("item", F.explode(found).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           k: int = 10, block_terms: int = 200_000, segment_postings: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item.

    ``block_terms`` bounds the (item, term) rows that the driver and every task hold at once, ``segment_postings`` a segment.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = scratch.stage(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
                          .distinct().withColumn("item", F.monotonically_increasing_id()))
    wanted = scratch.stage(wanted_terms(items))
    blocks = max(1, -(-wanted.count() // block_terms))
    hits = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "term").toArrow()
        terms = sorted(set(rows.column("term").to_pylist()))
        number = {t: i for i, t in enumerate(terms)}
        key, term = rows.column("item").to_numpy(), np.array([number[t] for t in rows.column("term").to_pylist()], np.int64)
        times, first = rows.column("times").to_numpy(), np.flatnonzero(np.diff(key, prepend=-1))
        asked = [(int(key[a]), term[a:b], times[a:b]) for a, b in zip(first, np.append(first, len(key))[1:], strict=True)]
        index = scratch.stage(postings(docs, terms))
        size = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r[0]: r[1] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).toLocalIterator()}
        weights = np.array([math.floor(1000 * math.log((2 * size[0] + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
        found = scratch.stage(in_batches(index.select("doc_id", "n", "terms", "times"), _search(
            asked, weights, size[0], size[1], k, segment_postings), "item long, doc_id long, score long"))
        hits = found if hits is None else hits.union(found)
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # the k best of each of many parts of an item's hits first, so that no task gets all of them
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    hits = hits.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("rank") <= k)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)
    return scratch.result(hits.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
