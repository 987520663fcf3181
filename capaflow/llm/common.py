"""Helpers shared by the training-data operators.

Everything that leaves Spark's own expressions works on Arrow batches: texts
are read as the raw UTF-8 buffer plus offsets and handled with numpy in
pieces of bounded size, so a worker never holds more than one batch and one
piece (a single longer text forms a piece of its own).
"""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capaflow.session import ensure_checkpoint_dir

PIECE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
WORD_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATOR_PATTERN = r"[\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def in_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_BYTES: a worker holds a batch and what it makes of it, and texts can be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(_tidy(work), schema)


def _tidy(work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release_memory()
    return run


def release_memory() -> None:
    """Give back what a task no longer needs: its worker waits for other tasks, beside those of other jobs, and would hold it."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage (a lost executor re-reads files, not the whole plan) and
    gives later scans column pruning.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one job in a folder of their own, which goes when the job's result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` stored outside the folder; the folder is removed."""
        out = staged(df, f"{self.name}-result")
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return out


def held_out(doc_id: Column | str) -> Column:
    """True for documents kept out of every model fit: crc32 of the id as text, mod 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- integer mixing ------------------------------------------------------------
def splitmix(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit words (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        start = splitmix(np.array([seed * 0xD1342543DE82EF95 & _MASK], np.uint64))  # streams of different seeds are apart
        return splitmix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# --- Arrow text buffers ----------------------------------------------------------
def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def pieces(data: np.ndarray, off: np.ndarray,
           limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


# --- word hashing ------------------------------------------------------------------
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(WORD_SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x2545F4914F6CDD1D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = random_words(256, 11)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of every word of a piece."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_IS_SEPARATOR[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = off[1:-1][off[1:-1] < n]
    first[edges] |= word[edges]
    inner = edges[edges > 0]
    last[inner - 1] |= word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased: a polynomial over random byte
    values by prefix sums, then mixed with the length."""
    with np.errstate(over="ignore"):
        up, down = _power_table(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[_LOWER[data]] * up[:len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return splitmix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of ``size`` words and their rows, in row order.

    A text of 1 to ``size`` - 1 words has its whole word sequence as its only
    shingle; a text without words has none.
    """
    starts, ends, row = word_spans(data, off)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = word_hashes(data, starts, ends)
    count = np.bincount(row, minlength=len(off) - 1)
    factors = random_words(size, 29)
    with np.errstate(over="ignore"):
        m = len(words) - size + 1
        if m > 0:
            full = np.zeros(m, np.uint64)
            for k in range(size):
                full += words[k:k + m] * factors[k]
            inside = row[:m] == row[size - 1:]
            h, r = splitmix(full[inside]), row[:m][inside]
        else:
            h, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        begin = np.concatenate(([0], np.cumsum(count)))
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for k in range(size - 1):
                has = count[few] > k
                short[has] += words[begin[few[has]] + k] * factors[k]
            short = splitmix(short + count[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            h, r = np.concatenate((h, short)), np.concatenate((r, few))
            order = np.argsort(r, kind="stable")
            h, r = h[order], r[order]
    return h, r


def distinct_sets(h: np.ndarray, r: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, concatenated, and their offsets (rows + 1)."""
    if len(h) == 0:
        return h, np.zeros(rows + 1, np.int64)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[fresh], r[fresh]
    return h, np.concatenate(([0], np.cumsum(np.bincount(r, minlength=rows)))).astype(np.int64)


# --- connected components ------------------------------------------------------------
def connected_components(edges: DataFrame, stage) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``: the smallest node reachable.

    Alternating large-star and small-star steps on distributed edge lists; each
    step is one aggregation and one join, written to the shared folder by ``stage``. Ends
    when the edges are stars. Edges with a null end are
    ignored, so are repeated ones.
    """
    e = (edges.select("a", "b").where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = stage(e)
    while True:
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
        e = stage(e)
        # small star: u and its smaller neighbours point to the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = stage(e)
        # done when every node points to one node that points to none: the edges are stars
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
            e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.where("out > 1 or (out > 0 and into > 0)").isEmpty():
            break
    return (e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def exactly(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; whatever others are called, they are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def kept_beside(keep: tuple[str, ...], results: tuple[str, ...]) -> tuple[str, ...]:
    """The columns to be kept whose names no result column has (a result column wins)."""
    taken = {r.lower() for r in results}
    return tuple(c for c in dict.fromkeys(keep) if c.lower() not in taken)
