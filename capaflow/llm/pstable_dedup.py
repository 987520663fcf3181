"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one, so a cosine of c is a distance of
sqrt(2 - 2c). Each of several tables projects a vector on ``m`` Gaussian
directions, adds an offset, cuts the line into cells of width ``w`` and uses the
cells together as the bucket. Vectors that share a bucket in any table are
compared exactly in double precision.

``m`` grows with the logarithm of the number of vectors, so that unrelated
vectors fill buckets of about the same size at every input size; the number of
tables follows from ``m`` and ``miss``, the probability that a pair exactly at
the threshold shares no bucket (closer pairs are missed far less often).

Equal directions form a class that is compared once. A bucket is never taken
whole: its members are dealt to blocks, and each pair of blocks is a task of at
most 2 x ``tile`` vectors, compared by one matrix product. A pair is counted
only in the first table in which it meets. A tile gives back one count per
vector and enough links to join what belongs together, not its pairs.

Defined results: a null id links with nothing (its component is null and it
is kept), nor does a vector that is null, empty, zero, or has null or non-finite
components; vectors of different length are never linked; repeated rows, and rows of
one id with other vectors, count as other vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capaflow.llm.common import Scratch, connected_components, in_batches, random_words, splitmix


def collision(distance: float, width: float) -> float:
    """Probability that one quantised Gaussian projection puts two points at a distance into one cell."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(vectors: int, cosine: float, width: float, bucket: int, miss: float) -> tuple[int, int]:
    """Projections per table and number of tables."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2.0), width)
    m = max(4, math.ceil(math.log(max(1.0, vectors / bucket)) / -math.log(far)))
    return m, math.ceil(math.log(miss) / math.log1p(-near ** m))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision (no overflow or underflow on the way)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def _projections(dim: int, m: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64([dim, m, tables, 5]))
    return g.standard_normal((dim, m * tables)), g.random(m * tables)


def _kind(vectors: DataFrame, embedding: str) -> str:
    """Floats travel as floats; everything is computed in doubles."""
    return "float" if vectors.select(F.col(f"`{embedding}`")).schema[0].dataType == T.ArrayType(T.FloatType()) else "double"


def hashed(vectors: DataFrame, vec_id: str, embedding: str, m: int, tables: int, width: float) -> DataFrame:
    """(id, digest, vector, keys): digest, vector (its components as they are stored) and one 32-bit bucket per table only for usable vectors."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                lists = part.column(1)
                n = part.num_rows
                digest, raw, keys = [None] * n, [None] * n, [None] * n
                by_dim: dict[int, list[int]] = {}
                for k in range(n):
                    if part.column(0)[k].is_valid and lists[k].is_valid and len(lists[k]) and not lists[k].values.null_count:
                        by_dim.setdefault(len(lists[k]), []).append(k)
                for dim, at in by_dim.items():
                    x = np.stack([lists[k].values.to_numpy(zero_copy_only=False) for k in at])
                    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    at, x = [k for k, ok in zip(at, good, strict=True) if ok], x[good]
                    if not at:
                        continue
                    if dim not in made:
                        made[dim] = _projections(dim, m, tables)
                    u = unit_vectors(x)
                    cell = np.floor(u @ made[dim][0] / width + made[dim][1]).astype(np.int64).view(np.uint64)
                    key = np.tile(random_words(tables, dim), (len(at), 1))
                    with np.errstate(over="ignore"):
                        for j in range(m):
                            key = splitmix(key ^ cell[:, j * tables:(j + 1) * tables]) + np.uint64(j)
                    key = (splitmix(key) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    for r, k in enumerate(at):
                        digest[k] = hashlib.blake2b(u[r].tobytes(), digest_size=16).digest()
                        raw[k], keys[k] = x[r].tobytes(), key[r].tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int32()))],
                    names=["id", "digest", "vector", "keys"])

    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast(f"array<{_kind(vectors, embedding)}>").alias("e"))
    return in_batches(rows, work, "id long, digest binary, vector binary, keys array<int>")


def _compare(cosine: float, kind: str):
    def work(rows: pa.Table) -> pa.Table:
        ids = rows.column("cls").to_numpy()
        copies, block = rows.column("copies").to_numpy(), rows.column("block").to_numpy()
        t, i, j = (rows.column(c)[0].as_py() for c in ("t", "i", "j"))
        u = unit_vectors(np.stack([np.frombuffer(v, np.float32 if kind == "float" else np.float64) for v in rows.column("vector").to_pylist()]))
        keys = rows.column("keys").combine_chunks().values.to_numpy(zero_copy_only=False)
        keys = keys.reshape(len(ids), -1) if len(ids) else keys
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(u[left] @ u[right].T >= cosine)
        a, b = left[a], right[b]
        if i == j:
            once = a < b
            a, b = a[once], b[once]
        fresh = np.ones(len(a), bool)
        for s in range(t):  # not if an earlier table has compared them
            fresh &= keys[a, s] != keys[b, s]
        a, b = a[fresh], b[fresh]
        more = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        first, second = [], []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[p] = q
                first.append(x)
                second.append(y)
        has = np.flatnonzero(more)
        return pa.table({
            "a": pa.array(np.concatenate((ids[has], ids[first])) if len(ids) else [], pa.int64()),
            "links": pa.array(np.concatenate((more[has], np.zeros(len(first)))).astype(np.int64)),
            "b": pa.array([None] * len(has) + ids[second].tolist(), pa.int64())})
    return work


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9,
                    width: float = 2.0, bucket: int = 1024, miss: float = 1e-3, tile: int = 1024) -> DataFrame:
    """Per row: id, n_links, component_id and kept."""
    m, tables = table_plan(vectors.count(), cosine, width, bucket, miss)
    scratch = Scratch(vectors.sparkSession, "pstable")
    rows = scratch.stage(hashed(vectors, vec_id, embedding, m, tables, width))
    # a class is known by a number of its own: an id can occur with several vectors
    classes = scratch.stage(rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by("vector", "id").alias("vector"),
        F.min_by("keys", "id").alias("keys")).withColumn("cls", F.monotonically_increasing_id()))
    members = classes.select("cls", F.posexplode("keys").alias("t", "key"))
    per = members.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / tile)
    members = (members.join(per, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("cls"), blocks))
               .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
               .select("cls", "t", "key", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")))
    tiles = members.join(classes.select("cls", "copies", "vector", "keys"), "cls").groupBy("t", "key", "i", "j")
    found = scratch.stage(tiles.applyInArrow(_compare(cosine, _kind(vectors, embedding)), "a long, links long, b long"))
    comps = scratch.stage(connected_components(found.where("b is not null").select("a", "b"), scratch.stage).withColumnRenamed("node", "cls"))
    least = comps.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("least"))
    more = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cls")
    named = (classes.select("digest", "cls", "rep", "copies").join(more, "cls", "left")
             .join(comps.join(least, "component").select("cls", "least"), "cls", "left")
             .select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("least", "rep").alias("component")))
    linked = rows.select("id", "digest").where("digest is not null").join(named, "digest").select("id", "n_links", "component")
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return scratch.result(linked.union(alone).select(
        "id", "n_links", F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("id")).alias("kept")))
