"""Near-duplicate groups by min-max hashing.

A document's set holds its distinct word shingles. Under each of the hash
permutations both the least and the greatest value of the set are kept: two
signature values per evaluation, each equal in two sets with the probability
of their resemblance. Signature values are banded; sets with an equal band
share a bucket. Bands mix values of different permutations only.

From buckets to groups, without ever listing all pairs of a bucket:

1. Documents with equal sets form a class; its smallest id stands for it.
2. Each bucket draws one member at random as its centre; each document is
   checked, on full sets, against the centres of the ``centres_each`` largest of
   its buckets.
   Confirmed links give components.
3. Buckets whose members are in one component are done: more links there
   cannot change anything. The others draw new centres, ``rounds`` times in
   all. A round checks at most ``centres_each`` pairs per document.
4. What is left is finished exactly. Members outside a bucket's largest
   component meet all members of other components: as pairs where the bucket
   is small, in tiles of ``tile`` x ``tile`` members where it is large.

So every pair that shares a bucket is either linked, checked, or already in
one component. A pair at the threshold of 0.8 shares none of the default 60
bands of 7 values with a probability below 1e-6.

Defined results: a text without words (or null) has no set and stays alone;
one to ``size`` - 1 words count as one shingle; an id that occurs several times is
one document, linked by any of its texts; rows with a null id belong to the
class of their text, never represent it, and are kept only if no row with an
id has that text; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capaflow.llm.common import (Scratch, connected_components, distinct_sets, in_batches, pieces, random_words,
                                 shingle_hashes, splitmix, utf8_buffers)


def band_keys(sets: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (set, band) of non-empty sets: min-max signatures folded band by band."""
    count = bands * rows // 2
    factor, shift = random_words(count, 41) | np.uint64(1), random_words(count, 43)
    n = len(off) - 1
    signature = np.empty((2 * count, n), np.uint64)
    begin = off[:-1]
    with np.errstate(over="ignore"):
        for j in range(count):
            v = sets * factor[j] + shift[j]
            signature[j] = np.minimum.reduceat(v, begin)
            signature[count + j] = np.maximum.reduceat(v, begin)
        out = np.empty((n, bands), np.uint64)
        for b in range(bands):
            key = np.full(n, (b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
            for r in range(rows):
                key = splitmix(key ^ signature[b * rows + r]) + np.uint64(r)
            out[:, b] = key
    return out


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, set hashes, offsets) piece by piece."""
    data, off = utf8_buffers(column)
    for lo, hi, part, o in pieces(data, off):
        h, r = shingle_hashes(part, o, size)
        yield lo, hi, *distinct_sets(h, r, hi - lo)


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, hash of the text, n_shingles, digest of the set, band keys) of every row; no digest and keys for an empty set."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, off in _sets(batch.column(1), size):
                n = np.diff(off)
                full = np.flatnonzero(n)
                keys = np.zeros((0, bands), np.uint64)
                if len(full):
                    keys = band_keys(h, np.append(off[:-1][full], len(h)), bands, rows)
                raw = h.tobytes()
                digest = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a else None
                          for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                     pa.array(digest, pa.binary()), lists], names=["id", "h", "n_shingles", "digest", "keys"])

    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return in_batches(texts.withColumn("h", F.xxhash64("text")), work, "id long, h long, n_shingles long, digest binary, keys array<long>")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 x intersection >= percent x union, for sorted sets of distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                both = []
                for c in (2, 3):
                    own = []
                    for _, _, h, off in _sets(part.column(c), size):
                        own += np.split(h, off[1:-1])
                    both.append(own)
                good = pa.array([_linked(x, y, percent) for x, y in zip(*both, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(good)

    joined = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
              .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
              .select("a", "b", "ta", "tb"))
    return in_batches(joined, work, "a long, b long")


def _tile_links(size: int, percent: int):
    """Links of one tile between members of different components, enough of them to join all that belong together.

    A pair is compared only under the first band that both share; under later ones it has been.
    """
    def work(rows: pa.Table) -> pa.Table:
        ids, comp = rows.column("id").to_pylist(), rows.column("comp").to_pylist()
        outer = np.array(rows.column("outer").to_pylist(), dtype=bool)
        sets = []
        for _, _, h, off in _sets(rows.column("text").combine_chunks(), size):
            sets += np.split(h, off[1:-1])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        keys = rows.column("keys").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        band = int(np.flatnonzero(keys[0] == rows.column("key")[0].as_py())[0])
        inner = np.flatnonzero(~outer)
        lengths = np.array([len(x) for x in sets])
        a, b = [], []
        for i in np.flatnonzero(outer):
            near = 100 * np.minimum(lengths[inner], lengths[i]) >= percent * np.maximum(lengths[inner], lengths[i])
            fresh = inner[near & ~(keys[inner, :band] == keys[i, :band]).any(axis=1)]
            for j in fresh:
                if find(comp[i]) != find(comp[j]) and _linked(sets[i], sets[j], percent):
                    root[find(comp[i])] = find(comp[j])
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return work


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                    bands: int = 60, rows: int = 7, rounds: int = 3, centres_each: int = 3, pair_members: int = 24, tile: int = 128) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable) and kept."""
    scratch = Scratch(docs.sparkSession, "minmax")
    rows_ = scratch.stage(signatures(docs, doc_id, text, size, bands, rows))
    classes = scratch.stage(rows_.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep")))
    # the rows that stand for their classes, met by digest and id, so that a class of many copies is spread
    members = (rows_.join(classes.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi")
               .select(F.col("id").alias("rep"), "digest", F.explode("keys").alias("key")))
    shared = members.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("key")
    members = scratch.stage(members.join(shared, "key").distinct())
    keys = rows_.join(classes.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi").select("id", "digest", "h", "keys")
    ids = members.select(F.col("rep").alias("id")).distinct()
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = (texts.where("id is not null and text is not null").join(ids, "id", "left_semi")
             .withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]))
    texts = scratch.stage(texts)

    links = checked = comps = None
    open_ = members.withColumn("comp", F.col("rep"))
    for k in range(rounds):
        draw = F.xxhash64(F.lit(k), F.col("key"), F.col("rep"))
        centres = open_.groupBy("key").agg(F.count("*").alias("n"), F.min_by(F.struct("rep", "comp"), draw).alias("c"))
        # of the centres that a document could be checked against those of its largest buckets, one list per document
        choice = F.collect_set(F.struct("n", "key", F.col("c.rep").alias("centre")))
        pairs = (open_.join(centres, "key").where("comp <> c.comp")
                 .groupBy("rep").agg(F.slice(F.sort_array(choice, asc=False), 1, centres_each).alias("choice"))
                 .select("rep", F.explode("choice.centre").alias("centre"))
                 .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())
        pairs = scratch.stage(pairs)
        found = scratch.stage(confirmed(pairs, texts, size, percent))
        links, checked = (found, pairs) if links is None else (links.union(found), checked.union(pairs))
        comps = connected_components(links, scratch.stage)
        open_ = scratch.stage(_unfinished(members, comps))

    found = scratch.stage(_rest(open_, checked, texts, keys, scratch, size, percent, pair_members, tile))
    if not found.isEmpty():
        links = links.union(found)
        comps = connected_components(links, scratch.stage)
    # a row's component is that of its class; an id with several texts joins their classes
    # through the edges between representatives and ids
    reused = rows_.where("id is not null and digest is not null").groupBy("id").agg(
        F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select(F.col("id").alias("a"))
    extra = scratch.stage(rows_.where("digest is not null").join(classes, "digest").where("id <> rep")
                          .select(F.col("id").alias("a"), F.col("rep").alias("b")).join(reused, "a", "left_semi").distinct())
    if not extra.isEmpty():
        comps = connected_components(links.union(extra), scratch.stage)
    named = (classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
             .select("digest", F.coalesce("component", "rep").alias("component")))
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return scratch.result(rows_.join(named, "digest", "left").select(
        "id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")))


def _unfinished(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, rep, digest, comp) of the buckets with members of several components."""
    known = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", "digest", F.coalesce("component", "rep").alias("comp"))
    several = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return known.join(several, "key")


def _rest(open_: DataFrame, checked: DataFrame, texts: DataFrame, keys: DataFrame, scratch: Scratch, size: int, percent: int,
          pair_members: int, tile: int) -> DataFrame:
    """Links between components inside unfinished buckets, found from all their cross pairs."""
    per = open_.groupBy("key", "comp").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    small = open_.join(per.where(F.col("n") <= pair_members).select("key", "largest"), "key")
    left = small.where("comp <> largest").select("key", F.col("rep").alias("a"), F.col("comp").alias("ca"))
    pairs = (left.join(small.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"), "largest"), "key")
             .where("ca <> cb and (cb = largest or a < b)")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
             .join(checked, ["a", "b"], "left_anti"))
    found = confirmed(pairs, texts, size, percent)
    large = scratch.stage(open_.join(per.where(F.col("n") > pair_members).select("key", "largest", "n"), "key"))
    if large.isEmpty():
        return found
    outside = large.where("comp <> largest").groupBy("key").agg(F.count("*").alias("m"))
    large = large.join(outside, "key").withColumn("no", F.ceil(F.col("m") / tile)).withColumn("nm", F.ceil(F.col("n") / tile))
    spread = F.xxhash64("rep", "digest", "key")  # an id may stand for several classes
    rows_ = large.where("comp <> largest").select(
        "key", F.col("rep").alias("id"), "digest", "comp", F.pmod(spread, "no").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)).alias("j"), F.lit(True).alias("outer"))
    cols = large.select("key", F.col("rep").alias("id"), "digest", "comp",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("no") - 1)).alias("i"),
                        F.pmod(spread, "nm").alias("j"), F.lit(False).alias("outer"))
    members = large.select(F.col("rep").alias("id"), "digest").distinct()
    # one text and one list of keys for each class, however often its rows occur
    keys = keys.join(members, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    carried = scratch.stage(texts.join(keys, ["id", "h"]).drop("h"))
    tiles = rows_.unionByName(cols).join(carried, ["id", "digest"]).groupBy("key", "i", "j")
    return found.union(tiles.applyInArrow(_tile_links(size, percent), "a long, b long"))
