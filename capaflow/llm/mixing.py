"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken m = target / source size times on
average. The whole part of m is taken outright; the fraction is rounded
document by document with the pivotal method: two documents with fractional
copy probabilities meet, mass is moved at random from one to the other until
one of them is 0 or 1, and the other goes on. Mass is moved in words (size x
probability), so a meeting leaves the expected words of the mix exactly as they
were, and only the very last document of a source is rounded on its own: a
source's taken words differ from its target by less than one document.

The meetings form a reduction tree. Documents are dealt to blocks of about
``block_rows`` rows by a hash (a large source just has more blocks); each
block leaves at most one unfinished document; those meet in groups of
``fan_in`` blocks, level by level, until one per source is left. No task gets
more than one block or ``fan_in`` unfinished documents. Random numbers come
from hashes of the documents, so reruns agree however the rows are dealt out.

Defined results: null text has size 0; a document without words is taken
floor(m) times (0 words) and takes part in no meeting; null is a source of its own,
last in order; an empty table gives an empty result; repeated rows are
separate documents. Extra columns are carried only if named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capaflow.llm.common import WORD_PATTERN, kept_beside, splitmix, staged


def word_count(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, source_size, target, n) from rows (source, size).

    Sources in order (null last) have the weights in turn; ``share`` of all
    words is dealt by weight; a target stops at ``most`` x its source's size
    and the excess goes to the others by weight until none is above. One row
    per source: the windows below run over sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # sources reach their caps in the order of cap / weight; the level is the
    # share per weight once all sources before are full
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share))
                                   - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("_reached", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    final = F.first("_reached", ignorenulls=True).over(by_ratio.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("_level", final)
    return per.select("source", "source_size", "n", F.when(
        F.col("_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_level") * F.col("weight"))).alias("target"))


def _meet(size: np.ndarray, p: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, int]:
    """One pass of meetings over rows in order: probabilities after it and the row left unfinished (-1: none)."""
    p, left = p.tolist(), -1
    size, u = size.tolist(), (splitmix(mark.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    u = u.tolist()
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if left < 0:
            left = j
            continue
        i = left
        a, b, x, y = size[i], size[j], p[i], p[j]
        # moving t: i gains t * b, j loses t * a
        up_i, up_j = (1.0 - x) / b, y / a
        down_i, down_j = x / b, (1.0 - y) / a
        up, down = min(up_i, up_j), min(down_i, down_j)
        if u[j] * (up + down) < down:  # each meeting has a newcomer, whose number decides
            done_i, done_j = up_i <= up, up_j <= up
            p[i], p[j] = (1.0 if done_i else x + up * b), (0.0 if done_j else y - up * a)
        else:
            done_i, done_j = down_i <= down, down_j <= down
            p[i], p[j] = (0.0 if done_i else x - down * b), (1.0 if done_j else y + down * a)
        left = -1 if done_i and done_j else j if done_i else i
    if left >= 0 and not 0.0 < p[left] < 1.0:
        left = -1
    return np.array(p, dtype=np.float64), left


def _pass(level: int, last: bool):
    """Meetings of one group; with ``last`` the row left is rounded by its own probability."""
    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("_mark", "ascending"), ("_order", "ascending")])  # large ones first: a small one is left
        mark = rows.column("_mark").to_numpy()
        with np.errstate(over="ignore"):
            mark = splitmix(mark.view(np.uint64) + np.uint64(2 * level + 1)).view(np.int64)
        p, left = _meet(rows.column("size").to_numpy(), rows.column("_p").to_numpy(), mark)
        open_ = np.zeros(len(p), bool)
        if left >= 0 and last:
            u = (splitmix(splitmix(mark[left:left + 1].view(np.uint64))) >> np.uint64(11)).astype(np.float64)[0] / 2.0**53
            p[left] = 1.0 if u < p[left] else 0.0
        elif left >= 0:
            open_[left] = True
        at = rows.schema.get_field_index
        rows = rows.set_column(at("_p"), "_p", pa.array(p))
        return rows.set_column(at("_open"), "_open", pa.array(open_))
    return work


_ROW = "number of the row in the mix"   # a name that no column has


def _copies(docs: DataFrame, keep: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", source: str = "source",
            weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
            block_rows: int = 2048, fan_in: int = 512) -> DataFrame:
    """Per document the columns to be kept as k0, k1, ... and size, source_size, target and copies."""
    key = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`")))
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
                       key.alias("_mark"), F.col(f"`{doc_id}`").cast("string").alias("_order"))
    targets = source_targets(docs.select(F.col(f"`{source}`").alias("source"),
                                         word_count(F.col(f"`{text}`")).alias("size")), weights, share, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = (targets.withColumn("_m", F.least(times, F.lit(float(most))))
               .withColumn("_whole", F.floor("_m")).withColumn("_frac", F.col("_m") - F.floor("_m"))
               .withColumn("_blocks", F.ceil(F.col("n") / F.lit(block_rows))).drop("_m"))
    targets = staged(targets, "mix-targets")
    rows = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "n")
    rows = (rows.withColumn("_p", F.when(F.col("size") > 0, F.col("_frac")).otherwise(F.lit(0.0)))
            .withColumn("_block", F.pmod("_mark", "_blocks")).withColumn("_open", F.lit(False)))
    blocks = targets.agg(F.max("_blocks")).first()[0] or 1
    schema = rows.schema
    done = rows.groupBy("source", "_block").applyInArrow(_pass(0, blocks <= 1), schema)
    if blocks > 1:
        done = staged(done, "mix-blocks")
        closed, rows = done.where("not _open"), done.where("_open")
        level = 0
        while blocks > 1:
            level += 1
            blocks = -(-blocks // fan_in)
            rows = rows.withColumn("_block", F.floor(F.col("_block") / fan_in))
            rows = staged(rows.groupBy("source", "_block").applyInArrow(_pass(level, blocks <= 1), schema), "mix-level")
            closed, rows = closed.unionByName(rows.where("not _open")), rows.where("_open")
        done = closed
    return done.select(*[f"k{i}" for i in range(len(keep))], "size", "source_size", "target",
                       (F.col("_whole") + F.col("_p")).cast("long").alias("copies"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """Per document the kept columns and size, source_size, target, copies and taken (words taken)."""
    results = ("size", "source_size", "target", "copies", "taken")
    keep = kept_beside(keep, results)
    return (_copies(docs, keep, **options).withColumn("taken", F.col("copies") * F.col("size"))
            .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *results))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Rows are stored once with a number; sizes and numbers go through the rounding, texts do not.
    """
    names = tuple(docs.columns)
    rows = staged(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    named = rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("row").alias(_ROW))
    taken = _copies(named, (_ROW,), **options).where("copies > 0").select(F.col("k0").alias("row"), "copies")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.join(taken, "row").select(*[F.col(f"c{i}") for i in range(len(names))], times).drop("col").toDF(*names)
