"""Running positions (1-based ``row_number``) inside groups, skew-proof.

Every limit in the planner is "the first *k* rows of a group in a given
order". ``positions`` computes that position.

Two physical strategies give the same numbers:

* ``window`` -- ``row_number() over (partition by keys order by ...)``. One
  hash exchange on the keys; a group is sorted inside a single task, so a
  key holding a third of the data would land in one task.
* ``range``  -- the group is split over many tasks: range-partition on
  ``(keys, order)`` (sampled boundaries split a hot key), sort inside each
  partition, stage the rows with their partition id and row index as
  columns (written under the checkpoint folder) so they are stable, count rows
  per (partition, key), turn the counts into offsets with a small window,
  and add the offset to the row index inside the partition. No task ever
  holds more than one range partition; the offset table has at most
  ``#keys + #partitions`` rows.

``auto`` (default) proves a bound: a row bound given by the caller, else the
largest group from one map-side-combined aggregation, which reads only the
group's columns. ``window`` is used only when the bound fits one task
(``capaflow.rank.maxGroupRows``, default 5 000 000 rows); otherwise ``range``.
Callers whose rows come out of joins measure (``strategy_for``) before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capaflow.session import broadcast_checked, ensure_checkpoint_dir, stage_table

STRATEGY_CONF = "capaflow.rank.strategy"
MAX_GROUP_CONF = "capaflow.rank.maxGroupRows"
TASK_ROWS_CONF = "capaflow.rank.taskRows"


def _conf(df: DataFrame, key: str, default: str) -> str:
    return df.sparkSession.conf.get(key, default)


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    if not by:
        return df.count()
    row = df.groupBy(*by).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def strategy_for(df: DataFrame, by: Sequence[str], row_bound: int | None = None) -> str:
    """Strategy for ranks inside groups of ``df`` by ``by``: ``window`` if every group is proven to fit one task, else ``range``."""
    strategy = _conf(df, STRATEGY_CONF, "auto")
    if strategy != "auto":
        return strategy
    limit = int(_conf(df, MAX_GROUP_CONF, "5000000"))
    fits = (row_bound is not None and row_bound <= limit) or largest_group(df, by) <= limit
    return "window" if fits else "range"


def dealt(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """``df`` hashed by ``by`` for a sort, ``capaflow.rank.taskRows`` rows (default 250 000) a task on average.

    Left alone, Spark makes tasks by compressed bytes, and a sort needs many times that in memory.
    """
    tasks = -(-rows // int(_conf(df, TASK_ROWS_CONF, "250000")))
    if tasks <= 1:
        return df.repartition(*by)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *by)


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
              name: str = "pos", strategy: str | None = None,
              num_partitions: int | None = None, row_bound: int | None = None) -> DataFrame:
    """Add column ``name`` = 1-based position of each row inside its ``by`` group.

    ``order`` must be a total order inside a group (end it with a unique
    column) so the result is deterministic. ``row_bound`` is an upper bound
    on the rows of ``df`` the caller has already proven (e.g. the row count
    of the staged table it derives from); it lets ``auto`` skip measuring.
    """
    strategy = strategy or strategy_for(df, by, row_bound)
    if strategy == "window":
        w = Window.partitionBy(*by).orderBy(*_as_cols(order)) if by else \
            Window.orderBy(*_as_cols(order))
        return df.withColumn(name, F.row_number().over(w))
    if strategy != "range":
        raise ValueError(f"unknown rank strategy {strategy!r}")
    return _range_positions(df, list(by), _as_cols(order), name, num_partitions)


def _range_positions(df: DataFrame, by: list[str], order: list[Column], name: str,
                     num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = _as_cols(by) + order
    staged = (df.repartitionByRange(n, *sort_cols)
                .sortWithinPartitions(*sort_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_row", F.monotonically_increasing_id()))
    # partition id and row index are stored as columns, so the staged copy
    # keeps them whatever the physical layout of the read-back
    staged = stage_table(staged, "rank-staged")
    stats = staged.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"),
                                            F.min("_row").alias("_first"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = (stats.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
                    .select("_pid", *by, (F.col("_before") - F.col("_first")).alias("_base")))
    offsets = stage_table(offsets, "rank-offsets")
    out = staged.join(broadcast_checked(offsets), ["_pid", *by])
    return (out.withColumn(name, F.col("_row") + F.col("_base") + 1)
               .drop("_pid", "_row", "_base"))
