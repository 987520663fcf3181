"""Which records of a key count when an accepted one hides those that follow within a horizon (JOIN-08).

The first record of a key is accepted; after an accepted one, the next to be accepted is the first that comes
``horizon`` seconds later or more. What a record hides depends on whether it was accepted itself, so this is a chain,
not a comparison with the record before. The next record of *every* record is found by one running
"last value" over records and their horizons in descending order of time; the chain from each key's first record is followed
by doubling: every round joins what is reached with the pointers and the pointers with themselves, so a chain
of n records takes log2(n) rounds, whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capaflow.session import stage_table


def next_after(records: DataFrame, horizon: int) -> DataFrame:
    """(key, id, next): for each of records(key, at, id) the id of the key's first record at ``at + horizon`` or later."""
    asks = records.select("key", (F.col("at") + horizon * 1_000_000).alias("at"), "id", F.lit(1).alias("ask"))
    both = records.select("key", "at", "id", F.lit(0).alias("ask")).unionByName(asks)
    # from the latest on, records before the asks of the same time, and the smaller id last
    order = Window.partitionBy("key").orderBy(F.desc("at"), "ask", F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newest = F.last(F.when(F.col("ask") == 0, F.col("id")), ignorenulls=True).over(order)
    return both.withColumn("next", newest).filter("ask = 1 and next is not null").select("key", "id", "next")


def accepted(records: DataFrame, key: str, at: str, id_: str, horizon: int) -> DataFrame:
    """The rows of ``records`` that are accepted; ``id_`` is unique, and orders records of the same time."""
    slim = stage_table(records.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(id_).alias("id")), "horizon")
    step = stage_table(next_after(slim, horizon), "horizon")
    reached = slim.groupBy("key").agg(F.min_by("id", F.struct("at", "id")).alias("id"))
    while not step.isEmpty():
        further = reached.join(step.select("id", "next"), "id").select("key", F.col("next").alias("id"))
        reached = stage_table(reached.unionByName(further), "horizon")
        step = stage_table(step.join(step.select(F.col("id").alias("next"), F.col("next").alias("_after")), "next")
                           .select("key", "id", F.col("_after").alias("next")), "horizon")
    return records.join(reached.select(F.col("id").alias(id_)), id_, "left_semi")
