"""Print capacity step (EVALUATE_PRINT_CAPACITY) and the bypass paths.

The print queue of a week is ordered by (priority as string, ranking date,
request id). With daily capacity ``D``, ``E`` releases a day and weekly
capacity ``W = 7 D``:

* ALC-10 rows with position ``<= W`` are released to phase 2; day
  ``ceil(pos / D)``, release ``ceil(pos_in_day / ceil(D / E))`` of that day
* ALC-11 rows with position ``> W`` (the tail) go to next week's sender step
* ALC-13 per-release counts and the running total sent
* AGG-12 the print counter of the week

The position is a global rank per week (``ranking.positions``), which the
skew-proof strategy splits over many tasks.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.functions import keys as K
from capaflow.operators.capacity import print_capacity_in_force
from capaflow.operators.ranking import positions
from capaflow.session import stage_table
from capaflow.sources.ledger_store import SORTED_BY, range_scan


def slice_size(daily: F.Column, executions: F.Column) -> F.Column:
    """ALC-09: rows per release = ceil(daily / executions per day)."""
    return F.ceil(daily.cast("double") / executions.cast("double")).cast("int")


def print_queue(print_rows: DataFrame, config: DataFrame, inclusive: bool = True,
                row_bound: int | None = None) -> DataFrame:
    """Rank the print rows of every week and attach the capacity in force."""
    cap = print_capacity_in_force(print_rows, config, inclusive)
    ranked = positions(print_rows, ["delivery_week"], K.step_order(C.STEP_PRINT), name="print_pos",
                       row_bound=row_bound)
    # the capacity table has one row per week: small, joined on the week
    out = ranked.join(F.broadcast(cap), "delivery_week")
    d = F.col("daily_print_capacity")
    return (out.withColumn("weekly_print_capacity", d * C.PRINT_WEEKLY_WORKING_DAYS)
               .withColumn("slice_size", slice_size(d, F.col("executions_per_day"))))


def release(queue: DataFrame) -> DataFrame:
    """ALC-10/11: phase-2 release plan (day, release number) or tail to next week."""
    pos, d = F.col("print_pos"), F.col("daily_print_capacity")
    head = pos <= F.col("weekly_print_capacity")
    day = F.ceil(pos.cast("double") / d.cast("double")).cast("int")
    in_day = pos - (day - 1) * d
    rel = F.ceil(in_day.cast("double") / F.col("slice_size").cast("double")).cast("int")
    return (queue.withColumn("released", head)
                 .withColumn("release_day", F.when(head, day))
                 .withColumn("release_no", F.when(head, rel))
                 .withColumn("next_step", F.when(head, F.lit(C.STEP_PHASE_2))
                                           .otherwise(F.lit(C.STEP_SENDER)))
                 .withColumn("next_week", F.when(head, F.col("delivery_week"))
                                           .otherwise(F.date_add("delivery_week", 7))))


def release_counts(released: DataFrame) -> DataFrame:
    """ALC-13: rows per (week, day, release) and running total sent to phase 2."""
    per = (released.filter(F.col("released"))
                   .groupBy("delivery_week", "release_day", "release_no")
                   .agg(F.count(F.lit(1)).alias("sent")))
    w = (Window.partitionBy("delivery_week").orderBy("release_day", "release_no")
               .rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("sent_to_phase_two", F.sum("sent").over(w))


def print_counter(released: DataFrame) -> DataFrame:
    """AGG-12: print counter per week."""
    return (released.groupBy("delivery_week")
                    .agg(F.count(F.lit(1)).alias("number_of_shipments"),
                         F.first("daily_print_capacity").alias("daily_print_capacity"),
                         F.first("weekly_print_capacity").alias("weekly_print_capacity"),
                         F.first("executions_per_day").alias("daily_execution_number"),
                         F.count_if(F.col("released")).alias("sent_to_phase_two"),
                         F.count_if(~F.col("released")).alias("sent_to_next_week"))
                    .withColumn("stop_send_to_phase_two",
                                F.col("sent_to_phase_two") >= F.col("number_of_shipments")))


PAGE_ROWS = 1000


def page(queue: DataFrame, rows: int = PAGE_ROWS, after: int = 0, descending: bool = False) -> DataFrame:
    """ALC-12: one page of each week's queue. ``after`` is the cursor: the number of rows already read,
    from the head of the queue or, descending, from its tail."""
    pos = F.col("print_pos")
    if descending:
        size = queue.groupBy("delivery_week").agg(F.max("print_pos").alias("_size"))
        queue = queue.join(size, "delivery_week")
        pos = F.col("_size") - F.col("print_pos") + 1
    return queue.filter((pos > after) & (pos <= after + rows)).drop("_size")


def switch_off(sender_rows: DataFrame, execution_limit: int = C.SWITCH_OFF_EXECUTION_LIMIT,
               current_week: bool = True) -> tuple[DataFrame, DataFrame]:
    """ALC-15: all calls of the switch-off at once. The sender queue of each week in key order, numbered into calls of
    ``execution_limit`` rows and moved, with strict priority, to phase 2 of the week that is current: the queue's own,
    or the one before it when the calls ask for the next week's queue. Returns the moved and the rejected rows."""
    ok, rejected = K.split_by_priority(sender_rows)
    ranked = positions(ok.withColumn("_sk", K.sort_key(C.STEP_SENDER)), ["delivery_week"], [F.col("_sk")], name="switch_pos")
    out = ranked.withColumn("batch_no", F.ceil(F.col("switch_pos") / F.lit(execution_limit)).cast("int"))
    target = F.col("delivery_week") if current_week else F.date_sub("delivery_week", 7)
    return K.transition(out.drop("_sk").withColumn("queue_week", F.col("delivery_week")), C.STEP_PHASE_2, target), rejected


@dataclass(frozen=True)
class SwitchOffCall:
    """What one call moved and rejected, and where the next one goes on (``cursor`` is None once the queue is empty)."""

    moved: DataFrame
    rejected: DataFrame
    processed: int
    cursor: str | None


def switch_off_call(spark: SparkSession, path: str, today: datetime.date, execution_limit: int = C.SWITCH_OFF_EXECUTION_LIMIT,
                    cursor: str | None = None, current_week: bool = True) -> SwitchOffCall:
    """ALC-15, one call: the next ``execution_limit`` rows after ``cursor`` of the stored sender queue of the
    current or the next week go to phase 2 of the current week, that of the Monday on or before ``today``."""
    monday = today - datetime.timedelta(days=today.weekday())
    week = monday if current_week else monday + datetime.timedelta(days=7)
    rows = stage_table(range_scan(spark, path, C.STEP_SENDER, week, after=cursor, limit=execution_limit + 1), "switch-off")
    last = rows.agg(F.count(F.lit(1)).alias("n"), F.max(SORTED_BY).alias("sk")).first()
    more = last["n"] > execution_limit
    if more:   # one row beyond the limit says that the queue goes on
        rows = rows.filter(F.col(SORTED_BY) < last["sk"])
    ok, rejected = K.split_by_priority(rows.drop("priority"))
    at = rows.agg(F.max(SORTED_BY)).first()[0]
    return SwitchOffCall(K.transition(ok, C.STEP_PHASE_2, F.lit(monday).cast("date")), rejected,
                         min(last["n"], execution_limit), at if more else None)


def print_totals(moved: DataFrame) -> DataFrame:
    """ALC-14: the print counter of each week after the bypass: all rows that it moved."""
    return moved.groupBy("delivery_week").agg(F.count(F.lit(1)).alias("print_counter"))
