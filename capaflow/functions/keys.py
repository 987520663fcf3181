"""Row-level expressions: ranking date, sort keys, weeks, validity filters.

All are built-in Column expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capaflow import config as C


def is_rs(product: Column) -> Column:
    return F.upper(product) == C.PRODUCT_RS


def rank_date(product: str = "product_type", attempt: str = "attempt") -> Column:
    """PRJ-01: prepare date for RS or second attempts, else notification date."""
    return F.when(is_rs(F.col(product)) | (F.col(attempt) == 1),
                  F.col("prepare_request_date")).otherwise(F.col("notification_sent_at"))


def exempt(product: str = "product_type", attempt: str = "attempt") -> Column:
    """FLT-02: RS or second attempt -- exempt from the sender guarantee."""
    return is_rs(F.col(product)) | (F.col(attempt) == 1)


def sort_key(step: str) -> Column:
    """PRJ-02: the ledger sort key of a step (for export/ordering parity)."""
    d, req = rank_date(), F.col("request_id")
    pr = F.col("priority").cast("string")
    parts = {
        C.STEP_SENDER: [F.col("province"), d, req],
        C.STEP_DRIVER: [F.col("unified_delivery_driver"), F.col("province"), pr, d, req],
        C.STEP_RESIDUAL: [F.col("unified_delivery_driver"), F.col("province"), d, req],
        C.STEP_PRINT: [pr, d, req],
        C.STEP_PHASE_2: [pr, d, req],
    }[step]
    return F.concat_ws("~", *parts)


def step_order(step: str) -> list[Column]:
    """Column order equal to the sort key of ``step`` inside its query prefix."""
    d, req = rank_date(), F.col("request_id")
    pr = F.col("priority").cast("string")
    return {
        C.STEP_SENDER: [d, req],
        C.STEP_DRIVER: [pr, d, req],
        C.STEP_RESIDUAL: [d, req],
        C.STEP_PRINT: [pr, d, req],
    }[step]


def partition_key(week: Column, step: Column | str) -> Column:
    step = F.lit(step) if isinstance(step, str) else step
    return F.concat_ws("~", F.date_format(week, "yyyy-MM-dd"), step)


def transition(df: DataFrame, step: str, week: Column, created_at: Column | None = None) -> DataFrame:
    """PRJ-03: the row a shipment gets when it moves to ``step`` of ``week``."""
    out = (df.withColumn("workflow_step", F.lit(step))
             .withColumn("delivery_week", week))
    out = out.withColumn("pk", partition_key(F.col("delivery_week"), step))
    if "priority" in df.columns or step == C.STEP_SENDER:
        out = out.withColumn("sk", sort_key(step))
    if created_at is not None:
        out = out.withColumn("created_at", created_at)
    return out


def next_weekday_strict(ts: Column, day: str = C.DELIVERY_WEEKDAY) -> Column:
    """PRJ-06: delivery week at ingest = strictly next configured weekday."""
    return F.next_day(F.to_date(ts), day)


def previous_or_same_weekday(ts: Column, day: str = C.DELIVERY_WEEKDAY) -> Column:
    """PRJ-07: delivery week at planning = previous-or-same weekday (UTC)."""
    return F.next_day(F.date_sub(F.to_date(ts), 7), day)


#: FLT-01: attempt present and both dates non-empty.
VALID_EVENT = ("attempt IS NOT NULL AND coalesce(length(prepare_request_date) > 0, false) "
               "AND coalesce(length(notification_sent_at) > 0, false)")


def valid_event() -> Column:
    """FLT-01 as a column."""
    return F.expr(VALID_EVENT)


def cancellable(today: Column | None = None) -> Column:
    """FLT-05: step SENDER, pk date parses, and the pk date is not today."""
    today = F.current_date() if today is None else today
    pk_date = F.try_to_date(F.split(F.col("pk"), "~").getItem(0), "yyyy-MM-dd")
    return ((F.col("workflow_step") == C.STEP_SENDER) & pk_date.isNotNull()
            & (pk_date != today))


def prepare_elements(timeline: DataFrame) -> DataFrame:
    """FLT-06: timeline elements of the two PREPARE categories with a PREPARE_ id."""
    return timeline.filter(F.col("category").isin(*C.PREPARE_CATEGORIES) & F.col("element_id").startswith(C.PREPARE_PREFIX))


def priority_table(spark: SparkSession) -> DataFrame:
    rows = [(p, k) for p, keys in sorted(C.PRIORITY_MAP.items()) for k in keys]
    return spark.createDataFrame(rows, "priority int, priority_key string")


def priority_key() -> Column:
    return F.concat(F.lit("PRODUCT_"), F.col("product_type"), F.lit(".ATTEMPT_"),
                    F.col("attempt").cast("string"))


def with_priority(df: DataFrame, strict: bool = False) -> DataFrame:
    """PRJ-04 (default 3) / PRJ-05 (strict: unknown key or attempt not 0/1 fails).

    The priority map is configuration (a handful of keys): broadcast.
    """
    pm = F.broadcast(priority_table(df.sparkSession)
                     .groupBy("priority_key").agg(F.min("priority").alias("_prio")))
    out = (df.withColumn("priority_key", priority_key())
             .join(pm, "priority_key", "left").drop("priority_key"))
    if strict:
        bad = F.col("_prio").isNull() | ~F.col("attempt").isin(0, 1)
        prio = F.when(bad, F.raise_error(F.concat(
            F.lit("no priority for product "), F.col("product_type"),
            F.lit(" attempt "), F.col("attempt").cast("string")))).otherwise(F.col("_prio"))
    else:
        prio = F.coalesce(F.col("_prio"), F.lit(C.DEFAULT_PRIORITY))
    return out.withColumn("priority", prio.cast("int")).drop("_prio")


def split_by_priority(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ-05 quarantine flavour: (rows with a strict priority, rejected rows)."""
    pm = F.broadcast(priority_table(df.sparkSession)
                     .groupBy("priority_key").agg(F.min("priority").alias("priority")))
    keyed = (df.withColumn("priority_key", priority_key())
               .join(pm, "priority_key", "left").drop("priority_key"))
    good = F.col("priority").isNotNull() & F.col("attempt").isin(0, 1)
    return keyed.filter(good), keyed.filter(~F.coalesce(good, F.lit(False))).drop("priority")
