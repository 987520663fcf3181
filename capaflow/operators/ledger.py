"""The append-only shipment ledger: history, latest state, lookups, deletes.

Moving a shipment between steps appends a row under a new (pk, sk); state
is the newest row per request (ALC-17), history all its rows (LKP-01).
Deletes and resets rewrite only the affected week partitions
(``left_anti``), never the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.functions import keys as K
from capaflow.session import few_rows, stage_table

LEDGER_COLS = ["delivery_week", "workflow_step", "pk", "request_id", "iun", "product_type",
               "attempt", "sender_pa_id", "province", "cap", "unified_delivery_driver",
               "priority", "prepare_request_date", "notification_sent_at", "created_at"]

STEP_SEQ = {C.STEP_SENDER: 0, C.STEP_DRIVER: 1, C.STEP_RESIDUAL: 1, C.STEP_PRINT: 2,
            C.STEP_PHASE_2: 3}


def _stamp(week: Column, hours: int) -> Column:
    # the day as pk and output write it, so that it is formatted once a row
    return F.concat(F.date_format(week, "yyyy-MM-dd"), F.lit(f"T{hours:02d}:00:00.000Z"))


def _rows(df: DataFrame, step: str, week: Column, hours: int) -> DataFrame:
    base = df
    for c, default in (("unified_delivery_driver", F.lit(None).cast("string")),
                       ("priority", F.lit(None).cast("int"))):
        if c not in base.columns:
            base = base.withColumn(c, default)
    out = (base.withColumn("created_at", _stamp(F.col("delivery_week"), hours))
               .withColumn("delivery_week", week)
               .withColumn("workflow_step", F.lit(step)))
    out = out.withColumn("pk", K.partition_key(F.col("delivery_week"), step))
    return out.select(*LEDGER_COLS)


def ledger_history(shipments: DataFrame, split: DataFrame, driver: DataFrame,
                   residual: DataFrame, released: DataFrame) -> DataFrame:
    """All ledger rows one planning round writes, one per (request, step)."""
    wk = F.col("delivery_week")
    nxt = F.date_add(wk, 7)
    pushed = (driver.filter(~F.col("accepted"))
              .unionByName(residual.filter(~F.col("accepted")), allowMissingColumns=True)
              .select(*[c for c in LEDGER_COLS if c not in ("workflow_step", "pk", "created_at")])
              .unionByName(released.filter(~F.col("released"))
                           .select(*[c for c in LEDGER_COLS
                                     if c not in ("workflow_step", "pk", "created_at")])))
    parts = [
        _rows(shipments, C.STEP_SENDER, wk, 0),
        _rows(split.filter(F.col("next_step") == C.STEP_DRIVER), C.STEP_DRIVER, wk, 1),
        _rows(split.filter(F.col("next_step") == C.STEP_RESIDUAL), C.STEP_RESIDUAL, wk, 1),
        _rows(released, C.STEP_PRINT, wk, 2),
        _rows(released.filter("released"), C.STEP_PHASE_2, wk, 3),
        _rows(pushed, C.STEP_SENDER, nxt, 4),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_step(ledger: DataFrame) -> list[DataFrame]:
    """The ledger in parts, one a step and one for rows of no known step: read one after the other, each part's
    exchange is gone before the next one's is written, and a ledger that is a union of steps is not read again."""
    at = F.col("workflow_step")
    known = list(STEP_SEQ)
    return [*[ledger.filter(at == s) for s in known], ledger.filter(~F.coalesce(at.isin(known), F.lit(False)))]


def rows_of(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the staged request ids: the ledger stays where it is for few ids; for more, a step after the other meets them and what is found is staged."""
    if few_rows(ids):
        return ledger.join(F.broadcast(ids), "request_id", "left_semi").select(*ledger.columns)
    parts = [stage_table(part.join(ids, "request_id", "left_semi").select(*ledger.columns), "rows-of-ids") for part in by_step(ledger)]
    return reduce(DataFrame.unionByName, parts)


def latest_per_request(ledger: DataFrame) -> DataFrame:
    """ALC-17: newest ledger row per request (``max_by`` -- no sort, partial agg)."""
    cols = [c for c in ledger.columns if c != "request_id"]
    latest = (ledger.groupBy("request_id")
                    .agg(F.max_by(F.struct(*cols), "created_at").alias("r")))
    return latest.select("request_id", "r.*")


def latest_image(images: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """ALC-16: latest CDC image per key (``ROW_NUMBER() ... DESC = 1`` as ``max_by``)."""
    cols = [c for c in images.columns if c not in keys]
    return (images.groupBy(*keys).agg(F.max_by(F.struct(*cols), time_col).alias("r"))
                  .select(*keys, "r.*"))


def delete_requests(ledger: DataFrame, request_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOIN-14 / MNT-02: (remaining ledger, deleted rows) for a request-id list."""
    ids = request_ids.select("request_id").distinct()
    return (ledger.join(ids, "request_id", "left_anti"),
            ledger.join(ids, "request_id", "left_semi"))


def table_rows(name: str, df: DataFrame, key: Column, week: Column | str, n: Column | str) -> DataFrame:
    """A counter table as (table, key, delivery_week, n), the shape in which maintenance jobs report."""
    week, n = (F.col(c) if isinstance(c, str) else c for c in (week, n))
    return df.select(F.lit(name).alias("table"), key.alias("key"), week.alias("delivery_week"), n.cast("bigint").alias("n"))


def apply_tombstones(ledger: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The ledger once cancellations are applied: a cancelled row is under its ``DELETED~`` key only."""
    gone = tombstones.select(F.regexp_replace("pk", f"^{C.DELETED_PREFIX}", "").alias("pk"), "request_id")
    return ledger.join(gone, ["pk", "request_id"], "left_anti").unionByName(tombstones.select(*ledger.columns))


def active(ledger: DataFrame) -> DataFrame:
    """What readers of the ledger see: no tombstones."""
    return ledger.filter(~F.col("pk").startswith(C.DELETED_PREFIX))


def tombstoned(rows: DataFrame) -> DataFrame:
    """Ledger rows under their ``DELETED~`` keys."""
    return rows.withColumn("pk", F.concat(F.lit(C.DELETED_PREFIX), F.col("pk")))
