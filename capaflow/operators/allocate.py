"""Driver capacity allocation (EVALUATE_DRIVER_CAPACITY / _RESIDUAL_CAPACITY).

The planner pages through the shipments of a (driver, province) in sort-key
order, keeps the first ``cap residual`` rows of every postal code and stops
when the province residual is used up. That greedy loop equals two running
positions compared with limits:

    cap_pos  = position in (week, driver, province, cap)     -> eligible if <= cap residual
    prov_pos = position among eligible rows of (week, driver, province)
                                                             -> accepted if <= province residual

Accepted rows move to the print step of the week, the others to the sender
step of the next week (ALC-07). Residuals come from JOIN-04 (used-capacity
snapshot, else capacity in force).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.functions import keys as K
from capaflow.operators.capacity import declared_and_used
from capaflow.operators.ranking import dealt, positions, strategy_for
from capaflow.session import concurrently, stage_table

DP = ["delivery_week", "unified_delivery_driver", "province"]


def step_keys(rows: DataFrame, *by: str) -> DataFrame:
    """Shipments per (tender, driver, province, cap, week): the limits that a step needs and the size of its groups follow from these few rows."""
    return rows.groupBy(*by, "tender_id", *DP, "cap").agg(F.count(F.lit(1)).alias("n"))


def needs(keys: DataFrame, geo_col: str) -> DataFrame:
    """(tender, driver, geo_key, week) that the rows behind ``keys`` need at one level."""
    return keys.select("tender_id", "unified_delivery_driver",
                       F.col(geo_col).alias("geo_key"), "delivery_week").distinct()


def _limits(keys: DataFrame, capacity: DataFrame, used: DataFrame | None,
            geo_col: str) -> DataFrame:
    # one row per key and week: staged, so that Spark knows how small it is and the shipments stay where they are
    return stage_table(declared_and_used(needs(keys, geo_col), capacity, used), "limits")


def allocate(rows: DataFrame, capacity: DataFrame, step: str,
             used: DataFrame | None = None, row_bound: int | None = None,
             keys: DataFrame | None = None) -> DataFrame:
    """ALC-03..06: flag each row of ``step`` as accepted or not.

    ``rows``: shipments of the step with ``tender_id, delivery_week,
    unified_delivery_driver, province, cap, priority, request_id`` and dates.
    ``keys``: their ``step_keys``, if they are staged already; ``row_bound``: rows that no group exceeds, if known.
    Adds ``cap_declared, cap_residual, prov_declared, prov_residual,
    cap_pos, prov_pos, accepted``.
    """
    order = K.step_order(step)
    if keys is None:
        keys = stage_table(step_keys(rows), "keys")
    prov_limits, cap_limits, size = concurrently(
        *[lambda c=c: _limits(keys, capacity, used, c) for c in ("province", "cap")],
        lambda: keys.groupBy(*DP).agg(F.sum("n").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first())
    if row_bound is None or (size.largest or 0) < row_bound:
        row_bound = size.largest or 0
    prov = (prov_limits
            .select("unified_delivery_driver", F.col("geo_key").alias("province"), "delivery_week",
                    F.col("declared_capacity").alias("prov_declared"),
                    (F.col("declared_capacity") - F.col("used_capacity")).alias("prov_residual")))
    cap = (cap_limits
           .select("unified_delivery_driver", F.col("geo_key").alias("cap"), "delivery_week",
                   F.col("declared_capacity").alias("cap_declared"),
                   F.greatest(F.lit(0), F.col("declared_capacity") - F.col("used_capacity"))
                    .alias("cap_residual")))
    strategy = strategy_for(rows, DP, row_bound)
    # one exchange serves both ranks where a (driver, province) of a week, which holds its caps, fits one task; limits are met behind it
    sent = dealt(rows, DP, size.rows or 0) if strategy == "window" else rows
    with_lim = (sent.join(prov, DP, "left")
                    .join(cap, ["unified_delivery_driver", "cap", "delivery_week"], "left"))
    fits_cap = F.coalesce(F.col("cap_pos") <= F.col("cap_residual"), F.lit(False))
    if strategy == "window":
        flagged = positions(with_lim, DP + ["cap"], order, name="cap_pos", strategy="window").withColumn("_fits", fits_cap)
        ranked = positions(flagged, DP + ["_fits"], order, name="prov_pos", strategy="window")
        return (ranked.withColumn("prov_pos", F.when(F.col("_fits"), F.col("prov_pos")))
                      .withColumn("accepted", F.coalesce(F.col("prov_pos") <= F.col("prov_residual"), F.lit(False)))
                      .drop("_fits"))
    cap_ranked = positions(with_lim, DP + ["cap"], order, name="cap_pos", strategy=strategy_for(rows, DP + ["cap"], row_bound))
    eligible = cap_ranked.filter(fits_cap)
    blocked = (cap_ranked.filter(~fits_cap)
                         .withColumn("prov_pos", F.lit(None).cast("int"))
                         .withColumn("accepted", F.lit(False)))
    prov_ranked = positions(eligible, DP, order, name="prov_pos", strategy="range")
    accepted = prov_ranked.withColumn(
        "accepted", F.coalesce(F.col("prov_pos") <= F.col("prov_residual"), F.lit(False)))
    return accepted.unionByName(blocked)


def outcome(allocated: DataFrame) -> DataFrame:
    """ALC-07: accepted -> print step of the week; rejected -> sender step of week + 7."""
    nxt = F.when(F.col("accepted"), F.lit(C.STEP_PRINT)).otherwise(F.lit(C.STEP_SENDER))
    wk = F.when(F.col("accepted"), F.col("delivery_week")) \
          .otherwise(F.date_add("delivery_week", 7))
    return allocated.withColumn("next_step", nxt).withColumn("next_week", wk)


def used_capacity(allocated: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """AGG-11: used capacity per (driver, geo_key, week) after a step.

    Province level: every (driver, province, week) that had input rows and a
    positive residual gets a row (possibly +0). Cap level: a row only where
    something was accepted. Used adds to ``previous``; declared is the
    value the step planned with.
    """
    # one pass over the shipments; both levels are made of its few rows
    per_cap = stage_table(allocated.groupBy(*DP, "cap", "prov_residual", "prov_declared", "cap_declared")
                                   .agg(F.count_if(F.col("accepted")).alias("n")), "accepted")
    prov = (per_cap.filter(F.col("prov_residual") > 0)
                     .groupBy(*DP)
                     .agg(F.sum("n").cast("int").alias("inc"),
                          F.first("prov_declared").alias("declared_capacity"))
                     .select("unified_delivery_driver", F.col("province").alias("geo_key"),
                             "delivery_week", "inc", "declared_capacity",
                             F.lit("PROVINCE").alias("geo_level")))
    cap = (per_cap.filter(F.col("n") > 0)
                    .groupBy("unified_delivery_driver", "cap", "delivery_week")
                    .agg(F.sum("n").cast("int").alias("inc"),
                         F.first("cap_declared").alias("declared_capacity"))
                    .select("unified_delivery_driver", F.col("cap").alias("geo_key"),
                            "delivery_week", "inc", "declared_capacity",
                            F.lit("CAP").alias("geo_level")))
    inc = prov.unionByName(cap)
    key = ["unified_delivery_driver", "geo_key", "delivery_week"]
    if previous is None:
        return inc.select(*key, "geo_level", F.col("inc").alias("used_capacity"),
                          "declared_capacity")
    prev = previous.select(*key, F.col("geo_level").alias("_pl"),
                           F.col("used_capacity").alias("_pu"),
                           F.col("declared_capacity").alias("_pd"))
    merged = inc.join(prev, key, "full")
    return merged.select(
        *key, F.coalesce("geo_level", "_pl").alias("geo_level"),
        (F.coalesce("inc", F.lit(0)) + F.coalesce("_pu", F.lit(0))).cast("int").alias("used_capacity"),
        F.coalesce("declared_capacity", "_pd").alias("declared_capacity"))
