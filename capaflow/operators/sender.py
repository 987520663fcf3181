"""Sender guarantee step (EVALUATE_SENDER_LIMIT).

Counters and limits are derived from the ledger with aggregates -- nothing
is incremented in place, so a re-run produces the same numbers.

* AGG-03 exempt counters per (week, province, product)
* AGG-07/08 estimate totals and the latest total per product
* AGG-09 sender limit = floor(net capacity x weekly / total)
* JOIN-07 estimates of the senders present, read at week - 7 days
* ALC-01/02 first ``limit`` non-exempt shipments per sender go to the driver
  step, the rest to the residual step; exempt ones always to the driver step
* AGG-10 used sender limit per (pa, product, province, week - 7 days)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.functions import keys as K
from capaflow.operators.ranking import dealt, positions, strategy_for

SENDER_KEY = ["delivery_week", "province", "sender_pa_id", "product_type"]


def exempt_counters(shipments: DataFrame) -> DataFrame:
    """AGG-03: count of exempt shipments (RS, or second attempt) per week/province/product."""
    return (shipments.filter(K.exempt())
                     .groupBy("delivery_week", "province", "product_type")
                     .agg(F.count(F.lit(1)).alias("number_of_shipments")))


def estimate_totals(estimates: DataFrame) -> DataFrame:
    """AGG-07: sum of weekly estimates per (date, product, province, last_update)."""
    return (estimates.groupBy("delivery_date", "product_type", "province", "last_update")
                     .agg(F.sum("weekly_estimate").cast("bigint").alias("number_of_shipments")))


def latest_totals(totals: DataFrame) -> DataFrame:
    """AGG-08: the total of the greatest ``last_update`` per (date, product, province)."""
    return (totals.groupBy("delivery_date", "product_type", "province")
                  .agg(F.max_by("number_of_shipments", "last_update").alias("total_estimate")))


def sender_limits(estimates: DataFrame, net: DataFrame, totals: DataFrame) -> DataFrame:
    """AGG-09 + JOIN-07: limit per (week, province, pa, product).

    ``estimates`` rows are read at ``delivery_date = week - 7``. The total of
    a component with more than one non-RS product is the sum of the latest
    totals of those products; otherwise the product's own latest total. The
    product's component is the one whose product list contains it; none ->
    limit 0. Arithmetic is done in double in the order
    ``floor(capacity * (weekly / total))``.
    """
    comp = net.select("tender_id", "province", "delivery_week", "component", "products",
                      "net_capacity")
    comp_products = comp.select("province", "delivery_week", "component",
                                F.explode("products").alias("product_type"))
    lt = latest_totals(totals).withColumn("delivery_week", F.date_add("delivery_date", 7))
    relevant = (comp_products.filter(~K.is_rs(F.col("product_type")))
                             .join(lt, ["delivery_week", "province", "product_type"], "left")
                             .groupBy("province", "delivery_week", "component")
                             .agg(F.count(F.lit(1)).alias("_n_relevant"),
                                  F.sum(F.coalesce("total_estimate", F.lit(0))).alias("_sum_relevant")))
    est = estimates.select(F.col("pa_id").alias("sender_pa_id"), "product_type", "province",
                           F.date_add("delivery_date", 7).alias("delivery_week"),
                           "weekly_estimate")
    with_comp = (est.join(comp_products, ["province", "delivery_week", "product_type"], "left")
                    .join(comp, ["province", "delivery_week", "component"], "left")
                    .join(relevant, ["province", "delivery_week", "component"], "left")
                    .join(lt.select("delivery_week", "province", "product_type", "total_estimate"),
                          ["delivery_week", "province", "product_type"], "left"))
    total = F.when(F.col("_n_relevant") > 1, F.col("_sum_relevant")) \
             .otherwise(F.coalesce(F.col("total_estimate"), F.lit(0)))
    limit = F.when(F.col("component").isNull() | (total == 0), F.lit(0)).otherwise(
        F.floor(F.col("net_capacity").cast("double")
                * (F.col("weekly_estimate").cast("double") / total.cast("double"))))
    return with_comp.select(*SENDER_KEY, F.col("weekly_estimate"),
                            total.cast("bigint").alias("total_estimate"),
                            F.col("net_capacity"),
                            limit.cast("int").alias("sender_limit"))


def split_by_sender_limit(enriched: DataFrame, limits: DataFrame,
                          used: DataFrame | None = None, row_bound: int | None = None,
                          rows: int | None = None) -> DataFrame:
    """ALC-01/02: next step of each shipment of the sender step.

    ``enriched``: shipments with driver and priority. Non-exempt rows are
    ranked per (week, province, pa, product) by (ranking date, request id);
    the first ``limit - used`` go to the driver step. No estimate -> limit 0.
    ``row_bound``: rows that no such key exceeds, ``rows``: those of ``enriched``, if known.
    """
    lim = limits.select(*SENDER_KEY, "sender_limit")
    if used is not None:
        u = used.select(F.col("pa_id").alias("sender_pa_id"), "product_type", "province",
                        F.date_add("delivery_date", 7).alias("delivery_week"),
                        F.col("number_of_shipment").alias("_used"))
        lim = (lim.join(u, SENDER_KEY, "left")
                  .withColumn("sender_limit",
                              F.col("sender_limit") - F.coalesce(F.col("_used"), F.lit(0)))
                  .drop("_used"))
    flagged = enriched.withColumn("exempt", K.exempt())
    own = flagged.filter(~F.col("exempt"))
    strategy = strategy_for(own, SENDER_KEY, row_bound)
    if strategy == "window" and rows is not None:
        own = dealt(own, SENDER_KEY, rows)
    guarded = own.join(lim, SENDER_KEY, "left")
    ranked = positions(guarded, SENDER_KEY, K.step_order(C.STEP_SENDER), name="sender_rank", strategy=strategy)
    within = ranked.withColumn(
        "next_step", F.when(F.col("sender_rank") <= F.coalesce(F.col("sender_limit"), F.lit(0)),
                            F.lit(C.STEP_DRIVER)).otherwise(F.lit(C.STEP_RESIDUAL)))
    exempt_rows = (flagged.filter(F.col("exempt"))
                          .withColumn("sender_limit", F.lit(None).cast("int"))
                          .withColumn("sender_rank", F.lit(None).cast("int"))
                          .withColumn("next_step", F.lit(C.STEP_DRIVER)))
    return within.unionByName(exempt_rows)


def used_sender_limits(split: DataFrame) -> DataFrame:
    """AGG-10: accepted non-exempt shipments per sender key at week - 7, only > 0."""
    acc = split.filter(~F.col("exempt") & (F.col("next_step") == C.STEP_DRIVER))
    return (acc.groupBy(*SENDER_KEY)
               .agg(F.count(F.lit(1)).cast("int").alias("number_of_shipment"),
                    F.max("sender_limit").alias("sender_limit"))
               .select(F.concat_ws("~", "sender_pa_id", "product_type", "province").alias("pk"),
                       F.date_sub("delivery_week", 7).alias("delivery_date"),
                       F.col("sender_pa_id").alias("pa_id"), "product_type", "province",
                       "number_of_shipment", "sender_limit"))
