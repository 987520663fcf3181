"""Registered queries: one per operator of the inventory (ids lower-cased).

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
test tables (or data Spark derives from them). Output columns follow
``results.normalize`` so they compare one-to-one with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.functions import keys as K
from capaflow.operators import allocate as A
from capaflow.operators import capacity as CAP
from capaflow.operators import printing as P
from capaflow.plans import weekly as W
from capaflow.plans.results import normalize, plan_results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: normalize(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# --- flagship -----------------------------------------------------------------
@query("weekly_plan")
def weekly_plan(spark, sf_dir):
    """Final placement of every shipment: phase 2 (with release day/no) or next week."""
    r = plan_results(spark, sf_dir)
    return W.placements(r.sender, r.caps, r.released)


@query("weekly_plan_chained")
def weekly_plan_chained(spark, sf_dir):
    """Two rounds of chained weeks, as its SQL: what a week cannot place is planned once more in the next week.

    What is pushed a second time stays in the sender step; ``run_weeks`` without ``rounds`` plans it to the end.
    """
    return W.run_weeks(spark, W.load_inputs(spark, sf_dir), rounds=2)


# --- sender step ----------------------------------------------------------------
@query("alc_01")
def alc_01(spark, sf_dir):
    """Sender-limit split of every shipment of the sender step."""
    s = plan_results(spark, sf_dir).sender.split
    return s.select("request_id", "delivery_week", "province", "sender_pa_id", "product_type",
                    "exempt", "sender_limit", "sender_rank", "next_step")


@query("alc_02")
def alc_02(spark, sf_dir):
    """Sender step output: rows per (week, next step, exempt)."""
    s = plan_results(spark, sf_dir).sender.split
    return s.groupBy("delivery_week", "next_step", "exempt").agg(F.count(F.lit(1)).alias("n"))


@query("flt_02")
def flt_02(spark, sf_dir):
    """RS-or-second-attempt split: exempt and guaranteed rows per week/province."""
    shp = W.load_inputs(spark, sf_dir).shipments
    return (shp.withColumn("exempt", K.exempt())
               .groupBy("delivery_week", "province", "exempt").agg(F.count(F.lit(1)).alias("n")))


@query("agg_03")
def agg_03(spark, sf_dir):
    """Exempt counters per (week, province, product)."""
    return plan_results(spark, sf_dir).sender.exempt


@query("join_02")
def join_02(spark, sf_dir):
    """Latest valid province capacity per driver for every (province, week) planned."""
    inp = W.load_inputs(spark, sf_dir)
    return CAP.drivers_on_province(inp.province_weeks, inp.capacity).drop("activation_from")


@query("agg_04")
def agg_04(spark, sf_dir):
    """Driver components by intersecting product sets, with summed capacity."""
    return plan_results(spark, sf_dir).sender.components


@query("agg_05")
def agg_05(spark, sf_dir):
    """Net component capacity after exempt counters."""
    return plan_results(spark, sf_dir).sender.net


@query("agg_07")
def agg_07(spark, sf_dir):
    """Estimate totals per (date, product, province, last update)."""
    return plan_results(spark, sf_dir).sender.totals


@query("agg_08")
def agg_08(spark, sf_dir):
    """Latest estimate total per (date, product, province)."""
    from capaflow.operators.sender import latest_totals
    return latest_totals(plan_results(spark, sf_dir).sender.totals)


@query("agg_09")
def agg_09(spark, sf_dir):
    """Sender limits of the senders present in the sender step."""
    r = plan_results(spark, sf_dir)
    present = r.inputs.shipments.select("delivery_week", "province", "sender_pa_id",
                                        "product_type").distinct()
    return r.sender.limits.join(present, ["delivery_week", "province", "sender_pa_id",
                                          "product_type"], "left_semi")


@query("join_07")
def join_07(spark, sf_dir):
    """Estimate of every sender present, read at week - 7 days (missing -> null)."""
    inp = W.load_inputs(spark, sf_dir)
    present = (inp.shipments.filter(~K.exempt())
               .select("delivery_week", "province", "sender_pa_id", "product_type").distinct())
    est = inp.estimates.select(F.col("pa_id").alias("sender_pa_id"), "product_type", "province",
                               F.date_add("delivery_date", 7).alias("delivery_week"),
                               "weekly_estimate")
    return present.join(est, ["delivery_week", "province", "sender_pa_id", "product_type"], "left")


@query("agg_10")
def agg_10(spark, sf_dir):
    """Used sender limit per (pa, product, province, week - 7)."""
    from capaflow.operators.sender import used_sender_limits
    return used_sender_limits(plan_results(spark, sf_dir).sender.split)


@query("join_05")
def join_05(spark, sf_dir):
    """Driver and priority assigned to every shipment."""
    e = plan_results(spark, sf_dir).sender.enriched
    return e.select("request_id", "unified_delivery_driver", "priority")


@query("prj_04")
def prj_04(spark, sf_dir):
    """Priority per shipment, default 3 when the product/attempt key is absent."""
    shp = W.load_inputs(spark, sf_dir).shipments
    return (K.with_priority(shp).groupBy("product_type", "attempt", "priority")
             .agg(F.count(F.lit(1)).alias("n")))


@query("prj_01")
def prj_01(spark, sf_dir):
    """Ranking date of every shipment."""
    shp = W.load_inputs(spark, sf_dir).shipments
    return shp.select("request_id", K.rank_date().alias("rank_date"))


# --- driver / residual steps ------------------------------------------------------
ALLOC_COLS = ["request_id", "delivery_week", "unified_delivery_driver", "province", "cap",
              "cap_declared", "cap_residual", "prov_declared", "prov_residual",
              "cap_pos", "prov_pos", "accepted"]


@query("join_01")
def join_01(spark, sf_dir):
    """Capacity in force for every (driver, geo key, week) the driver step needs."""
    r = plan_results(spark, sf_dir)
    keys = r.caps.keys(C.STEP_DRIVER)
    needs = A.needs(keys, "province").unionByName(A.needs(keys, "cap"))
    return CAP.capacity_in_force(needs, r.inputs.capacity)


@query("alc_03")
def alc_03(spark, sf_dir):
    """Postal-code capacity check of the driver step (position in cap vs residual)."""
    d = plan_results(spark, sf_dir).caps.driver
    return d.select("request_id", "delivery_week", "unified_delivery_driver", "cap",
                    "cap_declared", "cap_residual", "cap_pos",
                    (F.col("cap_pos") <= F.col("cap_residual")).alias("eligible"))


@query("alc_04")
def alc_04(spark, sf_dir):
    """Province capacity of the driver step on cap-eligible rows."""
    return plan_results(spark, sf_dir).caps.driver.select(*ALLOC_COLS)


@query("alc_05")
def alc_05(spark, sf_dir):
    """Driver-step sort key (driver~province~priority~date~request) of every row."""
    d = plan_results(spark, sf_dir).caps.driver
    return d.select("request_id", K.sort_key(C.STEP_DRIVER).alias("sk"))


@query("agg_11")
def agg_11(spark, sf_dir):
    """Used capacity per (driver, geo key, week) after driver and residual steps."""
    return plan_results(spark, sf_dir).caps.used_after_residual


@query("join_04")
def join_04(spark, sf_dir):
    """Declared and used capacity seen by the residual step (snapshot else in force)."""
    r = plan_results(spark, sf_dir)
    keys = r.caps.keys(C.STEP_RESIDUAL)
    needs = A.needs(keys, "province").unionByName(A.needs(keys, "cap"))
    return CAP.declared_and_used(needs, r.inputs.capacity, r.caps.used_after_driver)


@query("alc_06")
def alc_06(spark, sf_dir):
    """Residual step allocation (capacity already used by the driver step subtracted)."""
    return plan_results(spark, sf_dir).caps.residual.select(*ALLOC_COLS)


@query("alc_07")
def alc_07(spark, sf_dir):
    """Rejected rows of driver/residual steps -> sender step of week + 7."""
    c = plan_results(spark, sf_dir).caps
    rej = (c.driver.filter(~F.col("accepted")).select("request_id", "delivery_week")
           .unionByName(c.residual.filter(~F.col("accepted")).select("request_id", "delivery_week")))
    return rej.select("request_id", F.date_add("delivery_week", 7).alias("next_week"),
                      F.lit(C.STEP_SENDER).alias("workflow_step"))


# --- print step -------------------------------------------------------------------
@query("alc_08")
def alc_08(spark, sf_dir):
    """Daily print capacity in force for every planned week."""
    inp = W.load_inputs(spark, sf_dir)
    return CAP.print_capacity_in_force(inp.shipments, inp.print_config)


@query("alc_09")
def alc_09(spark, sf_dir):
    """Release slice size per week = ceil(daily / executions per day)."""
    inp = W.load_inputs(spark, sf_dir)
    cap = CAP.print_capacity_in_force(inp.shipments, inp.print_config)
    return cap.select("delivery_week",
                      P.slice_size(F.col("daily_print_capacity"), F.col("executions_per_day"))
                       .alias("slice_size"))


@query("alc_10")
def alc_10(spark, sf_dir):
    """Head of the print queue released to phase 2 (day and release number)."""
    rel = plan_results(spark, sf_dir).released
    return rel.filter("released").select("request_id", "delivery_week", "print_pos",
                                          "release_day", "release_no")


@query("alc_11")
def alc_11(spark, sf_dir):
    """Tail of the print queue pushed to next week's sender step."""
    rel = plan_results(spark, sf_dir).released
    return rel.filter(~F.col("released")).select("request_id", "print_pos", "next_week")


@query("alc_12")
def alc_12(spark, sf_dir):
    """Bounded pages of each week's print queue: the first, the one after its cursor, and the first from the end."""
    rel = plan_results(spark, sf_dir).released
    pages = {"first": P.page(rel), "next": P.page(rel, after=P.PAGE_ROWS), "last": P.page(rel, descending=True)}
    out = None
    for name, page in pages.items():
        part = page.select("delivery_week", "print_pos", "request_id", F.lit(name).alias("page"))
        out = part if out is None else out.unionByName(part)
    return out


@query("alc_13")
def alc_13(spark, sf_dir):
    """Rows per release and running total sent to phase 2."""
    return P.release_counts(plan_results(spark, sf_dir).released)


@query("agg_12")
def agg_12(spark, sf_dir):
    """Print counter per week."""
    return P.print_counter(plan_results(spark, sf_dir).released)


def all_queries() -> dict[str, Query]:
    # side modules register the remaining operator families
    import importlib
    for mod in ("capaflow.catalog_more", "capaflow.catalog_reports", "capaflow.catalog_stream",
                "capaflow.catalog_estimates", "capaflow.catalog_sources"):
        try:
            importlib.import_module(mod)
        except ModuleNotFoundError as e:
            if e.name != mod:
                raise
    return dict(QUERIES)
