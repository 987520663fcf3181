"""Registered queries: reports, report joins/aggregates, CDC lake, CSV sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.catalog import query
from capaflow.catalog_estimates import documents
from capaflow.operators import printing as P
from capaflow.operators.estimates import order_levels
from capaflow.operators.ledger import by_step
from capaflow.operators.sender import used_sender_limits
from capaflow.plans import reports as R
from capaflow.plans import weekly as W
from capaflow.plans.results import plan_results, session_key
from capaflow.session import concurrently
from capaflow.sources import cdc
from capaflow.sources import sinks
from testbed import lake


def _sender_inputs(spark, sf_dir):
    r = plan_results(spark, sf_dir)
    return r.ledger, r.inputs.estimates, used_sender_limits(r.sender.split)


@query("rpt_01")
def rpt_01(spark, sf_dir):
    """Weekly sender x province x product report, every week of the ledger."""
    return R.sender_report(*_sender_inputs(spark, sf_dir))


@query("agg_14")
def agg_14(spark, sf_dir):
    """Final roll-up of the sender report (MAX declared, SUM counts, 0 if absent)."""
    return R.sender_report(*_sender_inputs(spark, sf_dir))


@query("join_11")
def join_11(spark, sf_dir):
    """Full-join coverage of the six report inputs per key (tagged union + one group)."""
    return R.key_coverage(*_sender_inputs(spark, sf_dir))


@query("agg_13")
def agg_13(spark, sf_dir):
    """Distinct requests, RS and second attempts of each week's sender input."""
    return R.sender_counts(plan_results(spark, sf_dir).ledger)


@query("set_01")
def set_01(spark, sf_dir):
    """Rows of next week's queue that were this week's input (INTERSECT)."""
    return R.not_passed(plan_results(spark, sf_dir).ledger)


def _caps(spark, sf_dir):
    return plan_results(spark, sf_dir).weekly_caps


@query("alc_16")
def alc_16(spark, sf_dir):
    """Latest used-capacity image per (driver, geo key, week)."""
    r = plan_results(spark, sf_dir)
    return R.weekly_capacities(R.used_capacity_images(r.caps.used_after_driver, r.caps.used_after_residual))


@query("join_12")
def join_12(spark, sf_dir):
    """Used capacities with the province of the week's shipments (cap or province match)."""
    return R.capacities_with_province(_caps(spark, sf_dir), R.cutoff(plan_results(spark, sf_dir).ledger))


@query("set_02")
def set_02(spark, sf_dir):
    """Distinct (week, geo key, province) pairs of the weekly cutoff."""
    return R.geo_provinces(R.cutoff(plan_results(spark, sf_dir).ledger))


@query("join_13")
def join_13(spark, sf_dir):
    """Overflow rows: pushed requests of the cutoff matched to saturated capacities."""
    return R.overflow_rows(plan_results(spark, sf_dir).ledger, _caps(spark, sf_dir))


@query("agg_15")
def agg_15(spark, sf_dir):
    """Distinct overflowing requests per (week, driver, geo key)."""
    return R.overflow_counts(R.overflow_rows(plan_results(spark, sf_dir).ledger, _caps(spark, sf_dir)))


@query("rpt_02")
def rpt_02(spark, sf_dir):
    """Weekly driver x geo key report with overflow where saturated."""
    return R.driver_report(plan_results(spark, sf_dir).ledger, _caps(spark, sf_dir))


@query("alc_18")
def alc_18(spark, sf_dir):
    """Driver report rows with their position in report order within each week."""
    rep = rpt_02(spark, sf_dir)
    w = Window.partitionBy("delivery_week").orderBy(*R.report_order(), F.col("province"))
    return rep.withColumn("report_pos", F.row_number().over(w))


@query("rpt_03")
def rpt_03(spark, sf_dir):
    """Report parameters per week: the weeks around it, the day ranges of Q1 and Q3, the months of Q2, the keys read."""
    weeks = plan_results(spark, sf_dir).ledger.select("delivery_week").distinct()
    w = F.col("delivery_week")
    last, next_ = F.date_sub(w, 7), F.date_add(w, 7)
    text = F.date_format(w, "yyyy-MM-dd")
    return weeks.select(w, last.alias("last_week"), next_.alias("next_week"),
                        last.alias("q1_from"), w.alias("q1_to"), F.concat(text, F.lit(f"~{C.STEP_SENDER}")).alias("q1_pk"),
                        F.date_format(F.add_months(last, -1), "yyyy-MM").alias("q2_from"),
                        F.date_format(last, "yyyy-MM").alias("q2_to"),
                        w.alias("q3_from"), next_.alias("q3_to"), F.concat(text, F.lit(f"~{C.STEP_PHASE_2}")).alias("q3_pk"))


REPORT_MONTHS_BACK = 4
REPORTS_FROM = "1990-01-01"     # all weeks of the test tables
_LAKE: dict = {}


def _epoch(day):
    return F.unix_timestamp(F.col(day).cast("timestamp"))


def _ledger_rows(r):
    written = F.to_timestamp("created_at", C.TS_FORMAT)
    fresh = F.col("unified_delivery_driver").isNull() & F.col("priority").isNull()
    return (r.ledger.filter(fresh).drop("unified_delivery_driver", "priority"), written), (r.ledger.filter(~fresh), written)


def _counter_rows(r):
    week = F.col("delivery_week")
    exempt = r.sender.exempt.select(
        F.date_format(week, "yyyy-MM-dd").alias("pk"), F.concat_ws("~", F.lit("EXCLUDE"), "province", "product_type").alias("sk"),
        "number_of_shipments", (_epoch("delivery_week") + C.COUNTER_TTL_DAYS * 86400).alias("ttl"), week)
    prints = P.print_counter(r.released).select(
        F.lit("PRINT").alias("pk"), F.date_format(week, "yyyy-MM-dd").alias("sk"), "number_of_shipments",
        "daily_print_capacity", "weekly_print_capacity", "sent_to_next_week", week)
    return (exempt, week), (prints, week)


def _used_rows(r):
    used = r.caps.used_after_residual.select(
        F.concat_ws("~", "unified_delivery_driver", "geo_key").alias("unified_delivery_driver_geokey"),
        F.col("delivery_week").alias("delivery_date"), "declared_capacity", "geo_key", "unified_delivery_driver", "used_capacity")
    return ((used, F.col("delivery_date")),)


def _limit_rows(r):
    limits = r.inputs.estimates.select(
        F.concat_ws("~", "pa_id", "product_type", "province").alias("pk"), "delivery_date", "weekly_estimate", "monthly_estimate",
        "original_estimate", "pa_id", "product_type", "province", "file_key",
        (_epoch("delivery_date") + C.ESTIMATE_TTL_DAYS * 86400).alias("ttl"))
    return ((limits, F.col("delivery_date")),)


def _order_rows(spark, sf_dir):
    month = F.to_date(F.concat("month", F.lit("-01")))
    values = order_levels(documents(spark, sf_dir)[1]).select(
        F.col("pa_id").alias("pk"), F.concat_ws("~", "month", "sk").alias("sk"), "value", "file_key",
        F.date_format(month, "yyyy-MM-dd").alias("last_update_order"), F.date_format(month, "yyyy-MM-dd").alias("created_at"))
    return ((values, F.to_date("created_at")),)


def _store_lake(spark, sf_dir, base, tables):
    """Images of lake tables, stored as their writers knew them: rows without a driver yet, exempt and print
    counters come with different attributes."""
    r = plan_results(spark, sf_dir)
    rows_of = {
        "shipment_ledger": lambda: _ledger_rows(r), "used_capacity": lambda: _used_rows(r),
        "used_sender_limit": lambda: ((used_sender_limits(r.sender.split), F.col("delivery_date")),),
        "sender_limit": lambda: _limit_rows(r), "counter": lambda: _counter_rows(r), "order_value": lambda: _order_rows(spark, sf_dir)}
    written_by = {name: rows_of[name]() for name in tables}

    def store(name, writers):   # the writers of one table one after the other, as both add to it
        for rows, at in writers:
            # dealt by day before they are wrapped into images; a day with many rows goes to several tasks
            for part in by_step(rows) if "workflow_step" in rows.columns else [rows]:
                dealt = part.withColumn("_day", F.to_date(at)).hint("rebalance", "_day")
                cdc.store(lake.images(dealt, name, at), f"{base}/{name}")

    concurrently(*[lambda n=n, w=w: store(n, w) for n, w in written_by.items()])


def lake_images(spark, sf_dir, *tables):
    """Images of lake tables; a table is stored once per session and input, when it is first read."""
    key = session_key(spark, sf_dir)
    base, stored = _LAKE.setdefault(key, (sinks.output_dir(spark, "lake"), set()))
    missing = [t for t in tables if t not in stored]
    if missing:
        _store_lake(spark, sf_dir, base, missing)
        stored.update(missing)
    return [cdc.read(spark, f"{base}/{t}", t) for t in tables]


@query("src_07")
def src_07(spark, sf_dir):
    """The six tables of the CDC lake, each flattened to its typed view; attributes that a table lacks are null."""
    out = None
    for name, images in zip(cdc.LAKE, lake_images(spark, sf_dir, *cdc.LAKE), strict=True):
        view = cdc.flatten(images, name).withColumn("table", F.lit(name))
        out = view if out is None else out.unionByName(view, allowMissingColumns=True)
    return out


@query("fn_07")
def fn_07(spark, sf_dir):
    """Rows per key that each report query of every week reads from the lake, by partition ranges."""
    weeks = W.small(plan_results(spark, sf_dir).ledger.select("delivery_week").distinct())
    view = cdc.flatten(*lake_images(spark, sf_dir, "shipment_ledger"), "shipment_ledger")
    # the reports' first week: a bound on the weeks, from which the folders are pruned at run time
    asked = weeks.filter(F.col("delivery_week") >= F.lit(REPORTS_FROM).cast("date"))
    out = None
    for name, rows in cdc.report_rows(view, asked, C.STEP_SENDER, C.STEP_PHASE_2, REPORT_MONTHS_BACK).items():
        part = rows.groupBy("delivery_week", "pk").agg(F.count(F.lit(1)).alias("n")).withColumn("query", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _export(spark, sf_dir, name):
    used = plan_results(spark, sf_dir).caps.used_after_residual
    out = used.select(F.concat_ws("~", "unified_delivery_driver", "geo_key")
                       .alias("unified_delivery_driver_geokey"),
                      F.date_format("delivery_week", "yyyy-MM-dd").alias("delivery_date"),
                      "unified_delivery_driver", "geo_key",
                      F.col("used_capacity").cast("string").alias("used_capacity"),
                      F.col("declared_capacity").cast("string").alias("declared_capacity"))
    path = sinks.write_csv(out, sinks.output_dir(spark, name), partition_by=["delivery_date"])
    return sinks.read_csv_strings(spark, path, out.columns)


@query("rpt_04")
def rpt_04(spark, sf_dir):
    """Used-capacity weekly export (CSV, one folder per week), read back."""
    return _export(spark, sf_dir, "used_capacity_export")


@query("src_08")
def src_08(spark, sf_dir):
    """CSV sink with header from the columns; the written rows read back as strings."""
    return _export(spark, sf_dir, "csv_sink")


@query("src_09")
def src_09(spark, sf_dir):
    """Report sink: the driver report as <base>/<query>/<date>.csv, one file per week; read back with the week from the file's name."""
    rep = rpt_02(spark, sf_dir)
    out = rep.select(*[F.col(c).cast("string").alias(c) for c in rep.columns])
    place = sinks.write_csv_files(out, sinks.output_dir(spark, "reports"), "driver_weekly", "delivery_week")
    rows = sinks.read_csv_strings(spark, place, [c for c in out.columns if c != "delivery_week"])
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("delivery_week"), "*")
