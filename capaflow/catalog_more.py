"""Registered queries: keys, filters, ledger state, lookups, maintenance, functions."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.catalog import query
from capaflow.catalog_estimates import documents
from capaflow.functions import keys as K
from capaflow.operators import capacity as CAP
from capaflow.operators import drivers as D
from capaflow.operators import ledger as L
from capaflow.operators import printing as P
from capaflow.operators.estimates import order_levels
from capaflow.operators.ranking import positions, strategy_for
from capaflow.operators.sender import exempt_counters
from capaflow.plans import weekly as W
from capaflow.plans.results import plan_results, session_key
from capaflow.session import concurrently, stage_table
from capaflow.sources import expiring as X
from capaflow.sources import ledger_store as LS
from capaflow.sources.events import load_event_records
from capaflow.sources.planner_store import KEY_COLS, PlannerStore, derived_keys
from capaflow.sources.sinks import output_dir

# parameters of the parameterised jobs (fixed values of this catalog)
TODAY = "1998-01-05"             # "now" for the cancellation predicate
RETENTION_NOW = "1998-07-06"     # "now" for TTL retention
STREAM_NOW = "2024-01-30 12:00:00"   # "now" for the ids that the ingest has seen


# --- keys and projections ------------------------------------------------------------
def _step_key():
    """Sort key of a ledger row for its step."""
    return F.coalesce(*[F.when(F.col("workflow_step") == s, K.sort_key(s))
                        for s in (C.STEP_SENDER, C.STEP_DRIVER, C.STEP_RESIDUAL, C.STEP_PRINT, C.STEP_PHASE_2)])


@query("prj_02")
def prj_02(spark, sf_dir):
    """Sort key of every ledger row for its step."""
    return plan_results(spark, sf_dir).ledger.select("request_id", "pk", _step_key().alias("sk"))


@query("prj_03")
def prj_03(spark, sf_dir):
    """Step transitions: every ledger row one planning round appends."""
    return plan_results(spark, sf_dir).ledger


@query("prj_05")
def prj_05(spark, sf_dir):
    """Strict priority: rows without a configured key (or attempt not 0/1) are quarantined."""
    shp = W.load_inputs(spark, sf_dir).shipments
    ok, bad = K.split_by_priority(shp)
    return (ok.select("request_id", "priority", F.lit("OK").alias("status"))
              .unionByName(bad.select("request_id", F.lit(None).cast("int").alias("priority"),
                                      F.lit("QUARANTINE").alias("status"))))


@query("prj_06")
def prj_06(spark, sf_dir):
    """Delivery week at ingest: strictly next Monday after the event time."""
    ev = load_event_records(spark, sf_dir)
    return ev.select("event_id", K.next_weekday_strict(F.col("ts")).alias("delivery_week"))


@query("prj_07")
def prj_07(spark, sf_dir):
    """Delivery week at planning: previous-or-same Monday of the event time (UTC)."""
    ev = load_event_records(spark, sf_dir)
    return ev.select("event_id", K.previous_or_same_weekday(F.col("ts")).alias("planning_week"))


# --- filters ---------------------------------------------------------------------------
@query("flt_01")
def flt_01(spark, sf_dir):
    """Event validity: attempt present and both dates non-empty."""
    ev = load_event_records(spark, sf_dir)
    return ev.select("event_id", K.valid_event().alias("valid"))


_SORTED: dict = {}


def sorted_ledger(spark, sf_dir):
    """The ledger stored by week and step in the order of its sort keys, once per session and input."""
    key = session_key(spark, sf_dir)
    if key not in _SORTED:
        led = plan_results(spark, sf_dir).ledger
        path = output_dir(spark, "sorted_ledger")
        for part in L.by_step(led):   # steps are folders of their own: one after the other, each with its own exchange
            LS.write_sorted(part, path, {"pk": K.partition_key(F.col("delivery_week"), F.col("workflow_step")), LS.SORTED_BY: _step_key()})
        _SORTED[key] = path
    return _SORTED[key]


@query("flt_03")
def flt_03(spark, sf_dir):
    """Range scan: driver-step rows of every week whose sort key starts with 'DRV_A~'."""
    return LS.range_scan(spark, sorted_ledger(spark, sf_dir), C.STEP_DRIVER, prefix="DRV_A~").select("pk", "sk", "request_id")


@query("flt_04")
def flt_04(spark, sf_dir):
    """TTL retention: estimates, order values and exempt counters are stored by expiry day, expired days are deleted,
    and so are the ids of the stream's valid records (kept for the dedupe horizon): what is still live at 'now' is read."""
    inp = W.load_inputs(spark, sf_dir)

    def epoch(day):
        return F.unix_timestamp(day.cast("timestamp"))

    month = F.to_date(F.concat("month", F.lit("-01")))
    tables = {
        "estimate": (inp.estimates.select(F.concat_ws("~", "pa_id", "product_type", "province").alias("key"), F.col("delivery_date").alias("day")),
                     C.ESTIMATE_TTL_DAYS),
        "order_value": (order_levels(documents(spark, sf_dir)[1]).select(F.concat_ws("~", "pa_id", "sk").alias("key"), month.alias("day")),
                        C.ORDER_TTL_DAYS),
        "exempt_counter": (exempt_counters(inp.shipments).select(
            F.concat_ws("~", "province", "product_type").alias("key"), F.col("delivery_week").alias("day")), C.COUNTER_TTL_DAYS)}
    seen = load_event_records(spark, sf_dir).filter(K.valid_event()).select(
        F.col("request_id").alias("key"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("at"))

    def kept(name, rows, ttl, now):
        path = output_dir(spark, f"expiring_{name}")
        X.write(X.expiring(rows, ttl).select("key", "day", "ttl", "expires"), path)
        X.drop_expired(spark, path, now.date())
        left = X.live(X.read_live(spark, path, "key string, day date, ttl long, expires date", since=now.date()),
                      F.unix_timestamp(F.lit(str(now)).cast("timestamp")))
        return left.select(F.lit(name).alias("table"), "key", "day", "ttl")

    planned, streamed = datetime.datetime.fromisoformat(RETENTION_NOW), datetime.datetime.fromisoformat(STREAM_NOW)
    parts = concurrently(*[
        lambda name=name, rows=rows, days=days: kept(name, rows, epoch(F.col("day")) + days * 86400, planned) for name, (rows, days) in tables.items()],
        lambda: kept("seen_id", seen, F.unix_timestamp("at") + C.DEDUPE_HORIZON_SECONDS, streamed))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _latest(spark, sf_dir):
    """Latest ledger row per request: only what its readers select goes through the shuffle."""
    return L.latest_per_request(plan_results(spark, sf_dir).ledger.select("request_id", "workflow_step", "pk", "created_at"))


@query("flt_05")
def flt_05(spark, sf_dir):
    """Cancellable: latest row in the sender step and its week is not 'today'."""
    latest = _latest(spark, sf_dir)
    return latest.select("request_id", "workflow_step",
                         K.cancellable(F.lit(TODAY).cast("date")).alias("cancellable"))


def timeline(spark, sf_dir):
    """Timeline elements per shipment: one PREPARE element (PREPARE_ and the request id) and one SEND."""
    shp = W.load_inputs(spark, sf_dir).shipments
    prep = shp.select("iun", F.concat(F.lit(C.PREPARE_PREFIX), "request_id").alias("element_id"),
                      F.when(F.col("product_type") == "RS", "PREPARE_SIMPLE_REGISTERED_LETTER")
                       .otherwise("PREPARE_ANALOG_DOMICILE").alias("category"))
    send = shp.select("iun", F.concat(F.lit("SEND_"), F.col("request_id")).alias("element_id"),
                      F.lit("SEND_ANALOG_DOMICILE").alias("category"))
    return prep.unionByName(send)


@query("flt_06")
def flt_06(spark, sf_dir):
    """Timeline elements of the two PREPARE categories whose id says so too."""
    return K.prepare_elements(timeline(spark, sf_dir))


# --- aggregations -----------------------------------------------------------------------
@query("agg_01")
def agg_01(spark, sf_dir):
    """Shipments per (week, pa, product, province)."""
    shp = W.load_inputs(spark, sf_dir).shipments
    return shp.groupBy("delivery_week", "sender_pa_id", "product_type", "province") \
              .agg(F.count(F.lit(1)).alias("n"))


@query("agg_02")
def agg_02(spark, sf_dir):
    """Groupings by cap, by cap x product, by pa x product x province (per week)."""
    shp = W.load_inputs(spark, sf_dir).shipments
    null = F.lit(None).cast("string")
    a = shp.groupBy("delivery_week", "cap").agg(F.count(F.lit(1)).alias("n")) \
           .select("delivery_week", F.lit("cap").alias("level"), F.col("cap").alias("k1"),
                   null.alias("k2"), null.alias("k3"), "n")
    b = shp.groupBy("delivery_week", "cap", "product_type").agg(F.count(F.lit(1)).alias("n")) \
           .select("delivery_week", F.lit("cap_product").alias("level"), F.col("cap").alias("k1"),
                   F.col("product_type").alias("k2"), null.alias("k3"), "n")
    c = shp.groupBy("delivery_week", "sender_pa_id", "product_type", "province") \
           .agg(F.count(F.lit(1)).alias("n")) \
           .select("delivery_week", F.lit("pa_product_province").alias("level"),
                   F.col("sender_pa_id").alias("k1"), F.col("product_type").alias("k2"),
                   F.col("province").alias("k3"), "n")
    return a.unionByName(b).unionByName(c)


@query("agg_06")
def agg_06(spark, sf_dir):
    """Colliding exempt counters: the ingest counter wins, the ledger recount fills gaps."""
    r = plan_results(spark, sf_dir)
    ingest = r.sender.exempt.withColumn("src", F.lit(1))
    recount = (r.ledger.filter(F.col("workflow_step") == C.STEP_SENDER).filter(K.exempt())
               .groupBy("delivery_week", "province", "product_type")
               .agg(F.count(F.lit(1)).alias("number_of_shipments")).withColumn("src", F.lit(2)))
    return D.first_counters(ingest.unionByName(recount))


# --- joins ---------------------------------------------------------------------------------
@query("join_03")
def join_03(spark, sf_dir):
    """Declared capacity per province with strict validity bounds (from < t < to)."""
    inp = W.load_inputs(spark, sf_dir)
    return CAP.drivers_on_province(inp.province_weeks, inp.capacity, inclusive=False).drop("activation_from")


@query("join_06")
def join_06(spark, sf_dir):
    """Cap x product needed by shipments without a covering driver."""
    inp = W.load_inputs(spark, sf_dir)
    return D.unassigned(inp.shipments, inp.coverage)


# --- allocation side paths --------------------------------------------------------------------
@query("alc_14")
def alc_14(spark, sf_dir):
    """Bypass ("light"): sender rows straight to the print step with strict priority, beside the print counter of their week, the total of the rows moved."""
    shp = W.load_inputs(spark, sf_dir).shipments
    ok, bad = K.split_by_priority(shp)
    moved = K.transition(ok, C.STEP_PRINT, F.col("delivery_week"))
    return (moved.join(P.print_totals(moved), "delivery_week")
                 .select("request_id", "delivery_week", "workflow_step", "priority", "sk", "print_counter")
                 .unionByName(bad.select("request_id", "delivery_week", F.lit("QUARANTINE").alias("workflow_step")),
                              allowMissingColumns=True))


@query("alc_15")
def alc_15(spark, sf_dir):
    """Switch-off: each week's sender queue in key order, in calls of 5000, to phase 2 of the current week, both as the
    current week's queue and as the next one's; rows without a priority are returned as rejected."""
    shp, out = W.load_inputs(spark, sf_dir).shipments, None
    for mode, current in (("current", True), ("next", False)):
        moved, rejected = P.switch_off(shp, current_week=current)
        part = moved.select("request_id", "queue_week", "delivery_week", "switch_pos", "batch_no", "workflow_step", "priority").unionByName(
            rejected.select("request_id", F.col("delivery_week").alias("queue_week"), F.lit("REJECTED").alias("workflow_step")),
            allowMissingColumns=True).withColumn("queue", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("alc_17")
def alc_17(spark, sf_dir):
    """Latest ledger row per request."""
    latest = _latest(spark, sf_dir)
    return latest.select("request_id", "workflow_step", "pk", "created_at")


@query("set_03")
def set_03(spark, sf_dir):
    """In-batch dedupe: first record per request id by sequence number."""
    ev = load_event_records(spark, sf_dir)
    first = ev.groupBy("request_id").agg(F.min("sequence_number").alias("sequence_number"))
    return first


# --- scalar functions ------------------------------------------------------------------------
@query("fn_01")
def fn_01(spark, sf_dir):
    """split/join on '~', prefix tests, case-insensitive equality, trim on ledger keys."""
    led = plan_results(spark, sf_dir).ledger
    parts = F.split(F.col("pk"), "~")
    return led.select("request_id", "pk",
                      parts.getItem(0).alias("pk_week"), parts.getItem(1).alias("pk_step"),
                      F.concat_ws("~", "sender_pa_id", "product_type", "province").alias("sender_key"),
                      F.col("pk").startswith("19").alias("pk_1900s"),
                      (F.lower("product_type") == F.lower(F.lit("rs"))).alias("is_rs"),
                      F.trim(F.concat(F.lit("  "), F.col("cap"), F.lit(" "))).alias("cap_trim"))


@query("fn_02")
def fn_02(spark, sf_dir):
    """Date helpers per planned week: +/- weeks, month start, days in month, day diff, ISO."""
    wk = W.load_inputs(spark, sf_dir).shipments.select("delivery_week").distinct()
    w = F.col("delivery_week")
    return wk.select(w, F.date_add(w, 7).alias("next_week"), F.date_sub(w, 7).alias("last_week"),
                     F.trunc(w, "month").alias("month_start"),
                     F.dayofmonth(F.last_day(w)).alias("days_in_month"),
                     F.datediff(w, F.trunc(w, "month")).alias("days_from_month_start"),
                     F.date_format(w.cast("timestamp"), C.TS_FORMAT).alias("iso"))


@query("fn_03")
def fn_03(spark, sf_dir):
    """floor / ceil / round-half-up / least / greatest / integer division on capacities."""
    cap = W.load_inputs(spark, sf_dir).capacity
    c = F.col("capacity")
    return cap.select("unified_delivery_driver", "geo_key", "activation_from",
                      F.floor(c / 7).alias("floor7"), F.ceil(c / 7).alias("ceil7"),
                      F.floor(c / 7 + 0.5).alias("round7"),
                      F.least(c, F.lit(100)).alias("least100"),
                      F.greatest(c, F.lit(10)).alias("greatest10"),
                      (c - c % 3).cast("bigint").alias("down3"))


@query("fn_04")
def fn_04(spark, sf_dir):
    """JSON parse, nested access, first non-null, try_cast, if, coalesce on event props."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    parsed = F.from_json("props", "k string, missing string")
    return ev.select("event_id",
                     F.coalesce(parsed.getField("missing"), parsed.getField("k")).alias("first_non_null"),
                     parsed.getField("k").try_cast("bigint").alias("k"),
                     F.lit("x").try_cast("int").alias("bad_cast"),
                     F.when(parsed.getField("k").try_cast("bigint") > 50, "high").otherwise("low").alias("band"))


@query("fn_05")
def fn_05(spark, sf_dir):
    """Epoch TTL = event time + 1 day (seconds)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp"))
                                  + C.DEDUPE_HORIZON_SECONDS).alias("ttl"))


@query("fn_06")
def fn_06(spark, sf_dir):
    """array contains / distinct / sort / overlap on capacity product lists."""
    cap = W.load_inputs(spark, sf_dir).capacity.filter(F.col("geo_level") == "PROVINCE")
    p = F.col("products")
    return cap.select("unified_delivery_driver", "geo_key", "activation_from",
                      F.array_contains(p, "RS").alias("has_rs"),
                      F.array_distinct(F.concat(p, p)).alias("distinct_products"),
                      F.sort_array(p, asc=False).alias("desc_products"),
                      F.arrays_overlap(p, F.array(F.lit("AR"), F.lit("890"))).alias("overlaps_estimated"))


# --- lookups -----------------------------------------------------------------------------------
@query("lkp_01")
def lkp_01(spark, sf_dir):
    """History of every request: number of ledger rows and its steps in time order."""
    led = plan_results(spark, sf_dir).ledger
    agg = led.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_list(F.struct("created_at", "workflow_step"))).alias("h"))
    return agg.select("request_id", "n_rows",
                      F.concat_ws(">", F.transform("h", lambda x: x["workflow_step"])).alias("steps"))


@query("lkp_02")
def lkp_02(spark, sf_dir):
    """Ledger rows of each (week, step) in sort-key order, paged by 1000."""
    led = plan_results(spark, sf_dir).ledger
    # week and step are the pk, and the sort key ends with the request id: neither is sent a second time
    rows = led.select(*LS.PARTITIONS, _step_key().alias("sk"), F.length("request_id").alias("_n"))
    request = F.when(F.col("_n").isNotNull(), F.right("sk", F.col("_n")))
    strategy = strategy_for(rows, LS.PARTITIONS)
    # by ranges, each part is staged before the next one is sent: only one step's rows are in an exchange at a time
    parts = [rows.repartition(*LS.PARTITIONS)] if strategy == "window" else L.by_step(rows)
    pos = reduce(DataFrame.unionByName, [positions(part, LS.PARTITIONS, [F.col("sk"), request], name="pos", strategy=strategy) for part in parts])
    return pos.select(K.partition_key(F.col("delivery_week"), F.col("workflow_step")).alias("pk"), "sk",
                      request.alias("request_id"), F.ceil(F.col("pos") / F.lit(1000)).cast("int").alias("page_no"))


@query("lkp_03")
def lkp_03(spark, sf_dir):
    """Estimates per (week, province): senders and summed weekly estimate."""
    est = W.load_inputs(spark, sf_dir).estimates
    return est.groupBy("delivery_date", "province").agg(
        F.count(F.lit(1)).alias("n_estimates"),
        F.sum("weekly_estimate").cast("bigint").alias("weekly_estimate"))


@query("lkp_04")
def lkp_04(spark, sf_dir):
    """Used capacity of every (driver, geo key, week)."""
    return plan_results(spark, sf_dir).caps.used_after_residual.select(
        "unified_delivery_driver", "geo_key", "delivery_week", "used_capacity", "declared_capacity")


@query("lkp_05")
def lkp_05(spark, sf_dir):
    """Declared capacity per province mid-week (week + 3 days), newest per driver, strict."""
    inp = W.load_inputs(spark, sf_dir)
    pw = (inp.shipments.select("tender_id", "province",
                               F.date_add("delivery_week", 3).alias("at_date")).distinct())
    return CAP.drivers_on_province(pw, inp.capacity, inclusive=False, week_col="at_date") \
              .drop("activation_from")


@query("lkp_06")
def lkp_06(spark, sf_dir):
    """Print counter of every week."""
    pc = P.print_counter(plan_results(spark, sf_dir).released)
    return pc.select(F.lit("PRINT").alias("pk"), F.date_format("delivery_week", "yyyy-MM-dd").alias("sk"),
                     "number_of_shipments", "weekly_print_capacity", "sent_to_phase_two")


@query("lkp_07")
def lkp_07(spark, sf_dir):
    """Used capacity export rows (driver~geo key) of every week."""
    u = plan_results(spark, sf_dir).caps.used_after_residual
    return u.select(F.concat_ws("~", "unified_delivery_driver", "geo_key")
                     .alias("unified_delivery_driver_geokey"),
                    F.col("delivery_week").alias("delivery_date"), "unified_delivery_driver",
                    "geo_key", "used_capacity", "declared_capacity")


@query("lkp_08")
def lkp_08(spark, sf_dir):
    """Distinct provinces of the ledger and distinct drivers of the capacity table."""
    inp = W.load_inputs(spark, sf_dir)
    prov = inp.shipments.select(F.lit("province").alias("kind"), F.col("province").alias("value"))
    drv = inp.capacity.select(F.lit("driver").alias("kind"), F.col("unified_delivery_driver").alias("value"))
    return prov.unionByName(drv).distinct()


# --- maintenance ---------------------------------------------------------------------------------
def _tail_requests(r):
    return r.released.filter(~F.col("released")).select("request_id")


def planner_store(spark, sf_dir):
    """The planned ledger and its derived tables, stored."""
    from capaflow.operators.sender import used_sender_limits
    r = plan_results(spark, sf_dir)
    return PlannerStore(spark, output_dir(spark, "planner_store")).create(
        r.ledger, r.caps.used_after_residual, used_sender_limits(r.sender.split))


@query("mnt_01")
def mnt_01(spark, sf_dir):
    """Reset the last planned week in the stored tables: used capacities, used sender limits and print counters afterwards."""
    store = planner_store(spark, sf_dir)
    store.reset_week(plan_results(spark, sf_dir).inputs.shipments.agg(F.max("delivery_week").alias("delivery_week")))
    return (L.table_rows("used_capacity", store.read("used_capacity"), F.concat_ws("~", "unified_delivery_driver", "geo_key"), "delivery_week", "used_capacity")
            .unionByName(L.table_rows("used_sender_limit", store.read("used_sender_limit"), F.col("pk"), "delivery_date", "number_of_shipment"))
            .unionByName(L.table_rows("print_counter", store.read("print_counter"), F.lit("PRINT"), "delivery_week", "number_of_shipments")))


@query("join_14")
def join_14(spark, sf_dir):
    """Delete cascade: what the requests pushed out by the print step touch in the ledger and in the four tables derived from it."""
    r = plan_results(spark, sf_dir)
    ids, deleted = stage_table(_tail_requests(r).distinct(), "deleted"), None
    for part in L.by_step(r.ledger.select(*KEY_COLS)):   # the pk, which is made of week and step, is not sent
        rows = stage_table(L.delete_requests(part, ids)[1], "deleted-rows")
        deleted = rows if deleted is None else deleted.unionByName(rows)
    return derived_keys(deleted.withColumn("pk", K.partition_key(F.col("delivery_week"), F.col("workflow_step"))))


@query("mnt_02")
def mnt_02(spark, sf_dir):
    """Delete by request list in the stored tables: the ledger per (week, step), exempt and print counters, used capacity and used sender limits afterwards."""
    store = planner_store(spark, sf_dir)
    store.delete_requests(_tail_requests(plan_results(spark, sf_dir)))
    ledger = store.read("ledger").groupBy("pk", "delivery_week").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        L.table_rows("ledger", ledger, F.col("pk"), "delivery_week", "n"),
        L.table_rows("exempt_counter", store.read("exempt_counter"), F.concat_ws("~", "province", "product_type"), "delivery_week", "number_of_shipments"),
        L.table_rows("print_counter", store.read("print_counter"), F.lit("PRINT"), "delivery_week", "number_of_shipments"),
        L.table_rows("used_capacity", store.read("used_capacity"), F.concat_ws("~", "unified_delivery_driver", "geo_key"), "delivery_week", "used_capacity"),
        L.table_rows("used_sender_limit", store.read("used_sender_limit"), F.col("pk"), "delivery_date", "number_of_shipment")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
