"""Weekly dashboard reports, computed for every week of the ledger at once.

RPT-01 (sender x province x product): one pass over the ledger marks, per
(week, key, request), in which steps the request was; counting the marks gives every
column of the report. Declared values join in as rows of the same shape, so
the whole report is one ``groupBy`` on (key, request) and one on the key.

RPT-02 (driver x geo key): a shipment belongs to two geo keys, its cap and its
province. Exploding the two keys once turns every "cap or province" match
into one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.operators.ledger import latest_image

KEY = ["delivery_week", "pa_id", "province", "product_type"]


def _step(ledger: DataFrame, step: str) -> DataFrame:
    return ledger.filter(F.col("workflow_step") == step)


def candidates(ledger: DataFrame) -> DataFrame:
    """Sender rows as input of their week and as queued ``again`` after the week before, where a week has rows of both kinds: weeks are few."""
    week, sender = F.col("delivery_week"), _step(ledger, C.STEP_SENDER)
    weeks = sender.select("delivery_week").distinct()
    rows = sender.select("delivery_week", F.col("sender_pa_id").alias("pa_id"), "province", "product_type", "request_id",
                         F.coalesce(F.col("attempt") == 1, F.lit(False)).alias("second"))
    before = weeks.select(F.date_sub(week, 7).alias("_week"))
    both = weeks.join(F.broadcast(before), week.eqNullSafe(F.col("_week")), "left_semi").select(week.alias("_both"))
    asked = week.eqNullSafe(F.col("_both"))   # rows without a week are in the one week that they name
    inputs = rows.join(F.broadcast(both), asked, "left_semi")
    again = rows.withColumn("delivery_week", F.date_sub(week, 7)).join(F.broadcast(both), asked, "left_semi")
    return inputs.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True)))


def queued_again(ledger: DataFrame) -> DataFrame:
    """Keys of a week with a request of its input that is queued again a week later, at the same attempt (``is_back`` of ``request_flags``)."""
    met = candidates(ledger).groupBy(*KEY, "request_id", "second").agg(F.bool_and("again").alias("_only"), F.bool_or("again").alias("_some"))
    return met.filter(F.col("_some") & ~F.col("_only")).select(*KEY).distinct()


def _week_marks(ledger: DataFrame) -> DataFrame:
    """Ledger rows as marks on (week, request).

    A sender-step row of week w marks w as input and, if it carries on, w - 7 as
    "back in next week's queue"; print and phase-2 rows mark their own week.
    """
    step = F.col("workflow_step")
    week = F.col("delivery_week")
    marks = F.when(step == C.STEP_SENDER, F.array(
        F.struct(week.alias("delivery_week"), F.lit("input").alias("mark")),
        F.struct(F.date_sub(week, 7).alias("delivery_week"), F.lit("again").alias("mark")))) \
        .when(step == C.STEP_PRINT, F.array(F.struct(week.alias("delivery_week"), F.lit("passed").alias("mark")))) \
        .when(step == C.STEP_PHASE_2, F.array(F.struct(week.alias("delivery_week"), F.lit("phase_2").alias("mark"))))
    return (ledger.select("request_id", F.col("sender_pa_id").alias("pa_id"), "province", "product_type", "attempt",
                          F.explode(marks).alias("m"))
            .select("m.delivery_week", "pa_id", "province", "product_type", "request_id", "attempt", "m.mark"))


def request_flags(ledger: DataFrame) -> DataFrame:
    """One row per (week, key, request): its part in the week."""
    mark, second = F.col("mark"), F.coalesce(F.col("attempt") == 1, F.lit(False))

    def some(cond: Column) -> Column:
        return F.coalesce(F.bool_or(cond), F.lit(False))

    flags = _week_marks(ledger).groupBy(*KEY, "request_id").agg(
        some((mark == "input") & second).alias("in_second"), some((mark == "input") & ~second).alias("in_first"),
        some((mark == "again") & second).alias("again_second"), some((mark == "again") & ~second).alias("again_first"),
        some(mark == "passed").alias("passed"), some(mark == "phase_2").alias("phase_2"))
    second_back = F.col("in_second") & F.col("again_second")
    return flags.select(*KEY, "request_id", (F.col("in_first") | F.col("in_second")).alias("is_input"), "in_second",
                        (second_back | (F.col("in_first") & F.col("again_first"))).alias("is_back"),
                        second_back.alias("second_back"), "passed", "phase_2")


def sender_counts(ledger: DataFrame) -> DataFrame:
    """AGG-13: distinct requests, distinct RS, distinct second attempts of the week's input per key."""
    second = F.coalesce(F.col("attempt") == 1, F.lit(False))
    # the week's own rows only: whether a request is queued again is not asked here
    inputs = (_step(ledger, C.STEP_SENDER)
              .select("delivery_week", F.col("sender_pa_id").alias("pa_id"), "province", "product_type", "request_id", second.alias("second"))
              .groupBy(*KEY, "request_id").agg(F.bool_or("second").alias("in_second")))
    rs = F.col("product_type") == "RS"
    return inputs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("shipments"), F.count_if(rs).alias("rs"),
                                    F.count_if("in_second").alias("second_attempts"))


def not_passed(ledger: DataFrame) -> DataFrame:
    """SET-01: week w+1 sender rows INTERSECT week w sender rows (5 columns)."""
    cols = ["request_id", "attempt", "product_type", "sender_pa_id", "province"]
    snd = _step(ledger, C.STEP_SENDER)
    nxt = snd.select(F.date_sub("delivery_week", 7).alias("delivery_week"), *cols)
    cur = snd.select("delivery_week", *cols)
    return nxt.intersect(cur)


def estimate_view(estimates: DataFrame) -> DataFrame:
    """Declared estimates of the week (latest image per key: unique here)."""
    return estimates.select(F.col("delivery_date").alias("delivery_week"), "pa_id", "province",
                            "product_type",
                            F.col("original_estimate").alias("monthly_regional_estimate"),
                            F.col("monthly_estimate").alias("monthly_provincial_estimate"),
                            F.col("weekly_estimate").alias("weekly_provincial_estimate"))


def limit_view(used_limits: DataFrame) -> DataFrame:
    return used_limits.select(F.date_add("delivery_date", 7).alias("delivery_week"), "pa_id",
                              "province", "product_type", F.col("sender_limit").alias("guaranteed_limit"))


MAX_COLS = ["monthly_regional_estimate", "monthly_provincial_estimate",
            "weekly_provincial_estimate", "guaranteed_limit"]


def _report_rows(ledger: DataFrame, estimates: DataFrame, used_limits: DataFrame) -> DataFrame:
    """Flags of requests and declared values, one kind of row per input."""
    flags = request_flags(ledger)
    return (flags.unionByName(estimate_view(estimates).withColumn("declared", F.lit(True)), allowMissingColumns=True)
            .unionByName(limit_view(used_limits).withColumn("limited", F.lit(True)), allowMissingColumns=True))


#: Only keys that some input of the report holds: a queue row of a later week alone is none.
_HELD = "declared or limited or is_input or passed or phase_2"


def key_coverage(ledger: DataFrame, estimates: DataFrame, used_limits: DataFrame) -> DataFrame:
    """JOIN-11: which of the six inputs hold each key."""
    names = {"in_estimates": "declared", "in_limits": "limited", "in_total": "is_input", "in_passed": "passed",
             "in_not_passed": "is_back", "in_phase_2": "phase_2"}
    # whether a key holds rows is told by the keys; request by request, only who is queued again meets the input
    step = F.col("workflow_step")
    held = (ledger.filter(step.isin(C.STEP_SENDER, C.STEP_PRINT, C.STEP_PHASE_2))
            .groupBy("delivery_week", F.col("sender_pa_id").alias("pa_id"), "province", "product_type")
            .agg(F.bool_or(step == C.STEP_SENDER).alias("is_input"), F.bool_or(step == C.STEP_PRINT).alias("passed"),
                 F.bool_or(step == C.STEP_PHASE_2).alias("phase_2")))
    rows = held
    for more, name in ((estimate_view(estimates), "declared"), (limit_view(used_limits), "limited"), (queued_again(ledger), "is_back")):
        rows = rows.unionByName(more.select(*KEY, F.lit(True).alias(name)), allowMissingColumns=True)
    return rows.groupBy(*KEY).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in names.items()])


def sender_report(ledger: DataFrame, estimates: DataFrame, used_limits: DataFrame) -> DataFrame:
    """RPT-01 / AGG-14: largest declared values, counts of distinct requests, 0 when absent."""
    rows = _report_rows(ledger, estimates, used_limits).filter(_HELD)
    rs = F.col("product_type") == "RS"
    return rows.groupBy(*KEY).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in MAX_COLS],
        F.count_if("is_input").alias("shipments"), F.count_if(F.col("is_input") & rs).alias("rs"),
        F.count_if("in_second").alias("second_attempts"), F.count_if("passed").alias("passed"),
        F.count_if("is_back").alias("not_passed"), F.count_if("second_back").alias("not_passed_second_attempts"),
        F.count_if(F.col("is_back") & rs).alias("not_passed_rs"), F.count_if("phase_2").alias("in_prepare_phase_2"))


# --- RPT-02 -------------------------------------------------------------------------
def used_capacity_images(used_after_driver: DataFrame, used_after_residual: DataFrame) -> DataFrame:
    """CDC images of the used-capacity table: one per write (driver step, residual step)."""
    def img(df: DataFrame, hours: int) -> DataFrame:
        t = F.date_format(F.col("delivery_week").cast("timestamp") + F.expr(f"INTERVAL {hours} HOURS"),
                          C.TS_FORMAT)
        return df.select("unified_delivery_driver", "geo_key", "delivery_week", "used_capacity",
                         "declared_capacity", t.alias("approx_creation_time"))
    return img(used_after_driver, 1).unionByName(img(used_after_residual, 2))


def weekly_capacities(images: DataFrame) -> DataFrame:
    """ALC-16: latest image per (driver, geo key, week)."""
    return latest_image(images, ["unified_delivery_driver", "geo_key", "delivery_week"],
                        "approx_creation_time").drop("approx_creation_time")


def _geo_keys() -> Column:
    """Both geo keys of a shipment, once each."""
    return F.explode(F.array_distinct(F.array("cap", "province"))).alias("geo_key")


def cutoff(ledger: DataFrame) -> DataFrame:
    return _step(ledger, C.STEP_SENDER).select("delivery_week", "request_id", "cap", "province")


def geo_provinces(cut: DataFrame) -> DataFrame:
    """SET-02: distinct (week, geo key, province) of the week's shipments."""
    places = cut.select("delivery_week", "cap", "province").distinct()
    return places.select("delivery_week", _geo_keys(), "province").distinct()


def capacities_with_province(caps: DataFrame, cut: DataFrame) -> DataFrame:
    """JOIN-12: capacity rows with the provinces of the week's shipments under their geo key."""
    return caps.join(geo_provinces(cut), ["delivery_week", "geo_key"], "left")


def overflow_rows(ledger: DataFrame, caps: DataFrame) -> DataFrame:
    """JOIN-13: requests of a week that are queued again next week, under each saturated geo key (used = declared)."""
    sender = _step(ledger, C.STEP_SENDER)
    full = (caps.filter(F.col("used_capacity") == F.col("declared_capacity"))
            .select("delivery_week", "unified_delivery_driver", "geo_key"))
    saturated = ["delivery_week", "unified_delivery_driver", "geo_key"]
    # who was to deliver it next week, where that is under a saturated geo key at all
    queued = (sender.filter(F.col("unified_delivery_driver").isNotNull())
              .select(F.date_sub("delivery_week", 7).alias("delivery_week"), "request_id", "unified_delivery_driver", "cap", "province")
              .select("*", _geo_keys()).join(full, saturated, "left_semi").drop("geo_key").distinct())
    here = sender.select(F.col("delivery_week").alias("_week"), F.col("request_id").alias("_request"))
    again = queued.join(here, (F.col("delivery_week") == F.col("_week")) & F.col("request_id").eqNullSafe(F.col("_request")), "left_semi")
    keyed = again.select("delivery_week", "unified_delivery_driver", "request_id", _geo_keys())
    return keyed.join(full, saturated).select(*saturated, "request_id")


def overflow_counts(rows: DataFrame) -> DataFrame:
    """AGG-15: distinct overflowing requests per (week, driver, geo key)."""
    return (rows.groupBy("delivery_week", "unified_delivery_driver", "geo_key")
                .agg(F.count_distinct("request_id").alias("overflow")))


def driver_report(ledger: DataFrame, caps: DataFrame) -> DataFrame:
    """RPT-02: declared, used, province and overflow per (week, driver, geo key)."""
    overflow = overflow_counts(overflow_rows(ledger, caps))
    return (capacities_with_province(caps, cutoff(ledger))
            .join(overflow, ["delivery_week", "unified_delivery_driver", "geo_key"], "left"))


def report_order() -> list[Column]:
    """ALC-18: overflow descending (nulls last), then driver, geo key."""
    return [F.col("overflow").desc_nulls_last(), F.col("unified_delivery_driver"), F.col("geo_key")]
