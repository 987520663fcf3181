"""Plan invariants on the sf0.001 tables."""
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.plans import weekly as W
from capaflow.plans.results import plan_results

SF = "/root/testdata/sf0.001"


def test_every_shipment_is_placed_exactly_once(spark):
    r = plan_results(spark, SF)
    n = r.inputs.shipments.count()
    without = r.sender.unassigned.count()
    assert without > 0                      # the fixture has a cap and product nobody delivers
    n -= without
    assert r.sender.split.count() == n
    assert r.caps.driver.count() + r.caps.residual.count() == n
    printed = r.released.count()
    rejected = r.caps.driver.filter(~F.col("accepted")).count() + \
        r.caps.residual.filter(~F.col("accepted")).count()
    assert printed + rejected == n


def test_used_never_exceeds_declared(spark):
    used = plan_results(spark, SF).caps.used_after_residual
    assert used.filter(F.col("used_capacity") > F.col("declared_capacity")).count() == 0


def test_guaranteed_within_limit(spark):
    s = plan_results(spark, SF).sender.split
    over = s.filter(~F.col("exempt") & (F.col("next_step") == C.STEP_DRIVER)
                    & (F.col("sender_rank") > F.col("sender_limit")))
    assert over.count() == 0


def test_no_request_twice_in_one_step(spark):
    led = plan_results(spark, SF).ledger
    assert led.groupBy("pk", "request_id").count().filter("count > 1").count() == 0


def test_print_release_within_weekly_capacity(spark):
    rel = plan_results(spark, SF).released
    per_week = rel.filter("released").groupBy("delivery_week", "weekly_print_capacity").count()
    assert per_week.filter(F.col("count") > F.col("weekly_print_capacity")).count() == 0


def test_run_weeks_carries_rejects_forward(spark):
    inp = W.load_inputs(spark, SF)
    weeks = [r["delivery_week"] for r in
             inp.shipments.select("delivery_week").distinct().orderBy("delivery_week").limit(2).collect()]
    # the second week moved right behind the first one: it must wait for the first one's rejects
    rows = inp.shipments.filter(F.col("delivery_week").isin(weeks)).withColumn(
        "delivery_week", F.when(F.col("delivery_week") == weeks[1], F.date_add(F.lit(weeks[0]), 7)).otherwise(F.col("delivery_week")))
    some = W.Inputs(W.materialize(rows, force=True), inp.coverage, inp.capacity, inp.estimates, inp.print_config)
    out = W.run_weeks(spark, some, rounds=3).collect()
    assert len(out) == rows.count() == len({r.request_id for r in out})     # every shipment once
    later = [r for r in out if r.attempts > 1 and r.final_step == C.STEP_PHASE_2]
    assert later and all(r.delivery_week > weeks[0] for r in later)
    base = {r.request_id: r.delivery_week for r in rows.collect()}
    for r in out:   # each attempt is one week later
        planned = r.attempts - (r.final_step != C.STEP_SENDER)
        assert (r.delivery_week - base[r.request_id]).days == 7 * planned


def test_pipeline_range_strategy_equals_window(spark):
    """The skew-proof rank path gives the same plan as the window path end to end."""
    inp = W.load_inputs(spark, SF)

    def run():
        snd = W.sender_step(inp)
        caps, rel = W.capacity_and_print(snd, inp)
        return (sorted(map(tuple, snd.split.select("request_id", "next_step", "sender_rank").collect()),
                       key=str),
                sorted(map(tuple, caps.driver.select("request_id", "cap_pos", "prov_pos", "accepted")
                           .collect()), key=str),
                sorted(map(tuple, rel.select("request_id", "print_pos", "released").collect()), key=str))
    try:
        spark.conf.set("capaflow.rank.strategy", "window")
        a = run()
        spark.conf.set("capaflow.rank.strategy", "range")
        b = run()
    finally:
        spark.conf.unset("capaflow.rank.strategy")
    assert a == b
