"""Unit vectors of the planner's own tests, re-stated on Spark DataFrames."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.functions import keys as K
from capaflow.operators import capacity as CAP
from capaflow.operators import drivers as D
from capaflow.operators import estimates as E
from capaflow.operators import sender as S

WEEK = dt.date(2025, 3, 3)


def _drivers(spark, rows):
    return spark.createDataFrame(
        [("T", "RM", WEEK, d, c, p) for d, c, p in rows],
        "tender_id string, province string, delivery_week date, unified_delivery_driver string, "
        "capacity int, products array<string>")


def test_components_by_intersecting_products(spark):
    comps = D.product_components(_drivers(spark, [("d2", 30, ["890"]), ("d1", 30, ["RS", "AR"]),
                                                  ("d3", 30, ["RS"])]))
    got = {tuple(r["products"]): (r["capacity"], tuple(r["drivers"])) for r in comps.collect()}
    assert got == {("AR", "RS"): (60, ("d1", "d3")), ("890",): (30, ("d2",))}


def test_net_capacity_subtracts_exempt_counters(spark):
    comps = D.product_components(_drivers(spark, [("d2", 30, ["RS"]), ("d1", 30, ["RS", "AR"])]))
    counters = spark.createDataFrame([(WEEK, "RM", "RS", 10)],
                                     "delivery_week date, province string, product_type string, "
                                     "number_of_shipments int")
    net = D.net_capacity(comps, counters).collect()
    assert [(r["capacity"], r["net_capacity"]) for r in net] == [(60, 50)]


def test_sender_limit_share_of_capacity(spark):
    # capacity 72, sender estimate 62 of a total of 72 -> limit 62
    comps = D.product_components(_drivers(spark, [("d1", 72, ["AR"])]))
    net = D.net_capacity(comps, spark.createDataFrame([], "delivery_week date, province string, "
                                                          "product_type string, number_of_shipments int"))
    shipment_date = WEEK - dt.timedelta(days=7)
    est = spark.createDataFrame([("PA1", "AR", "RM", shipment_date, 62, "2025-01-01"),
                                 ("PA2", "AR", "RM", shipment_date, 10, "2025-01-01")],
                                "pa_id string, product_type string, province string, delivery_date date, "
                                "weekly_estimate int, last_update string")
    lim = S.sender_limits(est, net, S.estimate_totals(est))
    got = {r["sender_pa_id"]: r["sender_limit"] for r in lim.collect()}
    assert got == {"PA1": 62, "PA2": 10}


def test_sender_split_limit_minus_used(spark):
    # limit 3, used 1, three shipments -> two to the driver step, one to residual
    rows = [(f"R{i}", WEEK, "RM", "PA1", "AR", 0, f"2025-02-0{i + 1}T00:00:00.000Z", "x") for i in range(3)]
    ship = spark.createDataFrame(rows, "request_id string, delivery_week date, province string, "
                                       "sender_pa_id string, product_type string, attempt int, "
                                       "notification_sent_at string, prepare_request_date string")
    limits = spark.createDataFrame([(WEEK, "RM", "PA1", "AR", 3)],
                                   "delivery_week date, province string, sender_pa_id string, "
                                   "product_type string, sender_limit int")
    used = spark.createDataFrame([("PA1", "AR", "RM", WEEK - dt.timedelta(days=7), 1)],
                                 "pa_id string, product_type string, province string, delivery_date date, "
                                 "number_of_shipment int")
    out = {r["request_id"]: r["next_step"] for r in S.split_by_sender_limit(ship, limits, used).collect()}
    assert out == {"R0": C.STEP_DRIVER, "R1": C.STEP_DRIVER, "R2": C.STEP_RESIDUAL}


def test_exempt_rows_skip_the_sender_limit(spark):
    rows = [("R0", WEEK, "RM", "PA1", "RS", 0, "a", "b"), ("R1", WEEK, "RM", "PA1", "AR", 1, "a", "b"),
            ("R2", WEEK, "RM", "PA1", "AR", 0, "a", "b")]
    ship = spark.createDataFrame(rows, "request_id string, delivery_week date, province string, "
                                       "sender_pa_id string, product_type string, attempt int, "
                                       "notification_sent_at string, prepare_request_date string")
    limits = spark.createDataFrame([], "delivery_week date, province string, sender_pa_id string, "
                                       "product_type string, sender_limit int")
    out = {r["request_id"]: r["next_step"] for r in S.split_by_sender_limit(ship, limits).collect()}
    assert out == {"R0": C.STEP_DRIVER, "R1": C.STEP_DRIVER, "R2": C.STEP_RESIDUAL}


def test_capacity_validity_interval(spark):
    cap = spark.createDataFrame([
        ("T", "D", "RM", "2025-01-01T00:00:00.000Z", "2025-12-31T00:00:00.000Z", 10),
        ("T", "D", "MI", "2024-01-01T00:00:00.000Z", "2024-06-30T00:00:00.000Z", 20),
        ("T", "D", "MI", "2024-07-01T00:00:00.000Z", None, 30),
        ("T", "D", "NA", "2026-01-01T00:00:00.000Z", None, 40)],
        "tender_id string, unified_delivery_driver string, geo_key string, activation_from string, "
        "activation_to string, capacity int")
    needs = spark.createDataFrame([("T", "D", g, WEEK) for g in ("RM", "MI", "NA")],
                                  "tender_id string, unified_delivery_driver string, geo_key string, "
                                  "delivery_week date")
    got = {r["geo_key"]: r["declared_capacity"] for r in CAP.capacity_in_force(needs, cap).collect()}
    assert got == {"RM": 10, "MI": 30, "NA": 0}


def test_weekly_estimates_february_2025(spark):
    docs = spark.createDataFrame([("k", "PA1", "02-2025", "2025-01-01", "AR", 0, "V1", 0, "Lombardia", 0, 1000)],
                                 "file_key string, pa_id string, periodo_riferimento string, last_update string, "
                                 "product_type string, product_idx int, variant string, variant_idx int, "
                                 "region string, region_idx int, value long")
    dist = spark.createDataFrame([("Lombardia", "MI", 60)], "region string, province string, percentage int")
    rec = E.province_records(docs, dist)
    got = {str(r["delivery_date"]): (r["week_type"], r["weekly_estimate"]) for r in rec.collect()}
    assert len(got) == 5
    assert got["2025-01-27"] == ("PARTIAL_START", 43)
    assert got["2025-02-03"] == ("FULL", 150)
    assert got["2025-02-24"] == ("PARTIAL_END", 107)


def test_boundary_week_merge(spark):
    # end of February portion 3 + start of March portion 8 -> 11
    rows = [("k1", "PA1", "AR", "MI", "V1", "02-2025", 0, 0, 0, dt.date(2025, 2, 24), "PARTIAL_END", 3, 10.0, 100),
            ("k2", "PA1", "AR", "MI", "V1", "03-2025", 0, 0, 0, dt.date(2025, 2, 24), "PARTIAL_START", 8, 20.0, 200)]
    rec = spark.createDataFrame(rows, "file_key string, pa_id string, product_type string, province string, "
                                      "variant string, periodo_riferimento string, product_idx int, "
                                      "variant_idx int, region_idx int, delivery_date date, week_type string, "
                                      "weekly_estimate long, monthly_estimate double, original_estimate long")
    m = E.merge_weekly(rec).collect()[0]
    assert (m["weekly_estimate"], m["first_week_weekly_estimate"], m["second_week_weekly_estimate"]) == (11, 3, 8)
    assert (m["monthly_estimate"], m["file_key"]) == (10.0, "k1")


def test_delivery_weeks(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 3, 3, 10),), (dt.datetime(2025, 3, 9, 23),)], "ts timestamp")
    out = df.select(K.next_weekday_strict(F.col("ts")).alias("n"),
                    K.previous_or_same_weekday(F.col("ts")).alias("p")).collect()
    assert [(str(r["n"]), str(r["p"])) for r in out] == [("2025-03-10", "2025-03-03"),
                                                         ("2025-03-10", "2025-03-03")]


def test_priority_default_and_strict(spark):
    df = spark.createDataFrame([("RS", 0), ("RS", 1), ("AR", 1)], "product_type string, attempt int")
    got = [r["priority"] for r in K.with_priority(df).orderBy("product_type", "attempt").collect()]
    assert got == [2, 1, 3]
    ok, bad = K.split_by_priority(df)
    assert ok.count() == 2 and bad.count() == 1


def test_components_need_several_widening_steps(spark):
    # {AR} - {AR,890} - {890,RS} - {RS,RIR}: one component reached in three steps; {RIS} alone
    comps = D.product_components(_drivers(spark, [("d1", 1, ["AR"]), ("d2", 2, ["AR", "890"]),
                                                  ("d3", 4, ["890", "RS"]), ("d4", 8, ["RIR", "RS"]),
                                                  ("d5", 16, ["RIS"])]))
    got = {r["component"]: (tuple(r["products"]), r["capacity"]) for r in comps.collect()}
    assert got == {"890": (("890", "AR", "RIR", "RS"), 15), "RIS": (("RIS",), 16)}


def test_cap_in_two_provinces_is_refused(spark):
    from capaflow.operators.drivers import reject_shared_caps
    cols = "tender_id string, cap string, province string"
    reject_shared_caps(spark.createDataFrame([("T", "1", "A"), ("T", "1", "A"), ("U", "1", "B")], cols))
    with pytest.raises(ValueError):
        reject_shared_caps(spark.createDataFrame([("T", "1", "A"), ("T", "1", "B")], cols))
