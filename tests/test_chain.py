"""The whole chain of weeks against a queue planned week by week."""
import datetime as dt

from capaflow import config as C
from capaflow.plans import weekly as W

DAY = dt.timedelta(days=1)
FIRST = dt.date(2025, 1, 6)


def at(day, end=False):
    return f"{day}T23:59:59.999Z" if end else f"{day}T00:00:00.000Z"


def brute(rows, versions, weeks):
    """request id -> (week, attempts) of all that the first-come queue of a driver places."""
    out, tries = {}, {}
    for k in range(weeks):
        week = FIRST + 7 * k * DAY
        valid = [v for v in versions if v[0] <= at(week) and (v[1] is None or v[1] >= at(week))]
        queue = [r for r, w in rows if w <= week and r not in out]
        for r in queue:
            tries[r] = tries.get(r, 0) + 1
        for r in sorted(queue)[:max(valid)[2] if valid else 0]:
            out[r] = (week, tries[r])
    return out


def test_whole_chain_places_all_that_can_be(spark):
    # two weeks of backlog, a fresh week it runs into, weeks without capacity, a late version; another cap never has any
    fresh = [FIRST] * 5 + [FIRST + 14 * DAY] * 3
    rows = [(f"R{k}", w) for k, w in enumerate(fresh)]
    versions = [(at(FIRST - 50 * DAY), None, 1), (at(FIRST - 30 * DAY), at(FIRST + 13 * DAY, True), 2),
                (at(FIRST + 14 * DAY), at(FIRST + 34 * DAY, True), 0)]
    never = [("X1", FIRST), ("X2", FIRST + 14 * DAY)]
    ship = [(r, "I", "Z", "AR", 0, "PA1", "RM", "L", cap, at(FIRST - 40 * DAY + k * DAY), at(FIRST - 40 * DAY + k * DAY), w, "T")
            for cap, some in (("001", rows), ("002", never)) for k, (r, w) in enumerate(some)]
    shipments = spark.createDataFrame(ship, "request_id string, iun string, recipient_id string, product_type string, attempt int, "
                                            "sender_pa_id string, province string, region string, cap string, notification_sent_at string, "
                                            "prepare_request_date string, delivery_week date, tender_id string")
    coverage = spark.createDataFrame([("T", c, "AR", "RM", 0, "D") for c in ("001", "002")],
                                     "tender_id string, cap string, product_type string, province string, nation_key int, "
                                     "unified_delivery_driver string")
    caps = [("T", "D", g, level, "RM", f, t, n, ["AR"] if level == "PROVINCE" else None)
            for g, level in (("RM", "PROVINCE"), ("001", "CAP")) for f, t, n in versions]
    capacity = spark.createDataFrame(caps, "tender_id string, unified_delivery_driver string, geo_key string, geo_level string, "
                                           "province string, activation_from string, activation_to string, capacity int, products array<string>")
    estimates = spark.createDataFrame([], "pa_id string, product_type string, province string, delivery_date date, weekly_estimate int, "
                                          "monthly_estimate double, original_estimate int, last_update string, file_key string")
    prints = spark.createDataFrame([(dt.date(1970, 1, 1), 100, 17)], "start_date date, daily_capacity int, executions_per_day int")
    got = W.run_weeks(spark, W.Inputs(shipments, coverage, capacity, estimates, prints)).collect()
    assert len(got) == len(rows) + len(never)
    expected = brute(rows, versions, 20)
    assert len(expected) == len(rows)
    assert {r.request_id: (r.delivery_week, r.attempts) for r in got if r.final_step == C.STEP_PHASE_2} == expected
    assert {r.request_id for r in got if r.final_step == C.NO_CAPACITY} == {"X1", "X2"}
