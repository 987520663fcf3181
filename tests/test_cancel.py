"""Cancellation stream and dedupe horizon, each against a loop."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.operators import ledger as L
from capaflow.operators.horizon import accepted
from capaflow.streaming import cancel as S
from testbed import stream as bed



@pytest.fixture()
def world(spark, tmp_path):
    ledger, timeline = [], []
    for n in range(12):
        week = "2024-01-08" if n % 4 == 0 else "2024-01-15"
        steps = [C.STEP_SENDER] + ([C.STEP_PRINT] if n % 5 == 1 else [])
        for k, step in enumerate(steps):
            ledger.append((f"{week}~{step}", f"R{n}", f"IUN-{n // 2}", step, f"2024-01-01T0{k}:00:00.000Z"))
        timeline.append((f"IUN-{n // 2}", f"PREPARE_R{n}", "PREPARE_ANALOG_DOMICILE"))
    led = spark.createDataFrame(ledger, "pk string, request_id string, iun string, workflow_step string, created_at string")
    tl = spark.createDataFrame(timeline + [("IUN-0", "SEND_R0", "SEND_ANALOG_DOMICILE")], "iun string, element_id string, category string")
    # order k asks for IUN-k; 0 and 2 are asked for twice, a year later; 9 has no timeline
    orders = [(k, "P" if k != 3 else "O", dt.date(2020 + k % 3, 5, 1)) for k in (0, 1, 2, 3, 4, 9)] + [(0, "P", dt.date(2023, 5, 1)), (2, "P", dt.date(2023, 5, 1))]
    o = spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate date")
    return led, tl, bed.land(bed.cdc_records(o), f"{tmp_path}/in", period="year"), ledger


def test_cancellations(spark, world, tmp_path):
    led, tl, source, rows = world
    today = F.lit("2024-01-08").cast("date")
    out = f"{tmp_path}/out"
    S.run_cancellations(spark, source, out, tl, led, today, files_per_batch=1)
    latest = {}
    for pk, r, iun, step, at in rows:
        latest[r] = max(latest.get(r, ("",)), (at, pk, iun, step))
    asked = [f"IUN-{k}" for k in (0, 1, 2, 4)]
    gone = {(pk, r) for r, (_, pk, iun, step) in latest.items() if iun in asked and step == C.STEP_SENDER and not pk.startswith("2024-01-08")}

    def state():
        t = S.tombstones(spark, out, led)
        after = L.apply_tombstones(led, t)
        return (sorted((r.pk, r.request_id) for r in t.collect()), sorted((r.pk, r.request_id) for r in L.active(after).collect()),
                sorted((r.iun, r.request_id, r.sequence_number, r.cancellable) for r in S.requests_found(spark, out).collect()))

    first = state()
    assert first[0] == sorted((C.DELETED_PREFIX + pk, r) for pk, r in gone) and gone
    assert first[1] == sorted((pk, r) for pk, r, *_ in rows if (pk, r) not in gone)
    # both requests of an IUN are answered, the second one finds the row gone
    assert sorted(i for i, r, _, ok in first[2] if ok) == sorted(latest[r][2] for _, r in gone)
    assert len(first[2]) == 2 * len(asked) + 4
    S.run_cancellations(spark, source, out, tl, led, today, files_per_batch=1, checkpoint=f"{tmp_path}/again")   # a replay
    assert state() == first


@pytest.mark.parametrize("seed", range(3))
def test_horizon_is_a_chain(spark, seed):
    """One key holds a third of the records; times tie; what was dropped hides nothing."""
    rng = random.Random(seed)
    rows = [(("hot" if n % 3 == 0 else f"k{rng.randrange(9)}"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 9)), f"{n:04d}")
            for n in range(240)] + [("late", dt.datetime(2024, 1, 1), "a"), ("late", dt.datetime(2024, 1, 2), "b")]
    df = spark.createDataFrame(rows, "request_id string, ts timestamp, n string")
    want, last = [], {}
    for key, ts, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts >= last[key] + dt.timedelta(seconds=86400):
            want.append(n)
            last[key] = ts
    assert sorted(r.n for r in accepted(df, "request_id", "ts", "n", 86400).collect()) == sorted(want)
    assert accepted(df.filter("false"), "request_id", "ts", "n", 86400).count() == 0
