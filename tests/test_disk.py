"""What a query leaves on disk while it runs: one step's exchange at a time, and no copy that nothing reads any more."""
import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from capaflow import catalog_more, catalog_reports, catalog_sources, config as C
from capaflow.operators import ledger as L
from capaflow.operators import ranking
from capaflow.plans import reports as R
from capaflow.plans import results
from capaflow.plans import weekly as W
from capaflow.session import SHUFFLE_CLEANUP_CONF, ensure_checkpoint_dir, stage_table
from capaflow.sources import cdc, files
from capaflow.sources import ledger_store as LS
from capaflow.sources.planner_store import PlannerStore
from tests.test_plan_size import LEDGER, WEEK, planned, queue  # noqa: F401


@pytest.fixture()
def conf(spark):
    held = []

    def put(key, value):
        held.append(key)
        spark.conf.set(key, value)
    yield put
    for key in held:
        spark.conf.unset(key)


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def staged(spark, name):
    return {n for n in files.folders(spark, f"{ensure_checkpoint_dir(spark)}/tables") if n.startswith(name)}


def test_shuffle_files_go_with_their_write(spark):
    before = shuffle_files(spark)
    df = spark.range(1000).selectExpr("id % 7 k", "id v").repartition(5, "k")
    out = stage_table(df)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:   # they are removed behind the write
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert out.count() == 1000 and spark.conf.get(SHUFFLE_CLEANUP_CONF, "false") == "false"


def test_the_copy_of_the_print_rank_goes(spark, planned, conf):
    drv, res = planned.caps.driver, planned.caps.residual
    conf("capaflow.rank.strategy", "range")
    before = staged(spark, "rank-")
    out = W.print_step(drv, res, planned.inputs.print_config, 40)
    assert staged(spark, "rank-") == before
    assert sorted(map(str, out.collect())) == sorted(map(str, planned.released.collect()))


def test_coverage_sends_only_who_may_be_queued_again(spark):
    rows = [(0, r, 0, "AR", None, "1", "P") for r in ("a", "a", "b", None)] + [(0, "s", 1, "AR", None, "1", "Q"), (0, "s", 0, "AR", None, "1", "S")]
    rows += [(1, "a", 0, "AR", "D", "1", "P"), (1, "s", 0, "AR", "D", "1", "Q"), (1, None, 0, "AR", "D", "1", "P"), (1, "s", None, "AR", "D", "1", "S"),
             (None, "n", 0, "AR", None, "1", "P"), (None, None, None, None, None, None, None), (9, "z", 0, "AR", None, "1", "P"), (3, "y", 0, "RS", None, "1", "P")]
    rows = queue(*rows) + [(WEEK, step, "PA", p, "AR", 0, "a", "D", "1") for step, p in ((C.STEP_PRINT, "P"), (C.STEP_PHASE_2, "T"), (C.STEP_DRIVER, "U"))]
    ledger = spark.createDataFrame(rows, LEDGER)
    est = spark.createDataFrame([("PA", "AR", "P", WEEK, 5, 20.0, 6), ("PB", "AR", None, None, 5, 20.0, 6)],
                                "pa_id string, product_type string, province string, delivery_date date, weekly_estimate int, monthly_estimate double, original_estimate int")
    lim = spark.createDataFrame([(WEEK, "PA", "AR", "Q", 3)], "delivery_date date, pa_id string, product_type string, province string, sender_limit int")
    names = {"in_estimates": "declared", "in_limits": "limited", "in_total": "is_input", "in_passed": "passed", "in_not_passed": "is_back", "in_phase_2": "phase_2"}
    want = R._report_rows(ledger, est, lim).filter(R._HELD).groupBy(*R.KEY).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in names.items()])
    got = R.key_coverage(ledger, est, lim)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.delivery_week, r.province) for r in got.collect() if r.in_not_passed} == {(WEEK, "P"), (WEEK, "S"), (None, "P"), (None, None)}
    assert "z" not in {r.request_id for r in R.candidates(ledger).collect()}


def test_second_put_is_made_step_by_step(spark, planned, monkeypatch):
    puts = []
    monkeypatch.setattr(LS, "upsert", lambda s, p, rows, key, f=LS.upsert: puts.append({r[0] for r in rows.select("workflow_step").distinct().collect()}) or f(s, p, rows, key))
    before = staged(spark, "upsert") | staged(spark, "second")
    got = {(r.pk, r.request_id): (r.unified_delivery_driver, r.priority) for r in catalog_sources.src_10(spark, "own rows").collect()}
    assert puts == [{C.STEP_SENDER}, {C.STEP_SENDER}, {C.STEP_PRINT}]
    assert staged(spark, "upsert") | staged(spark, "second") == before
    want = {}
    drivers = {r.request_id: (r.unified_delivery_driver, r.priority) for r in planned.sender.enriched.collect()}
    for r in planned.ledger.collect():
        if r.workflow_step == C.STEP_SENDER and r.created_at.endswith("T00:00:00.000Z"):
            want[r.pk, r.request_id] = drivers[r.request_id] if r.product_type == "RS" or r.attempt == 1 else (None, None)
        elif r.workflow_step == C.STEP_PRINT:
            want[r.pk, r.request_id] = (r.unified_delivery_driver, r.priority)
    assert got == want


def test_sorted_ledger_and_ranges_take_a_step_at_a_time(spark, planned, monkeypatch, conf):
    steps = []

    def seen(df):
        steps.append({r[0] for r in df.select("workflow_step").distinct().collect()})
        return df
    monkeypatch.setattr(LS, "write_sorted", lambda df, *a, f=LS.write_sorted: f(seen(df), *a))
    path = catalog_more.sorted_ledger(spark, "own rows")
    del catalog_more._SORTED[results.session_key(spark, "own rows")]
    assert spark.read.parquet(path).count() == planned.ledger.count()
    conf("capaflow.rank.strategy", "range")
    monkeypatch.setattr(ranking, "stage_table", lambda df, *a, f=ranking.stage_table: f(seen(df) if "_row" in df.columns else df, *a))
    catalog_more.lkp_02(spark, "own rows")
    assert len(steps) == 12 and all(len(s) <= 1 for s in steps)


def test_rows_of_known_unknown_and_no_step(spark):
    ledger = spark.createDataFrame([(s, n) for n, s in enumerate([C.STEP_SENDER, C.STEP_PRINT, "OTHER", None])], "workflow_step string, n int")
    parts = [sorted(r.n for r in p.collect()) for p in L.by_step(ledger)]
    assert sorted(parts) == [[], [], [], [0], [1], [2, 3]]


def test_delete_cascade_keys(spark, planned):
    tails = {r.request_id for r in planned.released.collect() if not r.released}
    want = set()
    for r in planned.ledger.filter(F.col("request_id").isin(*tails)).collect():
        wk, before = str(r.delivery_week), str(r.delivery_week - dt.timedelta(days=7))
        want |= {("ledger", f"{r.pk}~{r.request_id}", wk), ("exempt_counter", f"{r.province}~{r.product_type}", wk), ("print_counter", "PRINT", wk),
                 ("used_sender_limit", f"{r.sender_pa_id}~{r.product_type}~{r.province}", before)}
        if r.workflow_step == C.STEP_PRINT:
            want |= {("used_capacity", f"{r.unified_delivery_driver}~{geo}", wk) for geo in (r.cap, r.province)}
    got = [tuple(r) for r in catalog_more.join_14(spark, "own rows").collect()]
    got = [(t, k, str(w)) for t, k, w in got]
    assert tails and len(got) == len(set(got)) and set(got) == want


def test_marks_of_a_deletion_go(spark, tmp_path, conf):
    conf("capaflow.rank.maxOffsetRowsToBroadcast", "0")
    rows = [(WEEK, s, f"{WEEK}~{s}", f"R{n}", "RS", 0, "PA", "P", "001", "D", f"{WEEK}T00:00:00.000Z") for n in range(6) for s in (C.STEP_SENDER, C.STEP_PRINT)]
    ledger = spark.createDataFrame(rows, "delivery_week date, workflow_step string, pk string, request_id string, product_type string, attempt int, "
                                         "sender_pa_id string, province string, cap string, unified_delivery_driver string, created_at string")
    used = spark.createDataFrame([("D", "001", WEEK, 6)], "unified_delivery_driver string, geo_key string, delivery_week date, used_capacity int")
    store = PlannerStore(spark, str(tmp_path)).create(ledger, used, spark.createDataFrame([], "pk string, delivery_date date, number_of_shipment int"))
    before = staged(spark, "marked")
    store.delete_requests(spark.createDataFrame([("R1",), ("R1",), (None,)], "request_id string"))
    assert sorted({r.request_id for r in store.read("ledger").collect()}) == ["R0", "R2", "R3", "R4", "R5"] and store.read("ledger").count() == 10
    assert [r.used_capacity for r in store.read("used_capacity").collect()] == [5]
    assert staged(spark, "marked") == before and "_marked" not in files.folders(spark, str(tmp_path))


def test_lake_images_are_dealt_a_step_at_a_time(spark, planned, monkeypatch):
    steps = []
    monkeypatch.setattr(cdc, "store", lambda images, path, f=cdc.store: steps.append(
        {r[0] for r in images.select("dynamodb.NewImage.workflow_step.S").distinct().collect()}) or f(images, path))
    [images] = catalog_reports.lake_images(spark, "own rows", "shipment_ledger")
    catalog_reports._LAKE.pop(results.session_key(spark, "own rows"))
    assert all(len(s) <= 1 for s in steps) and images.count() == planned.ledger.count()


def test_many_cancelled_ids_meet_the_ledger_a_step_at_a_time(spark, planned, conf):
    ids = stage_table(spark.createDataFrame([("R1",), ("R2",), ("none",), (None,)], "request_id string"), "ids")
    few = sorted(map(str, L.rows_of(planned.ledger, ids).collect()))
    conf("capaflow.rank.maxOffsetRowsToBroadcast", "0")
    before = staged(spark, "rows-of-ids")
    assert sorted(map(str, L.rows_of(planned.ledger, ids).collect())) == few and few
    assert len(staged(spark, "rows-of-ids") - before) == len(L.by_step(planned.ledger))


def test_a_cancellation_batch_leaves_only_its_results(spark, tmp_path, conf):
    from capaflow.streaming import cancel as S
    from testbed import stream as bed
    conf("capaflow.rank.maxOffsetRowsToBroadcast", "0")
    ledger = spark.createDataFrame([(f"2024-01-15~{C.STEP_SENDER}", f"R{n}", f"IUN-{n}", C.STEP_SENDER, "2024-01-01T00:00:00.000Z") for n in range(9)],
                                   "pk string, request_id string, iun string, workflow_step string, created_at string")
    timeline = spark.createDataFrame([(f"IUN-{n}", f"PREPARE_R{n}", "PREPARE_ANALOG_DOMICILE") for n in range(9)], "iun string, element_id string, category string")
    batch = bed.cdc_records(spark.createDataFrame([(3, "P", dt.date(2020, 1, 1))], "o_orderkey long, o_orderstatus string, o_orderdate date"))
    before = staged(spark, "")
    S.cancel_batch(batch, 0, str(tmp_path), timeline, ledger, F.lit("2024-01-08").cast("date"))
    assert staged(spark, "") == before
    assert [(r.request_id, r.cancellable) for r in S.requests_found(spark, str(tmp_path)).collect()] == [("R3", True)]
    assert [r.pk for r in S.tombstones(spark, str(tmp_path), ledger).collect()] == [f"{C.DELETED_PREFIX}2024-01-15~{C.STEP_SENDER}"]
