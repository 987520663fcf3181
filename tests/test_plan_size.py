"""What a query runs, stages and sends through a shuffle: no more than its result needs."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from capaflow import catalog_more, catalog_reports, config as C
from capaflow.operators import allocate as A
from capaflow.operators import ranking
from capaflow.plans import reports as R
from capaflow.plans import results
from capaflow.plans import weekly as W
from capaflow.sources import files
from capaflow.sources import testdata as T
from capaflow.sources import ledger_store as LS
from capaflow.sources.planner_store import PlannerStore
from capaflow.streaming import cancel as S
from testbed import stream as bed

WEEK = dt.date(2025, 1, 6)


def at(day):
    return f"{day}T00:00:00.000Z"


@pytest.fixture()
def planned(spark):
    ship = [(f"R{n}", f"I{n}", "Z", ("AR", "890", "RS")[n % 3], int(n % 7 == 0), f"PA{n % 2}", "RM", "L", f"00{n % 2}",
             at(WEEK - dt.timedelta(days=n)), at(WEEK - dt.timedelta(days=n)), WEEK + dt.timedelta(days=7 * (n % 2)), "T") for n in range(40)]
    shipments = spark.createDataFrame(ship, "request_id string, iun string, recipient_id string, product_type string, attempt int, "
                                            "sender_pa_id string, province string, region string, cap string, notification_sent_at string, "
                                            "prepare_request_date string, delivery_week date, tender_id string")
    coverage = spark.createDataFrame([("T", f"00{k}", p, "RM", 0, "D") for k in range(2) for p in ("AR", "890", "RS")],
                                     "tender_id string, cap string, product_type string, province string, nation_key int, unified_delivery_driver string")
    caps = [("T", "D", g, level, "RM", at("2020-01-01"), None, n, ["AR", "890", "RS"] if level == "PROVINCE" else None)
            for g, level, n in (("RM", "PROVINCE", 15), ("000", "CAP", 9), ("001", "CAP", 8))]
    capacity = spark.createDataFrame(caps, "tender_id string, unified_delivery_driver string, geo_key string, geo_level string, "
                                           "province string, activation_from string, activation_to string, capacity int, products array<string>")
    estimates = spark.createDataFrame([], "pa_id string, product_type string, province string, delivery_date date, weekly_estimate int, "
                                          "monthly_estimate double, original_estimate int, last_update string, file_key string")
    prints = spark.createDataFrame([(dt.date(1970, 1, 1), 1, 2)], "start_date date, daily_capacity int, executions_per_day int")
    inp = W.Inputs(shipments, coverage, capacity, estimates, prints)
    snd = W.sender_step(inp)
    key = results.session_key(spark, "own rows")
    results._CACHE[key] = results.PlanResults(inp, snd, W.CapacitySteps(snd))
    yield results._CACHE[key]
    del results._CACHE[key]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_query_runs_only_the_steps_that_it_needs(planned):
    assert planned.sender.components.count() == 2
    assert "split" not in vars(planned.sender) and "driver" not in vars(planned.caps)
    planned.caps.used_after_driver.count()
    assert "residual" not in vars(planned.caps)


def test_ranks_are_measured_without_a_copy(spark, monkeypatch):
    monkeypatch.setattr(ranking, "stage_table", lambda *a: pytest.fail("staged"))
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5)], "k string, v int")
    assert sorted((r.v, r.pos) for r in ranking.positions(df, ["k"], ["v"]).collect()) == [(1, 1), (2, 2), (5, 1)]


def test_both_ranks_of_an_allocation_share_an_exchange(spark, planned):
    rows = planned.sender.split
    out = A.allocate(rows, planned.inputs.capacity, C.STEP_DRIVER, row_bound=40)
    assert plan_of(out).count("Exchange hashpartitioning") == 1
    try:
        spark.conf.set("capaflow.rank.strategy", "range")
        other = A.allocate(rows, planned.inputs.capacity, C.STEP_DRIVER)
    finally:
        spark.conf.unset("capaflow.rank.strategy")
    cols = ["request_id", "cap_pos", "prov_pos", "accepted"]
    got = sorted(map(str, out.select(*cols).collect()))
    assert got == sorted(map(str, other.select(*cols).collect()))
    assert any("prov_pos=None" in r for r in got) and any("accepted=True" in r for r in got)


def test_ledger_is_no_copy(planned, monkeypatch):
    stage = W.stage_table
    monkeypatch.setattr(W, "stage_table", lambda df, *a: pytest.fail("staged") if "created_at" in df.columns else stage(df, *a))
    assert planned.ledger.groupBy("pk", "request_id").count().filter("count > 1").count() == 0


def test_latest_row_takes_only_its_columns(spark, planned):
    assert "prepare_request_date" not in plan_of(catalog_more.alc_17(spark, "own rows")).partition("Scan")[0]
    latest = {r.request_id: r.workflow_step for r in catalog_more.alc_17(spark, "own rows").collect()}
    want = {}
    for r in planned.ledger.collect():
        want[r.request_id] = max(want.get(r.request_id, ("",)), (r.created_at, r.workflow_step))
    assert latest == {k: v[1] for k, v in want.items()}


def test_cancellation_leaves_the_ledger_where_it_is(spark, tmp_path, monkeypatch):
    ledger = spark.createDataFrame([(f"2024-01-15~{C.STEP_SENDER}", f"R{n}", f"IUN-{n}", C.STEP_SENDER, at("2024-01-01")) for n in range(9)],
                                   "pk string, request_id string, iun string, workflow_step string, created_at string")
    timeline = spark.createDataFrame([(f"IUN-{n}", f"PREPARE_R{n}", "PREPARE_ANALOG_DOMICILE") for n in range(9)], "iun string, element_id string, category string")
    batch = bed.cdc_records(spark.createDataFrame([(3, "P", dt.date(2020, 1, 1))], "o_orderkey long, o_orderstatus string, o_orderdate date"))
    seen, latest = [], S.L.latest_per_request
    monkeypatch.setattr(S.L, "latest_per_request", lambda df: seen.append(plan_of(df)) or latest(df))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        S.cancel_batch(batch, 0, str(tmp_path), timeline, ledger, F.lit("2024-01-08").cast("date"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in seen[0] and "Exchange hashpartitioning" not in seen[0]
    assert [r.request_id for r in S.requests_found(spark, str(tmp_path)).collect()] == ["R3"]


def test_delete_meets_the_ledger_once(spark, tmp_path, monkeypatch):
    rows = [(WEEK, s, f"{WEEK}~{s}", f"R{n}", "RS", 0, "PA", "P", "001", "D", at(WEEK)) for n in range(6) for s in (C.STEP_SENDER, C.STEP_PRINT)]
    ledger = spark.createDataFrame(rows, "delivery_week date, workflow_step string, pk string, request_id string, product_type string, attempt int, "
                                         "sender_pa_id string, province string, cap string, unified_delivery_driver string, created_at string")
    used = spark.createDataFrame([("D", "001", WEEK, 6)], "unified_delivery_driver string, geo_key string, delivery_week date, used_capacity int")
    limit = spark.createDataFrame([], "pk string, delivery_date date, number_of_shipment int")
    store = PlannerStore(spark, str(tmp_path)).create(ledger, used, limit)
    changes = []
    monkeypatch.setattr(PlannerStore, "change", lambda self, contents, stop_after=None: changes.append(contents))
    ids = spark.createDataFrame([("R1",), ("R1",), (None,)], "request_id string")
    store.delete_requests(ids)
    assert changes[0]["ledger"][1].count() == 10
    assert not any("request_id" in line for df in changes[0]["ledger"] for line in plan_of(df).splitlines() if "Join" in line)


def test_first_put_is_written_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LS, "stage_table", lambda *a: pytest.fail("staged"))
    rows = [("a", WEEK, "S", 1), ("a", WEEK, "S", None), ("a", WEEK, "S", 2), (None, WEEK, "S", 4), (None, WEEK, "S", 3)]
    LS.upsert(spark, f"{tmp_path}/l", spark.createDataFrame(rows, "id string, delivery_week date, workflow_step string, v int"), ["id"])
    assert {(r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/l").collect()} == {("a", 2), (None, 4)}


def test_lake_stores_the_tables_that_are_read(spark, planned):
    [images] = catalog_reports.lake_images(spark, "own rows", "shipment_ledger")
    assert images.count() == planned.ledger.count()
    entry = catalog_reports._LAKE.pop(results.session_key(spark, "own rows"))
    assert list(files.folders(spark, entry[0])) == ["shipment_ledger"]


def test_orders_meet_customers_before_line_items(spark, tmp_path):
    def rows(name, *cols, n=5000):
        spark.range(n).selectExpr(*cols).write.parquet(f"{tmp_path}/{name}.parquet")
    day = "timestamp'1995-03-01' as {}".format
    rows("region", "cast(id as int) r_regionkey", "'R' r_name", n=1)
    rows("nation", "cast(id as int) n_nationkey", "concat('N', id) n_name", "0 n_regionkey", n=3)
    rows("customer", "xxhash64(id) c_custkey", "cast(id % 4 as int) c_nationkey")
    rows("orders", "xxhash64(-id) o_orderkey", "if(id = 7, null, xxhash64(id div 2)) o_custkey", day("o_orderdate"))
    rows("lineitem", "xxhash64(-(id div 3)) l_orderkey", "1 l_linenumber", "xxhash64(id) l_partkey", "id l_suppkey",
         "1.5D l_extendedprice", "'A' l_returnflag", day("l_shipdate"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
        shp = T.shipments(spark, str(tmp_path))
        plan = plan_of(shp)
        got = {r.province: r["count"] for r in shp.groupBy("province").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") == 4
    assert plan.index("SortMergeJoin [l_orderkey") < plan.index("SortMergeJoin [o_custkey")
    want = {}
    for i in range(5000):
        nation = i // 3 // 2 % 4
        if nation < 3 and i // 3 != 7:
            want[f"N{nation}"] = want.get(f"N{nation}", 0) + 1
    assert got == want


def test_pages_send_a_request_id_once(spark, planned):
    pages = catalog_more.lkp_02(spark, "own rows")
    assert "length(request_id" in plan_of(pages) and "hashpartitioning(pk" not in plan_of(pages)
    try:
        spark.conf.set("capaflow.rank.strategy", "range")
        ranged = sorted(map(tuple, catalog_more.lkp_02(spark, "own rows").collect()))
    finally:
        spark.conf.unset("capaflow.rank.strategy")
    want = sorted((r.pk, r.sk, r.request_id, 1) for r in catalog_more.prj_02(spark, "own rows").collect())
    assert sorted(map(tuple, pages.collect())) == ranged == want


def test_sorted_ledger_derives_its_keys_behind_the_exchange(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(WEEK, s, r) for s in ("A", "B") for r in ("x", None, "y", "y")], "delivery_week date, workflow_step string, request_id string")
    sent, deal = [], type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *by: sent.append(self.columns) or deal(self, *by))
    derived = {"pk": F.concat_ws("~", "delivery_week", "workflow_step"), "sk": F.concat_ws("~", F.lit("D"), "request_id")}
    LS.write_sorted(df.withColumns({"pk": derived["pk"]}), f"{tmp_path}/l", derived)
    assert sent == [["delivery_week", "workflow_step", "request_id"]]
    got = sorted(tuple(r) for r in LS.range_scan(spark, f"{tmp_path}/l", "B", prefix="D~").select("pk", "sk", "request_id").collect())
    assert got == [(f"{WEEK}~B", "D~x", "x"), (f"{WEEK}~B", "D~y", "y"), (f"{WEEK}~B", "D~y", "y")]


def test_components_write_no_shipments(spark, tmp_path, monkeypatch):
    def rows(name, *cols, n=300):
        spark.range(n).selectExpr(*cols).write.parquet(f"{tmp_path}/{name}.parquet")
    rows("region", "cast(id as int) r_regionkey", "'R' r_name", n=1)
    rows("nation", "cast(id as int) n_nationkey", "concat('N', id) n_name", "0 n_regionkey", n=3)
    rows("customer", "id c_custkey", "cast(id % 4 as int) c_nationkey")
    rows("orders", "id o_orderkey", "if(id = 7, null, id div 2) o_custkey", "timestamp'1995-03-01' o_orderdate")
    rows("lineitem", "id div 3 l_orderkey", "cast(id % 8 as int) l_linenumber", "id l_partkey", "id l_suppkey", "1.5D l_extendedprice",
         "substr('ANR', cast(id % 3 as int) + 1, 1) l_returnflag", "if(id % 50 = 0, null, timestamp'1995-03-01' + make_interval(0, 0, 0, cast(id as int))) l_shipdate")
    stage = W.stage_table
    monkeypatch.setattr(W, "stage_table", lambda df, *a: pytest.fail("staged") if "request_id" in df.columns else stage(df, *a))
    inp = W.load_inputs(spark, str(tmp_path))
    lean = [sorted(map(str, df.collect())) for df in (W.sender_step(inp).components, inp.capacity, inp.estimates, inp.print_config)]
    assert all(lean)
    monkeypatch.setattr(W, "stage_table", stage)
    shp = inp.shipments
    plain = W.Inputs(shp, inp.coverage, inp.capacity, inp.estimates, inp.print_config)
    assert lean[0] == sorted(map(str, W.sender_step(plain).components.collect()))
    per_sender = {tuple(r)[:4]: r.n for r in shp.groupBy("sender_pa_id", "product_type", "province", "delivery_week").agg(F.count("*").alias("n")).collect()
                  if r.product_type != "RS"}
    assert sorted(per_sender.values()) == sorted(r.original_estimate for r in inp.estimates.collect())
    weeks = [r["count"] for r in shp.groupBy("delivery_week").count().collect()]
    assert {r.daily_capacity for r in inp.print_config.collect()} == {sum(weeks) // len(weeks) // 12, sum(weeks) // len(weeks) // 9}


def test_a_ledger_row_formats_its_day_once(spark, planned):
    whole = plan_of(catalog_more.prj_03(spark, "own rows"))
    assert "INTERVAL" not in whole and "HH:mm" not in whole
    hours = {C.STEP_SENDER: 0, C.STEP_DRIVER: 1, C.STEP_RESIDUAL: 1, C.STEP_PRINT: 2, C.STEP_PHASE_2: 3}
    own = [r for r in planned.ledger.collect() if not r.created_at.endswith("T04:00:00.000Z")]
    assert own and all(r.created_at == f"{r.delivery_week}T0{hours[r.workflow_step]}:00:00.000Z" for r in own)
    pushed = [r for r in planned.ledger.collect() if r.created_at.endswith("T04:00:00.000Z")]
    assert pushed and all(r.created_at[:10] == str(r.delivery_week - dt.timedelta(days=7)) for r in pushed)


LEDGER = "delivery_week date, workflow_step string, sender_pa_id string, province string, product_type string, attempt int, request_id string, unified_delivery_driver string, cap string"


def queue(*rows):
    """Sender rows: (weeks after WEEK, request, attempt, product, driver, cap, province)."""
    return [(None if w is None else WEEK + dt.timedelta(days=7 * w), C.STEP_SENDER, "PA", prov, prod, a, r, d, cap) for w, r, a, prod, d, cap, prov in rows]


def test_sender_counts_take_the_input_once(spark):
    ledger = spark.createDataFrame(queue((0, "a", 1, "RS", None, "1", "P"), (0, "a", 0, "RS", None, "1", "P"), (0, None, None, "AR", None, "1", "P"),
                                         (0, None, 1, "AR", None, "1", "P"), (1, "b", 0, None, None, "1", "P"), (None, "c", 1, "AR", None, "1", "P")), LEDGER)
    counts = R.sender_counts(ledger)
    assert "Generate" not in plan_of(counts)
    got = {(r.delivery_week, r.product_type): (r.shipments, r.rs, r.second_attempts) for r in counts.collect()}
    assert got == {(WEEK, "RS"): (1, 1, 1), (WEEK, "AR"): (1, 0, 1), (WEEK + dt.timedelta(days=7), None): (1, 0, 0), (None, "AR"): (1, 0, 1)}


def test_only_saturated_keys_are_sent_for_overflow(spark):
    rows = [(0, r, 0, "AR", None, "1", "P") for r in ("a", "a", "b", "c", None)]
    rows += [(1, "a", 0, "AR", "D", "1", "P"), (1, "a", 0, "AR", "D", "1", "P"), (1, "a", 0, "AR", "D", "2", "P"), (1, "b", 0, "AR", "E", "1", "P"),
             (1, "c", 0, "AR", "D", "3", "Q"), (1, None, 0, "AR", "D", "P", "P"), (1, "new", 0, "AR", "D", "1", "P"), (None, "a", 0, "AR", "D", "1", "P")]
    ledger = spark.createDataFrame(queue(*rows), LEDGER)
    caps = spark.createDataFrame([(WEEK, "D", "P", 5, 5), (WEEK, "D", "1", 2, 2), (WEEK, "D", "3", 1, 2), (WEEK, "E", "1", 0, 1), (None, "D", "1", 1, 1)],
                                 "delivery_week date, unified_delivery_driver string, geo_key string, used_capacity int, declared_capacity int")
    over = R.overflow_rows(ledger, caps)
    assert "collect_set" not in plan_of(over)
    got = sorted((str(r.request_id), r.geo_key) for r in over.collect())
    assert got == [("None", "P"), ("a", "1"), ("a", "P"), ("a", "P")]
    assert {(r.unified_delivery_driver, r.geo_key, r.overflow) for r in R.overflow_counts(over).collect()} == {("D", "P", 1), ("D", "1", 1)}


def test_a_pass_over_the_split_serves_all_steps(spark, planned, monkeypatch):
    planned.sender.split
    scans = []
    monkeypatch.setattr(A, "declared_and_used", lambda needs, *a, f=A.declared_and_used, **k: scans.append(plan_of(needs)) or f(needs, *a, **k))
    monkeypatch.setattr(ranking, "largest_group", lambda *a: pytest.fail("measured on the shipments"))
    spark.conf.set("capaflow.rank.maxGroupRows", "30")   # above each province's week, below the 40 rows of all
    try:
        planned.caps.residual.count()
    finally:
        spark.conf.unset("capaflow.rank.maxGroupRows")
    assert len(scans) == 4 and not any("request_id" in p or "next_step" in p and "priority" in p for p in scans)
    keys = planned.caps.keys(C.STEP_RESIDUAL)
    assert keys.agg(F.sum("n")).first()[0] == planned.sender.split.filter(F.col("next_step") == C.STEP_RESIDUAL).count()


def test_sender_ranks_are_not_measured_on_the_shipments(spark, planned, monkeypatch):
    monkeypatch.setattr(ranking, "largest_group", lambda *a: pytest.fail("measured on the shipments"))
    spark.conf.set("capaflow.rank.maxGroupRows", "30")
    try:
        assert planned.sender.split.count() == 40
    finally:
        spark.conf.unset("capaflow.rank.maxGroupRows")
    assert (planned.sender.bound, planned.sender.group_bound) == (40, 20)


def test_a_sort_is_dealt_by_rows(spark):
    df = spark.range(40).selectExpr("id % 20 k", "id v")
    spark.conf.set("capaflow.rank.taskRows", "2")
    try:
        assert ranking.dealt(df, ["k"], 40).rdd.getNumPartitions() == max(20, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.unset("capaflow.rank.taskRows")


def test_used_capacity_reads_the_rows_once(planned, monkeypatch):
    rows, seen = planned.caps.driver, []
    monkeypatch.setattr(A, "stage_table", lambda df, *a, f=A.stage_table: seen.append(plan_of(df)) or f(df, *a))
    used = A.used_capacity(rows)
    assert len(seen) == 1 and seen[0].count("Scan parquet") == 1 and "prov_pos" not in plan_of(used)
    want = {}
    for r in rows.collect():
        for geo, counts in ((r.province, (r.prov_residual or 0) > 0), (r.cap, r.accepted)):
            if counts:
                key = (r.unified_delivery_driver, geo, r.delivery_week)
                want[key] = want.get(key, 0) + r.accepted
    assert {(r.unified_delivery_driver, r.geo_key, r.delivery_week): r.used_capacity for r in used.collect()} == want
