"""Driver capacity allocation: the two-rank formula against the paged loop.

The simulator below is the test oracle: it pages through a (driver,
province) queue in order with page size min(residual, page limit), keeps
per cap the first rows that fit the cap residual, and stops when the
province residual is used up -- as the planner's loop does.
"""
import random

from pyspark.sql import functions as F

from capaflow import config as C
from capaflow.operators.allocate import allocate


def simulate(rows, cap_decl, prov_decl, page_limit):
    used_cap = {c: 0 for c in cap_decl}
    accepted = set()
    residual = prov_decl
    i = 0
    if residual <= 0:
        return accepted
    while i < len(rows) and residual > 0:
        page = rows[i:i + min(residual, page_limit)]
        i += len(page)
        sent = 0
        for req, cap in page:
            if used_cap[cap] < cap_decl[cap]:
                used_cap[cap] += 1
                accepted.add(req)
                sent += 1
        residual -= sent
    return accepted


def _case(spark, seed):
    rnd = random.Random(seed)
    caps = [f"0000{k}" for k in range(rnd.randint(1, 4))]
    cap_decl = {c: rnd.randint(0, 12) for c in caps}
    prov_decl = rnd.randint(0, 30)
    n = rnd.randint(1, 40)
    rows = [(f"R{seed:03d}-{i:03d}", rnd.choice(caps), rnd.randint(1, 3), f"2024-01-{rnd.randint(1, 9):02d}")
            for i in range(n)]
    ordered = sorted(rows, key=lambda r: (str(r[2]), r[3], r[0]))
    exp = simulate([(r[0], r[1]) for r in ordered], cap_decl, prov_decl, rnd.randint(1, 7))
    return rows, cap_decl, prov_decl, exp


def test_two_rank_equals_paged_loop(spark):
    all_rows, cap_rows, expected = [], [], set()
    for seed in range(60):
        rows, cap_decl, prov_decl, exp = _case(spark, seed)
        prov = f"P{seed}"
        all_rows += [(r[0], prov, r[1], r[2], r[3]) for r in rows]
        cap_rows += [("T", "D1", prov, prov, "PROVINCE", "1990-01-01T00:00:00.000Z", None, prov_decl)]
        cap_rows += [("T", "D1", c, prov, "CAP", "1990-01-01T00:00:00.000Z", None, v) for c, v in cap_decl.items()]
        expected |= exp
    df = (spark.createDataFrame(all_rows, "request_id string, province string, cap string, priority int, d string")
          .withColumn("cap", F.concat(F.col("province"), F.lit("-"), F.col("cap")))
          .withColumn("tender_id", F.lit("T")).withColumn("unified_delivery_driver", F.lit("D1"))
          .withColumn("delivery_week", F.lit("2024-01-15").cast("date"))
          .withColumn("product_type", F.lit("AR")).withColumn("attempt", F.lit(0))
          .withColumn("notification_sent_at", F.col("d")).withColumn("prepare_request_date", F.col("d")))
    cap = (spark.createDataFrame(cap_rows, "tender_id string, unified_delivery_driver string, geo_key string, "
                                           "province string, geo_level string, activation_from string, "
                                           "activation_to string, capacity int")
           .withColumn("geo_key", F.when(F.col("geo_level") == "CAP",
                                         F.concat(F.col("province"), F.lit("-"), F.col("geo_key")))
                       .otherwise(F.col("geo_key"))))
    got = {r["request_id"] for r in allocate(df, cap, C.STEP_DRIVER).filter("accepted").collect()}
    assert got == expected


def test_no_province_capacity_sends_all_to_next_week(spark):
    rows = [("A", "P", "P-1", 1, "2024-01-01"), ("B", "P", "P-1", 1, "2024-01-02")]
    df = (spark.createDataFrame(rows, "request_id string, province string, cap string, priority int, d string")
          .withColumn("tender_id", F.lit("T")).withColumn("unified_delivery_driver", F.lit("D1"))
          .withColumn("delivery_week", F.lit("2024-01-15").cast("date"))
          .withColumn("product_type", F.lit("AR")).withColumn("attempt", F.lit(0))
          .withColumn("notification_sent_at", F.col("d")).withColumn("prepare_request_date", F.col("d")))
    cap = spark.createDataFrame([("T", "D1", "P-1", "P", "CAP", "1990-01-01T00:00:00.000Z", None, 5)],
                                "tender_id string, unified_delivery_driver string, geo_key string, province string, "
                                "geo_level string, activation_from string, activation_to string, capacity int")
    out = allocate(df, cap, C.STEP_DRIVER)
    assert out.filter("accepted").count() == 0
