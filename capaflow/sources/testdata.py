"""Domain views over the driver-provided test tables.

The planner's own tables (ledger, versioned driver capacity, sender
estimates, driver coverage) do not exist in the test data; they are derived
here from the TPC-H-like tables with plain arithmetic, so every query's work
grows with ``lineitem``. The same definitions are written in DuckDB SQL in
``oracle/sql.py``.

Mapping (one shipment per lineitem):

* request_id   ``orderkey-linenumber-partkey-suppkey-cents`` (unique)
* product_type ``l_returnflag`` A->AR, N->890, R->RS
* attempt      1 on line number 7, else 0
* province     nation name of the order's customer, region its region name
* cap          2-digit nation key + 3-digit ``l_partkey % 5``
* sender       ``PA`` + 2-digit ``o_custkey % 20``
* prepare_request_date / notification_sent_at  order date / ship date
* delivery_week Monday on or before the quarter start of the ship date
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capaflow import config as C

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

TENDER_ID = "TENDER_1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso_ts(col: Column) -> Column:
    """Timestamp/date -> ISO-8601 string with milliseconds and ``Z``."""
    return F.date_format(col, C.TS_FORMAT)


def quarter_week(col: Column) -> Column:
    return F.date_trunc("week", F.date_trunc("quarter", col)).cast("date")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested shipments, one per lineitem, as ledger-ready columns."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # orders meet their customers first, as numbers: a line item is sent through one exchange at most, and names join last
    placed = (o.join(c, o.o_custkey == c.c_custkey)
               .select("o_orderkey", "o_custkey", "o_orderdate", "c_nationkey"))
    df = (li.join(placed, li.l_orderkey == placed.o_orderkey)
            .join(n, placed.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return df.select(
        F.concat_ws("-", *[F.col(x).cast("string") for x in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                    cents.cast("string")).alias("request_id"),
        F.concat(F.lit("IUN-"), F.col("l_orderkey").cast("string")).alias("iun"),
        F.concat(F.lit("REC-"), F.col("o_custkey").cast("string")).alias("recipient_id"),
        F.when(F.col("l_returnflag") == "A", "AR")
         .when(F.col("l_returnflag") == "N", "890").otherwise("RS").alias("product_type"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(0).cast("int").alias("attempt"),
        F.concat(F.lit("PA"), F.lpad((F.col("o_custkey") % 20).cast("string"), 2, "0"))
         .alias("sender_pa_id"),
        F.col("n_name").alias("province"),
        F.col("r_name").alias("region"),
        F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
                 F.lpad((F.col("l_partkey") % 5).cast("string"), 3, "0")).alias("cap"),
        iso_ts(F.col("l_shipdate")).alias("notification_sent_at"),
        iso_ts(F.col("o_orderdate")).alias("prepare_request_date"),
        quarter_week(F.col("l_shipdate")).alias("delivery_week"),
        F.lit(TENDER_ID).alias("tender_id"),
    )


def driver_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tender, cap, product) -> driver, the answer of the coverage service.

    Per province (nation key n, cap suffix k):
    n % 3 == 0: one driver for everything; n % 3 == 1: AR/RS to one driver,
    890 to another; n % 3 == 2: caps k <= 2 to one driver for all products,
    caps k >= 3 split AR / (890, RS) between two more drivers. Nobody
    delivers RS to cap 4 of nation 23: its shipments have no driver.
    """
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df = (n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
           .withColumn("product_type", F.explode(F.array(*[F.lit(p) for p in ("AR", "890", "RS")]))))
    nk, k, p = F.col("n_nationkey"), F.col("k"), F.col("product_type")
    off = (F.when(nk % 3 == 0, 0)
            .when(nk % 3 == 1, F.when(p == "890", 1).otherwise(0))
            .otherwise(F.when(k <= 2, 0).when(p == "AR", 1).otherwise(2)))
    return df.filter(~((nk == 23) & (k == 4) & (p == "RS"))).select(
        F.lit(TENDER_ID).alias("tender_id"),
        F.concat(F.lpad(nk.cast("string"), 2, "0"), F.lpad(k.cast("string"), 3, "0")).alias("cap"),
        p.alias("product_type"),
        F.col("n_name").alias("province"),
        nk.alias("nation_key"),
        F.concat(F.lit("DRV_"), F.chr(F.lit(65) + (nk + off) % 4)).alias("unified_delivery_driver"),
    )


def volumes(shp: DataFrame) -> DataFrame:
    """Shipments per (tender, cap, province, product, sender, week): what the planner's other inputs are derived from."""
    return (shp.groupBy("tender_id", "cap", "province", "product_type", "sender_pa_id", "delivery_week")
               .agg(F.count(F.lit(1)).alias("n")))


def _weekly_counts(vol: DataFrame, cov: DataFrame) -> DataFrame:
    """Shipments per (cap, province, driver, week): coverage is a per-cap dimension, rolled up by both levels."""
    per_product = vol.groupBy("cap", "province", "product_type", "delivery_week").agg(F.sum("n").alias("n"))
    return (per_product.join(cov.select("cap", "product_type", "unified_delivery_driver"),
                             ["cap", "product_type"])
                       .groupBy("cap", "province", "unified_delivery_driver", "delivery_week")
                       .agg(F.sum("n").alias("n")))


def _avg_weekly(per_week: DataFrame, keys: list[str]) -> DataFrame:
    """Average weekly volume of a key over the weeks in which it had shipments."""
    wk = per_week.groupBy(*keys, "delivery_week").agg(F.sum("n").alias("n"))
    return wk.groupBy(*keys).agg((F.sum("n") / F.count(F.lit(1))).cast("bigint").alias("base"))


def driver_capacity(spark: SparkSession, sf_dir: str, vol: DataFrame | None = None,
                    cov: DataFrame | None = None) -> DataFrame:
    """Versioned declared capacity per (tender, driver, geo_key).

    Capacity is a fraction of the average weekly volume of the key, with
    overlapping, expired, open-ended and zero versions.
    """
    vol = vol if vol is not None else volumes(shipments(spark, sf_dir))
    cov = cov if cov is not None else driver_coverage(spark, sf_dir)
    prov_products = (cov.groupBy("province", "unified_delivery_driver")
                        .agg(F.sort_array(F.collect_set("product_type")).alias("products"),
                             F.first("nation_key").alias("nation_key")))
    per_week = _weekly_counts(vol, cov)
    prov = (_avg_weekly(per_week, ["province", "unified_delivery_driver"])
            .join(prov_products, ["province", "unified_delivery_driver"]))
    nk = F.col("nation_key")
    b = F.col("base")
    prov_versions = F.array(
        F.struct(F.lit("1990-01-01T00:00:00.000Z").alias("f"),
                 F.lit("1998-06-30T23:59:59.999Z").alias("t"), ((b * 9) / 10).cast("bigint").alias("c")),
        F.struct(F.lit("1997-01-01T00:00:00.000Z").alias("f"),
                 F.lit(None).cast("string").alias("t"), ((b * 11) / 10).cast("bigint").alias("c")),
        F.struct(F.lit("1999-01-01T00:00:00.000Z").alias("f"),
                 F.lit("1999-12-31T23:59:59.999Z").alias("t"),
                 F.when(nk % 5 == 0, F.lit(0).cast("bigint"))
                  .otherwise(((b * 7) / 10).cast("bigint")).alias("c")),
    )
    prov_rows = (prov.select("province", "unified_delivery_driver", "products", "nation_key",
                             F.explode(prov_versions).alias("v"))
                     .select(F.lit(TENDER_ID).alias("tender_id"), "unified_delivery_driver",
                             F.col("province").alias("geo_key"), F.lit("PROVINCE").alias("geo_level"),
                             "province", F.col("v.f").alias("activation_from"),
                             F.col("v.t").alias("activation_to"),
                             F.col("v.c").cast("int").alias("capacity"), "products"))
    capk = F.substring(F.col("cap"), 3, 3).cast("int")
    cap = (_avg_weekly(per_week, ["cap", "unified_delivery_driver"])
           .join(cov.select("cap", "province").distinct(), "cap"))
    cap_versions = F.array(
        F.struct(F.lit("1990-01-01T00:00:00.000Z").alias("f"), F.lit(None).cast("string").alias("t"),
                 ((b * (capk + 8)) / 10).cast("bigint").alias("c")),
        F.struct(F.lit("2000-01-01T00:00:00.000Z").alias("f"), F.lit("2000-12-31T23:59:59.999Z").alias("t"),
                 ((b * (capk + 5)) / 10).cast("bigint").alias("c")),
    )
    cap_rows = (cap.select("cap", "province", "unified_delivery_driver",
                           F.explode(cap_versions).alias("v"))
                   .select(F.lit(TENDER_ID).alias("tender_id"), "unified_delivery_driver",
                           F.col("cap").alias("geo_key"), F.lit("CAP").alias("geo_level"),
                           "province", F.col("v.f").alias("activation_from"),
                           F.col("v.t").alias("activation_to"),
                           F.col("v.c").cast("int").alias("capacity"),
                           F.lit(None).cast("array<string>").alias("products")))
    return prov_rows.unionByName(cap_rows)


def sender_estimates(spark: SparkSession, sf_dir: str, vol: DataFrame | None = None) -> DataFrame:
    """Weekly estimates per (pa, product, province, delivery_date).

    The estimate for the next quarter's week is 80 % of this quarter's
    volume of the sender (AR and 890 only); ``delivery_date`` is the
    shipment date the planner reads, i.e. that week minus 7 days.
    """
    v = vol if vol is not None else volumes(shipments(spark, sf_dir))
    counts = (v.filter(F.col("product_type").isin(*C.ESTIMATED_PRODUCTS))
               .groupBy("sender_pa_id", "product_type", "province", "delivery_week")
               .agg(F.sum("n").alias("n")))
    next_week = F.date_trunc("week", F.add_months(F.col("delivery_week"), 3)).cast("date")
    dd = F.date_sub(next_week, 7)
    return counts.select(
        F.col("sender_pa_id").alias("pa_id"), "product_type", "province",
        dd.alias("delivery_date"),
        ((F.col("n") * 4) / 5).cast("bigint").cast("int").alias("weekly_estimate"),
        (((F.col("n") * 4) / 5).cast("bigint") * 4).cast("double").alias("monthly_estimate"),
        F.col("n").cast("int").alias("original_estimate"),
        F.concat(F.date_format(dd, "yyyy-MM-dd"), F.lit("T00:00:00.000Z")).alias("last_update"),
        F.concat(F.lit("orders/"), F.col("sender_pa_id"), F.lit("/"),
                 F.date_format(dd, "yyyy-MM-dd"), F.lit(".json")).alias("file_key"),
    )


def print_capacity_config(spark: SparkSession, sf_dir: str, vol: DataFrame | None = None) -> DataFrame:
    """Print capacity versions (start_date, daily capacity, executions/day).

    Daily capacity is set from the volume so the weekly limit binds at every
    scale: one twelfth, then (from 1998) one ninth of the average week.
    """
    v = vol if vol is not None else volumes(shipments(spark, sf_dir))
    wk = v.groupBy("delivery_week").agg(F.sum("n").alias("n"))
    avg = wk.agg((F.sum("n") / F.count(F.lit(1))).cast("bigint").alias("avg_week"))
    versions = F.array(
        F.struct(F.lit("1970-01-01").cast("date").alias("start_date"),
                 (F.col("avg_week") / 12).cast("bigint").cast("int").alias("daily_capacity")),
        F.struct(F.lit("1998-01-01").cast("date").alias("start_date"),
                 (F.col("avg_week") / 9).cast("bigint").cast("int").alias("daily_capacity")),
    )
    return (avg.select(F.explode(versions).alias("v"))
               .select("v.start_date", "v.daily_capacity",
                       F.lit(C.PRINT_EXECUTIONS_PER_DAY).alias("executions_per_day")))


def priority_map(spark: SparkSession) -> DataFrame:
    """Exploded priority map: (priority, key=PRODUCT_<p>.ATTEMPT_<a>)."""
    rows = [(p, k) for p, keys in sorted(C.PRIORITY_MAP.items()) for k in keys]
    return spark.createDataFrame(rows, "priority int, priority_key string")
