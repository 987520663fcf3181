"""Driver assignment and product components of a province.

* JOIN-05/06 -- shipments get their driver from the coverage table
  (cap x product -> driver); a cap x product without a driver is reported.
* AGG-04 -- drivers of a province whose product sets intersect form one
  component: each driver's set is widened by the overlapping sets of its
  province-week until it stops growing (a fixpoint with a bounded number of
  steps), all inside one aggregate expression.
* AGG-05 -- component capacity = sum of driver capacities minus the exempt
  counters of its products, floored at 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


GROUP = ["tender_id", "province", "delivery_week"]


def assign_driver(shipments: DataFrame, coverage: DataFrame) -> DataFrame:
    """JOIN-05: driver per shipment from (tender, cap, product).

    Coverage is one row per (cap, product) of the tender -- a dimension
    that grows with the postal-code list, not with shipments; Spark/AQE picks
    broadcast or shuffle from its measured size.
    """
    cov = coverage.select("tender_id", "cap", "product_type", "unified_delivery_driver")
    return shipments.join(cov, ["tender_id", "cap", "product_type"], "left")


def reject_shared_caps(coverage: DataFrame) -> None:
    """A cap in two provinces would be granted its capacity once in each: refused at load."""
    shared = coverage.groupBy("tender_id", "cap").agg(F.count_distinct("province").alias("n")).filter("n > 1")
    row = shared.first()
    if row is not None:
        raise ValueError(f"cap {row['cap']} of tender {row['tender_id']} lies in several provinces")


def unassigned(shipments: DataFrame, coverage: DataFrame) -> DataFrame:
    """JOIN-06: (tender, cap, product) needed by shipments but without a driver."""
    need = shipments.select("tender_id", "cap", "product_type").distinct()
    cov = coverage.select("tender_id", "cap", "product_type")
    return need.join(cov, ["tender_id", "cap", "product_type"], "left_anti")


def sole_driver_shortcut(assigned: DataFrame, components: DataFrame) -> DataFrame:
    """JOIN-05 shortcut: a province-week with exactly one component of one
    driver sends every shipment to that driver, whatever the coverage says."""
    sole = (components.groupBy(*GROUP)
                      .agg(F.count(F.lit(1)).alias("_ncomp"),
                           F.sum(F.size("drivers")).alias("_ndrv"),
                           F.first(F.element_at("drivers", 1)).alias("_sole"))
                      .filter((F.col("_ncomp") == 1) & (F.col("_ndrv") == 1))
                      .select(*GROUP, "_sole"))
    out = assigned.join(sole, GROUP, "left")
    return (out.withColumn("unified_delivery_driver",
                           F.coalesce(F.col("_sole"), F.col("unified_delivery_driver")))
               .drop("_sole"))


def product_components(drivers: DataFrame) -> DataFrame:
    """AGG-04: group drivers by intersecting product sets.

    ``drivers``: one row per (tender, province, week, driver) with
    ``capacity`` and ``products``. Output: one row per component with
    ``component`` (smallest product), sorted ``products``, ``drivers`` and
    summed ``capacity``.

    The product sets of a province-week (one per driver: a list bounded by
    the drivers of one province) are gathered once; each driver's set is then
    widened by every set that overlaps it, repeated as many times as there
    are sets -- a fixpoint, so the result is the whole connected component.
    Two small shuffles, no iteration on the driver.
    """
    d = drivers.withColumn(
        "_prods", F.when(F.size(F.coalesce("products", F.array())) > 0, F.col("products"))
                   .otherwise(F.array(F.concat(F.lit("#"), F.col("unified_delivery_driver")))))
    sets = d.groupBy(*GROUP).agg(F.collect_list("_prods").alias("_sets"))
    widened = F.aggregate(
        F.sequence(F.lit(1), F.size("_sets")), F.col("_prods"),
        lambda acc, _i: F.array_distinct(F.flatten(F.filter(F.col("_sets"),
                                                            lambda s: F.arrays_overlap(s, acc)))))
    with_comp = d.join(sets, GROUP).withColumn("component", F.array_min(widened))
    return (with_comp.groupBy(*GROUP, "component")
                     .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("products"))))
                           .alias("products"),
                          F.sort_array(F.collect_list("unified_delivery_driver")).alias("drivers"),
                          F.sum("capacity").cast("bigint").alias("capacity")))


def first_counters(counters: DataFrame) -> DataFrame:
    """AGG-06: of counters that share a key the one of the first source (least ``src``) counts."""
    return (counters.groupBy("delivery_week", "province", "product_type")
                    .agg(F.min_by("number_of_shipments", "src").alias("number_of_shipments")))


def net_capacity(components: DataFrame, exempt_counters: DataFrame) -> DataFrame:
    """AGG-05: component capacity minus exempt counters of its products, >= 0.

    ``exempt_counters``: (delivery_week, province, product_type, number_of_shipments), and ``src`` if several
    sources were put together (AGG-06).
    """
    if "src" in exempt_counters.columns:
        exempt_counters = first_counters(exempt_counters)
    counters = exempt_counters.withColumnRenamed("number_of_shipments", "n")
    per_comp = (components.select(*GROUP, "component", F.explode("products").alias("product_type"))
                          .join(counters, ["delivery_week", "province", "product_type"])
                          .groupBy(*GROUP, "component").agg(F.sum("n").alias("_excl")))
    out = components.join(per_comp, [*GROUP, "component"], "left")
    return (out.withColumn("net_capacity",
                           F.greatest(F.lit(0), F.col("capacity") - F.coalesce(F.col("_excl"), F.lit(0)))
                            .cast("bigint"))
               .drop("_excl"))
