"""Versioned capacity lookups (as-of + validity interval joins).

A capacity row is valid at instant ``t`` when ``activation_from <= t`` and
(``activation_to`` is missing or ``activation_to >= t``); among valid rows
the newest ``activation_from`` wins. Instants are compared as ISO strings,
exactly as they are stored. The strict flavour (``from < t`` and
``to > t``) serves the declared-capacity lookup.

Every lookup is an equi-join on the capacity key followed by ``max_by`` per
requested key -- a hash aggregate with partial (map-side) aggregation, so a
key with many versions never gathers its rows in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capaflow.config import TS_FORMAT


def week_instant(week: Column) -> Column:
    """Start of the delivery week as the stored ISO string."""
    return F.date_format(week.cast("timestamp"), TS_FORMAT)


def valid_at(t: Column, inclusive: bool = True) -> Column:
    frm, to = F.col("activation_from"), F.col("activation_to")
    to_missing = to.isNull() | (to == "")
    if inclusive:
        return (frm <= t) & (to_missing | (to >= t))
    return (frm < t) & (to_missing | (to > t))


def capacity_in_force(needs: DataFrame, capacity: DataFrame, inclusive: bool = True,
                      week_col: str = "delivery_week") -> DataFrame:
    """JOIN-01: declared capacity per need (tender, driver, geo_key, week); 0 if none.

    ``needs`` carries ``tender_id, unified_delivery_driver, geo_key`` and the
    week column; result adds ``declared_capacity``.
    """
    keys = ["tender_id", "unified_delivery_driver", "geo_key"]
    distinct_needs = needs.select(*keys, week_col).distinct()
    cap = capacity.select(*[F.col(k).alias(f"_c_{k}") for k in keys],
                          "activation_from", "activation_to", "capacity")
    # one left join carrying the validity interval, one aggregate per need
    cond = valid_at(week_instant(F.col(week_col)), inclusive)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_c_{k}"))
    return (distinct_needs.join(cap, cond, "left")
                          .groupBy(*keys, week_col)
                          .agg(F.coalesce(F.max_by("capacity", "activation_from"), F.lit(0))
                                .alias("declared_capacity")))


def drivers_on_province(province_weeks: DataFrame, capacity: DataFrame,
                        inclusive: bool = True, week_col: str = "delivery_week") -> DataFrame:
    """JOIN-02 / JOIN-03: newest valid province-level capacity row per driver.

    ``province_weeks``: ``tender_id, province, <week_col>``. Returns one row
    per (tender, province, week, driver) with capacity and product list.
    """
    pw = province_weeks.select("tender_id", "province", week_col).distinct()
    cap = (capacity.filter(F.col("geo_key") == F.col("province"))
                   .select("tender_id", "province", "unified_delivery_driver",
                           "activation_from", "activation_to", "capacity", "products"))
    valid = (pw.join(cap, ["tender_id", "province"])
               .filter(valid_at(week_instant(F.col(week_col)), inclusive)))
    latest = (valid.groupBy("tender_id", "province", week_col, "unified_delivery_driver")
                   .agg(F.max_by(F.struct("capacity", "products", "activation_from"),
                                 "activation_from").alias("v")))
    return latest.select("tender_id", "province", week_col, "unified_delivery_driver",
                         F.col("v.capacity").alias("capacity"),
                         F.col("v.products").alias("products"),
                         F.col("v.activation_from").alias("activation_from"))


def declared_and_used(needs: DataFrame, capacity: DataFrame, used: DataFrame | None,
                      week_col: str = "delivery_week") -> DataFrame:
    """JOIN-04: (declared, used) per need.

    The used-capacity row of (driver, geo_key, week) wins when present -- its
    declared value is the snapshot taken when the week was first planned;
    otherwise the capacity in force with used 0.
    """
    in_force = capacity_in_force(needs, capacity, week_col=week_col)
    if used is None:
        return in_force.withColumn("used_capacity", F.lit(0))
    u = used.select("unified_delivery_driver", "geo_key",
                    F.col("delivery_week").alias(week_col),
                    F.col("declared_capacity").alias("_snap_declared"),
                    F.col("used_capacity").alias("_snap_used"))
    out = in_force.join(u, ["unified_delivery_driver", "geo_key", week_col], "left")
    present = F.col("_snap_used").isNotNull()
    return (out.withColumn("declared_capacity",
                           F.when(present, F.col("_snap_declared")).otherwise(F.col("declared_capacity")))
               .withColumn("used_capacity",
                           F.when(present, F.col("_snap_used")).otherwise(F.lit(0)))
               .drop("_snap_declared", "_snap_used"))


def print_capacity_in_force(weeks: DataFrame, config: DataFrame, inclusive: bool = True,
                            week_col: str = "delivery_week") -> DataFrame:
    """ALC-08: daily print capacity in force for each week.

    Newest ``start_date`` on/before the week (``inclusive``) or strictly
    before it; a week without any configured capacity is an error.
    ``config`` is the small, configuration-sized print capacity list.
    """
    w = weeks.select(week_col).distinct()
    cond = (F.col("start_date") <= F.col(week_col)) if inclusive else \
        (F.col("start_date") < F.col(week_col))
    hits = (w.join(F.broadcast(config), cond)
             .groupBy(week_col)
             .agg(F.max_by(F.struct("daily_capacity", "executions_per_day"), "start_date").alias("v")))
    out = w.join(hits, week_col, "left")
    missing = F.col("v").isNull()
    return out.select(
        week_col,
        F.when(missing, F.raise_error(F.concat(F.lit("no print capacity for week "),
                                               F.col(week_col).cast("string"))))
         .otherwise(F.col("v.daily_capacity")).cast("int").alias("daily_print_capacity"),
        F.col("v.executions_per_day").alias("executions_per_day"))
