"""File sinks: CSV exports and report outputs.

Outputs go under ``capaflow.output.dir`` when set, else under the session's
reliable checkpoint folder (a shared file system on a cluster) -- never a
machine-local temporary folder. Writes are partitioned, not coalesced to
one file: every task writes its own part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from capaflow.session import ensure_checkpoint_dir
from capaflow.sources.files import delete, files, folders, rename


def output_dir(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("capaflow.output.dir", None)
    if not base:
        base = ensure_checkpoint_dir(spark).rstrip("/") + "/outputs"
    return f"{base}/{name}/{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, sep: str = ",", partition_by: list[str] | None = None) -> str:
    """SRC-08: CSV with a header taken from the columns; overwrite per partition."""
    w = df.write.mode("overwrite").option("header", True).option("sep", sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def write_csv_files(df: DataFrame, base: str, query: str, date: str) -> str:
    """SRC-09: ``<base>/<query>/<date>.csv``, one file for each value of the date column.

    A date's rows are one report (a row per key), written by one task; dates are written in parallel. The files
    take their names once all are written.
    """
    spark = df.sparkSession
    parts, place = f"{base}/_parts/{query}", f"{base}/{query}"
    df.repartition(date).write.mode("overwrite").option("header", True).partitionBy(date).csv(parts)
    for name, folder in folders(spark, parts).items():   # one per date
        for file in files(spark, folder).values():
            rename(spark, file, f"{place}/{name.partition('=')[2]}.csv")
    delete(spark, parts)
    return place


def read_csv_strings(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
