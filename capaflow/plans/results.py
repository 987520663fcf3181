"""Memoised step results of the weekly plan for one session and input folder.

Queries that expose one operator of the chain (sender split, driver step,
print release, ...) share the same planned steps instead of replanning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capaflow.operators.ledger import ledger_history
from capaflow.plans import reports as R
from capaflow.plans import weekly as W

_CACHE: dict = {}


@dataclass
class PlanResults:
    """The round's steps; a query runs those that its result needs."""
    inputs: W.Inputs | W.LoadedInputs
    sender: W.SenderStep
    caps: W.CapacitySteps

    @cached_property
    def released(self) -> DataFrame:
        return W.print_step(self.caps.driver, self.caps.residual, self.inputs.print_config, self.sender.bound)

    @cached_property
    def ledger(self) -> DataFrame:
        """All ledger rows of the round, over the staged steps: a reader takes the steps and columns that it asks for."""
        return ledger_history(self.inputs.shipments, self.sender.split, self.caps.driver, self.caps.residual, self.released)

    @cached_property
    def weekly_caps(self) -> DataFrame:
        """Used capacity as last written, staged when first asked for."""
        return W.small(R.weekly_capacities(R.used_capacity_images(self.caps.used_after_driver, self.caps.used_after_residual)))


def session_key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Key of per-session state: the application's id, which no later one has, and the input folder."""
    return spark.sparkContext.applicationId, sf_dir


def plan_results(spark: SparkSession, sf_dir: str) -> PlanResults:
    key = session_key(spark, sf_dir)
    if key not in _CACHE:
        inp = W.load_inputs(spark, sf_dir)
        snd = W.sender_step(inp)
        _CACHE[key] = PlanResults(inp, snd, W.CapacitySteps(snd))
    return _CACHE[key]


def normalize(df: DataFrame) -> DataFrame:
    """Output convention shared with the SQL oracle: integers as bigint,
    dates as ``yyyy-MM-dd`` strings, arrays as comma-joined strings."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws(",", c.cast("array<string>"))
        cols.append(c.alias(f.name))
    return df.select(*cols)
