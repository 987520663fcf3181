"""Summarise the physical plan of registered queries (operator counts).

Usage: python tools/plans.py [sf_dir] [name ...]  -> markdown table on stdout.
The plan is the one Spark would run (AQE may still re-plan at run time).
"""
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from capaflow.catalog import all_queries  # noqa: E402
from capaflow.session import build_session  # noqa: E402

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
       "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
       "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "HashAggregate", "ObjectHashAggregate",
       "ArrowEvalPython", "BatchEvalPython", "Scan"]


def summary(plan: str) -> dict:
    c = Counter()
    for op in OPS:
        c[op] = len(re.findall(re.escape(op) + r"\b", plan))
    return c


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session()
    qs = all_queries()
    cols = [o for o in OPS]
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name in names or sorted(qs):
        plan = qs[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        s = summary(plan)
        print(f"| {name} | " + " | ".join(str(s[o]) for o in cols) + " |")


if __name__ == "__main__":
    main()
