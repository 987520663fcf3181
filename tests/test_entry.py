"""Driver contract: entry() runs on sf0.001; a sample of queries equals its oracle."""
import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "final_step" in df.columns


def test_every_query_of_the_reference_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {x for x in set(q) - set(o) if x != "pipeline" and not x.startswith("op")} == set()


@pytest.mark.parametrize("name", ["weekly_plan", "alc_01", "alc_06", "agg_04", "agg_11", "alc_10",
                                  "rpt_01", "rpt_02", "est_04", "lkp_02", "src_05", "src_10", "est_03",
                                  "str_01", "str_05", "join_11", "join_13", "lkp_01", "mnt_02", "prj_05",
                                  "alc_15", "src_06", "fn_04", "join_09", "agg_09", "src_01"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(ocols)
    def canon(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(str(r[i]) if r[i] is not None else "NULL" for i in order) for r in rows)
    assert canon(df.collect(), df.columns) == canon(res.fetchall(), ocols)
