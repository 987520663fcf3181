"""Positions: the skew-proof range strategy equals row_number() exactly."""
import random

from pyspark.sql import functions as F

from capaflow.operators.ranking import positions


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot key holds a third of the rows
        key = "HOT" if i % 3 == 0 else f"K{rnd.randint(0, 40)}"
        rows.append((key, rnd.randint(0, 50), f"r{i:06d}"))
    return spark.createDataFrame(rows, "k string, d int, id string")


def test_range_equals_window(spark):
    df = _data(spark)
    w = positions(df, ["k"], ["d", "id"], strategy="window").select("id", F.col("pos").alias("w"))
    r = positions(df, ["k"], ["d", "id"], strategy="range", num_partitions=16) \
        .select("id", F.col("pos").alias("r"))
    j = w.join(r, "id")
    assert j.count() == df.count()
    assert j.filter(F.col("w") != F.col("r")).count() == 0


def test_global_rank_range(spark):
    df = _data(spark, 2000, seed=3)
    r = positions(df, [], ["d", "id"], strategy="range", num_partitions=8)
    got = [row["id"] for row in r.orderBy("pos").collect()]
    exp = [row["id"] for row in df.orderBy("d", "id").collect()]
    assert got == exp
    assert sorted(x["pos"] for x in r.select("pos").collect()) == list(range(1, 2001))


def test_auto_picks_range_for_big_group(spark):
    spark.conf.set("capaflow.rank.maxGroupRows", "100")
    try:
        df = _data(spark, 900, seed=11)
        a = positions(df, ["k"], ["d", "id"]).select("id", F.col("pos").alias("a"))
        w = positions(df, ["k"], ["d", "id"], strategy="window").select("id", F.col("pos").alias("w"))
        assert a.join(w, "id").filter(F.col("a") != F.col("w")).count() == 0
    finally:
        spark.conf.unset("capaflow.rank.maxGroupRows")
