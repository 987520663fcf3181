import math

import numpy as np
import pytest

from capaflow.llm import catalog
from capaflow.llm import hard_negatives as H


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    """rows: (id, vector, label)."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], set()
    for a, va, ya in ok:
        if a % every or (a, tuple(va), ya) in asked:
            continue
        asked.add((a, tuple(va), ya))
        scored = sorted((-sum(p * q for p, q in zip(va, v, strict=True)), i, y) for i, v, y in ok if len(v) == len(va))
        for p, who in [(-s, i) for s, i, y in scored if y == ya and i != a][:positives]:
            far = [(-s, i) for s, i, y in scored if y != ya and low * p <= -100 * s <= high * p][:negatives]
            out += [(a, who, r + 1, i, p, s) for r, (s, i) in enumerate(far)]
    return sorted(out)


def run(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


def made(rng, n, dim=12, labels=4):
    centres = rng.normal(size=(labels, dim))
    rows = []
    for i in range(n):
        y = int(rng.integers(labels))
        v = centres[y] * rng.choice([0, 0.5, 1]) + rng.normal(size=dim) * 0.7
        rows.append((i, np.round(v, 2).astype(np.float32).tolist(), y))
    return rows


@pytest.mark.parametrize("block, segment", [(16 << 20, 8192), (9000, 50)])
def test_same_as_scoring_everything(spark, block, segment):
    rows = made(np.random.default_rng(2), 600)
    rows += [(1000 + k, rows[3][1], 1 if k % 2 else 2) for k in range(300)]   # one vector holds a third: ties
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = run(H.hard_negatives(df, "vec_id % 20 = 0", block_bytes=block, segment_rows=segment))
    assert got == brute(rows, 20) and len(got) > 500


def test_odd_rows(spark):
    v = [1.0, -2.0, 0.5]
    rows = [(0, v, 1), (0, v, 1), (0, [0.0, 0.0, 0.0], 1), (100, [], 2), (101, [], 2), (102, [], 3), (200, [0.0, 0.0, 0.0], 1), (3, [0.0, 0.0, 0.0], 4),
            (4, [0.0, 0.0, 0.0], 1), (5, v, 1), (5, v, 1), (6, [0.5, -1.0, 0.25], 2), (6, [0.5, -1.0, 0.25], 2), (7, [0.5, -1.0, 0.2], None),
            (None, v, 2), (8, None, 2), (9, [1.0, None, 2.0], 2), (10, [float("nan")] * 3, 2), (11, [float("-inf"), 1.0, 1.0], 2), (12, [1.0, 2.0], 1),
            (300, [-1.0, 2.0, -0.5], 1), (400, [1000.5, 2.0, 3e4], 5), (13, [1000.0, 2.0, 3e4], 5), (14, [500.0, 2.0, 2e4], 6)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", x string, score int")
    assert run(H.hard_negatives(df, "vec_id % 100 = 0")) == brute(rows)
    assert H.hard_negatives(df.where("false"), "vec_id % 100 = 0").count() == 0


def test_ends_before_all_rows():
    """Correlated components: the threshold ends a search long before all rows are scored, and nothing is missed."""
    rng = np.random.default_rng(5)
    x = np.rint(rng.normal(size=(20_000, 1)) * 300 + rng.normal(size=(20_000, 6)) * 30).astype(np.int64)
    lists, places = H.Lists(x, np.arange(20_000), np.zeros(20_000, np.int64)), H.Places(10)
    anchor = np.array([3, 2, 5, 1, 0, 4])
    scored = lists.search(anchor, places.beyond, lambda rows, s: places.add(s, rows))
    assert list(zip(-places.score, places.ids)) == sorted((-s, i) for i, s in enumerate((x @ anchor).tolist()))[:10]
    assert scored < 5_000


def test_query(spark, folder):
    rows = made(np.random.default_rng(9), 400, 8, 10)
    path = folder(embeddings=spark.createDataFrame(rows, SCHEMA))
    moved = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    assert run(catalog.op13_hard_negatives(spark, path)) == brute(moved)
