import numpy as np
import pytest

from capaflow.llm import pstable_dedup as P


def brute(ids, vectors, cosine=0.9):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) for v in vectors]
    n, links, parent = len(ids), [0] * len(ids), list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and ids[i] is not None and ids[j] is not None and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [(ids[i], links[i], low.get(find(i))) for i in range(n)]


@pytest.mark.parametrize("tile", [256, 4])
def test_same_links_as_all_pairs(spark, tile):
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(12):
        centre = rng.normal(size=24)
        for _ in range(25):
            v = centre + rng.normal(size=24) * rng.choice([0.0, 0.15, 0.3, 0.45])
            vectors.append((v * rng.choice([1, 5])).astype(np.float32).tolist())
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>")
    got = sorted((r.id, r.n_links, r.component_id) for r in P.near_duplicates(df, miss=1e-6, tile=tile).collect())
    assert got == sorted(brute(ids, vectors))


def test_one_id_with_several_vectors(spark):
    """Each row's links and component are those of its own vector; a third of the rows share one id."""
    rng = np.random.default_rng(7)
    rows = [(1, [1.0, 0.0, 0.1]), (1, [0.0, 1.0, 0.1]), (2, [1.0, 0.0, 0.1]), (3, [1.0, 0.1, 0.1]), (4, [0.0, 1.0, 0.0]), (5, [0.1, 1.0, 0.0])]
    rows += [(9 if k % 3 == 0 else 10 + k, (np.eye(3)[k % 3] + rng.normal(size=3) * 0.3).tolist()) for k in range(120)]
    ids, vectors = zip(*rows, strict=True)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.id, r.n_links, r.component_id) for r in P.near_duplicates(df, miss=1e-6, tile=16).collect())
    assert got == sorted(brute(ids, vectors))


def test_recall_at_production_settings(spark):
    """Pairs close to the threshold, with the default probability of a miss."""
    rng, rows = np.random.default_rng(8), []
    for k in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.905 * a + np.sqrt(1 - 0.905**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert P.near_duplicates(df).where("n_links > 0").count() >= 0.99 * 800


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, None), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0),
            (7, [1.0, None, 3.0], 0), (8, [float("nan"), 1.0, 1.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [1.0, 2.0], 0),
            (None, v, 0), (11, [1e38, 2e38, 3e38], 0), (12, [1e-38, 2e-38, 3e-38], 0), (13, [-1.0, -2.0, -3.0], 0)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows],
                               "vec_id long, embedding array<float>, label int, digest string, t int")
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in P.near_duplicates(df).collect()), key=str)
    linked = [(1, 5, 1, True), (2, 5, 1, False), (2, 5, 1, False), (3, 5, 1, False), (11, 5, 1, False), (12, 5, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 13)] + [(None, 0, None, True)]
    assert got == sorted(linked + alone, key=str)
    assert P.near_duplicates(df.where("false")).count() == 0


def test_collision_probability():
    rng = np.random.default_rng(1)
    for d in (0.4, 1.4):
        g, b = rng.normal(size=200_000) * d / 2.0, rng.random(200_000)
        assert abs((np.floor(b) == np.floor(b + g)).mean() - P.collision(d, 2.0)) < 0.01
