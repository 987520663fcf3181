import re

import numpy as np
from pyspark.sql import functions as F

from capaflow.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by repeated resharing, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def documents(spark, n=3000):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), None if i % 11 == 0 else f"s{int(rng.integers(0, 6)) if i % 3 else 0}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def check(rows, slack=1.0):
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    expected = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - expected[r.source]) <= 1e-9 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= largest[s] * slack + 1e-6
    return taken


def test_targets_and_sums(spark):
    docs = documents(spark)
    rows = M.mix(docs, keep=("doc_id", "source"), block_rows=64, fan_in=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    words = {r.doc_id: len(WORD.findall(r.text)) for r in docs.collect()}
    assert all(r.size == words[r.doc_id] for r in rows)
    check(rows)


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = documents(spark, 1200)
    a = {(r.doc_id, r.taken) for r in M.mix(docs, block_rows=50, fan_in=3).collect()}
    b = {(r.doc_id, r.taken) for r in M.mix(docs.repartition(7, "text").orderBy(F.desc("doc_id")), block_rows=50, fan_in=3).collect()}
    assert a == b


def test_meeting_keeps_words_and_expectation():
    size = np.array([5, 9, 2, 30, 4, 4, 7, 1], dtype=np.int64)
    start = np.array([0.3, 0.5, 0.25, 0.9, 0.1, 0.6, 0.5, 0.85])
    total, mean = float(size @ start), np.zeros(8)
    for seed in range(4000):
        mark = np.random.default_rng(seed).integers(-2**63, 2**63 - 1, 8)
        p, left = M._meet(size, start.copy(), mark)
        assert abs(float(size @ p) - total) < 1e-9
        assert sum(0 < x < 1 for x in p) == (left >= 0)
        mean += p
    assert np.abs(mean / 4000 - start).max() < 0.04


def test_odd_rows(odd, empty):
    rows = M.mix(odd, keep=("doc_id", "source")).collect()
    assert len(rows) == odd.count()
    check(rows)
    assert M.mix(empty).count() == 0
    assert M.mix(odd.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0
    mixed = M.repeated(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in rows)
    one = M.mix(odd.withColumn("source", F.lit("a")), keep=("doc_id", "source")).collect()
    check(one)
