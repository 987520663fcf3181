import re
import zlib

import numpy as np
import pyarrow as pa

from capaflow.llm import common as C
from capaflow.llm import quality_classifier as Q
from capaflow.llm.catalog import op6_quality
from capaflow.llm.common import utf8_buffers


def corpus(spark, n=800):
    rng, rows = np.random.default_rng(4), []
    for i in range(n):
        good = i % 4 != 0
        words = ["".join(rng.choice(list("aeioubcdlmnrst"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(3, 60)))]
        kind = i // 4 % 3
        if not good:
            words = [w + "%%%" for w in words] if kind == 0 else [w for w in words[:9] for _ in range(6)] if kind == 1 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_accuracy(spark, folder):
    docs = corpus(spark)
    path = folder(documents=docs.select("doc_id", "text"), labels=docs.select("doc_id", "quality").where("doc_id % 3 > 0 or quality = 0"))
    rows = op6_quality(spark, path).collect()
    truth = {r.doc_id: r.quality for r in docs.collect()}
    assert len(rows) == 800 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_quality_told_by_the_order_of_words():
    """Same words, shapes and 4-byte pieces in both classes; only which word follows which differs."""
    rng, words = np.random.default_rng(6), [f"abc{c}xyz" for c in "ghkmnpqr"]
    texts, labels = [], np.arange(240) % 2
    for good in labels:
        at, step = int(rng.integers(8)), 1 if good else -1
        texts.append(" ".join(words[(at + step * k) % 8] for k in range(int(rng.integers(10, 30)))))
    sets, off = Q.feature_sets(*utf8_buffers(pa.array(texts)))
    model = Q.fit(np.split(sets, off[1:-1])[:160], labels[:160])
    assert np.array_equal(model.scores(sets, off)[160:] >= 0.5, labels[160:] == 1)


def test_feature_sets_are_per_text():
    texts = ["Some words. Some words!", "", "é", "Some words. Some words!", "abc", "abcd abcd"]
    data, off = utf8_buffers(pa.array(texts))
    sets, ends = Q.feature_sets(data, off)
    parts = np.split(sets, ends[1:-1])
    for t, got in zip(texts, parts, strict=True):
        d, o = utf8_buffers(pa.array([t]))
        assert np.array_equal(got, Q.feature_sets(d, o)[0])
        assert np.array_equal(got, np.unique(got))
    assert len(parts[1]) == 0 and len(parts[4]) and len(parts[5]) > len(parts[4])


def test_dual_coordinate_descent_finds_the_optimum():
    """Primal and dual values meet."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows, values, cost = [np.arange(5)] * 60, list(x), np.full(60, 0.5)
    w = Q.dual_coordinate_descent(rows, values, y, cost, 5, epochs=3000, tolerance=1e-9)
    margin = y * (x @ w[:-1] + w[-1])
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - margin)).sum()
    for _ in range(300):  # no small step improves it
        v = w + rng.normal(size=6) * 1e-3
        assert 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))).sum() >= primal - 1e-7


def test_odd_rows(spark, odd, empty, folder):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (1, 0, 1), (99, 1, 0), (None, 1, 0), (7, None, 1), (8, 7, 0), (9, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = op6_quality(spark, folder(documents=odd, labels=labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    rows = op6_quality(spark, folder(documents=odd, labels=labels.where("false"))).collect()
    assert {r.score for r in rows} == {0.5}
    assert op6_quality(spark, folder(documents=empty, labels=labels)).count() == 0


ALL = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def slow_features(text):
    """Buckets of a text's features, one word and one byte at a time."""
    data = (text or "").encode()
    kind = [0 if b < 0x21 or b == 0x7F else 2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 or b > 127 else 3 if 48 <= b <= 57 else 4 for b in data]
    words, shapes = [], []
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", data):
        a, e = m.span()
        h = sum(int(C._BYTE_VALUE[b]) * pow(0x2545F4914F6CDD1D, k, 1 << 64) for k, b in enumerate(m[0].lower())) & ALL
        h = mixed(h + len(m[0]) * 0x9E3779B97F4A7C15 & ALL)
        shape = kind[a]
        for k in (1, 2):
            shape = shape * 8 + kind[min(a + k, e - 1)]
        for k in (1, 2):
            place = max(e - k, a)
            shape = shape * 256 + (data[place] if kind[place] >= 3 else 0)
        shapes.append(mixed(shape * 4 + (bool(words) and words[-1] == h) + 1))
        words.append(h)
    found = set()
    for of, seed in ((shapes, 53), (words, 59)):
        factors = [int(f) for f in C.random_words(3, seed)]
        for n in (1, 2, 3):
            for k in range(len(of) - n + 1):
                found.add((n + sum(of[k + j] * factors[j] for j in range(n))) & ALL)
    for k in range(len(data) - 3):
        found.add(int.from_bytes(data[k:k + 4]) + (1 << 40))
    return sorted({(h * 0x9E3779B97F4A7C15 & ALL) >> 46 for h in found})


def test_query_against_a_slow_scorer(spark, folder):
    """Every row's score, from features made one at a time and the model's weights."""
    docs = corpus(spark, 240)
    odd = [(900, None), (901, ""), (902, " \t"), (903, "Éa größe \U0001f600 a a a!?"), (904, "\x7f ~~ A1 zz.")]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    labels = docs.select("doc_id", "quality")
    got = {r.doc_id: r for r in op6_quality(spark, folder(documents=every.repartition(3), labels=labels)).collect()}
    learnt = [(r.doc_id, r.text, r.quality) for r in docs.orderBy("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = Q.fit([np.array(slow_features(t)) for _, t, _ in learnt], np.array([y for *_, y in learnt]))
    assert len(got) == every.count()
    for r in every.collect():
        on = slow_features(r.text)
        length = sum(model.ratios[b] ** 2 for b in on) ** 0.5
        margin = (sum(model.weights[b] for b in on) / length if length else 0.0) + model.intercept
        score = 1 / (1 + np.exp(-(model.slope * margin + model.offset)))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == (score >= 0.7)
