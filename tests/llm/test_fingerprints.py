import hashlib
import random
import re

from pyspark.sql import functions as F

from capaflow.llm import fingerprints as P
from capaflow.llm.catalog import op4_fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, n=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n=300):
    rng, out, words = random.Random(2), [], []
    for k in range(n):
        if rng.random() < 0.3 or not words:
            words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 4, 5, 6, 30, 110]))]
        elif words:
            words = [*words[:-1], "é\U0001f600"] if rng.random() < 0.5 else words
        out.append((k * 7 % 1013, " ".join(words) + rng.choice(["", "\n", " "])))
    return out


def test_edited_texts_and_exact_likeness(spark, folder):
    """Sets below the sketch's size are compared exactly."""
    rows = sorted(texts())
    got = {r.doc_id: r for r in op4_fingerprints(spark, folder(documents=spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(shingles(t) | shingles(edited)) < 128:
            assert abs(r.near_edited - likeness(shingles(t), shingles(edited))) < 1e-12
        if len(shingles(t) | shingles(after)) < 128:
            assert abs(r.near_next - likeness(shingles(t), shingles(after))) < 1e-12
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_next_document_across_buckets(spark):
    rows = [(i, f"t{i}") for i in range(0, 4000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = {r.id: r.next_text for r in P.with_next(docs, "doc_id", "text", lambda d: d, bucket_rows=20).collect()}
    assert got == {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}


def test_place_among_cuts(spark):
    cuts = [float(c) for c in range(0, 3000, 7)]
    df = spark.range(-5, 3010, 3).withColumn("p", P._place(F.col("id").cast("double"), cuts))
    assert all(r.p == sum(c <= r.id for c in cuts) for r in df.collect())
    assert spark.range(1).select(P._place(F.col("id").cast("double"), [0.0]).alias("p")).first().p == 1


def test_estimates_and_merging(spark):
    rng = random.Random(5)
    a = [f"a{rng.randrange(10**6)}" for _ in range(4000)]
    b = a[:3000] + [f"b{i}" for i in range(1500)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[:2002]), " ".join(a[1998:]))], "a string, b string, p string, q string")
    for c in "abpq":
        df = P.with_sketch(df, c, f"s{c}", k=512)
    s = {c: F.col(f"s{c}") for c in "abpq"}
    r = df.select(P.resemblance(s["a"], s["b"], 512).alias("r"), P.containment(s["a"], s["b"], 512).alias("c"),
                  P.distinct_count(s["a"], 512).alias("n"), (P.merged(s["p"], s["q"], 512) == s["a"]).alias("m")).first()
    assert abs(r.r - likeness(shingles(" ".join(a)), shingles(" ".join(b)))) < 0.08
    assert abs(r.c - 0.75) < 0.1
    assert abs(r.n - 3996) < 3996 * 0.15
    assert r.m
    parts = df.select(F.lit(1).alias("key"), s["p"].alias("s")).union(df.select(F.lit(1), s["q"]))
    assert P.merge_all(parts, ["key"], "s", 512).first().s == df.first().sa


def test_odd_rows(spark, odd, empty, folder):
    rows = op4_fingerprints(spark, folder(documents=odd)).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].fingerprint == "" == by_id[4].fingerprint
    assert by_id[3].near_next == 1.0  # both without words
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert op4_fingerprints(spark, folder(documents=empty)).count() == 0
    alone = op4_fingerprints(spark, folder(documents=odd.where("doc_id = 1"))).collect()
    assert alone[0].near_next == 1.0 and alone[0].n_chars == 43
