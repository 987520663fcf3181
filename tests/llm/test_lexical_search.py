import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from capaflow.llm import catalog
from capaflow.llm import lexical_search as L

TERM = re.compile(L.TERM_PATTERN)


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms_of(t))]
    n, words = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, size in held:
            m = 100 - 75 + (75 * size * n) // words
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=str)


def run(df, **kw):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


@pytest.mark.parametrize("block_terms, segment", [(200_000, 1 << 20), (40, 60)])
def test_same_as_scoring_everything(spark, block_terms, segment):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Éa", "ß", "日本"]
    p = 1 / np.arange(1, len(words) + 1)

    def text(n):
        return " ".join(rng.choice(words, n, p=p / p.sum()))

    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(120)]          # a third are copies: ties
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(25)]
    got = L.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"),
                   block_terms=block_terms, segment_postings=segment)
    assert run(got) == brute(docs, items)


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "the FOX fox"), (1, "the FOX fox"), (1, "word1 of1"), (2, None), (3, ""), (4, "nowhere"), (None, "größe 日本語, one"), (5, "12 34")]
    asked = spark.createDataFrame([(*x, "s", 1) for x in items], "item_id long, text string, score string, rank int")
    assert run(L.ranked(odd, asked)) == brute(docs, items)
    assert run(L.ranked(empty, asked)) == [] == run(L.ranked(odd, asked.where("false")))


def test_ends_before_all_documents(spark):
    """Far fewer documents are looked up than the lists hold, and none that counts is missed."""
    rng = np.random.default_rng(1)
    n = 20_000
    term, impact = np.repeat(np.arange(4), n), rng.integers(1, 1000, 4 * n) ** 2
    doc = np.concatenate([np.arange(n)] * 4)
    segment, counted = L.Segment(doc, term, impact, np.arange(n), 4), {}
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    score, ids = segment.best(np.arange(4), np.array([1, 2, 1, 1]), none, 10, counted)
    total = (impact.reshape(4, n) * np.array([[1], [2], [1], [1]])).sum(0)
    assert list(zip(-score, ids)) == sorted((-s, i) for i, s in enumerate(total))[:10]
    assert counted["looked_up"] < n / 2


def test_terms(spark):
    data = "a-B ée é9_x\U0001f600y".encode()
    off = np.array([0, 3, 3, len(data)])
    starts, ends, row = L.term_spans(np.frombuffer(data, np.uint8), off)
    assert [(data[a:b].decode(), r) for a, b, r in zip(starts, ends, row)] == [("a", 0), ("B", 0), ("ée", 2), ("é9", 2), ("x\U0001f600y", 2)]
    words = L.Vocabulary(["b", "é9"])
    which, number = words.find(np.frombuffer(data, np.uint8), starts, ends)
    assert (which.tolist(), number.tolist()) == ([1, 3], [0, 1])


def test_query(spark, folder, odd):
    items = [(7, "quick brown dog"), (8, "word1")]
    path = folder(documents=odd, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    assert run(catalog.op11_ranked_search(spark, path)) == brute([(r.doc_id, r.text) for r in odd.collect()], items)
