import re
import zlib
from collections import Counter

import numpy as np

from capaflow.llm import language_id as L
from capaflow.llm.catalog import op3_language_id

WORDS = {"en": "the and of to that with this from have they which there", "de": "der die und nicht eine mit das für auch werden schon",
         "fr": "les des une est dans pour que qui avec sont cette être", "es": "los las una que para con por está pero como más"}


def corpus(spark, n=400):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 4]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(3, 40)))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, folder):
    path = folder(documents=corpus(spark))
    rows = op3_language_id(spark, path).collect()
    truth = {r.doc_id: r.lang for r in corpus(spark).collect()}
    held = [r for r in rows if r.held_out]
    assert 60 < len(held) < 140
    assert all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_masks_hold_every_language_of_a_gram(spark):
    filters = L.fit(corpus(spark), ratio=0.0)
    counts = L.gram_counts(corpus(spark)).collect()
    for r in counts:
        total = sum(x.n for x in counts if x.lang == r.lang)
        if r.n >= total * 1e-4:
            mask = int(filters.masks(np.array([r.gram], np.int64).view(np.uint64))[0, 0])
            assert mask >> filters.languages.index(r.lang) & 1
    assert filters.false_positive.max() < 0.05


def test_gram_counts_are_exact(spark):
    docs = spark.createDataFrame([("Ab a!", "x"), (None, "x"), ("ab", "x"), ("ab", None)], "text string, lang string")
    got = {r.gram: r.n for r in L.gram_counts(docs).collect()}
    pack = lambda s: ord(s[0]) << 42 | ord(s[1]) << 21 | ord(s[2])
    assert got == {pack(" ab"): 2, pack("ab "): 2, pack("b a"): 1, pack(" a "): 1}


def test_odd_rows(spark, odd, empty, folder):
    filters = L.fit(corpus(spark))
    rows = L.predict(odd, filters).collect()
    und = [r.lang_pred == "und" for r in rows]
    assert und == [not any(c.isalpha() for c in (r.text or "")) for r in odd.collect()]
    assert all(r.score == 0 for r, u in zip(rows, und, strict=True) if u)
    assert L.predict(empty, filters).count() == 0
    nothing = L.fit(empty)
    assert {r.lang_pred for r in L.predict(odd, nothing).collect()} == {"und"}
    assert op3_language_id(spark, folder(documents=empty)).count() == 0
    assert op3_language_id(spark, folder(documents=odd)).count() == odd.count()


def test_many_languages_need_several_words(spark):
    docs = spark.createDataFrame([(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * 5, f"l{k:03}") for k in range(70)], "text string, lang string")
    filters = L.fit(docs)
    assert filters.table.shape[1] == 2
    rows = L.predict(docs, filters, keep=("lang",)).collect()
    assert all(r.lang_pred == r.lang for r in rows)


def slow_grams(text):
    """Trigrams by hand: lower-cased letters, all between them one space."""
    t = " " + "".join(c if c.isalpha() else " " for c in (text or "").replace("\0", " ").lower()) + " "
    t = re.sub(" +", " ", t)
    return [t[k:k + 3] for k in range(len(t) - 2)] if any(c.isalpha() for c in t) else []


def slow_predict(labelled, texts, min_share=1e-4, ratio=0.25):
    """Exact sets of n-grams instead of filters."""
    counts = {}
    for text, lang in labelled:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(slow_grams(text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    often = {x: {g: n / total[x] for g, n in c.items() if n >= total[x] * min_share} for x, c in counts.items()}
    top = Counter()
    for shares in often.values():
        for g, share in shares.items():
            top[g] = max(top[g], share)
    known = {x: {g for g, share in shares.items() if share >= ratio * top[g]} for x, shares in often.items()}
    out = []
    for text in texts:
        grams = slow_grams(text)
        hits = {x: sum(g in known[x] for g in grams) for x in sorted(known)}
        if not grams:
            out.append(("und", 0.0))
        elif not any(hits.values()):
            out.append((max(sorted(total), key=lambda x: total[x]), 0.0))
        else:
            best = max(hits, key=lambda x: hits[x])
            out.append((best, hits[best] / sum(hits.values())))
    return out


def test_query_against_exact_sets(spark, folder):
    """Every row of the query, held out or not, against a predictor without filters; texts of two languages among them."""
    rng = np.random.default_rng(8)
    rows = [(r.doc_id, r.text, r.lang) for r in corpus(spark).collect()]
    for k in range(120):
        a, b = rng.choice(sorted(WORDS), 2)
        mixed = [*rng.choice(WORDS[a].split(), 9), *rng.choice(WORDS[b].split(), 4)]
        rows.append((1000 + k, " ".join(rng.permutation(mixed)).title() + "! 12 été", None))
    rows += [(2000, None, "en"), (2001, "", "de"), (2002, " 12 !", None), (2003, "\u65e5\u672c\u8a9e", None), (2004, "x", "fr")]
    path = folder(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    got = {r.doc_id: r for r in op3_language_id(spark, path).collect()}
    learnt = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    want = slow_predict(learnt, [t for _, t, _ in rows])
    assert len(got) == len(rows)
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert abs(got[i].score - score) < 0.03, i
        assert got[i].lang_pred == lang or abs(score - 0.5) < 0.03, i
