import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline as C
from capaflow.llm.common import table
from tests.llm.test_language_id import WORDS, corpus
from tests.llm.test_minmax_dedup import brute
from tests.llm.test_secret_scan import BASE, MORE

KEY = "token=0123456789abcdef0123456789abcdef"


def documents(spark):
    rows = [(r.doc_id, r.text, r.lang if r.doc_id // 4 % 2 else None, f"s{r.doc_id % 4}" if r.doc_id % 9 else None, len(r.text)) for r in corpus(spark, 200).collect()]
    base = " ".join(WORDS["en"].split() * 4)
    rows += [(300, base + " alpha beta", "en", "s0", 0), (301, base + " alpha gamma", "en", "s1", 0), (302, f"the and {KEY} of to that", "en", "s2", 0),
             (303, "12 34 %%", "en", "s0", 0), (304, None, "en", "s0", 0), (305, "", None, None, 0), (300, base + " alpha beta", "en", "s0", 0),
             (None, "der und die nicht schon", "de", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_brute_force(spark, folder):
    path = folder(documents=documents(spark))
    docs = table(spark, path, "documents")
    names, stages = zip(*C.STAGES, strict=True)
    assert names == ("language_id", "minmax_near_dedup", "secret_scan", "mix_sources", "sentencepiece")

    def rows(df):
        return [tuple(r) for r in df.collect()]

    given = rows(docs)
    one = stages[0](spark, docs, path)
    kept = rows(one)
    assert one.columns == docs.columns
    assert Counter(kept) == Counter(r for r in given if r[1] and any(c.isalpha() for c in r[1]))

    two = stages[1](spark, one, path)
    deduped = rows(two)
    groups = brute([(r[0], r[1]) for r in kept], 2)
    assert two.columns == docs.columns
    assert sorted(r[0] for r in deduped if r[0] is not None) == sorted(i for i, c in groups.items() if i == c)
    assert sum(r[0] is None for r in deduped) == 1
    assert set(deduped) <= set(kept)

    three = stages[2](spark, two, path)
    clean = rows(three)
    assert three.columns == docs.columns and len(clean) == len(deduped)
    before = {r[0]: r for r in deduped}
    for r in clean:
        assert not any(len(m[g]) >= least for _, p, g, least in BASE + MORE for m in p.finditer(r[1]))
        if r[0] != 302:
            assert r == before[r[0]]
    assert {r[0]: r[1] for r in clean}[302] == "the and [SECRET] of to that"
    assert {r[0]: r[4] for r in clean}[302] == len("the and [SECRET] of to that")

    four = stages[3](spark, three, path)
    mixed = Counter(rows(four))
    assert four.columns == docs.columns
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r[1]) for r in clean)
    assert abs(sum(words(r[1]) * n for r, n in mixed.items()) - 1.5 * total) <= 5 * max(words(r[1]) for r in clean)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tokens = stages[4](spark, four, path).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in tokens) == Counter(
        {(r[0], len(library.encode(r[1]))): n for r, n in mixed.items()})
    assert Counter((r.doc_id, r.ids_sha256) for r in C.run(spark, path).collect()) == Counter((r.doc_id, r.ids_sha256) for r in tokens)


def test_odd_rows(spark, odd, empty, folder):
    assert C.run(spark, folder(documents=odd)).count() > 0
    assert C.run(spark, folder(documents=empty)).count() == 0


def test_scattered_edits_are_no_near_duplicates(spark):
    """One word in 20 changed: alike on word pairs, not on five words."""
    words = [f"w{k}" for k in range(400)]
    edited = [f"x{k}" if k % 20 == 10 else w for k, w in enumerate(words)]
    tail = [*words[:-1], "end"]
    rows = [(k, " ".join(w), "en", "s0", 0) for k, w in enumerate((words, edited, tail))]
    assert brute([r[:2] for r in rows], 2) == {0: 0, 1: 0, 2: 0}
    assert brute([r[:2] for r in rows], 5) == {0: 0, 1: 1, 2: 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect()) == [0, 1]
