import random
import re
from collections import defaultdict

import pytest

from capaflow.llm import minmax_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent=80):
    """Components over all pairs; an id with several texts is one document."""
    sets, parent = [(i, shingles(t, size)) for i, t in rows if i is not None], {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        find(a)
        for b, t in sets[:k]:
            common = len(s & t)
            if s and 100 * common >= percent * (len(s) + len(t) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def groups(seed, n=260, vocabulary=60):
    """Base texts with many edited copies, chains of edits, exact copies and short texts."""
    rng, rows = random.Random(seed), []
    for base in range(12):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(n // 12):
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words = words.copy() if rng.random() < 0.7 else words
                if words:
                    words[rng.randrange(len(words))] = f"w{rng.randrange(vocabulary)}"
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
    return rows


@pytest.mark.parametrize(("size", "options"), [
    (2, {}), (5, {}),
    # every way of the rest: pairs of small buckets, tiles of large ones
    (2, {"rounds": 1, "pair_members": 2, "tile": 8}), (2, {"rounds": 1, "pair_members": 1000})])
def test_same_components_as_all_pairs(spark, size, options):
    rows = groups(size + len(options))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in D.near_duplicates(docs, size=size, **options).collect()}
    expected = brute(rows, size)
    assert {i: r.component_id for i, r in got.items()} == expected
    for i, text in rows:
        assert got[i].n_shingles == len(shingles(text, size))
        assert got[i].kept == (expected[i] == i)


def test_repeated_ids_in_large_unfinished_buckets(spark, monkeypatch):
    """Ids that stand for a class in each of two families, and rows that occur often: a tile holds each class once."""
    rng, rows = random.Random(0), []
    for name, ids in (("w", range(60)), ("y", range(0, 60, 2))):
        for k in ids:  # edits of one text, most of them too far from each other to be linked
            words = [f"{name}{j}" for j in range(60)]
            for j in rng.sample(range(60), 4):
                words[j] = f"{name}{k}x{j}"
            rows.append((k, " ".join(words)))
    rows += rows[:10] * 5
    links = D._tile_links

    def watched(size, percent):
        work = links(size, percent)

        def once(table):
            seen = list(zip(*(table.column(c).to_pylist() for c in ("id", "digest", "outer"))))
            assert len(seen) == len(set(seen))
            return work(table)
        return once

    monkeypatch.setattr(D, "_tile_links", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in D.near_duplicates(docs, size=2, rounds=1, pair_members=2, tile=8).collect()}
    assert got == brute(rows, 2)


def test_odd_rows(spark, odd, empty):
    rows = D.near_duplicates(odd, size=2).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.id].append(r)
    assert [r.component_id for r in by_id[2]] == [1, 1]
    assert by_id[1][0].kept and not by_id[2][0].kept
    for i in (3, 4, 5):
        assert (by_id[i][0].n_shingles, by_id[i][0].component_id, by_id[i][0].kept) == (0, i, True)
    assert by_id[7][0].n_shingles == 1
    assert {(r.n_shingles, r.component_id, r.kept) for r in by_id[None]} == {(8, 1, False), (0, None, True)}
    assert D.near_duplicates(empty).count() == 0


def test_an_id_with_several_texts_joins_their_groups(spark):
    docs = spark.createDataFrame([(5, "a b c"), (3, "a b c"), (5, "x y z"), (9, "x y z"), (7, "q r s")], "doc_id long, text string")
    got = {(r.id, r.component_id) for r in D.near_duplicates(docs, size=2).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}


def test_signature_agreement_estimates_resemblance():
    import numpy as np
    from capaflow.llm.common import random_words
    a = np.sort(random_words(400, 1))
    b = np.sort(np.concatenate((a[:300], random_words(100, 2))))
    keys = D.band_keys(np.concatenate((a, b)), np.array([0, 400, 800]), 400, 1)
    agreed = (keys[0] == keys[1]).mean()
    assert abs(agreed - 300 / 500) < 0.08
