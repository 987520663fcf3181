import itertools

import pytest

# ids None, repeated, ties; texts null, empty, without words, without letters, very long
LONG = " ".join(f"word{i % 997} of{i % 13}" for i in range(60_000))
ODD_TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "12 34 !!"),
    (7, "one"),
    (8, "Éa größe 日本語 \U0001f600 x\u0000y ▁z"),
    (9, LONG),
    (None, "the quick brown fox jumps over the lazy dog"),
    (None, None),
]


@pytest.fixture()
def odd(spark):
    """Documents with every awkward kind of row and columns named like ones that operators make."""
    rows = [(i, t, None if k % 5 == 4 else ("en", "de")[k % 2], None if k % 4 == 3 else f"s{k % 3}", len(t or ""), "x", k, 0.5)
            for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int, score double")


@pytest.fixture()
def empty(odd):
    return odd.where("false")


@pytest.fixture()
def folder(tmp_path):
    """Writes tables as the queries read them; gives the folder."""
    numbers = itertools.count()

    def make(**tables):
        path = tmp_path / f"in{next(numbers)}"
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make
