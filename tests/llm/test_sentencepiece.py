import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from capaflow.llm import sentencepiece_bpe as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(MODEL, "rb") as f:
        return S.load(f.read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["the", " ", "  ", "▁", "\n", "é", "日", "\U0001f600", "<s>", "<0x41>", "999", "aaaa"]),
                          st.text(max_size=5)), max_size=12))
def test_same_as_the_library(both, parts):
    ours, library = both
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = library.encode(text)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=8))
@example([197, 1, 131])   # two bytes of one character with a control symbol between them
@example([1, 300, 2, 300])
def test_decoding_any_ids(both, ids):
    assert both[0].decode(ids) == both[1].decode(ids)


def test_backtracking_equals_merging(both):
    """Words that need pieces taken back, against merging by priority."""
    ours = both[0]
    for word in ["▁unbelievably", "▁aaaaaaaaab", "▁" * 37 + "x", "▁abcabcabcabd", "▁ththththanand"]:
        assert [ours.model.pieces[i] for i in ours.known(word)] == ours.merged(word)


def test_forgetting_words_changes_nothing(both, monkeypatch):
    with open(MODEL, "rb") as f:
        fresh = S.Encoder(S.PieceModel(f.read()))
    monkeypatch.setattr(S, "WORD_MEMORY", 3)
    text = "some words come again some words come again and some do not"
    assert fresh.encode(text) == both[1].encode(text)


def test_rows(both, odd, empty):
    library = both[1]
    rows = S.encode_decode(odd, MODEL, keep=("doc_id", "key")).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert [r.n_tokens for r in rows] == [len(library.encode(t)) for t in texts]
    assert [r.ids for r in rows] == [",".join(map(str, library.encode(t))) for t in texts]
    assert [r.decoded for r in rows] == [library.decode(library.encode(t)) for t in texts]
    digests = S.encode_decode(odd, MODEL, digests=True).collect()
    assert digests[0].ids_sha256 == hashlib.sha256(rows[0].ids.encode()).hexdigest()
    assert S.encode_decode(empty, MODEL).count() == 0
