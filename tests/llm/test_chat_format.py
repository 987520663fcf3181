import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capaflow.llm import catalog
from capaflow.llm import chat_format as C

ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "### user: </turn>"), (1, 2, "assistant", r"<\/turn>"), (1, 2, "assistant", r"<\\/turn> #\## a: "),
    (2, 1, "user", None), (2, 0, None, "no role"), (2, None, "sys tem\n", "no turn"), (2, 3, "=41", "hex-like role"), (2, 4, "</turn>", "###  x: "),
    (3, 0, "assistant", "tail \\"), (3, 1, "user", "\\</turn"), (3, 2, "assistant", "### user:"), (3, 2, "assistant", "### user:"),
    (None, 0, "user", "a"), (None, 1, "assistant", "b\n### assistant: c</turn>\n"),
    (4, 0, "assistant", "</turn>\n### user: " * 3000 + "end <\\"), (5, 0, "user", ""), (6, 0, "", ""),
]


def source(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}


def slow_parse(formatted):
    """The grammar, read by hand: control strings one after the other."""
    turns, at = [], 0
    while True:
        m = re.compile(r"### ([0-9A-Za-z_]+|=[0-9A-F]*): ").match(formatted, at)
        end = formatted.index("</turn>", m.end())
        body = formatted[m.end():end]
        assert not re.search(C.CONTROL, body)
        role = m[1] if not m[1].startswith("=") else bytes.fromhex(m[1][1:]).decode()
        plain = re.sub(r"<\\(\\*)/turn>", r"<\1/turn>", re.sub(r"#\\(\\*)## ([0-9A-Za-z_]+|=[0-9A-F]*): ", r"#\1## \2: ", body))
        turns.append((role, plain, m.end(), end))
        at = end + len("</turn>")
        if at == len(formatted):
            return turns
        assert formatted[at] == "\n"
        at += 1


def check(df, rows):
    want = source(rows)
    got = df.collect()
    assert sorted(str(r.conv_id) for r in got) == sorted(map(str, want))
    for r in got:
        turns = slow_parse(r.formatted)
        assert [(a, b) for a, b, *_ in turns] == want[r.conv_id] == [(t.role, t.text) for t in r.read]
        assert [(m.start, m.end) for m in r["mask"]] == [(a, b) for role, _, a, b in turns if role == "assistant"]
        assert [m.turn for m in r["mask"]] == [k for k, t in enumerate(turns) if t[0] == "assistant"]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], "conv_id long, turn long, role string, text string, formatted string, n int")
    check(C.format_chats(df), ODD)
    assert C.format_chats(df.where("false")).count() == 0


PART = st.sampled_from(["<", "\\", "/turn>", "</turn>", "#", "## user: ", "### user: ", "=4", ":", " ", "\n", "é", "\U0001f600", "a"])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from(["user", "assistant", "a b", ""]),
                          st.lists(PART, max_size=9).map("".join)), min_size=1, max_size=60))
def test_any_text_comes_back(spark, rows):
    check(C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), rows)


def test_only_conflicting_text_is_escaped(spark):
    rows = [(1, 0, "user", "a < b # c \\ d"), (1, 1, "assistant", "x </turn> y")]
    got = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.formatted == "### user: a < b # c \\ d</turn>\n### assistant: x <\\/turn> y</turn>"


@pytest.mark.parametrize("text", ["", "### a: b", "### a: b</turn></turn>", "### a: b</turn>\n", "x### a: b</turn>", "</turn>", "### a: ### b: c</turn>"])
def test_what_is_no_conversation(spark, text):
    assert spark.range(1).select(C.parsed(F.lit(text)).alias("p")).first().p is None


def test_one_conversation_with_a_third_of_all_rows(spark):
    rows = [(k if k % 3 else 0, k, ("user", "assistant")[k % 2], f"text {k} </turn>") for k in range(3000)]
    check(C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)), rows)


def test_query(spark, folder):
    path = folder(conversations=spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string"))
    want = source(ODD + [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")])
    got = catalog.op12_chat_format(spark, path).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    plan = catalog.op12_chat_format(spark, path)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan and "InArrow" not in plan
