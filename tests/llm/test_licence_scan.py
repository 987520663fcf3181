import re

import pytest
from pyspark.sql import functions as F

from capaflow.llm import licence_scan as S
from capaflow.llm.catalog import op1_licences

TEXTS = dict(S.known_texts())


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_variants_of_a_licence(spark, name):
    text = TEXTS[name]
    variants = [text, text.upper(), text.replace("\n", "\r\n"),
                "(c) 2011 Some One\n" + text, "  " + text.replace('"', "''").replace(",", " , ") + "\n\nAll rights reserved.\n",
                re.sub(r"(?<!un)(l|L)icense(?!\.)", r"\1icence", text), text.replace("<year>", "1999").replace("[yyyy]", "2001"),
                "© 2020 A, B and C\n" + text]
    docs = spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")
    assert {r.licence for r in S.scan(docs).collect()} == {name}


def test_digests_differ():
    assert len(TEXTS) >= 8


def test_other_texts_match_nothing(spark):
    text = TEXTS["MIT"]
    docs = spark.createDataFrame(list(enumerate([text + "\nand one more condition", text[:-30], "Released under the MIT License.", text.replace("free of charge", "for a fee")])), "doc_id long, text string")
    assert {r.licence for r in S.scan(docs).collect()} == {None}


def test_a_table_of_ones_own(spark):
    known = spark.createDataFrame([("b", "Do what you like."), ("a", "do WHAT you like"), ("none", " ... ")], "licence string, text string")
    docs = spark.createDataFrame([(1, "Do what  you like!"), (2, "?"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in S.scan(docs, known).collect()} == {1: "a", 2: None, 3: None}


def test_odd_rows(spark, odd, empty, folder):
    rows = op1_licences(spark, folder(documents=odd.withColumn("licence", F.lit("x")).withColumn("digest", F.lit("y")))).collect()
    assert len(rows) == odd.count() and all(r.licence is None for r in rows)
    assert {r.doc_id for r in rows if r.digest is None} == {3, 4, 5, None}
    assert op1_licences(spark, folder(documents=empty)).count() == 0
