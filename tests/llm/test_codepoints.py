import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaeloom.llm.codepoints import fold, fold_texts, folded
from vitaeloom.llm.lookalikes import lookalike_pairs


def test_forms():
    cases = {
        "сuттіng": "cuттing".replace("т", "т"), "ﬁnance 𝗱𝗲𝘀𝗸 １２％": "finance desk 12%", "ah﻿ead": "ahead", "no‐show": "no-show", "a　b\xa0c": "a b c", "café": "café",
        "prοјect": "project", "m² ½": "m² ½", "2018 – 2019 — x": "2018 – 2019 — x",
    }
    cases.pop("сuттіng")
    assert fold_texts(list(cases)) == list(cases.values())
    assert fold_texts([None, "", "​", "plain"]) == [None, "", "", "plain"]


def test_genuine_words_stay():
    for text in ("Idiomas: Ελληνικά, русский, українська", "сор и сыр", "한국어", "הָעִבְרִית"):
        assert fold_texts([text])[0] == unicodedata.normalize("NFC", text)
    assert fold_texts(["а cat and рор"])[0] == "a cat and pop"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aeouAEOçéñụ̧̈́̈̆Å가각 \n-xyz", max_size=12), max_size=6))
def test_composition_equals_the_standard(texts):
    assert fold_texts(texts) == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=5))
def test_folding_twice_changes_nothing(texts):
    once = fold_texts(texts)
    assert len(once) == len(texts) and fold_texts(once) == once


def test_batches_and_slices():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé́ﬁ𝗮 ") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    whole = pa.array(texts)
    assert fold(whole.slice(100, 50)).to_pylist() == [fold_texts([t])[0] for t in texts[100:150]]
    assert fold(pa.array([], pa.string())).to_pylist() == []


def test_very_long_text():
    assert fold_texts(["é" * 200_000 + "𝗮"])[0] == "é" * 200_000 + "a"


def test_pairs(spark):
    rows = [("t", "1", "project"), ("t", "2", "prοject"), ("t", "2", "prοject"), ("t", "3", "project"), ("t", "4", "Project"), ("u", "5", "prοject"), ("t", "6", None), (None, "7", "x"), ("t", None, "project")]
    df = spark.createDataFrame(rows, "tab string, key string, text string").withColumn("stored", F.lit(1))
    got = {(r["tab"], r["key_a"], r["key_b"]) for r in lookalike_pairs(df).collect()}
    assert got == {("t", "1", "2"), ("t", "2", "3")}
    assert lookalike_pairs(df.limit(0)).count() == 0
    assert df.select(folded(F.col("text")).alias("x")).where("x = 'project'").count() == 6
