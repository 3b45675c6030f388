from pyspark.sql import functions as F

from vitaeloom.functions import text as tx
from vitaeloom.functions.dates import first_range, scan, without_dates


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_clean_text(spark):
    raw = "﻿José\r\nA  \tb  c\r\r\n\n\n\nâ€¢ ﬁne​ \n"
    assert one(spark, raw, tx.clean_text) == "José\nA b c\n\n• fine"
    assert one(spark, None, tx.clean_text) is None
    assert one(spark, "", tx.clean_text) == ""


def test_bullets_and_units(spark):
    assert one(spark, "  • Did it", tx.is_bullet) is True
    assert one(spark, "-no blank", tx.is_bullet) is False
    assert one(spark, "- Did it. And more.", tx.units) == ["Did it. And more."]
    assert one(spark, 'One. Two! "Three" it is? four', tx.units) == ["One.", "Two!", '"Three" it is? four']
    assert one(spark, "", tx.units) == []


def test_lines_keep_order_and_blanks(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None)], "id int, t string")
    assert [(r["line_no"], r["line"]) for r in tx.explode_lines(df, "t", "id").collect()] == [(0, "a"), (1, ""), (2, "b")]
    assert tx.explode_lines(df, "t", "id", keep_blank=False).count() == 2


def test_clip_and_metrics(spark):
    assert one(spark, "x" * 160, tx.clip) == "x" * 160
    assert one(spark, "x" * 158 + "  yz", tx.clip) == "x" * 158 + "…"
    assert one(spark, "x" * 161, tx.clip) == "x" * 160 + "…" and one(spark, "word " * 100, tx.clip) == ("word " * 32).strip() + "…"
    assert one(spark, "", tx.reading_ease) == 100.0
    easy = one(spark, "The cat sat. The dog ran.", tx.reading_ease)
    hard = one(spark, "Interdisciplinary organisational considerations necessitate prioritisation", tx.reading_ease)
    assert easy > 90 > 0 > hard


def test_number_guard(spark):
    row = spark.createDataFrame([("cut 12% in 2020", "cut 12%"), ("cut costs", "cut 0.97 of costs")], "a string, b string").select(tx.adds_numbers(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in row] == [False, True]


def test_dates():
    assert [d[2] for d in scan("Jun 2018 – present, 03/2020, 3.19, 2021-04 and 1999")] == ["2018-06", "present", "2020-03", "2019-03", "2021-04", "1999"]
    assert first_range("Engineer, Sept. 2018 to Present")[:3] == ("2018-09", "present", "text")
    assert first_range("2023 — 2024")[:3] == ("2023", "2024", "year")
    assert first_range("Present – 2020") is None
    assert first_range("from 2019, then 2020") is None
    assert without_dates("Acme | Jan 2020 - Mar 2021 | 2019").strip(" |") == "Acme |  "[:4]
    assert scan("") == [] and scan("in 12019 or 2019.") == []
