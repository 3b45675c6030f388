import random

import pytest

from vitaeloom.llm.mixing import mix, mix_report, token_counts

pytest.importorskip("public_tokenizers")
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, n=3000):
    rng = random.Random(3)
    rows = [(i, rng.choices(["big", "small", "tiny"], [0.9, 0.08, 0.02])[0], " ".join(["word"] * rng.randint(1, 60)), 7) for i in range(n)]
    return spark.createDataFrame([*rows, (-1, None, "a", 0), (-2, "unlisted", "a", 0), (-3, "big", None, 0), (-4, "big", "", 0), (None, "big", "x", 0)], "doc_id bigint, source string, text string, copies int")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 4), ("tiny", 0.1, 6), ("absent", 0.0, 1)], TARGETS)
    mixed = mix(docs(spark), targets).cache()
    report = {r["source"]: r for r in mix_report(mixed, targets).collect()}
    for s, share, cap in (("big", 0.6, 2), ("small", 0.3, 4), ("tiny", 0.1, 6)):
        assert abs(report[s]["reached_share"] - share) < 0.01 and 0 < report[s]["most_copies"] <= cap
    assert report["absent"]["tokens"] == 0 and mixed.where("doc_id < 0 or doc_id is null").count() == 0
    spread = mixed.where("source = 'big'").collect()
    rates = sorted((r["tokens"], r["rate"]) for r in spread)
    assert all(a[1] >= b[1] - 1e-12 for a, b in zip(rates, rates[1:])) or all(a[1] <= b[1] + 1e-12 for a, b in zip(rates, rates[1:]))


def test_unreachable_total_uses_the_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], TARGETS)
    report = {r["source"]: r for r in mix_report(mix(docs(spark, 500), targets, total=1e9), targets).collect()}
    assert report["tiny"]["most_copies"] == 2 and report["big"]["most_copies"] == 1


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mix(docs(spark).limit(0), targets).count() == 0
    assert mix(docs(spark, 10), targets.limit(0)).count() == 0
    assert mix_report(mix(docs(spark).limit(0), targets), targets).first()["reached_share"] == 0.0


def test_token_counts(spark):
    from vitaeloom.llm.mixing import default_tokenizer

    df = spark.createDataFrame([("hello world",), ("",), (None,), ("x" * 50_000,)], "t string")
    got = [r["tokens"] for r in token_counts(df.withColumn("k", df["t"]), "t", default_tokenizer()).collect()]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 0
