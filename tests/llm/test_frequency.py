import random
from collections import defaultdict

from vitaeloom.llm.frequency import mark_terms, term_frequency

SCHEMA = "row_id string, submission_id string, term string, term_count int, records string"


def rows():
    rng = random.Random(8)
    out = [(f"r{i}", f"s{rng.randint(0, 40)}", "Hot  Term " if rng.random() < 0.33 else f" t{rng.randint(0, 300)}", rng.choice([1, 1, 2]), "clash") for i in range(2000)]
    out += [("n1", "s1", None, 1, ""), ("n2", "s1", "  ", 1, ""), ("n3", None, "lone", 1, ""), ("n4", "s999", "t1", 1, "")]
    return out + out[:50]


def test_equals_brute_force(spark):
    total, records = defaultdict(int), defaultdict(set)
    for _, s, t, n, _ in dict.fromkeys(rows()):
        t = " ".join((t or "").lower().split())
        if t:
            total[t] += n
            records[t] |= {s} - {None}
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    found = term_frequency(df, "row_id", "submission_id", "term", "term_count")
    assert {r["term"]: (r["occurrences"], r["records"]) for r in found.collect()} == {t: (total[t], len(records[t])) for t in total}
    marks = {(r["term"], r["mark"]) for r in mark_terms(found, df.select("submission_id")).collect()}
    n = len({r[1] for r in rows()} - {None})
    assert marks == {(t, "rare") for t in total if total[t] <= 2} | {(t, "common") for t in total if len(records[t]) * 10 > n}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    found = term_frequency(df, "row_id", "submission_id", "term", "term_count")
    assert found.count() == 0 and mark_terms(found, df.select("submission_id")).count() == 0
