import random

from pyspark.sql import functions as F

from vitaeloom.operators import embed, scoring


def unit(c):
    return [c, (1 - c * c) ** 0.5]


def semantic(spark, cosines, kinds):
    asked = spark.createDataFrame([("p", i, k, [1.0, 0.0]) for i, k in enumerate(kinds)], "posting_id string, req_idx int, requirement_type string, vector array<double>")
    lines = spark.createDataFrame([("r", i, unit(c)) for i, c in enumerate(cosines)], "resume_id string, line_idx int, vector array<double>")
    pairs = spark.createDataFrame([("r", "p"), ("r", "none")], "resume_id string, posting_id string")
    best = scoring.best_lines(pairs, asked, lines)
    return best.orderBy("req_idx").collect(), {r["posting_id"]: r["semantic"] for r in scoring.semantic_scores(pairs, best).collect()}


def test_semantic_goldens(spark):
    assert semantic(spark, [0.82], ["required"])[1] == {"p": 100, "none": 0}
    assert semantic(spark, [0.47], ["required"])[1]["p"] == 0
    best, score = semantic(spark, [0.55, 0.645, 0.645], ["required"])
    assert score["p"] == 50 and best[0]["line_idx"] == 1


def test_semantic_weights(spark):
    asked = spark.createDataFrame([("p", 0, "required", [1.0, 0.0]), ("p", 1, "preferred", [0.0, -1.0])], "posting_id string, req_idx int, requirement_type string, vector array<double>")
    lines = spark.createDataFrame([("r", 0, [1.0, 0.0])], "resume_id string, line_idx int, vector array<double>")
    pairs = spark.createDataFrame([("r", "p")], "resume_id string, posting_id string")
    assert scoring.semantic_scores(pairs, scoring.best_lines(pairs, asked, lines)).first()["semantic"] == 67


def test_no_lines_keep_the_requirement(spark):
    asked = spark.createDataFrame([("p", 0, "required", [1.0])], "posting_id string, req_idx int, requirement_type string, vector array<double>")
    lines = spark.createDataFrame([], "resume_id string, line_idx int, vector array<double>")
    pairs = spark.createDataFrame([("r", "p")], "resume_id string, posting_id string")
    row = scoring.best_lines(pairs, asked, lines).first()
    assert (row["line_idx"], row["similarity"], row["score"]) == (None, 0.0, 0)


def overlap(spark, have, want, track=None, weights=None):
    resumes = spark.createDataFrame([("r", c, "line " + c) for c in have], "resume_id string, cluster_id string, evidence string")
    postings = spark.createDataFrame([("p", c, k, "asked " + c) for c, k in want], "posting_id string, cluster_id string, requirement_type string, asked string")
    pairs = spark.createDataFrame([("r", "p", track)], "resume_id string, posting_id string, track string")
    table = spark.createDataFrame(weights, "cluster_id string, track string, weight double") if weights else None
    return scoring.overlap_scores(pairs, scoring.pair_skills(pairs, resumes, postings, table)).first()


def test_overlap_goldens(spark):
    want = [("rag", "required"), ("dl_frameworks", "required"), ("sql", "required"), ("cloud", "preferred")]
    row = overlap(spark, ["rag", "dl_frameworks"], want)
    assert row["taxonomy"] == 57 and row["matched"] == ["dl_frameworks", "rag"]
    assert row["missing_required"] == ["sql"] and row["missing_preferred"] == ["cloud"]
    assert overlap(spark, ["rag"], [])["taxonomy"] == 0
    row = overlap(spark, ["sql"], [("rag", "required"), ("sql", "required")], "mle", [("rag", "mle", 0.2), ("sql", "mle", 0.8)])
    assert row["taxonomy"] == 80


def test_blend_is_half_even(spark):
    df = spark.createDataFrame([(80, 60, 100), (100, 100, 100), (0, 0, 0), (10, 0, 0), (90, 20, 45)], "s int, t int, p int")
    got = [r["b"] for r in df.select(scoring.blend(F.col("s"), F.col("t"), F.col("p")).alias("b")).collect()]
    assert got == [77, 100, 0, 4, round(0.45 * 90 + 0.35 * 20 + 0.2 * 45)]


def test_evidence_and_strongest_type(spark):
    lines = spark.createDataFrame([("r", "skill", None, 0, "SQL", ["sql"]), ("r", "work", 0, 1, "used SQL", ["sql"]), ("r", "project", 0, 0, "made it", [])], "resume_id string, source string, entry_idx int, line_no int, raw_text string, clusters array<string>")
    raw = spark.createDataFrame([("r", 0, "a b c"), ("e", 0, "one two three"), ("e", 1, "two words")], "resume_id string, line_no int, line string")
    rows = scoring.evidence_lines(lines, raw).orderBy("resume_id", "line_idx").collect()
    assert [(x["resume_id"], x["raw_text"]) for x in rows] == [("e", "one two three"), ("r", "used SQL"), ("r", "made it"), ("r", "SQL")]
    assert scoring.resume_clusters(scoring.evidence_lines(lines)).first()["evidence"] == "used SQL"
    asked = spark.createDataFrame([("p", 0, "nice SQL", "preferred", ["sql"]), ("p", 1, "must SQL", "required", ["sql"]), ("p", 2, "more SQL", "required", ["sql"])], "posting_id string, req_idx int, raw_text string, requirement_type string, clusters array<string>")
    row = scoring.posting_clusters(asked).first()
    assert (row["requirement_type"], row["asked"]) == ("required", "must SQL")


def test_scores_do_not_depend_on_company_or_partitions(spark):
    rng = random.Random(1)
    asked = [(p, i, "required" if i % 2 else "preferred", unit(rng.random())) for p in range(4) for i in range(5)]
    lines = [(r, i, unit(rng.random())) for r in range(6) for i in range(7)]
    q = spark.createDataFrame(asked, "posting_id int, req_idx int, requirement_type string, vector array<double>")
    d = spark.createDataFrame(lines, "resume_id int, line_idx int, vector array<double>")
    pairs = spark.createDataFrame([(r, p) for r in range(6) for p in range(4)], "resume_id int, posting_id int")
    many = {(x["resume_id"], x["posting_id"]): x["semantic"] for x in scoring.semantic_scores(pairs, scoring.best_lines(pairs, q, d)).collect()}
    for parts in (1, 8):
        alone = pairs.where("resume_id = 3 and posting_id = 2")
        got = scoring.semantic_scores(alone, scoring.best_lines(alone, q.repartition(parts), d.repartition(parts))).first()["semantic"]
        assert got == many[3, 2]


def test_vectors(spark):
    df = spark.createDataFrame([("python",), (None,), ("",)], "t string").select(embed.vectors(F.col("t"), embed.hashed).alias("v")).collect()
    assert abs(sum(x * x for x in df[0]["v"]) - 1) < 1e-6 and df[1]["v"] is None and len(df[2]["v"]) == 64


def test_category_levels(spark):
    w = spark.createDataFrame([("a", "mle", 1.0), ("b", "mle", 0.9), ("c", "mle", 0.2)], "cluster_id string, track string, weight double")
    c = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "cluster_id string, category string")
    assert {r["category"]: r["level"] for r in scoring.category_levels(w, c).collect()} == {"x": "high", "y": "low"}
