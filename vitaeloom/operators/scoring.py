"""Scores of resume-posting pairs, with the evidence for each number.

Pairs are rows (pair keys are resume_id and posting_id); every function is a join and an aggregation
over all pairs at once. Rounding is half to even on doubles. Sums that are rounded fold a sorted array,
so that a score doesn't depend on the order in which rows arrive.

Defined results: a pair without requirements or without lines scores 0 on meaning; without clusters in
the posting 0 on coverage; of equal similarities the first line wins; null vectors have no similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeloom.functions.text import word_count

# Weights of the blend and of requirement types, and the range that similarities are stretched over.
BLEND = {"semantic": 0.45, "taxonomy": 0.35, "parseability": 0.20}
TYPE_WEIGHT = {"required": 1.0, "preferred": 0.5}
FLOOR, CEILING = 0.47, 0.82


def clamp(x: Column) -> Column:
    """Half-even rounding into 0..100."""
    return F.least(F.greatest(F.bround(x), F.lit(0.0)), F.lit(100.0)).cast("int")


def rescale(cosine: Column) -> Column:
    return F.least(F.greatest((cosine - FLOOR) / (CEILING - FLOOR), F.lit(0.0)), F.lit(1.0))


def type_weight(kind: Column) -> Column:
    return F.when(kind == "required", TYPE_WEIGHT["required"]).otherwise(TYPE_WEIGHT["preferred"])


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ordered_sum(order: Column, value: Column) -> Column:
    """Sum of doubles in a fixed order, whatever the order of arrival."""
    kept = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["v"])


def evidence_lines(lines: DataFrame, raw: DataFrame | None = None, key: str = "resume_id") -> DataFrame:
    """(key, line_idx, raw_text, clusters): work bullets, then project bullets, then skills; without any, the raw lines of three words and more.

    `lines` has (key, source, entry_idx, line_no, raw_text, clusters) with source work, project or skill;
    `raw` has (key, line_no, line).
    """
    rank = F.when(F.col("source") == "work", 0).when(F.col("source") == "project", 1).otherwise(2)
    order = Window.partitionBy(key).orderBy("_rank", F.coalesce("entry_idx", F.lit(0)), "line_no", "raw_text")
    own = lines.withColumn("_rank", rank).withColumn("line_idx", F.row_number().over(order) - 1).select(key, "line_idx", "raw_text", "clusters")
    if raw is None:
        return own
    rest = raw.where(word_count(F.col("line")) >= 3).join(own.select(key).distinct(), key, "left_anti")
    number = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1
    return own.unionByName(rest.select(key, number.alias("line_idx"), F.col("line").alias("raw_text"), F.array().cast("array<string>").alias("clusters")))


def best_lines(pairs: DataFrame, requirements: DataFrame, lines: DataFrame) -> DataFrame:
    """(resume_id, posting_id, req_idx, requirement_type, line_idx, similarity, score) for every requirement of every pair.

    requirements: (posting_id, req_idx, requirement_type, vector); lines: (resume_id, line_idx, vector).
    """
    asked = pairs.select("resume_id", "posting_id").distinct().join(requirements.withColumnRenamed("vector", "asked"), "posting_id")
    met = asked.join(lines.select("resume_id", "line_idx", "vector"), "resume_id", "left").withColumn("cosine", dot("asked", "vector"))
    best = met.groupBy("resume_id", "posting_id", "req_idx", "requirement_type").agg(F.max_by(F.when(F.col("cosine").isNotNull(), F.col("line_idx")), F.struct("cosine", -F.col("line_idx"))).alias("line_idx"), F.max("cosine").alias("_cosine"))
    similarity = F.coalesce("_cosine", F.lit(0.0))
    return best.select("resume_id", "posting_id", "req_idx", "requirement_type", "line_idx", similarity.alias("similarity"), F.when(F.col("line_idx").isNull(), 0).otherwise(clamp(rescale(similarity) * 100)).alias("score"))


def semantic_scores(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """(resume_id, posting_id, semantic): weighted mean of the stretched similarities."""
    w = type_weight(F.col("requirement_type"))
    part = F.when(F.col("line_idx").isNull(), 0.0).otherwise(rescale(F.col("similarity")))
    sums = matches.groupBy("resume_id", "posting_id").agg(ordered_sum(F.col("req_idx"), w * part).alias("got"), ordered_sum(F.col("req_idx"), w).alias("total"))
    joined = pairs.select("resume_id", "posting_id").distinct().join(sums, ["resume_id", "posting_id"], "left")
    return joined.select("resume_id", "posting_id", F.coalesce(F.when(F.col("total") > 0, clamp(100 * F.col("got") / F.col("total"))), F.lit(0)).alias("semantic"))


def resume_clusters(lines: DataFrame, fallback: DataFrame | None = None, key: str = "resume_id") -> DataFrame:
    """(key, cluster_id, evidence): the first line that names each cluster; `fallback` (key, phrase_idx, phrase, cluster_id) fills gaps."""
    named = lines.select(key, F.lit(0).alias("_p"), F.col("line_idx").alias("_i"), "raw_text", F.explode("clusters").alias("cluster_id"))
    if fallback is not None:
        named = named.unionByName(fallback.select(key, F.lit(1).alias("_p"), F.col("phrase_idx").alias("_i"), F.col("phrase").alias("raw_text"), "cluster_id"))
    return named.groupBy(key, "cluster_id").agg(F.min_by("raw_text", F.struct("_p", "_i")).alias("evidence"))


def posting_clusters(requirements: DataFrame, key: str = "posting_id") -> DataFrame:
    """(key, cluster_id, requirement_type, asked): the strongest type in which a cluster is asked for, with the first text of that type."""
    rank = F.when(F.col("requirement_type") == "required", 0).otherwise(1)
    named = requirements.select(key, "req_idx", "raw_text", rank.alias("_rank"), F.explode("clusters").alias("cluster_id"))
    best = named.groupBy(key, "cluster_id").agg(F.min("_rank").alias("_rank"), F.min_by("raw_text", F.struct("_rank", "req_idx")).alias("asked"))
    return best.select(key, "cluster_id", F.when(F.col("_rank") == 0, "required").otherwise("preferred").alias("requirement_type"), "asked")


def pair_skills(pairs: DataFrame, resumes: DataFrame, postings: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(resume_id, posting_id, rank, cluster_id, requirement_type, weight, state, evidence, asked).

    pairs may carry `track`; weights is (cluster_id, track, weight). state is matched, missing_required or
    missing_preferred; rank orders by weight, then by cluster.
    """
    has_track = "track" in pairs.columns
    base = pairs.select("resume_id", "posting_id", *(["track"] if has_track else [])).distinct().join(postings, "posting_id")
    if weights is not None and has_track:
        base = base.join(weights.withColumnRenamed("weight", "_w"), ["cluster_id", "track"], "left")
    else:
        base = base.withColumn("_w", F.lit(1.0))
    base = base.withColumn("weight", F.coalesce("_w", F.lit(1.0)) * type_weight(F.col("requirement_type")))
    joined = base.join(resumes.select("resume_id", "cluster_id", "evidence"), ["resume_id", "cluster_id"], "left")
    state = F.when(F.col("evidence").isNotNull(), "matched").when(F.col("requirement_type") == "required", "missing_required").otherwise("missing_preferred")
    rank = F.row_number().over(Window.partitionBy("resume_id", "posting_id").orderBy(F.desc("weight"), "cluster_id")) - 1
    return joined.select("resume_id", "posting_id", rank.alias("rank"), "cluster_id", "requirement_type", "weight", state.alias("state"), "evidence", "asked")


def overlap_scores(pairs: DataFrame, skills: DataFrame) -> DataFrame:
    """(resume_id, posting_id, taxonomy, matched, missing_required, missing_preferred): weighted coverage, and the ordered clusters."""
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == s, F.struct("rank", "cluster_id")))), lambda x: x["cluster_id"])
    got = ordered_sum(F.col("rank"), F.when(F.col("state") == "matched", F.col("weight")).otherwise(0.0))
    sums = skills.groupBy("resume_id", "posting_id").agg(got.alias("got"), ordered_sum(F.col("rank"), F.col("weight")).alias("total"), *[listed(s).alias(s) for s in ("matched", "missing_required", "missing_preferred")])
    joined = pairs.select("resume_id", "posting_id").distinct().join(sums, ["resume_id", "posting_id"], "left")
    score = F.coalesce(F.when(F.col("total") > 0, clamp(100 * F.col("got") / F.col("total"))), F.lit(0))
    empty = F.array().cast("array<string>")
    return joined.select("resume_id", "posting_id", score.alias("taxonomy"), *[F.coalesce(s, empty).alias(s) for s in ("matched", "missing_required", "missing_preferred")])


def resolve_track(selected: Column, signal: Column) -> Column:
    return F.coalesce(selected, F.when(signal != "unclear", signal))


def blend(semantic: Column, taxonomy: Column, parseability: Column) -> Column:
    d = lambda c: c.cast("double")
    return clamp(F.lit(BLEND["semantic"]) * d(semantic) + F.lit(BLEND["taxonomy"]) * d(taxonomy) + F.lit(BLEND["parseability"]) * d(parseability))


def score_pairs(semantic: DataFrame, overlap: DataFrame, parseability: DataFrame) -> DataFrame:
    """(resume_id, posting_id, semantic, taxonomy, parseability, overall) of every pair; resumes without a report count as unassessed, 100."""
    joined = semantic.join(overlap.select("resume_id", "posting_id", "taxonomy"), ["resume_id", "posting_id"]).join(parseability.select("resume_id", "parseability"), "resume_id", "left")
    joined = joined.withColumn("parseability", F.coalesce("parseability", F.lit(100)))
    return joined.withColumn("overall", blend(F.col("semantic"), F.col("taxonomy"), F.col("parseability")))


def category_levels(weights: DataFrame, clusters: DataFrame, high: float = 0.9, medium: float = 0.5) -> DataFrame:
    """(category, track, median_weight, level) over the weights (cluster_id, track, weight)."""
    m = F.col("median_weight")
    grouped = weights.join(clusters.select("cluster_id", "category"), "cluster_id").groupBy("category", "track").agg(F.median("weight").alias("median_weight"))
    return grouped.withColumn("level", F.when(m >= high, "high").when(m >= medium, "medium").otherwise("low"))
