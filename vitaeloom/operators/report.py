"""Grounded reports: context numbering, requests, and the guards on what a generator returns.

The generator is pluggable (`generate`); nothing here calls a network. Requests are rows, retrieval for
them is batched. An answer that cites nothing or something unknown is a violation row, not an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeloom.functions.text import adds_numbers, reading_ease, word_count

# Weak lines, rewrites and readability.
WEAK_SCORE, LEAST_WORDS, MOST_REWRITES = 70, 6, 6
DENSITY_RISE, EASE_DROP, DENSITY_CEILING = 0.02, 10.0, 0.20
FLAG_NOTE = "# readability flag: raises keyword density at the cost of readability"


def number_context(uses: DataFrame, request: str = "request_id", order: str = "pos") -> DataFrame:
    """(request, pos, chunk_id) → (request, chunk_id, context_id): dense numbers from 1 by first use in each request."""
    first = uses.where("chunk_id is not null").groupBy(request, "chunk_id").agg(F.min(order).alias("_first"))
    number = F.row_number().over(Window.partitionBy(request).orderBy("_first", "chunk_id"))
    return first.select(request, "chunk_id", number.alias("context_id"))


def explanation_items(skills: DataFrame, report: DataFrame, clusters: DataFrame) -> DataFrame:
    """(resume_id, posting_id, item_no, item_id, kind, query): matched and missing required skills, then failed checks."""
    named = skills.where("state in ('matched', 'missing_required')").join(clusters.select("cluster_id", "canonical_name"), "cluster_id", "left")
    asked = F.concat_ws(" ", F.coalesce("canonical_name", F.col("cluster_id")), "asked")
    a = named.select("resume_id", "posting_id", F.when(F.col("state") == "matched", 0).otherwise(1).alias("_g"), F.col("rank").alias("_o"), F.col("cluster_id").alias("item_id"), F.col("state").alias("kind"), asked.alias("query"))
    pairs = skills.select("resume_id", "posting_id").distinct()
    failed = report.where("status = 'fail'").join(pairs, "resume_id")
    text = F.trim(F.concat_ws(" ", F.translate("check_name", "_", " "), "location"))
    b = failed.select("resume_id", "posting_id", F.lit(2).alias("_g"), F.col("check_idx").alias("_o"), F.concat(F.lit("check:"), "check_name").alias("item_id"), F.lit("check").alias("kind"), text.alias("query"))
    number = F.row_number().over(Window.partitionBy("resume_id", "posting_id").orderBy("_g", "_o", "item_id")) - 1
    return a.unionByName(b).select("resume_id", "posting_id", number.alias("item_no"), "item_id", "kind", "query")


def with_filters(items: DataFrame, platform: Column | None = None) -> DataFrame:
    """Items of explanations with what they may be explained by: strong bullets of their cluster, or quirks of the platform for a check."""
    check = F.col("kind") == "check"
    kinds = F.when(check, F.array(F.lit("platform_quirk"))).otherwise(F.array(F.lit("strong_bullet")))
    clusters = F.when(check, F.array().cast("array<string>")).otherwise(F.array("item_id"))
    return items.withColumn("kinds", kinds).withColumn("cluster_ids", clusters).withColumn("platform", F.when(check, platform if platform is not None else F.lit(None).cast("string")))


def item_context(items: DataFrame, chunks: DataFrame, ranks: DataFrame, most: int = 2) -> DataFrame:
    """(resume_id, posting_id, item_no, item_id, pos, chunk_id): the equivalence chunk of a skill, then its best strong bullets; for a check its best quirks.

    ranks are the hits (resume_id, posting_id, item_no, chunk_id, rank) of `retrieval.filtered_ranks` for `with_filters(items)`; a check
    without any chunk is dropped.
    """
    pair = ["resume_id", "posting_id"]
    equal = items.where("kind <> 'check'").join(chunks.select("chunk_id"), F.col("chunk_id") == F.concat(F.lit("equiv:"), "item_id"))
    equal = equal.select(*pair, "item_no", "item_id", F.lit(0).alias("_r"), "chunk_id")
    found = items.join(ranks.where(F.col("rank") <= most).select(*pair, "item_no", "chunk_id", "rank"), [*pair, "item_no"])
    pos = F.row_number().over(Window.partitionBy(*pair).orderBy("item_no", "_r")) - 1
    return equal.unionByName(found.select(*pair, "item_no", "item_id", F.col("rank").alias("_r"), "chunk_id")).select(*pair, "item_no", "item_id", pos.alias("pos"), "chunk_id")


def rewrite_context(ranks: DataFrame, request: str, item: str, guidance: str | None = None) -> DataFrame:
    """(request, item, chunk_id, rank), the best examples of each line to rewrite → (request, item, ids): their numbers in the context.

    The guidance chunk, if any, is number 1 of every request and ends every list; examples are numbered by first use.
    """
    first = F.lit(0 if guidance is None else 1)
    uses = ranks.select(request, "chunk_id", F.struct(F.col(item), F.col("rank")).alias("pos"))
    numbered = number_context(uses, request).withColumn("context_id", F.col("context_id") + first)
    listed = ranks.join(numbered, [request, "chunk_id"]).groupBy(request, item).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context_id"))), lambda x: x["context_id"]).alias("ids"))
    return listed.withColumn("ids", F.concat("ids", F.array() if guidance is None else F.array(F.lit(1))))


def weak_lines(matches: DataFrame, *keys: str, line: str = "line", score: str = "score", order: str = "req_idx", below: int = WEAK_SCORE, least_words: int = LEAST_WORDS, most: int = MOST_REWRITES) -> DataFrame:
    """The weakest distinct lines of each pair, with the requirement each should serve: ascending score, first requirement on ties."""
    kept = matches.where(F.col(line).isNotNull() & (F.col(score) < below)).where(word_count(F.col(line)) >= least_words)
    once = F.row_number().over(Window.partitionBy(*keys, line).orderBy(score, order))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(score, order))
    return kept.withColumn("_once", once).where("_once = 1").withColumn("weak_rank", number).where(F.col("weak_rank") <= most).drop("_once")


def generate(requests: DataFrame, generator: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Answers of a generator for request rows, batch by batch; it returns one dict for each answer, with the columns of the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = generator(b.to_dict("records"))
            if answers:
                yield pd.DataFrame(answers)

    return requests.mapInPandas(run, schema)


def ground(answers: DataFrame, context: DataFrame, request: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(request, answer_id, ids) and (request, context_id, text) → cited texts in order of first citation, and the violations.

    A violation is an answer without ids (`no_context`) or with an unknown one (`unknown_id`).
    """
    cited = answers.select(request, "answer_id", F.posexplode("ids").alias("_pos", "context_id"))
    met = cited.join(context.select(request, "context_id", "text"), [request, "context_id"], "left")
    unknown = met.where("text is null").select(request, "answer_id", F.lit("unknown_id").alias("reason")).distinct()
    empty = answers.where("ids is null or size(ids) = 0").select(request, "answer_id", F.lit("no_context").alias("reason"))
    bad = unknown.unionByName(empty)
    first = met.where("text is not null").groupBy(request, "answer_id", "text").agg(F.min("_pos").alias("_pos"))
    texts = first.groupBy(request, "answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "text"))), lambda x: x["text"]).alias("grounding"))
    return texts.join(bad.select(request, "answer_id"), [request, "answer_id"], "left_anti"), bad


def keyword_density(mentions: Column, text: Column) -> Column:
    """Mentions per word; 0 for a text without words."""
    n = word_count(text)
    return F.when(n > 0, mentions / n).otherwise(0.0)


def readability_flag(original: Column, rewrite: Column, density_before: Column, density_after: Column) -> Column:
    """Does a rewrite raise keyword density and get markedly harder to read, or is it dense anyhow?"""
    harder = reading_ease(rewrite) < reading_ease(original) - EASE_DROP
    return (density_after > density_before + DENSITY_RISE) & (harder | (density_after > DENSITY_CEILING))


def guard_rewrites(rewrites: DataFrame, original: str = "original_bullet", rewrite: str = "suggested_rewrite") -> DataFrame:
    """Rewrites that add no figure and stand for a known bullet."""
    return rewrites.where(F.col(original).isNotNull() & F.col(rewrite).isNotNull()).where(~adds_numbers(F.col(original), F.col(rewrite)))


def rewrite_diff(rewrites: DataFrame, *keys: str) -> DataFrame:
    """(keys, diff): one text of changed lines for each report, from (keys, rewrite_no, original_bullet, suggested_rewrite, readability_flag)."""
    block = F.concat(F.lit("@@ bullet "), F.col("_n").cast("string"), F.lit(" @@\n-"), "original_bullet", F.lit("\n+"), "suggested_rewrite", F.when(F.col("readability_flag"), F.lit("\n" + FLAG_NOTE)).otherwise(F.lit("")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("rewrite_no"))
    blocks = rewrites.withColumn("_n", number).select(*keys, "_n", block.alias("_b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda x: x["_b"]), "\n")
    return blocks.groupBy(*keys).agg(F.concat(F.lit("--- resume (original)\n+++ resume (suggested)\n"), body, F.lit("\n")).alias("diff"))


def display_names(clusters: DataFrame, checks: DataFrame) -> DataFrame:
    """(item_id, label) of clusters and checks."""
    label = F.concat(F.upper(F.substring("check_name", 1, 1)), F.translate(F.expr("substring(check_name, 2)"), "_", " "))
    return clusters.select(F.col("cluster_id").alias("item_id"), F.col("canonical_name").alias("label")).unionByName(checks.select(F.concat(F.lit("check:"), "check_name").alias("item_id"), label.alias("label")).distinct())
