"""Registered queries of this subpackage; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeloom.session import table


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.names import link_names

    typed = table(spark, folder, "work_entries").select(F.lit("company").alias("field"), F.col("company").alias("name"))
    typed = typed.unionByName(table(spark, folder, "education_entries").select(F.lit("institution").alias("field"), F.col("institution").alias("name")))
    return link_names(typed)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.names import name_pairs

    return name_pairs(_linked(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with its organisation and the number of its other spellings."""
    from vitaeloom.llm.names import name_classes

    return name_classes(_linked(spark, folder))


def _submissions(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda tab, key, text: table(spark, folder, tab).select(F.lit(tab).alias("tab"), F.col(key).alias("key"), F.col(text).alias("text"), F.lit(tab == "jobs").alias("is_json"))
    return part("resumes", "resume_id", "raw_text").unionByName(part("jobs", "id", "input_json"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with its class and the number of rows it is close to."""
    from vitaeloom.llm.nearcopies import classes, near_copies

    return classes(*near_copies(_submissions(spark, folder)))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.nearcopies import key_pairs, near_copies

    return key_pairs(*near_copies(_submissions(spark, folder)))


def _personal(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from vitaeloom.llm.pii import find_spans, first_names

    resumes, jobs = table(spark, folder, "resumes"), table(spark, folder, "jobs")
    part = lambda df, tab, key, col: df.select(F.lit(f"{tab}.{col}").alias("field"), F.col(key).alias("rec_id"), F.col(col).alias("text"), F.lit(tab == "jobs").alias("is_json"))
    texts = part(resumes, "resumes", "resume_id", "raw_text").unionByName(part(resumes, "resumes", "resume_id", "email")).unionByName(part(resumes, "resumes", "resume_id", "phone"))
    texts = texts.unionByName(part(jobs, "jobs", "id", "input_json").dropDuplicates(["rec_id"]))
    return texts, find_spans(texts, first_names(resumes, "full_name"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    _, spans = _personal(spark, folder)
    return spans.select("field", "rec_id", "pii_kind", "pii_value").distinct()


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.pii import redact

    return redact(*_personal(spark, folder))


def _skills(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "resume_lines").where("source = 'skill'").select(F.lit("resume_lines").alias("tab"), F.col("line_id").alias("row_key"), F.col("raw_text").alias("value"))
    return lines.unionByName(table(spark, folder, "unmatched_terms").select(F.lit("unmatched_terms").alias("tab"), F.col("row_id").alias("row_key"), F.col("term").alias("value")))


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.canonical import map_values

    forms = table(spark, folder, "surface_forms").select(F.col("cluster_id").alias("target"), F.col("form").alias("entry"))
    return map_values(_skills(spark, folder), forms)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    own = F.lower(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")))
    known = F.lower(F.trim(F.regexp_replace("entry", r"(?U)\s+", " ")))
    meant = _mapped(spark, folder).where("target is not null").where(own != known)
    return meant.select("tab", "row_key", F.col("target").alias("cluster_id")).distinct()


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean none of the forms, with the number of their rows."""
    none = _mapped(spark, folder).where("target is null and normal <> ''")
    return none.groupBy("tab", F.col("normal").alias("value")).agg(F.count("*").alias("rows"))


def _visible(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "resume_lines").where(F.col("source").isin("work", "project"))
    texts = lines.select(F.lit("resume_lines").alias("tab"), F.col("line_id").alias("key"), F.col("raw_text").alias("text"))
    texts = texts.unionByName(table(spark, folder, "resumes").select(F.lit("resumes").alias("tab"), F.col("resume_id").alias("key"), F.col("raw_text").alias("text")))
    return texts


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.lookalikes import lookalike_pairs

    return lookalike_pairs(_visible(spark, folder))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with the class of rows that look the same and the number of those that are stored differently."""
    from vitaeloom.llm.lookalikes import lookalike_classes

    return lookalike_classes(_visible(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.frequency import mark_terms, term_frequency

    log = table(spark, folder, "unmatched_terms")
    return mark_terms(term_frequency(log, "row_id", "submission_id", "term", "term_count"), log.select("submission_id"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.leakage import item_passages, leaked_items

    items = item_passages(table(spark, folder, "eval_items"), "item_id", ["question", "reference_answer"])
    found = leaked_items(table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text"), items)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_mix_copies(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.mixing import mix

    return mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p8_mix_report(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.mixing import mix_report

    return mix_report(p8_mix_copies(spark, folder), table(spark, folder, "mix_targets"))


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from vitaeloom.llm.abuse import score_documents

    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return docs, score_documents(docs, table(spark, folder, "abuse_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    _, scored = _scored(spark, folder)
    return scored.where("score >= 0.5").select("doc_id").distinct()


def p9_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    from vitaeloom.llm.abuse import source_rates

    docs, scored = _scored(spark, folder)
    return source_rates(scored, docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("p") and k[1].isdigit()}
