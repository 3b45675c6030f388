"""Rows whose texts look the same although the stored strings differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeloom.llm.codepoints import folded


def one_form(df: DataFrame, text: str, out: str = "one_form") -> DataFrame:
    """Adds the text in the one form of `codepoints`; null stays null."""
    return df.withColumn(out, folded(F.col(text)))


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """(tab, key, text) → (tab, key_a, key_b): rows of one table that look the same and are stored differently.

    Repeated rows count once, nulls have no row. Only forms with at least two stored variants are
    joined; the join is between the members of different variants, on a hash of the form, so exact
    copies of one variant never meet. A key with two different texts is compared by each of them.
    """
    rows = texts.where("text is not null and key is not null")
    shaped = one_form(rows, "text").select("tab", "key", F.xxhash64("one_form").alias("form"), F.sha2("one_form", 256).alias("proof"), F.xxhash64("text").alias("stored")).distinct()
    mixed = shaped.groupBy("tab", "form", "proof").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("tab", "form", "proof")
    kept = shaped.join(mixed, ["tab", "form", "proof"], "left_semi")
    b = kept.select("tab", "form", "proof", F.col("key").alias("key_b"), F.col("stored").alias("stored_b"))
    pairs = kept.withColumnRenamed("key", "key_a").join(b, ["tab", "form", "proof"]).where("key_a < key_b and stored <> stored_b")
    return pairs.select("tab", "key_a", "key_b").distinct()


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """(tab, key, text) → (tab, key, class_id, links): one row for each row, links counts the rows that look the same and are stored differently.

    A key with different texts has a row for each of their forms. Nothing is expanded into pairs.
    """
    rows = one_form(texts.where("text is not null and key is not null"), "text").select("tab", "key", F.sha2("one_form", 256).alias("class_id"), F.xxhash64("text").alias("stored")).distinct()
    variants = rows.groupBy("tab", "class_id", "stored").agg(F.count_distinct("key").alias("n"))
    sizes = variants.groupBy("tab", "class_id").agg(F.sum("n").alias("all"))
    other = variants.join(sizes, ["tab", "class_id"]).select("tab", "class_id", "stored", (F.col("all") - F.col("n")).alias("links"))
    return rows.join(other, ["tab", "class_id", "stored"]).groupBy("tab", "key", "class_id").agg(F.max("links").alias("links"))
