"""Terms that a taxonomy lacks: extraction from both sides, and their counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeloom.functions.text import word_count

# Limits, lead-ins of requirement lines, ends of fragments, and words that are no term.
MOST_CHARS, RESUME_WORDS, POSTING_WORDS = 40, 5, 3
LEAD_IN = (
    r"(?iU)^(?:\W*(?:strong|solid|deep|hands[\s-]+on|working|proven|demonstrated|prior|previous|extensive|some|basic|good|excellent|practical|professional)\s+)*"
    r"(?:experience|proficiency|proficient|familiarity|familiar|knowledge|expertise|understanding|background|exposure|competence|competency|skills?|ability|comfortable|fluency|fluent)"
    r"\s*(?:with|in|of|using|to|on)?\s*"
)
FRAGMENT_END = r"(?iU)\s*(?:,|;|/|\(|\)|\bor\b|\band\b|\betc\.?)\s*"
NO_TERM = ("", "a", "an", "the", "other", "others", "similar", "related", "tools", "technologies", "frameworks", "equivalent", "such as", "e.g", "eg", "ie", "i.e")


def clean_term(raw: Column, most_words: int) -> Column:
    """A term in lower case without outer punctuation; null if it can't be one."""
    t = F.lower(F.trim(F.regexp_replace(F.trim(raw), r"^[.:;\-–—'\"]+|[.:;\-–—'\"]+$", "")))
    fits = ~t.isin(*NO_TERM) & ~t.rlike(r"(?U)[@\d]") & F.length(t).between(2, MOST_CHARS) & (word_count(t) <= most_words)
    return F.when(fits, t)


def candidate_terms(skills: DataFrame, requirements: DataFrame, *keys: str) -> DataFrame:
    """(keys, side, term) once per submission: skills and requirement fragments without a cluster.

    skills and requirements have (keys, raw_text, clusters); a requirement without a lead-in is prose and
    gives none. A term of both sides is one of the resume.
    """
    a = skills.where("size(clusters) = 0").select(*keys, F.lit("resume").alias("side"), clean_term(F.col("raw_text"), RESUME_WORDS).alias("term"))
    led = requirements.where("size(clusters) = 0").select(*keys, F.trim("raw_text").alias("_t")).withColumn("_b", F.regexp_replace("_t", LEAD_IN, "")).where("_b <> _t")
    b = led.select(*keys, F.lit("posting").alias("side"), F.explode(F.split("_b", FRAGMENT_END)).alias("_f")).select(*keys, "side", clean_term(F.col("_f"), POSTING_WORDS).alias("term"))
    return a.unionByName(b).where("term is not null").groupBy(*keys, "term").agg(F.max("side").alias("side")).select(*keys, "side", "term")


def upsert_counts(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, count) with 1 more for each submission that names the term."""
    return counts.select("term", "count").unionByName(terms.groupBy("term").agg(F.count("*").alias("count"))).groupBy("term").agg(F.sum("count").alias("count"))


def top_terms(counts: DataFrame, most: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("count"), "term").limit(most)
