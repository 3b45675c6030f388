"""Tagging of text with the clusters of a skill taxonomy.

A surface form matches without regard to case, with any run of blanks, hyphens and underscores (also
none) between its words, "&" for "and", and no ASCII letter or digit at either side. Two ways are
offered: `tag_clusters` tells which clusters a text names, in order of their first mention, in one
native expression per cluster; `mention_spans` lists every mention with its place.

Defined results: null texts have no mention; empty forms match nothing; a form of two clusters names
both; mentions inside another mention of the same cluster don't count, overlapping ones do.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_COMPILED = 2_000
PUNCTUATION = re.compile(r"([.\\^$|?*+()\[\]{}&~#])")


def form_pattern(form: str) -> str:
    """Regular expression, for Java and Python alike, of one surface form without its borders."""
    words = [w for w in re.split(r"[\s\-_]+", form.strip()) if w]
    return r"[\s\-_]*".join("(?:&|and)" if w.lower() in ("&", "and") else PUNCTUATION.sub(r"\\\1", w) for w in words)


def bordered(pattern: str) -> str:
    return rf"(?<![A-Za-z0-9])(?:{pattern})(?![A-Za-z0-9])"


def compile_taxonomy(forms: DataFrame) -> dict[str, list[str]]:
    """cluster_id → its forms, read to the driver after a check of their number."""
    n = forms.where("form is not null").limit(MOST_COMPILED + 1).count()
    if n > MOST_COMPILED:
        raise ValueError(f"more than {MOST_COMPILED} surface forms: use with_clusters")
    out: dict[str, list[str]] = {}
    for r in forms.where("cluster_id is not null and trim(form) <> ''").select("cluster_id", "form").distinct().orderBy("cluster_id", "form").toLocalIterator():
        out.setdefault(r["cluster_id"], []).append(r["form"])
    return out


def tag_clusters(text: Column, taxonomy: dict[str, list[str]]) -> Column:
    """Array of the clusters that a text names, by first mention, then by name."""
    if not taxonomy:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    hits = []
    for cluster, forms in sorted(taxonomy.items()):
        pattern = "(?iU)" + bordered("|".join(form_pattern(f) for f in forms))
        at = F.regexp_instr(text, F.lit(pattern))
        hits.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(cluster).alias("cluster"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*hits))), lambda h: h["cluster"])


def tag_by_join(df: DataFrame, text: str, forms: DataFrame, *keys: str) -> DataFrame:
    """(keys, cluster_id, first_at) for a taxonomy of any size.

    Texts and forms meet by an equi-join on how their runs of letters and digits begin (up to three characters), and
    the pattern of a form is tried only there. Forms that begin with another sign are tried on every text.
    """
    words = F.filter(F.split(F.trim("form"), r"[\s\-_]+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.when(F.lower(w).isin("&", "and"), F.lit("(?:&|and)")).otherwise(F.regexp_replace(w, r"([.\\^$|?*+()\[\]{}&~#])", r"\\$1")))
    first = F.lower(F.regexp_extract(F.trim("form"), "^[A-Za-z0-9]+", 0))
    start = F.when((first != "") & (first != "and") & ~F.col("form").rlike(r"[^\x00-\x7F]"), F.substring(first, 1, 3)).otherwise("")
    patterns = forms.where("trim(form) <> ''").select("cluster_id", start.alias("_start"), F.concat(F.lit("(?iU)(?<![A-Za-z0-9])(?:"), F.array_join(quoted, r"[\s\-_]*"), F.lit(")(?![A-Za-z0-9])")).alias("pattern"))
    # Long s and the Kelvin sign equal letters when case is ignored.
    runs = F.regexp_extract_all(F.translate(F.lower(F.col(text)), "\u017f\u212a", "sk"), F.lit("[a-z0-9]+"), F.lit(0))
    starts = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(runs, lambda r: F.array(*[F.substring(r, 1, n) for n in (1, 2, 3)])))))
    met = df.select(*keys, text, F.explode(starts).alias("_start")).join(patterns, "_start").where(F.expr(f"regexp_instr({text}, pattern) > 0"))
    return met.groupBy(*keys, "cluster_id").agg(F.min(F.expr(f"regexp_instr({text}, pattern)")).alias("first_at"))


def with_clusters(df: DataFrame, text: str, forms: DataFrame, *keys: str, out: str = "clusters", most: int = MOST_COMPILED) -> DataFrame:
    """Adds the clusters that a text names, by first mention: compiled for up to `most` forms, joined beyond. Keys tell rows apart."""
    if forms.where("form is not null").limit(most + 1).count() <= most:
        return df.withColumn(out, tag_clusters(F.col(text), compile_taxonomy(forms)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_at", "cluster_id"))), lambda x: x["cluster_id"])
    tagged = tag_by_join(df, text, forms, *keys).groupBy(*keys).agg(listed.alias(out))
    return df.drop(out).join(tagged, list(keys), "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


class Spans:
    """All mentions of a text, for use inside Arrow batches.

    A mention begins where a run of ASCII letters and digits begins, so that the first characters of the
    runs of a text tell which forms are worth a search.
    """

    RUN = re.compile(r"[A-Za-z0-9]+")
    # The only other characters that equal ASCII letters when case is ignored: long s and the Kelvin sign.
    FOLDED = re.compile("[\u017f\u212a]")

    def __init__(self, taxonomy: dict[str, list[str]]) -> None:
        self.always: list[tuple[str, str, re.Pattern[str]]] = []
        self.by_start: dict[str, list[tuple[str, str, re.Pattern[str]]]] = {}
        for c, forms in taxonomy.items():
            for f in forms:
                entry = (c, f, re.compile(bordered(form_pattern(f)), re.I))
                first = self.RUN.match(f.strip())
                if first and f.strip().isascii() and first[0].lower() != "and":
                    self.by_start.setdefault(first[0][:3].lower(), []).append(entry)
                else:
                    self.always.append(entry)

    def __call__(self, text: str) -> list[tuple[str, str, int, int]]:
        """(cluster, form, start, end), by place, then by cluster."""
        starts = {r[:n].lower() for r in self.RUN.findall(text) for n in (1, 2, 3)} if not self.FOLDED.search(text) else self.by_start
        patterns = [e for s in starts for e in self.by_start.get(s, ())] + self.always
        by_cluster: dict[str, list[tuple[int, int, str]]] = {}
        for c, f, p in patterns:
            by_cluster.setdefault(c, []).extend((m.start(), -m.end(), f) for m in p.finditer(text))
        kept = []
        for c, found in by_cluster.items():
            found.sort()
            # A mention counts if it ends beyond all that begin before it, or with it and are longer.
            reach = accumulate((-e for _, e, _ in found), max, initial=-1)
            kept += [(c, f, start, -end) for (start, end, f), before in zip(found, reach) if -end > before]
        return sorted(kept, key=lambda x: (x[2], x[0]))


def mention_spans(text: Column, taxonomy: dict[str, list[str]]) -> Column:
    """Array of (cluster_id, form, start, end) of every mention; places count characters from 0."""

    def run(texts: pd.Series) -> pd.Series:
        find = Spans(taxonomy)
        return texts.map(lambda t: None if t is None else [{"cluster_id": c, "form": f, "start": a, "end": z} for c, f, a, z in find(t)])

    return F.pandas_udf(run, "array<struct<cluster_id:string,form:string,start:int,end:int>>")(text)


def match_phrases(phrases: DataFrame, taxonomy: dict[str, list[str]], form_vectors: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """(phrase_id, phrase[, vector]) → (phrase_id, cluster_id, form, method, similarity).

    Exact mentions come first, one for each cluster. Phrases without any are compared with the vectors
    (cluster_id, form_idx, form, vector) of the forms; each cluster keeps its best form at or above the
    threshold, the first form on ties.
    """
    spans = phrases.select("phrase_id", F.explode(mention_spans(F.col("phrase"), taxonomy)).alias("m"))
    first = spans.groupBy("phrase_id", F.col("m.cluster_id").alias("cluster_id")).agg(F.min_by("m.form", F.struct("m.start", "m.form")).alias("form"))
    exact = first.select("phrase_id", "cluster_id", "form", F.lit("exact").alias("method"), F.lit(None).cast("double").alias("similarity"))
    if form_vectors is None:
        return exact
    rest = phrases.join(exact.select("phrase_id").distinct(), "phrase_id", "left_anti")
    cosine = F.aggregate(F.zip_with("vector", "form_vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
    # The forms of a taxonomy are the stated, bounded query set here; phrases stream past them.
    met = rest.join(form_vectors.withColumnRenamed("vector", "form_vector"), F.col("vector").isNotNull() & F.col("form_vector").isNotNull())
    near = met.withColumn("similarity", cosine).where(F.col("similarity") >= threshold)
    best = near.groupBy("phrase_id", "cluster_id").agg(F.max_by("form", F.struct("similarity", -F.col("form_idx"))).alias("form"), F.max("similarity").alias("similarity"))
    return exact.unionByName(best.select("phrase_id", "cluster_id", "form", F.lit("embedding").alias("method"), "similarity"))


def equivalent_phrasings(tags: DataFrame) -> DataFrame:
    """(text, cluster_id) → (cluster_id, text_a, text_b) with each text and the next one of its cluster, so that classes form chains, not all pairs."""
    order = Window.partitionBy("cluster_id").orderBy("text")
    chained = tags.select("text", "cluster_id").distinct().withColumn("text_b", F.lead("text").over(order))
    return chained.where("text_b is not null").select("cluster_id", F.col("text").alias("text_a"), "text_b")
