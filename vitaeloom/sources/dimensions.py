"""Taxonomy, corpus and labelled sets as tables, with their checks as queries.

Violations are rows of (kind, key), so that a load can be refused or repaired; nothing is raised here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLUSTER_ID = "^[a-z][a-z0-9_]*$"


def track_weights(clusters: DataFrame, category_weights: DataFrame, own_weights: DataFrame) -> DataFrame:
    """(cluster_id, track, weight): the weights of the category, overlaid by those of the cluster."""
    base = clusters.select("cluster_id", "category").join(category_weights, "category").select("cluster_id", "track", "weight")
    own = own_weights.select("cluster_id", "track", F.col("weight").alias("_own"))
    return base.join(own, ["cluster_id", "track"], "full").select("cluster_id", "track", F.coalesce("_own", "weight").alias("weight"))


def taxonomy_violations(clusters: DataFrame, forms: DataFrame, category_weights: DataFrame | None = None, least_forms: int = 2) -> DataFrame:
    """Bad or repeated cluster ids, unknown categories, clusters with too few forms, forms of unknown clusters."""
    bad = [
        clusters.where(~F.coalesce(F.col("cluster_id").rlike(CLUSTER_ID), F.lit(False))).select(F.lit("bad_id").alias("kind"), F.col("cluster_id").alias("key")),
        clusters.groupBy("cluster_id").count().where("count > 1").select(F.lit("repeated_id").alias("kind"), F.col("cluster_id").alias("key")),
        clusters.join(forms.groupBy("cluster_id").agg(F.count_distinct("form").alias("n")), "cluster_id", "left").where(F.coalesce("n", F.lit(0)) < least_forms).select(F.lit("few_forms").alias("kind"), F.col("cluster_id").alias("key")),
        forms.join(clusters.select("cluster_id"), "cluster_id", "left_anti").select(F.lit("unknown_cluster").alias("kind"), F.col("cluster_id").alias("key")).distinct(),
    ]
    if category_weights is not None:
        bad.append(clusters.join(category_weights.select("category").distinct(), "category", "left_anti").select(F.lit("unknown_category").alias("kind"), F.col("cluster_id").alias("key")))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def read_taxonomy(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clusters, forms, own weights, category weights) of a folder of YAML files; needs a YAML parser.

    categories.yaml maps categories to track weights; every other file lists clusters with cluster_id,
    canonical_name, category, surface_forms and perhaps role_track_weight.
    """
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package yaml; tables can be given instead") from e
    from pathlib import Path

    files = sorted(Path(folder).glob("*.yaml"))
    if not files:
        raise ValueError(f"no taxonomy in {folder}")
    clusters, forms, own, by_category = [], [], [], []
    for p in files:
        content = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
        if p.stem == "categories":
            by_category += [(c, t, float(w)) for c, ws in content.items() for t, w in ws.items()]
            continue
        for c in content if isinstance(content, list) else content.get("clusters", []):
            clusters.append((c["cluster_id"], c["canonical_name"], c["category"]))
            forms += [(c["cluster_id"], i, f) for i, f in enumerate(c["surface_forms"])]
            own += [(c["cluster_id"], t, float(w)) for t, w in (c.get("role_track_weight") or {}).items()]
    return (
        spark.createDataFrame(clusters, "cluster_id string, canonical_name string, category string"),
        spark.createDataFrame(forms, "cluster_id string, form_idx int, form string"),
        spark.createDataFrame(own, "cluster_id string, track string, weight double"),
        spark.createDataFrame(by_category, "category string, track string, weight double"),
    )


def equivalence_chunks(clusters: DataFrame, forms: DataFrame) -> DataFrame:
    """One chunk for each cluster: its forms but for the canonical name, in order."""
    others = forms.join(clusters.select("cluster_id", "canonical_name"), "cluster_id").where("lower(form) <> lower(canonical_name)")
    listed = others.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("form_idx", "form"))), lambda x: x["form"]), ", ").alias("_forms"))
    text = F.concat("canonical_name", F.lit(" also appears as: "), F.coalesce("_forms", F.lit("")))
    return clusters.join(listed, "cluster_id", "left").select(F.concat(F.lit("equiv:"), "cluster_id").alias("chunk_id"), F.lit("equivalence").alias("kind"), text.alias("text"), F.col("canonical_name").alias("context"), F.array("cluster_id").alias("cluster_ids"), "category", F.lit(None).cast("string").alias("platform"))


def bullet_chunks(bullets: DataFrame, kind: str = "strong_bullet") -> DataFrame:
    """(cluster_id, text, line_no, category) → chunks numbered within each cluster."""
    number = F.row_number().over(Window.partitionBy("cluster_id").orderBy("line_no", "text"))
    prefix = {"strong_bullet": "bullet", "rewrite_pair": "pair"}.get(kind, kind)
    return bullets.select(F.concat_ws(":", F.lit(prefix), "cluster_id", number.cast("string")).alias("chunk_id"), F.lit(kind).alias("kind"), "text", F.col("cluster_id").alias("context"), F.array("cluster_id").alias("cluster_ids"), "category", F.lit(None).cast("string").alias("platform"))


def note_chunks(notes: DataFrame, kind: str) -> DataFrame:
    """(title, text, platform) → platform quirks, numbered within a platform, or guidance with a slug of the title as id."""
    if kind == "platform_quirk":
        number = F.row_number().over(Window.partitionBy("platform").orderBy("title"))
        name = F.concat_ws(":", F.lit("platform"), "platform", number.cast("string"))
    else:
        slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "_"), "^_|_$", "")
        name = F.concat(F.lit("guidance:"), slug)
    return notes.select(name.alias("chunk_id"), F.lit(kind).alias("kind"), "text", F.col("title").alias("context"), F.array().cast("array<string>").alias("cluster_ids"), F.lit(None).cast("string").alias("category"), "platform")


def corpus(*parts: DataFrame) -> DataFrame:
    """All chunks with `embed_text`, the context and the text."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("embed_text", F.concat_ws("\n", "context", "text"))


def corpus_violations(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Unknown clusters and repeated ids."""
    named = chunks.select("chunk_id", F.explode("cluster_ids").alias("cluster_id"))
    unknown = named.join(clusters.select("cluster_id"), "cluster_id", "left_anti").select(F.lit("unknown_cluster").alias("kind"), F.col("chunk_id").alias("key"))
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select(F.lit("repeated_id").alias("kind"), F.col("chunk_id").alias("key"))
    return unknown.unionByName(twice)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(query, expect): labelled queries from a JSON list; members of expect may be null."""
    return spark.read.schema("query string, expect struct<chunk_id:string,kind:string,cluster_id:string,platform:string>").json(path, multiLine=True)
