"""Hybrid retrieval: BM25, vectors, reciprocal rank fusion, filters and evaluation.

Statistics of BM25 cover the whole corpus; filters act on candidates only. A document without a
positive score on a side has no rank there. Ties are broken by document number. Query sets are stated
and may be large: text queries meet documents through their terms, vector queries pass over the corpus
in blocks, and only the best of each block are shuffled.

Defined results: null or empty texts have no terms and no lexical rank; null vectors have no rank;
empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeloom.functions.text import terms
from vitaeloom.session import durable

# BM25 and fusion constants.
K1, B, FLOOR_SHARE = 1.5, 0.75, 0.25
RRF, CANDIDATES = 60, 50
BLOCK, GRID = 1024, 16


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl)"""
    words = docs.select(key, terms(F.col(text)).alias("_w")).where(F.size("_w") > 0).withColumn("dl", F.size("_w"))
    return words.select(key, "dl", F.explode("_w").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25_weights(counts: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): what a term adds to the score of a document, by statistics of the whole corpus.

    Terms in more than half of the documents would count negatively; they get a share of the mean instead.
    """
    # Counted once: statistics and weights read the written counts, not the texts.
    counts = durable(counts)
    n = docs.select(key).distinct().agg(F.count("*").alias("n")).scalar()
    total = counts.select(key, "dl").distinct().agg(F.sum("dl").alias("s")).scalar()
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("m")).scalar()
    idf = idf.select("term", F.when(F.col("raw") < 0, FLOOR_SHARE * mean).otherwise(F.col("raw")).alias("idf"))
    tf, dl = F.col("tf"), F.col("dl")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (total / n)))
    return counts.join(idf, "term").select(key, "term", weight.alias("weight"))


def allowed(docs: DataFrame, kinds: list[str] | None = None, clusters: list[str] | None = None, platform: str | None = None) -> DataFrame:
    """Candidates of a search: kind in a list, a cluster in common, platform equal; each only if given."""
    out = docs
    if kinds is not None:
        out = out.where(F.col("kind").isin(kinds))
    if clusters is not None:
        out = out.where(F.arrays_overlap("cluster_ids", F.array(*[F.lit(c) for c in clusters])))
    return out.where(F.col("platform") == platform) if platform is not None else out


def _ranked(scored: DataFrame, query: str, key: str, score: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def sparse_ranks(queries: DataFrame, weights: DataFrame, query: str, key: str, text: str, most: int = CANDIDATES, candidates: DataFrame | None = None) -> DataFrame:
    """(query, key, score, rank) by BM25; a term that a query repeats counts each time."""
    asked = queries.select(query, F.explode(terms(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("times"))
    pool = weights.join(candidates.select(key).distinct(), key, "left_semi") if candidates is not None else weights
    scored = asked.join(pool, "term").groupBy(query, key).agg(F.round(F.sum(F.col("times") * F.col("weight")), 9).alias("score")).where("score > 0")
    return _ranked(scored, query, key, "score", most)


def filtered_ranks(items: DataFrame, chunks: DataFrame, weights: DataFrame, most: int, *keys: str) -> DataFrame:
    """(keys, query, kinds, cluster_ids, platform) and chunks → (keys, chunk_id, score, rank), each item among its own candidates.

    A chunk is a candidate if its kind is listed, a cluster is shared and the platform is equal; an empty
    list and a null platform ask for nothing. Candidates are chosen before ranking, statistics cover all chunks.
    Items that ask the same are ranked once, and terms meet only among the chunks of a cluster asked for.
    """
    asks = ["query", "kinds", "cluster_ids", "platform"]
    items = durable(items.select(*keys, *asks))
    # Numbers are fixed by the checkpoint.
    asked = durable(items.select(*asks).distinct().withColumn("_ask", F.monotonically_increasing_id()))
    # A place is a cluster, or the whole collection for those that ask for none.
    whole, within = F.array(F.struct(F.lit(True).alias("whole"), F.lit("").alias("cluster"))), lambda c: F.transform(F.array_distinct(c), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("cluster")))
    places = F.when(F.size("cluster_ids") == 0, whole).otherwise(within(F.col("cluster_ids")))
    words = asked.select("_ask", F.explode(terms(F.col("query"))).alias("term")).groupBy("_ask", "term").agg(F.count("*").alias("times"))
    wanted = words.join(asked.select("_ask", "kinds", "cluster_ids", "platform", F.explode(places).alias("_place")), "_ask")
    held = chunks.select("chunk_id", F.col("kind").alias("_kind"), F.col("cluster_ids").alias("_clusters"), F.col("platform").alias("_platform"))
    held = held.withColumn("_place", F.explode(F.concat(whole, F.coalesce(within(F.col("_clusters")), F.array().cast("array<struct<whole:boolean,cluster:string>>")))))
    met = wanted.join(weights.join(held, "chunk_id"), ["term", "_place"])
    # A chunk that shares several clusters counts in the first of them.
    several = (F.size("cluster_ids") > 1) & (F.size("_clusters") > 1)
    fits = ~several | (F.array_min(F.array_intersect("cluster_ids", "_clusters")) == F.col("_place.cluster"))
    fits &= (F.size("kinds") == 0) | F.array_contains("kinds", F.col("_kind"))
    fits &= F.col("platform").isNull() | (F.col("platform") == F.col("_platform"))
    scored = met.where(fits).groupBy("_ask", "chunk_id").agg(F.round(F.sum(F.col("times") * F.col("weight")), 9).alias("score")).where("score > 0")
    ranked = _ranked(scored, "_ask", "chunk_id", "score", most)
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"a.{c}")) for c in asks]
    numbered = items.alias("i").join(asked.alias("a"), same).select(*[F.col(f"i.{k}") for k in keys], "a._ask")
    return durable(numbered.join(ranked, "_ask").select(*keys, "chunk_id", "score", "rank"))


def dense_ranks(queries: DataFrame, docs: DataFrame, query: str, key: str, vector: str = "vector", most: int = CANDIDATES, digits: int = 9) -> DataFrame:
    """(query, key, score, rank) by cosine of unit vectors; a query is not excluded from its own result.

    Both sides are packed into blocks of rows; each pair of blocks is one matrix product, whose best
    rows for each query go on.
    """
    pack = lambda df, name, block: df.where(F.col(vector).isNotNull()).select(F.col(name).alias("id"), F.col(vector).alias("v")).mapInPandas(_packer(block), f"ids array<{df.schema[name].dataType.simpleString()}>, dim int, data binary")
    asked = pack(queries, query, BLOCK).select(F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))
    held = pack(docs, key, 8 * BLOCK)

    def product(batches):
        for b in batches:
            for q_ids, q_data, ids, data, dim in zip(b["q_ids"], b["q_data"], b["ids"], b["data"], b["dim"]):
                q, d = (np.frombuffer(x, np.float32).reshape(-1, dim).astype(float) for x in (q_data, data))
                score = np.round(q @ d.T, digits)
                ids = np.asarray(ids)
                by_key = np.argsort(ids, kind="stable")
                score, ids = score[:, by_key], ids[by_key]
                best = np.argsort(-score, axis=1, kind="stable")[:, :most]
                values = np.take_along_axis(score, best, 1)
                good = values > 0
                yield pd.DataFrame({query: np.repeat(np.asarray(q_ids), good.sum(1)), key: ids[best][good], "score": values[good]})

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    # Blocks of a stated query set against blocks of all rows: a held block goes to one of GRID lanes, a query block
    # to all of them, so that lane and dimension spread the products over as many tasks, whatever the sizes.
    held = held.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(GRID)))
    asked = asked.withColumn("q_lane", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    met = held.join(asked, (F.col("dim") == F.col("q_dim")) & (F.col("lane") == F.col("q_lane")))
    scored = met.mapInPandas(product, f"{query} {kind(queries, query)}, {key} {kind(docs, key)}, score double")
    return _ranked(scored, query, key, "score", most)


def _packer(block: int):
    def run(batches):
        for b in batches:
            for size, rows in b.groupby(b["v"].map(len)):
                for k in range(0, len(rows), block):
                    part = rows.iloc[k : k + block]
                    yield pd.DataFrame({"ids": [part["id"].tolist()], "dim": [size], "data": [np.stack(part["v"].to_numpy()).astype(np.float32).tobytes()]})

    return run


def fuse(dense: DataFrame | None, sparse: DataFrame | None, query: str, key: str, most: int = 5) -> DataFrame:
    """(query, key, score, dense_rank, sparse_rank, rank) by reciprocal rank fusion; one side may be left out."""
    empty = lambda other: other.limit(0)
    d = (dense if dense is not None else empty(sparse)).select(query, key, F.col("rank").alias("dense_rank"))
    s = (sparse if sparse is not None else empty(dense)).select(query, key, F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    joined = d.join(s, [query, key], "full").withColumn("score", part("dense_rank") + part("sparse_rank"))
    return _ranked(joined, query, key, "score", most)


def evaluate(hits: DataFrame, cases: DataFrame, satisfied: Column, query: str, k: int = 5) -> DataFrame:
    """(recall_at_k, mrr, n): over all cases, by the rank of the first hit that satisfies its case."""
    first = hits.join(cases, query).where(satisfied).groupBy(query).agg(F.min("rank").alias("first"))
    joined = cases.select(query).distinct().join(first, query, "left")
    n = F.greatest(F.count("*"), F.lit(1))
    hit = F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))
    return joined.agg((F.coalesce(F.sum(hit), F.lit(0)) / n).alias("recall_at_k"), (F.coalesce(F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), F.lit(0.0)) / n).alias("mrr"), n.alias("n"))


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(auc, positives, negatives): share of pairs in which the positive scores strictly higher, by cumulative counts instead of pairs."""
    by = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    # Counts below each score: sums over ranges of scores first, then within a range, so that no task holds all scores.
    ranged = by.repartitionByRange(score).withColumn("_part", F.spark_partition_id())
    parts = ranged.groupBy("_part").agg(F.sum("n").alias("_n"))
    offset = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ranged.withColumn("_inside", inside).join(F.broadcast(offset), "_part")
    sums = won.agg(F.sum(F.col("p") * (F.col("_inside") + F.col("_before"))).alias("w"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return sums.select(F.when(F.col("positives") * F.col("negatives") > 0, F.col("w") / (F.col("positives") * F.col("negatives"))).alias("auc"), "positives", "negatives")


def nearest_label_accuracy(ranks: DataFrame, probe_labels: DataFrame, form_labels: DataFrame, query: str, key: str) -> DataFrame:
    """(accuracy, n): share of probes whose nearest form has their label."""
    best = ranks.where("rank = 1").join(form_labels.withColumnRenamed("label", "_found"), key)
    joined = probe_labels.join(best.select(query, "_found"), query, "left")
    return joined.agg(F.avg(F.coalesce((F.col("_found") == F.col("label")).cast("double"), F.lit(0.0))).alias("accuracy"), F.count("*").alias("n"))
