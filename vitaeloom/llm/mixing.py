"""Mixing sources to target shares of tokens by entropy balancing.

The rates closest to taking every document once (in relative entropy) that meet the token constraint of
each source are exponentially tilted, rate = min(cap, exp(lambda * tokens)). The multipliers minimise a
convex dual; Newton iterations, safeguarded by a bracket, run for all sources at once, each as one
aggregation over a table of (source, token count, documents). Rates become copies by adding a fixed
pseudo-random number per document and a shift per source, found by the same kind of aggregation, so
that the tokens of the copies meet the constraint to about one document.

Defined results: documents of null or unlisted sources and without tokens are not used; a source of
share 0 gets no copies; repeated document keys are separate documents; no copy exceeds the cap. The
total is the largest that every source can reach under its cap, times `fill`, unless it is given; a
source that can't reach its part even so is used up to its cap, which the report shows.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeloom.session import durable


def default_tokenizer() -> str:
    """Place of a public vocabulary of byte pairs; any file of that format can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """Adds `tokens`, the number of tokens of the text; 0 for null. The vocabulary file is sent to the executors."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name
    rest = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)

    def run(batches):
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        coder = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield b[rest].assign(tokens=[len(coder.encode_ordinary(t)) if t else 0 for t in b[text]])

    return docs.mapInPandas(run, f"{kinds}, tokens bigint")


def tilt(table: DataFrame, caps: dict[str, int], goals: dict[str, float], rounds: int = 40, close: float = 1e-6) -> dict[str, tuple[float, float]]:
    """Newton iterations over (source, tokens, n): for each source its multiplier and its scale, the mean number of tokens."""
    scale = {r["source"]: r["t"] / r["n"] for r in table.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    at = dict.fromkeys(scale, 0.0)
    low, high = dict.fromkeys(scale, -400.0), dict.fromkeys(scale, 400.0)
    live = {s for s in scale if goals.get(s, 0) > 0}
    for _ in range(rounds):
        if not live:
            break
        spark = table.sparkSession
        now = spark.createDataFrame([(s, at[s], scale[s], float(caps[s])) for s in sorted(live)], "source string, at double, scale double, cap double")
        u = F.col("tokens") / F.col("scale")
        raw = F.exp(F.least(F.col("at") * u, F.lit(50.0)))
        sums = table.join(F.broadcast(now), "source").groupBy("source").agg(
            F.sum(F.col("n") * F.col("tokens") * F.least(raw, F.col("cap"))).alias("got"), F.sum(F.when(raw < F.col("cap"), F.col("n") * F.col("tokens") * u * raw).otherwise(0.0)).alias("slope")
        )
        for r in sums.collect():
            s, wrong = r["source"], r["got"] - goals[r["source"]]
            if abs(wrong) <= close * goals[s] or high[s] - low[s] < 1e-9:
                live.discard(s)
                continue
            low[s], high[s] = (low[s], at[s]) if wrong > 0 else (at[s], high[s])
            step = at[s] - wrong / r["slope"] if r["slope"] > 0 else None
            at[s] = step if step is not None and low[s] < step < high[s] else (low[s] + high[s]) / 2
    return {s: (at[s], scale[s]) for s in scale}


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None, total: float | None = None, fill: float = 0.9) -> DataFrame:
    """(doc_id, source, text) and (source, target_share, max_repeats) → (doc_id, source, tokens, rate, copies), documents with copies only."""
    spark = docs.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").collect()}
    used = docs.where("doc_id is not null").join(targets.select("source").distinct(), "source", "left_semi").select("doc_id", "source", "text")
    counted = durable(token_counts(used, "text", vocabulary or default_tokenizer()).where("tokens > 0"))
    table = durable(counted.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r["source"]: r["t"] for r in table.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).collect()}
    caps = {s: m for s, (_, m) in wanted.items()}
    reach = [have.get(s, 0) * m / share for s, (share, m) in wanted.items() if share > 0 and s in have]
    if not reach:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, tokens bigint, rate double, copies int")
    size = total if total is not None else fill * min(reach)
    goals = {s: min(share * size, float(caps[s] * have[s])) for s, (share, _) in wanted.items() if s in have}
    tilts = tilt(table, caps, goals)
    known = spark.createDataFrame([(s, *tilts[s], float(caps[s]), goals[s]) for s in tilts if s in goals], "source string, at double, scale double, cap double, goal double")
    noise = F.pmod(F.xxhash64("doc_id", "source", "tokens"), F.lit(1 << 30)) / float(1 << 30)
    rated = counted.join(F.broadcast(known), "source").withColumn("rate", F.when(F.col("goal") <= 0, 0.0).otherwise(F.least(F.exp(F.least(F.col("at") * F.col("tokens") / F.col("scale"), F.lit(50.0))), F.col("cap"))))
    rated = rated.withColumn("noise", noise)
    copies = lambda shift: F.least(F.greatest(F.floor(F.col("rate") + F.col("noise") + shift), F.lit(0)), F.col("cap").cast("bigint"))
    low, high = {s: -1.0 for s in tilts}, {s: 1.0 for s in tilts}
    for _ in range(3):
        steps = 16
        grid = spark.createDataFrame([(s, low[s], (high[s] - low[s]) / steps) for s in tilts], "source string, low double, step double")
        sums = [F.sum(F.col("tokens") * copies(F.col("low") + i * F.col("step"))).alias(f"s{i}") for i in range(steps + 1)]
        for r in rated.join(F.broadcast(grid), "source").groupBy("source").agg(*sums).collect():
            s = r["source"]
            got = np.array([r[f"s{i}"] for i in range(steps + 1)], float)
            i = int(np.clip(np.searchsorted(got, goals.get(s, 0.0)) - 1, 0, steps - 1))
            width = (high[s] - low[s]) / steps
            low[s], high[s] = low[s] + i * width, low[s] + (i + 1) * width
    shifts = spark.createDataFrame([(s, (low[s] + high[s]) / 2) for s in tilts], "source string, shift double")
    chosen = rated.join(F.broadcast(shifts), "source").withColumn("copies", F.when(F.col("goal") > 0, copies(F.col("shift"))).otherwise(0).cast("int"))
    return chosen.where("copies > 0").select("doc_id", "source", "tokens", "rate", "copies")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_copies) for every source of the targets."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = F.coalesce(got.agg(F.sum("tokens").alias("t")).scalar(), F.lit(0))
    tokens = F.coalesce("tokens", F.lit(0))
    joined = targets.join(got, "source", "left")
    return joined.select("source", "target_share", F.when(total > 0, tokens / total).otherwise(0.0).alias("reached_share"), tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))


