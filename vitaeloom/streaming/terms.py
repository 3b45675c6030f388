"""Streaming counter of unmatched terms: submissions in, merged counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitaeloom.operators.terms import upsert_counts


def running_counts(terms: DataFrame) -> DataFrame:
    """(term, count) for a stream of (submission_id, term), one for each row; use with output mode update or complete."""
    return terms.where("term is not null").groupBy("term").agg(F.count("*").alias("count"))


def merge_counts(terms: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds each micro-batch into Parquet snapshots path/v=N; a replayed batch rewrites its own snapshot, so that each counts once."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v={number - 1}") if number else spark.createDataFrame([], "term string, count bigint")
        once = batch.where("term is not null").dropDuplicates(["submission_id", "term"])
        upsert_counts(before, once.select("term")).write.mode("overwrite").parquet(f"{path}/v={number}")

    return terms.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
