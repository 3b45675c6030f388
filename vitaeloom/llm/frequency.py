"""How often every distinct term occurs, and in how many records.

Pairs of term and record are range-partitioned and sorted; a scan over the runs of equal terms counts
occurrences and records. The ranges are over both columns, so that a term that a third of all rows
hold is spread over several partitions, while equal pairs stay together; partial counts of one term
add up. Pairs are summed before they are moved.

Defined results: a term is trimmed, in lower case, with single blanks; null and blank terms are none;
a row key counts once; a null record adds occurrences, but no record; a null count adds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_term(term: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(term, r"(?U)\s+", " ")))


def _scan(batches):
    """Run-length scan of sorted (term, record, n): one row for each run of a batch."""
    for b in batches:
        terms, n = b.column(0), b.num_rows
        if not n:
            continue
        starts = np.ones(n, bool)
        if n > 1:
            starts[1:] = pc.not_equal(terms.slice(1), terms.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(starts)
        known = pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.add.reduceat(b.column(2).to_numpy(zero_copy_only=False), at)
        yield pa.record_batch([terms.take(pa.array(at)), pa.array(total), pa.array(np.add.reduceat(known, at))], names=["term", "occurrences", "records"])


def term_frequency(rows: DataFrame, row_key: str, record: str, term: str, count: str) -> DataFrame:
    """(term, occurrences, records) over all rows of the table."""
    once = rows.select(F.col(row_key).alias("k"), F.col(record).alias("record"), normal_term(F.col(term)).alias("term"), F.col(count).cast("bigint").alias("n"))
    once = once.where("term is not null and term <> ''").dropDuplicates(["k"])
    pairs = once.groupBy("term", "record").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    ordered = pairs.repartitionByRange("term", "record").sortWithinPartitions("term", "record").select("term", "record", "n")
    runs = ordered.mapInArrow(_scan, "term string, occurrences bigint, records bigint")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(frequency: DataFrame, all_records: DataFrame, rare_most: int = 2, common_share: int = 10) -> DataFrame:
    """Adds a row (term, mark) for each term that is `rare` (occurrences up to rare_most) or `common` (in more than 1 / common_share of all records).

    all_records has one column with the record of every row; nulls are no record.
    """
    (name,) = all_records.columns
    total = all_records.agg(F.count_distinct(name).alias("n")).scalar()
    rare = F.when(F.col("occurrences") <= rare_most, F.lit("rare"))
    common = F.when(F.col("records") * common_share > total, F.lit("common"))
    marks = frequency.withColumn("mark", F.explode(F.array_compact(F.array(rare, common))))
    return marks.select("term", "mark")
