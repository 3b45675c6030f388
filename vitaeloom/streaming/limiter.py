"""Sliding-window rate limits: a request counts against the limit only if it was allowed.

The decision depends on earlier decisions, so that no window frame can express it. In batch the
requests of a key are folded in time order by one array aggregation with the allowed times of the last
window as state; as a stream the same state lives in the state store.

Defined results: requests of a key at the same time are taken in the order of their number; a hit
exactly one window old no longer counts; null keys are the key `unknown`; null times are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def client_key(header: Column, peer: Column) -> Column:
    """First part of a forwarding header, else the peer, else `unknown`."""
    part = F.trim(F.split(header, ",")[0])
    return F.coalesce(F.when(part != "", part), peer, F.lit("unknown"))


def step(kept: list[int], now: int, limit: int, window: int) -> tuple[list[int], bool, int]:
    """State after a request, whether it is allowed, and the seconds to wait if not; times and window in microseconds."""
    kept = [t for t in kept if t > now - window]
    if len(kept) < limit:
        return [*kept, now], True, 0
    wait = kept[0] + window - now
    return kept, False, max(1, -(-wait // 1_000_000))


def decide(requests: DataFrame, limit: int, window: float, key: str = "key", at: str = "ts", number: str = "request_id") -> DataFrame:
    """(key, number, at, allowed, retry_after), requests of each key streamed in time order.

    Rows are partitioned by a hash of the key and sorted; a worker reads them as they come and keeps at most
    `limit` times per key, so that a key of any size needs no group in memory.
    """
    rows = requests.where(F.col(at).isNotNull()).select(F.coalesce(F.col(key), F.lit("unknown")).alias(key), number, at, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    span = round(window * 1_000_000)
    ordered = rows.repartition(key).sortWithinPartitions(key, "_us", number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, []
        for b in batches:
            allowed, retry = [], []
            for k, us in zip(b[key], b["_us"]):
                if k != current:
                    current, kept = k, []
                kept, ok, wait = step(kept, int(us), limit, span)
                allowed.append(ok)
                retry.append(wait)
            yield b.drop(columns="_us").assign(allowed=allowed, retry_after=retry)

    return ordered.mapInPandas(run, f"{key} {kinds[key]}, {number} {kinds[number]}, {at} {kinds[at]}, allowed boolean, retry_after int")


def decide_stream(requests: DataFrame, limit: int, window: float, key: str = "key", at: str = "ts", number: str = "request_id") -> DataFrame:
    """The same for a stream; state expires by its time to live once a key has been idle for two windows.

    Needs the RocksDB state store provider.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    span = round(window * 1_000_000)

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.hits = handle.getListState("hits", "at bigint", ttlDurationMs=int(window * 2000) + 1)

        def handleInputRows(self, key_, rows, timerValues):  # noqa: N802, N803
            table = pd.concat(list(rows)).sort_values([at, number])
            kept = [x[0] for x in self.hits.get()]
            allowed, retry = [], []
            for t in table[at]:
                kept, ok, wait = step(kept, pd.Timestamp(t).value // 1000, limit, span)
                allowed.append(ok)
                retry.append(wait)
            if kept:
                self.hits.put([(x,) for x in kept])
            yield pd.DataFrame({key: key_[0], number: table[number].values, at: table[at].values, "allowed": allowed, "retry_after": retry})

        def handleExpiredTimer(self, key_, timerValues, expiredTimerInfo):  # noqa: N802, N803
            return iter([])

        def close(self) -> None:
            pass

    schema = f"{key} {kinds[key]}, {number} {kinds[number]}, {at} {kinds[at]}, allowed boolean, retry_after int"
    return requests.groupBy(key).transformWithStateInPandas(statefulProcessor=Limiter(), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
