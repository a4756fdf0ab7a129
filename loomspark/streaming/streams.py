"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Permanent; the state grows with the keys, as the semantics ask."""
    return stream.dropDuplicates(keys)


def ttl_dedup(stream: DataFrame, keys: list[str], time_ms: str, ttl_ms: int) -> DataFrame:
    """A key is held for ``ttl_ms`` from the row that was admitted; later rows of a batch follow event time."""
    schema = stream.schema
    names = stream.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time_ms, kind="stable")
        keep = []
        for t in rows[time_ms]:
            new = until is None or t >= until
            until = t + ttl_ms if new else until
            keep.append(new)
        state.update((int(until),))
        yield rows[keep][names]

    held = T.StructType([T.StructField("until", T.LongType())])
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.NoTimeout)


def rate_limit(stream: DataFrame, group: list[str], arrival_ms: str, interval_ms: int) -> DataFrame:
    """L1, L3: slots per group across batches; the state is one timestamp per group."""
    out = T.StructType([*stream.schema.fields, T.StructField("slot", T.LongType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(arrival_ms, kind="stable")
        slots = []
        for t in rows[arrival_ms]:
            last = int(t) if last is None else max(int(t), last + interval_ms)
            slots.append(last)
        state.update((last,))
        yield rows.assign(slot=slots)

    held = T.StructType([T.StructField("last", T.LongType())])
    return stream.groupBy(*group).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


def counters(stream: DataFrame, keys: list[str]) -> DataFrame:
    """A1: running counts (complete or update mode)."""
    return stream.groupBy(*keys).agg(F.count("*").alias("total"))


def windowed(stream: DataFrame, time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """An extra: event-time windows behind a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("total"))


def load_loop(messages: DataFrame, start: Callable[[dict], None], checkpoint: str, attempts: int = 3):
    """Starts a run per message, with bounded retries; a message that keeps failing fails its batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        for row in batch.toLocalIterator():
            for k in range(attempts):
                try:
                    start(row.asDict(recursive=True))
                    break
                except Exception:
                    if k + 1 == attempts:
                        raise

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
