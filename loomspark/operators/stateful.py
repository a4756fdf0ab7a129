"""Deduplication, rate limits and retry schedules over ordered arrivals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

PERMANENT, DISABLED = -1, 0


def first_by(rows: DataFrame, keys: list[str], order: Column, bypass: str | None = None) -> DataFrame:
    """The first row of each key by ``order``; rows with ``bypass`` set pass unseen.

    Map-side minima keep a hot key from meeting in one task: only one row per
    key and task is shuffled, and the rows themselves are not sorted.
    """
    seen = rows if bypass is None else rows.filter(~F.coalesce(F.col(bypass), F.lit(False)))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    one = seen.groupBy(*keys).agg(F.min_by(whole, order).alias("_row")).select("_row.*")
    return one if bypass is None else one.unionByName(rows.filter(F.coalesce(F.col(bypass), F.lit(False))))


def fingerprint(*columns: Column) -> Column:
    """D5 for text keys: digest of the JSON array of the key values."""
    return F.sha2(F.to_json(F.array(*columns)), 256)


def ttl_dedup(rows: DataFrame, keys: list[str], time_ms: str, order: list[str], ttl_ms: int) -> DataFrame:
    """Admits a row if its key is not held; a key is held for ``ttl_ms`` from the admitted row on (not sliding).

    A ttl of 0 admits everything, -1 holds for ever.  Rows stream through their
    partition in order of key and time, so a task holds one timestamp, whatever
    the size of a key.
    """
    if ttl_ms == DISABLED:
        return rows
    if ttl_ms == PERMANENT:
        return first_by(rows, keys, F.struct(time_ms, *order))
    names = rows.columns
    key_at, time_at = [names.index(k) for k in keys], names.index(time_ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        until = 0
        for b in batches:
            key_columns, times, keep = [b.column(k).to_pylist() for k in key_at], b.column(time_at).to_pylist(), []
            for key, t in zip(zip(*key_columns, strict=True), times, strict=True):
                new = key != held or t >= until
                if new:
                    held, until = key, t + ttl_ms
                keep.append(new)
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, time_ms, *order).mapInArrow(run, rows.schema)


def rate_limit(rows: DataFrame, group: list[str], arrival_ms: str, order: list[str], interval_ms: int) -> DataFrame:
    """L1: ``slot`` = max(arrival, previous slot + interval) per group, in closed form.

    A slot is the greatest (arrival - place * interval) so far, plus place * interval.
    Rows are range-partitioned by group and time; each part takes its own places and
    maxima, and the parts of a group meet by one row each, so a group of any
    size is spread over tasks.
    """
    part = written(rows.repartitionByRange(*group, arrival_ms, *order).withColumn("_part", F.spark_partition_id()), "paced")
    w = Window.partitionBy("_part", *group).orderBy(arrival_ms, *order)
    own = part.withColumn("_rn", F.row_number().over(w).cast("long"))
    own = own.withColumn("_run", F.max(F.col(arrival_ms) - F.col("_rn") * interval_ms).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = own.groupBy("_part", *group).agg(F.max("_rn").alias("_n"), F.max("_run").alias("_most"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")))
    parts = parts.withColumn("_reached", F.max(F.col("_most") - F.col("_before") * interval_ms).over(before))
    parts = parts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_before", "_reached")
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    slot = F.greatest(F.col("_reached"), F.col("_run") - F.col("_before") * interval_ms) + (F.col("_before") + F.col("_rn")) * interval_ms
    return own.join(parts, same).select(*rows.columns, slot.alias("slot"))


def rate_conflicts(rows: DataFrame, group: list[str], qps: str) -> DataFrame:
    """L2: groups that ask for more than one rate."""
    return rows.groupBy(*group).agg(F.min(qps).alias("least"), F.max(qps).alias("most")).filter("least <> most")


def retry_delay(attempt: Column, backoff: list[int], attempts: int) -> Column:
    """Delay before the next try after ``attempt`` failures (from 0); the last step repeats; null when tries are used up."""
    step = F.element_at(F.array(*[F.lit(b).cast("long") for b in backoff]), F.least(attempt + 1, F.lit(len(backoff))).cast("int"))
    return F.when(attempt < attempts, step)


def retry_schedules(schedules: list[tuple[list[int], int]]) -> list[int]:
    """Several schedules in a row as one list of delays."""
    return [s[min(k, len(s) - 1)] for s, n in schedules for k in range(n)]
