"""Sinks: JSON lines by task and hour, queue records, quarantine of failed batches, safe path segments."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


def path_segment(value: str) -> str:
    """A portable name of at most 64 bytes as it is, any other as ``prefix--sha256``."""
    if _SAFE.fullmatch(value) and not value.endswith("."):
        return value
    prefix = re.sub(r"[^A-Za-z0-9._-]", "_", value)[:32]
    return f"{prefix}--{hashlib.sha256(value.encode()).hexdigest()}"


def path_segment_column(c: Column) -> Column:
    """K6 without Python."""
    prefix = F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), 1, 32)
    return F.when(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$") & ~c.endswith("."), c).otherwise(F.concat(prefix, F.lit("--"), F.sha2(c, 256)))


def jsonl_record(columns: list[str], key: str = "id") -> Column:
    """K2: one line ``{"id": ..., "data": {...}}``."""
    return F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.struct(*columns).alias("data")))


def queue_record(items: DataFrame) -> DataFrame:
    """K5: the envelope of the queue sink as a ``value`` column; ``data`` is embedded, not quoted."""
    head = F.to_json(F.struct("id", "task_id", "trace_id", "request_id", "node"))
    return items.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"data":'), F.col("data"), F.lit("}")).alias("value"))


def write_jsonl(items: DataFrame, folder: str, time: Column | None = None) -> None:
    """Appends ``{"id","data"}`` lines below ``task_id=.../hour=...``; ``data`` is JSON text."""
    line = F.concat(F.lit('{"id":'), F.to_json(F.struct(F.col("id"))).substr(F.lit(7), F.length(F.to_json(F.struct(F.col("id")))) - 7), F.lit(',"data":'), F.col("data"), F.lit("}"))
    hour = F.date_format(F.current_timestamp() if time is None else time, "yyyyMMddHH")
    items.select(line.alias("value"), path_segment_column(F.col("task_id")).alias("task_id"), hour.alias("hour")).write.mode("append").partitionBy("task_id", "hour").text(folder)


def guarded(write: Callable[[DataFrame, int], None], quarantine: str) -> Callable[[DataFrame, int], None]:
    """K1, K4: a batch writer whose failed batches are kept as Parquet and removed once they succeed."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = f"{quarantine}/batch={epoch}"
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            write(batch, epoch)
        except Exception:
            batch.write.mode("overwrite").parquet(path)
            raise
        fs.delete(files, True)

    return run


def address_allowed(text: str) -> bool:
    """K7: whether an address may be fetched from: public unicast only."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False
    mapped = getattr(a, "ipv4_mapped", None)
    a = mapped or a
    return a.is_global and not (a.is_multicast or a.is_reserved or a.is_loopback or a.is_link_local or a.is_unspecified)
