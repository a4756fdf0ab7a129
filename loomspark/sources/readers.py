"""Sources: captured responses, decoded bodies, seeds and message folders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import charset
from ..plans.config import Config

REQUEST = "id string, task_id string, trace_id string, node string, url string, vals string, priority int, transport string, parent string, edge int, idx int"
MESSAGE = "task_id string, trace_id string, params map<string,string>, priority int"


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text of binary bodies by mark, header, meta element or UTF-8."""
    return pd.Series([charset.decode(b, c) for b, c in zip(body, content_type, strict=True)], dtype=object)


def captured(pages: DataFrame, url: str = "url", body: str = "html", status: Column | None = None, place: str | None = None) -> DataFrame:
    """A table of pages as responses; ``place`` names a column that comes along and orders captures of one URL."""
    own = [F.col(url).alias("url"), (F.lit(200) if status is None else status).cast("int").alias("status"), F.col(body).alias("body")]
    return pages.select(*own, *([] if place is None else [F.col(place).alias("place")]))


def by_mode(sources: dict[str, DataFrame]) -> DataFrame:
    """S3: the responses of several downloaders, each with its mode."""
    out = None
    for mode, df in sources.items():
        one = df.withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def bounded(responses: DataFrame, limit: int) -> DataFrame:
    """Bodies of at most ``limit`` bytes stay; longer ones leave a row marked ``too_large``."""
    over = F.coalesce(F.octet_length("body") > limit, F.lit(False))
    return responses.withColumn("too_large", over).withColumn("body", F.when(~over, F.col("body")))


def seeds(spark: SparkSession, config: Config, task_id: str, trace_id: str, vals: dict | None = None) -> DataFrame:
    """The start rows of a run."""
    from ..functions.values import dumps, sha256

    rows = []
    for k, r in enumerate(config.initial_requests(task_id, trace_id, vals)):
        key = sha256("\n".join((trace_id, r["node"], r["url"], str(k))))
        rows.append((key, task_id, trace_id, r["node"], r["url"], dumps(r["vals"]), r["priority"], dumps(r["transport"]), trace_id, -1, k))
    return spark.createDataFrame(rows, REQUEST)


def seed_table(pages: DataFrame, config: Config, task_id: str, trace_id: str, node: str) -> DataFrame:
    """S8 at scale: a table of URLs as start rows, without the driver."""
    vals = F.to_json(F.struct(F.lit(config.topic).alias("topic")))
    return pages.select(
        F.sha2(F.concat_ws("\n", F.lit(trace_id), F.lit(node), "url"), 256).alias("id"), F.lit(task_id).alias("task_id"), F.lit(trace_id).alias("trace_id"), F.lit(node).alias("node"),
        "url", vals.alias("vals"), F.lit(config.priority or 0).alias("priority"), F.lit("{}").alias("transport"), F.lit(trace_id).alias("parent"), F.lit(-1).alias("edge"), F.lit(0).alias("idx"),
    )


def messages(spark: SparkSession, folder: str, files_per_round: int = 100) -> DataFrame:
    """A stream of task messages, one JSON file or line each."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_round).json(folder)


class MemoryLoad:
    """A queue of task messages on the driver, drained in order of arrival."""

    def __init__(self) -> None:
        self._rows: list[dict] = []

    def put(self, task_id: str, trace_id: str, params: dict[str, str] | None = None, priority: int = 0) -> None:
        self._rows.append({"task_id": task_id, "trace_id": trace_id, "params": params or {}, "priority": priority})

    def take(self, limit: int) -> Iterator[dict]:
        """At most ``limit`` messages, the size of a round."""
        out, self._rows = self._rows[:limit], self._rows[limit:]
        return iter(out)
