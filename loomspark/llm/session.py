"""What the operators need from the session: the shared folder, written tables and small checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/loomspark/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go as soon as it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends there and survives lost executors.

    The shuffle files behind it are of no more use then and go at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def bucketed(df: DataFrame, name: str, *key: str) -> DataFrame:
    """``written``, as a table in as many buckets by ``key`` as the session has shuffle partitions.

    Where ``df`` comes out of an exchange by ``key`` every bucket is one file, and
    joins and aggregates by ``key`` on the table need no exchange.  The table is packed
    tighter than Spark does by default, as those of whole texts stay for long.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"loomspark_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    # Spark drops the shuffle files of an insertion, but not those behind a table that is made from a query
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({', '.join(key)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    with shuffles_dropped(spark):
        df.write.insertInto(table)
    out = spark.read.table(table)
    out.shared_path, out.shared_name = path, table
    return out


def same_table(view: DataFrame, table: DataFrame) -> DataFrame:
    """``view``, which ``discard`` then takes for the table below it."""
    view.shared_path = vars(table)["shared_path"]
    return view


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` and ``bucketed`` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        if vars(t).get("shared_name"):
            spark.sql(f"DROP TABLE IF EXISTS {t.shared_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(vars(t)["shared_path"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that are deleted together once their readers are done."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def discard(self) -> None:
        discard(*self.tables)
        self.tables = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
