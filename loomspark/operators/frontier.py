"""Queue algebra over DataFrames: claims, settlement, idempotent pushes, recovery, and the fixpoint loop.

Tables (names and states follow the durable schema):

* ``requests(id, task_id, trace_id, node, mode, priority, url, vals, state, version, next_time,
  leased_by, lease_time, retry_count, max_retry_count, ack_version, dont_filter, sequence)``
* ``failed_workers(request_id, position, worker_id)``
* ``completions(id, version, worker, state, error, completed_at)``
* ``trace_stats(trace_id, name, total, done, filter, dedup, validate, download)``

States: 0 pending, 1 processing, 2 done, 3 failed.  Functions return new tables;
the driver is the single writer of a round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls, values
from ..sources.tables import written
from . import stateful

PENDING, PROCESSING, DONE, FAILED = range(4)
COUNTERS = ("total", "done", "filter", "dedup", "validate", "download")
LEASE_MS, REFRESH_MS = 30_000, 10_000


# ---------------------------------------------------------------------------- claims


def due(queue: DataFrame, now: int) -> DataFrame:
    """Rows whose time has come."""
    return queue.filter((F.col("state") == PENDING) & (F.col("next_time") <= now))


def capable(queue: DataFrame, modes: list[str]) -> DataFrame:
    """R9."""
    return queue.filter(F.col("mode").isin(*modes))


def not_failed_by(queue: DataFrame, failed_workers: DataFrame, worker: str) -> DataFrame:
    """Rows that this worker has not failed before."""
    mine = failed_workers.filter(F.col("worker_id") == worker).select(F.col("request_id").alias("id"))
    return queue.join(mine, "id", "left_anti").select(*queue.columns)


def top(queue: DataFrame, limit: int) -> DataFrame:
    """Highest priority first, then lowest sequence."""
    return queue.orderBy(F.desc("priority"), F.asc("sequence")).limit(limit)


def after(queue: DataFrame, priority: int, sequence: int) -> DataFrame:
    """Keyset pagination behind a row."""
    return queue.filter((F.col("priority") < priority) | ((F.col("priority") == priority) & (F.col("sequence") > sequence)))


def claim(requests: DataFrame, failed_workers: DataFrame, worker: str, modes: list[str], limit: int, now: int) -> DataFrame:
    """Q3, Q11: the claimed rows in their new state; the limit is a parameter of the claim."""
    found = top(not_failed_by(capable(due(requests, now), modes), failed_workers, worker), limit)
    return found.withColumns({"state": F.lit(PROCESSING).cast("tinyint"), "version": F.col("version") + 1, "leased_by": F.lit(worker), "lease_time": F.lit(now).cast("long")})


def applied(requests: DataFrame, changed: DataFrame) -> DataFrame:
    """``requests`` with the changed rows in place of the old ones."""
    return requests.join(changed.select("id"), "id", "left_anti").select(*requests.columns).unionByName(changed.select(*requests.columns))


def has_pending(requests: DataFrame, modes: list[str]) -> bool:
    """Whether a row is queued or being processed."""
    return not capable(requests, modes).filter(F.col("state").isin(PENDING, PROCESSING)).select("id").limit(1).isEmpty()


def quarantined(requests: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame]:
    """Q10: sound rows, and the others as failed with an error."""
    ok = F.coalesce(sound, F.lit(False))
    bad = requests.filter(~ok).withColumns({"state": F.lit(FAILED).cast("tinyint"), "error": F.lit("stored row disagrees with its queue entry")})
    return requests.filter(ok), bad


# ------------------------------------------------------------------------ settlement


def lease_holds(now: int, timeout: int = LEASE_MS) -> Column:
    """Q6."""
    return (F.col("state") == PROCESSING) & (F.lit(now) - F.col("lease_time") < timeout)


def ack(requests: DataFrame, claimed: DataFrame) -> DataFrame:
    """Q4: marks rows ``(id, version)`` as accepted by their worker."""
    hit = requests.join(claimed.select("id", "version"), ["id", "version"], "left_semi").filter(F.col("state") == PROCESSING)
    return applied(requests, hit.withColumn("ack_version", F.col("version")))


def refresh(requests: DataFrame, claimed: DataFrame, now: int) -> DataFrame:
    """Q4: moves the lease of acknowledged rows."""
    hit = requests.join(claimed.select("id", "version"), ["id", "version"], "left_semi")
    return applied(requests, hit.filter(lease_holds(now) & (F.col("ack_version") == F.col("version"))).withColumn("lease_time", F.lit(now).cast("long")))


def ranked(rows: DataFrame, order: list[str], name: str, first: int) -> DataFrame:
    """``rows`` with their place in an order, from ``first`` on, without a task that sees them all.

    Rows are range-partitioned by the order and written; a partition's places follow
    the number of rows in the partitions before it, of which there is one row each.
    """
    part = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1
    return part.join(F.broadcast(before), "_part").withColumn(name, F.lit(first).cast("long") + F.col("_before") + place).select(*dict.fromkeys([*rows.columns, name]))


def _requeued(rows: DataFrame, next_sequence: int) -> DataFrame:
    """T4: back to pending at the end of the queue, in the old order."""
    back = rows.withColumns({"state": F.lit(PENDING).cast("tinyint"), "leased_by": F.lit(None).cast("string"), "lease_time": F.lit(None).cast("long")})
    placed = ranked(back.withColumnRenamed("sequence", "_old"), ["_old", "id"], "sequence", next_sequence)
    return placed.select(*rows.columns)


def release(requests: DataFrame, claimed: DataFrame, next_sequence: int) -> DataFrame:
    """Q4: claimed rows go back without costing a retry."""
    hit = requests.join(claimed.select("id", "version"), ["id", "version"], "left_semi").filter(F.col("state") == PROCESSING)
    return applied(requests, _requeued(hit, next_sequence))


def fresh(settled: DataFrame, completions: DataFrame) -> DataFrame:
    """Q5: settlements ``(id, version, ...)`` that were not recorded before; replays drop out."""
    once = settled.dropDuplicates(["id", "version"])
    return once.join(completions.select("id", "version"), ["id", "version"], "left_anti")


def fenced(requests: DataFrame, settled: DataFrame, now: int, timeout: int = LEASE_MS) -> tuple[DataFrame, DataFrame]:
    """Q5, Q6: the rows that settlements ``(id, version, worker)`` may settle, and the settlements that are refused.

    A settlement counts only while its worker holds the lease of that version.
    """
    held = requests.filter(lease_holds(now, timeout)).select("id", "version", F.col("leased_by").alias("worker"))
    keys = ["id", "version", "worker"]
    good = settled.join(held, keys, "left_semi")
    hit = requests.join(good.select("id", "version").distinct(), ["id", "version"], "left_semi").select(*requests.columns)
    return hit, settled.join(held, keys, "left_anti").select(*settled.columns)


def _free(state: int) -> dict[str, Column]:
    return {"state": F.lit(state).cast("tinyint"), "leased_by": F.lit(None).cast("string"), "lease_time": F.lit(None).cast("long")}


def succeed(requests: DataFrame, settled: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Q5: requests with the settled ones done, and the refused settlements."""
    hit, refused = fenced(requests, settled, now)
    return applied(requests, hit.withColumns(_free(DONE))), refused


def fail(requests: DataFrame, settled: DataFrame, now: int, next_sequence: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One retry more each; below the maximum back into the queue, else failed. Also the new exclusions and the refused settlements."""
    hit, refused = fenced(requests, settled, now)
    excluded = hit.select(F.col("id").alias("request_id"), F.col("retry_count").alias("position"), F.col("leased_by").alias("worker_id"))
    hit = hit.withColumn("retry_count", F.col("retry_count") + 1)
    again = _requeued(hit.filter(F.col("retry_count") < F.col("max_retry_count")), next_sequence)
    over = hit.filter(F.col("retry_count") >= F.col("max_retry_count")).withColumns(_free(FAILED))
    return applied(requests, again.unionByName(over)), excluded, refused


def recover(requests: DataFrame, workers: DataFrame, worker: str, next_sequence: int) -> DataFrame:
    """Rows of an offline worker go back; accepted ones cost a retry, and fail at the maximum."""
    offline = workers.filter((F.col("worker_id") == worker) & F.col("offline_time").isNotNull()).select(F.col("worker_id").alias("leased_by"))
    hit = requests.filter(F.col("state") == PROCESSING).join(offline, "leased_by", "left_semi").select(*requests.columns)
    accepted = F.coalesce(F.col("ack_version") == F.col("version"), F.lit(False))
    hit = hit.withColumn("retry_count", F.col("retry_count") + accepted.cast("int"))
    spent = accepted & (F.col("retry_count") >= F.col("max_retry_count"))
    failed = hit.filter(spent).withColumns({"state": F.lit(FAILED).cast("tinyint"), "leased_by": F.lit(None).cast("string"), "lease_time": F.lit(None).cast("long")})
    return applied(requests, _requeued(hit.filter(~spent), next_sequence).unionByName(failed))


def online(workers: DataFrame, now: int, timeout: int = LEASE_MS) -> DataFrame:
    """R18."""
    return workers.filter(F.col("offline_time").isNull() & (F.lit(now) - F.col("last_heartbeat") < timeout))


def heartbeat(workers: DataFrame, worker: str, token: str, now: int) -> DataFrame:
    """Only the holder of the token moves its heartbeat, and not once it is offline."""
    mine = (F.col("worker_id") == worker) & (F.col("token") == token) & F.col("offline_time").isNull()
    return workers.withColumn("last_heartbeat", F.when(mine, F.lit(now).cast("long")).otherwise(F.col("last_heartbeat")))


def go_offline(workers: DataFrame, worker: str, token: str, now: int) -> DataFrame:
    mine = (F.col("worker_id") == worker) & (F.col("token") == token) & F.col("offline_time").isNull()
    return workers.withColumn("offline_time", F.when(mine, F.lit(now).cast("long")).otherwise(F.col("offline_time")))


def register(workers: DataFrame, worker: str, token: str, now: int) -> DataFrame:
    """A worker's new incarnation replaces its row."""
    row = workers.sparkSession.createDataFrame([(worker, token, now, None)], "worker_id string, token string, last_heartbeat long, offline_time long")
    return workers.filter(F.col("worker_id") != worker).select(*row.columns).unionByName(row)


# ---------------------------------------------------------------------------- pushes


def snapshot_hash(columns: list[str]) -> Column:
    """digest of a row's stable view."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def push(requests: DataFrame, incoming: DataFrame, identity: list[str]) -> DataFrame:
    """Inserts rows by id; equal rows under one id count once, rows that differ fail the whole batch.

    That holds for rows of the batch and for stored ones alike.
    """
    mark = snapshot_hash(identity)
    whole = F.struct(*[F.col(c) for c in requests.columns])
    new = incoming.withColumn("_hash", mark).groupBy("id").agg(F.min_by(whole, "_hash").alias("_row"), F.min("_hash").alias("_least"), F.max("_hash").alias("_most"))
    joined = new.join(requests.select("id", mark.alias("_old")), "id", "left")

    def refuse(message: str) -> Column:
        return F.raise_error(F.lit(message)).cast("boolean")

    differs = (F.col("_least") != F.col("_most")) | F.coalesce(F.col("_old") != F.col("_least"), F.lit(False))
    checked = joined.filter(F.when(differs, refuse("a request differs from another of its id")).otherwise(F.col("_old").isNull()))
    return requests.unionByName(checked.select("_row.*"))


def with_ids(rows: DataFrame) -> DataFrame:
    """replay-stable ids from parent, fingerprint and how often it occurred before under that parent."""
    print_ = F.sha2(F.concat_ws("\n", "node", "url", "vals", "transport"), 256)
    seen = F.row_number().over(Window.partitionBy("parent", "_print").orderBy("edge", "idx")) - 1
    return rows.withColumn("_print", print_).withColumn("_n", seen).withColumn("id", values.child_id(F.col("parent"), F.col("_print"), F.col("_n"))).drop("_print", "_n")


def start(requests: DataFrame, traces: DataFrame, trace_id: str, seeds: DataFrame) -> DataFrame:
    """Q1: a run's seeds, none of which is deduplicated; a run that exists is an error."""
    if not traces.filter(F.col("trace_id") == trace_id).limit(1).isEmpty():
        raise ValueError(f"trace {trace_id} exists")
    return requests.unionByName(seeds)


# -------------------------------------------------------------------------- counters


def count(rows: DataFrame) -> DataFrame:
    """A1, A3: outcomes ``(trace_id, name, outcome, admitted)`` as six counters.

    Skipped rows count under what skipped them; a row that ran to its end counts
    as done too, also if a filter stopped it, as long as it was admitted.
    """
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    other = F.count_if(~F.col("outcome").isin("done", "dedup", "validate", "download", "retry", "failed"))
    done = F.count_if((F.col("outcome") == "done") | (F.col("admitted") & ~F.col("outcome").isin("done", "download", "retry", "failed")))
    return rows.groupBy("trace_id", "name").agg(
        F.count_if(F.col("outcome") != "retry").alias("total"), done.alias("done"), other.alias("filter"), is_("dedup").alias("dedup"), is_("validate").alias("validate"), is_("download").alias("download")
    )


def merge_stats(stats: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert; overflow raises."""
    both = stats.select("trace_id", "name", *COUNTERS).unionByName(delta.select("trace_id", "name", *COUNTERS))
    return both.groupBy("trace_id", "name").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def latest(completions: DataFrame) -> DataFrame:
    """A5: the completion with the highest version of each id."""
    rest = [c for c in completions.columns if c != "id"]
    return completions.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("_c")).select("id", *[f"_c.{c}" for c in rest])


def gauges(requests: DataFrame) -> DataFrame:
    """A6."""
    return requests.agg(*[F.count_if(F.col("state") == k).alias(n) for k, n in enumerate(("queued", "processing", "done", "failed"))])


def cleanable(completions: DataFrame, requests: DataFrame, before: int) -> DataFrame:
    """Ids whose completions all lie before a time and that are not active."""
    old = completions.groupBy("id").agg(F.max("completed_at").alias("last")).filter(F.col("last") < before).select("id")
    return old.join(requests.filter(F.col("state").isin(PENDING, PROCESSING)).select("id"), "id", "left_anti")


def exclusions(failed_workers: DataFrame) -> DataFrame:
    """The ordered workers of each request."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("position", "worker_id"))), lambda x: x["worker_id"])
    return failed_workers.groupBy("request_id").agg(pairs.alias("workers"))


# -------------------------------------------------------------------------- fixpoint


def crawl(seeds: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], allowed: list[str] | None = None, drop_query: list[str] | None = None, max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rounds of a frontier until nothing new comes.

    ``step`` maps the admitted rows of a round to ``(requests, items)``.  New
    requests are checked (URL, domain), deduplicated by task, node and canonical
    URL, first by sequence, against all earlier rounds (seeds pass unchecked, rows with
    ``dont_filter`` neither ask nor leave a fingerprint), and
    form the next round.  Each round is a written table.  Returns all admitted
    requests and all items.
    """
    print_ = F.sha2(F.concat_ws("\n", "task_id", "node", urls.canonical_column(F.col("url"), drop_query)), 256)
    order = F.struct(F.col("round"), F.col("parent"), F.col("edge"), F.col("idx"))
    now = written(seeds.withColumn("round", F.lit(0)).withColumn("fingerprint", F.lit(None).cast("string")), "round")
    rounds, items = [now], []
    for k in range(1, max_rounds + 1):
        found, made = step(now)
        items.append(written(made, "items"))
        new = found.withColumn("round", F.lit(k)).filter(urls.http_valid(F.col("url")) & urls.host_allowed(F.col("url"), allowed or []))
        free = F.coalesce(F.col("dont_filter"), F.lit(False)) if "dont_filter" in new.columns else F.lit(False)
        new = with_ids(new).withColumn("fingerprint", F.when(~free, print_))
        asking, free_rows = new.filter("fingerprint IS NOT NULL"), new.filter("fingerprint IS NULL")
        new = stateful.first_by(asking, ["fingerprint"], order)
        if len(rounds) > 1:
            new = new.join(reduce(DataFrame.unionByName, [r.select("fingerprint") for r in rounds[1:]]), "fingerprint", "left_anti")
        new = new.select(*asking.columns).unionByName(free_rows)
        now = written(new.select(*rounds[0].columns), "round")
        if now.limit(1).isEmpty():
            break
        rounds.append(now)
    else:
        raise RuntimeError(f"the frontier did not settle in {max_rounds} rounds")
    every, out = rounds[0], items[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    for i in items[1:]:
        out = out.unionByName(i)
    return every, out
