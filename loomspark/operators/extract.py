"""Node execution: one fused Arrow pass per node over responses, then plain columns.

Input rows are responses: ``request_id, task_id, trace_id, node, url, status, body``
(text) and ``vals`` (JSON text of the request's values).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conditions, urls, values
from ..plans.config import Config
from ..plans.rules import AiProvider, NodeProgram, RuleError
from . import stateful

_OUT = (
    "request_id string, task_id string, trace_id string, node string, error string, "
    "requests array<struct<edge:int,idx:int,node:string,url:string,vals:string,priority:int,transport:string>>, "
    "items array<struct<edge:int,idx:int,fn:string,data:string>>"
)
RESPONSE = ("request_id", "task_id", "trace_id", "node", "url", "status", "body", "vals")


def run_nodes(responses: DataFrame, config: Config, nodes: list[str], ai: AiProvider | None = None) -> DataFrame:
    """What nodes emit for their responses, in one pass; ``error`` says which rule a row breaks (such a row emits nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programs = {n: NodeProgram(config, n, ai) for n in nodes}
        types = pa.schema(
            [("error", pa.string()),
             ("requests", pa.list_(pa.struct([("edge", pa.int32()), ("idx", pa.int32()), ("node", pa.string()), ("url", pa.string()), ("vals", pa.string()), ("priority", pa.int32()), ("transport", pa.string())]))),
             ("items", pa.list_(pa.struct([("edge", pa.int32()), ("idx", pa.int32()), ("fn", pa.string()), ("data", pa.string())])))]
        )
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b, rows = whole.slice(lo, 500), []
                for rid, _, _, name, url, status, body, vals in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    try:
                        request = {"id": rid, "node": name, "url": url, "vals": json.loads(vals or "{}")}
                        requests, items = programs[name].run(request, url, status, body or "")
                        for r in requests:
                            r["vals"], r["transport"] = values.dumps(r["vals"]), values.dumps(r["transport"])
                        for i in items:
                            i["data"] = values.dumps(i["data"])
                        rows.append((None, requests, items))
                    except RuleError as e:
                        rows.append((str(e), [], []))
                cols = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols], names=["request_id", "task_id", "trace_id", "node", "error", "requests", "items"])

    picked = responses.filter(F.col("node").isin(*nodes)).select(
        *[F.col(c).cast("string").alias(c) for c in RESPONSE[:5]], F.col("status").cast("int").alias("status"), "body", F.col("vals").cast("string").alias("vals")
    )
    return picked.mapInArrow(run, _OUT)


def run_node(responses: DataFrame, config: Config, node: str, ai: AiProvider | None = None) -> DataFrame:
    return run_nodes(responses, config, [node], ai)


def run_all(responses: DataFrame, config: Config, ai: AiProvider | None = None) -> DataFrame:
    """All nodes of a configuration over the responses that are theirs, which are read once."""
    return run_nodes(responses, config, list(config.nodes), ai)


def emitted_requests(emitted: DataFrame) -> DataFrame:
    """Request rows with ``parent``, edge and place; ids are filled in by ``frontier.with_ids``."""
    one = emitted.select("task_id", "trace_id", F.col("request_id").alias("parent"), F.explode("requests").alias("r"))
    return one.select("task_id", "trace_id", "parent", "r.edge", "r.idx", "r.node", "r.url", "r.vals", "r.priority", "r.transport")


def emitted_items(emitted: DataFrame) -> DataFrame:
    """Item records: ``id, task_id, trace_id, request_id, node, edge, idx, fn, data``."""
    one = emitted.select("task_id", "trace_id", "request_id", "node", F.explode("items").alias("i"))
    return one.select(
        F.sha2(F.concat_ws("\n", "request_id", F.col("i.edge").cast("string"), F.col("i.idx").cast("string")), 256).alias("id"),
        "task_id", "trace_id", "request_id", "node", "i.edge", "i.idx", "i.fn", "i.data",
    )


def fetch(frontier: DataFrame, captured: DataFrame, body_limit: int = 64 << 20, place: str | None = None) -> DataFrame:
    """S1 without a network: requests joined to captured responses ``(url, status, body)`` by canonical URL.

    Of several captures of one URL the least counts: by URL and status, then by the column ``place`` of
    ``captured`` if one is named, then by body, so that reruns agree; one without a body comes last. A body over the limit makes an error row instead of a body; what was never captured gets status 404.
    """
    key = lambda c: urls.canonical_column(c)
    seen = captured.select(key(F.col("url")).alias("_key"), F.col("url").alias("final_url"), "status", "body", (F.lit(0) if place is None else F.col(place)).alias("_place"))
    seen = stateful.first_by(seen, ["_key"], F.struct(F.col("body").isNull(), "final_url", "status", "_place", "body")).drop("_place")
    rows = frontier.withColumn("_key", key(F.col("url"))).join(seen, "_key", "left").drop("_key")
    over = F.octet_length("body") > body_limit
    return rows.select(
        F.col("id").alias("request_id"), "task_id", "trace_id", "node", F.coalesce("final_url", "url").alias("url"), F.coalesce("status", F.lit(404)).cast("int").alias("status"),
        F.when(~over, F.col("body")).alias("body"), "vals", F.coalesce(over, F.lit(False)).alias("too_large"),
    )


# ------------------------------------------------------- native twins for typed data

# Redirect statuses.
REDIRECTS = (301, 302, 303, 307, 308)


def is_redirect(status: Column) -> Column:
    return status.isin(*REDIRECTS)


def redirect_method(status: Column, method: Column) -> Column:
    """GET after 303 (but for HEAD) and after 301 or 302 of a POST."""
    rewrite = ((status == 303) & (method != "HEAD")) | (status.isin(301, 302) & (method == "POST"))
    return F.when(rewrite, F.lit("GET")).otherwise(method)


def response_kept(status: Column) -> Column:
    return (status >= 200) & (status < 400)


def regex_all(text: Column, pattern: str, groups: int) -> Column:
    """Every match; group 1 where the pattern has one."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if groups else 0))


def fan_out(df: DataFrame, url: str, aligned: list[str] | None = None) -> DataFrame:
    """A row per element of an array of URLs with ``idx`` from 1; aligned arrays must have its length."""
    aligned = aligned or []
    ok = F.lit(True)
    for a in aligned:
        ok = ok & (F.size(a) == F.size(url))
    zipped = F.when(ok, F.arrays_zip(url, *aligned)).otherwise(F.raise_error(F.lit("aligned arrays differ in length")).cast(_zip_type(df, [url, *aligned])))
    rest = [c for c in df.columns if c not in (url, *aligned)]
    one = df.select(*rest, F.posexplode(zipped).alias("_at", "_row"))
    return one.select(*rest, *[F.col(f"_row.{c}").alias(c) for c in (url, *aligned)], (F.col("_at") + 1).alias("idx"))


def _zip_type(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "array<struct<" + ",".join(f"{n}:{kinds[n].removeprefix('array<')[:-1]}" for n in names) + ">>"


def item_value(edge_value: Column, bind: Column, field: Column) -> Column:
    """A non-empty value of the edge, else the bind, else the field."""
    return F.coalesce(values.null_if_empty(edge_value), bind, field)


def inherit(parent: Column, own: Column) -> Column:
    """A child's map of values; its own entries win."""
    return F.map_concat(F.map_filter(parent, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def matches(when: Column | None) -> Column:
    return F.lit(True) if when is None else F.coalesce(when, F.lit(False))


present = conditions.present
