"""Code mode: spiders with DataFrame handlers, middleware and pluggable parts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import urls
from .operators import extract, frontier, stateful, validate
from .plans.config import Config
from .plans.rules import AiProvider

Handler = Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]]
Middleware = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]

#: Places where middleware can stand, in the order a row passes them.
HOOKS = (
    "before_scheduler", "after_scheduler", "before_download", "after_download", "before_parse", "after_parse",
    "before_item", "after_item", "on_error", "on_close",
)


def node(name: str) -> Callable:
    """H2: marks a method as the handler of a node: responses in, ``(requests, items)`` out."""

    def mark(f: Callable) -> Callable:
        f._node = name
        return f

    return mark


def item_function(name: str) -> Callable:
    """H3: marks a method as an item function: items in, items out."""

    def mark(f: Callable) -> Callable:
        f._item = name
        return f

    return mark


class Spider:
    """H1: the base of code-mode spiders; ``index`` handles rows without a handler of their own."""

    name = "spider"
    allowed_domains: list[str] = []
    start_urls: list[str] = []

    def handlers(self) -> dict[str, Handler]:
        own = {f._node: f for f in (getattr(self, k) for k in dir(self)) if callable(f) and hasattr(f, "_node")}
        return {"index": self.index, **own}

    def item_functions(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        own = {f._item: f for f in (getattr(self, k) for k in dir(self)) if callable(f) and hasattr(f, "_item")}
        return {"item": self.item, **own}

    def index(self, responses: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        return None, None

    def item(self, items: DataFrame) -> DataFrame:
        return items


def dispatch(responses: DataFrame, spider: Spider) -> tuple[DataFrame | None, DataFrame | None]:
    """Every node's rows to its handler, unknown nodes to ``index``."""
    handlers = spider.handlers()
    named = [n for n in handlers if n != "index"]
    requests = items = None
    for name, run in handlers.items():
        own = responses.filter(F.col("node") == name) if name != "index" else responses.filter(~F.col("node").isin(*named)) if named else responses
        r, i = run(own)
        requests = r if requests is None else requests if r is None else requests.unionByName(r)
        items = i if items is None else items if i is None else items.unionByName(i)
    return requests, items


@dataclass(frozen=True)
class Spec:
    """A middleware of a hook; a later one of the same name and key replaces it, ``skip`` removes it."""

    hook: str
    name: str
    run: Middleware | None = None
    key: str = ""
    order: int = 100
    skip: bool = False


def resolve(specs: list[Spec], hook: str) -> list[Spec]:
    """What runs at a hook, by order, then declaration."""
    if hook not in HOOKS:
        raise ValueError(f"unknown hook {hook}")
    last: dict[tuple[str, str], tuple[int, Spec]] = {}
    for k, s in enumerate(specs):
        if s.hook == hook:
            at = last[s.name, s.key][0] if (s.name, s.key) in last else k
            last[s.name, s.key] = (at, s)
    return [s for _, s in sorted(((k, s) for k, s in last.values() if not s.skip), key=lambda x: (x[1].order, x[0]))]


IDENTITY = ("id", "task_id", "trace_id", "node")


def apply(rows: DataFrame, specs: list[Spec], hook: str) -> tuple[DataFrame, DataFrame | None]:
    """H6, H7: rows through a hook's middleware; what they skip comes with ``outcome``; identity may not change."""
    held = [c for c in IDENTITY if c in rows.columns]
    skipped = None
    for s in resolve(specs, hook):
        before = rows
        rows, out = s.run(rows)
        if set(held) - set(rows.columns):
            raise ValueError(f"middleware {s.name} dropped {sorted(set(held) - set(rows.columns))}")
        if held:
            known = before.select(*held).withColumn("_known", F.lit(True)).distinct()
            guarded = rows.join(known, held, "left")
            ok = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.lit(f"middleware {s.name} changed a row's identity")).cast("boolean"))
            rows = guarded.filter(ok).select(*rows.columns)
        if out is not None:
            out = out.withColumn("outcome", F.lit(s.name))
            skipped = out if skipped is None else skipped.unionByName(out, allowMissingColumns=True)
    return rows, skipped


_SQL = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}


def schema_of(item: type) -> T.StructType:
    """H4: the columns of a typed item (a dataclass)."""
    if not is_dataclass(item):
        raise TypeError("an item is a dataclass")
    hints = {f.name: f.type if isinstance(f.type, type) else {"str": str, "int": int, "float": float, "bool": bool}.get(str(f.type), str) for f in fields(item)}
    return T.StructType([T.StructField(n, _SQL.get(t, T.StringType())) for n, t in hints.items()])


@dataclass(frozen=True)
class Settings:
    """How a run deduplicates, retries and paces its requests.

    ``ttl_ms``: how long a fingerprint is held (-1 for ever, 0 not at all); rows with
    ``dont_filter`` neither ask nor leave one.  ``backoff_ms``, ``attempts``: the tries after the
    first.  ``interval_ms``: time between two requests to a host.  ``item_keys``: JSON paths by
    whose values items are deduplicated.  ``round_ms``: what the clock shows in a round.
    """

    ttl_ms: int = stateful.PERMANENT
    drop_query: tuple[str, ...] = ()
    backoff_ms: tuple[int, ...] = (1000,)
    attempts: int = 0
    interval_ms: int = 0
    item_keys: tuple[str, ...] = ()
    round_ms: Callable[[int], int] = lambda k: 1000 * k


@dataclass(frozen=True)
class Run:
    """What a run leaves: admitted requests (with ``slot_ms``), valid items, rejected ones, and six counters a node, items under ``items``."""

    requests: DataFrame
    items: DataFrame
    rejected: DataFrame
    stats: DataFrame


#: Name that the counters of items stand under; no node may have it.
ITEMS = "items"


class Engine:
    """H8: the run loop over captured responses; downloader, rules or spider, AI, store and middleware are what is passed in.

    A round takes new requests through address and domain checks, ``before_scheduler``
    middleware, deduplication and ``after_scheduler``; paces, fetches and retries them;
    drops responses by status; and hands the others to the rules or the spider's
    handlers.  Their requests are the next round, until none is admitted.  Items go
    through item functions, ``before_item`` middleware, deduplication and the schema.
    Every table that is read twice is written to the shared folder first.
    """

    def __init__(
        self, config: Config | None, fetch: Callable[[DataFrame], DataFrame], ai: AiProvider | None = None, store: Callable[[DataFrame], None] | None = None,
        spider: Spider | None = None, middleware: tuple[Spec, ...] = (), settings: Settings | None = None,
    ) -> None:
        if config is None and spider is None:
            raise ValueError("an engine needs rules or a spider")
        self.config, self.fetch, self.ai, self.store, self.spider = config, fetch, ai, store, spider
        self.middleware, self.settings = list(middleware), settings or Settings()
        self.domains = list(config.allowed_domains if config is not None else spider.allowed_domains)

    def run(self, seeds: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Admitted requests, valid items and rejected items of a run."""
        out = self.crawl(seeds, max_rounds=max_rounds)
        return out.requests, out.items, out.rejected

    def crawl(self, seeds: DataFrame, stats: DataFrame | None = None, max_rounds: int = 100) -> Run:
        """A whole run; ``stats`` are counters so far, to which the run's are added."""
        flagged = seeds if "dont_filter" in seeds.columns else seeds.withColumn("dont_filter", F.lit(False))
        now = frontier.written(self._paced(flagged.withColumns({"round": F.lit(0), "fingerprint": F.lit(None).cast("string"), "until_ms": F.lit(None).cast("long")}), 0), "round")
        rounds, items, outcomes = [now], [], []
        for k in range(1, max_rounds + 1):
            found, made, ended = self._round(now)
            items.append(made)
            outcomes.append(ended)
            admitted, skipped = self._admit(found, rounds, k)
            outcomes.append(skipped)
            now = frontier.written(self._paced(admitted, k).select(*rounds[0].columns), "round")
            if now.limit(1).isEmpty():
                break
            rounds.append(now)
        else:
            raise RuntimeError(f"the frontier did not settle in {max_rounds} rounds")
        good, bad, ended = self._items(reduce(DataFrame.unionByName, items))
        counted = frontier.count(reduce(DataFrame.unionByName, [*outcomes, ended]))
        total = frontier.written(counted if stats is None else frontier.merge_stats(stats, counted), "stats")
        self._hook(total, "on_close")
        return Run(reduce(DataFrame.unionByName, rounds), good, bad, total)

    # ------------------------------------------------------------------ requests

    def _hook(self, rows: DataFrame, hook: str, admitted: bool = False, name: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Rows that pass a hook, and the outcomes of those that its middleware skips."""
        if not resolve(self.middleware, hook):
            return rows, None
        kept, skipped = apply(rows, self.middleware, hook)
        return kept, None if skipped is None else _outcomes(skipped, skipped["outcome"], admitted, name)

    def _paced(self, rows: DataFrame, k: int) -> DataFrame:
        """L1: when each request may start."""
        at = rows.withColumn("arrival_ms", F.lit(self.settings.round_ms(k)).cast("long"))
        if not self.settings.interval_ms:
            return at.withColumnRenamed("arrival_ms", "slot_ms")
        at = at.withColumn("_host", urls.host_of(F.col("url")))
        return stateful.rate_limit(at, ["_host"], "arrival_ms", ["id"], self.settings.interval_ms).withColumnRenamed("slot", "slot_ms").drop("_host", "arrival_ms")

    def _admit(self, found: DataFrame, rounds: list[DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
        """New requests that may run, and the outcomes of the others."""
        s, time = self.settings, self.settings.round_ms(k)
        print_ = F.sha2(F.concat_ws("\n", "task_id", "node", urls.canonical_column(F.col("url"), list(s.drop_query))), 256)
        rows = frontier.with_ids(found)
        if "dont_filter" not in rows.columns:
            rows = rows.withColumn("dont_filter", F.coalesce(F.get_json_object("transport", "$.dont_filter") == "true", F.lit(False)))
        held = F.lit((1 << 63) - 1 if s.ttl_ms < 0 else time + s.ttl_ms)
        stored = ~F.col("dont_filter") & F.lit(s.ttl_ms != stateful.DISABLED)
        rows = rows.withColumns({"round": F.lit(k), "fingerprint": F.when(stored, print_), "until_ms": F.when(stored, held.cast("long"))})
        rows = frontier.written(rows, "found")
        sound = F.coalesce(urls.http_valid(F.col("url")) & urls.host_allowed(F.col("url"), self.domains), F.lit(False))
        outcomes = [_outcomes(rows.filter(~sound), F.lit("filter"))]
        live, skipped = self._hook(rows.filter(sound), "before_scheduler")
        outcomes += [] if skipped is None else [skipped]
        asking, free = live.filter("fingerprint IS NOT NULL"), live.filter("fingerprint IS NULL")
        first = stateful.first_by(asking, ["fingerprint"], F.struct("parent", "edge", "idx", "id"))
        known = reduce(DataFrame.unionByName, [r.filter(F.col("until_ms") > time).select("fingerprint") for r in rounds])
        admitted = frontier.written(first.join(known, "fingerprint", "left_anti").select(*live.columns).unionByName(free), "admitted")
        outcomes.append(_outcomes(asking.join(admitted.select("id"), "id", "left_anti"), F.lit("dedup")))
        admitted, skipped = self._hook(admitted, "after_scheduler", True)
        outcomes += [] if skipped is None else [skipped]
        return admitted, reduce(DataFrame.unionByName, outcomes)

    def _fetched(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Responses, and the requests whose tries are used up; the tries are those of the settings."""
        s, left, done = self.settings, rows, []
        for attempt in range(s.attempts + 1):
            wait = sum(s.backoff_ms[min(k, len(s.backoff_ms) - 1)] for k in range(attempt))
            got = frontier.written(self.fetch(left.withColumns({"attempt": F.lit(attempt), "slot_ms": F.col("slot_ms") + wait})), "responses")
            bad = F.coalesce((F.col("status") >= 500) | F.col("status").isin(0, 408, 429), F.lit(True))
            done.append(got.filter(~bad))
            failed = got.filter(bad)
            left = left.join(failed.select(F.col("request_id").alias("id")).distinct(), "id", "left_semi").select(*rows.columns)
            if attempt < s.attempts and failed.limit(1).isEmpty():
                break
        return reduce(DataFrame.unionByName, done), failed

    def _round(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What the admitted requests of a round emit, and how they end."""
        outcomes: list[DataFrame] = []

        def passed(table: DataFrame, hook: str) -> DataFrame:
            kept, skipped = self._hook(table, hook, True)
            outcomes.extend([] if skipped is None else [skipped])
            return kept

        responses, failed = self._fetched(passed(rows, "before_download"))
        self._hook(failed, "on_error")
        outcomes.append(_outcomes(failed, F.lit("download"), True))
        responses = passed(responses, "after_download")
        outcomes.append(_outcomes(responses.filter(~extract.response_kept(F.col("status"))), F.lit("filter"), True))
        responses = passed(responses.filter(extract.response_kept(F.col("status"))), "before_parse")
        if self.spider is None:
            emitted = frontier.written(extract.run_all(responses, self.config, self.ai), "emitted")
            broken = emitted.filter("error IS NOT NULL")
            self._hook(broken, "on_error")
            outcomes.append(_outcomes(broken, F.lit("failed"), True))
            sound = passed(emitted.filter("error IS NULL"), "after_parse")
            outcomes.append(_outcomes(sound, F.lit("done"), True))
            return extract.emitted_requests(sound), extract.emitted_items(sound), reduce(DataFrame.unionByName, outcomes)
        parsed = frontier.written(responses, "parsed")
        requests, items = dispatch(parsed, self.spider)
        outcomes.append(_outcomes(passed(parsed, "after_parse"), F.lit("done"), True))
        requests = rows.limit(0).drop("round", "fingerprint", "until_ms", "slot_ms", "id", "dont_filter") if requests is None else requests
        items = self._none(rows) if items is None else items
        return frontier.written(requests, "requests"), frontier.written(items, "items"), reduce(DataFrame.unionByName, outcomes)

    # --------------------------------------------------------------------- items

    @staticmethod
    def _none(rows: DataFrame) -> DataFrame:
        return rows.sparkSession.createDataFrame([], "id string, task_id string, trace_id string, request_id string, node string, edge int, idx int, fn string, data string")

    def _items(self, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Valid items, rejected ones and outcomes under ``items``."""
        outcomes: list[DataFrame] = []
        if self.spider is not None:
            functions = self.spider.item_functions()
            named = [n for n in functions if n != "item"]
            parts = [functions[n](items.filter(F.col("fn") == n)) for n in named]
            items = reduce(DataFrame.unionByName, [functions["item"](items.filter(~F.coalesce(F.col("fn").isin(*named), F.lit(False)) if named else F.lit(True))), *parts])
        items = frontier.written(items, "items")
        live, skipped = self._hook(items, "before_item", name=F.lit(ITEMS))
        outcomes += [] if skipped is None else [skipped]
        if self.settings.item_keys:
            key = stateful.fingerprint(*[F.get_json_object("data", p) for p in self.settings.item_keys])
            every = live.withColumn("_key", key)
            live = frontier.written(stateful.first_by(every, ["_key"], F.struct("request_id", "edge", "idx", "id")), "unique")
            outcomes.append(_outcomes(every.join(live.select("id", "_key"), ["id", "_key"], "left_anti"), F.lit("dedup"), name=F.lit(ITEMS)))
            live = live.drop("_key")
        schema = self.config.schema if self.config is not None else None
        good, bad = validate.split_items(live, schema or {})
        outcomes += [_outcomes(bad, F.lit("validate"), name=F.lit(ITEMS)), _outcomes(good, F.lit("done"), True, F.lit(ITEMS))]
        if self.store is not None:
            self.store(good)
        self._hook(good, "after_item")
        return good, bad, reduce(DataFrame.unionByName, outcomes)


def _outcomes(rows: DataFrame, outcome: Column, admitted: bool = False, name: Column | None = None) -> DataFrame:
    return rows.select("trace_id", (F.col("node") if name is None else name).alias("name"), outcome.alias("outcome"), F.lit(admitted).alias("admitted"))
