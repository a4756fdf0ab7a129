import pytest
from pyspark.sql import functions as F

from loomspark.functions.values import dumps
from loomspark.operators import extract, frontier, stateful, validate
from loomspark.plans.config import Config
from loomspark.sources import readers
from loomspark.spider import Engine, Settings, Spec, Spider, apply, dispatch, node, resolve
from loomspark.streaming import streams

REQ = "id string, mode string, priority int, sequence long, next_time long, state tinyint, version long, leased_by string, lease_time long, retry_count int, max_retry_count int, ack_version long"


def queue(spark, rows):
    return spark.createDataFrame([(i, m, p, s, t, 0, 0, None, None, 0, 2, None) for i, m, p, s, t in rows], REQ)


@pytest.fixture()
def some(spark):
    return queue(spark, [("a", "http", 1, 1, 0), ("b", "http", 5, 2, 0), ("c", "browser", 9, 3, 0), ("d", "http", 5, 4, 0), ("e", "http", 9, 5, 100)])


def ids(df):
    return [r["id"] for r in df.collect()]


def test_claim_order_delay_capability_exclusion(spark, some):
    failed = spark.createDataFrame([("d", "w")], "request_id string, worker_id string")
    got = frontier.claim(some, failed, "w", ["http"], 9, 50)
    assert ids(got) == ["b", "a"]
    assert ids(frontier.claim(some, failed, "v", ["http", "browser"], 2, 100)) == ["c", "e"]


def test_settlement(spark, some):
    none = spark.createDataFrame([], "request_id string, worker_id string")
    took = frontier.claim(some, none, "w", ["http"], 2, 50)
    now = frontier.applied(some, took)
    assert {r["id"]: r["state"] for r in now.collect()} == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0}
    done, refused = frontier.succeed(now, spark.createDataFrame([("b", 1, "w"), ("d", 9, "w")], "id string, version long, worker string"), 60)
    assert {r["id"]: r["state"] for r in done.filter("id IN ('b', 'd')").collect()} == {"b": 2, "d": 1} and ids(refused) == ["d"]
    mine = took.select("id", "version", F.col("leased_by").alias("worker"))
    late, refused = frontier.succeed(now, mine, 50 + frontier.LEASE_MS)
    assert late.filter("state = 2").isEmpty() and sorted(ids(refused)) == ["b", "d"]
    _, refused = frontier.succeed(now, mine.withColumn("worker", F.lit("other")), 60)
    assert sorted(ids(refused)) == ["b", "d"]
    once, out, _ = frontier.fail(now, mine.filter("id = 'd'"), 60, 100)
    d = once.filter("id = 'd'").first()
    assert (d["state"], d["retry_count"], d["sequence"]) == (0, 1, 100) and out.collect() == [("d", 0, "w")]
    spent, _, _ = frontier.fail(now.withColumn("retry_count", F.lit(1)), mine, 60, 100)
    assert {r["state"] for r in spent.filter("id IN ('b', 'd')").collect()} == {3}
    back = frontier.release(now, took.select("id", "version"), 100)
    assert [(r["id"], r["retry_count"]) for r in back.filter("sequence >= 100").orderBy("sequence").collect()] == [("b", 0), ("d", 0)]
    acked = frontier.ack(now, took.select("id", "version"))
    assert frontier.refresh(acked, took.select("id", "version"), 60).filter("lease_time = 60").count() == 2
    assert frontier.refresh(now, took.select("id", "version"), 60).filter("lease_time = 60").count() == 0
    assert frontier.has_pending(now, ["http"]) and not frontier.has_pending(now.filter("state > 1"), ["http"])


def test_push_is_idempotent_and_checks(spark, some):
    new = queue(spark, [("a", "http", 1, 1, 0), ("z", "http", 0, 9, 0), ("z", "http", 0, 9, 0)])
    assert sorted(ids(frontier.push(some, new, ["id", "priority"]))) == ["a", "b", "c", "d", "e", "z"]
    with pytest.raises(Exception, match="differs"):
        frontier.push(some, queue(spark, [("a", "http", 2, 1, 0)]), ["id", "priority"]).collect()
    with pytest.raises(Exception, match="differs"):
        frontier.push(some, queue(spark, [("z", "http", 2, 1, 0), ("z", "http", 3, 1, 0)]), ["id", "priority"]).collect()


def test_ranked_has_no_gaps(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("s"), F.col("id").cast("string").alias("id"))
    got = frontier.ranked(rows, ["s", "id"], "place", 5).collect()
    assert [r["place"] for r in sorted(got, key=lambda r: (r["s"], r["id"]))] == list(range(5, 1005))


def test_workers(spark):
    none = spark.createDataFrame([], "worker_id string, token string, last_heartbeat long, offline_time long")
    w = frontier.register(frontier.register(none, "w", "t1", 5), "w", "t2", 6)
    assert frontier.heartbeat(w, "w", "t1", 9).first()["last_heartbeat"] == 6
    w = frontier.heartbeat(w, "w", "t2", 9)
    assert frontier.online(w, 100).count() == 1 and frontier.online(w, 50_000).count() == 0
    assert frontier.online(frontier.go_offline(w, "w", "t2", 10), 100).count() == 0


def test_ttl_dedup_is_anchored(spark):
    rows = spark.createDataFrame([("k", t) for t in (0, 5, 10, 14, 20)] + [("m", 3)], "k string, t long")
    got = sorted((r["k"], r["t"]) for r in stateful.ttl_dedup(rows, ["k"], "t", [], 10).collect())
    assert got == [("k", 0), ("k", 10), ("k", 20), ("m", 3)]
    assert stateful.ttl_dedup(rows, ["k"], "t", [], 0).count() == 6 and stateful.ttl_dedup(rows, ["k"], "t", [], -1).count() == 2
    assert stateful.retry_schedules([([1, 2], 3), ([9], 1)]) == [1, 2, 2, 9]


def test_rate_limit_over_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(400).select(F.when(F.col("id") % 50 == 0, None).otherwise("k").alias("g"), (F.col("id") * 37 % 1000).alias("t"), "id")
        got = stateful.rate_limit(rows, ["g"], "t", ["id"], 7).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last = {}
    for r in sorted(got, key=lambda r: (r["t"], r["id"])):
        want = max(r["t"], last.get(r["g"], -(10**9)) + 7)
        last[r["g"]] = want
        assert r["slot"] == want
    assert len(got) == 400


def test_schema_split(spark):
    items = spark.createDataFrame([("1", '{"t":"x","n":3}'), ("2", '{"t":"","n":3}'), ("3", '{"t":"x","n":"no"}'), ("4", '{"t":"x","u":"ftp://x"}')], "id string, data string")
    fields = {"t": {"type": "string", "rules": ["required"]}, "n": {"type": "int", "rules": [{"min": 1}]}, "u": {"type": "string", "rules": ["url"]}}
    good, bad = validate.split_items(items, fields)
    assert ids(good) == ["1"] and sorted(ids(bad)) == ["2", "3", "4"]


SITE = {"http://s.org/": "<a href=/a>a</a><a href=/b>b</a><a href=http://other.org/>o</a>", "http://s.org/a": "<h1>A</h1><a href=/b#x>b</a>", "http://s.org/b": "<h1>B</h1><a href=/>home</a>"}
CRAWL = """
spider: {name: s, allowed_domains: [s.org], start: [{node: page, url: {value: "http://s.org/"}}]}
graph:
  nodes: {page: {fields: {links: {default: [], extractors: [{kind: css, expr: "a::attr(href)"}]}, t: {extractors: [{kind: css, expr: "h1::text"}]}}}}
  edges:
    - {from: page, kind: request, request: {node: page, url: {from: $fields.links}}}
    - {from: page, kind: item}
item: {schema: {fields: {t: {type: string, rules: [required]}}}}
"""


def test_engine_crawls_to_a_fixpoint(spark):
    config = Config.from_yaml(CRAWL)
    captured = spark.createDataFrame([(u, 200, b) for u, b in SITE.items()], "url string, status int, body string")
    engine = Engine(config, lambda f: extract.fetch(f, captured))
    requests, good, bad = engine.run(readers.seeds(spark, config, "task", "run"))
    assert sorted(r["url"] for r in requests.collect()) == ["http://s.org/", "http://s.org/", "http://s.org/a", "http://s.org/b"]
    assert sorted(r["item"]["t"] for r in good.collect()) == ["A", "B"] and bad.count() == 2


def test_engine_outcomes(spark):
    config = Config.from_yaml(CRAWL)
    captured = spark.createDataFrame([(u, 200, b) for u, b in SITE.items()], "url string, status int, body string")
    tries = []

    def fetch(rows):
        tries.append(rows.select("attempt").first())
        got = extract.fetch(rows, captured)
        return got.withColumn("status", F.when(F.col("url").endswith("/b"), 503).otherwise(F.col("status")))

    closed, stored = [], []
    skip = Spec("before_scheduler", "own", lambda d: (d.filter("NOT url LIKE '%/a'"), d.filter("url LIKE '%/a'")))
    close = Spec("on_close", "tell", lambda d: (closed.append(d.count()), (d, None))[1])
    engine = Engine(config, fetch, store=lambda d: stored.append(d.count()), middleware=(close,), settings=Settings(attempts=2, backoff_ms=(5,)))
    run = engine.crawl(readers.seeds(spark, config, "task", "run"))
    stats = {r["name"]: r.asDict() for r in run.stats.collect()}
    # the seed and /a end well, /b is down after two more tries; one link leaves the domain, one leads to /b again
    page = stats["page"]
    assert (page["done"], page["download"], page["filter"], page["validate"], page["dedup"]) == (2, 1, 1, 0, 1) and page["total"] == page["done"] + page["download"] + page["filter"] + page["dedup"]
    assert stats["items"]["total"] == 2 and stats["items"]["done"] == 1 and stats["items"]["validate"] == 1
    assert closed == [2] and stored == [1] and run.items.count() == 1
    again = engine.crawl(readers.seeds(spark, config, "task", "run"), run.stats)
    assert {r["name"]: r["total"] for r in again.stats.collect()} == {n: 2 * r["total"] for n, r in stats.items()}
    other = Engine(config, fetch, middleware=(skip,)).crawl(readers.seeds(spark, config, "task", "run"))
    assert {r["name"]: r["filter"] for r in other.stats.collect()}["page"] == 2
    free = Engine(config, fetch, settings=Settings(ttl_ms=0))
    with pytest.raises(RuntimeError, match="settle"):
        free.crawl(readers.seeds(spark, config, "task", "run"), max_rounds=2)


def test_code_mode(spark):
    class S(Spider):
        @node("detail")
        def detail(self, rows):
            return None, rows.select("id", F.upper("body").alias("data"))

        def index(self, rows):
            return rows.select("id"), None

    rows = spark.createDataFrame([("1", "detail", "x"), ("2", "other", "y")], "id string, node string, body string")
    requests, items = dispatch(rows, S())
    assert ids(requests) == ["2"] and items.collect() == [("1", "X")]
    specs = [Spec("before_item", "a", order=200), Spec("before_item", "b"), Spec("before_item", "a", order=50), Spec("before_item", "c", skip=True)]
    assert [s.name for s in resolve(specs, "before_item")] == ["a", "b"]
    keep = Spec("before_item", "half", lambda d: (d.filter("id = '1'"), d.filter("id <> '1'")))
    kept, skipped = apply(rows, [keep], "before_item")
    assert ids(kept) == ["1"] and skipped.first()["outcome"] == "half"
    with pytest.raises(Exception, match="identity"):
        apply(rows, [Spec("before_item", "bad", lambda d: (d.withColumn("id", F.lit("9")), None))], "before_item")[0].collect()


def test_streams(spark, tmp_path):
    spark.createDataFrame([("k", t) for t in (0, 5, 10)], "k string, t long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t long").json(str(tmp_path / "in"))
    for name, df, want in (("ttl", streams.ttl_dedup(stream, ["k"], "t", 10), [0, 10]), ("rate", streams.rate_limit(stream, ["k"], "t", 20).select(F.col("slot").alias("t")), [0, 20, 40])):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r["t"] for r in spark.table(name).collect()) == want
    (tmp_path / "msg").mkdir()
    (tmp_path / "msg" / "a.json").write_text(dumps({"task_id": "t", "trace_id": "r", "params": {"u": "x"}, "priority": 1}))
    seen = []
    streams.load_loop(readers.messages(spark, str(tmp_path / "msg")), seen.append, str(tmp_path / "cp")).awaitTermination()
    assert seen == [{"task_id": "t", "trace_id": "r", "params": {"u": "x"}, "priority": 1}]
