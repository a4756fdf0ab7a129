"""What a fetch carries from one request to the next: cookies, inherited headers, redirects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.tables import written
from . import extract

#: Redirects that a fetch follows at most.
MOST_REDIRECTS = 10


def _path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def cookie_headers(requests: DataFrame, jar: DataFrame, now: int) -> DataFrame:
    """``requests(id, url)`` with ``cookie``, the header that ``jar(domain, host_only, path, secure, expires, name, value, created)`` gives.

    A cookie matches its domain and, unless ``host_only``, hosts below it; its path and
    what lies below that; ``secure`` ones https only; none that has expired (null never does).
    Longer paths come first, then older cookies, then names.  Requests without cookies get null.
    Hosts meet the jar by each of their suffixes, so nothing is compared with all cookies.
    """
    labels = F.split(urls.host_of(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = requests.select("id", urls.host_of(F.col("url")).alias("_host"), _path_of(F.col("url")).alias("_path"), F.lower("url").startswith("https:").alias("_tls"), F.explode(suffixes).alias("domain"))
    live = jar.filter(F.col("expires").isNull() | (F.col("expires") > now)).withColumn("domain", F.lower("domain"))
    met = asked.join(live, "domain")
    under = (F.col("_path") == F.col("path")) | (F.col("_path").startswith(F.col("path")) & (F.col("path").endswith("/") | (F.substr("_path", F.length("path") + 1, F.lit(1)) == "/")))
    met = met.filter(under & (~F.col("host_only") | (F.col("_host") == F.col("domain"))) & (~F.col("secure") | F.col("_tls")))
    order = F.struct((-F.length("path")).alias("l"), "created", "name", F.concat("name", F.lit("="), "value").alias("pair"))
    header = met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["pair"]), "; ").alias("cookie"))
    return requests.join(header, "id", "left").select(*requests.columns, "cookie")


def origin(url: Column) -> Column:
    """Scheme, host and port of an http(s) URL, the port in full."""
    scheme, port = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1)), F.regexp_extract(url, r"(?i)^https?://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    return F.concat(scheme, F.lit("://"), urls.host_of(url), F.lit(":"), F.when(port != "", port).when(scheme == "https", "443").otherwise("80"))


def followed(parent_url: Column, url: Column, headers: Column) -> Column:
    """a parent's headers for a request of the same origin, else none."""
    return F.when(origin(parent_url) == origin(url), headers)


def follow_redirects(requests: DataFrame, captured: DataFrame, allowed: list[str] | None = None, most: int = MOST_REDIRECTS) -> DataFrame:
    """``requests(id, url, method)`` to their ends over ``captured(url, status, location, body)``, a join a hop.

    Every hop is checked against the allowed domains; a redirect to elsewhere, and one
    over ``most``, ends with ``error``.  What was never captured has status 404.  The
    captured table holds a row per canonical URL; locations are absolute.  Returns
    ``id, url, method, status, body, hops, error``.
    """
    key = urls.canonical_column
    seen = captured.select(key(F.col("url")).alias("_key"), "status", "location")
    now = requests.select("id", "url", "method", F.lit(0).alias("hops"))
    ended = []
    for hop in range(most + 1):
        got = now.withColumn("_key", key(F.col("url"))).join(seen, "_key", "left")
        on = F.coalesce(extract.is_redirect(F.col("status")) & F.col("location").isNotNull(), F.lit(False))
        inside = F.coalesce(urls.http_valid(F.col("location")) & urls.host_allowed(F.col("location"), allowed or []), F.lit(False))
        error = F.when(on & ~inside, "redirect leaves the allowed domains").when(on & F.lit(hop == most), "too many redirects")
        got = written(got.select("id", "url", "method", "_key", F.coalesce("status", F.lit(404)).cast("int").alias("status"), "location", "hops", error.alias("error"), on.alias("_on")), "hop")
        ended.append(got.filter("NOT _on OR error IS NOT NULL"))
        moving = got.filter("_on AND error IS NULL")
        if hop == most or moving.limit(1).isEmpty():
            break
        now = moving.select("id", F.col("location").alias("url"), extract.redirect_method(F.col("status"), F.col("method")).alias("method"), (F.col("hops") + 1).alias("hops"))
    last = reduce(DataFrame.unionByName, ended)
    body = captured.select(key(F.col("url")).alias("_key"), "body")
    return last.join(body, "_key", "left").select("id", "url", "method", "status", F.when(F.col("error").isNull(), F.col("body")).alias("body"), "hops", "error")
