"""URLs: parsing, joining and canonical forms after the WHATWG rules, and native column forms of the common checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, quote, unquote_to_bytes, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default ports and schemes with an authority.
_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_PATH_SAFE = "/%:@!$&'()*+,;=-._~[]|\\"
_QUERY_SAFE = "/%:@!$&()*+,;=-._~?[]|\\^`{}"


class UrlError(ValueError):
    """The text is no absolute URL and no base helps."""


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str
    host: str
    port: str
    path: str
    query: str | None
    fragment: str | None

    def __str__(self) -> str:
        at = f"{self.user}@" if self.user else ""
        port = f":{self.port}" if self.port else ""
        body = f"//{at}{self.host}{port}" if self.scheme in _PORTS or self.host else ""
        return f"{self.scheme}:{body}{self.path}" + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")

    @property
    def origin(self) -> tuple[str, str, str]:
        return self.scheme, self.host, self.port or _PORTS.get(self.scheme, "")


def _cut(text: str) -> tuple[str, str | None, str | None]:
    text, hash_, fragment = text.partition("#")
    text, mark, query = text.partition("?")
    query = quote(query, safe=_QUERY_SAFE) if mark else None
    return text, query, quote(fragment, safe=_QUERY_SAFE + "#") if hash_ else None


def _dots(path: str) -> str:
    """Dot segments resolved, the rest percent-encoded; always absolute."""
    out: list[str] = []
    parts = path.replace("\\", "/").split("/")[1:] if path[:1] in "/\\" and path else path.replace("\\", "/").split("/")
    for k, part in enumerate(parts):
        low, last = part.lower().replace("%2e", "."), k == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(quote(part, safe=_PATH_SAFE.replace("/", "").replace("\\", "")))
    return "/" + "/".join(out)


def _host(text: str) -> str:
    host = unquote_to_bytes(text).decode("utf-8", "replace").lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError as e:
            raise UrlError(f"invalid host: {text}") from e
    if not host or re.search(r"[\x00-\x20#%/:<>?@\\^|]", host.strip("[]") if host.startswith("[") else host) and not host.startswith("["):
        raise UrlError(f"invalid host: {text}")
    return host


def parse(text: str, base: Url | None = None) -> Url:
    """An absolute URL, or one relative to ``base``."""
    text = re.sub(r"[\t\r\n]", "", text.strip("".join(map(chr, range(33)))))
    m = _SCHEME.match(text)
    if m and (scheme := m[1].lower()) in _PORTS:
        rest = text[m.end() :]
        if base is not None and base.scheme == scheme and not rest[:2].replace("\\", "/").startswith("/"):
            return _relative(rest, base)
        return _authority(scheme, rest.lstrip("/\\"))
    if m:
        body, query, fragment = _cut(text[m.end() :])
        return Url(m[1].lower(), "", "", "", body, query, fragment)
    if base is None:
        raise UrlError(f"relative URL without a base: {text}")
    return _relative(text, base)


def _authority(scheme: str, rest: str) -> Url:
    m = re.match(r"[^/\\?#]*", rest)
    path, query, fragment = _cut(rest[m.end() :])
    user, _, host = m[0].rpartition("@")
    name, port = (host, "") if host.endswith("]") else (host.rpartition(":")[0], host.rpartition(":")[2]) if ":" in host else (host, "")
    if port and not port.isdigit() or port and int(port) > 65535:
        raise UrlError(f"invalid port: {port}")
    port = str(int(port)) if port else ""
    return Url(scheme, quote(user, safe=":%-._~!$&'()*+,;="), _host(name), "" if port == _PORTS[scheme] else port, _dots(path or "/"), query, fragment)


def _relative(text: str, base: Url) -> Url:
    head = text[:2].replace("\\", "/")
    if head == "//":
        return _authority(base.scheme, text.lstrip("/\\"))
    path, query, fragment = _cut(text)
    if head[:1] == "/":
        return replace(base, path=_dots(path), query=query, fragment=fragment)
    if not path:
        return replace(base, query=base.query if query is None else query, fragment=fragment)
    return replace(base, path=_dots(base.path.rpartition("/")[0] + "/" + path), query=query, fragment=fragment)


def join(base: str, text: str) -> str:
    return str(parse(text, parse(base)))


def normalize(text: str) -> str:
    return str(parse(text))


def canonical(text: str, drop_query: tuple[str, ...] = (), sort_query: bool = False) -> str:
    """The form that deduplication compares: no fragment, no dropped keys, keys in (stable) order."""
    url = replace(parse(text), fragment=None)
    pairs = [(k, v) for k, v in parse_qsl(url.query or "", keep_blank_values=True) if k not in drop_query]
    if sort_query:
        pairs.sort(key=lambda kv: kv[0])
    return str(replace(url, query=urlencode(pairs, safe="*-._") if pairs else None))


def is_http(text: str) -> bool:
    try:
        url = parse(text)
    except UrlError:
        return False
    return url.scheme in ("http", "https") and bool(url.host)


def allows(domains: list[str], host: str) -> bool:
    """Whether a host is one of the domains or below one; no domains allow all."""
    host = host.lower().rstrip(".")
    return not domains or any(host == d or host.endswith("." + d) for d in (x.lower().rstrip(".") for x in domains))


# ------------------------------------------------------------------- native columns


def http_valid(url: Column) -> Column:
    """F20 without Python: an absolute http(s) URL with a host."""
    return F.coalesce(url.rlike(r"(?i)^\s*https?://[^/?#\s\\]*[^/?#\s\\:@]"), F.lit(False))


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) URL."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("."))


def host_allowed(url: Column, domains: list[str]) -> Column:
    """F19 without Python."""
    if not domains:
        return F.lit(True)
    host, out = host_of(url), F.lit(False)
    for d in (x.lower().rstrip(".") for x in domains):
        out = out | (host == d) | host.endswith("." + d)
    return out


def canonical_column(url: Column, drop_query: list[str] | None = None, sort_query: bool = True) -> Column:
    """F18 without Python for URLs that are already percent-encoded: fragment and dropped keys gone, keys sorted stably."""
    bare = F.regexp_replace(url, r"#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(drop_query or ["\x00"]))
    if sort_query:
        keyed = F.transform(pairs, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), p.alias("p")))
        pairs = F.transform(F.array_sort(keyed), lambda x: x["p"])
    text = F.array_join(pairs, "&")
    return F.concat(F.regexp_replace(bare, r"\?.*$", ""), F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text)))
