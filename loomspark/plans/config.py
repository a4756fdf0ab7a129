"""Rule files: a closed-world model of the YAML and every check that needs no data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..functions import dom, jsonpath, urls, values
from ..functions.conditions import OPERATORS

TRANSFORMS = ("trim", "normalize_space", "lowercase", "uppercase", "url_join", "url_normalize", "add")
KINDS = ("text", "image", "video", "audio")
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS")
#: Counter name that no node may take.
RESERVED = "items"


class ConfigError(ValueError):
    """A rule file is malformed; the message names the place."""


@dataclass(frozen=True)
class Extractor:
    kind: str
    expr: str
    healing: bool = False
    minimum: float = 0.8


@dataclass(frozen=True)
class Field:
    kind: str = "text"
    download: bool = False
    required: bool = False
    default: Any = None
    extractors: tuple[Extractor, ...] = ()


@dataclass(frozen=True)
class Bind:
    kind: str
    source: Any = None  # a path for pipelines, a template text for templates, a value reference for values
    steps: tuple[dict, ...] = ()
    variables: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Node:
    fields: dict[str, Field]
    binds: dict[str, Bind]
    allowed_domains: tuple[str, ...] | None = None
    middlewares: tuple[dict, ...] = ()
    label: str | None = None


@dataclass(frozen=True)
class RequestSpec:
    node: str
    url: Any
    vals: dict[str, Any]
    priority: int | None
    transport: dict[str, Any]


@dataclass(frozen=True)
class Edge:
    source: str
    kind: str
    request: RequestSpec | None
    each: str | None
    vals: dict[str, Any]
    when: dict | None
    function: str


@dataclass(frozen=True)
class Config:
    name: str
    topic: str
    priority: int | None
    allowed_domains: tuple[str, ...]
    start: tuple[RequestSpec, ...]
    nodes: dict[str, Node]
    edges: tuple[Edge, ...]
    schema: dict[str, dict] | None
    spider: dict[str, Any]

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls.from_yaml(Path(path).read_text(encoding="utf-8"))

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ConfigError(f"not YAML: {e}") from e
        return _config(raw)

    def initial_requests(self, task_id: str, trace_id: str, vals: dict[str, Any] | None = None) -> list[dict]:
        """The seed rows of a run; the topic rides along in their values."""
        vals, out = vals or {}, []
        for spec in self.start:
            def at(ref: Any) -> Any:
                if not is_reference(ref):
                    return ref
                if "value" in ref:
                    return ref["value"]
                name = ref["from"].removeprefix("$vals.")
                if name == ref["from"] or name not in vals:
                    raise ConfigError(f"undefined start value: {ref['from']}")
                return vals[name]

            url = at(spec.url)
            if not isinstance(url, str) or not url:
                raise ConfigError("a start url must be a non-empty string")
            own = {**vals, "topic": self.topic, **{k: at(v) for k, v in spec.vals.items()}}
            scope = {"request.url": url, "request.node": spec.node, **own, **{f"vals.{k}": v for k, v in own.items()}}
            transport = {k: values.render_value(v, scope.get) for k, v in spec.transport.items()}
            priority = spec.priority if spec.priority is not None else self.priority or 0
            out.append({"task_id": task_id, "trace_id": trace_id, "node": spec.node, "url": url, "vals": own, "priority": priority, "transport": transport})
        return out


def is_reference(v: Any) -> bool:
    return isinstance(v, dict) and ("from" in v or "value" in v)


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _keys(raw: Any, allowed: str, where: str) -> dict:
    _need(isinstance(raw, dict), f"{where} must be a mapping")
    unknown = set(raw) - set(allowed.split())
    _need(not unknown, f"{where}: unknown field {sorted(map(str, unknown))}")
    return raw


def _config(raw: Any) -> Config:
    raw = _keys(raw, "spider graph item", "config")
    spider = _keys(raw.get("spider"), "name topic version priority allowed_domains start timezone login attachment middlewares", "spider")
    graph = _keys(raw.get("graph") or {}, "nodes edges", "graph")
    name = spider.get("name")
    _need(isinstance(name, str) and name.strip(), "spider.name must not be empty")
    nodes = {str(k): _node(str(k), v or {}) for k, v in (graph.get("nodes") or {}).items()}
    _need(nodes, "graph.nodes must not be empty")
    _need(RESERVED not in nodes, f"node name {RESERVED!r} is reserved")
    start = tuple(_request(s, f"spider.start[{k}]") for k, s in enumerate(spider.get("start") or []))
    schema = None
    if raw.get("item") is not None:
        item = _keys(raw["item"], "schema middlewares", "item")
        fields = _keys(item.get("schema") or {}, "fields", "item.schema").get("fields") or {}
        schema = {k: _schema_field(v or {}, f"item.schema.fields.{k}") for k, v in fields.items()}
        _need(schema, "item.schema.fields must not be empty")
    edges = tuple(_edge(e, k, nodes, schema) for k, e in enumerate(graph.get("edges") or []))
    for s in start:
        _need(s.node in nodes, f"spider.start: node {s.node!r} does not exist")
    for n in nodes:
        _need(sum(e.source == n and e.kind == "item" and e.when is None for e in edges) <= 1, f"node {n!r} has more than one item edge")
    return Config(name, spider.get("topic") or name, spider.get("priority"), tuple(spider.get("allowed_domains") or ()), start, nodes, edges, schema, spider)


def _schema_field(raw: Any, where: str) -> dict:
    raw = _keys(raw, "type rules fields", where)
    _need(raw.get("type", "string") in ("string", "int", "float", "bool", "array", "object"), f"{where}: unknown type {raw.get('type')!r}")
    for rule in raw.get("rules") or []:
        key = rule if isinstance(rule, str) else next(iter(rule), None) if isinstance(rule, dict) and len(rule) == 1 else None
        _need(key in ("required", "min", "max", "len", "url"), f"{where}: unknown rule {rule!r}")
    return raw


def _node(name: str, raw: Any) -> Node:
    raw = _keys(raw, "label allowed_domains fields binds middlewares", f"node {name}")
    fields = {k: _field(f"node {name}.fields.{k}", v or {}) for k, v in (raw.get("fields") or {}).items()}
    binds: dict[str, Bind] = {}
    for k, v in (raw.get("binds") or {}).items():
        binds[k] = _bind(f"node {name}.binds.{k}", v, fields, list(binds))
    domains = raw.get("allowed_domains")
    return Node(fields, binds, None if domains is None else tuple(domains), tuple(raw.get("middlewares") or ()), raw.get("label"))


def _field(where: str, raw: Any) -> Field:
    raw = _keys(raw, "kind download required default extractors", where)
    _need(raw.get("kind", "text") in KINDS, f"{where}: unknown kind {raw.get('kind')!r}")
    out = []
    for e in raw.get("extractors") or []:
        e = _keys(e, "kind expr args", f"{where}.extractors")
        kind, expr = e.get("kind"), e.get("expr")
        _need(isinstance(expr, str) and expr.strip(), f"{where}: an extractor needs expr")
        args = e.get("args") or {}
        try:
            if kind == "css":
                selector, _, _ = dom.split_output(expr)
                dom.compile_selector(selector)
                healing = _keys(args, "healing", where).get("healing")
                on = healing is not None and healing is not False
                minimum = float(healing.get("min", 0.8)) if isinstance(healing, dict) else 0.8
                _need(0 <= minimum <= 1, f"{where}: healing.min must lie between 0 and 1")
                out.append(Extractor("css", expr, on, minimum))
                continue
            _need(not args, f"{where}: only css extractors take args")
            if kind == "regex":
                _need(not re.search(r"\(\?(<?[=!])|\\[1-9]", expr), f"{where}: look-around and back-references are not supported")
                re.compile(expr)
            elif kind == "json":
                jsonpath.compile_path(expr)
            else:
                _need(kind == "ai", f"{where}: unknown extractor {kind!r}")
        except (dom.SelectorError, re.error, jsonpath.PathError) as e2:
            raise ConfigError(f"{where}: {e2}") from e2
        out.append(Extractor(kind, expr))
    _need(out or not raw.get("required"), f"{where}: a required field needs an extractor")
    return Field(raw.get("kind", "text"), bool(raw.get("download")), bool(raw.get("required")), raw.get("default"), tuple(out))


def _path(path: Any, where: str, fields: dict, binds: list[str], item: bool = False) -> str:
    _need(isinstance(path, str), f"{where}: a reference must be text")
    scope, _, name = path.partition(".")
    if scope == "$fields":
        ok = name in fields
    elif scope == "$binds":
        ok = name in binds
    elif scope == "$response":
        ok = name in ("url", "status")
    elif scope == "$request":
        ok = name in ("url", "node")
    else:
        ok = scope == "$vals" and bool(name) or scope == "$item" and item
    _need(ok, f"{where}: undefined reference {path}")
    return path


def _ref(v: Any, where: str, fields: dict, binds: list[str], item: bool = False) -> Any:
    if is_reference(v):
        _keys(v, "from value", where)
        _need(("from" in v) != ("value" in v), f"{where}: either from or value")
        if "from" in v:
            _path(v["from"], where, fields, binds, item)
    return v


def _bind(where: str, raw: Any, fields: dict, earlier: list[str]) -> Bind:
    raw = _keys(raw, "kind from transforms template vars value", where)
    kind = raw.get("kind")
    if kind == "pipeline":
        source = _path(raw.get("from"), where, fields, earlier)
        steps = []
        for t in raw.get("transforms") or []:
            t = {"kind": t} if isinstance(t, str) else _keys(t, "kind base_url value", where)
            _need(t.get("kind") in TRANSFORMS, f"{where}: unknown transform {t.get('kind')!r}")
            _need(t["kind"] != "add" or "value" in t, f"{where}: add needs value")
            if isinstance(t.get("base_url"), str) and t["base_url"].startswith("$"):
                _path(t["base_url"], where, fields, earlier)
            _ref(t.get("value"), where, fields, earlier)
            steps.append(t)
        return Bind("pipeline", source, tuple(steps))
    if kind == "template":
        text = raw.get("template")
        _need(isinstance(text, str), f"{where}: a template needs text")
        names = raw.get("vars") or {}
        try:
            for named, part in values.template_parts(text):
                _need(not named or part in names, f"{where}: undefined variable {part}")
        except values.RuleError as e:
            raise ConfigError(f"{where}: {e}") from e
        return Bind("template", text, (), {k: _ref(v, where, fields, earlier) for k, v in names.items()})
    _need(kind == "value", f"{where}: unknown bind {kind!r}")
    return Bind("value", _ref(raw.get("value"), where, fields, earlier))


_TRANSPORT = "method headers cookies body timeout proxy tls mode retry max_retry_count dont_filter scroll wait login body_limit middlewares"


def _request(raw: Any, where: str) -> RequestSpec:
    raw = _keys(raw, f"node url vals priority {_TRANSPORT}", where)
    _need(isinstance(raw.get("node"), str), f"{where}: node is missing")
    _need("url" in raw, f"{where}: url is missing")
    _need(str(raw.get("method", "GET")).upper() in METHODS, f"{where}: unknown method {raw.get('method')!r}")
    _need(raw.get("mode", "http") in ("http", "browser"), f"{where}: unknown mode {raw.get('mode')!r}")
    return RequestSpec(raw["node"], raw["url"], raw.get("vals") or {}, raw.get("priority"), {k: raw[k] for k in _TRANSPORT.split() if k in raw})


def _condition(c: Any, where: str, fields: dict, binds: list[str]) -> dict:
    _need(isinstance(c, dict), f"{where}: a condition must be a mapping")
    for group in ("all", "any"):
        if group in c:
            _keys(c, group, where)
            _need(isinstance(c[group], list) and c[group], f"{where}: {group} must not be empty")
            return {group: [_condition(x, where, fields, binds) for x in c[group]]}
    c = _keys(c, "from op value", where)
    _path(c.get("from"), where, fields, binds)
    _need(c.get("op") in OPERATORS, f"{where}: unknown operator {c.get('op')!r}")
    _need((c["op"] in ("present", "absent")) == ("value" not in c), f"{where}: {c['op']} {'takes no' if 'value' in c else 'needs a'} value")
    _ref(c.get("value"), where, fields, binds)
    return c


def _edge(raw: Any, k: int, nodes: dict[str, Node], schema: dict | None) -> Edge:
    where = f"graph.edges[{k}]"
    raw = _keys(raw, "from kind each request vals when fn", where)
    source, kind = raw.get("from"), raw.get("kind")
    _need(source in nodes, f"{where}: node {source!r} does not exist")
    node = nodes[source]
    binds = list(node.binds)
    when = None if raw.get("when") is None else _condition(raw["when"], where, node.fields, binds)
    request = None
    if kind == "request":
        _need(raw.get("request") is not None, f"{where}: a request edge needs request")
        _need(raw.get("each") is None and not raw.get("vals") and raw.get("fn") is None, f"{where}: each, vals and fn belong to item edges")
        request = _request(raw["request"], where)
        _need(request.node in nodes, f"{where}: target {request.node!r} does not exist")
        _ref(request.url, where, node.fields, binds)
        for v in request.vals.values():
            _ref(v, where, node.fields, binds)
    else:
        _need(kind == "item", f"{where}: unknown kind {kind!r}")
        _need(raw.get("request") is None, f"{where}: request belongs to request edges")
        _need(schema is not None, f"{where}: an item edge needs the item section")
        if raw.get("each") is not None:
            _path(raw["each"], where, node.fields, binds)
        for name, v in (raw.get("vals") or {}).items():
            _need(name in schema, f"{where}: {name!r} is not in the item schema")
            _ref(v, where, node.fields, binds, item=raw.get("each") is not None)
    return Edge(source, kind, request, raw.get("each"), raw.get("vals") or {}, when, raw.get("fn") or "item")
