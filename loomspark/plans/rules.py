"""One row through one node: fields, binds, edges.

``NodeProgram`` is built once per task from a checked configuration; selectors,
patterns and paths are compiled then, a body is parsed at most once, and all
extractors of a node share it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from ..functions import dom, healing, jsonpath, media, urls, values
from ..functions.conditions import MISSING, holds
from ..functions.values import RuleError, is_empty
from .config import Config, Edge, Extractor, Field, is_reference

#: ``(prompt, content) -> JSON object``; offline there is none.
AiProvider = Callable[[str, str], dict]
AI_LIMIT = 1 << 20


class Body:
    """A response body, parsed on first use."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._dom: dom.Element | None = None
        self._json: Any = MISSING

    def dom(self) -> dom.Element:
        if self._dom is None:
            self._dom = dom.parse(self.text)
        return self._dom

    def json(self) -> Any:
        if self._json is MISSING:
            try:
                self._json = json.loads(self.text)
            except ValueError as e:
                raise RuleError(f"the body is not JSON: {e}") from e
        return self._json


def extractor(e: Extractor, ai: AiProvider | None) -> Callable[[Body], list]:
    """An extractor's values in document order."""
    if e.kind == "css":
        selector, kind, attribute = dom.split_output(e.expr)

        def css(b: Body) -> list:
            found = healing.find(b.dom(), selector, e.healing, e.minimum)
            return [v for v in (dom.output(x, kind, attribute) for x in found) if not is_empty(v)]

        return css
    if e.kind == "regex":
        pattern = re.compile(e.expr)
        return lambda b: [m[1] if pattern.groups and m[1] is not None else m[0] for m in pattern.finditer(b.text)]
    if e.kind == "json":
        path = jsonpath.compile_path(e.expr)
        return lambda b: path(b.json())

    def ask(b: Body) -> list:
        if ai is None:
            raise RuleError("no AI provider is configured")
        if len(b.text.encode()) > AI_LIMIT or len(e.expr.encode()) > AI_LIMIT:
            raise RuleError("AI body or prompt over 1 MiB")
        answer = ai(e.expr, b.text)
        if not isinstance(answer, dict):
            raise RuleError("the AI answer must be one JSON object")
        return [answer]

    return ask


def collapse(found: list, default: Any) -> Any:
    """None, the value, or the list; a list as default keeps single values in a list."""
    if not found:
        return None
    return found[0] if len(found) == 1 and not isinstance(default, list) else found


def field_value(name: str, f: Field, chain: list[Callable[[Body], list]], body: Body) -> Any:
    """The first extractor with a non-empty result wins; then the default; required fields must end non-empty."""
    value = None
    for run in chain:
        value = collapse(run(body), f.default)
        if not is_empty(value):
            break
    if is_empty(value):
        if f.default is not None:
            value = f.default
        elif f.required:
            raise RuleError(f"required field {name} is missing")
        else:
            value = None
    return value


class Context:
    """The names a row's expressions can see."""

    def __init__(self, request: dict, url: str, status: int) -> None:
        self.request, self.url, self.status = request, url, status
        self.fields: dict[str, Any] = {}
        self.binds: dict[str, Any] = {}
        self.item: Any = MISSING

    def look(self, path: str) -> Any:
        """The value at a path, MISSING if there is none."""
        scope, _, name = path.partition(".")
        if scope == "$response":
            return {"url": self.url, "status": self.status}.get(name, MISSING)
        if scope == "$request":
            return self.request.get(name, MISSING)
        if scope == "$item":
            v = self.item
            for part in name.split(".") if name else []:
                v = v.get(part, MISSING) if isinstance(v, dict) else MISSING
            return v
        return {"$fields": self.fields, "$binds": self.binds, "$vals": self.request["vals"]}[scope].get(name, MISSING)

    def get(self, path: str) -> Any:
        v = self.look(path)
        if v is MISSING:
            if path.startswith(("$vals.", "$item")):
                return None
            raise RuleError(f"undefined value: {path}")
        return v

    def value(self, ref: Any) -> Any:
        if not is_reference(ref):
            return ref
        return self.get(ref["from"]) if "from" in ref else ref["value"]

    def name(self, name: str) -> Any:
        """A template's variable: bare names are binds, then fields, then values."""
        scope, dot, rest = name.partition(".")
        if dot:
            return {"binds": self.binds, "fields": self.fields, "vals": self.request["vals"], "request": self.request, "response": {"url": self.url, "status": self.status}}.get(scope, {}).get(rest)
        for space in (self.binds, self.fields, self.request["vals"]):
            if name in space:
                return space[name]
        return None


class NodeProgram:
    """A node of a configuration, ready to run."""

    def __init__(self, config: Config, name: str, ai: AiProvider | None = None) -> None:
        self.config, self.name, self.node = config, name, config.nodes[name]
        self.chains = {k: [extractor(e, ai) for e in f.extractors] for k, f in self.node.fields.items()}
        self.edges = [(i, e) for i, e in enumerate(config.edges) if e.source == name]

    def fields(self, body: Body) -> dict[str, Any]:
        return {k: field_value(k, f, self.chains[k], body) for k, f in self.node.fields.items()}

    def binds(self, c: Context) -> None:
        for name, b in self.node.binds.items():
            if b.kind == "pipeline":
                v = c.get(b.source)
                for t in b.steps:
                    argument = c.value(t.get("value"))
                    if t["kind"] == "url_join":
                        base = t.get("base_url", "$response.url")
                        argument = c.get(base) if isinstance(base, str) and base.startswith("$") else c.value(base)
                    v = values.transform(v, t["kind"], argument)
            elif b.kind == "template":
                own = {k: c.value(v) for k, v in b.variables.items()}
                v = values.render(b.source, lambda n, own=own: own[n] if n in own else c.name(n))
            else:
                v = c.value(b.source)
            c.binds[name] = v

    def requests(self, k: int, e: Edge, c: Context) -> list[dict]:
        spec = e.request
        found = c.value(spec.url)
        many = isinstance(found, list)
        if found is None:
            return []
        targets = found if many else [found]
        if not all(isinstance(u, str) and u for u in targets):
            raise RuleError("a request url must be a non-empty string or a list of such")
        if not targets:
            return []
        vals = {n: c.value(v) for n, v in spec.vals.items()}
        for n, v in vals.items():
            if isinstance(v, list) and (not many or len(v) != len(targets)):
                raise RuleError(f"value {n} is a list of {len(v)} beside {len(targets) if many else 'a single'} url")
        out = []
        for i, url in enumerate(targets):
            try:
                url = urls.join(c.url, url)
            except urls.UrlError as err:
                raise RuleError(str(err)) from err
            own = {**c.request["vals"], **{n: v[i] if isinstance(v, list) else v for n, v in vals.items()}}
            if many:
                own["idx"] = i + 1
            scope = Context({"url": url, "node": spec.node, "vals": own}, c.url, c.status)
            scope.fields, scope.binds = c.fields, c.binds
            transport = {n: values.render_value(v, scope.name) for n, v in spec.transport.items()}
            priority = spec.priority if spec.priority is not None else self.config.priority or 0
            out.append({"edge": k, "idx": i, "node": spec.node, "url": url, "vals": own, "priority": priority, "transport": transport})
        return out

    def item(self, e: Edge, c: Context) -> dict[str, Any]:
        out = {}
        for name in self.config.schema or {}:
            v = c.binds.get(name, c.fields.get(name))
            if name in e.vals and not is_empty(new := c.value(e.vals[name])):
                v = new
            if v is not None:
                kind = self.node.fields[name].kind if name in self.node.fields else "text"
                out[name] = media.normalize(v, kind, c.url)
        return out

    def run(self, request: dict, url: str, status: int, text: str) -> tuple[list[dict], list[dict]]:
        """Requests and items of one response; ``RuleError`` if the row breaks a rule."""
        c = Context(request, url, status)
        c.fields = self.fields(Body(text))
        self.binds(c)
        requests: list[dict] = []
        items: list[dict] = []
        for k, e in self.edges:
            if not holds(e.when, c.look, c.value):
                continue
            if e.kind == "request":
                requests += self.requests(k, e, c)
                continue
            if items:
                raise RuleError(f"node {self.name} has more than one item edge")
            if e.each is None:
                items.append({"edge": k, "idx": 0, "fn": e.function, "data": self.item(e, c)})
                continue
            many = c.get(e.each)
            if not isinstance(many, list):
                raise RuleError(f"each must be a list: {e.each}")
            for i, one in enumerate(many):
                c.item = one
                items.append({"edge": k, "idx": i, "fn": e.function, "data": self.item(e, c)})
            c.item = MISSING
        return requests, items
