import pytest

from loomspark.plans.config import Config, ConfigError
from loomspark.plans.registry import PAGES_YAML
from loomspark.plans.rules import NodeProgram, RuleError

BASE = """
spider: {name: s, start: [{node: list, url: {from: $vals.u}, headers: {x: "{topic}"}}]}
graph:
  nodes:
    list:
      fields:
        links: {default: [], extractors: [{kind: css, expr: "a::attr(href)"}]}
        names: {default: [], extractors: [{kind: css, expr: "a::text"}]}
        rows: {extractors: [{kind: json, expr: "$.rows"}, {kind: regex, expr: "row=(\\\\d+)"}]}
    detail: {fields: {pic: {kind: image, extractors: [{kind: css, expr: img}]}, t: {required: true, extractors: [{kind: css, expr: "h1::text"}]}}}
  edges:
    - {from: list, kind: request, request: {node: detail, url: {from: $fields.links}, vals: {name: {from: $fields.names}}, cookies: {n: "{vals.name}"}}}
    - {from: detail, kind: item, vals: {t: {value: ""}}}
item: {schema: {fields: {t: {type: string}, pic: {type: array}}}}
"""


def test_seed_rows():
    rows = Config.from_yaml(BASE).initial_requests("t", "r", {"u": "http://a.b/"})
    assert rows == [{"task_id": "t", "trace_id": "r", "node": "list", "url": "http://a.b/", "vals": {"u": "http://a.b/", "topic": "s"}, "priority": 0, "transport": {"headers": {"x": "s"}}}]


def test_request_edge_aligns_arrays():
    text = BASE.replace('{kind: json, expr: "$.rows"}, ', "")
    p = NodeProgram(Config.from_yaml(text), "list")
    requests, _ = p.run({"vals": {"k": 1}}, "http://a.b/c/", 200, "<a href=x>X</a><a href=y>Y</a> row=7")
    assert [(r["url"], r["vals"], r["transport"]["cookies"]["n"]) for r in requests] == [
        ("http://a.b/c/x", {"k": 1, "name": "X", "idx": 1}, "X"), ("http://a.b/c/y", {"k": 1, "name": "Y", "idx": 2}, "Y"),
    ]
    with pytest.raises(RuleError, match="list of 1"):
        p.run({"vals": {}}, "http://a.b/", 200, "<a href=x>X</a><a href=y></a>")


def test_item_edge_and_required():
    p = NodeProgram(Config.from_yaml(BASE), "detail")
    _, items = p.run({"vals": {}}, "http://a.b/", 200, "<h1>T</h1><img src=p.png alt=q>")
    assert items[0]["data"]["t"] == "T" and items[0]["data"]["pic"][0]["url"] == "http://a.b/p.png"
    with pytest.raises(RuleError, match="required"):
        p.run({"vals": {}}, "http://a.b/", 200, "<p>")


@pytest.mark.parametrize(
    ("old", "new", "message"),
    [
        ("name: s,", "name: '',", "must not be empty"), ("node: detail", "node: gone", "does not exist"), ("$fields.links}, vals", "$fields.nope}, vals", "undefined reference"), ("kind: css, expr: img", "kind: css, expr: 'img >'", "misplaced"),
        ("kind: css, expr: img", "kind: xpath, expr: img", "unknown extractor"), ("t: {value", "zz: {value", "not in the item schema"), ("kind: image", "kind: hologram", "unknown kind"), ("item: {schema", "items: {schema", "unknown field"),
        ('"$.rows"', '"$.["', "expected"), ("row=", "(?=row)", "look-around"), ("default: [], ", "defaults: [], ", "unknown field"), ("    detail:", "    items: {}\n    detail:", "reserved"),
    ],
)
def test_rejections(old, new, message):
    assert old in BASE
    with pytest.raises(ConfigError, match=message):
        Config.from_yaml(BASE.replace(old, new))


def test_conditions_and_binds():
    p = NodeProgram(Config.from_yaml(PAGES_YAML), "page")
    html = "<html lang=en><nav><a href=/x>x</a></nav><article><h1> A  b </h1></article></html>"
    requests, items = p.run({"vals": {}}, "http://h.c/", 200, html)
    assert items[0]["data"] == {"title": " A  b ", "key": "a b", "lang": "en", "label": "en-200", "url": "http://h.c/"}
    assert [(r["url"], r["priority"]) for r in requests] == [("http://h.c/x", 3)]
    assert p.run({"vals": {}}, "http://h.c/", 200, html.replace("=en", "=fr"))[0] == []


@pytest.mark.parametrize("node", ["fields: {t: {required: true}}", "fields: {t: {extractors: [{kind: css, expr: h1}]}}, binds: {b: {kind: template, template: '{t}'}}"])
def test_static_checks_of_fields_and_templates(node):
    with pytest.raises(ConfigError):
        Config.from_yaml("spider: {name: s}\ngraph: {nodes: {page: {" + node + "}}}")
