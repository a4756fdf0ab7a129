import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomspark.functions import charset, conditions, cron, dom, healing, jsonpath, media, urls, values
from loomspark.sources import sinks


@pytest.mark.parametrize(
    ("base", "text", "want"),
    [
        ("http://EXAMPLE.com/a/b", "c", "http://example.com/a/c"), ("http://e.com/a/b", "../x?y#z", "http://e.com/x?y#z"), ("http://e.com:80/a", "//F.com/q", "http://f.com/q"),
        ("https://e.com/a", "https:b", "https://e.com/b"), ("http://e.com/a/", "./é", "http://e.com/a/%C3%A9"), ("http://e.com/a?x=1", "#f", "http://e.com/a?x=1#f"), ("http://e.com/a", "\\b\\c", "http://e.com/b/c"),
    ],
)
def test_url_join(base, text, want):
    assert urls.join(base, text) == want


def test_url_canonical_and_checks():
    assert urls.canonical("http://E.com/p?b=2&a=1&b=1&utm_source=x#f", ("utm_source",), True) == "http://e.com/p?a=1&b=2&b=1"
    assert urls.is_http("HTTP://a.b/c") and not urls.is_http("ftp://a.b") and not urls.is_http("/x") and not urls.is_http("http://")
    assert urls.allows(["Example.com"], "a.example.COM.") and not urls.allows(["example.com"], "badexample.com") and urls.allows([], "x")


def test_values():
    assert [values.is_empty(v) for v in (None, "", [], {}, 0, False, " ")] == [True, True, True, True, False, False, False]
    assert values.canonical({"b": 1, "a": {"d": 1.0, "c": [2, 1]}}) == '{"a":{"c":[2,1],"d":1.0},"b":1}'
    assert not values.same("2", 2) and not values.same(1, True) and values.same({"a": [1]}, {"a": [1]})
    assert values.transform([" A ", None, ["b  c"]], "normalize_space") == ["A", None, ["b c"]]
    assert values.transform("41", "add", 1) == 42
    with pytest.raises(values.RuleError):
        values.transform((1 << 63) - 1, "add", 1)
    assert values.render("{a}-{b}", {"a": ["x", "y"], "b": 1}.get) == ["x-1", "y-1"]
    assert values.render("{a}", {"a": "{b}", "b": "no"}.get) == "{b}"
    assert values.render("{a}{z}", {"a": 1}.get) is None
    with pytest.raises(values.RuleError):
        values.render("{a}{b}", {"a": [1], "b": [1, 2]}.get)
    assert values.render_value({"k": ["{n}", "x{n}"]}, {"n": 5}.get) == {"k": [5, "x5"]}


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ({"from": "a", "op": "present"}, True), ({"from": "zero", "op": "present"}, True), ({"from": "none", "op": "absent"}, True), ({"from": "none", "op": "ne", "value": 1}, False),
        ({"from": "two", "op": "eq", "value": 2}, False), ({"from": "zero", "op": "lt", "value": 0.5}, True), ({"from": "two", "op": "gt", "value": 1}, False),
        ({"all": [{"from": "a", "op": "present"}, {"any": [{"from": "none", "op": "present"}, {"from": "a", "op": "eq", "value": "x"}]}]}, True),
    ],
)
def test_conditions(condition, want):
    row = {"a": "x", "zero": 0, "two": "2"}
    assert conditions.holds(condition, lambda p: row.get(p, conditions.MISSING), lambda v: v) is want


DOC = {"store": {"book": [{"t": "A", "p": 8, "i": 1}, {"t": "B", "p": 12}, {"t": "C", "p": 9, "i": 2}], "x.y": None}}


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$.store.book[*].t", ["A", "B", "C"]), ("$..p", [8, 12, 9]), ("$.store.book[?@.p < 10].t", ["A", "C"]), ("$.store.book[?@.i && @.p > 8].t", ["C"]), ("$.store.book[-1:].t", ["C"]),
        ("$.store.book[::2].t", ["A", "C"]), ("$.store.book[0,2]['t']", ["A", "C"]), ("$['store'][\"x.y\"]", [None]), ("$.nothing", []), ("$.store.book[?length(@.t) == 1 && match(@.t, '[AB]')].p", [8, 12]),
        ("$.store.book[?!(@.i)].t", ["B"]), ("$.store.book[?@.i == $.store.book[0].i].t", ["A"]), ("$.store.book[?count(@.*) == 2].t", ["B"]), ("$", [DOC]),
    ],
)
def test_jsonpath(path, want):
    assert jsonpath.compile_path(path)(DOC) == want


@pytest.mark.parametrize("path", ["", "store", "$.", "$[", "$[01]", "$[?@.a ==]", "$.a b", "$['a]"])
def test_jsonpath_rejects(path):
    with pytest.raises(jsonpath.PathError):
        jsonpath.compile_path(path)


PAGE = """<div id=main class="box wide"><h1>One</h1><p>a<p>b <b>c</b><ul><li>x<li class=on data-k="v-1">y</ul><img src=i.png></div><div><p>last</p></div>"""


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("p", ["a", "b c", "last"]), ("#main > p", ["a", "b c"]), ("div.box.wide h1", ["One"]), ("h1 + p", ["a"]), ("h1 ~ p", ["a", "b c"]), ("li:not(.on)", ["x"]), ("li:nth-child(2n)", ["y"]), ("li:last-child, h1", ["One", "y"]),
        ("[data-k|=v]", ["y"]), ("[class~=wide] b", ["c"]), ("[src$='.png']", [""]), ("p:first-of-type", ["a", "last"]), ("div:nth-of-type(2) p", ["last"]), ("img:empty", [""]), ("*:root", [dom.parse(PAGE).elements[0].text(), "last"]),
    ],
)
def test_css(selector, want):
    assert [e.text() for e in dom.select(dom.parse(PAGE), selector)] == want


@pytest.mark.parametrize("selector", ["", "p >", "> p", "p:is(a)", "p::", "[a", "p:nth-child(x)", "a,,b"])
def test_css_rejects(selector):
    with pytest.raises(dom.SelectorError):
        dom.compile_selector(selector)


def test_css_outputs():
    assert dom.split_output('a[href="x::text"]::attr(href)') == ('a[href="x::text"]', "attr", "href")
    assert dom.split_output("p /* ::text */") == ("p /* ::text */", "element", "")
    e = dom.select(dom.parse("<a HREF='/x&amp;y'>t<i>u</i></a>"), "a")[0]
    assert dom.output(e, "element", "") == {"html": '<a href="/x&amp;y">t<i>u</i></a>', "text": "tu", "attrs": {"href": "/x&y"}}


def test_healing():
    root = dom.parse('<div class="product-card"><span class="price-now">1</span></div><div class="other"><span class="price-now">2</span></div>')
    assert [e.text() for e in healing.find(root, "div.product-cart > span.price-new", True, 0.8)] == ["1"]
    assert healing.find(root, "div.product-cart > span.price-new") == []
    assert [e.text() for e in healing.heal(root, "span.price-nov", 0.8)] == ["1", "2"]
    assert healing.heal(root, "table#zzz", 0.8) == []
    assert [e.text() for e in healing.heal(root, "*.price-nov", 0.85)] == ["1", "2"]


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_levenshtein(a, b):
    def slow(x, y):
        return len(x) + len(y) if not x or not y else min(slow(x[1:], y) + 1, slow(x, y[1:]) + 1, slow(x[1:], y[1:]) + (x[0] != y[0]))

    if len(a) + len(b) < 10:
        assert healing.levenshtein(a, b) == slow(a, b)
    assert healing.levenshtein(a, b) == healing.levenshtein(b, a)


def test_charset():
    assert charset.decode("é".encode("utf-16-be") and b"\xfe\xff" + "é".encode("utf-16-be"), "text/html; charset=gbk") == "é"
    assert charset.decode("中".encode("gbk"), "text/html; charset=gb2312") == "中"
    assert charset.decode(b"<meta charset='windows-1252'>\x80") == "<meta charset='windows-1252'>€"
    assert charset.decode(b"<meta charset=gbk>\xe4", "text/plain") == "<meta charset=gbk>�"
    assert charset.decode(None) is None


def test_cron():
    day = 86_400_000
    assert cron.next_time("0 0 * * *", 0) == day and cron.next_time("30 12 1 * mon", day * 3) == day * 4 + 45_000_000
    assert cron.next_time("0 9 * * *", 0, "Asia/Shanghai") == 3_600_000
    for bad in ("* * * *", "60 * * * *", "a * * * *", "0 0 31 2 *"):
        with pytest.raises(cron.CronError):
            cron.next_time(bad, 0)


def test_healing_is_linear_in_siblings():
    root = dom.parse("<div>" + "<p class=a>x</p>" * 6000 + "</div>")
    began = time.process_time()
    assert len(healing.heal(root, "p.ab ~ p.ab", 0.7)) == 5999
    assert time.process_time() - began < 6


def test_media_order_and_facts():
    base = "http://e.com/d/p"
    got = media.normalize([[{"src": "", "poster": "p.png", "alt": 3, "title": "T", "height": "+7", "width": "-2"}], {"attrs": {"data-src": "q.exe"}, "text": "r.png"}], "image", base)
    assert [(m["url"], m["alt"], m["height"], m["width"]) for m in got] == [("http://e.com/d/p.png", "", 7, 0)]
    assert [m["url"] for m in media.normalize({"html": "see <a>https://x.org/a.mp3?k</a>", "attrs": {}}, "audio", base)] == ["https://x.org/a.mp3?k"]


def test_media():
    base = "https://e.com/d/"
    one = media.normalize({"html": "<img>", "attrs": {"srcset": "a.jpg 1x, b.jpg 2x", "alt": "A", "width": "12"}}, "image", base)
    assert [(m["url"], m["alt"], m["width"], m["ext"]) for m in one] == [("https://e.com/d/a.jpg", "A", 12, "jpg"), ("https://e.com/d/b.jpg", "A", 12, "jpg")]
    assert [m["url"] for m in media.normalize(["url('x.png#f')", "x.png", "y.exe", 3, None], "image", base)] == ["https://e.com/d/x.png"]
    assert [m["src"] for m in media.normalize({"html": "<video><source src=v.mp4><source src=v.txt></video>", "attrs": {}}, "video", base)] == ["v.mp4"]
    assert media.normalize("t", "text", base) == "t"


def test_paths_and_addresses():
    assert sinks.path_segment("ok-1.x") == "ok-1.x" and sinks.path_segment("a/b").startswith("a_b--") and len(sinks.path_segment("x" * 65)) == 32 + 2 + 64
    assert sinks.address_allowed("8.8.8.8") and not any(map(sinks.address_allowed, ("127.0.0.1", "10.0.0.1", "::1", "::ffff:10.0.0.1", "169.254.1.1", "x")))
