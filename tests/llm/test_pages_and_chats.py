"""Chat formatting, HTML extraction and WARC packages: exact round trips and the awkward cases."""

import hashlib
import io
import time
import zipfile

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import chatformat as cf
from loomspark.llm import htmltext, warczip

ODD = st.lists(st.sampled_from(["<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "|", ">", "[", "/", "a", "é", "日", "\U0001f600", " ", "\n"]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>", ""]), ODD), max_size=5))
def test_formatting_can_be_undone(turns):
    text, spans = cf.render(turns)
    assert cf.parse(text) == turns
    e = cf._encoder(cf.TOKENIZER).encode(text, add_special_tokens=False)
    off = cf.np.array(e.offsets).reshape(-1, 2)
    assert cf.masked_text(text, off, cf.loss_mask(off, spans)) == "".join(t for r, t in turns if r == "assistant")
    for mark in ("</s>", "<s>", "[INST]", "[/INST]"):
        assert mark not in text


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "late"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "assistant", "n"), (4, 0, "user", ""), (5, 0, "assistant", "word " * 50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "2 AS turns", "3 AS late", "4 AS formatted")
    out = {x.conv_id: x for x in cf.digest(cf.chat_format(cf.with_probe(table))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1].turns_sha256 == sha("user\na\nassistant\nb\n") and out[1].loss_sha256 == sha("b") and out[2].turns_sha256 == sha("\n\nassistant\nlate\n")
    assert (out[3].n_turns, out[3].loss_chars, out[None].loss_chars, out[4].loss_chars, out[5].loss_chars, out[-1].loss_chars) == (2, 2, 1, 0, 250_000, 21)
    assert cf.digest(cf.chat_format(table.limit(0))).collect() == []


P = "This is a long paragraph of real content, with many words and hardly any markup at all, as articles have it. "


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []), ("", []), ("<nav>menu</nav>", []), ("plain &lt;b&gt; &eacute;", ["plain <b> é"]),
        (f"<body><div id=header>Site</div><div class=menu><a href=a>Home</a> <a href=b>News</a></div><div class=content><h2>Title</h2><p>{P}{P}</p><p>Short.</p><p>{P}</p></div><div id=comments><p>{P}</p></div><div class=footer>x</div>", ["Title", (P + P).strip(), "Short.", P.strip()]),
        (f"<header>Site</header><div class='cookie-notice'>We use cookies</div><main><article><header><h1>Head</h1></header><p>{P}<ul><li>one<li>two</ul><form><p>Subscribe</form><section class=comments><article><p>{P}{P}{P}</article></section></article><aside>{P}</aside></main>", ["Head", P.strip(), "one", "two"]),
        (f"<article><h1>A &amp;\n B</h1><p><b>{P}<br>more<p>x <i>y</i>z<script>var t='</p>'</script><style>p{{}}</style></article><footer>&copy; f", ["A & B", P + "more", "x yz"]),
        (f"<article><p>{P}</article><div class=ad>Buy</div><foot", [P.strip()]),
        ("<article><p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", ["deep"]),
    ],
)
def test_main_blocks(html, want):
    assert htmltext.main_blocks(html) == want


def _two_regions():
    """A page without article, main or telling names: short tagged cells, prose, short tagged cells."""
    cells = "".join(f"<div><b>Item</b> <i>{k}</i> <span>of</span> <em>stock</em></div>" for k in range(60))
    return f"<body><div class=x1>{cells}</div><div class=x2>" + f"<p>{P}{P}</p>" * 6 + f"<p>Short.</p></div><div class=x3>{cells}</div></body>"


def test_clusters_of_ratios_choose_the_region(monkeypatch):
    want = [(P + P).strip()] * 6
    assert htmltext.main_blocks(_two_regions())[:6] == want and "Item 3 of stock" not in htmltext.main_blocks(_two_regions())
    smoothed = htmltext.smoothed
    monkeypatch.setattr(htmltext, "smoothed", lambda v: smoothed([1.0] * len(v)))
    assert "Item 3 of stock" in htmltext.main_blocks(_two_regions())


def test_the_article_with_the_content_cluster_is_chosen():
    teasers = "".join(f"<article><h3><a href=t>Teaser</a></h3><span>{k}</span> <b>more</b></article>" for k in range(30))
    assert htmltext.main_blocks(f"<main><section>{teasers}</section></main><article><p>{P}{P}</p><p>{P}</p></article>") == [(P + P).strip(), P.strip()]


def test_nested_boxes_cost_linear_time():
    began = time.process_time()
    assert len(htmltext.page_lines("<div>x" * 20_000 + "</b>" * 20_000)[0]) == 20_000
    assert time.process_time() - began < 5


def test_html_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "<article>" + f"<p>{P}" * 2000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS lines")
    out = sorted((repr(x.page_id), x.url, x.n_chars) for x in htmltext.extract_text(table).collect())
    assert out == sorted([("1", "u", 1), ("1", "u", 1), ("None", None, 0), ("2", "v", 2000 * len(P.strip()) + 2 * 1999)])
    assert htmltext.extract_text(table.limit(0)).collect() == []


def test_warc_rows(spark, tmp_path):
    big, other = "é" * 600, "x" * 999
    rows = [(1, "a\r\n%b", big), (2, "b", big), (3, "c", big), (3, "c", big), (4, "d", other), (5, "e", other), (6, None, None), (None, "n", big), (7, "z", ""), (8, "y", "q" * 300_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS salt", "3 AS first")
    folder = f"file://{tmp_path}/w"
    packages = warczip.write_packages(warczip.planned(table), folder, package_bytes=2000)
    out = sorted(repr((x.page_id, x.url, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in warczip.read_packages(packages).collect())
    want = []
    for i, u, h in rows:
        b = (h or "").encode()
        revisit = h == big and i in (1, 2)
        want.append(repr((i, u, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)))
    assert out == sorted(want)
    uri = packages.first()["uri"]
    fs, path = pafs.FileSystem.from_uri(uri)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
    assert [warczip.record_at(uri, k) for k in range(len(list(warczip.records(uri))))] == list(warczip.records(uri))
    assert warczip.archive_round_trip(table.limit(0)).collect() == []


def test_zip_reader_takes_classic_and_wide_directories():
    classic = io.BytesIO()
    with zipfile.ZipFile(classic, "w") as z:
        z.comment = b"PK\x05\x06 a comment that looks like an end"
        z.writestr("ä", b"12345")
        z.writestr(zipfile.ZipInfo("packed"), b"1" * 100, zipfile.ZIP_DEFLATED)
    r = warczip.ZipReader(classic)
    assert r.read("ä", 1, 3) == b"234"
    for bad in (lambda: r.read("packed"), lambda: r.read("ä", 3, 9), lambda: warczip.ZipReader(io.BytesIO(b"no zip"))):
        with pytest.raises(ValueError):
            bad()
    wide = io.BytesIO()
    w = warczip.StoredZipWriter(wide)
    for k in range(70_000):
        w.begin(str(k))
        w.write(b"%d" % k)
        w.end()
    w.close()
    r = warczip.ZipReader(wide)
    assert len(r.members) == 70_000 and r.read("69999") == b"69999"
    with zipfile.ZipFile(wide) as z:
        assert z.read("69998") == b"69998"
