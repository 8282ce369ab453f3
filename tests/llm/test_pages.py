"""Web page operators."""

import time

import numpy as np
import pytest
from voxmend.llm import htmltext, urls
from voxmend.llm.dom import Page

SCHEMA = "page_id long, url string, html string, node string, text int, verdict string"


@pytest.fixture(scope="module")
def model():
    return htmltext.trained()


def blocks(source):
    return [t for _, t in Page(source).runs]


def test_reading_markup():
    assert blocks("<p>a&amp;b &copy; &am<p>c <b>d<br>e</b>\n f<script>var x='</p><p>no';</script>g<li>h<li>i") == ["a&b © &am", "c d e f g", "h", "i"]
    assert blocks("<!-- <p>x --><div>t<p class='a>b'>u</div>v<p title=\"open") == ["t", "u", "v"]
    assert blocks("") == blocks("<p") == blocks("<script>never ends") == []
    assert blocks("1 < 2 <3") == ["1 < 2 <3"]
    # An unclosed control ends where a block starts; text in figures and fallbacks is text.
    assert blocks("<p>a<button>b<p>c<button>d<div>e</div>") == ["a", "c", "e"]
    assert blocks("<p>a <svg><text>b</text></svg> <object>c</object><noscript>d</noscript><video>e</video><select><option>f</select>") == ["a b cde"]
    assert blocks("<p>a<textarea>b<p>c") == ["a"]


def test_reading_is_linear():
    began = time.process_time()
    deep = "<div><ul><li>" * 60000 + "x" + "</li></ul></div>" * 60000
    assert blocks(deep) == ["x"]
    assert blocks("<p>y<button>" * 30000)[:2] == ["y", "y"]
    assert time.process_time() - began < 20


def test_held_out_pages(model):
    writer = htmltext.Writer(np.random.Generator(np.random.PCG64(77)))
    sources = [writer.page() for _ in range(120)]
    wanted = ["\n\n".join(t.replace(htmltext.MARK, "") for _, t in Page(s).runs if htmltext.MARK in t) for s in sources]
    got = htmltext.main_texts([s.replace(htmltext.MARK, "") for s in sources], model)
    assert np.mean([a == b for a, b in zip(wanted, got)]) > 0.85


def test_choices_are_consistent():
    parent = np.array([-1, 0, 1, 1, 0])
    assert htmltext.chosen(np.array([0.0, -1.0, 3.0, -2.0, -1.0]), parent).tolist() == [True, True, True, False, False]
    assert htmltext.chosen(np.array([0.0, -5.0, 3.0, 1.0, 1.0]), parent).tolist() == [True, False, False, False, True]


def test_extraction(spark, model):
    article = "<article><h1>Title here</h1>" + "".join(f"<p>Some words, and more of them, number {i}.</p>" for i in range(5)) + "</article>"
    page = f'<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>{article}<div class="comments"><p>I like it, thanks.</p></div><footer>&copy; me</footer></body></html>'
    wanted = "\n\n".join(["Title here", *(f"Some words, and more of them, number {i}." for i in range(5))])
    rows = [(1, "u", page, "n", 1, "v"), (1, "u", page, "n", 1, "v"), (2, None, None, None, None, None), (None, "x", "", "n", 1, "v"), (3, "y", page[:-60], "n", 1, "v"), (4, "z", "<div>" * 3000 + "deep", "n", 1, "v")]
    got = htmltext.extract(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] in (1, 3)] == [(wanted, len(wanted))] * 3
    assert {(r["text"], r["n_chars"]) for r in got if r["page_id"] in (2, None)} == {("", 0)}
    assert len(got) == 6
    assert htmltext.extract(spark.createDataFrame([], SCHEMA), model).count() == 0


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def ruled(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def test_rules(spark):
    tests = [None, "", "no scheme", "http://Example.COM/en/1", "https://www.example.com/en/x#a", "ftp://a.net/fr/?q", "http://net/es/", "http://xnet/es/", "http://a.com", "http://a.com?x", "http://É.com/İ", "http://b.org/en/", "//x/://y.net/fr/", "a://b://c.net/fr/", "http://a.net/fr"]
    df = spark.createDataFrame([(i, u, None, "n", 1, "v") for i, u in enumerate(tests)] + [(0, None, "x", "n", 1, "v")], SCHEMA)
    got = urls.judge(df).collect()
    assert len(got) == len(tests) + 1
    for r in got:
        host, path = plain(tests[r["page_id"]])
        rule, verdict = ruled(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urls.judge(df.where("false")).count() == 0


def test_aliases_share_a_block(spark):
    def link(to):
        return f'<html><head><LINK href="{to}" rel="canonical"></head></html>'

    rows = [
        (1, "http://a.org/1", link("http://b.org/2")),
        (2, "https://b.org/2#x", link("http://c.net/fr/3")),
        (3, "http://d.org/4", '<meta http-equiv="refresh" content="0; url=http://c.net/fr/3">'),
        (4, "http://e.org/5", link("http://f.com/6")),
        (5, "http://g.net/es/7", link("http://f.com/6")),
        (6, "http://h.org/8", link("/9")),
        (7, "http://h.org/9", None),
    ]
    redirects = spark.createDataFrame([("http://h.org/9", "http://c.net/fr/3"), (None, "http://x.org/")], "from_url string, to_url string")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block"}
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}[6] == "allow"
