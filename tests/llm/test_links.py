"""Links of pages against the standard library's resolution."""

from urllib.parse import urldefrag, urljoin

from voxmend.llm import urls

SCHEMA = "page_id long, url string, html string"


def test_every_target_is_resolved(spark):
    pages = ["http://a.org/x/y/z.html?q=1#f", "http://a.org/x/y/", "http://a.org"]
    targets = ["new.html", "../n", "../../../n", "./", "..", ".", "?id=3", "/r/../s", "a/./b/../c?d=../e", "?u=http://c.net/fr/1", "n?u=http://c.net/fr/1", "//b.org/k", "http://b.org/k?x", "/", "sub/"]
    rows = [(i, p, f'<link rel="canonical" href="{t}">') for i, (p, t) in enumerate((p, t) for p in pages for t in targets)]
    got = {(r["from_url"], r["to_url"]) for r in urls.page_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    # A host without a path stands for its root, as in browsers; urljoin leaves the / out before a query.
    assert got == {(p, urljoin(p + "/" if p.count("/") == 2 else p, t)) for p in pages for t in targets}
    none = [(0, pages[0], f'<link rel=canonical href="{t}">') for t in ("", "#top", "mailto:a@b.org", "javascript:void(0)")]
    assert urls.page_links(spark.createDataFrame(none, SCHEMA)).count() == 0


def test_relative_and_later_tags_carry_blocks(spark):
    rows = [
        (1, "http://a.org/d/1", '<meta http-equiv="refresh" content="0;url=2">'),
        (2, "http://a.org/d/2", '<link rel="canonical" href="http://b.org/"><link rel="canonical" href="http://c.net/fr/3">'),
        (3, "http://e.org/d/?id=1", '<meta http-equiv=refresh content="5; url=http://f.org/"><meta http-equiv=refresh content="0; url=?id=2">'),
        (4, "http://e.org/d/?id=2", '<link rel="canonical" href="http://c.net/fr/4">'),
        (5, "http://g.org/d/e/5", '<link rel="canonical" href="../6">'),
        (6, "http://g.org/d/7", '<link rel="canonical" href="http://c.net/fr/4">'),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"}
    assert urldefrag(urljoin("http://g.org/d/e/5", "../6"))[0] == "http://g.org/d/6"


def test_only_tags_count(spark):
    page = "http://a.org/"
    ok = [
        '<link rel="alternate canonical" href="/1">', "<LINK HREF='/2' REL=Canonical>", '<link title="a>b" rel=canonical href="/3?x=1&amp;y=&#50;&#x33;">', "<meta content='1; URL=\"/4\"' http-equiv=refresh>", '<link rel="canonical" data-href="/no" href=/5>',
    ]
    no = ['<!-- <link rel="canonical" href="/n1"> -->', '<script>"<link rel=canonical href=/n2>"</script>', '<link rel="non-canonical" href="/n3">', "<textarea><link rel=canonical href=/n4></textarea>", '<meta name="refresh" content="0;url=/n5">', '<a rel="canonical" href="/n6">']
    rows = [(k, page, "<html>" + "".join(ok) + "".join(no) + "<p>x")for k in (1,)]
    got = {r["to_url"] for r in urls.page_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {page + x for x in ("1", "2", "3?x=1&y=23", "4", "5")}


def test_a_hub_and_long_chains(spark):
    """100 000 pages that point at one hub, and chains of 200: the hub's block, and each chain's end's, reach all of them."""
    hub = spark.range(100000).selectExpr("id AS page_id", "concat('http://h', id, '.org/') AS url", "'<link rel=canonical href=\"http://hub.net/fr/1\">' AS html")
    chains = spark.range(20 * 200).selectExpr("100000 + id AS page_id", "concat('http://c.org/', id) AS url", "concat('<link rel=canonical href=\"', if(id % 200 = 199, if(id % 400 = 199, 'http://x.net/es/', 'http://y.com/'), concat('/', id + 1)), '\">') AS html")
    got = {(r["chain"], r["verdict"]): r["n"] for r in urls.judge(hub.unionByName(chains)).selectExpr("if(page_id < 100000, -1, (page_id - 100000) div 200 % 2) AS chain", "verdict").groupBy("chain", "verdict").count().withColumnRenamed("count", "n").collect()}
    assert got == {(-1, "block"): 100000, (0, "block"): 2000, (1, "allow"): 2000}
