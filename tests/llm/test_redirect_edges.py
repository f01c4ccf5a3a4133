"""All tags, relative targets, and votes of addresses that are no pages."""

from shelfmark.llm import redirects

PAGES = "page_id long, url string, html string"


def test_targets_beside_the_page(spark):
    named = ["page.html", "../x?a=../b", "?a=1", "#top", "mailto:a@b.net", "/r/./s", "..", "//h.net/p", "", "http://f.net/q"]
    html = "".join(f'<link rel="canonical" href="{n}">' for n in named) + "<meta http-equiv=refresh content='0; url=z'>" * 2
    pages = spark.createDataFrame([(1, "http://a.net/d/e/f?g#h", html), (2, "http://b.net", '<link rel=canonical href="k">')], PAGES)
    got = {(r.url, r.target) for r in redirects.link_targets(pages).collect()}
    beside = ["d/e/page.html", "d/x?a=../b", "d/e/f?a=1", "r/s", "d/", "d/e/z"]
    want = {("http://a.net/d/e/f?g#h", t) for t in [*(f"http://a.net/{b}" for b in beside), "https://h.net/p", "http://f.net/q"]}
    assert got == want | {("http://b.net", "http://b.net/k")}


def test_every_end_of_an_edge_votes(spark):
    head = '<link rel="canonical" href="{}">'
    pages = [(1, "http://q.net/1", head.format("http://x.com/de/1")), (2, "http://q.net/2", ""), (3, "http://q.net/3", head.format("http://r.net/") + head.format("http://x.com/de/3"))]
    table = spark.createDataFrame([("http://x.com/de/2", "http://q.net/2")], "source string, target string")
    got = {r.page_id: r.verdict for r in redirects.judge(spark.createDataFrame(pages, PAGES), table).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}
