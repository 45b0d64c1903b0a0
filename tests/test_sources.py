"""Feeds, listings and pages on hand-made documents."""

import datetime as dt
import random
import re
import time

from pyspark.sql import functions as F

from tidewire.operators import pages as pg
from tidewire.sources import feeds, pages

NOW = dt.datetime(2026, 1, 2, 12)
RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title>One &amp; two</title><link>https://a/1</link><pubDate>Mon, 05 Jan 2026 09:00:00 +0900</pubDate><description>&lt;p&gt;Hi &lt;b&gt;x&lt;/b&gt;&lt;/p&gt;</description><source url="u">Wire</source></item>
<item><title>No date</title><link>https://a/2</link><pubDate>soon</pubDate><description/></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>
<entry><title>E1</title><link href="https://b/1"/><summary>s1</summary></entry><entry><summary>dropped</summary></entry><entry><title>E3</title><content>c3</content></entry></feed>"""


def feed_docs(spark, bodies):
    return spark.createDataFrame([(f"f{i}", b, NOW) for i, b in enumerate(bodies)], "feed_url string, body string, as_of timestamp_ntz")


def test_feeds(spark):
    many = RSS.replace("</channel>", "<item><title>x</title></item>" * 20 + "</channel>")
    rows = feeds.feed_rows(feed_docs(spark, [RSS, ATOM, "<broken", None, many])).collect()
    by = {(r["feed_url"], r["pos"]): r for r in rows}
    one = by["f0", 0]
    assert (one["title"], one["publisher"], one["published_at"], one["summary"]) == ("One & two", "Wire", dt.datetime(2026, 1, 5, 0, 0), "Hi x")
    assert (by["f0", 1]["published_at"], by["f0", 1]["publisher"]) == (NOW, "Global Financial Wire")
    assert [(r["title"], r["url"], r["publisher"]) for k, r in sorted(by.items()) if k[0] == "f1"] == [("E1", "https://b/1", "Target Feed"), ("E3", "f1", "Target Feed")]
    assert sum(k[0] == "f4" for k in by) == 15 and not any(k[0] in ("f2", "f3") for k in by)


def test_listing_edges(spark):
    body = '{"data":{"children":[{"data":{"title":"$tsla up","stickied":true}},{"data":{"title":"$tsla up","created_utc":1767351600}},{"data":{"score":80,"num_comments":2,"created_utc":1767355190}}]}}'
    docs = spark.createDataFrame([("stocks", body, NOW)], "board string, body string, as_of timestamp_ntz")
    a, b = feeds.listing_posts(docs).orderBy("pos").collect()
    assert (a["tickers"], a["score"], a["upvote_ratio"], a["hours_alive"], a["is_spike"]) == (["TSLA"], 0, 1.0, 1.0, False)
    assert (b["velocity_score"], b["is_spike"], b["author"]) == (425.0, True, "u/unknown")


PAGE = """<html><head><title>T &amp; t</title><meta name="author" content="kimkim"><meta property="og:site_name" content="Site">
<meta property="article:published_time" content="2026-01-02T03:04:05Z"></head><body>
<nav><a href="/login">Log in here</a></nav>
<table id="main"><tr><td><a href="/view?id=1">First long headline</a></td></tr><tr><td><a href="/view?id=2">Second</a><a href="/view?id=3">x</a></td></tr><tr><td><a href="/view?id=2">Again</a></td></tr></table>
<ul class="gnb"><li><a href="/a">aa</a><li><a href="/b">bb</a><li><a href="#c">cc</a></ul>
<a href="javascript:void(0)">script</a><a href="https://other.org/news/1">Foreign site link</a><a href="https://sub.x.com/news/9">Sub site link</a>
<div class="post_content">Body text that is long enough to count<img src="a.png"><p>tail <a href="/z">z</a></p></div><div class="comment_box"><p>noise noise noise noise noise</p></div>
<script>var a = "<p>not text</p>";</script></body>"""


def scan(spark, *html, **parts):
    return pages.scan_pages(spark.createDataFrame([(i, "https://x.com/list", h) for i, h in enumerate(html)], "page_id long, url string, html string"), **parts)


def test_page_scan(spark):
    s = scan(spark, PAGE, None, "<p>unclosed <a href='/q'>link", "<<<>>>")
    anchors = pages.page_anchors(s).where("page_id = 0").orderBy("pos").collect()
    links = [r["abs_url"] for r in anchors]
    assert links.count("https://x.com/view?id=2") == 1 and "https://x.com/login" in links and not any(l.startswith("javascript") for l in links)
    assert [r["abs_url"] for r in pages.page_anchors(s).where("page_id = 2").collect()] == ["https://x.com/q"]
    meta = pages.page_metadata(s).where("page_id = 0").first()
    assert (meta["title"], meta["author"], meta["published_at"], meta["canonical_url"]) == ("T & t", "kim", dt.datetime(2026, 1, 2, 3, 4, 5), "https://x.com/list")
    blocks = {r["selector"]: r for r in pages.page_blocks(s).where("page_id = 0").collect()}
    body = blocks["div.post_content"]
    assert (body["text_len"], body["link_len"], body["img_count"]) == (len("Body text that is long enough to count tail z"), 1, 1)
    assert not any("comment" in k for k in blocks)


def test_page_operators(spark):
    s = scan(spark, PAGE)
    links = [(r["link"], r["score"]) for r in pg.article_links(s).orderBy("rank").collect()]
    assert links == [("https://x.com/view?id=1", 65), ("https://x.com/view?id=2", 50), ("https://sub.x.com/news/9", 30)]
    groups = [(r["selector"], r["link_count"], r["probable"]) for r in pg.anchor_groups(s).orderBy("rank").collect()]
    assert groups == [("#main a", 4, True), ("ul.gnb a", 3, False)]
    cascade = [(r["method"], r["link"]) for r in pg.link_cascade(scan(spark, PAGE, elements=True)).orderBy("pos").collect()]
    assert cascade == [("rows", "https://x.com/view?id=1"), ("rows", "https://x.com/view?id=2")]
    best = pg.content_density(s, 1).first()
    assert (best["selector"], best["score"]) == ("div.post_content", 1044.0)
    examples = spark.createDataFrame([(0, ["aa", " "])], "page_id long, examples array<string>")
    assert pg.common_parent(s, examples).count() == 0  # the list items carry no class


CASCADE = {
    "rule": (
        """<ul><li><img data-src="/t.png"><b class="mine"><i>x</i><a href="/n/1">One <b>title</b></a></b><p class="newsDesc">a lead</p><span class="Writer-name">Kim</span><time>10:00</time></li>
        <li class="mine"><a href="/n/2">Two</a></li><li class="mine"><a href="/n/1#">Other</a></li><a class="mine" href="mailto:x">no</a></ul><div class="sa_item"><a href="/article/9">card</a></div>""",
        [("/n/1", "One title", "a lead", "Kim", "10:00", "https://x.com/t.png"), ("/n/2", "Two", None, None, None, None), ("/n/1#", "Other", None, None, None, None)],
    ),
    "cards": (
        """<div class="sa_item"><div class="sa_text"><a class="sa_text_title" href="/a/1"><strong>Head</strong> line</a><div class="sa_text_lede">lead <i>in</i></div><div class="sa_text_press">P</div><div class="sa_text_datetime">1h</div></div>
        <img class="sa_thumb_inner" src="https://i.org/1.png"></div><ul class="type06"><li><dl><a href="/x">skipped</a><a href="/article/2">Two</a><span class="writing">W</span><span class="date">d</span></dl></li></ul><tr><td><a href="/view/7">row</a></td></tr>""",
        [("/a/1", "Head line", "lead in", "P", "1h", "https://i.org/1.png"), ("/article/2", "Two", None, "W", "d", None)],
    ),
    "items": (
        """<div class="list_item"><a href="/else">e</a><a class="list_subject" href="/s/1">Subject</a><span class="nickname">N</span><span class="timestamp">t</span><img src="/i.png"></div>
        <div class="list_content"><a href="/service/board/2">By link</a></div>""",
        [("/s/1", "Subject", None, "N", "t", None), ("/service/board/2", "By link", None, None, None, None)],
    ),
    "rows": (
        """<table><tr><td class="eng">23/01</td><td><a href="/x">no</a><a href="/zboard?id=1">Row one</a><span class="user">U</span></td></tr><tr><td><a href="/view/2">x</a></td></tr><tr><td><a href="/view/2">again</a></td></tr>
        <tr><td><a href="/view/login">login</a></td></tr></table>""",
        [("/zboard?id=1", "Row one", None, "U", "23/01", None)],
    ),
    "any": (
        """<table><tr><td><a href="/view/2">x</a></td></tr></table><a href="/view/2">a longer one</a><a href="/post/3">Post</a><a href="/post/3">Again</a><a href="/post/share">s</a><a href="/other">o</a><a>none</a><a href="/read/4"></a>""",
        [("/post/3", "Post", None, None, None, None), ("/read/4", None, None, None, None, None)],
    ),
}


def test_every_method_of_the_cascade_with_its_fields(spark):
    made = scan(spark, *[html for html, _ in CASCADE.values()], None, "", "<p>no link", elements=True, anchors=False, blocks=False)
    found = pg.link_cascade(made.withColumn("own", F.when(F.col("page_id") == 0, "mine")), F.col("own"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]
    rows = found.orderBy("page_id", "pos").collect()
    for k, (method, (_, want)) in enumerate(CASCADE.items()):
        mine = [r for r in rows if r["page_id"] == k]
        assert [r["method"] for r in mine] == [method] * len(want) and [r["pos"] for r in mine] == list(range(len(want)))
        assert [(r["link"].removeprefix("https://x.com"), r["title"], r["snippet"], r["press"], r["time_text"], r["thumbnail"]) for r in mine] == want
        assert all(r["title"] == r["anchor_text"] for r in mine)
    assert {r["page_id"] for r in rows} == set(range(5))


def test_list_page_queries_shuffle_no_page(spark, sf):
    """The table is dealt out before pages are built, and nothing is joined to what was read in them."""
    from tidewire.plans import load

    for name in ("S11_page_metadata", "M12_content_of_lists", "A17_anchor_groups", "S12_blocks_of_lists", "U5_link_cascade", "W6_top_items_per_page", "A16_selector_vote_of_lists"):
        above, below = load()[0][name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)
        assert below.count("Exchange") == 1 and "html" not in below[below.index("Exchange") :], name
        assert "Join" not in above, name
    wide = pages.scan_pages(spark.createDataFrame([(k, None, "<p>x", [k], str(k)) for k in range(200)], "page_id long, url string, html string, list array<int>, `a b` string").coalesce(1), keep=("list", "a b"))
    assert all(r["list"] == [r["page_id"]] and r["a b"] == str(r["page_id"]) for r in wide.collect()) and wide.count() == 200


def test_whole_tags_and_odd_ones_are_read_alike(monkeypatch):
    rng = random.Random(3)
    bits = ["<a href='/x?a&amp;b'>", "</a>", "<p>", "</p>", "<td>", "<div id=Comment_1 class='Post  z'>", "</div>", "<h1>", "</h1>", "<title>", "<script>", "</script >", "<!--", "-->", "t &amp; m", " ", "<", ">", '"', "'",
            "<META property='og:title' content=\"T &lt;\">", "<img src=1>", "</ b>", "< a", '<a"b>', "<ul>", "<li>", "<nav>", "<section", '"' * 512 + ">", "<p " + "a='b' " * 255 + ">", "<p " + "a='b' " * 256 + "x>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(150)]

    def read():
        out = []
        for html in texts:
            for wanted in ((False, False, False), (True, True, True)):
                scanner = pages._PageScanner("https://x.com/p", *wanted)
                scanner.feed(html)
                out.append(repr(scanner.row(1)))
        return out

    whole = read()
    monkeypatch.setattr(pages, "_TAG", re.compile("(?!)"))  # every tag is taken apart step by step
    assert read() == whole


def test_page_operators_do_not_shuffle_after_the_scan(spark):
    s = scan(spark, PAGE, partitions=3)
    for found in (pg.article_links(s), pg.content_density(s), pg.anchor_groups(s)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("MapInArrow")[0] and "Exchange" in plan


def test_selector_vote_and_negative_terms(spark):
    votes = spark.createDataFrame([("s", 1, "t", "h1"), ("s", 1, "t", "h1"), ("s", 2, "t", "b"), ("s", 3, "t", "b"), ("s", 4, "t", "a"), ("s", 5, "t", "a")], "site string, page_id long, field string, selector string")
    assert tuple(pg.selector_vote(votes).first()) == ("s", "t", "a", 2)
    items = F.array(*[F.struct(F.lit(t).alias("text")) for t in ("Ad one", "two")])
    row = spark.range(1).select(pg.drop_negative(items, ["AD "]).alias("some"), pg.drop_negative(items, ["o"]).alias("all")).first()
    assert [x["text"] for x in row["some"]] == ["two"] and len(row["all"]) == 2


def test_page_scan_time_grows_with_the_page():
    """Unclosed tags, quotes and nests: eight times the page may take at most about eight times as long, never its square."""
    for unit in ("<p>a", '<a href="x', "<a 'x>b", "<div>a", "<a href=x>t", "<div><a href=x>t</a>", "<", "<p \"'>x"):
        spent = []
        for n in (2000, 16000):
            start = time.process_time()
            scanner = pages._PageScanner("http://x.com/", elements=True)
            scanner.feed(unit * n)
            scanner.row(1)
            spent.append(time.process_time() - start)
        assert spent[1] < 24 * max(spent[0], 0.02), (unit, spent)


def test_bare_items_and_escaped_captions(spark):
    rdf = '<?xml version="1.0"?><rdf><channel><title>t</title></channel><item><title>A</title><link>https://x/1</link><description>d</description></item></rdf>'
    got = feeds.feed_rows(spark.createDataFrame([("f", rdf)], "feed_url string, body string").withColumn("as_of", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))).collect()
    assert [(r["title"], r["url"], r["summary"]) for r in got] == [("A", "https://x/1", "d")]
    html = '<script>{"text": "caf\\u00e9 and more text", "code": "ABCDE1"}</script>'
    post = feeds.embedded_posts(spark.createDataFrame([(1, "u", html)], "page_id long, username string, html string"), "2026-01-01 00:00:00").first()
    assert post["title"] == "café and more text"
