"""Links, containers and content blocks of scanned pages.

Input is the result of ``sources.pages.scan_pages``, whose row holds the whole page. Links, containers and blocks are filtered, scored and ranked in its arrays, and exploded at the end, so that
nothing is shuffled after the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.core import let, round_half_up
from tidewire.functions.markup import any_of
from tidewire.functions.urls import AUTHORITY
from tidewire.sources.pages import anchor_rows, block_selector

# URL parts that speak for or against an article link.
ARTICLE_PATTERNS = (
    r"/article/", r"/news/", r"/view", r"/post/", r"/entry/", r"/p/", r"/story/", r"/\d{4}/\d{2}/", r"/detail", r"read\.nhn", r"id=\d+", r"no=\d+",
)
NEGATIVE_PATTERNS = (
    "login", "signup", "join", "mypage", "policy", "terms", "about", "contact", "search", "category", "tag", "feed", "rss",
)
LINK_BASE, LINK_HIT, LINK_LONG_TEXT, LINK_MISS, LINK_KEEP, LINK_MAX = 10, 20, 15, 30, 20, 100
# Containers and classes of list pages.
LIST_CLASSES = ("list", "board", "post", "news", "feed", "card", "article")
MENU_CLASSES = ("menu", "nav", "gnb", "lnb", "footer", "header", "tab")
# Classes and URL parts of cards, items and rows, and of the fields inside.
RULE_SNIPPETS, RULE_PRESS, RULE_TIMES = ("lede", "desc", "snippet", "summary", "content"), ("press", "source", "author", "writer", "nick", "media"), ("date", "time", "stamp", "when")
CARD_CLASSES, CARD_LISTS, CARD_TITLES, CARD_LINKS = ("sa_item", "sa_text", "sh_item"), ("type06_headline", "type06"), ("sa_text_title", "sh_text_headline"), ("article", "news")
CARD_SNIPPETS, CARD_PRESS, CARD_TIMES = ("sa_text_lede", "lede", "sh_text_lede"), ("sa_text_press", "writing", "sh_text_press"), ("sa_text_datetime", "date", "time")
ITEM_CLASSES, ITEM_TITLES, ITEM_LINKS, ITEM_PRESS, ITEM_TIMES = ("list_item", "list_content"), ("list_subject", "subject_fixed"), ("/service/board/",), ("nickname", "author"), ("timestamp", "time")
ROW_AUTHORS, ROW_TIMES = ("list_name", "author"), ("date", "time")
ROW_LINKS = ("view", "zboard", "article", "board")
ROW_EXCLUDED = ("comment", "login", "auth", "member", "javascript")
ANY_LINKS = ("article", "news", "view", "read", "board", "post", "id=")
ANY_EXCLUDED = ("comment", "login", "auth", "share", "tag", "category")
# Notices and content wrappers.
NOTICE_WORDS = ("공지", "[공지]", "이용규칙", "전체공지", "AD", "[AD]", "필독")
WRAPPERS = ("wrapper", "contents", "container", "wrap", "main", "body", "layout", "toptitle")
BONUS_CLASSES = ("han", "board-contents", "pic_bg", "view_content", "post_article", "post_content", "articleBody", "article_body", "dic_area", "content", "view_body")
SKIPPED_SELECTORS = ("body", "html", "table", "tbody", "div.wrapper", "div.contents", "div.container", "div.wrap")
MAX_LINK_RATIO, MIN_BLOCK_TEXT, BONUS = 0.35, 20, 500


def _no_jump(href: Column) -> Column:
    """No jump inside the page and no script; a missing href counts as an empty one."""
    bare = F.trim(F.coalesce(href, F.lit("")))
    return ~F.startswith(bare, F.lit("#")) & ~F.startswith(bare, F.lit("javascript"))


def _usable(href: Column) -> Column:
    """A link that leads somewhere: not empty, either."""
    return (F.trim(F.coalesce(href, F.lit(""))) != "") & _no_jump(href)


def _once(rows: Column, key: str, *order: str) -> Column:
    """The first of the structs with the same ``key`` by ``order``, in the order of the keys. One sort, then neighbours are compared."""
    fields = lambda x: F.struct(x[key].alias("key"), *[x[o] for o in order], x.alias("row"))
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["key"].eqNullSafe(x["key"]))
    return F.transform(let(F.array_sort(F.transform(rows, fields)), first), lambda x: x["row"])


def _ordered(rows: Column, keys: Callable[[Column], list[Column]]) -> Column:
    """Structs sorted by ``keys``, whose last one must tell all apart."""
    keyed = F.transform(rows, lambda x: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys(x))], x.alias("row")))
    return F.transform(F.array_sort(keyed), lambda x: x["row"])


def link_score(url: Column, text: Column) -> Column:
    """Points of a link by its URL and text, before the cap."""
    low = F.lower(url)
    score = F.lit(LINK_BASE) + F.when(F.length(text) >= 15, LINK_LONG_TEXT).otherwise(0)
    for p in ARTICLE_PATTERNS:
        score = score + F.when(low.rlike(p), LINK_HIT).otherwise(0)
    for p in NEGATIVE_PATTERNS:
        score = score - F.when(F.contains(low, F.lit(p)), LINK_MISS).otherwise(0)
    return score


def article_links(scan: DataFrame, n: int = 30) -> DataFrame:
    """The best ``n`` article links of every page by URL and text (M11): same site, outside page chrome, score >= 20."""
    home = F.regexp_extract("url", AUTHORITY, 1)

    def same_site(link: Column) -> Column:
        return let(F.regexp_extract(link, AUTHORITY, 1), lambda host: (host == "") | (host == home) | F.endswith(host, F.concat(F.lit("."), home)))

    rows = F.filter("anchors", lambda a: ~a["in_chrome"] & _usable(a["href"]) & a["abs_url"].isNotNull() & (F.length(a["text"]) >= 4) & same_site(a["abs_url"]))
    scored = F.transform(rows, lambda a: F.struct(a["pos"], a["abs_url"].alias("link"), a["text"], link_score(a["abs_url"], a["text"]).alias("score")))
    capped = F.transform(F.filter(scored, lambda a: a["score"] >= LINK_KEEP), lambda a: F.struct(a["pos"], a["link"], a["text"], F.least(a["score"], F.lit(LINK_MAX)).alias("score")))
    best = _ordered(_once(capped, "link", "pos"), lambda a: [-a["score"], a["pos"]])
    return scan.select("page_id", F.posexplode(F.slice(best, 1, n)).alias("rank", "a")).select("page_id", F.col("a.link").alias("link"), "a.text", "a.score", "rank")


def content_density(scan: DataFrame, n: int = 4) -> DataFrame:
    """The best ``n`` content containers of every page by text density (M12, W6), one per selector."""

    def ratio(b: Column) -> Column:
        return b["link_len"].cast("double") / F.greatest(F.lit(1), b["text_len"])

    def is_content(b: Column) -> Column:
        wrapper = F.lower(F.substring_index(b["class"], ".", 1)).isin(list(WRAPPERS)) | F.lower(b["id"]).isin([*WRAPPERS, "header"])
        return ~wrapper & (b["text_len"] >= MIN_BLOCK_TEXT) & (ratio(b) <= MAX_LINK_RATIO) & ~block_selector(b).isin(list(SKIPPED_SELECTORS))

    def scored(b: Column) -> Column:
        name = F.lower(F.concat_ws(" ", b["class"], b["id"]))
        bonus = let(name, lambda x: sum((F.when(F.contains(x, F.lit(word)), BONUS).otherwise(0) for word in BONUS_CLASSES), F.lit(0)))
        score = round_half_up(b["text_len"].cast("double") * (F.lit(1.0) - ratio(b)) + bonus, 1)
        return F.struct((-score).alias("down"), b["pos"], block_selector(b).alias("selector"), score.alias("score"), b["text_len"], b["img_count"], b["preview"])

    best = _ordered(_once(F.transform(F.filter("blocks", is_content), scored), "selector", "down", "pos"), lambda b: [b["down"], b["pos"]])
    rows = scan.select("page_id", "url", F.posexplode(F.slice(best, 1, n)).alias("rank", "b"))
    return rows.select("page_id", "url", "rank", "b.selector", "b.score", "b.text_len", "b.img_count", "b.preview")


def selector_vote(candidates: DataFrame) -> DataFrame:
    """Per site and field the selector seen on most pages (A16); ties by selector. Input: site, page_id, field, selector."""
    pages = candidates.select("site", "page_id", "field", "selector").distinct()
    votes = pages.groupBy("site", "field", "selector").agg(F.count("*").alias("pages"))
    best = F.min(F.struct((-F.col("pages")).alias("k"), "selector"))
    return votes.groupBy("site", "field").agg(best.alias("b")).select("site", "field", F.col("b.selector").alias("selector"), (-F.col("b.k")).alias("pages"))


def anchor_groups(scan: DataFrame) -> DataFrame:
    """Link containers of every page, probable article lists first (A17). A container's links are a slice of the page's, between the first and the last inside it."""

    def links(g: Column) -> Column:
        return F.filter(F.slice("anchors", g["from"] + 1, g["after"] - g["from"]), lambda a: ~a["hidden"])

    def described(g: Column, own: Column) -> Column:
        by_class = F.when(g["class"] != "", F.concat(g["tag"], F.lit("."), g["class"])).otherwise(g["tag"])
        selector = F.concat(F.when((g["id"] != "") & (g["tag"] != "div"), F.concat(F.lit("#"), g["id"])).otherwise(by_class), F.lit(" a"))
        valid = F.filter(F.slice(own, 1, 20), lambda a: (F.length(a["text"]) > 1) & _no_jump(a["href"]))
        return F.struct(g["gid"], g["tag"], g["class"], F.size(own).alias("link_count"), selector.alias("selector"), F.transform(valid, lambda a: F.substring(a["text"], 1, 40)).alias("texts"))

    def is_list(g: Column) -> Column:
        sized = F.when(g["tag"] == "div", any_of(F.lower(g["class"]), LIST_CLASSES)).when(g["tag"].isin("ul", "ol"), g["link_count"] <= 100).otherwise(True)
        return (g["link_count"] >= 3) & sized & (F.size(g["texts"]) >= 2)

    def ranked(g: Column) -> Column:
        lists = g["tag"].isin("ul", "ol")
        probable = ~(lists & any_of(F.lower(g["selector"]), MENU_CLASSES))
        once = F.when(g["tag"] == "div", g["selector"]).otherwise(F.concat(F.lit("#"), g["gid"].cast("string")))  # repeated card lists share a selector: the first one stands for all
        kind = F.when(g["tag"] == "table", 0).when(lists, 1).otherwise(2)
        return F.struct(once.alias("once"), g["gid"], probable.alias("probable"), kind.alias("kind"), g["link_count"], g["tag"], g["class"], g["selector"], F.slice(g["texts"], 1, 5).alias("samples"))

    found = F.filter(F.transform(F.filter("groups", lambda g: g["after"] - g["from"] >= 3), lambda g: let(links(g), lambda own: described(g, own))), is_list)
    best = _ordered(_once(F.transform(found, ranked), "once", "gid"), lambda g: [~g["probable"], -g["link_count"], g["kind"], g["gid"]])
    rows = scan.select("page_id", F.posexplode(best).alias("rank", "g"))
    return rows.select("page_id", "g.link_count", "g.tag", "g.class", "g.selector", "g.probable", "g.samples", "rank")


def common_parent(scan: DataFrame, examples: DataFrame) -> DataFrame:
    """Per page the most frequent parent class of the anchors that match its example texts (A19); ties by class.

    ``examples`` has page_id and a short array of example texts. A match is containment in either direction; an anchor counts once for each example that it matches.
    """
    wanted = F.filter(F.transform("examples", lambda e: F.trim(e)), lambda e: e != "")
    anchors = anchor_rows(scan).where(F.col("parent_class") != "").select("page_id", "text", "parent_class").join(examples, "page_id")
    matched = F.size(F.filter(wanted, lambda e: F.contains(F.col("text"), e) | F.contains(e, F.col("text"))))
    counts = anchors.groupBy("page_id", F.col("parent_class").alias("class")).agg(F.sum(matched).alias("n")).where(F.col("n") > 0)
    best = F.min(F.struct((-F.col("n")).alias("k"), "class"))
    return counts.groupBy("page_id").agg(best.alias("b")).select(
        "page_id", F.concat(F.lit("."), F.col("b.class"), F.lit(" a")).alias("selector"), (-F.col("b.k")).alias("matches")
    )


def link_cascade(scan: DataFrame, rule: Column | None = None) -> DataFrame:
    """(page_id, method, pos, link, title, anchor_text, snippet, press, time_text, thumbnail): article links of every page by the first method that finds any.

    Methods: the source's own class rule, cards of news sites, items of boards, table rows, any article-like URL. ``rule`` is a column of the scan with the class name of the source's own
    rule, null for none. The scan has ``elements`` in document order; what an element holds is the slice up to its last one, and its text the slice of its pieces, so that a card's fields
    are found by containment. Links that aren't http, and repeats of a page, are left out; a field that a method doesn't look for, or that isn't there, is null.
    """
    page = scan.select("page_id", "elements", "pieces", F.coalesce(rule, F.lit("")).alias("rule") if rule is not None else F.lit("").alias("rule"))
    elements = F.col("elements")

    def inside(e: Column) -> Column:
        return F.slice(elements, e["at"] + 2, e["last"] - e["at"])

    def first(rows: Column, test: Callable[[Column], Column]) -> Column:
        return F.get(F.filter(rows, test), F.lit(0))

    def text(e: Column) -> Column:
        return F.nullif(F.array_join(F.slice("pieces", e["piece"] + 1, e["pieces"]), " "), F.lit(""))

    def named(names: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda e: any_of(e["class"], tuple(f" {n} " for n in names))

    def alike(parts: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda e: any_of(F.lower(e["class"]), parts)

    def linking(parts: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda e: (e["tag"] == "a") & any_of(F.coalesce(e["href"], F.lit("")), parts)

    def item(pos: Column, a: Column, snippet: Column | None = None, press: Column | None = None, time: Column | None = None, thumbnail: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        of = lambda e: none if e is None else text(e)
        picture = none if thumbnail is None else thumbnail["link"]
        title = text(a)
        return F.struct(a["link"].alias("link"), pos.alias("pos"), title.alias("title"), title.alias("anchor_text"), of(snippet).alias("snippet"), of(press).alias("press"), of(time).alias("time_text"), picture.alias("thumbnail"))

    def is_picture(e: Column) -> Column:
        return e["tag"] == "img"

    def usable(rows: Column) -> Column:
        return F.filter(rows, lambda x: F.startswith(F.coalesce(x["link"], F.lit("")), F.lit("http")))

    def unique(rows: Column) -> Column:
        return F.array_sort(F.transform(_once(rows, "link", "pos"), lambda x: F.struct(x["pos"], x.alias("x"))))

    def by_rule(e: Column, pos: Column) -> Column:
        a = F.when(e["tag"] == "a", e).otherwise(first(inside(e), lambda x: x["tag"] == "a"))
        card = F.when(e["box"] >= 0, F.get(elements, e["box"])).otherwise(e)
        time = lambda s: F.coalesce(first(s, alike(RULE_TIMES)), first(s, lambda x: x["tag"] == "time"))
        return let(a, lambda a: let(inside(card), lambda s: item(pos, a, first(s, alike(RULE_SNIPPETS)), first(s, alike(RULE_PRESS)), time(s), first(s, is_picture))))

    def by_card(e: Column, pos: Column) -> Column:
        return let(inside(e), lambda s: let(first(s, lambda x: named(CARD_TITLES)(x) | linking(CARD_LINKS)(x)), lambda a: item(pos, a, first(s, named(CARD_SNIPPETS)), first(s, named(CARD_PRESS)), first(s, named(CARD_TIMES)), first(s, is_picture))))

    def by_item(e: Column, pos: Column) -> Column:
        is_title = lambda x: (x["tag"] == "a") & named(ITEM_TITLES)(x) | linking(ITEM_LINKS)(x)
        return let(inside(e), lambda s: let(first(s, is_title), lambda a: item(pos, a, None, first(s, named(ITEM_PRESS)), first(s, named(ITEM_TIMES)))))

    def by_row(e: Column, pos: Column) -> Column:
        author = lambda x: named(ROW_AUTHORS)(x) | (x["tag"] == "span") & named(("user",))(x)
        time = lambda x: named(ROW_TIMES)(x) | (x["tag"] == "td") & named(("eng",))(x)
        return let(inside(e), lambda s: let(first(s, linking(ROW_LINKS)), lambda a: item(pos, a, None, first(s, author), first(s, time))))

    own = F.when(F.col("rule") != "", F.filter(elements, lambda e: F.contains(e["class"], F.concat(F.lit(" "), F.trim("rule"), F.lit(" "))))).otherwise(F.slice(elements, 1, 0))
    lists = F.flatten(F.transform(F.filter(elements, lambda e: (e["tag"] == "ul") & named(CARD_LISTS)(e)), lambda e: F.filter(inside(e), lambda x: x["tag"] == "li")))
    cards = F.array_sort(F.array_distinct(F.concat(F.filter(elements, named(CARD_CLASSES)), lists)))
    rows = F.filter(usable(F.transform(F.filter(elements, lambda e: e["tag"] == "tr"), by_row)), lambda x: ~any_of(x["link"], ROW_EXCLUDED))
    any_link = lambda x: any_of(x["link"], ANY_LINKS) & ~any_of(x["link"], ANY_EXCLUDED)
    anchors = F.filter(usable(F.transform(F.filter(elements, lambda e: e["tag"] == "a"), lambda e, i: item(i, e))), any_link)
    named_by = lambda method: lambda found: F.transform(found, lambda x: F.struct(F.lit(method).alias("method"), x["x"].alias("x")))

    def rest(seen: Column) -> Column:
        """Table rows with a title, else any link that no row has had."""
        titled = F.filter(seen, lambda x: F.length(x["x"]["title"]) >= 2)
        had = F.transform(seen, lambda x: x["x"].withField("pos", F.lit(-1)))
        others = F.filter(unique(F.concat(had, anchors)), lambda x: x["pos"] >= 0)
        return F.when(F.size(titled) > 0, named_by("rows")(titled)).otherwise(named_by("any")(others))

    def cascade(methods: list[tuple[str, Column]]) -> Column:
        if not methods:
            return let(unique(rows), rest)
        name, found = methods[0]
        return let(unique(usable(found)), lambda x: F.when(F.size(x) > 0, named_by(name)(x)).otherwise(cascade(methods[1:])))

    found = cascade([("rule", F.transform(own, by_rule)), ("cards", F.transform(cards, by_card)), ("items", F.transform(F.filter(elements, named(ITEM_CLASSES)), by_item))])
    return page.select("page_id", F.posexplode(found).alias("pos", "f")).select("page_id", "f.method", "pos", *[f"f.x.{c}" for c in ("link", "title", "anchor_text", "snippet", "press", "time_text", "thumbnail")])


def is_notice(text: Column) -> Column:
    """Notices and advertisements by key word, case-sensitive."""
    return any_of(text, NOTICE_WORDS)


def notice_filter(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, excluded rows with a 60-character sample) of an anchor table."""
    flag = is_notice(F.col("text"))
    return anchors.where(~flag), anchors.where(flag).withColumn("sample", F.substring("text", 1, 60))


def drop_negative(items: Column, terms: list[str]) -> Column:
    """Array items whose ``text`` contains none of the terms, ignoring case; all items when none would be left."""
    wanted = tuple(t.strip().lower() for t in terms if t.strip())
    left = F.filter(items, lambda a: ~any_of(F.lower(a["text"]), wanted))
    return F.when(F.size(left) > 0, left).otherwise(items)
