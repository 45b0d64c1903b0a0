"""Raw page scan: one pass over the tags of each page, everything else as DataFrame expressions.

``scan_pages`` is the only Python step. It keeps the page's partitioning (no shuffle) and emits one row per page with
arrays of anchors, containers and blocks; the tables S10-S12 are explodes and expressions over that row.
Only the columns an operator asks for are kept after the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import clean_title, collapse_repeat, parse_flexible_date

# Tags and name parts that are not content.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME_TAGS = {"header", "footer", "nav", "aside"}
SILENT_TAGS = {"script", "style"}
NOISE_TAGS = CHROME_TAGS | SILENT_TAGS | {"noscript", "iframe"}
NOISE_IDS = ("comment", "reply", "memo_", "cmt_")
NOISE_CLASSES = NOISE_IDS + ("reply_area", "d_drag", "photo_drag", "sidebar", "banner", "menu", "nav", "footer", "ad_")
BLOCK_TAGS = {"td", "article", "section", "div", "p"}
GROUP_TAGS = {"table", "ul", "ol", "div"}
BOX_TAGS = {"li", "tr", "div", "article"}
MISSING_AUTHOR = "미지정"

SCAN_SCHEMA = (
    "page_id long, url string, title string, h1 string, canonical_link string, meta map<string,string>, "
    "anchors array<struct<pos:int,href:string,abs_url:string,text:string,class:string,path:string,parent_class:string,"
    "in_chrome:boolean,hidden:boolean,first:boolean>>, "
    "groups array<struct<gid:int,tag:string,id:string,class:string,from:int,after:int>>, "
    "elements array<struct<at:int,tag:string,class:string,href:string,link:string,last:int,box:int,piece:int,pieces:int>>, pieces array<string>, "
    "blocks array<struct<pos:int,tag:string,id:string,class:string,text_len:int,link_len:int,img_count:int,preview:string>>"
)
PREVIEW_CHARS = 120


# Elements that can't hold one of their own kind: the next one ends them if they are innermost (an anchor: wherever it is open).
SELF_ENDING = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
# Open elements at most (deeper ones become siblings, as in browsers), quoted values of a tag at most, pages of an output batch.
MAX_DEPTH, MAX_QUOTED, SLICE = 512, 256, 64
# Characters of attributes, or names, that are kept for the next tag like it.
KEPT_CHARS = 128

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# A whole tag, as nearly all are: nothing is tried twice. What it does not match (comments, open quotes, more quoted values) is taken apart step by step.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+){0,%d}+)>""" % (MAX_QUOTED - 1))
_TO_END = re.compile(r"""[^>"']*""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ORIGIN = re.compile(r"https?://[^/?#]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in SILENT_TAGS}


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name, to be read only: short texts, which repeat, are kept."""
    return _short_attributes(text) if len(text) <= KEPT_CHARS else _parsed_attributes(text)


def _parsed_attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        value = double or single or bare
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


_short_attributes = lru_cache(4096)(_parsed_attributes)


def _names(cls: str, ident: str) -> tuple[str, bool]:
    """The class names joined by dots, and whether class or id is that of noise."""
    low_id, low_cls = ident.lower(), cls.lower()
    cls, low_cls = ".".join(cls.split()), ".".join(low_cls.split())
    return cls, any(k in low_id for k in NOISE_IDS) or any(k in low_cls for k in NOISE_CLASSES)


_short_names = lru_cache(4096)(_names)
_NOTHING: dict[str, str] = {}
_OUTSIDE = {"tag": "", "class": "", "chrome": False, "hidden": False, "noise": False, "linked": False, "home": None}


class _PageScanner:
    """Collects anchors, containers, text blocks and head metadata in one pass over the tags of a page."""

    def __init__(self, url: str, anchors: bool = True, blocks: bool = True, elements: bool = False):
        self.url = url
        self.want_anchors, self.want_blocks, self.want_elements = anchors, blocks, elements
        self.want_body = anchors or blocks or elements
        origin = _ORIGIN.match(url)
        self.origin = origin.group(0) if origin else ""
        self.open: list[dict] = []
        self.counts: dict[str, int] = {}  # open elements by tag
        self.listening: list[dict] = []  # open anchors and titles
        self.filling: list[dict] = []  # open blocks whose preview is not full
        self.anchors: list[dict] = []
        self.groups: list[dict] = []
        self.blocks: list[dict] = []
        self.elements: list[dict] = []  # in document order: what an element holds are the ones up to its ``last``
        self.pieces: list[str] = []
        self.meta: dict[str, str] = {}
        self.title: list[str] | None = None
        self.h1: list[str] | None = None
        self.canonical: str | None = None

    def feed(self, html: str) -> None:
        """One pass; no place is looked at again, whatever quotes or tags are left open."""
        at, n = 0, len(html)
        while at < n:
            begin = html.find("<", at)
            m = _TAG.match(html, begin) if begin >= 0 else None
            if m:
                if begin > at:
                    self._text(html[at:begin])
                closing, tag, attributes = m.groups()
                at, tag = m.end(), tag.lower()
                if closing:
                    self._close(tag)
                else:
                    at = self._open(tag, attributes, html, at)
                continue
            while 0 <= begin < n - 1 and not (html[begin + 1] in "!?/" or html[begin + 1].isalpha()):
                begin = html.find("<", begin + 1)
            if begin < 0 or begin == n - 1:
                return self._text(html[at:])
            if begin > at:
                self._text(html[at:begin])
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                at = end + 3 if end >= 0 else n
                continue
            m = _NAME.match(html, begin + 1)
            if not m or not m.group(2)[0].isascii():
                end = html.find(">", begin + 1)
                at = end + 1 if end >= 0 else n
                continue
            end = self._tag_end(html, m.end())
            if end < 0:  # no tag ends from here on
                return self._text(html[begin:])
            at = end + 1
            tag = m.group(2).lower()
            if m.group(1):
                self._close(tag)
                continue
            at = self._open(tag, html[m.end() : end], html, at)

    def _open(self, tag: str, attribute_text: str, html: str, at: int) -> int:
        """Begin an element; the place after it, or after all of it if its content is not markup (scripts and styles)."""
        self._start(tag, attribute_text)
        if tag in SILENT_TAGS:
            raw = _RAW_END[tag].search(html, at)
            at = raw.end() if raw else len(html)
            self._close(tag)
        return at

    @staticmethod
    def _tag_end(html: str, at: int) -> int:
        """Place of the ``>`` outside quotes; of the first one at all, if a quote stays open or there are very many; -1 for none."""
        start = at
        for _ in range(MAX_QUOTED):
            at = _TO_END.match(html, at).end()
            if at == len(html):
                break
            if html[at] == ">":
                return at
            at = html.find(html[at], at + 1) + 1
            if not at:
                break
        return html.find(">", start)

    def _start(self, tag: str, attribute_text: str) -> None:
        # without a body to collect only the head's tags have attributes of use
        a = _attributes(attribute_text) if attribute_text and (self.want_body or tag in ("meta", "link")) else _NOTHING
        if tag in VOID_TAGS:
            return self._void(tag, a)
        if tag == "a" and self.counts.get("a"):
            self._close("a")
        elif (tag in SELF_ENDING and self.open and self.open[-1]["tag"] == tag) or len(self.open) >= MAX_DEPTH:
            self._end()
        if not self.want_body:
            e = {"tag": tag, "home": None}
            if (tag == "title" and self.title is None) or (tag == "h1" and self.h1 is None):
                e["text"] = []
                setattr(self, tag, e["text"])
                self.listening.append(e)
            self.counts[tag] = self.counts.get(tag, 0) + 1
            self.open.append(e)
            return
        cls, ident, noisy = a.get("class", ""), a.get("id", ""), False
        if cls or ident:
            cls, noisy = (_short_names if len(cls) + len(ident) <= KEPT_CHARS else _names)(cls, ident)
        parent = self.open[-1] if self.open else _OUTSIDE
        e = {
            "tag": tag,
            "class": cls,
            "chrome": tag in CHROME_TAGS or parent["chrome"],
            "hidden": tag in ("noscript", "iframe") or parent["hidden"],
            "noise": noisy or tag in NOISE_TAGS or parent["noise"],
            "linked": tag == "a" or parent["linked"],
            "home": parent["home"],
        }
        if self.want_elements:
            e["element"] = self._element(tag, a, parent)
        if tag == "a" and self.want_anchors:
            e["anchor"] = {
                "pos": len(self.anchors),
                "href": a.get("href"),
                "text": [],
                "class": cls,
                "path": "/".join(x["tag"] for x in self.open),
                "parent_class": parent["class"],
                "in_chrome": e["chrome"],
                "hidden": e["hidden"],
            }
            self.anchors.append(e["anchor"])
        elif tag == "title" and self.title is None:
            self.title = e["text"] = []
        elif tag == "h1" and self.h1 is None:
            self.h1 = e["text"] = []
        if self.want_anchors and tag in GROUP_TAGS:
            e["group"] = {"gid": len(self.groups), "tag": tag, "id": ident, "class": cls, "from": len(self.anchors)}
            self.groups.append(e["group"])
        if self.want_blocks and tag in BLOCK_TAGS and not e["noise"]:
            e["block"] = {
                "pos": len(self.blocks), "tag": tag, "id": ident, "class": cls, "text_len": 0, "link_len": 0, "img_count": 0, "preview": "", "pieces": 0, "above": e["home"],
            }
            self.blocks.append(e["block"])
            self.filling.append(e["block"])
            e["home"] = e["block"]
        if "anchor" in e or "text" in e:
            self.listening.append(e)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.open.append(e)

    def _void(self, tag: str, a: dict[str, str]) -> None:
        """A tag without content: head metadata and pictures."""
        if tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("http-equiv") or "").strip()
            if name and a.get("content"):
                self.meta[name] = a["content"].strip()
        elif tag == "link" and "canonical" in a.get("rel", "").split() and self.canonical is None:
            self.canonical = a.get("href", "").strip() or None
        elif tag == "img":
            home = self.open[-1]["home"] if self.open else None
            if home:
                home["img_count"] += 1
            if self.want_elements:
                self._element(tag, a, {})["last"] = len(self.elements) - 1

    def _element(self, tag: str, a: dict[str, str], parent: dict) -> dict:
        """An element by its number, with the nearest card around it and the text pieces from which on its own come; class names stand between spaces."""
        above = parent.get("element", {})
        box = above["at"] if above.get("tag") in BOX_TAGS else above.get("box", -1)
        source = a.get("href") if tag == "a" else (a.get("src") or a.get("data-src")) if tag == "img" else None
        cls = " ".join(a.get("class", "").split())
        self.elements.append({"at": len(self.elements), "tag": tag, "class": f" {cls} " if cls else "", "href": source, "link": self._absolute(source) if source else None, "box": box, "piece": len(self.pieces), "pieces": 0})
        return self.elements[-1]

    def _end(self) -> None:
        """Close the innermost element; a block hands its sums to the block around it."""
        e = self.open.pop()
        if "element" in e:
            e["element"].update(last=len(self.elements) - 1, pieces=len(self.pieces) - e["element"]["piece"])
        if "group" in e:
            e["group"]["after"] = len(self.anchors)
        self.counts[e["tag"]] -= 1
        if self.listening and self.listening[-1] is e:
            self.listening.pop()
        block = e.get("block")
        if block:
            if self.filling and self.filling[-1] is block:
                self.filling.pop()
            above = block["above"]
            if above:
                for k in ("text_len", "link_len", "img_count", "pieces"):
                    above[k] += block[k]

    def _close(self, tag: str) -> None:
        if self.counts.get(tag):
            while self.open[-1]["tag"] != tag:
                self._end()
            self._end()

    def _text(self, data: str) -> None:
        if not self.open:
            return
        top = self.open[-1]
        if not (self.listening or self.want_elements or (top["home"] and not top["noise"])):
            return
        piece = data.strip()
        if not piece:
            return
        if "&" in piece:
            piece = unescape(piece)
        if self.want_elements:
            self.pieces.append(piece)
        for e in self.listening:
            (e["text"] if "text" in e else e["anchor"]["text"]).append(piece)
        home = top["home"]
        if home and not top["noise"]:
            home["text_len"] += len(piece)
            home["pieces"] += 1
            if top["linked"]:
                home["link_len"] += len(piece)
            # blocks whose preview is not full; each takes a bounded number of pieces
            for b in self.filling:
                b["preview"] = (b["preview"] + " " + piece).strip()[:PREVIEW_CHARS]
            self.filling = [b for b in self.filling if len(b["preview"]) < PREVIEW_CHARS]

    def _absolute(self, href: str | None) -> str | None:
        if href is None:
            return None
        href = href.strip()
        if self.origin and href[:1] == "/" and href[1:2] != "/" and "/." not in href:
            return self.origin + href
        try:
            return urljoin(self.url, href)
        except ValueError:
            return None

    def row(self, page_id) -> dict:
        while self.open:
            self._end()
        for b in self.blocks:
            b["text_len"] += max(0, b["pieces"] - 1)  # a space between pieces
        seen = set()
        for a in self.anchors:
            a["text"] = " ".join(" ".join(a["text"]).split())
            a["abs_url"] = self._absolute(a["href"])
            link = a["abs_url"]
            a["first"] = bool(link and link.startswith("http") and link not in seen)
            seen.add(link)
        return {
            "page_id": page_id,
            "url": self.url,
            "title": " ".join(self.title) if self.title else None,
            "h1": " ".join(self.h1) if self.h1 else None,
            "canonical_link": self.canonical,
            "meta": list(self.meta.items()),
            "anchors": self.anchors,
            "groups": self.groups,
            "elements": self.elements,
            "pieces": self.pieces,
            "blocks": self.blocks,
        }


def _scan_batches(batches: Iterator[pa.RecordBatch], anchors: bool, blocks: bool, elements: bool) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema()

    def made(rows: list[dict], batch: pa.RecordBatch, end: int) -> pa.RecordBatch:
        """The rows with the kept columns of their pages, which end at ``end``."""
        out = pa.RecordBatch.from_pylist(rows, schema=schema)
        kept = batch.slice(end - len(rows), len(rows)).columns[3:]
        return pa.RecordBatch.from_arrays([*out.columns, *kept], names=[*schema.names, *batch.schema.names[3:]])

    for batch in batches:
        rows, done = [], 0
        for page_id, url, html in zip(*((x.as_py() for x in batch.column(i)) for i in range(3))):
            scanner = _PageScanner(url or "", anchors, blocks, elements)
            scanner.feed(html or "")
            rows.append(scanner.row(page_id))
            if len(rows) == SLICE:
                done += SLICE
                yield made(rows, batch, done)
                rows = []
        yield made(rows, batch, batch.num_rows)


def _arrow_schema() -> pa.Schema:
    s, i, b = pa.string(), pa.int32(), pa.bool_()
    anchor = pa.struct(
        [("pos", i), ("href", s), ("abs_url", s), ("text", s), ("class", s), ("path", s), ("parent_class", s), ("in_chrome", b), ("hidden", b),
         ("first", b)]
    )
    group = pa.struct([("gid", i), ("tag", s), ("id", s), ("class", s), ("from", i), ("after", i)])
    element = pa.struct([("at", i), ("tag", s), ("class", s), ("href", s), ("link", s), ("last", i), ("box", i), ("piece", i), ("pieces", i)])
    block = pa.struct(
        [("pos", i), ("tag", s), ("id", s), ("class", s), ("text_len", i), ("link_len", i), ("img_count", i), ("preview", s)]
    )
    return pa.schema(
        [("page_id", pa.int64()), ("url", s), ("title", s), ("h1", s), ("canonical_link", s), ("meta", pa.map_(s, s)),
         ("anchors", pa.list_(anchor)), ("groups", pa.list_(group)), ("elements", pa.list_(element)), ("pieces", pa.list_(s)), ("blocks", pa.list_(block))]
    )


def scan_pages(pages: DataFrame, anchors: bool = True, blocks: bool = True, elements: bool = False, partitions: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse every page once. Input: page_id, url, html. Head metadata is always read; skip the arrays nobody asks for.

    ``partitions``: deal the pages out to so many tasks before they are parsed, where their files are fewer or of uneven size.
    ``keep``: more columns of the pages, given on beside what is read in them, so that no join has to bring them back.
    """
    scan = partial(_scan_batches, anchors=anchors, blocks=blocks, elements=elements)
    pages = pages.select("page_id", "url", "html", *keep)
    kept = "".join(f", `{name}` {pages.schema[name].dataType.simpleString()}" for name in keep)
    return (pages.repartition(partitions) if partitions else pages).mapInArrow(scan, SCAN_SCHEMA + kept)


def anchor_rows(scan: DataFrame) -> DataFrame:
    """One row per anchor."""
    return scan.select("page_id", F.col("url").alias("page_url"), F.explode("anchors").alias("a")).select("page_id", "page_url", "a.*")


def page_anchors(scan: DataFrame) -> DataFrame:
    """Anchors with an absolute http URL, first occurrence of a URL per page (S10). No shuffle: the scan marks the first."""
    return anchor_rows(scan).where("first")


def page_metadata(scan: DataFrame) -> DataFrame:
    """Title, author, dates, images and canonical URL of every page, with all meta tags."""

    def meta(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at("meta", F.lit(n)), F.lit("")) for n in names])

    title = F.coalesce(meta("og:title", "twitter:title"), F.nullif(F.col("h1"), F.lit("")), F.col("title"), F.lit(""))
    author = F.coalesce(F.nullif(collapse_repeat(meta("og:article:author", "author")), F.lit("")), meta("og:site_name", "publisher"), F.lit(MISSING_AUTHOR))
    return scan.select(
        "page_id",
        "url",
        title.alias("title"),
        clean_title(title).alias("clean_title"),
        author.alias("author"),
        parse_flexible_date(meta("article:published_time", "pubdate", "article:published")).alias("published_at"),
        parse_flexible_date(meta("article:modified_time", "og:updated_time")).alias("modified_at"),
        meta("og:image", "twitter:image").alias("image_url"),
        F.coalesce(meta("og:description", "description"), F.lit("")).alias("description"),
        F.coalesce(meta("og:site_name", "publisher"), F.lit("")).alias("site_name"),
        F.coalesce(meta("og:type"), F.lit("article")).alias("og_type"),
        F.coalesce(F.nullif(F.col("canonical_link"), F.lit("")), meta("og:url"), F.col("url")).alias("canonical_url"),
        F.col("meta").alias("meta_tags"),
    )


def block_selector(b: Column) -> Column:
    """Selector of a text block: its id, else its tag and first class."""
    by_class = F.when(b["class"] != "", F.concat(b["tag"], F.lit("."), F.substring_index(b["class"], ".", 1))).otherwise(b["tag"])
    return F.when(b["id"] != "", F.concat(F.lit("#"), F.lower(b["id"]))).otherwise(by_class)


def page_blocks(scan: DataFrame) -> DataFrame:
    """Text blocks outside page chrome and comment areas."""
    return scan.select("page_id", "url", F.explode("blocks").alias("b")).select("page_id", "url", "b.*", block_selector(F.col("b")).alias("selector"))
