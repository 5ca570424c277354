"""Page extraction: one Arrow-batched parsing stage, everything after it native.

Only turning broken HTML into title, text and references needs Python. Spark
splits the pages over tasks; each batch is parsed where it lies and only the
extracted columns go on. Resolving, filtering and deduplicating references is
done with column expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from curalens.functions.photos import is_photo, original_upload_url, photo_identity, srcset_largest
from curalens.functions.urls import absolute_url

# Parts of a page that are not the article, and where the article usually is.
STRIP_TAGS = {"script", "style", "noscript", "svg", "form"}
CHROME_TAGS = {"nav", "aside", "footer"}
IMAGE_STRIP_TAGS = {"script", "style", "noscript", "header", "footer", "nav", "aside"}
ARTICLE_PLACES = [("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "entry-content"),
                  ("class", "post-content"), ("class", "article-content"), ("class", "article-body")]
IMAGE_PLACES = [("tag", "article"), ("tag", "main"), ("itemprop", "articleBody"), ("class", "entry-content")]
NOISE_MARK = re.compile(
    r"(?:^|[-_\s])(?:related|recirc\w*|recommend\w*|more-?stories|most-?recent|read-?more|trending|popular|newsletter|"
    r"subscribe|promo|advert\w*|author-?bio|byline-?bio|share|social|comments?)(?:[-_\s]|$)", re.IGNORECASE)
SCRIPT_IMAGE = re.compile(r"https?://[^\s\"'<>\\]+\.(?:jpg|jpeg|png|webp)(?:\?[^\s\"'<>\\]*)?", re.IGNORECASE)
LAZY_ATTRS = ("data-src", "data-original", "data-lazy-src", "src")
MIN_ARTICLE_CHARS = 400
#: A marked section outside foreign content; browsers take it for a comment.
BOGUS_DECLARATION = re.compile(r"<!\[[^>]*>?")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "form",
            "article", "section", "aside", "nav", "footer", "header", "main"}
SAME_LEVEL = {"li", "p", "td", "th", "tr", "dt", "dd", "option"}

SCHEMA = ("title string, text string, whole_text string, hrefs array<string>, "
          "image_refs array<struct<kind:string,ref:string>>, parse_error string")


class _Node:
    """An element. Its descendants stand behind it in the flat list of the page, up to ``end``."""
    __slots__ = ("attrs", "end", "flat", "place", "tag", "_noise")

    def __init__(self, tag: str, attrs: dict[str, str], flat: list["_Node | str"]) -> None:
        self.tag, self.attrs, self.flat, self.place, self.end, self._noise = tag, attrs, flat, len(flat), None, None
        flat.append(self)

    @property
    def stop(self) -> int:
        return len(self.flat) if self.end is None else self.end

    def walk(self, skip) -> Iterator["_Node | str"]:
        """Nodes and texts below, in order, without the parts ``skip`` names."""
        at, stop = self.place + 1, self.stop
        while at < stop:
            item = self.flat[at]
            if isinstance(item, str):
                yield item
            elif skip(item):
                at = item.stop
                continue
            else:
                yield item
            at += 1

    def strings(self, skip) -> list[str]:
        return [s.strip() for s in self.walk(skip) if isinstance(s, str) and s.strip()]

    def at(self, kind: str, value: str) -> bool:
        if kind == "tag":
            return self.tag == value
        if kind == "class":
            return value in self.attrs.get("class", "").split()
        return self.attrs.get(kind) == value

    @property
    def noise(self) -> bool:
        if self._noise is None:
            self._noise = (self.tag in STRIP_TAGS or self.tag in CHROME_TAGS
                           or bool(NOISE_MARK.search(f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}")))
        return self._noise


class _Tree(HTMLParser):
    """Small forgiving tree builder. Elements left open end with the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, [])
        self.open = [self.root]
        self.counts: Counter[str] = Counter()

    def _close(self, tag: str, stop: set[str]) -> None:
        if not self.counts[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                for node in self.open[at:]:
                    node.end = len(self.root.flat)
                    self.counts[node.tag] -= 1
                del self.open[at:]
                return
            if self.open[at].tag in stop:
                return

    def handle_starttag(self, tag, attrs) -> None:
        if tag in CLOSES_P:
            self._close("p", {"article", "section", "div", "td", "li", "body", "blockquote"} - {tag})
        if tag in SAME_LEVEL and tag != "p":
            self._close(tag, {"ul", "ol", "table", "dl", "select", "tr"} - {tag})
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.root.flat)
        if tag in VOID:
            node.end = len(self.root.flat)
        else:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_endtag(self, tag) -> None:
        self._close(tag, set())

    def handle_data(self, data) -> None:
        self.root.flat.append(data)


def _built(html: str) -> tuple[_Node, str | None]:
    """The tree of a page, and what was wrong with its markup.

    Declarations that the parser can't read are left out; if it still fails, the page is its text
    without tags.
    """
    problem = None
    for source in (html, BOGUS_DECLARATION.sub("", html)):
        parser = _Tree()
        try:
            parser.feed(source)
            parser.close()
            return parser.root, problem
        except (AssertionError, ValueError, RecursionError) as error:
            problem = f"{type(error).__name__}: {error}"
    root = _Node("", {}, [])
    root.flat.append(re.sub(r"<[^>]*>", " ", html))
    return root, problem


def _is_stripped(node: _Node) -> bool:
    return node.tag in STRIP_TAGS


def _is_noise(node: _Node) -> bool:
    return node.noise


def _first(root: _Node, skip, kind: str, value: str) -> _Node | None:
    return next((n for n in root.walk(skip) if isinstance(n, _Node) and n.at(kind, value)), None)


def _meta(root: _Node, name: str) -> str:
    found = (n for n in root.walk(_is_stripped) if isinstance(n, _Node) and n.tag == "meta"
             and n.attrs.get("property") == name and n.attrs.get("content"))
    node = next(found, None)
    return node.attrs["content"].strip() if node else ""


def _article(tree: _Node) -> _Node:
    for kind, value in ARTICLE_PLACES:
        node = _first(tree, _is_stripped, kind, value)
        if node is not None and len("".join(node.strings(_is_noise))) >= MIN_ARTICLE_CHARS:
            return node
    return _first(tree, _is_stripped, "tag", "body") or tree


def _image_refs(tree: _Node) -> list[dict[str, str]]:
    def skip(node: _Node) -> bool:
        return node.tag in IMAGE_STRIP_TAGS

    refs = []
    lead = _meta(tree, "og:image")
    if lead:
        refs.append({"kind": "url", "ref": lead})
    scope = next((n for kind, value in IMAGE_PLACES if (n := _first(tree, skip, kind, value)) is not None), tree)
    for img in (n for n in scope.walk(skip) if isinstance(n, _Node) and n.tag == "img"):
        srcset = img.attrs.get("srcset") or img.attrs.get("data-srcset")
        plain = next((img.attrs[a].strip() for a in LAZY_ATTRS if img.attrs.get(a)), "")
        if srcset:
            refs.append({"kind": "srcset", "ref": srcset})
        elif plain:
            refs.append({"kind": "url", "ref": plain})
    scripts = (n for n in tree.walk(lambda n: False) if isinstance(n, _Node) and n.tag == "script")
    for script in scripts:
        body = "".join(s for s in script.walk(lambda n: True) if isinstance(s, str)).replace("\\/", "/")
        refs.extend({"kind": "url", "ref": m.group(0)} for m in SCRIPT_IMAGE.finditer(body))
    return refs


def parse_page(html: str | None) -> dict:
    """Title, article text, page text, raw links, raw image references and parse error of one page."""
    tree, problem = _built(html or "")
    title_node = _first(tree, _is_stripped, "tag", "title")
    title = _meta(tree, "og:title") or (" ".join(title_node.strings(_is_stripped)) if title_node else "")
    root = _article(tree)
    parts = [" ".join(n.strings(_is_noise)) for n in root.walk(_is_noise) if isinstance(n, _Node) and n.tag == "p"]
    body = " ".join(" ".join(parts).split())
    if len(body) < MIN_ARTICLE_CHARS:
        body = " ".join(" ".join(root.strings(_is_noise)).split())
    links = [n.attrs["href"].strip() for n in root.walk(_is_noise) if isinstance(n, _Node) and n.tag == "a"
             and n.attrs.get("href")]
    return {"title": title or None, "text": " ".join(p for p in (title, body) if p),
            "whole_text": " ".join(tree.strings(lambda n: n.tag in {"script", "style", "template"})),
            "hrefs": [h for h in links if h and not h.startswith(("javascript:", "mailto:", "#"))],
            "image_refs": _image_refs(tree), "parse_error": problem}


def extract_pages(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Add the parsed columns to ``keep``. The raw HTML does not travel further.

    Every page gives a row; ``parse_error`` tells where its markup could not be read as it stands."""
    kept = pages.select(*keep, html)
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keep)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = pd.DataFrame([parse_page(x) for x in frame[html]], index=frame.index,
                                  columns=["title", "text", "whole_text", "hrefs", "image_refs", "parse_error"])
            yield pd.concat([frame[keep], parsed], axis=1)

    return kept.mapInPandas(batches, f"{kept_schema}, {SCHEMA}")


def resolved_links(hrefs: Column, base: Column) -> Column:
    """Absolute links of a page, each once, in order."""
    return F.array_distinct(F.transform(hrefs, lambda h: absolute_url(h, base)))


def image_urls(refs: Column, base: Column, limit: int | None = None, skip_lead: Column | None = None) -> Column:
    """Photo URLs in page order, one per photo. ``limit`` is how many a listing may offer; without it all are kept."""
    urls = F.transform(refs, lambda r: F.when(r["kind"] == "srcset", srcset_largest(r["ref"], base))
                       .otherwise(absolute_url(r["ref"], base)))
    photos = F.transform(F.filter(urls, lambda u: u.isNotNull() & is_photo(u)),
                         lambda u: original_upload_url(u))
    keys = F.transform(photos, lambda u: photo_identity(u))
    kept = F.filter(F.arrays_zip(photos.alias("url"), keys.alias("key")),
                    lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    every = F.transform(kept, lambda p: p["url"])
    first = every if limit is None else F.slice(every, 1, limit)
    if skip_lead is None:
        return first
    return F.when(skip_lead & (F.size(first) > 1), F.slice(first, F.lit(2), F.size(first))).otherwise(first)


# --- native columns over raw HTML -------------------------------------------

def html_title(html: Column) -> Column:
    """og:title, else the title element, straight from the markup."""
    og = F.regexp_extract(html, r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    plain = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.coalesce(F.nullif(F.trim(og), F.lit("")), F.nullif(F.trim(plain), F.lit("")))


def html_links(html: Column, base: Column) -> Column:
    """Absolute targets of all anchors, each once, in order."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)),
                        lambda h: F.trim(h))
    good = F.filter(hrefs, lambda h: (h != "") & ~h.startswith("javascript:") & ~h.startswith("mailto:")
                    & ~h.startswith("#"))
    return resolved_links(good, base)
