"""HTML to rows: one pass of the standard parser per page, run in Arrow batches (mapInPandas).

Seen-before logic, filters and counts stay outside as DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

#: Elements without an end tag, and attributes that hold an image address, in the order they are tried.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SOURCE_ATTRIBUTES = ["src", "data-src", "data-original", "data-lazy-src", "data-url", "data-image", "data-srcset", "srcset"]
META_IMAGES = {"og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src"}
#: Parts of the address of a page about a video.
VIDEO_PATHS = ["/video/", "/videos/", "/watch", "/player/"]
TEXT_CONTEXT = 220
#: Links of an article that tell of its images, and the longest text taken over.
LINKS_TOLD, LONGEST_TEXT = 4, 300

IMAGE_SCHEMA = (
    "page_url string, idx int, url string, kind string, source_attr string, alt string, title string, img_class string, img_id string, "
    "parent_tag string, parent_class string, parent_id string, srcset string, loading string, declared_width int, declared_height int, context string, "
    "resolved_alt string, resolved_title string"
)
LINK_SCHEMA = "page_url string, idx int, href string, url string, text string"
META_SCHEMA = "page_url string, title string, n_images int, n_links int, is_video boolean"

_DESCRIPTOR = re.compile(r"([0-9]+(?:\.[0-9]+)?)([wx])")


def best_source(srcset: str) -> str:
    """The largest source of a srcset: widths as they are, densities in thousands; the last on ties, the first without any."""
    best, size = "", -1.0
    for entry in re.split(r",\s+|(?<=\d[wx]),", srcset.strip()):
        parts = entry.strip(" ,").split()
        if not parts:
            continue
        m = _DESCRIPTOR.fullmatch(parts[-1].lower()) if len(parts) > 1 else None
        n = float(m[1]) * (1000 if m[2] == "x" else 1) if m else 0.0
        if n > size or n == size and n > 0:
            best, size = parts[0], n
    return best


_CSS_URL = re.compile(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""")


class PageParser(HTMLParser):
    """Collects images (with their context), links, title and meta entries of one page; tolerates unclosed elements."""

    def __init__(self, page_url: str):
        super().__init__(convert_charrefs=True)
        self.page_url, self.images, self.links, self.meta = page_url, [], [], {}
        self.title, self._stack, self._headings, self._style, self._in_title, self._link = "", [], "", False, False, None

    def _add(self, url: str | None, kind: str, attr: str, a: dict) -> None:
        url = (url or "").strip()
        if not url or url.startswith(("data:", "blob:", "javascript:")):
            return
        parent = self._stack[-1] if self._stack else {"tag": "", "attrs": {}, "text": []}
        whole = lambda v: int(v) if (v or "").strip().isdigit() else None
        row = {
            "url": urljoin(self.page_url, url), "kind": kind, "source_attr": attr, "alt": (a.get("alt") or "").strip(), "title": (a.get("title") or "").strip(), "img_class": a.get("class") or "",
            "img_id": a.get("id") or "", "parent_tag": parent["tag"], "parent_class": parent["attrs"].get("class") or "", "parent_id": parent["attrs"].get("id") or "", "srcset": a.get("srcset") or "",
            "loading": a.get("loading") or "", "declared_width": whole(a.get("width")), "declared_height": whole(a.get("height")), "context": (a.get("aria-label") or "").strip(),
        }
        around = lambda tag: next((e for e in reversed(self._stack) if e["tag"] == tag), None)
        self.images.append((row, around("figure"), around("article"), parent, self._headings))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("img", "amp-img"):
            found = False
            for name in SOURCE_ATTRIBUTES:
                if a.get(name) and not found:
                    found = True
                    self._add(best_source(a[name]) if "srcset" in name else a[name], tag, name, a)
        elif tag == "source" and a.get("srcset") and any(e["tag"] == "picture" for e in self._stack):
            self._add(best_source(a["srcset"]), "source", "srcset", a)
        elif tag == "video" and a.get("poster"):
            self._add(a["poster"], "poster", "poster", a)
        elif tag == "link" and "preload" in a.get("rel", "") and a.get("as") == "image":
            self._add(a.get("href"), "preload", "href", a)
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            self.meta.setdefault(name, a.get("content", ""))
            if name in META_IMAGES:
                self._add(a.get("content"), "meta", name, {})
        elif tag == "a" and a.get("href") is not None:
            self._link = [a["href"], []]
            self.links.append(self._link)
        for url in _CSS_URL.findall(a.get("style", "")):
            self._add(url, "background", "style", a)
        self._style, self._in_title = tag == "style", tag == "title" or self._in_title
        if tag not in VOID:
            self._stack.append({"tag": tag, "attrs": a, "text": []})

    def handle_endtag(self, tag):
        self._in_title = self._in_title and tag != "title"
        self._style = False
        if tag == "a":
            self._link = None
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i]["tag"] == tag:
                text = " ".join("".join(self._stack[i]["text"]).split())
                if tag in ("h1", "h2", "h3"):
                    self._headings = text
                if tag in ("h1", "h2", "h3", "p", "a"):
                    for e in self._stack[:i]:
                        if e["tag"] == "article" and len(told := e.setdefault("told", {}).setdefault(tag, [])) < (LINKS_TOLD if tag == "a" else 1):
                            told.append(text)
                del self._stack[i:]
                break

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        if self._style:
            for url in _CSS_URL.findall(data):
                self._add(url, "background", "style", {})
            return
        for e in self._stack:
            e["text"].append(data)
            if e["tag"] == "figcaption":
                for f in self._stack:
                    if f["tag"] == "figure":
                        f.setdefault("caption", []).append(data)
        if self._link is not None:
            self._link[1].append(data)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def rows(self) -> Iterator[dict]:
        """Images in order; the context is the label, the figure's caption, the text around, or the last heading.

        A missing alternative text or title is taken from the texts beside: the caption, then of the article headings,
        the first links and the first paragraph, then the text around; the first of these is the text, the second the title.
        """
        squeezed = lambda parts: " ".join("".join(parts).split())
        for row, figure, article, parent, heading in self.images:
            caption, around = squeezed((figure or {}).get("caption", [])), squeezed(parent["text"])
            row["context"] = row["context"] or caption or around[:TEXT_CONTEXT] or heading
            told = (article or {}).get("told", {})
            beside = [caption, *(t for tag in ("h1", "h2", "h3", "a", "p") for t in told.get(tag, [])), around]
            beside = list(dict.fromkeys(_cleaned(t) for t in beside if t))
            both = bool(row["alt"] and row["title"])
            row["resolved_alt"] = _cleaned(row["alt"]) or (beside[0] if beside and not both else "")
            row["resolved_title"] = _cleaned(row["title"]) or (beside[1] if len(beside) > 1 and not both else "")
            yield row


def _cleaned(text: str, most: int = LONGEST_TEXT) -> str:
    text = " ".join(text.split())
    return text[:most].rstrip() + "..." if len(text) > most else text


def parse(html: str | None, page_url: str) -> PageParser:
    """Parses a page; the content of noscript elements is read like any other."""
    p = PageParser(page_url or "")
    p.feed(html or "")
    p.close()
    return p


class LinkParser(HTMLParser):
    """Only the links of a page, as PageParser has them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self._link = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            a = dict(attrs)
            if "href" in a:
                self._link = [a["href"] or "", []]
                self.links.append(self._link)

    def handle_endtag(self, tag):
        if tag == "a":
            self._link = None

    def handle_data(self, data):
        if self._link is not None:
            self._link[1].append(data)


def page_links_of(html: str | None) -> list[list]:
    p = LinkParser()
    p.feed(html or "")
    p.close()
    return p.links


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    for c in schema.split(", "):
        if c.endswith(" int"):
            df[c.split()[0]] = df[c.split()[0]].astype("Int64")
    return df


def page_images(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per image reference of every page."""

    def run(batches):
        for b in batches:
            rows = []
            for u, h in zip(b[url], b[html]):
                rows += [{"page_url": u, "idx": i, **r} for i, r in enumerate(parse(h, u).rows())]
            yield _frame(rows, IMAGE_SCHEMA)

    return pages.select(url, html).mapInPandas(run, IMAGE_SCHEMA)


def page_link_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for u, h in zip(b[url], b[html]):
                rows += [(u, i, x, urljoin(u or "", x), " ".join("".join(t).split())) for i, (x, t) in enumerate(page_links_of(h))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINK_SCHEMA.split(", ")])

    return pages.select(url, html).mapInPandas(run, LINK_SCHEMA)


def page_facts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Title, counts and whether a page is about a video (its address, og:type or a twitter player)."""

    def run(batches):
        for b in batches:
            rows = []
            for u, h in zip(b[url], b[html]):
                p = parse(h, u)
                video = "video" in p.meta.get("og:type", "").lower() or any("player" in p.meta.get(k, "").lower() for k in ("twitter:card", "twitter:player"))
                video |= any(w in (u or "").lower() for w in VIDEO_PATHS)
                rows.append({"page_url": u, "title": " ".join(p.title.split()), "n_images": len(p.images), "n_links": len(p.links), "is_video": video})
            yield _frame(rows, META_SCHEMA)

    return pages.select(url, html).mapInPandas(run, META_SCHEMA)
