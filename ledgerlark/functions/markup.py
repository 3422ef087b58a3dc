"""HTML and XML: expressions where a pattern decides, Arrow-batched parsers where structure does."""

from __future__ import annotations

import html
import unicodedata
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, squeeze, strip_tags
from .vectorized import vectorized


@vectorized("string")
def unescape_all(texts: pd.Series) -> pd.Series:
    """Every named and numeric reference."""
    return texts.map(lambda t: html.unescape(t) if t is not None else None)


@vectorized("string")
def unaccent_exact(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, lower case, for every script (text.unaccent covers Latin in the JVM)."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower())


@vectorized("string")
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", x) if x is not None else None for b, x in zip(base, link, strict=True)])


def absolute_url(base: Column | str, link: Column | str) -> Column:
    """Absolute addresses kept, '//host' gets https, '/path' the base; other relative ones are joined to the base's folder."""
    b, x = col(base), F.trim(col(link))
    root = F.regexp_extract(b, r"^([a-zA-Z]+://[^/]+)", 1)
    return (
        F.when(x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), x)
        .when(F.startswith(x, F.lit("//")), F.concat(F.lit("https:"), x))
        .when(F.startswith(x, F.lit("/")), F.concat(root, x))
        .otherwise(F.concat(F.regexp_replace(F.when(b.rlike("^[a-zA-Z]+://[^/]+$"), F.concat(b, F.lit("/"))).otherwise(b), "/[^/]*$", "/"), x))
    )


def meta_content(doc: Column | str, name: str) -> Column:
    """content of <meta property|name="name">, in either order of attributes; null if absent."""
    n = name.replace(".", r"\.")
    one = rf'(?is)<meta[^>]+(?:property|name)=["\']{n}["\'][^>]+content=["\']([^"\']*)["\']'
    two = rf'(?is)<meta[^>]+content=["\']([^"\']*)["\'][^>]+(?:property|name)=["\']{n}["\']'
    return F.coalesce(*[F.nullif(F.regexp_extract(col(doc), rx, 1), F.lit("")) for rx in (one, two)])


def first_tag(doc: Column | str, tag: str) -> Column:
    return F.nullif(squeeze(strip_tags(F.regexp_extract(col(doc), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))), F.lit(""))


def title(doc: Column | str) -> Column:
    """og:title, then twitter:title, the first heading, the title element."""
    return F.coalesce(meta_content(doc, "og:title"), meta_content(doc, "twitter:title"), first_tag(doc, "h1"), first_tag(doc, "title"))


def links(doc: Column | str, pattern: str | None = None) -> Column:
    """Distinct link targets in order, those that match `pattern` only if given."""
    out = F.array_distinct(F.regexp_extract_all(col(doc), F.lit(r'(?i)<a[^>]+href=["\']([^"\']+)["\']'), F.lit(1)))
    return F.filter(out, lambda x: x.rlike(pattern)) if pattern else out


def json_ld(doc: Column | str) -> Column:
    """The JSON-LD blocks, as text."""
    return F.regexp_extract_all(col(doc), F.lit(r'(?is)<script[^>]+type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))


def article_json_ld(doc: Column | str) -> Column:
    """The first block that is an article: struct<type, headline, author, published, body>; null if none parses."""
    schema = "struct<`@type`:string,headline:string,author:struct<name:string>,datePublished:string,articleBody:string>"
    parsed = F.transform(json_ld(doc), lambda j: F.from_json(j, schema))
    kinds = ("Article", "NewsArticle", "BlogPosting", "ReportageNewsArticle")
    return F.get(F.filter(parsed, lambda j: j["@type"].isin(*kinds)), F.lit(0))


def author(doc: Column | str) -> Column:
    byline = F.nullif(squeeze(strip_tags(F.regexp_extract(col(doc), r'(?is)<[a-z]+[^>]+class=["\'][^"\']*\bauthor\b[^"\']*["\'][^>]*>(.*?)</', 1))), F.lit(""))
    return F.coalesce(article_json_ld(doc)["author"]["name"], meta_content(doc, "author"), meta_content(doc, "article:author"), byline)


def published(doc: Column | str) -> Column:
    time = F.nullif(F.regexp_extract(col(doc), r'(?is)<time[^>]+datetime=["\']([^"\']+)["\']', 1), F.lit(""))
    return F.coalesce(meta_content(doc, "article:published_time"), meta_content(doc, "date"), time)


def body(doc: Column | str) -> Column:
    """The article element (else the whole page) without scripts, styles, comments and tags."""
    page = F.regexp_replace(col(doc), r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " ")
    inner = F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    return squeeze(strip_tags(F.when(inner != "", inner).otherwise(page)))


# --- feeds -----------------------------------------------------------------------------------------

ENTRY = "struct<title:string,link:string,creator:string,published:string,updated:string,summary:string,content:string>"


def parse_entries(xml: str | None) -> list[dict]:
    """Entries of an RSS or Atom document, in order; not well-formed gives none."""
    try:
        root = ET.fromstring((xml or "").strip().encode())
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for item in (e for e in root.iter() if local(e) in ("item", "entry")):
        held: dict[str, str] = {}
        for child in item:
            name = local(child)
            value = "".join(child.itertext()).strip() or child.get("href") or ""
            full = "content" if name == "encoded" else {"description": "summary", "pubDate": "published", "author": "creator", "date": "published"}.get(name, name)
            held.setdefault(full, value)
        out.append({k: held.get(k) for k in ("title", "link", "creator", "published", "updated", "summary", "content")})
    return out


@vectorized(f"array<{ENTRY}>")
def feed_entries(documents: pd.Series) -> pd.Series:
    return documents.map(parse_entries)


# --- profile timelines -------------------------------------------------------------------------------

POST = (
    "struct<link:string,content:string,date:string,is_retweet:boolean,is_reply:boolean,is_quote:boolean,reply_to_handle:string,"
    "quoted_link:string,quoted_handle:string,quoted_content:string,media:string,replies:string,retweets:string,quotes:string,likes:string>"
)
TIMELINE = f"struct<posts:array<{POST}>,next_cursor:string>"
_VOID = {"img", "br", "hr", "input", "meta", "link", "source", "wbr"}


class _Timeline(HTMLParser):
    """Collects posts from class names on the open-element stack; knows nothing of layout."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str]]] = []
        self.posts: list[dict] = []
        self.cursor: str | None = None
        self.now: dict | None = None
        self.depth = 0
        self.icon: str | None = None

    def inside(self, name: str) -> bool:
        return any(name in c for _, c in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").split())
        if tag not in _VOID:
            self.open.append((tag, classes))
        if "timeline-item" in classes and not classes & {"show-more", "unavailable"}:
            self.now, self.depth = {"text": [], "date": None, "link": "", "quote": False, "stats": {}, "reply": [], "q": {}}, len(self.open)
        if tag == "a" and self.inside("show-more") and "cursor=" in a.get("href", "") and not self.cursor:
            self.cursor = a["href"]
        p = self.now
        if p is None:
            return
        if "retweet-header" in classes:
            p["retweet"] = True
        if "replying-to" in classes:
            p["replying"] = True
        if "quote" in classes:
            p["quote"] = True
        if tag == "a":
            if self.inside("quote"):
                if "quote-link" in classes:
                    p["q"].setdefault("link", a.get("href"))
            elif self.inside("tweet-date"):
                p["date"], p["link"] = p["date"] or a.get("title"), a.get("href") or p["link"]
            elif "tweet-link" in classes:
                p["link"] = p["link"] or a.get("href", "")
        for icon in ("comment", "retweet", "quote", "heart"):
            if f"icon-{icon}" in classes:
                self.icon = icon
        if tag == "video" or tag == "img" and (self.inside("attachment") or self.inside("still-image")):
            p.setdefault("media", a.get("src") or a.get("data-url"))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, classes = self.open.pop()
            if "tweet-stat" in classes:
                self.icon = None
            if self.now is not None and len(self.open) < self.depth:
                self.finish()
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        p = self.now
        if p is None:
            return
        if self.inside("quote"):
            if self.inside("quote-text"):
                p["q"]["text"] = p["q"].get("text", "") + data
            elif self.inside("username"):
                p["q"]["user"] = p["q"].get("user", "") + data
        elif self.inside("tweet-content"):
            p["text"].append(data)
        elif self.inside("replying-to") and self.open and self.open[-1][0] == "a":
            p["reply"].append(data)
        elif self.inside("tweet-stat") and self.icon:
            p["stats"][self.icon] = p["stats"].get(self.icon, "") + data

    def finish(self) -> None:
        p, self.now = self.now, None
        content = "".join(p["text"]).strip()
        if not content:
            return
        stat = lambda k: p["stats"].get(k)
        user = (p["q"].get("user") or "").strip().lstrip("@") or ((p["q"].get("link") or "").lstrip("/").split("/")[0] or None)
        self.posts.append({
            "link": p["link"], "content": content, "date": p["date"], "is_retweet": bool(p.get("retweet")), "is_reply": bool(p.get("replying")), "is_quote": p["quote"],
            "reply_to_handle": (p["reply"][0].strip().lstrip("@") or None) if p["reply"] else None, "quoted_link": p["q"].get("link"), "quoted_handle": user if p["quote"] else None,
            "quoted_content": (p["q"].get("text") or "").strip() or None, "media": p.get("media"), "replies": stat("comment"), "retweets": stat("retweet"), "quotes": stat("quote"), "likes": stat("heart"),
        })


def parse_timeline(document: str | None) -> dict:
    parser = _Timeline()
    parser.feed(document or "")
    parser.close()
    if parser.now is not None:
        parser.finish()
    return {"posts": parser.posts, "next_cursor": parser.cursor}


@vectorized(TIMELINE)
def timeline(documents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_timeline(d) for d in documents], columns=["posts", "next_cursor"])
