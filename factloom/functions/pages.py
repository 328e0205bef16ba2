"""What a web page says of itself: structured data first, then meta tags, then its title and article.

HTML and JSON-LD have no Catalyst expression, so one Arrow-batched function reads a page once, with the standard library's
parsers, and gives all fields.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import any_date, epoch_date
from .urls import absolute, is_public

#: Kinds of structured nodes that tell of a page's content, and titles of pages that ask for a human.
KINDS = {"videoobject", "newsarticle", "article", "socialmediaposting"}
CHALLENGE = "(?i)access denied|captcha|just a moment|attention required"
#: Fixed value: metadata are read from so many characters of a page; its article blocks from all of it.
PAGE_CHARS = 1_000_000
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("node_title", "node_description", "node_date", "author", "author_url", "publisher", "publisher_url", "meta", "title", "canonical", "excerpt")])


class _Reader(HTMLParser):
    """Collects meta tags, structured data, the title, the canonical link and the text of the first article or main."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta, self.scripts, self.title, self.canonical = {}, [], [], None
        self.text = {"article": [], "main": []}
        self.depth = {"article": 0, "main": 0}
        self.inside, self.done = None, set()

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag == "meta" and found.get("content"):
            for key in ("property", "name", "itemprop"):
                if key in found:
                    self.meta.setdefault((key, found[key]), found["content"])
        elif tag == "link" and self.canonical is None and "canonical" in found.get("rel", "").split():
            self.canonical = found.get("href", "")
        elif tag in ("script", "style"):
            self.inside = "ld" if tag == "script" and re.search("ld\\+json", found.get("type", ""), re.I) else tag
            if self.inside == "ld":
                self.scripts.append([])
        elif tag == "title" and "title" not in self.done:
            self.inside = "title"
        if tag in self.depth and tag not in self.done:
            self.depth[tag] += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            if self.inside == "title":
                self.done.add("title")
            self.inside = None
        if tag in self.depth and self.depth[tag]:
            self.depth[tag] -= 1
            if not self.depth[tag]:
                self.done.add(tag)

    def handle_data(self, data):
        if self.inside == "ld":
            self.scripts[-1].append(data)
        elif self.inside == "title":
            self.title.append(data)
        elif self.inside is None:
            for tag, depth in self.depth.items():
                if depth and data.strip():
                    self.text[tag].append(data.strip())


def nodes(value) -> Iterator[dict]:
    """All objects within a JSON value, outer ones first."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack += reversed(v.values())
        elif isinstance(v, list):
            stack += reversed(v)


def _kinds(node: dict) -> set[str]:
    found = node.get("@type") or []
    return {str(x).casefold() for x in ([found] if isinstance(found, str) else found)}


def _entity(value) -> tuple[str | None, str | None]:
    """Name and link of a person or an organisation."""
    if isinstance(value, list):
        value = next((x for x in value if x), None)
    if isinstance(value, dict):
        link = value.get("url") or value.get("sameAs")
        link = next((x for x in link if x), None) if isinstance(link, list) else link
        return _text(value.get("name")), str(link) if link else None
    if isinstance(value, str):
        return (None, value) if re.match("https?://", value) else (_text(value), None)
    return None, None


def _text(value, most: int = 300, *, read: bool = False) -> str | None:
    """Cleaned and cut. What a parser has read holds no character references any more."""
    told = str(value if value is not None else "")
    plain = " ".join(re.sub("<[^>]+>", " ", told if read else html.unescape(told)).split())
    return plain[:most] or None


def _read(page: str | None) -> tuple:
    reader = _Reader()
    try:
        reader.feed((page or "")[:PAGE_CHARS])
        reader.close()
    except (AssertionError, ValueError):
        pass
    found = []
    for script in reader.scripts:
        try:
            found += [n for n in nodes(json.loads("".join(script))) if _kinds(n) & KINDS]
        except ValueError:
            continue
    found.sort(key=lambda n: "videoobject" not in _kinds(n))
    first = lambda *keys: next((n[k] for n in found for k in keys if n.get(k)), None)
    people = [[_entity(n.get(k)) for n in found] for k in ("author", "publisher")]
    names = [next((x[i] for x in who if x[i]), None) for who in people for i in (0, 1)]
    date = first("uploadDate", "datePublished")
    meta = json.dumps({f"{k}\n{n}": v for (k, n), v in reader.meta.items()}, ensure_ascii=False)
    body = reader.text["article"] or reader.text["main"]
    return (_text(first("headline", "name"), 1000), _text(first("description"), 10000), None if date is None else str(date), *names, meta, _text(" ".join(reader.title), 1000, read=True), reader.canonical, " ".join(" ".join(body).split())[:1200] or None)


@F.pandas_udf(RAW)
def _parsed(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(x) for x in pages], columns=RAW.names, dtype=object)


def whole_references(page: Column) -> Column:
    """The page with every ampersand written out that begins no character reference ending in a semicolon.

    HTML reads `&amp` without one as a reference too, so a text that was escaped and then cut would end in another
    character than was written. Not for pages with scripts: what these hold isn't decoded.
    """
    return F.regexp_replace(page, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def _meta(found: Column, *names: str) -> Column:
    """The first meta tag of these names, whichever attribute names it, cleaned."""
    every = [F.try_element_at(found, F.lit(f"{key}\n{name}")) for name in names for key in ("property", "name", "itemprop")]
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(*every), "<[^>]+>", " "), r"(?U)\s+", " "))
    return F.substring(F.nullif(clean, F.lit("")), 1, 10000)


def metadata(rows: DataFrame, page: str, url: str) -> DataFrame:
    """Adds title, description, author, author_url, publisher, publisher_url, site_name, uploader_name, uploader_profile, published_at, canonical_url, context_excerpt and challenge.

    Structured data come before meta tags, and those before the page's title. Links are made whole by the page's own;
    such as aren't public are left out. Of a page PAGE_CHARS characters are read. A page whose title asks for a human (`challenge`) tells nothing.
    """
    p = rows.withColumn("__p", _parsed(F.col(page))).withColumn("__m", F.from_json("__p.meta", "map<string,string>"))
    m, base = F.col("__m"), F.col(url)
    own = _meta(m, "author", "article:author")
    linked = F.coalesce(is_public(own), F.lit(False))
    title = F.coalesce("__p.node_title", F.substring(_meta(m, "og:title", "twitter:title"), 1, 1000), "__p.title")
    author = F.coalesce("__p.author", F.when(~linked, F.substring(own, 1, 300)))
    author_url = F.coalesce(absolute(F.col("__p.author_url"), base), F.when(linked, own))
    publisher, publisher_url = F.col("__p.publisher"), absolute(F.col("__p.publisher_url"), base)
    site = _meta(m, "og:site_name")
    date = F.coalesce("__p.node_date", _meta(m, "article:published_time", "datePublished", "uploadDate", "date", "pubdate"))
    out = {
        "title": title, "description": F.coalesce("__p.node_description", _meta(m, "og:description", "description", "twitter:description")), "author": author, "author_url": author_url,
        "publisher": publisher, "publisher_url": publisher_url, "site_name": site, "uploader_name": F.coalesce(author, publisher, site), "uploader_profile": F.coalesce(author_url, publisher_url),
        "published_at": F.coalesce(any_date(date), F.when(date.rlike(r"^\d{9,13}$"), epoch_date(date.try_cast("bigint")))), "canonical_url": F.coalesce(absolute(F.col("__p.canonical"), base), base), "context_excerpt": F.col("__p.excerpt"),
    }
    challenge = F.coalesce(title.rlike(CHALLENGE), F.lit(False))
    return p.select(*rows.columns, *(F.when(~challenge, v).alias(k) for k, v in out.items()), challenge.alias("challenge"))


def filled_from(own: dict[str, Column], page: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """Of each field the value and where it is from: what was supplied (yt_dlp), else what the page says (html)."""
    has = lambda v: v.isNotNull() & (F.trim(v) != "")
    return {k: (F.when(has(v), v).when(has(page[k]), page[k]), F.when(has(v), "yt_dlp").when(has(page[k]), "html")) for k, v in own.items()}


def lenient_json(text: Column) -> Column:
    """The JSON that a model's answer holds, in canonical form: fences and words around it, raw control characters and Python literals are tolerated; null if there is none."""
    return _lenient(text)


def _balanced(text: str) -> str | None:
    if "```" in text:
        text = max(text.split("```"), key=lambda part: part.count("{") + part.count("["))
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    end = text.rfind("}" if start.group() == "{" else "]")
    return text[start.start() : end + 1] if end > start.start() else None


def _answer(text: str | None):
    import ast

    body = _balanced(text or "")
    if body is None:
        return None
    # strict=False takes control characters within strings; raw_decode what follows a whole value.
    try:
        return json.JSONDecoder(strict=False).raw_decode(body)[0]
    except ValueError:
        pass
    try:
        return ast.literal_eval(body)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _lenient(texts: pd.Series) -> pd.Series:
    found = (_answer(x) for x in texts)
    return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True, default=str) for x in found], dtype=object)


#: Words of titles that tell nothing of a page's topic.
IDLE = ["this", "that", "with", "from", "have", "will", "when", "what", "news", "video", "watch", "breaking", "latest", "live", "updates"]
_BLOCK = T.StructType([T.StructField("text", T.StringType()), T.StructField("heads", T.ArrayType(T.StringType()))])


class _Blocks(HTMLParser):
    """The parts of a page that may hold its article, each with its whole text and its headings, nested ones within outer ones too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.silent = [], [], 0
        self.root, self.body = {"rank": 2, "text": [], "heads": []}, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.silent += 1
        if tag in VOID or self.silent:
            return
        block = None
        if tag in ("article", "main") or "articleBody" in (dict(attrs).get("itemprop") or "").split():
            block = {"rank": 0 if tag in ("article", "main") else 1, "text": [], "heads": []}
            self.found.append(block)
        elif tag == "body" and self.body is None:
            block = self.body = {"rank": 2, "text": [], "heads": []}
        head = [] if tag in ("h1", "h2") else None
        if head is not None:
            for holder in self._holders():
                holder["heads"].append(head)
        self.open.append((tag, block, head))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.silent = max(0, self.silent - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def _holders(self):
        return [self.root, *(block for _, block, _ in self.open if block is not None)]

    def handle_data(self, data):
        text = data.strip()
        if text and not self.silent:
            for holder in self._holders():
                holder["text"].append(text)
            for _, _, head in self.open:
                if head is not None:
                    head.append(text)

    def blocks(self) -> list[dict]:
        parts = sorted(self.found, key=lambda b: b["rank"]) or [self.body or self.root]
        return [{"text": " ".join(b["text"]), "heads": [" ".join(h) for h in b["heads"]]} for b in parts]


def _blocks_of(page: str | None) -> list[dict]:
    reader = _Blocks()
    try:
        reader.feed(page or "")
        reader.close()
    except (AssertionError, ValueError):
        pass
    return reader.blocks()


@F.pandas_udf(T.ArrayType(_BLOCK))
def blocks(pages: pd.Series) -> pd.Series:
    """A page's articles and mains as they stand, then its other article bodies; the whole body where there are none. Texts within scripts and styles don't count."""
    return pd.Series([_blocks_of(x) for x in pages], dtype=object)


def topic_words(text: Column) -> Column:
    """Distinct runs of four letters or more in lower case, without those that tell nothing."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[^\W\d_]{4,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(IDLE)))


def article(rows: DataFrame, page: str, title: str, description: str, out: str = "article") -> DataFrame:
    """Adds the text of the block that fits a page's title best, or its description where the title has no words of its own.

    Best is the block with most words of these in one of its headings, then most in its first 1500 characters, then the
    shortest, then the first. A block of less than 300 characters with a heading, but none of these words, is a card
    of another story: null. The blocks of one page are compared within its row.
    """
    own, more = topic_words(F.col(title)), topic_words(F.col(description))
    rows = rows.withColumns({"__blocks": blocks(F.col(page)), "__topic": F.when(F.size(own) > 0, own).otherwise(more)})
    shared = lambda text: F.size(F.array_intersect(topic_words(text), F.col("__topic")))
    scored = F.transform("__blocks", lambda b, i: F.struct(
        (-F.coalesce(F.array_max(F.transform(b["heads"], shared)), F.lit(0))).alias("heads"), (-shared(F.substring(b["text"], 1, 1500))).alias("body"), F.char_length(b["text"]).alias("size"), i.alias("at"), b["text"].alias("text"), (F.size(b["heads"]) > 0).alias("headed"),
    ))
    rows = rows.withColumn("__best", F.array_min(scored))
    card = (F.size("__topic") > 0) & (F.col("__best.size") < 300) & F.col("__best.headed") & (shared(F.col("__best.text")) == 0)
    return rows.withColumn(out, F.when(~card, F.col("__best.text"))).drop("__blocks", "__topic", "__best")
