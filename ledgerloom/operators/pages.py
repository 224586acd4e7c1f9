"""Saved pages: title, description, structured blocks, links, text, images (F7).

One Arrow pass over the pages; joins over images and links are DataFrame operations.
"""

from __future__ import annotations

import html as _html
import ipaddress
import re
import struct
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerloom.operators.running import running_sum

# Elements without text, elements that end a line, entities of image texts.
NO_TEXT = frozenset("script style svg template iframe".split())
LINE = frozenset("p div br hr li tr section article header footer nav main aside form table ul ol dl dt dd blockquote pre figure figcaption h1 h2 h3 h4 h5 h6".split())
OPEN, CLOSE, TEXT = range(3)
_BLANKS = re.compile(r"[ \t\r\f\v]+")
IMAGE_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}
PARSED = "title string, description string, jsonld array<string>, links array<struct<text:string,url:string>>, base string, text string"


class _Events(HTMLParser):
    """A page as a list of (kind, name or text, attributes), kind being OPEN, CLOSE or TEXT."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, dict[str, str]]] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append((OPEN, tag, {name: value or "" for name, value in attrs}))

    def handle_endtag(self, tag):
        self.found.append((CLOSE, tag, {}))

    def handle_data(self, data):
        self.found.append((TEXT, data, {}))


def _spans(events: list[tuple[int, str, dict[str, str]]], wanted: Callable[[str, dict[str, str]], bool]) -> list[tuple[int, int]]:
    """First and last event of the outermost elements that are wanted; one that is never closed reaches to the end."""
    out, at = [], 0
    while at < len(events):
        kind, name, attributes = events[at]
        if kind == OPEN and wanted(name, attributes):
            first, depth = at, 0
            for at in range(first, len(events)):
                if events[at][1] == name and events[at][0] != TEXT:
                    depth += 1 if events[at][0] == OPEN else -1
                    if not depth:
                        break
            out.append((first, at))
        at += 1
    return out


def _joined(events: list[tuple[int, str, dict[str, str]]]) -> str:
    return "".join(name for kind, name, _ in events if kind == TEXT)


def _is_structured(name: str, attributes: dict[str, str]) -> bool:
    return name == "script" and attributes.get("type", "").strip().lower() == "application/ld+json"


def _description(events: list[tuple[int, str, dict[str, str]]]) -> str:
    """The first description that says something."""
    metas = (a for kind, name, a in events if kind == OPEN and name == "meta" and (a.get("name") or a.get("property") or "").lower() in ("description", "og:description"))
    return next((c for c in (a.get("content", "").strip() for a in metas) if c), "")


def _links(events: list[tuple[int, str, dict[str, str]]]) -> list[tuple[str, str]]:
    """(text, address) of each anchor with an address that is closed; a later one ends it unread."""
    out, begins = [], None
    for at, (kind, name, attributes) in enumerate(events):
        if name != "a" or kind == TEXT:
            continue
        if kind == OPEN and attributes.get("href", "").strip():
            begins = at
        elif kind == CLOSE and begins is not None:
            out.append((" ".join(_joined(events[begins:at]).split()), events[begins][2]["href"].strip()))
            begins = None
    return out


def _plain(events: list[tuple[int, str, dict[str, str]]]) -> str:
    """Running text: breaks at line elements, texts of images in place, one space and at most one empty line between."""
    parts = []
    for kind, name, attributes in events:
        if kind == TEXT:
            parts.append(name)
        elif kind == OPEN and name == "img" and attributes.get("alt", "").strip():
            parts.append(attributes["alt"].strip())
        if kind != TEXT and name in LINE:
            parts.append("\n")
    lines = [_BLANKS.sub(" ", line).strip(" ") for line in "".join(parts).split("\n")]
    return "\n".join(line for k, line in enumerate(lines) if line or (k and lines[k - 1])).strip()


def _seen(events: list[tuple[int, str, dict[str, str]]]) -> list[tuple[int, str, dict[str, str]]]:
    silent = {k for a, b in _spans(events, lambda name, _: name in NO_TEXT) for k in range(a, b + 1)}
    return [e for k, e in enumerate(events) if k not in silent]


def _titles(seen: list[tuple[int, str, dict[str, str]]]) -> list[tuple[int, int]]:
    return _spans(seen, lambda name, _: name == "title")


def parse(page: str | None) -> dict:
    """SC29, SF33, SF39: the parts of a page, each by a pass over its events."""
    events = _Events(page or "").found
    blocks = [_joined(events[a : b + 1]).strip() for a, b in _spans(events, _is_structured)]
    base = [a["href"] for kind, name, a in events if kind == OPEN and name == "base" and a.get("href")]
    seen = _seen(events)
    titles = _titles(seen)
    rest = [e for k, e in enumerate(seen) if not any(a <= k <= b for a, b in titles)]
    return {
        "title": "".join(_joined(seen[a : b + 1]) for a, b in titles),
        "description": _description(seen),
        "jsonld": [b for b in blocks if b],
        "links": _links(rest),
        "base": base[-1] if base else "",
        "text": _plain(rest),
    }


def _absolute(base: str, href: str) -> str:
    """The address seen from `base`; as it stands where either is malformed."""
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return href


def addresses(links: list[tuple[str, str]], base: str = "") -> list[tuple[str, str]]:
    """SF34, WN17: links made absolute, fragments and scripts left out, each address once, with its first text."""
    usable = [(_absolute(base, href), text) for text, href in links if not re.match(r"#|javascript:", href, re.I)]
    first = {url: k for k, (url, _) in reversed(list(enumerate(usable)))}
    return [(usable[k][1], usable[k][0]) for k in sorted(first.values())]


def parsed(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Every page with its parts; the HTML itself is left behind."""
    keep = [c for c in pages.columns if c != html]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep), PARSED])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [parse(h) for h in frame[html]]
            where = frame[url] if url in frame else [""] * len(frame)
            out = frame[keep].copy()
            for name in ("title", "description", "jsonld", "base", "text"):
                out[name] = [m[name] for m in made]
            out["links"] = [[{"text": t, "url": u} for t, u in addresses(m["links"], u0 or m["base"])] for m, u0 in zip(made, where)]
            yield out[[*keep, "title", "description", "jsonld", "links", "base", "text"]]

    return pages.mapInPandas(run, schema)


def written_title(page: str | None) -> str | None:
    """The title by the reader, its references as they stand, closed or not; null for no page."""
    if page is None:
        return None
    seen = _seen(_Events(page.replace("&", "&amp;")).found)
    return "".join(_joined(seen[a : b + 1]) for a, b in _titles(seen))


@F.pandas_udf(T.StringType())
def written_titles(pages: pd.Series) -> pd.Series:
    """written_title() of every page."""
    return pages.map(written_title)


def marks_decoded(text: Column) -> Column:
    """A text whose closed references of markup characters are decoded, and no others."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def hrefs_of(page: Column) -> Column:
    """Addresses of links by expression alone, in order, each once, fragments and scripts left out."""
    all_ = F.regexp_extract_all(page, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(all_, lambda h: ~h.startswith("#") & ~F.lower(h).startswith("javascript:") & (F.trim(h) != "")))


_IMG = re.compile(r"<img(?=[\s/>])((?:[^>\"']|\"[^\"]*\"?|'[^']*'?)*)>?", re.I)
_ATTRIBUTE = re.compile(r"([^\s=]+)(?:[ \t]*=[ \t]*(?:\"([^\"]*)\"?|'([^']*)'?|(\S+)))?")
_ENTITY = re.compile("|".join(map(re.escape, IMAGE_ENTITIES)))


def images(page: str | None) -> list[tuple[str, str]]:
    """SF32: (address, text) of every image, the first mention of an address winning."""
    out: dict[str, str] = {}
    for m in _IMG.finditer(page or ""):
        a: dict[str, str] = {}
        for k in _ATTRIBUTE.finditer(m[1].rstrip("/")):
            a[k[1].lower()] = _ENTITY.sub(lambda e: IMAGE_ENTITIES[e[0]], (k[2] or k[3] or k[4] or "").strip()).strip()
        src = next((a[k] for k in ("src", "data-src", "data-original") if a.get(k)), "")
        if src:
            out.setdefault(src, next((a[k] for k in ("alt", "title", "aria-label") if a.get(k)), ""))
    return list(out.items())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("alt", T.StringType())])))
def image_list(pages: pd.Series) -> pd.Series:
    """images() of every page."""
    return pages.map(lambda p: [{"url": u, "alt": a} for u, a in images(p)])


def with_alts(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """JN17: (key, ord, url, alt): listed images with missing texts filled, then those only the page has, in order, each once."""
    one = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(key, "url").orderBy("ord"))).where("_n = 1").drop("_n")
    a = one(listed).select(key, "url", F.col("ord").alias("_a"), F.col("alt").alias("_x"))
    b = one(found).select(key, "url", F.col("ord").alias("_b"), F.col("alt").alias("_y"))
    j = a.join(b, [key, "url"], "full_outer")
    order = Window.partitionBy(key).orderBy(F.col("_a").isNull(), "_a", "_b")
    return j.select(key, (F.row_number().over(order) - 1).alias("ord"), "url", F.coalesce(F.nullif("_x", F.lit("")), "_y", F.lit("")).alias("alt"))


# --- addresses and pictures


def is_blocked(host: str) -> bool:
    """PF18: is an address loopback, private, link-local, shared, or a tunnel to such?"""
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return host.lower() in ("localhost",) or host.lower().endswith((".localhost", ".local", ".internal"))
    tunnels = [ipaddress.ip_network(n) for n in ("64:ff9b::/96", "64:ff9b:1::/48", "2002::/16", "2001::/32", "100.64.0.0/10")]
    mapped = getattr(ip, "ipv4_mapped", None)
    return not ip.is_global or ip.is_multicast or any(ip in n for n in tunnels if n.version == ip.version) or (mapped is not None and is_blocked(str(mapped)))


def url_problem(url: str | None) -> str | None:
    """PF17: why an address is not fetched; null when it may be."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname
    except ValueError:
        return "not an address"
    if parts.scheme not in ("http", "https"):
        return "not http"
    if not host:
        return "no host"
    if parts.fragment:
        return "has a fragment"
    return "private host" if is_blocked(host) else None


@F.pandas_udf(T.StringType())
def url_problems(urls: pd.Series) -> pd.Series:
    """url_problem() of every address."""
    return urls.map(url_problem)


def picture_facts(data: bytes | None) -> tuple[str | None, int | None, int | None, str | None]:
    """SF30: (content type, width, height, problem) of an image's bytes."""
    b = data or b""
    kind = width = height = None
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        kind, (width, height) = "image/png", struct.unpack(">II", b[16:24])
    elif b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        kind, (width, height) = "image/gif", struct.unpack("<HH", b[6:10])
    elif b[:2] == b"\xff\xd8":
        kind, at = "image/jpeg", 2
        while at + 9 < len(b) and b[at] == 0xFF:
            mark = b[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", b[at + 5 : at + 9])
                break
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    elif b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        kind = "image/webp"
    if kind is None:
        return None, None, None, "not an image"
    if width is None:
        return kind, None, None, "too small" if len(b) < 3072 else None
    if min(width, height) < 48:
        return kind, width, height, "too small" if max(width, height) < 48 * 4 else "too thin"
    return kind, width, height, "too thin" if max(width, height) > 6 * min(width, height) else None


@F.pandas_udf(T.StructType([T.StructField("content_type", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("problem", T.StringType())]))
def picture_info(data: pd.Series) -> pd.DataFrame:
    """picture_facts() of every image."""
    return pd.DataFrame([picture_facts(d) for d in data], columns=["content_type", "width", "height", "problem"])


def bound_pictures(asked: DataFrame, most: int = 50) -> DataFrame:
    """AP02, WN14, TK06, SF31: (n, node, url, bytes) to verdicts: one stored picture a digest, the first node keeps it, `most` a run."""
    d = asked.select("n", "node", "url", F.sha2("bytes", 256).alias("digest"), picture_info("bytes")["problem"].alias("problem"))
    return picture_verdicts(d, most)


def picture_verdicts(facts: DataFrame, most: int = 50) -> DataFrame:
    """(n, node, url, digest, verdict) from (n, node, url, digest, problem), judged in the order of n.

    The first node that asks for a digest owns it, by one aggregation; the limit counts
    the first askers of sound pictures in order, by a running sum over ranges.
    """
    first = facts.groupBy("digest").agg(F.min(F.struct("n", "node")).alias("_first"))
    d = facts.join(first, "digest").select("n", "node", "url", "digest", "problem", F.col("_first.node").alias("owner"), ((F.col("n") == F.col("_first.n")) & F.col("problem").isNull()).cast("int").alias("_counts"))
    d = running_sum(d, F.col("_counts"), [F.col("n")], "_k")
    return d.select("n", "node", "url", "digest", F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("owner") != F.col("node"), "belongs to another node").when(F.col("_k") > most, "over the run's limit").otherwise("stored").alias("verdict"))


def text_of(xml: str, breaks: dict[str, str]) -> str:
    """SF35: the text of markup, named tags turned into their breaks."""
    for tag, mark in breaks.items():
        xml = re.sub(rf"<{re.escape(tag)}(?:\s[^>]*)?/?>", lambda _, m=mark: m, xml)
    return _html.unescape(re.sub(r"<[^>]*>", "", xml))
