"""HTML extraction by line-block distribution.

A page is read once, tag by tag, into lines: every block-level tag and line break ends
a line, inline tags do not.  Markup, scripts, styles, comments and hidden parts leave
nothing; lines inside navigation, page headers, footers, asides, forms and elements
whose class, id or role names such a part carry no weight, and neither does link
text.  The weights are summed over sliding windows of WINDOW lines with text: text
surges where a window passes SURGE after quiet lines and dives where a whole window
is of links; the lines between are kept, with the headings that lead into them.
Where the page marks its article, the distribution runs inside it; there link text
weighs like any other and any weight at all is a surge, so that one-word paragraphs
stay.

A name that only states something of a wrapper (has-sidebar, comments-open) names no
part.  A form, or an element whose compound name says where it stands (sidebar-layout),
is a wrapper and no part if it holds running text and the title of the page; on a page
without one, its first article or heading with no running text before it.  Comments,
adverts and notices stay parts whatever they hold.  An article inside a part is taken
for a comment or a teaser, unless there is no other text.  Hidden stays hidden.

Link text within one element's lines, and paragraphs that follow them, belong to them.

Character references are decoded, white space inside a line becomes one space,
and lines are joined by one newline.  Nothing is cut off.

Narrow: one pass over the pages, no shuffle, and memory for one batch.

Edge cases: a null or empty page gives an empty text; an unclosed or cut-off page is
read as far as it goes; repeated rows are extracted alike; other columns pass
through, and a column named like an output is replaced.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.llm import shared

WINDOW, SURGE = 3, 60
LOOSE, PROPER, HIDDEN = 1, 2, 3

# HTML's elements by role, and names of page parts.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript iframe textarea title".split())
SKIPPED = frozenset("template svg object canvas math".split())
HEAD = frozenset("head html base basefont bgsound link meta title script style noscript noframes template".split())
#: A name with one of these words states how a wrapper is, not what part it is.
STATES = frozenset("has with without no is are open opened closed enabled disabled allowed visible hidden on off".split())
STACKED = frozenset("html body article main div section nav header footer aside form ul ol dl menu table tbody thead tfoot tr td th figure fieldset select button dialog details label span p li blockquote".split())
PARTS = frozenset("nav aside footer form menu select button dialog fieldset".split())
#: Elements that hold runs of lines: lines of one such element belong together.
HOMES = frozenset("html body article main div section header footer aside nav form table td th blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead topbar header footer sidebar sidenav aside widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr "
    "notice notices alert alerts warning popup modal overlay toast newsletter subscribe subscription signup signin login register search comment comments reply "
    "replies respond disqus discussion pagination pager tags copyright legal disclaimer toolbar complementary contentinfo skip".split()
)
#: Names that say where a part stands; a compound of them may name a wrapper of the whole page by its layout.
LAYOUT = frozenset("nav navbar navigation menu header footer sidebar sidenav aside banner topbar toolbar masthead widget widgets".split())
#: A compound of one of these with `header` is the head of the text.
CONTENT = frozenset("article post entry story content section body text blog news title headline chapter recipe".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s\"'<>][^\s<>]*)|[^<>=]|=)*+)(?:>|$|(?=<))", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")


def _part(tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """Does this element begin a part of the page that is not its text?  LOOSE, PROPER or HIDDEN if so, else 0; and do all its names say where it stands?"""
    named, layout = 0, True
    if attributes and tag not in ("html", "body", "article", "main"):
        if _HIDDEN.search(attributes):
            return HIDDEN, False
        for m in _NAMED.finditer(attributes):
            for token in (m[1] or m[2] or m[3] or "").lower().split():
                words = _WORD.findall(token)
                for name in words:
                    if name not in NAMES or STATES.intersection(words) or (name == "header" and (inside or CONTENT.intersection(words))):
                        continue
                    named = max(named, PROPER if name == token else LOOSE)
                    layout = layout and name in LAYOUT
    if tag in PARTS or (tag == "header" and not inside):
        return max(named, LOOSE if tag in ("form", "fieldset") else PROPER), layout
    return named, layout


def _past(page: str, tag: str, at: int) -> int:
    """Where the raw text or the skipped element `tag` that begins at `at` has ended."""
    if tag in RAW:
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
        return m.end() if m else len(page)
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*(?:>|$)", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return len(page)


Line = tuple[str, int, bool, int, int, bool]  # text, weight, heading, marked, home, paragraph


class _Found:
    """What a reading of a page has met: its loose parts, and where its first heading of the first order, article and heading of any order stand."""

    def __init__(self):
        self.loose: list[tuple[int, int, int, int, bool]] = []  # begin, end, plain text outside parts before it, plain text in it, layout
        self.h1 = self.article = self.heading = -1

    def wrappers(self) -> frozenset[int]:
        """Loose parts that hold the text instead of standing beside it.

        Such a part is named by its layout alone, holds running text, and holds the
        page's title; or, on a page without one, its first article or else its first
        heading, with no running text outside parts before it.
        """
        mark = self.article if self.article >= 0 else self.heading
        out = []
        for begin, end, before, held, layout in self.loose:
            titled = begin < self.h1 < end if self.h1 >= 0 else begin < mark < end and before < SURGE
            if layout and held >= SURGE and titled:
                out.append(begin)
        return frozenset(out)

    def last_resort(self) -> frozenset[int]:
        """All loose parts around the title, article or heading: for a page without text outside parts."""
        mark = next((x for x in (self.h1, self.article, self.heading) if x >= 0), -1)
        return frozenset(begin for begin, end, *_ in self.loose if begin < mark < end)


def _read(page: str, wrappers: frozenset[int]) -> tuple[list[Line], _Found]:
    """The lines of a page and what it holds; the elements at the places `wrappers` are no parts."""
    out: list[Line] = []
    found = _Found()
    text: list[str] = []
    stack: list[tuple[str, int, int, int, int, int, int, bool, int]] = []  # tag, article, `quiet`, `marked` and `home` outside it, and for a loose part its place, the plain text before it outside parts and at all, and its layout
    open_tags: Counter = Counter()
    linked = other = quiet = inside = marked = plain = seen = home = homes = 0
    heading = in_link = head = paragraph = False
    at, size = 0, len(page)

    def close() -> None:
        nonlocal linked, other
        joined = " ".join(_html.unescape("".join(text)).split()) if text else ""
        weight = 0
        if joined:
            weight = len(joined) if not linked or inside else max(0, len(joined) - linked)
            if linked > other and not inside:
                weight = 0
        out.append((joined, weight, heading, marked, home, paragraph))
        text.clear()
        linked = other = 0

    def leave() -> str:
        nonlocal quiet, marked, inside, home
        name, article, quiet, marked, home, place, before, layout, had = stack.pop()
        open_tags[name] -= 1
        inside -= article
        if place >= 0:
            found.loose.append((place, at, before, seen - had, layout))
        return name

    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            long = len(piece.strip())
            if long and head:
                head = False
            if not head and not in_link:
                if quiet < PROPER:
                    seen += long
                if not quiet:
                    plain += long
            if not quiet and not head:
                text.append(piece)
                if in_link:
                    linked += len(piece)
                else:
                    other += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, ends = m[2].lower(), m[1] == "/"
        if tag == "head":
            head = not ends
        elif head and tag not in HEAD:
            head = False
        if tag in RAW or tag in SKIPPED:
            if not ends and (tag in RAW or not m[3].rstrip().endswith("/")):
                at = _past(page, tag, at)
            continue
        if tag in BLOCK:
            close()
            heading = tag in HEADINGS and not ends
            paragraph = tag == "p" and not ends
        if not ends and quiet < PROPER:
            if tag == "h1" and found.h1 < 0:
                found.h1 = m.start()
            if tag in HEADINGS and found.heading < 0:
                found.heading = m.start()
            if tag in ("article", "main") and found.article < 0:
                found.article = m.start()
        if tag == "a":
            in_link = not ends
        if tag in STACKED:
            if not ends:
                if tag in ("p", "li") and stack and stack[-1][0] == tag:
                    leave()
                flag, layout = (0, False) if m.start() in wrappers else _part(tag, m[3], inside > 0)
                article = tag in ("article", "main")
                if not m[3].endswith("/"):
                    stack.append((tag, article, quiet, marked, home, m.start() if flag == LOOSE else -1, plain, layout, seen))
                    open_tags[tag] += 1
                    inside += article
                    if tag in HOMES:
                        homes += 1
                        home = homes
                    if article and quiet < HIDDEN:
                        marked = 1 if quiet or marked == 1 else 2
                        quiet = 0
                    quiet = max(quiet, flag)
            elif open_tags[tag]:
                while leave() != tag:
                    pass
    close()
    while stack:
        leave()
    return out, found


def lines_of(page: str) -> list[Line]:
    """(text, weight, heading, marked, home, paragraph) of every line; marked: 2 inside the article that the page names, 1 if that is inside another part.

    Lines of other page parts are empty.  Whether an element that is named like a part
    is one follows from its names and from what it holds, never from its share of the page.
    """
    lines, found = _read(page, frozenset())
    wrappers = found.wrappers()
    if wrappers:
        lines, _ = _read(page, wrappers)
    if not any(x[1] for x in lines) and found.last_resort():
        lines, _ = _read(page, found.last_resort())
    return lines


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    lines = lines_of(page)
    empty = ("", 0, False, 0, 0, False)
    most = max((x[3] for x in lines if x[1]), default=0)
    if most == 1 and any(x[1] and not x[3] for x in lines):  # articles inside parts, comments perhaps, are no match for text outside
        most = 0
        lines = [x if not x[3] else empty for x in lines]
    if most:
        lines = [x if x[3] == most else empty for x in lines]
        least = 1
    else:
        least = SURGE
    weights = [x[1] for x in lines]
    n = len(lines)
    full = [k for k in range(n) if lines[k][0]]  # the empty lines between tags are no part of a window
    sums = [sum(weights[k] for k in full[i : i + WINDOW]) for i in range(len(full))]
    kept = [False] * n
    i = 0
    while i < len(full):
        if sums[i] < least or not weights[full[i]]:
            i += 1
            continue
        end = i  # the surge; it ends where a whole window is quiet
        while end < len(full) and sums[end]:
            end += 1
        start = full[i]
        while start and lines[start - 1][0] and (lines[start - 1][2] or weights[start - 1]):
            start -= 1
        for k in range(start, full[end - 1] + 1):
            kept[k] = True
        i = end + 1
    if least == SURGE and not any(kept):
        kept = [w > 0 for w in weights]  # a page of nothing but short lines
    # Quiet lines between two kept ones of one element belong to it, and so do paragraphs that follow one.
    last = -1
    for i, k in enumerate(full):
        if kept[k]:
            if last >= 0 and i - last > 1 and lines[full[last]][4] == lines[k][4] and all(lines[full[j]][4] == lines[k][4] for j in range(last, i)):
                for j in range(last, i):
                    kept[full[j]] = True
            last = i
        elif last == i - 1 >= 0 and lines[k][5] and lines[k][4] == lines[full[last]][4]:
            kept[k] = True
            last = i
    # A heading leads into the text after it over quiet lines too.
    for k in range(n):
        if lines[k][2] and lines[k][0] and not kept[k] and any(kept[k + 1 : k + 1 + 4 * WINDOW]):
            kept[k] = True
    return "\n".join(x[0] for x, keep in zip(lines, kept) if keep and x[0])


def texts(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Appends the main text of every page; the other columns but the HTML stay."""
    keep = [c for c in pages.columns if c not in (html, out)]
    schema = StructType([*(f for f in pages.schema if f.name in keep), StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([extract(p.as_py()) for p in batch.column(len(keep))], pa.string())], [*keep, out])

    return shared.mapped(pages.select(*(shared._named(c) for c in keep), shared._named(html)), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: page_id, url, text, n_chars of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
