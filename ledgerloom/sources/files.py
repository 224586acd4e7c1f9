"""Readers (SC01-SC09, SC30): all through Spark's own file access, so any store that Spark reads works.

A source is a path, or a table of (path, content) where files are already held in one; a
row without content has no rows.
"""

from __future__ import annotations

import csv
import functools
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS = "file string, page int, row_no long, top double, cells array<struct<text:string,x0:double,x1:double>>"
_CELL = pa.struct([("text", pa.string()), ("x0", pa.float64()), ("x1", pa.float64())])
_ROWS = {"file": pa.string(), "page": pa.int32(), "row_no": pa.int64(), "top": pa.float64(), "cells": pa.list_(_CELL)}
_DOCUMENT = {"file": pa.string(), "text": pa.string(), "error": pa.string()}

BATCH_ROWS = 5000  # a batch of rows leaves a task with that many,
BATCH_BYTES = 4 << 20  # or once the files that it is from have that many bytes


Source = str | DataFrame


def contents(spark: SparkSession, source: Source) -> DataFrame:
    """(path, content) of the files of a source."""
    held = source if isinstance(source, DataFrame) else spark.read.format("binaryFile").load(source)
    return held.select("path", "content").where("content IS NOT NULL")


def lines(spark: SparkSession, path: Source) -> DataFrame:
    """(file, line_no, raw) of every line.

    Files are read whole and split natively, since a line's number is part of its
    meaning; a statement file is megabytes, and files spread over the cluster.
    """
    whole = contents(spark, path).select(F.col("path").alias("file"), F.decode("content", "utf-8").alias("t"))
    split = whole.select("file", F.posexplode(F.split("t", "\r\n|\n|\r")).alias("n", "raw"))
    return split.select("file", (F.col("n") + 1).cast("long").alias("line_no"), "raw")


def batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch of the columns `kinds`."""
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def batched(batches: Iterator[pa.RecordBatch], read: Callable[[str, bytes], Iterator[tuple]], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """read() of the (path, content) of batches, as batches of the columns `kinds`.

    Rows of many small files leave together, since a batch costs far more than a row;
    those of a large file leave in parts.
    """
    part, size = [], 0
    for held in batches:
        for name, content in zip(held.column("path"), held.column("content")):
            content = content.as_py()
            size += len(content)
            for row in read(name.as_py(), content):
                part.append(row)
                if len(part) == BATCH_ROWS:
                    yield batch(part, kinds)
                    part, size = [], 0
            if part and size > BATCH_BYTES:
                yield batch(part, kinds)
                part, size = [], 0
    if part:
        yield batch(part, kinds)


def _by_file(spark: SparkSession, path: Source, read: Callable[[str, bytes], Iterator[tuple]], schema: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    """read() of every file; `kinds` are the columns of `schema` as Arrow has them."""
    return contents(spark, path).mapInArrow(lambda batches: batched(batches, read, kinds), schema)


def tabular(values: list, page: int = 1) -> list[tuple[str, float, float]]:
    """SC09: the cells (text, x0, x1) of a table row; a cell's place is its column number, blank cells go."""
    return [(text, float(i), float(i)) for i, v in enumerate(values) if v is not None and (text := str(v).strip())]


_OPENS = re.compile(r"""([^\w\n"'])(?= ?(["']))""")
_BETWEEN, *_AT_ENDS = (
    re.compile(p, re.DOTALL | re.MULTILINE)
    for p in (
        r"""(?P<delim>[^\w\n"']) ?(?P<quote>["']).*?(?P=quote)(?P=delim)""",
        r"""(?:^|\n)(?P<quote>["']).*?(?P=quote)(?P<delim>[^\w\n"']) ?""",
        r"""(?P<delim>[^\w\n"']) ?(?P<quote>["']).*?(?P=quote)(?:$|\n)""",
    )
)


def _closed(head: str) -> bool:
    """Whether a quote that opens after a mark is closed before that mark; of each pair the first place has most text behind it."""
    first: dict[tuple[str, str], int] = {}
    for m in _OPENS.finditer(head):
        first.setdefault(m.groups(), m.end())
    return any(head.find(quote + mark, head.index(quote, at) + 1) >= 0 for (mark, quote), at in first.items())


def sniffed(head: str) -> str:
    """The delimiter of a sample, as csv.Sniffer finds it; a comma when nothing is clear.

    Marks beside quoted texts decide, as they do there; the first pattern, which reads to
    the end for every quote without a match, is left out where it can't match.
    """
    for pattern in (_BETWEEN, *_AT_ENDS) if _closed(head) else _AT_ENDS:
        found = [m["delim"] for m in pattern.finditer(head)]
        if found:
            marks = [d for d in found if d in ",;\t|"]
            if marks:
                return max(dict.fromkeys(marks), key=marks.count)
            break
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def _delimited_rows(name: str, content: bytes, header_rows: int = 0, delimiter: str | None = None, encoding: str = "utf-8-sig") -> Iterator[tuple]:
    text = content.decode(encoding, "replace")
    for n, values in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter or sniffed(text[:8192]))):
        if n >= header_rows:
            yield name, 1, n, float(n), tabular(values)


def _words(line: str) -> list[tuple[str, float, float]]:
    """The words of a line as cells (text, x0, x1); split and found again, which is half the work of a pattern."""
    cells, at = [], 0
    for word in line.split():
        start = line.index(word, at)
        at = start + len(word)
        cells.append((word, float(start), float(at)))
    return cells


def _fixed_rows(name: str, content: bytes, encoding: str = "utf-8") -> Iterator[tuple]:
    n = 0
    for page, body in enumerate(content.decode(encoding, "replace").split("\f"), 1):
        for line in body.splitlines():
            n += 1
            if cells := _words(line):
                yield name, page, n, float(n), cells


def delimited(spark: SparkSession, path: Source, header_rows: int = 0, delimiter: str | None = None, encoding: str = "utf-8-sig") -> DataFrame:
    """SC03: delimited text; the delimiter is sniffed from the first 8 KiB, row order is kept."""
    return _by_file(spark, path, lambda name, content: _delimited_rows(name, content, header_rows, delimiter, encoding), ROWS, _ROWS)


def fixed_width(spark: SparkSession, path: Source, encoding: str = "utf-8") -> DataFrame:
    """SC06: words of text lines with their character offsets; form feeds end pages."""
    return _by_file(spark, path, lambda name, content: _fixed_rows(name, content, encoding), ROWS, _ROWS)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_V = f"{_S}v"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


_TEXTS = frozenset((f"{_W}t", f"{_A}t"))
_MARKS = {f"{_W}tab": "\t"} | dict.fromkeys((f"{_W}br", f"{_W}cr", f"{_A}br"), "\n")
_ROW, _CELL_OF, _PARAGRAPH = f"{_W}tr", f"{_W}tc", f"{_W}p"


def _paragraph(p) -> str:
    return "".join([(e.text or "") if e.tag in _TEXTS else _MARKS.get(e.tag, "") for e in p.iter()])


def word_rows(content: bytes) -> Iterator[list[str]]:
    """SC05: every row of every table of a word-processor document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for row in root.iter(_ROW):
        yield [" ".join([_paragraph(p) for p in cell.iter(_PARAGRAPH)]) for cell in row.iter(_CELL_OF)]


def cell_text(value: str | None, kind: str | None, shared: list[str]) -> str:
    """SF36: TRUE and FALSE, whole numbers without a point, shared strings."""
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind in ("str", "inlineStr", "e", "d"):
        return value
    try:
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e16 else value
    except ValueError:
        return value


@functools.lru_cache(maxsize=20_000)
def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


_LETTERS = re.compile("[A-Z]*")


def _column(ref: str) -> int:
    return _number(_LETTERS.match(ref)[0])


def sheets(content: bytes, only: str | None = None) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows) of the sheets of a workbook, as the file has their values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in book.iter(f"{_S}sheet"):
            if only and sheet.get("name") != only:
                continue
            target = rels[sheet.get(f"{_R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{_S}row"):
                values: list[str] = []
                for k, c in enumerate(row.iter(f"{_S}c")):
                    ref, kind = c.get("r"), c.get("t")
                    at = _column(ref) if ref else k
                    values += [""] * (at + 1 - len(values))
                    if kind == "inlineStr":
                        values[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    else:
                        v = c.find(_V)
                        values[at] = cell_text(v.text if v is not None else None, kind, shared)
                rows.append(values)
            yield sheet.get("name"), rows


def _sheet_rows(name: str, content: bytes, sheet: str | None = None, header_rows: int = 0) -> Iterator[tuple]:
    for _, rows in sheets(content, sheet):
        for n, values in enumerate(rows):
            if n >= header_rows:
                yield name, 1, n, float(n), tabular(values)
        return


def _table_rows(name: str, content: bytes, header_rows: int = 0) -> Iterator[tuple]:
    for n, values in enumerate(word_rows(content)):
        if n >= header_rows:
            yield name, 1, n, float(n), tabular(values)


def workbook(spark: SparkSession, path: Source, sheet: str | None = None, header_rows: int = 0) -> DataFrame:
    """SC04: the rows of the named or first sheet of each workbook."""
    return _by_file(spark, path, lambda name, content: _sheet_rows(name, content, sheet, header_rows), ROWS, _ROWS)


def word_tables(spark: SparkSession, path: Source, header_rows: int = 0) -> DataFrame:
    """SC05: table rows of word-processor documents."""
    return _by_file(spark, path, lambda name, content: _table_rows(name, content, header_rows), ROWS, _ROWS)


KINDS = ("csv", "tsv", "xlsx", "xlsm", "docx", "txt")


def _kind(path: str) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in KINDS:
        raise ValueError(f"no reader for .{kind}: convert legacy formats first; give PDF pages as a words table")
    return kind


def rows(spark: SparkSession, path: Source, spec) -> DataFrame:
    """SC08: each file by the reader for its extension; a folder or a table may mix them.

    A file of another kind ends the job, by its own name if the path names it.
    """
    header, delimiter, encoding, sheet = spec.header_rows, spec.delimiter, spec.encoding, spec.sheet
    if isinstance(path, str) and "." in path.rsplit("/", 1)[-1]:
        _kind(path)

    def read(name: str, content: bytes) -> Iterator[tuple]:
        kind = _kind(name)
        if kind in ("csv", "tsv"):
            return _delimited_rows(name, content, header, delimiter, encoding)
        if kind in ("xlsx", "xlsm"):
            return _sheet_rows(name, content, sheet, header)
        return _table_rows(name, content, header) if kind == "docx" else _fixed_rows(name, content)

    return _by_file(spark, path, read, ROWS, _ROWS)


def document_text(name: str, content: bytes, notes: bool = False) -> str:
    """SC30: the text of an office or HTML document."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in ("html", "htm"):
        from ledgerloom.operators.pages import parse

        return parse(content.decode("utf-8", "replace"))["text"]
    if kind in ("txt", "md", "csv", "tsv"):
        return content.decode("utf-8-sig", "replace")
    if kind in ("xlsx", "xlsm"):
        return "\n\n".join(f"# {n}\n" + "\n".join("\t".join(r).rstrip() for r in rows) for n, rows in sheets(content))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = z.namelist()
        number = lambda p: int(re.search(r"(\d+)", p.rsplit("/", 1)[-1])[1]) if re.search(r"(\d+)", p.rsplit("/", 1)[-1]) else 0
        if kind == "docx":
            order = [*sorted((p for p in parts if re.fullmatch(r"word/header\d*\.xml", p)), key=number), "word/document.xml", *sorted((p for p in parts if re.fullmatch(r"word/footer\d*\.xml", p)), key=number)]
            tag = f"{_W}p"
        elif kind == "pptx":
            order = sorted((p for p in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", p)), key=number)
            if notes:
                order += sorted((p for p in parts if re.fullmatch(r"ppt/notesSlides/notesSlide\d+\.xml", p)), key=number)
            tag = f"{_A}p"
        elif kind in ("odt", "ods", "odp"):
            text = z.read("content.xml").decode("utf-8", "replace")
            text = re.sub(r"</text:(p|h)>|<text:line-break/>", "\n", text)
            return re.sub(r"\n{3,}", "\n\n", unescape(re.sub(r"<[^>]*>", "", text.replace("<text:tab/>", "\t")))).strip()
        else:
            raise ValueError(f"no text reader for .{kind}")
        out = []
        for p in order:
            if p in parts:
                out.append("\n".join(_paragraph(x) for x in ElementTree.fromstring(z.read(p)).iter(tag)))
        return "\n".join(o for o in out if o.strip())


def documents(spark: SparkSession, path: Source) -> DataFrame:
    """(file, text, error) of every office or HTML document under a path; a bad file is a row, not a failure."""

    def read(name: str, content: bytes) -> Iterator[tuple]:
        try:
            yield name, document_text(name, content), None
        except Exception as e:  # noqa: BLE001 - one unreadable file must not end the scan
            yield name, None, f"{type(e).__name__}: {e}"[:300]

    return _by_file(spark, path, read, "file string, text string, error string", _DOCUMENT)
