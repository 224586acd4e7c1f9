"""Rows of many small files leave a reader's task in few batches, those of a large file in parts."""

import pandas as pd
import pyarrow as pa

from ledgerloom.sources import files


def _held(contents):
    return iter([pa.RecordBatch.from_pydict({"path": [f"{n}.x" for n in range(len(contents))], "content": [c.encode() for c in contents]})])


def test_documents_share_batches():
    read = lambda name, content: iter([(name, content.decode(), None)])
    small = list(files.batched(_held(["a"] * 300), read, files._DOCUMENT))
    assert [b.num_rows for b in small] == [300]
    large = list(files.batched(_held(["a" * files.BATCH_BYTES + "b"] * 3 + ["c"]), read, files._DOCUMENT))
    assert [b.num_rows for b in large] == [1, 1, 1, 1]
    many = list(files.batched(_held(["a\n" * 12_001]), lambda name, c: ((name, s, None) for s in c.decode().split()), files._DOCUMENT))
    assert [b.num_rows for b in many] == [5000, 5000, 2001]


def test_cells_of_a_sheet_are_few_steps(monkeypatch):
    """Texts inside a cell are looked for in inline cells alone, columns are numbered once for all rows."""
    from ledgerloom.plans.file_queries import _workbooks

    cells = lambda r: f'<row><c r="A{r}"><v>{r}.0</v></c><c r="AB{r}" t="s"><v>1</v></c><c r="AC{r}" t="inlineStr"><is><t>in</t></is></c><c r="AD{r}" t="b"><v/></c><c><v>9</v></c></row>'
    content = _workbooks.func(pd.Series(["".join(cells(r) for r in range(1, 101))]))[0]
    files._number.cache_clear()
    rows = next(files.sheets(content))[1]
    assert rows[6] == ["7", "", "", "", "9", *[""] * 22, "odd", "in", ""] and len(rows) == 100
    assert files._number.cache_info().misses == 4


def _many(read, content, n=400):
    held = iter([pa.RecordBatch.from_pydict({"path": [f"{k}.x" for k in range(n)], "content": [content] * n})])
    return list(files.batched(held, read, files._ROWS))


def test_word_tables_share_batches():
    from ledgerloom.plans.file_queries import _word_files

    content = _word_files.func(pd.Series(["<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"]))[0]
    got = _many(files._table_rows, content)
    assert [b.num_rows for b in got] == [400] and got[0].to_pylist()[399] == {"file": "399.x", "page": 1, "row_no": 0, "top": 0.0, "cells": [{"text": "a", "x0": 0.0, "x1": 0.0}]}


def test_delimited_texts_share_batches():
    got = _many(files._delimited_rows, b"a;b\n1; \n")
    assert [b.num_rows for b in got] == [800] and got[0].to_pylist()[799]["cells"] == [{"text": "1", "x0": 0.0, "x1": 0.0}]


def test_printed_lines_share_batches():
    got = _many(files._fixed_rows, b"a b\n\nc\fd")
    assert [b.num_rows for b in got] == [1200] and [(r["page"], r["row_no"]) for r in got[0].to_pylist()[-3:]] == [(1, 1), (1, 3), (2, 4)]


def test_words_of_lines_are_few_steps():
    """Words are split and found again, not matched one by one; a cell is a plain tuple, blanks are those of the pattern."""
    import random
    import re

    r = random.Random(12)
    for _ in range(2000):
        line = "".join(r.choice("ab1.é😀 \t\x1f\xa0\u2003\u3000\u200b\0") for _ in range(r.randint(0, 30)))
        assert files._words(line) == [(m[0], float(m.start()), float(m.end())) for m in re.finditer(r"\S+", line)]
    assert list(files._fixed_rows("a.txt", b"aa a\n \n\fa aa a")) == [("a.txt", 1, 1, 1.0, [("aa", 0.0, 2.0), ("a", 3.0, 4.0)]), ("a.txt", 2, 3, 3.0, [("a", 0.0, 1.0), ("aa", 2.0, 4.0), ("a", 5.0, 6.0)])]
    assert files.tabular(["a", None, " ", 7]) == [("a", 0.0, 0.0), ("7", 3.0, 3.0)]


def test_files_are_made_on_all_cores(spark):
    """The rows of files are dealt over several parts a core, however few bytes they are."""
    from ledgerloom.plans import file_queries

    least = 4 * spark.sparkContext.defaultParallelism
    assert file_queries._by_customer(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= least
    assert file_queries._lines_of(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= least


def test_marks_beside_quotes_need_no_sniffer(monkeypatch):
    """A head whose quotes tell the delimiter is told by them, as csv.Sniffer would."""
    import csv
    import random

    def by_sniffer(head):
        try:
            return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
        except csv.Error:
            return ","

    r = random.Random(7)
    heads = ["".join(r.choice(a) for _ in range(r.randint(0, 20))) for a in ['",; \n', "\"',;|\t a\n", '"a;\n ', "\"'a,: \n1"] for _ in range(500)]
    assert [files.sniffed(h) for h in heads] == [by_sniffer(h) for h in heads]
    monkeypatch.delattr(csv, "Sniffer")
    assert files.sniffed('id;note\n1;"say ""1"", then; a, b"\n2;""\n') == ";" and files.sniffed('1|"a"|2\n') == "|"
