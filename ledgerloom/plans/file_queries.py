"""Queries of the readers: files and sidecars made from the given tables, held as (path, content), and read where they are.

`statement_folder` alone writes files; the others read contents that a table holds, as
an archive's files are, so their rows can be compared with SQL.
"""

from __future__ import annotations

import io
import zipfile
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.functions import names as N
from ledgerloom.operators import graph, planning
from ledgerloom.plans import graph_queries as G
from ledgerloom.sources import files, layer_files
from ledgerloom.streaming.state import new_folder

ANY = SimpleNamespace(header_rows=1, delimiter=None, encoding="utf-8-sig", sheet=None)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key over four parts a core: the files made of them are few bytes but long work, which Spark would join into too few parts."""
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, key)


def _by_customer(spark: SparkSession, sf_dir: str, **cells: Column) -> DataFrame:
    """(file, rows): the orders of each customer in order, with the given cells."""
    one = F.struct(F.col("o_orderkey").alias("k"), *(c.alias(n) for n, c in cells.items()))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), one.alias("_r"))
    return _dealt(spark, orders, "file").groupBy("file").agg(F.array_sort(F.collect_list("_r")).alias("rows"))


def _read_cells(read: DataFrame) -> DataFrame:
    texts = F.array_join(F.transform("cells", lambda c: F.concat(c["x0"].cast("int").cast("string"), F.lit("="), c["text"])), "|")
    return read.select("file", "page", "row_no", texts.alias("cells"))


def _money() -> Column:
    return F.col("o_totalprice").cast("decimal(18,2)").cast("string")


def _delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _by_customer(spark, sf_dir, day=F.date_format("o_orderdate", "yyyy-MM-dd"), money=_money(), note=F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit('say ""'), "o_orderkey", F.lit('"", then; a, b'))))
    mark = F.element_at(F.array(*map(F.lit, (",", ";", "\t", "|"))), (F.col("file") % 4 + 1).cast("int"))
    line = F.transform("rows", lambda r: F.concat_ws("\0", r["k"].cast("string"), r["day"], r["money"], F.concat(F.lit('"'), r["note"], F.lit('"'))))
    body = F.concat(F.when(F.col("file") % 5 == 0, "﻿").otherwise(""), F.lit("id\0day\0amount\0note\n"), F.array_join(line, "\n"))
    return made.select(F.concat("file", F.lit(".csv")).alias("path"), F.encode(F.replace(body, F.lit("\0"), mark), "utf-8").alias("content"))


def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC03, SC08-SC09: delimited texts with four delimiters, quotes and byte order marks, told by their heads."""
    return _read_cells(files.rows(spark, _delimited(spark, sf_dir), ANY))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


_SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@F.pandas_udf(T.BinaryType())
def _workbooks(bodies: pd.Series) -> pd.Series:
    """Workbooks from their sheet rows, a second sheet beside them that is not to be read."""
    book = f'<workbook xmlns="{_SHEET_NS}" xmlns:r="{_REL_NS}"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
    sheet = lambda body: f'<worksheet xmlns="{_SHEET_NS}"><sheetData>{body}</sheetData></worksheet>'
    shared = f'<sst xmlns="{_SHEET_NS}"><si><t>even</t></si><si><r><t>od</t></r><r><t>d</t></r></si></sst>'
    return bodies.map(lambda b: _zip({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet(b), "xl/worksheets/sheet2.xml": sheet("<row><c><v>7</v></c></row>")}))


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC04, SF36: the first sheet of workbooks: shared texts, truths, whole and broken numbers, cells left out."""
    made = _by_customer(spark, sf_dir, money=_money())
    cell = lambda col, r, kind, v: F.concat(F.lit(f'<c r="{col}'), r["k"].cast("string"), F.lit(f'"{kind}><v>'), v, F.lit("</v></c>"))
    row = lambda r: F.concat(
        F.lit("<row>"), cell("A", r, "", F.concat(r["k"].cast("string"), F.lit(".0"))), cell("B", r, ' t="s"', (r["k"] % 2).cast("string")),
        F.when(r["k"] % 3 == 0, "").otherwise(cell("C", r, ' t="b"', (r["k"] % 2).cast("string"))), cell("AB", r, "", r["money"]), F.lit("</row>"),
    )
    body = F.concat(F.lit("<row><c><v>1</v></c></row>"), F.array_join(F.transform("rows", row), ""))
    return _read_cells(files.rows(spark, made.select(F.concat("file", F.lit(".xlsx")).alias("path"), _workbooks(body).alias("content")), ANY))


@F.pandas_udf(T.BinaryType())
def _word_files(bodies: pd.Series) -> pd.Series:
    """Word-processor documents from their bodies; no body, no document."""
    return bodies.map(lambda b: _zip({"word/document.xml": f'<w:document xmlns:w="{_WORD_NS}"><w:body>{b}</w:body></w:document>'}), na_action="ignore")


def _paragraph(text: Column) -> Column:
    return F.concat(F.lit("<w:p><w:r><w:t>"), text, F.lit("</w:t></w:r></w:p>"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC05: the rows of tables in word-processor documents; several paragraphs of a cell make one text."""
    made = _by_customer(spark, sf_dir, money=_money())
    cell = lambda *ps: F.concat(F.lit("<w:tc>"), *map(_paragraph, ps), F.lit("</w:tc>"))
    row = lambda r: F.concat(F.lit("<w:tr>"), cell(r["k"].cast("string")), cell(F.lit("a &amp; b"), r["money"]), F.lit("</w:tr>"))
    body = F.concat(_paragraph(F.lit("before")), F.lit("<w:tbl><w:tr><w:tc/></w:tr>"), F.array_join(F.transform("rows", row), ""), F.lit("</w:tbl>"))
    return _read_cells(files.rows(spark, made.select(F.concat("file", F.lit(".docx")).alias("path"), _word_files(body).alias("content")), ANY))


def fixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC06: the words of printed lines with their places; form feeds end pages, blank lines count."""
    made = _by_customer(spark, sf_dir, money=_money())
    line = lambda r: F.concat(F.rpad(r["k"].cast("string"), 12, " "), F.lpad(r["money"], 14, " "), F.when(r["k"] % 4 == 0, "\n\n").when(r["k"] % 4 == 1, "\f").otherwise("\n"))
    text = F.encode(F.array_join(F.transform("rows", line), ""), "utf-8")
    return _read_cells(files.rows(spark, made.select(F.concat("file", F.lit(".txt")).alias("path"), text.alias("content")), ANY))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC01, PF22: lines of texts with three kinds of line end, numbered from one."""
    made = _by_customer(spark, sf_dir)
    line = lambda r: F.concat(r["k"].cast("string"), F.when(r["k"] % 3 == 0, "\r\n").when(r["k"] % 3 == 1, "\n").otherwise("\r"))
    text = F.encode(F.concat(F.array_join(F.transform("rows", line), ""), F.lit("end")), "utf-8")
    return files.lines(spark, made.select(F.col("file").cast("string").alias("path"), text.alias("content")))


def office_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC30: texts of documents of several kinds; a broken file is a row with its error."""
    c = _table(spark, sf_dir, "customer").repartition("c_custkey")  # the table is small, its documents are not: all cores make and read them
    k, name = F.col("c_custkey"), F.col("c_name")
    kind = F.element_at(F.array(*map(F.lit, (".docx", ".txt", ".csv", ".xlsx"))), (k % 4 + 1).cast("int"))
    word = _word_files(F.when(k % 4 == 0, F.concat(_paragraph(name), _paragraph(F.col("c_mktsegment")))))
    plain = F.encode(F.concat(name, F.lit("\n"), "c_mktsegment"), "utf-8")
    content = F.when(k % 4 == 0, word).when(k % 4 == 3, F.encode(F.lit("no workbook"), "utf-8")).otherwise(plain)
    got = files.documents(spark, c.select(F.concat(k, kind).alias("path"), content.alias("content")))
    return got.select("file", "text", F.substring_index("error", ":", 1).alias("error"))


def statement_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC03, SC08: a folder that Spark has written, a folder a customer's segment, read back by path: rows and money of each segment."""
    folder = new_folder(spark, "statements")
    c = _table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))
    c.write.partitionBy("c_mktsegment").option("header", True).option("sep", ";").csv(folder)
    read = files.rows(spark, f"{folder}/*/*.csv", ANY)
    segment = F.regexp_extract("file", "c_mktsegment=([^/]*)/", 1)
    money = F.get(F.filter("cells", lambda x: x["x0"] == 2), F.lit(0))["text"].cast("decimal(18,2)")
    return read.groupBy(segment.alias("segment")).agg(F.count("*").alias("n"), F.sum(money).alias("total"))


# --- sidecars


def _lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, rows): an order's lines in order, numbered anew as line numbers repeat."""
    one = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), one.alias("_r"))
    made = _dealt(spark, lines, "file").groupBy("file").agg(F.array_sort(F.collect_list("_r")).alias("rows"))
    return made.withColumn("rows", F.transform("rows", lambda r, i: F.struct((i + 1).alias("k"), r["l_partkey"].alias("l_partkey"), r["l_returnflag"].alias("l_returnflag"))))


def ids_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22: the ids files of layers, an order each, some with another separator, without paths or broken."""
    made = _lines_of(spark, sf_dir)
    entry = F.transform("rows", lambda r: F.concat(layer_files.quoted(F.concat(r["l_returnflag"], F.lit(" > "), r["k"].cast("string"))), F.lit(': "p'), r["l_partkey"].cast("string"), F.lit('"')))
    sep = F.when(F.col("file") % 7 == 1, "/").otherwise(N.SEPARATOR)
    text = F.concat(F.lit('{"layer": "o'), "file", F.lit('", "sep": '), layer_files.quoted(sep), F.lit(', "paths": {'), F.when(F.col("file") % 7 == 2, "").otherwise(F.array_join(entry, ", ")), F.lit("}"), F.when(F.col("file") % 7 == 3, "").otherwise("}"))
    return layer_files.ids(made.select(F.col("file").cast("string").alias("file"), text.alias("text")))


def ids_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK03, SC22: the ids files of layers, a layer a region, as lines in walk order."""
    nodes, edges = G._layer(spark, sf_dir)
    return layer_files.ids_lines(graph.forest(nodes, edges))


def types_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC23, SK04: type dictionaries of all brands, a form a size of part, written and read back."""
    p = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), "p_size", F.col("p_partkey").alias("k"))
    slug = F.concat(F.lit("size_"), "p_size")
    kinds = p.select("file", slug.alias("slug"), (F.col("p_size") + 1).cast("long").alias("form_id"), F.concat(F.lit("SIZE: "), "p_size").alias("form_title"), F.when(F.col("p_size") % 2 == 0, "all  of\nit").otherwise("").alias("description")).distinct()
    fields = p.select("file", slug.alias("slug"), F.col("k").cast("int").alias("ord"), F.concat(F.lit("f_"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("name"), F.concat(F.lit("item_"), "k").alias("id"), F.when(F.col("k") % 2 == 1, "int").otherwise("string").alias("type"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("The  #"), "k")).otherwise("").alias("title"), (F.col("k") % 4 > 0).alias("writable"))
    return layer_files.types(layer_files.type_texts(kinds, fields))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("ord"))
    bucket = F.element_at(F.array(*map(F.lit, layer_files.BUCKETS)), (F.col("ord") % 3 + 1).cast("int"))
    buckets = o.where("ord % 5 < 4").select("file", "ord", F.concat(F.lit('n"'), "ord").alias("id"), bucket.alias("bucket"))
    return layer_files.result_texts(buckets, o.where("ord % 5 = 4").select("file", "ord", F.concat(F.lit("r"), "ord").alias("ref"), (F.col("ord") % 9).cast("long").alias("n")))


def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC33, SK10: the results of all runs, a run a customer, written and read back."""
    return layer_files.results(_results(spark, sf_dir))


def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10: what the results' lists count, statements' transactions among them."""
    return layer_files.result_counts(_results(spark, sf_dir))


def ops_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC24, ST03, PF19: ops files of all customers read and judged: refused shapes, clashes, closed keys, modes, typed values."""
    made = _by_customer(spark, sf_dir, day=F.date_format("o_orderdate", "yyyy-MM-dd"))
    op = lambda r: F.concat(F.lit("  - {"), F.element_at(F.array(
        F.concat(F.lit("at: 'A > "), r["k"].cast("string"), F.lit("', set: {day: "), r["day"], F.lit(", code: 010, on: yes}")), F.lit("at: A, rename: B, under: {at: C}"), F.lit("at: A, append: {f: x}"), F.lit("at: A, type: t, rename: B"),
        F.lit("rename: B"), F.lit("type: t, describe: D"), F.concat(F.lit("type: t, ref: r"), r["k"].cast("string"), F.lit(", picture: p.png")), F.lit("at: A, set: {title: T}"),
    ), (r["k"] % 8 + 1).cast("int")), F.lit("}"))
    head = F.concat(F.lit("layer: c"), "file", F.when(F.col("file") % 9 == 1, "\nmode: other").when(F.col("file") % 9 == 2, "\nmode: strict").when(F.col("file") % 9 == 3, "\nextra: 1").otherwise(""), F.lit("\nops:\n"))
    got = layer_files.ops(made.select(F.col("file").cast("string").alias("file"), F.concat(head, F.array_join(F.transform("rows", op), "\n")).alias("text")))
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(planning.op_errors(got.columns))
    return got.select("file", "layer", "mode", "n", "at", "ref", F.col("set")["day"].alias("day"), F.col("set")["code"].alias("code"), F.col("set")["on"].alias("said"), wrong.alias("wrong"))


def values_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC25, SC27, WN19: values texts of all orders read back: paths by indentation, fields, pictures."""
    made = _lines_of(spark, sf_dir)
    node = lambda r: F.concat(
        F.repeat(F.lit("  "), (r["k"] % 3 + 2).cast("int")), F.lit("L"), r["k"].cast("string"), F.lit(" [line]"), F.when(r["k"] % 2 == 0, "  # by ship").otherwise(""), F.lit("\n"),
        F.repeat(F.lit("  "), (r["k"] % 3 + 3).cast("int")), F.lit("part: p"), r["l_partkey"].cast("string"), F.lit("\n"),
    )
    tree = F.concat(F.lit("layer: x\n\ntree: |\n  O [order]\n"), F.array_join(F.transform("rows", node), ""))
    shown = F.when(F.col("file") % 2 == 0, F.concat(F.lit("\npictures: |\n  O\n  # no path\n"))).otherwise("")
    got = layer_files.values(made.select(F.col("file").cast("string").alias("file"), F.concat(tree, shown).alias("text")))
    return got.select("file", "ord", "path", "type", "description", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "|").alias("fields"), "pictured")


def settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC34: settings of all customers: comments, quotes, exports, repeated and broken lines."""
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.concat(F.lit("# of "), "c_name", F.lit("\n\nexport NAME='"), "c_name", F.lit("'\r\nSEGMENT = \" "), "c_mktsegment", F.lit(" \"\nURL=a=b$NAME\nEMPTY=\n"), F.when(k % 3 == 0, "URL=later\n").when(k % 3 == 1, "oops\n").otherwise("HALF='x\n"))
    return layer_files.settings(c.select(k.cast("string").alias("file"), text.alias("text")))


QUERIES = {f.__name__: f for f in (delimited_rows, workbook_rows, table_rows, fixed_words, text_lines, office_texts, statement_folder, ids_file, ids_text, types_file, result_file, result_counts, ops_file, values_file, settings_file)}

_ORDERS = "WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) "

_LINES = "WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS k FROM lineitem) "

ORACLES = {
    "delimited_rows": _ORDERS + """SELECT c || '.csv' AS file, 1 AS page, i AS row_no, '0=' || k || '|1=' || d || '|2=' || m || CASE WHEN k % 3 = 0 THEN '' ELSE '|3=say "' || k || '", then; a, b' END AS cells FROM o""",
    "workbook_rows": _ORDERS + """
SELECT c || '.xlsx' AS file, 1 AS page, i AS row_no, '0=' || k || '|1=' || CASE k % 2 WHEN 0 THEN 'even' ELSE 'odd' END || CASE WHEN k % 3 = 0 THEN '' WHEN k % 2 = 1 THEN '|2=TRUE' ELSE '|2=FALSE' END || '|27=' || CASE WHEN m LIKE '%.00' THEN m[:-4] ELSE m END AS cells FROM o""",
    "table_rows": _ORDERS + "SELECT c || '.docx' AS file, 1 AS page, i AS row_no, '0=' || k || '|1=a & b ' || m AS cells FROM o",
    "fixed_words": _ORDERS + """
SELECT c || '.txt' AS file, CAST(1 + coalesce(sum(CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END) OVER w, 0) AS INT) AS page, CAST(i + coalesce(sum(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS row_no,
  '0=' || k || '|' || (26 - length(m)) || '=' || m AS cells FROM o WINDOW w AS (PARTITION BY c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "text_lines": _ORDERS + "SELECT CAST(c AS VARCHAR) AS file, i AS line_no, CAST(k AS VARCHAR) AS raw FROM o UNION ALL SELECT CAST(c AS VARCHAR), count(*) + 1, 'end' FROM o GROUP BY c",
    "office_texts": """
SELECT c_custkey || list_extract(['.docx', '.txt', '.csv', '.xlsx'], CAST(c_custkey % 4 + 1 AS INT)) AS file, CASE WHEN c_custkey % 4 < 3 THEN c_name || chr(10) || c_mktsegment END AS text, CASE WHEN c_custkey % 4 = 3 THEN 'BadZipFile' END AS error FROM customer""",
    "ids_file": _LINES + """
SELECT CAST(l_orderkey AS VARCHAR) AS file, NULL AS error, 'o' || l_orderkey AS layer, l_returnflag || ' > ' || k AS path, 'p' || l_partkey AS id FROM i WHERE l_orderkey % 7 NOT IN (1, 2, 3)
UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), CASE l_orderkey % 7 WHEN 1 THEN 'unexpected separator /' WHEN 2 THEN 'no paths to resolve addresses against' ELSE 'not JSON' END, NULL, NULL, NULL FROM i WHERE l_orderkey % 7 IN (1, 2, 3)""",
    "ids_text": """
WITH n AS (SELECT [r_regionkey] AS w, r_name AS path, 'r' || r_regionkey AS id FROM region UNION ALL SELECT [r_regionkey, n_nationkey], r_name || ' > ' || n_name, 'n' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT [r_regionkey, n_nationkey, c_custkey], r_name || ' > ' || n_name || ' > ' || c_name, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT row_number() OVER (ORDER BY w) AS k, count(*) OVER () AS m, path, id FROM n)
SELECT 'world' AS layer, k + 4 AS line_no, '  "' || path || '": "' || id || '"' || CASE WHEN k < m THEN ',' ELSE '' END AS line FROM k
UNION ALL SELECT 'world', i, t FROM (VALUES (1, '{'), (2, ' "layer": "world",'), (3, ' "sep": " > ",'), (4, ' "paths": {')) AS h(i, t) UNION ALL SELECT 'world', count(*) + 5, ' }' FROM k UNION ALL SELECT 'world', count(*) + 6, '}' FROM k""",
    "types_file": """
WITH p AS (SELECT p_brand AS file, p_size AS s, p_partkey AS k FROM part)
SELECT file, NULL AS error, 'size_' || s AS slug, CAST(s + 1 AS BIGINT) AS form_id, 'SIZE: ' || s AS form_title, CASE WHEN s % 2 = 0 THEN 'all of it' ELSE '' END AS description, CAST(row_number() OVER (PARTITION BY file, s ORDER BY k) - 1 AS INT) AS ord,
  'f_' || lpad(CAST(k AS VARCHAR), 9, '0') AS name, 'item_' || k AS id, CASE WHEN k % 2 = 1 THEN 'int' ELSE 'string' END AS type, CASE WHEN k % 3 > 0 THEN 'The #' || k ELSE '' END AS title, k % 4 > 0 AS writable FROM p""",
    "result_file": """
WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey AS k, o_orderkey % 3 AS b FROM orders WHERE o_orderkey % 5 < 4)
SELECT file, NULL AS error, CAST(row_number() OVER (PARTITION BY file ORDER BY b, k) - 1 AS INT) AS pos, 'n"' || k AS id, list_extract(['hole', 'updated', 'created'], CAST(b + 1 AS INT)) AS bucket FROM b""",
    "result_counts": """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey AS k FROM orders)
SELECT file, count(*) FILTER (k % 5 < 4 AND k % 3 = 0) AS holes, count(*) FILTER (k % 5 < 4 AND k % 3 = 1) AS updated, count(*) FILTER (k % 5 < 4 AND k % 3 = 2) AS created, CAST(sum(CASE WHEN k % 5 = 4 THEN k % 9 ELSE 0 END) AS BIGINT) AS transactions FROM o GROUP BY file""",
    "ops_file": _ORDERS + """
SELECT CAST(c AS VARCHAR) AS file, 'c' || c AS layer, CASE WHEN c % 9 = 2 THEN 'strict' ELSE 'upsert' END AS mode, i AS n, CASE WHEN k % 8 = 0 THEN 'A > ' || k WHEN k % 8 IN (1, 2, 3, 7) THEN 'A' END AS at, CASE WHEN k % 8 = 6 THEN 'r' || k END AS ref,
  CASE WHEN k % 8 = 0 THEN '"' || d || '"' END AS day, CASE WHEN k % 8 = 0 THEN '10' END AS code, CASE WHEN k % 8 = 0 THEN '"yes"' END AS said,
  list_extract([NULL, 'under and create are not supported', 'append is not supported: set the whole value', 'at and type exclude each other', 'no address', 'a record needs a ref', NULL, 'write the title by rename'], CAST(k % 8 + 1 AS INT)) AS wrong FROM o WHERE c % 9 NOT IN (1, 3)
UNION ALL SELECT DISTINCT CAST(c AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE c % 9 WHEN 1 THEN 'mode must be one of upsert, strict' ELSE 'file: unknown field(s) [''extra'']' END FROM o WHERE c % 9 IN (1, 3)""",
    "values_file": _LINES + """,
l AS (SELECT l_orderkey AS o, k, 'p' || l_partkey AS p, k AS i, k % 3 AS d FROM i),
u AS (SELECT a.o, a.k, max(CASE WHEN b.d = a.d - 1 THEN b.k END) AS up1, max(CASE WHEN b.d = a.d - 2 THEN b.k END) AS up2, max(CASE WHEN b.d < a.d THEN b.k END) AS near FROM l a LEFT JOIN l b ON a.o = b.o AND b.k < a.k AND b.k > a.k - 3 GROUP BY 1, 2)
SELECT CAST(l.o AS VARCHAR) AS file, CAST(i AS INT) AS ord, 'O' || CASE l.d WHEN 0 THEN '' WHEN 1 THEN CASE WHEN up1 IS NOT NULL THEN ' > L' || up1 ELSE '' END ELSE CASE WHEN up1 IS NOT NULL THEN CASE WHEN l.k >= 3 AND up2 IS NOT NULL THEN ' > L' || up2 ELSE '' END || ' > L' || up1 WHEN up2 IS NOT NULL THEN ' > L' || up2 ELSE '' END END || ' > L' || l.k AS path,
  'line' AS type, CASE WHEN l.k % 2 = 0 THEN 'by ship' ELSE '' END AS description, 'part=' || p AS fields, CASE WHEN l.o % 2 = 0 THEN false END AS pictured FROM l JOIN u ON l.o = u.o AND l.k = u.k
UNION ALL SELECT DISTINCT CAST(o AS VARCHAR), 0, 'O', 'order', '', '', CASE WHEN o % 2 = 0 THEN true END FROM l""",
    "settings_file": """
SELECT CAST(c_custkey AS VARCHAR) AS file, NULL AS error, name, value FROM (SELECT c_custkey, unnest([{'name': 'NAME', 'value': c_name}, {'name': 'SEGMENT', 'value': ' ' || c_mktsegment || ' '}, {'name': 'URL', 'value': CASE WHEN c_custkey % 3 = 0 THEN 'later' ELSE 'a=b$NAME' END}, {'name': 'EMPTY', 'value': ''}], recursive := true) FROM customer WHERE c_custkey % 3 <> 1)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, 'HALF', '''x' FROM customer WHERE c_custkey % 3 = 2
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'line 7 is not NAME=VALUE', NULL, NULL FROM customer WHERE c_custkey % 3 = 1""",
}
