"""Queries of a statement's evidence, of stored records and of recorded expectations on stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions import records
from ledgerloom.operators import gates, probe, regression, statements


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_turn(k: Column, values: list[Column]) -> Column:
    return F.element_at(F.array(*values), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def header_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK02, PF15: the best header row of each file, the first of equal ones."""
    row = lambda *cells: F.array(*map(F.lit, cells))
    cells = _in_turn(F.col("p_partkey"), [row("Date", "Amount", "Balance"), row("Date", "Amount", "1.00"), row("Date", "Amount", "at:"), row("Total", "2.00"), row("date", "DATE", "amount")])
    rows = _table(spark, sf_dir, "part").select("p_size", F.col("p_partkey").alias("ord"), cells.alias("cells"))
    return probe.best_header(rows, ["p_size"], ["date", "amount", "balance"])


def column_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: orders whose three big columns add up."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    n = F.when((line == 3) & (k % 2 == 0), 2 * (k % 7 + 3)).when((line == 4) & (k % 4 == 0), 1).otherwise(k % 7 + 3)
    return probe.column_arithmetic(_table(spark, sf_dir, "lineitem").select(k, (line * 10).alias("lo"), (line * 10 + 5).alias("hi"), n.alias("n")), ["l_orderkey"], 100)


def row_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: what the rows of each file begin with."""
    k = F.col("event_id")
    cells = F.array(F.when(k % 3 != 0, F.lit("2024-01-02")).otherwise("carried"), F.when(k % 2 == 0, F.lit("1,234.50")).otherwise("note"))
    return probe.row_starts(_table(spark, sf_dir, "events").select("user_id", cells.alias("cells")), ["user_id"])


def date_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19: the date column of each file by its right edges."""
    return probe.date_edges(_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("event_id") % 41 * 2.5).cast("double").alias("x")), ["user_id"])


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").withColumn("row_no", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    price = F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit(".25"))
    return p.select("p_size", "row_no", F.array("p_name", price, F.lit(""), F.when(F.col("p_partkey") % 2 == 0, price).otherwise(F.col("p_brand"))).alias("cells"))


def sheet_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11: the first rows of every sheet."""
    return probe.tabular_preview(_sheets(spark, sf_dir), ["p_size"])[0]


def sheet_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11: money-looking cells of every column of a sheet's first rows."""
    return probe.tabular_preview(_sheets(spark, sf_dir), ["p_size"])[1]


def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF29, SF42: one record an envelope; places round halves to the even number."""
    k = F.col("c_custkey")
    full = F.concat(F.lit('{"data":{"id":"n'), k, F.lit('","formId":'), k, F.lit(',"title":"T","data":{"a":1},"position":{"x":'), k, F.lit('.5,"y":null}}}'))
    part = F.concat(F.lit('{"data":{"id":"n'), k, F.lit('","title":null,"position":{}}}'))
    # The table is small, the work on it is not: all cores read the envelopes, each once.
    c = _table(spark, sf_dir, "customer").repartition("c_custkey").select(k.alias("k"), _in_turn(k, [full, F.lit('{"data":null}'), part, F.lit("no json"), F.lit("[]")]).alias("payload"))
    r = c.select("k", F.inline(F.array(records.record(records.item(F.col("payload")), "node"))))
    return r.select("k", "id", "form_id", "title", "data", "x", "y")


def listed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF29, SF42: all records of an envelope, in either of its forms."""
    k = F.col("c_custkey")
    rows = F.concat(F.lit('[{"id":"e'), k, F.lit('","source":"a"},{"id":"f","target":"b"}]'))
    payload = _in_turn(k, [F.concat(F.lit('{"data":'), rows, F.lit("}")), F.concat(F.lit('{"data":{"list":'), rows, F.lit("}}")), F.lit('{"data":{"list":null}}'), F.lit("{}")])
    e = _table(spark, sf_dir, "customer").select(k.alias("k"), F.posexplode(records.items(payload)).alias("pos", "text"))
    return e.select("k", "pos", records.record(F.col("text"), "edge").alias("r")).select("k", "pos", "r.id", "r.source", "r.target")


def form_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF42: fields of forms whose sections stand at the top, under `form`, or nowhere."""
    k = F.col("c_custkey")
    sections = F.concat(F.lit('[{"id":"s","content":[{"id":"item_'), k, F.lit('","class":"edit"},{"id":"b","options":[{"title":"A","value":1},{"value":null}]}]},{"title":"empty"}]'))
    text = _in_turn(k, [F.concat(F.lit('{"sections":'), sections, F.lit("}")), F.concat(F.lit('{"sections":[],"form":{"sections":'), sections, F.lit("}}")), F.lit('{"id":1}'), F.lit("none")])
    f = _table(spark, sf_dir, "customer").select(k.alias("k"), records.form_fields(text).alias("f"))
    return f.select("k", F.size("f").alias("n_fields"), F.array_join("f.id", ",").alias("ids"), F.array_join("f.class", ",").alias("classes"), F.array_join(F.flatten(F.transform("f", lambda x: x["options"]["title"])), ",").alias("titles"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("case"), k % 12).alias("name"), F.when(k % 2 == 0, "1.25").otherwise("0").alias("debit_sum"), F.when(k % 2 == 0, "0").otherwise("2.00").alias("credit_sum"))
    own = rows.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("debit_sum").cast("decimal(18,2)")).alias("d"))
    i = F.substring("name", 5, 2).cast("int")
    debit = F.when(i.isin(0, 1, 4), F.col("d")).when(i == 2, F.col("d") + 1).cast("decimal(18,2)")
    cases = own.select("name", (i != 5).alias("found"), F.when(i == 4, 3).otherwise(0).alias("exit_code"), F.when(i.isin(1, 6), F.col("n")).when(i == 7, F.col("n") + 1).alias("count"), debit.alias("debit"), F.lit(None).cast("decimal(18,2)").alias("credit"))
    return regression.judged(cases, rows)


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25: every case's verdict against its recorded expectations."""
    return _cases(spark, sf_dir)


def suite_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25: the suite as a whole."""
    return regression.tally(_cases(spark, sf_dir))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("cluster"), (line * 50.0).alias("lo"), (line * 50.0 + 30).alias("hi"), (F.col("l_orderkey") * line % 17).alias("n"))


def big_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK03: the three fullest columns of the right part of each page."""
    return probe.top_columns(_columns(spark, sf_dir), ["l_orderkey"], 200)


def column_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN22: the header word nearest to each column's right edge."""
    c = _columns(spark, sf_dir).where("cluster <= 5")
    words = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*(F.struct(F.lit(x).alias("x1"), F.lit(t).alias("text")) for x, t in ((95.0, "Date"), (130.0, "Debit"), (260.0, "Credit"))))).alias("w"))
    return probe.nearest_headers(c, words.select("l_orderkey", "w.x1", "w.text"), ["l_orderkey"]).select("l_orderkey", "cluster", "header")


def glued_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN21: edges whose text a tighter reading divides."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), (F.col("event_id") % 7 * 10.04).alias("x1"), F.col("event_id").alias("ord"))
    k = F.col("ord").cast("string")
    return probe.glued(e.withColumn("text", k), e.withColumn("text", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("1"), k)).otherwise(k)))


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK01: transactions as JSON lines, optional keys left out."""
    k = F.col("o_orderkey")
    t = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("file"), k.alias("line_no"), F.lit("2024-01-02").alias("transaction_date"), F.when(k % 2 == 0, "10:00").when(k % 4 == 1, "").alias("transaction_time"),
        F.concat(k, F.lit(".50")).alias("debit_sum"), F.lit("0").alias("credit_sum"), F.lit("USD").alias("currency"), F.when(k % 5 > 0, F.concat(F.lit('say "'), k, F.lit('" \\'))).otherwise("").alias("description"), F.when(k % 3 == 0, F.concat(F.lit("a"), k)).alias("uniq_actor_field_value"),
    )
    return statements.jsonl(t)


def unsorted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN18: rows dated before the row above."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("line_no"), F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("transaction_date"))).alias("raw"))
    return gates.unsorted(o).select("file", "line_no", "transaction_date", "before")


def printed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13, PF16: lines of the outer pages that name a total and hold an amount."""
    k = F.col("o_orderkey")
    lines = _table(spark, sf_dir, "orders").select(k.alias("line_no"), (k % 9 + 1).alias("page"), _in_turn(k, [F.lit("Total debit 1,200.00"), F.lit("Total pages 7"), F.lit("Rent 12.50"), F.lit("TOTAL: 5.00")]).alias("text"))
    return gates.total_lines(lines, F.lit(9))


def gap_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG07: what a gap beside a side's total looks like."""
    k = F.col("o_orderkey")
    total = F.when(k % 7 != 6, k * 1000).otherwise(0).cast("decimal(18,2)")
    gap = _in_turn(k, [k * 1000, k * 999, k * 990, k * 600, k * 400, k + 10, k * 0])
    return _table(spark, sf_dir, "orders").select(k.alias("k"), gates.signature(gap.cast("decimal(18,2)"), total).alias("reading"))


def joined_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM14: amounts whose thousands stand apart, joined where the gap is small."""
    k = F.col("o_orderkey")
    cell = lambda t, a, b: F.struct(t.alias("text"), F.lit(a).cast("double").alias("x0"), b.cast("double").alias("x1"))
    near = F.when(k % 2 == 0, 18).otherwise(10)
    cells = F.array(cell((k % 9 + 1).cast("string"), 0, near), cell(F.lit("234"), 20, F.lit(30)), cell(F.lit("567.80"), 32, F.lit(50)), cell(F.lit("900"), 52, F.lit(60)))
    return _table(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(F.transform(statements.joined_thousands(cells), lambda c: c["text"]), "|").alias("texts"))


QUERIES = {f.__name__: f for f in (header_choice, column_arithmetic, row_starts, date_edges, sheet_preview, sheet_money, node_records, listed_edges, form_records, case_verdicts, suite_tally, big_columns, column_headers, glued_amounts, written_lines, unsorted_dates, printed_totals, gap_signatures, joined_amounts)}

_SHEETS = """
WITH s AS (SELECT p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS row_no, p_name, (p_partkey % 1000) || '.25' AS price, p_partkey % 2 = 0 AS even, p_brand FROM part)
"""
_VERDICTS = """
WITH r AS (SELECT CAST(o_orderkey % 12 AS INT) AS i, o_orderkey % 2 = 0 AS even FROM orders),
v AS (SELECT 'case' || i AS name, CASE i WHEN 5 THEN 'SKIP' WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 6 THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE i WHEN 5 THEN 'not found' WHEN 4 THEN 'exit code' WHEN 2 THEN 'debit' WHEN 7 THEN 'count' WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 6 THEN NULL ELSE 'nothing expected' END AS reason,
  count(*) AS n, CAST(sum(CASE WHEN even THEN 1.25 ELSE 0 END) AS DECIMAL(38,2)) AS debit, CAST(sum(CASE WHEN even THEN 0 ELSE 2 END) AS DECIMAL(38,2)) AS credit FROM r GROUP BY i)
"""
_PAGE = "WITH c AS (SELECT l_orderkey, l_linenumber AS cluster, CAST(l_linenumber * 50 AS DOUBLE) AS lo, CAST(l_linenumber * 50 + 30 AS DOUBLE) AS hi, l_orderkey * l_linenumber % 17 AS n FROM lineitem) "

ORACLES = {
    "header_choice": """
WITH s AS (SELECT p_size, p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 30 WHEN 2 THEN 15 WHEN 4 THEN 20 END AS score FROM part)
SELECT p_size, ord, score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY score DESC, ord) = 1""",
    "column_arithmetic": """
WITH c AS (SELECT l_orderkey, l_linenumber AS l, CASE WHEN l_linenumber = 3 AND l_orderkey % 2 = 0 THEN 2 * (l_orderkey % 7 + 3) WHEN l_linenumber = 4 AND l_orderkey % 4 = 0 THEN 1 ELSE l_orderkey % 7 + 3 END AS n FROM lineitem),
o AS (SELECT l_orderkey, list({'l': l, 'n': n} ORDER BY l) AS a FROM c GROUP BY 1),
r AS (SELECT l_orderkey, CASE WHEN len(list_filter(a, lambda x: x.l >= 5)) > 0 THEN list_filter(a, lambda x: x.l >= 5) ELSE a END AS a FROM o),
b AS (SELECT l_orderkey, list_filter(a, lambda x: x.n >= 3 AND x.n * 100 >= 15 * list_max(list_transform(a, lambda y: y.n))) AS a FROM r)
SELECT l_orderkey, a[1].n AS n1, a[2].n AS n2, a[3].n AS n3 FROM b WHERE len(a) = 3 AND a[1].n + a[2].n = a[3].n""",
    "row_starts": """
WITH g AS (SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS amount_rows, count(*) FILTER (event_id % 3 <> 0) AS date_rows FROM events GROUP BY 1)
SELECT *, CASE WHEN date_rows > 1.3 * amount_rows THEN 'amount' END AS row_start FROM g""",
    "date_edges": """
WITH e AS (SELECT user_id, event_id, CAST(event_id % 41 AS INT) AS h FROM events), b AS (SELECT *, (CASE WHEN h % 2 = 0 THEN h // 2 WHEN (h // 2) % 2 = 0 THEN h // 2 ELSE h // 2 + 1 END) * 5 AS bucket FROM e),
d AS (SELECT user_id, bucket FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) = 1)
SELECT user_id, d.bucket, CAST(max(h * 2.5) AS DOUBLE) AS edge FROM e JOIN d USING (user_id) WHERE abs(h * 2.5 - d.bucket) <= 6 GROUP BY 1, 2""",
    "sheet_preview": _SHEETS + "SELECT p_size, row_no, '0:' || left(p_name, 22) || ' | 1:' || price || ' | 3:' || CASE WHEN even THEN price ELSE left(p_brand, 22) END AS line FROM s WHERE row_no <= 25",
    "sheet_money": _SHEETS + "SELECT p_size, 1 AS \"column\", count(*) AS n FROM s WHERE row_no <= 31 GROUP BY 1 UNION ALL SELECT p_size, 3, count(*) FROM s WHERE row_no <= 31 AND even GROUP BY 1",
    "node_records": """
SELECT c_custkey AS k, CASE WHEN c_custkey % 5 IN (0, 2) THEN 'n' || c_custkey ELSE '' END AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE 0 END AS form_id, CASE WHEN c_custkey % 5 = 0 THEN 'T' ELSE '' END AS title,
  CASE WHEN c_custkey % 5 = 0 THEN '{"a":1}' ELSE '{}' END AS data, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + c_custkey % 2 ELSE 0 END AS x, 0 AS y FROM customer""",
    "listed_edges": "SELECT c_custkey AS k, pos, CASE pos WHEN 0 THEN 'e' || c_custkey ELSE 'f' END AS id, CASE pos WHEN 0 THEN 'a' ELSE '' END AS source, CASE pos WHEN 0 THEN '' ELSE 'b' END AS target FROM customer, (VALUES (0), (1)) AS p(pos) WHERE c_custkey % 4 < 2",
    "form_records": "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 < 2 THEN 2 ELSE 0 END AS n_fields, CASE WHEN c_custkey % 4 < 2 THEN 'item_' || c_custkey || ',b' ELSE '' END AS ids, CASE WHEN c_custkey % 4 < 2 THEN 'edit,' ELSE '' END AS classes, CASE WHEN c_custkey % 4 < 2 THEN 'A,' ELSE '' END AS titles FROM customer",
    "case_verdicts": _VERDICTS + "SELECT * FROM v",
    "suite_tally": _VERDICTS + "SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'SKIP') AS skipped, false AS holds FROM v",
    "big_columns": _PAGE + "SELECT * EXCLUDE (top) FROM (SELECT *, max(n) OVER (PARTITION BY l_orderkey) AS top FROM c WHERE hi >= 110) WHERE n >= greatest(3, top * 0.15) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, lo) <= 3",
    "column_headers": "SELECT DISTINCT l_orderkey, l_linenumber AS cluster, CASE l_linenumber WHEN 1 THEN 'Date' WHEN 2 THEN 'Debit' WHEN 3 THEN 'Debit' ELSE 'Credit' END AS header FROM lineitem WHERE l_linenumber <= 5",
    "glued_amounts": """
SELECT user_id AS page, CAST(round((event_id % 7) * 10.04, 1) AS DOUBLE) AS edge, CAST(max(event_id) AS VARCHAR) AS loose, '1' || max(event_id) AS tight FROM events GROUP BY user_id, event_id % 7 HAVING max(event_id) % 3 = 0""",
    "written_lines": """
SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey AS line_no, '{"transaction_date": "2024-01-02", ' || CASE WHEN o_orderkey % 2 = 0 THEN '"transaction_time": "10:00", ' ELSE '' END || '"debit_sum": "' || o_orderkey || '.50", "credit_sum": "0", "currency": "USD", "description": "'
  || CASE WHEN o_orderkey % 5 > 0 THEN 'say \\"' || o_orderkey || '\\" \\\\' ELSE '' END || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ', "uniq_actor_field_value": "a' || o_orderkey || '"' ELSE '' END || '}' AS line FROM orders""",
    "unsorted_dates": """
SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey AS line_no, strftime(o_orderdate, '%Y-%m-%d') AS transaction_date, lag(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE transaction_date < before""",
    "printed_totals": "SELECT o_orderkey AS line_no, o_orderkey % 9 + 1 AS page, CASE o_orderkey % 4 WHEN 0 THEN 'Total debit 1,200.00' ELSE 'TOTAL: 5.00' END AS text FROM orders WHERE o_orderkey % 4 IN (0, 3) AND o_orderkey % 9 IN (0, 1, 7, 8)",
    "gap_signatures": "SELECT o_orderkey AS k, CASE CASE WHEN o_orderkey = 0 THEN 6 ELSE o_orderkey % 7 END WHEN 0 THEN 'whole_side' WHEN 4 THEN 'no_single_row' WHEN 5 THEN 'no_single_row' WHEN 6 THEN 'no_single_row' ELSE 'over_half' END AS reading FROM orders",
    "joined_amounts": "SELECT o_orderkey AS k, (o_orderkey % 9 + 1) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '|' END || '234567.80|900' AS texts FROM orders",
}
