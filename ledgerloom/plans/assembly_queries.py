"""Queries of statement assembly over the events of each user as the rows of a statement, with their oracles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.operators import statements as S


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number k of each within its user's, from 0, and an amount that is never null."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("file"), "event_id", "event_type", "ts", k.alias("k"), ((F.col("event_id") % 9000) / 100 + 1).cast("decimal(18,2)").alias("money"))


def _cell(text: Column | str, x: float) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(text.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x)).alias("x1"))


def _rows(e: DataFrame, page: Column, *cells: Column) -> DataFrame:
    return e.select("file", page.cast("long").alias("page"), F.col("k").cast("long").alias("row_no"), F.filter(F.array(*cells), lambda c: c["text"].isNotNull()).alias("cells"))


BASE = S.ColumnSpec(debit=S.cols(1, 2), description=S.col(0), date=S.col(3), numbers="us", currency_default="EUR")


def clock_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM10-ASM12, PF01: a clock from a continuation leaves its description, a date outside its band is found in the text, amounts are no description."""
    e = _numbered(spark, sf_dir)
    third = F.col("k") % 3
    said = F.when(third == 0, F.concat(F.lit("pay "), "event_type")).when(third == 1, F.concat(F.lit("at "), F.date_format("ts", "HH:mm:ss"), F.lit("  note"))).otherwise("more")
    opener = lambda c: F.when(third == 0, c)
    rows = _rows(e, F.lit(1), _cell(said, 0), _cell(opener(F.col("money").cast("string")), 1), _cell(opener(F.date_format("ts", "dd/MM/yyyy")), 9))
    spec = replace(BASE, time_re=r"[0-9]{2}:[0-9]{2}:[0-9]{2}")
    return S.transactions(rows, spec).select("file", "line_no", "transaction_date", "transaction_time", "debit_sum", "description")


def stray_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM13, PF08, AG03: the last number of a band counts, numbers in no band are counted, with five samples."""
    e = _numbered(spark, sf_dir)
    money = F.col("money").cast("string")
    stray = F.when(F.col("event_id") % 3 == 0, (F.col("money") + 1).cast("decimal(18,2)").cast("string"))
    rows = _rows(e, F.lit(1), _cell("pay", 0), _cell("999.99", 1), _cell(money, 2), _cell(F.date_format("ts", "dd/MM/yyyy"), 3), _cell(stray, 7))
    return S.metrics(rows, BASE).select("file", "transactions", "debit_total", "unclaimed", F.array_join("unclaimed_samples", ",").alias("samples"))


def reconciled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG04: totals against a printed one, by side or, where signs were flipped, in place."""
    e = _numbered(spark, sf_dir)
    sign = F.when(F.col("event_id") % 2 == 0, "-").otherwise("")
    rows = _rows(e, F.lit(1), _cell("pay", 0), _cell(F.concat(sign, F.col("money").cast("string")), 1), _cell(F.date_format("ts", "dd/MM/yyyy"), 3))
    spec = replace(BASE, credit=S.col(5), expect_debit_total="1000.00", expect_count=60)
    return S.reconcile(S.metrics(rows, spec), spec).select("file", "transactions", "debit_total", "credit_total", "signed_convention", "count_ok", "ok")


def style_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG12: the number style of a statement by a vote over the first 200 tokens of its bands, whatever follows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    us, first = F.format_number(F.col("event_id") * 1000 + 0.5, 2), F.when(F.length("event_type") % 2 == 0, 60).otherwise(40)
    token = F.when(F.col("k") <= first, us).otherwise(F.translate(us, ",.", ".,"))
    numbered = e.where("event_type IS NOT NULL").withColumn("k", k).withColumn("file", F.col("event_type"))
    rows = _rows(numbered, F.lit(1), _cell("pay", 0), _cell(token, 1), _cell(token, 2), _cell(us, 8))
    return S.styles(rows, replace(BASE, numbers="auto")).select("file", "style", "us", "eu", "n")


def armed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN02, PF04, PF06, UD1-UD3: pages armed by their own start row, a stop row, filtered rows, mapped cells, transactions dropped after the fold."""
    e = _numbered(spark, sf_dir)
    pays = ~((F.col("k") % 5 == 1) | (F.col("k") == 18))
    said = F.when(F.col("k") % 5 == 1, "begin").when(F.col("k") == 18, "end of list").otherwise("pay")
    rows = _rows(e, F.floor(F.col("k") / 5), _cell(said, 0), _cell(F.when(pays, F.col("money").cast("string")), 1), _cell(F.when(pays, F.date_format("ts", "dd/MM/yyyy")), 3), _cell(F.when(F.col("k") % 7 == 3, "drop"), 6))
    spec = replace(
        BASE, start_re="^BEGIN", start_per_page=True, stop_re="^END", cell_map=lambda c: F.struct(F.upper(c["text"]).alias("text"), c["x0"].alias("x0"), c["x1"].alias("x1")),
        row_filter=lambda cells: ~F.exists(cells, lambda c: c["text"] == "DROP"), post=lambda t: t.where(F.col("debit_sum").cast("decimal(18,2)") >= 20),
    )
    return S.transactions(rows, spec).select("file", "line_no", "page", "transaction_date", "debit_sum", "description")


def row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM15: words to rows, each row anchored at the top of its first word."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    words = e.select(F.col("user_id").cast("string").alias("file"), (F.col("event_id") % 2).alias("page"), F.col("event_id").cast("string").alias("text"), F.col("event_id").cast("double").alias("x0"), F.col("event_id").cast("double").alias("x1"), ((F.col("event_id") * 7919) % 1000 / 8).cast("double").alias("top"))
    return S.clustered(words).select("file", "page", "row_no", "top", F.size("cells").cast("long").alias("n"), F.element_at("cells.text", 1).alias("first"))


QUERIES = {f.__name__: f for f in (clock_backfill, stray_numbers, reconciled_totals, style_sample, armed_pages, row_clusters)}

_E = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS file, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, CAST((event_id % 9000) / 100 + 1 AS DECIMAL(18,2)) AS money FROM events)
"""

ORACLES = {
    "clock_backfill": _E + """
SELECT file, k // 3 + 1 AS line_no, max(strftime(ts, '%Y-%m-%d')) FILTER (k % 3 = 0) AS transaction_date, max(strftime(ts, '%H:%M:%S')) FILTER (k % 3 = 1) AS transaction_time, CAST(max(money) FILTER (k % 3 = 0) AS VARCHAR) AS debit_sum,
  string_agg(CASE k % 3 WHEN 0 THEN 'pay ' || coalesce(event_type, '') WHEN 1 THEN 'at note' ELSE 'more' END, ' ' ORDER BY k) AS description FROM e GROUP BY file, k // 3""",
    "stray_numbers": _E + """
, s AS (SELECT *, row_number() OVER (PARTITION BY file, event_id % 3 = 0 ORDER BY k) AS n FROM e)
SELECT file, count(*) AS transactions, CAST(sum(money) AS DECIMAL(38,2)) AS debit_total, count(*) FILTER (event_id % 3 = 0) AS unclaimed,
  coalesce(string_agg(CAST(CAST(money + 1 AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY k) FILTER (event_id % 3 = 0 AND n <= 5), '') AS samples FROM s GROUP BY 1""",
    "reconciled_totals": _E + """
, t AS (SELECT file, count(*) AS transactions, CAST(coalesce(sum(money) FILTER (event_id % 2 = 1), 0) AS DECIMAL(38,2)) AS debit_total, CAST(coalesce(sum(money) FILTER (event_id % 2 = 0), 0) AS DECIMAL(38,2)) AS credit_total FROM e GROUP BY 1),
s AS (SELECT *, abs(debit_total - 1000) < 0.01 AS by_side, abs(debit_total - credit_total - 1000) < 0.01 AS in_place FROM t)
SELECT file, transactions, debit_total, credit_total, NOT by_side AND in_place AND credit_total > 0 AS signed_convention, transactions = 60 AS count_ok, (by_side OR in_place AND credit_total > 0) AND transactions = 60 AS ok FROM s""",
    "style_sample": """
WITH e AS (SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE event_type IS NOT NULL),
v AS (SELECT file, 2 * count(*) FILTER (k <= CASE WHEN length(file) % 2 = 0 THEN 60 ELSE 40 END) AS us, 2 * count(*) FILTER (k > CASE WHEN length(file) % 2 = 0 THEN 60 ELSE 40 END) AS eu FROM e WHERE k <= 100 GROUP BY 1)
SELECT file, CASE WHEN us > eu THEN 'us' ELSE 'eu' END AS style, us, eu, us + eu AS n FROM v""",
    "armed_pages": _E + """
, t AS (SELECT *, k // 5 AS page FROM e WHERE k < 18 AND k % 7 <> 3 AND k % 5 > 1 AND (k // 5 * 5 + 1) % 7 <> 3 AND money >= 20)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY k) AS line_no, page, strftime(ts, '%Y-%m-%d') AS transaction_date, CAST(money AS VARCHAR) AS debit_sum, 'PAY' AS description FROM t""",
    "row_clusters": """
WITH RECURSIVE w AS (SELECT CAST(user_id AS VARCHAR) AS file, event_id % 2 AS page, event_id, (event_id * 7919) % 1000 / 8 AS top FROM events),
a AS (SELECT file, page, min(top) AS top FROM w GROUP BY 1, 2 UNION ALL SELECT file, page, top FROM (SELECT w.file, w.page, min(w.top) AS top FROM a JOIN w ON a.file = w.file AND a.page = w.page AND w.top > a.top + 2 GROUP BY w.file, w.page, a.top)),
r AS (SELECT w.*, (SELECT max(a.top) FROM a WHERE a.file = w.file AND a.page = w.page AND a.top <= w.top) AS anchor FROM w)
SELECT file, page, row_number() OVER (PARTITION BY file ORDER BY page, anchor) AS row_no, anchor AS top, count(*) AS n, CAST(min(event_id) AS VARCHAR) AS first FROM r GROUP BY file, page, anchor""",
}
