"""Ledger, statement and gate queries on stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions import amounts as A, names as N
from ledgerloom.operators import gates, ledger, probe, statements as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("file"), F.col("l_suppkey").alias("actor_id"), A.currency_or_default(F.col("l_returnflag")).alias("currency"),
        F.when(F.col("l_linestatus") == "O", amount).otherwise(0).alias("debit_amount"), F.when(F.col("l_linestatus") == "O", F.lit(0)).otherwise(amount).alias("credit_amount"),
    )


def ledger_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG01, SF11: turnover of every (actor, currency), order lines standing in for ledger rows."""
    return ledger.turnover(_lines_as_rows(spark, sf_dir))


def ledger_batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG02: tallies of two files rolled up by currency and overall."""
    rows = _lines_as_rows(spark, sf_dir)
    tally = rows.groupBy("file", "actor_id", "currency").agg(F.count("*").alias("rows"), F.sum("debit_amount").cast("decimal(38,2)").alias("debit"), F.sum("credit_amount").cast("decimal(38,2)").alias("credit"))
    return ledger.batch_totals(tally)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_id") % 2 == 0, "debit").otherwise("credit")
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), side.alias("side"), N.ref_of("stmt", F.col("props"), side).alias("ref"))


def ledger_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF08: references of event payloads, with the rows that share each."""
    return _entries(spark, sf_dir).groupBy("ref").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"))


def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK06: which entries are posted and which are duplicates of others or of earlier postings."""
    e = _entries(spark, sf_dir)
    return ledger.outcomes(e, e.where("line_no % 40 = 0").select("ref")).select("file", "line_no", "side", "outcome")


def ledger_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LP01, SC01: JSON lines parsed, resolved by key or default, and tallied; a file with a bad row posts nothing."""
    o = _table(spark, sf_dir, "orders")
    raw = F.concat(
        F.lit('{"transaction_date": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "debit_sum": "'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit('", "credit_sum": "0.00", "currency": "'),
        F.lower(F.substring("o_orderpriority", 3, 3)), F.lit('", "description": "order"'), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(', "uniq_actor_field_value": "cust '), "o_custkey", F.lit('"'))).otherwise(""), F.lit("}"),
    )
    bad = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0), F.replace(raw, F.lit('"debit_sum": "'), F.lit('"debit_sum": "-'))).otherwise(raw)
    lines = o.select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("line_no"), bad.alias("raw"))
    held = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("actor_id"), F.lit("key").alias("field_id"), F.concat(F.lit("CUST"), "c_custkey").alias("value"), F.lit("2024").alias("created_at"), F.col("c_custkey").alias("listing"))
    options = ledger.PostOptions("Bank", actor_id="house", actor_field="key", actor_type="customer")
    return ledger.turnover(ledger.good_rows(ledger.resolved(lines, options, held, "key")))


def actor_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN05, WN12: the newest record of each key, the first listed on ties."""
    values = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("actor_id"), F.lit("cust").alias("field_id"), F.col("o_custkey").cast("string").alias("value"), F.col("o_orderdate").cast("string").alias("created_at"), F.col("o_orderkey").alias("listing"))
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return ledger.resolve_keys(keys, values, "cust")


def txn_islands_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM2, ASM7, WN03: a user turn opens a transaction, other turns continue it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _table(spark, sf_dir, "conversations").withColumn("txn", F.sum((F.col("role") == "user").cast("int")).over(w)).where("txn > 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    return t.groupBy("conv_id", "txn").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.md5(text).alias("description_md5"))


def _statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    cell = lambda t, x: F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x)).alias("x1"))
    money = F.col("value").cast("decimal(18,2)").cast("string")
    day = F.date_format("ts", "dd/MM/yyyy")
    cells = F.array(
        cell(F.col("event_type"), 0),
        cell(F.when(F.col("event_id") % 3 != 0, money).otherwise(""), 1),
        cell(F.when(F.col("event_id") % 4 != 0, day).otherwise(""), 2),
    )
    return e.select(F.col("user_id").cast("string").alias("file"), F.lit(1).alias("page"), F.col("event_id").alias("row_no"), F.lit(0.0).alias("top"), F.filter(cells, lambda c: c["text"] != "").alias("cells"))


SPEC = S.ColumnSpec(debit=S.col(1), description=S.col(0), date=S.col(2), numbers="us", start_re="^view", skip_rows=("signup",), currency_default="EUR")


def statement_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF03, PF05, ASM1-ASM7: arming, vetoes, islands, carried dates and folded rows over events as statement rows."""
    return S.transactions(_statement_rows(spark, sf_dir), SPEC).select("file", "line_no", "transaction_date", "debit_sum", "credit_sum", "currency", "description")


def statement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG03: counts of the same statement rows."""
    return S.metrics(_statement_rows(spark, sf_dir), SPEC).select("file", "transactions", "continuations", "skipped", "before_start", "orphan", "carried_dates", "debit_total")


_ROWS_SQL = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS file, event_id AS row_no, event_type AS t, CASE WHEN event_id % 3 <> 0 THEN CAST(value AS DECIMAL(18,2)) END AS v,
  CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS d FROM events),
a AS (SELECT *, coalesce(max(CASE WHEN t LIKE 'view%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS armed FROM e),
b AS (SELECT *, armed AND t LIKE '%signup%' AS veto, armed AND t NOT LIKE '%signup%' AS live FROM a),
c AS (SELECT *, live AND v IS NOT NULL AS is_new FROM b),
g AS (SELECT *, sum(CASE WHEN is_new OR veto THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY row_no) AS txn,
  coalesce(d, CASE WHEN is_new THEN last_value(CASE WHEN is_new THEN d END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_no) END) AS dd FROM c),
h AS (SELECT *, is_new AND dd IS NOT NULL AS ok, max(CASE WHEN is_new AND dd IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file, txn) = 1 AS open FROM g)
"""


def date_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM3, WN01: undated events take the last date before them."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    dated = F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd"))
    return _table(spark, sf_dir, "events").select("event_id", F.last(dated, ignorenulls=True).over(w).alias("carried"))


def amount_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF01-SF03, PF02: tokens in several grammars: their values under each, and whether they look like money."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    us = F.format_number(v, 2)
    k = F.col("o_orderkey") % 4
    token = F.when(k == 0, us).when(k == 1, F.translate(us, ",.", ".,")).when(k == 2, F.concat(F.lit("("), v.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("€ "), us, F.lit("-")))
    t = _table(spark, sf_dir, "orders").select(token.alias("token")).distinct()
    return t.select("token", A.amount_or_null(F.col("token"), "us").alias("us"), A.amount_or_null(F.col("token"), "eu").alias("eu"), A.is_money_shaped(F.col("token")).alias("shaped"))


def number_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12: the number grammar of each priority's tokens by vote."""
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    eu = F.col("o_orderpriority") >= "3"
    t = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.when(eu & (F.col("o_orderkey") % 10 != 0), F.translate(us, ",.", ".,")).otherwise(us).alias("token"))
    return probe.number_vote(t, ["source"])


def date_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, TK04: separator and order of each status's dates by vote."""
    f = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return probe.date_vote(_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), f.alias("token"), F.col("o_orderkey").alias("ord")), ["source"])


def currency_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15, SF05: currency codes in a column with their extents."""
    token = F.element_at(F.array(*(F.lit(x) for x in ("eur.", "$", "£", "USD", "euro", "₴"))), (F.col("event_id") % 6 + 1).cast("int"))
    return probe.currency_hits(_table(spark, sf_dir, "events").select("event_type", token.alias("token"), F.col("event_id").alias("x")), ["event_type"])


def edge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN04: one-dimensional single-link clusters of values of each user."""
    return probe.edge_clusters(_table(spark, sf_dir, "events").select("user_id", F.col("value").cast("decimal(18,2)").alias("x")), ["user_id"], tolerance=3)


def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN05: the same clusters, neighbours within ten points merged."""
    return probe.merged_clusters(edge_clusters(spark, sf_dir), ["user_id"], 10)


def column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17, JN19: column sums by flag, confirmed against printed totals."""
    li = _table(spark, sf_dir, "lineitem")
    signed = F.when(F.col("l_linenumber") == 1, -F.col("l_extendedprice").cast("decimal(18,2)")).otherwise(F.col("l_extendedprice").cast("decimal(18,2)"))
    t = li.select(F.col("l_linestatus").alias("file"), F.col("l_returnflag").alias("cluster"), signed.cast("string").alias("token"))
    totals = li.where("l_returnflag = 'R' AND l_linenumber <> 1").groupBy(F.col("l_linestatus").alias("file")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
    return probe.column_scores(t, ["file"], "us", totals)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    debit = F.when(k % 11 == 0, F.regexp_replace(price, r"\.", ",")).when(k % 2 == 0, price).otherwise("0.00")
    credit = F.when(k % 2 == 0, F.when(k % 26 == 0, F.lit("1.00")).otherwise("0.00")).when(k % 13 == 0, "0.00").otherwise(price)
    raw = F.concat(
        F.lit('{"transaction_date": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 17 == 0, "T").otherwise(""), F.lit('", "debit_sum": "'), debit, F.lit('", "credit_sum": "'), credit, F.lit('", "currency": "'),
        F.when(k % 19 == 0, "eur").otherwise("EUR"), F.lit('", "description": "'), F.when(k % 23 == 0, "  ").otherwise("order"), F.lit('"'), F.when(k % 29 == 0, ', "extra": 1').otherwise(""), F.when(k % 31 == 0, ', "uniq_actor_field_value": " "').otherwise(""), F.lit("}"),
    )
    return _table(spark, sf_dir, "orders").select(k.alias("line_no"), raw.alias("raw"))


_RECORDS_SQL = r"""
WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders),
r AS (SELECT k, CASE WHEN k % 11 = 0 THEN replace(price, '.', ',') WHEN k % 2 = 0 THEN price ELSE '0.00' END AS d,
  CASE WHEN k % 2 = 0 THEN CASE WHEN k % 26 = 0 THEN '1.00' ELSE '0.00' END WHEN k % 13 = 0 THEN '0.00' ELSE price END AS c FROM o),
n AS (SELECT *, coalesce(TRY_CAST(d AS DOUBLE), 0) AS dn, coalesce(TRY_CAST(c AS DOUBLE), 0) AS cn FROM r)
"""


def gate_one_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG06, ST04: failing rows and first line of every shape rule."""
    return gates.gate_one(_records(spark, sf_dir)).select("rule", "n", "first_line")


def gate_two_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG05, PF14: sums against printed totals, an equal excess read as the sign convention."""
    return gates.gate_two(_records(spark, sf_dir), want_debit="100.00", want_credit="200.00", want_count=5, currency="EUR").select("debit", "credit", "n", "delta_debit", "delta_credit", "ok")


def gap_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20, AG07: the first row whose debit equals a gap."""
    r = _records(spark, sf_dir)
    gap = r.where("line_no % 2 = 0 AND line_no % 11 <> 0").agg(F.max_by(F.get_json_object("raw", "$.debit_sum"), "line_no")).first()[0]
    return gates.explain_gap(r, "debit", gap)


def mixed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF07: local dates with and without clocks to epoch milliseconds in a zone."""
    clock = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return _table(spark, sf_dir, "events").select("event_id", A.occurred_ms(F.date_format("ts", "yyyy-MM-dd"), clock, "Europe/Kyiv").alias("ms"))


def statement_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF12, SF10: statement references and comments."""
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", N.statement_ref("stmt", F.col("o_custkey").cast("string"), "Bank", F.concat(F.lit("/tmp/run/"), "o_orderstatus", F.lit(".jsonl"))).alias("ref"), N.comment(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "08:20:00"), F.col("o_orderpriority")).alias("comment"))


QUERIES = {f.__name__: f for f in (ledger_tally, ledger_batch_rollup, ledger_refs, ledger_replay, ledger_post, actor_latest, txn_islands_fold, statement_transactions, statement_metrics, date_carry, amount_grammar, number_vote, date_vote, currency_hits, edge_clusters, merged_clusters, column_scores, gate_one_profile, gate_two_totals, gap_explain, mixed_moments, statement_refs)}

_TALLY = "SELECT l_linestatus AS file, l_suppkey AS actor_id, upper(l_returnflag) AS currency, CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS d, CASE WHEN l_linestatus = 'O' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS c FROM lineitem"
_ENTRIES = "SELECT event_type AS file, event_id AS line_no, CASE WHEN event_id % 2 = 0 THEN 'debit' ELSE 'credit' END AS side, 'stmt-' || left(sha1(props), 32) || CASE WHEN event_id % 2 = 0 THEN '-debit' ELSE '-credit' END AS ref FROM events"
_CLUSTERS = """
SELECT user_id, cluster, min(x) AS lo, max(x) AS hi, count(*) AS n FROM (SELECT user_id, x, sum(b) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS cluster FROM
 (SELECT user_id, x, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x) > 3 THEN 1 ELSE 0 END AS b FROM (SELECT user_id, CAST(value AS DECIMAL(18,2)) AS x FROM events))) GROUP BY 1, 2"""
_US = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]{1,2})?$|^-?[0-9]+(\.[0-9]{1,2})?$"
_EU = r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]{1,2})?$|^-?[0-9]+(,[0-9]{1,2})?$"

ORACLES = {
    "ledger_tally": f"SELECT actor_id, currency, count(*) AS \"rows\", CAST(sum(d) AS DECIMAL(38,2)) AS debit, CAST(sum(c) AS DECIMAL(38,2)) AS credit FROM ({_TALLY}) GROUP BY 1, 2",
    "ledger_batch_rollup": f"SELECT file, actor_id, currency, count(*) AS \"rows\", CAST(sum(d) AS DECIMAL(38,2)) AS debit, CAST(sum(c) AS DECIMAL(38,2)) AS credit FROM ({_TALLY}) GROUP BY GROUPING SETS ((file, actor_id, currency), (currency), ())",
    "ledger_refs": f"SELECT ref, min(line_no) AS first_line, count(*) AS n FROM ({_ENTRIES}) GROUP BY 1",
    "ledger_replay": f"SELECT file, line_no, side, CASE WHEN row_number() OVER (PARTITION BY ref ORDER BY file, line_no, side) = 1 AND ref NOT IN (SELECT ref FROM ({_ENTRIES}) WHERE line_no % 40 = 0) THEN 'posted' ELSE 'duplicate' END AS outcome FROM ({_ENTRIES})",
    "ledger_post": """
WITH o AS (SELECT *, o_orderstatus = 'P' AND o_orderkey % 5 = 0 AS bad FROM orders), f AS (SELECT DISTINCT o_orderstatus FROM o WHERE bad AND (o_orderkey % 3 <> 0 OR o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)))
SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'house' END AS actor_id, coalesce(nullif(trim(upper(substr(o_orderpriority, 3, 3))), ''), 'XXX') AS currency, count(*) AS "rows",
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS debit, CAST(0 AS DECIMAL(38,2)) AS credit
FROM o WHERE o_orderstatus NOT IN (SELECT * FROM f) AND (o_orderkey % 3 <> 0 OR o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) GROUP BY 1, 2""",
    "actor_latest": "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS actor_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1 AND o_custkey IN (SELECT c_custkey FROM customer)",
    "txn_islands_fold": "SELECT conv_id, CAST(txn AS BIGINT) AS txn, count(*) AS n, min(turn) AS first_turn, md5(string_agg(text, ' ' ORDER BY turn)) AS description_md5 FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS txn FROM conversations) WHERE txn > 0 GROUP BY 1, 2",
    "statement_transactions": _ROWS_SQL + """, x AS (SELECT file, txn, min(row_no) AS r, max(CASE WHEN ok THEN dd END) AS transaction_date, max(CASE WHEN ok THEN v END) AS v, string_agg(t, ' ' ORDER BY row_no) AS description FROM h WHERE open AND live GROUP BY 1, 2)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY r) AS line_no, transaction_date, CAST(abs(v) AS VARCHAR) AS debit_sum, '0.00' AS credit_sum, 'EUR' AS currency, description FROM x""",
    "statement_metrics": _ROWS_SQL + """SELECT file, count(*) FILTER (ok) AS transactions, count(*) FILTER (live AND NOT is_new AND open) AS continuations, count(*) FILTER (veto) AS skipped, count(*) FILTER (NOT armed) AS before_start,
 count(*) FILTER ((live AND NOT is_new AND NOT open) OR (is_new AND dd IS NULL)) AS orphan, count(*) FILTER (is_new AND d IS NULL AND dd IS NOT NULL) AS carried_dates, CAST(coalesce(sum(v) FILTER (ok), 0) AS DECIMAL(38,2)) AS debit_total FROM h GROUP BY 1""",
    "date_carry": "SELECT event_id, last_value(CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS carried FROM events",
    "amount_grammar": f"""
WITH t AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN us WHEN 1 THEN translate(us, ',.', '.,') WHEN 2 THEN '(' || p || ')' ELSE '€ ' || us || '-' END AS token FROM (SELECT o_orderkey, format('{{:,.2f}}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)) AS us, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders)),
c AS (SELECT token, CASE WHEN token LIKE '(%' THEN '-' || replace(replace(token, '(', ''), ')', '') WHEN token LIKE '%-' THEN '-' || replace(replace(replace(token, '€', ''), ' ', ''), '-', '') ELSE token END AS t FROM t)
SELECT token, CASE WHEN regexp_matches(t, '{_US}') THEN CAST(replace(t, ',', '') AS DECIMAL(18,2)) END AS us, CASE WHEN regexp_matches(t, '{_EU}') THEN CAST(replace(replace(t, '.', ''), ',', '.') AS DECIMAL(18,2)) END AS eu,
       regexp_matches(token, '^[-(]?[0-9][0-9.,]*\\)?$') AND (regexp_matches(t, '{_US}') OR regexp_matches(t, '{_EU}')) AND regexp_matches(t, '[.,][0-9]{{1,2}}$') AS shaped FROM c""",
    "number_vote": f"""
WITH t AS (SELECT o_orderpriority AS source, CASE WHEN o_orderpriority >= '3' AND o_orderkey % 10 <> 0 THEN translate(us, ',.', '.,') ELSE us END AS t FROM (SELECT *, format('{{:,.2f}}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)) AS us FROM orders)),
v AS (SELECT source, count(*) FILTER (regexp_matches(t, '{_US}')) AS us, count(*) FILTER (regexp_matches(t, '{_EU}')) AS eu, count(*) AS n FROM t GROUP BY 1)
SELECT *, CASE WHEN n = 0 OR us > eu THEN 'us' WHEN us < eu THEN 'eu' ELSE 'tie' END AS style FROM v""",
    "date_vote": """
WITH t AS (SELECT o_orderstatus AS source, o_orderkey AS ord, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)
SELECT source, CASE source WHEN 'F' THEN '.' WHEN 'O' THEN '/' ELSE '-' END AS sep,
  coalesce(arg_min(o, CASE WHEN o IS NOT NULL THEN ord END), 'dmy') AS date_order FROM (SELECT *, CASE WHEN source NOT IN ('F', 'O') THEN 'ymd' WHEN source = 'F' AND d > 12 THEN 'dmy' WHEN source = 'O' AND d > 12 THEN 'mdy' END AS o FROM t) GROUP BY 1, 2""",
    "currency_hits": "SELECT event_type, code, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT *, CASE event_id % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'USD' WHEN 5 THEN 'UAH' END AS code FROM events) WHERE code IS NOT NULL GROUP BY 1, 2",
    "edge_clusters": _CLUSTERS,
    "merged_clusters": f"""
WITH c AS ({_CLUSTERS}), b AS (SELECT *, CASE WHEN lo - max(hi) OVER (PARTITION BY user_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 10 THEN 1 ELSE 0 END AS b FROM c)
SELECT user_id, merged, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS merged FROM b) GROUP BY 1, 2""",
    "column_scores": """
WITH t AS (SELECT l_linestatus AS file, l_returnflag AS cluster, CASE WHEN l_linenumber = 1 THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS v FROM lineitem)
SELECT file, cluster, count(*) AS n, CAST(sum(CASE WHEN v < 0 THEN -v ELSE 0 END) AS DECIMAL(38,2)) AS negative, CAST(sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS DECIMAL(38,2)) AS positive, count(DISTINCT v) AS "distinct", cluster = 'R' AS confirmed FROM t GROUP BY 1, 2""",
    "gate_one_profile": _RECORDS_SQL + r"""
SELECT r.rule AS rule, count(*) FILTER (r.bad) AS n, min(k) FILTER (r.bad) AS first_line FROM (SELECT k, unnest([{'rule': 'keys', 'bad': k % 29 = 0}, {'rule': 'transaction_date', 'bad': k % 17 = 0}, {'rule': 'transaction_time', 'bad': false},
 {'rule': 'debit_sum', 'bad': NOT regexp_matches(d, '^[0-9]+\.[0-9]{2}$')}, {'rule': 'credit_sum', 'bad': NOT regexp_matches(c, '^[0-9]+\.[0-9]{2}$')}, {'rule': 'one side only', 'bad': dn > 0 AND cn > 0}, {'rule': 'not both zero', 'bad': dn = 0 AND cn = 0},
 {'rule': 'currency', 'bad': k % 19 = 0}, {'rule': 'description', 'bad': k % 23 = 0}, {'rule': 'uniq_actor_field_value', 'bad': k % 31 = 0}]) AS r FROM n) GROUP BY 1""",
    "gate_two_totals": _RECORDS_SQL + """
, s AS (SELECT CAST(sum(coalesce(TRY_CAST(d AS DECIMAL(18,2)), 0)) AS DECIMAL(38,2)) AS debit, CAST(sum(coalesce(TRY_CAST(c AS DECIMAL(18,2)), 0)) AS DECIMAL(38,2)) AS credit, count(*) AS n FROM n WHERE k % 19 <> 0)
SELECT debit, credit, n, CAST(debit - 100 - x AS DECIMAL(38,2)) AS delta_debit, CAST(credit - 200 - x AS DECIMAL(38,2)) AS delta_credit, abs(debit - 100 - x) < 0.01 AND abs(credit - 200 - x) < 0.01 AND n = 5 AS ok
FROM (SELECT *, CASE WHEN debit > 100 AND abs(debit - 100 - (credit - 200)) < 0.01 THEN debit - 100 ELSE 0 END AS x FROM s)""",
    "gap_explain": _RECORDS_SQL + "SELECT min(k) AS line_no, 'one_row' AS reading FROM n WHERE TRY_CAST(d AS DECIMAL(18,2)) = (SELECT arg_max(TRY_CAST(d AS DECIMAL(18,2)), k) FROM n WHERE k % 2 = 0 AND k % 11 <> 0)",
    "mixed_moments": "SELECT event_id, epoch_ms((CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END)::TIMESTAMP AT TIME ZONE 'Europe/Kyiv') AS ms FROM events",
    "statement_refs": "SELECT o_orderkey, 'stmt|' || o_custkey || '|Bank|' || o_orderstatus || '.jsonl' AS ref, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' 08:20:00' ELSE '' END || ' ' || o_orderpriority AS comment FROM orders",
}
