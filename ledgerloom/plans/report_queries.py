"""Queries of reports, with oracles built on those of the tables that they tell of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import ledger, lookup, planning, reports
from ledgerloom.plans import graph_queries as G, rule_queries as R


def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK13: the lines of a plan over all orders."""
    return reports.plan_lines(planning.plan(*G._plan(spark, sf_dir)))


def find_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK13, AG08: the lines of a search for all customers."""
    return reports.find_lines(lookup.find_records(*G._cascade(spark, sf_dir)))


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK13, AG01-AG02: the lines of a batch of five jobs, one of which fails."""
    rows, outcome = R._jobs(spark, sf_dir, False)
    return reports.post_lines(ledger.job_counts(rows, outcome), ledger.turnover(ledger.good_rows(rows)))


def dry_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK13, LP04: the same batch, of which nothing is written."""
    rows, outcome = R._jobs(spark, sf_dir, True)
    return reports.post_lines(ledger.job_counts(rows, outcome), ledger.turnover(ledger.good_rows(rows)), dry_run=True)


QUERIES = {f.__name__: f for f in (plan_report, find_report, batch_report, dry_run_report)}

_COUNT = lambda n, one, many: f"CASE {n} WHEN 0 THEN NULL WHEN 1 THEN '1 {one}' ELSE {n} || ' {many}' END"


def _batch(what: str, posted: str, duplicate: str) -> str:
    """The oracle of a batch, which differs by what a dry run counts."""
    counts = lambda n: f"concat_ws(', ', {n('records')} || ' rows', '{what} ' || {n(posted)}, {_COUNT(n(duplicate), 'was there', 'were there')}, {_COUNT(n('skipped'), 'skipped', 'skipped')}"
    total = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT)"
    return R._JOBS + f""",
m AS (SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN CAST(price AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS debit, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS DECIMAL(38,2)) AS credit FROM o WHERE skipped = 0 AND o_orderpriority NOT IN (SELECT file FROM f))
SELECT 0 AS section, file AS at, 0 AS part, file || ': ' || CASE WHEN error IS NOT NULL THEN 'error, ' || error ELSE {counts(lambda c: c)}, CASE WHEN actors > 1 THEN 'across ' || actors || ' actors' END) END AS line FROM k
UNION ALL SELECT 1, '', 0, concat_ws(', ', {_COUNT('count(*)', 'job', 'jobs')}, {_COUNT('count(error)', 'failed', 'failed')}) || ': ' || {counts(total)}) FROM k
UNION ALL SELECT 2, 'EUR', 0, 'EUR  debit ' || debit || '  credit ' || credit || '  net ' || (credit - debit) || '  ' || {_COUNT('n', 'row', 'rows')} FROM m"""


ORACLES = {
    "plan_report": G._PLAN + f""",
l AS (SELECT *, [mark || CASE WHEN creates THEN ' order new' ELSE ' o' END || k || CASE mark WHEN '*' THEN ' (new record)' WHEN '+' THEN ' (fills a hole)' ELSE '' END, '    title: ' || new_title,
  CASE WHEN n_changes > 0 THEN '    status: ' || CASE WHEN creates THEN 'none' ELSE s END || ' -> ' || CASE k % 6 WHEN 1 THEN 'X' WHEN 0 THEN s ELSE 'F' END END, CASE WHEN n_changes = 2 THEN '    amount: none -> 5' END] AS x FROM m WHERE mark IN ('*', '+', '~')),
y AS (SELECT k, list_filter(x, lambda v: v IS NOT NULL) AS x FROM l),
c AS (SELECT count(*) FILTER (mark = '*') AS creates, CAST(coalesce(sum(n_changes) FILTER (mark IN ('+', '~')), 0) AS BIGINT) AS writes, count(*) FILTER (mark IN ('+', '~') AND new_title IS NOT NULL) AS renames, count(*) FILTER (mark = '+') AS holes, count(*) FILTER (mark = '>') AS held, count(*) FILTER (mark = '!') AS errors FROM m)
SELECT 0 AS section, '' AS at, 0 AS part, concat_ws(', ', {_COUNT('creates', 'record to create', 'records to create')}, {_COUNT('writes', 'value to write', 'values to write')}, {_COUNT('renames', 'rename', 'renames')}, {_COUNT('holes', 'hole to fill', 'holes to fill')}, {_COUNT('held', 'op holds already', 'ops hold already')}, {_COUNT('errors', 'error', 'errors')}) AS line FROM c
UNION ALL SELECT 1, lpad(CAST(k AS VARCHAR), 19, '0'), CAST(i - 1 AS INT), x[i] FROM (SELECT k, x, unnest(range(1, len(x) + 1)) AS i FROM y)
UNION ALL SELECT 2, lpad(CAST(k AS VARCHAR), 19, '0'), 0, '> o' || k FROM m WHERE mark = '>'
UNION ALL SELECT 3, lpad(CAST(k AS VARCHAR), 19, '0'), 0, '! op ' || k || ': ' || CASE k % 6 WHEN 2 THEN '''many'' is not an int' WHEN 3 THEN 'no field colour' ELSE 'the op does nothing' END FROM m WHERE mark = '!'""",
    "find_report": f"""
WITH f AS ({G.ORACLES['candidate_cascade']})
SELECT 0 AS section, value AS at, 0 AS part, value || CASE WHEN matched_by IS NULL THEN ': not found' ELSE ': found by ' || matched_by END AS line FROM f
UNION ALL SELECT 0, value, 1, '    ' || c_name || '  ref ref-' || first_id || '  [' || first_id || ']' FROM f JOIN customer ON c_custkey = first_id
UNION ALL SELECT 1, '', 0, count(matched_by) || ' found, ' || (count(*) - count(matched_by)) || ' not found' FROM f""",
    "batch_report": _batch("posted", "posted", "duplicate"),
    "dry_run_report": _batch("would post", "(posted + duplicate)", "0") + " UNION ALL SELECT 3, '', 0, 'nothing was written'",
}
