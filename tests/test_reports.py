"""Reports: their lines, orders, nulls and empty tables."""

from ledgerloom.operators import reports

FOUND = "value string, verdict string, matched_by string, records array<struct<listing:int,id:string,ref:string,title:string>>, similar array<struct<listing:int,id:string,ref:string,title:string>>"
JOBS = "file string, records long, posted long, duplicate long, skipped long, actors long, error string"
TURNOVER = "actor_id string, currency string, rows long, debit decimal(38,2), credit decimal(38,2)"


def _text(report):
    return [r["line"] for r in report.sort(*reports.ORDER).collect()]


def test_find(spark):
    rows = [("b", "not found", None, None, [(1, "i", "r", "a b")]), ("a", "FOUND", "title", [(1, "i", "", "A"), (2, "j", "r", "A")], None), ("c", "not found", None, None, None)]
    text = _text(reports.find_lines(spark.createDataFrame(rows, FOUND)))
    assert text == ["a: found by title", "    A  no ref  [i]", "    A  ref r  [j]", "b: not found", "    like it: a b", "c: not found", "1 found, 2 not found"]
    assert _text(reports.find_lines(spark.createDataFrame([], FOUND))) == ["0 found, 0 not found"]


def test_batch(spark, tmp_path):
    jobs = spark.createDataFrame([("x", 5, 3, 1, 2, 2, None), ("y", None, None, None, None, None, "line 1: not JSON"), ("z", 1, 1, 0, 0, 1, None)], JOBS)
    money = spark.createDataFrame([("a", "USD", 1, 2, 0), ("b", "USD", 3, 1, 5), ("a", "EUR", 1, 0, 1)], "actor_id string, currency string, rows long, debit int, credit int")
    report = reports.post_lines(jobs, money)
    want = ["x: 5 rows, posted 3, 1 was there, 2 skipped, across 2 actors", "y: error, line 1: not JSON", "z: 1 rows, posted 1", "3 jobs, 1 failed: 6 rows, posted 4, 1 was there, 2 skipped", "EUR  debit 0.00  credit 1.00  net 1.00  1 row", "USD  debit 3.00  credit 5.00  net 2.00  4 rows"]
    assert _text(report) == want
    assert _text(reports.post_lines(jobs, money, dry_run=True))[-1] == "nothing was written"
    assert _text(reports.post_lines(spark.createDataFrame([], JOBS), spark.createDataFrame([], TURNOVER))) == ["no jobs: 0 rows, posted 0"]
    reports.write(report, f"{tmp_path}/report")
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert [x for p in parts for x in p.read_text().splitlines()] == want
