"""Evidence of statements, stored records and recorded expectations: cases at the edges."""

from pyspark.sql import functions as F

from ledgerloom.functions import records
from ledgerloom.operators import probe, regression


def test_envelopes(spark):
    texts = ['{"data":{"b":1,"a":[2]}}', '{"data":null}', '{"data":[]}', '{"data":[{"x":1},null]}', '{"data":{"list":[1]}}', '{"data":{"list":null}}', "[]", "x", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", records.item(F.col("t")).alias("one"), records.items(F.col("t")).alias("all")).orderBy("i").collect()
    assert [r["one"] for r in rows] == ['{"a":[2],"b":1}', "{}", "{}", '[{"x":1},null]', '{"list":[1]}', '{"list":null}', "{}", "{}", "{}", "{}"]
    assert [r["all"] for r in rows] == [[], [], [], ['{"x":1}', "null"], ["1"], [], [], [], [], []]


def test_records_have_zero_values(spark):
    texts = ['{"id":"a","formId":7,"hole":true,"data":{"k":"v"},"createdAt":123}', '{"id":null}', "no json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", records.record(F.col("t"), "actor").alias("r")).select("i", "r.*").orderBy("i")
    assert [tuple(r)[1:] for r in df.select("i", "id", "form_id", "hole", "data", "created_at").collect()] == [("a", 7, True, '{"k":"v"}', "123")] + [("", 0, False, "{}", "")] * 3
    places = spark.createDataFrame([('{"position":{"x":2.5,"y":3.5}}',), ('{"position":{"x":-0.5,"y":"1.4"}}',), ('{"position":null}',)], "t string").select(records.record(F.col("t"), "node").alias("r")).select("r.x", "r.y")
    assert sorted(map(tuple, places.collect())) == [(0, 0), (0, 1), (2, 4)]
    none = spark.createDataFrame([('{"sections":[{"id":"s"}]}',), ("",), (None,)], "t string").select(F.size(records.form_fields(F.col("t"))).alias("n"))
    assert [r["n"] for r in none.collect()] == [0, 0, 0]


def test_evidence_of_nothing(spark):
    rows = spark.createDataFrame([("f", 1, []), ("f", 2, None), ("g", 1, ["2024-01-02", "1.00"])], "f string, ord int, cells array<string>")
    assert {r["f"]: (r["amount_rows"], r["date_rows"], r["row_start"]) for r in probe.row_starts(rows, ["f"]).collect()} == {"f": (0, 0, None), "g": (1, 1, None)}
    assert probe.best_header(rows, ["f"], ["date"]).count() == 0
    edges = spark.createDataFrame([("f", 1, 100.0), ("f", 2, 300.0), ("f", 3, 106.0), ("f", 4, None)], "f string, ord int, x double")
    assert [tuple(r) for r in probe.date_edges(edges, ["f"]).collect()] == [("f", 100, 106.0)]
    clusters = spark.createDataFrame([("f", 10.0, 20.0, 3), ("f", 30.0, 40.0, 4), ("f", 50.0, 54.0, 7), ("f", 0.0, 5.0, 1)], "f string, lo double, hi double, n long")
    assert [tuple(r) for r in probe.column_arithmetic(clusters, ["f"], 100).collect()] == [("f", 3, 4, 7)]
    assert probe.column_arithmetic(clusters.where("n > 3"), ["f"], 100).count() == 0


def test_suite(spark):
    schema = "name string, found boolean, exit_code int, count long, debit decimal(18,2), credit decimal(18,2)"
    cases = spark.createDataFrame([("none", True, 0, 0, None, None), ("bare", True, 0, None, None, None), ("gone", False, 0, 1, None, None)], schema)
    rows = spark.createDataFrame([], "name string, debit_sum string, credit_sum string")
    assert {r["name"]: (r["status"], r["reason"]) for r in regression.judged(cases, rows).collect()} == {"none": ("PASS", None), "bare": ("FAIL", "nothing expected"), "gone": ("SKIP", "not found")}
    assert [tuple(r) for r in regression.tally(regression.judged(cases.where("name <> 'bare'"), rows)).collect()] == [(1, 0, 1, True)]
    assert [tuple(r) for r in regression.tally(regression.judged(cases.where("name = 'gone'"), rows)).collect()] == [(0, 0, 1, False)]
