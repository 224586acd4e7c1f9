"""Versions, exports, page dumps, the path index, rounds and ops files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.coercion import coerce
from ledgerloom.operators import graph, planning, rounds
from ledgerloom.operators.path_index import PathIndex
from ledgerloom.sources import dumps, sidecars, snapshots


def test_versions_are_taken_once(spark, tmp_path):
    store = snapshots.Versions(spark, f"file:{tmp_path}/s")
    assert store.latest() == -1
    a, b = spark.range(3), spark.range(5)
    assert store.commit(-1, {"by": "a"}, table=a) == 0
    with pytest.raises(snapshots.Moved):
        store.commit(-1, table=b)
    assert store.read().count() == 3 and store.manifest(0)["by"] == "a"
    assert store.commit(0, table=b) == 1 and store.read().count() == 5 and store.read(version=0).count() == 3


def test_a_failed_task_leaves_nothing_readable(spark, tmp_path):
    store = snapshots.Versions(spark, f"file:{tmp_path}/s")
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit(-1, ids=spark.range(3), values=bad)
    assert store.latest() == -1 and not [n for n in os.listdir(tmp_path / "s") if not n.startswith(".")]


def test_export_and_reload(spark, tmp_path):
    store = snapshots.Versions(spark, f"file:{tmp_path}/s")
    tree = spark.createDataFrame([("l", "1", "A", "a"), ("l", "2", "A > B", "b"), ("m", "1", "Z", "z")], "layer string, walk_key string, path string, id string")
    lines = spark.createDataFrame([("l", "1", 0, "A [t]"), ("m", "1", 0, "Z [t]")], "layer string, walk_key string, line_no int, line string")
    types = spark.createDataFrame([("t", 1)], "slug string, form_id int")
    with pytest.raises(ValueError, match="no nodes"):
        snapshots.export_layer(store, "gone", tree, types, lines)
    assert snapshots.load_index(store, "l", lambda: tree)[1] is False
    snapshots.export_layer(store, "l", tree, types, lines)
    paths, exported = snapshots.load_index(store, "l", lambda: tree)
    assert exported and sorted(r.path for r in paths.collect()) == ["A", "A > B"]
    assert [r.line for r in store.read("values").collect()] == ["A [t]"]
    assert snapshots.load_index(store, "m", lambda: tree)[1] is False


def test_a_dump_of_more_pages_than_the_platform_gives(spark, tmp_path):
    items = spark.range(1000).select(F.when(F.col("id") < 600, "a").otherwise("b").alias("layer"), "id", F.when(F.col("id") < 600, F.col("id")).otherwise(F.col("id") - 600).alias("_n"))
    dumps.write_pages(items, F.col("_n"), f"{tmp_path}/d", size=2)
    with pytest.raises(Exception, match="layer a does not end within 200 pages"):
        dumps.scan_pages(spark, f"{tmp_path}/d", "id long", size=2).where("layer = 'a'").collect()
    got = dumps.scan_pages(spark, f"{tmp_path}/d", "id long", size=2, most=None)
    assert sorted((r.layer, r.ord, r.id) for r in got.collect()) == [("a", k, k) for k in range(600)] + [("b", k, 600 + k) for k in range(400)]


def test_page_scan(spark, tmp_path):
    items = spark.range(25).select(F.when(F.col("id") < 10, "a").otherwise("b").alias("layer"), F.col("id"), F.concat(F.lit("t"), "id").alias("title"), F.lit(1.5).alias("x"), F.when(F.col("id") < 10, F.col("id")).otherwise(F.col("id") - 10).alias("_n"))
    dumps.write_pages(items, F.col("_n"), f"{tmp_path}/d", size=5)
    got = dumps.scan_pages(spark, f"{tmp_path}/d", "id long, title string", size=5)
    assert sorted(tuple(r) for r in got.collect()) == [(("a" if i < 10 else "b"), i if i < 10 else i - 10, i, f"t{i}") for i in range(25)]
    with pytest.raises(Exception, match="does not end within 2 pages"):
        dumps.scan_pages(spark, f"{tmp_path}/d", "id long", size=5, most=2).collect()
    os.makedirs(tmp_path / "e/layer=a/page=1")
    (tmp_path / "e/layer=a/page=1/x.txt").write_text(json.dumps([{"id": 1}]))
    with pytest.raises(Exception, match="lacks a page"):
        dumps.scan_pages(spark, f"{tmp_path}/e", "id long", size=5).collect()


def test_path_index_writes_only_what_changed(spark, tmp_path):
    tree = lambda rows: spark.createDataFrame([("l", i, p) for i, p in rows.items()], "layer string, id string, path string")
    index = PathIndex(snapshots.Versions(spark, f"file:{tmp_path}/s"))
    paths = {"1": "A", "2": "A > B", "3": "A > B > C", "4": "D", "5": "D > C@abcd", "6": "E"}
    assert index.update(tree(paths)) == 6
    del paths["6"]
    paths |= {"2": "A > X", "3": "A > X > C", "7": "D > C@abce"}
    assert index.update(tree(paths)) == 4 and index.update(tree(paths)) == 0
    assert {r.id: r.path for r in index.paths().collect()} == paths
    asked = spark.createDataFrame([("l", a) for a in ("C", "X > C", "D > C", "B", "E", "C@abcd", "D")], "layer string, addr string")
    same = lambda df: sorted(map(str, df.collect()))
    assert same(index.resolve(asked)) == same(graph.resolve_addresses(asked, tree(paths)))


def test_rounds_end_by_themselves_or_at_the_limit(spark):
    start = spark.range(1, 8).select(F.col("id").alias("k"), F.when(F.col("k") > 5, None).otherwise(F.col("k") - 1).alias("before"))
    known = spark.createDataFrame([(0, None)], "k long, before long")

    def step(todo, fresh):
        return todo.join(fresh.select(F.col("k").alias("before"), F.lit(True).alias("_y")), "before", "left").select("k", "before", F.col("_y").isNotNull().alias("done"))

    done, rest, n = rounds.until_settled(start, step, known, most=3)
    assert n == 3 and done.count() == 3 and rest.count() == 4
    done, rest, n = rounds.until_settled(start, step, known)
    assert n == 5 and rest.count() == 2 and done.where("round <> k").count() == 0


def test_ops_of_a_file_are_refused_by_the_planner(spark):
    doc = sidecars.parse_ops("mode: upsert\nops:\n- {at: A, create: [x], set: {a: 1}}\n- {at: A, append: {a: 1}}\n- {at: A, under: B, set: {a: 1}}\n- {at: A, set: {a: 1}}\n")
    ops = spark.createDataFrame(sidecars.op_rows(doc), sidecars.OP_ROW)
    assert [r.e is not None for r in ops.select("n", planning.op_errors(ops.columns).alias("e")).orderBy("n").collect()] == [True, True, True, False]


def test_coercion_of_dates_and_unknown_types():
    assert coerce("date", "20240102") == ("2024-01-02", None) and coerce("date", "2024-01-02T03:04:05Z")[0] == "2024-01-02"
    assert coerce("date", 20240102)[1] and coerce("date", "2024-02-30")[1]
    assert "unknown field type" in coerce("colour", "red")[1] and coerce("text", "red") == ("red", None)
