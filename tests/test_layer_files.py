"""Readers of held files and sidecar tables: against the readers of one text, with nulls, broken texts and empty tables."""

import json
import tracemalloc

import pytest

from ledgerloom.operators import graph
from ledgerloom.plans import file_queries
from ledgerloom.sources import files, layer_files as L, sidecars as C


def _texts(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, text string")


def test_broken_texts_leave_others_alone(spark):
    t = _texts(spark, ("a", '{"layer": "l", "paths": {"A > B": "1"}}'), ("b", "{"), ("c", '{"sep": "/", "paths": {"A": "1"}}'), ("d", "{}"), ("e", None))
    got = {r["file"]: (r["error"], r["layer"], r["path"], r["id"]) for r in L.ids(t).collect()}
    assert got == {"a": (None, "l", "A > B", "1"), "b": ("not JSON", None, None, None), "c": ("unexpected separator /", None, None, None), "d": ("no paths to resolve addresses against", None, None, None)}
    assert sorted(r["id"] for r in L.ids(_texts(spark, ("a", '{"paths": {"A": "1", "A": "2"}}'))).collect()) == ["1", "2"]
    bad = _texts(spark, ("a", "ops: ["), ("b", "ops: 3"), ("c", ""), ("d", "ops: [{at: A, set: {b: 1}}]"), ("e", "- x"), ("f", None))
    rows = L.ops(bad).collect()
    assert sorted(r["file"] for r in rows if r["error"]) == ["a", "b", "e"] and [(r["n"], r["set"]) for r in rows if not r["error"]] == [(1, {"b": "1"})]
    types = L.types(_texts(spark, ("a", "types: {a: {formId: 1}, b: {formId: 1}}"), ("b", "types: {a: {formId: 2, fields: {x: }}, c: {formId: 3}}"))).collect()
    assert sorted((r["file"], r["error"] is None, r["slug"] or "", r["name"]) for r in types) == [("a", False, "", None), ("b", True, "a", "x"), ("b", True, "c", None)]


def test_empty_tables(spark):
    none = _texts(spark).where("false")
    for read in (L.ids, L.types, L.ops, L.values, L.results, L.result_counts, L.settings):
        assert read(none).collect() == []
        assert read(_texts(spark, ("a", None))).collect() == []
    held = spark.createDataFrame([("a.csv", None)], "path string, content binary")
    assert files.rows(spark, held, file_queries.ANY).collect() == [] and files.lines(spark, held).collect() == []
    with pytest.raises(ValueError):
        files.rows(spark, "x/a.pdf", file_queries.ANY)


def test_settings_like_one_text(spark):
    texts = ["# c\nexport A='1'\nB=\"x=$y\"\n\nC=", "A=1\nA=2\n B = ' x ' ", "oops", "A='\nB=\"\"\nC='a\"", "=x", "\r\n\r\n", "exportA=1\nexport  B=2"]
    rows = L.settings(_texts(spark, *((str(n), t) for n, t in enumerate(texts)))).collect()
    for n, t in enumerate(texts):
        mine = [r for r in rows if r["file"] == str(n)]
        try:
            want = C.parse_settings(t)
        except ValueError as e:
            assert [r["error"] for r in mine] == [str(e)]
        else:
            assert {r["name"]: r["value"] for r in mine} == want and not any(r["error"] for r in mine)


def test_results_like_one_text(spark):
    buckets = [("r", 2, "u2", "updated"), ("r", 1, "u1", "updated"), ("r", 3, 'h"', "hole"), ("s", 1, "c", "created")]
    posted = [("r", 1, "x", 3), ("t", 1, "y", 4), ("t", 2, "z", 1)]
    texts = L.result_texts(spark.createDataFrame(buckets, "file string, ord long, id string, bucket string"), spark.createDataFrame(posted, "file string, ord long, ref string, n long")).collect()
    by = {r["file"]: json.loads(r["text"]) for r in texts}
    for f in "rst":
        own = [(i, b) for g, _, i, b in sorted(buckets) if g == f]
        statements = [{"ref": ref, "транзакций": n} for g, _, ref, n in posted if g == f]
        assert by[f] == json.loads(C.result_document(own, statements))
    again = L.results(_texts(spark, *((r["file"], r["text"]) for r in texts), ("u", "{"))).collect()
    assert sorted((r["file"], r["id"]) for r in again if not r["error"]) == sorted((f, i) for f, _, i, _ in buckets) and [r["file"] for r in again if r["error"]] == ["u"]


def test_ids_lines_are_the_document(spark):
    nodes = spark.createDataFrame([("l", 1, "a", 'A "x"', 0, 0), ("l", 2, "b", "Б", 0, 1), ("m", 1, "c", "C", 0, 0)], "layer string, ord long, id string, title string, x long, y long")
    edges = spark.createDataFrame([("l", 1, "a", "b")], "layer string, ord long, source string, target string")
    tree = graph.forest(nodes, edges).cache()
    lines = L.ids_lines(tree).orderBy("layer", "line_no").collect()
    for layer in "lm":
        assert "\n".join(r["line"] for r in lines if r["layer"] == layer) + "\n" == graph.ids_document(tree, layer)


def test_statement_folder_against_the_table(spark, tmp_path):
    c = [(k, f"Name; {k}", ("A", "B C", "D")[k % 3], k * 1.25 - 20) for k in range(200)]
    spark.createDataFrame(c, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["segment"].replace("%20", " "): (r["n"], float(r["total"])) for r in file_queries.statement_folder(spark, str(tmp_path)).collect()}
    want = {s: (len(m), sum(round(x, 2) for x in m)) for s in ("A", "B C", "D") for m in [[x for *_, t, x in c if t == s]]}
    assert got.keys() == want.keys() and all(got[s][0] == want[s][0] and abs(got[s][1] - want[s][1]) < 0.01 * 200 for s in want)


def test_values_leave_as_arrow_batches(spark):
    """The nodes of many texts leave a task as Arrow batches, without a pandas frame between."""
    text = "layer: x\n\ntree: |\n  O [order]\n    part: p1\n\n   \n    L [line]  # by ship\npictures: |\n  O\n  # none\n"
    got = L.values(spark.createDataFrame([("a", text), ("b", "layer: y\n"), ("c", None), ("d", "tree: |  \n  O [o]\nx\n  P [p]\n")], "file string, text string"))
    assert [(r.file, r.ord, r.path, r.description, [tuple(f) for f in r.fields], r.pictured) for r in got.orderBy("file", "ord").collect()] == [
        ("a", 0, "O", "", [("part", "p1")], True), ("a", 1, "O > L", "by ship", [], False), ("d", 0, "O", "", [], None),
    ]
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def _dictionary(types: int, fields: int) -> str:
    return C.types_document("l", [(f"t{k}", k + 1, f"T {k}", "") for k in range(types)], [(f"t{k}", n, f"f{n:05d}", f"i{n}", "int", f"#{n}", n % 2 == 0) for k in range(types) for n in range(fields)])


def test_type_dictionaries_are_read_a_type_at_a_time():
    """Memory follows the largest type, not the file; rows and errors are those of a whole reading."""
    text = _dictionary(30, 100)
    tracemalloc.start()
    whole = C.parse_types(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tracemalloc.start()
    n = sum(len(fields) for _, fields in C.types_in_parts(text))
    least = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(whole[1]) == 3000 and least < most / 10

    def read(parts: bool, text: str):
        try:
            made = list(C.types_in_parts(text)) if parts else C.parse_types(text)
        except L._BROKEN as e:
            return str(e).split("\n")[0]
        return ([k for k, _ in made], [f for _, own in made for f in own]) if parts else made

    broken = ["types: {a: {formId: 0}}\nb: [", "types: {a: {formId: 0}, b: !x 5}", "types: {a: !x 1}\nb: [", "types: {a: {formId: 1}, b: {formId: 1}}", "types: {a: }", "types: {a: {formId: 1, fields: {2: , b: }}}", "d: 2024-13-45\ntypes: {a: {formId: 1}}"]
    sound = ["types: {}", "a: 1", "types: {a: {formId: 0x10, form: 010, fields: {b: {id: x, writable: false}, a: }}, yes: {formId: 2}}", text]
    for t in broken + sound:
        assert read(True, t) == read(False, t), t
    for t in ("", "types: []", "types: {a: {formId: 1}, a: {formId: 2}}", "types: {a: {formId: 1, form: &x F, description: *x}}", "types: {a: {formId: 1}}\ntypes: {b: {formId: 2}}", "--- {types: {a: !x 1}}\n--- 5"):
        with pytest.raises(C.NotInParts):
            list(C.types_in_parts(t))


def test_types_of_large_files(spark):
    """Nothing of a file stays that proves broken at its end; others leave whole, and anchors are followed."""
    large = _dictionary(3, 4000)
    got = L.types(_texts(spark, ("a", large), ("b", large + "x: ["), ("c", large + "x: !y 1\n"), ("d", "types: {a: {formId: 1, form: &x F, description: *x}}"), ("e", "types: {a: {formId: 1}, a: {formId: 0}}"))).collect()
    assert [(r["file"], r["slug"], r["ord"], r["name"]) for r in got if r["file"] == "a"] == [("a", f"t{k}", n, f"f{n:05d}") for k in range(3) for n in range(4000)]
    assert [(r["file"], r["slug"]) for r in got if r["file"] in "bc"] == [("b", None), ("c", None)] and all(r["error"] for r in got if r["file"] in "bce")
    assert [(r["slug"], r["form_title"], r["description"], r["name"]) for r in got if r["file"] == "d"] == [("a", "F", "F", None)]


def test_type_texts_are_written_by_type(spark):
    """Entries are made a type a row and joined by form id, as one text is written."""
    kinds = [("l", "b", 2, "B: b", "two\n words"), ("l", "a", 3, "", ""), ("l", "", 1, "é", ""), ("m", "a", 7, "A", ""), ("m", "a", 5, "old", ""), ("m", None, 6, "N", ""), (None, "z", 1, "Z", "")]
    fields = [("l", "b", 1, "y", "1", "int", "  t  t ", False), ("l", "b", 0, "x", "", "string", "", True), ("l", "no", 0, "x", "", "string", "", True), ("m", "a", 0, "p", "q", "int", None, True), ("m", None, 0, "of null", "q", "int", "", True)]
    k = spark.createDataFrame(kinds, "file string, slug string, form_id long, form_title string, description string")
    f = spark.createDataFrame(fields, "file string, slug string, ord int, name string, id string, type string, title string, writable boolean")
    made = L.type_texts(k, f)
    assert {r["file"]: r["text"] for r in made.collect()} == {file: C.types_document(file, [t[1:] for t in kinds if t[0] == file], [t[1:] for t in fields if t[0] == file]) for file in ("l", "m", None)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [file" in plan and "slug" in plan.split("RepartitionByExpression [file")[2].split("]")[0]
    assert C.types_document("l", [], []) == 'layer: "l"\ntypes: {}\n'
