"""Statements, gates, ledger, graph, plans, lookup and streaming on small tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import gates, graph, ledger, lookup, planning, probe, statements as S
from ledgerloom.sources import files

SHEET = "Date,Ref,Narrative,More,Paid out,Paid in\n01/04/2026,,Card payment,Tesco Metro,29.00,\n,,continuation of,the narrative,,\n04/04/2026,,Salary,ACME Ltd,,\"2,500.00\"\n07/04/2026,,Transfer out,To savings,150.50,\nTotal,,,,179.50,\"2,500.00\"\n"
DRCR = "Date,Narration,Amount,Type,Balance\n05-04-2026,NEFT ACME PAYROLL,2500.00,CR,3000.00\n06-04-2026,UPI GROCERY,149.75,DR,2850.25\n06-04-2026,ATM WITHDRAWAL,200.00,DR,2650.25\n07-04-2026,INTEREST CREDIT,1.30,CR,2651.55\n"
ACTORS = "Date,X,Account,Narrative,Out,In\n01/04/2026,,RO111,Card payment,29.00,\n04/04/2026,,RO222,Salary,,2500.00\n07/04/2026,,RO111,Transfer out,150.50,\n"


def run(spark, tmp_path, text, spec):
    (tmp_path / "a.csv").write_text(text)
    rows = files.rows(spark, str(tmp_path / "a.csv"), spec)
    got = [tuple(r) for r in S.transactions(rows, spec).orderBy("line_no").select("transaction_date", "debit_sum", "credit_sum", "currency", "description", "uniq_actor_field_value").collect()]
    return got, S.metrics(rows, spec), rows


def test_sheet(spark, tmp_path):
    spec = S.ColumnSpec(debit=S.col(4), credit=S.col(5), description=S.cols(2, 3), date=S.col(0), numbers="us", currency_default="GBP", header_rows=1, stop_re="^Total", expect_debit_total="179.50", expect_credit_total="2,500.00", expect_count=3)
    got, counts, rows = run(spark, tmp_path, SHEET, spec)
    assert got == [
        ("2026-04-01", "29.00", "0.00", "GBP", "Card payment Tesco Metro continuation of the narrative", None),
        ("2026-04-04", "0.00", "2500.00", "GBP", "Salary ACME Ltd", None),
        ("2026-04-07", "150.50", "0.00", "GBP", "Transfer out To savings", None),
    ]
    m = counts.first()
    assert (m["transactions"], m["continuations"], m["stopped_at"]) == (3, 1, 1)
    assert S.reconcile(counts, spec).first()["ok"]
    lines = [r[0] for r in S.jsonl(S.transactions(rows, spec)).orderBy("line_no").select("line").collect()]
    assert lines[0] == json.dumps({"transaction_date": "2026-04-01", "debit_sum": "29.00", "credit_sum": "0.00", "currency": "GBP", "description": got[0][4]})


def test_marker_column(spark, tmp_path):
    spec = S.ColumnSpec(amount=S.col(2), sign_band=S.col(3), sign_re_debit="DR", sign_re_credit="CR", balance=S.col(4), description=S.col(1), date=S.col(0), currency_default="INR", header_rows=1)
    got, counts, _ = run(spark, tmp_path, DRCR, spec)
    assert [x[1:3] for x in got] == [("0.00", "2500.00"), ("149.75", "0.00"), ("200.00", "0.00"), ("0.00", "1.30")]
    m = counts.first()
    assert (str(m["debit_total"]), str(m["credit_total"]), m["number_style"], m["unclaimed"]) == ("349.75", "2501.30", "us", 0)


def test_actor_column(spark, tmp_path):
    spec = S.ColumnSpec(debit=S.col(4), credit=S.col(5), actor=S.col(2), description=S.col(3), date=S.col(0), numbers="us", currency_default="RON", header_rows=1)
    got, _, _ = run(spark, tmp_path, ACTORS, spec)
    assert [x[5] for x in got] == ["RO111", "RO222", "RO111"]


def row(n, *cells, page=1):
    return ("f", page, n, 0.0, [(t, float(x), float(x)) for t, x in cells])


def test_flips_both_sides_vetoes_and_backfills(spark):
    spec = S.ColumnSpec(debit=S.col(1), credit=S.col(2), currency=S.col(3), actor=S.col(4), description=S.col(0), date=S.col(5), numbers="us", time_re=r"\d\d:\d\d:\d\d", skip_re="^Sold", start_re="^Begin", start_per_page=True)
    rows = [
        row(1, ("early", 0), ("9.99", 1), ("01.01.2026", 5)), row(2, ("Begin", 0)), row(3, ("flip", 0), ("-5.00", 2), ("02.01.2026", 5)), row(4, ("at 08:20:02 shop", 0), ("$", 3), ("ACC", 4)),
        row(5, ("both", 0), ("1.00", 1), ("2.00", 2), ("03.01.2026", 5)), row(6, ("lost", 0)), row(7, ("carried", 0), ("3.00", 2)), row(8, ("Sold 100.00", 0), ("100.00", 1)), row(9, ("orphan", 0)),
        row(10, ("page two", 0), ("4.00", 1), ("05.01.2026", 5), page=2), row(11, ("Begin", 0), page=2), row(12, ("last", 0), ("4.00", 1), ("05.01.2026", 5), page=2),
    ]
    df = spark.createDataFrame(rows, files.ROWS)
    got = [tuple(r) for r in S.transactions(df, spec).select("transaction_date", "transaction_time", "debit_sum", "credit_sum", "currency", "description", "uniq_actor_field_value").collect()]
    assert got == [("2026-01-02", "08:20:02", "5.00", "0.00", "USD", "flip at shop", "ACC"), ("2026-01-03", None, "0.00", "3.00", "XXX", "carried", None), ("2026-01-05", None, "4.00", "0.00", "XXX", "last", None)]
    m = S.metrics(df, spec).first()
    assert (m["sign_flips"], m["both_sides"], m["carried_dates"], m["skipped"], m["orphan"], m["before_start"], m["pages"]) == (1, 1, 1, 1, 2, 4, 2)
    assert (str(m["signed_credit"]), str(m["debit_total"])) == ("0.00", "9.00")


def test_spec_rules():
    for bad in (dict(), dict(amount=(1, 1), debit=(2, 2)), dict(debit=(1, 1), sign_re_debit="D"), dict(debit=(1, 1), row_start="x"), dict(debit=(1, 1), y_tolerance=9)):
        with pytest.raises(ValueError):
            S.ColumnSpec(**bad).validate()


def test_words_to_rows(spark):
    words = [("f", 1, "a", 0.0, 1.0, 10.0), ("f", 1, "c", 9.0, 10.0, 11.9), ("f", 1, "b", 5.0, 6.0, 11.0), ("f", 1, "next", 0.0, 1.0, 12.5)]
    got = S.clustered(spark.createDataFrame(words, "file string, page int, text string, x0 double, x1 double, top double")).orderBy("row_no").collect()
    assert [[c["text"] for c in r["cells"]] for r in got] == [["a", "b", "c"], ["next"]]
    cells = [("-2", 0.0, 1.0), ("633.00", 2.0, 5.0), ("1", 50.0, 51.0), ("234", 52.0, 54.0), ("567.8", 55.0, 57.0), ("900", 58.0, 59.0), ("7", 90.0, 91.0), ("123", 99.0, 100.0)]
    df = spark.createDataFrame([(cells,)], "cells array<struct<text:string,x0:double,x1:double>>")
    assert [c["text"] for c in df.select(S.joined_thousands(F.col("cells"))).first()[0]] == ["-2633.00", "1234567.8", "900", "7", "123"]


def test_gates(spark):
    good = {"transaction_date": "2026-04-01", "debit_sum": "29.00", "credit_sum": "0.00", "currency": "GBP", "description": "x"}
    rows = [(1, json.dumps(good)), (2, json.dumps(good | {"debit_sum": "1,0"})), (3, json.dumps(good | {"uniq_actor_field_value": " "})), (4, json.dumps({k: v for k, v in good.items() if k != "currency"}))]
    df = spark.createDataFrame(rows, "line_no long, raw string")
    bad = {r["rule"]: (r["n"], r["first_line"]) for r in gates.gate_one(df).collect() if r["n"]}
    assert bad == {"debit_sum": (1, 2), "not both zero": (1, 2), "uniq_actor_field_value": (1, 3), "keys": (1, 4), "currency": (1, 4)}
    assert gates.gate_two(df).first()["ok"] is None and gates.gate_two(df, want_debit="87.00").first()["ok"]
    both = spark.createDataFrame([(1, json.dumps(good | {"credit_sum": "5.00"}))], "line_no long, raw string")
    assert gates.gate_two(both, want_debit="24.00", want_credit="0.00").first()["ok"]
    assert gates.explain_gap(df, "debit", "29.00").first()["line_no"] == 1
    assert gates.explain_gap(df, "debit", "86.13").first()["reading"] == "over_half"
    assert gates.explain_gap(df, "debit", "87.00").first()["reading"] == "whole_side"


def test_posting(spark):
    line = lambda **k: json.dumps({"transaction_date": "2026-04-01", "debit_sum": "1.50", "credit_sum": "0.00", "currency": "uah", "description": "d"} | k)
    rows = [("a", 1, line()), ("a", 2, line()), ("a", 3, line(uniq_actor_field_value="ua 1")), ("a", 4, line(uniq_actor_field_value="nobody")), ("a", 5, "  "), ("b", 1, line(debit_sum="-1")), ("c", 1, "{oops"), ("d", 1, line(debit_sum=5, currency=""))]
    df = spark.createDataFrame(rows, "file string, line_no long, raw string")
    values = spark.createDataFrame([("old", "k", "UA1", "2020", 0), ("new", "k", "UA1", "2024", 1)], "actor_id string, field_id string, value string, created_at string, listing long")
    options = ledger.PostOptions("Bank", actor_id="me", actor_field="k", actor_type="t")
    r = ledger.resolved(df, options, values, "k")
    assert {x["file"] for x in ledger.failed_files(r).collect()} == {"b", "c"}
    good = ledger.good_rows(r)
    assert {tuple(x) for x in ledger.turnover(good).select("actor_id", "currency", "rows", F.col("debit").cast("string")).collect()} == {("me", "UAH", 2, "3.00"), ("new", "UAH", 1, "1.50"), ("me", "XXX", 1, "5.00")}
    e = ledger.entries(good, options)
    done = ledger.outcomes(e)
    assert sorted(x["outcome"] for x in done.collect()) == ["duplicate", "posted", "posted", "posted"]
    assert {x["outcome"] for x in ledger.outcomes(e, e).collect()} == {"duplicate"}
    with pytest.raises(ValueError):
        ledger.PostOptions("Bank").validate()


def test_streaming_replay(spark, tmp_path):
    from ledgerloom.streaming.ledger_stream import post_stream

    os.makedirs(tmp_path / "in")
    lines = [json.dumps({"transaction_date": "2026-04-01", "debit_sum": f"{i}.50", "credit_sum": "0.00"}) for i in range(5)]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, raw string")
    options = ledger.PostOptions("Bank", actor_id="me")
    for k in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        q = post_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), options, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def _layer(spark, actors, edges):
    nodes = spark.createDataFrame([("l", i, a[0], a[1], *(a[2:] or (0, 0))) for i, a in enumerate(actors)], "layer string, ord long, id string, title string, x long, y long")
    e = spark.createDataFrame([("l", i, a, b) for i, (a, b) in enumerate(edges)], "layer string, ord long, source string, target string")
    return nodes, e


def test_forest(spark):
    nodes, edges = _layer(spark, [("a1", "ACME"), ("aaaa1111", "Kid", 5, 0), ("bbbb2222", "Kid", 1, 0), ("c", "Leaf")], [("a1", "aaaa1111"), ("a1", "bbbb2222"), ("bbbb2222", "c"), ("aaaa1111", "c"), ("c", "c"), ("zz", "c")])
    got = [tuple(r) for r in graph.forest(nodes, edges).orderBy("walk_key").select("id", "path").collect()]
    assert got == [("a1", "ACME"), ("bbbb2222", "ACME > Kid@bbbb"), ("c", "ACME > Kid@bbbb > Leaf"), ("aaaa1111", "ACME > Kid@aaaa")]
    assert [r["warning"] for r in graph.edge_warnings(nodes, edges).collect()] == ["already has a parent", "self-edge", "dangling endpoint"]
    tree = graph.forest(nodes, edges)
    asked = spark.createDataFrame([("l", a) for a in ("Leaf", "Kid", "Kid > Leaf", "eaf", "ACME > Kid@aaaa")], "layer string, addr string")
    assert {r["addr"]: r["verdict"] for r in graph.resolve_addresses(asked, tree).collect()} == {"Leaf": "found", "Kid": "ambiguous", "Kid > Leaf": "found", "eaf": "missing", "ACME > Kid@aaaa": "found"}
    assert json.loads(graph.ids_document(tree, "l"))["paths"]["ACME"] == "a1"


def test_cycle_residue(spark):
    nodes, edges = _layer(spark, [("r", "Root"), ("x", "X", 1, 0), ("y", "Y", 2, 0), ("z", "Z", 3, 0)], [("x", "y"), ("y", "z"), ("z", "x")])
    assert [tuple(r) for r in graph.cycles(nodes, edges).orderBy("walk_no").select("id", "parent_id", "path").collect()] == [("x", None, "X"), ("y", "x", "X > Y"), ("z", "y", "X > Y > Z")]


def test_types(spark):
    forms = spark.createDataFrame([(701, "DEV_DTO_WIDGET"), (702, "DEV_DTO_WIDGET"), (703, "PLATFORM_THING"), (705, "DEV_DTO_OTHER")], "form_id long, form_title string")
    p = graph.common_prefix(forms, "form_title").first()["prefix"]
    assert p == "DEV_DTO_"
    assert {r["form_id"]: r["slug"] for r in graph.types(forms, p).collect()} == {701: "widget", 702: "widget_702", 703: "platform_thing", 705: "other"}
    f = spark.createDataFrame([("t", 0, "a"), ("t", 1, "a_2"), ("t", 2, "a"), ("t", 3, "a")], "slug string, ord int, name string")
    assert [r["name"] for r in graph.deduped_names(f).orderBy("ord").collect()] == ["a", "a_2", "a_3", "a_4"]


def _plan_tables(spark):
    actors = spark.createDataFrame([("e1", "emp", "Ivan", "", "R1", "", {"role": '"CFO"'}, True), ("e2", "emp", "Petro", "", "", "", {}, False)], "id string, slug string, title string, description string, ref string, picture string, data map<string,string>, hole boolean")
    tree = spark.createDataFrame([("l", "e1", "ACME > Ivan"), ("l", "e2", "ACME > Petro")], "layer string, id string, path string")
    fields = spark.createDataFrame([("emp", 0, "role", "role", "enum[CFO, CEO]", True), ("emp", 1, "age", "age", "int", True)], "slug string, ord int, name string, id string, type string, writable boolean")
    return actors, tree, fields


OPS = "n long, id string, at string, type string, ref string, set map<string,string>, rename string, describe string, picture string"


def test_plan_apply_replay(spark):
    actors, tree, fields = _plan_tables(spark)
    ops = spark.createDataFrame([
        (1, None, "ACME > Ivan", None, None, {"role": '"CEO"'}, None, None, None), (2, None, "ACME > Old", None, None, None, "Petro", None, None), (3, None, None, "emp", "R9", {"age": '"42"'}, "New", None, None), (4, None, None, "emp", "R9", {"age": "1"}, None, None, None),
        (5, None, "Nobody", None, None, {"age": "1"}, None, None, None), (6, None, "Petro", None, None, {"rle": "1", "age": '"x"'}, None, None, None), (7, None, "Petro", None, None, None, None, None, None),
    ], OPS)
    p = planning.plan(ops, tree, actors, fields)
    got = {r["n"]: r for r in p.collect()}
    assert {n: r["mark"] for n, r in got.items()} == {1: "+", 2: ">", 3: "*", 4: "!", 5: "!", 6: "!", 7: "!"}
    assert "age" not in (got[6]["error"] or "") or "no field rle" in got[6]["error"]
    assert planning.summary(p).first().asDict() == {"creates": 1, "writes": 1, "renames": 0, "describes": 0, "holes": 1, "pictures": 0, "satisfied": 1, "errors": 4}
    with pytest.raises(ValueError):
        planning.apply(p, actors)
    after = planning.apply(p, actors, partial=True)
    new = {r["ref"]: r for r in after.collect()}
    assert new["R1"]["data"] == {"role": "CEO"} and not new["R1"]["hole"] and new["R9"]["title"] == "New"
    again = planning.plan(ops.where("n <= 3"), tree, after, fields)
    assert {r["n"]: r["mark"] for r in again.collect()} == {1: ">", 2: ">", 3: ">"}


def test_tallies(spark):
    applied = spark.createDataFrame([(1, "a", True, False), (2, "a", False, True), (3, "b", False, True), (4, "c", False, False)], "n long, id string, creates boolean, fills_hole boolean")
    known = spark.createDataFrame([("c", "created")], "id string, bucket string")
    first = planning.fold_tally(applied, known)
    assert {tuple(r) for r in first.collect()} == {("a", "created"), ("b", "hole"), ("c", "created")}
    assert planning.fold_tally(applied, first).count() == 3


def test_want_list(spark):
    nodes = spark.createDataFrame([(1, "t"), (2, "t")], "node_id long, slug string")
    held = spark.createDataFrame([(1, "a")], "node_id long, name string")
    fields = spark.createDataFrame([("t", 0, "a", "A", True), ("t", 1, "b", "B", False), ("t", 2, "confidence", "C", True)], "slug string, ord int, name string, title string, writable boolean")
    w = lookup.want_list(nodes, held, fields)
    assert {tuple(r) for r in w.select("node_id", "name").collect()} == {(2, "a")}
    assert lookup.want_list(nodes, held, fields, keep_all=True).count() == 5
    assert lookup.want_totals(nodes, w).first().asDict() == {"nodes": 2, "with_holes": 1, "missing": 1}


def test_probe(spark):
    assert probe.sample_pages(5) == [1, 2, 3, 4, 5] and probe.sample_pages(400)[:3] == [1, 2, 3] and len(probe.sample_pages(400)) == 20
    df = spark.createDataFrame([(["Date", "Descri", "Debit", "1,00"],), (["x"],)], "c array<string>")
    assert [r[0] for r in df.select(probe.header_score(F.col("c"), ["Date", "Description", "Debit", "Credit"])).collect()] == [5, None]
    c = spark.createDataFrame([("f", 0, 90.0, 100.0, 10), ("f", 1, 60.0, 70.0, 1), ("f", 2, 10.0, 20.0, 50)], "file string, cluster int, lo double, hi double, n long")
    assert [r["cluster"] for r in probe.top_columns(c, ["file"], 100.0).collect()] == [0]
    h = spark.createDataFrame([("f", 95.0, "Debit"), ("f", 71.0, "Credit")], "file string, x1 double, text string")
    assert {r["cluster"]: r["header"] for r in probe.nearest_headers(c, h, ["file"]).collect()} == {0: "Debit", 1: "Credit", 2: "Credit"}


def test_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("12 ab\n\n\fpage two\n")
    rows = files.fixed_width(spark, str(tmp_path / "a.txt")).orderBy("row_no").collect()
    assert [(r["page"], [c["text"] for c in r["cells"]], r["cells"][-1]["x1"]) for r in rows] == [(1, ["12", "ab"], 5.0), (2, ["page", "two"], 8.0)]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    assert [[(c["text"], c["x0"]) for c in r["cells"]] for r in files.word_tables(spark, str(tmp_path / "d.docx")).collect()] == [[("a b", 0.0), ("c", 2.0)]]
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>text</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.0</v></c><c r="D1" t="b"><v>1</v></c></row></sheetData></worksheet>')
    assert [[(c["text"], c["x0"]) for c in x["cells"]] for x in files.workbook(spark, str(tmp_path / "x.xlsx")).collect()] == [[("text", 0.0), ("3", 2.0), ("TRUE", 3.0)]]
    got = {os.path.basename(x["file"]): (x["text"], x["error"] is None) for x in files.documents(spark, str(tmp_path)).collect()}
    assert got["d.docx"][0].startswith("Head") and got["x.xlsx"] == ("# One\ntext\t\t3\tTRUE", True)
    assert [(x["line_no"], x["raw"]) for x in files.lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()][0] == (1, "12 ab")


def test_find_records_gives_similar_titles_of_all_values(spark):
    titles = [f"Company {i} Ltd" for i in range(300)] + ["Été  SA Paris", "ab", "", None]
    actors = spark.createDataFrame([(i, f"r{i}", t, i) for i, t in enumerate(titles)], "id long, ref string, title string, listing long")
    values = [f"company {i}" for i in range(300)] + ["été sa", "a", "ab", "AB", "", "nothing like it", "ltd", "company 7 ltd", None]
    probed = spark.createDataFrame([(1, "f1", "key")], "rank int, field_id string, name string")
    stored = spark.createDataFrame([(5, "f1", "company 5")], "actor_id long, field_id string, value string")
    rows = lookup.find_records(spark.createDataFrame([(v,) for v in values], "value string"), probed, stored, actors).collect()
    fold = lambda t: " ".join(t.split()).lower()
    like = lambda v: [i for i, t in enumerate(titles) if t is not None and fold(v) in fold(t) and fold(v) != fold(t)][:10]
    got = {r["value"]: r for r in rows}
    assert len(rows) == len(values) and got["company 5"]["matched_by"] == "key" and got["company 5"]["similar"] is None
    assert {v: [x["id"] for x in r["similar"] or []] for v, r in got.items() if v is not None and v != "company 5"} == {v: like(v) for v in values if v is not None and v != "company 5"}
    assert got["company 7 ltd"]["matched_by"] == "title" and got["ltd"]["verdict"] == "not found"
