"""State, climbing, bins, running orders and near names against brute force."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bands, graph, ledger, lineage, pages, planning, running, statements as S
from ledgerloom.plans import mechanism_queries
from ledgerloom.streaming import ledger_stream, state, statement_stream

DATA = "/root/testdata/sf0.001"


# --- statements in pieces

ROWS = "file string, page long, row_no long, cells array<struct<text:string,x0:double,x1:double>>"
SPECS = [
    S.ColumnSpec(debit=S.col(1), credit=S.col(2), description=S.col(0), date=S.col(3), numbers="us", start_re="^begin", stop_re="^end", skip_rows=("skip",), currency=S.col(4), time_re=r"[0-9]{2}:[0-9]{2}:[0-9]{2}", actor=S.col(5)),
    S.ColumnSpec(debit=S.col(1), credit=S.col(2), description=S.col(0), date=S.col(3), numbers="us", start_re="^begin", start_per_page=True, date_carry=False, currency_default="eur", row_filter=lambda cells: ~F.exists(cells, lambda c: c["text"] == "drop")),
    S.ColumnSpec(debit=S.col(1), credit=S.col(2), description=S.col(0), date=S.col(3), numbers="us", row_start="date", allow_both_sides=True, desc_join=" / "),
]


def statement_rows(seed):
    rng = random.Random(seed)
    out = []
    for f in range(6):
        for n in range(rng.randint(1, 40)):
            words = rng.choice(["begin", "pay", "pay", "to shop", "  more  text ", "skip it", "drop", "end" if rng.random() < 0.2 else "x", "at 10:20:30 o'clock"])
            cells = [(words, 0.0)]
            cells += [(f"{rng.randint(1, 99)}.50", 1.0)] if rng.random() < 0.4 else []
            cells += [(f"-{rng.randint(1, 99)}.25", 2.0)] if rng.random() < 0.2 else []
            cells += [(f"{rng.randint(1, 28):02d}/03/2024", 3.0)] if rng.random() < 0.4 else []
            cells += [(rng.choice(["USD", "€"]), 4.0)] if rng.random() < 0.3 else []
            cells += [(f"Actor{n}", 5.0)] if rng.random() < 0.2 else []
            out.append((f"f{f}", n // 9, n, [(t, x, x) for t, x in cells]))
    return out


def streamed(spark, folder, rows, spec, cuts, idle_ms=None, wait=False):
    """Each cut is a batch: (file, row_no) of a later cut never precede those of an earlier one."""
    schema = f"{ROWS}, last boolean"
    ends = {r[0]: r[2] for r in rows}
    for n, part in enumerate(cuts):
        spark.createDataFrame([(*r, not wait and ends[r[0]] == r[2]) for r in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with state.rocks_state(spark):
        out = statement_stream.transactions_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), spec, idle_ms)
        w = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
        q = w.start() if wait else w.trigger(availableNow=True).start()
    return q, lambda: spark.read.schema(out.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("k", range(len(SPECS)))
def test_statement_stream_is_the_batch_fold_on_any_cut(spark, tmp_path, k):
    rng = random.Random(k)
    rows = statement_rows(k)
    want = S.transactions(spark.createDataFrame(rows, ROWS), SPECS[k]).orderBy("file", "line_no").collect()
    at = {f: sorted(rng.choices(range(41), k=2)) for f in {r[0] for r in rows}}
    cuts = [[r for r in rows if sum(r[2] >= c for c in at[r[0]]) == n] for n in range(3)]
    q, read = streamed(spark, str(tmp_path), rows, SPECS[k], [c for c in cuts if c])
    q.awaitTermination()
    assert want and read().orderBy("file", "line_no").collect() == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_the_query_reads_a_piece_a_batch(spark):
    folder = lineage.folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    mechanism_queries.statement_stream(spark, DATA)
    (run,) = [f for f in set(os.listdir(folder)) - before if f.startswith("ledgerloom-statement-stream")]
    assert sum(name.isdigit() for name in os.listdir(f"{folder}/{run}/checkpoint/commits")) == mechanism_queries.PIECES


def test_silent_statement_is_closed(spark, tmp_path):
    rows = [("f", 0, n, [("pay", 0.0, 0.0), ("5.50", 1.0, 1.0), ("01/03/2024", 3.0, 3.0)]) for n in range(2)]
    q, read = streamed(spark, str(tmp_path), rows, SPECS[2], [rows], idle_ms=1500, wait=True)
    try:
        for _ in range(60):
            time.sleep(1)
            if q.exception() is not None or (q.recentProgress and read().count() == 2):
                break
        assert [(r.line_no, r.debit_sum) for r in read().orderBy("line_no").collect()] == [(1, "5.50"), (2, "5.50")]
    finally:
        q.stop()


def test_a_stream_refuses_what_it_cannot_do(spark):
    rows = spark.createDataFrame([], ROWS)
    for spec in (S.ColumnSpec(debit=S.col(1)), S.ColumnSpec(debit=S.col(1), numbers="us", post=lambda df: df)):
        with pytest.raises(ValueError, match="a stream needs"):
            statement_stream.transactions_stream(rows, spec)


# --- posting in pieces

LINE = "file string, line_no long, raw string, of_lines long"


def _line(amount):
    return json.dumps({"transaction_date": "2026-04-01", "debit_sum": amount, "credit_sum": "0.00"})


def _post(spark, folder, checkpoint="check"):
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ledger_stream.post_stream(stream, ledger.PostOptions("Bank", actor_id="me"), f"{folder}/out", f"{folder}/{checkpoint}").awaitTermination()


def test_files_split_over_batches(spark, tmp_path):
    folder = str(tmp_path)
    batches = [
        [("good", 1, _line("1.00"), None), ("bad", 1, _line("2.00"), None), ("late", 1, _line("3.00"), None)],
        [("good", 1, _line("1.00"), None), ("bad", 2, _line("-2.00"), None), ("good", 3, " ", 3)],
        [("good", 2, _line("1.50"), None), ("bad", 3, _line("4.00"), 3), ("late", 2, _line("5.00"), 3)],
    ]
    posted = lambda: sorted(str(r.amount) for r in spark.read.parquet(f"{folder}/out").collect())
    for b in batches:
        spark.createDataFrame(b, LINE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _post(spark, folder)
    assert posted() == ["1.00", "1.50"]  # nothing of the bad file, nothing of the one that lacks a line
    spark.createDataFrame([("late", 3, _line("6.00"), None), *batches[0]], LINE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _post(spark, folder)
    assert posted() == ["1.00", "1.50", "3.00", "5.00", "6.00"]


def test_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    for k in range(2):
        spark.createDataFrame([(f"f{k}", n, _line(f"{k}{n}.00"), None) for n in range(1, 4)], LINE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    lines = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    new = ledger_stream.posted(lines.drop("of_lines"), ledger.PostOptions("Bank", actor_id="me"))

    def write_and_die(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        if number == 1:
            raise RuntimeError("lost after the write")

    with state.rocks_state(spark):
        q = new.writeStream.foreachBatch(write_and_die).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after the write"):
        q.awaitTermination()
    ledger_stream.post_stream(lines.drop("of_lines"), ledger.PostOptions("Bank", actor_id="me"), f"{folder}/out", f"{folder}/check").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 6


# --- climbing


def _frames(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "layer string, ord long, id string, title string, x long, y long")
    e = spark.createDataFrame(edges, "layer string, ord long, source string, target string")
    return n, e


def ways_by_hand(nodes, edges):
    """Visits each layer in sibling order: roots first, then whoever is still unseen."""
    out = {}
    for layer in {n[0] for n in nodes}:
        mine = sorted((n for n in nodes if n[0] == layer), key=lambda n: (n[5], n[4], n[1]))
        ids = {n[2] for n in mine}
        parent = {}
        for _, _, a, b in sorted((e for e in edges if e[0] == layer), key=lambda e: e[1]):
            if a != b and a in ids and b in ids:
                parent.setdefault(b, a)
        kids = {}
        for n in mine:
            kids.setdefault(parent.get(n[2]), []).append(n[2])

        def visit(root):
            todo = [(root, None, 0)]
            while todo:
                i, p, d = todo.pop()
                if (layer, i) not in out:
                    out[layer, i] = (p, d, root)
                    todo += [(c, i, d + 1) for c in kids.get(i, [])]

        for i in [*kids.get(None, []), *(n[2] for n in mine if n[2] in parent)]:
            if (layer, i) not in out and (i not in parent or not _reaches_root(i, parent)):
                visit(i)
    return out


def _reaches_root(i, parent):
    seen = set()
    while i in parent and i not in seen:
        seen.add(i)
        i = parent[i]
    return i not in parent


@pytest.mark.parametrize("seed", range(3))
def test_structure_and_forest_with_cycles(spark, seed):
    rng = random.Random(seed)
    nodes, edges = [], []
    for layer in ("a", "b"):
        ids = [f"{rng.randrange(16**8):08x}" for _ in range(60)]
        nodes += [(layer, k, i, rng.choice("XYZ"), rng.randint(0, 3), rng.randint(0, 3)) for k, i in enumerate(ids)]
        edges += [(layer, k, rng.choice(ids), i) for k, i in enumerate(ids) if rng.random() < 0.93]
        edges += [(layer, 100 + k, rng.choice(ids), rng.choice([*ids, "gone"])) for k in range(10)]
    n, e = _frames(spark, nodes, edges)
    want = ways_by_hand(nodes, edges)
    got = {(r.layer, r.id): (r.parent_id, r.depth, r.root_id) for r in graph.structure(n, e).collect()}
    assert got == want and any(d > 3 for _, d, _ in want.values())
    tree = graph.forest(n, e).collect()
    assert {(r.layer, r.id): (r.parent_id, r.depth) for r in tree} == {k: v[:2] for k, v in want.items()}
    path = {(r.layer, r.id): r.path for r in tree}
    assert len({(r.layer, r.path) for r in tree}) == len(tree)
    assert all(r.parent_id is None or r.path.startswith(path[r.layer, r.parent_id] + " > ") for r in tree)


def test_deep_chain_takes_few_rounds(spark):
    n = 5000
    nodes = spark.range(n).select(F.lit("l").alias("layer"), F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("id").alias("x"), F.lit(0).alias("y"))
    edges = spark.range(1, n).select(F.lit("l").alias("layer"), F.col("id").alias("ord"), (F.col("id") - 1).cast("string").alias("source"), F.col("id").cast("string").alias("target"))
    rounds = []
    got = graph.structure(nodes, edges, cut=lambda df: rounds.append(1) or lineage.cut(df))
    assert got.where("depth <> cast(id as int) or root_id <> '0'").count() == 0 and got.count() == n
    assert len(rounds) <= 15


# --- bins and orders


def test_bands(spark):
    rng = random.Random(3)
    b = [(f"f{rng.randint(0, 3)}", k, lo := rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5))]), lo + rng.choice([0.0, 0.001, 1.0, 7.5, 300.0, -1.0, 1e9])) for k in range(200)] + [("f0", 900, 0.0, 1e15)]
    t = [(f"f{rng.randint(0, 4)}", k, rng.choice([rng.uniform(-60, 400), float(rng.randint(-5, 5))])) for k in range(400)] + [("f1", 401, None), ("f1", 402, float("nan"))]
    bd, tk = spark.createDataFrame(b, "file string, band long, lo double, hi double"), spark.createDataFrame(t, "file string, n long, x double")
    got = bands.in_bands(tk, bd)
    assert sorted((r.n, r.band) for r in got.collect()) == sorted((n, k) for f, n, x in t for g, k, lo, hi in b if f == g and x is not None and lo <= x <= hi)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert bands.in_bands(tk, bd.where("false")).count() == 0


def test_band_totals_are_those_of_the_pairs_without_making_them(spark):
    rng = random.Random(5)
    b = [(f"f{rng.randint(0, 3)}", k % 150, lo := rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5)), -0.0]), lo + rng.choice([0.0, 0.001, 1.0, 7.5, 300.0, -1.0])) for k in range(200)] + [("f9", 900, 0.0, 1.0)]
    t = [(f"f{rng.randint(0, 4)}", rng.choice([rng.uniform(-60, 400), float(rng.randint(-5, 5))]), rng.choice([None, 1, 5])) for _ in range(400)] + [("f1", None, 1), ("f1", float("nan"), 1)]
    bd, tk = spark.createDataFrame(b, "file string, band long, lo double, hi double"), spark.createDataFrame(t, "file string, x double, v long").repartition(5)
    got = bands.band_totals(tk, bd, F.col("v").cast("decimal(18,2)"), ["file", "band"]).collect()
    want = {}
    for f, x, v in t:
        for g, k, lo, hi in b:
            if f == g and x is not None and lo <= x <= hi:
                n, total = want.get((f, k), (0, 0))
                want[f, k] = (n + 1, total + (v or 0))
    assert want and {(r.file, r.band): (r.n, r.total) for r in got} == want
    every = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").cast("double").alias("x"))
    wide = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").alias("band"), F.lit(0.0).alias("lo"), F.lit(2e4).alias("hi"))
    assert bands.band_totals(every, wide, F.lit(1), ["file", "band"]).where("n = 20000 AND total = 20000").count() == 20_000  # 400 million pairs
    assert bands.band_totals(every, wide.where("false"), F.lit(1), ["file", "band"]).count() == bands.band_totals(every.where("false"), wide, F.lit(1), ["file", "band"]).count() == 0


def test_running_values(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 400), rng.randint(-3, 5)) for _ in range(700)]
    df = spark.createDataFrame(rows, "n int, v int").repartition(5)
    got = running.running_sum(df, F.col("v"), [F.col("n")], "s").collect()
    assert sorted((r.n, r.v, r.s) for r in got) == sorted((n, v, sum(w for m, w in rows if m <= n)) for n, v in rows)
    once = spark.createDataFrame([(k * 3 % 701, f"t{k}") for k in range(701)], "n int, t string").repartition(5)
    before = running.value_before(once, "t", [F.col("n")], "b").collect()
    at = {r.n: r.t for r in before}
    assert all(r.b == at.get(r.n - 1) for r in before)
    assert running.running_sum(df.where("false"), F.col("v"), [F.col("n")], "s").count() == 0


def test_picture_verdicts(spark):
    rows = [(1, "a", "u", "d1", None), (2, "b", "u", "d1", None), (3, "b", "u", "d2", "too small"), (4, "b", "u", "d3", None), (5, "b", "u", "d3", None), (6, "c", "u", "d4", None)]
    got = pages.picture_verdicts(spark.createDataFrame(rows, "n long, node string, url string, digest string, problem string"), most=2).orderBy("n").collect()
    assert [r.verdict for r in got] == ["stored", "belongs to another node", "too small", "stored", "stored", "over the run's limit"]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_names(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names = [("t", w, k) for k, w in enumerate(dict.fromkeys(word(rng.randint(1, 14)) for _ in range(150)))] + [("u", "status", 1)]
    fields = sorted({word(rng.randint(0, 16)) for _ in range(200)}) + ["zzzzzzzzzz", ""]
    want = {}
    for f in fields:
        best = min(((_edits(f, n), k, n) for s, n, k in names if s == "t"), key=lambda x: x[:2])
        if best[0] <= min(3, max(1, len(f) // 3)):
            want[f] = best[2]
    got = planning.nearest_fields(spark.createDataFrame([("t", f) for f in fields], "slug string, field string"), spark.createDataFrame(names, "slug string, name string, ord int"))
    assert {r.field: r.suggestion for r in got.collect()} == want


def test_a_batch_of_the_ledger_stream_is_read_by_all_cores(spark, monkeypatch):
    """A piece is several files, so that its lines are not parsed by one task; the batches stay as many as the pieces."""
    seen = []
    post = mechanism_queries.post_stream
    monkeypatch.setattr(mechanism_queries, "post_stream", lambda lines, options, sink, checkpoint: (seen.append(sink), post(lines, options, sink, checkpoint))[1])
    mechanism_queries.ledger_stream(spark, "/root/testdata/sf0.01")
    files = spark.read.parquet(seen[0].replace("/posted", "/lines")).inputFiles()
    assert len(files) == mechanism_queries.PIECES * spark.sparkContext.defaultParallelism
    made = [d for d in os.listdir(seen[0].removeprefix("file:")) if d.startswith("batch=")]
    assert len(made) == mechanism_queries.PIECES
