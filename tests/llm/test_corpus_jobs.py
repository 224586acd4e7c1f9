"""Repeated phrases, compaction and clustering against brute force, with their edge cases."""

import collections
import datetime as dt
import glob
import hashlib
import math
import os
import random
import zlib
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bin_compaction as bc, kd_clusters as kd, phrase_automata as pa_

DATA = "/root/testdata/sf0.001"


# --- op11


def phrases_by_hand(texts, window):
    words = [(t or "").encode().split() for t in texts]
    starts = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram", "contexts"), [(6, 3, 4096), (6, 3, 2), (5, 5, 4096), (4, 1, 1)])
def test_phrases(spark, window, gram, contexts):
    rng = random.Random(window * contexts)
    word = lambda: rng.choice("a b c dd é".split())
    common = " ".join(rng.choices("xyz", k=window + 3))
    texts = [None, "", " \t", "a b", "a " * 200, common, common + " tail", "head\n" + common]
    texts += [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(40)]
    texts += [" ".join(f"w{rng.randint(0, 400)}" for _ in range(60)) for _ in range(10)] * 2
    texts += [f"{i} {i + 1} {common} {i + 2} {i + 3}" for i in range(30)]
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(3, "a b", "x"), (3, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `ex.tra` string").repartition(3)
    got = pa_.dedup(df, window=window, gram=gram, contexts=contexts, with_text=True).collect()
    want = phrases_by_hand([r[1] for r in rows], window)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_phrases_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pa_.dedup(df).collect() == []
    assert [tuple(r)[:3] for r in pa_.dedup(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0)]


def test_automaton_covers_overlapping_passages():
    assert pa_.occurrences([(1, 2, 3, 4, 5, 9, 1, 2, 3)], [(1, 2, 3), (3, 4, 5)]) == [[(0, 5), (6, 9)]]
    assert pa_.occurrences([(1, 2)], []) == [[]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_phrases_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in pa_.query(spark, DATA).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, phrases_by_hand([d.text for d in docs], pa_.WINDOW))}
    assert any(n for _, n, _ in got.values())


# --- op12


def compacted_by_hand(rows):
    """Rows (click_id, arrived_at, value) in sorted order to the expected report."""
    total = len(rows)
    size = lambda x: 1 + total // x
    days = collections.defaultdict(list)
    for r in rows:
        days[None if r[1] is None else (r[1] - dt.datetime(1970, 1, 1)).days].append(r)
    want = {}
    for day, mine in days.items():
        files = collections.defaultdict(list)
        for r in mine:
            h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            files[(h // 16) % (1 + len(mine) // size(150)), min(h % 4, h // 4 % 4)].append(r)
        groups = []
        for k in sorted((k for k in files if len(files[k]) < size(600)), key=lambda k: (-len(files[k]), k)):
            fit = next((g for g in groups if sum(len(files[j]) for j in g) + len(files[k]) <= size(500)), None)
            fit.append(k) if fit is not None else groups.append([k])
        groups += [[k] for k in files if len(files[k]) >= size(600)]
        first = lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0] is not None, r[0] or 0)
        for g in groups:
            held = [r for k in g for r in sorted(files[k], key=first)]
            ids = [r[0] for r in held if r[0] is not None]
            cents = sum(math.floor(100 * r[2] + 0.5) for r in held if r[2] is not None and math.isfinite(r[2]))
            digest = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in held).encode()).hexdigest()
            want[day, *g[0]] = (len(held), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for a, b in g), digest, len(g) > 1)
    return want


def check_compaction(spark, df, rows, value="value"):
    job = bc.Compaction(df, "arrived_at", "click_id")
    job.write_lots()
    before = {p: open(p, "rb").read() for p in glob.glob(f"{job.folder.removeprefix('file:')}/*/*/*/*.parquet")}
    job.packing()
    job.rewrite()
    job.swap()
    job.swap()  # a second time finds nothing to do
    got = job.report(value).collect()
    want = compacted_by_hand(rows)
    assert {(r.day, r.lot, r.piece): (r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in got} == want
    assert {r.columns for r in got} <= {",".join(df.columns)}
    left = {p for p in glob.glob(f"{job.folder.removeprefix('file:')}/**/*.parquet", recursive=True)}
    assert left == {unquote(r.path).removeprefix("file:").replace("///", "/") for r in got}
    for r in got:
        path = unquote(r.path).removeprefix("file:").replace("///", "/")
        assert r.rewritten or open(path, "rb").read() == before[path]
    assert spark.read.option("recursiveFileLookup", "true").schema(df.schema).parquet(job.folder).count() == len(rows)
    return got


def test_compaction(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 3000), start + dt.timedelta(days=min(9, int(rng.expovariate(0.4))), seconds=rng.randint(0, 86399)), rng.choice([None, 1.005, -2.5, 3.0]), "k") for _ in range(1500)]
    rows += [(None, start, 1.0, "k"), (None, None, 2.0, "k"), (7, None, float("nan"), "k"), (8, dt.datetime(1969, 12, 31, 23), float("inf"), None), *rows[:5]]
    df = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, day string").withColumn("x.y", F.lit("z")).repartition(3)
    got = check_compaction(spark, df, rows)
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)


def test_compaction_of_nothing(spark):
    df = spark.createDataFrame([], "click_id long, arrived_at timestamp_ntz, value double")
    assert check_compaction(spark, df, []) == []


def test_first_fit_by_segment_tree():
    rng = random.Random(1)
    for _ in range(50):
        sizes, full = [rng.randint(1, 10) for _ in range(rng.randint(1, 40))], 10
        rooms, groups = bc.Rooms(len(sizes), full), []
        for n in sizes:
            k = next((i for i, g in enumerate(groups) if g + n <= full), len(groups))
            groups[k:] = [n] if k == len(groups) else [groups[k] + n, *groups[k + 1 :]]
            assert rooms.take(n) == k


# --- op13


def clusters_by_hand(vectors, number, rounds, width):
    kept = [(i, np.array([math.floor(1024 * float(x)) for x in v], object)) for i, v in vectors if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), list(r[1])))
    cents = [list(v) for _, v in drawn[:number]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), k in zip(kept, of) if k == j]
            if mine:
                cents[j] = [int(s) // len(mine) for s in sum(mine)]
    return [(i, *reversed(near(v))) for i, v in kept], cents


@pytest.mark.parametrize(("n", "number"), [(400, 8), (3, 8), (1, 2)])
def test_clusters(spark, n, number):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(6, 4))
    vectors = [(i, [float(x) for x in np.float32(base[i % 6] + rng.normal(scale=0.2, size=4))]) for i in range(n)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(n // 2)] + [(5000, [1e-3, -1e-3, 0.0, -0.0])] * 2
    vectors += [(2000, None), (2001, [1.0]), (2002, [1.0, None, 1.0, 1.0]), (2003, [float("nan")] * 4), (2004, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, `a.b` string").repartition(3)
    table, cents = kd.clusters(df, components=4, number=number)
    want, centroids = clusters_by_hand(vectors, number, kd.ROUNDS, 4)
    assert cents.tolist() == centroids
    got = kd.report(table, cents).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), j, d) for i, j, d in want)
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    for r in got:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert kd.report(*kd.clusters(df)).collect() == []


def test_filtering_assigns_like_distances():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-50, 50, (500, 3)), np.full((200, 3), 7)])
    order, t = kd.tree(points, leaf=4)
    t = {k: v.astype(np.int64) for k, v in t.items()}
    centroids = rng.integers(-50, 50, (6, 3))
    cluster = np.zeros(len(points), np.int64)
    count, sums = kd.filtered(t, centroids, cluster)
    want = kd._distances(points[order], centroids).argmin(axis=1)
    assert (cluster == want).all() and (count == np.bincount(want, minlength=6)).all()
    assert (sums == np.array([points[order][want == j].sum(axis=0) for j in range(6)])).all()
