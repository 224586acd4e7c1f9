"""Classifiers, extraction, decontamination, WARC and the pipeline on small tables."""

import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontaminate, html_extract, quality_classifier, textkernel as tk, toxicity, warc


def _table(spark, n=240):
    r = random.Random(3)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(80)]
        junk, bad = i % 5 == 0, i % 3 == 0
        if junk:
            w = [x + "%%%" for x in w]
        if bad:
            for _ in range(4):
                w[r.randrange(80)] = r.choice(["idiotic", "moronic"])
        docs.append((i, " ".join(w), "en", f"s{i % 4}", 0.0))
        labels.append((i, int(not junk), int(bad)))
    docs += [(None, None, None, None, None), (9001, "", "en", "s", 1.0), (9002, "word " * 3000, "en", "s", 1.0)]
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,modulus,held", [(quality_classifier, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_classifier(spark, module, label, modulus, held):
    docs, labels = _table(spark)
    model = module.train(docs, labels)
    out = module.score(docs, model)
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    from ledgerloom.llm.labelled import fold_of

    tested = out.join(labels.where(f"{label} IS NOT NULL"), "doc_id").where(fold_of("doc_id", modulus) == held)
    right = tested.where((F.col("score") >= module.THRESHOLD) == (F.col(label) == 1)).count()
    assert right >= 0.9 * tested.count() > 0
    assert module.train(docs, labels) == model  # the same sample, the same model
    nothing = docs.where("false")
    assert module.score(nothing, model).count() == 0
    assert module.score(docs, module.train(docs, labels.where("false"))).select("score").distinct().count() == 1


ARTICLE = "<h1>A title</h1><p>The first paragraph has words &amp; more words, quite  a\n few of them.</p><p>Of.</p><p>The last paragraph of the article ends the text with a stop.</p>"
TEXT = "A title\nThe first paragraph has words & more words, quite a few of them.\nOf.\nThe last paragraph of the article ends the text with a stop."


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy this now and be happy with all that you have bought.</div><article>{ARTICLE}</article><footer>&copy; us</footer></body></html>",
    f"<body><div id=menu><a href=a>Home</a> <a href=b>News</a></div><div id=content>{ARTICLE}</div><div class='cookie-notice'>We use cookies to make this site a better place for you.</div><section id=comments><p>Nice article, I liked it very much, thank you for it.</p></section>",
    f"<main>{ARTICLE}<form><p>Your name and your address, please write them here.</p></form></main><aside>See also other pages of this great site.</aside>",
    f"<body><!-- a > b --><noscript>Enable it</noscript><header><h2>Site</h2></header><article>{ARTICLE[:-4]}",
])
def test_extraction(page):
    assert html_extract.extract(page) == TEXT


def test_extraction_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "<p>Only this short line.</p>", "c"), (4, "<nav>x</nav>", "d")], "page_id long, html string, text string")
    assert {r[0]: r[1] for r in html_extract.texts(df).select("page_id", "text").collect()} == {1: "", 2: "", 3: "Only this short line.", 4: ""}
    assert html_extract.texts(df.where("false")).count() == 0


LONG = "<p>This first paragraph is long enough to be the beginning of the text of the page.</p>"


@pytest.mark.parametrize("page,text", [
    (f"<body><div class='layout has-sidebar'><article>{ARTICLE}</article></div></body>", TEXT),
    (f"<body><form action=/><nav><a href=/>Home</a></nav><article>{ARTICLE}</article></form></body>", TEXT),
    (f"<main><div class='no-comments'><article>{ARTICLE}</article></div><div class=comments><article>A comment.</article></div></main>", TEXT),
    (f"<aside class=sidebar><article>{ARTICLE}</article></aside>", TEXT),
    (f"<div hidden><article>Not shown.</article></div><article>{ARTICLE}</article>", TEXT),
    ("<article><p>One.</p><p><a href=a>A linked paragraph</a></p><ul><li><a href=b>An item</a></li></ul><p>Two.</p></article>", "One.\nA linked paragraph\nAn item\nTwo."),
    (f"{LONG}<div class=ad>Buy <p>this</p> now.</div><p>The end.</p>", LONG[3:-4] + "\nThe end."),
    (f"<body><div class='layout has-sidebar'>{ARTICLE}</div><div class=sidebar>Other pages.</div></body>", TEXT),
    (f"<body><div class='comments-open'>{ARTICLE}<div class=comments>One comment.</div></div></body>", TEXT),
    (f"<article><div class='post-comments-enabled'>{ARTICLE}</div></article>", TEXT),
    (f"<body class=x><div id=sidebar-layout>{ARTICLE}</div><footer>The end of a page with a footer.</footer></body>", TEXT),
    (f"<form><nav><a href=/>Home</a></nav>{ARTICLE}</form>", TEXT),
    (f"{ARTICLE}<div class='post-comments'>{'A long comment of a reader on it. ' * 12}</div>", TEXT),
    (f"<div title=Bob's class='a>b'>{ARTICLE.replace('<p>', '<p title=Bob&#39;s data-x=it' + chr(39) + 's>')}</div>", TEXT),
    (f"<html><head><script>var t = '<p>not text</p>'; if (a<b) u = \"it's\";</script><meta name=a><title>T</title></head><body>{ARTICLE}</body>", TEXT),
    (f"<head><style>p > a {{}}</style>{ARTICLE}", TEXT),
    (f"<article><svg><svg></svg><text>x</text></svg>{ARTICLE}<template><p>t</p></template><iframe><p>f</p></iframe></article>", TEXT),
    (f"{LONG}<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><p>Far off.</p>", LONG[3:-4]),
])
def test_extraction_loses_no_article_text(page, text):
    assert html_extract.extract(page) == text


def _smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_full_matrix():
    r = np.random.default_rng(3)
    items = [r.integers(0, 4, r.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    windows = [r.integers(0, 4, r.integers(1, 20)).astype(np.uint64) for _ in range(40)]
    assert decontaminate.align(items, windows).tolist() == [_smith_waterman(a, b) for a, b in zip(items, windows)]


def test_decontamination(spark):
    r = random.Random(8)
    w = lambda n: [f"v{r.randrange(500)}" for _ in range(n)]
    items = [(k, " ".join(w(30))) for k in range(12)] + [(50, None), (51, ""), (52, "two words"), (53, " ".join(w(30)))]
    items.append((54, items[0][1]))
    edited = items[3][1].split()
    edited[7], edited[19] = "changed", "again"
    docs = [(1, " ".join(w(300)) + " " + items[0][1].upper() + ". " + " ".join(w(50))), (2, " ".join(edited)), (3, " ".join(w(400))), (4, None), (5, ""), (6, "So these two words are here."), (7, " ".join(items[5][1].split()[:12]) + " " + " ".join(w(60))), (1, items[1][1])]
    d = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 600):
        got = {(x[0], x[1]) for x in decontaminate.held(d, b, block_bytes=block).select("doc_id", "item_id").collect()}
        assert got == {(1, 0), (1, 54), (1, 1), (2, 3), (6, 52)}
        kept = sorted(x[0] for x in decontaminate.without(d, b, block_bytes=block).collect())
        assert kept == [3, 4, 5, 7]
    assert decontaminate.held(d, b.where("false")).count() == 0 and decontaminate.held(d.where("false"), b).count() == 0


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 1500])
def test_decontamination_of_many_items_on_one_passage(spark, block):
    passage = [f"p{i}" for i in range(60)]
    own = lambda k: [f"own{k}x{i}" for i in range(6)]
    items = [(k, " ".join(passage[:30] + own(k) + passage[30:])) for k in range(20)]
    docs = [(1, " ".join(passage)), (2, " ".join(passage[:30] + ["edited"] * 6 + passage[30:])), (3, " ".join(passage[:8] + ["other"] * 90))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x[0], x[1]) for x in decontaminate.held(d, b, block_bytes=block).select("doc_id", "item_id").collect()}
    assert got == {(i, k) for i in (1, 2) for k in range(20)}
    assert [x[0] for x in decontaminate.without(d, b, block_bytes=block).collect()] == [3]


def test_decontamination_of_copies_with_insertions():
    w = [f"p{i}" for i in range(60)]
    put = lambda n, gap: " ".join(x for i in range(0, 60, n) for x in [*w[i : i + n], *(f"x{i}y{j}" for j in range(gap))])
    docs = pa.array([put(15, 20), put(15, 30), put(5, 4), "a b " * 50 + put(20, 15)], pa.large_string())
    idx = decontaminate.index([(7, " ".join(w))])
    found = {d: round(s, 3) for _, _, data, offs in tk.slices(docs) for d, _, s, *_ in decontaminate.held_items(tk.Words(data, offs), idx, decontaminate._tables(idx), 0.45)}
    assert found == {0: 0.5, 2: 0.633, 3: 0.75}


def test_folding_of_capitals():
    text = "ÀÖØÞ×÷ΑΟΠΩ ЁЯПр 一丠 Straße É"
    made = bytes(decontaminate.folded(np.frombuffer(text.encode(), np.uint8))).decode()
    assert made == "àöøþ×÷αοπω ёяпр 一丠 Straße é" and not len(decontaminate.folded(np.zeros(0, np.uint8)))
    words = lambda t: tk.Words(decontaminate.folded(np.frombuffer(t.encode(), np.uint8)), np.array([0, len(t.encode())])).hashes(decontaminate._ALNUM)
    assert words("ПРИВЕТ, Één")[0] == words("привет één")[0] and words("一")[0] != words("丠")[0]


def test_decontamination_in_small_groups_of_hits(monkeypatch):
    r = random.Random(5)
    items = [(k, " ".join(f"v{r.randrange(6)}" for _ in range(12))) for k in range(9)]
    docs = pa.array([" ".join(f"v{r.randrange(6)}" for _ in range(n)) for n in (300, 5, 80, 40)], pa.large_string())
    idx = decontaminate.index(items)

    def found():
        return sorted(x for _, _, data, offs in tk.slices(docs) for x in decontaminate.held_items(tk.Words(data, offs), idx, decontaminate._tables(idx), 0.45))

    whole = found()
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", 7)
    assert found() == whole and len(whole) > 5


def test_warc_round_trip(spark, tmp_path):
    records = [
        {"record_id": "<urn:1>", "type": "response", "url": "http://www.A.org/x/?b=2&a=1#f", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"ETag": '"e"', "Content-Type": "text/html", "Age": "1"}, "payload": b"<p>\r\n\r\nbody</p>", "refers_to": None, "profile": None},
        {"record_id": "<urn:2>", "type": "revisit", "url": "https://a.org:443/x?a=1&b=2&utm_source=z", "date": "2024-01-02T00:00:00Z", "status": 304, "headers": {"ETag": 'W/"e"', "Content-Length": "0", "Age": "9"}, "payload": b"", "refers_to": None, "profile": "p"},
        {"record_id": "<urn:3>", "type": "revisit", "url": "http://a.org/x?a=1", "date": "2024-01-02T00:00:00Z", "status": 304, "headers": {}, "payload": b"", "refers_to": None, "profile": None},
    ]
    data = b"".join(map(warc.render, records))
    assert [{k: v for k, v in r.items()} | {"payload": r["payload"]} for r in warc.parse(data)][0]["payload"] == records[0]["payload"]
    (tmp_path / "a.warc").write_bytes(data + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    rows = warc.read(spark, str(tmp_path / "a.warc"))
    assert rows.count() == 3
    got = {r["id"]: r for r in warc.resolve(warc.captures(rows)).collect()}
    assert got["<urn:2>"]["verdict"] == "resolved" and got["<urn:2>"]["response_id"] == "<urn:1>"
    assert got["<urn:2>"]["headers"] == {"etag": 'W/"e"', "age": "9", "content-type": "text/html"}
    assert got["<urn:3>"]["verdict"] == "no_earlier_response"


def test_damaged_records(spark, tmp_path):
    good = {"record_id": "<urn:1>", "type": "response", "url": "http://a.org/", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"ETag": "e"}, "payload": b"body", "refers_to": None, "profile": None}
    one, two = warc.render(good), warc.render(good | {"record_id": "<urn:2>"})
    ids = lambda data: [r["record_id"] for r in warc.parse(data)]
    assert ids(gzip.compress(one) + gzip.compress(two)) == ["<urn:1>", "<urn:2>"] == ids(gzip.compress(one + two))
    assert ids(gzip.compress(one) + gzip.compress(two)[:-20]) == ["<urn:1>"] and ids(gzip.compress(one)[:15]) == [] == ids(b"")
    bad = b"WARC/1.1\r\nWARC-Record-ID: <urn:9>\r\nContent-Length: many\r\n\r\n"
    assert ids(bad + one) == ["<urn:1>"] and ids(bad.replace(b"many", b"-1") + two) == ["<urn:2>"]
    assert warc._fields(b"HTTP/1.1 200 OK\r\nVia: a\r\nvia: b")[1] == {"via": "a, b"}
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two)[:-40])
    assert warc.read(spark, str(tmp_path / "a.warc.gz")).count() == 1


def test_headers_that_differ_in_case(spark):
    rows = [(1, "http://a.org", 5, "response", "e", None, None, {"ETag": "x", "etag": "y", "Age": "1"}), (2, "http://a.org", 9, "revisit", "e", None, None, {"AGE": "2", "age": "3"}), (3, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    assert warc.resolve(df).first()["headers"] == {"etag": "y", "age": "3"}
    nothing = df.select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
    assert warc.resolve(nothing).count() == 0 == warc.resolve(df.where("false")).count()


@pytest.mark.parametrize("blocks", [1, 7, 300])
def test_revisits_equal_brute_force(spark, blocks):
    r = random.Random(6)
    rows = []
    for i in range(400):
        kind = r.choice(["response", "revisit"])
        url = r.choice(["http://hot.org/", "http://hot.org/", f"http://a.org/{r.randrange(5)}", None, ""])
        rows.append((i, url, r.choice([None, *range(0, 9000, 7)]), kind, r.choice([None, "a", "W/a", "b"]), r.choice([None, "x", "y"]), None, r.choice([None, {"A": "1"}]), "extra"))
    df = spark.createDataFrame(rows, "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, key string")
    got = {x["id"]: (x["verdict"], x["response_id"]) for x in warc.resolve(df, blocks).collect()}
    bare = lambda e: e.removeprefix("W/") if e else e
    for i, url, ts, kind, etag, lm, *_ in rows:
        if kind == "revisit":
            seen = [x for x in rows if x[3] == "response" and x[1] == url and x[2] is not None and ts is not None and x[2] < ts]
            if not url:
                expected = ("no_url", None)
            elif not seen:
                expected = ("no_earlier_response", None)
            else:
                x = max(seen, key=lambda s: (s[2], s[0]))
                pairs = [(bare(etag), bare(x[4])), (lm, x[5])]
                both = [a == b for a, b in pairs if a is not None and b is not None]
                expected = ("validator_mismatch", None) if not all(both) else ("resolved", x[0]) if both else ("no_validator", None)
            assert got.pop(i) == expected
    assert not got


def test_pipeline(spark, tmp_path):
    docs, labels = _table(spark)
    item = " ".join(f"bench{i}" for i in range(30))
    more = [(5000, docs.where("doc_id = 1").first()[1] + " tail"), (5001, " ".join(f"word{chr(97 + i % 26)}a" for i in range(70)) + " " + item), (5002, " ".join(f"word{chr(97 + i % 26)}b" for i in range(70)) + " password=livekey99")]
    extra = spark.createDataFrame([(i, t, "en", "s9") for i, t in more], "doc_id long, text string, lang string, source string")
    all_ = docs.select("doc_id", "text", "lang", "source").unionByName(extra).withColumn("n_chars", F.length("text").cast("long"))
    d = str(tmp_path)
    all_.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{d}/documents.parquet")
    kept = stages["quality_classifier"](spark, table, d)
    assert kept.columns == table.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert all(i % 5 for i in ids if i is not None and i < 240) and {1, 5000, 5001, 5002} <= ids
    one = {r[0] for r in stages["jaccard_join"](spark, kept, d).select("doc_id").collect()}
    assert ids - one == {5000}
    rest = stages["decontaminate"](spark, kept, d)
    assert ids - {r[0] for r in rest.select("doc_id").collect()} == {5001} and rest.columns == table.columns
    clean = stages["secret_scan"](spark, kept, d)
    row = clean.where("doc_id = 5002").first()
    assert row["text"].endswith(" [SECRET]") and row["n_chars"] == len(row["text"]) and clean.count() == kept.count()
    final = corpus_pipeline.run(spark, d)
    assert {r[0] for r in final.select("doc_id").collect()} == ids - {5000, 5001}
