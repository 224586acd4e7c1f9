"""Golden vectors of the scalar functions."""

from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A, coercion, names as N
from ledgerloom.operators import pages as P


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_reference(spark):
    raw = '{"transaction_date":"2026-09-21","transaction_time":"08:20:02","debit_sum":"236.10","credit_sum":"0.00","currency":"UAH","description":"MAGAZiN 5499"}'
    assert one(spark, N.ref_of("stmt", F.lit(raw), "debit"))[0] == "stmt-3270a3bf150b2109d0ce58313852b0ef-debit"
    assert N.pair_name("  Bank Statement  ", 42) == "Bank Statement 42" and N.pair_name(" a ", 0) == "a"
    assert one(spark, N.statement_ref("stmt", F.lit("actor-1"), "Bank Statement", F.lit("/tmp/run/statement.jsonl")))[0] == "stmt|actor-1|Bank Statement|statement.jsonl"


def test_moments(spark):
    ms = one(spark, *(A.occurred_ms(F.lit(d), F.lit(t), z) for d, t, z in (("2026-09-21", "08:20:02", "Europe/Kyiv"), ("2026-9-21", "", "UTC"), ("2026-09-21", "8:20", "UTC"), ("", "", "UTC"), ("21.09.2026", "", "UTC"), ("2026-09-21", "noon", "UTC"))))
    at = lambda *x: int(datetime(*x, tzinfo=timezone.utc).timestamp() * 1000)
    assert list(ms) == [at(2026, 9, 21, 5, 20, 2), at(2026, 9, 21), at(2026, 9, 21, 8, 20), None, None, None]


@pytest.mark.parametrize("token,us,eu", [("1,163.14", "1163.14", None), ("1.238,92", None, "1238.92"), ("618,80", None, "618.80"), ("(236.10)", "-236.10", None), ("€ 12.30-", "-12.30", None), ("5", "5.00", "5.00"), ("004 0264", "40264.00", "40264.00"), ("abc", None, None)])
def test_grammars(spark, token, us, eu):
    got = one(spark, A.amount_or_null(F.lit(token), "us"), A.amount_or_null(F.lit(token), "eu"))
    assert [x and str(x) for x in got] == [us, eu]


def test_money_shapes_dates_and_ledger_amounts(spark):
    shaped = one(spark, *(A.is_money_shaped(F.lit(t)) for t in ("1,163.14", "8028", "(12.50)", "004 0264", "12.345")))
    assert list(shaped) == [True, False, True, False, False]
    dates = one(spark, A.iso_date(F.lit("01/04/2026")), A.iso_date(F.lit("4.1.26"), "mdy"), A.iso_date(F.lit("2026-2-31"), "ymd"), A.iso_date(F.lit("32/01/2026")), A.iso_date(F.lit("x")))
    assert list(dates) == ["2026-04-01", "2026-04-01", "2026-02-31", None, None]
    got = one(spark, *(A.ledger_amount(F.lit(s)) for s in ("", "236.10", "-5", "abc", "nan", "1_000", "1e2")))
    assert list(got) == [Decimal("0.00"), Decimal("236.10"), None, None, None, None, Decimal("100.00")]
    assert list(one(spark, A.sided(F.lit(Decimal("-2.345"))), A.currency_of(F.lit("€.")), A.currency_of(F.lit("usd")), A.currency_of(F.lit("euro")))) == ["2.35", "EUR", "USD", None]


def test_names(spark):
    assert list(one(spark, *(N.slug(F.lit(s)) for s in ("  Unit_Cost__Net ", "Río (Norte), 7th", "-_-", "x..Y", "Été 24")))) == ["unit_cost_net", "río_norte_7th", "", "x_y", "été_24"]
    assert list(one(spark, N.candidates(F.lit(" ua 12 3 ")), N.candidates(F.lit("Івано 1")))) == [["ua 12 3", "UA123"], ["Івано 1"]]
    assert list(one(spark, N.without_discriminators(F.lit("A@aaaa > Support@ab > B@0123abcd")), N.path_title(F.lit("A > B@aaaa")), N.renamed_path(F.lit("A > B"), F.lit("C")), N.without_type(F.lit("A > B [x]")))) == ["A > Support@ab > B", "B", "A > C", "A > B"]
    assert one(spark, N.suffixes(F.lit("A > B > C")))[0] == ["A > B > C", "B > C", "C"]
    assert list(one(spark, N.cut_at_line(F.lit("aaaa\nbbbb\ncccc"), 11), N.cut_at_line(F.lit("a\nbbbbbbbbbbbb"), 8), N.cut_at_line(F.lit("ab"), 8))) == ["aaaa\nbbbb", "a\nbbbbbb", "ab"]
    m = F.create_map(F.lit("__form__408962:view"), F.lit("v"), F.lit("blank"), F.lit("  "), F.lit("zero"), F.lit("0"))
    assert one(spark, N.clean_values(m))[0] == {"view": "v", "zero": "0"}
    assert list(one(spark, N.is_uuid(F.lit("11111111-1111-4111-8111-111111111111")), N.is_uuid(F.lit("1111")), N.resolved_form_id(F.array(F.lit("a"), F.lit("__form__7:b")), F.lit(1)))) == [True, False, 7]


@pytest.mark.parametrize("value,text", [(None, ""), (True, "true"), ("  a   b  ", "a b"), (3, "3"), (3.5, "3.5"), (3.0, "3"), ({"title": "T"}, "T"), (["a", "b", "c"], "a, b, c")])
def test_rendering(value, text):
    assert coercion.render_value(value) == text


@pytest.mark.parametrize("kind,raw,value", [
    ("int", 5, 5), ("int", 5.0, 5), ("int", " 42 ", 42), ("int", 5.5, None), ("int", "abc", None), ("int", True, None), ("number", "1.5", 1.5), ("number", True, None),
    ("bool", "T", True), ("bool", 1, None), ("date", "2024-03-01T10:15:00Z", "2024-03-01"), ("date", "1 March", None), ("enum[CFO, CEO]", "CEO", "CEO"), ("enum[CFO, CEO]", "CTO", None), ("string", [1], None), ("string", "x", "x"), ("string", "", None),
])
def test_coercion(kind, raw, value):
    assert coercion.coerce(kind, raw)[0] == value and (coercion.coerce(kind, raw)[1] is None) == (value is not None)


def test_addresses_and_pictures():
    assert all(map(P.is_blocked, ("127.0.0.1", "10.0.0.1", "100.64.0.1", "169.254.1.1", "64:ff9b::1", "2002::1", "::1", "localhost", "::ffff:10.0.0.1")))
    assert not any(map(P.is_blocked, ("8.8.8.8", "2606:4700::1111", "example.com")))
    assert P.url_problem("https://example.com/a") is None and P.url_problem("ftp://x") and P.url_problem("http://x/#a") and P.url_problem("http://[::1]/")
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"x" * 20
    assert [P.picture_facts(png(*s))[3] for s in ((10, 10), (2000, 40), (200, 60))] == ["too small", "too thin", None]
    assert P.picture_facts(b"hello")[3] == "not an image"
    assert P.images('<img src="a>b.png" alt="x &amp; y"><images src=q><IMG data-src=c title=\'T\'/><img src="a>b.png" alt="">') == [("a>b.png", "x & y"), ("c", "T")]


def test_page_parts():
    p = P.parse('<title>T &amp; t</title><meta name=description content=" D "><base href="http://b/"><script type="application/ld+json">{"a":1}</script><script>no</script><noscript>yes</noscript><p>a<br>b</p><a href="/x"> l  k </a><img alt="logo"><a href="#y">z</a>')
    assert (p["title"], p["description"], p["jsonld"], p["base"]) == ("T & t", "D", ['{"a":1}'], "http://b/")
    assert p["text"] == "yes\na\nb\nl k logoz" and P.addresses(p["links"], "http://b/") == [("l k", "http://b/x")]


def test_titles_equal_their_sql(spark, tmp_path):
    """A reference that is cut, or is none of the five, stays as it stands; no page has no title."""
    import duckdb

    from ledgerloom.plans import graph_queries as G

    titles = ["Ly.&amp;&amp;&amp; and&amp", "a&lt", "a&lt;b&gt;", "&quot;&#39;", "a&#39", "&amp;lt;", "&amp;amp;amp", "&copy;&nbsp;x", "&#65;&#x41", "a & b &", "&am", "", "\n é\n"]
    pages = [f"<html><head><TITLE lang=a>{t}</title><p>x&amp</p>" for t in titles] + [None, "", "<p>no title &amp</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {r["page_id"]: r["title"] for r in G.page_title(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(G.ORACLES["page_title"]).fetchall()) and got[0] == "Ly.&&& and&amp" and got[len(titles)] is None
    assert P.parse(pages[0])["title"] == "Ly.&&& and&" and P.parse(pages[7])["title"] == "©\xa0x"  # the reader itself decodes them all
