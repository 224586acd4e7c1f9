"""Similar titles against a brute-force search, and nodes without a picture."""

from ledgerloom.functions import names as N
from ledgerloom.operators import lookup

from pyspark.sql import functions as F


def test_similar_titles_of_all_lengths(spark):
    titles = ["Alpha Beta", "alphabet soup", "Beta", "a", "", None, "gamma alpha beta gamma", "ALPHA  BETA", "xyz" * 40]
    asked = ["alpha", "beta", "a", "b", "et", "alpha beta", "alphabet soup", "xyzxyz", "none at all", "", None, "beta"]
    actors = spark.createDataFrame([(n, f"i{n}", "r", t) for n, t in enumerate(titles)], "listing int, id string, ref string, title string")
    values = spark.createDataFrame([(v,) for v in asked], "value string")
    fold = {t: f for t, f in spark.createDataFrame([(t,) for t in {*titles, *asked} - {None}], "t string").select("t", N.folded_title(F.col("t"))).collect()}
    want = {(v, n) for v in set(asked) - {None} for n, t in enumerate(titles) if t is not None and fold[v] is not None and fold[t] is not None and fold[v] in fold[t] and fold[v] != fold[t]}
    got = [(r["value"], r["listing"]) for r in lookup.similar_titles(values, actors, most=100).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert lookup.similar_titles(values.where("false"), actors).collect() == [] and lookup.similar_titles(values, actors.where("false")).collect() == []


def test_faceless(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    wanted = spark.createDataFrame([(1, "a"), (1, "b")], "node_id long, name string")
    shown = spark.createDataFrame([(2,), (2,), (9,)], "node_id long")
    assert lookup.want_totals(nodes, wanted, shown).first().asDict() == {"nodes": 3, "faceless": 2, "with_holes": 1, "missing": 2}
    assert lookup.want_totals(nodes, wanted, shown.where("false")).first()["faceless"] == 3
