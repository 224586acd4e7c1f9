"""Records found by identity keys, and what nodes still lack (F7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions import names as N

# Fields a run writes about itself, the most records given for a value, and the length of title pieces.
PROVENANCE = ("source", "evidence_quote", "confidence", "gaps")
MOST_HITS, PIECE = 10, 6


def probes(type_fields: DataFrame, slug: str, named: list[str] | None = None) -> DataFrame:
    """ST06: (rank, field_id, name): the named fields in their order, else the identity fields; the title comes last by itself."""
    f = type_fields.where(F.col("slug") == slug)
    if named:
        order = F.array_position(F.array(*map(F.lit, named)), F.col("name"))
        f = f.where(order > 0).withColumn("rank", order)
    else:
        f = f.where(N.is_identity_title(F.col("title"))).withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy("ord")))
    return f.select(F.col("rank").cast("int").alias("rank"), F.col("id").alias("field_id"), "name")


def find_records(values: DataFrame, probed: DataFrame, stored: DataFrame, actors: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """JN07: (value, verdict, matched_by, records, similar): the first probe and candidate with hits wins, then the title.

    `similar` holds the titles that contain a value which no field found; it is null where there are none.

    `stored` is (actor_id, field_id, value), `actors` (id, ref, title, listing).  One
    equi-join on (field, value); only what it leaves over is compared by title.
    """
    v = values.select("value").distinct()
    tries = v.select("value", F.posexplode(N.candidates(F.col("value"))).alias("cand", "candidate"))
    # The stored values of probed fields, then one equi-join by candidate: values and probes never meet in pairs.
    held = stored.select("actor_id", "field_id", F.col("value").alias("candidate")).join(probed.select("rank", "field_id", "name"), "field_id")
    hits = tries.join(held, "candidate")
    best = F.dense_rank().over(Window.partitionBy("value").orderBy("rank", "cand"))
    hits = hits.withColumn("_r", best).where("_r = 1").join(actors.select(F.col("id").alias("actor_id"), "ref", "title", "listing"), "actor_id")
    few = F.row_number().over(Window.partitionBy("value").orderBy("listing")) <= most
    record = F.struct("listing", F.col("actor_id").alias("id"), "ref", "title")
    by_field = hits.withColumn("_k", few).where("_k").groupBy("value").agg(F.first("name").alias("matched_by"), F.sort_array(F.collect_list(record)).alias("records"))
    rest = v.join(by_field.select("value"), "value", "left_anti")
    titled = actors.withColumn("_t", N.folded_title(F.col("title")))
    exact = rest.withColumn("_t", N.folded_title(F.col("value"))).join(titled, "_t").withColumn("_k", few).where("_k").groupBy("value").agg(F.lit("title").alias("matched_by"), F.sort_array(F.collect_list(F.struct("listing", "id", "ref", "title"))).alias("records"))
    found = by_field.unionByName(exact)
    alike = similar_titles(rest, actors, most).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("listing", "id", "ref", "title"))).alias("similar"))
    return v.join(found, "value", "left").join(alike, "value", "left").select("value", F.when(F.col("matched_by").isNotNull(), "FOUND").otherwise("not found").alias("verdict"), "matched_by", "records", "similar")


def similar_titles(values: DataFrame, actors: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """(value, listing, id, ref, title): titles that contain a value without equalling it, the first `most` of each value.

    All values are taken.  A value meets only the titles that have its rarest piece of
    at most PIECE characters, by an equi-join.
    """
    v = values.select("value").distinct().withColumn("_v", N.folded_title(F.col("value"))).where("_v IS NOT NULL")
    titled = actors.select("listing", "id", "ref", "title", N.folded_title(F.col("title")).alias("_t")).where("_t IS NOT NULL")
    cut = lambda t, n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: F.substring(t, i, n))).otherwise(F.array().cast("array<string>"))
    # Titles are cut to the sizes that values need: one size where no value is shorter than PIECE.
    sizes = v.agg(F.collect_set(F.least(F.length("_v"), F.lit(PIECE))).alias("_sizes"))
    sized = F.flatten(F.transform("_sizes", lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(cut(F.col("_t"), n))))
    pieces = titled.crossJoin(F.broadcast(sizes)).withColumn("_piece", F.explode(F.array_distinct(sized))).drop("_sizes")
    count = pieces.groupBy("_piece").agg(F.count("*").alias("_n"))
    own = v.withColumn("_piece", F.explode(F.array_distinct(cut(F.col("_v"), F.least(F.length("_v"), F.lit(PIECE))))))
    rarest = own.join(count, "_piece").groupBy("value", "_v").agg(F.min(F.struct("_n", "_piece")).alias("_r")).select("value", "_v", F.col("_r._piece").alias("_piece"))
    hits = rarest.join(pieces, "_piece").where(F.col("_t").contains(F.col("_v")) & (F.col("_t") != F.col("_v")))
    few = F.row_number().over(Window.partitionBy("value").orderBy("listing")) <= most
    return hits.withColumn("_k", few).where("_k").select("value", "listing", "id", "ref", "title")


def tally(found: DataFrame) -> DataFrame:
    """AG08: found and missing."""
    return found.agg(F.count_if(F.col("verdict") == "FOUND").alias("found"), F.count_if(F.col("verdict") == "not found").alias("missing"))


def want_list(nodes: DataFrame, held: DataFrame, type_fields: DataFrame, keep_all: bool = False) -> DataFrame:
    """JN16, PF11: (node_id, slug, ord, name, title) of the fields a node's type has and the node does not hold."""
    f = type_fields if keep_all else type_fields.where(F.col("writable") & ~F.col("name").isin(*PROVENANCE))
    wanted = nodes.select("node_id", "slug").join(f.select("slug", "ord", "name", "title"), "slug")
    return wanted.join(held.select("node_id", "name").distinct(), ["node_id", "name"], "left_anti")


def want_totals(nodes: DataFrame, wanted: DataFrame, pictured: DataFrame | None = None) -> DataFrame:
    """AG21: nodes, nodes with holes and missing fields; with `pictured`, the node_id of nodes with a picture, also the faceless.

    A values text without a pictures block says nothing about pictures: then there is no such count.
    """
    w = wanted.agg(F.countDistinct("node_id").alias("with_holes"), F.count("*").alias("missing"))
    if pictured is None:
        return nodes.agg(F.count("*").alias("nodes")).crossJoin(w)
    shown = pictured.select("node_id").distinct().withColumn("_shown", F.lit(True))
    counts = nodes.join(shown, "node_id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("_shown").isNull()).alias("faceless"))
    return counts.crossJoin(w)
