"""Layers as forests: parents, sibling labels, unique paths, addresses, types and the exported texts (F5).

Nodes are (layer, ord, id, title, x, y, ...), edges (layer, ord, source, target).  Ways to
the roots are found by pointer doubling: each round is one join on node ids, written to
a table that cuts lineage, and the number of rounds is the logarithm of the depth.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import names as N
from ledgerloom.operators import lineage

MARK = "@"


def accepted_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN01, WN07: edges between known nodes, no self-edges, and the first parent of each node alone."""
    ids = nodes.select("layer", "id")
    known = edges.where("source <> target").join(ids.withColumnRenamed("id", "source"), ["layer", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["layer", "target"], "left_semi")
    first = Window.partitionBy("layer", "target").orderBy("ord")
    return known.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def edge_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer, ord, warning) of dangling, self and second-parent edges, in edge order."""
    ids = nodes.select("layer", F.col("id").alias("_i"))
    e = edges.join(ids.withColumnRenamed("_i", "source").withColumn("_s", F.lit(True)), ["layer", "source"], "left").join(ids.withColumnRenamed("_i", "target").withColumn("_t", F.lit(True)), ["layer", "target"], "left")
    dangling = F.col("_s").isNull() | F.col("_t").isNull()
    good = ~dangling & (F.col("source") != F.col("target"))
    w = Window.partitionBy("layer", "target").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_before", F.max(good).over(w))
    kind = F.when(dangling, "dangling endpoint").when(F.col("source") == F.col("target"), "self-edge").when(F.coalesce("_before", F.lit(False)), "already has a parent")
    return e.select("layer", "ord", kind.alias("warning")).where("warning IS NOT NULL").orderBy("layer", "ord")


def labels(siblings: DataFrame, keys: list[str]) -> DataFrame:
    """WN08: siblings of one title carry the shortest hex prefix, of four digits and more, that tells the whole group apart.

    `siblings` has `keys`, id and title.  In order of the hex digits only neighbours
    must be told apart, so one window gives each pair's length and the group's largest.
    """
    group = Window.partitionBy(*keys, "title")
    before = F.lag("_h").over(group.orderBy("_h"))
    apart = F.array_min(F.filter(F.sequence(F.lit(4), F.lit(31)), lambda k: F.left(F.col("_h"), k) != F.left(F.col("_b"), k)))
    s = siblings.withColumn("_h", F.replace(F.col("id"), F.lit("-"), F.lit(""))).withColumn("_b", before)
    s = s.withColumn("_k", F.when(F.col("_b").isNotNull() & (F.col("_b") != F.col("_h")), F.coalesce(apart, F.lit(32))).otherwise(4))
    s = s.withColumns({"_k": F.max("_k").over(group), "_n": F.count(F.lit(1)).over(group)})
    return s.withColumn("label", F.when(F.col("_n") == 1, F.col("title")).otherwise(F.concat("title", F.lit(MARK), F.left(F.col("_h"), F.col("_k"))))).drop("_h", "_b", "_n", "_k")


def forest(nodes: DataFrame, edges: DataFrame, cut=None) -> DataFrame:
    """GR01, GR02: (layer, id, parent_id, depth, label, path, walk_key) of every node.

    What no root reaches, the residue of cycles, is promoted to further roots.
    `walk_key` sorts in depth-first order: zero-padded sibling ranks.  Paths hold all
    labels above a node, so those of a chain of n nodes take n * n / 2 labels: see
    structure() for such layers.  `cut` writes a frame and reads it again (lineage).
    """
    cut = cut or lineage.cut
    parents = accepted_edges(nodes, edges).select("layer", F.col("target").alias("id"), F.col("source").alias("parent_id"))
    placed = nodes.join(parents, ["layer", "id"], "left").select("layer", "id", "title", "parent_id", "x", "y", "ord")
    rank = F.row_number().over(Window.partitionBy("layer", "parent_id").orderBy("y", "x", "ord"))
    placed = labels(placed.withColumn("_rank", rank), ["layer", "parent_id"])
    placed = cut(placed.select("layer", "id", "title", "x", "y", "ord", "parent_id", "label", F.format_string("%08d", "_rank").alias("_rank")))
    out, looped = climbed(placed, cut)
    if looped is not None:
        out = out.unionByName(climbed(opened(placed.join(looped, ["layer", "id"], "left_semi"), cut), cut)[0])
    return disambiguated(out.drop("root_id"), cut)


def structure(nodes: DataFrame, edges: DataFrame, cut=None) -> DataFrame:
    """GR01, GR02 without texts: (layer, id, parent_id, depth, root_id), for layers so deep that written-out paths would not fit."""
    cut = cut or lineage.cut
    parents = accepted_edges(nodes, edges).select("layer", F.col("target").alias("id"), F.col("source").alias("parent_id"))
    placed = cut(nodes.join(parents, ["layer", "id"], "left").select("layer", "id", "title", "x", "y", "ord", "parent_id"))
    out, looped = climbed(placed, cut, texts=False)
    if looped is not None:
        out = out.unionByName(opened_ways(placed.join(looped, ["layer", "id"], "left_semi"), cut))
    return out


def climbed(placed: DataFrame, cut, texts: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The nodes that hang from a root, and (layer, id) of those that hang from a cycle, null if there are none.

    Pointer doubling: a node knows a stretch of its way up, and in every round adds the
    stretch of the node where its own ends, which doubles it.  A node is done when its
    stretch reaches a root, so log2(depth) rounds do.  As long as tree nodes are open,
    the highest of them is done in the next round: a round without one leaves cycles.
    """
    own = ["label", F.col("label").alias("path"), F.col("_rank").alias("walk_key")] if texts else []
    top = F.col("parent_id").isNull()
    start = placed.select("layer", "id", "parent_id", F.col("parent_id").alias("_up"), F.when(top, 0).otherwise(1).alias("depth"), F.when(top, F.col("id")).alias("root_id"), *own)
    done, todo = start.where("_up IS NULL"), start.where("_up IS NOT NULL")
    left = todo.count()
    while left:
        known = done.unionByName(todo)
        above = known.select("layer", F.col("id").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_d"), F.col("root_id").alias("_r"), *([F.col("path").alias("_p"), F.col("walk_key").alias("_w")] if texts else []))
        grown = ["label", F.concat("_p", F.lit(N.SEPARATOR), "path").alias("path"), F.concat("_w", "walk_key").alias("walk_key")] if texts else []
        moved = cut(todo.join(above, ["layer", "_up"]).select("layer", "id", "parent_id", F.col("_next").alias("_up"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_r").alias("root_id"), *grown))
        still = moved.where("_up IS NOT NULL")
        now = still.count()
        if now == left:
            return done.drop("_up"), todo.select("layer", "id")
        done, todo, left = done.unionByName(moved.where("_up IS NULL")), still, now
    return done.drop("_up"), None


def _first_above(looped: DataFrame, cut) -> DataFrame:
    """(layer, id, parent_id, least, depth) of nodes that hang from cycles: the first node in sibling order above each or itself, and how far above it stands.

    Found by pointer doubling, final once a round changes none; as no way ends, after
    k rounds all stretches are 2^k nodes long.
    """
    key = F.struct("y", "x", "ord", "id")
    first = cut(looped.select("layer", "id", "parent_id", F.col("parent_id").alias("_up"), key.alias("least"), F.lit(0).alias("depth")))
    stretch = 1
    while True:
        above = first.select("layer", F.col("id").alias("_up"), F.col("_up").alias("_next"), F.col("least").alias("_m"), F.col("depth").alias("_d"))
        new = F.col("_m") < F.col("least")
        moved = cut(first.join(above, ["layer", "_up"]).select("layer", "id", "parent_id", F.col("_next").alias("_up"), F.when(new, F.col("_m")).otherwise(F.col("least")).alias("least"), F.when(new, F.col("_d") + F.lit(stretch)).otherwise(F.col("depth")).alias("depth"), new.alias("_new")))
        if not moved.where("_new").limit(1).count():
            return first.drop("_up")
        first, stretch = moved.drop("_new"), stretch * 2


def opened_ways(looped: DataFrame, cut) -> DataFrame:
    """GR02 without texts: (layer, id, parent_id, depth, root_id) of the nodes that hang from cycles.

    The first node above a node has none before it above itself, so it becomes a root,
    and no root stands between the two: nothing has to be climbed again.
    """
    first = _first_above(looped, cut)
    root = F.col("least.id")
    return first.select("layer", "id", F.when(root != F.col("id"), F.col("parent_id")).alias("parent_id"), "depth", root.alias("root_id"))


def opened(looped: DataFrame, cut) -> DataFrame:
    """GR02: the nodes that hang from cycles, with the parents of those cut off that become roots.

    In sibling order each node becomes a root unless an earlier one has led to it: it
    is one if no node above it, round the cycle, comes before it.
    """
    first = _first_above(looped, cut)
    roots = first.where(F.col("least.id") == F.col("id")).select("layer", "id", F.lit(True).alias("_root"))
    # A root is labelled among all nodes of the residue, and comes after the layer's other roots.
    named = labels(looped.select("layer", "id", "title", "x", "y", "ord"), ["layer"]).join(roots, ["layer", "id"])
    number = F.row_number().over(Window.partitionBy("layer").orderBy("y", "x", "ord", "id")) + 89_999_999
    named = named.select("layer", "id", "_root", F.col("label").alias("_label"), F.format_string("%08d", number).alias("_number"))
    pick = lambda a, b: F.when(F.col("_root"), F.col(a)).otherwise(F.col(b)).alias(b)
    return cut(looped.join(named, ["layer", "id"], "left").select("layer", "id", "title", "x", "y", "ord", F.when(F.col("_root").isNull(), F.col("parent_id")).alias("parent_id"), pick("_label", "label"), pick("_number", "_rank")))


def disambiguated(tree: DataFrame, cut=lambda df: df) -> DataFrame:
    """GR03: the second and later nodes of one path, in walk order, carry their full id, and so do the paths below them.

    Collisions are rare; as long as there are any, those that no colliding node stands
    above are renamed with all that is below them.
    """
    again = F.row_number().over(Window.partitionBy("layer", "path").orderBy("walk_key")) > 1
    above = F.explode(F.transform(F.sequence(F.lit(1), F.col("depth") + 1), lambda k: F.left(F.col("walk_key"), k * 8))).alias("_k")
    while True:
        clash = cut(tree.withColumn("_again", again).where("_again").select("layer", F.col("walk_key").alias("_k")))
        if not clash.limit(1).count():
            return tree
        below = tree.select("layer", "walk_key", above).join(clash, ["layer", "_k"]).where("_k <> walk_key").select("layer", "walk_key").distinct()
        clear = tree.join(below, ["layer", "walk_key"], "left_anti")
        named = clear.withColumn("_again", again).where("_again").select("layer", F.col("walk_key").alias("_k"), F.col("path").alias("_old"), F.concat("path", F.lit(MARK), "id").alias("_new"))
        moved = tree.select("layer", "walk_key", above).join(named, ["layer", "_k"]).select("layer", "walk_key", "_old", "_new")
        tree = tree.join(moved, ["layer", "walk_key"], "left").withColumn("path", F.when(F.col("_new").isNotNull(), F.concat("_new", F.substring(F.col("path"), F.length("_old") + 1, F.length("path")))).otherwise(F.col("path"))).drop("_old", "_new")
        tree = cut(tree.select("layer", "id", "parent_id", "depth", "label", "path", "walk_key"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR02: (layer, id, parent_id, path, walk_no) of the nodes that no root reaches, promoted in sibling order."""
    residue = forest(nodes, edges).where("walk_key >= '9'")
    return residue.select("layer", "id", "parent_id", "path", (F.row_number().over(Window.partitionBy("layer").orderBy("walk_key")) - 1).alias("walk_no"))


def short_addresses(tree: DataFrame) -> DataFrame:
    """WN13, AG20: the shortest suffix of each path that no other path of the layer ends with, else the path."""
    each = tree.select("layer", "id", "path", F.posexplode(F.reverse(N.suffixes(F.col("path")))).alias("k", "suffix"))
    counted = each.withColumn("_n", F.count("*").over(Window.partitionBy("layer", "suffix")))
    return counted.groupBy("layer", "id", "path").agg(F.coalesce(F.min_by("suffix", F.when(F.col("_n") == 1, F.col("k"))), F.first("path")).alias("address"))


def resolve_addresses(addresses: DataFrame, tree: DataFrame) -> DataFrame:
    """JN08: (layer, addr, verdict found/ambiguous/missing, id, path): exact or suffix matches, then without discriminators.

    A node is posted under every suffix of its path, which turns the suffix search into
    an equi-join; an address that hits in the first pass never enters the second.
    """

    def hits(path: Column, asked: DataFrame) -> DataFrame:
        posted = tree.select("layer", "id", "path", F.explode(N.suffixes(path)).alias("addr"))
        return asked.join(posted, ["layer", "addr"]).groupBy("layer", "addr").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("path").alias("path"))

    asked = addresses.select("layer", "addr").distinct()
    first = hits(F.col("path"), asked)
    second = hits(N.without_discriminators(F.col("path")), asked.join(first, ["layer", "addr"], "left_anti"))
    found = first.unionByName(second)
    one = F.col("n") == 1
    return asked.join(found, ["layer", "addr"], "left").select("layer", "addr", F.when(one, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("verdict"), F.when(one, F.col("id")).alias("id"), F.when(one, F.col("path")).alias("path"))


def common_prefix(titles: DataFrame, title: str = "title") -> DataFrame:
    """AG11: the longest `_`-ended prefix that three fifths of the titles, two at least, have; ties the smallest."""
    t = titles.select(F.col(title).alias("t"))
    parts = F.split("t", "_")
    prefixes = t.select("t", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "_"), F.lit("_"))))).alias("prefix"))
    n = t.agg(F.count("*").alias("total"))
    ranked = prefixes.groupBy("prefix").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).where("n >= greatest(2, 3 * total div 5) AND total >= 2")
    return ranked.orderBy(F.desc(F.length("prefix")), "prefix").limit(1).select("prefix", "n")


def types(forms: DataFrame, prefix: str = "") -> DataFrame:
    """GR04, WN10: (form_id, slug): the title's slug without the common prefix; a later form of one slug adds its id."""
    bare = F.when(F.lit(bool(prefix)) & F.col("form_title").startswith(prefix), F.substring(F.col("form_title"), F.lit(len(prefix) + 1), F.length("form_title"))).otherwise(F.col("form_title"))
    base = F.coalesce(F.nullif(N.slug(bare), F.lit("")), F.concat(F.lit("form_"), F.col("form_id")))
    again = F.row_number().over(Window.partitionBy("_base").orderBy("form_id")) > 1
    return forms.withColumn("_base", base).select("form_id", "form_title", F.when(again, F.concat("_base", F.lit("_"), "form_id")).otherwise(F.col("_base")).alias("slug"))


def resolve_refs(fields: DataFrame, typed: DataFrame) -> DataFrame:
    """JN13: fields (slug, ..., type) with ref:<form> named as ref(<slug>) of the layer's types, else string."""
    form = F.regexp_extract("type", "^ref:([0-9]+)$", 1).try_cast("long")
    known = typed.select(F.col("form_id").cast("long").alias("_form"), F.col("slug").alias("_target"))
    named = fields.withColumn("_form", form).join(known, "_form", "left")
    kind = F.when(F.col("_target").isNotNull(), F.concat(F.lit("ref("), "_target", F.lit(")"))).when(F.col("type").startswith("ref:"), "string").otherwise(F.col("type"))
    return named.withColumn("type", kind).select(*fields.columns)


def forms(actors: DataFrame) -> DataFrame:
    """AG22: (form_id, form_title): the distinct forms of actors (form_id, form_title, ord), each with its first title that is not empty."""
    said = F.when(F.trim(F.coalesce("form_title", F.lit(""))) != "", F.col("ord"))
    return actors.where("form_id IS NOT NULL").groupBy("form_id").agg(F.coalesce(F.min_by("form_title", said), F.lit("")).alias("form_title"))


def filtered(nodes: DataFrame, type_: str = "", under: str = "", empty: bool = False, filled: bool = False, no_picture: bool = False) -> DataFrame:
    """PF12: nodes (slug, path, n_values, picture) of a type, under a part of a path in any case, without or with values, without a picture."""
    out = nodes
    if type_:
        out = out.where(F.col("slug") == type_)
    if under:
        out = out.where(F.lower("path").contains(under.lower()))
    if empty or filled:
        out = out.where((F.col("n_values") == 0) if empty else (F.col("n_values") > 0))
    return out.where(F.coalesce(F.trim("picture"), F.lit("")) == "") if no_picture else out


def deduped_names(fields: DataFrame) -> DataFrame:
    """WN09: names of a type's fields made unique by _2, _3 ... against all names taken so far (sequential by nature)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        taken: set = set()
        out = []
        for name in frame.name:
            k, candidate = 2, name
            while candidate in taken:
                candidate, k = f"{name}_{k}", k + 1
            taken.add(candidate)
            out.append(candidate)
        return frame.assign(name=out)

    return fields.groupBy("slug").applyInPandas(one, fields.schema)


def with_types(nodes: DataFrame, typed: DataFrame) -> DataFrame:
    """JN03: the type of each node by its form; the dictionary of forms is joined, broadcast only as far as Spark finds it small."""
    return nodes.join(typed.select("form_id", "slug"), "form_id", "left").withColumn("slug", F.coalesce("slug", F.concat(F.lit("form_"), F.col("form_id"))))


def value_lines(tree: DataFrame, values: DataFrame, type_fields: DataFrame) -> DataFrame:
    """SK05, JN04: (layer, walk_key, line_no, line) of the values text: a node's line, then its fields in form order, then leftovers A-Z.

    tree has a slug and may have a description; values is (layer, id, field_id, value),
    value already rendered.
    """
    said = F.nullif(N.one_line(F.col("description")), F.lit("")) if "description" in tree.columns else F.lit(None).cast("string")
    head = tree.select("layer", "walk_key", F.lit(0).alias("line_no"), F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), "label", F.lit(" ["), "slug", F.lit("]"), F.coalesce(F.concat(F.lit("  # "), said), F.lit(""))).alias("line"))
    v = values.where("value <> ''").join(tree.select("layer", "id", "slug", "depth", "walk_key"), ["layer", "id"])
    named = v.join(type_fields.select("slug", F.col("id").alias("field_id"), "name", F.col("ord").alias("_ord")), ["slug", "field_id"], "left")
    order = Window.partitionBy("layer", "id").orderBy(F.col("_ord").isNull(), "_ord", "field_id")
    rows = named.select("layer", "walk_key", F.row_number().over(order).alias("line_no"), F.concat(F.repeat(F.lit("  "), F.col("depth") + 2), F.coalesce("name", "field_id"), F.lit(": "), "value").alias("line"))
    return head.unionByName(rows).orderBy("layer", "walk_key", "line_no")


def ids_document(tree: DataFrame, layer: str) -> str:
    """SK03: the ids file of one layer, paths in walk order."""
    rows: Iterator = tree.where(F.col("layer") == layer).orderBy("walk_key").select("path", "id").toLocalIterator()
    return json.dumps({"layer": layer, "sep": N.SEPARATOR, "paths": {r["path"]: r["id"] for r in rows}}, ensure_ascii=False, indent=1) + "\n"
