"""Declarative updates as a diff against stored state, applied and tallied (F6).

Ops are (n, id, at, type, ref, set map<string,string> of JSON values, rename, describe,
picture), and may have a layer and the shapes that are not carried out (under, create,
append), which are refused; actors are the stored records.  A plan is joins and expressions over all
ops at once: resolve, read state, diff, classify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import names as N
from ledgerloom.functions.coercion import compared
from ledgerloom.operators import lineage
from ledgerloom.operators.graph import resolve_addresses


def op_errors(columns: list[str] = ()) -> Column:
    """PF19: the first rule an op breaks, null when it is sound; `columns` are those that ops have."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    nothing = (F.size(F.coalesce(F.col("set"), F.create_map().cast("map<string,string>"))) == 0) & blank("rename") & blank("describe") & blank("picture")
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != "" if c in columns else F.lit(False)
    return (
        F.when(given("under") | given("create"), "under and create are not supported")
        .when(given("append"), "append is not supported: set the whole value")
        .when(~blank("at") & ~blank("type"), "at and type exclude each other")
        .when(blank("at") & blank("type") & blank("id"), "no address")
        .when(~blank("type") & blank("ref") & blank("id"), "a record needs a ref")
        .when(nothing, "the op does nothing")
        .when(F.array_contains(F.map_keys("set"), "title"), "write the title by rename")
    )


def resolve_ops(ops: DataFrame, tree: DataFrame, actors: DataFrame) -> DataFrame:
    """JN09-JN12, WN11: every op with its actor_id, whether it creates, and its error.

    A stamped id wins over the path; a path that misses is tried again with the name
    the op renames to; of several claims on one (type, ref) the first sound one holds.
    """
    o = ops.withColumn("error", op_errors(ops.columns))
    if "layer" not in ops.columns:  # ops of one layer
        one = tree.agg(F.min("layer").alias("layer"), F.max("layer").alias("_other"))
        o = o.crossJoin(one.select(F.when(F.col("layer") == F.col("_other"), F.col("layer")).alias("layer")))
    # Most ops have no address, or no record: only those that have one are joined, so no null key gathers the rest.
    addressed = o.where("at IS NOT NULL").select("n", "layer", "at", N.renamed_path(F.col("at"), F.col("rename")).alias("_again"))
    asked = addressed.select("layer", F.explode(F.array("at", F.coalesce("_again", "at"))).alias("addr")).distinct()
    found = resolve_addresses(asked, tree).select("layer", "addr", "verdict", F.col("id").alias("_id"))
    addressed = addressed.join(found.withColumnsRenamed({"addr": "at", "verdict": "_v1", "_id": "_i1"}), ["layer", "at"], "left")
    addressed = addressed.withColumn("_again", F.coalesce(F.when(F.col("_v1") == "missing", F.col("_again")), "at"))
    addressed = addressed.join(found.withColumnsRenamed({"addr": "_again", "verdict": "_v2", "_id": "_i2"}), ["layer", "_again"], "left")
    missed = F.col("_v1") == "missing"
    addressed = addressed.select("n", "_v1", "_i1", F.when(missed, F.col("_v2")).alias("_v2"), F.when(missed, F.col("_i2")).alias("_i2"))
    claimed = o.where("type IS NOT NULL AND ref IS NOT NULL").select("n", "type", "ref", "error")
    first = F.first("n").over(Window.partitionBy("type", "ref", F.col("error").isNull()).orderBy("n"))
    records = actors.where("ref IS NOT NULL AND ref <> ''").select(F.col("slug").alias("type"), "ref", F.col("id").alias("_i3"))
    claimed = claimed.withColumn("_first", F.when(F.col("error").isNull(), first)).join(records, ["type", "ref"], "left").select("n", "_first", "_i3")
    o = o.join(addressed, "n", "left").join(claimed, "n", "left")
    o = o.withColumn("actor_id", F.coalesce("id", "_i1", "_i2", "_i3"))
    known = actors.select(F.col("id").alias("actor_id"), F.lit(True).alias("_there"))
    o = o.join(known, "actor_id", "left")
    address = F.when(F.col("_v1") == "ambiguous", "ambiguous address").when((F.col("_v1") == "missing") & (F.coalesce("_v2", F.lit("missing")) != "found"), "no node has the address")
    error = F.coalesce("error", F.when(F.col("_first") < F.col("n"), F.concat(F.lit("the record is claimed by op "), F.col("_first"))), F.when(F.col("id").isNull(), address), F.when(F.col("id").isNotNull() & F.col("_there").isNull(), "no node has the id"))
    creates = F.col("type").isNotNull() & F.col("actor_id").isNull()
    return o.withColumns({"error": error, "creates": creates}).drop("_v1", "_i1", "_v2", "_i2", "_i3", "_first", "_there")


def field_changes(resolved: DataFrame, actors: DataFrame, type_fields: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """JN11, JN14, PL03, AG23: (n, field, ord, key, old, new, error) of every field an op sets, in the form's order.

    A ref(type) value is the path of its target in `tree`; it is stored as the
    target's id and title, and refused where the path hits no node of that type.  An
    unknown field is named with the one that was most likely meant.
    """
    s = resolved.where("error IS NULL AND set IS NOT NULL").select("n", "layer", "actor_id", "type", F.explode("set").alias("field", "raw"))
    state = actors.select(F.col("id").alias("actor_id"), F.col("slug").alias("_slug"), "data")
    s = s.join(state, "actor_id", "left").withColumn("slug", F.coalesce("_slug", "type"))
    f = type_fields.select("slug", F.col("name").alias("field"), F.col("id").alias("field_id"), F.col("type").alias("kind"), "writable", "ord")
    s = s.join(f, ["slug", "field"], "left")
    data = F.coalesce("data", F.create_map().cast("map<string,string>"))
    s = s.withColumn("key", N.storage_key(F.map_keys(data), F.col("field_id")))
    s = s.withColumn("_c", compared("kind", "raw", F.try_element_at(data, F.col("key")))).withColumns({"old": F.col("_c.old"), "new": F.col("_c.new")})
    s = lineage.cut(s.withColumn("_want", N.ref_target(F.col("kind"))))
    meant = nearest_fields(s.where("field_id IS NULL").select("slug", "field").distinct(), type_fields)
    s = s.join(meant, ["slug", "field"], "left")
    if tree is not None and type_fields.where(N.ref_target(F.col("type")).isNotNull()).limit(1).count():
        refs = s.where("_want IS NOT NULL AND _c.error IS NULL").select("n", "layer", "field", F.get_json_object(F.concat(F.lit('{"v":'), "_c.value", F.lit("}")), "$.v").alias("addr"))
        target = actors.select(F.col("id").alias("_target"), F.col("slug").alias("_got"), F.col("title").alias("_title"))
        hit = resolve_addresses(refs.select("layer", "addr"), tree).select("layer", "addr", "verdict", F.col("id").alias("_target")).join(target, "_target", "left")
        s = s.join(refs.join(hit, ["layer", "addr"]).select("n", "field", "addr", "verdict", "_target", "_got", "_title"), ["n", "field"], "left")
        s = s.withColumn("new", F.when(F.col("_want").isNotNull(), F.to_json(F.struct(F.col("_target").alias("id"), F.col("_title").alias("title")))).otherwise(F.col("new")))
        wrong = F.when(F.col("verdict") != "found", F.concat("field", F.lit(": "), "verdict", F.lit(" address "), "addr")).when(~F.col("_got").eqNullSafe(F.col("_want")), F.concat("field", F.lit(" takes a "), "_want", F.lit(", "), "addr", F.lit(" is a "), F.coalesce("_got", F.lit("node without a type"))))
    else:
        wrong = F.lit(None).cast("string")
    suggestion = F.coalesce(F.concat(F.lit(", did you mean "), "suggestion"), F.lit(""))
    error = F.when(F.col("field_id").isNull(), F.concat(F.lit("no field "), F.col("field"), suggestion)).when(~F.col("writable"), F.concat(F.col("field"), F.lit(" is not writable"))).otherwise(F.coalesce("_c.error", wrong))
    return s.select("n", "field", "ord", "key", "old", "new", error.alias("error"))


def rename_collisions(planned: DataFrame, tree: DataFrame) -> DataFrame:
    """JN23: (n, path): the renames of a plan whose new path another node has already."""
    at = tree.select("layer", F.col("id").alias("actor_id"), "path")
    renamed = planned.where("new_title IS NOT NULL AND mark IN ('+', '~')").join(at, "actor_id").select("n", "layer", "actor_id", N.renamed_path(F.col("path"), F.col("new_title")).alias("path"))
    return renamed.join(at.withColumnRenamed("actor_id", "_other"), ["layer", "path"]).where("_other <> actor_id").select("n", "path").distinct()


def nearest_fields(unknown: DataFrame, type_fields: DataFrame) -> DataFrame:
    """WN20, SF26: (slug, field, suggestion): the closest name within min(3, max(1, length/3)) edits, the first on ties.

    Names are looked up by what edits leave whole: cut into d + 1 pieces, a name within
    d edits has a piece that stands unchanged in the field, at most d places away.  The
    pieces are joined by equality, for one edit, then two, then three, each time for
    the fields that have found no name yet.
    """
    names = type_fields.select("slug", "name", "ord")
    budget = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.length("field") / 3)))
    todo = lineage.cut(unknown.select("slug", "field").distinct().withColumn("_budget", budget))
    found = None
    for d in (1, 2, 3):
        if found is not None and not todo.limit(1).count():
            break
        kept = names.select("slug", "name", "ord", F.length("name").alias("_length"), F.explode(_pieces(F.col("name"), d)).alias("_p")).select("*", "_p.*").drop("_p")
        asked = todo.where(F.col("_budget") >= d).select("slug", "field", F.explode(_probes(F.col("field"), d)).alias("_p")).select("slug", "field", "_p.*")
        near = asked.join(kept, ["slug", "_length", "number", "piece"]).select("slug", "field", "name", "ord").withColumn("_d", F.levenshtein("field", "name")).where(F.col("_d") <= d)
        best = lineage.cut(near.groupBy("slug", "field").agg(F.min_by("name", F.struct("_d", "ord", "name")).alias("suggestion")))
        found = best if found is None else found.unionByName(best)
        if d < 3:
            todo = todo.where(F.col("_budget") > d).join(best, ["slug", "field"], "left_anti")
    return found


def _bounds(length: Column, number: Column, d: int) -> tuple[Column, Column]:
    """Start and length of a piece of a name of that length."""
    start = F.floor(number * length / (d + 1)).cast("int")
    return start, F.floor((number + 1) * length / (d + 1)).cast("int") - start


def _pieces(name: Column, d: int) -> Column:
    """The d + 1 pieces of a name, numbered."""

    def piece(number: Column) -> Column:
        start, size = _bounds(F.length(name), number, d)
        return F.struct(number.alias("number"), F.substring(name, start + 1, size).alias("piece"))

    return F.transform(F.sequence(F.lit(0), F.lit(d)), piece)


def _probes(field: Column, d: int) -> Column:
    """What a field may hold of a name's pieces: for each length of a name and piece, the texts of that size near its place."""

    def of_length(length: Column) -> Column:
        def of_piece(number: Column) -> Column:
            start, size = _bounds(length, number, d)
            low, high = F.greatest(start - d, F.lit(0)), F.least(start + d, F.length(field) - size)
            places = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(length.alias("_length"), number.alias("number"), F.substring(field, at + 1, size).alias("piece")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d)), of_piece))

    lengths = F.sequence(F.greatest(F.length(field) - d, F.lit(0)), F.length(field) + d)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def plan(ops: DataFrame, tree: DataFrame, actors: DataFrame, type_fields: DataFrame) -> DataFrame:
    """PL01-PL05: one row for each op: mark (* create, + fills a hole, ~ update, > satisfied), what is written, or the error."""
    r = lineage.cut(resolve_ops(ops, tree, actors))
    c = field_changes(r, actors, type_fields, tree)
    per_op = c.groupBy("n").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct(F.coalesce("ord", F.lit(1 << 30)).alias("ord"), "field", "error")))), lambda x: x["error"]), "; ").alias("_problems"),
        F.sort_array(F.collect_list(F.when(F.col("error").isNull() & ~F.col("old").eqNullSafe(F.col("new")), F.struct("ord", "field", "key", "old", "new")))).alias("changes"),
    )
    state = actors.select(F.col("id").alias("actor_id"), "title", "description", F.col("ref").alias("_ref"), F.col("picture").alias("_picture"), "hole")
    p = r.join(per_op, "n", "left").join(state, "actor_id", "left")
    text = lambda x: F.trim(F.coalesce(F.col(x), F.lit("")))
    set_if = lambda cond, x: F.when(cond, F.col(x))
    p = p.withColumns({
        "error": F.coalesce("error", F.nullif("_problems", F.lit(""))),
        "new_title": set_if((text("rename") != "") & (text("rename") != text("title")), "rename"),
        "new_description": set_if((text("describe") != "") & (text("describe") != text("description")), "describe"),
        "new_ref": set_if(F.col("type").isNotNull() & F.col("id").isNotNull() & (text("_ref") == ""), "ref"),
        "new_picture": set_if((text("picture") != "") & (text("_picture") == ""), "picture"),
        "picture_kept": (text("picture") != "") & (text("_picture") != ""),
        "changes": F.coalesce("changes", F.array().cast(per_op.schema["changes"].dataType)),
    })
    writes = F.col("new_title").isNotNull() | F.col("new_description").isNotNull() | F.col("new_ref").isNotNull() | F.col("new_picture").isNotNull() | (F.size("changes") > 0)
    mark = F.when(F.col("error").isNotNull(), "!").when(F.col("creates"), "*").when(~writes, ">").when(F.coalesce("hole", F.lit(False)), "+").otherwise("~")
    return p.select("n", mark.alias("mark"), "actor_id", "type", "ref", "new_title", "new_description", "new_ref", "new_picture", "picture_kept", "changes", "error")


def summary(planned: DataFrame) -> DataFrame:
    """AG09: counts of a plan; creates are not counted among writes, renames, descriptions and holes."""
    made = F.col("mark") == "*"
    writes = F.col("mark").isin("+", "~")
    return planned.agg(F.count_if(made).alias("creates"), F.sum(F.when(writes, F.size("changes")).otherwise(0)).alias("writes"), F.count_if(writes & F.col("new_title").isNotNull()).alias("renames"), F.count_if(writes & F.col("new_description").isNotNull()).alias("describes"), F.count_if(F.col("mark") == "+").alias("holes"), F.count_if((made | writes) & F.col("new_picture").isNotNull()).alias("pictures"), F.count_if(F.col("mark") == ">").alias("satisfied"), F.count_if(F.col("mark") == "!").alias("errors"))


def adopted(planned: DataFrame, actors: DataFrame) -> DataFrame:
    """SK08: creates whose (type, ref) some record has already become updates of that record, the first by id."""
    there = actors.where("ref IS NOT NULL AND ref <> ''").groupBy(F.col("slug").alias("type"), "ref").agg(F.min("id").alias("_there"))
    creates = planned.where("mark = '*'").join(there, ["type", "ref"], "left")
    mark = F.when(F.col("_there").isNull(), "*").otherwise("~").alias("mark")
    actor = F.coalesce("_there", "actor_id").alias("actor_id")
    turned = creates.select(*(actor if c == "actor_id" else mark if c == "mark" else F.col(c) for c in planned.columns))
    return planned.where("mark <> '*'").unionByName(turned)


def apply(planned: DataFrame, actors: DataFrame, partial: bool = False) -> DataFrame:
    """AP01, SK07, SK08: the snapshot after a plan; only named keys change, a create's id follows from (type, ref).

    Without `partial` a plan with an error is refused.  A replay of an applied plan
    plans nothing, so it is safe.  A create whose record is there by now adopts it.
    """
    planned = adopted(planned, actors)
    if not partial and planned.where("mark = '!'").limit(1).count():
        raise ValueError("the plan has errors: nothing was applied")
    go = planned.where("mark IN ('*', '+', '~')")
    data = F.map_from_entries(F.transform("changes", lambda c: F.struct(c["key"], c["new"])))
    upd = go.where("mark <> '*'").groupBy("actor_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c) for c in ("new_title", "new_description", "new_ref", "new_picture")), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "changes"))), lambda x: x["changes"])).alias("changes"))
    last = F.map_from_entries(F.transform(F.filter("changes", lambda c, i: ~F.exists(F.slice("changes", i + 2, F.size("changes")), lambda d: d["key"] == c["key"])), lambda c: F.struct(c["key"], c["new"])))
    u = upd.withColumn("_set", last).withColumnRenamed("actor_id", "id").drop("changes")
    old = actors.join(u, "id", "left")
    held = F.coalesce("data", F.create_map().cast("map<string,string>"))
    merged = F.when(F.col("_set").isNotNull(), F.map_concat(F.map_filter(held, lambda k, _: ~F.array_contains(F.map_keys("_set"), k)), F.col("_set"))).otherwise(F.col("data"))
    touched = F.col("_set").isNotNull()
    after = old.withColumns({"title": F.coalesce("new_title", "title"), "description": F.coalesce("new_description", "description"), "ref": F.coalesce("new_ref", "ref"), "picture": F.coalesce("new_picture", "picture"), "data": merged, "hole": F.col("hole") & ~touched}).select(*actors.columns)
    new = go.where("mark = '*'").select(F.left(F.sha1(F.concat_ws("|", "type", "ref")), F.lit(32)).alias("id"), F.col("type").alias("slug"), F.coalesce("new_title", "ref").alias("title"), F.col("new_description").alias("description"), "ref", F.col("new_picture").alias("picture"), data.alias("data"), F.lit(False).alias("hole"))
    return after.unionByName(new, allowMissingColumns=True)


def fold_tally(applied: DataFrame, known: DataFrame) -> DataFrame:
    """AP03, WN15: (id, bucket) after a run: an id is counted once, created before hole before updated, known ids stay."""
    bucket = F.when(F.col("creates"), "created").when(F.col("fills_hole"), "hole").otherwise("updated")
    first = Window.partitionBy("id").orderBy("n")
    new = applied.withColumn("bucket", bucket).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("id", "bucket").join(known, "id", "left_anti")
    return known.select("id", "bucket").unionByName(new)


def fold_statements(statements: DataFrame) -> DataFrame:
    """WN16: (seq, ref, ...) to one row a ref: the newest payload in the oldest place."""
    w = Window.partitionBy("ref")
    newest = F.row_number().over(w.orderBy(F.desc("seq")))
    return statements.withColumns({"position": F.min("seq").over(w), "_n": newest}).where("_n = 1").drop("_n")
