"""Sidecar files of many layers or runs as tables (SC22-SC27, SC33-SC34, SK03-SK04, SK10, AG10).

Every reader takes (file, text) rows, as `files.lines` or a table gives them, and works
where the rows are; a text that breaks its format gives one row with an `error` and
nothing else, and the other files go on.  A null text is no file: it has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.names import SEPARATOR
from ledgerloom.sources import files, sidecars


_BROKEN = (ValueError, TypeError, AttributeError, yaml.YAMLError)
_TEXT = pa.string()
_FIELDS = pa.list_(pa.struct([("name", _TEXT), ("value", _TEXT)]))
_VALUES = {"file": _TEXT, "error": _TEXT, "ord": pa.int32(), "path": _TEXT, "label": _TEXT, "type": _TEXT, "description": _TEXT, "fields": _FIELDS, "pictured": pa.bool_()}


def _broken(file: str, e: Exception, width: int) -> tuple:
    return (file, str(e).split("\n")[0][:200], *[None] * width)


def _each(texts: DataFrame, read: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """read() of every text; `schema` names its columns after file and error."""
    width = len(schema.split(", "))
    full = f"file string, error string, {schema}"
    names = [c.split(" ")[0] for c in full.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for file, text in zip(frame.file, frame.text):
                try:
                    out += [(file, None, *row) for row in read(text)]
                except _BROKEN as e:
                    out.append(_broken(file, e, width))
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out = []
            yield pd.DataFrame(out, columns=names, dtype=object)

    return texts.where("text IS NOT NULL").select("file", "text").mapInPandas(run, full)


def ids(texts: DataFrame) -> DataFrame:
    """SC22: (file, error, layer, path, id) of ids files; of a path that is repeated every id stays."""
    doc = F.from_json("text", "layer string, sep string, paths map<string,string>")
    t = texts.where("text IS NOT NULL").select("file", F.get_json_object("text", "$").isNull().alias("_bad"), doc.alias("_d"))
    error = (
        F.when(F.col("_bad"), "not JSON")
        .when(F.coalesce("_d.sep", F.lit(SEPARATOR)) != SEPARATOR, F.concat(F.lit("unexpected separator "), "_d.sep"))
        .when(F.coalesce(F.size("_d.paths"), F.lit(0)) <= 0, "no paths to resolve addresses against")
    )
    t = t.withColumn("error", error)
    paths = F.when(F.col("error").isNull(), F.col("_d.paths"))
    return t.select("file", "error", F.when(F.col("error").isNull(), F.coalesce("_d.layer", F.lit(""))).alias("layer"), F.explode_outer(paths).alias("path", "id"))


_TYPES = {"file": _TEXT, "error": _TEXT, "slug": _TEXT, "form_id": pa.int64(), "form_title": _TEXT, "description": _TEXT, "ord": pa.int32(), "name": _TEXT, "id": _TEXT, "type": _TEXT, "title": _TEXT, "writable": pa.bool_()}


def types(texts: DataFrame) -> DataFrame:
    """SC23, SC26: (file, error, slug, form_id, form_title, description, ord, name, id, type, title, writable), a field a row; a type without fields has one row.

    A file's rows wait as Arrow batches until its text has proved sound, a type at a time.
    """

    def told(kind: tuple, fields: list[tuple]) -> list[tuple]:
        return [(*kind, *f[1:6], None if f[6] is None else bool(f[6])) for f in fields] or [(*kind, *(None,) * 6)]

    def whole(text: str) -> list[tuple]:
        kinds, fields = sidecars.parse_types(text)
        own: dict = {}
        for f in fields:
            own.setdefault(f[0], []).append(f)
        return [row for k in kinds for row in told(k, own.get(k[0], []))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for held in batches:
            for name, content in zip(held.column("file"), held.column("text")):
                file, text = name.as_py(), content.as_py()
                sound, own = [], []
                try:
                    for kind, fields in sidecars.types_in_parts(text):
                        own += [(file, None, *row) for row in told(kind, fields)]
                        if len(own) >= files.BATCH_ROWS:
                            sound.append(files.batch(own, _TYPES))
                            own = []
                except sidecars.NotInParts:
                    sound = []
                    try:
                        own = [(file, None, *row) for row in whole(text)]
                    except _BROKEN as e:
                        own = [_broken(file, e, len(_TYPES) - 2)]
                except _BROKEN as e:
                    sound, own = [], [_broken(file, e, len(_TYPES) - 2)]
                yield from sound
                part += own
                if len(part) >= files.BATCH_ROWS:
                    yield files.batch(part, _TYPES)
                    part = []
        if part:
            yield files.batch(part, _TYPES)

    shown = "file string, error string, slug string, form_id long, form_title string, description string, ord int, name string, id string, type string, title string, writable boolean"
    return texts.where("text IS NOT NULL").select("file", "text").mapInArrow(run, shown)


def ops(texts: DataFrame) -> DataFrame:
    """SC24, ST03, PF19: the ops of ops files, in the columns that planning reads, with the file, its layer and mode."""

    def read(text: str) -> list[tuple]:
        doc = sidecars.parse_ops(text)
        return [(doc.get("layer"), doc["mode"], *row) for row in sidecars.op_rows(doc)]

    return _each(texts, read, f"layer string, mode string, {sidecars.OP_ROW}")


def values(texts: DataFrame) -> DataFrame:
    """SC25, SC27, WN19: the nodes of values texts with their path and fields; `pictured` is null where a text has no such block."""

    def read(text: str) -> list[tuple]:
        with_picture = sidecars.pictured(text)
        out = []
        for n, node in enumerate(sidecars.parse_values(text)):
            path = SEPARATOR.join(node["path"])
            out.append((n, path, node["label"], node["type"], node["description"], [{"name": a, "value": b} for a, b in node["fields"]], None if with_picture is None else path in with_picture))
        return out

    def told(file: str, text: str) -> list[tuple]:
        try:
            return [(file, None, *row) for row in read(text)]
        except _BROKEN as e:
            return [_broken(file, e, len(_VALUES) - 2)]

    held = texts.where("text IS NOT NULL").select(F.col("file").alias("path"), F.col("text").alias("content"))
    return held.mapInArrow(lambda batches: files.batched(batches, told, _VALUES), "file string, error string, ord int, path string, label string, type string, description string, fields array<struct<name:string,value:string>>, pictured boolean")


_RESULT = "STRUCT<" + ", ".join(f"`{name}`: ARRAY<STRING>" for name in sidecars.RESULT_LISTS[:3]) + f", `{sidecars.RESULT_LISTS[3]}`: ARRAY<STRUCT<`ref`: STRING, `транзакций`: BIGINT>>>"
BUCKETS = ("hole", "updated", "created")


def results(texts: DataFrame) -> DataFrame:
    """SC33: (file, error, pos, id, bucket) of result files, lists in their order; a file with empty lists has no rows."""
    t = texts.where("text IS NOT NULL").select("file", F.when(F.get_json_object("text", "$").isNull(), "not JSON").alias("error"), F.from_json("text", _RESULT).alias("_d"))

    def marked(name: str, bucket: str) -> Column:
        return F.transform(F.col("_d")[name], lambda i: F.struct(i.alias("id"), F.lit(bucket).alias("bucket")))

    listed = [marked(name, bucket) for name, bucket in zip(sidecars.RESULT_LISTS, BUCKETS)]
    every = F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<struct<id:string,bucket:string>>")) for x in listed)))
    shown = F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("bucket")))).otherwise(every)
    return t.select("file", "error", F.posexplode(shown).alias("pos", "_r")).select("file", "error", "pos", "_r.id", "_r.bucket")


def result_counts(texts: DataFrame) -> DataFrame:
    """AG10: (file, holes, updated, created, transactions), counted from the lists and not from the counts that the file states."""
    d = texts.where("text IS NOT NULL").select("file", F.from_json("text", _RESULT).alias("_d"))
    n = lambda name: F.greatest(F.coalesce(F.size(F.col("_d")[name]), F.lit(0)), F.lit(0)).cast("long")
    posted = F.aggregate(F.coalesce(F.col("_d")[sidecars.RESULT_LISTS[3]], F.array()), F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["транзакций"], F.lit(0)))
    return d.select("file", *(n(name).alias(out) for name, out in zip(sidecars.RESULT_LISTS, ("holes", "updated", "created"))), posted.alias("transactions"))


def settings(texts: DataFrame) -> DataFrame:
    """SC34: (file, error, name, value) of NAME=VALUE files, natively; of a name that is set twice the last holds, nothing is expanded."""
    line = F.transform(F.split("text", "\r\n|\n|\r"), lambda x, n: F.struct((n + 1).alias("n"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("x")))
    kept = F.filter(line, lambda s: (s["x"] != "") & ~s["x"].startswith("#"))
    t = texts.where("text IS NOT NULL").select("file", kept.alias("_k"))
    said = F.regexp_replace("_x", r"^export ", "")
    t = t.select("file", F.explode("_k").alias("_k")).select("file", F.col("_k.n").alias("_n"), F.col("_k.x").alias("_x")).withColumn("_x", said)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    name, value = trim(F.substring_index("_x", "=", 1)), trim(F.regexp_replace("_x", r"^[^=]*=?", ""))
    bare = F.when(value.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(value) > 1), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    t = t.select("file", "_n", F.when(~F.col("_x").contains("=") | (name == ""), F.concat(F.lit("line "), "_n", F.lit(" is not NAME=VALUE"))).alias("_e"), name.alias("name"), bare.alias("value"))
    per = t.groupBy("file").agg(F.min_by("_e", F.when(F.col("_e").isNotNull(), F.col("_n"))).alias("error"), F.collect_list(F.struct("_n", "name", "value")).alias("_all"))
    last = F.transform(F.array_distinct(F.transform("_all", lambda s: s["name"])), lambda nm: F.array_max(F.filter("_all", lambda s: s["name"] == nm)))
    shown = F.when(F.col("error").isNull(), last).otherwise(F.array(F.struct(F.lit(0).alias("_n"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))))
    return per.select("file", "error", F.explode(shown).alias("_s")).select("file", "error", "_s.name", "_s.value")


# --- writers


def quoted(text: Column | str) -> Column:
    """A text as JSON writes it."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def ids_lines(tree: DataFrame) -> DataFrame:
    """SK03: (layer, line_no, line) of every layer's ids file, paths in walk order; the layers' lines are numbered by a sort, never gathered."""
    walk = Window.partitionBy("layer").orderBy("walk_key", "id")
    t = tree.select("layer", F.row_number().over(walk).alias("_k"), F.lead(F.lit(1)).over(walk).isNull().alias("_last"), "path", "id")
    entry = F.concat(F.lit("  "), quoted("path"), F.lit(": "), quoted("id"), F.when(F.col("_last"), "").otherwise(","))
    head = F.array(F.lit("{"), F.concat(F.lit(' "layer": '), quoted("layer"), F.lit(",")), F.concat(F.lit(' "sep": '), quoted(F.lit(SEPARATOR)), F.lit(",")), F.lit(' "paths": {'))
    own = F.concat(F.when(F.col("_k") == 1, head).otherwise(F.array().cast("array<string>")), F.array(entry), F.when(F.col("_last"), F.array(F.lit(" }"), F.lit("}"))).otherwise(F.array().cast("array<string>")))
    lines = t.select("layer", "_k", F.posexplode(own).alias("_i", "line"))
    return lines.select("layer", (F.col("_k") + F.when(F.col("_k") == 1, 0).otherwise(4) + F.col("_i")).cast("long").alias("line_no"), "line")


_ENTRIES = {"file": _TEXT, "form_id": pa.int64(), "head": _TEXT, "entry": _TEXT}


def type_texts(kinds: DataFrame, fields: DataFrame) -> DataFrame:
    """SK04: (file, text) of type dictionaries from (file, slug, form_id, form_title, description) and (file, slug, ord, name, id, type, title, writable).

    A row holds a type's entry, then a layer's dictionary: its forms, not its nodes.  Both
    are dealt over four parts a core, as few keys would meet in too few parts.
    """
    parts = max(4 * kinds.sparkSession.sparkContext.defaultParallelism, int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind, field = F.struct("slug", "form_id", "form_title", "description").alias("k"), F.struct("slug", "ord", "name", "id", "type", "title", "writable").alias("f")
    rows = kinds.select("file", "slug", kind).unionByName(fields.select("file", "slug", field), allowMissingColumns=True)
    own = rows.repartition(parts, "file", "slug").groupBy("file", "slug").agg(F.collect_list("k").alias("k"), F.collect_list("f").alias("f")).where(F.size("k") > 0)

    def row(held: dict) -> tuple:
        return tuple(held.values())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for held in batches:
            for file, k, f in zip(held.column("file"), held.column("k"), held.column("f")):
                name, k = file.as_py(), [*map(row, k.as_py())]
                part.append((name, min(t[1] for t in k), sidecars.type_head(name), sidecars.type_text(k, [*map(row, f.as_py())])))
                size += len(part[-1][-1])
                if size > files.BATCH_BYTES or len(part) == files.BATCH_ROWS:
                    yield files.batch(part, _ENTRIES)
                    part, size = [], 0
        if part:
            yield files.batch(part, _ENTRIES)

    entries = own.select("file", "k", "f").mapInArrow(write, "file string, form_id long, head string, entry string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("form_id", "entry"))), lambda s: s["entry"]), "")
    return entries.repartition(parts, "file").groupBy("file").agg(F.concat(F.first("head"), text).alias("text"))


def result_texts(buckets: DataFrame, posted: DataFrame) -> DataFrame:
    """SK10, AG10: (file, text) of results from (file, ord, id, bucket) and (file, ord, ref, n), natively; counts follow the lists.

    One row holds a run's result, as one file does.
    """
    in_order = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", "id")))), lambda s: s["id"])
    b = buckets.groupBy("file").agg(*(in_order(F.col("bucket") == name).alias(f"_{n}") for n, name in enumerate(BUCKETS)))
    p = posted.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref", "n"))), lambda s: F.struct(s["ref"].alias("ref"), s["n"].alias("транзакций"))).alias("_3"), F.sum("n").alias("_total"))
    no_ids, no_posts = F.array().cast("array<string>"), F.array().cast("array<struct<ref:string,`транзакций`:bigint>>")
    j = b.join(p, "file", "full_outer").select("file", *(F.coalesce(f"_{n}", no_ids).alias(f"_{n}") for n in range(3)), F.coalesce(F.col("_3").cast("array<struct<ref:string,`транзакций`:bigint>>"), no_posts).alias("_3"), F.coalesce("_total", F.lit(0)).alias("_total"))
    counts = [*(F.size(f"_{n}") for n in range(3)), F.col("_total")]
    doc = F.struct(*(c.alias(name) for c, name in zip(counts, sidecars.RESULT_COUNTS)), *(F.col(f"_{n}").alias(name) for n, name in enumerate(sidecars.RESULT_LISTS)))
    return j.select("file", F.to_json(doc).alias("text"))
