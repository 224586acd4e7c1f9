"""Stored page dumps of a layer's nodes and edges (SC14, SC15, PF20).

A dump is a folder of `layer=<id>/page=<number>` folders, a page being one line of text,
a JSON array.  Pages are read by Spark's own reader, so they may lie in any store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAGE, MOST_PAGES = 50, 200


def write_pages(items: DataFrame, number: Column, folder: str, size: int = PAGE) -> None:
    """Dumps (layer, ...) items: `number` counts each layer's items from 0; a full last page is followed by an empty one."""
    fields = [c for c in items.columns if c != "layer"]
    paged = items.select("layer", F.floor(number / size).cast("int").alias("page"), (number % size).alias("_at"), F.struct(*fields).alias("item"))
    pages = paged.groupBy("layer", "page").agg(F.sort_array(F.collect_list(F.struct("_at", "item"))).alias("items"))
    pages = pages.select("layer", "page", F.transform("items", lambda i: i["item"]).alias("items"))
    last = pages.groupBy("layer").agg(F.max_by(F.struct("page", F.size("items").alias("n")), "page").alias("last"))
    ends = last.where(F.col("last.n") == size).select("layer", (F.col("last.page") + 1).alias("page"), F.lit("[]").alias("value"))
    pages.select("layer", "page", F.to_json("items").alias("value")).unionByName(ends).write.partitionBy("layer", "page").text(folder)


def scan_pages(spark: SparkSession, folder: str, columns: str, size: int = PAGE, most: int | None = MOST_PAGES) -> DataFrame:
    """(layer, ord, *columns) of every item up to each layer's first short page, in the order of the dump.

    Only the named columns are parsed.  A layer whose first `most` pages (null: all of
    its pages) are all full, or that lacks a page before its short one, is an error: a
    part of a layer must not pass for the whole.
    """
    pages = spark.read.schema("value string, layer string, page int").text(folder)
    item = f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in columns.split(','))}>>"
    pages = pages.select("layer", "page", F.json_array_length("value").alias("n"), F.from_json("value", item).alias("items"))
    within = F.lit(True) if most is None else F.col("page") < most
    end = pages.where((F.col("n") < size) & within).groupBy("layer").agg(F.min("page").alias("_end"))
    there = pages.select("layer", "page").groupBy("layer").agg(F.collect_set("page").alias("_pages"))  # few: one for each full page
    ends = there.join(end, "layer", "left")
    wrong = F.when(F.col("_end").isNull(), F.concat(F.lit("layer "), "layer", F.lit(" does not end" if most is None else f" does not end within {most} pages"))).when(F.size(F.array_except(F.sequence(F.lit(0), F.coalesce("_end", F.lit(0))), "_pages")) > 0, F.concat(F.lit("layer "), "layer", F.lit(" lacks a page")))
    ends = ends.select("layer", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("int")).otherwise(F.col("_end")).alias("_end"))
    kept = pages.join(ends, "layer").where("page <= _end")
    each = kept.select("layer", "page", F.posexplode("items").alias("_at", "item"))
    return each.select("layer", (F.col("page") * size + F.col("_at")).alias("ord"), "item.*")
