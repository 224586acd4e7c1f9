"""A kept suffix index of a layer's paths, updated by the nodes that changed (GR05, GR06, JN08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions import names as N
from ledgerloom.sources.snapshots import Versions


class PathIndex:
    """Versions of changes: each holds the nodes whose path is new, moved or gone, with all suffixes of the path."""

    def __init__(self, store: Versions):
        self.store = store

    def _changes(self) -> DataFrame:
        parts = [self.store.read("changes", v).withColumn("version", F.lit(v)) for v in range(self.store.latest() + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def paths(self) -> DataFrame:
        """(layer, id, path) of the nodes that are there: of each node its newest change."""
        newest = F.row_number().over(Window.partitionBy("layer", "id").orderBy(F.desc("version")))
        return self._changes().withColumn("_n", newest).where("_n = 1 AND path IS NOT NULL").select("layer", "id", "path")

    def update(self, tree: DataFrame) -> int:
        """Brings the index up to `tree` (layer, id, path): writes the nodes that differ, and no others; their number is returned."""
        base = self.store.latest()
        now = tree.select("layer", "id", "path")
        if base < 0:
            changed = now
        else:
            before = self.paths().withColumnRenamed("path", "_old")
            changed = now.join(before, ["layer", "id"], "full_outer").where("NOT path <=> _old").select("layer", "id", "path")
        suffixes = F.when(F.col("path").isNotNull(), N.suffixes(F.col("path")))
        version = self.store.commit(base, changes=changed.withColumn("suffixes", suffixes))
        return self.store.read("changes", version).count()

    def resolve(self, addresses: DataFrame) -> DataFrame:
        """As graph.resolve_addresses(): exact or suffix hits of (layer, addr), then without discriminators."""
        newest = F.row_number().over(Window.partitionBy("layer", "id").orderBy(F.desc("version")))
        kept = self._changes().withColumn("_n", newest).where("_n = 1 AND path IS NOT NULL")
        asked = addresses.select("layer", "addr").distinct()

        def hits(suffixes, wanted: DataFrame) -> DataFrame:
            posted = kept.select("layer", "id", "path", F.explode(suffixes).alias("addr"))
            return wanted.join(posted, ["layer", "addr"]).groupBy("layer", "addr").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("path").alias("path"))

        first = hits(F.col("suffixes"), asked)
        second = hits(F.transform("suffixes", N.without_discriminators), asked.join(first, ["layer", "addr"], "left_anti"))
        one = F.col("n") == 1
        found = first.unionByName(second)
        return asked.join(found, ["layer", "addr"], "left").select("layer", "addr", F.when(one, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("verdict"), F.when(one, F.col("id")).alias("id"), F.when(one, F.col("path")).alias("path"))
