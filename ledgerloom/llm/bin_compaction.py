"""Executed bin-packed compaction: small files of a day are packed into groups, and each group is rewritten as one file.

1.  write_lots(): rows are dealt to (day, lot, piece), one sorted file each, under
    `day=/lot=/piece=` folders.  The number of lots of a day follows its rows.
2.  packing(): applyInPandas per day.  Small files, largest first, go to the first
    group that has room: a segment tree over the groups in the order they were opened
    holds the largest room below each node, and a descent that prefers the left finds
    the group in log(files) steps.  A day has at most 4 * (1 + LOTS) files, whatever
    the number of rows.
3.  rewrite(): the rows of groups of several join the plan by their file, are dealt
    by group, sorted by the joining ordinal and their position in their file, and
    written as one file a group to a staging folder.
4.  swap(): the replaced files go, the new ones take their place; the plan and staged
    files lie beside the table, so a driver that dies in between repeats this step.
    The driver handles one path a file: their number follows the days, not the rows.
5.  report(): reads the final folder; a task streams the rows of each file in order.

Files of at least SMALL rows, and files that found no partner, are never touched.

Edge cases: a null time makes a day of its own (null in the report); a null id counts
as the empty text, for the hash and for the digest; rows equal in time and id are in
the order of their other columns; repeated rows are kept; values that are null, NaN or
infinite count 0 cents; an empty table gives no files and no rows; columns named day,
lot or piece stay columns of the files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import AtomicType, IntegerType, LongType, StructField, StructType

from ledgerloom.llm import shared

LOTS, SMALL, FULL = 150, 600, 500
#: Tables of at most so many rows of a few numbers are broadcast; larger ones are joined by Spark's choice.
BROADCAST_ROWS = 100_000
NO_DAY = -(2**31)
PLAN = "day int, lot long, piece long, n long, path string, grp int, place int, members int, first_lot long, first_piece long, sources string"


def share(rows: int, parts: int) -> int:
    """One more than rows / parts, rounded down: the measure that lots, small files and groups follow."""
    return 1 + rows // parts


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Compaction:
    """A table folder, the work folder beside it and the sizes that the packing follows."""

    def __init__(self, rows: DataFrame, time: str, row_id: str, folder: str | None = None, lots: int = LOTS, small: int = SMALL, full: int = FULL):
        self.spark, self.columns, self.time, self.row_id = rows.sparkSession, rows.columns, time, row_id
        self.folder = folder or f"{shared.folder(self.spark)}/ledgerloom-compacted-{uuid.uuid4().hex}"
        self.work = f"{self.folder}-work"
        self.rows, self.lots, self.small, self.full = rows, lots, small, full
        self.day, self.lot, self.piece = (shared.fresh(rows, c) for c in ("day", "lot", "piece"))
        self.keys = [self.day, self.lot, self.piece]
        self.own = {c: shared.fresh(rows, f"_{c}") for c in ("file_path", "row_index", "rows")}
        self.schema = StructType([*rows.schema, StructField(self.day, IntegerType()), StructField(self.lot, LongType()), StructField(self.piece, LongType())])

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.work}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.work}/{name}")

    def _stored(self, *fields: str) -> DataFrame:
        """The rows of the table folder, with fields of the reader's metadata."""
        df = self.spark.read.schema(self.schema).parquet(self.folder)
        meta = df.metadataColumn("_metadata")
        return df.select(*map(shared._named, df.columns), *(meta[f].alias(self.own[f]) for f in fields))

    def _partitioned(self, df: DataFrame, path: str) -> None:
        df.write.option("maxRecordsPerFile", 0).partitionBy(*self.keys).parquet(path)

    def write_lots(self) -> None:
        """One sorted file for each (day, lot, piece) with rows.

        The number of tasks is given, so that small files are not all left to one task.
        """
        time, row_id = shared._named(self.time), shared._named(self.row_id)
        day = F.coalesce(F.unix_date(time.cast("date")), F.lit(NO_DAY))
        days = self._table(self.rows.groupBy(day.alias(self.day)).agg(F.count("*").alias(self.own["rows"])), "days")
        number, self.total = days.agg(F.count("*"), F.coalesce(F.sum(self.own["rows"]), F.lit(0))).first()
        h = F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary"))
        lots = F.expr(f"1 + {self.own['rows']} div {share(self.total, self.lots)}")
        dealt = self.rows.select(*map(shared._named, self.columns), day.alias(self.day)).join(_small(days, number), self.day)
        dealt = dealt.select(*map(shared._named, self.columns), self.day, (F.floor(h / 16) % lots).cast("long").alias(self.lot), F.least(h % 4, F.floor(h / 4) % 4).cast("long").alias(self.piece))
        ties = [shared._named(f.name) for f in self.rows.schema if isinstance(f.dataType, AtomicType) and f.name not in (self.time, self.row_id)]
        self._partitioned(dealt.repartition(shared.partitions(self.spark), *self.keys).sortWithinPartitions(*self.keys, time, row_id, *ties), self.folder)

    def packing(self) -> DataFrame:
        """The plan, written: every file with its group, place, and what the group's file is named by."""
        small, full = share(self.total, self.small), share(self.total, self.full)
        files = self._stored("file_path").groupBy(*(F.col(k).alias(a) for k, a in zip(self.keys, ("day", "lot", "piece")))).agg(F.count("*").alias("n"), F.min(self.own["file_path"]).alias("path"))
        self.plan = self._table(files.groupBy("day").applyInPandas(lambda f: packed(f, small, full), PLAN), "plan")
        self.files = self.plan.count()
        return self.plan

    def rewrite(self) -> None:
        """One staged file for each group of several."""
        keys = ("day", "lot", "piece")
        # The plan's columns take names that no column of the table has.
        into = {c: shared.fresh(self.rows, f"_{c}_of_plan") for c in (*keys, "grp", "place", "first_lot", "first_piece")}
        plan = self.plan.where("members > 1").select(*(F.col(c).alias(a) for c, a in into.items()))
        stored = self._stored("row_index")
        on = [shared._named(k) == F.col(into[c]) for k, c in zip(self.keys, keys)]
        moved = stored.join(_small(plan, self.files), on)
        position = F.col(self.own["row_index"])
        target = [F.col(into["day"]).alias(self.day), F.col(into["first_lot"]).alias(self.lot), F.col(into["first_piece"]).alias(self.piece)]
        place = F.col(into["place"])
        moved = moved.select(*map(shared._named, self.columns), *target, place, position, F.col(into["grp"]))
        dealt = moved.repartition(shared.partitions(self.spark), self.day, into["grp"]).sortWithinPartitions(*self.keys, place, position)
        self._partitioned(dealt.select(*map(shared._named, self.columns), *self.keys), f"{self.work}/merged")

    def swap(self) -> None:
        """Puts each staged file in the place of its group's files; a group that has no staged file any more is done."""
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path_of(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        of = lambda day, lot, piece: f"{self.day}={day}/{self.lot}={lot}/{self.piece}={piece}"
        groups = self.plan.where("members > 1").groupBy("day", "first_lot", "first_piece").agg(F.collect_list(F.struct("lot", "piece")).alias("files"))
        for r in groups.toLocalIterator():
            target = of(r["day"], r["first_lot"], r["first_piece"])
            staged = path_of(f"{self.work}/merged/{target}")
            if not fs.exists(staged):
                continue
            for lot, piece in r["files"]:
                fs.delete(path_of(f"{self.folder}/{of(r['day'], lot, piece)}"), True)
            if not fs.rename(staged, path_of(f"{self.folder}/{target}")):
                raise OSError(f"could not move {staged.toString()}")

    def report(self, value: str) -> DataFrame:
        """One row for each final file, from its rows in order."""
        names = self.spark.read.option("recursiveFileLookup", "true").parquet(self.folder).columns if self.files else self.columns
        amount = shared._named(value).cast("double")
        cents = F.when(F.abs(amount) < float("inf"), F.floor(amount * 100 + 0.5))
        keys = [shared._named(k).alias(a) for k, a in zip(self.keys, ("day", "lot", "piece"))]
        each = self._stored("file_path", "row_index").select(*keys, F.col(self.own["file_path"]).alias("path"), F.col(self.own["row_index"]).alias("at"), shared._named(self.row_id).cast("long").alias("id"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents"))
        ordered = each.repartition("path").sortWithinPartitions("path", "at")
        digests = ordered.mapInArrow(shared.lean(_digests), "day int, lot long, piece long, path string, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string")
        plan = self.plan.where("place = 0").select("day", "lot", "piece", "sources", (F.col("members") > 1).alias("rewritten"))
        out = digests.join(_small(plan, self.files), ["day", "lot", "piece"])
        day = F.when(F.col("day") != NO_DAY, F.col("day").cast("long"))
        return out.select(day.alias("day"), "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", F.lit(",".join(names)).alias("columns"), "path", "rewritten")

    def run(self) -> None:
        """All steps up to the final folder; the plan stays beside it."""
        self.write_lots()
        self.packing()
        self.rewrite()
        self.swap()


class Rooms:
    """The largest room below each node of a segment tree over groups in opening order; unopened groups are all room."""

    def __init__(self, most: int, capacity: int):
        self.width = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.width)

    def take(self, size: int) -> int:
        """The first group with room for `size`, which takes it."""
        at = 1
        while at < self.width:
            at *= 2
            if self.room[at] < size:
                at += 1
        self.room[at] -= size
        group = at - self.width
        while at > 1:
            at //= 2
            self.room[at] = max(self.room[2 * at], self.room[2 * at + 1])
        return group


def packed(files: pd.DataFrame, small: int, full: int) -> pd.DataFrame:
    """The groups of one day's files (day, lot, piece, n, path)."""
    files = files.sort_values(["n", "lot", "piece"], ascending=[False, True, True], ignore_index=True)
    fits = ((files.n < small) & (files.n <= full)).to_numpy()
    rooms = Rooms(int(fits.sum()), full)
    group, alone = [], len(files)
    for n, fit in zip(files.n.tolist(), fits.tolist()):
        if fit:
            group.append(rooms.take(n))
        else:  # a group of its own, numbered after all others
            group.append(alone)
            alone += 1
    files["grp"] = np.array(group, np.int32)
    by = files.groupby("grp", sort=False)
    files["place"] = by.cumcount().astype(np.int32)
    files["members"] = by["n"].transform("size").astype(np.int32)
    files["first_lot"], files["first_piece"] = by["lot"].transform("first"), by["piece"].transform("first")
    names = files.lot.astype(str) + "-" + files.piece.astype(str)
    files["sources"] = names.groupby(files.grp).transform(",".join)
    return files[["day", "lot", "piece", "n", "path", "grp", "place", "members", "first_lot", "first_piece", "sources"]]


_OUT = ("day", "lot", "piece", "path", "n_rows", "min_click_id", "max_click_id", "cents", "ids_sha256")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by file and position: one row a file, whatever its length."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        n, low, high, cents, sha = state
        row = (*key, n, low, high, cents if -(1 << 63) <= cents < 1 << 63 else None, sha.hexdigest())
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], list(_OUT))

    for batch in batches:
        paths = batch.column("path").to_pylist()
        cuts = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            mine = tuple(batch.column(c)[a].as_py() for c in ("day", "lot", "piece", "path"))
            if mine != key:
                if key is not None:
                    yield done()
                key, state = mine, [0, None, None, 0, hashlib.sha256()]
            ids = batch.column("id").slice(a, b - a).to_pylist()
            some = [i for i in ids if i is not None]
            state[4].update(("," * (state[0] > 0) + ",".join("" if i is None else str(i) for i in ids)).encode())
            if some:
                state[1] = min([*some, *[state[1]] * (state[1] is not None)])
                state[2] = max([*some, *[state[2]] * (state[2] is not None)])
            state[0] += b - a
            state[3] += sum(batch.column("cents").slice(a, b - a).to_pylist())
    if key is not None:
        yield done()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the files of clicks after their compaction in a new folder, which stays."""
    job = Compaction(spark.read.parquet(f"{sf_dir}/clicks.parquet"), "arrived_at", "click_id")
    job.run()
    return job.report("value")
