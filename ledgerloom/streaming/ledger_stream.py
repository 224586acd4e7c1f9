"""Replay-safe streaming posting: whole files are judged in keyed state, references are remembered in keyed state.

A batch costs what its own lines cost: no batch reads the sink.  The state store holds
the pending lines of files that are not complete and one row for each reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ledgerloom.operators import ledger
from ledgerloom.streaming.state import rocks_state

LINE = "file string, line_no long, raw string"


class WholeFile(StatefulProcessor):
    """LP01 on a stream: the lines of a file come out together once all are there, and only if none of them is bad.

    Without a count of its lines (`counted`) a file is whole in its batch.
    """

    def __init__(self, counted: bool):
        self.counted = counted

    def init(self, handle) -> None:
        self.lines = handle.getListState("lines", "line_no long, raw string")
        self.judged = handle.getValueState("judged", "bad boolean, ended boolean, seen long, lines long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bad, ended, seen, of = self.judged.get() if self.judged.exists() else (False, False, 0, None)
        fresh: list[tuple] = []
        for frame in rows:
            bad = bad or bool(frame["fatal"].notna().any())
            told = frame["of_lines"].max()
            of = int(told) if told == told and told is not None else of
            seen += len(frame)
            if not bad:  # of a bad file nothing is held
                fresh += [(int(n), r if p else None) for n, r, p in zip(frame["line_no"], frame["raw"], frame["posts"])]
        whole = ended or not self.counted
        if bad:
            self.lines.clear()
        elif not whole:
            self.lines.appendList(fresh)
            if of is not None and seen >= of:
                # A line that came twice counts once.
                held = dict(self.lines.get())
                whole, fresh = len(held) >= of, list(held.items())
                self.lines.put(fresh) if not whole else self.lines.clear()
                seen = len(held)
        if whole and not bad:
            for i in range(0, len(fresh), 10_000):
                part = [x for x in fresh[i : i + 10_000] if x[1] is not None]
                yield pd.DataFrame({"file": key[0], "line_no": [x[0] for x in part], "raw": [x[1] for x in part]})
        if self.counted:
            self.judged.update((bad, whole, seen, of))

    def close(self) -> None:
        pass


def gated(lines: DataFrame, options: ledger.PostOptions) -> DataFrame:
    """(file, line_no, raw) of a stream's sound files.

    `lines` may have `of_lines`, the number of a file's lines, on one of them at least;
    then the lines may come in any batches and any order.  A file that lacks lines stays
    in the state and posts nothing; one with a bad line never does.  Lines that come
    once a file is whole are posted if they are sound.
    """
    counted = "of_lines" in lines.columns
    rows = ledger.resolved(lines, options)
    of = F.col("of_lines").cast("long") if counted else F.lit(None).cast("long")
    rows = rows.select("file", "line_no", "raw", F.when(F.col("raw") != "", F.col("fatal")).alias("fatal"), of.alias("of_lines"), ((F.col("raw") != "") & F.col("skipped").isNull()).alias("posts"))
    return rows.groupBy("file").transformWithStateInPandas(WholeFile(counted), LINE, "Append", "None")


def posted(lines: DataFrame, options: ledger.PostOptions) -> DataFrame:
    """SK06: the entries of a stream of (file, line_no, raw[, of_lines]) lines, each reference once for all time."""
    if options.dry_run:
        raise ValueError("a dry run posts nothing: read ledger.posting() over the lines instead")
    return ledger.entries(ledger.resolved(gated(lines, options), options), options).dropDuplicates(["ref"])


def post_stream(lines: DataFrame, options: ledger.PostOptions, sink: str, checkpoint: str) -> StreamingQuery:
    """Posts a stream of lines; a line that comes again, in this run or a later one, adds nothing.

    Each micro-batch overwrites its own folder of the sink (`batch=<number>`), so one
    that is run again after a failure between its write and its commit leaves the same rows.
    """
    new = posted(lines, options)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with rocks_state(lines.sparkSession):
        return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
