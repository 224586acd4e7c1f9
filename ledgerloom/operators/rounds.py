"""Rounds until nothing changes: each works on what is still open, and the last allowed one is the twentieth (§2.11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import lineage

MOST_ROUNDS = 20


def until_settled(open_rows: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], settled: DataFrame | None = None, most: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame, int]:
    """(settled rows with their round, rows that stay open, rounds that settled any).

    `step(open, fresh)` gives the open rows, with a boolean `done`; `fresh` is what the
    round before settled (`settled` at first), so a round joins with that alone.  It
    ends with a round that settles nothing, with nothing open, or after `most` rounds.
    """
    todo, fresh, out, n = lineage.cut(open_rows), settled, None, 0
    while n < most and todo.limit(1).count():
        moved = lineage.cut(step(todo, fresh))
        fresh = moved.where("done").drop("done")
        if not fresh.limit(1).count():
            break
        n += 1
        part = fresh.withColumn("round", F.lit(n))
        out = part if out is None else out.unionByName(part)
        todo = moved.where("NOT done").select(*open_rows.columns)
    if out is None:
        out = todo.where("false").withColumn("round", F.lit(0))
    return out, todo, n
