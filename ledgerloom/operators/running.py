"""Running values over a whole table's order in two passes, without a stage of one task (TK06, WN14, WN18).

The rows are dealt into ranges of the order and written; each range is summed up in one
row; what stands before a range is then added to the running value within it.  Only
one row a range comes to the driver, whatever the number of rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators import lineage

PART = "_range"


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with the number of their range; equal keys are in one range."""
    return lineage.cut(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def _before(spark, kind: str, rows: list[tuple]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, f"{PART} int, _before {kind}"))


def running_sum(df: DataFrame, value: Column, order: list[Column], out: str) -> DataFrame:
    """`df` with `out`: the sum of `value` over all rows up to this one and those equal to it in order."""
    dealt = _ranges(df.withColumn(out, value.cast("long")), order)
    total, rows = 0, []
    for r in sorted(dealt.groupBy(PART).agg(F.coalesce(F.sum(out), F.lit(0)).alias("s")).collect()):  # a row a range
        rows.append((r[PART], total))
        total += r["s"]
    within = F.sum(out).over(Window.partitionBy(PART).orderBy(*order))
    return dealt.withColumn(out, within).join(_before(df.sparkSession, "long", rows), PART, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.col("_before")).drop(PART, "_before")


def running_sums(df: DataFrame, values: dict[str, Column], order: list[Column]) -> DataFrame:
    """`df` with the sum of each of `values`, none of them null, over the rows before in the order and this one.

    The sums of rows that are equal in order differ by Spark's choice of which is first.
    """
    dealt = _ranges(df.withColumns(values), order)
    each = dealt.groupBy(PART).agg(*(F.sum(n).alias(n) for n in values))
    total, rows = [0] * len(values), []
    for r in sorted(each.collect()):  # a row a range
        rows.append((r[PART], *total))
        total = [t + s for t, s in zip(total, r[1:])]
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = ", ".join(f"_{n} {each.schema[n].dataType.simpleString()}" for n in values)
    before = F.broadcast(df.sparkSession.createDataFrame([(p, *(Decimal(t) if "decimal" in each.schema[n].dataType.simpleString() else t for n, t in zip(values, ts))) for p, *ts in rows], f"{PART} int, {kinds}"))
    summed = dealt.withColumns({n: F.sum(n).over(within) for n in values}).join(before, PART)
    return summed.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop(PART, *(f"_{n}" for n in values))


def value_before(df: DataFrame, value: str, order: list[Column], out: str) -> DataFrame:
    """`df` with `out`: `value` of the row before in the order, null on the first row.

    Rows that are equal in order stand in an order of Spark's choice: make it total.
    """
    dealt = _ranges(df, order)
    kind = df.schema[value].dataType.simpleString()
    descending = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    last, rows = None, []
    for r in sorted(dealt.groupBy(PART).agg(descending.alias("s")).collect(), key=lambda r: r[PART]):  # a row a range
        rows.append((r[PART], last))
        last = r["s"]["v"]
    w = Window.partitionBy(PART).orderBy(*order)
    own = dealt.withColumns({"_first": F.row_number().over(w) == 1, out: F.lag(value).over(w)})
    joined = own.join(_before(df.sparkSession, kind, rows), PART, "left")
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(out))).drop(PART, "_before", "_first")
