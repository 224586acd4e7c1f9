"""Recorded expectations of statements against the rows that a parser gives now (AG25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions import amounts as A


def judged(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, status, reason, n, debit, credit) of every case.

    `cases` holds name, found (is the statement there?), exit_code, and what is expected:
    count, debit, credit, null where nothing is recorded.  `rows` holds the parser's rows:
    name, debit_sum, credit_sum.  A statement that is not there is skipped; one without
    any expectation fails, for it checks nothing; sums may differ by less than 0.01.
    """
    money = lambda c: F.coalesce(F.sum(F.col(c).cast(A.MONEY)), F.lit(0)).cast("decimal(38,2)")
    sums = rows.groupBy("name").agg(F.count("*").alias("n"), money("debit_sum").alias("debit"), money("credit_sum").alias("credit"))
    c = cases.select("name", "found", "exit_code", F.col("count").alias("_count"), F.col("debit").alias("_debit"), F.col("credit").alias("_credit")).join(sums, "name", "left").fillna(0, ["n"])
    for side in ("debit", "credit"):
        c = c.withColumn(side, F.coalesce(side, F.lit(0).cast("decimal(38,2)")))
    off = lambda side: F.abs(F.col(side) - F.col(f"_{side}")) >= 0.01
    reason = (
        F.when(~F.col("found"), "not found").when(F.col("exit_code") != 0, "exit code").when(off("debit"), "debit").when(off("credit"), "credit")
        .when(F.col("n") != F.col("_count"), "count").when(F.coalesce("_count", "_debit", "_credit").isNull(), "nothing expected")
    )
    status = F.when(~F.col("found"), "SKIP").when(F.col("reason").isNotNull(), "FAIL").otherwise("PASS")
    return c.withColumn("reason", reason).select("name", status.alias("status"), "reason", "n", "debit", "credit")


def tally(verdicts: DataFrame) -> DataFrame:
    """One row: cases passed, failed and skipped, and whether the suite holds: none failed and one passed at least."""
    t = verdicts.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIP", "skipped"))))
    return t.withColumn("holds", (F.col("failed") == 0) & (F.col("passed") > 0))
