"""Reports as tables of lines (SK13): what a plan, a search, a posting or a batch would tell a reader.

A report is (section, at, part, line): sorted by the first three columns, its lines are
the text.  A report may be as long as the plan or the batch it tells of, so it stays a
table; `write` gives it as a folder of texts in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import names as N
from ledgerloom.operators import lineage, lookup, planning

ORDER = ("section", "at", "part")


def counted(n: Column, one: str, many: str) -> Column:
    """`3 rows`, null for none."""
    return F.when(n == 1, f"1 {one}").when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))


def _said(parts: Sequence[Column], nothing: str) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit(nothing))


def _lines(df: DataFrame, section: int, at: Column | str, *lines: Column) -> DataFrame:
    """Those of `lines` that are not null, numbered in their order."""
    shown = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return df.select(F.lit(section).alias("section"), (F.col(at) if isinstance(at, str) else at).cast("string").alias("at"), F.posexplode(shown).alias("part", "line"))


def _shown(value: Column) -> Column:
    return F.coalesce(F.nullif(N.shortened(value), F.lit("")), F.lit("none"))


def _padded(n: Column | str) -> Column:
    """A number as a text that sorts like it."""
    return F.lpad((F.col(n) if isinstance(n, str) else n).cast("string"), 19, "0")


def plan_lines(planned: DataFrame) -> DataFrame:
    """A plan: its counts; each op that writes, with every old and new value; those that hold already; the errors."""
    planned = lineage.cut(planned)  # read once for each part
    s = planning.summary(planned)
    words = (("creates", "record to create", "records to create"), ("writes", "value to write", "values to write"), ("renames", "rename", "renames"), ("describes", "description", "descriptions"), ("holes", "hole to fill", "holes to fill"), ("pictures", "picture", "pictures"), ("satisfied", "op holds already", "ops hold already"), ("errors", "error", "errors"))
    head = _lines(s, 0, F.lit(""), _said([counted(F.col(c), one, many) for c, one, many in words], "nothing to do"))
    to = lambda name: F.concat(F.lit(f"    {name}: "), N.shortened(F.col(f"new_{name}")))
    who = F.coalesce("actor_id", F.concat_ws(" ", "type", "ref"))
    kind = F.when(F.col("mark") == "*", " (new record)").when(F.col("mark") == "+", " (fills a hole)").otherwise("")
    own = [F.concat("mark", F.lit(" "), who, kind), *map(to, ("title", "description", "ref", "picture"))]
    changes = F.transform("changes", lambda c: F.concat(F.lit("    "), c["field"], F.lit(": "), _shown(c["old"]), F.lit(" -> "), _shown(c["new"])))
    body = planned.where("mark IN ('*', '+', '~')")
    shown = F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()), changes)
    acts = body.select(F.lit(1).alias("section"), _padded("n").alias("at"), F.posexplode(shown).alias("part", "line"))
    held = _lines(planned.where("mark = '>'"), 2, _padded("n"), F.concat(F.lit("> "), who))
    wrong = _lines(planned.where("mark = '!'"), 3, _padded("n"), F.concat(F.lit("! op "), "n", F.lit(": "), "error"))
    return head.unionByName(acts).unionByName(held).unionByName(wrong)


def find_lines(found: DataFrame) -> DataFrame:
    """A search: each value with the records it was found as, or titles that are like it; the counts."""
    found = lineage.cut(found)
    record = lambda r: F.concat(F.lit("    "), r["title"], F.lit("  "), F.coalesce(F.concat(F.lit("ref "), F.nullif(r["ref"], F.lit(""))), F.lit("no ref")), F.lit("  ["), r["id"].cast("string"), F.lit("]"))
    head = F.concat("value", F.when(F.col("verdict") == "FOUND", F.concat(F.lit(": found by "), "matched_by")).otherwise(": not found"))
    like = F.when((F.col("verdict") != "FOUND") & (F.size("similar") > 0), F.concat(F.lit("    like it: "), F.array_join(F.transform("similar", lambda r: r["title"]), ", ")))
    records = F.coalesce(F.when(F.col("verdict") == "FOUND", F.transform("records", record)), F.array().cast("array<string>"))
    shown = F.filter(F.concat(F.array(head), records, F.array(like)), lambda x: x.isNotNull())
    body = found.select(F.lit(0).alias("section"), F.col("value").alias("at"), F.posexplode(shown).alias("part", "line"))
    counts = lookup.tally(found)
    return body.unionByName(_lines(counts, 1, F.lit(""), F.concat("found", F.lit(" found, "), "missing", F.lit(" not found"))))


def post_lines(jobs: DataFrame, turnover: DataFrame, dry_run: bool = False) -> DataFrame:
    """A batch: each job's counts or its error, all jobs together, and the turnover and net of every currency.

    `jobs` is ledger.job_counts(), `turnover` (currency, rows, debit, credit) with several rows a currency.
    """
    jobs, what = lineage.cut(jobs), "would post" if dry_run else "posted"
    counts = lambda *also: [F.concat("records", F.lit(" rows")), F.concat(F.lit(f"{what} "), "posted"), counted(F.col("duplicate"), "was there", "were there"), counted(F.col("skipped"), "skipped", "skipped"), *also]
    across = F.when(F.col("actors") > 1, F.concat(F.lit("across "), "actors", F.lit(" actors")))
    job = F.when(F.col("error").isNotNull(), F.concat("file", F.lit(": error, "), "error")).otherwise(F.concat("file", F.lit(": "), F.concat_ws(", ", *counts(across))))
    each = _lines(jobs, 0, "file", job)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    total = jobs.agg(F.count("*").alias("jobs"), F.count("error").alias("failed"), *map(n, ("records", "posted", "duplicate", "skipped")))
    all_jobs = F.concat(_said([counted(F.col("jobs"), "job", "jobs"), counted(F.col("failed"), "failed", "failed")], "no jobs"), F.lit(": "), F.concat_ws(", ", *counts()))
    money = turnover.groupBy("currency").agg(F.sum("rows").alias("rows"), *(F.sum(c).cast("decimal(38,2)").alias(c) for c in ("debit", "credit")))
    net = (F.col("credit") - F.col("debit")).cast("decimal(38,2)")
    per = _lines(money, 2, "currency", F.concat("currency", F.lit("  debit "), "debit", F.lit("  credit "), "credit", F.lit("  net "), net, F.lit("  "), counted(F.col("rows"), "row", "rows")))
    out = each.unionByName(_lines(total, 1, F.lit(""), all_jobs)).unionByName(per)
    return out.unionByName(_lines(total, 3, F.lit(""), F.lit("nothing was written"))) if dry_run else out


def write(report: DataFrame, folder: str) -> None:
    """The lines in order: text files whose names sort as their lines do."""
    report.sort(*ORDER).select("line").write.text(folder)
