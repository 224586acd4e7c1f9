"""Quality gates over transaction records: shape, totals and the reading of a gap (F3).

Records are (line_no, raw) with the raw JSON line, so that an absent key and a blank
one stay different.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.operators.running import value_before

# The keys of a record and the patterns of its fields.
REQUIRED = ("transaction_date", "debit_sum", "credit_sum", "currency", "description")
OPTIONAL = ("transaction_time", "uniq_actor_field_value")
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME = r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
AMOUNT = r"^[0-9]+\.[0-9]{2}$"
CURRENCY = r"^[A-Z]{3}$"
RULES = ("keys", "transaction_date", "transaction_time", "debit_sum", "credit_sum", "one side only", "not both zero", "currency", "description", "uniq_actor_field_value")
TOTAL_WORDS = r"(?iu)\b(total|rulaj|sold|balance|closing|opening|deschidere|inchidere)\b"


def fields(records: DataFrame, raw: str = "raw") -> DataFrame:
    """The record's fields as text beside the names of its keys."""
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    return records.select("*", F.json_object_keys(raw).alias("keys"), *(get(k).alias(k) for k in (*REQUIRED, *OPTIONAL)))


def violations(records: DataFrame) -> list[tuple[str, Column]]:
    """AG06: (rule, failing condition) over fields()."""
    has = lambda k: F.array_contains("keys", k)
    bad = lambda k, pattern: ~F.coalesce(F.col(k), F.lit("")).rlike(pattern)
    n = lambda k: A.number_or_zero(F.col(k))
    allowed, required = F.array(*map(F.lit, (*REQUIRED, *OPTIONAL))), F.array(*map(F.lit, REQUIRED))
    return list(zip(RULES, (
        (F.size(F.array_except("keys", allowed)) > 0) | (F.size(F.array_except(required, "keys")) > 0),
        bad("transaction_date", DATE), has("transaction_time") & bad("transaction_time", TIME), bad("debit_sum", AMOUNT), bad("credit_sum", AMOUNT),
        (n("debit_sum") > 0) & (n("credit_sum") > 0), (n("debit_sum") == 0) & (n("credit_sum") == 0), bad("currency", CURRENCY),
        A.stripped(F.coalesce("description", F.lit(""))) == "", has("uniq_actor_field_value") & (A.stripped(F.coalesce("uniq_actor_field_value", F.lit(""))) == ""),
    ), strict=True))


def gate_one(records: DataFrame, most: int = 3) -> DataFrame:
    """One row for each rule: failing rows, the first failing line and the first `most` samples.

    The counts are one aggregation over the rows; samples are the first rows of a rule,
    of which each task sends only `most` on.
    """
    f = fields(records)
    bad = violations(f)
    counted = f.agg(*(F.struct(F.lit(r).alias("rule"), F.count_if(c).alias("n"), F.min(F.when(c, F.col("line_no"))).alias("first_line")).alias(f"r{k}") for k, (r, c) in enumerate(bad)))
    counted = counted.select(F.inline(F.array(*(F.col(f"r{k}") for k in range(len(bad))))))
    broken = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in bad)))
    each = f.select("line_no", F.left("raw", F.lit(120)).alias("raw"), F.explode(broken).alias("rule"))
    few = each.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy("line_no"))).where(F.col("_n") <= most)
    samples = few.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("line_no", "raw"))).alias("samples"))
    return counted.join(samples, "rule", "left").withColumn("samples", F.coalesce("samples", F.array().cast(samples.schema["samples"].dataType)))


def profile(records: DataFrame) -> DataFrame:
    """One row: date range and order, magnitudes, clocks, actor keys."""
    f = fields(records).withColumn("_d", F.when(F.col("transaction_date").rlike(DATE), F.col("transaction_date")))
    size = A.number_or_zero(F.col("debit_sum")) + A.number_or_zero(F.col("credit_sum"))
    key = F.nullif(A.stripped(F.col("uniq_actor_field_value")), F.lit(""))
    n = f.agg(F.count("*").alias("n"), F.min("_d").alias("first_date"), F.max("_d").alias("last_date"), F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(F.array_contains("keys", "transaction_time")).alias("n_time"), F.count(key).alias("n_actor"), F.countDistinct(key).alias("distinct_actors"), F.count_distinct("currency").alias("currencies"))
    return n


def currencies(records: DataFrame) -> DataFrame:
    """Rows of each currency, `?` where a record has none."""
    return fields(records).groupBy(F.coalesce("currency", F.lit("?")).alias("currency")).agg(F.count("*").alias("n"))


def unsorted(records: DataFrame, partition: str | None = None) -> DataFrame:
    """WN18: dates that are before the one on the line before, within each file."""
    f = fields(records)
    # Without a file column the records are those of one file.
    of = partition or ("file" if "file" in records.columns else None)
    dated = f.where(F.col("transaction_date").rlike(DATE))
    if of:
        dated = dated.withColumn("before", F.lag("transaction_date").over(Window.partitionBy(of).orderBy("line_no")))
    else:
        dated = value_before(dated, "transaction_date", [F.col("line_no")], "before")
    return dated.where("transaction_date < before")


def gate_two(records: DataFrame, want_debit=None, want_credit=None, want_count=None, currency: str | None = None) -> DataFrame:
    """AG05: one row with sums against the printed totals; null `ok` without any expectation.

    An equal excess on both sides is the sign convention, not an error.
    """
    f = fields(records)
    if currency:
        f = f.where(F.col("currency") == currency)
    big = "decimal(38,2)"
    total = lambda k: F.coalesce(F.sum(F.coalesce(F.col(k).try_cast(A.MONEY), F.lit(0).cast(A.MONEY))), F.lit(0)).cast(big)
    s = f.agg(total("debit_sum").alias("debit"), total("credit_sum").alias("credit"), F.count("*").alias("n"))
    want = lambda x: F.lit(None if x is None else str(x)).cast(big)
    s = s.withColumns({"want_debit": want(want_debit), "want_credit": want(want_credit), "want_count": F.lit(want_count).cast("long")})
    dd, dc = F.col("debit") - F.col("want_debit"), F.col("credit") - F.col("want_credit")
    s = s.withColumn("convention", F.when((dd > 0) & (F.abs(dd - dc) < 0.01), dd).cast(big))
    less = F.coalesce("convention", F.lit(0).cast(big))
    s = s.withColumns({"delta_debit": (dd - less).cast(big), "delta_credit": (dc - less).cast(big)})
    good = lambda c: F.coalesce(F.abs(F.col(c)) < 0.01, F.lit(True))
    asked = F.col("want_debit").isNotNull() | F.col("want_credit").isNotNull() | F.col("want_count").isNotNull()
    return s.withColumn("ok", F.when(asked, good("delta_debit") & good("delta_credit") & F.coalesce(F.col("n") == F.col("want_count"), F.lit(True))))


def explain_gap(records: DataFrame, side: str, delta) -> DataFrame:
    """JN20, AG07: one row that reads a gap: the first row of that amount, else its signature."""
    amount = F.col(f"{side}_sum").try_cast(A.MONEY)
    d = F.abs(F.lit(str(delta)).cast("decimal(38,2)"))
    s = fields(records).agg(F.min_by(F.struct("line_no", "description"), F.when(F.abs(amount - d) < 0.01, F.col("line_no"))).alias("row"), F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)").alias("total"))
    return s.select(F.col("row.line_no").alias("line_no"), F.when(F.col("row.line_no").isNotNull(), "one_row").otherwise(signature(d, F.col("total"))).alias("reading"))


def signature(gap: Column, total: Column) -> Column:
    """AG07: whole side, over half of it, off by a factor of 1000 or 100, or none of these."""
    off = lambda k: F.abs(gap - total * (k - 1) / k) < 0.01
    return F.when((total != 0) & (F.abs(gap - total) < 0.01), "whole_side").when((total != 0) & (gap > total * 0.5), "over_half").when((total != 0) & off(1000), "factor_1000").when((total != 0) & off(100), "factor_100").otherwise("no_single_row")


def total_lines(lines: DataFrame, pages: Column, text: str = "text", page: str = "page") -> DataFrame:
    """SC13, PF16: lines of the first two and last two pages that name a total and hold an amount."""
    return lines.where((F.col(page) <= 2) | (F.col(page) > pages - 2)).where(F.col(text).rlike(TOTAL_WORDS) & F.col(text).rlike(r"[0-9][0-9.,]*[.,][0-9]{2}"))


def any_of(conditions: list[Column]) -> Column:
    """The disjunction of conditions."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
