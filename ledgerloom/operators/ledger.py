"""Ledger posting: lines to resolved, two-sided, idempotent entries and turnover (F4).

One pass over the lines, one join to the actors and one aggregation; accounts and
actors are joined, never looked up row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import amounts as A, names as N
from ledgerloom.operators import lineage

MOST_LINE_BYTES = 1 << 20
SIDES = ("debit", "credit")


@dataclass(frozen=True)
class PostOptions:
    """How a statement is posted; actor_field and actor_type go together."""

    account_name: str
    actor_id: str = ""
    actor_field: str = ""
    actor_type: str = ""
    default_currency: str = ""
    timezone: str = "UTC"
    ref_prefix: str = "stmt"
    group_id: int = 0
    dry_run: bool = False

    def validate(self) -> None:
        if not self.account_name.strip():
            raise ValueError("no account name")
        if bool(self.actor_field.strip()) != bool(self.actor_type.strip()):
            raise ValueError("actor_field and actor_type go together")
        if not self.actor_id.strip() and not self.actor_field.strip():
            raise ValueError("no actor: an actor_id, or actor_field with actor_type")


def records(lines: DataFrame) -> DataFrame:
    """SC01: (file, line_no, raw) to the fields of a record, each as text; blank lines go, bad ones carry an error.

    A JSON zero, false, null or empty value is blank, as are absent keys.
    """
    keys = {"transaction_date": "date", "transaction_time": "time", "debit_sum": "debit", "credit_sum": "credit", "currency": "currency", "description": "description", "uniq_actor_field_value": "key"}
    marked = ["of_lines"] if "of_lines" in lines.columns else []  # in a stream blank lines stay, to be counted
    got = lines.select("file", "line_no", A.stripped(F.coalesce("raw", F.lit(""))).alias("raw"), *marked)
    got = got if marked else got.where("raw <> ''")
    read = got.select("*", F.json_tuple("raw", *keys).alias(*keys.values()))
    error = F.when(F.octet_length("raw") > MOST_LINE_BYTES, "line too long").when(F.try_parse_json("raw").isNull(), "not JSON")

    def text(key: str, name: str) -> Column:
        zero = F.col(name).isin("0", "false", "0.0") & ~F.col("raw").rlike(f'"{key}"\\s*:\\s*"')
        return F.when(zero, "").otherwise(F.coalesce(name, F.lit("")))

    own = {name: text(key, name) for key, name in keys.items()} | {"key": A.stripped(text("uniq_actor_field_value", "key"))}
    return read.select("file", "line_no", "raw", *marked, error.alias("error"), *(c.alias(name) for name, c in own.items()))


def resolve_keys(keys: DataFrame, values: DataFrame, field_id: str) -> DataFrame:
    """JN05, WN12: (key, actor_id): the value as printed, then normalised; of several actors the latest created.

    `values` is (actor_id, field_id, value, created_at, listing).  Ranked by a window on the
    distinct keys, so a key with many rows is looked up once.
    """
    tries = keys.select("key").where("key <> ''").distinct().select("key", F.posexplode(N.candidates(F.col("key"))).alias("rank", "value"))
    hits = tries.join(values.where(F.col("field_id") == field_id).select("actor_id", "value", "created_at", "listing"), "value")
    best = Window.partitionBy("key").orderBy("rank", F.desc("created_at"), "listing", "actor_id")
    return hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("key", "actor_id")


def account_id(actor: Column, account: str, currency: Column, side: Column | str) -> Column:
    """LP03: the id of one side of an actor's account pair; the same names give the same id."""
    return F.left(F.sha1(F.concat_ws("|", actor, F.lit(account), currency, F.lit(side) if isinstance(side, str) else side)), F.lit(32))


def resolved(lines: DataFrame, options: PostOptions, values: DataFrame | None = None, field_id: str = "") -> DataFrame:
    """LP01: one row for each record with actor, currency, amounts, instant, and why it is skipped or fatal."""
    options.validate()
    r = records(lines)
    if options.actor_field and values is not None:
        found = resolve_keys(r, values, field_id or options.actor_field).withColumnsRenamed({"actor_id": "_found", "key": "_key"})
        # Rows without a key find none; they are looked up by texts of their own, so that they don't all meet in one task.
        own = F.when(F.col("key") == "", F.concat_ws("\0", F.lit(""), "file", "line_no")).otherwise(F.col("key"))
        r = r.withColumn("_own", own).join(found, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")
    else:
        r = r.withColumn("_found", F.lit(None).cast("string"))
    default = F.nullif(F.lit(options.actor_id.strip()), F.lit(""))
    # A key that fails is skipped; only a row without a key falls back to the default actor.
    actor = F.when(F.col("key") != "", F.col("_found")).otherwise(default)
    skipped = F.when((F.col("key") != "") & F.lit(not options.actor_field), "key without actor_field").when((F.col("key") != "") & F.col("_found").isNull(), "no actor has the key").when((F.col("key") == "") & default.isNull(), "no key and no default actor")
    r = r.withColumns({"actor_id": actor, "skipped": skipped, "currency": A.currency_or_default(F.col("currency"), options.default_currency), "debit_amount": A.ledger_amount(F.col("debit")), "credit_amount": A.ledger_amount(F.col("credit")), "occurred_ms": A.occurred_ms(F.col("date"), F.col("time"), options.timezone)})
    fatal = F.coalesce("error", F.when(F.col("skipped").isNull(), F.when(F.col("debit_amount").isNull(), "debit_sum").when(F.col("credit_amount").isNull(), "credit_sum").when(F.col("occurred_ms").isNull(), "transaction_date")))
    return r.withColumn("fatal", fatal).drop("_found", "error")


def failed_files(rows: DataFrame) -> DataFrame:
    """(file, error): a file with one bad row posts nothing (LP01), and other files go on (LP02)."""
    return rows.where("fatal IS NOT NULL").groupBy("file").agg(F.min_by(F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("fatal")), "line_no").alias("error"))


def good_rows(rows: DataFrame) -> DataFrame:
    """Rows of files without a fatal row that found their actor; the rows are read once for both."""
    rows = lineage.cut(rows)
    bad = rows.where("fatal IS NOT NULL").select("file").distinct()
    return rows.join(bad, "file", "left_anti").where("skipped IS NULL")


def turnover(rows: DataFrame) -> DataFrame:
    """AG01: rows and sums of every (actor, currency); every resolved row counts, duplicates too."""
    return rows.groupBy("actor_id", "currency").agg(F.count("*").alias("rows"), F.sum("debit_amount").cast("decimal(38,2)").alias("debit"), F.sum("credit_amount").cast("decimal(38,2)").alias("credit"))


def entries(rows: DataFrame, options: PostOptions) -> DataFrame:
    """The two sides of every row whose amount is not zero, each with its reference."""
    account = N.pair_name(options.account_name, options.group_id)
    both = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_amount").alias("amount")) for s in SIDES))
    e = rows.select("*", F.explode(both).alias("_e")).where("_e.amount <> 0")
    side = F.col("_e.side")
    return e.select("file", "line_no", "actor_id", "currency", side.alias("side"), account_id(F.col("actor_id"), account, F.col("currency"), side).alias("account_id"), F.col("_e.amount").alias("amount"), N.ref_of(options.ref_prefix or "stmt", F.col("raw"), side).alias("ref"), N.comment(F.col("date"), F.col("time"), F.col("description")).alias("comment"), "occurred_ms")


def outcomes(new: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """SK06: `new` with outcome posted or duplicate: one of each reference is posted, none that is there already."""
    first = Window.partitionBy("ref").orderBy("file", "line_no", "side")
    n = new.withColumn("_n", F.row_number().over(first))
    if posted is None:
        return n.withColumn("outcome", F.when(F.col("_n") == 1, "posted").otherwise("duplicate")).drop("_n")
    there = posted.select(F.col("ref").alias("_ref")).distinct()
    return n.join(there, n.ref == there._ref, "left").withColumn("outcome", F.when((F.col("_n") == 1) & F.col("_ref").isNull(), "posted").otherwise("duplicate")).drop("_n", "_ref")


def posting(rows: DataFrame, options: PostOptions, posted: DataFrame | None = None) -> DataFrame:
    """LP01, LP04: every entry with its outcome: posted or duplicate, or `would post` for every one of a dry run.

    A dry run counts the sides that are not zero and posts nothing.
    """
    new = entries(good_rows(rows), options)
    return new.withColumn("outcome", F.lit("would post")) if options.dry_run else outcomes(new, posted)


def job_counts(rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """(file, records, posted, duplicate, skipped, actors, error) of every job; a failed one has only its error."""
    rows = lineage.cut(rows)
    failed = failed_files(rows)
    read = rows.groupBy("file").agg(F.count("*").alias("records"), F.count("skipped").alias("skipped"))
    done = outcome.groupBy("file").agg(F.count_if(F.col("outcome").isin("posted", "would post")).alias("posted"), F.count_if(F.col("outcome") == "duplicate").alias("duplicate"))
    actors = rows.where("skipped IS NULL").groupBy("file").agg(F.countDistinct("actor_id").alias("actors"))
    j = read.join(failed, "file", "left").join(done, "file", "left").join(actors, "file", "left")
    if_good = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).alias(c)
    return j.select("file", *map(if_good, ("records", "posted", "duplicate", "skipped", "actors")), "error").orderBy("file")


def batch_counts(rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """AG02, AG24, ST01: one row: jobs, failed jobs, records, posted, duplicate, skipped, and actors counted once over all jobs."""
    rows = lineage.cut(rows)
    per = job_counts(rows, outcome)
    sums = per.agg(F.count("*").alias("jobs"), F.count("error").alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "posted", "duplicate", "skipped")))
    return sums.crossJoin(good_rows(rows).agg(F.countDistinct("actor_id").alias("actors")))


def batch_totals(tally: DataFrame) -> DataFrame:
    """AG02, TK01: per (file, actor, currency), per currency and overall, from one grouping-sets aggregation, by currency and actor."""
    sets = [["file", "actor_id", "currency"], ["currency"], []]
    total = lambda c: F.sum(c).cast("decimal(38,2)").alias(c)
    return tally.groupingSets([[F.col(c) for c in g] for g in sets], "file", "actor_id", "currency").agg(F.sum("rows").alias("rows"), total("debit"), total("credit")).orderBy("currency", "actor_id", "file")


def sides(accounts: DataFrame) -> DataFrame:
    """JN18: account rows to one (actor, name, currency) row with its debit and credit ids, by kind and not by place."""
    return accounts.groupBy("actor_id", "name_id", "currency_id").pivot("income_type", list(SIDES)).agg(F.max_by("id", "ord"))
