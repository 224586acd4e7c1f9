"""Statement rows to transactions: band claims, islands, carried dates, folded continuations (F1).

Rows are (file, page, row_no, cells array<struct<text,x0,x1>>).  Everything is ordered
within a file only, so every window is partitioned by file; a file is a statement and
stays in one task, files spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import amounts as A

Band = tuple[float, float]


def col(i: int) -> Band:
    """The band of one table column."""
    return (i, i)


def cols(a: int, b: int) -> Band:
    """The band of several table columns."""
    return (a, b)


@dataclass(frozen=True)
class ColumnSpec:
    """Where a statement keeps what; callables take and give Columns (post: DataFrames)."""

    debit: Band | None = None
    credit: Band | None = None
    amount: Band | None = None
    balance: Band | None = None
    ignore: Sequence[Band] = ()
    amount_sign: str = "negative_is_debit"
    sign_band: Band | None = None
    sign_re_debit: str | None = None
    sign_re_credit: str | None = None
    allow_both_sides: bool = False
    require_decimals: bool = True
    currency: Band | None = None
    currency_default: str | None = None
    currency_re: str = r"^[A-Za-z]{3}$|^[€$£₴₽]$"
    actor: Band | None = None
    description: Band = (0.0, 1e9)
    date: Band | None = None
    desc_join: str = " "
    numbers: str = "auto"
    date_re: str = r"([0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4})"
    date_order: str = "dmy"
    date_carry: bool = True
    time_re: str | None = None
    start_re: str | None = None
    stop_re: str | None = None
    start_per_page: bool = False
    skip_rows: Sequence[str] = ()
    skip_re: str | None = None
    row_start: str = "amount"
    y_tolerance: float = 2.0
    space_thousands: bool = True
    header_rows: int = 0
    delimiter: str | None = None
    encoding: str = "utf-8-sig"
    sheet: str | None = None
    cell_map: Callable[[Column], Column] | None = None
    row_filter: Callable[[Column], Column] | None = None
    post: Callable[[DataFrame], DataFrame] | None = None
    expect_debit_total: str | None = None
    expect_credit_total: str | None = None
    expect_count: int | None = None
    strict_bands: bool = True

    def validate(self) -> None:
        """PF21: what a spec must and must not declare."""
        if not (self.debit or self.credit or self.amount):
            raise ValueError("declare debit and credit bands, or one signed amount band")
        if self.amount and (self.debit or self.credit):
            raise ValueError("an amount band excludes debit and credit bands")
        if (self.sign_re_debit or self.sign_re_credit) and not self.amount:
            raise ValueError("a marker column needs an amount band")
        if self.row_start not in ("amount", "date", "date_and_amount"):
            raise ValueError("row_start is amount, date or date_and_amount")
        if not 0.3 <= self.y_tolerance <= 6.0:
            raise ValueError("y_tolerance is 0.3 to 6.0")


def inside(band: Band | None, x: Column) -> Column:
    """PF01: inclusive; no band holds nothing."""
    return F.lit(False) if band is None else x.between(band[0], band[1])


def _texts(cells: Column, keep: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(cells, keep), lambda c: c["text"])


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def styles(rows: DataFrame, spec: ColumnSpec) -> DataFrame:
    """AG12, AG13: (file, style, us, eu, n) by a vote over the first 200 banded money tokens; a tie is an error."""
    banded = lambda c: A.stripped(c["text"]).rlike(A.MONEY_SHAPE) & (inside(spec.debit, c["x1"]) | inside(spec.credit, c["x1"]) | inside(spec.amount, c["x1"]))
    got = rows.select("file", "row_no", _texts(F.col("cells"), banded).alias("t"))
    before = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("seen", F.coalesce(F.sum(F.size("t")).over(before), F.lit(0))).where("seen < 200").select("file", F.explode_outer("t").alias("t"))
    votes = got.groupBy("file").agg(F.count_if(A.cleaned(F.col("t")).rlike(A.US)).alias("us"), F.count_if(A.cleaned(F.col("t")).rlike(A.EU)).alias("eu"), F.count("t").alias("n"))
    tie = F.raise_error(F.concat(F.lit("cannot tell us from eu numbers in "), F.col("file")))
    return votes.withColumn("style", F.when((F.col("n") == 0) | (F.col("us") > F.col("eu")), "us").when(F.col("us") < F.col("eu"), "eu").otherwise(tie))


def read_rows(rows: DataFrame, spec: ColumnSpec) -> DataFrame:
    """UD1, UD2: rows with their mapped cells, their text, and whether they are filtered out or end the statement."""
    t = rows
    if spec.cell_map is not None:
        t = t.withColumn("cells", F.filter(F.transform("cells", spec.cell_map), lambda c: c.isNotNull()))
    text = F.array_join(F.transform("cells", lambda c: c["text"]), " ")
    t = t.withColumn("text", text).withColumn("filtered", ~spec.row_filter(F.col("cells")) if spec.row_filter is not None else F.lit(False))
    return t.withColumn("_stops", F.col("text").rlike(spec.stop_re) & ~F.col("filtered") if spec.stop_re else F.lit(False))


def tagged(rows: DataFrame, spec: ColumnSpec) -> DataFrame:
    """Every row that reaches assembly or is counted, with its claims, flags and transaction number."""
    spec.validate()
    w = Window.partitionBy("file").orderBy("row_no")
    t = read_rows(rows, spec)
    if spec.stop_re:
        whole = Window.partitionBy("file")
        t = t.withColumn("_stop", F.min(F.when(F.col("_stops"), F.col("row_no"))).over(whole))
        t = t.withColumn("stopped_at", F.max(F.when(F.col("row_no") == F.col("_stop"), F.col("page"))).over(whole))
        t = t.where("_stop IS NULL OR row_no < _stop").drop("_stop")
    else:
        t = t.withColumn("stopped_at", F.lit(None).cast(t.schema["page"].dataType))
    if spec.start_re:
        scope = Window.partitionBy("file", "page") if spec.start_per_page else Window.partitionBy("file")
        hit = F.col("text").rlike(spec.start_re) & ~F.col("filtered")
        armed = F.coalesce(F.max(hit).over(scope.orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    else:
        armed = F.lit(True)
    t = t.withColumn("armed", armed)
    if spec.numbers == "auto":
        t = t.join(styles(rows, spec).select("file", "style"), "file", "left")
    else:
        t = t.withColumn("style", F.lit(spec.numbers))
    t = claims(t, spec)
    t = t.withColumn("boundary", F.col("is_new") | F.col("veto") | F.col("filtered"))
    t = t.withColumn("txn", F.sum(F.col("boundary").cast("int")).over(w))
    carried = F.last(F.when(F.col("is_new"), F.col("dtok")), ignorenulls=True).over(w) if spec.date_carry else F.lit(None).cast("string")
    t = t.withColumn("d", F.coalesce("dtok", F.when(F.col("is_new"), carried)))
    both = F.col("deb").isNotNull() & F.col("cred").isNotNull() & F.lit(not spec.allow_both_sides)
    t = t.withColumn("both", F.col("is_new") & F.col("d").isNotNull() & both)
    t = t.withColumn("ok", F.col("is_new") & F.col("d").isNotNull() & ~both)
    t = t.withColumn("strays", F.count(F.when(F.col("ok") & (F.size("unclaimed") > 0), 1)).over(w))
    group = Window.partitionBy("file", "txn")
    t = t.withColumn("open", F.max("ok").over(group))
    return t.drop("_stops")


def claims(t: DataFrame, spec: ColumnSpec) -> DataFrame:
    """ASM1, ASM5-ASM6, ASM11-ASM12, PF08-PF09: what a row claims by itself, from read_rows() with `armed` and `style`."""
    low = F.lower("text")
    veto = F.lit(False)
    for s in spec.skip_rows:
        veto = veto | low.contains(s.lower())
    if spec.skip_re:
        veto = veto | F.col("text").rlike(spec.skip_re)
    t = t.withColumn("veto", veto & F.col("armed") & ~F.col("filtered")).withColumn("live", F.col("armed") & ~F.col("filtered") & ~F.col("veto"))

    looks = lambda c: A.is_money_shaped(c["text"], spec.require_decimals)
    value = lambda c: A.amount(c["text"], F.col("style"))
    live_cells = F.when(F.col("live"), F.col("cells")).otherwise(F.slice("cells", 1, 0))
    t = t.withColumn("_money", F.filter(live_cells, looks))
    marker = F.lit(None).cast("string")
    if spec.sign_re_debit or spec.sign_re_credit:
        def side(c: Column) -> Column:
            s = A.stripped(c["text"])
            out = F.when(s.rlike(f"^(?:{spec.sign_re_debit})"), "debit") if spec.sign_re_debit else F.when(F.lit(False), "debit")
            return out.when(s.rlike(f"^(?:{spec.sign_re_credit})"), "credit") if spec.sign_re_credit else out

        marked = F.filter("cells", lambda c: inside(spec.sign_band, c["x1"])) if spec.sign_band else F.col("cells")
        marker = F.when(F.col("live"), _first(F.transform(marked, side)))
    t = t.withColumn("marker", marker)
    if spec.amount:
        v = F.transform(F.filter("_money", lambda c: inside(spec.amount, c["x1"])), value)
        debit_sign = (lambda x: x < 0) if spec.amount_sign == "negative_is_debit" else (lambda x: x >= 0)
        t = t.withColumn("_v", v)
        deb = F.when(F.col("marker") == "debit", F.abs(_last(F.col("_v")))).when(F.col("marker").isNull(), F.abs(_last(F.filter("_v", debit_sign))))
        cred = F.when(F.col("marker") == "credit", F.abs(_last(F.col("_v")))).when(F.col("marker").isNull(), F.abs(_last(F.filter("_v", lambda x: ~debit_sign(x)))))
        t = t.withColumns({"deb": deb, "cred": cred}).drop("_v")
    else:
        deb = _last(F.transform(F.filter("_money", lambda c: inside(spec.debit, c["x1"])), value))
        cred = _last(F.transform(F.filter("_money", lambda c: ~inside(spec.debit, c["x1"]) & inside(spec.credit, c["x1"])), value))
        t = t.withColumns({"deb": deb, "cred": cred})
    known = [spec.debit, spec.credit, spec.amount, spec.balance, *spec.ignore, spec.description, spec.date]

    def stray(c: Column) -> Column:
        out = F.lit(True)
        for b in known:
            out = out & ~inside(b, c["x1"])
        return out

    t = t.withColumn("unclaimed", _texts(F.col("_money"), stray)).drop("_money")
    t = t.withColumns({"signed_debit": F.coalesce("deb", F.lit(0).cast(A.MONEY)), "signed_credit": F.coalesce("cred", F.lit(0).cast(A.MONEY))})
    # A negative amount moves to the other side, first from debit, then from credit.
    t = t.withColumn("_f1", F.coalesce(F.col("deb") < 0, F.lit(False)))
    t = t.withColumns({"cred": F.when(F.col("_f1"), (F.coalesce("cred", F.lit(0)) - F.col("deb")).cast(A.MONEY)).otherwise(F.col("cred")), "deb": F.when(~F.col("_f1"), F.col("deb"))})
    t = t.withColumn("_f2", F.coalesce(F.col("cred") < 0, F.lit(False)))
    t = t.withColumns({"deb": F.when(F.col("_f2"), (F.coalesce("deb", F.lit(0)) - F.col("cred")).cast(A.MONEY)).otherwise(F.col("deb")), "cred": F.when(~F.col("_f2"), F.col("cred")), "flips": F.col("_f1").cast("int") + F.col("_f2").cast("int")})

    cells = F.col("cells")
    cur = _first(F.transform(F.filter(cells, lambda c: inside(spec.currency, c["x1"])), lambda c: A.currency_of(c["text"], spec.currency_re))) if spec.currency else F.lit(None).cast("string")
    act = F.nullif(A.stripped(F.array_join(_texts(cells, lambda c: inside(spec.actor, c["x1"])), " ")), F.lit("")) if spec.actor else F.lit(None).cast("string")
    dated = F.filter(cells, lambda c: inside(spec.date, c["x1"])) if spec.date else cells
    dtok = F.coalesce(_first(F.transform(dated, lambda c: A.iso_date(_found(c["text"], spec.date_re, 1), spec.date_order))), A.iso_date(_found(F.col("text"), spec.date_re, 1), spec.date_order))
    tm = _found(F.col("text"), spec.time_re) if spec.time_re else F.lit(None).cast("string")
    t = t.withColumns({"cur": cur, "act": act, "dtok": dtok, "tm": tm, "desc": F.array_join(_texts(cells, lambda c: inside(spec.description, c["x1"])), " ")})
    has = F.col("deb").isNotNull() | F.col("cred").isNotNull()
    start = {"amount": has, "date": F.col("dtok").isNotNull(), "date_and_amount": has & F.col("dtok").isNotNull()}[spec.row_start]
    return t.withColumn("is_new", F.col("live") & start).drop("_f1", "_f2")


def transactions(rows: DataFrame, spec: ColumnSpec) -> DataFrame:
    """ASM1-ASM13: (file, line_no, page, and the record's fields) of every transaction, in order."""
    t = tagged(rows, spec).where("open AND live")
    group = Window.partitionBy("file", "txn")
    t = t.withColumn("_tm_row", F.min(F.when(F.col("tm").isNotNull(), F.col("row_no"))).over(group))
    late = (F.col("row_no") == F.col("_tm_row")) & ~F.col("ok")
    t = t.withColumn("desc", F.when(late, A.stripped(F.replace(F.col("desc"), F.col("tm"), F.lit("")))).otherwise(F.col("desc")))
    opener = lambda c: F.max(F.when(F.col("ok"), F.col(c)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_no")))
    part = F.when(F.col("ok") | (F.col("desc") != ""), F.struct("row_no", "desc"))
    own = F.coalesce(opener("cur"), F.lit(spec.currency_default), F.lit(A.UNKNOWN_CURRENCY))
    got = t.groupBy("file", "txn").agg(
        opener("row_no").alias("row_no"), opener("page").alias("page"), opener("d").alias("transaction_date"), first("tm").alias("transaction_time"),
        F.coalesce(A.sided(opener("deb")), F.lit("0.00")).alias("debit_sum"), F.coalesce(A.sided(opener("cred")), F.lit("0.00")).alias("credit_sum"),
        F.upper(own).alias("_own"), first("cur").alias("_cur"),
        F.regexp_replace(A.stripped(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda s: s["desc"]), spec.desc_join)), r"\s+", " ").alias("description"),
        first("act").alias("uniq_actor_field_value"),
    )
    backfilled = F.when(F.col("_own") == A.UNKNOWN_CURRENCY, F.coalesce("_cur", "_own")).otherwise(F.col("_own")) if spec.currency else F.col("_own")
    got = got.withColumn("currency", backfilled)
    if spec.post is not None:
        got = spec.post(got)
    order = Window.partitionBy("file").orderBy("row_no")
    return got.select("file", F.row_number().over(order).cast("long").alias("line_no"), "page", "transaction_date", "transaction_time", "debit_sum", "credit_sum", "currency", "description", "uniq_actor_field_value")


def metrics(rows: DataFrame, spec: ColumnSpec) -> DataFrame:
    """AG03: one row of counts for each file (before `post`, which drops transactions without counting)."""
    t = tagged(rows, spec)
    total = lambda c: F.sum(F.coalesce(F.when(F.col("ok"), F.col(c)), F.lit(0).cast(A.MONEY))).cast("decimal(38,2)")
    seen = F.col("armed") & ~F.col("filtered")
    return t.groupBy("file").agg(
        F.count_if("ok").alias("transactions"), F.countDistinct("page").alias("pages"), F.count_if(F.col("live") & ~F.col("is_new") & F.col("open")).alias("continuations"),
        F.count_if(F.col("veto") | F.col("filtered")).alias("skipped"), F.count_if(~F.col("armed") & ~F.col("filtered")).alias("before_start"),
        F.count_if((F.col("live") & ~F.col("is_new") & ~F.col("open")) | (F.col("is_new") & F.col("d").isNull())).alias("orphan"), F.count_if("both").alias("both_sides"),
        F.sum(F.when(seen, F.col("flips")).otherwise(0)).alias("sign_flips"), F.count_if(F.col("is_new") & F.col("dtok").isNull() & F.col("d").isNotNull()).alias("carried_dates"),
        F.sum(F.when(F.col("ok") & F.lit(spec.strict_bands), F.size("unclaimed")).otherwise(0)).alias("unclaimed"), F.count_if(F.col("marker").isNotNull()).alias("markers_read"),
        total("deb").alias("debit_total"), total("cred").alias("credit_total"), F.sum("signed_debit").cast("decimal(38,2)").alias("signed_debit"), F.sum("signed_credit").cast("decimal(38,2)").alias("signed_credit"),
        F.max("stopped_at").alias("stopped_at"), F.max("style").alias("number_style"),
        F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("ok") & (F.size("unclaimed") > 0) & (F.col("strays") <= 5), F.struct("row_no", F.slice("unclaimed", 1, 5).alias("unclaimed"))))), lambda s: s["unclaimed"])), 1, 5).alias("unclaimed_samples"),
    )


def reconcile(counts: DataFrame, spec: ColumnSpec) -> DataFrame:
    """AG04: do the totals agree with the printed ones, by sides or, after sign flips, in place?"""
    style = F.col("number_style")
    want = {s: A.amount(F.lit(x), style).cast("decimal(38,2)") if x is not None else F.lit(None).cast("decimal(38,2)") for s, x in (("debit", spec.expect_debit_total), ("credit", spec.expect_credit_total))}
    near = lambda a, b: F.coalesce(F.abs(a - b) < 0.01, F.lit(True))
    by_side = near(F.col("debit_total"), want["debit"]) & near(F.col("credit_total"), want["credit"])
    in_place = near(F.col("signed_debit"), want["debit"]) & near(F.col("signed_credit"), want["credit"])
    signed = ~by_side & in_place & (F.col("sign_flips") > 0)
    count_ok = F.lit(True) if spec.expect_count is None else F.col("transactions") == spec.expect_count
    return counts.select("file", "transactions", "debit_total", "credit_total", want["debit"].alias("expected_debit"), want["credit"].alias("expected_credit"), signed.alias("signed_convention"), count_ok.alias("count_ok"), ((by_side | signed) & count_ok).alias("ok"))


def jsonl(txns: DataFrame) -> DataFrame:
    """SK01: (file, line_no, line), keys in their fixed order, absent optional keys left out, `, ` and `: ` between."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)
    keys = ["transaction_date", "transaction_time", "debit_sum", "credit_sum", "currency", "description", "uniq_actor_field_value"]
    parts = [F.when(F.col(k).isNotNull() & ((F.col(k) != "") | F.lit(k not in ("transaction_time", "uniq_actor_field_value"))), F.concat(F.lit(f'"{k}": '), quoted(k))) for k in keys]
    return txns.select("file", "line_no", F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("line"))


def joined_thousands(cells: Column, most_gap: float = 4.0) -> Column:
    """ASM14: `1` and `234.56` close together are one number again; a part with decimals ends it."""
    kind = "array<struct<text:string,x0:double,x1:double,open:boolean>>"

    def step(out: Column, c: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = F.coalesce(last["open"] & c["text"].rlike(r"^[0-9]{3}(?:[.,][0-9]{1,2})?$") & (c["x0"] - last["x1"] <= most_gap), F.lit(False))
        whole = F.struct(F.concat(last["text"], c["text"]).alias("text"), last["x0"].alias("x0"), c["x1"].cast("double").alias("x1"), c["text"].rlike(r"^[0-9]{3}$").alias("open"))
        alone = F.struct(c["text"].alias("text"), c["x0"].cast("double").alias("x0"), c["x1"].cast("double").alias("x1"), c["text"].rlike(r"^-?[0-9]{1,3}$").alias("open"))
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(whole))).otherwise(F.concat(out, F.array(alone))).cast(kind)

    folded = F.aggregate(cells, F.array().cast(kind), step)
    return F.transform(folded, lambda c: F.struct(c["text"].alias("text"), c["x0"].alias("x0"), c["x1"].alias("x1")))


def clustered(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """ASM15: words (file, page, text, x0, x1, top) to rows; a row is anchored at its first word's top."""
    w = F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "text")))
    kind = "array<struct<top:double,cells:array<struct<x0:double,x1:double,text:string>>>>"

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        cell = F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"), x["text"].alias("text"))
        near = F.coalesce(F.abs(x["top"] - last["top"]) <= tolerance, F.lit(False))
        grown = F.struct(last["top"].alias("top"), F.concat(last["cells"], F.array(cell)).alias("cells"))
        return F.when(near, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(F.struct(x["top"].alias("top"), F.array(cell).alias("cells"))))).cast(kind)

    pages = words.groupBy("file", "page").agg(F.aggregate(w, F.array().cast(kind), step).alias("rows"))
    flat = pages.select("file", "page", F.posexplode("rows").alias("at", "row"))
    order = Window.partitionBy("file").orderBy("page", "at")
    cells = F.transform(F.sort_array("row.cells"), lambda c: F.struct(c["text"].alias("text"), c["x0"].alias("x0"), c["x1"].alias("x1")))
    return flat.select("file", "page", F.row_number().over(order).cast("long").alias("row_no"), F.col("row.top").alias("top"), cells.alias("cells"))
