"""The open-transaction fold as a stream: rows of a statement come in pieces, each file keeps one open transaction.

The claims of a row are the batch operator's own expressions.  Only what needs the rows
before it is state: whether the file is armed or stopped, the date to carry, the open
transaction and the last line number.  The pieces of a file may be cut anywhere, and
must come in the order of its rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ledgerloom.functions import amounts as A
from ledgerloom.operators import statements as S

OUT = "file string, line_no long, page long, transaction_date string, transaction_time string, debit_sum string, credit_sum string, currency string, description string, uniq_actor_field_value string"
MADE = Row(*(c.split()[0] for c in OUT.split(", ")))
FRESH = {"armed": False, "stopped": False, "page": None, "carried": None, "open": None, "line_no": 0}


class OpenTransaction(StatefulProcessor):
    """ASM1-ASM10 over the claimed rows of one file, in their order; a file that stays silent for `idle_ms` is closed."""

    def __init__(self, spec_armed: bool, per_page: bool, carry: bool, both: bool, join: str, currency: str, backfill: bool, idle_ms: int | None):
        self.always_armed, self.per_page, self.carry, self.both = spec_armed, per_page, carry, both
        self.join, self.currency, self.backfill, self.idle_ms = join, currency, backfill, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "fold string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        fold = json.loads(held[0]) if held is not None else dict(FRESH)
        out: list[tuple] = []
        for r in sorted(rows, key=lambda r: r.row_no):
            self.step(fold, r, out)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        self.state.update((json.dumps(fold),))
        yield from self.made(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out: list[tuple] = []
        if self.state.exists():
            fold = json.loads(self.state.get()[0])
            self.shut(fold, out)
            self.state.update((json.dumps(fold),))
        yield from self.made(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def made(key, out: list[tuple]) -> Iterator[Row]:
        return (MADE(key[0], *r) for r in out)

    def step(self, fold: dict, r, out: list[tuple]) -> None:
        if fold["stopped"]:
            return
        if r.stops:
            self.shut(fold, out)
            fold["stopped"] = True
            return
        page = r.page
        if self.per_page and page != fold["page"]:
            fold["armed"] = False
        fold["page"] = page
        armed = fold["armed"] or self.always_armed
        fold["armed"] = fold["armed"] or bool(r.starts)
        if r.filtered:
            self.shut(fold, out)
        elif armed and r.veto:
            self.shut(fold, out)
        elif armed and r.is_new:
            self.shut(fold, out)
            token = r.dtok
            if token and self.carry:
                fold["carried"] = token
            date, debit, credit = token or fold["carried"], r.debit, r.credit
            if date is not None and (self.both or debit is None or credit is None):
                fold["open"] = {"page": page, "date": date, "time": r.tm, "debit": debit, "credit": credit, "own": r.cur, "cur": r.cur, "act": r.act, "parts": [r.desc or ""]}
        elif armed and fold["open"] is not None:
            t, said = fold["open"], r.desc or ""
            if t["time"] is None and r.tm:
                t["time"], said = r.tm, r.untimed or ""
            if said:
                t["parts"].append(said)
            t["cur"], t["act"] = t["cur"] or r.cur, t["act"] or r.act
        if r.last:
            self.shut(fold, out)

    def shut(self, fold: dict, out: list[tuple]) -> None:
        """Closes the open transaction, if there is one."""
        t, fold["open"] = fold["open"], None
        if t is None:
            return
        fold["line_no"] += 1
        currency = (t["own"] or self.currency).upper()
        if self.backfill and currency == A.UNKNOWN_CURRENCY:
            currency = t["cur"] or currency
        out.append((fold["line_no"], t["page"], t["date"], t["time"], t["debit"] or "0.00", t["credit"] or "0.00", currency, self.join.join(t["parts"]), t["act"]))


def transactions_stream(rows: DataFrame, spec: S.ColumnSpec, idle_ms: int | None = None) -> DataFrame:
    """The rows of statements.transactions() from a stream of (file, page, row_no, cells[, last]).

    A transaction comes out when the row after it closes it, when a row is marked
    `last` (boolean), or when its file has been silent for `idle_ms`.  A spec must
    name its number style, which a stream cannot vote on, and have no `post`.
    """
    if spec.numbers == "auto" or spec.post is not None:
        raise ValueError("a stream needs a spec with a number style and without post")
    spec.validate()
    last = F.coalesce("last", F.lit(False)) if "last" in rows.columns else F.lit(False)
    t = S.read_rows(rows.withColumn("_last", last), spec).withColumns({"armed": F.lit(True), "style": F.lit(spec.numbers)})
    t = S.claims(t, spec)
    text = lambda c: F.when(F.col(c).isNotNull(), A.sided(F.col(c)))
    starts = F.col("text").rlike(spec.start_re) & ~F.col("filtered") if spec.start_re else F.lit(False)
    t = t.select(
        "file", F.col("row_no").cast("long").alias("row_no"), F.col("page").cast("long").alias("page"), F.coalesce("_stops", F.lit(False)).alias("stops"), F.coalesce(starts, F.lit(False)).alias("starts"), "filtered",
        F.coalesce("veto", F.lit(False)).alias("veto"), F.coalesce("is_new", F.lit(False)).alias("is_new"), "dtok", "tm", text("deb").alias("debit"), text("cred").alias("credit"), "cur", "act", "desc",
        A.stripped(F.replace(F.col("desc"), F.col("tm"), F.lit(""))).alias("untimed"), F.col("_last").alias("last"),
    )
    fold = OpenTransaction(not spec.start_re, spec.start_per_page, spec.date_carry, spec.allow_both_sides, spec.desc_join, spec.currency_default or A.UNKNOWN_CURRENCY, spec.currency is not None, idle_ms)
    out = t.groupBy("file").transformWithState(fold, OUT, "Append", "None" if idle_ms is None else "ProcessingTime")
    return out.withColumn("description", F.regexp_replace(A.stripped(F.col("description")), r"\s+", " "))
