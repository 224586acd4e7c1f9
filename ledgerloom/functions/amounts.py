"""Amounts, dates and currencies as Column expressions (SF01-SF07, SF11, SF44, PF02)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The number grammars, the money shape and the currency symbols.
US = r"^-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?$|^-?[0-9]+(?:\.[0-9]{1,2})?$"
EU = r"^-?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]{1,2})?$|^-?[0-9]+(?:,[0-9]{1,2})?$"
MONEY_SHAPE = r"^[-(]?[0-9][0-9.,]*\)?$"
CENTS = r"[.,][0-9]{1,2}$"
PLAIN = r"^-?[0-9]+(?:\.[0-9]{1,2})?\z"  # needs no cleaning, and is of the us grammar
SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "₴": "UAH", "₽": "RUB"}
UNKNOWN_CURRENCY = "XXX"
MONEY = "decimal(18,2)"


def stripped(s: Column) -> Column:
    """Leading and trailing white space of any kind removed (trim() takes spaces only)."""
    return F.regexp_replace(s, r"^[\s ]+|[\s ]+$", "")


#: Stands for the minus that a token's form means, until its currency signs are gone.
_MEANT = "\x01"


def cleaned(token: Column) -> Column:
    """Currency noise removed; parentheses and a closing minus become a leading minus.

    One chain of replacements without branches: expressions that use the result several
    times would otherwise copy every branch, beyond what generated code may hold.
    """
    t = F.regexp_replace(stripped(token), "[  ]", "")
    t = F.regexp_replace(t, r"(?s)^\((.*)\)$", f"{_MEANT}$1")
    t = F.regexp_replace(t, f"^({_MEANT}?)[€$£]+|[€$£]+$", "$1")
    t = F.regexp_replace(t, f"(?s)^{_MEANT}?(.*)-$", f"{_MEANT}$1")
    return F.regexp_replace(t, f"^{_MEANT}-?", "-")


def amount_or_null(token: Column, style: Column | str) -> Column:
    """The decimal under the grammar `style` ('us' or 'eu'), null when the token has another grammar."""
    style, t = (F.lit(style) if isinstance(style, str) else style), cleaned(token)
    return F.when((style == "us") & token.rlike(PLAIN), token.cast(MONEY)).when((style == "us") & t.rlike(US), F.replace(t, F.lit(","), F.lit("")).cast(MONEY)).when((style == "eu") & t.rlike(EU), F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".").cast(MONEY))


def amount(token: Column, style: Column | str) -> Column:
    """As amount_or_null, but another grammar is an error: a wrong style must not pass as a plausible number."""
    return F.coalesce(amount_or_null(token, style), F.when(token.isNotNull(), F.raise_error(F.concat(F.lit("not a number of the declared grammar: "), token)).cast(MONEY)))


def is_money_shaped(token: Column, cents: bool = True) -> Column:
    """Does the token look like money (optionally with cents required)?"""
    t = cleaned(token)
    ok = stripped(token).rlike(MONEY_SHAPE) & (t.rlike(US) | t.rlike(EU))
    plain = token.rlike(PLAIN) & token.rlike(CENTS) if cents else token.rlike(PLAIN)
    return F.when(plain, True).otherwise(ok & t.rlike(CENTS) if cents else ok)


def sided(value: Column) -> Column:
    """'1163.14': unsigned, half-up, two places."""
    return F.abs(F.round(value, 2)).cast(MONEY).cast("string")


def iso_date(token: Column, order: str = "dmy") -> Column:
    """'2026-04-01' or null. Ranges are checked, calendars are not: 31 February passes."""
    if sorted(order) != ["d", "m", "y"]:
        raise ValueError(f"date order must be dmy, mdy or ymd, not {order!r}")
    parts = F.split(stripped(token), "[./-]")
    at = {k: F.try_element_at(parts, F.lit(i + 1)) for i, k in enumerate(order)}
    d, m, y = (F.when(F.trim(at[k]).rlike("^[0-9]+$"), F.trim(at[k])).try_cast("int") for k in "dmy")
    y = F.when(y < 100, y + 2000).otherwise(y)
    ok = (F.size(parts) == 3) & m.between(1, 12) & d.between(1, 31) & y.between(1900, 2200)
    return F.when(ok, F.format_string("%04d-%02d-%02d", y, m, d))


def currency_of(token: Column, pattern: str = r"^[A-Za-z]{3}$|^[€$£₴₽]$") -> Column:
    """ISO code of a currency token, null for anything else."""
    t = F.regexp_replace(stripped(token), "^[.,;:]+|[.,;:]+$", "")
    symbol = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    return F.when(t.rlike(pattern), F.coalesce(F.try_element_at(symbol, t), F.upper(t)))


def currency_or_default(own: Column, default: str = "") -> Column:
    """Row, then option, then XXX; upper case."""
    return F.coalesce(F.nullif(F.upper(stripped(own)), F.lit("")), F.lit(default.strip().upper() or UNKNOWN_CURRENCY))


def ledger_amount(s: Column) -> Column:
    """Blank is 0; otherwise a non-negative decimal, null when it is none.

    NaN, infinities and underscores are refused, unlike in a float parser.
    """
    t = stripped(F.coalesce(s, F.lit("")))
    return F.when(t == "", F.lit(0).cast(MONEY)).when(t.rlike(r"^\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.round(t.try_cast("double").try_cast("decimal(38,10)"), 2).try_cast(MONEY))


def occurred_ms(date: Column, time: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds of a local date and optional clock in an IANA zone; null when they are malformed."""
    d, c = stripped(F.coalesce(date, F.lit(""))), stripped(F.coalesce(time, F.lit("")))
    clock = F.when(c == "", "0:0:0").when(c.rlike(r"^[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), c).when(c.rlike(r"^[0-9]{1,2}:[0-9]{1,2}$"), F.concat(c, F.lit(":0")))
    local = F.when(d.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_timestamp(F.concat_ws(" ", d, clock), F.lit("y-M-d H:m:s")))
    return F.when(clock.isNotNull(), F.unix_millis(F.to_utc_timestamp(local, zone.strip() or "UTC")))


def number_or_zero(s: Column) -> Column:
    """Lenient double of a profile row."""
    return F.coalesce(s.try_cast("double"), F.lit(0.0))
