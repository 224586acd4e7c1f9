"""References, names, slugs, paths and rendered values (SF08-SF29, SF38, SF41, SF43, PF13, PF23)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.amounts import stripped

SEPARATOR = " > "
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def ref_of(prefix: str, raw: Column, side: Column | str) -> Column:
    """Idempotency reference: prefix, 32 hex digits of the raw line's SHA-1, side."""
    side = F.lit(side) if isinstance(side, str) else side
    return F.concat_ws("-", F.lit(prefix), F.left(F.sha1(F.encode(raw, "utf-8")), F.lit(32)), side)


def pair_name(name: str, group_id: int = 0) -> str:
    """The name of an account pair; a group has a pair of its own."""
    return name.strip() if group_id <= 0 else f"{name.strip()} {group_id}"


def comment(date: Column, time: Column, description: Column) -> Column:
    """When and what, space-separated, blanks left out."""
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return F.concat_ws(" ", F.coalesce(date, F.lit("")), blank(time), blank(stripped(description)))


def statement_ref(prefix: Column | str, actor: Column, account: Column | str, path: Column) -> Column:
    """prefix|actor|account|base name of the file."""
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.concat_ws("|", as_col(prefix), actor, as_col(account), F.regexp_extract(path, r"([^/]*)$", 1))


def candidates(value: Column) -> Column:
    """The value as given; for an identifier also without spaces in upper case."""
    v = stripped(value)
    identifier = v.rlike(r"^[A-Za-z0-9\s]+$") & v.rlike("[0-9]")
    return F.array_distinct(F.when(identifier, F.array(v, F.upper(F.regexp_replace(v, r"\s+", "")))).otherwise(F.array(v)))


def folded_title(t: Column) -> Column:
    """White space collapsed, lower case: equal titles compare equal."""
    return F.lower(stripped(F.regexp_replace(t, r"\s+", " ")))


def one_line(t: Column) -> Column:
    """White space collapsed to single spaces."""
    return stripped(F.regexp_replace(t, r"\s+", " "))


def shortened(t: Column, most: int = 72) -> Column:
    """One line of at most `most` characters, the last an ellipsis where text was cut."""
    line = one_line(t)
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line)


def slug(s: Column) -> Column:
    """Letters and digits in lower case, every other run one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def field_slug(field_id: Column, title: Column) -> Column:
    """A field's name: its id when that is an identifier of its own, else its title's first four words, else the id."""
    own = field_id.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~field_id.startswith("item_")
    words = slug(F.array_join(F.slice(F.split(stripped(title), r"\s+"), 1, 4), " "))
    return F.when(own, field_id).when(words != "", words).otherwise(slug(field_id))


# Widget classes and declared types of form fields.
BOOL_WIDGETS = ("check", "checkbox", "switch", "toggle")
DATE_WIDGETS = ("calendar", "date", "datetime", "datepicker")
CHOICE_WIDGETS = ("select", "radio", "multiselect", "dropdown")
LINK_WIDGETS = ("actor", "actorlink", "link", "reference")
INT_TYPES, NUMBER_TYPES = ("int", "integer"), ("float", "double", "number", "decimal")


def field_type(widget: Column, kind: Column, multiline: Column, form: Column, options: Column) -> Column:
    """The type name of a form field from its widget class and declared type, in any case of letters.

    A choice is an enum of its options; a link to a form is ref:<form> until
    resolve_refs() names the form's type.
    """
    w, k = F.lower(widget), F.lower(kind)
    return (
        F.when(w.isin(*BOOL_WIDGETS), "bool")
        .when(w.isin(*DATE_WIDGETS), "date")
        .when(w.isin(*CHOICE_WIDGETS), F.when(F.size(options) > 0, F.concat(F.lit("enum["), F.array_join(options, ", "), F.lit("]"))).otherwise("string"))
        .when(w.isin(*LINK_WIDGETS), F.when(form > 0, F.concat(F.lit("ref:"), form.cast("string"))).otherwise("string"))
        .when(k.isin(*INT_TYPES), "int")
        .when(k.isin(*NUMBER_TYPES), "number")
        .when(multiline, "text")
        .otherwise("string")
    )


def ref_target(kind: Column) -> Column:
    """The type that a ref(<type>) field names, else null."""
    return F.nullif(F.regexp_extract(kind, r"^ref\(([^()]*)\)$", 1), F.lit(""))


def option_values(options: Column) -> Column:
    """Values of options (struct<title,value>), titles where there is none; those that a list cannot hold are left out."""
    return F.filter(F.transform(options, lambda o: F.coalesce(F.nullif(o["value"], F.lit("")), o["title"])), lambda v: v.isNotNull() & (v != "") & ~v.rlike(r"[,\]]"))


def resolved_form_id(keys: Column, form_id: Column) -> Column:
    """The leaf form of a record: the first `__form__<id>:` key with a positive id, else its own form."""
    ids = F.filter(F.transform(keys, lambda k: F.regexp_extract(k, r"^__form__([0-9]+):", 1).try_cast("long")), lambda x: x > 0)
    return F.coalesce(F.try_element_at(ids, F.lit(1)), form_id)


def storage_key(keys: Column, field_id: Column) -> Column:
    """The stored key of a field: the exact id, else the first prefixed one, else the id."""
    prefixed = F.try_element_at(F.filter(keys, lambda k: k.startswith("__form__") & k.endswith(F.concat(F.lit(":"), field_id))), F.lit(1))
    return F.when(F.array_contains(keys, field_id), field_id).otherwise(F.coalesce(prefixed, field_id))


def clean_values(data: Column) -> Column:
    """Field values without blanks, form prefixes removed; 0 and false stay."""
    kept = F.map_filter(data, lambda _, v: v.isNotNull() & (stripped(v) != ""))
    return F.transform_keys(kept, lambda k, _: F.regexp_replace(k, r"^__form__[0-9]+:", ""))


def without_discriminators(path: Column) -> Column:
    """Path segments without their ` @hex` suffixes of four digits and more."""
    return F.array_join(F.transform(F.split(path, SEPARATOR), lambda s: F.regexp_replace(s, r"\s*@[0-9a-fA-F]{4,32}$", "")), SEPARATOR)


def without_type(address: Column) -> Column:
    """An address without its closing ` [type]`."""
    return F.regexp_replace(address, r"\s*\[[^\[\]]*\]$", "")


def path_title(path: Column) -> Column:
    """The last segment of a path, discriminator removed."""
    return F.regexp_replace(F.element_at(F.split(path, SEPARATOR), -1), r"\s*@[0-9a-fA-F]{4,32}$", "")


def renamed_path(path: Column, name: Column) -> Column:
    """The path with its last segment replaced."""
    parts = F.split(path, SEPARATOR)
    return F.array_join(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(name)), SEPARATOR)


def suffixes(path: Column) -> Column:
    """All suffixes of a path, the whole path first: equi-joins on them replace suffix search."""
    parts = F.split(path, SEPARATOR)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), SEPARATOR))


def is_uuid(s: Column) -> Column:
    """A full UUID: a shortened id must not be asked for."""
    return s.rlike(UUID)


def is_identity_title(title: Column) -> Column:
    """Does a field's title mark it as an identity key?"""
    return F.lower(title).contains("identity key")


def cut_at_line(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last line end unless that loses over half."""
    head = F.left(text, F.lit(limit))
    at = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    return F.when(F.length(text) <= limit, text).when(at >= limit / 2, F.left(head, at)).otherwise(head)


def duration(seconds: Column) -> Column:
    """'400ms', '12.5s', '3m5.25s': milliseconds under a second, else seconds without closing zeros."""
    ms = F.round(seconds * 1000).cast("long")
    plain = lambda n: F.regexp_replace((n / 1000).cast("decimal(18,3)").cast("string"), r"\.?0+$", "")
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(plain(ms), F.lit("s"))).otherwise(F.concat(F.floor(ms / 60000).cast("string"), F.lit("m"), plain(F.pmod(ms, F.lit(60000))), F.lit("s")))


def page_address(url: Column, source: Column) -> Column:
    """The final address of a page, else the one asked for, else empty."""
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(source, F.lit("")), F.lit(""))


def base_url(url: Column) -> Column:
    """Scheme and host of a service address: https by default, no path, query or closing slash."""
    u = stripped(url)
    u = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_extract(u, r"^([^/]+//[^/?#]*)", 1)


def error_parts(body: Column) -> tuple[Column, Column]:
    """Message and code of an error body: JSON with message/error/description, else the text."""
    field = lambda *ks: F.coalesce(*(F.nullif(F.get_json_object(body, f"$.{k}"), F.lit("")) for k in ks))
    return F.coalesce(field("message", "error.message", "error", "description"), shortened(body, 200)), field("code", "error.code", "statusCode")


def is_duplicate_ref(status: Column, body: Column) -> Column:
    """Was a write refused because its reference is there already?"""
    return status.isin(400, 409) & F.lower(body).contains("ref") & F.lower(body).rlike("exist|duplicate|unique|already")
