"""Stored records read from JSON texts: envelopes and typed records whose missing parts are zero values (SF29, SF42)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The keys of a stored record and the kinds of their values.
RECORDS = {
    "actor": {"id": "text", "accId": "text", "formId": "number", "formTitle": "text", "title": "text", "description": "text", "ref": "text", "color": "text", "picture": "text", "data": "object", "hole": "flag", "createdAt": "text"},
    "node": {"id": "text", "title": "text", "description": "text", "formId": "number", "formTitle": "text", "data": "object", "picture": "text", "position": "place"},
    "edge": {"id": "text", "source": "text", "target": "text"},
    "account": {"id": "text", "nameId": "text", "currencyId": "number", "incomeType": "text"},
    "upload": {"id": "number", "accId": "text", "title": "text", "type": "text", "size": "number", "fileName": "text", "status": "text"},
}
FIELD = ["id", "key", "class", "type", "title", "value", "extra", "description", "visibility", "color"]
_OPTION = "struct<title: string, value: string, color: string>"
_SECTIONS = f"array<struct<id: string, title: string, content: array<struct<{', '.join(f'`{n}`: string' for n in FIELD)}, options: array<{_OPTION}>>>>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use() of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def item(payload: Column) -> Column:
    """The JSON text of an envelope's one record; `{}` where it holds none or the payload is no JSON."""
    data = F.to_json(F.try_variant_get(F.try_parse_json(payload), "$.data", "variant"))
    return _once(data, lambda d: F.when(~d.isin("null", "{}", "[]", '""', "0", "false"), d).otherwise("{}"))


def items(payload: Column) -> Column:
    """The JSON texts of an envelope's records: `data` as a list, or the `list` in it; empty where there is neither."""
    v = F.try_parse_json(payload)
    found = F.coalesce(*(F.try_variant_get(v, path, "array<variant>") for path in ("$.data", "$.data.list")))
    return F.coalesce(F.transform(found, lambda x: F.to_json(x)), F.array().cast("array<string>"))


def _column_name(key: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in key)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def record(text: Column, kind: str) -> Column:
    """A struct of a JSON text by the keys of its kind; missing and null parts are '', 0, false or {}, and so are all of a text that is no JSON object.

    A place gives x and y as whole numbers, halves to the even one.
    """
    keys = RECORDS[kind]
    parsed = F.from_json(text, ", ".join(f"`{k}` " + ("struct<x: string, y: string>" if v == "place" else "string") for k, v in keys.items()))

    def shaped(p: Column) -> Column:
        parts = []
        for key, what in keys.items():
            c = p[key]
            if what == "place":
                parts += [F.coalesce(F.bround(c[axis].try_cast("double")).cast("long"), F.lit(0).cast("long")).alias(axis) for axis in ("x", "y")]
                continue
            value = {"text": _text, "number": _number, "object": lambda c: F.coalesce(c, F.lit("{}")), "flag": lambda c: F.coalesce(c.try_cast("boolean"), F.lit(False))}[what](c)
            parts.append(value.alias(_column_name(key)))
        return F.struct(*parts)

    return _once(parsed, shaped)


def form_fields(text: Column) -> Column:
    """The fields of a form's sections in order, each with its options; sections stand at the top or, where those are empty, under `form`."""
    parsed = F.from_json(text, f"sections {_SECTIONS}, form struct<sections: {_SECTIONS}>")
    sections = F.when(F.size(F.coalesce(parsed["sections"], F.array())) > 0, parsed["sections"]).otherwise(parsed["form"]["sections"])
    fields = F.flatten(F.transform(sections, lambda s: F.coalesce(s["content"], F.array())))
    option = lambda o: F.struct(_text(o["title"]).alias("title"), o["value"].alias("value"), _text(o["color"]).alias("color"))
    plain = {"value": lambda c: c, "extra": lambda c: F.coalesce(c, F.lit("{}"))}
    shaped = F.transform(fields, lambda f: F.struct(*(plain.get(n, _text)(f[n]).alias(n) for n in FIELD), F.coalesce(F.transform(f["options"], option), F.array()).alias("options")))
    return F.coalesce(shaped, F.array())
