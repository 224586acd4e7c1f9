"""Rendering and coercing field values (SF22, SF23, SF36): vectorised pandas functions.

Values arrive as JSON text, since a record's fields are dynamic.
"""

from __future__ import annotations

import json
import math
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F, types as T


def render_value(v) -> str:
    """A value as text: nothing for none, true/false, whole floats without a point, labels of objects, lists by commas."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return " ".join(v.split())
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e16 else repr(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dict):
        for key in ("title", "name", "label", "value"):
            if isinstance(v.get(key), str) and v[key].strip():
                return " ".join(v[key].split())
        return json.dumps(v, ensure_ascii=False)
    return ", ".join(x for x in map(render_value, v) if x)


def coerce(kind: str, raw) -> tuple[object, str | None]:
    """(stored value, error) of a raw value for a field type of the fixed vocabulary.

    int takes whole floats and digit strings but no booleans; bool takes words but
    not the integers 1 and 0; string and text refuse lists and maps; date keeps the day
    of a text in any ISO form; a type outside the vocabulary is refused.
    """
    if raw is None or (isinstance(raw, str) and not raw.strip()) or raw == [] or raw == {}:
        return None, "clearing a value is not supported"
    if kind == "int":
        if not isinstance(raw, bool):
            if isinstance(raw, int) or (isinstance(raw, float) and raw.is_integer()):
                return int(raw), None
            if isinstance(raw, str) and re.fullmatch(r"[+-]?\d+", raw.strip()):
                return int(raw.strip()), None
        return None, f"{render_value(raw)!r} is not an int"
    if kind == "number":
        if not isinstance(raw, bool):
            try:
                value = float(raw)
                if math.isfinite(value):
                    return value, None
            except (TypeError, ValueError, OverflowError):
                pass
        return None, f"{render_value(raw)!r} is not a number"
    if kind == "bool":
        if isinstance(raw, bool):
            return raw, None
        word = raw.strip().lower() if isinstance(raw, str) else ""
        if word in ("1", "t", "true"):
            return True, None
        if word in ("0", "f", "false"):
            return False, None
        return None, f"{render_value(raw)!r} is not a bool"
    if kind == "date":
        if isinstance(raw, str):
            try:
                return datetime.fromisoformat(raw.strip()).strftime("%Y-%m-%d"), None
            except ValueError:
                pass
        return None, f"{render_value(raw)!r} is not a date"
    if kind.startswith("enum["):
        options, value = [o.strip() for o in kind[5:].rstrip("]").split(",")], render_value(raw)
        return (value, None) if value in options else (None, f"{value!r} is none of {', '.join(options)}")
    if kind.startswith("ref("):  # the address of the record that is meant; planning looks it up
        return (raw.strip(), None) if isinstance(raw, str) else (None, f"a {kind} takes the path of its target")
    if kind not in ("string", "text"):
        return None, f"unknown field type {kind!r}"
    if isinstance(raw, (list, dict)):
        return None, "a list or map does not fit a text field"
    return render_value(raw) if not isinstance(raw, str) else raw, None


def _rendered(s: str | None) -> str:
    if s is None:
        return ""
    try:
        return render_value(json.loads(s))
    except ValueError:
        return " ".join(s.split())


@F.pandas_udf(T.StringType())
def rendered(values: pd.Series) -> pd.Series:
    """render_value() of JSON texts; null and malformed JSON render as nothing and as themselves."""
    return values.map(_rendered)


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
def coerced(kinds: pd.Series, values: pd.Series) -> pd.DataFrame:
    """coerce() of JSON texts; the value is JSON again."""
    return pd.DataFrame([_coerced(kind, s) for kind, s in zip(kinds, values)], columns=["value", "error"])


def _coerced(kind: str | None, s: str | None) -> tuple[str | None, str | None]:
    try:
        raw = json.loads(s) if s is not None else None
    except ValueError:
        raw = s
    value, error = coerce(kind or "string", raw)
    return None if error else json.dumps(value, ensure_ascii=False), error


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("value", "error", "new", "old")]))
def compared(kinds: pd.Series, values: pd.Series, held: pd.Series) -> pd.DataFrame:
    """coerced() of JSON texts, with the value and what is held rendered: one function, so that a task needs one Python worker."""
    out = []
    for kind, s, old in zip(kinds, values, held):
        value, error = _coerced(kind, s)
        out.append((value, error, _rendered(value), _rendered(old)))
    return pd.DataFrame(out, columns=["value", "error", "new", "old"])
