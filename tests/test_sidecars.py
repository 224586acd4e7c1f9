"""Sidecar files: closed keys, round trips and stamps."""

import datetime

import pytest

from ledgerloom.sources import sidecars as C

OPS = """layer: x
ops:
  - at: "ACME > Finance > Employee #1"
    set: {role: CFO, flag: yes, code: 010, at: 1:30, day: 2024-03-01}

  # a comment worth keeping
  - type: hrs_employee
    ref: "UA-1"
    rename: X
  - at: |
      ACME > Docs
    describe: hello
unrouted:
  - {text: fact, source: page 4, guess: maybe, reason: none}
"""


def test_ops():
    doc = C.parse_ops(OPS)
    assert doc["mode"] == "upsert" and doc["ops"][0]["set"] == {"role": "CFO", "flag": "yes", "code": 10, "at": "1:30", "day": datetime.date(2024, 3, 1)}
    rows = C.op_rows(doc)
    assert rows[0][5]["role"] == '"CFO"' and rows[0][5]["day"] == '"2024-03-01"' and rows[1][3:5] == ("hrs_employee", "UA-1")
    for bad in ("ops: [{att: x}]", "mode: other", "extra: 1", "unrouted: [{texts: 1}]"):
        with pytest.raises(ValueError):
            C.parse_ops(bad)


def test_stamps():
    text, n, warnings = C.stamped(OPS, {1: "u1", 2: "u2", 3: "u3"})
    lines = text.split("\n")
    assert n == 2 and len(warnings) == 1
    assert lines[3] == "    id: u1" and lines[6] == "  # a comment worth keeping" and lines[8] == "    id: u2"
    assert C.stamped(text, {1: "v1"})[0] == text and C.stamped(OPS, {})[0] == OPS


def test_ids_types_values_results():
    assert C.parse_ids('{"layer": "l", "sep": " > ", "paths": {"A": "1"}}') == ("l", {"A": "1"})
    for bad in ('{"sep": "/", "paths": {"A": "1"}}', '{"paths": {}}'):
        with pytest.raises(ValueError):
            C.parse_ids(bad)
    types, fields = C.parse_types("types: {company: {formId: 1, form: COMPANY, fields: {b: {id: bb, type: int, writable: false}, a: }}}")
    assert types == [("company", 1, "COMPANY", "")] and fields == [("company", 0, "a", "a", "string", "", True), ("company", 1, "b", "bb", "int", "", False)]
    assert C.parse_types(C.types_document("l", types, fields)) == (types, fields)
    with pytest.raises(ValueError):
        C.parse_types("types: {a: {formId: 1}, b: {formId: 1}}")
    text = C.values_document("l", ["  ACME [company]", "    industry: Steel", "    Kid [person]  # hired 2024", "      role: CFO", "  Other [company]"], ["ACME"])
    nodes = C.parse_values(text)
    assert [n["path"] for n in nodes] == [["ACME"], ["ACME", "Kid"], ["Other"]] and nodes[1]["fields"] == [("role", "CFO")] and nodes[1]["description"] == "hired 2024"
    assert C.pictured(text) == {"ACME"} and C.pictured("tree: |\n  A [b]\n") is None
    buckets, statements = [("h", "hole"), ("u", "updated"), ("c", "created")], [{"ref": "r", "транзакций": 3}]
    text = C.result_document(buckets, statements)
    assert '"количество проведенных транзакций": 3' in text and C.parse_result(text) == (buckets, statements) and C.parse_result(None) == ([], [])


def test_settings():
    s = C.parse_settings("# c\nexport A='1'\nB=\"x=$y\"\n\nC=")
    assert s == {"A": "1", "B": "x=$y", "C": ""}
    assert C.setting("A", None, {}, s) == "1" and C.setting("A", "2", {"A": "3"}, s) == "2" and C.setting("A", None, {"A": "3"}, s) == "3" and C.setting("C", None, {}, s, "d") == "d"
    with pytest.raises(ValueError):
        C.parse_settings("oops")
