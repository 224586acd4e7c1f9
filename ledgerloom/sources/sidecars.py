"""Small files beside a layer: ids, types, ops, values, results and settings (SC22-SC27, SC33-SC34, SK02-SK05, SK09-SK10).

Each describes one layer or one run; layer_files reads and writes those of many as tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import yaml

from ledgerloom.functions.names import SEPARATOR

# The keys that files may have, and the result file's labels.
OP_KEYS = ("id", "at", "set", "rename", "describe", "picture", "type", "ref", "under", "create", "append")
UNROUTED_KEYS = ("text", "source", "guess", "reason")
FILE_KEYS = ("layer", "source_doc", "mode", "ops", "unrouted")
MODES = ("upsert", "strict")
RESULT_COUNTS = ("количество заполненных дырок", "количество обновленных акторов", "количество созданных акторов", "количество проведенных транзакций")
RESULT_LISTS = ("заполненные дырки", "обновленные акторы", "созданные акторы", "проведенные выписки")


_DUMPER = getattr(yaml, "CSafeDumper", yaml.SafeDumper)


class _Yaml12(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2's core schema: yes, no, on and off are words, 010 is ten, 1:30 is text."""


_Yaml12.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^[-+]?[0-9]+$|^0o[0-7]+$|^0x[0-9a-fA-F]+$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", "-+0123456789."),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "0123456789"),
):
    _Yaml12.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


def _int12(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> int:
    s = loader.construct_scalar(node)
    return int(s[2:], 8) if s.startswith("0o") else int(s, 16) if s.lower().startswith("0x") else int(s, 10)


_Yaml12.add_constructor("tag:yaml.org,2002:int", _int12)


def read_yaml(text: str):
    """A document under YAML 1.2 rules; plain days become dates."""
    return yaml.load(text, _Yaml12)


def parse_ids(text: str) -> tuple[str, dict[str, str]]:
    """SC22: (layer, path to id); another separator or no paths at all is an error."""
    doc = json.loads(text)
    if doc.get("sep") not in (None, SEPARATOR):
        raise ValueError(f"unexpected separator {doc['sep']!r}")
    if not doc.get("paths"):
        raise ValueError("no paths to resolve addresses against")
    return doc.get("layer", ""), dict(doc["paths"])


class NotInParts(Exception):
    """A text that only a whole reading understands: anchors, tags, several documents, keys that repeat or are no scalars, types that are no mapping."""


def _value(loader: _Yaml12, event: yaml.Event):
    """The value that begins with `event`, as a whole reading makes it but without its nodes."""
    if isinstance(event, yaml.AliasEvent) or event.anchor is not None:
        raise NotInParts
    if isinstance(event, yaml.ScalarEvent):
        tag = loader.resolve(yaml.ScalarNode, event.value, event.implicit) if event.tag in (None, "!") else event.tag
        if tag == "tag:yaml.org,2002:str":
            return event.value
        return loader.construct_document(yaml.ScalarNode(tag, event.value, event.start_mark, event.end_mark, style=event.style))
    if event.tag is not None:
        raise NotInParts
    if isinstance(event, yaml.MappingStartEvent):
        return {key: _value(loader, loader.get_event()) for key in _keys(loader)}
    out = []
    while not isinstance(event := loader.get_event(), yaml.SequenceEndEvent):
        out.append(_value(loader, event))
    return out


def _keys(loader: _Yaml12) -> Iterator:
    """The keys of the mapping that has begun; its reader takes each value before the next key."""
    while not isinstance(event := loader.get_event(), yaml.MappingEndEvent):
        if not isinstance(event, yaml.ScalarEvent):
            raise NotInParts
        yield _value(loader, event)


def _begins_mapping(event: yaml.Event) -> None:
    if not isinstance(event, yaml.MappingStartEvent) or event.anchor is not None or event.tag is not None:
        raise NotInParts


def _entries(loader: _Yaml12) -> Iterator[tuple]:
    """(slug, entry) of a document's types, one at a time."""
    loader.get_event(), loader.get_event()  # the stream's start, the document's
    _begins_mapping(loader.get_event())
    slugs = None
    for key in _keys(loader):
        if key != "types":
            _value(loader, loader.get_event())
            continue
        if slugs is not None:
            raise NotInParts
        _begins_mapping(loader.get_event())
        slugs = set()
        for slug in _keys(loader):
            if slug in slugs:
                raise NotInParts
            slugs.add(slug)
            yield slug, _value(loader, loader.get_event())
    loader.get_event()  # the document's end
    if not isinstance(loader.get_event(), yaml.StreamEndEvent):
        raise NotInParts


def _typed(slug: str, entry: dict, seen: dict) -> tuple[tuple, list[tuple]]:
    """The rows of a type and of its fields; `seen` tells which form ids came before."""
    form = entry.get("formId")
    if isinstance(form, bool) or not isinstance(form, int) or form <= 0:
        raise ValueError(f"type {slug}: formId must be a positive number")
    if form in seen:
        raise ValueError(f"types {seen[form]} and {slug} have one formId")
    seen[form] = slug
    fields = []
    for n, (name, f) in enumerate(sorted((entry.get("fields") or {}).items())):
        f = f or {}
        fields.append((slug, n, name, f.get("id") or name, f.get("type") or "string", f.get("title", ""), f.get("writable", True)))
    return (slug, form, entry.get("form", ""), entry.get("description", "")), fields


def types_in_parts(text: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """parse_types(), a type with its fields at a time, so that memory follows the largest type; NotInParts where the whole must be read.

    A text may turn out broken at its end, so its rows count only once all are there.  The
    error is that of a whole reading: of the text's form before a value's, a value's before a type's.
    """
    loader = _Yaml12(text)
    try:
        said, seen = None, {}
        try:
            for slug, entry in _entries(loader):
                try:
                    made = None if said else _typed(slug, entry, seen)
                except (ValueError, TypeError, AttributeError) as e:
                    said = e
                if not said:
                    yield made
        except (ValueError, TypeError, AttributeError, yaml.constructor.ConstructorError) as e:
            said = e
            while not isinstance(event := loader.get_event(), yaml.StreamEndEvent):
                if isinstance(event, (yaml.AliasEvent, yaml.DocumentStartEvent)) or getattr(event, "anchor", None) is not None:
                    raise NotInParts from e
        if said:
            raise said
    finally:
        loader.dispose()


def parse_types(text: str) -> tuple[list[tuple], list[tuple]]:
    """SC23: rows of types (slug, form_id, form_title, description) and of fields (slug, ord, name, id, type, title, writable), fields by name."""
    types, fields, seen = [], [], {}
    for slug, entry in ((read_yaml(text) or {}).get("types") or {}).items():
        kind, own = _typed(slug, entry, seen)
        types.append(kind)
        fields += own
    return types, fields


def type_head(layer: str) -> str:
    """SK04: how a type dictionary with types begins; a type_text() for each follows."""
    return f"layer: {json.dumps(layer)}\ntypes:\n"


def type_text(types: list[tuple], fields: list[tuple]) -> str:
    """SK04: the entry of a type, from its row and its fields'; of several rows the one with the largest form id holds."""
    slug, form, title, description = max(types, key=lambda t: t[1])
    entry: dict = {"formId": form, "form": title}
    if description:
        entry["description"] = " ".join(description.split())
    entry["fields"] = {f[2]: {"id": f[3], "type": f[4]} | ({} if f[6] else {"writable": False}) | ({"title": " ".join(f[5].split())} if f[5] else {}) for f in sorted(fields, key=lambda f: f[1])}
    dumped = yaml.dump({"types": {slug: entry}}, Dumper=_DUMPER, allow_unicode=True, sort_keys=False, width=10**6)
    return dumped.removeprefix("types:\n")


def types_document(layer: str, types: list[tuple], fields: list[tuple]) -> str:
    """SK04: the type dictionary, types by form id, a field a line; parse_types() reads it back."""
    if not types:
        return type_head(layer).removesuffix("\n") + " {}\n"
    own: dict[str, tuple[list, list]] = {}
    for t in sorted(types, key=lambda t: t[1]):
        own.setdefault(t[0], ([], []))[0].append(t)
    for f in fields:
        if f[0] in own:
            own[f[0]][1].append(f)
    return type_head(layer) + "".join(type_text(*rows) for rows in own.values())


def _known(d: dict, keys: tuple[str, ...], where: str) -> dict:
    unknown = sorted(set(d) - set(keys))
    if unknown:
        raise ValueError(f"{where}: unknown field(s) {unknown}")
    return d


def parse_ops(text: str) -> dict:
    """SC24, ST03: an ops file; a key outside the closed set or another mode is an error."""
    doc = _known(read_yaml(text) or {}, FILE_KEYS, "file")
    if doc.setdefault("mode", "upsert") not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    doc["ops"] = [_known(o or {}, OP_KEYS, f"op {n}") for n, o in enumerate(doc.get("ops") or [], 1)]
    doc["unrouted"] = [_known(u or {}, UNROUTED_KEYS, f"unrouted {n}") for n, u in enumerate(doc.get("unrouted") or [], 1)]
    return doc


#: The columns of op_rows(), as planning.plan() reads them; the last three are refused there.
OP_ROW = "n long, id string, at string, type string, ref string, set map<string,string>, rename string, describe string, picture string, under string, create string, append string"


def op_rows(doc: dict) -> list[tuple]:
    """Rows of OP_ROW: values as JSON texts; a day is its ISO text."""

    def value(v) -> str:
        return json.dumps(v, ensure_ascii=False, default=str)

    def row(n: int, o: dict) -> tuple:
        shapes = (value(o[k]) if o.get(k) else None for k in ("under", "create", "append"))
        return (n, *(o.get(k) for k in ("id", "at", "type", "ref")), {k: value(v) for k, v in (o.get("set") or {}).items()} or None, *(o.get(k) for k in ("rename", "describe", "picture")), *shapes)

    return [row(n, o) for n, o in enumerate(doc["ops"], 1)]


def stamped(text: str, ids: dict[int, str]) -> tuple[str, int, list[str]]:
    """SK09: an ops text with `id:` lines under the resolved ops, everything else untouched.

    Only an op whose `at:`, `type:` or `ref:` stands whole on one line is stamped; others
    give a warning.  Stamps go in from the bottom, so that line numbers stay right.
    """
    lines, warnings, places = text.split("\n"), [], []
    root = yaml.compose(text, yaml.SafeLoader)
    seq = next((v for k, v in root.value if k.value == "ops"), None) if root is not None else None
    for n, op in enumerate(seq.value if seq is not None else [], 1):
        keys = {k.value: (k, v) for k, v in op.value}
        if n not in ids or "id" in keys:
            continue
        anchor = next((keys[a] for a in ("at", "type", "ref") if a in keys), None)
        whole = anchor and anchor[0].start_mark.line == anchor[1].end_mark.line and anchor[1].style not in ("|", ">") and not op.flow_style
        if not whole:
            warnings.append(f"op {n}: not stamped, its address does not stand on one line")
            continue
        places.append((anchor[0].start_mark.line, anchor[0].start_mark.column, ids[n]))
    for line, column, value in sorted(places, reverse=True):
        lines.insert(line + 1, " " * column + f"id: {value}")
    return "\n".join(lines), len(places), warnings


_FIELD = re.compile(r"^([^\s:\[\]]+): (.*)$")
_NODE = re.compile(r"^(.*?) \[([^\[\]]+)\](?:  # (.*))?$")


def parse_values(text: str) -> list[dict]:
    """SC25, WN19: nodes of a values text with their path, type, description and fields, by indentation."""
    body = _block(text, "tree") or []
    out: list[dict] = []
    stack: list[tuple[int, dict]] = []
    for line in body:
        depth, bare = len(line) - len(line.lstrip(" ")), line.strip()
        while stack and stack[-1][0] >= depth:
            stack.pop()
        field = _FIELD.match(bare)
        node = None if field and stack else _NODE.match(bare)
        if field and stack:
            stack[-1][1]["fields"].append((field[1], field[2]))
        elif node:
            made = {"path": [*(stack[-1][1]["path"] if stack else []), node[1]], "label": node[1], "type": node[2], "description": node[3] or "", "fields": []}
            out.append(made)
            stack.append((depth, made))
    return out


def _block(text: str, name: str) -> list[str] | None:
    head = f"{name}: |"
    if head not in text:
        return None
    lines = text.splitlines()
    at = next((i for i, x in enumerate(lines) if x.startswith(head) and x.rstrip() == head), None)
    if at is None:
        return None
    out = []
    for line in lines[at + 1 :]:
        if line.startswith("  "):
            if not line.isspace():
                out.append(line)
        elif line.strip():
            break
    return out


def pictured(text: str) -> set[str] | None:
    """SC27: paths of nodes with a picture; None when the text has no such block, which is not the same as none."""
    block = _block(text, "pictures")
    return None if block is None else {x.strip() for x in block if not x.strip().startswith("#")}


def values_document(layer: str, lines: list[str], pictures: list[str]) -> str:
    """SK05: the values text from graph.value_lines() in order and the pictured paths."""
    return "".join([f"layer: {layer}\n\ntree: |\n", *(f"{x}\n" for x in lines), "\npictures: |\n", *(f"  {x}\n" for x in pictures)])


def result_document(buckets: list[tuple[str, str]], statements: list[dict]) -> str:
    """SK10: the cumulative result with its exact labels, from (id, bucket) and statement entries."""
    lists = [[i for i, b in buckets if b == name] for name in ("hole", "updated", "created")]
    counts = [*map(len, lists), sum(s.get("транзакций", 0) for s in statements)]
    return json.dumps(dict(zip(RESULT_COUNTS, counts)) | dict(zip(RESULT_LISTS, [*lists, statements])), ensure_ascii=False, indent=4) + "\n"


def parse_result(text: str | None) -> tuple[list[tuple[str, str]], list[dict]]:
    """SC33: (id, bucket) rows and statement entries of a result; nothing for a missing file."""
    doc = json.loads(text) if text else {}
    buckets = [(i, b) for name, b in zip(RESULT_LISTS, ("hole", "updated", "created")) for i in doc.get(name) or []]
    return buckets, list(doc.get(RESULT_LISTS[3]) or [])


def parse_settings(text: str) -> dict[str, str]:
    """SC34: NAME=VALUE lines, comments and `export ` allowed, quotes removed, nothing expanded."""
    out: dict[str, str] = {}
    for n, line in enumerate(map(str.strip, text.splitlines()), 1):
        if line and not line.startswith("#"):
            name, eq, value = line.removeprefix("export ").partition("=")
            name, value = name.strip(), value.strip()
            if not eq or not name:
                raise ValueError(f"line {n} is not NAME=VALUE")
            out[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def setting(name: str, argument: str | None, environment: dict[str, str], settings: dict[str, str], default: str = "") -> str:
    """Argument over environment over file over default; blanks count as absent."""
    return next((v.strip() for v in (argument, environment.get(name), settings.get(name)) if v and v.strip()), default)
