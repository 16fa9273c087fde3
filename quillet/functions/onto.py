"""Two plain table texts: a schema line over rows of JSON literals, and a class header over constructor calls."""

from __future__ import annotations

import json
import re

from .values import PayloadError, dumps, is_scalar, loads

_class = re.compile(r"class ([A-Z][A-Za-z0-9_]*): ?(.*)")
_name = re.compile(r"[A-Za-z0-9_]+")
_skip = re.compile(r'"(?:\\.|[^"\\])*"|([A-Z][A-Za-z0-9_]*)\(')


def onto_encode(value) -> str:
    """`!schema "a"|"b"` (keys in order) and a line of literals a row."""
    if not isinstance(value, list) or not value or not all(isinstance(r, dict) and r and all(map(is_scalar, r.values())) for r in value):
        raise PayloadError("no array of flat objects")
    keys = sorted(value[0])
    if any(sorted(r) != keys for r in value):
        raise PayloadError("rows differ in their keys")
    return "!schema " + "|".join(map(dumps, keys)) + "\n" + "".join("|".join(dumps(r[k]) for k in keys) + "\n" for r in value)


def _bars(line: str) -> list[str]:
    out, at = [], 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|(\|)', line):
        if m[1]:
            out.append(line[at : m.start()])
            at = m.end()
    return [*out, line[at:]]


def onto_decode(text: str):
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines or not lines[0].startswith("!schema "):
        raise PayloadError("no schema line")
    keys = [loads(c) for c in _bars(lines[0][8:])]
    out = []
    for line in lines[1:]:
        cells = _bars(line)
        if len(cells) != len(keys):
            raise PayloadError("a row has another number of cells")
        out.append(dict(zip(keys, map(loads, cells), strict=True)))
    return out


def _call(row: dict, keys: list[str]) -> str:
    return "A(" + ",".join(dumps(row[k]) for k in keys) + ")"


def _flat(row) -> bool:
    return isinstance(row, dict) and bool(row) and all(_name.fullmatch(k) for k in row) and all(map(is_scalar, row.values()))


def tron_encode(value) -> str:
    """`class A: a, b`, a blank line, and the calls: `[A(1,2),A(3,4)]`, or one for an object."""
    rows = value if isinstance(value, list) else [value]
    if not rows or not all(map(_flat, rows)) or any(list(r) != list(rows[0]) for r in rows):
        raise PayloadError("no objects with the same keys in the same order")
    keys = list(rows[0])
    calls = [_call(r, keys) for r in rows]
    return f"class A: {', '.join(keys)}\n\n" + (f"[{','.join(calls)}]" if isinstance(value, list) else calls[0])


def tron_encode_stream(records) -> str:
    """Of a stream of values: the first flat object makes the class; what doesn't have its keys is written as JSON."""
    keys, parts, head = None, [], ""
    for k, r in enumerate(records):
        if k == 0 and _flat(r):
            keys, head = list(r), f"class A: {', '.join(r)}\n\n"
        parts.append(_call(r, keys) if keys and _flat(r) and r.keys() == set(keys) else dumps(r))
    return head + "[" + ",".join(parts) + "]"


def _end(text: str, at: int) -> int:
    """Where the call that opens at `at` closes."""
    depth = 0
    for m in re.compile(r'"(?:\\.|[^"\\])*"|[()]').finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == ")" and not depth:
            return m.start()
    raise PayloadError("a call isn't closed")


def _arguments(text: str) -> list[str]:
    out, at, depth = [], 0, 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[()\[\]{},]', text):
        if m[0] == "," and not depth:
            out.append(text[at : m.start()])
            at = m.end()
        elif m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
    return [*out, text[at:]] if text.strip() or out else []


def _json_of(text: str, classes: dict[str, list[str]], depth: int = 0) -> str:
    if depth > 100:
        raise PayloadError("nested too deep")
    out, at = [], 0
    while m := _skip.search(text, at):
        out.append(text[at : m.start()])
        if not m[1]:
            out.append(m[0])
            at = m.end()
            continue
        close = _end(text, m.end() - 1)
        keys, values = classes.get(m[1]), _arguments(text[m.end() : close])
        if keys is None or len(keys) != len(values):
            raise PayloadError("a call doesn't fit its class")
        out.append("{" + ",".join(f"{json.dumps(k)}:{_json_of(v, classes, depth + 1)}" for k, v in zip(keys, values, strict=True)) + "}")
        at = close + 1
    return "".join([*out, text[at:]])


def tron_decode(text: str):
    """Any number of classes; calls may nest; without a class it is JSON."""
    classes, lines = {}, text.split("\n")
    while lines and (not lines[0].strip() or lines[0].startswith("class ")):
        if lines[0].strip():
            m = _class.fullmatch(lines[0].strip())
            keys = [k.strip() for k in m[2].split(",")] if m and m[2].strip() else []
            if not m or not keys or not all(map(_name.fullmatch, keys)):
                raise PayloadError("bad class")
            classes[m[1]] = keys
        lines.pop(0)
    body = "\n".join(lines)
    return loads(_json_of(body, classes) if classes else body)
