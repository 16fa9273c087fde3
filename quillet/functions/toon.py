"""A tabular, token-saving text for JSON values: arrays of like objects become one header and a row each."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from .values import MAX_DEPTH, PayloadError, is_scalar, number_text

_numeric = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_special = re.compile(r'[:"\\\[\]{},\x00-\x1f\x7f\u0085\u2028\u2029]')
_bare_key = re.compile(r"[^\s:\"\\\[\]{},\-\x00-\x1f][^\s:\"\\\[\]{},\x00-\x1f]*")
_identifier = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_head = re.compile(r'(?P<key>"(?:\\.|[^"\\])*"|[^:\[\]{}"]*)(?:\[(?P<n>\d+)\](?:\{(?P<columns>.*)\})?)?:(?: (?P<rest>.*))?', re.S)
_cell = re.compile(r'"(?:\\.|[^"\\])*"|[^,"]*')


@dataclass(frozen=True)
class Codec:
    """How to write and read: indent in blanks; fold_keys writes chains of single keys as a.b.c; expand_paths reads them so."""

    indent: int = 2
    fold_keys: bool = False
    expand_paths: bool = False


def scalar_text(value) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if not isinstance(value, str):
        return number_text(value)
    if not value or value != value.strip() or value in ("true", "false", "null") or value[0] == "-" or _numeric.fullmatch(value) or _special.search(value):
        return json.dumps(value, ensure_ascii=False)
    return value


_CONTAINERS = frozenset((dict, list))
_plain_start = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_#@$%&/(")
_reals = re.compile(r"(?:-?[0-9]+\.[0-9]+(?:\n|$))+")
_words = frozenset(("true", "false", "null"))


def _column_text(values: list) -> list[str]:
    """scalar_text of each, with one test for all where they are of one kind."""
    kinds = set(map(type, values))
    if kinds == {int}:
        return list(map(str, values))
    if kinds == {str} and not _special.search("x".join(values)):
        return [t if t and t[0] in _plain_start and not t[-1].isspace() and t not in _words else scalar_text(t) for t in values]
    return list(map(scalar_text, values))


def _column_values(cells: list[str]) -> list:
    """_scalar of each cell of a column without quotes."""
    joined = "".join(cells)
    if joined.isascii() and joined.isdigit() and all(cells) and max(map(len, cells)) < 19:
        return list(map(int, cells))
    if _words.issuperset(cells):
        return [{"null": None, "true": True, "false": False}[c] for c in cells]
    if _reals.fullmatch("\n".join(cells)):
        return list(map(float, cells))
    return [c if c and c[0] in _plain_start and c[-1] != " " and c not in _words else _scalar(c) for c in cells]


def _key_text(key: str, codec: Codec) -> str:
    if _bare_key.fullmatch(key) and not (codec.fold_keys and "." in key):
        return key
    return json.dumps(key, ensure_ascii=False)


def columns_of(rows: list) -> list[str] | None:
    """The columns of an array of flat objects with one set of keys, in the first one's order."""
    if not rows or not isinstance(rows[0], dict) or not rows[0]:
        return None
    keys = rows[0].keys()
    if all(isinstance(r, dict) and r.keys() == keys and _CONTAINERS.isdisjoint(map(type, r.values())) for r in rows):
        return list(keys)
    return None


def _fold(key: str, value, siblings: dict) -> tuple[str, object, bool]:
    path, inner = [key], value
    while isinstance(inner, dict) and len(inner) == 1 and _identifier.fullmatch(path[-1]):
        (k, v), = inner.items()
        if not _identifier.fullmatch(k):
            break
        path.append(k)
        inner = v
    if len(path) == 1 or any("." in k for k in siblings):
        return key, value, False
    return ".".join(path), inner, True


def _array(out: list[str], lead: str, key: str, rows: list, level: int, codec: Codec) -> None:
    pad = " " * (codec.indent * (level + 1))
    if not rows:
        out.append(f"{lead}{key}[0]:")
    elif all(map(is_scalar, rows)):
        out.append(f"{lead}{key}[{len(rows)}]: " + ",".join(map(scalar_text, rows)))
    elif columns := columns_of(rows):
        out.append(f"{lead}{key}[{len(rows)}]{{{','.join(_key_text(c, codec) for c in columns)}}}:")
        out.extend(pad + ",".join(cells) for cells in zip(*(_column_text([r[c] for r in rows]) for c in columns), strict=True))
    else:
        out.append(f"{lead}{key}[{len(rows)}]:")
        for row in rows:
            if isinstance(row, dict):
                if row:
                    _fields(out, row, level + 2, codec, first=pad + "- ")
                else:
                    out.append(pad + "-")
            elif isinstance(row, list):
                _array(out, pad + "- ", "", row, level + 2, codec)
            else:
                out.append(pad + "- " + scalar_text(row))


def _fields(out: list[str], fields: dict, level: int, codec: Codec, first: str | None = None) -> None:
    pad = " " * (codec.indent * level)
    for key, value in fields.items():
        lead, first = (pad if first is None else first), None
        name = _key_text(key, codec)
        if codec.fold_keys:
            folded, value, did = _fold(key, value, fields)
            name = folded if did else name
        if isinstance(value, dict):
            out.append(f"{lead}{name}:")
            _fields(out, value, level + 1, codec)
        elif isinstance(value, list):
            _array(out, lead, name, value, level, codec)
        else:
            out.append(f"{lead}{name}: {scalar_text(value)}")


def encode(value, codec: Codec = Codec()) -> str:
    """The text of a value; every line ends in a line feed. An empty object is an empty text."""
    out: list[str] = []
    if isinstance(value, dict):
        _fields(out, value, 0, codec)
    elif isinstance(value, list):
        if value:
            _array(out, "", "", value, 0, codec)
        else:
            out.append("[]")
    else:
        out.append(scalar_text(value))
    return "".join(line + "\n" for line in out)


def _scalar(text: str):
    text = text.strip(" ")
    if text.startswith('"'):
        try:
            value = json.loads(text)
        except ValueError:
            raise PayloadError("bad quoted text") from None
        if not isinstance(value, str):
            raise PayloadError("bad quoted text")
        return value
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    if _numeric.fullmatch(text):
        if re.fullmatch(r"-?\d+", text):
            return int(text) if text != "-0" and -(1 << 63) <= int(text) < (1 << 64) else float(text)
        return float(text)
    return text


def split_cells(line: str) -> list[str]:
    """Cells between commas that don't stand in quotes."""
    out, at = [], 0
    while True:
        m = _cell.match(line, at)
        end = m.end()
        if end < len(line) and line[end] != ",":
            raise PayloadError("bad quoted cell")
        out.append(m[0])
        if end >= len(line):
            return out
        at = end + 1


class _Reader:
    def __init__(self, text: str, codec: Codec):
        self.codec = codec
        self.lines = [(len(x) - len(x.lstrip(" ")), x.strip(" ")) for x in (y.rstrip("\r") for y in text.split("\n")) if x.strip(" ")]
        self.at = 0

    def deeper(self, indent: int, depth: int):
        """The first line below, if it stands further in than indent."""
        if depth > MAX_DEPTH:
            raise PayloadError("nested too deep")
        return self.lines[self.at] if self.at < len(self.lines) and self.lines[self.at][0] > indent else None

    def key(self, text: str) -> tuple[str, bool]:
        if text.startswith('"'):
            return _scalar(text), True
        if not text:
            raise PayloadError("a key is missing")
        return text, False

    def put(self, into: dict, key: str, quoted: bool, value) -> None:
        parts = key.split(".")
        if quoted or not self.codec.expand_paths or len(parts) == 1 or not all(map(_identifier.fullmatch, parts)):
            into[key] = value
            return
        for part in parts[:-1]:
            into = into.setdefault(part, {})
            if not isinstance(into, dict):
                raise PayloadError("a folded key collides")
        into[parts[-1]] = value

    def field(self, into: dict, m: re.Match, indent: int, depth: int) -> None:
        key, quoted = self.key(m["key"])
        if m["n"] is not None:
            value = self.array(m, indent, depth)
        elif m["rest"] is not None:
            value = _scalar(m["rest"])
        else:
            below = self.deeper(indent, depth)
            value = self.fields(below[0], depth + 1) if below else {}
        self.put(into, key, quoted, value)

    def fields(self, indent: int, depth: int) -> dict:
        out: dict = {}
        while self.at < len(self.lines) and self.lines[self.at][0] == indent:
            m = _head.fullmatch(self.lines[self.at][1])
            if not m:
                raise PayloadError("a line without a key")
            self.at += 1
            self.field(out, m, indent, depth)
        if self.at < len(self.lines) and self.lines[self.at][0] > indent:
            raise PayloadError("a line stands too far in")
        return out

    def array(self, m: re.Match, indent: int, depth: int) -> list:
        n, out = int(m["n"]), []
        if m["rest"] is not None:
            out = [_scalar(c) for c in split_cells(m["rest"])]
        elif m["columns"] is not None:
            columns = [self.key(c.strip())[0] for c in split_cells(m["columns"])]
            rows = self.lines[self.at : self.at + n]
            if len(rows) == n and self.deeper(indent, depth) and all(i > indent and '"' not in t for i, t in rows):
                split = [t.split(",") for _, t in rows]
                if set(map(len, split)) == {len(columns)}:
                    self.at += n
                    out = [dict(zip(columns, r, strict=True)) for r in zip(*map(_column_values, zip(*split, strict=True)), strict=True)]
            while len(out) < n and self.deeper(indent, depth):
                cells = split_cells(self.lines[self.at][1])
                if len(cells) != len(columns):
                    raise PayloadError("a row has another number of cells")
                out.append(dict(zip(columns, map(_scalar, cells), strict=True)))
                self.at += 1
        else:
            below = self.deeper(indent, depth)
            while below and self.at < len(self.lines) and self.lines[self.at][0] == below[0]:
                out.append(self.item(below[0], depth + 1))
        if len(out) != n:
            raise PayloadError("an array has another number of elements")
        return out

    def item(self, indent: int, depth: int):
        text = self.lines[self.at][1]
        if text != "-" and not text.startswith("- "):
            raise PayloadError("an element lacks its hyphen")
        rest = text[2:].strip(" ")
        if not rest:
            self.at += 1
            return {}
        m = _head.fullmatch(rest)
        if not m:
            self.at += 1
            return _scalar(rest)
        inner = indent + self.codec.indent
        if not m["key"] and m["n"] is not None:
            self.at += 1
            return self.array(m, inner, depth)
        self.lines[self.at] = (inner, rest)
        return self.fields(inner, depth)


def decode(text: str, codec: Codec = Codec()):
    """The value of a text; a single line that is no field is a scalar."""
    reader = _Reader(text, codec)
    lines = reader.lines
    if not lines:
        return {}
    if len(lines) == 1 and lines[0][1] == "[]":
        return []
    m = _head.fullmatch(lines[0][1])
    if not m:
        if len(lines) > 1:
            raise PayloadError("more than one scalar")
        return _scalar(lines[0][1])
    if not m["key"] and m["n"] is not None:
        reader.at = 1
        out = reader.array(m, lines[0][0], 0)
    else:
        out = reader.fields(lines[0][0], 0)
    if reader.at < len(lines):
        raise PayloadError("lines are left over")
    return out
