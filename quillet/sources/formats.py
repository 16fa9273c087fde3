"""Parsers from payload bytes to JSON values, one per format. All raise PayloadError for what they can't read."""

from __future__ import annotations

import csv
import io
import re
import struct
import tomllib

from quillet.functions.values import MAX_DEPTH, PayloadError, loads

try:  # YAML payloads need PyYAML
    import yaml
except ImportError:
    yaml = None


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise PayloadError(str(e)) from None


def parse_json(data: bytes):
    return loads(data)


def parse_ndjson(data: bytes) -> list:
    """A value per line that isn't blank; one bad line fails all."""
    return [loads(line) for line in _text(data).split("\n") if line.strip(" \t\r\x0c")]


def parse_delimited(data: bytes, delimiter: str) -> list:
    """Rows under the first row's names, all cells texts. Short rows lack the last keys; cells beyond the header are field_<column>."""
    rows = [r for r in csv.reader(io.StringIO(_text(data).removeprefix("\ufeff"), newline=""), delimiter=delimiter) if r]
    if not rows:
        return []
    header = rows[0]
    if len(set(header)) < len(header):
        raise PayloadError("a column name is repeated")
    return [{header[k] if k < len(header) else f"field_{k}": cell for k, cell in enumerate(r)} for r in rows[1:]]


def parse_csv(data: bytes) -> list:
    return parse_delimited(data, ",")


def parse_tsv(data: bytes) -> list:
    return parse_delimited(data, "\t")


def _yaml_loader():
    """Scalars as YAML 1.2's core schema reads them: no yes and no, dates, or numbers in base 60."""

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    def add(tag, pattern, first):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))

    add("null", r"^(?:null|Null|NULL|~|)$", ["n", "N", "~", ""])
    add("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF")
    add("int", r"^(?:[-+]?(?:0|[1-9][0-9]*)|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789")
    add("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789")
    add("merge", r"^<<$", "<")

    def whole(loader, node):
        s = node.value
        n = int(s, 16) if s.startswith("0x") else int(s[2:], 8) if s.startswith("0o") else int(s)
        return n if -(1 << 63) <= n < (1 << 64) else float(n)

    Loader.add_constructor("tag:yaml.org,2002:int", whole)
    Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(node.value))
    return Loader


_loader: list = []


def _plain(value, depth: int = 0):
    """JSON values only; keys become texts as JSON has them."""
    if depth > MAX_DEPTH:
        raise PayloadError("nested too deep")
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if not isinstance(k, str):
                if not isinstance(k, (bool, int, float)):
                    raise PayloadError("a key is no text")
                k = {True: "true", False: "false"}[k] if isinstance(k, bool) else str(k)
            out[k] = _plain(v, depth + 1)
        return out
    if isinstance(value, (list, tuple)):
        return [_plain(v, depth + 1) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    raise PayloadError("a value JSON doesn't have")


def parse_yaml(data: bytes):
    if yaml is None:
        raise PayloadError("PyYAML isn't installed")
    if not _loader:
        _loader.append(_yaml_loader())
    try:
        return _plain(yaml.load(_text(data), Loader=_loader[0]))
    except (yaml.YAMLError, RecursionError, ValueError, TypeError) as e:
        raise PayloadError(str(e)) from None


def parse_toml(data: bytes):
    try:
        return _plain(tomllib.loads(_text(data).replace("\r\n", "\n")))
    except (tomllib.TOMLDecodeError, RecursionError, ValueError) as e:
        raise PayloadError(str(e)) from None


_xml = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!DOCTYPE(?:[^\[>]|\[.*?\])*>|<(?P<close>/)?(?P<name>[^\s/>!?<][^\s/>]*)(?P<attributes>(?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/)?>|(?P<text>[^<]+)", re.S | re.I)
_xml_attribute = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_entity = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[^\s;&]+);")


def _resolve(text: str) -> str:
    def one(m):
        name = m[1]
        if name.startswith("#"):
            try:
                return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
            except (ValueError, OverflowError):
                raise PayloadError("bad character reference") from None
        return {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}.get(name, m[0])

    return _entity.sub(one, text)


def _element(children: list, attributes: dict):
    texts = [c for c in children if isinstance(c, str)]
    elements = [c for c in children if not isinstance(c, str)]
    if texts and elements:
        mixed = [{"#text": c} if isinstance(c, str) else {c[0]: c[1]} for c in children]
        return attributes | {"$mixed": mixed} if attributes else mixed
    if elements:
        grouped: dict = {}
        for name, value in elements:
            if name not in grouped:
                grouped[name] = value
            elif isinstance(grouped[name], list):
                grouped[name] = [*grouped[name], value]
            else:
                grouped[name] = [grouped[name], value]
        return attributes | grouped
    if texts:
        return attributes | {"$text": "".join(texts)} if attributes else "".join(texts)
    return attributes


def parse_xml(data: bytes):
    """The root as {name: value}: attributes under @name, text beside them under $text, mixed contents as a list of #text and elements."""
    text, at = _text(data).removeprefix("\ufeff").strip(), 0
    stack: list[tuple] = []
    root = None
    while at < len(text):
        m = _xml.match(text, at)
        if not m:
            raise PayloadError("bad markup")
        at = m.end()
        found = m["cdata"] if m["cdata"] is not None else _resolve(m["text"].replace("\r\n", "\n")) if m["text"] else None
        if found is not None:
            if found.strip():
                if not stack:
                    raise PayloadError("text outside of the root")
                stack[-1][2].append(found)
            continue
        if not m["name"]:
            continue
        name = m["name"].rpartition(":")[2]
        if m["close"]:
            if not stack or stack[-1][0] != name:
                raise PayloadError("tags don't match")
            name, attributes, children = stack.pop()
        else:
            attributes = {}
            for key, a, b in _xml_attribute.findall(m["attributes"] or ""):
                if key != "xmlns" and not key.startswith("xmlns:"):
                    attributes["@" + key.rpartition(":")[2]] = _resolve(re.sub(r"[\r\n\t]", " ", a or b))
            children = []
            if not m["empty"]:
                stack.append((name, attributes, children))
                if len(stack) > MAX_DEPTH:
                    raise PayloadError("nested too deep")
                continue
        value = _element(children, attributes)
        if stack:
            stack[-1][2].append((name, value))
        elif root is not None:
            raise PayloadError("more than one root")
        else:
            root = {name: value}
    if root is None or stack:
        raise PayloadError("no whole root")
    return root


_json5 = re.compile(
    r"""(?P<skip>(?:[\s\ufeff\u00a0]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+)|(?P<punct>[\[\]{},:])|(?P<string>"(?:\\.|[^"\\\n\r])*"|'(?:\\.|[^'\\\n\r])*')"""
    r"""|(?P<number>[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$]))|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u200c\u200d]*)""",
    re.S | re.X,
)
_escapes = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}
_escape = re.compile(r"\\(\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", re.S)


def _json5_string(raw: str) -> str:
    def one(m):
        s = m[1]
        if len(s) > 1 and s[0] in "xu":
            return chr(int(s[1:], 16))
        return _escapes.get(s, s)

    try:
        return _escape.sub(one, raw[1:-1]).encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError as e:
        raise PayloadError(str(e)) from None


def parse_json5(data: bytes):
    """JSON with comments, trailing commas, bare keys, single quotes and more kinds of numbers."""
    text, tokens, at = _text(data), [], 0
    while at < len(text):
        m = _json5.match(text, at)
        if not m:
            raise PayloadError("bad JSON5")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    at = 0

    def value(depth: int):
        nonlocal at
        if depth > MAX_DEPTH:
            raise PayloadError("nested too deep")
        kind, s = tokens[at]
        at += 1
        if kind == "string":
            return _json5_string(s)
        if kind == "number":
            body = s.lstrip("+-")
            if body in ("Infinity", "NaN"):
                return None
            if body[:2] in ("0x", "0X"):
                n = int(body, 16) * (-1 if s[0] == "-" else 1)
            elif re.fullmatch(r"\d+", body):
                n = -0.0 if s[0] == "-" and not int(body) else int(s)
            else:
                return float(s)
            return n if not isinstance(n, int) or -(1 << 63) <= n < (1 << 64) else float(n)
        if kind == "name" and s in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[s]
        out: dict | list
        if s == "{" and kind == "punct":
            out = {}
            while tokens[at] != ("punct", "}"):
                kind, s = tokens[at]
                if kind not in ("name", "string") or tokens[at + 1] != ("punct", ":"):
                    raise PayloadError("bad JSON5 key")
                at += 2
                out[_json5_string(s) if kind == "string" else s] = value(depth + 1)
                if tokens[at] == ("punct", ","):
                    at += 1
                elif tokens[at] != ("punct", "}"):
                    raise PayloadError("bad JSON5 object")
            at += 1
            return out
        if s == "[" and kind == "punct":
            out = []
            while tokens[at] != ("punct", "]"):
                out.append(value(depth + 1))
                if tokens[at] == ("punct", ","):
                    at += 1
                elif tokens[at] != ("punct", "]"):
                    raise PayloadError("bad JSON5 array")
            at += 1
            return out
        raise PayloadError("bad JSON5 value")

    found = value(0)
    if tokens[at][0] != "end":
        raise PayloadError("more than one JSON5 value")
    return found


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise PayloadError("the payload ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def unpack(self, kind: str):
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]

    def text(self, n: int) -> str:
        return _text(self.take(n))

    def whole(self, value):
        if self.at < len(self.data):
            raise PayloadError("bytes are left over")
        return value


def _real(x: float):
    return x if x == x and x not in (float("inf"), float("-inf")) else None


def _pairs(n: int, read, depth: int) -> dict:
    out = {}
    for _ in range(n):
        key = read(depth + 1)
        if not isinstance(key, str):
            raise PayloadError("a key is no text")
        out[key] = read(depth + 1)
    return out


def parse_msgpack(data: bytes):
    """MessagePack with text keys; binary becomes an array of numbers, extension types are errors."""
    r = _Bytes(data)

    def read(depth: int):
        if depth > MAX_DEPTH:
            raise PayloadError("nested too deep")
        b = r.number(1)
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 0x100
        if b < 0x90:
            return _pairs(b & 15, read, depth)
        if b < 0xA0:
            return [read(depth + 1) for _ in range(b & 15)]
        if b < 0xC0:
            return r.text(b & 31)
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if 0xC4 <= b <= 0xC6:
            return list(r.take(r.number(1 << (b - 0xC4))))
        if b in (0xCA, 0xCB):
            return _real(r.unpack("f" if b == 0xCA else "d"))
        if 0xCC <= b <= 0xCF:
            return r.number(1 << (b - 0xCC))
        if 0xD0 <= b <= 0xD3:
            return r.unpack("bhiq"[b - 0xD0])
        if 0xD9 <= b <= 0xDB:
            return r.text(r.number(1 << (b - 0xD9)))
        if b in (0xDC, 0xDD):
            return [read(depth + 1) for _ in range(r.number(2 if b == 0xDC else 4))]
        if b in (0xDE, 0xDF):
            return _pairs(r.number(2 if b == 0xDE else 4), read, depth)
        raise PayloadError("an unknown MessagePack type")

    return r.whole(read(0))


def parse_cbor(data: bytes):
    """CBOR with text keys; tags are skipped, byte strings become arrays of numbers."""
    r = _Bytes(data)
    stop = object()

    def read(depth: int, may_stop: bool = False):
        if depth > MAX_DEPTH:
            raise PayloadError("nested too deep")
        b = r.number(1)
        major, info = b >> 5, b & 31
        if b == 0xFF:
            if may_stop:
                return stop
            raise PayloadError("a break stands alone")
        if major == 7:
            if info in (20, 21, 22, 23):
                return {20: False, 21: True, 22: None, 23: None}[info]
            if info in (25, 26, 27):
                return _real(r.unpack("efd"[info - 25]))
            raise PayloadError("an unknown CBOR value")
        if info > 27 and info < 31:
            raise PayloadError("bad CBOR length")
        n = None if info == 31 else info if info < 24 else r.number(1 << (info - 24))
        if n is None and major in (0, 1, 6):
            raise PayloadError("bad CBOR length")
        if major == 0:
            return n
        if major == 1:
            return -1 - n if n < 1 << 63 else float(-1 - n)
        if major == 6:
            return read(depth + 1)
        if major in (2, 3):
            if n is not None:
                return r.text(n) if major == 3 else list(r.take(n))
            parts = []
            while (part := read(depth + 1, True)) is not stop:
                if not isinstance(part, str if major == 3 else list):
                    raise PayloadError("bad CBOR string")
                parts.append(part)
            return "".join(parts) if major == 3 else [x for p in parts for x in p]
        if major == 4:
            if n is not None:
                return [read(depth + 1) for _ in range(n)]
            out = []
            while (v := read(depth + 1, True)) is not stop:
                out.append(v)
            return out
        if n is not None:
            return _pairs(n, read, depth)
        pairs: dict = {}
        while (key := read(depth + 1, True)) is not stop:
            if not isinstance(key, str):
                raise PayloadError("a key is no text")
            pairs[key] = read(depth + 1)
        return pairs

    return r.whole(read(0))


PARSERS = {"json": parse_json, "ndjson": parse_ndjson, "yaml": parse_yaml, "toml": parse_toml, "csv": parse_csv, "tsv": parse_tsv, "xml": parse_xml, "msgpack": parse_msgpack, "cbor": parse_cbor, "json5": parse_json5}
#: Of the public entry point for values: no binary formats and no JSON5.
TEXT_FORMATS = ("json", "ndjson", "yaml", "toml", "csv", "tsv", "xml")


def parse(data: bytes, doc_type: str):
    try:
        return PARSERS[doc_type](data)
    except KeyError:
        raise PayloadError(f"no format {doc_type}") from None
    except (RecursionError, csv.Error, struct.error, OverflowError) as e:
        raise PayloadError(str(e)) from None
