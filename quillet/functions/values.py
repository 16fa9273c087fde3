"""JSON values as Python objects: strict parsing, compact text, equality that tells 1 from 1.0."""

from __future__ import annotations

import json
import re

MAX_DEPTH = 100
_string = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)', re.S)
_exponent = re.compile(r"e\+?(-?)0*(\d)")


class PayloadError(ValueError):
    """A payload can't be parsed, encoded or decoded."""


_large = re.compile(r"[eE]\+?\d{3}|\d{300}")
_only_brackets = {c: None for c in range(128) if chr(c) not in "[]{}"}


def check_depth(text: str) -> None:
    """More than MAX_DEPTH brackets open at once, outside of strings, is an error."""
    if text.count("{") + text.count("[") <= MAX_DEPTH:
        return
    if text.isascii():  # brackets cancel out level by level, unless a string holds some
        left = text.translate(_only_brackets)
        for _ in range(MAX_DEPTH):
            less = left.replace("{}", "").replace("[]", "")
            if not less:
                return
            if less == left:
                break
            left = less
    depth = 0
    for c in re.sub(r"[^\[\]{}]+", "", _string.sub("", text)):
        depth += 1 if c in "{[" else -1
        if depth > MAX_DEPTH:
            raise PayloadError("nested too deep")


def _whole(digits: str):
    n = int(digits)
    return n if -(1 << 63) <= n < (1 << 64) else float(n)


def _reject(name: str):
    raise PayloadError(f"{name} is no JSON number")


def _real(digits: str) -> float:
    x = float(digits)
    if x in (float("inf"), float("-inf")):
        raise PayloadError("number out of range")
    return x


def loads(data: bytes | str):
    """A whole JSON document. Of equal keys the last one counts; NaN, numbers out of range, lone surrogates and bad UTF-8 are errors."""
    try:
        text = data.decode("utf-8") if isinstance(data, bytes) else data
        check_depth(text)
        value = json.loads(text, parse_int=_whole, parse_float=_real if _large.search(text) else None, parse_constant=_reject)
        if "\\u" in text:
            dumps(value).encode("utf-8")
        return value
    except (ValueError, OverflowError, RecursionError) as e:
        raise PayloadError(str(e)) from None


def number_text(x: int | float) -> str:
    text = repr(x)
    return _exponent.sub(r"e\1\2", text) if "e" in text else text


def dumps(value) -> str:
    """Compact JSON in the values' own key order."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def json_bytes(value) -> int:
    return len(dumps(value).encode("utf-8"))


def same(a, b) -> bool:
    """Equal in types and values; the order of keys doesn't count, that of elements does; -0.0 isn't 0.0."""
    return dumps(a) == dumps(b) or _same(a, b)


def _same(a, b) -> bool:
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return repr(a) == repr(b) if isinstance(a, float) else a == b


def sort_keys(value):
    """The value with the keys of every object in order."""
    if isinstance(value, dict):
        return {k: sort_keys(value[k]) for k in sorted(value)}
    return [sort_keys(v) for v in value] if isinstance(value, list) else value


def is_scalar(value) -> bool:
    return not isinstance(value, (dict, list))
