"""The dictionary tier: cells that repeat are replaced by short sentinels, which a legend in front explains."""

from __future__ import annotations

from collections import Counter

from .toon import split_cells
from .values import PayloadError

MARK = "\ue000"
HEADING = MARK + " legend:"


def _structure(lines: list[str]) -> int:
    """Where the table's header is, or -1 for a text of fields."""
    for i, line in enumerate(lines):
        t = line.strip()
        if "{" in t and "}" in t and t.endswith(":"):
            return i
    return -1


def _cells(text: str) -> list[str]:
    try:
        return split_cells(text)
    except PayloadError:
        return [text]


def _protected(name: str, policy) -> bool:
    return any(p in name.lower() for p in policy)


def _parts(line: str, header: int, skip: set[int], policy):
    """(what stays in front, the cells, which of them may be replaced) of a line."""
    body = line.lstrip(" ")
    lead = line[: len(line) - len(body)]
    if header >= 0:
        cells = _cells(body)
        return lead, cells, [k not in skip for k in range(len(cells))]
    key, colon, rest = body.partition(": ")
    if not colon or _protected(key.lstrip("- ").strip('"'), policy):
        return line, [], []
    cells = _cells(rest)
    return lead + key + ": ", cells, [True] * len(cells)


def compress(text: str, policy=()) -> str | None:
    """The text with a legend if that makes it shorter, else None. Columns and fields whose names the policy protects stay as they are.

    Sentinels are numbered by the bytes they save, most first, then by the token.
    """
    if MARK in text:
        return None
    lines = text.split("\n")
    header = _structure(lines)
    skip: set[int] = set()
    if header >= 0:
        head = lines[header]
        skip = {k for k, c in enumerate(_cells(head[head.index("{") + 1 : head.rindex("}")])) if _protected(c.strip('"'), policy)}
    first = header + 1
    data = [(i, *_parts(lines[i], header, skip, policy)) for i in range(first, len(lines)) if lines[i].strip()]
    seen = Counter(c for _, _, cells, may in data for c, ok in zip(cells, may, strict=True) if ok)
    size = lambda s: len(s.encode())
    ranked = sorted((t for t, n in seen.items() if n >= 2 and (size(t) - 4) * n > 4 + 1 + size(t) + 1), key=lambda t: (-(size(t) - 4) * seen[t] + size(t), t))
    legend: dict[str, str] = {}
    for token in ranked:
        sentinel = f"{MARK}{len(legend)}"
        s = size(sentinel)
        if size(token) > s and (size(token) - s) * seen[token] > s + 1 + size(token) + 1:
            legend[token] = sentinel
    if not legend:
        return None
    for i, lead, cells, may in data:
        lines[i] = lead + ",".join(legend.get(c, c) if ok else c for c, ok in zip(cells, may, strict=True)) if cells else lines[i]
    out = HEADING + "\n" + "".join(f"{s} {t}\n" for t, s in legend.items()) + "\n" + "\n".join(lines)
    return out if size(out) < size(text) else None


def expand(text: str, most_bytes: int | None = None) -> str:
    """The text without its legend, sentinels replaced; longer results than most_bytes are an error."""
    if not text.startswith(HEADING):
        return text
    lines = text.split("\n")
    words: dict[str, str] = {}
    at = 1
    while at < len(lines) and lines[at].rstrip("\r"):
        sentinel, blank, token = lines[at].rstrip("\r").partition(" ")
        if not blank or not sentinel.startswith(MARK):
            raise PayloadError("bad legend")
        words[sentinel] = token
        at += 1
    out, total = [], -1
    body = lines[at + 1 :]
    header = _structure(body)
    for i, line in enumerate(body):
        if MARK in line and i > header:
            lead, cells, _ = _parts(line, header, set(), ())
            line = lead + ",".join(words.get(c, c) for c in cells)
        out.append(line)
        total += len(line.encode()) + 1
        if most_bytes is not None and total > most_bytes:
            raise PayloadError("the expanded text is too large")
    return "\n".join(out)
