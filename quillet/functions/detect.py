"""Which of ten formats a payload has: in Python for bytes, and as a Column expression for texts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions.values import PayloadError

# The file extensions, and the element names that make a text HTML rather than XML.
EXTENSIONS = {"json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "yaml": "yaml", "yml": "yaml", "toml": "toml", "csv": "csv", "tsv": "tsv", "xml": "xml", "msgpack": "msgpack", "msg": "msgpack", "cbor": "cbor", "json5": "json5"}
HTML_TAGS = (
    "html head body div span p a script style table tr td th thead tbody tfoot ul ol li h1 h2 h3 h4 h5 h6 form input button select option textarea label "
    "img br hr meta link title base nav section article aside header footer main figure figcaption pre code strong em b i u s small sub sup mark q "
    "blockquote cite time address details summary dialog canvas video audio source track embed object param iframe frame frameset noframes applet marquee font center"
).split()

SPACE = " \t\n\x0c\r"
# Patterns that Java, RE2 and Python read alike.
P_STRING = r'"(?:\\[\s\S]|[^"\\])*(?:"|$)'
P_JSON5 = r"'|//|/\*|,[ \t\n\f\r]*[}\]]|[A-Za-z_$][A-Za-z0-9_$]*[ \t\n\f\r]*:"
P_TOML_HEADER = r"^(?:\[[A-Za-z0-9_.-]+\]|\[\[[A-Za-z0-9_.-]+\]\])[ \t\f\r]*$"
P_SCALAR_HEADER = r"^\[{1,2}(?:true|false|null|-?[0-9]+\.?[0-9]*|-?\.[0-9]+)\]{1,2}[ \t\f\r]*$"
P_HTML_DOCTYPE = r"(?i)^<!doctype[ \t\n\f\r]*html(?:$|[^a-z0-9_:.-])"
P_XML_NAME = r"^<([A-Za-z_:][A-Za-z0-9_:.-]*)"

_string, _json5, _toml_header, _scalar_header, _doctype, _name = map(re.compile, (P_STRING, P_JSON5, P_TOML_HEADER, P_SCALAR_HEADER, P_HTML_DOCTYPE, P_XML_NAME))


def _is_json5(text: str) -> bool:
    try:
        json.loads(text)
        return False  # what is JSON needs none of the signs
    except (ValueError, RecursionError):
        return bool(_json5.search(_string.sub('""', text)))


def _sniff_text(text: str) -> str | None:
    trimmed = text.strip(SPACE)
    if not trimmed:
        return None
    lines = [x for x in (y.strip(SPACE) for y in text.split("\n")) if x]
    json5 = _is_json5(text) if trimmed[0] in "{[/" else False
    head = lines[:3]
    ndjson = len(lines) >= 2 and all((x[0] + x[-1]) in ("{}", "[]") for x in head)
    if trimmed.startswith(("//", "/*")) and json5:
        return "json5"
    first_line = trimmed.split("\n")[0]
    if trimmed[0] == "[" and _toml_header.search(first_line) and not _scalar_header.search(first_line):
        return "toml"
    if trimmed[0] in "{[":
        return "ndjson" if ndjson else "json5" if json5 else "json"
    if trimmed.startswith("---"):
        return "yaml"
    said = next((x for x in lines if x[0] != "#"), None)
    if said is not None:
        if said[0] == "[" and said[-1] == "]" or " = " in said and ": " not in said:
            return "toml"
        if said[0] == "-" or ": " in said or said[-1] == ":":
            return "yaml"
    if len(lines) >= 2:
        tabs, commas = (lines[0].count(c) for c in "\t,")
        if tabs and tabs >= commas:
            if lines[1].count("\t") == tabs:
                return "tsv"
        elif commas and lines[1].count(",") == commas:
            return "csv"
    start = text.removeprefix("\ufeff").lstrip(SPACE)
    if _doctype.search(start):
        return None
    if start.startswith(("<?xml", "<?XML", "<!DOCTYPE", "<!doctype")):
        return "xml"
    m = _name.match(start)
    return "xml" if m and m[1].lower() not in HTML_TAGS else None


def detect(data: bytes, hint: str | None = None) -> str | None:
    """The hint if there is one, else what the first rule that fits says; None for prose and what two formats may claim."""
    if hint:
        return hint
    try:
        return _sniff_text(data.decode("utf-8"))
    except UnicodeDecodeError:
        pass
    found = _sniff_text(data.decode("latin-1"))
    if found:
        return found
    from quillet.sources.formats import parse_cbor, parse_msgpack

    fits = []
    for name, parser in (("msgpack", parse_msgpack), ("cbor", parse_cbor)):
        try:
            if isinstance(parser(data), (dict, list)):
                fits.append(name)
        except (PayloadError, RecursionError):
            pass
    return fits[0] if len(fits) == 1 else None


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")


def text_lines(text: Column) -> Column:
    """The trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")


def is_ndjson(lines: Column) -> Column:
    return (F.size(lines) >= 2) & F.forall(F.slice(lines, 1, 3), lambda x: x.rlike(r"^(\{[\s\S]*\}|\[[\s\S]*\])$"))


def is_json5(text: Column) -> Column:
    return F.regexp_replace(text, P_STRING, '""').rlike(P_JSON5)


def delimited(lines: Column) -> Column:
    """csv, tsv or null, by the separators of the first two lines."""
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    one, two = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    tabs, commas = count(one, "\t"), count(one, ",")
    return F.when((tabs > 0) & (tabs >= commas), F.when(count(two, "\t") == tabs, "tsv")).when((commas > 0) & (count(two, ",") == commas), "csv")


def xml_kind(text: Column) -> Column:
    """xml or null; HTML isn't XML."""
    start = F.regexp_replace(text, "^\ufeff?[ \\t\\n\\f\\r]*", "")
    name = F.lower(F.regexp_extract(start, P_XML_NAME, 1))
    return F.when(start.rlike(P_HTML_DOCTYPE), F.lit(None).cast("string")).when(start.rlike(r"^(<\?xml|<\?XML|<!DOCTYPE|<!doctype)"), "xml").when((name != "") & ~name.isin(HTML_TAGS), "xml")


def detect_text(text: Column, hint: Column | None = None) -> Column:
    """detect() for a column of texts, in expressions only."""
    lines, trimmed = text_lines(text), trim(text)
    first = F.substring(trimmed, 1, 1)
    first_line = F.split(trimmed, "\n")[0]
    said = F.get(F.filter(lines, lambda x: ~x.startswith("#")), F.lit(0))
    json_like = F.when(is_ndjson(lines), "ndjson").when(is_json5(text), "json5").otherwise("json")
    found = (
        F.when(trimmed.isNull() | (trimmed == ""), F.lit(None).cast("string"))
        .when(trimmed.rlike(r"^(//|/\*)") & is_json5(text), "json5")
        .when((first == "[") & first_line.rlike(P_TOML_HEADER) & ~first_line.rlike(P_SCALAR_HEADER), "toml")
        .when(first.isin("{", "["), json_like)
        .when(trimmed.startswith("---"), "yaml")
        .when(said.rlike(r"^\[[\s\S]*\]$") | (said.contains(" = ") & ~said.contains(": ")), "toml")
        .when(said.startswith("-") | said.contains(": ") | said.endswith(":"), "yaml")
        .otherwise(F.coalesce(delimited(lines), xml_kind(text)))
    )
    return found if hint is None else F.coalesce(hint, found)


def hint_of_path(path: Column) -> Column:
    extension = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[extension]
