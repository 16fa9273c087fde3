"""Adaptive conversion: a payload becomes tabular text only if that is smaller by a margin and decodes to the same value."""

from __future__ import annotations

import difflib
import json
import math
from collections import Counter
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import legend, onto, toon
from quillet.functions.detect import detect
from quillet.functions.tokens import count_tokens, token_savings_pct
from quillet.functions.values import PayloadError, dumps, is_scalar, same, sort_keys
from quillet.sources.formats import parse

# Names that are kept out of the legend, and sizes and shares of the gates.
CRITICAL = ("id", "uuid", "key", "token", "secret", "password", "hash", "signature", "fingerprint")
MAX_INPUT, SAMPLE, UNIFORM = 2 << 20, 64, 0.9
STREAMED = ("json", "ndjson", "csv", "tsv")


@dataclass(frozen=True)
class Options:
    margin_pct: float = 2.0
    max_input_bytes: int = MAX_INPUT
    format_hint: str | None = None
    auto_margin: bool = False
    cache_stable: bool = False
    dict_enabled: bool = True
    critical: tuple[str, ...] = CRITICAL
    entropy_gate: bool = False
    fold_keys: bool = True
    expand_paths: bool = True
    zero_alloc: bool = False
    target: str = "toon"  # or onto, tron


#: What the command line and the tool server use, and what agent hooks use.
CLI = Options(auto_margin=True, entropy_gate=True)
HOOK = Options(zero_alloc=True, dict_enabled=False, fold_keys=False)


def classify(value) -> tuple[str, float | None, int | None]:
    """(uniform, share, sampled), irregular or scalar: by how many of the first 64 elements have the commonest set of keys."""
    if not isinstance(value, list):
        return "scalar", None, None
    if not value:
        return "irregular", None, None
    keys = Counter(tuple(sorted(v)) if isinstance(v, dict) else () for v in value[:SAMPLE])
    n = min(len(value), SAMPLE)
    share = max(keys.values()) / n
    return ("uniform", share, n) if share >= UNIFORM else ("irregular", None, None)


def entropy(data: bytes) -> float:
    """Shannon's bits a byte over 8."""
    if not data:
        return 0.0
    n = len(data)
    return min(1.0, max(0.0, -sum(c / n * math.log2(c / n) for c in Counter(data).values()) / 8))


def entropy_margin(h: float) -> float:
    return 0.0 if h < 0.35 else 2.0 if h < 0.5 else 5.0 if h < 0.65 else 10.0


def shape_margin(shape: tuple) -> float:
    kind, share, _ = shape
    if kind != "uniform":
        return 2.0
    return 0.0 if share >= 0.7 else 2.0 if share >= 0.4 else 5.0 if share >= 0.2 else 10.0


def smaller_enough(size: int, json_size: int, margin: float) -> bool:
    margin = margin if math.isfinite(margin) and margin > 0 else 0.0
    return size < json_size * (1 - margin / 100)


def savings_pct(size: int, json_size: int) -> float:
    return max(0.0, (1 - size / json_size) * 100) if json_size else 0.0


def protected_keys(value, critical=CRITICAL) -> list[str]:
    """Top-level keys (of all elements of an array, in the order they appear) that hold a critical word."""
    rows = value if isinstance(value, list) else [value]
    keys = dict.fromkeys(k for r in rows if isinstance(r, dict) for k in r)
    return [k for k in keys if any(c in k.lower() for c in critical)]


@dataclass
class Result:
    converted: bool = False
    text: str | None = None
    reason: str | None = None
    json_bytes: int | None = None
    toon_bytes: int | None = None
    savings_pct: float | None = None
    doc_type: str | None = None
    shape_class: str | None = None
    uniformity_pct: float | None = None
    sampled_count: int | None = None
    protected_fields: list | None = None


def _codec(o: Options) -> toon.Codec:
    return toon.Codec(fold_keys=o.fold_keys and not o.zero_alloc, expand_paths=o.expand_paths)


def decode_any(text: str, codec: toon.Codec = toon.Codec(expand_paths=True), most_bytes: int | None = None):
    """The value of a table text of any of the three kinds, told by its start."""
    if text.startswith("!schema "):
        return onto.onto_decode(text)
    if text.startswith("class "):
        return onto.tron_decode(text)
    return toon.decode(legend.expand(text, most_bytes), codec)


def _convert_records(data: bytes, o: Options) -> Result:
    """A payload above the size cap to TRON, record by record; its own size stands for that of its JSON."""
    try:
        kind = detect(data, o.format_hint)
    except RecursionError:
        kind = None
    if kind not in STREAMED:
        return Result(reason="InputTooLarge")
    out = Result(doc_type=kind)
    try:
        records = parse(data, kind)
        if not isinstance(records, list):
            raise PayloadError("no records")
        text = onto.tron_encode_stream(records)
        out.json_bytes, out.toon_bytes = len(data), len(text.encode())
        out.shape_class, out.uniformity_pct, out.sampled_count = classify(records)
        out.savings_pct = savings_pct(out.toon_bytes, out.json_bytes)
        if not smaller_enough(out.toon_bytes, out.json_bytes, o.margin_pct):
            out.reason = "NotSmallerEnough"
            return out
    except (PayloadError, RecursionError, UnicodeEncodeError):
        out.reason = "ParseFailed"
        return out
    try:
        if not same(onto.tron_decode(text), records):
            raise PayloadError("another value")
    except (PayloadError, RecursionError):
        out.reason = "RoundTripMismatch"
        return out
    out.converted, out.text, out.protected_fields = True, text, []
    return out


def convert(data: bytes, o: Options = Options()) -> Result:
    """The gates in order; what doesn't pass one is left as it is, with the reason. Never raises."""
    if len(data) > o.max_input_bytes:
        return _convert_records(data, o) if o.target == "tron" else Result(reason="InputTooLarge")
    try:
        kind = detect(data, o.format_hint)
    except RecursionError:
        kind = None
    if kind is None:
        return Result(reason="NotStructuredData")
    out = Result(doc_type=kind)
    try:
        value = parse(data, kind)
        if o.cache_stable:
            value = sort_keys(value)
        out.shape_class, out.uniformity_pct, out.sampled_count = shape = classify(value)
        plain = dumps(value)
        out.json_bytes = len(plain.encode())
        codec = _codec(o)
        text = {"toon": lambda v: toon.encode(v, codec), "onto": onto.onto_encode, "tron": onto.tron_encode}[o.target](value)
        if o.target == "toon" and o.dict_enabled and not o.zero_alloc:
            text = legend.compress(text, o.critical) or text
        out.toon_bytes = len(text.encode())
    except (PayloadError, RecursionError, UnicodeEncodeError):
        out.reason = "ParseFailed"
        return out
    margin = o.margin_pct
    if not o.zero_alloc:
        margin = max(margin, shape_margin(shape)) if o.auto_margin else margin
        margin = max(margin, entropy_margin(entropy(data))) if o.entropy_gate else margin
    out.savings_pct = savings_pct(out.toon_bytes, out.json_bytes)
    if not smaller_enough(out.toon_bytes, out.json_bytes, margin):
        out.reason = "NotSmallerEnough"
        return out
    try:
        back = decode_any(text, codec) if o.target == "toon" else decode_any(text)
        if dumps(back) != plain and not same(back, value):
            raise PayloadError("another value")
    except (PayloadError, RecursionError):
        out.reason = "RoundTripMismatch"
        return out
    out.converted, out.text, out.protected_fields = True, text, protected_keys(value, o.critical)
    return out


def inspect(data: bytes, o: Options = Options(), rank_file: str | None = None) -> dict:
    """A dry run: the result's fields but its text, with token estimates and their savings; exact ones with a rank file."""
    r = convert(data, o)
    report = {k: v for k, v in vars(r).items() if k != "text"}
    if r.toon_bytes is not None:
        value = parse(data, r.doc_type)
        texts = dumps(value), r.text if r.text is not None else toon.encode(value, _codec(o))
        report |= {"json_tokens": count_tokens(texts[0], rank_file), "toon_tokens": count_tokens(texts[1], rank_file), "token_savings_pct": token_savings_pct(*texts, rank_file), "precise": rank_file is not None}
    return report


def lint(text: str) -> list[str]:
    """Warnings about a table text; one that starts with "error" if it can't be read or written again."""
    try:
        value = decode_any(text)
        if not same(toon.decode(toon.encode(value)), value):
            return ["error: round trip mismatch"]
    except (PayloadError, RecursionError) as e:
        return [f"error: {e}"]
    if is_scalar(value):
        return ["root is a scalar"]
    if isinstance(value, dict):
        return []
    if not value:
        return ["empty top-level array"]
    if not all(isinstance(r, dict) for r in value):
        return ["top-level array contains non-object rows"]
    return ["top-level array rows have inconsistent key sets"] if any(r.keys() != value[0].keys() for r in value) else []


def round_trip_diff(data: bytes, o: Options = Options()) -> list[str]:
    """Unified diff of a payload's value and what its table text decodes to, both pretty-printed; empty if they agree."""
    value = parse(data, detect(data, o.format_hint) or "json")
    back = toon.decode(toon.encode(value, _codec(o)), _codec(o))
    pretty = lambda v: json.dumps(v, ensure_ascii=False, indent=2).split("\n")
    return list(difflib.unified_diff(pretty(value), pretty(back), "original", "round-trip", lineterm=""))


SCHEMA = "converted boolean, text string, reason string, json_bytes long, toon_bytes long, savings_pct double, doc_type string, shape_class string, uniformity_pct double, sampled_count int, protected_fields array<string>"
_names = [f.name for f in fields(Result)]


def convert_column(payload: Column, options: Options = Options(), hint: Column | None = None) -> Column:
    """convert() over a binary column, as a struct; one Arrow batch at a time."""

    @F.pandas_udf(SCHEMA)
    def run(data: pd.Series, hints: pd.Series) -> pd.DataFrame:
        found = [Result(reason="NotStructuredData") if d is None else convert(bytes(d), replace(options, format_hint=h or options.format_hint)) for d, h in zip(data, hints, strict=True)]
        frame = pd.DataFrame([[getattr(r, n) for n in _names] for r in found], columns=_names)
        return frame.astype({"json_bytes": "Int64", "toon_bytes": "Int64", "sampled_count": "Int32", "savings_pct": "Float64", "uniformity_pct": "Float64"})

    return run(payload, F.lit(None).cast("string") if hint is None else hint)


def convert_payloads(payloads: DataFrame, options: Options = Options(), payload: str = "payload", hint: str | None = None) -> DataFrame:
    """payloads with the conversion's fields; payloads above the size cap reach Python for TRON only."""
    fits = F.lit(True) if options.target == "tron" else F.octet_length(payload) <= options.max_input_bytes
    c = convert_column(F.when(fits, F.col(payload)), options, F.col(hint) if hint else None)
    out = payloads.withColumn("_c", c)
    rest = [F.col(f"_c.{n}").alias(n) for n in _names if n != "reason"]
    return out.select(*payloads.columns, F.when(~fits, "InputTooLarge").otherwise(F.col("_c.reason")).alias("reason"), *rest)


def inspect_column(payload: Column, options: Options = Options(), rank_file: str | None = None) -> Column:
    """inspect() over a binary column, as JSON."""

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else dumps(inspect(bytes(d), options, rank_file)) for d in data], dtype=object)

    return run(payload)


def parse_column(payload: Column, hint: Column) -> Column:
    """Compact JSON of payloads in the hinted formats; null where they can't be parsed."""

    @F.pandas_udf("string")
    def run(data: pd.Series, hints: pd.Series) -> pd.Series:
        out = []
        for d, h in zip(data, hints, strict=True):
            try:
                out.append(None if d is None or h is None else dumps(parse(bytes(d), h)))
            except PayloadError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(payload, hint)


def decode_column(text: Column) -> Column:
    """Compact JSON of table texts; null where they can't be decoded."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else dumps(decode_any(t)))
            except (PayloadError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def lint_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else lint(t) for t in texts], dtype=object)

    return run(text)
