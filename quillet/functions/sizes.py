"""Sizes, margins, tokens, prices and small texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars a million tokens, by tokenizer family.
PRICES = {"o200k": {"input": 2.5, "cache_write": 2.5, "cache_read": 0.625, "output": 10.0}, "cl100k": {"input": 5.0, "cache_write": 5.0, "cache_read": 1.25, "output": 15.0}, "heuristic": {"input": 3.0, "cache_write": 3.0, "cache_read": 0.75, "output": 12.0}}
# What a model's name must hold to belong to a family, and the names of families.
O200K_NAMES = ("gpt-4o", "gpt-5", "gpt-5o", "o1", "o3", "o4", "o200k", "chatgpt-4o")
CL100K_NAMES = ("gpt-4", "gpt-3", "text-embedding-ada", "cl100k", "babbage", "davinci")
PROFILES = {"heuristic": "heuristic", "auto": "heuristic", "bytes": "heuristic", "cl100k": "cl100k", "cl100k_base": "cl100k", "gpt-4": "cl100k", "gpt-3.5": "cl100k", "o200k": "o200k", "o200k_base": "o200k", "gpt-4o": "o200k", "gpt-5": "o200k"}
CRITICAL_PATTERN = "id|uuid|key|token|secret|password|hash|signature|fingerprint"


def smaller_enough(size: Column, json_size: Column, margin_pct: Column | float) -> Column:
    m = margin_pct if isinstance(margin_pct, Column) else F.lit(float(margin_pct))
    m = F.when(F.isnan(m) | (m < 0) | (m == float("inf")), 0.0).otherwise(m)
    return size < json_size * (1 - m / 100)


def savings_pct(size: Column, json_size: Column) -> Column:
    return F.when(json_size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (1 - size / json_size) * 100))


def shape_margin(shape: Column, share: Column) -> Column:
    return F.when(shape != "uniform", 2.0).when(share >= 0.7, 0.0).when(share >= 0.4, 2.0).when(share >= 0.2, 5.0).otherwise(10.0)


def entropy_margin(h: Column) -> Column:
    return F.when(h < 0.35, 0.0).when(h < 0.5, 2.0).when(h < 0.65, 5.0).otherwise(10.0)


def tokens_up(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4)


def tokens_down(saved_bytes: Column) -> Column:
    """Estimated tokens of saved bytes, as the ledger counts them: rounded down."""
    return F.floor(saved_bytes / 4)


def model_family(name: Column) -> Column:
    n = F.lower(name)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(n, w))
    return F.when(any_of(O200K_NAMES), "o200k").when(any_of(CL100K_NAMES), "cl100k").otherwise("heuristic")


def profile_family(profile: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PROFILES.items() for x in kv])
    return F.coalesce(known[F.lower(profile)], model_family(profile))


def price(family: Column, kind: str) -> Column:
    return F.create_map(*[F.lit(x) for f, p in PRICES.items() for x in (f, p[kind])])[family]


def protected(key: Column) -> Column:
    return F.lower(key).rlike(CRITICAL_PATTERN)


def protected_keys(json_text: Column) -> Column:
    """The top-level keys of a JSON object that hold a critical word, in their order."""
    return F.filter(F.json_object_keys(json_text), protected)


def label_escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_escape(c: Column) -> Column:
    c = label_escape(c)
    for a, b in (("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def csv_label(c: Column) -> Column:
    return F.when(c.rlike('[,"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def count_text(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fk", n / 1e3)).otherwise(n.cast("string"))


def rate_text(pct: Column) -> Column:
    return F.when(pct >= 100, "100%").when(pct <= 0, "0%").otherwise(F.format_string("%.0f%%", pct))


def source_label(path: Column, root: str = "") -> Column:
    """A path relative to the root, or else its file's name; null for standard input."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(path.isNull() | (path == "-"), F.lit(None).cast("string")).when(F.lit(bool(root)) & path.startswith(root.rstrip("/") + "/"), F.regexp_replace(path, "^" + root.rstrip("/") + "/", "")).otherwise(base)


def day_of(ts: Column) -> Column:
    """Days since 1970 of Unix seconds, rounded down also before 1970."""
    return F.floor(ts / 86400)


def strict_day(text: Column) -> Column:
    """The day number of YYYY-MM-DD; null for anything else."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.unix_date(F.try_to_date(text, "yyyy-MM-dd"))).cast("long")
