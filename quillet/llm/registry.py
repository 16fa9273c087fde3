"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

_MODULES = ("exact_dedup", "fingerprint", "html", "jaccard_join", "language", "mixing", "packing", "sharding", "tokens", "toxicity")


def _loaded():
    return [importlib.import_module(f"{__package__}.{m}") for m in _MODULES]


def queries():
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in _loaded() for k, s in m.ORACLE.items()}
