"""SQL names for the payload functions, and a table function that turns table texts into rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillet.functions import onto, toon
from quillet.functions.detect import detect
from quillet.functions.values import PayloadError, dumps, loads, sort_keys
from quillet.operators import convert

_FAILURES = (PayloadError, RecursionError, UnicodeEncodeError)


def _mapped(f, kind: str = "string"):
    """A vectorised function that gives null for nulls and for what f can't do."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                out.append(None if v is None else f(v))
            except _FAILURES:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


FUNCTIONS = {
    "payload_detect": (lambda b: detect(bytes(b)), "string"),
    "payload_json": (lambda b: dumps(convert.parse(bytes(b), detect(bytes(b)) or "")), "string"),
    "toon_encode": (lambda t: toon.encode(loads(t)), "string"),
    "toon_decode": (lambda t: dumps(convert.decode_any(t)), "string"),
    "onto_encode": (lambda t: onto.onto_encode(loads(t)), "string"),
    "onto_decode": (lambda t: dumps(onto.onto_decode(t)), "string"),
    "tron_encode": (lambda t: onto.tron_encode(loads(t)), "string"),
    "tron_decode": (lambda t: dumps(onto.tron_decode(t)), "string"),
    "json_sort_keys": (lambda t: dumps(sort_keys(loads(t))), "string"),
    "toon_lint": (convert.lint, "array<string>"),
    "payload_inspect": (lambda b: dumps(convert.inspect(bytes(b))), "string"),
    "maybe_convert": (lambda b: (lambda r: r.text if r.converted else None)(convert.convert(bytes(b))), "string"),
}


@F.udtf(returnType="pos int, row string")
class ToonRows:
    """Rows of a table text as JSON with their positions; one row for anything that is no array."""

    def eval(self, text: str):
        if text is None:
            return
        try:
            value = convert.decode_any(text)
        except _FAILURES:
            return
        for k, v in enumerate(value if isinstance(value, list) else [value]):
            yield k, dumps(v)


def register(spark: SparkSession) -> None:
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, _mapped(f, kind))
    spark.udtf.register("toon_rows", ToonRows)
