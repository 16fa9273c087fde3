"""Groups of rows as one document each: compact JSON, tabular text, schema rows, class calls. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import sizes
from quillet.functions.toon import _numeric, _special

_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def quoted(c: Column) -> Column:
    for a, b in _ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def json_literal(c: Column, kind: str) -> Column:
    """A JSON literal; doubles as Spark writes them."""
    return F.coalesce(quoted(c) if kind == "string" else c.cast("string"), F.lit("null"))


def cell(c: Column, kind: str) -> Column:
    """A cell of tabular text: texts bare unless they could be read as something else."""
    if kind != "string":
        return F.coalesce(c.cast("string"), F.lit("null"))
    odd = c.rlike(rf"^$|^[ \s]|\s$|^(true|false|null)$|^-|^({_numeric.pattern})$") | c.rlike(_special.pattern.replace("\\u0085", "\u0085").replace("\\u2028", " ").replace("\\u2029", " "))
    return F.when(c.isNull(), "null").when(odd, quoted(c)).otherwise(c)


def _joined(row: Column, order: list[Column], between: str) -> Column:
    """The rows' texts in order, aggregated."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], row.alias("row"))))
    return F.array_join(F.transform(sorted_rows, lambda r: r["row"]), between)


def encode_groups(rows: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """One row a group: n_rows, json_text, toon_text, onto_text, tron_text and the sizes of the first two.

    A group becomes one document, so it has to fit a task; a group's rows are put in the given order, ties by all
    columns. Nulls are null literals.
    """
    kinds = dict(rows.dtypes)
    keys = sorted(columns)
    ordering = [F.col(c) for c in [*order, *[c for c in columns if c not in order]]]
    lit = lambda c: json_literal(F.col(c), kinds[c])
    obj = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), lit(c)) for c in columns]), F.lit("}"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.concat(F.lit("["), _joined(obj, ordering, ","), F.lit("]")).alias("json_text"),
        _joined(F.concat(F.lit("  "), F.concat_ws(",", *[cell(F.col(c), kinds[c]) for c in columns]), F.lit("\n")), ordering, "").alias("_toon"),
        F.concat(F.lit("!schema " + "|".join(f'"{k}"' for k in keys) + "\n"), _joined(F.concat(F.concat_ws("|", *[lit(k) for k in keys]), F.lit("\n")), ordering, "")).alias("onto_text"),
        F.concat(F.lit(f"class A: {', '.join(columns)}\n\n["), _joined(F.concat(F.lit("A("), F.concat_ws(",", *[lit(c) for c in columns]), F.lit(")")), ordering, ","), F.lit("]")).alias("tron_text"),
    )
    out = out.withColumn("toon_text", F.concat(F.lit("["), F.col("n_rows").cast("string"), F.lit("]{" + ",".join(columns) + "}:\n"), F.col("_toon"))).drop("_toon")
    return out.withColumns({"json_bytes": F.octet_length("json_text").cast("long"), "toon_bytes": F.octet_length("toon_text").cast("long")})


def with_gates(encoded: DataFrame, margin_pct: float = 2.0) -> DataFrame:
    t, j = F.col("toon_bytes"), F.col("json_bytes")
    return encoded.withColumns({"savings_pct": F.round(sizes.savings_pct(t, j), 6), "would_convert": sizes.smaller_enough(t, j, margin_pct)})


def shape_of_groups(rows: DataFrame, by: str, keys: Column, position: Column, sample: int = 64) -> DataFrame:
    """Per group, of its first `sample` rows, the share of the commonest key list: uniform from 0.9 on.

    The first rows come from a bounded sort in each task and then over the tasks' candidates (min_by's array form
    isn't needed: row_number's limit is pushed below the shuffle as a window group limit).
    """
    from pyspark.sql import Window

    first = rows.select(F.col(by), F.array_sort(keys).alias("sig"), F.row_number().over(Window.partitionBy(by).orderBy(position)).alias("rn")).filter(F.col("rn") <= sample)
    counts = first.groupBy(by, "sig").agg(F.count("*").alias("c"))
    out = counts.groupBy(by).agg((F.max("c") / F.sum("c")).alias("uniformity"), F.sum("c").alias("sampled"))
    return out.withColumn("shape_class", F.when(F.col("uniformity") >= 0.9, "uniform").otherwise("irregular"))


def byte_entropy(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per row of a unique key, Shannon's bits a byte over 8 of the whole text's bytes.

    Bytes are counted in place, so nothing is exploded or shuffled.
    """
    h = F.hex(F.encode(F.col(text), "UTF-8"))
    n = F.octet_length(text)
    size = F.col("_n")
    pairs = F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))
    # Runs of a sorted array: positions where a new byte value starts give the counts.
    ordered = F.array_sort(pairs)
    starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.get(F.col("_o"), i - 1) != F.get(F.col("_o"), i - 2)))
    out = texts.filter(n > 0).select(F.col(key), ordered.alias("_o"), n.alias("_n")).withColumn("_s", starts)
    ends = F.concat(F.slice("_s", 2, F.size("_s")), F.array(size + 1))
    counts = F.zip_with("_s", ends, lambda a, b: (b - a).cast("double"))
    entropy = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - c / F.col("_n") * F.log2(c / F.col("_n")))
    return out.select(key, F.round(entropy / 8, 6).alias("h8"))


def legend_candidates(rows: DataFrame, columns: list[str], sentinel_bytes: int = 4) -> DataFrame:
    """Cells whose replacement by a sentinel would save bytes: token, count, net_saving."""
    tokens = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("tok")).filter("tok is not null")
    size = F.octet_length("tok")
    counted = tokens.groupBy("tok").agg(F.count("*").alias("cnt"))
    net = (size - sentinel_bytes) * F.col("cnt") - (sentinel_bytes + 1 + size + 1)
    return counted.withColumn("net_saving", net.cast("long")).filter((F.col("cnt") >= 2) & (size > sentinel_bytes) & (F.col("net_saving") > 0))


def ndjson_records(lines: DataFrame, stream: str, position: str, line: str) -> DataFrame:
    """Per stream of JSON lines: records, bytes read, and the array of all, or null if one line is no JSON object or array."""
    text = F.trim(F.col(line))
    alone = F.concat(F.lit("["), text, F.lit("]"))  # one element, or the line holds more or less than one value
    valid = F.try_parse_json(alone).isNotNull() & (F.coalesce(F.json_array_length(alone), F.lit(0)) == 1)
    kept = lines.filter(text != "")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(position, text.alias("t")))), lambda r: r["t"])
    return kept.groupBy(stream).agg(
        F.count("*").alias("records"),
        F.sum(F.octet_length(line) + 1).alias("bytes"),
        F.bool_and(valid).alias("all_valid"),
        F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("_a"),
    ).select(stream, "records", "bytes", "all_valid", F.when(F.col("all_valid"), F.col("_a")).alias("json_text"))


def tron_stream(records: DataFrame, stream: str, position: str, record: str, columns: list[str]) -> DataFrame:
    """Per stream of JSON objects: a class of `columns` (those of its first record) and a call for every record with just these keys; others as JSON."""
    from pyspark.sql import Window

    keys = F.json_object_keys(F.col(record))
    first = F.first(keys).over(Window.partitionBy(stream).orderBy(position))
    flat = ~F.exists(F.array(*[F.get_json_object(F.col(record), f"$.{c}") for c in columns]), lambda v: v.rlike(r"^[\[{]"))
    fits = (F.array_sort(keys) == F.array_sort(F.array(*map(F.lit, columns)))) & flat
    literal = lambda c: F.regexp_extract(F.col(record), rf'"{c}":("(?:\\.|[^"\\])*"|[^,}}]+)', 1)
    call = F.concat(F.lit("A("), F.concat_ws(",", *[literal(c) for c in columns]), F.lit(")"))
    marked = records.select(stream, position, first.alias("_f"), F.when(fits, call).otherwise(F.col(record)).alias("_t"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(position, "_t"))), lambda r: r["_t"])
    return marked.groupBy(stream).agg(F.count("*").alias("records"), F.concat(F.lit(f"class A: {', '.join(columns)}\n\n["), F.array_join(rows, ","), F.lit("]")).alias("tron_text"))


def key_union(records: DataFrame, by: str, position: str, record: str) -> DataFrame:
    """Per group, the keys of all its JSON objects in the order in which they first appear; only (group, key) pairs are gathered."""
    keys = records.select(by, position, F.posexplode(F.json_object_keys(F.col(record))).alias("_i", "_k"))
    first = keys.groupBy(by, "_k").agg(F.min(F.struct(position, "_i")).alias("_at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_k"))), lambda r: r["_k"])
    return first.groupBy(by).agg(F.array_join(ordered, ",").alias("keys"))
