"""The savings ledger: one row an event, and the reports over it. Every function takes and returns DataFrames.

events: ts, day (days since 1970), kind (actual or opportunity), surface, project_id, source_label, doc_type,
input_bytes, output_bytes, saved_bytes, tokens_saved, converted, precise (0 or 1). Write it partitioned by day, so
that a window of days reads its partitions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import sizes

SCHEMA = "ts long, day long, kind string, surface string, project_id string, source_label string, doc_type string, input_bytes long, output_bytes long, saved_bytes long, tokens_saved long, converted int, precise int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
METRICS = {"bytes": "saved_bytes", "tokens": "tokens_saved"}


def derive(raw: DataFrame) -> DataFrame:
    """Events from ts, kind, surface, input_bytes, output_bytes and, where there are any, project_id, source_label, doc_type, tokens (an exact count)."""
    have = set(raw.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    exact = F.col("tokens") if "tokens" in have else F.lit(None).cast("long")
    saved = F.greatest(F.col("input_bytes") - F.col("output_bytes"), F.lit(0))
    return raw.select(
        F.col("ts").cast("long").alias("ts"), sizes.day_of(F.col("ts")).alias("day"), "kind", "surface", *[text(c).alias(c) for c in ("project_id", "source_label", "doc_type")],
        F.col("input_bytes").cast("long").alias("input_bytes"), F.col("output_bytes").cast("long").alias("output_bytes"), saved.cast("long").alias("saved_bytes"),
        F.coalesce(exact, sizes.tokens_down(saved)).cast("long").alias("tokens_saved"),
        (F.col("input_bytes") > F.col("output_bytes")).cast("int").alias("converted"), exact.isNotNull().cast("int").alias("precise"),
    )


def select(events: DataFrame, until: int | None = None, since: int | None = None, surface: str | None = None, opportunities: bool = False) -> DataFrame:
    """Events of a window of days (365 that end with until), of one surface, actual ones unless opportunities count too."""
    if not opportunities:
        events = events.filter(F.col("kind") == "actual")
    if surface is not None:
        events = events.filter(F.col("surface") == surface)
    if until is not None:
        events = events.filter(F.col("day").between(until - 364 if since is None else since, until))
    elif since is not None:
        events = events.filter(F.col("day") >= since)
    return events


def daily(events: DataFrame, metric: str = "tokens") -> DataFrame:
    return events.groupBy("day").agg(F.sum(METRICS[metric]).alias("value"), F.count("*").alias("events"), F.sum(F.col("converted").cast("long")).alias("conversions"))


def heatmap(events: DataFrame, since: int, until: int, metric: str = "tokens") -> DataFrame:
    """A row for every day of the window: value, events, conversions, level 0 to 4 by the quintiles of the days with a value, weekday (0: Monday)."""
    spark = events.sparkSession
    days = spark.range(since, until + 1).withColumnRenamed("id", "day")
    cells = days.join(daily(select(events, until, since), metric), "day", "left").fillna(0, ["value", "events", "conversions"])
    # The window's days are the rows here, so one task ranks them.
    ranked = cells.filter("value > 0").select("value", F.row_number().over(Window.orderBy("value")).alias("rn"), F.count("*").over(Window.partitionBy()).alias("n"))
    steps = ranked.agg(*[F.max(F.when(F.col("rn") == F.expr(f"(n * {q} + 99) div 100"), F.col("value"))).alias(f"t{q}") for q in (20, 40, 60, 80)])
    level = F.when(F.col("value") == 0, 0)
    for k, q in ((4, 80), (3, 60), (2, 40), (1, 20)):
        level = level.when(F.col("value") >= F.col(f"t{q}"), k)
    return cells.join(F.broadcast(steps)).select("day", "value", "events", "conversions", level.otherwise(0).alias("level"), F.weekday(F.date_from_unix_date(F.col("day").cast("int"))).alias("weekday"))


def busiest(events: DataFrame, metric: str = "tokens") -> DataFrame:
    """The day with the largest value, the earliest of equals; no row if no day has any."""
    best = daily(events, metric).filter("value > 0").orderBy(F.desc("value"), "day").limit(1)
    return best.select(F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("busiest_day"), F.col("value").alias("v"))


def streak(events: DataFrame, until: int) -> DataFrame:
    """streak: how many days in a row with events end with until; 0 if until has none."""
    days = events.filter(F.col("day") <= until).select("day").distinct()
    islands = days.withColumn("grp", F.col("day") + F.row_number().over(Window.orderBy(F.desc("day"))))
    return islands.filter(F.col("grp") == until + 1).agg(F.count("*").alias("streak"))


def summary(events: DataFrame) -> DataFrame:
    total, conv = F.count("*"), F.coalesce(F.sum(F.col("converted").cast("long")), F.lit(0))
    saved, read = F.coalesce(F.sum("saved_bytes"), F.lit(0)), F.coalesce(F.sum("input_bytes"), F.lit(0))
    return events.agg(
        total.alias("total_events"), F.greatest(saved, F.lit(0)).alias("saved"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens"), conv.alias("conversions"),
        (total - conv).alias("passthroughs"), F.when(read > 0, F.round(saved / read * 100, 6)).otherwise(0.0).alias("avg_reduction_pct"),
    )


def per_surface(events: DataFrame, metric: str = "tokens") -> DataFrame:
    return events.groupBy("surface").agg(F.sum(METRICS[metric]).alias(metric), F.count("*").alias("events"), F.sum(F.col("converted").cast("long")).alias("conversions"))


def families(events: DataFrame) -> DataFrame:
    """Surfaces rolled up by what stands before their colon."""
    family = F.split_part(F.col("surface"), F.lit(":"), F.lit(1))
    return events.groupBy(family.alias("family")).agg(F.sum("saved_bytes").alias("saved"), F.sum("tokens_saved").alias("tokens"), F.count("*").alias("events"), F.sum(F.col("converted").cast("long")).alias("conversions"))


def leaderboard(events: DataFrame, by: str, top: int = 10, metric: str = "bytes") -> DataFrame:
    """The labels (source_label or project_id) that saved most."""
    sums = events.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("label")).agg(F.sum(METRICS[metric]).alias("saved"), F.count("*").alias("events"))
    return sums.orderBy(F.desc("saved"), "label").limit(top)


def cost(events: DataFrame, input_price: float = 2.5, cache_read_price: float = 0.625, turn_reuse: float = 10) -> DataFrame:
    tokens = F.coalesce(F.sum("tokens_saved"), F.lit(0))
    return events.agg(tokens.alias("tokens"), F.round(tokens / 1e6 * input_price, 9).alias("usd"), F.round(tokens / 1e6 * (input_price + turn_reuse * cache_read_price), 9).alias("usd_compounded"))


def recent(events: DataFrame, n: int, tie: str = "source_label") -> DataFrame:
    return events.orderBy(F.desc("ts"), tie).limit(n)


def sparkline(cells: DataFrame, n: int = 30) -> DataFrame:
    """The last n cells of a heatmap and the largest value among them."""
    last = cells.orderBy(F.desc("day")).limit(n)
    return last.withColumn("peak", F.max("value").over(Window.partitionBy()))


def export_csv(events: DataFrame) -> DataFrame:
    """A line an event, as CSV; only labels are ever quoted."""
    cells = [F.coalesce(sizes.csv_label(F.col(c)) if c == "source_label" else F.col(c).cast("string"), F.lit("")) for c in COLUMNS]
    return events.select(F.concat_ws(",", *cells).alias("line"))


def export_prometheus(events: DataFrame) -> DataFrame:
    """Four gauges an event, with milliseconds."""
    labels = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), sizes.label_escape(F.coalesce(F.col(c), F.lit(""))), F.lit('"')) for c in ("surface", "kind", "project_id", "source_label", "doc_type")])
    gauges = F.array(*[F.concat(F.lit(f"conversion_{m}{{"), labels, F.lit("} "), F.col(m).cast("string"), F.lit(" "), (F.col("ts") * 1000).cast("string")) for m in ("saved_bytes", "tokens_saved", "input_bytes", "output_bytes")])
    return events.select(F.explode(gauges).alias("line"))


def export_otel(events: DataFrame) -> DataFrame:
    """A nested JSON object an event, with nanoseconds."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    attributes = F.struct(*[text(c) for c in ("surface", "kind", "project_id", "source_label", "doc_type")], (F.col("converted") == 1).alias("converted"), (F.col("precise") == 1).alias("precise"))
    point = F.struct(attributes.alias("attributes"), (F.col("ts") * 1_000_000_000).alias("time_unix_nano"), F.struct("saved_bytes", "tokens_saved", "input_bytes", "output_bytes").alias("as_double"))
    metric = F.struct(F.lit("conversion").alias("name"), F.lit("Conversion event").alias("description"), F.lit("1").alias("unit"), F.struct(F.array(point).alias("points")).alias("data"))
    return events.select(F.to_json(F.struct(F.struct(F.lit("quillet").alias("service.name")).alias("resource"), F.struct(F.lit("ledger").alias("name")).alias("scope"), metric.alias("metric"))).alias("line"))


def export_json(events: DataFrame) -> DataFrame:
    """A JSON object an event; nulls are written."""
    return events.select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("line"))


EXPORTS = {"csv": export_csv, "prometheus": export_prometheus, "otel": export_otel, "json": export_json}


def export(events: DataFrame, form: str) -> DataFrame:
    """The lines of an export in the order of the events' times; events of one time are ordered by surface, label and sizes."""
    return EXPORTS[form](events.orderBy("ts", "surface", "source_label", "input_bytes", "output_bytes"))


def record(events: DataFrame, *paths: str) -> None:
    """Append events to one ledger or more, partitioned by day."""
    for path in paths:
        events.select(*COLUMNS).write.mode("append").partitionBy("day").parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def reset(spark, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").partitionBy("day").parquet(path)


def dashboard(events: DataFrame, since: int, until: int) -> dict[str, DataFrame]:
    kept = select(events, until, since)
    return {"summary": summary(kept), "heatmap": heatmap(events, since, until), "surfaces": per_surface(kept), "top": leaderboard(kept, "source_label"), "recent": recent(events, 100)}
