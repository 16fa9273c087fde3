"""The file index: snapshots of files, their shapes and conversions; synchronisation as joins; ranked savings.

files: path, size_bytes, mtime_unix, content_hash, doc_type, scanned_at. shapes and conversions: see SCHEMAS; both
belong to a file by its path. A sync never updates in place; it gives the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 2
SCHEMAS = {
    "files": "path string, size_bytes long, mtime_unix long, content_hash string, doc_type string, scanned_at long",
    "shapes": "path string, json_pointer string, shape_class string, uniformity_pct double, sampled_count long",
    "conversions": "path string, json_pointer string, json_bytes long, toon_bytes long, savings_pct double, cached_toon_text string, computed_at long",
    "meta": "key string, value string",
}
SECONDS = 86400.0


def diff(old: DataFrame, cur: DataFrame, key: str = "path", mtime: str = "mtime_unix", size: str | None = "size_bytes", digest: str = "content_hash") -> DataFrame:
    """key and state of every file: added, removed, unchanged (same time and size, or same contents), touched (same contents, other time), updated."""
    same_stat = F.col(f"old.{mtime}") == F.col(f"cur.{mtime}")
    if size:
        same_stat &= F.col(f"old.{size}") == F.col(f"cur.{size}")
    state = F.when(F.col(f"old.{key}").isNull(), "added").when(F.col(f"cur.{key}").isNull(), "removed").when(same_stat, "unchanged").when(F.col(f"old.{digest}") == F.col(f"cur.{digest}"), "touched").otherwise("updated")
    joined = old.alias("old").join(cur.alias("cur"), F.col(f"old.{key}") == F.col(f"cur.{key}"), "full_outer")
    return joined.select(F.coalesce(f"old.{key}", f"cur.{key}").alias(key), state.alias("state"))


def vanished(old: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """Keys of stored files that a walk hasn't seen."""
    return old.select(key).join(seen.select(key), key, "left_anti")


def sync_counts(states: DataFrame) -> DataFrame:
    """Rows by state; touched files count as unchanged."""
    return states.groupBy(F.when(F.col("state") == "touched", "unchanged").otherwise(F.col("state")).alias("state")).agg(F.count("*").alias("n"))


def next_files(old: DataFrame, cur: DataFrame, now: int, key: str = "path") -> DataFrame:
    """The next snapshot of files: new and changed rows as they are now, touched ones with their new times, others as they were."""
    states = diff(old, cur, key)
    fresh = cur.join(states.filter(F.col("state").isin("added", "updated", "touched")).select(key), key, "left_semi").withColumn("scanned_at", F.lit(now).cast("long"))
    kept = old.join(states.filter("state = 'unchanged'").select(key), key, "left_semi")
    return kept.unionByName(fresh)


def cascade(dependents: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """The dependents whose file is still there."""
    return dependents.join(files.select(key), key, "left_semi")


def replace_dependents(dependents: DataFrame, fresh: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Dependents of surviving files, with those of rescanned files replaced."""
    return cascade(dependents.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh), files, key)


def stats(files: DataFrame, conversions: DataFrame, mode: str = "savings", top: int | None = 10, doc_type: str | None = None, key: str = "path") -> DataFrame:
    """Files ranked by score: savings (a row a conversion), count (average times number) or recency (average, fading by e a day behind the newest)."""
    if doc_type is not None:
        files = files.filter(F.col("doc_type").isNull() if doc_type == "bin" else F.col("doc_type") == doc_type)
    rows = conversions.join(files.select(key, "doc_type"), key)
    if mode == "savings":
        out = rows.select(key, "doc_type", "json_bytes", "toon_bytes", "savings_pct", F.col("savings_pct").alias("score"), F.lit(1).cast("long").alias("conversion_count"))
    else:
        g = rows.groupBy(key, "doc_type").agg(F.sum("json_bytes").alias("json_bytes"), F.sum("toon_bytes").alias("toon_bytes"), F.avg("savings_pct").alias("savings_pct"), F.max("computed_at").alias("last"), F.count("*").alias("conversion_count"))
        newest = g.agg(F.max("last").alias("newest"))
        fade = F.exp(-(F.col("newest") - F.col("last")) / SECONDS)
        g = g.join(F.broadcast(newest)).withColumn("score", F.col("savings_pct") * (F.col("conversion_count") if mode == "count" else fade))  # one row
        out = g.drop("last", "newest")
    out = out.orderBy(F.desc("score"), key)
    return out.limit(top) if top else out


def status(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count("doc_type").alias("classified"), F.max("scanned_at").alias("last_scan"))


def show(files: DataFrame, shapes: DataFrame, conversions: DataFrame, path: str) -> DataFrame:
    """One file with its shape and conversion."""
    at = files.filter(F.col("path") == path)
    return at.join(shapes.filter(F.col("path") == path), "path", "left").join(conversions.filter(F.col("path") == path).drop("json_pointer"), "path", "left")


def surviving_protected(columns: DataFrame, protected: DataFrame) -> DataFrame:
    """Column names outside of the protected ones."""
    return columns.exceptAll(protected)


