"""Payload files as rows: a recursive scan with ignore rules, a size cap that keeps large contents unread, and snapshots for the index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.detect import hint_of_path
from quillet.operators.convert import CLI, Options, convert_payloads

#: Up to so many changed files are opened by their paths; beyond that the tree is read.
MOST_PATHS = 10_000


def glob_pattern(glob: str) -> str:
    """A Java regular expression for a path relative to the root, by the rules of ignore files (without negation)."""
    if glob.count("[") != glob.count("]") or not glob.strip("/ "):
        raise ValueError(f"bad pattern {glob!r}")
    rooted, only_dirs = glob.startswith("/") or "/" in glob.rstrip("/"), glob.endswith("/")
    out, i, g = "", 0, glob.strip("/")
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "[":
            end = g.index("]", i)
            out, i = out + "[" + g[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    return ("^" if rooted else "(?:^|.*/)") + out + ("/.*$" if only_dirs else "(?:/.*)?$")


def ignored(path, globs: list[str]):
    """The last rule that matches decides; `!` takes back."""
    out = F.lit(False)
    for g in globs:
        g = g.strip()
        if g and not g.startswith("#"):
            out = F.when(path.rlike(glob_pattern(g.removeprefix("!"))), F.lit(not g.startswith("!"))).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] = (), exclude: list[str] = (), most_files: int | None = None, hidden: bool = False) -> DataFrame:
    """path (relative), size_bytes, mtime_unix of the files below root. No content is read; where most_files is given, more are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/+", "")
    out = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("mtime_unix"))
    if not hidden:
        out = out.filter(~F.col("path").rlike(r"(?:^|/)\."))
    out = out.filter(~ignored(F.col("path"), list(ignore)) & ~ignored(F.col("path"), list(exclude)))
    if most_files is not None and out.count() > most_files:
        raise ValueError(f"more than {most_files} files")
    return out


def contents(spark: SparkSession, root: str, most_bytes: int, only: DataFrame | None = None) -> DataFrame:
    """path and payload of files up to most_bytes; the size is checked in the scan, so larger files aren't opened. only: a table of the paths wanted."""
    base = root.rstrip("/").removeprefix("file:")
    reader, where = spark.read.format("binaryFile"), root
    if only is not None:
        wanted = [r["path"] for r in only.select("path").limit(MOST_PATHS + 1).collect()]
        if not wanted:
            return spark.createDataFrame([], "path string, payload binary")
        if len(wanted) <= MOST_PATHS and not any(set(p) & set("*?[]{}\\") for p in wanted):
            where, only = [f"{root.rstrip('/')}/{p}" for p in wanted], None
    files = (reader.load(where) if isinstance(where, list) else reader.option("recursiveFileLookup", True).load(where)).filter(F.col("length") <= most_bytes)
    out = files.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/+", "").alias("path"), F.col("content").alias("payload"))
    return out if only is None else out.join(only.select("path"), "path", "left_semi")


def index_files(spark: SparkSession, root: str, now: int, options: Options = CLI, known: DataFrame | None = None, **rules) -> dict[str, DataFrame]:
    """files, shapes and conversions of a scan. Files above the cap have a row without a type and no dependents.

    known is the files table of the last scan: files of the same size and time keep their row's digest and type and aren't
    opened, and have no shapes and conversions here (a sync keeps theirs).
    """
    listed = scan(spark, root, **rules)
    same = None
    if known is not None:
        stat = ["path", "size_bytes", "mtime_unix"]
        same = listed.join(known.select(*stat, "content_hash", "doc_type", "scanned_at"), stat)
        listed = listed.join(known.select(*stat), stat, "left_anti")
    read = contents(spark, root, options.max_input_bytes, listed)
    done = convert_payloads(read.withColumn("hint", F.lit(None).cast("string")), options, hint="hint")
    done = done.withColumn("content_hash", F.sha2("payload", 256)).drop("payload", "text")
    files = listed.join(done.select("path", "content_hash", "doc_type"), "path", "left").withColumn("scanned_at", F.lit(now).cast("long"))
    known = done.filter("doc_type is not null")
    uniform = F.col("shape_class") == "uniform"
    shapes = known.select("path", F.lit("").alias("json_pointer"), F.coalesce("shape_class", F.lit("unknown")).alias("shape_class"), F.when(uniform, F.col("uniformity_pct")).alias("uniformity_pct"), F.when(uniform, F.col("sampled_count").cast("long")).alias("sampled_count"))
    conversions = known.filter("json_bytes is not null").select("path", F.lit("").alias("json_pointer"), "json_bytes", "toon_bytes", "savings_pct", F.lit(None).cast("string").alias("cached_toon_text"), F.lit(now).cast("long").alias("computed_at"))
    files = files.select("path", "size_bytes", "mtime_unix", "content_hash", "doc_type", "scanned_at")
    if same is not None:
        files = files.unionByName(same)
    return {"files": files, "shapes": shapes, "conversions": conversions}


def hinted(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("hint", hint_of_path(F.col("path")))
