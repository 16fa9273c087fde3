"""The index on disk: a folder with a version and numbered snapshots of its tables; a sync adds the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators import index

TABLES = ("files", "shapes", "conversions")


class VersionError(ValueError):
    """The folder was written by an unknown version."""


class IndexStore:
    """A snapshot counts once its row in meta is written, which is the last step; readers never see half of one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _meta(self) -> dict[str, str]:
        try:
            rows = self.spark.read.schema("key string, value string, at long").parquet(f"{self.root}/meta")
            return dict(rows.groupBy("key").agg(F.max_by("value", "at")).collect())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise

    def _say(self, at: int, **values: str) -> None:
        self.spark.createDataFrame([(k, v, at) for k, v in values.items()], "key string, value string, at long").coalesce(1).write.mode("append").parquet(f"{self.root}/meta")

    def current(self) -> int:
        """The number of the last snapshot, 0 if there is none; other versions than this one and the one before are errors."""
        meta = self._meta()
        version = int(meta.get("schema_version", index.VERSION))
        if version not in (1, index.VERSION):
            raise VersionError(f"version {version}")
        return int(meta.get("snapshot", 0))

    def read(self, table: str) -> DataFrame:
        n = self.current()
        schema = index.SCHEMAS[table]
        if not n:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{n}/{table}")  # columns an older version lacks are null

    def write(self, tables: dict[str, DataFrame]) -> int:
        n = self.current() + 1
        for t in TABLES:
            names = [c.split()[0] for c in index.SCHEMAS[t].split(", ")]
            tables[t].select(*names).write.mode("overwrite").parquet(f"{self.root}/{n}/{t}")
        self._say(n, schema_version=str(index.VERSION), snapshot=str(n))
        return n

    def sync(self, scanned: dict[str, DataFrame], now: int) -> DataFrame:
        """Take over a scan: changed files replace their dependents, vanished ones lose theirs. Returns the counts by state."""
        old, cur = self.read("files"), scanned["files"]
        states = index.diff(old, cur)
        counts = self.spark.createDataFrame(index.sync_counts(states).collect(), "state string, n long")  # at most four rows
        files = index.next_files(old, cur.select(*old.columns), now)
        fresh = states.filter(F.col("state").isin("added", "updated")).select("path")
        tables = {"files": files}
        for t in TABLES[1:]:
            kept = self.read(t).join(fresh, "path", "left_anti")
            tables[t] = index.cascade(kept.unionByName(scanned[t].join(fresh, "path", "left_semi")), files)
        self.write(tables)
        return counts

    def compact(self, files: int = 1) -> int:
        """The same rows in fewer files, as the next snapshot."""
        return self.write({t: self.read(t).coalesce(files) for t in TABLES})
