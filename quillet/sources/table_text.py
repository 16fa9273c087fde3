"""A Spark data source for table texts: spark.read.format("toon") gives path and value (compact JSON) of each file, writing makes one file a row."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillet.functions import toon
from quillet.functions.values import dumps, loads
from quillet.operators.convert import decode_any


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    names: list


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        root = Path(self.path)
        return [_File(str(p)) for p in ([root] if root.is_file() else sorted(root.rglob("*.toon")))]

    def read(self, partition):
        if partition is not None:
            yield partition.path, dumps(decode_any(Path(partition.path).read_text("utf-8")))


class _Writer(DataSourceWriter):
    """Files appear under their names only when the whole job has succeeded."""

    def __init__(self, path: str):
        self.path = path
        self.stage = os.path.join(path, f"_staged-{uuid.uuid4().hex}")

    def write(self, rows):
        os.makedirs(self.stage, exist_ok=True)
        names = []
        for row in rows:
            names.append(f"{uuid.uuid4().hex}.toon")
            Path(self.stage, names[-1]).write_text(toon.encode(loads(row["value"])), "utf-8")
        return _Written(names)

    def commit(self, messages):
        for m in messages:
            for name in m.names if m else ():
                os.replace(os.path.join(self.stage, name), os.path.join(self.path, name))
        self.abort(messages)

    def abort(self, messages):
        if os.path.isdir(self.stage):
            for p in Path(self.stage).iterdir():
                p.unlink()
            os.rmdir(self.stage)


class ToonSource(DataSource):
    """For folders that driver and executors share."""

    @classmethod
    def name(cls):
        return "toon"

    def schema(self):
        return "path string, value string"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        os.makedirs(self.options["path"], exist_ok=True)
        return _Writer(self.options["path"])
