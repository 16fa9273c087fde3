"""What the corpus operators share: tables, shared scratch tables, worker set-up, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Batches that go to Python workers hold so many bytes at most (or one row), and are worked on so many rows at a time.
BATCH_BYTES, ROWS_AT_ONCE = 16 << 20, 256


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imported it, and keep the batches they get small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "67108864b"):  # not where the user has chosen a size
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; where none is set, a temporary one of this machine, if it is the only one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillet-"))
    return sc.getCheckpointDir().rstrip("/")


_written: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that later jobs neither repeat it nor depend on executors that may be lost."""
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/quillet-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    if _written:
        _written[-1].append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within the block, tables written by cut() are the block's own and go at its end, but those that a DataFrame given to keep() reads.

    For results that are written before the block ends; the tables of one that is returned unread have to stay.
    """
    _written.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.extend(folder for folder in _written[-1] if any(folder.rsplit("/", 1)[1] in f for f in files))
        return df

    try:
        yield keep
    finally:
        own = _written.pop()
        if _written:
            _written[-1].extend(kept)
        drop_folders(spark, [folder for folder in own if folder not in kept])


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: A side of a join is broadcast up to so many rows of a few numbers, and shuffled beyond.
SMALL = 200_000


def sized(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """rows (a few numbers each), to be broadcast up to `small` of them; beyond that Spark joins by a shuffle."""
    return F.broadcast(rows) if rows.count() <= small else rows


def content(text: Column | str) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def stable_fraction(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns' values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) * F.lit(2.0**-53)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, whose texts fit as Python objects; at the end the worker gives memory back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Remembers the 64-bit hash of words (bytes); forgets all beyond `most` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()
_places: list[np.uint64] = []


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words in order; of fewer words, one hash of the whole run; of none, nothing."""
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    size = len(words) - width + 1
    out = np.full(size, width, np.uint64)
    for i in range(width):
        out += codes[i : i + size] * _place(i)
    return mix64(out)


def _place(i: int) -> np.uint64:
    """An odd factor for the word at place i; the factors have no simple relation, so words that change places change the sum."""
    while len(_places) <= i:
        _places.append(mix64(np.array([(len(_places) + 1) * 0x9E3779B97F4A7C15 & _MASK], np.uint64))[0] | np.uint64(1))
    return _places[i]
