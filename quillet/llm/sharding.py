"""Uniform sharding by a hypergeometric communication matrix, in DataFrame operations only.

Rows fall into blocks by a hash of their columns. From the blocks' counts the driver draws, with exact multivariate
hypergeometric steps, how many rows each block sends to each shard; the matrix has the blocks' counts and the
shards' sizes as its margins. A block's rows are permuted and dealt out by these counts, and a shard's rows are
permuted again. The result is a uniform shuffle whose shards differ by one row at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import content, cut, table

_NUMPY_MOST = 10**9 - 1


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows taken without return are good; beyond numpy's range by inversion from the mode."""
    if good + bad <= _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(lg(good, mode) + lg(bad, draws - mode) - lg(good + bad, draws))
    u = rng.random() - p
    left, right, p_left, p_right = mode, mode, p, p
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            if (u := u - p_right) <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            if (u := u - p_left) <= 0:
                return left
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """A random matrix of counts with the given sums of rows and columns, as uniform shuffles have it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    free, out = list(sizes), []
    for n in counts:
        row, rest = [], sum(free)
        for k, size in enumerate(free):
            rest -= size
            take = _hypergeometric(rng, size, rest, n) if rest and n else n
            row.append(take)
            n -= take
            free[k] -= take
        out.append(row)
    return out


def shard_uniform(rows: DataFrame, shards: int, seed: int = 7, rows_per_block: int = 200_000) -> DataFrame:
    """rows with two more columns: shard (0 to shards - 1) and slot (gapless from 0 within the shard).

    The counts of shards differ by one at most, the first ones get the extra rows. The same rows and seed give
    the same result, however the rows are partitioned; blocks and places are by a hash of all columns, so rows that
    share a key (or have none) spread like others. An empty table gives no rows. Columns named shard or slot are replaced.
    """
    spark, own = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(*own)
    total = rows.count()
    blocks = max(64, min(8192, -(-total // rows_per_block)))
    ties = [F.col(c) for c in own]
    block = F.pmod(F.xxhash64(*ties, F.lit(seed)), F.lit(blocks)).cast("int")
    counts = dict(rows.groupBy(block.alias("b")).count().collect())  # at most `blocks` rows
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    ends = spark.createDataFrame([(b, [int(x) for x in np.cumsum(row)]) for b, row in enumerate(matrix)], "_shard_b int, _shard_ends array<bigint>")
    dealt = rows.withColumns({"_shard_b": block, "_shard_k": F.xxhash64(*ties, F.lit(seed + 1))})
    dealt = dealt.withColumn("_shard_r", F.row_number().over(Window.partitionBy("_shard_b").orderBy("_shard_k", *ties)) - 1)
    # 8192 blocks of one number a shard: some MB at most, whatever the input.
    dealt = dealt.join(F.broadcast(ends), "_shard_b").withColumn("shard", F.size(F.filter("_shard_ends", lambda end: end <= F.col("_shard_r"))))
    parts = max(8, min(2048, -(-total // (shards * 50_000))))
    placed = cut(dealt.withColumn("_shard_k", F.xxhash64(*ties, "shard", F.lit(seed + 2))).select(*own, "shard", "_shard_k", F.pmod(F.xxhash64("_shard_k", F.lit(seed)), F.lit(parts)).cast("int").alias("_shard_p")), "placed")
    before = placed.groupBy("shard", "_shard_p").count().withColumn("_shard_before", F.sum("count").over(Window.partitionBy("shard").orderBy("_shard_p")) - F.col("count")).drop("count")
    slot = F.col("_shard_before") + F.row_number().over(Window.partitionBy("shard", "_shard_p").orderBy("_shard_k", *ties)) - 1
    return placed.join(F.broadcast(before), ["shard", "_shard_p"]).select(*own, "shard", slot.cast("long").alias("slot"))  # parts a shard are bounded


def op7_sharding(spark, sf_dir):
    raw = content("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    out = shard_uniform(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE = {}
