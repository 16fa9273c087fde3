"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Every row's digest is written once, with a salt that tells the tasks apart. Texts whose digest no other row has are
alone; the others are combined three times: within each task that reads them (the partial aggregate of the first
grouping), within salted groups of a digest, and over the salts of a digest. Every grouping has the normalised
text itself among its keys, so the full contents decide at every stage; the digest only spreads the groups. A
group that holds a third of all rows therefore reaches the shuffle as one row a task and salt, and its result goes
back to its rows salt by salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, SPACE_CLASS, content, cut, sized, table

_ID_SPAN = 10**19


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 256) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, n_chars.

    Two texts are equal when nothing but white space ([\\x20\\x09-\\x0D]) tells them apart. The row with the most
    code points stays, of these the one with the smallest id. A null text is an empty one; all empty texts are
    one group. Rows that repeat an id and a text are rows of one group like others, and rows that share the id of
    the row that stays are all marked kept (drop them as duplicate ids beforehand if ids aren't unique). A null
    id never wins over another. An empty table gives no rows; other columns of docs are neither read nor returned.
    Two contents with one SHA-256 would stop the job with an error rather than be merged.
    """
    raw = content(text_col)
    salt = (F.spark_partition_id() % salts).cast("int").alias("salt")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(raw).cast("long").alias("n_chars"), F.regexp_replace(raw, SPACE_CLASS + "+", "").alias("norm"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    slim = cut(rows.select("doc_id", "n_chars", "digest", salt), "digests")
    met = slim.groupBy("digest", "salt").agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    shared = cut(met.filter("n > 1").select("digest", "salts"), "shared")  # at most `salts` numbers a row
    few = shared.count() <= SMALL
    # Texts alone with their digest needn't be moved to know it. Too many digests to be broadcast: all texts are combined.
    pool = rows.join(F.broadcast(shared.select("digest")), "digest", "left_semi") if few else rows
    local = pool.select("digest", "norm", "n_chars", "doc_id", salt).groupBy("digest", "norm", "salt", "n_chars").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    # One number that orders by length, then by the smaller id, so that hash aggregation can carry it.
    rank = F.col("n_chars").cast("decimal(10,0)") * F.lit(str(10 * _ID_SPAN)).cast("decimal(21,0)") + (F.lit(str(_ID_SPAN)).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(19,0)"))
    winners = local.groupBy("digest", "norm", "salt").agg(F.max(rank.cast("decimal(38,0)")).alias("best"), F.sum("n").alias("n"))
    contents = winners.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    classes = contents.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.count("*").alias("contents")).filter("n > 1")
    keep = (F.lit(str(_ID_SPAN)).cast("decimal(20,0)") - F.col("best") % F.lit(str(10 * _ID_SPAN)).cast("decimal(38,0)")).cast("long")
    classes = classes.select("digest", F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents share a SHA-256"))).otherwise(keep).cast("long").alias("keep_id"), F.col("n").alias("group_size"))
    back = cut(classes.join(shared, "digest").select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size"), "classes")
    found = slim.join(sized(back), ["digest", "salt"], "left")
    alone = F.col("group_size").isNull()
    keep_id, size = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1))
    return found.select("doc_id", keep_id.cast("long").alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE = {"op3_exact_dedup": SQL}
