"""A corpus from documents to packed sequences, in five stages over the operators of quillet.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows its predecessor kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm.common import cut, scratch, sized, table
from quillet.llm.exact_dedup import exact_dedup
from quillet.llm.jaccard_join import jaccard_components
from quillet.llm.mixing import mix
from quillet.llm.packing import pack
from quillet.llm.toxicity import drop_toxic

ROW = "_quillet_row"


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the column that tells its rows apart: doc_id, or where ids repeat or are null, numbers in the order of the ids, nulls last."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text", "source"))
    return cut(ordered.withColumn(ROW, F.monotonically_increasing_id()), "rows"), ROW


def _found(spark: SparkSession, find: Callable[[], DataFrame], name: str) -> DataFrame:
    """What find gives, written; the tables it needed on the way go."""
    with scratch(spark) as keep:
        return keep(cut(find(), name))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, trained on the labelled ones among docs, doesn't reject.

    Null and empty texts are clean and stay; texts are read whole, however long; repeated rows fare alike; without labels,
    or with labels of one kind, all stay.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, of these the one with the smallest id; null ids come last.

    Null and empty texts are one group. Of rows that tie in all this, or repeat, one stays. Whole texts are compared.
    """
    rows, row = _rows(docs)
    dropped = _found(spark, lambda: exact_dedup(rows, id_col=row).filter(~F.col("kept")).select(F.col("doc_id").alias(row)), "copies")
    return rows.join(sized(dropped), row, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: five-word shingles, similarity of 0.8 or more.

    Null and empty texts have no shingles and stay. Rows of one id count as documents of their own, in the order of a
    hash of their texts; of repeated rows one stays. Whole texts are compared.
    """
    rows, row = _rows(docs)
    dropped = _found(spark, lambda: jaccard_components(rows, n=5, num=4, den=5, id_col=row).filter("component_id <> doc_id").select(F.col("doc_id").alias(row)), "near")
    return rows.join(sized(dropped), row, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; a null source is one of its own.

    Null and empty texts have no words and are taken as often as others. Repeated rows are rows of their own.
    """
    rows, row = _rows(docs)
    copies = _found(spark, lambda: mix(rows, id_col=row).filter("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias("_quillet_copies")), "taken")
    taken = rows.join(sized(copies), row).withColumn("_quillet_copy", F.explode(F.sequence(F.lit(1), F.col("_quillet_copies"))))
    return taken.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens.

    Null and empty texts are a single end token. Only documents of more tokens than a sequence holds are cut. Repeated
    rows (the mix repeats documents) are packed each.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", dedup), ("ngram_jaccard_join", near_dedup), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: SQL can express neither the model nor balanced sampling; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for name, stage in STAGES:
            docs = _found(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        return keep(docs)
