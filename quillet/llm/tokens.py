"""Encoding with a public byte-level vocabulary, and the exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, slices, table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as the tokenizers library gives them for the file (add_special_tokens=False).

    Where the same vocabulary lies beside it as ranks, texts go through tiktoken, which gives the same ids
    several times faster; texts that hold the string of a special token always go through tokenizers.
    """

    def __init__(self, path: str):
        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special):
            return np.asarray(self.exact(text), np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row per row of docs: n_tokens, the ids of its whole text; a null or empty text has 0."""
    prepare(docs.sparkSession)
    path = path or vocabulary_path()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """From one row a document (n_tokens) to one row a distinct length, with suffix sums.

    n_tokens, n_docs; docs_at_least and tokens_at_least: documents of this length or longer and their tokens;
    total_docs, total_tokens; quantile: share of documents no longer than this; truncated_total: tokens left
    when every document is cut to n_tokens. Sums run over blocks of lengths first, so no task holds more than
    `block` lengths or one row a block. No documents give no rows.
    """
    counted = cut(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")  # used twice; texts are encoded once
    hist = counted.withColumns({"_b": F.floor(F.col("n_tokens") / block), "_t": F.col("n_docs") * F.col("n_tokens")})
    blocks = hist.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    everything = Window.partitionBy()
    blocks = blocks.select("_b", F.coalesce(F.sum("_bd").over(after), zero).alias("_ad"), F.coalesce(F.sum("_bt").over(after), zero).alias("_at"), F.sum("_bd").over(everything).alias("total_docs"), F.sum("_bt").over(everything).alias("total_tokens"))
    inside = Window.partitionBy("_b").orderBy(F.desc("n_tokens"))
    out = hist.join(blocks, "_b").withColumns({"docs_at_least": F.col("_ad") + F.sum("n_docs").over(inside), "tokens_at_least": F.col("_at") + F.sum("_t").over(inside)})
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: total_docs, total_tokens, truncated_total, docs_cut. Answered from the histogram's rows alone."""
    cells = histogram.select("n_tokens", "n_docs")
    kept = [F.sum(F.least(F.col("n_tokens"), F.lit(x)) * F.col("n_docs")).alias(f"t{x}") for x in limits]
    cut_ = [F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs")).otherwise(0)).alias(f"c{x}") for x in limits]
    one = cells.agg(F.sum("n_docs").alias("total_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("total_tokens"), *kept, *cut_)
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"t{x}").alias("truncated_total"), F.col(f"c{x}").alias("docs_cut")) for x in limits])
    return one.select("total_docs", "total_tokens", F.explode(rows).alias("r")).select("r.context_limit", "total_docs", "total_tokens", "r.truncated_total", "r.docs_cut")


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents doesn't exceed."""
    return histogram.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op8_token_counts(spark, sf_dir):
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE = {}
