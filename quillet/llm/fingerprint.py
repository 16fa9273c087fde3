"""Document fingerprints by consistent weighted sampling.

A document is its multiset of five-word shingles, a shingle's weight is its count. For each of K samples every
term draws r and c from Gamma(2, 1) and beta from [0, 1), the same for every document that has the term; with
t = floor(ln w / r + beta) the term scores ln c - r (t - beta) - r, and the term of the smallest score, with its t,
is the sample. Two documents share a sample with a probability of sum(min of weights) / sum(max of weights).
The draws come from a fixed table of 2^17 triples, addressed by double hashing of the term, so a sample costs a
look-up instead of five uniform numbers and their logarithms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content, mix64, prepare, shingle_hashes, slices, table

SAMPLES, SHINGLE, POOL_BITS, SEED, TERMS_AT_ONCE, KEPT = 128, 5, 17, 20177, 4096, 4


def _orderable(x: np.ndarray) -> np.ndarray:
    """float32 as uint32 in the same order."""
    bits = x.astype(np.float32).view(np.uint32)
    return bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))


class Pool:
    def __init__(self, bits: int = POOL_BITS, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mask = (1 << bits) - 1
        self.r, self.c = (rng.standard_gamma(2, 1 << bits).astype(np.float32) for _ in range(2))
        self.beta = rng.random(1 << bits, dtype=np.float32)
        self.log_c = np.log(self.c)
        self.unit = _orderable(self.log_c - self.r * (1 - self.beta))  # scores at weight 1, where t is 0


_pools: list[Pool] = []


def _counted(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different terms in order, and how often each occurs."""
    terms = np.sort(terms)
    starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    return terms[starts], np.diff(starts, append=len(terms))


class Sketch:
    """The samples of a text, and the scores of its terms of weight 1, for texts that share them."""

    def __init__(self, words: list[bytes], known: tuple[Sketch, ...] = (), samples: int = SAMPLES, shingle: int = SHINGLE, keep: bool = False):
        self.scored: list[tuple[np.ndarray, np.ndarray]] = []
        self.samples = np.zeros(samples, np.uint16)  # a text without words has this
        if not words:
            return
        if not _pools:
            _pools.append(Pool())
        self.best = np.full(samples, 0xFFFFFFFF, np.uint32)
        self.term, self.id = np.full(samples, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(samples, np.uint64)
        self.each, self.steps = np.arange(samples), np.arange(samples)[:, None]
        terms, weights = _counted(shingle_hashes(words, shingle))
        for h, scores in (x for k in known for x in k.scored):
            at = np.searchsorted(h, terms)
            at[at == len(h)] = 0
            found = (h[at] == terms) & (weights == 1)
            if found.any():
                self._take(terms[found], scores.take(at[found], 1))
                terms, weights = terms[~found], weights[~found]
        for i in range(0, len(terms), TERMS_AT_ONCE):
            self._score(_pools[0], terms[i : i + TERMS_AT_ONCE], weights[i : i + TERMS_AT_ONCE], keep and len(self.scored) < KEPT)
        self.samples = (mix64(self.id) & np.uint64(0xFFFF)).astype(np.uint16)

    def _score(self, pool: Pool, h: np.ndarray, w: np.ndarray, keep: bool) -> None:
        at = ((h >> np.uint64(40)).astype(np.int64) * self.steps + (h & np.uint64(pool.mask)).astype(np.int64)) & pool.mask
        heavy = w > 1
        if heavy.any():
            a = at[:, heavy]
            t = np.floor(np.log(w[heavy]).astype(np.float32) / pool.r[a] + pool.beta[a])
            scores = _orderable(pool.log_c[a] - pool.r[a] * (t - pool.beta[a]) - pool.r[a])
            self._take(h[heavy], scores, t.astype(np.int64).view(np.uint64))
            h, at = h[~heavy], at[:, ~heavy]
        if len(h):
            scores = pool.unit.take(at)
            self._take(h, scores)
            if keep:
                self.scored.append((h, scores))

    def _take(self, h: np.ndarray, scores: np.ndarray, t: np.ndarray | None = None) -> None:
        """Keep the smallest scores; of equal ones that of the smallest term."""
        arg = scores.argmin(1)
        low, term = scores[self.each, arg], h[arg]
        id_ = term if t is None else term + t[self.each, arg] * np.uint64(0x9E3779B97F4A7C15)
        better = (low < self.best) | (low == self.best) & (term < self.term)
        self.best[better], self.term[better], self.id[better] = low[better], term[better], id_[better]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return float(np.count_nonzero(a == b)) / len(a)


def text_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def text_signature(text: str, samples: int = SAMPLES, shingle: int = SHINGLE) -> np.ndarray:
    """`samples` numbers of 16 bits."""
    return Sketch(text_words(text), (), samples, shingle).samples


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (4 hexadecimal digits a sample) of every row; null texts as empty ones, whose samples are all 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [text_signature(t or "").astype(">u2").tobytes().hex() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _bucket(column: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the column, by a search in two steps; -1 for null."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(_numbers(bounds[step - 1 :: step]), lambda b: b <= column))
    fine = F.size(F.filter(F.slice(_numbers(bounds), coarse * step + 1, F.lit(step)), lambda b: b <= column)) if bounds else F.lit(0)
    return F.when(column.isNull(), -1).otherwise(coarse * step + fine).cast("int")


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 4096) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third comes from the start of the next document (descending ids, after the last the first).

    The ids' quantiles cut the table into ranges; a range is sorted and read as a stream, with the first row of
    the range below as a guest at its end, so texts are moved once. Rows of equal ids follow in the order of their
    texts; null ids come last; a null text is empty; a table of one row has itself as its next; an empty table
    gives no rows. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), content(text_col).alias("text"))
    buckets = max(8, min(65_536, -(-rows.count() // rows_per_bucket)))
    shares = [k / buckets for k in range(1, buckets)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * buckets)).first()[0] or []  # one number a bucket
    bounds = sorted(set(found))
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    heads = dict(rows.groupBy("bucket").agg(F.max("doc_id")).collect())  # one row a bucket
    order = sorted(heads, reverse=True)
    # The guest of a bucket is the head of the next lower one; of the lowest, the head of the highest.
    guest_of = spark.createDataFrame([(b, heads[order[(k + 1) % len(order)]]) for k, b in enumerate(order)], "for_bucket int, head long")
    ids = sorted({x for x in heads.values() if x is not None})
    head_rows = rows.select("doc_id", "text").filter(F.col("doc_id").isin(ids) if None not in heads.values() else F.col("doc_id").isNull() | F.col("doc_id").isin(ids))
    head_rows = head_rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("n = 1")
    guests = guest_of.join(head_rows, F.col("head").eqNullSafe(F.col("doc_id"))).select("doc_id", "text", F.col("for_bucket").alias("bucket"), F.lit(1).alias("guest"))
    stream = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition(2 * buckets, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text, guest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                own = Sketch(text_words(text), keep=True)
                if before:
                    doc0, text0, own0 = before
                    n, third = len(text0), len(text0) // 3
                    edited = text0[: n - third] + text[:third]
                    second = Sketch(text_words(edited), (own0, own)).samples
                    first = own0.samples
                    out.append((doc0, n, hashlib.sha256(edited.encode()).hexdigest(), first.astype(">u2").tobytes().hex(), second.astype(">u2").tobytes().hex(), likeness(first, second), likeness(first, own.samples)))
                before = None if guest else (doc, text, own)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return stream.select("doc_id", "text", "bucket", "guest").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_document_fingerprints(spark, sf_dir):
    return compare_with_edited(table(spark, sf_dir, "documents"))


QUERIES = {"op2_document_fingerprints": op2_document_fingerprints}
ORACLE = {}
