"""Language identification by prediction by partial matching.

Each language has byte context trees of order 0 to 3, grown from a bounded sample of labelled rows and then
frozen. A byte after its three predecessors costs -log2 of its share in the longest context that knows it; every
longer context that doesn't costs its escape (method C: a context with T bytes, q of them different, escapes with
q / (T + q)). As statistics don't change while a text is read, the cost of a byte depends on four bytes only; the
costs of all runs seen in training are tabulated for all languages at once and a text is scored by look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, sized, slices, stable_fraction, table

ORDER = 3
_PAD = b"\n" * ORDER
_letter = regex.compile(r"\p{L}")


def _grams(data: bytes, n: int) -> np.ndarray:
    """The runs of n bytes that end at each byte after the padding, as numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(len(b) - ORDER, np.uint32)
    for k in range(n):
        at = ORDER - n + 1 + k
        out = (out << np.uint32(8)) | b[at : at + len(out)]
    return out


def _bytes(text: str) -> bytes:
    return _PAD + text.lower().encode("utf-8", "replace")


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


class Trees:
    """Frozen costs in bits of every run of four bytes, for all languages."""

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        """counts: per language and run length from 1 to 4, sorted runs and their counts."""
        self.languages = sorted(counts)
        self.counts = counts
        self.escape: list = [None] * (ORDER + 1)  # by context length: contexts, bits per language
        self.cost: list = [None] * (ORDER + 2)  # by run length: runs, bits per language
        for n in range(1, ORDER + 2) if counts else ():
            seen = [counts[x][n - 1][0] for x in self.languages]
            contexts = np.unique(np.concatenate([k >> np.uint32(8) for k in seen]))
            totals = np.zeros((len(contexts), len(self.languages)))
            kinds = np.zeros_like(totals)
            for j, x in enumerate(self.languages):
                keys, c = counts[x][n - 1]
                at = np.searchsorted(contexts, keys >> np.uint32(8))
                np.add.at(totals[:, j], at, c)
                np.add.at(kinds[:, j], at, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escape[n - 1] = (contexts, np.where(totals > 0, -np.log2(kinds / (totals + kinds)), 0).astype(np.float32))
            runs = np.arange(1 << (8 * n), dtype=np.uint32) if n < 3 else np.unique(np.concatenate(seen))
            bits = self._escaped(n, runs)
            for j, x in enumerate(self.languages):
                keys, c = counts[x][n - 1]
                at = np.searchsorted(contexts, keys >> np.uint32(8))
                bits[np.searchsorted(runs, keys), j] = -np.log2(c / (totals[at, j] + kinds[at, j]))
            self.cost[n] = (runs, bits)
        del self.counts

    def _escaped(self, n: int, runs: np.ndarray) -> np.ndarray:
        """Bits of runs whose last byte their context doesn't know."""
        contexts, bits = self.escape[n - 1]
        at, known = _find(contexts, runs >> np.uint32(8))
        out = np.where(known[:, None], bits[at], np.float32(0))
        if n == 1:
            return out + np.float32(8)
        return out + self._bits(n - 1, runs & np.uint32((1 << (8 * (n - 1))) - 1))

    def _bits(self, n: int, runs: np.ndarray) -> np.ndarray:
        keys, bits = self.cost[n]
        if n < 3:
            return bits[runs]
        at, known = _find(keys, runs)
        out = bits[at]
        if not known.all():
            out[~known] = self._escaped(n, runs[~known])
        return out

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits that each language's trees need for the whole text."""
        data, total = _bytes(text), np.zeros(len(self.languages))
        for i in range(0, len(data) - ORDER, 1 << 16):
            runs = _grams(data[i : i + (1 << 16) + ORDER], ORDER + 1)
            total += self._bits(ORDER + 1, runs).sum(0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _letter.search(text):
            return "und", 0.0
        bits = self.code_lengths(text)
        k = int(bits.argmin())
        return self.languages[k], float(1 / np.exp2(np.clip(bits[k] - bits, -1000, 0)).sum())


def train(labelled: DataFrame, rows_per_language: int = 400) -> Trees:
    """Trees from (doc_id, text, lang), on the whole texts of about rows_per_language rows of each language, chosen by a hash of id and text.

    Every language is learned. Repeated rows count once. Null texts and languages are left out.
    """
    prepare(labelled.sparkSession)
    labelled = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg((F.lit(float(rows_per_language)) / F.count("*")).alias("rate"))
    sample = labelled.join(sized(cut(sizes, "languages")), "lang").filter(stable_fraction("doc_id", "text", seed=5) < F.col("rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(_bytes(text))
            for lang, data in texts.items():
                for n in range(1, ORDER + 2):
                    runs, c = np.unique(np.concatenate([_grams(d, n) for d in data]), return_counts=True)
                    columns = [pa.array([lang] * len(runs)), pa.array(np.full(len(runs), n, np.int32)), pa.array(runs.astype(np.int64)), pa.array(c.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "run", "c"])

    counted = sample.dropDuplicates(["lang", "doc_id", "text"]).select("lang", "text").mapInArrow(count, "lang string, n int, run long, c long")
    # The runs of a bounded sample.
    found = counted.groupBy("lang", "n", "run").agg(F.sum("c").alias("c")).toArrow().sort_by([("lang", "ascending"), ("n", "ascending"), ("run", "ascending")])
    langs, n, runs, c = found["lang"].to_pandas().to_numpy(), *(found[k].to_numpy() for k in ("n", "run", "c"))
    counts: dict[str, list] = {}
    starts = np.flatnonzero(np.concatenate([[True], (langs[1:] != langs[:-1]) | (n[1:] != n[:-1])])) if len(langs) else np.empty(0, np.int64)
    for i, j in zip(starts, np.append(starts[1:], len(langs))):
        counts.setdefault(langs[i], []).append((runs[i:j].astype(np.uint32), c[i:j]))
    return Trees(counts)


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone.

    `und` with a score of 0 for null texts, texts without a letter, and where nothing was learned. score is the
    share of the best language when code lengths count as probabilities; ties go to the first language by name.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE = {}
