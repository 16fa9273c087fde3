"""Severity of toxic texts by cumulative-link ordinal regression over sparse text features.

Features are words and within-word runs of 4 to 6 letters (a blank marks a word's ends) that labelled toxic
rows hold far more often than clean ones (of words of more than LONGEST_WORD letters only their runs, as in scripts
without blanks); an automaton finds them in whole texts. Grades are 0 for clean rows
and 1 to 3 for toxic ones by how many of their words hold a cue, where a row's cues are learned from the other half of
the sample, never from itself. One weight vector serves all thresholds:
P(grade <= k) = logistic(threshold_k - weights . x). The result is the expected grade and the odds of any grade
above 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, slices, stable_fraction, table

RUNS, LONGEST_WORD, GRAMS_AT_ONCE = (4, 5, 6), 40, 100_000
_not_letters = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-case words between single blanks, with a blank at both ends."""
    return " " + _not_letters.sub(" ", text.lower()).strip(" ") + " "


def candidates(words: set[str]) -> set[str]:
    out = set()
    for w in words:
        if w:
            long = len(w) > LONGEST_WORD
            w = f" {w} "
            if not long:
                out.add(w)
            for n in RUNS:
                out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


class Model:
    def __init__(self, features: list[str], weights=None, thresholds=None):
        self.features, self.weights, self.thresholds = features, weights, thresholds
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """How often each feature occurs in the whole text, and how many words hold one."""
        if not text or not self.features:
            return {}, 0
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for k, f in enumerate(self.features):
                self._automaton.add_word(f, k)
            self._automaton.make_automaton()
        text, found, words, word_end = normalise(text), {}, 0, -1
        for end, k in self._automaton.iter(text):
            found[k] = found.get(k, 0) + 1
            inside = end - (text[end] == " ")
            if inside > word_end:
                words, word_end = words + 1, text.find(" ", inside) - 1
        return found, words

    def probabilities(self, found: dict[int, int]) -> np.ndarray:
        """Of the grades 0 to 3."""
        if self.weights is None:
            return np.array([1.0, 0, 0, 0])
        score = sum(self.weights[k] * math.log1p(n) for k, n in found.items())
        below = 1 / (1 + np.exp(np.clip(score - self.thresholds, -500, 500)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def grade_of(words: int) -> int:
    """The grade of a toxic row with so many words that hold a cue."""
    return 1 if words <= 1 else 2 if words <= 4 else 3


def fit(rows: list[tuple[dict[int, int], int]], n_features: int, steps: int = 400, penalty: float = 2e-4, rate: float = 0.1):
    """Weights and thresholds that minimise the ordinal log loss (Adam, all rows at each step)."""
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.fromiter((k for f, _ in rows for k in f), np.int64, len(doc))
    x = np.log1p(np.fromiter((n for f, _ in rows for n in f.values()), float, len(doc)))
    y = np.array([g for _, g in rows])
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    p = np.concatenate([np.zeros(n_features), [1.0, 0.0, 0.0]])  # weights, first threshold, logs of the gaps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[-2:])
        cuts = np.array([-np.inf, p[-3], p[-3] + gaps[0], p[-3] + gaps.sum(), np.inf])
        s = np.bincount(doc, p[col] * x, len(rows))
        hi, lo = logistic(cuts[y + 1] - s), logistic(cuts[y] - s)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        like = np.maximum(hi - lo, 1e-12)
        g = np.zeros_like(p)
        g[:n_features] = np.bincount(col, ((dhi - dlo) / like)[doc] * x, n_features) / len(rows) + penalty * p[:n_features]
        by_cut = [-((dhi / like)[y == k].sum() - (dlo / like)[y == k + 1].sum()) / len(rows) for k in range(3)]
        g[-3:] = [sum(by_cut), gaps[0] * (by_cut[1] + by_cut[2]), gaps[1] * by_cut[2]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(p[-2:])
    return p[:n_features], np.array([p[-3], p[-3] + gaps[0], p[-3] + gaps.sum()])


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 6000, evidence: float = 25.0) -> Model:
    """A model from labels (doc_id, toxic) on a bounded sample: about toxic_rows and clean_rows rows, chosen by a hash of their ids, whole texts.

    A feature's evidence is its log-likelihood ratio; it must also be ten times as frequent in toxic rows. All with
    enough evidence count. Half the evidence makes a cue of one half, by which the toxic rows of the other are graded. A
    document labelled more than once is toxic if any label says so. Without toxic or clean labels nothing is
    learned and every text has grade 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = dict(labels.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return Model([])
    rate = F.when(F.col("toxic") == 1, min(1.0, toxic_rows / sizes[1])).otherwise(min(1.0, clean_rows / sizes[0]))
    chosen = labels.filter(stable_fraction("doc_id", seed=4) < rate)  # the bound of the sample is that of the broadcast
    half = (stable_fraction("doc_id", seed=8) < 0.5).cast("int").alias("half")
    sample = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic", half), "toxicity")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(4)]  # 2 * half + toxic

        def out():
            keys = list(set().union(*seen))
            rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[g] for g in keys], pa.int64()) for s in seen)], ["gram", "c0", "t0", "c1", "t1"])
            for s in seen:
                s.clear()
            return rows

        for batch in slices(batches):
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen[2 * half + toxic].update(candidates(set(normalise(text).split(" "))))
                if sum(map(len, seen)) > GRAMS_AT_ONCE:
                    yield out()
        yield out()

    n = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    counted = sample.mapInArrow(grams, "gram string, c0 long, t0 long, c1 long, t1 long").groupBy("gram").agg(*(F.sum(k).alias(k) for k in ("c0", "t0", "c1", "t1")))

    def strong(t: Column, c: Column, nt: int, nc: int, evidence: float) -> Column:
        if not nt or not nc:
            return F.lit(None).cast("double")
        share = nt / (nt + nc)
        term = lambda k, part: F.when(k > 0, k * F.log(k / ((t + c) * F.lit(part)))).otherwise(0.0)
        g = 2 * (term(t, share) + term(c, 1 - share))
        return F.when((g >= evidence) & (t / nt >= 10 * c / nc), g)

    nt, nc = (n.get((0, k), 0) + n.get((1, k), 0) for k in (1, 0))
    if not nt or not nc:
        return Model([])
    whole = strong(F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), nt, nc, evidence)
    of_half = [strong(F.col(f"t{h}"), F.col(f"c{h}"), n.get((h, 1), 0), n.get((h, 0), 0), evidence / 2) for h in (0, 1)]
    scored = counted.select("gram", whole.alias("g"), *(x.alias(f"g{h}") for h, x in enumerate(of_half))).filter("g is not null or g0 is not null or g1 is not null")
    strong_rows = scored.collect()  # of a bounded sample
    features = [r["gram"] for r in sorted(strong_rows, key=lambda r: (-(r["g"] or 0), r["gram"])) if r["g"] is not None]
    cues = [Model(sorted(r["gram"] for r in strong_rows if r[f"g{1 - h}"] is not None)) for h in (0, 1)]
    model = Model(features)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, words = [], []
            for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows.append(model.counts(text)[0])
                words.append(cues[half].counts(text)[1])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words, pa.int32()), pa.array([list(f) for f in rows], pa.list_(pa.int32())), pa.array([list(f.values()) for f in rows], pa.list_(pa.int32()))], ["toxic", "words", "k", "n"])

    rows = [(dict(zip(r["k"], r["n"], strict=True)), grade_of(r["words"]) if r["toxic"] else 0) for r in sample.mapInArrow(found, "toxic int, words int, k array<int>, n array<int>").collect()]  # the bounded sample
    rows.sort(key=lambda r: (r[1], sorted(r[0].items())))
    weights, thresholds = fit(rows, len(features))
    return Model(features, weights, thresholds)


def severity(text: Column, model: Model) -> Column:
    """struct<severity double, grade int, p_toxic double> of whole texts; null and empty texts as texts without features."""
    spark_model = model

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def grade(texts: pd.Series) -> pd.DataFrame:
        empty = spark_model.probabilities({})
        p = np.array([spark_model.probabilities(f) if (f := spark_model.counts(t)[0]) else empty for t in texts]).reshape(-1, 4)
        return pd.DataFrame({"severity": p @ np.arange(4.0), "grade": p.argmax(1).astype("int32"), "p_toxic": 1 - p[:, 0]})

    return grade(text)


def grade_documents(docs: DataFrame, model: Model, reject: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), grade (the likeliest), p_toxic, toxic (p_toxic of reject or more) of every row.

    Repeated rows get equal results; an empty table gives none; other columns are neither read nor returned.
    """
    prepare(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("doc_id"), severity(F.col(text_col), model).alias("s"))
    return out.select("doc_id", "s.severity", "s.grade", "s.p_toxic", (F.col("s.p_toxic") >= reject).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.4) -> DataFrame:
    """The rows of docs, with their columns, that the model doesn't reject."""
    model = train(docs, labels)
    prepare(docs.sparkSession)
    own = docs.columns
    return docs.withColumn("_quillet_severity", severity(F.col("text"), model)).filter(F.col("_quillet_severity.p_toxic") < reject).select(*own)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return grade_documents(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE = {}
