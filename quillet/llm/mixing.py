"""Mixing sources to target weights by the cube method.

A source's target is some whole number of passes over it and a fraction of a pass. Every document starts the
fractional pass with the fraction as its inclusion probability. The flight phase takes three open documents at a
time, finds the direction in which neither the number of documents nor the number of words changes, and moves
along it at random until a probability is 0 or 1. Blocks of a source fly on their own; what each leaves open (two
documents, and those that are held back) meets in blocks again, until one block of a source remains. There the
landing settles what is open from the largest document on, each against all others at once, and lets go of the number of
documents where that can't be kept; a dozen documents remain, of whose outcomes those near the target are drawn. Every
step keeps the inclusion probabilities; only a document too large for the rest of its source to balance is settled without a draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, prepare, sized, stable_fraction, table

OPEN = 1e-9


def targets(sizes: DataFrame, most: float = 3.0, cycle: int = 3) -> DataFrame:
    """Of (source, source_size): also weight and target. Sources in the order of their code points, null last, weigh 1 to `cycle` in turn.

    A target is min(most * source_size, share * weight) with the share that makes the targets sum to all sizes:
    what resharing the excess over the limits ends in. One row a source, in one task.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    full = Window.partitionBy()
    w = sizes.withColumn("weight", ((F.row_number().over(ordered) - 1) % cycle + 1).cast("double")).withColumn("_cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    ahead = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(full) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("_share", share)
    w = w.withColumn("_share", F.max(F.when(F.col("_share") * F.col("weight") <= F.col("_cap"), F.col("_share"))).over(full))
    return w.select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_share") * F.col("weight"), F.col("_cap"))).alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p until at most two entries lie strictly between 0 and 1; the sums of p and of p * sizes don't change."""
    p, x, draws = p.tolist(), sizes.tolist(), iter(rng.random(len(p) + 8).tolist())
    waiting = iter([k for k, v in enumerate(p) if OPEN < v < 1 - OPEN])
    active: list[int] = []
    while True:
        while len(active) < 3 and (k := next(waiting, None)) is not None:
            active.append(k)
        if len(active) < 3:
            return np.array(p)
        i, j, k = active
        u = (x[j] - x[k], x[k] - x[i], x[i] - x[j])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[a]) / d if d > 0 else -p[a] / d for a, d in zip(active, u, strict=True) if d)
        down = min(p[a] / d if d > 0 else (p[a] - 1) / d for a, d in zip(active, u, strict=True) if d)
        step = up if next(draws, None) < down / (up + down) else -down
        for a, d in zip(active, u, strict=True):
            v = p[a] + step * d
            p[a] = 0.0 if v <= OPEN else 1.0 if v >= 1 - OPEN else v
        active = [a for a in active if 0.0 < p[a] < 1.0]


def _reach(p: np.ndarray, d: np.ndarray) -> tuple[float, float]:
    """How far p may go along d and against it."""
    moving = d != 0
    p, d = p[moving], d[moving]
    if not len(d):
        return 0.0, 0.0
    return float(np.where(d > 0, (1 - p) / d, -p / d).min()), float(np.where(d > 0, p / d, (p - 1) / d).min())


def draw(p: np.ndarray, sizes: np.ndarray, near: float, rng: np.random.Generator) -> np.ndarray:
    """An outcome (0 or 1 an entry) of a few open documents near the sum of p * sizes, so that each keeps its probability.

    Outcomes weigh less by a factor of e for every `near` words they are off; of all distributions with the means p
    the one nearest to these weights (by Newton's method) is drawn from.
    """
    choices = ((np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1).astype(float)
    off = np.abs(choices @ sizes - p @ sizes)
    near = max(near, 1.0)
    while near < 4 * off.max() + 4:
        prior = -np.minimum(off / near, 300.0)
        theta = np.zeros(len(p))
        for _ in range(100):
            e = choices @ theta + prior
            w = np.exp(e - e.max())
            w /= w.sum()
            mean = w @ choices
            miss = p - mean
            if np.abs(miss).max() < 1e-9:
                return choices[rng.choice(len(w), p=w)]
            step = np.linalg.lstsq((choices * w[:, None]).T @ choices - np.outer(mean, mean), miss, rcond=1e-13)[0]
            theta = theta + step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-300))
        near *= 2
    return (rng.random(len(p)) < p).astype(float)  # every document by itself


def _direction(q: np.ndarray, x: np.ndarray, i: int) -> np.ndarray | None:
    """A direction that settles entry i either way: all others move by their room, so that number and words are kept, or only words; None if neither does."""
    room = q * (1 - q)
    room[i] = 0.0
    s0, s1, s2 = room.sum(), room @ x, room @ (x * x)
    det = s0 * s2 - s1 * s1
    tries = []
    if det > 1e-9 * s0 * s2:
        tries.append(-room * ((s2 - s1 * x[i]) / det + (s0 * x[i] - s1) / det * x))
    if s1 > 0:
        tries.append(-room * x[i] / s1)
    elif s0 > 0 and x[i] == 0:
        tries.append(-room / s0)
    for d in tries:
        d[i] = 1.0
        up, down = _reach(q, d)
        if up >= 1 - q[i] and down >= q[i]:
            return d
    return None


def landing(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, few: int = 12, near: float = 0.001) -> np.ndarray:
    """p with every entry at 0 or 1; entries come largest first.

    The largest open document moves against all others at once in a direction that keeps the words, and the number of
    documents if possible; every such move is as likely up as down by its lengths, so entries keep their means. A
    document that all others together can't make up for if it is taken, or if it isn't, is settled the other way: it is
    too large to be drawn without missing the target. The last `few` are drawn together.
    """
    p, sizes = p.copy(), sizes.astype(float)
    open_ = np.flatnonzero((p > OPEN) & (p < 1 - OPEN))
    near = near * float(p @ sizes)
    while len(open_):
        q, x = p[open_], sizes[open_]
        if len(open_) <= few:
            p[open_] = draw(q, x, near, rng)
            break
        d = _direction(q, x, 0)
        if d is not None:
            up, down = _reach(q, d)
            q = q + d * (up if rng.random() < down / (up + down) else -down)
        else:  # all others can't make up for it either way
            room = q[1:] * (1 - q[1:])
            d = np.concatenate([[1.0], -room * x[0] / (room @ x[1:])]) if x[1:].any() else np.eye(len(q))[0]
            up, down = _reach(q, d)
            q = q + d * (up if up >= 1 - q[0] else -down)
        q[q <= OPEN] = 0.0
        q[q >= 1 - OPEN] = 1.0
        p[open_] = q
        open_ = open_[(q > 0) & (q < 1)]
    return p


def balanced_pass(units: DataFrame, source_key: str = "source_no", block_rows: int = 8192, held: int = 512, seed: int = 11) -> DataFrame:
    """units (with source_no, doc_id, size, p): the same rows with p at 0 or 1. Groups hold about block_rows rows, however large a source is.

    About `held` rows a source, chosen by a hash of their ids (all of a smaller source), wait for the landing.
    """
    spark = units.sparkSession
    prepare(spark)
    schema, done, level = units.schema, [], 0
    held = min(held, block_rows // 2)  # so that every level settles some

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        rng = np.random.Generator(np.random.PCG64([seed, level, int(pdf["source_no"].iat[0]), int(pdf["_block"].iat[0])]))
        p, sizes, waits = pdf["p"].to_numpy(float), pdf["size"].to_numpy(float), pdf["_waits"].to_numpy(bool)
        flying = np.flatnonzero(~waits)
        p[flying] = flight(p[flying], sizes[flying], rng)
        if int(pdf["_blocks"].iat[0]) == 1:
            p = landing(p, sizes, rng)
        return pdf[[f.name for f in schema]].assign(p=p)

    while True:
        n = units.groupBy(source_key).agg(F.count("*").alias("_n"))
        counts = sized(n.select(source_key, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"), F.least(F.lit(1.0), F.lit(float(held)) / F.col("_n")).alias("_share")))  # a row a source
        block = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), F.col("_blocks")).cast("int")
        waits = stable_fraction("doc_id", "size", seed=seed + 1000 + level) < F.col("_share")
        dealt = units.join(counts, source_key).withColumns({"_block": block, "_waits": waits})
        flown = cut(dealt.repartition(source_key, "_block").groupBy(source_key, "_block").applyInPandas(fly, schema), f"flight{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.filter(~open_))
        units, level = flown.filter(open_), level + 1
        if units.isEmpty():
            out = done[0]
            for x in done[1:]:
                out = out.unionByName(x)
            return out


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; size counts words, taken is size times the passes that take the row (0 to `most`).

    Null and empty texts have no words and are taken as often as others. A source without words has the target 0.
    Repeated rows are rows of their own. An empty table gives no rows. Other columns are neither read nor returned.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words.alias("size")), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    whole = F.floor(ratio + F.lit(OPEN))
    fraction = F.greatest(ratio - whole, F.lit(0.0))
    plan = plan.select("source", "source_size", "target", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("int").alias("source_no"), whole.cast("int").alias("whole"), F.when(fraction > OPEN, fraction).otherwise(0.0).alias("p"))
    plan = cut(plan, "targets")
    joined = rows.join(sized(plan), rows["source"].eqNullSafe(plan["source"])).select("doc_id", "size", "source_no", "whole", "p")
    settled = joined.filter("p = 0").withColumn("copies", F.col("whole"))
    flown = balanced_pass(joined.filter("p > 0")).withColumn("copies", (F.col("whole") + F.col("p")).cast("int"))
    out = settled.unionByName(flown).join(sized(plan.select("source_no", "source_size", "target")), "source_no")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op9_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_source_mixing": op9_source_mixing}
ORACLE = {}
