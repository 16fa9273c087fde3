"""Exact Jaccard self-join of word n-gram sets by universe partition and pigeonhole.

A pair belongs to the size band of its larger set. A band's pairs differ in at most U tokens, so its scheme hashes
the token universe into m segments, t of them with one-deletion neighbourhoods (a segment's signature without any
one of its tokens), with m + t = U + 1: if every plain segment differed in one token or more and every other in
two or more, the sets would differ in more than U tokens. Linked sets thus share a signature. A segment without content
(or a neighbourhood without) is no signature: many sets have it by chance. A band may have m + t = U + r instead (U + 2r - 1
if t > 0), so that linked sets share r segments; what they share is then a segment with content or r without any,
and runs of r such segments are signatures. t and r are chosen a band from counts over all sets, as what the
signatures and the chance meetings they cause cost together. Sets indexed under a band's scheme are those of the band
and those below it that its smallest set may still link with.

Equal texts (up to white space and case) are one node, by comparison of the whole texts of those that share a digest.
Links are wanted for their components, so a bucket doesn't give all its pairs: first every member meets the bucket's
hub (the member that shares most signatures); where that leaves a bucket with more than one component, all its pairs
across components follow. Pairs go through two exact bounds (sizes, and the differing bits of parity maps of a bit or
more a token) before their texts are read and compared exactly, shingle by shingle.

Signatures are counted first. Those that many sets have are joined with their counts apart from the others; their
buckets, and the members of a hub, are dealt over several tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, mix64, prepare, shingle_hashes, sized, slices, table

GROWTH, LEAST_WORDS, CHANCE_COST, HOT, PARTS = 1.25, 8, 0.05, 256, 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def text_words(text: str | None) -> list[bytes]:
    """A to Z count as a to z."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The distinct n-word runs; of fewer words, the one run of all; of none, nothing."""
    return set(zip(*(words[i:] for i in range(min(n, len(words))))))


def token_set(words: list[bytes], n: int, bits: int = 64) -> np.ndarray:
    """Sorted hashes of the distinct n-word runs, one a run, also where two runs share a hash."""
    hashes = shingle_hashes(words, n)
    if bits < 64:
        hashes = hashes & np.uint64((1 << bits) - 1)
    found, runs = np.unique(hashes), shingles(words, n)
    if len(found) == len(runs):
        return found
    width = min(n, len(words))
    return np.sort(np.array(list({tuple(words[i : i + width]): h for i, h in enumerate(hashes.tolist())}.values()), np.uint64))


def bands(largest: int) -> list[int]:
    """The smallest size of each band, and one bound beyond `largest`."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def most_difference(a, b, num: int, den: int):
    """How many tokens sets of a and b tokens may differ in and still have num/den of their union in common."""
    total = a + b
    return total - 2 * (-(-num * total // (den + num)))


def allocate(size: float, sets: float, differ: int) -> tuple[int, int, int]:
    """(m, t, r) for a band: segments, how many of them get one-deletion neighbourhoods, and how many without content make a signature, at the least estimated cost."""
    best = None
    for r in range(1, 5):
        for t in range((differ + 1) // 2 + r):
            m = differ + (2 * r - 1 if t else r) - t
            if t > m:
                break
            each = size / m
            bare = math.exp(-each) * ((m - t) + t * (1 + each))
            met = math.exp(-2 * each) * ((m - t) + t * (1 + 2 * each))
            cost = sets * (m + t * each + bare**r / math.factorial(r)) + CHANCE_COST * sets * sets / 2 * met**r / math.factorial(r)
            if best is None or cost < best[0]:
                best = (cost, m, t, r)
    return best[1:]


def signatures(tokens: np.ndarray, starts: list[int], schemes: list[tuple[int, int, int]], num: int, den: int) -> np.ndarray:
    """All signatures of a set, under the scheme of its band and of those above whose sets it may link with."""
    n, out = len(tokens), []
    k = int(np.searchsorted(starts, n, "right")) - 1
    while k < len(schemes) and num * starts[k] <= den * n:
        m, t, r = schemes[k]
        salt = mix64(np.array([k + 1], np.uint64) * _GOLD)[0]
        mixed = mix64(tokens ^ salt)
        segment = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        value = mix64(mixed + _GOLD)
        order = np.argsort(segment, kind="stable")
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value[order], dtype=np.uint64)])
        ends = np.searchsorted(segment[order], np.arange(m + 1))
        whole, held = sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)
        place = mix64(np.arange(m, dtype=np.uint64) * _GOLD ^ salt)
        out.append(mix64(whole ^ place)[held > 0])
        bare = held == 0
        if t:
            near = (segment < t) & (held[segment] > 1)
            out.append(mix64((whole[segment[near]] - value[near]) ^ place[segment[near]]))
            bare[:t] |= held[:t] == 1
        empty = mix64(place[bare] + _GOLD)
        if len(empty) >= r:
            out.append(mix64(np.array([sum(c) & 0xFFFFFFFFFFFFFFFF for c in itertools.combinations(empty.tolist(), r)], np.uint64)))
        k += 1
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of tokens falls, in a power of two of 64-bit words; halving a map is the xor of its halves."""
    words = max(LEAST_WORDS, 1 << max(0, (len(tokens) - 1) // 64).bit_length())
    bits = np.bincount((mix64(tokens ^ _GOLD) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)))


def describe(docs: DataFrame, n: int, bits: int = 64) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the words in order), map (parity map)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, maps = np.zeros((3, batch.num_rows), np.int64), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text_words(text)
                s = token_set(words, n, bits)
                maps.append(parity_map(s) if len(s) else np.empty(0, np.int64))
                if len(s):
                    digest = xxhash.xxh3_128_digest(b" ".join(words))
                    out[0, i] = len(s)
                    out[1:3, i] = np.frombuffer(digest, np.int64) if bits == 64 else (digest[0], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out), _lists(maps)], ["doc_id", "n", "d1", "d2", "map"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, map array<long>")


def _with_signatures(docs: DataFrame, n: int, starts, schemes, num: int, den: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [signatures(s, starts, schemes, num, den) if len(s := token_set(text_words(t), n, bits)) else np.empty(0, np.uint64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], ["doc_id", "sigs"])

    return docs.mapInArrow(run, "doc_id long, sigs array<long>")


def _nodes(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, n, rep (the smallest id whose text has the same words in the same order) of every row; the texts that share a digest are compared whole."""
    key = ["d1", "d2", "n"]
    shared = cut(sets.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c"), "shared")
    found = sets.select("doc_id", *key).join(sized(shared), key, "left").select("doc_id", *key, F.coalesce("rep", "doc_id").alias("rep"))
    copied = cut(sets.select("doc_id", *key).join(sized(shared.drop("rep")), key, "left_semi"), "copied")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    norm = F.trim(F.regexp_replace(F.translate("text", upper, upper.lower()), SPACE_CLASS + "+", " ")).alias("norm")
    texts = docs.join(sized(copied), "doc_id").select("doc_id", *key, norm)
    same = texts.groupBy(*key, "norm").agg(F.min("doc_id").alias("rep"))
    clash = cut(same.groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "clash")
    if not clash.isEmpty():  # digests of more than one text
        apart = texts.join(sized(clash), key, "left_semi")
        apart = cut(apart.join(apart.groupBy(*key, "norm").agg(F.min("doc_id").alias("own")), [*key, "norm"]).select("doc_id", "own").distinct(), "apart")
        found = found.join(apart, "doc_id", "left").withColumn("rep", F.coalesce("own", "rep"))
    return cut(found.select("doc_id", "n", "rep"), "nodes")


def _shared(indexed: DataFrame) -> DataFrame:
    """sig, doc_id, c of the signatures that c > 1 sets have."""
    entries = indexed.select("doc_id", F.explode("sigs").alias("sig"))
    counts = cut(entries.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    hot = sized(cut(counts.filter(F.col("c") > HOT), "hot"))
    few = entries.join(hot.select("sig"), "sig", "left_anti").join(counts.filter(F.col("c") <= HOT), "sig")
    return few.select("sig", "doc_id", "c").unionByName(entries.join(hot, "sig").select("sig", "doc_id", "c"))


def _halved(own: Column, other: Column) -> Column:
    k = F.size(other)
    return F.when(F.size(own) > k, F.zip_with(F.slice(own, 1, k), F.slice(own, k + 1, k), lambda x, y: x.bitwiseXOR(y))).otherwise(own)


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """The two exact bounds, on columns of two described sets. Sets within the first have maps of one length or of twice it."""
    total, x, y = F.col(f"{a}.n") + F.col(f"{b}.n"), F.col(f"{a}.map"), F.col(f"{b}.map")
    most = total - 2 * F.expr(f"div({num} * ({a}.n + {b}.n) + {den + num - 1}, {den + num})")
    differ = F.aggregate(F.zip_with(_halved(x, y), _halved(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, c: acc + c)
    return (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= most) & (differ <= most)


def _part(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(PARTS)).cast("int").alias("part")


def verify(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by their whole texts. a's text goes once to each part of its partners."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = cut(docs.join(sized(cut(ids, "ids")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    pairs = pairs.select("a", "b", _part("b"))
    heads = pairs.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    tails = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    rows = heads.unionByName(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: set = set()
        for batch in slices(batches):
            keep = []
            for b, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = shingles(text_words(text), n)
                if b is None:
                    left = own
                    keep.append(False)
                else:
                    common = len(left & own)
                    keep.append(den * common >= num * (len(left) + len(own) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """doc_id, component (the smallest id of the component) of every linked node, by large-star and small-star steps."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small = star.select("u", F.col("m").alias("v")).unionByName(star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        mark = now


def _block(pdf: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """(ids, components, sizes, maps) of the rows, by the length of their maps."""
    length = pdf["map"].map(len).to_numpy()
    parts = [pdf[length == k] for k in np.unique(length)]
    return [(p["doc_id"].to_numpy(), p["component"].to_numpy(), p["n"].to_numpy(), np.stack(p["map"].to_numpy()).view(np.uint64)) for p in parts]


def near_pairs(left: list, right: list, num: int, den: int, one: bool, cells: int = 1 << 20) -> np.ndarray:
    """Pairs of ids of two blocks (or of one, each pair once) of different components that both bounds let pass; some million words of maps at a time."""
    out = [np.empty((0, 2), np.int64)]
    for ids, comp, size, maps in left:
        for ids_, comp_, size_, maps_ in right:
            words = min(maps.shape[1], maps_.shape[1])
            if max(maps.shape[1], maps_.shape[1]) * num > 2 * words * den:
                continue  # sizes too far apart
            x, y = maps, maps_
            while x.shape[1] > words:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > words:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            step = max(1, cells // (len(ids_) * words))
            for k in range(0, len(ids), step):
                part = slice(k, k + step)
                most = most_difference(size[part, None], size_[None], num, den)
                may = (comp[part, None] != comp_[None]) & (np.abs(size[part, None] - size_[None]) <= most)
                if one:
                    may &= ids[part, None] < ids_[None]
                a, b = np.nonzero(may)
                near = np.bitwise_count(x[part][a] ^ y[b]).sum(1, dtype=np.int64) <= most[a, b]
                out.append(np.stack([ids[part][a[near]], ids_[b[near]]], 1))
    return np.concatenate(out)


def _across(members: DataFrame, info: DataFrame, num: int, den: int, small: int = 64, block: int = 1024) -> DataFrame:
    """Pairs (a, b) of one bucket and of different components that the bounds let pass; (hub, member) pairs were tried before."""
    mixed = cut(members.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).filter("lo <> hi and c > 2").select("sig", "c"), "several")
    rows = cut(members.filter("doc_id <> hub").drop("c").join(sized(mixed), "sig").select("sig", "c", "doc_id", "component"), "mixed")
    full = rows.join(info, "doc_id")
    few = full.filter(F.col("c") <= small)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y", num, den)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    # Large buckets go in pairs of blocks; only pairs that pass leave the task.
    blocks = F.ceil(F.col("c") / block).cast("int")
    many = full.filter(F.col("c") > small).withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc_id")
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        found = near_pairs(*(_block(pdf[pdf["own"] == k]) for k in (i, j)), num, den, i == j)
        return pd.DataFrame({"a": found.min(1), "b": found.max(1)})

    large = many.repartition("sig", "i", "j").groupBy("sig", "i", "j").applyInPandas(run, "a long, b long")
    return pairs.unionByName(large).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of the links between texts whose sets of n-word runs share num/den of their union.

    A text of fewer than n words is one run of all of them. Null texts and texts without words have empty sets and
    no links: their component is themselves. The similarity is a half or more. Rows with one id count as one node. An empty table gives no rows.
    Other columns are neither read nor returned. Runs are hashed to `bits` bits to find pairs; fewer cost time, not exactness.
    """
    if 2 * num < den:
        raise ValueError("the similarity must be a half or more")  # parity maps are halved once
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = cut(describe(docs, n, bits), "sets")
    nodes = _nodes(docs, sets)
    reps = nodes.filter("n > 0 and doc_id = rep")
    sizes = reps.agg(F.max("n")).first()[0] or 0
    starts = bands(sizes)
    of_band = F.size(F.filter(F.array(*map(F.lit, starts)), lambda b: b <= F.col("n"))) - 1
    counts = {r["band"]: (r["c"], r["s"]) for r in reps.groupBy(of_band.alias("band")).agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()}  # a row a band
    schemes = []
    for k in range(len(starts) - 1):
        differ = (den - num) * 2 * (starts[k + 1] - 1) // (den + num)
        c, s = counts.get(k, (0, 0))
        below = counts.get(k - 1, (0, 0))[0]
        schemes.append(allocate(s / c if c else starts[k], c + below / 2, differ))
    copies = cut(nodes.filter("doc_id <> rep").select("doc_id"), "copies")
    signed = _with_signatures(docs, n, starts, schemes, num, den, bits).filter(F.size("sigs") > 0)
    indexed = cut(signed.join(sized(copies), "doc_id", "left_anti"), "signatures")
    members = cut(_shared(indexed), "members")
    central = members.groupBy("doc_id").agg(F.sum("c").alias("w"))
    weighed = members.join(central, "doc_id")
    hubs = weighed.groupBy("sig", "c").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("neg"))).alias("h")).select("sig", "c", (-F.col("h.neg")).alias("hub"))
    # A bucket's rows meet its hub in as many tasks as its size asks for.
    tasks = F.ceil(F.col("c") / HOT).cast("int")
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("c")
    members = cut(members.withColumn("part", F.pmod(F.xxhash64("doc_id"), tasks).cast("int")).join(hubs, ["sig", "part"]).select("sig", "doc_id", "c", "hub"), "hubs")
    info = cut(sets.select("doc_id", "n", "map").join(sized(copies), "doc_id", "left_anti").filter("n > 0").dropDuplicates(["doc_id"]), "info")
    stars = members.filter("doc_id <> hub").groupBy(F.least("doc_id", "hub").alias("lo"), F.greatest("doc_id", "hub").alias("hi")).agg(F.max("hub").alias("a"))
    stars = cut(stars.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), "stars").select("a", "b", _part("b"))
    centres = stars.select("a", "part").distinct().join(info.withColumnRenamed("doc_id", "a"), "a").alias("x")
    near = stars.alias("s").join(centres, (F.col("s.a") == F.col("x.a")) & (F.col("s.part") == F.col("x.part"))).join(info.alias("y"), F.col("s.b") == F.col("y.doc_id"))
    near = near.filter(_may_link("x", "y", num, den)).select("s.a", "s.b")
    links = cut(verify(cut(near, "near"), docs, n, num, den), "links")
    found = components(links)
    own = members.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = cut(_across(own, info, num, den), "across")
    out = nodes.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component"))
    if not more.isEmpty():  # components that further links join
        ends = cut(verify(more, docs, n, num, den), "more")
        for side in ("a", "b"):
            ends = ends.join(found.select(F.col("doc_id").alias(side), F.col("component").alias("_c")), side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
        joined = components(ends)
        out = out.join(sized(joined.select(F.col("doc_id").alias("component"), F.col("component").alias("_c"))), "component", "left").withColumn("component", F.coalesce("_c", "component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
ORACLE = {}
