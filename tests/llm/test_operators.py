"""Dealt operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillet.llm import common, exact_dedup, fingerprint, html, jaccard_join, language, mixing, packing, sharding, tokens, toxicity
from quillet.llm.registry import oracle_sql, queries
from tests.conftest import SF, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(r + (None,) * 5)[:5] for r in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Every hard case at once, with columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, "en", None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "a b\tc", "en", "a"), (5, "abc", "en", "b"), (6, "ab  c", "de", "b"), (6, "ab  c", "de", "b"), (7, long, "en", "b"), (8, long + " end", "en", None), (9, "😀 é x", "fr", "c"), (10, "12 34 !!", "fr", "c")]
    extra = [F.lit("x").alias(c) for c in ("norm", "digest", "keep_id", "kept", "shard", "slot", "piece", "length", "size", "target", "p", "bucket", "component", "sig", "salt")]
    return docs_of(spark, rows).select("*", *extra)


def empty(spark):
    return docs_of(spark, []).filter("false")


# exact dedup


def dedup_by_hand(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[t.translate({c: None for c in b" \t\n\x0b\x0c\r"})].append((-len(t), i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out)


def test_exact_dedup(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = exact_dedup.exact_dedup(odd).drop("n_chars").collect()
    assert sorted(map(tuple, found)) == dedup_by_hand(rows)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r ", max_size=4), min_size=1, max_size=60))
def test_exact_dedup_by_hand(spark, texts):
    rows = list(enumerate(texts))
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("n_chars").collect()
    assert sorted(map(tuple, found)) == dedup_by_hand(rows)


def test_large_ids(spark):
    df = docs_of(spark, [(2**62, "a"), (-(2**62), "a"), (0, "a b")])
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()} == {-(2**62), 0}


def test_hot_group_is_combined_before_the_shuffle(spark, monkeypatch):
    plans, cut = [], exact_dedup.cut
    monkeypatch.setattr(exact_dedup, "cut", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or cut(df, name))
    plans.append(exact_dedup.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString())
    assert any("partial_min(doc_id" in p for p in plans) and not any("Python" in p or "Arrow" in p for p in plans)


@pytest.mark.parametrize("small", [0, 10**6])
def test_hot_group_is_whole_by_either_join(spark, monkeypatch, small):
    """A third of all rows are copies; with few broadcast digests and with none."""
    monkeypatch.setattr(exact_dedup, "SMALL", small)
    monkeypatch.setattr(exact_dedup, "sized", lambda df: common.sized(df, small))
    rows = [(i, "a b" if i % 3 else f"text {i // 6}", None) for i in range(600)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, salt string").repartition(7)).drop("n_chars").collect()
    assert sorted(map(tuple, found)) == dedup_by_hand([r[:2] for r in rows])


def test_digests_that_collide_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lpad(F.length(c).cast("string"), 64, "0"))
    with pytest.raises(Exception, match="share a SHA-256"):
        exact_dedup.exact_dedup(docs_of(spark, [(1, "ab"), (2, "cd")])).collect()


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    """All but the tables that the result reads."""
    monkeypatch.setattr(common, "scratch_dir", lambda spark: str(tmp_path))
    with common.scratch(spark) as keep:
        common.cut(spark.range(3), "x")
        out = keep(common.cut(spark.range(5), "y"))
    assert out.count() == 5 and len(list(tmp_path.iterdir())) == 1


def test_dedup_against_sql(spark, duck):
    name = "op3_exact_dedup"
    assert rows_of(queries()[name](spark, SF).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).df())


# sharding


def test_communication_matrix():
    rng = random.Random(1)
    for seed in range(20):
        counts = [rng.randrange(50) for _ in range(rng.randrange(1, 30))]
        total, k = sum(counts), rng.randrange(1, 9)
        sizes = [total // k + (i < total % k) for i in range(k)]
        m = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes


def test_hypergeometric_beyond_numpy(monkeypatch):
    monkeypatch.setattr(sharding, "_NUMPY_MOST", 0)
    rng = np.random.Generator(np.random.PCG64(3))
    draws = [sharding._hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.1 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.25
    assert sharding._hypergeometric(rng, 5, 0, 5) == 5 and sharding._hypergeometric(rng, 0, 5, 5) == 0


def test_sharding(spark, odd):
    df = odd.select("doc_id", "text", "shard", F.lit(1).alias("_b"), F.lit(2).alias("_p"))
    out = sharding.shard_uniform(df, 4).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in df.collect())
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sorted(len(v) for v in by.values()) == [2, 3, 3, 3] and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard_uniform(df.repartition(5), 4)
    assert sorted(map(tuple, again.select("doc_id", "shard", "slot").collect())) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in out)
    assert sharding.shard_uniform(empty(spark), 4).count() == 0


def test_sharding_is_uniform(spark):
    """A document's shard doesn't depend on its neighbours': pairs meet as often as chance has it."""
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    out = sharding.shard_uniform(df, 10).toPandas().sort_values("doc_id")
    s = out["shard"].to_numpy()
    assert out.groupby("shard").size().tolist() == [600] * 10
    assert abs((s[1:] == s[:-1]).mean() - 0.1) < 0.015
    assert abs(np.corrcoef(out["doc_id"], out["slot"])[0, 1]) < 0.05


def test_op7(spark):
    out = queries()["op7_sharding"](spark, SF).toPandas()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(s == len(docs[i].encode()) + 16 and c == zlib.crc32(docs[i].encode()) for i, s, c in zip(out["doc_id"], out["size"], out["text_crc32"], strict=True))
    n = out.groupby("shard").size()
    assert len(n) == 40 and n.max() - n.min() <= 1


# packing and token counts


def unpacked(rows, capacity):
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan(case):
    capacity, lengths = case
    counts = [lengths.count(k) for k in range(capacity + 1)]
    plan = packing.solve(counts, capacity)
    fill, seen = collections.defaultdict(list), collections.Counter()
    for length, first, n, sequence, each, offset in plan.runs:
        for k in range(n):
            fill[sequence + k // each].append((offset + k % each * length, length))
            seen[length, first + k] += 1
    assert set(seen) == {(x, k) for x in range(capacity + 1) for k in range(counts[x])} and set(seen.values()) <= {1}
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == np.concatenate([[0], np.cumsum([x for _, x in parts])[:-1]]).tolist() and sum(x for _, x in parts) <= capacity
    assert len(fill) == plan.sequences >= -(-sum(lengths) // capacity)


def fewest(lengths, capacity):
    """The least number of sequences, by search."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i] and free[k] not in free[:k]:
                place(i + 1, [*free[:k], free[k] - lengths[i], *free[k + 1 :]])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_best_packing(lengths):
    """Fixing dominating sets never costs a sequence."""
    plan = packing.Plan(20, [lengths.count(k) for k in range(21)])
    packing.reduce(plan)
    rest = [k for k, n in enumerate(plan.counts) for _ in range(n)]
    assert plan.sequences + fewest(rest, 20) == fewest(lengths, 20)


def test_pack(spark, odd):
    out = packing.pack(odd, 64).collect()
    unpacked(out, 64)
    encode = tokens.encoder(tokens.vocabulary_path())
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for r in odd.dropDuplicates(["doc_id"]).collect():
        ids = np.append(encode(r["text"]) if r["text"] else np.empty(0, np.uint32), np.uint32(2)).astype("<u4")
        copies = sum(x["doc_id"] == r["doc_id"] for x in odd.collect())
        parts = sorted(by[r["doc_id"]], key=lambda p: p["start"])
        assert sum(p["length"] for p in parts) == copies * len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and (p["piece"] == 0 or p["length"] == 64) for p in parts)
    assert packing.pack(empty(spark)).count() == 0


def test_op6_is_tight(spark):
    out = queries()["op6_best_fit_packing"](spark, SF).collect()
    assert unpacked(out, 1024) <= -(-sum(r["length"] for r in out) // 1024) + 5


def test_encoder_agrees_with_tokenizers():
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(tokens.vocabulary_path()), tokens.encoder(tokens.vocabulary_path())
    rng = random.Random(2)
    odd = ["a" * 5000, " " * 300 + "x", "  　 x\r\n\t", "日本語テキスト", "👩‍👩‍👧 é é ﬁ", "<|endoftext|> in text", "it's we'll I'M", "\x00\x01\x1c\x85", "١٢٣ ½ ²"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2000), rng.randrange(0x1F300, 0x1F600), 32, 10])) for _ in range(200)) for _ in range(200)]
    for t in odd:
        assert fast(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_histogram(spark, odd):
    lengths = [r[0] for r in tokens.token_lengths(odd).collect()]
    for block in (1, 7, 1024):
        rows = tokens.length_histogram(tokens.token_lengths(odd), block).collect()
        assert {r["n_tokens"]: r["n_docs"] for r in rows} == collections.Counter(lengths)
        for r in rows:
            n = r["n_tokens"]
            assert (r["docs_at_least"], r["tokens_at_least"], r["truncated_total"]) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
            assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths)) and abs(r["quantile"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    h = tokens.length_histogram(tokens.token_lengths(odd))
    assert {r["context_limit"]: r["truncated_total"] for r in tokens.truncated_totals(h, [0, 3, 1000, 10**7]).collect()} == {x: sum(min(n, x) for n in lengths) for x in (0, 3, 1000, 10**7)}
    assert tokens.length_quantile(h, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert tokens.length_histogram(tokens.token_lengths(empty(spark))).count() == 0


# fingerprints


def weighted_jaccard(a, b, n=5):
    def bag(t):
        w = t.encode().lower().split()
        return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else collections.Counter([tuple(w)] if w else [])

    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_samples_estimate_generalised_jaccard():
    rng, errors = random.Random(7), []
    for _ in range(60):
        base = [f"w{rng.randrange(300)}" for _ in range(300)] + ["the same line again"] * rng.randrange(5)
        other = base[: rng.randrange(300)] + [f"v{rng.randrange(300)}" for _ in range(150)] + base[:40] * rng.randrange(3)
        a, b = " ".join(base), " ".join(other)
        x, y = fingerprint.text_signature(a, 512), fingerprint.text_signature(b, 512)
        errors.append(fingerprint.likeness(x, y) - weighted_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def test_shared_scores_change_nothing():
    rng = random.Random(8)
    make = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    for n in (0, 1, 4, 5, 50, 9000):
        a, b = make(n), make(300)
        known = tuple(fingerprint.Sketch(fingerprint.text_words(t), keep=True) for t in (a, b))
        mixed = a[: len(a) // 2] + b[: len(b) // 2]
        assert (fingerprint.Sketch(fingerprint.text_words(mixed), known).samples == fingerprint.text_signature(mixed)).all()


def edited_by_hand(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        n, nxt = len(t), rows[(k + 1) % len(rows)][1]
        out[i] = (n, t[: n - n // 3] + nxt[: n // 3], nxt)
    return out


@pytest.mark.parametrize("per_bucket", [2, 50])
def test_edited_texts(spark, per_bucket):
    rng = random.Random(3)
    rows = [(i * i, rng.choice(["", "é" * rng.randrange(9), " ".join(f"w{rng.randrange(20)}" for _ in range(rng.randrange(60)))])) for i in range(60)]
    found = {r["doc_id"]: r for r in fingerprint.compare_with_edited(docs_of(spark, rows).repartition(3), rows_per_bucket=per_bucket).collect()}
    assert len(found) == len(rows)
    for i, (n, text, nxt) in edited_by_hand(rows).items():
        r, own = found[i], dict(rows)[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(text.encode()).hexdigest())
        a, b, c = map(fingerprint.text_signature, (own, text, nxt))
        assert r["fingerprint"] == a.astype(">u2").tobytes().hex() and r["edited_fingerprint"] == b.astype(">u2").tobytes().hex()
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))


def test_fingerprint_cases(spark, odd):
    out = fingerprint.compare_with_edited(odd).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r["fingerprint"] for r in out}
    assert by[1] == by[2] == by[3] == "0000" * fingerprint.SAMPLES and by[5] != by[6]
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(odd).collect()} == by
    assert fingerprint.compare_with_edited(empty(spark)).count() == 0
    one = fingerprint.compare_with_edited(docs_of(spark, [(5, "a b c d e f")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c d a b").hexdigest()


# language


def test_code_lengths_by_hand():
    """The tables give what walking the trees gives."""
    import math

    train = {"x": ["abcabd", "aab"], "y": ["zzz abc"]}
    counts = {}
    for k, ts in train.items():
        data = [language._bytes(t) for t in ts]
        counts[k] = []
        for n in range(1, 5):
            runs, c = np.unique(np.concatenate([language._grams(d, n) for d in data]), return_counts=True)
            counts[k].append((runs, c.astype(np.int64)))
    trees = language.Trees(counts)
    for text in ("abcz", "qqq", "aab zzz", "é"):
        for j, k in enumerate(trees.languages):
            seen = collections.defaultdict(collections.Counter)
            for t in train[k]:
                d = language._bytes(t)
                for i in range(3, len(d)):
                    for n in range(4):
                        seen[n, d[i - n : i]][d[i]] += 1
            d, bits = language._bytes(text), 0.0
            for i in range(3, len(d)):
                p = 1.0
                for n in (3, 2, 1, 0):
                    c = seen.get((n, d[i - n : i]))
                    if c is None:
                        continue
                    total, kinds = sum(c.values()), len(c)
                    if d[i] in c:
                        p *= c[d[i]] / (total + kinds)
                        break
                    p *= kinds / (total + kinds)
                else:
                    p /= 256
                bits -= math.log2(p)
            assert abs(bits - trees.code_lengths(text)[j]) < 1e-3


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    out = queries()["op5_language_id"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(out) == len(docs) and out["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out["doc_id"], out["held_out"], strict=True))
    held = out[out["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98


def test_language_cases(spark, odd):
    trees = language.train(odd.select("doc_id", "text", "lang"))
    out = {r["doc_id"]: r for r in language.identify(odd, trees).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 10)] == ["und"] * 4 and out[1]["score"] == 0
    assert out[5]["lang_pred"] in ("en", "de", "fr")
    nothing = language.train(empty(spark).select("doc_id", "text", "lang"))
    assert language.identify(odd, nothing).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(empty(spark), trees).count() == 0


def test_only_text_predicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    trees = language.train(docs.select("doc_id", "text", "lang"))
    a = sorted(map(tuple, language.identify(docs, trees).collect()))
    b = sorted(map(tuple, language.identify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}), trees).collect()))
    assert a == b


# toxicity


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(600):
        n = int(rng.integers(0, 8))
        rows.append(({0: n} if n else {}, 0 if n == 0 else toxicity.grade_of(n)))
    weights, cuts = toxicity.fit(rows, 2)
    assert weights[0] > 0.5 and abs(weights[1]) < 1e-9 and (np.diff(cuts) > 0).all()
    model = toxicity.Model(["x", "y"], weights, cuts)
    expected = [model.probabilities({0: n} if n else {}) @ np.arange(4) for n in range(8)]
    assert all(b > a for a, b in zip(expected, expected[1:], strict=False)) and expected[0] < 0.2 and expected[-1] > 2
    assert abs(model.probabilities({0: 3}).sum() - 1) < 1e-12


def test_ordinal_gradient():
    """The fit's result can't be bettered by small steps."""
    rows = [({0: 1}, 1), ({0: 4, 1: 1}, 3), ({}, 0), ({1: 2}, 0), ({0: 2}, 2), ({}, 0), ({0: 1, 1: 1}, 1), ({0: 6}, 3)] * 5
    penalty = 0.02
    w, c = toxicity.fit(rows, 2, 3000, penalty, 0.02)

    def loss(w, c):
        cuts = np.concatenate([[-np.inf], c, [np.inf]])
        total = 0.0
        for f, y in rows:
            s = sum(w[k] * np.log1p(n) for k, n in f.items())
            total -= np.log(1 / (1 + np.exp(s - cuts[y + 1])) - 1 / (1 + np.exp(s - cuts[y])))
        return total / len(rows) + penalty / 2 * (w**2).sum()

    best = loss(w, c)
    for k in range(5):
        for step in (-1e-3, 1e-3):
            p = np.concatenate([w, c])
            p[k] += step
            assert loss(p[:2], p[2:]) > best - 2e-6


def test_toxic_words_are_found_in_whole_words():
    model = toxicity.Model([" bad ", "adwo"])
    assert model.counts("Bad, badword BAD.") == ({0: 2, 1: 1}, 3)
    assert model.counts("nobad") == ({}, 0) and model.counts(None) == ({}, 0)


def toxic_corpus(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        words = [f"{rng.choice(['ba', 'lo', 'mi'])}{rng.choice(['ner', 'tas', 'rum'])}{rng.choice(['a', 'e', ''])}" for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(60), rng.choice(["grubling", "Snorkface"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    out = {r["doc_id"]: r for r in toxicity.grade_documents(docs, model).collect()}
    held = [(i % 6 == 0, out[i]) for i in range(1, 700, 2)] + [(i % 6 == 0, out[i]) for i in range(0, 700, 2)]
    assert all(t == r["toxic"] for t, r in held) and all(0 <= r["severity"] <= 3 for _, r in held)


def test_toxicity_cases(spark, odd):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.grade_documents(odd, model).collect()
    assert len(out) == odd.count() and not any(r["toxic"] for r in out)
    assert toxicity.grade_documents(empty(spark), model).count() == 0
    for lab in (labels.filter("false"), labels.filter("toxic = 0"), labels.selectExpr("doc_id", "quality", "cast(null as int) toxic")):
        nothing = toxicity.train(docs, lab)
        assert toxicity.grade_documents(docs, nothing).filter("toxic").count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] % 6 for r in kept.collect()} == {1, 2, 3, 4, 5}


# mixing


def test_targets(spark):
    rng = random.Random(6)
    for _ in range(6):
        sizes = {rng.choice([None, "a", "b", "é", "Z", "zz", "c1"]): rng.randrange(0, 1000) for _ in range(5)}
        total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: k % 3 + 1 for k, s in enumerate(names)}
        share, capped = {}, set()
        while True:  # reshare the excess until no target is above its limit
            free = [s for s in names if s not in capped]
            rest = total - sum(3 * sizes[s] for s in capped)
            share = {s: 3 * sizes[s] for s in capped} | {s: rest * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            if not over:
                break
            capped |= over
        found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert found.keys() == share.keys() and all(abs(found[s] - share[s]) < 1e-6 * max(1, total) for s in names)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=60), st.floats(0.05, 0.95), st.integers(0, 9))
def test_flight_keeps_the_balance(sizes, p, seed):
    x = np.array(sizes, float)
    start = np.full(len(x), p)
    end = mixing.flight(start, x, np.random.default_rng(seed))
    assert ((end >= 0) & (end <= 1)).all() and ((end > 0) & (end < 1)).sum() <= 2
    assert abs(end.sum() - start.sum()) < 1e-6 * (1 + len(x)) and abs(end @ x - start @ x) < 1e-4 * (1 + x.sum())


def test_flight_keeps_the_probabilities():
    rng, x = np.random.default_rng(1), np.array([3.0, 8, 1, 4, 9, 2, 6])
    mean = np.mean([mixing.flight(np.full(7, 0.4), x, rng) for _ in range(6000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.03


@pytest.mark.parametrize("n", [2, 5, 60, 400])
def test_landing_keeps_the_probabilities(n):
    """Small sources, and ones with a document far larger than the others, included."""
    sizes = np.sort(np.random.default_rng(n).integers(0, 400, n))[::-1].astype(float)
    sizes[0] = 20 * n
    seeds = 400 if n < 100 else 100
    runs = [mixing.landing(np.full(n, 0.37), sizes, np.random.default_rng(k)) for k in range(seeds)]
    assert set(np.unique(runs)) <= {0.0, 1.0}
    assert np.abs(np.mean(runs, axis=0) - 0.37).max() < 4 * (0.37 * 0.63 / seeds) ** 0.5
    if n == 400:
        assert max(abs(r @ sizes / (0.37 * sizes.sum()) - 1) for r in runs) < 0.005


def test_mix_takes_rows_with_their_probability(spark):
    """The query's own sizes, over seeds: every document of a source is taken as often as its share says."""
    rows = [(1, i, 1 + (i * 7919) % 500, 0.3) for i in range(80)]
    units = spark.createDataFrame(rows, "source_no int, doc_id long, size long, p double")
    taken = np.zeros(80)
    for seed in range(6):
        out = mixing.balanced_pass(units, block_rows=30, held=10, seed=seed).toPandas().sort_values("doc_id")
        taken += out["p"].to_numpy()
    assert abs(taken.mean() / 6 - 0.3) < 0.05 and len(set(taken)) > 3


@pytest.mark.parametrize("block", [10, 8192])
def test_balanced_pass(spark, block):
    rng = random.Random(9)
    rows = [(s, i, rng.randrange(1, 900), 0.37) for s in (1, 2) for i in range(150 * s)]
    units = spark.createDataFrame(rows, "source_no int, doc_id long, size long, p double")
    out = mixing.balanced_pass(units, block_rows=block).toPandas()
    assert len(out) == len(rows) and set(out["p"]) <= {0.0, 1.0}
    for s, g in out.groupby("source_no"):
        assert abs((g["p"] * g["size"]).sum() / (0.37 * g["size"].sum()) - 1) < 0.01 and abs(g["p"].mean() - 0.37) < 0.08
    again = mixing.balanced_pass(units.repartition(5), block_rows=block).toPandas()
    key = ["source_no", "doc_id"]
    assert out.sort_values(key)["p"].tolist() == again.sort_values(key)["p"].tolist()


def test_mix_cases(spark, odd):
    out = mixing.mix(odd).toPandas()
    assert len(out) == odd.count() and (out["taken"] <= 3 * out["size"]).all() and (out["taken"] == out["size"] * out["copies"]).all()
    assert mixing.mix(empty(spark)).count() == 0


def test_op9(spark):
    out = queries()["op9_source_mixing"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").toPandas()
    out = out.merge(docs, on="doc_id")
    assert all(s == len((t or "").encode().split()) for s, t in zip(out["size"], out["text"], strict=True))
    for _, g in out.groupby("source"):
        assert g["size"].sum() == g["source_size"].iat[0] and abs(g["taken"].sum() / g["target"].iat[0] - 1) < 0.005
    assert abs(out.groupby("source")["target"].first().sum() - out["size"].sum()) < 1e-3


# n-gram Jaccard join


def components_by_hand(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_copies(rng, families=6, copies=12, words=120):
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(60 if f % 2 else 9)}" for _ in range(rng.choice([2, 3, 5, 12, 25, words]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(4) if t else 0):
                at = rng.randrange(len(t) or 1)
                t[at : at + rng.randrange(2)] = [f"w{rng.randrange(60)}"] * rng.randrange(2)
            base = t if rng.random() < 0.3 and t else base  # chains of small steps
            rows.append(" ".join(t).upper() if rng.random() < 0.1 else " ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den", "bits"), [(3, 9, 10, 64), (5, 4, 5, 64), (1, 1, 2, 64), (5, 4, 5, 8)])
def test_components_by_hand(spark, n, num, den, bits, monkeypatch):
    """Also where runs and texts share hashes: of 8 bits each, most do."""
    monkeypatch.setattr(jaccard_join, "HOT", 8)
    rows = near_copies(random.Random(n))
    found = jaccard_join.jaccard_components(docs_of(spark, rows).repartition(3), n, num, den, bits=bits).collect()
    assert sorted(map(tuple, found)) == components_by_hand(rows, n, num, den)


def test_large_buckets_go_in_blocks(spark):
    """The exhaustive round on its own, in blocks and as a join, finds every pair the bounds let pass."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(80):
        t = list(base)
        for _ in range(rng.randrange(12)):
            t[rng.randrange(90)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(t + [f"long{k}" for k in range(600)] if i % 9 == 0 else t)))
    info = common.cut(jaccard_join.describe(docs_of(spark, rows).select("doc_id", "text"), 1), "info")
    common.prepare(spark)
    members = spark.createDataFrame([(7, i, 0, i % 5) for i in range(80)], "sig long, doc_id long, hub long, component long")
    pairs = {small: set(map(tuple, jaccard_join._across(members, info, 4, 5, small, 16).collect())) for small in (0, 1000)}
    assert pairs[0] == pairs[1000]
    linked = {(a, b) for a, b in ((i, j) for i in range(1, 80) for j in range(i + 1, 80)) if a % 5 != b % 5 and components_by_hand([rows[a], rows[b]], 1, 4, 5)[1][2] == a}
    assert linked <= pairs[0] and linked


def test_schemes_miss_nothing():
    """Any two sets within the threshold share a signature, whatever the allocation."""
    rng = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        starts = jaccard_join.bands(400)
        for extra in (0, 1):
            schemes = []
            for k in range(len(starts) - 1):
                u, r = (den - num) * 2 * (starts[k + 1] - 1) // (den + num), 1 + k % 3
                t = (u + 1) // 2 if extra else 0
                schemes.append((u + (2 * r - 1 if t else r) - t, t, r))
            for _ in range(150):
                n = int(rng.integers(10, 400))
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                drop, add = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
                b = np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
                common_, union = len(a) - drop, len(a) + add
                if den * common_ >= num * union and (drop or add) and len(b) <= 400:
                    x, y = (jaccard_join.signatures(np.unique(s), starts, schemes, num, den) for s in (a, b))
                    assert len(np.intersect1d(x, y))


def test_segments_without_content_are_no_meeting_places():
    """Of many unlinked sets, hardly any share a signature, though most have empty segments under a narrow scheme."""
    rng = np.random.default_rng(8)
    starts, sets = [1, 41, 51], 4000
    m, t, r = jaccard_join.allocate(45, 1e9, 10)
    assert r > 1
    found = [jaccard_join.signatures(rng.integers(0, 2**63, 45).astype(np.uint64), starts, [(1, 0, 1), (m, t, r)], 4, 5) for _ in range(sets)]
    _, counts = np.unique(np.concatenate(found), return_counts=True)
    alone = [jaccard_join.signatures(rng.integers(0, 2**63, 45).astype(np.uint64), starts, [(1, 0, 1), (11, 0, 1)], 4, 5) for _ in range(sets)]
    assert counts.max() <= 0.2 * np.unique(np.concatenate(alone), return_counts=True)[1].max()


def test_join_cases(spark, odd):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(odd, 3, 9, 10).collect()}
    assert out[1] == (0, 1) and out[2] == (0, 2) and out[3] == (0, 3) and out[4] == (1, 4) and out[8][1] == 7 and out[9][1] == 9
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_hashes_of_runs_tell_places_apart():
    """Two words in different orders give different runs."""
    seen = {}
    for bits in range(32):
        words = [b"ab"[bits >> k & 1 :][:1] for k in range(5)]
        h = int(common.shingle_hashes(words, 5)[0])
        assert seen.setdefault(h, words) == words
    assert len(seen) == 32


def test_components_of_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = dict(jaccard_join.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(found.get(x, x) == find(x) for x in list(parent))


# HTML


PAGE = """<!DOCTYPE html><html><head><title>x</title></head><body class="home"><header><h1>Site</h1><nav><a href=1>a</a></nav></header>
<div id="wrap"><div class="sidebar">Side stuff</div><div class="content"><h2>Head &amp; line</h2><p>First  para<br>more text &lt;b&gt; <b>bold</b>.<p>Second &eacute; para</p><ul><li>one<li>two</ul>
<table><tr><td>a<td>b</tr></table><div class="share">Share me</div><form>Name <input></form><div id="comments"><p>nice</p></div></div></div><div class="cookie-notice">We use cookies</div><script>if (a<b) "</p>"</script><footer>f</footer></body></html>"""


def test_main_text_of_one_page():
    assert html.main_text(html.parse(PAGE)) == "Head & line\n\nFirst para more text <b> bold.\n\nSecond é para\n\none\n\ntwo\n\na b"
    layout = "<table><tr><td><a href=1>x</a></td><td><h2>Story</h2>Plain text.<br>Next line.<p>A paragraph.</p></td></tr><tr><td>1<td>2</tr></table>"
    assert html.main_text(html.parse(f"<article>{layout}</article>")) == "x\n\nStory\n\nPlain text. Next line.\n\nA paragraph.\n\n1 2"
    assert html.main_text(html.parse("")) == "" and html.main_text(html.parse("<p>a</p> b <!-- c")) == "a\n\nb"


def plain_page(i):
    return f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>Para {i} of a page with some words.</p>" + "".join(f"<p>More {i * j} and {j}.</p>" for j in range(i)) + "</div><div>All rights kept</div></body>"


def test_wrapper_without_any_hint(spark):
    w = html.expression(html.parse(plain_page(1)))
    for i in range(2, 6):
        w = html.align(w, html.expression(html.parse(plain_page(i))))
    assert html.show(w) == "<body><div>#same</> <div>(<p>#text</>)+</> <div>#same</></>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", plain_page(i)) for i in range(1, 7)], "page_id long, url string, html string").repartition(3)
    out = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert out[2] == "Para 2 of a page with some words.\n\nMore 0 and 0.\n\nMore 2 and 1."


def test_alignment_finds_optional_and_repeated_groups():
    make = lambda body: html.expression(html.parse(f"<div>{body}</div>"))
    w = html.align(make("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"), make("<h2>a</h2><p>b</p><hr><pre>x</pre>"))
    assert html.show(w) == "<div>((<h2>#text</> <p>#text</>)+)? (<h2>#text</>)? (<p>#text</>)? (<pre>#same</>)?</>" or "?" in html.show(w)
    again = html.align(make("<h2>a</h2><p>b</p>"), make("<h2>a</h2><p>b</p><p>c</p>"))
    assert html.show(again) == "<div><h2>#same</> (<p>#text</>)+</>"


def test_extract_cases(spark):
    rows = [(1, None, None), (2, "http://[bad", "<article><p>x</p></article>"), (3, "", ""), (4, "http://a/", "no markup &amp; text"), (4, "http://a/", "no markup &amp; text"), (5, "http://b/", "<nav>only menu</nav>"), (6, "http://c/", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit("y"), "wrapper": F.lit("z")})
    out = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert [out[i]["text"] for i in (1, 2, 3, 4, 5)] == ["", "x", "", "no markup & text", ""] and out[6]["n_chars"] == 20_000 * 6 - 2
    assert html.extract(pages.filter("false")).count() == 0
    joined = {r["page_id"]: r["text"] for r in html.extract(pages, broadcast_bytes=-1).collect()}
    assert joined == {i: r["text"] for i, r in out.items()}


def test_pages_give_their_articles(spark):
    import html as entities
    import re

    out = {r["page_id"]: r["text"] for r in queries()["op1_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(entities.unescape(b).split()) for b in re.split(r"<[^>]+>", re.sub(r"</?b>", "", body).replace("<br>", " "))]
        assert out[r["page_id"]] == "\n\n".join(filter(None, blocks))


STORY = "<p>The first fact of the story.</p><p>The second fact of the story.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content has-sidebar"><article>{STORY}</article><div class="sidebar"><p>links</p></div></div>',
        f'<div class="site with-sidebar"><main>{STORY}</main></div>',
        f'<body class="single-post comments-open"><article>{STORY}</article><div id="comments"><p>nice</p></div></body>',
        f'<body class="responsive nav-open"><div class="entry">{STORY}</div></body>',
        f'<article class="post comments-open category-ads">{STORY}</article><aside><p>x</p></aside>',
        f'<form id="aspnetForm" method="post"><div><nav>menu</nav><article>{STORY}</article></div></form>',
        f'<form id="form1"><div class="content">{STORY}</div><div class="footer">f</div></form>',
        f'<div class="social-wrap"><article>{STORY}</article></div><p>tail</p>',
        f'<article>{STORY}</article><div class="related"><article><p>Another.</p></article></div>',
        f'<main>{STORY}</main><div class="related"><article><p>Another.</p></article></div>',
        f'{STORY}<div class="related"><article><p>Another.</p></article></div>',
        f'<main>{STORY}<form><p>Your name</p></form></main><aside><article><p>Another.</p></article></aside>',
        f'<article>{STORY}</article><div id="comments"><article class="comment-body"><p>{"nice " * 50}</p></article></div>',
    ],
)
def test_articles_in_layouts(page):
    assert html.main_text(html.parse(page)) == "The first fact of the story.\n\nThe second fact of the story."


@pytest.mark.parametrize("facts_first", [True, False])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<body>{}</body>"])
def test_link_lists_leave_their_siblings(facts_first, wrap):
    pages = []
    for i in range(4):
        facts = f"<ul><li>A fact number {i * 7}.</li><li>A second fact {i * 5}.</li></ul>"
        links = "<ul>" + "".join(f"<li><a href=x>See also this long title {i + k}</a></li>" for k in range(6)) + "</ul>"
        a, b = (facts, links) if facts_first else (links, facts)
        pages.append(wrap.format(f"<p>Story {i} begins.</p>{a}<p>Story {i} goes on.</p>{b}"))
    wrapper = html.expression(html.parse(pages[0]))
    for page in pages[1:]:
        wrapper = html.align(wrapper, html.expression(html.parse(page)))
    for i, page in enumerate(pages):
        text = html.main_text(html.parse(page), html.label(wrapper))
        assert f"A fact number {i * 7}.\n\nA second fact {i * 5}." in text and "See also" not in text and f"Story {i} goes on." in text


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><p>b</p>", "Let x=1 hold.\n\nb"),
        ("<p>a <math><semantics><mi>y</mi><annotation encoding=tex>\\y</annotation></semantics></math> b</p>", "a y b"),
        ("<p>a <math/> b</p><p>c</p>", "a b\n\nc"),
        ("<xmp>a <b> &amp; c</xmp><p>d</p>", "a <b> &amp; c\n\nd"),
        ('<p>a <svg viewBox="0"/> b</p><p>c</p>', "a b\n\nc"),
        ("<p>a <svg><title/><path d=x /><text>no</text></svg> b</p>", "a b"),
        ("<p>a <svg><g> b</p><p>c</p>", "a\n\nc"),
        ("<p>a</p><svg><g><p>b</p>", "a\n\nb"),
        ("<p>a</p><button>Like<p>b</p><p>c</p>", "a\n\nb\n\nc"),
        ("<p>a</p><button>Like<p>b</p><button>Share<p>c</p><button>Ok</button>", "a\n\nb\n\nc"),
        ("<p>a <button>Like</p><p>b</p>", "a\n\nb"),
        ("<div>a <select><option>x<option>y</div><p>b</p>", "a\n\nb"),
        ("<p>a</p><button><div>Like</div></button><p>b <button>x</button> c</p>", "a\n\nb c"),
        ("<p>a</p><object><object><p>x</p></object><p>y</p></object><p>b</p>", "a\n\nb"),
        ("<p>a</p><video src=x><p>No video.</p></video><canvas>x<p>b</p>", "a\n\nb"),
        ("<p>a</p><script>if (a<b) '<p>x</p>'</script ><style>p{}</style><p>b</p>", "a\n\nb"),
        ("<p>a</p><template><p>x</p></template><p>b</p>", "a\n\nb"),
    ],
)
def test_embedded_elements(body, text):
    assert html.main_text(html.parse(f"<body><article>{body}</article><footer>f</footer></body>")) == text


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02}": [letters[k % 26] * 2 + letters[k // 26] * 3, letters[(k * 7 + 3) % 26] + letters[k // 26] + letters[k % 26]] for k in range(78)}
    rows = [(100 * k + i, " ".join(w * 20), lang) for k, (lang, w) in enumerate(words.items()) for i in range(2 if k > 64 else 3)]
    rows += [(10_000, "žluťoučký kůň " * 4000, "long"), (10_001, None, "none"), (10_002, "x", None)]
    trees = language.train(docs_of(spark, rows).select("doc_id", "text", "lang"))
    assert set(trees.languages) == {*words, "long"}
    assert trees.predict("žluťoučký kůň")[0] == "long" and all(trees.predict(" ".join(w * 3))[0] == x for x, w in words.items())
    assert language.train(docs_of(spark, []).filter("false").select("doc_id", "text", "lang")).predict("a b")[0] == "und"


def test_cues_in_scripts_without_blanks(spark):
    word = "的一是不了人我在有他这为之大来以个中上们" * 3
    assert "他这为之" in toxicity.candidates({word}) and f" {word} " not in toxicity.candidates({word})
    rng = random.Random(5)
    clause = lambda: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    rows = [(i, clause() + ("恶毒坏话" if i % 2 else "") + clause()) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, toxic int")
    docs = docs_of(spark, rows)
    out = toxicity.grade_documents(docs, toxicity.train(docs, labels)).collect()
    assert all(r["toxic"] == bool(r["doc_id"] % 2) for r in out)


@pytest.mark.parametrize("page, chars", [("<div>" * 50_000 + "x", 1), ("<p>t</p>" + "<a x " * 200_000, 999_999 + 3), ("<object><div>a " * 20_000, 3 * 20_000 - 2), ("<button><div>a " * 20_000, 3 * 20_000 - 2)], ids=["deep", "unclosed", "objects", "buttons"])
def test_broken_pages_are_read_whole_and_fast(page, chars):
    """Deep nesting, tags and embedded elements without an end: all text stays, in time that is linear in the page."""
    import time

    start = time.perf_counter()
    tree = html.parse(page)
    text = html.main_text(tree, html.label(html.align(html.expression(tree), html.expression(html.parse(page)))))
    assert len(text) == chars and time.perf_counter() - start < 20


def test_tags_end_outside_quotes():
    assert html.main_text(html.parse('<p title="a > b" x=\'c > d\'>one</p><p title="open>two</p><p>three</p>')) == "one\n\ntwo\n\nthree"
    assert html.main_text(html.parse("<p>1 < 2 <3 and <4</p><p>end <b")) == "1 < 2 <3 and <4\n\nend <b"


@pytest.mark.parametrize("parts", [1, 5])
def test_wrapper_finds_template_inside_articles(spark, parts):
    """A box of no telling class or tag, in the article of every page of a host, is template; the page alone can't tell."""
    box = "<div class=\"k2\"><p>Get our best stories each week, straight to you.</p></div>"
    pages = [(i, f"http://h.test/{i}", f"<article><h1>Background to it</h1><p>{'Story %d goes on and on here. ' % i * 5}</p>{box}<p>{'More of %d follows. ' % i * 9}</p></article>") for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
    out = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    for i, _, page in pages:
        assert out[i] == f"Background to it\n\n{('Story %d goes on and on here. ' % i * 5).strip()}\n\n{('More of %d follows. ' % i * 9).strip()}"
        assert "best stories" in html.main_text(html.parse(page))


def test_versions_of_one_article_stay_whole(spark):
    """Pages of a host that share most of their article keep it."""
    pages = [(i, f"http://v.test/{i}", f"<article><p>{'The same long paragraph in all versions. ' * 4}</p><p>{'Edited %d. ' % i * 6}</p></article>") for i in range(6)]
    out = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith("The same long paragraph") and f"Edited {r['page_id']}." in r["text"] for r in out)


def test_long_lists_align_by_tokens_that_occur_once(monkeypatch):
    """The short way for very long lists finds the tokens that both have in one order."""
    items = lambda s: [{"s": x, "o": 0, "r": 0, "n": 1, "c": []} for x in s]
    exact = html._matches(items("abcdefg"), items("xbcydefz"))
    monkeypatch.setattr(html, "MOST_CELLS", 0)
    assert html._matches(items("abcdefg"), items("xbcydefz")) == exact
    assert html._matches(items("abab"), items("ba")) == []
