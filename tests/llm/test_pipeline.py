"""The pipeline's stages, each against brute force on a small corpus with planted cases."""

import collections
import random

import pytest

import corpus_pipeline as pipeline
from quillet.llm import jaccard_join
from tests.llm.test_operators import components_by_hand, docs_of, toxic_corpus, unpacked


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    docs, labels = toxic_corpus(spark)
    rows = [(r["doc_id"], r["text"], "en", f"s{r['doc_id'] % 5}", len(r["text"])) for r in docs.collect()]
    words = lambda n: " ".join(f"u{rng.randrange(5000)}" for _ in range(n))
    for i in range(10):
        base = words(80)
        w = base.split()
        w[3] = "changed"
        rows += [(10_000 + 10 * i, base, "en", "s1", 1), (10_001 + 10 * i, base + "\n", "en", "s2", 1), (10_002 + 10 * i, " ".join(w), "de", "s3", 1), (10_003 + 10 * i, base + " grubling snorkface grubling", "en", "s4", 1)]
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "s1", 0), (20_002, words(4000), "en", "s0", 1)]
    at = tmp_path_factory.mktemp("corpus")
    docs_of(spark, rows).write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for name, stage in pipeline.STAGES:
        frames.append(pipeline.cut(stage(spark, frames[-1], corpus), name))
    assert all(f.columns == columns for f in frames[:-1])
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames[:-1]]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i, t in texts.items() if t and "grubling" in t.lower() or t and "snorkface" in t.lower()}
    assert ids[0] - ids[1] == toxic
    groups = collections.defaultdict(list)
    for i in ids[1]:
        groups["".join((texts[i] or "").split())].append((-len(texts[i] or ""), i))
    assert ids[2] == {min(g)[1] for g in groups.values()}
    by_hand = components_by_hand([(i, texts[i]) for i in sorted(ids[2])], 5, 4, 5)
    assert ids[3] == {i for i, _, c in by_hand if i == c}
    taken = collections.Counter(r["doc_id"] for r in frames[4].select("doc_id").collect())
    assert set(taken) <= ids[3] and max(taken.values()) <= 3
    out = frames[5].collect()
    unpacked(out, 1024)
    assert {r["doc_id"] for r in out} == set(taken) and sum(r["piece"] == 0 for r in out) == sum(taken.values())


def test_run(spark, corpus):
    a, b = (sorted((r["doc_id"], r["piece"], r["length"]) for r in pipeline.run(spark, corpus).collect()) for _ in range(2))
    assert a == b and a


def test_repeated_rows_leave_one(spark, corpus):
    docs = docs_of(spark, [(1, "a b"), (1, "a b"), (2, "a  b"), (2, "a  b"), (3, "c")])
    assert sorted(r["doc_id"] for r in pipeline.dedup(spark, docs, corpus).collect()) == [2, 3]


def test_empty_table(spark, corpus):
    docs = docs_of(spark, []).filter("false")
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, corpus), name)
    assert docs.count() == 0


def test_other_columns_stay(spark, corpus):
    names = ["copies", "target", "kept", "keep_id", "component_id", "severity", "size", "_copy", "_severity", "n_shingles", "dropped"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet").selectExpr("*", *[f"'x' AS {c}" for c in names])
    for name, stage in pipeline.STAGES:
        before, docs = docs, pipeline.cut(stage(spark, docs, corpus), name)
        if name != "best_fit_packing":
            assert docs.columns == before.columns and {r[0] for r in docs.select("copies").distinct().collect()} == {"x"}


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    assert pipeline.ORACLE_SQL is None and jaccard_join.jaccard_components


ODD_IDS = [(None, "a first text of seven words here", "en", "s", 1), (None, "another text that has words of its own", "en", "s", 1), (7, "b one more text with other words", "en", "s", 1), (7, "c yet another one under that id", "en", None, 1), (8, "b one  more text with other words", "en", "s", 1), (9, "lone words", "en", "s", 1), (None, "lone words", "en", "s", 1)]


def test_null_and_repeated_ids(spark, corpus):
    docs = docs_of(spark, ODD_IDS)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in pipeline.dedup(spark, docs, corpus).collect())
    unique = sorted((i or 0, t) for k, (i, t, *_) in enumerate(ODD_IDS) if k not in (2, 6))
    assert kept == unique
    near = docs_of(spark, [*ODD_IDS[:4], (None, ODD_IDS[0][1].upper(), "en", "s", 1), (None, ODD_IDS[0][1], "en", "s", 1)])
    assert sorted(r["text"][0].lower() for r in pipeline.near_dedup(spark, near, corpus).collect()) in (["a", "a", "b", "c"], ["a", "a", "a", "b", "c"])
    assert collections.Counter(r["text"] for r in pipeline.near_dedup(spark, near, corpus).collect())[ODD_IDS[0][1]] == 1


def test_mixing_takes_rows_of_any_id(spark, corpus):
    docs = docs_of(spark, ODD_IDS)
    taken = collections.Counter((r["doc_id"], r["text"]) for r in pipeline.mixing(spark, docs, corpus).collect())
    plain = docs_of(spark, [(k, *r[1:]) for k, r in enumerate(ODD_IDS)])
    assert max(taken.values()) <= 3 and any(i is None for i, _ in taken)
    assert abs(sum(taken.values()) - pipeline.mixing(spark, plain, corpus).count()) <= 2
