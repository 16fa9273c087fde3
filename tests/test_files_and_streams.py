"""Directory scans, index syncs and streams in temporary folders."""

import json
import os

import pytest

from quillet.operators import index
from quillet.sources import files
from quillet.streaming import ingest


def rows(n):
    return json.dumps([{"id": i, "name": f"row-{i}"} for i in range(n)])


@pytest.fixture
def tree(tmp_path):
    for path, text in {"a.json": rows(20), "sub/b.csv": "k,v\n1,2\n3,4\n", "sub/skip.log": "x", ".hidden/c.json": "[]", "build/d.json": "[]", "big.json": rows(3000), "prose.txt": "just words"}.items():
        p = tmp_path / "root" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        os.utime(p, (1000, 1000))
    return tmp_path / "root"


def test_scan(spark, tree):
    from quillet.operators.convert import Options

    listed = {r["path"]: r for r in files.scan(spark, str(tree), ignore=["*.log", "/build/"]).collect()}
    assert sorted(listed) == ["a.json", "big.json", "prose.txt", "sub/b.csv"]
    assert listed["a.json"]["mtime_unix"] == 1000
    with pytest.raises(ValueError):
        files.scan(spark, str(tree), most_files=2)
    with pytest.raises(ValueError):
        files.glob_pattern("[")
    made = files.index_files(spark, str(tree), 7, Options(max_input_bytes=10_000), ignore=["*.log", "build/"])
    kinds = {r["path"]: r["doc_type"] for r in made["files"].collect()}
    assert kinds == {"a.json": "json", "sub/b.csv": "csv", "big.json": None, "prose.txt": None}
    assert {r["path"] for r in made["conversions"].collect()} == {"a.json", "sub/b.csv"}
    assert {r["path"]: r["shape_class"] for r in made["shapes"].collect()}["a.json"] == "uniform"
    assert index.status(made["files"]).first()["classified"] == 2


def test_size_is_checked_in_the_scan(spark, tree):
    text = files.contents(spark, str(tree), 100)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,100)]" in text
    assert "content" not in files.scan(spark, str(tree))._jdf.queryExecution().toString().split("ReadSchema")[1]


def test_ignore_rules(spark):
    from pyspark.sql import functions as F

    paths = ["a.log", "x/a.log", "keep.log", "build/x", "x/build/y", "docs/a/b.txt", "docs/b.txt", "q1.c"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    left = [r[0] for r in df.filter(~files.ignored(F.col("path"), ["*.log", "!keep.log", "/build", "docs/**/b.txt", "q?.c", "# note"])).collect()]
    assert left == ["keep.log", "x/build/y"]


def test_sync(spark):
    old = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 1, "h"), ("edited", 1, 1, "h"), ("gone", 1, 1, "h")], "path string, size_bytes long, mtime_unix long, content_hash string")
    cur = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 2, "h"), ("edited", 1, 2, "i"), ("new", 1, 1, "h")], old.schema)
    assert dict(index.diff(old, cur).collect()) == {"same": "unchanged", "touched": "touched", "edited": "updated", "gone": "removed", "new": "added"}
    assert dict(index.sync_counts(index.diff(old, cur)).collect()) == {"unchanged": 2, "updated": 1, "removed": 1, "added": 1}
    from pyspark.sql import functions as F

    stamped = old.withColumn("scanned_at", F.lit(1).cast("long"))
    found = {r["path"]: (r["mtime_unix"], r["scanned_at"]) for r in index.next_files(stamped, cur, 9).collect()}
    assert found == {"same": (1, 1), "touched": (2, 9), "edited": (2, 9), "new": (1, 9)}


def test_json_lines_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s1.ndjson").write_text("\n".join(json.dumps({"k": i, "name": "n"}) for i in range(50)) + "\n\n")
    (tmp_path / "in" / "s2.ndjson").write_text('{"k":1}\n{bad\n')
    lines = ingest.lines(spark, str(tmp_path / "in"))
    out = []
    ingest.run_to_end(ingest.running_totals(lines), lambda batch, _: out.extend(batch.collect()), str(tmp_path / "c1"), "update")
    last = {r["path"].rsplit("/", 1)[1]: (r["records"], r["keys"], r["valid"]) for r in out}
    assert last == {"s1.ndjson": (50, "k,name", True), "s2.ndjson": (2, "k", False)}
    docs = []
    from pyspark.sql import functions as F

    def each(batch, _):
        docs.extend(ingest.tron_documents(batch.withColumn("pos", F.monotonically_increasing_id())).collect())

    ingest.run_to_end(ingest.lines(spark, str(tmp_path / "in")), each, str(tmp_path / "c2"))
    found = {d["path"].rsplit("/", 1)[1]: d for d in docs}
    assert found["s1.ndjson"]["converted"] and found["s1.ndjson"]["text"].startswith("class A: k, name\n\n[A(0,")
    assert not found["s2.ndjson"]["converted"] and found["s2.ndjson"]["text"] == '{"k":1}\n{bad\n'


def test_delimited_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,x\n2,y\n")
    got = []
    ingest.run_to_end(ingest.delimited(spark, str(tmp_path / "in"), ["k", "v"]), lambda b, _: got.extend(map(tuple, b.collect())), str(tmp_path / "c"))
    assert sorted(got) == [("1", "x"), ("2", "y")]


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("[]")
    calls = []
    query = ingest.watch(spark, str(tmp_path / "in"), lambda: calls.append(1), str(tmp_path / "c"), "0 seconds")
    query.processAllAvailable()
    query.stop()
    assert calls


def test_unchanged_files_are_not_opened(spark, tree, monkeypatch):
    opened, contents = [], files.contents
    monkeypatch.setattr(files, "contents", lambda s, r, m, only: opened.append(sorted(x["path"] for x in only.collect())) or contents(s, r, m, only))
    first = files.index_files(spark, str(tree), 7, ignore=["*.log", "/build/"])["files"]
    known = spark.createDataFrame(first.collect(), first.schema)
    (tree / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    again = files.index_files(spark, str(tree), 9, known=known, ignore=["*.log", "/build/"])
    rows = {r["path"]: r for r in again["files"].collect()}
    assert opened == [["a.json", "big.json", "prose.txt", "sub/b.csv"], ["a.json"]]
    old = {r["path"]: r for r in first.collect()}
    assert rows["sub/b.csv"] == {r["path"]: r for r in known.collect()}["sub/b.csv"] and rows["a.json"]["content_hash"] != {r["path"]: r for r in known.collect()}["a.json"]["content_hash"]
    assert set(rows) == set(old) and {r["path"] for r in again["conversions"].collect()} <= {"a.json"}
    idle = files.index_files(spark, str(tree), 9, known=spark.createDataFrame(again["files"].collect(), first.schema), ignore=["*.log", "/build/"])
    assert idle["conversions"].count() == 0 and idle["files"].count() == len(rows)


def test_many_changed_files_are_read_with_the_tree(spark, tree, monkeypatch):
    monkeypatch.setattr(files, "MOST_PATHS", 1)
    made = files.index_files(spark, str(tree), 7, ignore=["*.log", "/build/"])
    assert {r["path"]: r["doc_type"] for r in made["files"].collect()}["a.json"] == "json"
