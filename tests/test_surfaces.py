"""SQL names, the data source, the stored index, configuration and the command line."""

import json

import pytest

from quillet import __main__ as cli
from quillet import config
from quillet.functions import register, tokens
from quillet.operators import convert, ledger
from quillet.operators.store import IndexStore, VersionError
from quillet.sources import files, table_text

ROWS = [{"id": i, "name": f"row-{i}"} for i in range(40)]


def test_sql_functions(spark):
    register.register(spark)
    df = spark.createDataFrame([(json.dumps(ROWS).encode(), json.dumps(ROWS))], "b binary, t string")
    df.createOrReplaceTempView("payloads")
    r = spark.sql("SELECT payload_detect(b) d, toon_decode(maybe_convert(b)) j, tron_decode(tron_encode(t)) tr, onto_decode(onto_encode(t)) o, json_sort_keys('{\"b\":1.0,\"a\":2}') s, toon_lint('[]') l, toon_decode('a: \"x') bad, payload_inspect(b) i, payload_json(b) p FROM payloads").first()
    assert r["d"] == "json" and r["s"] == '{"a":2,"b":1.0}' and r["l"] == ["empty top-level array"] and r["bad"] is None
    assert all(json.loads(r[k]) == ROWS for k in ("j", "tr", "o", "p")) and json.loads(r["i"])["token_savings_pct"] > 20
    assert spark.sql("SELECT count(*), max(pos) FROM toon_rows('[2]{a}:\n  1\n  2\n')").first()[:] == (2, 1)


def test_data_source(spark, tmp_path):
    spark.dataSource.register(table_text.ToonSource)
    values = [json.dumps(ROWS[:n], separators=(",", ":")) for n in (1, 2, 3)]
    spark.createDataFrame([("", v) for v in values], "path string, value string").write.format("toon").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("toon").load(str(tmp_path / "out"))
    assert sorted(r["value"] for r in back.collect()) == sorted(values)
    assert all(p.suffix == ".toon" for p in (tmp_path / "out").iterdir())


def test_index_store(spark, tmp_path):
    root, store = tmp_path / "root", IndexStore(spark, str(tmp_path / "index"))
    root.mkdir()
    for k in range(3):
        (root / f"{k}.json").write_text(json.dumps(ROWS[: 10 + k]))
    assert store.current() == 0 and store.read("files").count() == 0
    first = dict(store.sync(files.index_files(spark, str(root), 5), 5).collect())
    assert first == {"added": 3}
    (root / "0.json").write_text(json.dumps(ROWS))
    (root / "1.json").unlink()
    second = dict(store.sync(files.index_files(spark, str(root), 9), 9).collect())
    assert second == {"updated": 1, "removed": 1, "unchanged": 1}
    assert {r["path"]: r["scanned_at"] for r in store.read("files").collect()} == {"0.json": 9, "2.json": 5}
    assert {r["path"]: r["computed_at"] for r in store.read("conversions").collect()} == {"0.json": 9, "2.json": 5}
    assert store.compact() == 3 and store.read("shapes").count() == 2
    store._say(4, schema_version="7")
    with pytest.raises(VersionError):
        store.current()


def test_config(tmp_path, monkeypatch):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "quillet.toml").write_text('margin_pct = 7.5\nprotect = ["Salary", "id"]\n')
    o = config.discover(str(tmp_path / "a" / "b"))
    assert o.margin_pct == 7.5 and o.auto_margin and o.critical == (*convert.CRITICAL, "salary")
    (tmp_path / "bad.toml").write_text("nonsense = 1\n")
    monkeypatch.setenv("QUILLET_CONFIG", str(tmp_path / "bad.toml"))
    with pytest.raises(ValueError, match="nonsense"):
        config.discover()


def test_command_line(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.json").write_text(json.dumps(ROWS))
    assert cli.main(["convert", "a.json", "-o", "a.toon"]) == 0
    assert (tmp_path / "a.toon").read_text().startswith("[40]{id,name}:\n")
    assert cli.main(["decode", "a.toon", "-o", "b.json"]) == 0 and json.loads((tmp_path / "b.json").read_text()) == ROWS
    for kind, start in (("onto", "!schema "), ("tron", "class A: ")):
        assert cli.main(["convert", "a.json", "--to", kind, "-o", "x"]) == 0 and (tmp_path / "x").read_text().startswith(start)
    capsys.readouterr()
    assert cli.main(["check", "a.json"]) == 0 and json.loads(capsys.readouterr().out)["converted"]
    assert cli.main(["detect", "a.json"]) == 0 and capsys.readouterr().out == "json\n"
    assert cli.main(["diff", "a.json"]) == 0 and cli.main(["lint", "a.toon"]) == 0
    (tmp_path / "bad").write_text('a: "x')
    assert cli.main(["lint", "bad"]) == 1 and cli.main(["decode", "bad"]) == 1 and cli.main(["convert", "missing"]) == 1
    (tmp_path / "prose").write_text("just words")
    assert cli.main(["convert", "prose", "-o", "same"]) == 0 and (tmp_path / "same").read_text() == "just words"
    with pytest.raises(SystemExit):
        cli.main(["nonsense"])


def test_command_line_reports(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("QUILLET_CONFIG", "")
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.json").write_text(json.dumps(ROWS))
    assert cli.main(["index", "/", "--store", "x"]) == 1
    assert cli.main(["index", str(tmp_path / "root"), "--store", str(tmp_path / "i")]) == 0 and "added" in capsys.readouterr().out
    assert cli.main(["stats", "--store", str(tmp_path / "i")]) == 0 and "a.json" in capsys.readouterr().out


def test_tokens():
    assert [tokens.count_tokens(t) for t in ("", "abcd", "abcde")] == [0, 1, 2]
    assert tokens.token_savings_pct("abcdefgh", "abcd") == 50 and tokens.token_savings_pct("", "x") == 0
    assert tokens.cost_usd(1_000_000, "gpt-4o") == 2.5 and tokens.cost_savings_usd(1, 5) == 0
    assert tokens.family("GPT-4-turbo") == "cl100k" and tokens.family("other") == "heuristic"


def test_command_line_ledger(spark, tmp_path, capsys):
    path, none = str(tmp_path / "ledger"), None
    raw = [(300, "actual", "cli", 90, 30, "b.json"), (100, "actual", "cli", 50, 60, none), (200, "opportunity", "hook:x", 80, 20, 'a,"q"'), (86_400, "actual", "hook:x", 1000, 400, "a.json")]
    ledger.record(ledger.derive(spark.createDataFrame(raw, "ts long, kind string, surface string, input_bytes long, output_bytes long, source_label string")), path)
    for form, lines_an_event in (("json", 1), ("csv", 1), ("otel", 1), ("prometheus", 4)):
        target = tmp_path / form
        assert cli.main(["export", path, "--format", form, "-o", str(target)]) == 0
        assert len(target.read_text().splitlines()) == 4 * lines_an_event
    assert [json.loads(x)["ts"] for x in (tmp_path / "json").read_text().splitlines()] == [100, 200, 300, 86_400]
    assert cli.main(["export", path, "--since", "1"]) == 0 and [json.loads(x)["ts"] for x in capsys.readouterr().out.splitlines()] == [86_400]
    assert cli.main(["top", path, "-n", "1"]) == 0
    out = capsys.readouterr().out
    assert "a.json" in out and "b.json" not in out and "600" in out
    assert cli.main(["recent", path, "-n", "1"]) == 0 and "86400" in capsys.readouterr().out
    assert cli.main(["cost", path]) == 0 and "usd" in capsys.readouterr().out
    assert cli.main(["reset", path]) == 1 and ledger.read(spark, path).count() == 4
    assert cli.main(["reset", path, "--yes"]) == 0 and ledger.read(spark, path).count() == 0


def test_command_line_index(spark, tmp_path, capsys):
    root, store = tmp_path / "root", str(tmp_path / "i")
    root.mkdir()
    (root / "a.json").write_text(json.dumps(ROWS))
    assert cli.main(["index", str(root), "--store", store]) == 0
    assert cli.main(["status", "--store", store]) == 0 and "classified" in capsys.readouterr().out
    assert cli.main(["show", "a.json", "--store", store]) == 0 and "uniform" in capsys.readouterr().out
    assert cli.main(["show", "b.json", "--store", store]) == 1
    assert cli.main(["compact", "--store", store]) == 0 and capsys.readouterr().out == "2\n"
    assert cli.main(["show", "a.json", "--store", store]) == 0
