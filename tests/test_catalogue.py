"""Every query against its SQL, and plans that should hold at scale."""

import pytest
from tests.conftest import SF, rows_of

from quillet.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows_only(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(catalogue.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_only_needed_columns_are_read(spark):
    text = plan(catalogue.queries()["legend_candidates"](spark, SF))
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in text


def test_day_window_prunes_partitions(spark, tmp_path):
    from quillet.operators import ledger

    path = str(tmp_path / "ledger")
    events = catalogue.events_ledger(spark, SF)
    ledger.record(events, path)
    again = ledger.read(spark, path)
    assert again.count() == events.count()
    assert "PartitionFilters: [isnotnull(day" in plan(ledger.daily(ledger.select(again, 19740, 19730)))
    ledger.reset(spark, path)
    assert ledger.read(spark, path).count() == 0


def test_entropy_shuffles_nothing(spark):
    from quillet.operators import tabular

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "Exchange" not in plan(tabular.byte_entropy(docs, "doc_id", "text"))
    made = spark.createDataFrame([(1, "a" * 64), (2, "".join(map(chr, range(128)))), (3, "")], "doc_id int, text string")
    found = {r[0]: r[1] for r in tabular.byte_entropy(made, "doc_id", "text").collect()}
    assert found == {1: 0.0, 2: 0.875}


def test_empty_ledger(spark):
    from quillet.operators import ledger

    none = spark.createDataFrame([], ledger.SCHEMA)
    assert ledger.summary(none).first()[0] == 0
    assert ledger.busiest(none).count() == 0
    assert [r["level"] for r in ledger.heatmap(none, 1, 5).collect()] == [0] * 5
    assert ledger.streak(none, 5).first()[0] == 0


def test_seed_ledger(spark):
    from quillet.operators import ledger

    raw = spark.createDataFrame([(0, "actual", "hook:a", 100, 40, "a.json"), (0, "actual", "cli:convert", 200, 100, "b.json"), (0, "opportunity", "index:scan", 500, 400, "c.json")], "ts long, kind string, surface string, input_bytes long, output_bytes long, source_label string")
    events = ledger.derive(raw)
    assert ledger.summary(ledger.select(events)).first()["saved"] == 160
    assert ledger.summary(ledger.select(events, opportunities=True)).first()["saved"] == 260
    assert ledger.leaderboard(ledger.select(events), "source_label").first()["label"] == "b.json"
    assert {r["level"] for r in ledger.heatmap(events, 0, 0).collect()} == {4}
    million = events.limit(1).selectExpr("*").drop("tokens_saved").selectExpr("*", "cast(1000000 as long) tokens_saved")
    assert tuple(ledger.cost(million).first())[1:] == (2.5, 8.75)


def test_stats_order(spark):
    from quillet.operators import index

    files = spark.createDataFrame([("a.json", "json"), ("b.json", "json"), ("c.toml", "toml")], "path string, doc_type string")
    conv = spark.createDataFrame([("a.json", 1, 1, 50.0, 100), ("b.json", 1, 1, 90.0, 100000), ("c.toml", 1, 1, 99.0, 100)], "path string, json_bytes long, toon_bytes long, savings_pct double, computed_at long")
    assert [r["path"] for r in index.stats(files, conv, "savings", 10, "json").collect()] == ["b.json", "a.json"]
    assert [r["path"] for r in index.stats(files, conv, "recency", 10).collect()] == ["b.json", "c.toml", "a.json"]
