"""Named queries of the engine over the test tables, and the SQL that checks them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions import detect, sizes
from quillet.operators import convert, index, ledger, tabular
from quillet.plans import oracles
from quillet.sources import envelopes
from quillet.streaming import ingest

SINCE, UNTIL = 19723, 19759


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _use_workers(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver did."""
    import os
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a ledger: an event a row, sizes from value and props."""
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ledger.derive(
        _t(spark, sf_dir, "events").select(
            "event_id", ts.alias("ts"), F.when(F.col("event_type") == "signup", "opportunity").otherwise("actual").alias("kind"), F.col("event_type").alias("surface"),
            F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project_id"), F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("source_label"),
            F.floor(F.col("value") * 100).alias("input_bytes"), (F.octet_length("props") * (F.col("event_id") % 200)).alias("output_bytes"),
        )
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tabular.with_gates(tabular.encode_groups(joined, ["r_name"], ["n_nationkey", "n_name"], ["n_nationkey"])).select("r_name", "n_rows", "json_bytes", "toon_bytes", "savings_pct", "would_convert", "toon_text")


def _encode(kind: str):
    def run(spark, sf_dir):
        return tabular.encode_groups(_t(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"]).select("n_regionkey", f"{kind}_text")

    return run


def encode_customers(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return tabular.with_gates(tabular.encode_groups(rows, ["c_nationkey"], ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"])).select("c_nationkey", "n_rows", "json_bytes", "toon_bytes", "savings_pct", "would_convert")


def entropy(spark, sf_dir):
    return tabular.byte_entropy(_t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\n").alias("text")), "conv_id", "text")


def entropy_margins(spark, sf_dir):
    return entropy(spark, sf_dir).select("conv_id", sizes.entropy_margin(F.col("h8")).alias("margin"))


def legend_candidates(spark, sf_dir):
    return tabular.legend_candidates(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def shapes(spark, sf_dir):
    return tabular.shape_of_groups(_t(spark, sf_dir, "events"), "event_type", F.json_object_keys("props"), F.col("event_id"))


def shape_margins(spark, sf_dir):
    return shapes(spark, sf_dir).select("event_type", sizes.shape_margin(F.col("shape_class"), F.col("uniformity")).alias("margin"))


def _ledger(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: f(events_ledger(spark, sf_dir))


def streak(spark, sf_dir):
    return ledger.streak(events_ledger(spark, sf_dir).filter("surface = 'purchase' and converted = 1"), 19752)


def recent(spark, sf_dir):
    return _t(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type")


def _index_rows(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    conv = docs.select(
        F.col("source").alias("path"), F.col("n_chars").alias("json_bytes"), F.expr("n_chars * (40 + doc_id % 50) div 100").alias("toon_bytes"), (1_000_000 + F.col("doc_id") * 97).alias("computed_at")
    ).withColumn("savings_pct", sizes.savings_pct(F.col("toon_bytes"), F.col("json_bytes")))
    number = F.regexp_extract("path", "[0-9]+", 0).cast("int")
    files = docs.groupBy(F.col("source").alias("path")).agg(F.sum("n_chars").alias("size_bytes"), F.max("doc_id").alias("scanned_at")).withColumn("doc_type", F.when(number % 3 == 0, "toml").when(number % 3 == 1, "json"))
    return files, conv


def _stats(mode, doc_type=None):
    def run(spark, sf_dir):
        files, conv = _index_rows(spark, sf_dir)
        return index.stats(files, conv, mode, None, doc_type).select("path", F.round("savings_pct", 6).alias("savings_pct"), F.round("score", 6).alias("score"), "conversion_count")

    return run


def stats_savings(spark, sf_dir):
    files, conv = _index_rows(spark, sf_dir)
    # Ties are ranked by all columns, so that the first twenty are the same in any engine.
    ranked = index.stats(files, conv, "savings", None)
    return ranked.orderBy(F.desc("score"), "path", "json_bytes", "toon_bytes").limit(20).select("path", "json_bytes", "toon_bytes", F.round("score", 6).alias("score"))


def index_status(spark, sf_dir):
    return index.status(_index_rows(spark, sf_dir)[0])


def _snapshots(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    old = docs.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.md5(text).alias("content_hash"), (F.col("doc_id") % 5).alias("mtime_unix"), F.lit(0).alias("size_bytes"), F.lit(1).alias("scanned_at"))
    edited, touched = F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0
    cur = docs.filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), F.md5(F.when(edited, F.concat(text, F.lit("x"))).otherwise(text)).alias("content_hash"), F.when(edited | touched, 99).otherwise(F.col("doc_id") % 5).alias("mtime_unix"), F.lit(0).alias("size_bytes"), F.lit(1).alias("scanned_at"))
    return old, cur


def sync(spark, sf_dir):
    return index.sync_counts(index.diff(*_snapshots(spark, sf_dir)))


def sync_next(spark, sf_dir):
    return index.next_files(*_snapshots(spark, sf_dir), now=7).select("path", "content_hash", F.col("mtime_unix").cast("long").alias("mtime_unix"), F.col("scanned_at").cast("long").alias("scanned_at"))


def sync_cascade(spark, sf_dir):
    old, cur = _snapshots(spark, sf_dir)
    return index.cascade(old.select("path", F.length("content_hash").cast("long").alias("n")), cur)


def delimiters(spark, sf_dir):
    ls = detect.text_lines(F.col("text"))
    count = lambda k: F.length(F.get("ls", F.lit(k))) - F.length(F.replace(F.get("ls", F.lit(k)), F.lit(","), F.lit("")))
    return _t(spark, sf_dir, "documents").select("doc_id", ls.alias("ls")).filter(F.size("ls") > 1).select("doc_id", count(0).cast("long").alias("c1"), count(1).cast("long").alias("c2"), detect.delimited(F.col("ls")).alias("kind"))


def html_pages(spark, sf_dir):
    start = F.regexp_replace("html", r"^[ \t\n\f\r]*", "")
    return _t(spark, sf_dir, "pages").select("page_id", start.rlike(detect.P_HTML_DOCTYPE).alias("is_html"), detect.xml_kind(F.col("html")).alias("kind"))


def payloads(spark, sf_dir) -> DataFrame:
    """Payloads of many kinds made from orders: order, kind, text."""
    o = _t(spark, sf_dir, "orders")
    k, s, p = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    made = {
        "json": F.concat(F.lit('{"k":'), k, F.lit(',"s":"'), s, F.lit('"}')),
        "json_array": F.concat(F.lit("["), k, F.lit(",[1],null]")),
        "ndjson": F.concat(F.lit('{"k":'), k, F.lit('}\n\n{"k":2}\n')),
        "json5": F.concat(F.lit("{k: "), k, F.lit(", 's': '"), s, F.lit("',}")),
        "json5_comment": F.concat(F.lit("// note\n{\"k\":"), k, F.lit("}")),
        "toml": F.concat(F.lit("[order]\nk = "), k, F.lit('\ns = "'), s, F.lit('"')),
        "toml_plain": F.concat(F.lit("# c\nk = "), k),
        "scalar_array": F.concat(F.lit("["), k, F.lit("]")),
        "yaml": F.concat(F.lit("k: "), k, F.lit("\ns: "), s),
        "yaml_doc": F.concat(F.lit("---\n- "), k),
        "csv": F.concat(F.lit("k,s\n"), k, F.lit(","), s),
        "tsv": F.concat(F.lit("k\ts,t\n"), k, F.lit("\t"), p),
        "xml": F.concat(F.lit("<order k='"), k, F.lit("'/>")),
        "html": F.concat(F.lit("<div>"), k, F.lit("</div>")),
        "doctype": F.concat(F.lit("  <!DOCTYPE html><p>"), k),
        "prose": F.concat(F.lit("order "), k, F.lit(" is "), s),
        "blank": F.lit(" \n\t"),
    }
    rows = F.explode(F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*made.values())))
    return o.select("o_orderkey", rows.alias("made", "text"))


def detect_payloads(spark, sf_dir):
    return payloads(spark, sf_dir).select("o_orderkey", "made", detect.detect_text(F.col("text")).alias("kind"))


def path_hints(spark, sf_dir):
    paths = F.explode(F.array(*[F.lit(f"a/b.{e}") for e in ("json", "jsonl", "yml", "msg", "txt", "cbor", "tsv")], F.lit("noext"))).alias("path")
    return spark.range(1).select(paths).select("path", detect.hint_of_path(F.col("path")).alias("hint"), sizes.source_label(F.col("path")).alias("label"))


def tokens(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(sizes.tokens_up(F.col("text"))).alias("tokens_ceil"), sizes.tokens_down(F.sum(F.octet_length("text").cast("long"))).alias("tokens_floor"))


def protected(spark, sf_dir):
    keys = F.explode(F.array(*map(F.lit, ("o_orderkey", "width", "name", "API_Token", "paid", "städte")))).alias("k")
    return spark.range(1).select(keys).select("k", sizes.protected(F.col("k")).alias("protected"))


def protected_keys(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus")).alias("j"))
    return o.select("o_orderkey", F.array_join(sizes.protected_keys(F.col("j")), ",").alias("keys"))


def models(spark, sf_dir):
    names = F.explode(F.array(*map(F.lit, ("GPT-4o-mini", "gpt-4", "gpt-3.5-turbo", "o3", "davinci-002", "other", "cl100k_base", "auto", "gpt-5")))).alias("name")
    x = spark.range(1).select(names)
    return x.select("name", sizes.model_family(F.col("name")).alias("family"), sizes.profile_family(F.col("name")).alias("profile"), sizes.price(sizes.profile_family(F.col("name")), "cache_read").alias("cache_read"))


def gates(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100 + 1).alias("t"), F.lit(60).alias("j"), (F.col("p_partkey") % 7 - 1).cast("double").alias("m"))
    return p.select("p_partkey", sizes.smaller_enough(F.col("t"), F.col("j"), F.col("m")).alias("ok"), F.round(sizes.savings_pct(F.col("t"), F.col("j")), 6).alias("pct"))


def texts(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 997).alias("n"), (F.col("p_partkey") % 130 - 10).cast("double").alias("r"), F.concat("p_name", F.lit('\\,"\n')).alias("s"))
    return p.select("p_partkey", sizes.rate_text(F.col("r")).alias("rate"), F.when(F.col("n") < 1000, sizes.count_text(F.col("n"))).alias("count"), sizes.label_escape(F.col("s")).alias("label"), sizes.json_escape(F.col("s")).alias("json"), sizes.csv_label(F.col("s")).alias("csv"))


def dates(spark, sf_dir):
    text = F.explode(F.array(*map(F.lit, ("1970-01-01", "2000-01-01", "2026-07-17", "2026-13-01", "2026-00-01", "2026-1-1", "2026-02-30", "not-a-date")))).alias("text")
    x = spark.range(1).select(text)
    return x.select("text", sizes.strict_day(F.col("text")).cast("string").alias("day"))


def json_elements(spark, sf_dir):
    """Elements of JSON arrays, one a row, with their positions."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))).alias("j"))
    each = o.select("o_custkey", F.posexplode(F.from_json("j", "array<struct<o_orderkey:bigint,o_orderstatus:string>>")).alias("pos", "e"))
    return each.select("o_custkey", F.col("pos").cast("long").alias("pos"), "e.o_orderkey", "e.o_orderstatus")


def ndjson(spark, sf_dir):
    line = F.when(F.col("event_id") % 20 == 7, F.concat("props", F.lit("x"))).when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.col("props"))
    e = _t(spark, sf_dir, "events").select((F.col("event_id") % 500).cast("string").alias("stream"), "event_id", line.alias("line"))
    out = tabular.ndjson_records(e, "stream", "event_id", "line")
    return out.select("stream", "records", F.col("bytes").cast("long").alias("bytes"), "all_valid", "json_text")


def tron_stream(spark, sf_dir):
    rec = F.when(F.floor(F.col("event_id") / 40) % 4 == 3, F.concat(F.lit('{"k":'), F.col("event_id").cast("string"), F.lit(',"z":[1]}'))).otherwise(F.concat(F.lit('{"k":'), F.col("event_id").cast("string"), F.lit(',"t":"'), F.col("event_type"), F.lit('"}')))
    e = _t(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("stream"), "event_id", rec.alias("record"))
    return tabular.tron_stream(e, "stream", "event_id", "record", ["k", "t"])


def envelopes_read(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.struct(F.lit(7).alias("x")).alias("tool_output"), F.struct(F.col("text").alias("output")).alias("tool_response"))).alias("e"))
    return c.select("conv_id", "turn", envelopes.tool_output(F.col("e"), "claude").alias("object"), envelopes.tool_output(F.col("e"), "devin").alias("devin"), envelopes.tool_output(F.col("e"), "droid").alias("droid"))


def envelopes_written(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("t"))
    return n.select("n_nationkey", envelopes.answer(F.col("t"), "claude").alias("claude"), envelopes.answer(F.col("t"), "codex").alias("codex"), envelopes.answer(F.col("t"), "droid").alias("droid"))


def roots(spark, sf_dir):
    """Scan counters of several roots, summed."""
    docs = _t(spark, sf_dir, "documents").select(F.lit("documents").alias("root"), F.col("lang").alias("doc_type"))
    pages = _t(spark, sf_dir, "pages").select(F.lit("pages").alias("root"), F.lit(None).cast("string").alias("doc_type"))
    return docs.unionByName(pages).groupBy("root").agg(F.count("*").alias("scanned"), F.count("doc_type").alias("classified"))


# Payload codecs, by Python workers.


def _payload_rows(spark, sf_dir, kind: str) -> DataFrame:
    """One payload a nation's customers, in the given format: nation, payload."""
    _use_workers(spark)
    c = _t(spark, sf_dir, "customer")
    k, n, m = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    obj = F.concat(F.lit('{"k":'), k, F.lit(',"n":"'), n, F.lit('","m":"'), m, F.lit('"}'))
    rows = {
        "json": (obj, "[", ",", "]"),
        "ndjson": (obj, "", "\n", "\n"),
        "csv": (F.concat_ws(",", k, n, m), "k,n,m\n", "\n", "\n"),
        "tsv": (F.concat_ws("\t", k, n, m), "k\tn\tm\n", "\n", "\n"),
        "yaml": (F.concat(F.lit("- k: "), k, F.lit("\n  n: '"), n, F.lit("'\n  m: '"), m, F.lit("'")), "", "\n", "\n"),
        "toml": (F.concat(F.lit("[[c]]\nk = "), k, F.lit('\nn = "'), n, F.lit('"\nm = "'), m, F.lit('"')), "", "\n", "\n"),
        "xml": (F.concat(F.lit('<c k="'), k, F.lit('" n="'), n, F.lit('" m="'), m, F.lit('"/>')), "<cs>", "", "</cs>"),
        "json5": (F.concat(F.lit("{k:"), k, F.lit(",'n':'"), n, F.lit("',m:\""), m, F.lit('",}')), "[", ",", "]"),
    }
    row, head, between, tail = rows[kind]
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("t")))), lambda r: r["t"]), between)
    return c.groupBy("c_nationkey").agg(F.encode(F.concat(F.lit(head), each, F.lit(tail)), "UTF-8").alias("payload"))


def _convert(kind: str, options=convert.Options()):
    def run(spark, sf_dir):
        return convert.convert_payloads(_payload_rows(spark, sf_dir, kind), options).select("c_nationkey", "converted", "reason", "json_bytes", "toon_bytes", F.round("savings_pct", 6).alias("savings_pct"), "doc_type", "shape_class", F.coalesce("sampled_count", F.lit(0)).cast("long").alias("sampled_count"))

    return run


def _convert_binary(kind: str):
    """Customers as MessagePack or CBOR maps {"k": custkey, "m": segment}, written byte by byte."""

    def run(spark, sf_dir):
        _use_workers(spark)
        c = _t(spark, sf_dir, "customer")
        key = F.lpad(F.hex("c_custkey"), 16, "0")
        m = F.hex(F.encode("c_mktsegment", "UTF-8"))
        n = F.lpad(F.hex(F.octet_length("c_mktsegment") + (0xA0 if kind == "msgpack" else 0x60)), 2, "0")
        head = ("82A16BCF", "A16D") if kind == "msgpack" else ("A2616B1B", "616D")
        rows = c.select("c_custkey", F.unhex(F.concat(F.lit(head[0]), key, F.lit(head[1]), n, m)).alias("payload"))
        return rows.select("c_custkey", convert.parse_column(F.col("payload"), F.lit(kind)).alias("json_text"))

    return run


def toon_roundtrip(spark, sf_dir):
    """Documents of tabular text, decoded to JSON again."""
    _use_workers(spark)
    joined = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    e = tabular.encode_groups(joined, ["r_name"], ["n_nationkey", "n_name"], ["n_nationkey"])
    return e.select("r_name", convert.decode_column(F.col("toon_text")).alias("toon"), convert.decode_column(F.col("onto_text")).alias("onto"), convert.decode_column(F.col("tron_text")).alias("tron"))


def lint(spark, sf_dir):
    _use_workers(spark)
    bad = F.explode(F.array(*map(F.lit, ("[]\n", "[2]: 1,2\n", "[2]:\n  - a: 1\n  - b: 2\n", "x\n", "a: 1\n", 'a: "open\n')))).alias("t")
    return spark.range(1).select(bad).select("t", F.array_join(convert.lint_column(F.col("t")), ";").alias("warnings"))


def key_union(spark, sf_dir):
    rec = F.when(F.col("event_id") % 4 == 3, F.lit('{"z":1,"k":2}')).otherwise(F.lit('{"k":1,"t":2}'))
    e = _t(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("stream"), "event_id", rec.alias("record"))
    return tabular.key_union(e.withColumn("stream", F.floor(F.col("stream") / 10)), "stream", "event_id", "record")


def vanished(spark, sf_dir):
    return index.vanished(*_snapshots(spark, sf_dir))


def common_days(spark, sf_dir):
    """Days of one surface on which another was used too."""
    e = events_ledger(spark, sf_dir)
    days = lambda s: e.filter((F.col("surface") == s) & (F.col("converted") == 1)).select("day").distinct()
    return days("purchase").join(days("signup"), "day", "left_semi")


def sorted_keys(spark, sf_dir):
    _use_workers(spark)
    from quillet.functions import register

    register.register(spark)
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.expr("json_sort_keys(to_json(named_struct('z', named_struct('b', o_custkey, 'a', o_orderstatus), 'k', o_orderkey)))").alias("j"))


def table_rows(spark, sf_dir):
    """Table texts exploded to rows by the table function."""
    _use_workers(spark)
    from quillet.functions import register

    register.register(spark)
    tabular.encode_groups(_t(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"]).createOrReplaceTempView("_encoded_nations")
    return spark.sql("SELECT n_regionkey, CAST(t.pos AS BIGINT) AS pos, t.row FROM _encoded_nations, LATERAL toon_rows(toon_text) t")


def legend_roundtrip(spark, sf_dir):
    """Customers' tables, with a legend, decoded again."""
    rows = convert.convert_payloads(_payload_rows(spark, sf_dir, "json"))
    return rows.select("c_nationkey", convert.decode_column(F.col("text")).alias("j"))


def inspect_tokens(spark, sf_dir):
    r = _payload_rows(spark, sf_dir, "json").select("c_nationkey", convert.inspect_column(F.col("payload"), convert.HOOK).alias("r"))
    return r.select("c_nationkey", *[F.get_json_object("r", f"$.{k}").cast("long").alias(k) for k in ("json_tokens", "toon_tokens", "json_bytes")])


def stream_daily(spark, sf_dir):
    """The ledger's daily sums from a stream over the events table; the last state of every day."""
    _use_workers(spark)
    events = spark.readStream.schema(_t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    saved = F.greatest(F.floor(F.col("value") * 100) - F.octet_length("props") * (F.col("event_id") % 200), F.lit(0))
    events = events.filter("event_type <> 'signup'").select(F.col("ts").cast("timestamp").alias("at"), F.floor(saved / 4).alias("tokens_saved"), (saved > 0).cast("int").alias("converted"))
    base = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillet-")).rstrip("/")
    at = f"{base}/stream-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}-{spark.range(1).select(F.uuid()).first()[0]}"
    ingest.run_to_end(ingest.daily(events), lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{at}/out"), f"{at}/state", "update")
    out = spark.read.schema("day long, value long, events long, conversions long, batch long").parquet(f"{at}/out")
    return out.groupBy("day").agg(*[F.max_by(c, "batch").alias(c) for c in ("value", "events", "conversions")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tabular_gates": flagship, "encode_onto": _encode("onto"), "encode_tron": _encode("tron"), "encode_json": _encode("json"), "encode_customers": encode_customers,
        "byte_entropy": entropy, "entropy_margins": entropy_margins, "legend_candidates": legend_candidates, "shape_uniformity": shapes, "shape_margins": shape_margins,
        "size_gates": gates, "ledger_events": _ledger(lambda e: e.select("ts", "day", "kind", "surface", "project_id", "source_label", "input_bytes", "output_bytes", "saved_bytes", "tokens_saved", "converted", "precise")),
        "ledger_daily": _ledger(lambda e: ledger.daily(ledger.select(e, UNTIL, SINCE))), "ledger_heatmap": _ledger(lambda e: ledger.heatmap(e, SINCE, UNTIL)),
        "ledger_sparkline": _ledger(lambda e: ledger.sparkline(ledger.heatmap(e, SINCE, UNTIL)).select("day", "value", "peak")), "ledger_summary": _ledger(lambda e: ledger.summary(ledger.select(e))),
        "ledger_streak": streak, "ledger_busiest": _ledger(lambda e: ledger.busiest(ledger.select(e))), "ledger_surfaces": _ledger(ledger.per_surface),
        "ledger_families": _ledger(lambda e: ledger.families(e.withColumn("surface", F.concat(F.substring("surface", 1, 1), F.lit(":"), F.col("surface"))))),
        "ledger_top_labels": _ledger(lambda e: ledger.leaderboard(ledger.select(e), "source_label")), "ledger_top_projects": _ledger(lambda e: ledger.leaderboard(ledger.select(e), "project_id", 5, "tokens")),
        "ledger_cost": _ledger(lambda e: ledger.cost(ledger.select(e))), "ledger_recent": recent, "ledger_window": _ledger(lambda e: ledger.daily(ledger.select(e, until=19740, surface="click", opportunities=True), "bytes")),
        "export_csv": _ledger(ledger.export_csv), "export_prometheus": _ledger(ledger.export_prometheus), "export_otel": _ledger(ledger.export_otel), "export_json": _ledger(ledger.export_json),
        "stats_recency": _stats("recency"), "stats_count": _stats("count"), "stats_by_type": _stats("count", "json"), "stats_untyped": _stats("count", "bin"), "stats_savings": stats_savings, "index_status": index_status,
        "sync_states": sync, "sync_next": sync_next, "sync_cascade": sync_cascade, "scan_roots": roots, "sniff_delimiters": delimiters, "sniff_html": html_pages, "detect_payloads": detect_payloads, "path_hints": path_hints,
        "token_estimates": tokens, "protected_names": protected, "protected_keys": protected_keys, "model_families": models, "text_functions": texts, "strict_dates": dates, "json_elements": json_elements, "ndjson_records": ndjson,
        "tron_stream": tron_stream, "envelopes_read": envelopes_read, "envelopes_written": envelopes_written, "toon_roundtrip": toon_roundtrip, "lint_warnings": lint, "stream_daily": stream_daily,
        "key_union": key_union, "vanished_files": vanished, "common_days": common_days, "sorted_keys": sorted_keys, "table_rows": table_rows, "legend_roundtrip": legend_roundtrip, "inspect_tokens": inspect_tokens,
        "parse_msgpack": _convert_binary("msgpack"), "parse_cbor": _convert_binary("cbor"),
        **{f"convert_{k}": _convert(k, convert.Options(dict_enabled=False)) for k in ("json", "ndjson", "csv", "tsv", "yaml", "toml", "xml", "json5")},
        "convert_legend": _convert("json"), "convert_onto": _convert("json", convert.Options(target="onto")), "convert_tron": _convert("json", convert.Options(target="tron")), "convert_cli": _convert("json", convert.CLI), "convert_hook": _convert("json", convert.HOOK),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
