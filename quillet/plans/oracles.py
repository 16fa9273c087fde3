"""DuckDB SQL for the queries of the catalogue, written on its own and not derived from their plans."""

from __future__ import annotations

LEDGER = """WITH ev AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day,
 CASE WHEN event_type = 'signup' THEN 'opportunity' ELSE 'actual' END AS kind, event_type AS surface, 'p' || (user_id % 7) AS project_id,
 CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'u' || user_id END AS source_label,
 CAST(floor(value * 100) AS BIGINT) AS input_bytes, CAST(strlen(props) * (event_id % 200) AS BIGINT) AS output_bytes FROM events),
l AS (SELECT *, greatest(input_bytes - output_bytes, 0) AS saved_bytes, greatest(input_bytes - output_bytes, 0) // 4 AS tokens_saved,
 CASE WHEN input_bytes > output_bytes THEN 1 ELSE 0 END AS converted, 0 AS precise FROM ev)"""

_HEAT = f"""{LEDGER}, d AS (SELECT day, CAST(sum(tokens_saved) AS BIGINT) AS v, count(*) AS e, CAST(sum(converted) AS BIGINT) AS k FROM l WHERE kind = 'actual' AND day BETWEEN 19723 AND 19759 GROUP BY day),
sp AS (SELECT unnest(range(19723, 19760)) AS day),
c AS (SELECT sp.day, coalesce(v, 0) AS value, coalesce(e, 0) AS events, coalesce(k, 0) AS conversions FROM sp LEFT JOIN d ON sp.day = d.day)"""

_LABELS = """'surface="' || surface || '",kind="' || kind || '",project_id="' || project_id || '",source_label="' || coalesce(source_label, '') || '",doc_type=""' """

_DIFF = """WITH old AS (SELECT doc_id, md5(coalesce(text, '')) AS h, doc_id % 5 AS m FROM documents WHERE doc_id % 10 <> 0),
cur AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(coalesce(text, '') || 'x') ELSE md5(coalesce(text, '')) END AS h, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 99 ELSE doc_id % 5 END AS m FROM documents WHERE doc_id % 13 <> 0)"""

_CONV = """WITH conv AS (SELECT source AS path, n_chars AS json_bytes, n_chars * (40 + doc_id % 50) // 100 AS toon_bytes, 1000000 + doc_id * 97 AS computed_at FROM documents),
p AS (SELECT *, CASE WHEN json_bytes = 0 THEN 0 ELSE greatest(0, (1 - toon_bytes / json_bytes) * 100) END AS pct FROM conv)"""

_ENTROPY = """WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS s FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, unnest(regexp_extract_all(hex(encode(s)), '..')) AS h FROM t),
c AS (SELECT conv_id, h, count(*) AS c FROM b GROUP BY ALL), n AS (SELECT conv_id, sum(c) AS n FROM c GROUP BY conv_id),
e AS (SELECT conv_id, round(-sum((c / n) * log2(c / n)) / 8, 6) AS h8 FROM c JOIN n USING (conv_id) GROUP BY conv_id)"""

_SHAPES = """WITH s AS (SELECT event_type, list_sort(json_keys(props)) AS sig, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
g AS (SELECT event_type, sig, count(*) AS c FROM s WHERE rn <= 64 GROUP BY ALL),
u AS (SELECT event_type, max(c) / sum(c) AS uniformity, CAST(sum(c) AS BIGINT) AS sampled FROM g GROUP BY event_type)"""

_TYPES = "ty AS (SELECT DISTINCT source AS path, CASE CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 3 WHEN 0 THEN 'toml' WHEN 1 THEN 'json' END AS doc_type FROM documents)"


def _payload_kinds() -> str:
    kinds = {"json": "json", "json_array": "json", "ndjson": "ndjson", "json5": "json5", "json5_comment": "json5", "toml": "toml", "toml_plain": "toml", "scalar_array": "json", "yaml": "yaml", "yaml_doc": "yaml", "csv": "csv", "tsv": "tsv", "xml": "xml", "html": None, "doctype": None, "prose": None, "blank": None}
    rows = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in kinds.items())
    return f"SELECT o_orderkey, made, kind FROM orders CROSS JOIN (VALUES {rows}) t(made, kind)"


def _binary() -> str:
    return """SELECT c_custkey, '{"k":' || c_custkey || ',"m":"' || c_mktsegment || '"}' AS json_text FROM customer"""


def _conversion(doc_type: str, row: str, head: str, tail: str, table_head: str, table_row: str, margin: float = 2.0, row_end: int = 1, uniform: bool = True, table_tail: str = "''") -> str:
    """Sizes and decisions of one payload a nation: the JSON and the table text have a head, a tail and a part a row."""
    return f"""WITH s AS (SELECT c_nationkey, count(*) AS n, CAST(sum(strlen({row})) + count(*) - 1 + strlen('{head}') + strlen('{tail}') AS BIGINT) AS json_bytes,
CAST(sum(strlen({table_row}) + {row_end}) + strlen({table_head}) + strlen({table_tail}) AS BIGINT) AS toon_bytes FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, toon_bytes < json_bytes * (1 - {margin} / 100) AS converted, CASE WHEN toon_bytes < json_bytes * (1 - {margin} / 100) THEN NULL ELSE 'NotSmallerEnough' END AS reason, json_bytes, toon_bytes,
round(greatest(0, (1 - toon_bytes / json_bytes) * 100), 6) AS savings_pct, '{doc_type}' AS doc_type, '{"uniform" if uniform else "scalar"}' AS shape_class, CAST({"least(n, 64)" if uniform else "0"} AS BIGINT) AS sampled_count FROM s"""


_OBJECT = """'{"k":'||c_custkey||',"n":"'||c_name||'","m":"'||c_mktsegment||'"}'"""
_STRINGS = """'{"k":"'||c_custkey||'","n":"'||c_name||'","m":"'||c_mktsegment||'"}'"""
_ATTRIBUTES = """'{"@k":"'||c_custkey||'","@n":"'||c_name||'","@m":"'||c_mktsegment||'"}'"""
_BARE = "'  '||c_custkey||','||c_name||','||c_mktsegment"
_QUOTED = """'  "'||c_custkey||'",'||c_name||','||c_mktsegment"""
_HEAD = "'['||count(*)||']{k,n,m}:'||chr(10)"
_plain = {k: _conversion(k, _OBJECT, "[", "]", _HEAD, _BARE) for k in ("json", "ndjson", "yaml", "json5")}
_plain |= {k: _conversion(k, _STRINGS, "[", "]", _HEAD, _QUOTED) for k in ("csv", "tsv")}
_plain["toml"] = _conversion("toml", _OBJECT, '{"c":[', "]}", "'c'||" + _HEAD, _BARE, uniform=False)
_plain["xml"] = _conversion("xml", _ATTRIBUTES, '{"cs":{"c":[', "]}}", "'cs.c['||count(*)||']{@k,@n,@m}:'||chr(10)", _QUOTED, uniform=False)

_TABLE = """'['||count(*)||']{n_nationkey,n_name}:'||chr(10)||string_agg('  '||n_nationkey||','||n_name||chr(10), '' ORDER BY n_nationkey)"""
_ARRAY = """'['||string_agg('{"n_nationkey":'||n_nationkey||',"n_name":"'||n_name||'"}', ',' ORDER BY n_nationkey)||']'"""

SQL = {
    "tabular_gates": f"""WITH e AS (SELECT r_name, count(*) AS n_rows, {_TABLE} AS toon_text, {_ARRAY} AS j FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
s AS (SELECT r_name, n_rows, CAST(strlen(j) AS BIGINT) AS json_bytes, CAST(strlen(toon_text) AS BIGINT) AS toon_bytes, toon_text FROM e)
SELECT *, round(greatest(0, (1 - toon_bytes / json_bytes) * 100), 6) AS savings_pct, toon_bytes < json_bytes * 0.98 AS would_convert FROM s""",
    "encode_onto": """SELECT n_regionkey, '!schema "n_name"|"n_nationkey"'||chr(10)||string_agg('"'||n_name||'"|'||n_nationkey||chr(10), '' ORDER BY n_nationkey) AS onto_text FROM nation GROUP BY n_regionkey""",
    "encode_tron": """SELECT n_regionkey, 'class A: n_nationkey, n_name'||chr(10)||chr(10)||'['||string_agg('A('||n_nationkey||',"'||n_name||'")', ',' ORDER BY n_nationkey)||']' AS tron_text FROM nation GROUP BY n_regionkey""",
    "encode_json": f"SELECT n_regionkey, {_ARRAY} AS json_text FROM nation GROUP BY n_regionkey",
    "encode_customers": """WITH s AS (SELECT c_nationkey, count(*) AS n_rows, CAST(sum(strlen('{"c_custkey":'||c_custkey||',"c_name":"'||c_name||'","c_mktsegment":"'||c_mktsegment||'"}')) + count(*) + 1 AS BIGINT) AS json_bytes,
CAST(strlen('['||count(*)||']{c_custkey,c_name,c_mktsegment}:') + 1 + sum(strlen('  '||c_custkey||','||c_name||','||c_mktsegment) + 1) AS BIGINT) AS toon_bytes FROM customer GROUP BY c_nationkey)
SELECT *, round(greatest(0, (1 - toon_bytes / json_bytes) * 100), 6) AS savings_pct, toon_bytes < json_bytes * 0.98 AS would_convert FROM s""",
    "byte_entropy": f"{_ENTROPY} SELECT conv_id, h8 FROM e",
    "entropy_margins": f"{_ENTROPY} SELECT conv_id, CAST(CASE WHEN h8 < 0.35 THEN 0 WHEN h8 < 0.5 THEN 2 WHEN h8 < 0.65 THEN 5 ELSE 10 END AS DOUBLE) AS margin FROM e",
    "legend_candidates": """SELECT tok, count(*) AS cnt, CAST((strlen(tok) - 4) * count(*) - (4 + 1 + strlen(tok) + 1) AS BIGINT) AS net_saving FROM (SELECT unnest([o_orderstatus, o_orderpriority]) AS tok FROM orders) GROUP BY tok
HAVING count(*) >= 2 AND strlen(tok) > 4 AND (strlen(tok) - 4) * count(*) > 4 + 1 + strlen(tok) + 1""",
    "shape_uniformity": f"{_SHAPES} SELECT event_type, uniformity, sampled, CASE WHEN uniformity >= 0.9 THEN 'uniform' ELSE 'irregular' END AS shape_class FROM u",
    "shape_margins": f"{_SHAPES} SELECT event_type, CAST(CASE WHEN uniformity < 0.9 THEN 2 WHEN uniformity >= 0.7 THEN 0 ELSE 2 END AS DOUBLE) AS margin FROM u",
    "size_gates": """SELECT p_partkey, (p_partkey % 100 + 1) < 60 * (1 - greatest(p_partkey % 7 - 1, 0) / 100) AS ok, round(greatest(0, (1 - (p_partkey % 100 + 1) / 60) * 100), 6) AS pct FROM part""",
    "ledger_events": f"{LEDGER} SELECT ts, day, kind, surface, project_id, source_label, input_bytes, output_bytes, saved_bytes, tokens_saved, converted, precise FROM l",
    "ledger_daily": f"{LEDGER} SELECT day, CAST(sum(tokens_saved) AS BIGINT) AS value, count(*) AS events, CAST(sum(converted) AS BIGINT) AS conversions FROM l WHERE kind = 'actual' AND day BETWEEN 19723 AND 19759 GROUP BY day",
    "ledger_heatmap": f"""{_HEAT}, r AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM c WHERE value > 0),
t AS (SELECT max(value) FILTER (rn = (n*20+99)//100) AS t1, max(value) FILTER (rn = (n*40+99)//100) AS t2, max(value) FILTER (rn = (n*60+99)//100) AS t3, max(value) FILTER (rn = (n*80+99)//100) AS t4 FROM r)
SELECT day, value, events, conversions, CASE WHEN value = 0 THEN 0 WHEN value >= t4 THEN 4 WHEN value >= t3 THEN 3 WHEN value >= t2 THEN 2 WHEN value >= t1 THEN 1 ELSE 0 END AS level, (day + 3) % 7 AS weekday FROM c CROSS JOIN t""",
    "ledger_sparkline": f"{_HEAT} SELECT day, value, max(value) OVER () AS peak FROM (SELECT * FROM c ORDER BY day DESC LIMIT 30)",
    "ledger_summary": f"{LEDGER} SELECT count(*) AS total_events, CAST(sum(saved_bytes) AS BIGINT) AS saved, CAST(sum(tokens_saved) AS BIGINT) AS tokens, CAST(sum(converted) AS BIGINT) AS conversions, count(*) - CAST(sum(converted) AS BIGINT) AS passthroughs, round(sum(saved_bytes) / sum(input_bytes) * 100, 6) AS avg_reduction_pct FROM l WHERE kind = 'actual'",
    "ledger_streak": f"""{LEDGER}, p AS (SELECT DISTINCT day FROM l WHERE surface = 'purchase' AND converted = 1 AND day <= 19752), g AS (SELECT day, day + row_number() OVER (ORDER BY day DESC) AS grp FROM p)
SELECT count(*) AS streak FROM g WHERE grp = 19753""",
    "ledger_busiest": f"{LEDGER}, d AS (SELECT day, CAST(sum(tokens_saved) AS BIGINT) AS v FROM l WHERE kind = 'actual' GROUP BY day) SELECT CAST(DATE '1970-01-01' + CAST(day AS INTEGER) AS VARCHAR) AS busiest_day, v FROM d WHERE v > 0 ORDER BY v DESC, day LIMIT 1",
    "ledger_surfaces": f"{LEDGER} SELECT surface, CAST(sum(tokens_saved) AS BIGINT) AS tokens, count(*) AS events, CAST(sum(converted) AS BIGINT) AS conversions FROM l GROUP BY surface",
    "ledger_families": f"{LEDGER} SELECT substr(surface, 1, 1) AS family, CAST(sum(saved_bytes) AS BIGINT) AS saved, CAST(sum(tokens_saved) AS BIGINT) AS tokens, count(*) AS events, CAST(sum(converted) AS BIGINT) AS conversions FROM l GROUP BY 1",
    "ledger_top_labels": f"{LEDGER} SELECT source_label AS label, CAST(sum(saved_bytes) AS BIGINT) AS saved, count(*) AS events FROM l WHERE kind = 'actual' AND source_label IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "ledger_top_projects": f"{LEDGER} SELECT project_id AS label, CAST(sum(tokens_saved) AS BIGINT) AS saved, count(*) AS events FROM l WHERE kind = 'actual' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "ledger_cost": f"{LEDGER} SELECT CAST(sum(tokens_saved) AS BIGINT) AS tokens, round(sum(tokens_saved)/1e6*2.5, 9) AS usd, round(sum(tokens_saved)/1e6*(2.5+10*0.625), 9) AS usd_compounded FROM l WHERE kind = 'actual'",
    "ledger_recent": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "ledger_window": f"{LEDGER} SELECT day, CAST(sum(saved_bytes) AS BIGINT) AS value, count(*) AS events, CAST(sum(converted) AS BIGINT) AS conversions FROM l WHERE surface = 'click' AND day BETWEEN 19376 AND 19740 GROUP BY day",
    "export_csv": f"{LEDGER} SELECT ts||','||day||','||kind||','||surface||','||project_id||','||coalesce(source_label,'')||',,'||input_bytes||','||output_bytes||','||saved_bytes||','||tokens_saved||','||converted||',0' AS line FROM l",
    "export_prometheus": f"{LEDGER}, m AS (SELECT *, unnest(['saved_bytes','tokens_saved','input_bytes','output_bytes']) AS g FROM l) SELECT 'conversion_'||g||'{{'||{_LABELS}||'}} '||CASE g WHEN 'saved_bytes' THEN saved_bytes WHEN 'tokens_saved' THEN tokens_saved WHEN 'input_bytes' THEN input_bytes ELSE output_bytes END||' '||(ts*1000) AS line FROM m",
    "export_otel": f"""{LEDGER} SELECT '{{"resource":{{"service.name":"quillet"}},"scope":{{"name":"ledger"}},"metric":{{"name":"conversion","description":"Conversion event","unit":"1","data":{{"points":[{{"attributes":{{"surface":"'||surface||'","kind":"'||kind||'","project_id":"'||project_id||'","source_label":"'||coalesce(source_label,'')||'","doc_type":"","converted":'||CASE converted WHEN 1 THEN 'true' ELSE 'false' END||',"precise":false}},"time_unix_nano":'||(ts*1000000000)||',"as_double":{{"saved_bytes":'||saved_bytes||',"tokens_saved":'||tokens_saved||',"input_bytes":'||input_bytes||',"output_bytes":'||output_bytes||'}}}}]}}}}}}' AS line FROM l""",
    "export_json": f"""{LEDGER} SELECT '{{"ts":'||ts||',"day":'||day||',"kind":"'||kind||'","surface":"'||surface||'","project_id":"'||project_id||'","source_label":'||coalesce('"'||source_label||'"','null')||',"doc_type":null,"input_bytes":'||input_bytes||',"output_bytes":'||output_bytes||',"saved_bytes":'||saved_bytes||',"tokens_saved":'||tokens_saved||',"converted":'||converted||',"precise":0}}' AS line FROM l""",
    "stats_recency": f"{_CONV}, g AS (SELECT path, avg(pct) AS a, max(computed_at) AS last, count(*) AS n FROM p GROUP BY path) SELECT path, round(a, 6) AS savings_pct, round(a * exp(-((SELECT max(last) FROM g) - last) / 86400.0), 6) AS score, n AS conversion_count FROM g",
    "stats_count": f"{_CONV} SELECT path, round(avg(pct), 6) AS savings_pct, round(avg(pct) * count(*), 6) AS score, count(*) AS conversion_count FROM p GROUP BY path",
    "stats_by_type": f"{_CONV}, {_TYPES} SELECT path, round(avg(pct), 6) AS savings_pct, round(avg(pct) * count(*), 6) AS score, count(*) AS conversion_count FROM p JOIN ty USING (path) WHERE doc_type = 'json' GROUP BY path",
    "stats_untyped": f"{_CONV}, {_TYPES} SELECT path, round(avg(pct), 6) AS savings_pct, round(avg(pct) * count(*), 6) AS score, count(*) AS conversion_count FROM p JOIN ty USING (path) WHERE doc_type IS NULL GROUP BY path",
    "index_status": f"WITH {_TYPES} SELECT count(*) AS files, count(doc_type) AS classified, (SELECT max(doc_id) FROM documents) AS last_scan FROM ty",
    "stats_savings": f"{_CONV} SELECT path, json_bytes, toon_bytes, round(pct, 6) AS score FROM p ORDER BY pct DESC, path, json_bytes, toon_bytes LIMIT 20",
    "sync_states": f"{_DIFF} SELECT CASE WHEN old.doc_id IS NULL THEN 'added' WHEN cur.doc_id IS NULL THEN 'removed' WHEN old.m = cur.m OR old.h = cur.h THEN 'unchanged' ELSE 'updated' END AS state, count(*) AS n FROM old FULL JOIN cur ON old.doc_id = cur.doc_id GROUP BY 1",
    "sync_next": f"{_DIFF} SELECT cur.doc_id AS path, cur.h AS content_hash, CAST(cur.m AS BIGINT) AS mtime_unix, CAST(CASE WHEN old.doc_id IS NOT NULL AND old.m = cur.m THEN 1 ELSE 7 END AS BIGINT) AS scanned_at FROM cur LEFT JOIN old ON old.doc_id = cur.doc_id",
    "sync_cascade": "SELECT doc_id AS path, CAST(32 AS BIGINT) AS n FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 13 <> 0",
    "scan_roots": "SELECT 'documents' AS root, count(*) AS scanned, count(lang) AS classified FROM documents UNION ALL SELECT 'pages', count(*), CAST(0 AS BIGINT) FROM pages",
    "sniff_delimiters": """WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
y AS (SELECT doc_id, length(ls[1]) - length(replace(ls[1], ',', '')) AS c1, length(ls[2]) - length(replace(ls[2], ',', '')) AS c2, length(ls[1]) - length(replace(ls[1], chr(9), '')) AS t1, length(ls[2]) - length(replace(ls[2], chr(9), '')) AS t2 FROM x WHERE len(ls) > 1)
SELECT doc_id, CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, CASE WHEN t1 > 0 AND t1 >= c1 THEN CASE WHEN t2 = t1 THEN 'tsv' END WHEN c1 > 0 AND c1 = c2 THEN 'csv' END AS kind FROM y""",
    "sniff_html": "SELECT page_id, regexp_matches(html, '^\\s*<!doctype\\s*html', 'i') AS is_html, CAST(NULL AS VARCHAR) AS kind FROM pages",
    "detect_payloads": _payload_kinds(),
    "path_hints": "SELECT * FROM (VALUES ('a/b.json','json','b.json'),('a/b.jsonl','ndjson','b.jsonl'),('a/b.yml','yaml','b.yml'),('a/b.msg','msgpack','b.msg'),('a/b.txt',NULL,'b.txt'),('a/b.cbor','cbor','b.cbor'),('a/b.tsv','tsv','b.tsv'),('noext',NULL,'noext')) t(path, hint, label)",
    "token_estimates": "SELECT conv_id, CAST(sum((strlen(text)+3)//4) AS BIGINT) AS tokens_ceil, CAST(sum(strlen(text))//4 AS BIGINT) AS tokens_floor FROM conversations GROUP BY conv_id",
    "protected_names": "SELECT k, regexp_matches(lower(k), 'id|uuid|key|token|secret|password|hash|signature|fingerprint') AS protected FROM (VALUES ('o_orderkey'),('width'),('name'),('API_Token'),('paid'),('städte')) t(k)",
    "protected_keys": "SELECT o_orderkey, 'o_orderkey,o_custkey' AS keys FROM orders",
    "model_families": "SELECT * FROM (VALUES ('GPT-4o-mini','o200k','o200k',0.625),('gpt-4','cl100k','cl100k',1.25),('gpt-3.5-turbo','cl100k','cl100k',1.25),('o3','o200k','o200k',0.625),('davinci-002','cl100k','cl100k',1.25),('other','heuristic','heuristic',0.75),('cl100k_base','cl100k','cl100k',1.25),('auto','heuristic','heuristic',0.75),('gpt-5','o200k','o200k',0.625)) t(name, family, profile, cache_read)",
    "text_functions": """WITH x AS (SELECT p_partkey, p_partkey % 130 - 10 AS r, p_name || '\\,"' || chr(10) AS s, p_partkey * 997 AS n FROM part)
SELECT p_partkey, CASE WHEN r >= 100 THEN '100%' WHEN r <= 0 THEN '0%' ELSE r || '%' END AS rate, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) END AS count,
replace(replace(replace(s, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS label, replace(replace(replace(s, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS json, '"' || replace(s, '"', '""') || '"' AS csv FROM x""",
    "strict_dates": "SELECT * FROM (VALUES ('1970-01-01','0'),('2000-01-01','10957'),('2026-07-17','20651'),('2026-13-01',NULL),('2026-00-01',NULL),('2026-1-1',NULL),('2026-02-30',NULL),('not-a-date',NULL)) t(text, day)",
    "json_elements": "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_orderstatus FROM orders",
    "ndjson_records": """WITH e AS (SELECT CAST(event_id % 500 AS VARCHAR) AS stream, event_id, CASE WHEN event_id % 20 = 7 THEN props || 'x' ELSE props END AS line, event_id % 20 <> 7 AS ok FROM events WHERE event_id % 20 = 7 OR event_id % 3 <> 0)
SELECT stream, count(*) AS records, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, bool_and(ok) AS all_valid, CASE WHEN bool_and(ok) THEN '[' || string_agg(line, ',' ORDER BY event_id) || ']' END AS json_text FROM e GROUP BY stream""",
    "tron_stream": """WITH e AS (SELECT event_id % 40 AS stream, event_id, CASE WHEN event_id // 40 % 4 = 3 THEN '{"k":' || event_id || ',"z":[1]}' ELSE 'A(' || event_id || ',"' || event_type || '")' END AS t FROM events)
SELECT stream, count(*) AS records, 'class A: k, t' || chr(10) || chr(10) || '[' || string_agg(t, ',' ORDER BY event_id) || ']' AS tron_text FROM e GROUP BY stream""",
    "envelopes_read": """SELECT conv_id, turn, '{"x":7}' AS object, text AS devin, text AS droid FROM conversations""",
    "envelopes_written": """SELECT n_nationkey, '{"hookSpecificOutput":{"hookEventName":"PostToolUse","updatedToolOutput":"' || n_name || '"}}' AS claude, '{"continue":false,"decision":"block","reason":"' || n_name || '","hookSpecificOutput":{"hookEventName":"PostToolUse"}}' AS codex, CAST(NULL AS VARCHAR) AS droid FROM nation""",
    "toon_roundtrip": f"WITH e AS (SELECT r_name, {_ARRAY} AS j, '['||string_agg('{{\"n_name\":\"'||n_name||'\",\"n_nationkey\":'||n_nationkey||'}}', ',' ORDER BY n_nationkey)||']' AS o FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) SELECT r_name, j AS toon, o AS onto, j AS tron FROM e",
    "lint_warnings": "SELECT * FROM (VALUES ('[]'||chr(10), 'empty top-level array'), ('[2]: 1,2'||chr(10), 'top-level array contains non-object rows'), ('[2]:'||chr(10)||'  - a: 1'||chr(10)||'  - b: 2'||chr(10), 'top-level array rows have inconsistent key sets'), ('x'||chr(10), 'root is a scalar'), ('a: 1'||chr(10), ''), ('a: \"open'||chr(10), 'error: bad quoted text')) t(t, warnings)",
    "stream_daily": f"{LEDGER} SELECT day, CAST(sum(tokens_saved) AS BIGINT) AS value, count(*) AS events, CAST(sum(converted) AS BIGINT) AS conversions FROM l WHERE kind = 'actual' GROUP BY day",
    **{f"convert_{k}": v for k, v in _plain.items()},
    "convert_hook": _plain["json"],
    "convert_onto": _conversion("json", _OBJECT, "[", "]", "'!schema \"k\"|\"m\"|\"n\"'||chr(10)", "c_custkey||'|\"'||c_mktsegment||'\"|\"'||c_name||'\"'"),
    "convert_tron": _conversion("json", _OBJECT, "[", "]", "'class A: k, n, m'||chr(10)||chr(10)||'['", "'A('||c_custkey||',\"'||c_name||'\",\"'||c_mktsegment||'\")'"),
    "key_union": """WITH r AS (SELECT (event_id % 40) // 10 AS stream, event_id, unnest(CASE WHEN event_id % 4 = 3 THEN ['z', 'k'] ELSE ['k', 't'] END) AS k, unnest([0, 1]) AS i FROM events),
f AS (SELECT stream, k, min(event_id * 2 + i) AS p FROM r GROUP BY ALL) SELECT stream, string_agg(k, ',' ORDER BY p) AS keys FROM f GROUP BY stream""",
    "vanished_files": f"{_DIFF} SELECT doc_id AS path FROM old WHERE doc_id NOT IN (SELECT doc_id FROM cur)",
    "common_days": f"{LEDGER} SELECT DISTINCT day FROM l WHERE surface = 'purchase' AND converted = 1 AND day IN (SELECT day FROM l WHERE surface = 'signup' AND converted = 1)",
    "sorted_keys": """SELECT o_orderkey, '{"k":' || o_orderkey || ',"z":{"a":"' || o_orderstatus || '","b":' || o_custkey || '}}' AS j FROM orders""",
    "table_rows": """SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS row FROM nation""",
    "legend_roundtrip": f"SELECT c_nationkey, '[' || string_agg({_OBJECT}, ',' ORDER BY c_custkey) || ']' AS j FROM customer GROUP BY c_nationkey",
    "inspect_tokens": f"""WITH s AS (SELECT c_nationkey, CAST(sum(strlen({_OBJECT})) + count(*) + 1 AS BIGINT) AS json_bytes, CAST(sum(strlen({_BARE}) + 1) + strlen({_HEAD}) AS BIGINT) AS t FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, CAST((json_bytes + 3) // 4 AS BIGINT) AS json_tokens, CAST((t + 3) // 4 AS BIGINT) AS toon_tokens, json_bytes FROM s""",
    "parse_msgpack": _binary(),
    "parse_cbor": _binary(),
}
