"""Text codecs, parsers, detection and gates: known answers and seeded properties."""

import json
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillet.functions import legend, onto, toon
from quillet.functions.detect import detect
from quillet.functions.values import PayloadError, dumps, json_bytes, loads, same
from quillet.operators.convert import CLI, HOOK, Options, classify, convert, entropy, lint, protected_keys, round_trip_diff, smaller_enough
from quillet.sources.formats import PARSERS, parse

FOLD = toon.Codec(fold_keys=True, expand_paths=True)
texts = st.text(alphabet='ab: ,"\\-[]{}\n\t1.0é\ue000 tru', max_size=8)
scalars = st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | texts
values = st.recursive(scalars, lambda x: st.lists(x, max_size=4) | st.dictionaries(texts, x, max_size=4), max_leaves=25)


@settings(max_examples=400, deadline=None)
@given(values)
def test_round_trip(value):
    value = loads(dumps(value))
    for codec in (toon.Codec(), FOLD):
        assert same(toon.decode(toon.encode(value, codec), codec), value)


@settings(max_examples=200, deadline=None)
@given(values)
def test_converted_means_smaller_and_equal(value):
    data = dumps(value).encode()
    for o in (Options(), CLI, HOOK, Options(target="onto"), Options(target="tron"), Options(margin_pct=float("nan"))):
        r = convert(data, o)
        if r.converted:
            assert r.toon_bytes < r.json_bytes


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes(data):
    for o in (CLI, Options(margin_pct=-1000), Options(max_input_bytes=10), Options(target="tron")):
        convert(data, o)
    for kind in PARSERS:
        try:
            parse(data, kind)
        except PayloadError:
            pass


def test_deep_nesting():
    assert convert(b"[" * 10_000 + b"]" * 10_000).reason == "ParseFailed"
    assert loads('["' + "[" * 200 + '"]')
    with pytest.raises(PayloadError):
        loads("[" * 101 + "]" * 101)


ROWS = [{"id": i, "name": f"row-{i}", "active": True, "score": i + 0.5} for i in range(30)]


def test_table_text():
    assert toon.encode(ROWS[:2]) == "[2]{id,name,active,score}:\n  0,row-0,true,0.5\n  1,row-1,true,1.5\n"
    assert toon.encode([]) == "[]\n" and toon.encode({}) == ""
    assert len(toon.encode([{"a": 1}, {"a": 2}])) == 16
    assert toon.encode({"user": {"profile": {"name": "Alice"}}, "tags": ["x", "y"]}, FOLD) == "user.profile.name: Alice\ntags[2]: x,y\n"
    assert toon.decode("a: 1\nb: hello\n") == {"a": 1, "b": "hello"}
    assert toon.decode("just prose\n") == "just prose"
    for bad in ('a: "unterminated', "[2]: 1", "[1]{a,b}:\n  1", "a: 1\n    b: 2"):
        with pytest.raises(PayloadError):
            toon.decode(bad)


def test_sizes_of_an_order_list():
    order = {"order_id": "ORD-1", "items": [{"sku": "A", "qty": 1, "price": 11.0}, {"sku": "B", "qty": 2, "price": 11.5}]}
    assert toon.encode([order]) == "[1]:\n  - order_id: ORD-1\n    items[2]{sku,qty,price}:\n      A,1,11.0\n      B,2,11.5\n"


def test_numbers_keep_their_kind():
    for text in ('{"x":1.0}', '{"x":-0.0}', '{"x":1}', '{"x":1e22}'):
        value = loads(text)
        assert same(toon.decode(toon.encode(value)), value)
    assert not same(loads("1"), loads("1.0")) and not same(loads("-0.0"), loads("0.0")) and not same(True, 1)
    assert loads('{"a":1,"a":2}') == {"a": 2}


def test_legend():
    rows = [{"id": i, "role": "administrator", "status": ["active", "inactive"][i % 2]} for i in range(8)]
    plain = toon.encode(rows)
    text = legend.compress(plain)
    assert text and legend.expand(text) == plain and len(text.encode()) < len(plain.encode())
    assert legend.compress(toon.encode([{"role": "administrator"}] * 4), ("role",)) is None
    assert legend.compress(plain + legend.MARK) is None
    with pytest.raises(PayloadError):
        legend.expand(text, 30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": st.sampled_from(["alpha alpha", "beta,beta", 'say "x"', "12345678", "-dash-dash"]), "key": st.sampled_from(["secret value", "other value"])}), min_size=1, max_size=20))
def test_legend_round_trip(rows):
    for value in (rows, {"rows": rows}, {f"k{i}": r["a"] for i, r in enumerate(rows)}):
        plain = toon.encode(value)
        text = legend.compress(plain, ("key",))
        assert text is None or legend.expand(text) == plain


def test_schema_rows_and_calls():
    rows = [{"b": 1, "a": "x|y"}, {"a": None, "b": 2}]
    assert onto.onto_encode(rows) == '!schema "a"|"b"\n"x|y"|1\nnull|2\n'
    assert same(onto.onto_decode(onto.onto_encode(rows)), rows)
    assert onto.tron_encode([{"k": 1, "n": "a)"}]) == 'class A: k, n\n\n[A(1,"a)")]'
    assert onto.tron_encode({"k": 1}) == "class A: k\n\nA(1)"
    assert onto.tron_decode('class A: k\nclass B: x, y\n\n[B(A(1),[A(2)])]') == [{"x": {"k": 1}, "y": [{"k": 2}]}]
    assert onto.tron_decode('{"a":1}') == {"a": 1}
    assert onto.tron_encode_stream([{"a": 1}, {"a": {"b": 2}}, {"a": 3}]) == 'class A: a\n\n[A(1),{"a":{"b":2}},A(3)]'
    assert onto.tron_encode_stream([]) == "[]"
    for bad in (42, [], [{"a": [1]}], [{"a": 1}, {"b": 1}]):
        with pytest.raises(PayloadError):
            onto.onto_encode(bad)


@pytest.mark.parametrize(
    ("data", "kind"),
    [(b"[null]", "json"), (b"[true]", "json"), (b"[-5]", "json"), (b"[3.14]", "json"), (b"[server]\nhost = 1", "toml"), (b"[[a.b]]\nx = 1", "toml"), (b'{\n "a": 1\n}', "json"), (b"{ 'a': 1 }", "json5"), (b"{ a: 1, b: 2 }", "json5"), (b'{ "a": 1, }', "json5"), (b'/* c */ {"a":1}', "json5"), (b'{"a":"http://x"}', "json"), (b"\x80", None), (b"\xa1aa\xf5", "cbor"), (b'{"a":1}\n{"a":2}', "ndjson"), (b"a,b\n1,2", "csv"), (b"a\tb,c\n1\t2", "tsv"), (b"a,b\n1", None), (b"k: v", "yaml"), (b"- x", "yaml"), (b"---\nx", "yaml"), (b"a = 1", "toml"), (b"a = b: c", "yaml"), (b"<r/>", "xml"), (b"<div/>", None), (b"<!DOCTYPE html><x/>", None), (b"<?xml version='1.0'?><html/>", "xml"), (b"plain prose", None), (b"  ", None), (b'{"a": not valid', "json")],
)
def test_detect(data, kind):
    assert detect(data) == kind
    assert detect(data, "csv") == "csv"


def test_detect_column_agrees(spark):
    from pyspark.sql import functions as F

    from quillet.functions.detect import detect_text

    r = random.Random(5)
    made = ["".join(r.choice(["{", "}", "[", "]", '"', "a", ": ", ":", " = ", "\n", ",", "\t", "'", "//", "1", "true", "-", "#", "<r>", "<p", "\\", " "]) for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string")
    found = {x["i"]: x["k"] for x in df.select("i", detect_text(F.col("t")).alias("k")).collect()}
    assert [(t, found[i], detect(t.encode())) for i, t in enumerate(made) if found[i] != detect(t.encode())] == []


def test_parsers():
    assert parse(b"a,b,c\n1,2,3\n4,5\n6,7,8,9", "csv") == [{"a": "1", "b": "2", "c": "3"}, {"a": "4", "b": "5"}, {"a": "6", "b": "7", "c": "8", "field_3": "9"}]
    for kind, data in (("csv", b"a,a,b\n1,2,3"), ("tsv", b"a\ta\n1\t2"), ("ndjson", b'{"a":1}\n{bad}'), ("json", b'{"a":NaN}'), ("xml", b"<a></b>"), ("xml", b"<a/><b/>"), ("xml", b"x<a/>"), ("msgpack", b"\x81\x01\x02"), ("cbor", b"\xa1\x01\x02"), ("json5", b"{a:}"), ("toml", b"a = "), ("yaml", b"a: [")):
        with pytest.raises(PayloadError):
            parse(data, kind)
    assert parse(b'{"a":1}\n\n{"b":2}\n', "ndjson") == [{"a": 1}, {"b": 2}]
    assert parse(b"a: yes\nb: 1\nc: [1.0, null]\nd: 2024-01-01", "yaml") == {"a": "yes", "b": 1, "c": [1.0, None], "d": "2024-01-01"}
    assert parse(b"a = 1\n[b]\nc = [1.5, 'x']", "toml") == {"a": 1, "b": {"c": [1.5, "x"]}}
    assert parse(b"// c\n{a:1,'b':[1,2,],c:.5,d:0xff,e:+1,f:'it\\'s'}", "json5") == {"a": 1, "b": [1, 2], "c": 0.5, "d": 255, "e": 1, "f": "it's"}
    assert parse(b'<d xmlns:x="u" a="1&amp;2"><x:r>t&lt;&foo;</x:r><r/></d>', "xml") == {"d": {"@a": "1&2", "r": ["t<&foo;", {}]}}
    assert parse(b"<d>a<b/>c</d>", "xml") == {"d": [{"#text": "a"}, {"b": {}}, {"#text": "c"}]}
    assert parse(b'<d k="1">a<b/></d>', "xml") == {"d": {"@k": "1", "$mixed": [{"#text": "a"}, {"b": {}}]}}
    assert parse(b'<d k="1">a</d>', "xml") == {"d": {"@k": "1", "$text": "a"}}


def _msgpack(v) -> bytes:
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        return b"\xd3" + struct.pack(">q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        return b"\xdb" + struct.pack(">I", len(v.encode())) + v.encode()
    if isinstance(v, list):
        return b"\xdd" + struct.pack(">I", len(v)) + b"".join(map(_msgpack, v))
    return b"\xdf" + struct.pack(">I", len(v)) + b"".join(_msgpack(k) + _msgpack(x) for k, x in v.items())


def _cbor(v) -> bytes:
    head = lambda major, n: bytes([major << 5 | 27]) + struct.pack(">Q", n)
    if v is None or isinstance(v, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[v]
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, float):
        return b"\xfb" + struct.pack(">d", v)
    if isinstance(v, str):
        return head(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return head(4, len(v)) + b"".join(map(_cbor, v))
    return head(5, len(v)) + b"".join(_cbor(k) + _cbor(x) for k, x in v.items())


@settings(max_examples=200, deadline=None)
@given(values)
def test_binary_formats(value):
    assert same(parse(_msgpack(value), "msgpack"), value)
    assert same(parse(_cbor(value), "cbor"), value)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": st.integers(-99, 99), "b": st.text(alphabet="abc xyz_", max_size=8)}), min_size=1, max_size=12))
def test_formats_agree(rows):
    """One value through several formats gives one decision."""
    import yaml

    json_result = convert(dumps(rows).encode(), Options(format_hint="json"))
    for kind, data in (("ndjson", "\n".join(map(dumps, rows))), ("yaml", yaml.safe_dump(rows, sort_keys=False)), ("json5", dumps(rows))):
        r = convert(data.encode(), Options(format_hint=kind))
        assert (r.converted, r.json_bytes, r.toon_bytes, r.text) == (json_result.converted, json_result.json_bytes, json_result.toon_bytes, json_result.text)


def test_gates():
    data = dumps(ROWS).encode()
    r = convert(data)
    assert r.converted and r.doc_type == "json" and r.shape_class == "uniform" and r.protected_fields == ["id"] and r.json_bytes == json_bytes(ROWS)
    assert convert(data, Options(max_input_bytes=4)).reason == "InputTooLarge"
    assert convert(b"plain prose").reason == "NotStructuredData"
    assert convert(b'{"a": not valid').reason == "ParseFailed"
    assert convert(b'{"a":1}', Options(margin_pct=90)).reason == "NotSmallerEnough"
    assert convert(b"42", Options(target="tron", format_hint="json")).reason == "ParseFailed"
    assert convert(b'{"x":1.0,"y":2.0,"z":3.0}', Options(margin_pct=0)).converted
    assert smaller_enough(97, 100, float("inf")) and smaller_enough(97, 100, -5) and not smaller_enough(98, 100, 2)
    assert entropy(b"a" * 64) == 0 and entropy(bytes(range(256))) > 0.99
    assert protected_keys([{"width": 1}, {"name": 2, "API_Token": 3}]) == ["width", "API_Token"]


def test_shapes():
    assert classify([{"a": 1, "b": 2}] * 3) == ("uniform", 1.0, 3)
    assert classify([{"a": 1}, {"b": 1}, {"c": 1}, {"d": 1}])[0] == "irregular"
    assert classify([])[0] == "irregular" and classify({})[0] == classify(3)[0] == "scalar"
    assert classify([{"a": 1}] * 64 + [{"b": i} for i in range(436)]) == ("uniform", 1.0, 64)
    assert classify([1, 2, 3])[0] == "uniform"


def test_lint_and_diff():
    assert lint("[]\n") == ["empty top-level array"] and lint("x\n") == ["root is a scalar"] and lint("a: 1\n") == []
    assert lint("[1]: 1,2\n")[0].startswith("error")
    assert round_trip_diff(dumps(ROWS).encode()) == []


def test_cache_stable_sorts_keys():
    a, b = ({"b": 1, "a": [{"y": 1, "x": 2}] * 3}, {"a": [{"x": 2, "y": 1}] * 3, "b": 1})
    o = Options(cache_stable=True, margin_pct=0)
    assert convert(json.dumps(a).encode(), o).text == convert(json.dumps(b).encode(), o).text


def test_large_payloads_go_to_tron_record_by_record():
    import json

    from quillet.operators import convert

    rows = [{"id": i, "name": f"row {i}"} for i in range(200)]
    o = convert.Options(target="tron", max_input_bytes=1000)
    payloads = {"json": json.dumps(rows), "ndjson": "\n".join(map(json.dumps, [*rows, {"id": 1, "nested": {"x": 1}}])), "csv": "id,name\n" + "".join(f"{i},row{i} {'x' * 9}\n" for i in range(200)), "tsv": "id\tname\n" + "".join(f"{i}\trow{i}\n" for i in range(200))}
    for kind, text in payloads.items():
        r = convert.convert(text.encode(), convert.replace(o, format_hint=kind))
        assert r.reason in (None, "NotSmallerEnough") and r.doc_type == kind and r.json_bytes == len(text)
        if kind in ("json", "ndjson"):
            assert r.converted and convert.decode_any(r.text) == convert.parse(text.encode(), kind)
    assert convert.convert(payloads["json"].encode()[:-1], convert.replace(o, format_hint="json")).reason == "ParseFailed"
    assert convert.convert(json.dumps({"a": rows}).encode(), o).reason == "ParseFailed"
    assert convert.convert(payloads["json"].encode(), convert.replace(o, target="toon")).reason == "InputTooLarge"
    assert convert.convert(b"- a\n- b\n" * 200, convert.replace(o, format_hint="yaml")).reason == "InputTooLarge"


def test_large_payloads_of_a_table(spark):
    import json

    from quillet.operators import convert

    text = json.dumps([{"id": i, "name": f"row {i}"} for i in range(200)])
    frame = spark.createDataFrame([(bytearray(text.encode()),)], "payload binary")
    for target, reason in (("tron", None), ("toon", "InputTooLarge")):
        r = convert.convert_payloads(frame, convert.Options(target=target, max_input_bytes=1000)).first()
        assert (r["reason"], r["converted"]) == (reason, True if reason is None else None) or reason and r["reason"] == reason


@pytest.mark.parametrize("text", ["[1e400]", "[-1E+999]", "[" + "9" * 400 + "]", "[" + "9" * 400 + ".5]"])
def test_numbers_out_of_range_are_errors(text):
    from quillet.functions.values import PayloadError, loads

    with pytest.raises(PayloadError):
        loads(text)
    assert loads("[1e308, 1e-400, 0.5e+10]") == [1e308, 0.0, 5e9]
