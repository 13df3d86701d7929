"""The untyped value model: canonical text, readers, JSON."""

import math
import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera import values as V

LOOSE = [
    ('{"yes":true,"null":false,"on":null}', '{"null"=f on=∅ yes=t}'),
    ('{"price":-12.5,"count":40,"tiny":0.00002}', "{count=40 price=-12.5 tiny=2e-05}"),
    ('{"big":25e2,"half":5E-1,"whole":7.0e+0}', "{big=2500 half=0.5 whole=7}"),
    ('{"zeta":1,"Zeta":2,"_z":3,"z9":4,"z":5}', "{Zeta=2 _z=3 z=5 z9=4 zeta=1}"),
    ('{"ö":1,"o":2,"日":3,"🚀":4}', '{"ö"=1 "日"=3 "🚀"=4 o=2}'),
    ("[9007199254740990,9007199254740992,-9007199254740991]", "[9007199254740990 9.007199254740992e+15 -9007199254740991]"),
    ('{"v":"first","w":0,"v":"last"}', "{v=last w=0}"),
    ('{"x":[null,{"y":null}],"w":null}', "{w=∅ x=[∅ {y=∅}]}"),
    (r'"line\nfeed\ttab\u0001one\u001f"', r'"line\nfeed\ttab\u0001one\u001F"'),
    ("[0.0003,0.00003,123456.5,1234567.5,5e30,2e-50]", "[0.0003 3e-05 123456.5 1.2345675e+06 5e+30 2e-50]"),
    ("[0.0,-0.0,0,-0]", "[0 0 0 0]"),
    ('["plain",{"k":[]},[],{},7,false]', "[plain {k=[]} [] {} 7 f]"),
    ('"two words"', '"two words"'), ('"nil"', '"nil"'), ('"x_1"', "x_1"), ('"9lives"', '"9lives"'), (r'"quo\"te\\"', r'"quo\"te\\"'),
]


@pytest.mark.parametrize("json, want", LOOSE)
def test_loose(json, want):
    assert V.loose(V.from_json(json), V.NO_TABULAR) == want
    assert V.loose(V.parse(want), V.NO_TABULAR) == want


def test_fingerprint_and_base():
    assert V.fingerprint({"b": 2, "a": 1}).startswith("f35719430d98a2fe")
    assert len(V.patch_base({"a": None})) == 16
    assert V.patch_base({"a": None}) != V.fingerprint({"a": None})[:16]


@pytest.mark.parametrize("x, want", [(1.0, "1.0"), (-0.0, "0.0"), (1e6, "1e+06"), (999999.0, "999999.0"), (1234567.5, "1.2345675e+06"), (1e23, "1e+23"), (5e-324, "5e-324"), (0.00012, "0.00012"), (-1.5e-7, "-1.5e-07"), (math.nan, "NaN"), (math.inf, "Inf")])
def test_float_text(x, want):
    assert V.float_text(x) == want


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_reads_back(x):
    t = V.float_text(x)
    assert float(t) == x and ("." in t or "e" in t)


def test_table():
    v = V.from_json('[{"id":1,"n":"a|b"},{"id":2,"n":null},{"id":3}]')
    t = V.loose(v)
    assert t == '@tab _ rows=3 cols=2 [id n]\n|1|"a\\|b"|\n|2|_|\n|3|_|\n@end'
    assert V.parse(t) == [{"id": 1, "n": "a|b"}, {"id": 2, "n": None}, {"id": 3, "n": None}]
    assert V.loose(v[:2]).startswith("[")
    assert V.loose([{"a": 1}, {}, {"a": 2}]).startswith("[")
    assert V.loose([{"a": 1}, {"b": 1}, {"c": 1}]).startswith("[")
    with pytest.raises(ValueError):
        V.parse("@tab _ rows=2 cols=1 [a]\n|1|\n@end")
    assert V.loose({"x": v}).startswith("{x=@tab") and V.loose(V.parse(V.loose({"x": v}))) == V.loose({"x": v})


def test_references_bytes_times():
    assert V.loose(V.Ref("p", "ana")) == "^p:ana"
    assert V.loose(V.Ref("ns", "a:b")) == '^"ns:a:b"'
    assert V.parse('^"ns:a:b"') == V.Ref("ns", "a:b")
    assert V.loose(b"\xff\xfe") == 'b64"//4="' and V.parse('b64"//4="') == b"\xff\xfe"
    for bad in ('b64"!!!!"', 'b64"AQ"'):
        with pytest.raises(ValueError):
            V.parse(bad)
    assert V.parse_time("2025-01-02T14:00:00+02:00").text == "2025-01-02T12:00:00Z"
    assert V.loose(V.parse("2025-01-02T14:00:00.500Z")) == "2025-01-02T14:00:00.5Z"


def test_structs_and_sums():
    s = V.Struct("Team", {"n": "Arsenal", "l": "EPL"})
    assert V.loose(s) == "{l=EPL n=Arsenal}" and V.typed(s) == "Team{l=EPL n=Arsenal}"
    assert V.loose(V.Sum("Ok", "done")) == "{Ok=done}" and V.typed(V.Sum("Ok", "done")) == "Ok(done)"
    assert V.typed({"a": 1, "b": 2}) == "{a:1 b:2}"
    assert V.parse("Ok()") == V.Sum("Ok") and V.parse("Team{n=Arsenal l=EPL}") == s


def test_modes_and_limits():
    assert V.parse("_") is None and V.parse("_", typed_mode=True) == "_" and V.parse("_internal") == "_internal"
    assert V.parse("trueish") == "trueish"
    with pytest.raises(ValueError):
        V.parse("9223372036854775808")
    with pytest.raises(ValueError):
        V.parse("[" * 200 + "]" * 200)
    with pytest.raises(ValueError):
        V.loose([math.nan])
    assert V.parse_tolerant("{a=1 b=[2")[0] == {"a": 1, "b": [2]}
    assert V.parse_tolerant("{a=}")[1]


def test_compact_keys():
    keys = V.key_dictionary({"action": "search", "query": "test"})
    text = V.loose_with_schema({"action": "search", "query": "test"}, V.LLM.replace(keys=tuple(keys)))
    head, body = text.split("\n")
    assert body == "{#0=search #1=test}" and head.endswith("@keys=[action query]")
    assert V.parse(text) == {"action": "search", "query": "test"}
    assert V.parse(text.replace("@keys", "keys")) == {"action": "search", "query": "test"}
    assert len(V.schema_context_id(keys)) == 8


def test_markers():
    v = V.from_json('{"$kind":"time","value":"2025-01-01T00:00:00Z"}', "$kind")
    assert v == V.Time("2025-01-01T00:00:00Z")
    for x in (v, V.Ref("p", "a"), b"abc", {"a": [V.Ref("", "x")]}):
        assert V.from_json(V.to_json(x, "$kind"), "$kind") == x
    for bad in ('{"$kind":"time"}', '{"$kind":"id","value":"^a","x":1}', '{"$kind":"odd","value":""}'):
        with pytest.raises(ValueError):
            V.from_json(bad, "$kind")
    with pytest.raises(ValueError):
        V.to_json({"$kind": 1}, "$kind")
    assert V.json_equal('{"a":1,"b":[2.0]}', '{"b":[2],"a":1.0}')


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: not x.is_integer()) | st.text(st.characters(exclude_categories=["Cs"])),
    lambda c: st.lists(c, max_size=5) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=6), c, max_size=5), max_leaves=20,
)


@given(JSON)
def test_parse_inverts_emit(v):
    for options in (V.NO_TABULAR, V.LLM.replace(auto_tabular=False)):
        assert V.loose(V.parse(V.loose(v, options)), options) == V.loose(v, options)
    assert V.equal(V.from_json(V.to_json(v)), v)
    assert V.loose(V.parse(V.typed(v), typed_mode=True), V.NO_TABULAR) == V.loose(v, V.NO_TABULAR)


def test_random_doubles():
    rng = random.Random(1)
    for _ in range(5000):
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x):
            assert float(V.float_text(x)) == x
