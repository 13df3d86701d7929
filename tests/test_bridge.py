"""Outside forms, decimals and mode selection."""

import pytest
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import canon, decimals
from tessera.plans.schema import parse_schema
from tessera.sources import bridge

SCHEMA = parse_schema("@schema{ Match struct{ id: id @k(m) home: Team @k(H) } Team @pack @tab struct{ name: str @fid(1) @k(n) } }")


def test_typed_json(spark):
    v = V.Struct("Match", {"id": V.Ref("m", "1"), "home": V.Struct("Team", {"name": "x"}), "at": V.Time("2025-01-01T00:00:00Z"), "b": b"ab", "s": V.Sum("Ok", 1), "l": [1, {"k": None}]})
    assert bridge.from_typed_json(bridge.to_typed_json(v)) == v
    assert bridge.from_typed_json(bridge.to_typed_json(v, SCHEMA, wire=True), SCHEMA) == v
    hinted = bridge.from_typed_json('{"m":"^m:1","H":{"n":"x"}}', SCHEMA, "Match")
    assert hinted == V.Struct("Match", {"id": V.Ref("m", "1"), "home": V.Struct("Team", {"name": "x"})})
    assert bridge.from_typed_json('["2025-01-01","^a:b",2.0]') == [V.Time("2025-01-01T00:00:00Z"), V.Ref("a", "b"), 2]
    assert bridge.from_typed_json('["2025-01-01","^a:b"]', dates=False, refs=False) == ["2025-01-01", "^a:b"]
    d = spark.createDataFrame([('{"H":{"n":"x"}}',)], "j string").select(bridge.typed_json_text(F.col("j"), SCHEMA, "Match").alias("t"))
    assert d.select("t", bridge.text_typed_json(F.col("t"), SCHEMA).alias("j")).first() == ("Match{home=Team{name=x}}", '{"$type":"Match","home":{"$type":"Team","name":"x"}}')


def test_dictionary_blob():
    blob = bridge.dump_dictionary(["a", "é", ""], session=7, version=2)
    assert blob[:4] == b"GDCT" and bridge.load_dictionary(blob) == (["a", "é", ""], 7, 2)
    for bad in (b"", b"XXXX" + blob[4:], blob[:-1], blob[:22] + b"b" + blob[23:]):
        with pytest.raises(ValueError):
            bridge.load_dictionary(bad)


def test_dictionary_frames(spark):
    v = {"a": [1, -1, 2**62, -(2**63), 1.5, True, False, None, "x"], "zz": V.Struct("T", {"a": "é"})}
    raw = bridge.encode_frame(v, ["a", "T"], session=300, seq=5)
    assert bridge.decode_frame(raw, ["a", "T"]) == (v, 300, 5)
    with pytest.raises(ValueError):
        bridge.decode_frame(raw, [])
    with pytest.raises(ValueError):
        bridge.decode_frame(raw[:-1], ["a", "T"])
    d = spark.createDataFrame([('{"a":{"b":[1,2]}}',)], "j string").select(bridge.frame_column(F.col("j"), ["a"]).alias("f"))
    assert d.select(bridge.frame_json(F.col("f"), ["a"])).first()[0] == '{"a":{"b":[1,2]}}'


def test_key_registry():
    r = bridge.KeyRegistry(limit=2)
    a, b = r.define(["k"]), r.define(["x", "y"])
    assert r.read(f"@schema#{a}\n{{#0=1}}") == {"k": 1} and r.read("{#0=1}") == {"k": 1}
    r.define(["z"])
    assert r.get(b) is None and r.get(a) == ["k"]
    assert r.read("@schema#q @keys=[p]\n{#0=2}") == {"p": 2}
    with pytest.raises(ValueError):
        r.read("@schema.clear\n{#0=1}")
    with pytest.raises(ValueError):
        r.read("@schema#nope\n{}")


def test_pool_documents(spark):
    long, longer = "a string of twenty bytes", "another, still longer string"
    v = {"x": [long, longer, long, "short", "short"], "y": {"z": longer, "w": long}}
    text = bridge.pool_document(v)
    assert text.startswith(f'@pool.str id=S1 ["{long}" "{longer}"]\n') and bridge.read_pool_document(text) == v
    assert bridge.pool_document({"a": "b"}) == "{a=b}"
    with pytest.raises(ValueError):
        bridge.read_pool_document('@pool.str id=S1 ["a"]\n{x=^S1:4}')
    d = spark.createDataFrame([(V.to_json(v),)], "j string").select(bridge.pool_text(F.col("j")).alias("p"))
    assert d.select(bridge.unpool_text(F.col("p"))).first()[0] == V.loose(v, V.NO_TABULAR)


def test_headers(spark):
    line = bridge.document_header(SCHEMA, "packed", "fid")
    h = spark.range(1).select(*(c.alias(k) for k, c in bridge.parse_document_header(F.lit(line)).items())).first()
    assert (h.version, h.schema_id, h["mode"], h["keys"], h.target) == ("v2", SCHEMA.hash(), "packed", "fid", None)


def test_decimals(spark):
    d = spark.createDataFrame([("99.99m",), ("-5m",), ("5",), ("1e3m",)], "s string")
    got = d.select(decimals.is_decimal_literal(F.col("s")).alias("i"), decimals.decimal_literal(decimals.parse_decimal_literal(F.col("s"))).alias("t")).collect()
    assert [(r.i, r.t) for r in got] == [(True, "99.99m"), (True, "-5m"), (False, None), (False, None)]
    assert d.limit(1).select(decimals.compare(F.lit(1), F.lit(2))).first()[0] == -1


def test_modes(spark):
    d = spark.createDataFrame([([("x",)],), ([("x",), ("y",), ("z",)],)], "r array<struct<name:string>>")
    t = d.schema["r"].dataType
    got = d.select(canon.select_mode(t, SCHEMA.types["Team"], size=F.size("r")).alias("m"), canon.auto_text(F.col("r"), t, SCHEMA.types["Team"], SCHEMA).alias("t")).collect()
    assert [tuple(r) for r in got] == [("struct", "[Team{name=x}]"), ("tabular", "@tab Team [n]\nx\ny\nz\n@end")]
    one = d.select(canon.auto_text(F.col("r")[0], t.elementType, SCHEMA.types["Team"], SCHEMA).alias("t")).first()
    assert one.t == "Team@(x)"
