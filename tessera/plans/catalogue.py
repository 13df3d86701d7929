"""Queries for what ``queries`` leaves out: markers, options, files, schemas, versions, cursors, the SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values
from ..functions import canon, text
from ..functions import sql as surface
from ..operators import abbreviate, dictionary, evolve, frames, patch, tables, validate
from ..sources import bridge, files, formats
from . import schema as schemas
from .queries import _PACKED, LINE_SCHEMA, SUPPLIER_VERSIONS, _str, _time, query, table, typed_tables

MARKER = "$kind"


# --- JSON


@query(f"""SELECT event_id, '{{"t"=' || {_time('ts')} || ' b=b64"' || base64(event_type::BLOB) || '" u=^u:' || user_id || '}}' AS canon,
'{{"b":{{"$kind":"bytes","base64":"' || base64(event_type::BLOB) || '"}},"t":{{"$kind":"time","value":"' || {_time('ts')} || '"}},"u":{{"$kind":"id","value":"^u:' || user_id || '"}}}}' AS back FROM events""")
def marker_round_trip(spark, sf_dir):
    """Times, references and bytes as marked objects of JSON, read and written."""
    d = table(spark, sf_dir, "events")
    marked = lambda kind, key, value: F.struct(F.lit(kind).alias(MARKER), value.alias(key))
    json = F.to_json(F.struct(
        marked("time", "value", canon.time_text(F.col("ts"))).alias("t"), marked("id", "value", F.concat(F.lit("^u:"), F.col("user_id").cast("string"))).alias("u"),
        marked("bytes", "base64", F.base64(F.col("event_type").cast("binary"))).alias("b"),
    ))
    c = text.from_json_text(json, marker=MARKER)
    return d.select("event_id", c.alias("canon"), text.to_json_text(c, marker=MARKER).alias("back"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '{\"kind\":' || event_id || '}' ELSE NULL END AS json, event_id % 3 = 2 AS refused_in FROM events")
def reserved_keys(spark, sf_dir):
    """A plain object that holds the marker's key is refused on the way out, and an unknown or misshapen marker on the way in."""
    d = table(spark, sf_dir, "events")
    k, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    out = F.when(k == 0, F.concat(F.lit('{"$kind"='), n, F.lit("}"))).when(k == 1, F.concat(F.lit("{kind="), n, F.lit("}")))
    into = F.when(k == 2, F.concat(F.lit('{"$kind":"odd","value":"'), n, F.lit('"}'))).otherwise(F.concat(F.lit('{"kind":'), n, F.lit("}")))
    return d.select("event_id", text.to_json_text(out, marker=MARKER).alias("json"), text.from_json_text(into, marker=MARKER).isNull().alias("refused_in"))


@query("SELECT event_id, event_id % 3 <> 0 AS same, event_id % 3 <> 0 AS same_text FROM events")
def json_equality(spark, sf_dir):
    """Equal but for the order of keys and the spelling of numbers."""
    d = table(spark, sf_dir, "events")
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    a = F.concat(F.lit('{"a":'), n, F.lit(',"b":[1.0,"x"]}'))
    b = F.concat(F.lit('{"b":[1,"x"],"a":'), n, F.when(k == 0, ".5").when(k == 1, ".0").otherwise("e0"), F.lit("}"))
    same = text.json_equal(a, b)
    return d.select("event_id", same.alias("same"), text.equal_text(text.from_json_text(a), text.from_json_text(b)).alias("same_text"))


_PART = schemas.parse_schema("@schema{ Part @pack struct{ name: str @fid(1) @k(n)  size: int @fid(2) @k(s)  box?: Box @fid(3) @k(b) } Box:v2 struct{ label: str @fid(1) @k(l) } }")


@query(f"""SELECT p_partkey, 'Part{{box=Box{{label=' || {_str('p_brand')} || '}} name=' || {_str('p_name')} || ' size=' || p_size || '}}' AS typed,
'{{"$type":"Part","b":{{"$type":"Box","l":"' || p_brand || '"}},"n":"' || p_name || '","s":' || p_size || '}}' AS wire FROM part""")
def hinted_json(spark, sf_dir):
    """JSON with wire keys and no markers, read by a schema, and written with wire keys."""
    d = table(spark, sf_dir, "part")
    json = F.to_json(F.struct(F.col("p_name").alias("n"), F.col("p_size").alias("s"), F.struct(F.col("p_brand").alias("l")).alias("b")))
    typed = bridge.typed_json_text(json, _PART, "Part")
    return d.select("p_partkey", typed.alias("typed"), bridge.text_typed_json(typed, _PART, wire=True).alias("wire"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")
def variant_round_trip(spark, sf_dir):
    """Binary values: documents as Variant, stored in Parquet and read back."""
    path = files.scratch(spark, "variant")
    table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v")).write.parquet(path)
    d = spark.read.parquet(path)
    return d.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"), F.to_json("v").alias("json"))


# --- text and options


@query("""SELECT r_regionkey, '{a=_ l=@tab _ rows=3 cols=1 [x]' || chr(10) || '|1|' || chr(10) || '|_|' || chr(10) || '|' || r_regionkey || '|' || chr(10) || '@end}' AS llm,
'{a=∅ l=@tab _ rows=3 cols=1 [x]' || chr(10) || '|1|' || chr(10) || '|∅|' || chr(10) || '|' || r_regionkey || '|' || chr(10) || '@end}' AS pretty, '{a=∅ l=[{x=1} {x=∅} {x=' || r_regionkey || '}]}' AS no_tabular FROM region""")
def option_presets(spark, sf_dir):
    d = table(spark, sf_dir, "region")
    t = F.concat(F.lit("{l=[{x=1} {x=_} {x="), F.col("r_regionkey").cast("string"), F.lit("}] a=_}"))
    return d.select("r_regionkey", *(text.canon_text(t, o).alias(n) for n, o in (("llm", values.LLM), ("pretty", values.PRETTY), ("no_tabular", values.NO_TABULAR))))


@query("SELECT event_id, '{kind=' || event_type || ' n=' || event_id || '}' AS canon, event_id % 2 = 0 AS has_keys, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id % 7 END AS id FROM events")
def directive_documents(spark, sf_dir):
    """Documents whose first line defines the keys of the rest, and documents without."""
    d = table(spark, sf_dir, "events")
    n, even = F.col("event_id").cast("string"), F.col("event_id") % 2 == 0
    line = F.when(even, F.concat(F.lit("@schema#e"), (F.col("event_id") % 7).cast("string"), F.lit(" @keys=[n kind]")))
    body = F.when(even, F.concat(F.lit("{#0="), n, F.lit(" #1="), "event_type", F.lit("}"))).otherwise(F.concat(F.lit("{n="), n, F.lit(" kind="), "event_type", F.lit("}")))
    whole = F.concat_ws("\n", line, body)
    head = text.schema_directive(F.substring_index(whole, "\n", 1))
    return d.select("event_id", text.canon_text(whole).alias("canon"), F.coalesce(F.size(head["keys"]) == 2, F.lit(False)).alias("has_keys"), head["id"].alias("id"))


@query("""SELECT event_id, '{a=' || event_id || ' b=[1 2]}' AS loose, '{"a":' || event_id || ',"b":[1,2]}' AS json, CASE event_id % 3 WHEN 0 THEN 0 ELSE 1 END AS n_warnings, 0 AS n_errors FROM events WHERE event_id % 3 < 2
UNION ALL SELECT event_id, NULL, NULL, 0, 1 FROM events WHERE event_id % 3 = 2""")
def tolerant_parse(spark, sf_dir):
    """Typed text with an unclosed bracket is read with a warning; one without a value is an error."""
    d = table(spark, sf_dir, "events")
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    t = F.concat(F.lit("{a="), F.when(k == 2, "").otherwise(n), F.when(k == 0, " b=[1 2]}").when(k == 1, " b=[1 2] ").otherwise("}"))
    r = text.parse_typed(t)
    return d.select("event_id", text.from_json_text(r["json"]).alias("loose"), r["json"].alias("json"), F.size(r["warnings"]).alias("n_warnings"), F.size(r["errors"]).alias("n_errors"))


def _forms():
    k, n = F.col("event_id") % 8, F.col("event_id").cast("string")
    return (
        F.when(k == 0, F.concat(F.lit("{k="), n, F.lit("}"))).when(k == 1, F.concat(F.lit("["), n, F.lit("]"))).when(k == 2, F.concat(F.lit("T{k="), n, F.lit("}"))).when(k == 3, F.concat(F.lit("T@("), n, F.lit(")")))
        .when(k == 4, F.concat(F.lit("Ok("), n, F.lit(")"))).when(k == 5, F.concat(F.lit("@tab _ [k]\n|"), n, F.lit("|\n@end"))).when(k == 6, F.concat(F.lit("@patch @target="), n, F.lit("\n@end"))).otherwise(n)
    )


@query("SELECT event_id, ['map', 'list', 'struct', 'packed', 'sum', 'tabular', 'patch', 'scalar'][event_id % 8 + 1] AS mode FROM events")
def text_modes(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    return d.select("event_id", text.mode_of(_forms()).alias("mode"))


@query(f"""SELECT c_custkey, '{{' || {_str('c_name')} || '=' || c_custkey || ' n=' || c_nationkey || '}}' AS map, '{{num=' || c_custkey || '}}' AS num, '{{word=' || {_str('c_mktsegment')} || '}}' AS word FROM customer""")
def map_and_sum_text(spark, sf_dir):
    """Maps with keys from the data, and sums of two variants."""
    d = table(spark, sf_dir, "customer")
    m = F.create_map(F.col("c_name"), F.col("c_custkey"), F.lit("n"), F.col("c_nationkey").cast("long"))
    t = T.StructType([T.StructField("tag", T.StringType()), T.StructField("v_num", T.LongType(), True, {"kind": "sum"}), T.StructField("v_word", T.StringType(), True, {"kind": "sum"})])
    sum_of = lambda tag: F.struct(F.lit(tag).alias("tag"), F.col("c_custkey").alias("v_num"), F.col("c_mktsegment").alias("v_word"))
    return d.select("c_custkey", canon.loose_text(m, T.MapType(T.StringType(), T.LongType())).alias("map"), *(canon.loose_text(sum_of(x), t).alias(x) for x in ("num", "word")))


@query("SELECT event_id, '@schema#own @keys=[k]' || chr(10) || '{#0=' || json_extract_string(props, '$.k') || '}' AS whole, '{k=' || json_extract_string(props, '$.k') || '}' AS back FROM events")
def compact_documents(spark, sf_dir):
    """Compact keys with the header that gives them."""
    d = table(spark, sf_dir, "events")
    whole = text.compact_keys(F.col("props"), ["k"])
    own = F.regexp_replace(whole, r"\A@schema#\w+", "@schema#own")
    return d.select("event_id", own.alias("whole"), text.expand_keys(own).alias("back"))


@query("SELECT event_id, '{n=' || event_id || ' u=' || user_id || '}' AS canon FROM events")
def registry_documents(spark, sf_dir):
    """Documents that define, choose and clear key lists of a registry."""
    d = table(spark, sf_dir, "events")
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    t = F.concat(F.lit("@schema#a @keys=[u n]\n@schema#b @keys=[n u]\n"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("@schema#a\n{#0="), u, F.lit(" #1="), n)).otherwise(F.concat(F.lit("{#0="), n, F.lit(" #1="), u)), F.lit("}"))
    return d.select("event_id", text.mapped(lambda s: values.loose(bridge.KeyRegistry().read(s)))(t).alias("canon"))


_ABBREVIATIONS = abbreviate.KeyDict.by_rule(["order_key", "order_status", "total", "customer_key"])


@query(f"""SELECT o_orderkey, '{{ck=' || o_custkey || ' ok=' || o_orderkey || CASE WHEN o_orderstatus = 'O' THEN '' ELSE ' os=' || {_str('o_orderstatus')} END || '}}' AS short,
'{{customer_key=' || o_custkey || ' order_key=' || o_orderkey || CASE WHEN o_orderstatus = 'O' THEN '' ELSE ' order_status=' || {_str('o_orderstatus')} END || '}}' AS long FROM orders""")
def abbreviated_orders(spark, sf_dir):
    """Keys by a dictionary of short forms, with a default left out, and back."""
    d = table(spark, sf_dir, "orders")
    t = F.concat(F.lit("{customer_key="), F.col("o_custkey").cast("string"), F.lit(" order_key="), F.col("o_orderkey").cast("string"), F.lit(" order_status="), canon.string_text(F.col("o_orderstatus")), F.lit("}"))
    short = abbreviate.abbreviate_text(t, _ABBREVIATIONS, {"order_status": "O"})
    return d.select("o_orderkey", short.alias("short"), abbreviate.expand_text(short, _ABBREVIATIONS).alias("long"))


@query(f"""SELECT conv_id, turn, '{{c=' || {_str('text')} || ' ix=' || turn || ' r=' || {_str('role')} || '}}' AS short, '{{content=' || {_str('text')} || ' index=' || turn || ' role=' || {_str('role')} || '}}' AS long FROM conversations""")
def abbreviated_messages(spark, sf_dir):
    """Messages by the dictionary of their domain, and back."""
    d = table(spark, sf_dir, "conversations")
    t = canon.loose_text(F.struct(F.col("text").alias("content"), F.col("turn").alias("index"), F.col("role").alias("role")), T.StructType([T.StructField("content", T.StringType()), T.StructField("index", T.LongType()), T.StructField("role", T.StringType())]))
    short = abbreviate.abbreviate_text(t, abbreviate.ALL_KEYS)
    return d.select("conv_id", "turn", short.alias("short"), abbreviate.expand_text(short, abbreviate.ALL_KEYS).alias("long"))


@query("""SELECT n_nationkey, '@doc v2' || CASE n_nationkey % 3 WHEN 1 THEN ' @mode=tab' WHEN 2 THEN ' @mode=packed @keys=fid' ELSE '' END || ' @target=n' || n_nationkey AS head, 'v2' AS version,
CASE n_nationkey % 3 WHEN 1 THEN 'tabular' WHEN 2 THEN 'packed' ELSE 'auto' END AS mode, CASE n_nationkey % 3 WHEN 2 THEN 'fid' ELSE 'wire' END AS keys, 'n' || n_nationkey AS target FROM nation""")
def document_headers(spark, sf_dir):
    d = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    head = F.when(k == 1, bridge.document_header(mode="tab")).when(k == 2, bridge.document_header(mode="packed", keys="fid")).otherwise(bridge.document_header())
    d = d.select("n_nationkey", F.concat(head, F.lit(" @target=n"), F.col("n_nationkey").cast("string")).alias("head"))
    h = bridge.parse_document_header(F.col("head"))
    return d.select("n_nationkey", "head", *(h[c].alias(c) for c in ("version", "mode", "keys", "target")))


_POWERS = [float(f"1e{k}") for k in range(-20, 20)]


def _float(c: str, source: str, key: str) -> str:
    """A double's text, from the digits that DuckDB prints."""
    return f"""SELECT {key}, CASE WHEN x = 0 THEN '0.0' ELSE CASE WHEN x < 0 THEN '-' ELSE '' END || CASE
WHEN power >= 6 OR power < -4 THEN sig[1] || CASE WHEN length(sig) > 1 THEN '.' || sig[2:] ELSE '' END || CASE WHEN power < 0 THEN 'e-' ELSE 'e+' END || CASE WHEN abs(power) < 10 THEN '0' ELSE '' END || abs(power)
WHEN power < 0 THEN '0.' || repeat('0', -power - 1) || sig WHEN length(sig) <= power + 1 THEN sig || repeat('0', power + 1 - length(sig)) || '.0' ELSE sig[:power + 1] || '.' || sig[power + 2:] END END AS v
FROM (SELECT *, rtrim(ltrim(digits, '0'), '0') AS sig, (ex + length(split_part(m, '.', 1)) - 1 - (length(digits) - length(ltrim(digits, '0'))))::INTEGER AS power
FROM (SELECT *, replace(m, '.', '') AS digits FROM (SELECT {key}, x, split_part(replace(x::VARCHAR, '-', 'n'), 'e', 1) AS raw, replace(ltrim(split_part(x::VARCHAR, 'e', 1), '-'), '-', '') AS m, coalesce(try_cast(nullif(split_part(x::VARCHAR, 'e', 2), '') AS INTEGER), 0) AS ex
FROM (SELECT {key}, {c} AS x FROM {source}))))"""


@query(_float(f"o_totalprice * [{', '.join(f'{x!r}::DOUBLE' for x in _POWERS)}][o_orderkey % 40 + 1]", "orders", "o_orderkey"))
def exact_floats(spark, sf_dir):
    """Doubles from 1e-18 to 1e25, shortest digits that read back."""
    d = table(spark, sf_dir, "orders")
    x = F.col("o_totalprice") * F.element_at(F.array(*map(F.lit, _POWERS)), (F.col("o_orderkey") % 40 + 1).cast("int"))
    return d.select("o_orderkey", canon.float_text(x).alias("v"))


@query(f"SELECT event_id, {_time('ts')} AS t, v FROM events JOIN ({_float('value', 'events', 'event_id')}) USING (event_id)")
def times_and_floats(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    return d.select("event_id", canon.time_text(F.col("ts")).alias("t"), canon.loose_text(F.col("value"), T.DoubleType()).alias("v"))


@query("SELECT event_id, value > 300 AS row_odd, event_id % 5 = 0 OR value > 300 AS list_odd FROM events")
def non_finite(spark, sf_dir):
    """Rows that hold a number without a loose form."""
    d = table(spark, sf_dir, "events")
    odd = F.when(F.col("value") > 300, float("inf")).otherwise(F.col("value"))
    some = F.array(F.lit(1.0), F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(0.5), odd)
    return d.select("event_id", canon.has_non_finite(F.struct(odd.alias("x")), T.StructType([T.StructField("x", T.DoubleType())])).alias("row_odd"), canon.has_non_finite(some, T.ArrayType(T.DoubleType())).alias("list_odd"))


@query("""SELECT p_partkey, printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::HUGEINT)),
lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) AS h FROM part""")
def fnv_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.fnv_hash(F.col("p_name")).alias("h"))


# --- tables and files


@query("""SELECT l_orderkey, count(*)::INTEGER AS rows, 3 AS cols, TRUE AS complete FROM lineitem GROUP BY l_orderkey""")
def table_headers(spark, sf_dir):
    h = tables.table_header(F.col("tab"))
    return _every_table(spark, sf_dir).select("l_orderkey", h["rows"].alias("rows"), h["cols"].alias("cols"), tables.is_complete(F.col("tab")).alias("complete"))


def _every_table(spark, sf_dir):
    cols = ["l_linenumber", "l_quantity", "l_returnflag"]
    return tables.tab_aggregate(table(spark, sf_dir, "lineitem"), ["l_orderkey"], cols, cols, values.DEFAULT.replace(min_rows=1))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def table_round_trip(spark, sf_dir):
    """Tables read back as rows."""
    fields = T.StructType([T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_quantity", T.DoubleType()), T.StructField("l_returnflag", T.StringType())])
    return tables.tab_decode(_every_table(spark, sf_dir), "tab", fields).drop("pos")


@query("SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS pos, c_custkey, c_name, c_acctbal FROM customer")
def typed_table_rows(spark, sf_dir):
    """Inline typed tables read back by their schema."""
    fields = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])
    return tables.tab_decode(typed_tables(spark, sf_dir), "tab", fields, _PACKED)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def table_files(spark, sf_dir):
    """Rows streamed to table files, a file a task, and read back."""
    formats.register(spark)
    path = files.scratch(spark, "tables")
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    d.write.format("tessera_table").mode("append").save(path)
    return spark.read.format("tessera_table").schema(d.schema).load(path)


@query(f"SELECT r_regionkey, 'value' AS kind, '{{\"key\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}}' AS json, '{{key=' || r_regionkey || ' name=' || {_str('r_name')} || '}}' AS canon FROM region")
def value_files(spark, sf_dir):
    """A file for each region's value."""
    path = files.scratch(spark, "values")
    d = table(spark, sf_dir, "region")
    body = F.concat(F.lit("@schema#r @keys=[name key]\n{#1="), F.col("r_regionkey").cast("string"), F.lit(" #0="), canon.string_text(F.col("r_name")), F.lit("}"))
    d.select("r_regionkey", body.alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    v = files.read_values(spark, path)
    return v.select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("int").alias("r_regionkey"), "kind", "json", "canon")


@query("SELECT user_id AS sid, event_id AS seq, 'row' AS kind, strlen(props)::BIGINT AS len, props AS payload, event_type = 'purchase' AS final FROM events")
def frame_files(spark, sf_dir):
    """Events in files of frames, written and read through the data source."""
    formats.register(spark)
    path = files.scratch(spark, "frames")
    d = table(spark, sf_dir, "events")
    d.select(F.col("user_id").alias("sid"), F.col("event_id").alias("seq"), F.lit("row").alias("kind"), F.col("props").cast("binary").alias("payload"), (F.col("event_type") == "purchase").alias("final")).write.format("tessera_frames").mode("append").save(path)
    r = spark.read.format("tessera_frames").load(path).where("error is null")
    return r.select(F.col("sid").cast("long").alias("sid"), F.col("seq").cast("long").alias("seq"), "kind", "len", F.col("payload").cast("string").alias("payload"), "final")


# --- schemas


_TEAM = schemas.parse_schema("@schema{ Order @pack struct{ key: int @fid(1)  customer: Person @fid(2)  total?: float @fid(3) } Person @pack struct{ key: int @fid(1)  name: str @fid(2)  segment?: str @fid(3) } }")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Order@(' ELSE 'Order@{{bm=0b0}}(' END || o_orderkey || ' ' || CASE WHEN c_custkey % 3 = 0 THEN 'Person@{{bm=0b0}}(' ELSE 'Person@(' END || c_custkey || ' ' || {_str('c_name')}
|| CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' || {_str('c_mktsegment')} END || ')' || CASE WHEN o_orderkey % 2 = 0 THEN ' ' || o_totalprice::VARCHAR ELSE '' END || ')' AS packed FROM orders JOIN customer ON c_custkey = o_custkey""")
def nested_packed(spark, sf_dir):
    """A packed struct inside another, both with optional fields."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    person = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    order = F.struct(F.col("o_orderkey").alias("key"), person.alias("customer"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("total"))
    d = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", order.alias("o"))
    return d.select("o_orderkey", canon.packed_text(F.col("o"), d.schema["o"].dataType, _TEAM.types["Order"], _TEAM).alias("packed"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""SELECT n_nationkey, {_literal(_TEAM.text())} AS schema, '@schema#' || substr(sha256({_literal(_TEAM.preimage())}), 1, 32) AS ref, TRUE AS again FROM nation""")
def schema_texts(spark, sf_dir):
    """A schema's text and reference, and the reference of the schema read back from its text."""
    d = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(_TEAM.text()).alias("schema"), F.lit(_TEAM.ref()).alias("ref"))
    return d.withColumn("again", text.mapped(lambda s: schemas.parse_schema(s).ref())(F.col("schema")) == F.col("ref"))


@query("SELECT * FROM (VALUES ('l_orderkey', 7, 'o'), ('l_quantity', 8, 'q'), ('l_discount', 9, ''), ('l_returnflag', 3, 'r')) AS t(field, fid, wire)")
def field_ids(spark, sf_dir):
    """Field numbers: those given stay, others follow the highest; fields are found by name, wire key and number."""
    s = schemas.parse_schema("@schema{ L struct{ l_orderkey: int @fid(7) @k(o)  l_quantity: float @k(q)  l_discount: float  l_returnflag: str @fid(3) @k(r) } }").assign_fids()
    kind = s.types["L"]
    rows = [(kind.field(f"#{f.fid}").name, f.fid, f.wire) for f in kind.fields if kind.field(f.wire or f.name) is f]
    return spark.createDataFrame(rows, "field string, fid int, wire string")


@query("SELECT l_orderkey AS o, l_quantity AS q, l_discount AS d, l_returnflag AS r, TRUE AS back FROM lineitem")
def wire_keys(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    w = validate.to_wire(d, LINE_SCHEMA, "Line")
    return w.withColumn("back", F.lit(validate.from_wire(w, LINE_SCHEMA, "Line").columns == d.columns))


_COUNTS = schemas.parse_schema("@schema{ Line struct{ l_orderkey: int  l_quantity: int  l_discount: int } }")


@query("""SELECT l_orderkey, l_linenumber, 1 + (l_discount = floor(l_discount))::INTEGER AS warnings, (l_discount <> floor(l_discount))::INTEGER AS errors FROM lineitem""")
def coercion_warnings(spark, sf_dir):
    """Whole doubles in fields of whole numbers are warned of; others are errors."""
    d = table(spark, sf_dir, "lineitem")
    found = validate.issues(d.select("l_orderkey", "l_quantity", "l_discount"), _COUNTS, "Line")
    n = lambda level: F.size(F.filter(found, lambda e: e["level"] == level))
    return d.select("l_orderkey", "l_linenumber", n("warning").alias("warnings"), n("error").alias("errors"))


_OPEN = schemas.parse_schema("@schema{ Cust @open struct{ c_custkey: int  c_name: str } }")


@query("SELECT c_custkey, c_name, c_nationkey::VARCHAR AS nation, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM customer")
def open_capture(spark, sf_dir):
    """Columns that an open type does not know, captured in a map."""
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    u = validate.capture_unknown(d, _OPEN, "Cust")
    m = F.col("`@unknown`")
    return u.select("c_custkey", "c_name", m["c_nationkey"].alias("nation"), m["c_mktsegment"].alias("segment"), F.size(m).alias("n"))


_TALK = schemas.parse_schema("""@schema{ Talk struct{ role: str [enum=["user"]] [regex="^u"]  text: str [len>=60] [len<=400]  words: list<str> [nonempty] [unique]  note: str [nonempty] [len=2] } }""")


@query("""WITH w AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 0 THEN [] ELSE string_split(text, ' ') END AS words, left(role, (turn % 3)::INTEGER) AS note FROM conversations)
SELECT code, count(*) AS n FROM (SELECT unnest([CASE WHEN role <> 'user' THEN 'constraint_enum' END, CASE WHEN role NOT LIKE 'u%' THEN 'constraint_regex' END, CASE WHEN strlen(text) < 60 THEN 'constraint_minlen' END,
CASE WHEN strlen(text) > 400 THEN 'constraint_maxlen' END, CASE WHEN len(words) = 0 THEN 'constraint_nonempty' END, CASE WHEN len(list_distinct(words)) < len(words) THEN 'constraint_unique' END,
CASE WHEN note = '' THEN 'constraint_nonempty' END, CASE WHEN strlen(note) <> 2 THEN 'constraint_len' END]) AS code FROM w) WHERE code IS NOT NULL GROUP BY code""")
def constraint_kinds(spark, sf_dir):
    """The constraints that ``validation_issues`` does not use."""
    d = table(spark, sf_dir, "conversations")
    words = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("text", " "))
    d = d.select("role", "text", words.alias("words"), F.substr(F.col("role"), F.lit(1), (F.col("turn") % 3).cast("int")).alias("note"))
    return validate.validate(d, _TALK, "Talk").select(F.explode("issues").alias("i")).groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


# --- dictionaries


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS keys, user_id AS session, 1 AS version, (20 + sum(2 + strlen(event_type)))::BIGINT AS bytes
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def dictionary_blobs(spark, sf_dir):
    """Each user's event types as a dictionary blob with its checksum, and back."""
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    d = d.withColumn("blob", bridge.dictionary_blob(F.col("k"), F.col("user_id")))
    back = bridge.blob_dictionary(F.col("blob"))
    return d.select("user_id", F.array_join(back["keys"], ",").alias("keys"), back["session"].alias("session"), back["version"].alias("version"), F.octet_length("blob").cast("long").alias("bytes"))


@query("""SELECT 'S' || ((n // 256) + 1)::VARCHAR AS pool, (n % 256)::INTEGER AS idx, value FROM (SELECT text AS value, row_number() OVER (ORDER BY min(conv_id * 100000 + turn), text) - 1 AS n FROM conversations WHERE strlen(text) >= 50 GROUP BY text)""")
def interned_texts(spark, sf_dir):
    """Long texts in order of first sight, in pools of 256."""
    d = table(spark, sf_dir, "conversations").withColumn("at", F.col("conv_id") * 100_000 + F.col("turn"))
    return dictionary.intern_first_seen(d, "text", "at")


# --- patches


@query("""SELECT o_orderkey, '@patch @keys=wire @target=' || o_orderkey || chr(10) || '= a ' || o_custkey || chr(10) || '~ n +2.0' || chr(10) || '- old' || chr(10) || '+ tags x' || chr(10) || '+ tags y @idx=0' || chr(10) || '@end' AS built,
'{a=' || o_custkey || ' n=3 tags=[y x]}' AS applied FROM orders""")
def built_patches(spark, sf_dir):
    """Patches put together operation by operation, in order, with an insertion, and applied."""
    def build(n: int) -> str:
        p = patch.Patch(str(n // 10**9)).set("a", n % 10**9).delta("n", 2).delete("old").append("tags", "x").insert_at("tags", 0, "y")
        return patch.emit(p)

    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 10**9 + F.col("o_custkey")).alias("n"))
    d = d.select("o_orderkey", text.mapped(build)(F.col("n")).alias("built"))
    return d.select("o_orderkey", "built", patch.apply_text(F.lit("{old=1 n=1}"), F.col("built"))["value"].alias("applied"))


@query("SELECT o_orderkey, 'Order{customer=Person{key=' || o_custkey || ' name=Z segment=B} key=' || o_orderkey || '}' AS value FROM orders")
def numbered_paths(spark, sf_dir):
    """Patches whose paths are field numbers, resolved down through the types."""
    d = table(spark, sf_dir, "orders")
    doc = F.concat(F.lit("Order{key="), F.col("o_orderkey").cast("string"), F.lit(" customer=Person{key=0 name=A segment=B}}"))
    p = F.concat(F.lit("@patch @keys=fid @target=x\n= #2.#1 "), F.col("o_custkey").cast("string"), F.lit("\n= #2.#2 Z\n@end"))
    return d.select("o_orderkey", patch.apply_text(doc, p, _TEAM, "Order", form="typed")["value"].alias("value"))


@query("SELECT conv_id, turn, '@patch @schema#s1 @keys=name @target=c:' || conv_id || ' @base=0123456789abcdef' || chr(10) || '+ a[\"x y\"] [1 2] @idx=' || turn || chr(10) || '- b[' || turn || '].c' || chr(10) || '~ n +' || turn || '.0' || chr(10) || '@end' AS back FROM conversations")
def patch_round_trip(spark, sf_dir):
    """Patches read and written again."""
    n, c = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    t = F.concat(F.lit("@patch @schema#s1 @keys=name @target=c:"), c, F.lit(" @base=0123456789abcdef\n// a note\n  ~ n  +"), n, F.lit("\n+ a[\"x y\"]  [1, 2] @idx="), n, F.lit("\n- b["), n, F.lit("].c\n@end\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.mapped(lambda s: patch.emit(patch.parse(s)))(t).alias("back"))


# --- versions


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL ELSE s_name END AS title, CASE s_suppkey % 4 WHEN 2 THEN 'gold' WHEN 3 THEN NULL ELSE 'basic' END AS tier,
CASE s_suppkey % 4 WHEN 3 THEN 'no way from version 9.9 to 3.0' END AS problem FROM supplier""")
def versioned_documents(spark, sf_dir):
    """Documents of several versions, read by what their first line names; an unknown version is kept and told."""
    d = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 4
    name = canon.quote_text(F.col("s_name"))
    body = lambda field, more="": F.concat(F.lit("{s_suppkey="), F.col("s_suppkey").cast("string"), F.lit(f" {field}="), name, F.lit(more + "}"))
    t = F.when(k == 0, body("s_name")).when(k == 1, F.concat(F.lit("@version 1.0\n"), body("s_name"))).when(k == 2, F.concat(F.lit("@version 2.0\n"), body("s_name", " tier=gold"))).otherwise(F.concat(F.lit("@version 9.9\n"), body("s_name")))
    return evolve.parse_versions(d.select(t.alias("t")), SUPPLIER_VERSIONS, "t").select("s_suppkey", "title", "tier", "problem")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Missing required field: s_name' END AS problem FROM supplier")
def strict_versions(spark, sf_dir):
    d = table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit(" s_name="), canon.quote_text(F.col("s_name"))))
    t = F.concat(F.lit("@version 1.0\n{s_suppkey="), F.col("s_suppkey").cast("string"), name, F.lit("}"))
    strict = evolve.VersionedSchema(SUPPLIER_VERSIONS.name, "strict", dict(SUPPLIER_VERSIONS.versions), dict(SUPPLIER_VERSIONS.descriptions))
    return evolve.parse_versions(d.select(t.alias("t")), strict, "t").select("s_suppkey", "problem")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '@version 1.0' END AS header, CASE WHEN s_suppkey % 5 = 0 THEN 'Missing required field: s_name' END AS problem, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '1.0' END AS version FROM supplier")
def emitted_versions(spark, sf_dir):
    """Rows that fit a version get its header line."""
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("s_name"), "s_acctbal")
    e = evolve.emit_header(d, SUPPLIER_VERSIONS, "1.0")
    return e.select("s_suppkey", "header", "problem", evolve.parse_version_header(F.col("header")).alias("version"))


@query("""SELECT pos, version, field, available, deprecated FROM (VALUES (0, '1.0'), (1, '2.0'), (2, '3.0')) AS v(pos, version),
LATERAL (SELECT field, CASE field WHEN 's_suppkey' THEN TRUE WHEN 's_acctbal' THEN TRUE WHEN 's_name' THEN pos < 2 WHEN 'title' THEN pos = 2 WHEN 'tier' THEN pos > 0 ELSE pos = 2 END AS available, field = 's_acctbal' AND pos = 2 AS deprecated
FROM (VALUES ('s_suppkey'), ('s_name'), ('s_acctbal'), ('tier'), ('title'), ('note')) AS f(field))""")
def field_availability(spark, sf_dir):
    return evolve.availability(spark, SUPPLIER_VERSIONS)


# --- frames and cursors


def _turns(spark, sf_dir):
    """Turns as frames, with some left out and some sent twice; from 1, so that no stream stands at 0."""
    d = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return d.where("turn % 4 <> 3").unionByName(d.where("turn % 5 = 2"))


_TURNS = "(SELECT conv_id, turn + 1 AS turn FROM conversations WHERE (turn + 1) % 4 <> 3 UNION ALL SELECT conv_id, turn + 1 FROM conversations WHERE (turn + 1) % 5 = 2)"
#: Numbers up to the first gap are accepted, each once: the last accepted one is where the unbroken run from the first ends.
_RUNS = f"""d AS (SELECT DISTINCT conv_id, turn FROM {_TURNS}), b AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM d),
r AS (SELECT conv_id, max(turn) AS top FROM b WHERE g = (SELECT min(g) FROM b x WHERE x.conv_id = b.conv_id) GROUP BY conv_id)"""


@query(f"""WITH {_RUNS}, f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn) AS copy FROM {_TURNS})
SELECT conv_id, turn, CASE WHEN turn > top THEN 'gap' WHEN copy > 1 THEN 'duplicate' ELSE 'ok' END AS status, CASE WHEN turn > top THEN 'SEQ_GAP' WHEN copy > 1 THEN 'SEQ_DUP' END AS code,
CASE WHEN turn > top THEN turn - top - 1 ELSE 0 END AS missing, count(*) AS n FROM f JOIN r USING (conv_id) GROUP BY ALL""")
def cursor_statuses(spark, sf_dir):
    """The strict rule: after a gap nothing is accepted until the missing number comes."""
    c = frames.cursor(_turns(spark, sf_dir), "conv_id", "turn")
    return c.withColumn("code", frames.status_code(F.col("status"))).groupBy("conv_id", "turn", "status", "code", "missing").agg(F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn) AS copy FROM {_TURNS}), l AS (SELECT *, max(turn) OVER (PARTITION BY conv_id ORDER BY turn, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f)
SELECT conv_id, turn, CASE WHEN turn = last THEN 'duplicate' WHEN turn > last + 1 THEN 'gap' ELSE 'ok' END AS status, coalesce(turn <> last, TRUE) AS accepted, count(*) AS n FROM l GROUP BY ALL""")
def lenient_statuses(spark, sf_dir):
    """The lenient rule: a gap is told and the frame taken."""
    c = frames.cursor(_turns(spark, sf_dir), "conv_id", "turn", lenient=True)
    return c.groupBy("conv_id", "turn", "status", "accepted").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN turn = 1 OR turn % 2 = 1 THEN 'ok' WHEN turn = 2 THEN 'ok' ELSE 'base_mismatch' END AS status, 'h' || conv_id AS expected FROM (SELECT conv_id, turn + 1 AS turn FROM conversations) WHERE turn <= 2
UNION ALL SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'base_mismatch' ELSE 'gap' END, 'h' || conv_id FROM (SELECT conv_id, turn + 1 AS turn FROM conversations) WHERE turn > 2""")
def base_statuses(spark, sf_dir):
    """Patches against a stream's state: the second names the right base, the third another, and what follows is a gap."""
    d = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"))
    own = F.concat(F.lit("h"), F.col("conv_id").cast("string"))
    d = d.select("conv_id", "turn", F.when(F.col("turn") == 1, "doc").otherwise("patch").alias("kind"), F.when(F.col("turn") == 2, own).when(F.col("turn") > 2, "other").alias("base"), own.alias("expected"))
    return frames.cursor(d, "conv_id", "turn", kind="kind", base="base", state="expected").select("conv_id", "turn", "status", "expected")


@query(f"""WITH {_RUNS}, m AS (SELECT conv_id, max(turn) AS most FROM d GROUP BY conv_id)
SELECT conv_id, top AS last_seq, coalesce((SELECT max(turn) FROM d WHERE d.conv_id = r.conv_id AND turn <= top AND turn % 2 = 0), 0) AS last_acked, top = most AS final, top < 4 AS needs_resync,
top - coalesce((SELECT max(turn) FROM d WHERE d.conv_id = r.conv_id AND turn <= top AND turn % 2 = 0), 0) AS pending FROM r JOIN m USING (conv_id)""")
def cursor_states(spark, sf_dir):
    """Every stream's state: last and acknowledged number, whether it has ended, needs a resync, and how many numbers wait."""
    d = _turns(spark, sf_dir)
    most = d.groupBy("conv_id").agg(F.max("turn").alias("most"))
    d = d.join(most, "conv_id").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "ack").otherwise("row").alias("kind"), F.when(F.col("turn") >= 4, "h").alias("hash"), (F.col("turn") == F.col("most")).alias("over"))
    c = frames.cursor(d, "conv_id", "turn", kind="kind", state="hash", final="over")
    return frames.cursor_states(c, "conv_id", "turn", kind="kind", state="hash", final="over").drop("state")


@query("""SELECT conv_id, count(*) FILTER (turn % 3 = 0) AS docs, count(*) FILTER (turn % 3 = 1) AS patches, count(*) FILTER (turn % 3 = 2) AS rows FROM conversations GROUP BY conv_id""")
def dispatched_frames(spark, sf_dir):
    """Accepted frames dealt to a handler for each kind."""
    d = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("seq"), F.element_at(F.array(*map(F.lit, ("doc", "patch", "row"))), (F.col("turn") % 3 + 1).cast("int")).alias("kind"))
    c = frames.cursor(d, "conv_id", "seq", kind="kind")
    counted = lambda name: lambda x: x.groupBy("conv_id").agg(F.count("*").alias(name))
    got = frames.dispatch(c, {"doc": counted("docs"), "patch": counted("patches"), "row": counted("rows")}, final="accepted")
    return got["doc"].join(got["patch"], "conv_id", "full").join(got["row"], "conv_id", "full").na.fill(0)


@query(f"""SELECT event_id, 'Progress{{msg=' || {_str('event_type')} || ' pct=0.5}}' AS progress, 'Log{{level=info msg=' || {_str('event_type')} || ' ts=' || {_time('ts')} || '}}' AS log, 'Metric{{name=' || {_str('event_type')} || ' unit=ms value=2.5}}' AS metric,
'Artifact{{mime="text/plain" name=' || {_str('event_type')} || ' ref="blob:1"}}' AS artifact, 'Error{{code=SEQ_GAP msg=' || {_str('event_type')} || ' seq=' || event_id || ' sid=' || user_id || '}}' AS error FROM events""")
def ui_events(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    e = F.col("event_type")
    return d.select(
        "event_id", frames.progress(F.lit(0.5), e).alias("progress"), frames.log("info", e, F.col("ts")).alias("log"), frames.metric(e, F.lit(2.5), F.lit("ms")).alias("metric"),
        frames.artifact(F.lit("text/plain"), F.lit("blob:1"), e).alias("artifact"), frames.error_event(F.lit("SEQ_GAP"), e, F.col("user_id"), F.col("event_id")).alias("error"),
    )


# --- the SQL functions


@query(f"""SELECT event_id, '{{a=' || {_str('event_type')} || ' b=[1 2]}}' AS canon, '{{"a":"' || event_type || '","b":[1,2]}}' AS json, sha256('{{a=' || {_str('event_type')} || ' b=[1 2]}}') AS fp, TRUE AS bare, 'sha256:' || sha256(event_type) AS cid,
'0b101' AS mask, '{{a=' || {_str('event_type')} || ' b=[1 2 9]}}' AS patched, event_id % 2 = 0 AS same FROM events""")
def sql_functions(spark, sf_dir):
    """Scalar functions as SQL knows them."""
    surface.register(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("tessera_events")
    return spark.sql("""
        SELECT event_id, canon_text(t) AS canon, to_json_text(t) AS json, fingerprint(t) AS fp, is_bare_safe(event_type) AS bare, cid(CAST(event_type AS BINARY)) AS cid, mask_text(array(true, false, true)) AS mask,
          patch_apply(t, '@patch @target=x\n+ b 9\n@end') AS patched, equal_loose(t, if(event_id % 2 = 0, concat('{a=', event_type, ' b=[1, 2]}'), '{}')) AS same
        FROM (SELECT event_id, event_type, concat('{b=[1 2], a:', event_type, '}') AS t FROM tessera_events)""")


@query("""SELECT conv_id, turn, e.pos AS pos, e.event AS event, e.path AS path FROM conversations, (VALUES (0, 'START_OBJECT', ''), (1, 'KEY', 'a'), (2, 'VALUE', 'a'), (3, 'END_OBJECT', '')) AS e(pos, event, path)
UNION ALL SELECT conv_id, turn, 10, '=', 'turn' FROM conversations UNION ALL SELECT conv_id, turn, 20, 'row', turn::VARCHAR FROM conversations UNION ALL SELECT conv_id, turn, 30, 'ping', turn::VARCHAR FROM conversations""")
def sql_table_functions(spark, sf_dir):
    """Table functions, joined laterally: parse events, patch operations, table rows, frames."""
    surface.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("tessera_turns")
    return spark.sql("""
        SELECT conv_id, turn, e.pos, e.event, e.path FROM tessera_turns, LATERAL parse_events(concat('{a=', turn, '}')) e
        UNION ALL SELECT conv_id, turn, o.pos + 10, o.op, o.path FROM tessera_turns, LATERAL patch_ops(concat('@patch @target=x\n= turn ', turn, '\n@end')) o
        UNION ALL SELECT conv_id, turn, r.pos + 20, 'row', get_json_object(r.json, '$.n') FROM tessera_turns, LATERAL tab_rows(concat('@tab _ [n]\n|', turn, '|\n@end')) r
        UNION ALL SELECT conv_id, turn, 30, f.kind, CAST(CAST(f.seq AS BIGINT) AS STRING) FROM tessera_turns, LATERAL frames(CAST(concat('@frame{v=1 sid=1 seq=', turn, ' kind=ping len=0}\n\n') AS BINARY)) f""")


@query("""SELECT conv_id, '["role","turn"]' AS keys, '{n=' || sum(turn) || '}' AS folded, '@tab _ rows=' || count(*) || ' cols=1 [turn]' || chr(10) || string_agg('|' || turn || '|' || chr(10), '' ORDER BY '{turn=' || turn || '}') || '@end' AS tab FROM conversations GROUP BY conv_id""")
def sql_grouped_functions(spark, sf_dir):
    """Grouped functions: keys, folded patches and a table for each conversation."""
    surface.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("tessera_turns")
    return spark.sql("""
        SELECT conv_id, key_dict_agg(to_json(named_struct('turn', turn, 'role', role))) AS keys, patch_fold('{n=0}', turn, concat('@patch @target=x\n~ n +', turn, '\n@end')) AS folded,
          tab_agg(to_json(named_struct('turn', turn))) AS tab FROM tessera_turns GROUP BY conv_id""")
