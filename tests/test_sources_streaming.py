"""Files, data sources and streams."""

import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import types as T

from tessera import cli
from tessera.operators import frames
from tessera.operators.events import events_of
from tessera.sources import files, formats
from tessera.streaming import stateful


def test_readers(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.txt").write_text("@schema#x @keys=[k]\n{#0=[1 2]}\n")
    (tmp_path / "v/p.txt").write_text("@patch @target=x\n= a 1\n@end\n")
    got = {r.kind: r.canon for r in files.read_values(spark, str(tmp_path / "v")).collect()}
    assert got == {"value": "{k=[1 2]}", "patch": None}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("@tab _ rows=2 cols=2 [id n]\n|1|x|\n|2|_|\n@end\n")
    fields = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.StringType())])
    assert [(r.pos, r.id, r.n) for r in files.read_tables(spark, str(tmp_path / "t"), fields).orderBy("pos").collect()] == [(0, 1, "x"), (1, 2, None)]


def test_table_source(spark, tmp_path):
    formats.register(spark)
    rows = [(1, "a|b", 1.5, [1, 2], datetime(2025, 1, 2, 3, 4, 5)), (2, None, 1e9, [], None)]
    d = spark.createDataFrame(rows, "id long, s string, x double, l array<long>, t timestamp").coalesce(1)
    path = str(tmp_path / "t")
    for _ in range(2):
        d.write.format("tessera_table").mode("overwrite").save(path)
    back = spark.read.format("tessera_table").schema(d.schema).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    d.write.format("tessera_table").mode("append").save(path)
    assert spark.read.format("tessera_table").schema(d.schema).load(path).count() == 4


def test_value_and_frame_sources(spark, tmp_path):
    formats.register(spark)
    spark.createDataFrame([("{a=1}",)], "canon string").coalesce(1).write.format("tessera_value").mode("append").save(str(tmp_path / "v"))
    assert spark.read.format("tessera_value").load(str(tmp_path / "v")).first().json == '{"a":1}'
    f = spark.createDataFrame([(7, n, "row", bytearray(b"x" * n), n == 3) for n in range(4)], "sid long, seq long, kind string, payload binary, final boolean").coalesce(1)
    f.write.format("tessera_frames").mode("append").save(str(tmp_path / "f"))
    got = spark.read.format("tessera_frames").load(str(tmp_path / "f")).orderBy("seq").collect()
    assert [(int(r.seq), r.len, r.final, r.error) for r in got] == [(n, n, n == 3, None) for n in range(4)]
    assert files.read_frames(spark, str(tmp_path / "f")).where("error is null").count() == 4
    q = spark.readStream.format("tessera_frames").load(str(tmp_path / "f")).writeStream.format("memory").queryName("src").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select * from src").count() == 4


def _run(spark, tmp_path, batches, schema, make, name):
    """Batches as files of a stream, one a micro-batch."""
    src = tmp_path / name
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
        if n == 0:
            df = spark.readStream.schema(schema).json(str(src))
            q = make(df).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}")


def test_cursor_stream(spark, tmp_path):
    batches = [[(1, 2, "row", False), (1, 1, "doc", False), (2, 1, "doc", False)], [(1, 2, "row", False), (1, 5, "row", False)], [(1, 6, "row", True), (2, 2, "row", False)], [(1, 1, "doc", False)]]
    got = _run(spark, tmp_path, batches, "sid long, seq long, kind string, final boolean", stateful.cursor_stream, "cur").collect()
    first = [(1, 1, "ok", 0), (1, 2, "ok", 0), (2, 1, "ok", 0), (1, 2, "duplicate", 0), (1, 5, "gap", 2), (2, 2, "ok", 0)]
    assert sorted((r.sid, r.seq, r.status, r.missing) for r in got) == sorted([*first, (1, 6, "gap", 3), (1, 1, "stale", 0)])
    got = _run(spark, tmp_path, batches, "sid long, seq long, kind string, final boolean", lambda d: stateful.cursor_stream(d, lenient=True), "lax").collect()
    assert sorted((r.sid, r.seq, r.status, r.missing, r.accepted) for r in got) == sorted([(*x, x[2] != "duplicate") for x in [*first, (1, 6, "ok", 0), (1, 1, "ok", 0)]])


def test_cursor_stream_checks_bases(spark, tmp_path):
    batches = [[(1, 1, "doc", None, "a", False), (1, 2, "patch", "a", "b", False)], [(1, 3, "patch", "a", "c", False)], [(1, 3, "patch", "b", "c", True), (2, 1, "patch", "q", None, False)]]
    make = lambda d: stateful.cursor_stream(d, base="base", state_hash="hash")
    got = _run(spark, tmp_path, batches, "sid long, seq long, kind string, base string, hash string, final boolean", make, "bases").collect()
    assert sorted((r.sid, r.seq, r.status) for r in got) == [(1, 1, "ok"), (1, 2, "ok"), (1, 3, "base_mismatch"), (1, 3, "ok"), (2, 1, "no_state")]


def test_frame_stream_offsets_stay_short(tmp_path):
    source = formats._FrameStream({"path": str(tmp_path)})
    start, seen = source.initialOffset(), []
    for n in range(5):
        (tmp_path / f"{9 - n}.bin").write_bytes(b"")
        os.utime(tmp_path / f"{9 - n}.bin", ns=(1000 + n // 2, 1000 + n // 2))
        end = source.latestOffset()
        seen += [p.path[-5:] for p in source.partitions(start, end)]
        assert len(end["files"]) <= 2
        start = end
    assert seen == [f"{9 - n}.bin" for n in range(5)] and source.partitions(start, source.latestOffset()) == []


def test_document_stream(spark, tmp_path):
    batches = [[(1, 1, "doc", "{n=1}"), (2, 1, "patch", "@patch @target=x\n= n 1\n@end")], [(1, 2, "patch", "@patch @target=x\n~ n +4\n@end")], [(1, 3, "patch", "@patch @target=x @base=deadbeefdeadbeef\n~ n +4\n@end")]]
    got = {(r.sid, r.seq): (r.value, r.error) for r in _run(spark, tmp_path, batches, "sid long, seq long, kind string, payload string", stateful.document_stream, "docs").collect()}
    assert got[1, 1] == ("{n=1}", None) and got[1, 2] == ("{n=5}", None) and got[2, 1] == (None, "NO_STATE") and got[1, 3][1]


def test_validator_stream(spark, tmp_path):
    batches = [[(1, 0, "{action"), (2, 0, "search{query=")], [(1, 1, "=boom "), (2, 1, "x}")]]
    got = {(r.call_id, r.tokens): (r.tool, r.should_stop, r.valid) for r in _run(spark, tmp_path, batches, "call_id long, token_no long, token string", stateful.validator_stream, "val").collect()}
    assert got == {(1, 1): (None, False, False), (2, 1): ("search", False, False), (1, 2): ("boom", True, False), (2, 2): ("search", False, True)}


def test_dictionary_stream(spark, tmp_path):
    batches = [[("s", 1, ["b", "a"])], [("s", 2, ["a", "c"])], [("s", 3, ["d", "c"])]]
    got = [(r.key, r.code) for r in _run(spark, tmp_path, batches, "session string, n long, ks array<string>", lambda d: stateful.dictionary_stream(d, "session", "n", "ks", learn=2), "dic").collect()]
    assert sorted(got, key=str) == sorted([("b", 0), ("a", 1), ("a", 1), ("c", 2), ("d", None), ("c", 2)], key=str)


def test_event_stream(spark, tmp_path):
    got = _run(spark, tmp_path, [[(1, 0, "{a=[1")], [(1, 1, "2 x]")], [(1, 2, "}")]], "doc long, n long, t string", lambda d: stateful.event_stream(d, "doc", "n", "t"), "evt").collect()
    want = events_of(["{a=[12 x]}"])
    assert [(r.pos, r.event, r.path, r.key, r.value, r.type_name) for r in sorted(got, key=lambda r: r.pos)] == want


def test_windows_drop_late_rows(spark, tmp_path):
    t = lambda m: datetime(2025, 1, 1, 0, m, tzinfo=UTC)
    got = _run(spark, tmp_path, [[(t(1), "a"), (t(2), "a")], [(t(40), "a")], [(t(3), "a"), (t(59), "b")]], "ts timestamp, k string", lambda d: stateful.windowed_counts(d, "ts", "5 minutes", "10 minutes", "k"), "win").collect()
    assert [(r.k, r.n) for r in got if r.window.start.minute == 0] == [("a", 2)]


def test_command_line(tmp_path, capsys):
    f = tmp_path / "a.json"
    f.write_text('{"b":null,"a":[{"x":1},{"x":2},{"x":3}]}')
    assert cli.main(["format", str(f)]) == 0 and capsys.readouterr().out == "{a=@tab _ rows=3 cols=1 [x]\n|1|\n|2|\n|3|\n@end b=_}\n"
    cli.main(["from-json", str(f), "--no-tabular", "--llm"])
    assert capsys.readouterr().out == "{a=[{x=1} {x=2} {x=3}] b=_}\n"
    cli.main(["format", str(f), "--compact", "--no-tabular"])
    assert capsys.readouterr().out.startswith("@schema#")
    cli.main(["to-json", str(f)])
    assert '"b": null' in capsys.readouterr().out
    g = tmp_path / "f.bin"
    g.write_bytes(b"@frame{v=1 sid=1 seq=0 kind=doc len=2}\nhi\n@frame{v=1")
    assert cli.main(["frames", str(g)]) == 1 and '"payload": "hi"' in capsys.readouterr().out


def test_frames_beyond_limits():
    with pytest.raises(ValueError):
        frames.split_frames(b"@frame{v=2 len=0}\n\n", strict=True)
    assert frames.split_frames(b"@frame{" + b" " * (70 << 10))[0][0][10] == "HEADER_TOO_LARGE"
