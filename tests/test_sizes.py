"""Queries on rows that larger tables hold: wide keys, ties and nulls, many messages a file."""

import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import __spark_entry__
from tidelog.errors import UnsupportedFormat
from tidelog.functions import protobatch
from tidelog.functions import protobuf as P
from tidelog.operators.export import export_file
from tidelog.sources import recording as R
from tidelog.sources.container import Channel, Message, Schema, Unpacker, message_records, opening, read_summary
from tidelog.streaming import events as S

QUERIES = __spark_entry__.queries()


def write(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_evolution_of_wide_keys(spark, tmp_path):
    rows = [(k, c, s) for k, c, s in [(0, 7, "a"), (1, 32767, "b"), (4, 32768, "c"), (3, 2**31, "d"), (2, 5, "e"), (7, None, "f"), (-1, 9, "g")]]
    got = QUERIES["rec_parquet_evolve"](spark, write(spark, tmp_path, "orders", rows, "o_orderkey long, o_custkey long, o_orderstatus string"))
    assert {(r.o_orderkey, r.c, r.o_orderstatus) for r in got.collect()} == {(k, c, s if k == 2 else None) for k, c, s in rows} and got.schema["c"].dataType.simpleString() == "bigint"


def test_lateral_order(spark, tmp_path):
    write(spark, tmp_path, "customer", [(1,), (2,), (None,)], "c_custkey long")
    write(spark, tmp_path, "orders", [(1, 1, 5.0), (None, 1, 5.0), (3, 1, 5.0), (None, 2, None), (7, 2, None), (4, None, 1.0)], "o_orderkey long, o_custkey long, o_totalprice double")
    got = QUERIES["sql_join_lateral"](spark, str(tmp_path))
    assert sorted(got.collect(), key=str) == [(1, 1), (1, 3), (2, 7), (2, None)]
    assert "windowspecdefinition(o_custkey" in (plan := got._jdf.queryExecution().analyzed().toString()) and "o_totalprice" in plan.split("windowspecdefinition(")[1].split("specifiedwindowframe")[0]


def test_blocks_keep_no_payloads():
    schema, channel = Schema(1, "t/A", "ros1msg", b"int64 a"), Channel(1, 1, "/a", "ros1")
    loose = opening([schema], [channel]) + b"".join(message_records(*(np.full(300_000, k) for k in (1, 5, 7, 7)), [b"\1" * 8] * 300_000)[1])  # no chunks
    held = sys.getrefcount(loose)
    blocks = [(len(heads), payloads.nbytes) for heads, payloads in Unpacker(loose).blocks()]
    assert sum(n for n, _ in blocks) == 300_000 and len(blocks) > 2 and sys.getrefcount(loose) == held
    with pytest.raises(UnsupportedFormat):
        message_records(*(np.array([k]) for k in (1, 1 << 32, 7, 7)), [b""])


def test_files_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(R, "HELD_BYTES", 4000)
    rows = R.encode(spark.range(1000).selectExpr("id AS _log_time", "id AS a"), "t/A", "int64 a", "ros1").withColumn("topic", F.lit("/a"))
    files = R.pack_files(rows, {"/a": ("t/A", "int64 a", "ros1")}, 1)
    found = files.orderBy("path").collect()
    assert len(found) == 10 and len({r.path for r in found}) == 10
    got = R.envelopes(files).select("_log_time", "_sequence").collect()
    assert sorted((r._log_time, r._sequence) for r in got) == [(i, i) for i in range(1000)]


def test_export_file_by_tasks(spark, tmp_path):
    rows = spark.range(60_000).repartition(7).select((F.col("id") % 30_000).alias("_log_time"), F.col("id").alias("n"), F.rpad(F.hex("id"), 60, "x").alias("s"))
    frames = {"/own": rows.filter("n % 3 = 0").withColumn("_sequence", 90_000 - F.col("n")), "/running": rows.filter("n % 3 > 0")}
    path = f"{tmp_path}/all.mcap"
    stats = export_file(frames, path)
    data = (tmp_path / "all.mcap").read_bytes()
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.mcap"] and stats.by_topic == {"/own": 20_000, "/running": 40_000}
    found = list(Unpacker(data).messages())
    order = [(m.log_time, m.channel_id, m.sequence) for m in found]
    assert order == sorted(order) and [m.sequence for m in found if m.channel_id == 1] == list(range(40_000)) and len(read_summary(len(data), lambda at, n: data[at : at + n]).chunks) > 3
    got = R.topic_frames(R.recording(spark, path, range_bytes=1 << 18))
    assert got["/own"].selectExpr("sum(n + _sequence) AS a", "count(DISTINCT n, s) AS b").first() == (20_000 * 90_000, 20_000) and got["/running"].count() == 40_000


def test_approximate_plan_and_odd_groups(spark, tmp_path):
    rows = [("A", i % 7, float(i)) for i in range(2001)] + [("B", 1, 5.0), ("B", 2, 9.0), ("C", 3, 1.0), (None, None, 2.0), (None, 4, None)] + [("D", i, 1.0 if i else 1e9) for i in range(50)]
    got = QUERIES["sql_agg_approx"](spark, write(spark, tmp_path, "lineitem", rows, "l_returnflag string, l_partkey long, l_extendedprice double"))
    assert sorted(got.collect(), key=str) == sorted([(k, True, k != "B") for k in ("A", "B", "C", "D", None)], key=str)  # of 5 and 9 the sketch takes 5
    assert "percentile_cont" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Expand" not in plan


def test_partitions_of_a_state(spark, tmp_path):
    write(spark, tmp_path, "in", [(i % 5, i) for i in range(50)], "k long, s long")
    stream = spark.readStream.schema("k long, s long").parquet(f"{tmp_path}/in.parquet").withColumn("at", F.timestamp_seconds("s"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    S.drain(S.first_seen(stream, "at", "1 day", ["k"]), str(tmp_path / "out"), str(tmp_path / "state"), partitions=7)
    assert len([p for p in (tmp_path / "state/state/0").iterdir() if p.name.isdigit()]) == 7 and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_protobuf_batches_like_single_payloads():
    kind = T.StructType.fromDDL("a int, b long, c double, d string, e binary, f boolean, g array<int>, h struct<x: long, y: array<string>>, i array<struct<z: float, w: array<struct<v: string>>>>, j tinyint")
    held = P.Descriptors(P.descriptor_set(kind, "t.Root"))
    codec, schema = P.ProtoCodec("t.Root", held), to_arrow_schema(P.spark_schema("t.Root", held))
    rng, rows = np.random.default_rng(5), []
    for i in range(300):
        wide = int(rng.integers(-(2**63), 2**63 - 1)) >> int(rng.integers(0, 63))
        rows.append({"a": (wide % 2**32) - 2**31, "b": wide, "c": wide / 3, "d": "é" * (i % 200), "e": bytes(i % 5), "f": i % 2 == 0, "g": [0, -1, i][: i % 4], "h": {"x": -i, "y": ["", "q"][: i % 3]}, "i": [{"z": 0.5 * k, "w": [{"v": "s" * k}] * (k % 3)} for k in range(i % 6)], "j": i % 100})
        for n in kind.names:
            if rng.random() < 0.2 and n not in "gi":
                rows[-1][n] = None
    columns = [pa.array([r[f.name] for r in rows], f.type) for f in schema]
    one = pa.array([codec.encode(r) for r in rows], pa.binary())
    for low, high in ((0, 300), (17, 250), (5, 6)):
        assert protobatch.encoded([c.slice(low, high - low) for c in columns], kind.names, "t.Root", held).equals(one.slice(low, high - low))
        got = protobatch.decoded(one.slice(low, high - low), "t.Root", held)
        assert all(got[n].cast(schema.field(n).type).to_pylist() == [codec.decode(p)[n] for p in one.slice(low, high - low).to_pylist()] for n in kind.names)
    assert protobatch.decoded(pa.array([b"", b"\x08\x05\x08\x06\x98\x06\x01"], pa.binary()), "t.Root", held)["a"].to_pylist() == [None, 6]  # unset; the last one, and a field that isn't known
    for bad in (b"\x08", b"\x3a\x02\x01\x02", b"\x09" + bytes(8), one[1].as_py()[:-1], b"\x0b"):  # breaks off, packed, other wire type, short, group
        with pytest.raises(protobatch.NotPlain):
            protobatch.decoded(pa.array([bad], pa.binary()), "t.Root", held)
