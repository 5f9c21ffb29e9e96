from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import IncompatibleType, InvalidDefinition, NameClash, SqlRejected, TableExists, UnexpectedEnd
from tidelog.functions.codecs import Codec
from tidelog.functions.definitions import Registry, definition_text, parse_definition, spark_schema
from tidelog.functions.names import cell_text, duration_text, size_text, table_name, time_text, topic_name
from tidelog.operators.evolution import can_widen, compare_schemas
from tidelog.operators.tables import TableStore
from tidelog.operators.temporal import asof_join
from tidelog.plans.front import nulls_last, rendered, run_sql
from tidelog.sources import recording as R
from tidelog.sources.container import Channel, Message, Schema, Unpacker, pack, read_summary

TEXT = "int32 seq\nstring frame\ntime stamp\nfloat64[3] xyz\nuint8[] raw\nt/Inner[] inner\nt/None none\n" + "=" * 80 + "\nMSG: t/Inner\nuint64 a\nbool b\n" + "=" * 80 + "\nMSG: t/None\nint32 X=1\n"
REGISTRY = Registry.parse("t/Root", TEXT)


@pytest.mark.parametrize("encoding", ["packed", "cdr"])
@settings(max_examples=60, deadline=None)
@given(st.integers(-(2**31), 2**31 - 1), st.text(st.characters(blacklist_characters="\0", blacklist_categories=["Cs"])), st.integers(0, 2**31 * 10**9 - 1), st.lists(st.floats(allow_nan=False), min_size=3, max_size=3), st.binary(), st.lists(st.tuples(st.integers(0, 2**64 - 1), st.booleans())))
def test_round_trip(encoding, seq, frame, stamp, xyz, raw, inner):
    row = {"seq": seq, "frame": frame, "stamp": stamp, "xyz": xyz, "raw": raw, "inner": [{"a": a, "b": b} for a, b in inner]}
    codec = Codec("t/Root", REGISTRY, encoding)
    assert codec.decode(codec.encode(row)) == row


def test_wire_bytes():
    registry = Registry.parse("t/A", "bool a\nint32 b")
    assert Codec("t/A", registry, "cdr").encode({"a": True, "b": 42}) == b"\0\1\0\0\1\0\0\0*\0\0\0"
    assert Codec("t/A", registry, "packed").decode(b"\x07*\0\0\0") == {"a": True, "b": 42}
    with pytest.raises(UnexpectedEnd):
        Codec("t/A", registry, "packed").decode(b"\1")


@pytest.mark.parametrize("bad", ["float64", "uint8[ x", "uint8[abc] x", "uint8[-1] x"])
def test_bad_definitions(bad):
    with pytest.raises(InvalidDefinition):
        parse_definition("t/X", bad)


def test_schema_text_round_trip():
    schema = spark_schema("t/Root", REGISTRY)
    assert "none" not in schema.names  # empty types are left out
    assert spark_schema("t/Root", Registry.parse("t/Root", definition_text(schema, "t/Root"))) == schema


@pytest.mark.parametrize("compression", ["", "zstd", "lz4"])
def test_container(compression):
    messages = [Message(1, i, i * 10**9, i, bytes([i])) for i in range(5)]
    data = b"".join(pack([Schema(1, "t/A", "ros1msg", b"bool a")], [Channel(1, 1, "/a", "ros1", {"k": "v"})], messages, compression, chunk_bytes=60))
    unpacker = Unpacker(data)
    assert list(unpacker.messages()) == messages and unpacker.channels[1].metadata == {"k": "v"}
    assert [m.sequence for m in Unpacker(data, since=3 * 10**9).messages()] == [3, 4]
    assert list(Unpacker(b"").messages()) == [] and len(list(Unpacker(data[:-60]).messages())) <= 5


def test_topic_views_and_corrupt(spark):
    df = spark.range(5).select((F.col("id") * 10).alias("_log_time"), F.col("id").cast("int").alias("a"))
    rows = R.encode(df, "t/A", "int32 a", "ros1").withColumn("topic", F.lit("/x/y-z"))
    bad = spark.createDataFrame([("/x/y-z", 99, bytearray(b"\1"))], "topic string, _log_time long, data binary")
    messages = R.envelopes(R.pack_files(rows.select("topic", "_log_time", "data").union(bad), {"/x/y-z": ("t/A", "int32 a", "ros1")}, 2))
    got = R.topic_frame(messages, "/x/y-z", permissive=True)
    assert got.filter("_corrupt IS NOT NULL").count() == 1 and got.agg(F.sum("a")).first()[0] == 10
    assert "x_y_z" in R.register_views(messages)


def test_evolution():
    s = lambda ddl: T.StructType.fromDDL(ddl)
    got = compare_schemas(s("x int, s struct<a: int>"), s("x bigint, s struct<a: bigint, b: string>, w double"))
    assert got.new_fields == ["w"] and got.merged.simpleString() == "struct<x:bigint,s:struct<a:bigint,b:string>,w:double>"
    assert not can_widen(T.LongType(), T.IntegerType()) and not can_widen(T.IntegerType(), T.DoubleType())
    with pytest.raises(IncompatibleType):
        compare_schemas(s("x int"), s("x string"))


def test_tables(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    store.write("p", spark.range(5).selectExpr("cast(id as int) x"))
    with pytest.raises(TableExists):
        store.write("p", spark.range(1))
    store.write("p", spark.range(3).selectExpr("id x", "'w' w"), "append")
    assert store.read("p").count() == 8 and store.read("p").schema["x"].dataType == T.LongType()
    store.write("p", spark.range(2), "overwrite")
    assert store.read("p").count() == 2 and store.tables() == ["p"]


def test_front(spark):
    for text in ("SELECT * FROM a ASOF JOIN b", "SELECT 1 QUALIFY x", "COPY t TO 'x'"):
        with pytest.raises(SqlRejected):
            run_sql(spark, text)
    assert "(1 row)" in rendered(run_sql(spark, "SELECT 'asof join' AS a, NULL AS b"))


def test_texts():
    assert (table_name("/camera/image_raw"), table_name("/my-topic"), topic_name("camera_image_raw")) == ("camera_image_raw", "my_topic", "/camera/image/raw")
    assert (size_text(512), size_text(1536), duration_text(0.25), duration_text(90)) == ("512 B", "1.5 KB", "250ms", "1m 30s")
    assert (time_text(-1), time_text(1_500_000_000), cell_text(b"ab"), cell_text(True)) == ("-1.999999999", "1.500", "\\x6162", "t")


def test_batches_like_single_payloads():
    """Columns of a batch are what the field-by-field codec makes of each payload, both ways; slices and empty batches too."""
    row = {"seq": -7, "frame": "é", "stamp": 10**18 + 1, "xyz": [0.5, 1.0, -1.0], "raw": b"\0\1", "inner": [{"a": 2**64 - 1, "b": True}, {"a": 0, "b": False}]}
    rows = [row | {"frame": "x" * k, "inner": row["inner"] * (k % 3), "raw": bytes(k)} for k in range(40)]
    for encoding in ("packed", "cdr"):
        codec = Codec("t/Root", REGISTRY, encoding)
        payloads = [codec.encode(r) for r in rows]
        columns = [pa.array([[{"a": Decimal(x["a"]), "b": x["b"]} for x in r[n]] if n == "inner" else r[n] for r in [rows[0], *rows]], codec.arrow.field(n).type).slice(1) for n in codec.arrow.names]
        assert codec.payloads(columns).to_pylist() == payloads
        got = codec.arrays(pa.array([b"zzzz", *payloads], pa.binary()).slice(1))
        assert [dict(zip(got, v)) for v in zip(*(c.to_pylist() for c in got.values()))] == rows
        assert [*Codec("t/Root", REGISTRY, encoding, {"raw"}).arrays(pa.array(payloads, pa.binary()))] == ["raw"]
        with pytest.raises(UnexpectedEnd):
            codec.arrays(pa.array([payloads[5][:-1]], pa.binary()))
        with pytest.raises(ValueError):
            codec.payloads([pa.nulls(len(c), c.type) for c in columns])
        assert len(codec.payloads([c.slice(0, 0) for c in columns])) == 0 and len(codec.arrays(pa.array([], pa.binary()))["seq"]) == 0
    big = b"\0\0\0\0\0\0\0\x05"
    assert Codec("t/A", Registry.parse("t/A", "int32 a"), "cdr").arrays(pa.array([big]))["a"].to_pylist() == [5]


def test_summary_and_ranges(spark, tmp_path):
    schema, channel = Schema(1, "t/A", "ros1msg", b"int32 a"), Channel(1, 1, "/a", "ros1", {"k": "v"})
    codec = Codec("t/A", Registry.parse("t/A", "int32 a"), "packed")
    data = b"".join(pack([schema], [channel], [Message(1, i, i * 10, i, codec.encode({"a": i})) for i in range(500)], chunk_bytes=400))
    found = read_summary(len(data), lambda at, n: data[at : at + n])
    assert found.channels[1].metadata == {"k": "v"} and len(found.chunks) > 30 and read_summary(5, lambda at, n: b"") is None
    (tmp_path / "r.mcap").write_bytes(data)
    whole = R.recording(spark, f"file://{tmp_path}/r.mcap", range_bytes=4096)
    assert whole.rdd.getNumPartitions() > 2 and R.topic_frame(whole, "/a").agg(F.sum("a")).first()[0] == sum(range(500))
    assert R.recording(spark, str(tmp_path / "r.mcap"), since=1000, until=1990).count() == 100
    bad = bytearray(data)
    bad[found.chunks[3][0] + 60] ^= 255
    with pytest.raises(Exception):
        list(Unpacker(bytes(bad)).messages())
    (tmp_path / "cut.mcap").write_bytes(data[: len(data) // 2])  # no summary: read whole, as far as it goes
    assert 100 < R.recording(spark, str(tmp_path / "cut.mcap")).count() < 500


def test_mixed_channels(spark):
    kinds = [("t/A", "int32 a", "ros1"), ("t/B", "int64 a\nstring s", "cdr")]
    files = [R.pack_files(R.encode(spark.createDataFrame(rows, ddl), *k).withColumn("topic", F.lit("/m")), {"/m": k}, 1) for k, rows, ddl in zip(kinds, ([(1, 5)], [(2, 7, "x")]), ("_log_time long, a int", "_log_time long, a long, s string"))]
    got = R.topic_frame(R.envelopes(files[0].union(files[1])), "/m")
    assert [(r.a, r.s) for r in got.orderBy("_log_time").collect()] == [(5, None), (7, "x")]
    clash = R.pack_files(R.encode(spark.createDataFrame([(3, "q")], "_log_time long, a string"), "t/C", "string a", "ros1").withColumn("topic", F.lit("/m")), {"/m": ("t/C", "string a", "ros1")}, 1)
    with pytest.raises(IncompatibleType):
        R.topic_frame(R.envelopes(files[0].union(clash)), "/m")


def test_asof_odd_cases(spark):
    left = spark.createDataFrame([(1, 10, "a"), (None, 10, "b"), (1, None, "c"), (1, 5, "d")], "`k.x` int, t long, side string")
    right = spark.createDataFrame([(1, 9, 100), (None, 1, 200), (1, None, 300)], "`k.x` int, t long, v int")
    got = asof_join(left, right, ["k.x"], "t", ["v"])
    assert {r.side: r.v_right for r in got.collect()} == {"a": 100, "b": None, "c": None, "d": None} and got.columns == ["k.x", "t", "side", "t_right", "v_right"]
    with pytest.raises(NameClash):
        asof_join(left.withColumn("v_right", F.lit(1)), right, ["k.x"], "t", ["v"])


def test_dialect(spark):
    spark.createDataFrame([(None, 1), (2, 2), (1, 3)], "a int, `b c` int").createOrReplaceTempView("d")
    assert [r[0] for r in run_sql(spark, 'SELECT "b c" FROM "d" ORDER BY a').collect()] == [3, 2, 1]
    assert [r[0] for r in run_sql(spark, "SELECT `b c` FROM d ORDER BY a NULLS FIRST, '//' LIMIT 1").collect()] == [1]
    assert nulls_last("SELECT f(a ORDER BY b), x FROM t ORDER BY g(a, b) DESC, c LIMIT 3") == "SELECT f(a ORDER BY b NULLS LAST), x FROM t ORDER BY g(a, b) DESC NULLS LAST, c NULLS LAST LIMIT 3"
    assert run_sql(spark, "SELECT 7 // 2 AS a, '//' AS b").first() == (3, "//")
    assert {r.column_name: r["count"] for r in run_sql(spark, "SUMMARIZE d").collect()} == {"a": 3, "b c": 3}
    for text in ("SELECT sum(a) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING EXCLUDE CURRENT ROW) FROM d", "SELECT sum(a) OVER (ORDER BY a GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM d"):
        with pytest.raises(SqlRejected):
            run_sql(spark, text)
    text = rendered(spark.range(2500))
    assert text.endswith("(2500 rows)") and len(text.splitlines()) == 2503
    assert cell_text(spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.5'").first()[0]) == "-1.500"
