import io
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import cli
from tidelog.errors import InvalidDefinition, TableExists, TableNotFound, UnexpectedEnd, UnsupportedEncoding, UnsupportedFormat
from tidelog.functions import protobuf as P
from tidelog.operators.export import export
from tidelog.plans.analyze import analyze, ratio_colour, report
from tidelog.shell import Shell
from tidelog.sources import recording as R
from tidelog.sources.container import Unpacker
from tidelog.sources.formats import infer_output, open_input, write_output
from tidelog.streaming import events as S

KINDS = {"a": T.IntegerType(), "b": T.LongType(), "c": T.DoubleType(), "d": T.StringType(), "e": T.BinaryType(), "f": T.BooleanType(), "g": T.ArrayType(T.IntegerType()), "h": T.StructType().add("x", T.LongType()).add("y", T.ArrayType(T.StringType())), "i": T.ArrayType(T.StructType().add("z", T.FloatType())), "u": T.DecimalType(20, 0)}
SCHEMA = T.StructType([T.StructField(n, k) for n, k in KINDS.items()])
ROW = {"a": -5, "b": -(2**63), "c": 1.5, "d": "é", "e": b"\0\1", "f": True, "g": [0, -1, 300], "h": {"x": 7, "y": ["", "q"]}, "i": [{"z": 0.5}, {"z": -2.0}], "u": Decimal(2**64 - 1)}


def test_protobuf_round_trip():
    held = P.Descriptors(P.descriptor_set(SCHEMA, "t.Root"))
    codec = P.ProtoCodec("t.Root", held)
    assert codec.decode(codec.encode(ROW)) == ROW
    empty = codec.decode(b"")
    assert empty["a"] is None and empty["g"] == [] and empty["h"] is None
    assert [f.dataType.simpleString() for f in P.spark_schema("t.Root", held).fields] == [f.dataType.simpleString() for f in SCHEMA.fields]
    assert P.varint(300) == b"\xac\x02"
    with pytest.raises(UnexpectedEnd):
        codec.decode(codec.encode(ROW)[:-1])
    with pytest.raises(UnsupportedEncoding):
        codec.decode(b"\x0b")


def test_protobuf_against_the_public_library():
    descriptor_pb2 = pytest.importorskip("google.protobuf.descriptor_pb2")
    from google.protobuf import descriptor_pool, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="k.proto", package="k", syntax="proto3", dependency=["google/protobuf/timestamp.proto"])
    m = file.message_type.add(name="All")
    numbers = [k for k in P.KINDS if k not in (11, 14)]
    for k in numbers:
        m.field.add(name=f"f{k}", number=k, type=k, label=1)
        if k not in (9, 12):
            m.field.add(name=f"r{k}", number=100 + k, type=k, label=3)
    entry = m.nested_type.add(name="MEntry")
    entry.options.map_entry = True
    entry.field.add(name="key", number=1, type=9, label=1)
    entry.field.add(name="value", number=2, type=5, label=1)
    m.field.add(name="m", number=200, type=11, label=3, type_name=".k.All.MEntry")
    m.field.add(name="at", number=201, type=11, label=1, type_name=".google.protobuf.Timestamp")
    m.field.add(name="self", number=202, type=11, label=3, type_name=".k.Leaf")
    leaf = file.message_type.add(name="Leaf")
    leaf.field.add(name="v", number=1, type=17, label=1)
    from google.protobuf import timestamp_pb2

    pool = descriptor_pool.DescriptorPool()
    stamp = descriptor_pb2.FileDescriptorProto()
    timestamp_pb2.DESCRIPTOR.CopyToProto(stamp)
    pool.Add(stamp)
    pool.Add(file)
    one = message_factory.GetMessageClass(pool.FindMessageTypeByName("k.All"))()
    for k in numbers:
        value = {1: 0.5, 2: 0.5, 8: True, 9: "ü", 12: b"\xff"}.get(k, 77 if k in (4, 6, 7, 13) else -77)
        setattr(one, f"f{k}", value)
        if k not in (9, 12):
            getattr(one, f"r{k}").extend([value, value])
    one.m["a"] = -1
    one.at.seconds, one.at.nanos = -2, 5
    one.self.add(v=-3)
    held = P.Descriptors(descriptor_pb2.FileDescriptorSet(file=[stamp, file]).SerializeToString())
    codec = P.ProtoCodec("k.All", held)
    row = codec.decode(one.SerializeToString())
    for k in numbers:
        assert row[f"f{k}"] == getattr(one, f"f{k}")
        assert k in (9, 12) or row[f"r{k}"] == list(getattr(one, f"r{k}"))
    assert row["m"] == [{"key": "a", "value": -1}] and row["at"] == -2 * 10**9 + 5 and row["self"] == [{"v": -3}]
    again = type(one)()
    again.ParseFromString(codec.encode(row))
    assert again == one


def test_protobuf_texts_and_loops():
    assert "repeated int32 g = 2;" in P.proto_text(T.StructType().add("a", T.StringType()).add("g", T.ArrayType(T.IntegerType())), "Flat")
    with pytest.raises(InvalidDefinition):
        P.proto_text(SCHEMA, "Nested")
    field = P._part(1, "me") + P._part(3, 1) + P._part(4, 1) + P._part(5, 11) + P._part(6, ".L")
    with pytest.raises(InvalidDefinition):
        P.spark_schema("L", P.Descriptors(P._part(1, P._part(4, P._part(1, "L") + P._part(2, field)))))


@pytest.fixture
def topics(spark):
    rows = spark.range(6).select((F.col("id") * 10).alias("_log_time"), F.col("id").alias("n"), F.concat(F.lit("s"), "id").alias("s"))
    return {"/robot/position": rows.filter("n % 2 = 0"), "/robot/status": rows.filter("n % 2 = 1")}


@pytest.mark.parametrize("encoding", ["ros1", "cdr", "protobuf"])
def test_export_in_order(spark, topics, encoding):
    out = io.BytesIO()
    stats = export(topics, out, encoding)
    messages = list(Unpacker(out.getvalue()).messages())
    assert [m.log_time for m in messages] == [0, 10, 20, 30, 40, 50] and stats.by_topic == {"/robot/position": 3, "/robot/status": 3}
    assert [m.sequence for m in messages] == [0, 0, 1, 1, 2, 2]
    files = spark.createDataFrame([("x", bytearray(out.getvalue()))], "path string, content binary")
    got = R.topic_frame(R.envelopes(files), "/robot/status").orderBy("n").collect()
    assert [(r.n, r.s) for r in got] == [(1, "s1"), (3, "s3"), (5, "s5")]


def test_export_ends_with_the_pipe(topics):
    class Closed(io.BytesIO):
        def write(self, data):
            raise BrokenPipeError

    export(topics, Closed())
    with pytest.raises(UnsupportedFormat):
        export({"/x": topics["/robot/status"].drop("_log_time")}, io.BytesIO())


@pytest.mark.parametrize("fmt", ["parquet", "duckdb", "tables"])
def test_modes(spark, topics, tmp_path, fmt):
    path = str(tmp_path / ("t.duckdb" if fmt == "duckdb" else "out"))
    write_output(spark, topics, path, fmt)
    with pytest.raises(TableExists):
        write_output(spark, topics, path, fmt)
    write_output(spark, topics, path, fmt, "append")
    source = open_input(spark, path, fmt)
    assert source.names() == ["robot_position", "robot_status"] and source.table("robot_status").count() == 6
    with pytest.raises(TableNotFound):
        source.table("none")
    write_output(spark, topics, path, fmt, "overwrite")
    assert open_input(spark, path, fmt).table("robot_position").count() == 3


def test_formats_that_are_absent(spark, topics):
    assert (infer_output("a.mcap"), infer_output("s3://b/c"), infer_output("x.db")) == ("mcap", "tables", "duckdb")
    with pytest.raises(UnsupportedFormat):
        write_output(spark, topics, "/tmp/none.vortex")
    with pytest.raises(UnsupportedFormat):
        open_input(spark, "/tmp/none.lance")


def test_command_line_shell_and_report(spark, topics, tmp_path, capsys):
    recording, folder = str(tmp_path / "r.mcap"), str(tmp_path / "out.tables")
    write_output(spark, topics, recording)
    assert cli.main(["convert", recording, "-o", folder], spark) == 0
    assert cli.main(["convert", recording, "-o", folder], spark) == 1 and "TableExists" in capsys.readouterr().err
    shell, said = Shell(spark, open_input(spark, folder)), []
    lines = iter(["\\dt", "SELECT count(*) AS n", "FROM robot_status;", "\\d robot_status", "SELECT nope;", "\\x", "\\dt+", "\\q", "never"])
    shell.run(lambda _: next(lines), said.append)
    assert "robot_position" in said[0] and "3" in said[1] and "s  string" in said[2] and "nope" in said[3] and "unknown" in said[4] and "3 rows" in said[5]
    result = analyze(spark, [recording], str(tmp_path / "report"), clean=True)
    assert result.totals()["messages"] == 6 and not result.errors and not (tmp_path / "report").exists()
    assert "/robot/status" in report(result) and result.topics.agg(F.sum("bytes")).first()[0] == 6 * (8 + 4 + 2)
    assert ratio_colour(0.5) != ratio_colour(2.0) == ratio_colour(9.0)


def test_streams(spark, topics, tmp_path):
    for k in range(2):
        write_output(spark, topics, str(tmp_path / f"{k}.mcap"))
    stream = S.recording_stream(spark, f"{tmp_path}/*.mcap", ["/robot/status"], files_per_batch=1)
    S.drain(stream.select("topic", "_log_time"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    S.drain(stream.select("topic", "_log_time"), str(tmp_path / "out"), str(tmp_path / "state"))  # nothing is repeated
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
