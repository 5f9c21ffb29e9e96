"""Recordings as DataFrames: envelopes of messages, and a typed DataFrame for each topic."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.errors import UnsupportedEncoding
from tidelog.functions import protobatch, protobuf
from tidelog.functions.codecs import Codec
from tidelog.functions.definitions import Registry, spark_schema
from tidelog.functions.names import table_name
from tidelog.operators.evolution import compare_schemas, project
from tidelog.sources.container import RECORD, Channel, Message, Schema, Summary, Unpacker, pack, read_summary
from tidelog.sources.shared import shared_folder

ENVELOPE = "_log_time long, _publish_time long, _sequence long, _channel_id int, topic string, message_encoding string, schema_name string, schema_encoding string, schema_data binary, data binary"
ENVELOPE_ARROW = pa.schema([("_log_time", pa.int64()), ("_publish_time", pa.int64()), ("_sequence", pa.int64()), ("_channel_id", pa.int32()), *((n, pa.string()) for n in ("topic", "message_encoding", "schema_name", "schema_encoding")), ("schema_data", pa.binary()), ("data", pa.binary())])
META = ["_log_time", "_publish_time", "_sequence", "_channel_id"]
#: Message encodings and the codec that reads them.
ENCODINGS = {"ros1": "packed", "ros1msg": "packed", "cdr": "cdr", "protobuf": "protobuf"}
SCHEMA_ENCODINGS = {"cdr": "ros2msg", "protobuf": "protobuf"}
BATCH_ROWS, BATCH_BYTES, HELD_BYTES = 4096, 64 << 20, 16 << 20


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of recording files on any file system that Spark reads; a task takes whole files of up to 2 GB."""
    return spark.read.format("binaryFile").load([*paths]).select("path", "content")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file as workers open it; plain paths and ``file:`` are local or shared mounts."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), unquote(re.sub("^file:/*", "/", path))
    return fs.FileSystem.from_uri(path)


def _summary(system: fs.FileSystem, place: str) -> tuple[int, Summary | None]:
    with system.open_input_file(place) as f:
        size = f.size()
        return size, read_summary(size, lambda at, n: f.read_at(n, at))


def recording(spark: SparkSession, *paths: str, topics: list[str] | None = None, since: int = 0, until: int = 1 << 62, range_bytes: int = 16 << 20) -> DataFrame:
    """The envelopes of recording files. Where workers can open them and they end with a chunk index, tasks read ranges of chunks of some
    ``range_bytes``, and none that the times rule out; other files are read whole, through ``read_files``."""
    listed = spark.read.format("binaryFile").load([*paths]).select("path", "length")  # contents aren't read
    first, total = listed.agg(F.min("path"), F.sum("length")).first()
    try:
        openable = first is not None and opened(first)[0] is not None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        openable = False
    if not openable:
        return envelopes(read_files(spark, *paths), topics, since, until)

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                size, found = _summary(*opened(path))
                ranges: list[list[int]] = []
                for place, length, low, high in sorted(found.chunks if found else [(0, size, 0, 1 << 63)]):
                    if high < since or low > until:
                        continue
                    if ranges and ranges[-1][0] + ranges[-1][1] == place and ranges[-1][1] + length <= range_bytes:
                        ranges[-1][1] += length
                    else:
                        ranges.append([place, length])
                if ranges:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges)), pa.array([r[0] for r in ranges], pa.int64()), pa.array([r[1] for r in ranges], pa.int64())], names=["path", "place", "size"])

    wanted = set(topics) if topics is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, place, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, own = opened(path)
                known = _summary(system, own)[1]
                with system.open_input_file(own) as f:
                    yield from _enveloped(Unpacker(f.read_at(size, place), wanted, since, until, known))

    parts = max(1, -(-(total or 0) // range_bytes))
    return listed.select("path").mapInArrow(planned, "path string, place long, size long").repartition(parts).mapInArrow(run, ENVELOPE)


def _enveloped(unpacker: Unpacker) -> Iterator[pa.RecordBatch]:
    schema = ENVELOPE_ARROW
    none = Schema(0, "", "", b"")
    for heads, payloads in unpacker.blocks():
        ids, place = np.unique(heads["channel"], return_inverse=True)
        channels = [unpacker.channels[i] for i in ids.tolist()]
        schemas = [unpacker.schemas.get(c.schema_id) or none for c in channels]
        described = [[c.topic for c in channels], [c.message_encoding for c in channels], [s.name for s in schemas], [s.encoding for s in schemas], [s.data for s in schemas]]
        each = [pa.array(heads[n].astype(np.int64)) for n in ("log", "publish", "sequence")] + [pa.array(heads["channel"].astype(np.int32))]
        each += [pa.array(x, t).take(pa.array(place)) for x, t in zip(described, schema.types[4:9])] + [payloads]
        whole = pa.RecordBatch.from_arrays(each, schema=schema)
        rows = max(1, min(BATCH_ROWS, BATCH_BYTES * whole.num_rows // max(1, payloads.nbytes)))
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def envelopes(files: DataFrame, topics: list[str] | None = None, since: int = 0, until: int = 1 << 62) -> DataFrame:
    """All messages of (path, content) rows; topics and log times are sieved before payloads are copied."""
    wanted = set(topics) if topics is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _enveloped(Unpacker(content.as_py() or b"", wanted, since, until))

    return files.select("content").mapInArrow(run, ENVELOPE)


def metadata(files: DataFrame) -> dict[str, DataFrame]:
    """The tables ``_channels`` and ``_schemas`` of (path, content) rows, each row once; a channel's own metadata as JSON."""
    kinds = {"_channels": "id int, topic string, schema_id int, message_encoding string, metadata string", "_schemas": "id int, name string, encoding string, data binary"}

    def rows_of(name: str) -> DataFrame:
        schema = to_arrow_schema(T.StructType.fromDDL(kinds[name]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    unpacker = Unpacker(content.as_py() or b"", topics=set())
                    unpacker.finish()
                    rows = [(c.id, c.topic, c.schema_id, c.message_encoding, json.dumps(c.metadata, sort_keys=True)) for c in unpacker.channels.values()] if name == "_channels" else [(s.id, s.name, s.encoding, s.data) for s in unpacker.schemas.values()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

        return files.select("content").mapInArrow(run, kinds[name]).distinct()

    return {n: rows_of(n) for n in kinds}


def topics_of(messages: DataFrame) -> DataFrame:
    """Each topic's schemas and encodings, one row for each, with its number of messages and first time; as many rows as
    topics have kinds of channels."""
    kinds = messages.groupBy("topic", "message_encoding", "schema_name", "schema_encoding", F.xxhash64("schema_data").alias("h"))
    return kinds.agg(F.first("schema_data").alias("schema_data"), F.count(F.lit(1)).alias("messages"), F.min("_log_time").alias("start")).drop("h")


def staged(messages: DataFrame) -> DataFrame:
    """The envelopes, written once to the shared folder by topic, so that each topic's frame reads its own part only."""
    path = f"{shared_folder(messages.sparkSession)}/staged-{uuid.uuid4().hex}"
    messages.withColumn("part", F.xxhash64("topic")).write.partitionBy("part").option("compression", "zstd").parquet(path)
    return messages.sparkSession.read.schema(T.StructType.fromDDL(ENVELOPE + ", part long")).parquet(path)


def _compiled(schema_name: str, schema: str | bytes, encoding: str, wanted: set[str] | None = None) -> tuple[T.StructType, Callable]:
    """The columns of a type, and what makes its codec in a task. ``schema``: a definition's text, or a descriptor set."""
    if encoding not in ENCODINGS:
        raise UnsupportedEncoding(encoding)
    if encoding == "protobuf":
        held = protobuf.Descriptors(schema if isinstance(schema, bytes) else schema.encode())
        return protobuf.spark_schema(schema_name, held), lambda: protobuf.ProtoCodec(schema_name, held)
    registry = Registry.parse(schema_name, schema.decode() if isinstance(schema, bytes) else schema)
    return spark_schema(schema_name, registry), lambda: Codec(schema_name, registry, ENCODINGS[encoding], wanted)


def _arrays(codec: Codec | protobuf.ProtoCodec, payloads: pa.Array, schema: pa.Schema) -> dict[str, pa.Array]:
    if isinstance(codec, Codec):
        return codec.arrays(payloads)
    try:
        whole = protobatch.decoded(payloads, codec.name, codec.held)
        return {n: whole[n].cast(schema.field(n).type) for n in whole if n in schema.names}
    except (protobatch.NotPlain, pa.ArrowInvalid, pa.ArrowNotImplementedError):  # payload by payload, which tells of what is wrong
        held = codec.columns(payloads.to_pylist())
    return {n: pa.array(held[n], schema.field(n).type) for n in held if n in schema.names}


def decode(messages: DataFrame, schema_name: str, schema: str | bytes, encoding: str, permissive: bool = False, columns: list[str] | None = None, layout: str = "head") -> DataFrame:
    """Message fields (all, or ``columns``) behind the envelope's time columns; in the layout ``tail`` before ``_log_time`` alone. ``permissive`` keeps payloads that don't
    decode as rows of nulls, with the error in ``_corrupt``."""
    fields, make = _compiled(schema_name, schema, encoding, set(columns) if columns is not None else None)
    if columns is not None:
        fields = T.StructType([fields[c] for c in columns])
    out = T.StructType([*(messages.schema[c] for c in META), *fields.fields, *([T.StructField("_corrupt", T.StringType())] if permissive else [])])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            payloads = batch.column(len(META))
            errors: list = [None] * len(payloads)
            try:
                held = _arrays(codec, payloads, arrow)
            except Exception:
                if not permissive:
                    raise
                rows = []
                for i, p in enumerate(payloads.to_pylist()):
                    try:
                        rows.append(codec.decode(p))
                    except Exception as e:
                        rows.append({})
                        errors[i] = f"{type(e).__name__}: {e}"
                held = {f.name: pa.array([r.get(f.name) for r in rows], arrow.field(f.name).type) for f in fields.fields}
            arrays = [batch.column(i) for i in range(len(META))] + [held[f.name].cast(arrow.field(f.name).type) for f in fields.fields]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(errors, pa.string())] if permissive else []), schema=arrow)

    done = messages.select(*META, "data").mapInArrow(run, out)
    return done if layout == "head" else done.select(*(f"`{c}`" for c in done.columns if c not in META), "_log_time")


def topic_frame(messages: DataFrame, topic: str, permissive: bool = False, columns: list[str] | None = None, layout: str = "head", kinds: list | None = None) -> DataFrame:
    """One topic as a typed DataFrame. Each kind of channel is decoded by its own encoding and schema; where there are several, their
    schemas are merged, and what a kind lacks is null. ``kinds``: the topic's rows of ``topics_of``, if they are known."""
    part = [F.col("part") == F.xxhash64(F.lit(topic))] if "part" in messages.columns else []
    own = reduce(DataFrame.filter, part, messages).filter(F.col("topic") == topic)
    kinds = topics_of(own).collect() if kinds is None else kinds  # a row a kind of channel
    if not kinds:
        raise UnsupportedEncoding(f"no messages of {topic}")
    frames = []
    for k in sorted(kinds, key=lambda k: (k.start, k.message_encoding, k.schema_name, bytes(k.schema_data))):
        rows = own
        if len(kinds) > 1:
            rows = own.filter((F.col("message_encoding") == k.message_encoding) & (F.col("schema_name") == k.schema_name) & (F.col("schema_encoding") == k.schema_encoding) & (F.col("schema_data") == F.lit(bytes(k.schema_data))))
        there = _compiled(k.schema_name, bytes(k.schema_data), k.message_encoding)[0].names
        frames.append(decode(rows, k.schema_name, bytes(k.schema_data), k.message_encoding, permissive, None if columns is None else [c for c in columns if c in there], layout))
    merged = reduce(lambda a, b: compare_schemas(a, b).merged, (f.schema for f in frames))
    out = frames[0] if len(frames) == 1 else reduce(DataFrame.unionByName, (project(f, merged) for f in frames))
    absent = [c for c in columns or [] if c not in out.columns]
    if absent:
        raise UnsupportedEncoding(f"{topic} has no {', '.join(absent)}")
    return out


def topic_frames(messages: DataFrame, topics: list[str] | None = None) -> dict[str, DataFrame]:
    """All topics (or ``topics``, in their order), from one pass over the recordings and one over the staged envelopes."""
    held = staged(messages)
    kinds: dict[str, list] = {}
    for r in topics_of(held).collect():  # a row a kind of channel
        kinds.setdefault(r.topic, []).append(r)
    return {t: topic_frame(held, t, kinds=kinds.get(t, [])) for t in (sorted(kinds) if topics is None else topics)}


def register_views(messages: DataFrame) -> list[str]:
    """A view for each topic under its table name, and under the topic itself in backticks."""
    out = []
    for topic, df in topic_frames(messages).items():
        for name in dict.fromkeys((table_name(topic), topic)):
            df.createOrReplaceTempView(f"`{name}`" if not name.isidentifier() else name)
            out.append(name)
    return sorted(out)


def _payloads(codec: Codec | protobuf.ProtoCodec, columns: list[pa.Array], names: list[str]) -> pa.Array:
    if isinstance(codec, Codec):
        return codec.payloads(columns)
    try:
        return protobatch.encoded(columns, names, codec.name, codec.held)
    except (protobatch.NotPlain, pa.ArrowInvalid, pa.ArrowNotImplementedError, TypeError):
        pass
    return pa.array([codec.encode(dict(zip(names, row))) for row in zip(*(c.to_pylist() for c in columns))], pa.binary())


def encode(df: DataFrame, schema_name: str, schema: str | bytes, encoding: str, log_time: str = "_log_time", kept: list[str] | None = None) -> DataFrame:
    """(_log_time, the columns ``kept``, data): each row's payload."""
    fields, make = _compiled(schema_name, schema, encoding)
    head = df.select(F.col(f"`{log_time}`").cast("long").alias("_log_time"), *(f"`{c}`" for c in kept or []))
    out = T.StructType([*head.schema.fields, T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out) - 1], _payloads(codec, batch.columns[len(out) - 1 :], fields.names)], names=out.names)

    named = [F.col(f"`{n}`").alias(f"__f{i}") for i, n in enumerate(fields.names)]  # fields may be called as the head's columns
    return df.select(F.col(f"`{log_time}`").cast("long").alias("_log_time"), *(f"`{c}`" for c in kept or []), *named).mapInArrow(run, out)


def decoder(schema_name: str, schema: str | bytes, encoding: str) -> Callable:
    """A function of a payload column, to use in expressions or to register for SQL (``spark.udf.register``)."""
    fields, make = _compiled(schema_name, schema, encoding)
    fields = T.StructType.fromDDL(fields.toDDL())  # results have no metadata
    kind = to_arrow_schema(fields)

    @F.arrow_udf(fields)
    def decoded(payloads: pa.Array) -> pa.Array:
        held = _arrays(make(), payloads, kind)
        return pa.StructArray.from_arrays([held[f.name].cast(f.type) for f in kind], fields=list(kind))

    return decoded


def encoder(schema_name: str, schema: str | bytes, encoding: str) -> Callable:
    """A function of a struct column, in the order of the type's fields, to its payload."""
    fields, make = _compiled(schema_name, schema, encoding)

    @F.arrow_udf("binary")
    def encoded(rows: pa.Array) -> pa.Array:
        return _payloads(make(), pa.RecordBatch.from_struct_array(rows).columns, fields.names)

    return encoded


def pack_files(messages: DataFrame, topics: dict[str, tuple[str, str | bytes, str]], files: int | None = None, compression: str = "zstd", file_bytes: int = 128 << 20) -> DataFrame:
    """(path, content): recordings of rows (topic, _log_time, data), each in order of time, from ``files`` ranges of time, or as many as hold
    ``file_bytes`` of records each; a range that is larger than ``HELD_BYTES`` makes several, as a file is held whole. ``topics``: topic -> (schema name, schema text, message encoding)."""
    names = sorted(topics)
    schemas = [Schema(i + 1, topics[t][0], SCHEMA_ENCODINGS.get(topics[t][2], "ros1msg"), x if isinstance(x := topics[t][1], bytes) else x.encode()) for i, t in enumerate(names)]
    channels = [Channel(i, i + 1, t, topics[t][2]) for i, t in enumerate(names)]
    place = {t: i for i, t in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def each() -> Iterator[Message]:
            for batch in batches:
                for topic, log, data in zip(*(c.to_pylist() for c in batch.columns)):
                    n = counts[topic] = counts.get(topic, -1) + 1
                    yield Message(place[topic], n, log, log, data)

        rows, number = each(), 0
        following = next(rows, None)

        def some() -> Iterator[Message]:
            nonlocal following
            size = 0
            while following is not None and size < HELD_BYTES:
                size += RECORD.itemsize + len(following.data)
                yield following
                following = next(rows, None)

        while following is not None:
            content = b"".join(pack(schemas, channels, some(), compression))
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{TaskContext.get().partitionId():05d}-{number:05d}.mcap"]), pa.array([content], pa.binary())], names=["path", "content"])
            number += 1

    if files is None:
        files = max(1, -(-(messages.agg(F.sum(F.length("data") + RECORD.itemsize)).first()[0] or 0) // file_bytes))
    dealt = messages.select("topic", "_log_time", "data").repartitionByRange(files, "_log_time").sortWithinPartitions("_log_time", "topic")
    return dealt.mapInArrow(run, "path string, content binary")
