"""Export of topics to one recording in order of time.

Executors encode, sort and frame payloads into packed chunks. A file in a shared folder is put together by one task, a stream of the driver's
process by the driver. For parallel output use ``pack_files``, which writes files for each range of time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.errors import UnsupportedFormat
from tidelog.functions.definitions import definition_text
from tidelog.functions.protobuf import descriptor_set
from tidelog.sources.container import CHUNK_BYTES, Channel, Indexed, Schema, chunk_record, closing, message_records, opening
from tidelog.sources.recording import META, SCHEMA_ENCODINGS, encode, opened

BLOCK_BYTES = 16 << 20


@dataclass
class ExportStats:
    messages: int = 0
    by_topic: dict[str, int] = field(default_factory=dict)


def log_time(df: DataFrame, column: str = "_log_time") -> DataFrame:
    """``df`` with its log time as nanoseconds; a type that is no time is an error, not 0."""
    kind = df.schema[column].dataType if column in df.columns else None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(column, F.unix_micros(F.col(column).cast("timestamp")) * 1000)
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return df.withColumn(column, F.col(column).cast("long"))
    raise UnsupportedFormat(f"no log time in {column}")


def payloads(frames: dict[str, DataFrame], encoding: str = "ros1") -> tuple[DataFrame, dict[str, tuple[str, bytes]]]:
    """(topic, place, _log_time, _publish_time, _sequence, turn, data) of all topics, and each topic's schema name and data. Envelope columns
    are not message fields; a frame that has no own publish time takes the log time, and one that has no own sequence
    gets a null. ``turn`` is the row's place in the frame's order of partitions and rows."""
    coded, schemas = [], {}
    for place, (topic, frame) in enumerate(frames.items()):
        df = log_time(frame)
        fields = T.StructType([f for f in df.schema.fields if f.name not in META])
        name = "tidelog/" + "".join(c if c.isalnum() else "_" for c in topic.strip("/"))
        if encoding == "protobuf":
            name = name.replace("/", ".")
            data: bytes = descriptor_set(fields, name)
        else:
            data = definition_text(fields, name).encode()
        schemas[topic] = (name, data)
        own = {c: F.col(c).cast("long") if c in df.columns else other for c, other in (("_publish_time", F.col("_log_time")), ("_sequence", F.lit(None).cast("long")))}
        df = df.select("_log_time", *(x.alias(c) for c, x in own.items()), F.monotonically_increasing_id().alias("__turn"), *(f"`{n}`" for n in fields.names))
        kept = ["_publish_time", "_sequence", "__turn"]
        coded.append(encode(df, name, data, encoding, kept=kept).select(F.lit(topic).alias("topic"), F.lit(place).alias("place"), "_log_time", "_publish_time", "_sequence", F.col("__turn").alias("turn"), "data"))
    return reduce(DataFrame.unionAll, coded), schemas


def in_order(coded: DataFrame) -> DataFrame:
    """Rows by time, then by the topic's place, their own sequence, and the order they came in: one range-partitioned sort."""
    return coded.orderBy("_log_time", "place", F.col("_sequence").asc_nulls_last(), "turn")


#: A written chunk: its task and turn, the file that holds it (or its bytes), and what the summary tells of it.
CHUNKS = "part int, turn int, name string, bytes binary, size long, low long, high long, small long, plain long, counts array<long>"


def _framed(ordered: DataFrame, topics: int, compression: str, folder: str | None) -> DataFrame:
    """``CHUNKS`` of rows in order; their bytes in a file of ``folder`` for each task, or in the rows if it is None. Messages keep their own
    sequence; those without one get their number in the topic, for which the rows of each partition are counted first."""
    before: dict[int, np.ndarray] = {}
    so_far = np.zeros(topics, np.int64)
    counted = ordered.groupBy(F.spark_partition_id().alias("part"), "place").count().collect()  # a row a partition and topic
    for r in sorted(counted, key=lambda r: r.part):
        before.setdefault(r.part, so_far.copy())
        so_far[r.place] += r["count"]
    schema = to_arrow_schema(T.StructType.fromDDL(CHUNKS))

    def chunks(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple[bytes, Indexed, list[int]]]:
        number = before.get(part, np.zeros(topics, np.int64)).copy()
        held: list[bytes] = []
        size, low, high, counts = 0, 1 << 64, 0, np.zeros(topics, np.int64)
        for batch in batches:
            place, log, publish = (batch.column(i).to_numpy() for i in (0, 1, 2))
            own = np.zeros(len(place), np.int64)
            for p in np.unique(place):
                mine = np.flatnonzero(place == p)
                own[mine] = number[p] + np.arange(len(mine))
                number[p] += len(mine)
            given = batch.column(3)
            sequence = np.where(given.is_null().to_numpy(zero_copy_only=False), own, given.fill_null(0).to_numpy())
            sizes, records = message_records(place, sequence, log, publish, batch.column(4).to_pylist())
            ends, at = np.cumsum(sizes), 0
            while at < len(place):
                start = ends[at] - sizes[at]
                stop = min(int(np.searchsorted(ends, start + CHUNK_BYTES - size)) + 1, len(place))
                held += records[2 * at : 2 * stop]
                size += int(ends[stop - 1] - start)
                low, high = min(low, int(log[at:stop].min())), max(high, int(log[at:stop].max()))
                counts += np.bincount(place[at:stop], minlength=topics)
                at = stop
                if size >= CHUNK_BYTES:
                    yield *chunk_record(b"".join(held), low, high, compression), counts.tolist()
                    held, size, low, high, counts = [], 0, 1 << 64, 0, np.zeros(topics, np.int64)
        if held:
            yield *chunk_record(b"".join(held), low, high, compression), counts.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        found = ((turn, *x) for turn, x in enumerate(chunks(batches, part)))
        if folder is None:
            for turn, body, c, counts in found:
                yield pa.RecordBatch.from_pylist([{"part": part, "turn": turn, "bytes": body, **vars(c), "counts": counts}], schema=schema)
            return
        rows, out = [], None
        for turn, body, c, counts in found:
            if out is None:
                system, own = opened(f"{folder}/{name}")
                system.create_dir(os.path.dirname(own), recursive=True)
                out = system.open_output_stream(own)
            out.write(body)
            rows.append({"part": part, "turn": turn, "name": name, **vars(c), "counts": counts})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ordered.select(F.col("place"), "_log_time", "_publish_time", "_sequence", "data").mapInArrow(run, CHUNKS)


def _described(frames: dict[str, DataFrame], encoding: str, metadata: dict[str, dict[str, str]] | None) -> tuple[DataFrame, list[Schema], list[Channel]]:
    coded, held = payloads(frames, encoding)
    schemas = [Schema(i + 1, held[t][0], SCHEMA_ENCODINGS.get(encoding, "ros1msg"), held[t][1]) for i, t in enumerate(frames)]
    channels = [Channel(i, i + 1, t, encoding, (metadata or {}).get(t, {})) for i, t in enumerate(frames)]
    return in_order(coded).persist(StorageLevel.DISK_ONLY), schemas, channels  # counted, then framed: both must see one order


def _stats(frames: dict[str, DataFrame], counts: np.ndarray) -> ExportStats:
    return ExportStats(int(counts.sum()), dict(zip(frames, counts.tolist())))


def export(frames: dict[str, DataFrame], out: BinaryIO, encoding: str = "ros1", compression: str = "zstd", metadata: dict[str, dict[str, str]] | None = None) -> ExportStats:
    """Writes one recording to a stream of this process, to which the packed chunks are sent. Messages keep their own sequence; a topic without one gets
    running numbers. ``metadata``: each channel's own. A reader that closes the pipe ends the export without an error."""
    ordered, schemas, channels = _described(frames, encoding, metadata)
    index, counts = [], np.zeros(len(frames), np.int64)
    try:
        out.write(opening(schemas, channels))
        for r in _framed(ordered, len(frames), compression, None).toLocalIterator(prefetchPartitions=True):
            index.append(Indexed(r.size, r.low, r.high, r.small, r.plain))
            counts += r.counts
            out.write(bytes(r.bytes))
        out.write(closing(schemas, channels, index, dict(enumerate(counts.tolist())), compression))
        out.flush()
    except BrokenPipeError:
        pass
    finally:
        ordered.unpersist()
    return _stats(frames, counts)


def export_file(frames: dict[str, DataFrame], path: str, encoding: str = "ros1", compression: str = "zstd", metadata: dict[str, dict[str, str]] | None = None) -> ExportStats:
    """Writes one recording to a path that all workers share. Tasks write the packed chunks of their rows beside it, and one task puts these together, a block at a time; the
    driver gets a row a chunk, without bytes. Where workers can't open the path, the chunks go through the driver as in ``export``."""
    spark = next(iter(frames.values())).sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    path = system.makeQualified(place).toString()
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        stream = system.create(place)

        class Pipe:
            def write(self, part: bytes) -> None:
                stream.write(bytearray(part))

            def flush(self) -> None:
                stream.flush()

        stats = export(frames, Pipe(), encoding, compression, metadata)
        stream.close()
        return stats
    folder = f"{path}.{uuid.uuid4().hex}"
    ordered, schemas, channels = _described(frames, encoding, metadata)
    try:
        rows = sorted(_framed(ordered, len(frames), compression, folder).drop("bytes").collect(), key=lambda r: (r.part, r.turn))  # a row a chunk
        counts = sum((np.array(r.counts, np.int64) for r in rows), np.zeros(len(frames), np.int64))
        index = [Indexed(r.size, r.low, r.high, r.small, r.plain) for r in rows]
        names = list(dict.fromkeys(r.name for r in rows))
        head, end = opening(schemas, channels), closing(schemas, channels, index, dict(enumerate(counts.tolist())), compression)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _ in range(batch.num_rows):
                    to, own = opened(folder)
                    to.create_dir(own, recursive=True)
                    whole = f"{own}/whole-{uuid.uuid4().hex}"
                    with to.open_output_stream(whole) as out:
                        out.write(head)
                        for name in names:
                            with to.open_input_stream(f"{own}/{name}") as part:
                                while block := part.read(BLOCK_BYTES):
                                    out.write(block)
                        out.write(end)
                    to.move(whole, opened(path)[1])
            yield from ()

        spark.range(1).coalesce(1).mapInArrow(run, "id long").collect()  # no rows
    finally:
        ordered.unpersist()
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
    return _stats(frames, counts)
