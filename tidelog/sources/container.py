"""The MCAP container: records of opcode, length and body, chunked and compressed; by its public layout.

Written files end with a summary: schemas, channels, an index of the chunks with their times, and statistics. A
reader that has it reads ranges of chunks, others go through the records from the start.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard

from tidelog.errors import CorruptFile, UnsupportedFormat

MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, STATISTICS, DATA_END = 1, 2, 3, 4, 5, 6, 8, 11, 15
FOOTER_BYTES = 9 + 20 + len(MAGIC)
HEAD = np.dtype([("channel", "<u2"), ("sequence", "<u4"), ("log", "<u8"), ("publish", "<u8")])
RECORD = np.dtype([("opcode", "u1"), ("length", "<u8"), *HEAD.descr])
CHUNK_BYTES, BLOCK_BYTES = 1 << 20, 4 << 20


@dataclass
class Schema:
    id: int
    name: str
    encoding: str
    data: bytes


@dataclass
class Channel:
    id: int
    schema_id: int
    topic: str
    message_encoding: str
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Message:
    channel_id: int
    sequence: int
    log_time: int
    publish_time: int
    data: bytes


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


def _record(opcode: int, body: bytes) -> bytes:
    return struct.pack("<BQ", opcode, len(body)) + body


def _schema_record(s: Schema) -> bytes:
    return _record(SCHEMA, struct.pack("<H", s.id) + _text(s.name) + _text(s.encoding) + struct.pack("<I", len(s.data)) + s.data)


def _channel_record(c: Channel) -> bytes:
    pairs = b"".join(_text(k) + _text(v) for k, v in c.metadata.items())
    return _record(CHANNEL, struct.pack("<HH", c.id, c.schema_id) + _text(c.topic) + _text(c.message_encoding) + struct.pack("<I", len(pairs)) + pairs)


@dataclass
class Indexed:
    """A written chunk: its record's size, the first and last time in it, and its payload's size packed and plain."""

    size: int
    low: int
    high: int
    small: int
    plain: int


def opening(schemas: list[Schema], channels: list[Channel]) -> bytes:
    """The parts of a file before its chunks."""
    return MAGIC + _record(HEADER, _text("") + _text("tidelog")) + _described(schemas, channels)


def _described(schemas: list[Schema], channels: list[Channel]) -> bytes:
    return b"".join([*map(_schema_record, schemas), *map(_channel_record, channels)])


def chunk_record(body: bytes, low: int, high: int, compression: str = "zstd") -> tuple[bytes, Indexed]:
    """A chunk of message records."""
    small = zstandard.compress(body) if compression == "zstd" else pa.Codec("lz4").compress(body, asbytes=True) if compression == "lz4" else body
    out = _record(CHUNK, struct.pack("<QQQI", low, high, len(body), zlib.crc32(body)) + _text(compression) + struct.pack("<Q", len(small)) + small)
    return out, Indexed(len(out), low, high, len(small), len(body))


def closing(schemas: list[Schema], channels: list[Channel], index: list[Indexed], counts: Mapping[int, int], compression: str = "zstd") -> bytes:
    """The parts of a file behind its chunks, which follow ``opening`` without gaps; ``counts``: messages by channel."""
    place, entries = len(opening(schemas, channels)), []
    for c in index:
        entries.append(_record(CHUNK_INDEX, struct.pack("<QQQQIQ", c.low, c.high, place, c.size, 0, 0) + _text(compression) + struct.pack("<QQ", c.small, c.plain)))
        place += c.size
    end = _record(DATA_END, struct.pack("<I", 0))
    per_channel = b"".join(struct.pack("<HQ", c, n) for c, n in sorted(counts.items()) if n)
    statistics = struct.pack("<QHIIIIQQI", sum(counts.values()), len(schemas), len(channels), 0, 0, len(index), min((c.low for c in index), default=0), max((c.high for c in index), default=0), len(per_channel)) + per_channel
    summary = _described(schemas, channels) + b"".join(entries) + _record(STATISTICS, statistics)
    footer = struct.pack("<BQQQ", FOOTER, 20, place + len(end), 0)
    return end + summary + footer + struct.pack("<I", zlib.crc32(summary + footer)) + MAGIC


def pack(schemas: Iterable[Schema], channels: Iterable[Channel], messages: Iterable[Message], compression: str = "zstd", chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The parts of a file, in order; messages go to chunks as they come."""
    schemas, channels = list(schemas), list(channels)
    yield opening(schemas, channels)
    index, counts = [], Counter()
    held, low, high = bytearray(), 1 << 64, 0

    def chunk() -> bytes:
        out, entry = chunk_record(bytes(held), low, high, compression)
        index.append(entry)
        return out

    for m in messages:
        held += _record(MESSAGE, struct.pack("<HIQQ", m.channel_id, m.sequence, m.log_time, m.publish_time) + m.data)
        low, high = min(low, m.log_time), max(high, m.log_time)
        counts[m.channel_id] += 1
        if len(held) >= chunk_bytes:
            yield chunk()
            held, low, high = bytearray(), 1 << 64, 0
    if held:
        yield chunk()
    yield closing(schemas, channels, index, counts, compression)


def message_records(channel: np.ndarray, sequence: np.ndarray, log: np.ndarray, publish: np.ndarray, payloads: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The sizes of message records, and their bytes: each one's head and payload in turn."""
    for values, top in ((channel, 1 << 16), (sequence, 1 << 32), (log, 1 << 63), (publish, 1 << 63)):
        if len(values) and not 0 <= values.min() <= values.max() < top:
            raise UnsupportedFormat("a channel, sequence or time out of range")
    heads = np.empty(len(payloads), RECORD)
    heads["opcode"], heads["length"] = MESSAGE, np.fromiter(map(len, payloads), np.int64, len(payloads)) + HEAD.itemsize
    heads["channel"], heads["sequence"], heads["log"], heads["publish"] = channel, sequence, log, publish
    raw, size = heads.tobytes(), RECORD.itemsize
    return heads["length"].astype(np.int64) + 9, [x for i, p in enumerate(payloads) for x in (raw[i * size : (i + 1) * size], p)]


@dataclass
class Summary:
    """What the end of a file tells: its schemas and channels, and (place, size, first, last time) of its chunks."""

    schemas: dict[int, Schema]
    channels: dict[int, Channel]
    chunks: list[tuple[int, int, int, int]]


def read_summary(size: int, read: Callable[[int, int], bytes]) -> Summary | None:
    """The summary of a file of ``size`` bytes, of which ``read`` gives (place, length); None where there is none or it has no chunk index."""
    if size < len(MAGIC) + FOOTER_BYTES:
        return None
    tail = read(size - FOOTER_BYTES, FOOTER_BYTES)
    opcode, length, start = struct.unpack_from("<BQQ", tail)
    if not tail.endswith(MAGIC) or opcode != FOOTER or length != 20 or not 0 < start < size:
        return None
    unpacker = Unpacker(MAGIC + read(start, size - FOOTER_BYTES - start))
    unpacker.finish()
    return Summary(unpacker.schemas, unpacker.channels, unpacker.chunks) if unpacker.chunks else None


class Unpacker:
    """Reads the records of a file; ``schemas`` and ``channels`` fill up on the way. A file that breaks off ends
    where it does. ``since`` and ``until`` (log times, both included) pass over chunks wholly outside."""

    def __init__(self, data: bytes, topics: set[str] | None = None, since: int = 0, until: int = 1 << 63, known: Summary | None = None):
        self.topics, self.since, self.until = topics, since, until
        self.schemas: dict[int, Schema] = dict(known.schemas) if known else {}
        self.channels: dict[int, Channel] = dict(known.channels) if known else {}
        self.chunks: list[tuple[int, int, int, int]] = []
        if not known and data and data[: len(MAGIC)] != MAGIC:
            raise UnsupportedFormat("not an MCAP file")
        self.data = memoryview(data)[0 if known else len(MAGIC) :]

    def messages(self) -> Iterator[Message]:
        for heads, payloads in self.blocks():
            for channel, sequence, log, publish, data in zip(*(heads[n].tolist() for n in HEAD.names), payloads.to_pylist()):
                yield Message(channel, sequence, log, publish, data)

    def finish(self) -> None:
        for _ in self.blocks():
            pass

    def blocks(self) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Heads and payloads of the messages wanted, a chunk at a time."""
        yield from self._walk(self.data)

    def _walk(self, data: memoryview) -> Iterator[tuple[np.ndarray, pa.Array]]:
        at, size, starts, ends = 0, len(data), [], []
        unpack = struct.Struct("<BQ").unpack_from
        while at + 9 <= size:
            opcode, length = unpack(data, at)
            start, at = at + 9, at + 9 + length
            if at > size or opcode == FOOTER:
                break
            if opcode == MESSAGE:
                starts.append(start)
                ends.append(at)
                if at - starts[0] >= BLOCK_BYTES:  # messages outside of chunks come in blocks too
                    yield from self._block(data, starts, ends)
                    starts, ends = [], []
                continue
            body = data[start:at]
            if opcode == CHUNK:
                if starts:
                    yield from self._block(data, starts, ends)
                    starts, ends = [], []
                low, high, plain, check = struct.unpack_from("<QQQI", body)
                name, k = self._string(body, 28)
                if high >= self.since and low <= self.until:
                    records = self._plain(name, body[k + 8 :], plain)
                    if check and zlib.crc32(records) != check:
                        raise CorruptFile("a chunk's check sum differs")
                    yield from self._walk(memoryview(records))
            elif opcode == CHUNK_INDEX:
                low, high, place, length = struct.unpack_from("<QQQQ", body)
                self.chunks.append((place, length, low, high))
            elif opcode == SCHEMA:
                (i,) = struct.unpack_from("<H", body)
                name, k = self._string(body, 2)
                encoding, k = self._string(body, k)
                self.schemas[i] = Schema(i, name, encoding, bytes(body[k + 4 :]))
            elif opcode == CHANNEL:
                i, schema = struct.unpack_from("<HH", body)
                topic, k = self._string(body, 4)
                encoding, k = self._string(body, k)
                (length,) = struct.unpack_from("<I", body, k)
                k, end, pairs = k + 4, k + 4 + length, {}
                while k < end:
                    key, k = self._string(body, k)
                    pairs[key], k = self._string(body, k)
                self.channels[i] = Channel(i, schema, topic, encoding, pairs)
        if starts:
            yield from self._block(data, starts, ends)

    def _block(self, data: memoryview, starts: list[int], ends: list[int]) -> Iterator[tuple[np.ndarray, pa.Array]]:
        raw = np.frombuffer(data, np.uint8)
        start, end = np.array(starts, np.int64), np.array(ends, np.int64)
        heads = raw[start[:, None] + np.arange(HEAD.itemsize)].view(HEAD).reshape(-1)
        wanted = np.array([i for i, c in self.channels.items() if self.topics is None or c.topic in self.topics], np.int64)
        kept = np.flatnonzero(np.isin(heads["channel"], wanted) & (heads["log"] >= self.since) & (heads["log"] <= self.until))
        if len(kept):
            first, sizes = start[kept] + HEAD.itemsize, end[kept] - start[kept] - HEAD.itemsize
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            values = raw[np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])]  # pyarrow keeps memoryviews that an array is made of
            yield heads[kept], pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])

    @staticmethod
    def _string(body: memoryview, at: int) -> tuple[str, int]:
        (size,) = struct.unpack_from("<I", body, at)
        return bytes(body[at + 4 : at + 4 + size]).decode(), at + 4 + size

    @staticmethod
    def _plain(name: str, data: memoryview, size: int) -> bytes:
        if name == "":
            return bytes(data)
        if name == "zstd":
            return zstandard.ZstdDecompressor().decompress(bytes(data), max_output_size=size)
        if name == "lz4":
            return pa.Codec("lz4").decompress(bytes(data), size, asbytes=True)
        raise UnsupportedFormat(f"chunk compression {name}")
