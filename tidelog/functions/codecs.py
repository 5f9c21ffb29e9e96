"""Payload codecs: definitions compiled once to plans that decode to, or encode from, Python rows.

``packed`` is the unaligned little-endian form (lengths before strings and open arrays, none before fixed
ones); ``cdr`` has a 4-byte head, whose second byte tells the byte order, natural alignment counted from behind it, and
strings that end in NUL.

A batch is decoded and encoded column by column: each row's place in its payload is one number of an array, a field's values are gathered from
(or scattered to) all places at once, and the places move on. Items whose size varies, and structs in ``cdr`` arrays, are taken first
item by first item, second by second. Big-endian payloads are read one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.errors import UnexpectedEnd, UnsupportedEncoding
from tidelog.functions.definitions import PRIMITIVES, Registry, is_empty, spark_schema

#: Struct codes and sizes of the numeric types.
CODES = {"bool": "B", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float32": "f", "float64": "d"}
BILLION = 1_000_000_000


class _Reader:
    def __init__(self, data: bytes, cdr: bool):
        self.data, self.cdr, self.at, self.origin, self.order = data, cdr, 0, 0, "<"
        if cdr:
            if len(data) < 4:
                raise UnexpectedEnd("no encapsulation head")
            self.at = self.origin = 4
            self.order = "<" if data[1] & 1 else ">"

    def numbers(self, code: str, count: int) -> tuple:
        size = struct.calcsize("<" + code)
        if self.cdr:
            self.at += -(self.at - self.origin) % size
        end = self.at + size * count
        if end > len(self.data):
            raise UnexpectedEnd(f"{end - len(self.data)} bytes are missing")
        out = struct.unpack_from(f"{self.order}{count}{code}", self.data, self.at)
        self.at = end
        return out

    def raw(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise UnexpectedEnd(f"{self.at + size - len(self.data)} bytes are missing")
        self.at += size
        return self.data[self.at - size : self.at]

    def text(self) -> str:
        raw = self.raw(self.numbers("I", 1)[0])
        return (raw.rstrip(b"\0") if self.cdr else raw).decode("utf-8")


class _Writer:
    def __init__(self, cdr: bool):
        self.out, self.cdr = bytearray(b"\0\1\0\0" if cdr else b""), cdr

    def numbers(self, code: str, values: tuple | list) -> None:
        if self.cdr:
            self.out += bytes(-(len(self.out) - 4) % struct.calcsize("<" + code))
        self.out += struct.pack(f"<{len(values)}{code}", *values)

    def text(self, value: str) -> None:
        raw = value.encode() + b"\0" * self.cdr
        self.numbers("I", (len(raw),))
        self.out += raw


def _one(base: str, registry: Registry, cdr: bool) -> tuple[Callable, Callable]:
    """(read, write) of one value of a type."""
    if base == "string":
        return _Reader.text, _Writer.text
    if base == "bool":
        return lambda r: r.numbers("B", 1)[0] != 0, lambda w, v: w.numbers("B", (int(v),))
    if base == "uint64":
        return lambda r: Decimal(r.numbers("Q", 1)[0]), lambda w, v: w.numbers("Q", (int(v),))
    if base in CODES:
        code = CODES[base]
        return lambda r: r.numbers(code, 1)[0], lambda w, v: w.numbers(code, (v,))
    if base in ("time", "duration"):
        signed, nano = base == "duration" or cdr, "I" if cdr or base == "time" else "i"

        def read_time(r: _Reader) -> int:
            return r.numbers("i" if signed else "I", 1)[0] * BILLION + r.numbers(nano, 1)[0]

        def write_time(w: _Writer, v: int) -> None:
            w.numbers("i" if signed else "I", (v // BILLION,))
            w.numbers(nano, (v % BILLION,))

        return read_time, write_time
    plan = _plan(base, registry, cdr)
    return lambda r: {n: read(r) for n, read, _ in plan}, lambda w, v: [write(w, v[n]) for n, _, write in plan]


def _plan(name: str, registry: Registry, cdr: bool) -> list[tuple[str, Callable, Callable]]:
    out = []
    for f in registry.get(name).fields:
        if f.base not in PRIMITIVES and is_empty(f.base, registry):
            if f.array and f.size is None:
                raise UnsupportedEncoding(f"{f.name}: open array of an empty type")
            continue
        read, write = _one(f.base, registry, cdr)
        if f.array:
            read, write = _array(f.base, f.size, read, write)
        out.append((f.name, read, write))
    return out


def _array(base: str, size: int | None, read: Callable, write: Callable) -> tuple[Callable, Callable]:
    def read_all(r: _Reader):
        n = r.numbers("I", 1)[0] if size is None else size
        if base == "uint8":
            return r.raw(n)
        if base in CODES and base not in ("bool", "uint64"):
            return list(r.numbers(CODES[base], n)) if n else []
        return [read(r) for _ in range(n)]

    def write_all(w: _Writer, values) -> None:
        if size is None:
            w.numbers("I", (len(values),))
        elif len(values) != size:
            raise ValueError(f"{len(values)} values for an array of {size}")
        if base == "uint8":
            w.out += bytes(values)
        elif base in CODES and base not in ("bool", "uint64"):
            if len(values):
                w.numbers(CODES[base], [*values])
        else:
            for v in values:
                write(w, v)

    return read_all, write_all


class _Node:
    """A field's type compiled for batches: its kind, its Arrow type, the size of its values in packed form if fixed, and its parts."""

    def __init__(self, base: str, registry: Registry, cdr: bool, kind: pa.DataType, array: bool = False, size: int | None = None):
        self.base, self.cdr, self.type, self.count, self.item, self.fields = base, cdr, kind, size, None, []
        if array and base == "uint8":
            self.kind, self.size = "bytes", size
        elif array:
            self.kind, self.item = "array", _Node(base, registry, cdr, kind.value_type)
            self.size = size * self.item.size if size is not None and self.item.size is not None else None
        elif base == "string":
            self.kind, self.size = "string", None
        elif base in ("time", "duration"):
            self.kind, self.size = "time", 8
            self.codes = ("<i4" if base == "duration" or cdr else "<u4", "<u4" if cdr or base == "time" else "<i4")
        elif base in CODES:
            self.kind, self.dtype = "number", np.dtype("<" + CODES[base])
            self.size = self.dtype.itemsize
        else:
            self.kind = "struct"
            there = {kind.field(i).name: kind.field(i).type for i in range(kind.num_fields)}
            self.fields = [(f.name, _Node(f.base, registry, cdr, there[f.name], f.array, f.size)) for f in registry.get(base).fields if f.name in there]
            sizes = [n.size for _, n in self.fields]
            self.size = None if None in sizes else sum(sizes)
        self.flat = self.kind in ("number", "time")
        self.align = 4 if self.kind == "time" else self.size if self.kind == "number" else 1


def _each(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of each range, one range behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(at - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _cut(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one behind the other."""
    total = int(lengths.sum())
    if total > 256 * max(1, len(at)):
        return np.concatenate([data[a : a + n] for a, n in zip(at.tolist(), lengths.tolist())])
    return data[_each(at, lengths)]


def _offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    if out[-1] >= 1 << 31:
        raise UnsupportedEncoding("over 2 GB in one column of a batch")
    return out.astype(np.int32)


def _decimals(values: np.ndarray) -> pa.Array:
    wide = np.zeros((len(values), 2), np.uint64)
    wide[:, 0] = values
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(values), [None, pa.py_buffer(wide)])


class _Batch:
    """Payloads behind one another, with each row's end and the origin of its alignment."""

    def __init__(self, data: np.ndarray, origin: np.ndarray, end: np.ndarray, cdr: bool):
        self.data, self.origin, self.end, self.cdr = data, origin, end, cdr

    def rows(self, places: np.ndarray) -> _Batch:
        return _Batch(self.data, self.origin[places], self.end[places], self.cdr)

    def aligned(self, at: np.ndarray, size: int) -> np.ndarray:
        return at + -(at - self.origin) % size if self.cdr and size > 1 else at

    def need(self, at: np.ndarray, size: int | np.ndarray) -> None:
        missing = at + size - self.end
        if len(missing) and missing.max() > 0:
            raise UnexpectedEnd(f"{missing.max()} bytes are missing")

    def raw(self, at: np.ndarray, size: int) -> np.ndarray:
        self.need(at, size)
        return self.data[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), np.uint8)

    def lengths(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.aligned(at, 4)
        return self.raw(at, 4).view("<u4").reshape(-1).astype(np.int64), at + 4

    def read(self, node: _Node, at: np.ndarray, build: bool = True) -> tuple[pa.Array | None, np.ndarray]:
        """A field's values of all rows, and the places behind them; without ``build`` the places only."""
        if node.flat:
            at = self.aligned(at, node.align)
            if not build:
                self.need(at, node.size)
                return None, at + node.size
            return self.values(node, self.raw(at, node.size)), at + node.size
        if node.kind in ("string", "bytes"):
            if node.kind == "bytes" and node.count is not None:
                lengths = np.full(len(at), node.count, np.int64)
            else:
                lengths, at = self.lengths(at)
            self.need(at, lengths)
            return self.texts(node, at, lengths) if build else None, at + lengths
        if node.kind == "array":
            return self.array(node, at, build)
        parts = []
        for _, field in node.fields:
            part, at = self.read(field, at, build)
            parts.append(part)
        return pa.StructArray.from_arrays(parts, fields=[*node.type]) if build else None, at

    def values(self, node: _Node, raw: np.ndarray) -> pa.Array:
        if node.kind == "time":
            pairs = raw.reshape(-1, 8)
            high, low = (np.ascontiguousarray(pairs[:, i : i + 4]).view(c).reshape(-1).astype(np.int64) for i, c in zip((0, 4), node.codes))
            return pa.array(high * BILLION + low)
        values = np.ascontiguousarray(raw).reshape(-1).view(node.dtype)
        if node.base == "uint64":
            return _decimals(values)
        return pa.array(values != 0) if node.base == "bool" else pa.array(values).cast(node.type)

    def texts(self, node: _Node, at: np.ndarray, lengths: np.ndarray) -> pa.Array:
        if node.kind == "string" and self.cdr:  # NULs at the end aren't text
            lengths = lengths.copy()
            while len(ending := np.flatnonzero(lengths > 0)):
                ending = ending[self.data[at[ending] + lengths[ending] - 1] == 0]
                if not len(ending):
                    break
                lengths[ending] -= 1
        buffers = [None, pa.py_buffer(_offsets(lengths)), pa.py_buffer(np.ascontiguousarray(_cut(self.data, at, lengths)))]
        out = pa.Array.from_buffers(node.type, len(lengths), buffers)
        if node.kind == "string":
            out.validate(full=True)
        return out

    def array(self, node: _Node, at: np.ndarray, build: bool) -> tuple[pa.Array | None, np.ndarray]:
        item = node.item
        if node.count is None:
            counts, at = self.lengths(at)
            self.need(at, counts)  # an item has a byte at least
        else:
            counts = np.full(len(at), node.count, np.int64)
        if item.flat:
            at = np.where(counts > 0, self.aligned(at, item.align), at)
            self.need(at, counts * item.size)
            held = self.values(item, _cut(self.data, at, counts * item.size)) if build else None
            at = at + counts * item.size
        elif item.size is not None and not self.cdr:
            self.need(at, counts * item.size)
            rows = np.repeat(np.arange(len(at)), counts)
            held = self.rows(rows).read(item, at[rows] + (_each(np.zeros(len(at), np.int64), counts) * item.size))[0] if build else None
            at = at + counts * item.size
        else:
            starts, parts, places, at = np.cumsum(counts) - counts, [], [], at.copy()
            for k in range(int(counts.max(initial=0))):
                rows = np.flatnonzero(counts > k)
                part, at[rows] = self.rows(rows).read(item, at[rows], build)
                parts.append(part)
                places.append(starts[rows] + k)
            held = pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places)))) if parts and build else pa.array([], item.type)
        return pa.ListArray.from_arrays(pa.array(_offsets(counts)), held, type=node.type) if build else None, at


class _Layout:
    """Places fields of all rows: ``lay`` moves the places on, and writes where there is an output. Places are
    counted from each row's origin; ``base`` is where that origin lies."""

    def __init__(self, cdr: bool, base: np.ndarray, out: np.ndarray | None):
        self.cdr, self.base, self.out = cdr, base, out

    def rows(self, places: np.ndarray) -> _Layout:
        return _Layout(self.cdr, self.base[places], self.out)

    def aligned(self, at: np.ndarray, size: int) -> np.ndarray:
        return at + -at % size if self.cdr and size > 1 else at

    def put(self, at: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.out is not None:
            self.out[_each(self.base + at, lengths)] = data
        return at + lengths

    def lengths(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = self.aligned(at, 4)
        return self.put(at, counts.astype("<u4").view(np.uint8), np.full(len(at), 4))

    def lay(self, node: _Node, array: pa.Array, at: np.ndarray) -> np.ndarray:
        if array.null_count:
            raise ValueError(f"a null {node.kind} can't be encoded")
        if node.flat:
            at = self.aligned(at, node.align)
            return self.put(at, _bytes_of(node, array) if self.out is not None else np.zeros(0, np.uint8), np.full(len(at), node.size))
        if node.kind in ("string", "bytes"):
            array = array.cast(pa.binary()) if node.kind == "string" else array
            bounds = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
            held = np.frombuffer(array.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if array.buffers()[2] else np.zeros(0, np.uint8)
            lengths = np.diff(bounds)
            ending = int(node.kind == "string" and self.cdr)
            if node.kind == "string" or node.count is None:
                at = self.lengths(at, lengths + ending)
            elif (lengths != node.count).any():
                raise ValueError(f"{lengths.max()} values for an array of {node.count}")
            return self.put(at, held, lengths) + ending  # the output is made of NULs
        if node.kind == "array":
            return self.array(node, array, at)
        for i, (_, field) in enumerate(node.fields):
            at = self.lay(field, array.field(i), at)
        return at

    def array(self, node: _Node, array: pa.Array, at: np.ndarray) -> np.ndarray:
        item, bounds = node.item, array.offsets.to_numpy().astype(np.int64)
        counts = np.diff(bounds)
        values = array.values.slice(bounds[0], bounds[-1] - bounds[0])
        if node.count is None:
            at = self.lengths(at, counts)
        elif (counts != node.count).any():
            raise ValueError(f"{counts.max()} values for an array of {node.count}")
        if item.flat:
            if values.null_count:
                raise ValueError(f"a null {item.kind} can't be encoded")
            at = np.where(counts > 0, self.aligned(at, item.align), at)
            return self.put(at, _bytes_of(item, values) if self.out is not None else np.zeros(0, np.uint8), counts * item.size)
        rows = np.repeat(np.arange(len(at)), counts)
        if not self.cdr:
            sizes = _Layout(False, np.zeros(len(values), np.int64), None).lay(item, values, np.zeros(len(values), np.int64))
            sums = np.concatenate([[0], np.cumsum(sizes)])
            first = sums[bounds - bounds[0]]
            self.rows(rows).lay(item, values, at[rows] + sums[:-1] - first[:-1][rows])
            return at + np.diff(first)
        at = at.copy()
        for k in range(int(counts.max(initial=0))):
            some = np.flatnonzero(counts > k)
            at[some] = self.rows(some).lay(item, values.take(pa.array(bounds[some] - bounds[0] + k)), at[some])
        return at


def _bytes_of(node: _Node, array: pa.Array) -> np.ndarray:
    """Numbers or times as they are written."""
    if node.base == "uint64":
        wide = np.frombuffer(array.buffers()[1], np.uint64).reshape(-1, 2)[array.offset : array.offset + len(array)]
        if wide[:, 1].any():
            raise ValueError("not an unsigned 64-bit number")
        return np.ascontiguousarray(wide[:, 0]).view(np.uint8)
    values = array.to_numpy(zero_copy_only=False)
    if node.kind == "time":
        out = np.zeros((len(values), 8), np.uint8)
        for i, part, code in zip((0, 4), (values // BILLION, values % BILLION), node.codes):
            if len(part) and (part.min() < np.iinfo(code).min or part.max() > np.iinfo(code).max):
                raise ValueError(f"{node.base} out of range")
            out[:, i : i + 4] = np.ascontiguousarray(part.astype(code)).view(np.uint8).reshape(-1, 4)
        return out.reshape(-1)
    if node.dtype.kind in "iu" and node.base != "bool" and len(values) and (values.min() < np.iinfo(node.dtype).min or values.max() > np.iinfo(node.dtype).max):
        raise ValueError(f"{node.base} out of range")
    return np.ascontiguousarray(values.astype(node.dtype)).view(np.uint8)


class Codec:
    """A type's compiled plan in one encoding. ``wanted`` fields (all, if None) are decoded, the others passed over."""

    def __init__(self, name: str, registry: Registry, encoding: str, wanted: set[str] | None = None):
        if encoding not in ("packed", "cdr"):
            raise UnsupportedEncoding(encoding)
        self.cdr = encoding == "cdr"
        self.plan = _plan(name, registry, self.cdr)
        schema = spark_schema(name, registry)
        self.arrow = to_arrow_schema(schema)
        self.root = _Node(name, registry, self.cdr, pa.struct(list(self.arrow)))
        self.wanted = wanted

    def decode(self, data: bytes) -> dict:
        """One payload, field by field."""
        r = _Reader(data, self.cdr)
        return {n: read(r) for n, read, _ in self.plan}

    def encode(self, row: dict) -> bytes:
        w = _Writer(self.cdr)
        for n, _, write in self.plan:
            write(w, row[n])
        return bytes(w.out)

    def arrays(self, payloads: pa.Array) -> dict[str, pa.Array]:
        """All payloads by column."""
        payloads = payloads.cast(pa.binary())
        bounds = np.frombuffer(payloads.buffers()[1], np.int32)[payloads.offset : payloads.offset + len(payloads) + 1].astype(np.int64) if len(payloads) else np.zeros(1, np.int64)
        data = np.frombuffer(payloads.buffers()[2], np.uint8) if len(payloads) and payloads.buffers()[2] else np.zeros(0, np.uint8)
        at, end = bounds[:-1], bounds[1:]
        wanted = [n for n, _ in self.root.fields if self.wanted is None or n in self.wanted]
        if self.cdr:
            if len(at) and (end - at).min() < 4:
                raise UnexpectedEnd("no encapsulation head")
            if len(at) and not (data[at + 1] & 1).all():
                rows = [self.decode(p or b"") for p in payloads.to_pylist()]
                return {n: pa.array([r[n] for r in rows], self.arrow.field(n).type) for n in wanted}
            at = at + 4
        batch, out = _Batch(data, at, end, self.cdr), {}
        for n, node in self.root.fields:
            part, at = batch.read(node, at, n in wanted)
            if part is not None:
                out[n] = part
        return out

    def payloads(self, columns: list[pa.Array]) -> pa.Array:
        """Rows, given by column in the order of the fields, as payloads."""
        head = 4 if self.cdr else 0
        rows = len(columns[0]) if columns else 0
        columns = [c.cast(n.type) for c, (_, n) in zip(columns, self.root.fields)]
        sizes = self._laid(columns, _Layout(self.cdr, np.zeros(rows, np.int64), None), rows) + head
        bounds = _offsets(sizes)
        out = np.zeros(int(bounds[-1]), np.uint8)
        base = bounds[:-1].astype(np.int64)
        if self.cdr:
            out[base + 1] = 1
        self._laid(columns, _Layout(self.cdr, base + head, out), rows)
        return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(bounds), pa.py_buffer(out)])

    def _laid(self, columns: list[pa.Array], layout: _Layout, rows: int) -> np.ndarray:
        at = np.zeros(rows, np.int64)
        for column, (_, node) in zip(columns, self.root.fields):
            at = layout.lay(node, column, at)
        return at
