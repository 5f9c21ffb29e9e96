"""Protocol Buffers payloads: descriptor sets to Spark schemas and back, and a codec compiled from them.

Repeated fields become arrays, maps arrays of (key, value), enums int32, well-known times nanoseconds.
Unset scalars take their default, unset messages and ``optional`` scalars are null. Messages without
fields are left out, as in the other encodings; types that hold themselves are rejected.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

from tidelog.errors import InvalidDefinition, UnexpectedEnd, UnresolvedType, UnsupportedEncoding

#: Field types of the public descriptor format, by number: name, Spark type, struct code of fixed width.
KINDS = {
    1: ("double", T.DoubleType(), "d"), 2: ("float", T.FloatType(), "f"), 3: ("int64", T.LongType(), ""), 4: ("uint64", T.DecimalType(20, 0), ""), 5: ("int32", T.IntegerType(), ""),
    6: ("fixed64", T.DecimalType(20, 0), "Q"), 7: ("fixed32", T.LongType(), "I"), 8: ("bool", T.BooleanType(), ""), 9: ("string", T.StringType(), ""), 11: ("message", None, ""),
    12: ("bytes", T.BinaryType(), ""), 13: ("uint32", T.LongType(), ""), 14: ("enum", T.IntegerType(), ""), 15: ("sfixed32", T.IntegerType(), "i"), 16: ("sfixed64", T.LongType(), "q"),
    17: ("sint32", T.IntegerType(), ""), 18: ("sint64", T.LongType(), ""),
}
WELL_KNOWN = {"google.protobuf.Timestamp": "time", "google.protobuf.Duration": "duration"}
#: The field type written for a Spark type, and the wire names that choose another.
FROM_SPARK = {"boolean": 8, "tinyint": 5, "smallint": 5, "int": 5, "bigint": 3, "float": 2, "double": 1, "string": 9, "binary": 12, "decimal(20,0)": 4}
FROM_WIRE = {"uint8": 13, "uint16": 13, "uint32": 13, "uint64": 4}
MESSAGE, BILLION, U64 = 11, 1_000_000_000, (1 << 64) - 1


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while shift < 70:
        if at >= len(data):
            raise UnexpectedEnd("a varint breaks off")
        out |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return out & U64, at
    raise UnsupportedEncoding("varint of more than 10 bytes")


def varint(value: int) -> bytes:
    value, out = value & U64, bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def parts(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field; fixed widths stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size, at = _varint(data, at) if wire == 2 else ((8, 4)[wire == 5], at)
            value, at = data[at : at + size], at + size
            if at > len(data):
                raise UnexpectedEnd(f"{at - len(data)} bytes are missing")
        else:
            raise UnsupportedEncoding(f"wire type {wire}")
        yield tag >> 3, wire, value


def _part(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


@dataclass(frozen=True)
class ProtoField:
    name: str
    number: int
    kind: int
    type_name: str
    repeated: bool
    optional: bool


class Descriptors:
    """The messages of a serialised FileDescriptorSet, by full name."""

    def __init__(self, data: bytes):
        self.messages: dict[str, list[ProtoField]] = {}
        self.maps: set[str] = set()
        for number, _, file in parts(data):
            if number == 1:
                held = list(parts(file))
                package = next((v.decode() for n, _, v in held if n == 2), "")
                for n, _, v in held:
                    if n == 4:
                        self._message(package, v)

    def _message(self, scope: str, data: bytes) -> None:
        held = list(parts(data))
        name = ".".join(x for x in (scope, next((v.decode() for n, _, v in held if n == 1), "")) if x)
        self.messages[name] = [self._field(v) for n, _, v in held if n == 2]
        if any(n == 7 and any(k == 7 and on for k, _, on in parts(v)) for n, _, v in held):
            self.maps.add(name)
        for n, _, v in held:
            if n == 3:
                self._message(name, v)

    @staticmethod
    def _field(data: bytes) -> ProtoField:
        held = {n: v for n, _, v in parts(data)}
        return ProtoField(held[1].decode(), held[3], held.get(5, 0), held.get(6, b"").decode().lstrip("."), held.get(4) == 3, bool(held.get(17)))

    def get(self, name: str) -> list[ProtoField]:
        if name.lstrip(".") not in self.messages:
            raise UnresolvedType(name)
        return self.messages[name.lstrip(".")]

    def fields(self, name: str, above: tuple[str, ...] = ()) -> list[ProtoField]:
        """The fields that are columns."""
        if name in above:
            raise InvalidDefinition(f"{name} holds itself")
        for f in self.get(name):
            if f.kind not in KINDS:
                raise UnsupportedEncoding(f"{f.name}: field type {f.kind}")
        return [f for f in self.get(name) if f.kind != MESSAGE or f.type_name in WELL_KNOWN or self.fields(f.type_name, (*above, name))]


def spark_schema(name: str, held: Descriptors) -> T.StructType:
    out = []
    for f in held.fields(name):
        label, kind, _ = KINDS[f.kind]
        meta: dict = {"proto": label, "number": f.number}
        if f.type_name in WELL_KNOWN:
            kind, meta["wire"] = T.LongType(), WELL_KNOWN[f.type_name]
        elif f.kind == MESSAGE:
            kind, meta["message"] = spark_schema(f.type_name, held), f.type_name
        elif label in FROM_WIRE:
            meta["wire"] = label
        if f.type_name in held.maps:
            meta["map"] = True
        if f.repeated:
            kind, meta["array"] = T.ArrayType(kind), 0
        out.append(T.StructField(f.name, kind, True, meta))
    return T.StructType(out)


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


#: How a varint becomes a value, and a value a varint, for the types that aren't plain.
FROM_VARINT: dict[int, Callable] = {3: lambda v: _signed(v, 64), 4: Decimal, 5: lambda v: _signed(v, 32), 8: bool, 13: lambda v: v & 0xFFFFFFFF, 14: lambda v: _signed(v, 32), 17: lambda v: _signed(v >> 1 ^ -(v & 1), 32), 18: lambda v: _signed(v >> 1 ^ -(v & 1), 64)}
TO_VARINT: dict[int, Callable] = {17: lambda v: v << 1 ^ v >> 31, 18: lambda v: v << 1 ^ v >> 63}


class ProtoCodec:
    """A message type's compiled plan."""

    def __init__(self, name: str, held: Descriptors):
        self.name, self.held = name, held
        self.fields = held.fields(name)
        self.by_number = {f.number: (f, self._reader(f, held)) for f in self.fields}
        self.writers = [(f, self._writer(f, held)) for f in self.fields]

    @staticmethod
    def _reader(f: ProtoField, held: Descriptors) -> Callable:
        code = KINDS[f.kind][2]
        if f.type_name in WELL_KNOWN:

            def read_time(raw: bytes) -> int:
                got = {n: v for n, _, v in parts(raw)}
                return _signed(got.get(1, 0), 64) * BILLION + _signed(got.get(2, 0), 32)

            return read_time
        if f.kind == MESSAGE:
            return ProtoCodec(f.type_name, held).decode
        if code:
            unpack = struct.Struct("<" + code).unpack
            return (lambda raw: Decimal(unpack(raw)[0])) if code == "Q" else lambda raw: unpack(raw)[0]
        if f.kind == 9:
            return lambda raw: raw.decode("utf-8")
        return bytes if f.kind == 12 else FROM_VARINT[f.kind]

    @staticmethod
    def _writer(f: ProtoField, held: Descriptors) -> Callable:
        code = KINDS[f.kind][2]
        if f.type_name in WELL_KNOWN:
            return lambda v: _part(f.number, _part(1, v // BILLION) + _part(2, v % BILLION))
        if f.kind == MESSAGE:
            inner = ProtoCodec(f.type_name, held)
            return lambda v: _part(f.number, inner.encode(v))
        if code:
            tag = varint(f.number << 3 | (1 if struct.calcsize("<" + code) == 8 else 5))
            return lambda v: tag + struct.pack("<" + code, int(v) if code == "Q" else v)
        if f.kind in (9, 12):
            return lambda v: _part(f.number, v if f.kind == 9 else bytes(v))
        change = TO_VARINT.get(f.kind, int)
        return lambda v: _part(f.number, int(change(v)))

    def decode(self, data: bytes) -> dict:
        row = {f.name: [] if f.repeated else self._unset(f) for f in self.fields}
        for number, wire, value in parts(data):
            if number not in self.by_number:
                continue
            f, read = self.by_number[number]
            code = KINDS[f.kind][2]
            if f.repeated and wire == 2 and f.kind not in (9, MESSAGE, 12):
                row[f.name] += self._packed(value, code, read)
                continue
            if wire != (2 if f.kind in (9, MESSAGE, 12) else 0 if not code else 1 if struct.calcsize("<" + code) == 8 else 5):
                raise UnsupportedEncoding(f"{f.name}: wire type {wire}")
            if f.repeated:
                row[f.name].append(read(value))
            else:
                row[f.name] = read(value)
        return row

    @staticmethod
    def _packed(data: bytes, code: str, read: Callable) -> list:
        if code:
            size = struct.calcsize("<" + code)
            if len(data) % size:
                raise UnexpectedEnd("packed values break off")
            return [read(data[i : i + size]) for i in range(0, len(data), size)]
        out, at = [], 0
        while at < len(data):
            value, at = _varint(data, at)
            out.append(read(value))
        return out

    @staticmethod
    def _unset(f: ProtoField) -> object:
        if f.optional or f.kind == MESSAGE:
            return None
        return {"string": "", "bytes": b"", "bool": False, "double": 0.0, "float": 0.0, "uint64": Decimal(0), "fixed64": Decimal(0)}.get(KINDS[f.kind][0], 0)

    def encode(self, row: dict) -> bytes:
        """Nulls are left out; defaults are written; repeated fields aren't packed."""
        out = []
        for f, write in self.writers:
            value = row[f.name]
            if value is not None:
                out += [write(v) for v in value] if f.repeated else [write(value)]
        return b"".join(out)

    def columns(self, payloads: list[bytes]) -> dict[str, list]:
        rows = [self.decode(p) for p in payloads]
        return {f.name: [r[f.name] for r in rows] for f in self.fields}


def _kind(f: T.StructField, item: T.DataType) -> int:
    kind = FROM_WIRE.get(f.metadata.get("wire", "")) or FROM_SPARK.get(item.simpleString())
    if kind is None:
        raise InvalidDefinition(f"no field type for {item.simpleString()}")
    return kind


def descriptor_set(schema: T.StructType, root: str) -> bytes:
    """A FileDescriptorSet of a Spark schema; nested types are declared inside the type that holds them.
    Unlike plain proto3, scalars are ``optional``, so nulls survive."""
    package, _, name = root.rpartition(".")

    def message(struct_: T.StructType, name: str, full: str) -> bytes:
        out, nested = _part(1, name), b""
        for number, f in enumerate(struct_.fields, 1):
            array = isinstance(f.dataType, T.ArrayType)
            item = f.dataType.elementType if array else f.dataType
            body = _part(1, f.name) + _part(3, number) + _part(4, 3 if array else 1)
            if isinstance(item, T.StructType):
                inner = f"T{number}_{f.name}"
                nested += _part(3, message(item, inner, f"{full}.{inner}"))
                body += _part(5, MESSAGE) + _part(6, f".{full}.{inner}")
            else:
                body += _part(5, _kind(f, item)) + (b"" if array else _part(17, 1))
            out += _part(2, body)
        return out + nested

    return _part(1, _part(1, f"{name}.proto") + _part(2, package) + _part(4, message(schema, name, root)) + _part(12, "proto3"))


def proto_text(schema: T.StructType, name: str) -> str:
    """The proto3 text of a flat schema."""
    lines = []
    for number, f in enumerate(schema.fields, 1):
        array = isinstance(f.dataType, T.ArrayType)
        item = f.dataType.elementType if array else f.dataType
        if isinstance(item, (T.StructType, T.ArrayType)):
            raise InvalidDefinition(f"{f.name}: nested types have no text form here")
        lines.append(f"  {'repeated ' * array}{KINDS[_kind(f, item)][0]} {f.name} = {number};")
    return "\n".join(['syntax = "proto3";', "", f"message {name} {{", *lines, "}", ""])
