"""Protocol Buffers payloads of a whole batch, decoded and encoded column by column: the same bytes and values as ``protobuf.ProtoCodec``'s.

All payloads are walked together, a field of each at a time. What isn't plain (packed repeated fields, unsigned 64-bit numbers,
well-known times, payloads that don't decode) raises ``NotPlain`` or an error, and the caller takes the codec, payload by payload.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidelog.functions.protobuf import MESSAGE, WELL_KNOWN, Descriptors, ProtoField, varint

U8, U64, I64 = np.uint8, np.uint64, np.int64
#: Kinds whose bytes have a fixed width, and those of varints.
FIXED = {1: "<f8", 2: "<f4", 15: "<i4", 16: "<i8"}
VARINTS = {3: pa.int64(), 5: pa.int32(), 8: pa.bool_(), 13: pa.int64(), 14: pa.int32(), 17: pa.int32(), 18: pa.int64()}


class NotPlain(Exception):
    pass


def _varints(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, at, active = np.zeros(len(at), U64), at.copy(), np.arange(len(at))
    for shift in range(0, 70, 7):
        if not len(active):
            break
        if (at[active] >= end[active]).any():
            raise NotPlain("a varint breaks off")
        byte = raw[at[active]]
        out[active] |= (byte & U8(127)).astype(U64) << U64(shift)
        at[active] += 1
        active = active[byte > 127]
    if len(active):
        raise NotPlain("varint of more than 10 bytes")
    return out, at


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of slices, one after another."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    return offsets, raw[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]


def _wire(f: ProtoField) -> int:
    return 2 if f.kind in (9, MESSAGE, 12) else 0 if f.kind in VARINTS else {8: 1, 4: 5}[np.dtype(FIXED[f.kind]).itemsize]


def _plain(fields: list[ProtoField]) -> None:
    for f in fields:
        if f.type_name in WELL_KNOWN or not (f.kind in FIXED or f.kind in VARINTS or f.kind in (9, 12, MESSAGE)):
            raise NotPlain(f.name)


def decoded(payloads: pa.Array, name: str, held: Descriptors) -> dict[str, pa.Array]:
    """The columns of (large or plain) binary payloads without nulls."""
    if payloads.null_count:
        raise NotPlain("null payload")
    wide = payloads.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], I64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, I64)
    raw = np.frombuffer(wide.buffers()[2] or b"", U8) if len(wide) else np.zeros(0, U8)
    return _message(raw, offsets[:-1].copy(), offsets[1:].copy(), name, held)


def _message(raw: np.ndarray, start: np.ndarray, end: np.ndarray, name: str, held: Descriptors) -> dict[str, pa.Array]:
    fields = held.fields(name)
    _plain(fields)
    known, n = {f.number: f for f in fields}, len(start)
    found: dict[int, list[tuple[np.ndarray, ...]]] = {f.number: [] for f in fields}  # rows, values, places and sizes
    at, live = start.copy(), np.flatnonzero(start < end)
    while len(live):
        stop = end[live]
        tag, place = _varints(raw, at[live], stop)
        wire, number = tag & U64(7), (tag >> U64(3)).astype(I64)
        value, size = np.zeros(len(live), U64), np.zeros(len(live), I64)
        if not np.isin(wire, (0, 1, 2, 5)).all():
            raise NotPlain("wire type")
        size[wire == 1], size[wire == 5] = 8, 4
        for kind in (0, 2):
            own = np.flatnonzero(wire == kind)
            if len(own):
                got, place[own] = _varints(raw, place[own], stop[own])
                if kind == 0:
                    value[own] = got
                elif (got > U64(1 << 31)).any():
                    raise NotPlain("size")
                else:
                    size[own] = got.astype(I64)
        if (place + size > stop).any():
            raise NotPlain("bytes are missing")
        for k in np.unique(number).tolist():
            if k in known:
                own = np.flatnonzero(number == k)
                if (wire[own] != _wire(known[k])).any():
                    raise NotPlain("wire type")
                found[k].append((live[own], value[own], place[own], size[own]))
        at[live] = place + size
        live = live[at[live] < stop]
    return {f.name: _column(raw, n, f, held, found[f.number]) for f in fields}


def _column(raw: np.ndarray, n: int, f: ProtoField, held: Descriptors, found: list[tuple[np.ndarray, ...]]) -> pa.Array:
    row, value, place, size = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (I64, U64, I64, I64))
    if f.repeated:
        order = np.argsort(row, kind="stable")  # a row's values were found in their order
        item = _values(raw, f, held, value[order], place[order], size[order], None)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32()), item)
    seen, one, where, long = np.zeros(n, bool), np.zeros(n, U64), np.full(n, -1, I64), np.zeros(n, I64)
    seen[row], one[row], where[row], long[row] = True, value, place, size  # the last one holds
    return _values(raw, f, held, one, where, long, ~seen if f.optional or f.kind == MESSAGE else None)


def _values(raw: np.ndarray, f: ProtoField, held: Descriptors, value: np.ndarray, place: np.ndarray, size: np.ndarray, null: np.ndarray | None) -> pa.Array:
    if f.kind == MESSAGE:
        inner = _message(raw, np.maximum(place, 0), np.maximum(place, 0) + size, f.type_name, held)
        return pa.StructArray.from_arrays(list(inner.values()), names=list(inner), mask=None if null is None else pa.array(null))
    if f.kind in (9, 12):
        offsets, data = _gathered(raw, np.maximum(place, 0), size)
        valid = None if null is None else pa.array(~null).buffers()[1]
        out = pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        return out if f.kind == 12 else out.cast(pa.string())  # checks the text
    if f.kind in FIXED:
        kind = np.dtype(FIXED[f.kind])
        got = np.zeros(len(place), kind)
        own = np.flatnonzero(place >= 0)
        if len(own):
            got[own] = raw[place[own][:, None] + np.arange(kind.itemsize)].view(kind).reshape(-1)
        return pa.array(got, mask=null)
    if f.kind in (17, 18):
        value = value >> U64(1) ^ (U64(0) - (value & U64(1)))
    if f.kind == 8:
        return pa.array(value != 0, mask=null)
    if f.kind == 13:
        return pa.array((value & U64(0xFFFFFFFF)).astype(I64), mask=null)
    return pa.array((value & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) if f.kind in (5, 14, 17) else value.view(I64), mask=null)


def _joined(ragged: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of rows whose parts come one after another."""
    sizes = sum((s for s, _ in ragged), np.zeros(n, I64))
    at, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), U8)
    for size, data in ragged:
        out[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(data))] = data
        at = at + size
    return sizes, out


def _headed(tag: bytes, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of a tag and a varint."""
    size = np.ones(len(value), I64)
    for k in range(1, 10):
        size += value >= U64(1 << 7 * k)
    most = int(size.max()) if len(size) else 1
    cells = np.empty((len(value), len(tag) + most), U8)
    cells[:, : len(tag)] = np.frombuffer(tag, U8)
    for k in range(most):
        cells[:, len(tag) + k] = (value >> U64(7 * k) & U64(127)).astype(U8) | np.where(size > k + 1, U8(128), U8(0))
    size = size + len(tag)
    return size, cells[np.arange(cells.shape[1]) < size[:, None]]


def _items(f: ProtoField, column: pa.Array, held: Descriptors) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of values without nulls, each with its tag."""
    n = len(column)
    if f.kind in FIXED:
        kind = np.dtype(FIXED[f.kind])
        tag = varint(f.number << 3 | _wire(f))
        cells = np.empty((n, len(tag) + kind.itemsize), U8)
        cells[:, : len(tag)] = np.frombuffer(tag, U8)
        cells[:, len(tag) :] = np.ascontiguousarray(column.to_numpy(zero_copy_only=False).astype(kind, casting="safe")).view(U8).reshape(n, kind.itemsize)
        return np.full(n, cells.shape[1], I64), cells.reshape(-1)
    if f.kind in VARINTS:
        value = column.cast(pa.int64()).to_numpy(zero_copy_only=False)
        if f.kind in (17, 18):
            value = value << 1 ^ value >> (31 if f.kind == 17 else 63)
        return _headed(varint(f.number << 3), value.astype(I64).view(U64))
    if f.kind == MESSAGE:
        size, data = _encoded(dict(zip((x.name for x in column.type), column.flatten())), n, f.type_name, held)
    else:
        wide = column.cast(pa.large_binary())
        offsets = np.frombuffer(wide.buffers()[1], I64)[wide.offset : wide.offset + n + 1] if n else np.zeros(1, I64)
        size, data = np.diff(offsets), np.frombuffer(wide.buffers()[2] or b"", U8)[offsets[0] : offsets[-1]]
    return _joined([_headed(varint(f.number << 3 | 2), size.astype(U64)), (size, data)], n)


def _encoded(columns: dict[str, pa.Array], n: int, name: str, held: Descriptors) -> tuple[np.ndarray, np.ndarray]:
    ragged, fields = [], held.fields(name)
    _plain(fields)
    for f in fields:
        column, size = columns[f.name], np.zeros(n, I64)
        if f.repeated:
            items = column.flatten()
            if items.null_count:
                raise NotPlain("null in an array")
            own, data = _items(f, items, held)
            ends = np.concatenate([[0], np.cumsum(own)])
            many = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            size = ends[many[1:]] - ends[many[:-1]]
        else:
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            size[valid], data = _items(f, column.drop_null() if column.null_count else column, held)
        ragged.append((size, data))
    return _joined(ragged, n)


def encoded(columns: list[pa.Array], names: list[str], name: str, held: Descriptors) -> pa.Array:
    """The payloads of a batch."""
    n = len(columns[0]) if columns else 0
    if not n:
        raise NotPlain("no columns or rows")
    size, data = _encoded(dict(zip(names, columns)), n, name, held)
    if len(data) >= 1 << 31:
        raise NotPlain("more than 2 GB")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
