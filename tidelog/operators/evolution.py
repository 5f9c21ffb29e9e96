"""Schema evolution: widening, the common type of two types, and the merge of two schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import IncompatibleType

#: Wire types from narrow to wide.
LADDERS = [["int8", "int16", "int32", "int64"], ["uint8", "uint16", "uint32", "uint64"], ["float32", "float64"]]
WIRE = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def _wire(kind: T.DataType, meta: dict) -> str:
    return meta.get("wire") or WIRE.get(kind.simpleString(), kind.simpleString())


def can_widen(a: T.DataType, b: T.DataType, meta_a: dict | None = None, meta_b: dict | None = None) -> bool:
    """Whether every value of ``a`` is one of ``b``: along a ladder, item by item in arrays (fixed ones of
    equal size), and field by field in structs, where either may lack fields of the other."""
    meta_a, meta_b = meta_a or {}, meta_b or {}
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return meta_a.get("array", 0) == meta_b.get("array", 0) and can_widen(a.elementType, b.elementType, meta_a, meta_b)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        there = {f.name: f for f in b.fields}
        return all(can_widen(f.dataType, there[f.name].dataType, f.metadata, there[f.name].metadata) for f in a.fields if f.name in there)
    x, y = _wire(a, meta_a), _wire(b, meta_b)
    return x == y or any(x in ladder and y in ladder and ladder.index(x) <= ladder.index(y) for ladder in LADDERS)


@dataclass
class Evolution:
    new_fields: list[str]
    widened_fields: list[str]
    merged: T.StructType

    @property
    def needed(self) -> bool:
        return bool(self.new_fields or self.widened_fields)


def _wider(old: T.StructField, new: T.StructField) -> T.StructField:
    a, b = old.dataType, new.dataType
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        if not (can_widen(a, b) or can_widen(b, a)):
            raise IncompatibleType(f"{old.name}: {a.simpleString()} and {b.simpleString()}")
        return T.StructField(old.name, compare_schemas(a, b).merged, True, old.metadata)
    if can_widen(a, b, old.metadata, new.metadata):
        return T.StructField(old.name, b, True, new.metadata)
    if can_widen(b, a, new.metadata, old.metadata):
        return T.StructField(old.name, a, True, old.metadata)
    raise IncompatibleType(f"{old.name}: {a.simpleString()} and {b.simpleString()}")


def compare_schemas(existing: T.StructType, incoming: T.StructType) -> Evolution:
    """The merge: existing fields in their order, widened where needed, then new ones."""
    there = {f.name: f for f in incoming.fields}
    fields, widened = [], []
    for f in existing.fields:
        merged = _wider(f, there[f.name]) if f.name in there else f
        if merged.dataType != f.dataType:
            widened.append(f.name)
        fields.append(T.StructField(f.name, merged.dataType, True, merged.metadata))
    known = {f.name for f in existing.fields}
    new = [f for f in incoming.fields if f.name not in known]
    return Evolution([f.name for f in new], widened, T.StructType(fields + [T.StructField(f.name, f.dataType, True, f.metadata) for f in new]))


def _cast(column: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        there = {f.name: f for f in have.fields}
        fields = [(_cast(column[f.name], there[f.name].dataType, f.dataType) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(column, lambda x: _cast(x, have.elementType, want.elementType))
    return column.cast(want)


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``; what it lacks is null."""
    have = {f.name: f for f in df.schema.fields}
    return df.select(*((_cast(F.col(f"`{f.name}`"), have[f.name].dataType, f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name, metadata=f.metadata) for f in schema.fields))
