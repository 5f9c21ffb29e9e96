"""Message definitions: their grammar, a registry of types, and the Spark schema of a type."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tidelog.errors import InvalidDefinition, UnresolvedType

#: Primitive types and their aliases, with Spark type and wire name.
PRIMITIVES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "uint8": T.ShortType(), "int16": T.ShortType(), "uint16": T.IntegerType(), "int32": T.IntegerType(), "uint32": T.LongType(),
    "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "time": T.LongType(), "duration": T.LongType(),
}
ALIASES = {"byte": "int8", "char": "uint8"}
ARRAY = re.compile(r"^(?P<base>[^\[\]]+?)(?P<array>\[(?P<size>[^\]]*)\]?)?$")


@dataclass(frozen=True)
class Field:
    name: str
    base: str
    array: bool = False
    size: int | None = None


@dataclass
class Definition:
    name: str
    fields: list[Field] = field(default_factory=list)
    constants: dict[str, tuple[str, str]] = field(default_factory=dict)


def parse_type(text: str) -> tuple[str, bool, int | None]:
    """Base type, whether it is an array, and a fixed array's size."""
    m = ARRAY.match(text)
    if not m or not m["base"]:
        raise InvalidDefinition(f"bad type {text!r}")
    base = ALIASES.get(m["base"], m["base"])
    if m["array"] is None:
        return base, False, None
    if not m["array"].endswith("]"):
        raise InvalidDefinition(f"array of {text!r} isn't closed")
    size = m["size"].strip()
    if size and not size.isdigit():
        raise InvalidDefinition(f"bad array size in {text!r}")
    return base, True, int(size) if size else None


def parse_definition(name: str, text: str) -> Definition:
    """One type: a line is empty, a comment, a constant (it holds ``=``) or a field."""
    out = Definition(name)
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        words = line.split(None, 1)
        if len(words) < 2:
            raise InvalidDefinition(f"no name in {line!r}")
        base, array, size = parse_type(words[0])
        if "=" in words[1]:
            constant, value = (x.strip() for x in words[1].split("=", 1))
            out.constants[constant] = (base, value)
        else:
            out.fields.append(Field(words[1].split()[0], base, array, size))
    return out


class Registry:
    """Types by full name; a short name finds the type registered last under it."""

    def __init__(self) -> None:
        self.types: dict[str, Definition] = {}
        self.short: dict[str, Definition] = {}

    def add(self, definition: Definition) -> None:
        self.types[definition.name] = definition
        self.short[definition.name.rpartition("/")[2]] = definition

    def get(self, name: str) -> Definition:
        found = self.types.get(name) or self.short.get(name.rpartition("/")[2])
        if found is None:
            raise UnresolvedType(name)
        return found

    @classmethod
    def parse(cls, name: str, text: str) -> Registry:
        """A root type and its dependencies, parted by lines of ``=`` and headed by ``MSG: name``."""
        out = cls()
        for k, part in enumerate(re.split(r"\n=+[ \t]*\n?", "\n" + text)):
            if k:
                head, _, part = part.strip().partition("\n")
                if not head.startswith("MSG:"):
                    raise InvalidDefinition(f"no MSG: in {head!r}")
                out.add(parse_definition(head[4:].strip(), part))
            else:
                out.add(parse_definition(name, part))
        return out


def is_empty(name: str, registry: Registry) -> bool:
    """Whether a type has no field that is a column."""
    return all(f.base not in PRIMITIVES and is_empty(f.base, registry) for f in registry.get(name).fields)


def spark_schema(name: str, registry: Registry) -> T.StructType:
    """The columns of a type; fields of empty types are left out. Metadata keeps what Spark's types lose."""
    fields = []
    for f in registry.get(name).fields:
        meta: dict = {}
        if f.base in PRIMITIVES:
            kind = PRIMITIVES[f.base]
            meta["wire"] = f.base
        elif is_empty(f.base, registry):
            continue
        else:
            kind = spark_schema(f.base, registry)
            meta["message"] = f.base
        if f.array and f.base == "uint8":
            kind = T.BinaryType()
        elif f.array:
            kind = T.ArrayType(kind)
        if f.array:
            meta["array"] = f.size or 0
        fields.append(T.StructField(f.name, kind, True, meta))
    return T.StructType(fields)


#: The wire type written for a Spark type without metadata.
DEFAULT_WIRE = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "string", "binary": "uint8", "timestamp": "time", "timestamp_ntz": "time"}


def definition_text(schema: T.StructType, root: str) -> str:
    """The definition of a schema, its nested types after it in order of name."""
    parts: dict[str, str] = {}

    def lines(struct: T.StructType) -> str:
        out = []
        for f in struct.fields:
            meta, kind = f.metadata, f.dataType
            array = isinstance(kind, (T.ArrayType, T.BinaryType))
            item = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if isinstance(item, T.StructType):
                base = meta.get("message", f"{root}_{f.name}")
                parts[base] = lines(item)
            else:
                base = meta.get("wire") or DEFAULT_WIRE.get(item.simpleString(), "uint64" if isinstance(item, T.DecimalType) else "")
                if not base:
                    raise InvalidDefinition(f"no wire type for {item.simpleString()}")
            out.append(f"{base}{f'[{meta.get("array") or ""}]' if array else ''} {f.name}")
        return "\n".join(out)

    text = lines(schema)
    return "".join([text, *(f"\n{'=' * 80}\nMSG: {n}\n{t}" for n, t in sorted(parts.items()))])
