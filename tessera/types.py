"""Logical column types: what a comparison tells apart, whether or not Spark has a type of its own for it.

Spark stores the logical type of a column, where it is not the plain reading of its physical type, as JSON in the
column's metadata. Element types of arrays have no metadata, so the whole tree is kept at the top.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

META = "tessera.type"
UNITS = ("s", "ms", "us", "ns")


@dataclass(frozen=True)
class Kind:
    """A logical type. Leaves have no children.

    name: null, bool, int, uint, float, decimal, decimal256, string, binary, fixed_binary, date, time, timestamp,
    duration, interval, list, fixed_list, map, struct. Other fields are used by the names they belong to.
    """

    name: str
    bits: int = 0
    precision: int = 0
    scale: int = 0
    form: str = ""  # "", large or view for text, binary and lists; 32 or 64 for dates
    unit: str = ""
    zone: str | None = None
    children: tuple[tuple[str, "Kind", bool], ...] = ()  # (field name, kind, nullable)

    @property
    def nested(self) -> bool:
        return self.name in ("list", "fixed_list", "map", "struct")

    def child(self, i: int) -> "Kind":
        return self.children[i][1]

    def __str__(self) -> str:
        if self.name in ("int", "uint", "float"):
            return f"{self.name}{self.bits}"
        if self.name in ("decimal", "decimal256"):
            return f"{self.name}({self.precision}, {self.scale})"
        if self.name in ("string", "binary"):
            return f"{self.form}_{self.name}" if self.form == "large" else f"{self.name}_view" if self.form else self.name
        if self.name == "fixed_binary":
            return f"binary[{self.bits}]"
        if self.name == "date":
            return f"date{self.form}"
        if self.name == "timestamp":
            return f"timestamp[{self.unit}{', tz=' + self.zone if self.zone is not None else ''}]"
        if self.name in ("time", "duration"):
            return f"{self.name}[{self.unit}]"
        if self.name in ("list", "fixed_list"):
            head = {"": "list", "large": "large_list", "view": "list_view"}[self.form] if self.name == "list" else "fixed_list"
            return f"{head}<{self.child(0)}>" + (f"[{self.bits}]" if self.bits else "")
        if self.name == "map":
            return f"map<{self.child(0)}, {self.child(1)}>"
        if self.name == "struct":
            return "struct<" + ", ".join(f"{n}: {k}" for n, k, _ in self.children) + ">"
        return self.name

    def to_json(self) -> Any:
        out: dict[str, Any] = {"name": self.name}
        for field in ("bits", "precision", "scale", "form", "unit", "zone"):
            if getattr(self, field) not in (0, "", None):
                out[field] = getattr(self, field)
        if self.children:
            out["children"] = [[n, k.to_json(), null] for n, k, null in self.children]
        return out

    @staticmethod
    def from_json(data: Any) -> "Kind":
        children = tuple((n, Kind.from_json(k), null) for n, k, null in data.get("children", ()))
        return Kind(**{**{k: v for k, v in data.items() if k != "children"}, "children": children})


NULL, BOOL = Kind("null"), Kind("bool")
STRING, LARGE_STRING, STRING_VIEW = Kind("string"), Kind("string", form="large"), Kind("string", form="view")
BINARY, LARGE_BINARY, BINARY_VIEW = Kind("binary"), Kind("binary", form="large"), Kind("binary", form="view")
DATE32, DATE64 = Kind("date", form="32"), Kind("date", form="64")


def integer(bits: int, signed: bool = True) -> Kind:
    return Kind("int" if signed else "uint", bits=bits)


def floating(bits: int) -> Kind:
    return Kind("float", bits=bits)


def decimal(precision: int, scale: int) -> Kind:
    return Kind("decimal", precision=precision, scale=scale)


def timestamp(unit: str, zone: str | None = None) -> Kind:
    return Kind("timestamp", unit=unit, zone=zone)


def time(unit: str) -> Kind:
    return Kind("time", unit=unit)


def list_of(element: Kind, form: str = "", nullable: bool = True) -> Kind:
    return Kind("list", form=form, children=(("element", element, nullable),))


def map_of(key: Kind, value: Kind, nullable: bool = True) -> Kind:
    return Kind("map", children=(("key", key, False), ("value", value, nullable)))


def struct_of(*fields: tuple[str, Kind] | tuple[str, Kind, bool]) -> Kind:
    return Kind("struct", children=tuple((f[0], f[1], f[2] if len(f) == 3 else True) for f in fields))


def from_arrow(t: pa.DataType) -> Kind:
    """The logical type of an Arrow type."""
    p = pa.types
    if p.is_null(t):
        return NULL
    if p.is_boolean(t):
        return BOOL
    if p.is_integer(t):
        return integer(t.bit_width, p.is_signed_integer(t))
    if p.is_floating(t):
        return floating(t.bit_width)
    if p.is_decimal(t):
        wide = p.is_decimal256(t)
        return Kind("decimal256" if wide else "decimal", precision=t.precision, scale=t.scale)
    for is_text, kind in (
        (p.is_large_string, LARGE_STRING), (p.is_string_view, STRING_VIEW), (p.is_string, STRING),
        (p.is_large_binary, LARGE_BINARY), (p.is_binary_view, BINARY_VIEW), (p.is_date32, DATE32), (p.is_date64, DATE64),
    ):
        if is_text(t):
            return kind
    if p.is_fixed_size_binary(t):
        return Kind("fixed_binary", bits=t.byte_width)
    if p.is_binary(t):
        return BINARY
    if p.is_time(t):
        return time(t.unit)
    if p.is_timestamp(t):
        return timestamp(t.unit, t.tz)
    if p.is_duration(t):
        return Kind("duration", unit=t.unit)
    if p.is_interval(t):
        return Kind("interval")
    if p.is_map(t):
        return map_of(from_arrow(t.key_type), from_arrow(t.item_type), t.item_field.nullable)
    if p.is_struct(t):
        return struct_of(*((f.name, from_arrow(f.type), f.nullable) for f in t))
    if p.is_fixed_size_list(t):
        return Kind("fixed_list", bits=t.list_size, children=(("element", from_arrow(t.value_type), t.value_field.nullable),))
    for is_list, form in ((p.is_large_list, "large"), (p.is_list_view, "view"), (p.is_large_list_view, "large_view"), (p.is_list, "")):
        if is_list(t):
            return list_of(from_arrow(t.value_type), form, t.value_field.nullable)
    raise TypeError(f"columns of type {t} cannot be held")


def to_arrow(k: Kind) -> pa.DataType:
    """The Arrow type that a logical type stands for."""
    if k.name in ("int", "uint"):
        return getattr(pa, f"{k.name}{k.bits}")()
    if k.name == "float":
        return getattr(pa, f"float{k.bits}")()
    if k.name in ("decimal", "decimal256"):
        return (pa.decimal128 if k.name == "decimal" else pa.decimal256)(k.precision, k.scale)
    if k.name in ("string", "binary"):
        form = {"": k.name, "large": f"large_{k.name}", "view": f"{k.name}_view"}[k.form]
        return getattr(pa, form)()
    if k.name == "time":
        return (pa.time32 if k.unit in ("s", "ms") else pa.time64)(k.unit)
    if k.name == "timestamp":
        return pa.timestamp(k.unit, k.zone)
    if k.name in ("list", "fixed_list"):
        element = pa.field("item", to_arrow(k.child(0)), k.children[0][2])
        if k.name == "fixed_list":
            return pa.list_(element, k.bits)
        return {"": pa.list_, "large": pa.large_list, "view": pa.list_view, "large_view": pa.large_list_view}[k.form](element)
    if k.name == "map":
        return pa.map_(to_arrow(k.child(0)), pa.field("value", to_arrow(k.child(1)), k.children[1][2]))
    if k.name == "struct":
        return pa.struct([pa.field(n, to_arrow(c), null) for n, c, null in k.children])
    if k.name == "fixed_binary":
        return pa.binary(k.bits)
    plain = {"null": pa.null(), "bool": pa.bool_(), "duration": pa.duration(k.unit or "us"), "interval": pa.month_day_nano_interval()}
    return plain[k.name] if k.name in plain else {"32": pa.date32(), "64": pa.date64()}[k.form]


_SPARK_LEAVES: list[tuple[type, Kind]] = [
    (T.NullType, NULL), (T.BooleanType, BOOL), (T.ByteType, integer(8)), (T.ShortType, integer(16)), (T.IntegerType, integer(32)),
    (T.LongType, integer(64)), (T.FloatType, floating(32)), (T.DoubleType, floating(64)), (T.StringType, STRING),
    (T.BinaryType, BINARY), (T.DateType, DATE32), (T.TimestampNTZType, timestamp("us")), (T.TimestampType, timestamp("us", "UTC")),
    (T.DayTimeIntervalType, Kind("duration", unit="us")), (T.YearMonthIntervalType, Kind("interval")),
]


def from_spark(t: T.DataType) -> Kind:
    """The plain reading of a Spark type."""
    if isinstance(t, T.DecimalType):
        return decimal(t.precision, t.scale)
    if isinstance(t, T.TimeType):
        return time({0: "s", 3: "ms"}.get(t.precision, "us"))
    if isinstance(t, T.ArrayType):
        return list_of(from_spark(t.elementType), "", t.containsNull)
    if isinstance(t, T.MapType):
        return map_of(from_spark(t.keyType), from_spark(t.valueType), t.valueContainsNull)
    if isinstance(t, T.StructType):
        return struct_of(*((f.name, from_spark(f.dataType), f.nullable) for f in t.fields))
    for kind, logical in _SPARK_LEAVES:
        if isinstance(t, kind):
            return logical
    raise TypeError(f"columns of type {t.simpleString()} cannot be held")


def to_spark(k: Kind) -> T.DataType:
    """The physical type in which Spark holds values of a logical type."""
    if k.name in ("int", "uint"):
        signed = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
        return signed[k.bits] if k.name == "int" else {8: signed[16], 16: signed[32], 32: signed[64], 64: T.DecimalType(20, 0)}[k.bits]
    if k.name == "float":
        return T.DoubleType() if k.bits == 64 else T.FloatType()
    if k.name == "decimal":
        return T.DecimalType(k.precision, k.scale)
    if k.name == "timestamp":
        return T.LongType() if k.unit == "ns" else T.TimestampNTZType() if k.zone is None else T.TimestampType()
    if k.name == "time":
        return T.LongType() if k.unit == "ns" else T.TimeType({"s": 0, "ms": 3, "us": 6}[k.unit])
    if k.name in ("list", "fixed_list"):
        return T.ArrayType(to_spark(k.child(0)), True)
    if k.name == "map":
        return T.MapType(to_spark(k.child(0)), to_spark(k.child(1)), True)
    if k.name == "struct":
        return T.StructType([T.StructField(n, to_spark(c), True) for n, c, _ in k.children])
    plain = {"null": T.NullType(), "bool": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(),
             "fixed_binary": T.BinaryType(), "date": T.DateType(), "duration": T.DayTimeIntervalType()}
    if k.name not in plain:
        raise TypeError(f"Spark cannot hold columns of type {k}")
    return plain[k.name]


def field_of(name: str, k: Kind, nullable: bool = True) -> T.StructField:
    """A Spark field that remembers its logical type if the physical one does not say it."""
    physical = to_spark(k)
    plain = from_spark(physical)
    return T.StructField(name, physical, nullable, {META: json.dumps(k.to_json())} if plain != k else None)


def kind_of(field: T.StructField) -> Kind:
    """The logical type of a column."""
    noted = (field.metadata or {}).get(META)
    if noted:
        k = Kind.from_json(json.loads(noted))
        if to_spark(k) == _nullable(field.dataType):  # a note that outlived a cast counts no more
            return k
    return from_spark(field.dataType)


def _nullable(t: T.DataType) -> T.DataType:
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(_nullable(t.keyType), _nullable(t.valueType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in t.fields])
    return t


def sortable(k: Kind) -> bool:
    """Leaves have an order, structs if all their fields do; lists and maps have none."""
    if k.name == "struct":
        return all(sortable(c) for _, c, _ in k.children)
    return not k.nested


@dataclass(frozen=True)
class Schema:
    """Ordered (name, logical type) pairs; names may repeat."""

    fields: tuple[tuple[str, Kind], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    @staticmethod
    def of(value: Any) -> "Schema":
        """From a Schema, a Spark schema, an Arrow schema or (name, Kind) pairs."""
        if isinstance(value, Schema):
            return value
        if isinstance(value, T.StructType):
            return Schema(tuple((f.name, kind_of(f)) for f in value.fields))
        if isinstance(value, pa.Schema):
            return Schema(tuple((f.name, from_arrow(f.type)) for f in value))
        return Schema(tuple((n, k) for n, k in value))
