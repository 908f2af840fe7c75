"""Typed literal tables that stand in for the sources of a snippet, or for its expected result."""

from __future__ import annotations

import datetime as dt
import decimal as dec
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera import types as L
from tessera.types import Kind, field_of


class SqlType(Enum):
    """The types that a fixture's author names."""

    INT = L.integer(32)
    BIGINT = L.integer(64)
    FLOAT = L.floating(64)
    STRING = L.STRING
    DATE = L.DATE32
    BOOLEAN = L.BOOL
    DECIMAL1 = L.decimal(18, 1)
    DECIMAL2 = L.decimal(18, 2)
    DECIMAL3 = L.decimal(18, 3)
    DECIMAL4 = L.decimal(18, 4)
    DECIMAL5 = L.decimal(18, 5)
    TIMESTAMP_NTZ0 = L.timestamp("s")
    TIMESTAMP_NTZ3 = L.timestamp("ms")
    TIMESTAMP_NTZ6 = L.timestamp("us")
    TIMESTAMP_NTZ9 = L.timestamp("ns")
    TIME = L.time("us")


def as_kind(t: Any) -> Kind:
    """From a SqlType, a Kind, a Spark type or an Arrow type."""
    if isinstance(t, SqlType):
        return t.value
    if isinstance(t, Kind):
        return t
    return L.from_spark(t) if isinstance(t, T.DataType) else L.from_arrow(t)


@dataclass(frozen=True)
class FixtureColumn:
    name: str
    type: Kind

    def __init__(self, name: str, type: Any) -> None:
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "type", as_kind(type))


EPOCH = dt.datetime(1970, 1, 1)


def _fits(value: int, low: int, high: int, k: Kind) -> int:
    if not low <= value <= high:
        raise ValueError(f"{value} is out of range for {k}")
    return value


def coerce(value: Any, k: Kind) -> Any:
    """A Python value as Spark wants it for a type; an error if it is no value of the type."""
    if value is None:
        return None
    wrong = TypeError(f"{value!r} is no value of type {k}")
    if k.name in ("int", "uint"):
        if isinstance(value, bool) or not (isinstance(value, int) or isinstance(value, float) and value.is_integer()):
            raise wrong
        signed = k.name == "int"
        whole = _fits(int(value), -(2 ** (k.bits - 1)) if signed else 0, 2 ** (k.bits - signed) - 1, k)
        return dec.Decimal(whole) if not signed and k.bits == 64 else whole
    if k.name == "float":
        if isinstance(value, bool) or not isinstance(value, (int, float, dec.Decimal)):
            raise wrong
        return float(value)
    if k.name == "decimal":
        if isinstance(value, (bool, str)):
            raise wrong
        exact = dec.Decimal(str(value))
        if exact != exact.quantize(dec.Decimal(1).scaleb(-k.scale), context=dec.Context(prec=60)):
            raise ValueError(f"{value!r} has more digits than {k} holds")
        return exact
    if k.name == "timestamp" and k.unit == "ns":
        if isinstance(value, int):
            return value
        if not isinstance(value, dt.datetime):
            raise wrong
        naive = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        whole = (naive - EPOCH) // dt.timedelta(microseconds=1) * 1000 + getattr(value, "nanosecond", 0)
        return _fits(whole, -(2**63), 2**63 - 1, k)
    if k.name == "time" and k.unit == "ns":
        if isinstance(value, int):
            return value
        return ((value.hour * 60 + value.minute) * 60 + value.second) * 10**9 + value.microsecond * 1000
    if k.name in ("list", "fixed_list"):
        return [coerce(v, k.child(0)) for v in value]
    if k.name == "map":
        pairs = value.items() if isinstance(value, Mapping) else value
        return {coerce(a, k.child(0)): coerce(b, k.child(1)) for a, b in pairs}
    if k.name == "struct":
        given = value if isinstance(value, Mapping) else dict(zip((n for n, _, _ in k.children), value, strict=True))
        return tuple(coerce(given.get(n), c) for n, c, _ in k.children)
    wanted = {"bool": bool, "string": str, "binary": (bytes, bytearray), "date": dt.date, "time": dt.time, "timestamp": dt.datetime}
    if k.name in wanted and not isinstance(value, wanted[k.name]):
        raise wrong
    return value


@dataclass(frozen=True)
class FixtureData:
    """Rows as tuples, with declared columns. The DataFrame is made once for a session; a failure is not remembered."""

    data: Sequence[tuple[Any, ...]]
    columns: Sequence[FixtureColumn]
    _made: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def schema(self) -> T.StructType:
        return T.StructType([field_of(c.name, c.type) for c in self.columns])

    def to_df(self, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("there is no active Spark session to make the fixture in")
        key = spark.sparkContext.applicationId, id(spark)
        if key not in self._made:
            rows = []
            for row in self.data:
                if len(row) != len(self.columns):
                    raise ValueError(f"row {row!r} has {len(row)} values for {len(self.columns)} columns")
                rows.append(tuple(coerce(v, c.type) for v, c in zip(row, self.columns)))
            self._made[key] = spark.createDataFrame(rows, self.schema())
        return self._made[key]

    def to_arrow(self) -> pa.Table:
        """The rows as an Arrow table of the declared types; needs no session."""
        rows = list(self.data)
        if bad := next((r for r in rows if len(r) != len(self.columns)), None):
            raise ValueError(f"row {bad!r} has {len(bad)} values for {len(self.columns)} columns")
        arrays = [pa.array([r[i] for r in rows], L.to_arrow(c.type)) for i, c in enumerate(self.columns)]
        return pa.table(arrays, names=[c.name for c in self.columns])


@dataclass(frozen=True)
class SourceFixture:
    """A fixture, or any DataFrame, under the alias that a snippet reads."""

    alias: str
    data: FixtureData | DataFrame

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self.data if isinstance(self.data, DataFrame) else self.data.to_df(spark)


def by_alias(fixtures: Iterable[SourceFixture] | Mapping[str, FixtureData | DataFrame]) -> dict[str, SourceFixture]:
    """Fixtures by alias; of two with the same one the last counts."""
    if isinstance(fixtures, Mapping):
        fixtures = [SourceFixture(a, d) for a, d in fixtures.items()]
    return {f.alias: f for f in fixtures}
