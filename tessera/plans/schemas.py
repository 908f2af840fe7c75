"""Comparing two schemas: which columns match, under which policy, and what both sides are cast to."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from tessera.plans.policy import Policy
from tessera.plans.promotion import Clash, order_problems, promote
from tessera.types import Kind, Schema, field_of


@dataclass(frozen=True)
class ColumnComparison:
    """One column. ``expected`` is None for an extra column, ``actual`` for a missing one; ``common`` is None unless
    both sides have it and agree. ``actual_name`` is how the actual side spells it."""

    name: str
    expected: Kind | None
    actual: Kind | None
    common: Kind | None
    problem: str | None = None
    actual_name: str | None = None

    @property
    def ok(self) -> bool:
        return self.problem is None


@dataclass(frozen=True)
class SchemaComparison:
    """Expected columns in their order, then extra ones; problems of the whole; the common schema if all is well."""

    columns: tuple[ColumnComparison, ...]
    problems: tuple[str, ...]
    common_schema: Schema | None

    @property
    def ok(self) -> bool:
        return self.common_schema is not None

    def spark_schema(self) -> T.StructType:
        """The common schema as Spark holds it; every column is nullable."""
        if self.common_schema is None:
            raise ValueError("the schemas do not agree, so there is no common one")
        return T.StructType([field_of(n, k) for n, k in self.common_schema.fields])

    def pairs(self) -> list[tuple[str, ColumnComparison]]:
        """(name on the actual side, column) of the columns that are compared."""
        return [(c.actual_name, c) for c in self.columns if c.common is not None and c.expected is not None]


def compare_schemas(actual: Any, expected: Any, policy: Policy = Policy()) -> SchemaComparison:
    """Both may be Spark or Arrow schemas, or (name, Kind) pairs. Runs no job."""
    have, want = Schema.of(actual), Schema.of(expected)
    by_key = {policy.fold(n): (n, k) for n, k in have.fields}
    columns = []
    for name, kind in want.fields:
        if (found := by_key.get(policy.fold(name))) is None:
            columns.append(ColumnComparison(name, kind, None, None, "missing column"))
            continue
        common = promote(found[1], kind, policy)
        clash = isinstance(common, Clash)
        columns.append(
            ColumnComparison(name, kind, found[1], None if clash else common, common.reason if clash else None, found[0])
        )
    wanted = set(map(policy.fold, want.names))
    extra = None if policy.allow_extra_columns_in_result else "unexpected column"
    columns += [ColumnComparison(n, None, k, None, extra, n) for n, k in have.fields if policy.fold(n) not in wanted]
    problems = order_problems(have.names, want.names, "column", policy.strict_column_ordering, policy.fold)
    common = None
    if not problems and all(c.ok for c in columns):
        common = Schema(tuple((c.name, c.common) for c in columns if c.expected is not None))
    return SchemaComparison(tuple(columns), tuple(problems), common)
