"""Expressions over cells: canonical forms that can be compared, grouped and ordered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.casts import fields_of
from tessera.types import Kind


def has_map(k: Kind) -> bool:
    return k.name == "map" or any(has_map(c) for _, c, _ in k.children)


def comparable(c: Column, k: Kind) -> Column:
    """The value with each map as its entries, in order; other values as they are."""
    if not has_map(k):
        return c
    if k.name == "map":
        key, value = k.child(0), k.child(1)
        return F.transform(
            F.map_entries(c),
            lambda e: F.struct(comparable(e["key"], key).alias("key"), comparable(e["value"], value).alias("value")),
        )
    if k.name == "struct":
        fields = [comparable(own, child).alias(n) for own, (n, child, _) in zip(fields_of(c, k), k.children)]
        return F.when(c.isNotNull(), F.struct(*fields))
    element = k.child(0)
    return F.transform(c, lambda x: comparable(x, element))


def differs(a: Column, b: Column, k: Kind) -> Column:
    """Never null: null equals null, NaN equals NaN, and both zeros are equal."""
    return ~comparable(a, k).eqNullSafe(comparable(b, k))


def order_keys(c: Column, k: Kind) -> list[Column]:
    """Ascending keys, nulls last and NaN before them; a struct gives the keys of its leaves."""
    if k.name == "struct":
        return [key for own, (_, child, _) in zip(fields_of(c, k), k.children) for key in order_keys(own, child)]
    return [] if k.name == "null" else [c.asc_nulls_last()]


def text(c: Column, k: Kind) -> Column:
    """A cell as text for reports in tables."""
    return F.to_json(F.struct(comparable(c, k).alias("v"))) if k.nested else c.cast("string")
