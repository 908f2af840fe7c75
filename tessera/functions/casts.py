"""Column expressions that bring a value from one logical type to the common one, and that find what does not fit.

All promotions widen but one: a timestamp in nanoseconds is held as a long, which the years 1677 to 2262 fill. Those
casts give null where they do not fit, and ``misfit`` tells such values apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import Kind, to_spark


def fields_of(c: Column, k: Kind) -> list[Column]:
    """The fields of a struct by their places, whatever the session's rule on upper and lower case."""
    named = c.cast(T.StructType([T.StructField(f"f{i}", to_spark(child)) for i, (_, child, _) in enumerate(k.children)]))
    return [named.getField(f"f{i}") for i in range(len(k.children))]


def by_name(c: Column, k: Kind) -> dict[str, tuple[Column, Kind]]:
    return {n: (value, child) for (n, child, _), value in zip(k.children, fields_of(c, k))}


def _micros(c: Column, zoned: bool) -> Column:
    if zoned:
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def _nanos_of_day(c: Column) -> Column:
    whole = (F.hour(c).cast("long") * 3600 + F.minute(c) * 60) * 1_000_000_000
    return whole + (F.extract(F.lit("SECOND"), c).cast("decimal(18,9)") * 1_000_000_000).cast("long")


def cast(c: Column, source: Kind, target: Kind) -> Column:
    """``c`` as the target's physical type; structs by field name, a null struct staying null."""
    if source == target:
        return c
    if source.name == "null":
        return c.cast(to_spark(target))
    if target.name in ("list", "fixed_list"):
        a, b = source.child(0), target.child(0)
        return c if to_spark(a) == to_spark(b) and not _renamed(a, b) else F.transform(c, lambda x: cast(x, a, b))
    if target.name == "map":
        (ka, va), (kb, vb) = ((k.child(0), k.child(1)) for k in (source, target))
        keyed = c if ka == kb else F.transform_keys(c, lambda k, _: cast(k, ka, kb))
        return keyed if va == vb else F.transform_values(keyed, lambda _, v: cast(v, va, vb))
    if target.name == "struct":
        have = by_name(c, source)
        fields = [cast(*have[n], k).alias(n) for n, k, _ in target.children]
        return F.when(c.isNotNull(), F.struct(*fields))
    if source.name == "timestamp" and target.unit == "ns" and source.unit != "ns":
        return F.try_multiply(_micros(c, source.zone is not None), F.lit(1000).cast("long"))
    if source.name == "time" and target.unit == "ns" and source.unit != "ns":
        return _nanos_of_day(c)
    return c if to_spark(source) == to_spark(target) else c.cast(to_spark(target))


def _renamed(a: Kind, b: Kind) -> bool:
    """Whether values differ although their physical types agree, as for nanoseconds made of microseconds."""
    return a.unit != b.unit and "ns" in (a.unit, b.unit)


def misfit(c: Column, source: Kind, target: Kind) -> Column | None:
    """Whether a value is lost by the cast; None if none can be."""
    if source == target or source.name == "null":
        return None
    if source.name == "timestamp" and target.unit == "ns" and source.unit != "ns":
        return c.isNotNull() & cast(c, source, target).isNull()
    if target.name in ("list", "fixed_list"):
        a, b = source.child(0), target.child(0)
        if misfit(F.lit(None), a, b) is None:
            return None
        return F.coalesce(F.exists(c, lambda x: misfit(x, a, b)), F.lit(False))
    if target.name == "map":
        tests = []
        for values, i in ((F.map_keys(c), 0), (F.map_values(c), 1)):
            a, b = source.child(i), target.child(i)
            if misfit(F.lit(None), a, b) is not None:
                tests.append(F.coalesce(_any(values, a, b), F.lit(False)))
        return _either(tests)
    if target.name == "struct":
        have = by_name(c, source)
        tests = [misfit(*have[n], k) for n, k, _ in target.children]
        return _either([F.coalesce(t, F.lit(False)) for t in tests if t is not None])
    return None


def _any(values: Column, a: Kind, b: Kind) -> Column:
    return F.exists(values, lambda x: misfit(x, a, b))


def _either(tests: list[Column]) -> Column | None:
    out = tests[0] if tests else None
    for t in tests[1:]:
        out = out | t
    return out
