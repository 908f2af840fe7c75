"""Every promotion rule, in both directions, and every flag that forbids one."""

import pyarrow as pa
import pytest

from tessera import Policy, SchemaPolicyError, compare_schemas
from tessera import types as L
from tessera.plans.promotion import Clash, promote

I8, I16, I32, I64 = (L.integer(b) for b in (8, 16, 32, 64))
U8, U16, U32, U64 = (L.integer(b, False) for b in (8, 16, 32, 64))
F16, F32, F64 = (L.floating(b) for b in (16, 32, 64))

COMPATIBLE = [
    (L.NULL, I32, I32), (L.NULL, L.STRING, L.STRING), (L.NULL, L.list_of(I8), L.list_of(I8)), (L.NULL, L.struct_of(("a", I8)), L.struct_of(("a", I8))),
    (I8, I16, I16), (I16, I32, I32), (I32, I64, I64), (I8, I64, I64), (U8, U16, U16), (U8, U32, U32), (U32, U64, U64),
    (I8, L.decimal(2, 0), L.decimal(3, 0)), (I16, L.decimal(2, 0), L.decimal(5, 0)), (I32, L.decimal(5, 0), L.decimal(10, 0)),
    (I64, L.decimal(5, 0), L.decimal(19, 0)), (U64, L.decimal(5, 0), L.decimal(20, 0)), (I32, L.decimal(38, 0), L.decimal(38, 0)),
    (U8, L.decimal(10, 0), L.decimal(10, 0)), (L.decimal(10, 2), L.decimal(18, 2), L.decimal(18, 2)), (L.decimal(5, 0), L.decimal(7, 0), L.decimal(7, 0)),
    (F16, F32, F64), (F16, F64, F64), (F32, F64, F64),
    (L.STRING, L.LARGE_STRING, L.LARGE_STRING), (L.STRING, L.STRING_VIEW, L.LARGE_STRING), (L.LARGE_STRING, L.STRING_VIEW, L.LARGE_STRING),
    (L.BINARY, L.LARGE_BINARY, L.LARGE_BINARY), (L.BINARY, L.BINARY_VIEW, L.LARGE_BINARY),
    (L.time("s"), L.time("ms"), L.time("ms")), (L.time("s"), L.time("us"), L.time("us")), (L.time("us"), L.time("ns"), L.time("ns")),
    (L.timestamp("s"), L.timestamp("ms"), L.timestamp("ms")), (L.timestamp("us"), L.timestamp("ns"), L.timestamp("ns")),
    (L.timestamp("s", "UTC"), L.timestamp("us", "UTC"), L.timestamp("us", "UTC")),
    (L.timestamp("us", "Asia/Tokyo"), L.timestamp("us", "UTC"), L.timestamp("us", "UTC")),
    (L.timestamp("ms", "Asia/Tokyo"), L.timestamp("us", "Europe/Oslo"), L.timestamp("us", "UTC")),
    (L.list_of(I8), L.list_of(I32), L.list_of(I32)), (L.list_of(I8), L.list_of(I8, "large"), L.list_of(I8, "large")),
    (L.list_of(L.NULL), L.list_of(L.list_of(I32)), L.list_of(L.list_of(I32))),
    (L.map_of(L.STRING, I16), L.map_of(L.STRING, I64), L.map_of(L.STRING, I64)),
    (L.struct_of(("a", I8), ("b", L.STRING)), L.struct_of(("a", I32), ("b", L.STRING)), L.struct_of(("a", I32), ("b", L.STRING))),
    (L.list_of(I8, nullable=False), L.list_of(I8), L.list_of(I8)),
]

CLASHES = [
    (I32, U32), (I64, U8), (I32, F64), (U8, F32), (I32, L.STRING), (I32, L.BOOL), (I32, L.decimal(10, 2)), (F64, L.decimal(10, 2)), (F64, L.decimal(5, 0)),
    (L.decimal(10, 2), L.decimal(10, 3)), (L.STRING, L.BINARY), (L.DATE32, L.DATE64), (L.DATE32, L.timestamp("us")), (L.timestamp("us"), L.timestamp("us", "UTC")),
    (L.time("us"), L.timestamp("us")), (L.Kind("duration", unit="us"), L.Kind("interval")), (L.Kind("fixed_binary", bits=4), L.BINARY),
    (L.list_of(I32), I32), (L.list_of(I32), L.struct_of(("a", I32))), (L.list_of(L.list_of(I8)), L.list_of(L.list_of(I16))),
    (L.list_of(I32, "view"), L.list_of(I32)), (L.map_of(L.STRING, I32), L.map_of(I32, I32)), (L.struct_of(("a", I8)), L.struct_of(("A", I8))),
    (L.Kind("decimal256", precision=50), L.decimal(10, 0)),
]

STRICT = [
    ("strict_null_types", L.NULL, I32), ("strict_null_types", L.list_of(L.NULL), L.list_of(I32)), ("strict_int_widths", I16, I32), ("strict_int_widths", U8, U16),
    ("strict_integer_vs_decimal", I32, L.decimal(10, 0)), ("strict_decimal_precision", L.decimal(5, 2), L.decimal(6, 2)), ("strict_float_widths", F32, F64),
    ("strict_large_variants", L.STRING, L.LARGE_STRING), ("strict_large_variants", L.BINARY, L.LARGE_BINARY), ("strict_large_variants", L.list_of(I8), L.list_of(I8, "large")),
    ("strict_temporal_units", L.time("ms"), L.time("us")), ("strict_temporal_units", L.timestamp("ms"), L.timestamp("us")),
    ("strict_temporal_units", L.timestamp("ms", "UTC"), L.timestamp("us", "UTC")), ("strict_tz_names", L.timestamp("us", "UTC"), L.timestamp("us", "Asia/Tokyo")),
    ("strict_nested_children", L.list_of(I8), L.list_of(I16)), ("strict_nested_children", L.map_of(L.STRING, I8), L.map_of(L.STRING, I16)),
    ("strict_nested_children", L.struct_of(("a", I8)), L.struct_of(("a", I16))), ("strict_nested_children", L.list_of(L.NULL), L.list_of(I16)),
]



@pytest.mark.parametrize(("a", "b", "common"), COMPATIBLE, ids=str)
def test_compatible(a, b, common):
    assert promote(a, b) == common
    assert promote(b, a) == common
    assert promote(a, a) == a


@pytest.mark.parametrize(("a", "b"), CLASHES, ids=str)
def test_never(a, b):
    assert isinstance(promote(a, b), Clash) and isinstance(promote(b, a), Clash)


@pytest.mark.parametrize(("flag", "a", "b"), STRICT, ids=str)
def test_flags_forbid(flag, a, b):
    assert not isinstance(promote(a, b), Clash)
    for x, y in ((a, b), (b, a)):
        found = promote(x, y, Policy(**{flag: True}))
        assert isinstance(found, Clash) and flag in found.reason


def test_flags_leave_equal_types_alone():
    strict = Policy(**{f: True for f in Policy.__dataclass_fields__ if f.startswith("strict_") and "ordering" not in f})
    kinds = [I16, F32, L.decimal(10, 2), L.STRING, L.LARGE_BINARY, L.timestamp("us", "UTC"), L.time("ns"), L.list_of(I32), L.map_of(L.STRING, I64), L.struct_of(("a", I8)), L.NULL]
    schema = [(f"c{i}", k) for i, k in enumerate(kinds)]
    found = compare_schemas(schema, schema, strict)
    assert found.ok and [k for _, k in found.common_schema.fields] == kinds
    assert len([f for f in Policy.__dataclass_fields__]) == 14


def test_policy_conflicts():
    for pair in (("strict_column_ordering", "allow_extra_columns_in_result"), ("strict_struct_field_ordering", "allow_extra_fields_in_structs")):
        with pytest.raises(SchemaPolicyError):
            Policy(**{p: True for p in pair})
    with pytest.raises(TypeError):
        Policy(no_such_flag=True)


def test_structs():
    a, b = L.struct_of(("x", I8), ("y", L.STRING)), L.struct_of(("y", L.STRING), ("x", I32))
    assert promote(a, b) == b
    assert "struct field order differs" in promote(a, b, Policy(strict_struct_field_ordering=True)).reason
    more = L.struct_of(("x", I8), ("y", L.STRING), ("z", I8))
    assert "unexpected struct fields" in promote(more, a).reason
    assert promote(more, a, Policy(allow_extra_fields_in_structs=True)) == a
    assert "missing struct fields" in promote(a, more, Policy(allow_extra_fields_in_structs=True)).reason
    assert "duplicate struct field names" in promote(L.struct_of(("x", I8), ("x", I8)), L.struct_of(("x", I16))).reason


def test_columns():
    found = compare_schemas([("NUM", I32), ("b", I16)], [("b", I32), ("num", I32)])
    assert found.ok and found.common_schema.fields == (("b", I32), ("num", I32)) and found.columns[1].actual_name == "NUM"
    strict = compare_schemas([("NUM", I32)], [("num", I32)], Policy(case_sensitive_column_names=True))
    assert [c.problem for c in strict.columns] == ["missing column", "unexpected column"]
    order = compare_schemas([("a", I32), ("b", I32)], [("b", I32), ("a", I32)], Policy(strict_column_ordering=True))
    assert not order.ok and "column order differs" in order.problems[0] and order.common_schema is None
    twice = compare_schemas([("a", I32), ("a", I32)], [("a", I32)])
    assert "duplicate column names in actual" in twice.problems[0]
    assert compare_schemas([("a", I32), ("A", I32)], [("a", I32)]).problems
    extra = compare_schemas([("a", I32), ("x", L.BOOL), ("b", I32)], [("a", I32), ("b", I32)])
    assert not extra.ok and extra.columns[2].problem == "unexpected column"
    dropped = compare_schemas([("a", I32), ("x", L.BOOL)], [("a", I32)], Policy(allow_extra_columns_in_result=True))
    assert dropped.ok and dropped.columns[1].common is None and dropped.common_schema.names == ["a"]


def test_arrow_types_are_read_and_kept_in_metadata():
    for t in (
        pa.uint8(), pa.uint64(), pa.float16(), pa.large_string(), pa.string_view(), pa.date64(), pa.timestamp("ns"), pa.timestamp("ms", "Asia/Tokyo"),
        pa.time32("s"), pa.time64("ns"), pa.large_list(pa.int8()), pa.list_(pa.uint16()), pa.map_(pa.string(), pa.float16()), pa.struct([("a", pa.uint8())]), pa.null(),
        pa.decimal128(10, 2), pa.bool_(), pa.binary(), pa.duration("us"),
    ):
        k = L.from_arrow(t)
        assert L.kind_of(L.field_of("c", k)) == L.Kind.from_json(k.to_json()) == k
        assert L.to_arrow(k) == t
    with pytest.raises(TypeError):
        L.from_arrow(pa.dictionary(pa.int8(), pa.string()))
    assert not L.sortable(L.list_of(I8)) and L.sortable(L.struct_of(("a", I8))) and not L.sortable(L.struct_of(("a", L.map_of(I8, I8))))
