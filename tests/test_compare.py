"""Comparisons of tables: stages, order, nulls and NaN, nested values, casts and reports."""

import datetime as dt
import decimal
import math

import numpy as np
import pyarrow as pa
import pytest

import tessera as t
from tessera.operators.compare import SortTable, tally
from tessera.operators.positions import POSITION, given_positions, sorted_positions
from tessera.types import Schema

INT, STR, FLOAT = t.SqlType.INT, t.SqlType.STRING, t.SqlType.FLOAT


def table(columns, *rows):
    return t.FixtureData(list(rows), [t.FixtureColumn(n, k) for n, k in columns])


AB = [("a", INT), ("b", STR)]


AB_DATA = table(AB, (1, "x"), (None, "y"))


def diffs(*args, **kwargs):
    return [(d.row, d.columns) for d in t.compare_tables(*args, **kwargs).row_diffs]


def test_equal_tables_and_unreached_stages(spark):
    same = t.compare_tables(table(AB, (1, "x"), (2, "y")), table(AB, (1, "x"), (2, "y")))
    assert same.ok and same.row_diffs == () and same.row_count is None
    missing = t.compare_tables(table([("a", INT)], (1,)), table(AB, (1, "x")))
    assert not missing.ok and (missing.actual, missing.row_count, missing.row_diffs) == (None, None, None)
    assert t.compare_tables(table([("a", INT)]), table([("a", INT)])).ok
    assert t.compare_tables(pa.table({"a": [1], "b": ["x"]}), spark.createDataFrame([(1, "x")], "a bigint, b string")).ok


def test_row_counts_stop_the_comparison(spark):
    found = t.compare_tables(table(AB, (1, "x"), (1, "x"), (2, "y")), table(AB, (1, "x"), (2, "y")))
    assert found.row_count == t.RowCountMismatch(3, 2) and found.row_diffs is None and not found.ok
    assert "expected 2 rows, actual 3 rows" in t.summary(found)
    assert t.compare_tables(table([("a", INT)]), table([("a", INT)], (1,))).row_count == t.RowCountMismatch(0, 1)


def test_sorting(spark):
    a = [("a", INT)]
    assert t.compare_tables(table(a, (2,), (1,), (3,)), table(a, (1,), (2,), (3,))).ok
    assert diffs(table(a, (2,), (1,)), table(a, (1,), (2,)), sort_results=False) == [(0, ("a",)), (1, ("a",))]
    left = table(AB, (5, "five??"), (1, "one"), (5, "five"))
    assert t.compare_tables(left, table(AB, (1, "one"), (5, "five"), (5, "five??")), sort_by=["A", "a"]).ok
    lead = t.compare_tables(table([("a", INT), ("b", INT)], (1, 9), (2, 9), (3, 0)), table([("a", INT), ("b", INT)], (1, 9), (2, 9), (3, 0)), sort_by=["b"])
    assert [r.a for r in lead.actual.collect()] == [3, 1, 2] and lead.actual.columns == ["a", "b"]
    assert diffs(table(AB, (3, "c"), (1, "a"), (2, "WRONG")), table(AB, (1, "a"), (2, "b"), (3, "c"))) == [(1, ("b",))]


def test_errors_come_in_order(spark):
    a, items = table([("a", INT)], (1,)), pa.table({"items": [[1]]})
    with pytest.raises(t.SortOptionsError):
        t.compare_tables(object(), a, sort_by=[], sort_results=False)
    with pytest.raises(t.TableConversionError) as e:
        t.compare_tables(object(), 5, sort_by=["none"])
    assert e.value.side == "actual" and isinstance(e.value.cause, TypeError)
    with pytest.raises(t.SortColumnError) as e:
        t.compare_tables(table([("b", STR)], ("x",)), a, sort_by=["b"])
    assert e.value.reason == "missing" and e.value.available == ("a",)
    with pytest.raises(t.SortColumnError) as e:
        t.compare_tables(items, items, sort_by=["items"])
    assert e.value.reason == "unsortable"
    with pytest.raises(t.SortColumnError):
        t.compare_tables(items, pa.table({"items": pa.nulls(1)}), sort_by=["items"])
    for rows in ([("not a number",)], [(1, 2)]):
        bad = t.FixtureData(rows, [t.FixtureColumn("a", INT)])
        for _ in range(2):
            with pytest.raises(t.TableConversionError):
                t.compare_tables(bad, a)
    assert not issubclass(t.TableMismatchError, t.ComparisonError)


def test_nulls_and_nan(spark):
    a, f = [("a", INT)], [("a", FLOAT)]
    assert t.compare_tables(table(a, (1,), (None,)), table(a, (1,), (None,))).ok
    assert diffs(table(a, (1,), (None,)), table(a, (1,), (2,))) == [(1, ("a",))]
    assert t.compare_tables(table(f, (math.nan,), (1.0,)), table(f, (1.0,), (math.nan,))).ok
    assert diffs(table(f, (math.nan,), (1.0,)), table(f, (1.0,), (1.0,)), sort_results=False) == [(0, ("a",))]
    assert t.compare_tables(table(f, (-0.0,)), table(f, (0.0,))).ok
    void = pa.table({"a": pa.nulls(2)})
    assert t.compare_tables(void, void).ok and t.compare_tables(void, void, sort_results=False).ok


def test_nested_values(spark):
    def side(item, k):
        return pa.table({"a": [1, 2], "items": [[1, 2], [3, item]], "info": [{"k": 1}, {"k": k}]})

    assert diffs(side(4, 5), side(0, 0)) == [(1, ("items", "info"))]
    assert t.compare_tables(side(4, 5), side(4, 5)).ok
    maps = [pa.table({"m": pa.array([[("a", 1), ("b", x)]], pa.map_(pa.string(), pa.int64()))}) for x in (2, 3)]
    assert t.compare_tables(maps[0], maps[0]).ok and diffs(*maps) == [(0, ("m",))]
    null_struct = spark.sql("select cast(null as struct<k:int>) s")
    assert diffs(null_struct, spark.sql("select named_struct('k', cast(null as int)) s")) == [(0, ("s",))]
    text = t.summary(t.compare_tables(side(4, 5), side(0, 5)))
    assert "row 1, column 'items': expected [3, 0], actual [3, 4]" in text


def test_casts(spark):
    ok = t.compare_tables(spark.sql("select cast(1 as smallint) A, 'x' b, true extra"), spark.sql("select 'x' B, 1L a"), policy=t.Policy(allow_extra_columns_in_result=True))
    assert ok.ok and ok.actual.columns[:2] == ["B", "a"]
    struct = t.compare_tables(
        spark.sql("select named_struct('c', true, 'b', 'x', 'a', cast(1 as smallint)) s, map('k', cast(1 as smallint)) m, array(cast(1 as smallint)) l"),
        spark.sql("select named_struct('a', 1, 'b', 'x') s, map('k', 1L) m, array(1L) l"),
        policy=t.Policy(allow_extra_fields_in_structs=True),
    )
    assert struct.ok
    mixed = t.compare_tables(spark.sql("select named_struct('a', 1, 'A', 2) s"), spark.sql("select named_struct('A', 2L, 'a', 1L) s"))
    assert mixed.ok
    assert t.compare_tables(spark.sql("select null x, array() l"), spark.sql("select 1 x, array(1) l")).row_diffs == (t.RowDiff(0, ("x", "l")),)
    assert diffs(spark.sql("select cast(0.1 as float) f"), spark.sql("select 0.1d f")) == [(0, ("f",))]
    with pytest.raises(ValueError):
        t.cast_to_common(spark.range(1), spark.range(1), t.compare_schemas(spark.range(1).schema, spark.sql("select 'x' id").schema))


@pytest.mark.parametrize("year", [3000, 9999])
def test_nanoseconds_that_do_not_fit(spark, year):
    when = dt.datetime(year, 1, 1)
    us, ns = pa.timestamp("us"), pa.timestamp("ns")
    for make in (lambda v, k: pa.array([v], k), lambda v, k: pa.array([[v]], pa.list_(k)), lambda v, k: pa.array([{"x": v}], pa.struct([("x", k)]))):
        fine = dt.datetime(2020, 1, 1)
        with pytest.raises(t.SchemaCastError) as e:
            t.compare_tables(pa.table({"when": make(when, us)}), pa.table({"when": make(fine, ns)}))
        assert e.value.column == "when" and e.value.side == "actual" and str(year) in str(e.value.cause)
        assert t.compare_tables(pa.table({"when": make(fine, us)}), pa.table({"when": make(fine, ns)})).ok


def test_logical_types_without_a_spark_type(spark):
    cases = [(pa.uint8(), pa.uint64(), 7), (pa.float16(), pa.float64(), 0.5), (pa.string_view(), pa.large_string(), "x"), (pa.time32("s"), pa.time64("ns"), dt.time(1, 2, 3)),
             (pa.timestamp("s", "Asia/Tokyo"), pa.timestamp("us", "UTC"), dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)), (pa.int32(), pa.decimal128(38, 0), 12)]
    for a, b, v in cases:
        left = np.float16(v) if a == pa.float16() else v
        right = decimal.Decimal(v) if pa.types.is_decimal(b) else v
        found = t.compare_tables(pa.table({"c": pa.array([left, None], a)}), pa.table({"c": pa.array([right, None], b)}))
        assert found.ok, (a, b, t.summary(found))
    assert not t.compare_tables(pa.table({"c": pa.array([1], pa.int64())}), pa.table({"c": pa.array([1], pa.uint64())})).schema.ok


def test_fixture_types(spark):
    kinds = list(t.SqlType)
    values = {"INT": 1.0, "BIGINT": 2**40, "FLOAT": 1, "STRING": "x", "DATE": dt.date(2020, 1, 2), "BOOLEAN": True, "TIME": dt.time(1, 2, 3)}
    values |= {f"DECIMAL{i}": 1.5 for i in range(1, 6)} | {f"TIMESTAMP_NTZ{i}": dt.datetime(2020, 1, 1, 2) for i in (0, 3, 6, 9)}
    data = t.FixtureData([tuple(values[k.name] for k in kinds), (None,) * len(kinds)], [t.FixtureColumn(k.name, k) for k in kinds])
    df = data.to_df(spark)
    assert df.count() == 2 and data.to_df(spark) is df
    assert t.compare_tables(AB_DATA.to_arrow(), AB_DATA).ok and AB_DATA.to_arrow().schema == pa.schema([("a", pa.int32()), ("b", pa.string())])
    assert t.compare_tables(df, data).ok and t.FixtureColumn("a", pa.int32()) == t.FixtureColumn("a", INT)
    assert dict(df.dtypes)["TIMESTAMP_NTZ9"] == "bigint" and dict(df.dtypes)["TIMESTAMP_NTZ6"] == "timestamp_ntz"
    for value, kind in ((1.5, INT), (2**40, INT), (True, INT), ("1", FLOAT), (1.55, t.SqlType.DECIMAL1), (1, STR)):
        with pytest.raises((TypeError, ValueError)):
            t.FixtureData([(value,)], [t.FixtureColumn("a", kind)]).to_df(spark)


def test_report(spark):
    found = t.compare_tables(table([("a", INT)], *((i,) for i in range(15))), table([("a", INT)], *((i + 100,) for i in range(15))))
    lines = t.summary(found).splitlines()
    assert lines[0] == "15 of 15 rows differ:" and len(lines) == 12 and lines[-1] == "  ... and 5 more rows"
    assert lines[1] == "  row 0, column 'a': expected 100, actual 0"
    three = [("c1", INT), ("c2", STR), ("c3", INT)]
    with pytest.raises(t.TableMismatchError) as e:
        t.assert_equals(table(three, (123, "bye", 1004), (7, "same", 8)), table(three, (123, "hello", 1004), (7, "same", 8)))
    assert "row 1, column 'c2': expected 'hello', actual 'bye'" in str(e.value) and e.value.comparison.row_diffs == (t.RowDiff(1, ("c2",)),)
    with pytest.raises(t.TableMismatchError) as e:
        t.assert_equals(table([("a", INT)], (1,)), table([("a", STR), ("b", STR)], ("x", "y")))
    assert "missing column" in str(e.value) and "'b'" in str(e.value)
    t.assert_equals(table(AB, (1, "x")), table(AB, (1, "x")))
    cells = t.compare_tables(table(AB, (1, "x"), (2, None)), table(AB, (1, "x"), (2, "z")), sort_results=False).cell_diffs().collect()
    assert [tuple(r) for r in cells] == [(1, "b", "z", None)]


def test_positions_do_not_depend_on_the_parts(spark):
    df = spark.range(3000).selectExpr("id % 7 as k", "case when id % 5 = 0 then null else id % 11 end as v", "array(id) as items").repartition(6).cache()
    keys = SortTable.of(Schema.of(df.schema), t.Policy()).keys([])
    one = sorted_positions(df, keys, 3000).select("k", "v", "items", POSITION)
    many = sorted_positions(df, keys, 3000, rows_per_part=10).select("k", "v", "items", POSITION)
    assert sorted(r[POSITION] for r in many.collect()) == list(range(3000))
    assert {(r.k, r.v, r[POSITION]) for r in one.collect()} == {(r.k, r.v, r[POSITION]) for r in many.collect()}
    in_order = spark.range(500).repartition(4).orderBy("id")
    assert [r.id for r in given_positions(in_order).orderBy(POSITION).collect()] == list(range(500))
    assert t.compare_tables(df, df.repartition(3), rows_per_part=10).diff_count is not None


@pytest.mark.parametrize("change", ["id", "case when id = 1500 then 9 else g end"])
def test_results_are_the_same_at_every_size(spark, change):
    left = spark.range(2000).selectExpr("id", "id % 3 as g")
    right = left.selectExpr("id", f"cast({change if change != 'id' else 'g'} as bigint) as g").repartition(5)
    found = [t.compare_tables(left, right, sort_by=["id"], rows_per_part=n) for n in (1, 100, 50_000)]
    for x in found:
        assert x.row_diffs == (() if change == "id" else (t.RowDiff(1500, ("g",)),)) and x.rows == 2000
        for side in (x.actual, x.expected):
            assert side.columns == ["id", "g"] and [r.id for r in side.collect()] == list(range(2000))
    short = [t.compare_tables(left, right.limit(7), rows_per_part=n) for n in (1, 50_000)]
    for x in short:
        assert x.row_count == t.RowCountMismatch(2000, 7) and x.actual.columns == x.expected.columns == ["id", "g"]
    assert tally(left, right, found[0].schema).actual == 2000


def test_any_column_name_will_do(spark):
    names = ["__position", "__place", "__part", "__before", "a`b", "a.b", "c0", "columns", "n_actual", "k0", "bad0", "é x"]
    left = spark.range(300).selectExpr(*[f"id + {i} as c{i}" for i in range(len(names))]).toDF(*names)
    right = left.toDF(*[f"x{i}" for i in range(len(names))]).selectExpr(*[f"case when x4 = 20 then 0 else x{i} end" for i in range(len(names))]).toDF(*names)
    for options in ({"sort_by": ["a`b"]}, {"sort_by": ["__position"], "rows_per_part": 10}, {"sort_results": False}):
        found = t.compare_tables(left, right, **options)
        assert found.actual.columns == names and found.diff_count and "a`b" in t.summary(found)
        assert found.cell_diffs().count() >= len(names)
    assert t.compare_tables(left, left.repartition(3)).ok


def test_names_that_differ_by_case(spark):
    twins = spark.sql("select 1 a, 2 A, named_struct('x', 1, 'X', 2, 'm', map('k', 1)) s")
    policy = t.Policy(case_sensitive_column_names=True)
    assert t.compare_tables(twins, twins, policy=policy).ok
    other = spark.sql("select 1 a, 3 A, named_struct('x', 1, 'X', 5, 'm', map('k', 1)) s")
    assert diffs(other, twins, policy=policy) == [(0, ("A", "s"))]
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_a_side_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(400).selectExpr("id", "id % 5 as g").mapInArrow(counted, "id long, g long")
    assert t.compare_tables(rows, spark.range(400).selectExpr("id", "id % 5 as g")).ok and read.value == 400


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from tessera.operators.positions import stable

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stable(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))))


def test_streams(spark, tmp_path):
    from tessera.streaming import stream_equals

    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").selectExpr("id + 1 as id")
    assert stream_equals(stream, pa.table({"id": [5, 4, 3, 2, 1]}), f"{tmp_path}/out", f"{tmp_path}/check").ok
