"""The registered queries of the snippet and comparison engine, each with the SQL that must give the same rows.

Every query runs over whole tables. "Changed" orders are a copy in which each 97th key has one more in its total price.
Errors and reports are given as rows, so that they can be compared too.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import types as L
from tessera.errors import ComparisonError
from tessera.operators.compare import SortTable, cast_to_common, compare_tables
from tessera.operators.positions import POSITION, given_positions, sorted_positions
from tessera.operators.report import assert_equals, summary
from tessera.plans.policy import Policy
from tessera.plans.schemas import compare_schemas
from tessera.plans.script import Script
from tessera.plans.snippet import by_tag
from tessera.sources.fixtures import FixtureColumn, FixtureData, SqlType
from tessera.sources.tables import to_df
from tessera.types import Schema, kind_of

Query = Callable[[SparkSession, str], DataFrame]

SCRIPT_PATH = Path(__file__).with_name("catalog.sql")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def equals(sql: str) -> Callable[[Query], Query]:
    """Register a query with the SQL that must give the same rows."""

    def registered(query: Query) -> Query:
        _queries[query.__name__], _oracles[query.__name__] = query, sql
        return query

    return registered


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _snippet(spark: SparkSession, tag: str):
    return by_tag(spark, tag, SCRIPT_PATH)


# Snippets.

_SALES = "SELECT o_orderkey AS orderkey, o_custkey AS custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), cents.alias("cents"))


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"c_custkey": "custkey", "c_name": "name", "c_nationkey": "nationkey", "c_mktsegment": "segment"}
    return _read(spark, sf_dir, "customer").select(*[F.col(a).alias(b) for a, b in names.items()])


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snippet's result over ``orders`` against an expectation that is wrong in one cell: the cells that differ."""
    sales = _sales(spark, sf_dir)
    actual = _snippet(spark, "fees").run({"sales": sales})
    fee = F.when(F.col("orderkey") == 5, 0).otherwise(F.col("cents") + 250)
    return compare_tables(actual, sales.withColumn("with_fee", fee), sort_by=["orderkey"]).cell_diffs()


@equals(f"SELECT *, cents + 250 AS with_fee FROM ({_SALES})")
def snippet_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snippet(spark, "fees").run({"sales": _sales(spark, sf_dir)})


@equals(f"SELECT custkey, count(*) AS n_orders, CAST(sum(cents) AS BIGINT) AS spent FROM ({_SALES}) GROUP BY custkey")
def snippet_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script read from its path."""
    return by_tag(spark, "spending", str(SCRIPT_PATH)).run({"sales": _sales(spark, sf_dir)})


@equals("SELECT DISTINCT c_mktsegment AS segment, CAST(length(c_mktsegment) AS INTEGER) AS letters FROM customer")
def snippet_distinct_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snippet(spark, "segment_letters").run({"clients": _clients(spark, sf_dir)}, descend=True)


@equals(f"""
    WITH sales AS ({_SALES})
    SELECT c_custkey AS custkey, c_name AS name, s.n_orders, CAST(s.spent AS BIGINT) AS spent, n_name AS nation,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'tools' WHEN 'MACHINERY' THEN 'oil' END AS perk
    FROM customer LEFT JOIN (SELECT custkey, count(*) AS n_orders, sum(cents) AS spent FROM sales GROUP BY custkey) s ON s.custkey = c_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey + 1""")
def snippet_cte_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the nations are shifted by one, so that some customers find none."""
    sales = _sales(spark, sf_dir)
    nations = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") - 1).alias("nationkey"), F.col("n_name").alias("nation"))
    spending = _snippet(spark, "spending").run({"sales": sales})
    return _snippet(spark, "customer_report").run({"c": _clients(spark, sf_dir), "s": spending, "h": nations})


@equals("""
    SELECT a.s_suppkey AS suppkey, a.s_name AS name, b.s_suppkey AS next_key, 'next ' || b.s_name AS next_name
    FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1""")
def snippet_self_join_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aliases of one table get fixtures of their own."""
    suppliers = _suppliers(spark, sf_dir)
    return _snippet(spark, "neighbours").run({"a": suppliers, "b": suppliers.withColumn("name", F.concat(F.lit("next "), "name"))})


@equals("""
    SELECT c_custkey AS custkey, c_nationkey AS first, 7 AS second, c_nationkey AS entry, c_nationkey AS x, c_name AS y, CAST(c_nationkey AS BIGINT) AS i,
           TIMESTAMP '2024-02-29 12:30:00' AS t FROM customer""")
def snippet_nested_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of lists, maps, structs and timestamps, and casts, taken apart again."""
    found = _snippet(spark, "nested").run({"clients": _clients(spark, sf_dir)})
    return found.select(
        "custkey", F.col("l")[0].cast("int").alias("first"), F.col("l")[1].cast("int").alias("second"), F.col("m")["n"].cast("int").alias("entry"), "s.x", "s.y", "i", "t"
    )


#: Rows of a fixture, and the same as SQL.
FIXTURE = FixtureData(
    [(10, "bolt", 0.25), (11, "nut", None), (12, None, -1.5), (10, "bolt, long", 0.0)],
    [FixtureColumn("sku", SqlType.INT), FixtureColumn("label", SqlType.STRING), FixtureColumn("weight", SqlType.FLOAT)],
)


@equals("""
    SELECT sku::INTEGER AS sku, label, weight::DOUBLE AS weight
    FROM (VALUES (10, 'bolt', 0.25), (11, 'nut', NULL), (12, NULL, -1.5), (10, 'bolt, long', 0.0)) t(sku, label, weight)""")
def fixture_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FIXTURE.to_df(spark)


@equals("""
    SELECT tag, place::INTEGER AS place, alias FROM (VALUES ('fees', 0, 'sales'), ('customer_report', 0, 'c'), ('customer_report', 1, 's'),
    ('customer_report', 2, 'h'), ('neighbours', 0, 'a'), ('neighbours', 1, 'b'), ('segment_letters', 0, '')) t(tag, place, alias)""")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = ("fees", "customer_report", "neighbours", "segment_letters")
    rows = [(tag, i, name) for tag in tags for i, name in enumerate(_snippet(spark, tag).source_aliases())]
    return spark.createDataFrame(rows, "tag string, place int, alias string")


@equals("""
    SELECT tag, lacking FROM (VALUES ('customer_report', 'c'), ('customer_report', 's'), ('customer_report', 'h'),
    ('neighbours', 'a'), ('neighbours', 'b'), ('fees', 'sales')) t(tag, lacking)""")
def missing_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source left out in turn, as the error names it."""
    rows = []
    for tag in ("customer_report", "neighbours", "fees"):
        snippet = _snippet(spark, tag)
        names = snippet.source_aliases()
        for left_out in names:
            e = _error(lambda: snippet.run({n: FIXTURE for n in names if n != left_out}))
            rows.append((e.tag, e.alias))
    return spark.createDataFrame(rows, "tag string, lacking string")


@equals("SELECT n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, 'uint16 large_string timestamp[ns]' AS kinds FROM nation")
def arrow_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Arrow table with types that Spark does not have."""
    own = _read(spark, sf_dir, "nation").toArrow()  # 25 rows, whatever the scale
    types = {"n_nationkey": pa.uint16(), "n_name": pa.large_string(), "n_regionkey": pa.timestamp("ns")}
    regions = own.column("n_regionkey").cast(pa.int64())
    made = pa.table([(regions if n == "n_regionkey" else own.column(n)).cast(t) for n, t in types.items()], names=list(types))
    df = to_df(made, "actual", spark)
    return df.withColumn("kinds", F.lit(" ".join(str(kind_of(f)) for f in df.schema.fields)))


# Schemas.

#: Columns of an actual and an expected schema that show one promotion rule each.
RULES = {
    "same": (L.STRING, L.STRING),
    "null_any": (L.NULL, L.integer(32)),
    "int_widths": (L.integer(16), L.integer(64)),
    "signs": (L.integer(32), L.integer(32, False)),
    "float_widths": (L.floating(32), L.floating(64)),
    "decimal_precision": (L.decimal(10, 2), L.decimal(18, 2)),
    "decimal_scale": (L.decimal(18, 2), L.decimal(18, 3)),
    "int_decimal": (L.integer(32), L.decimal(5, 0)),
    "uint64_decimal": (L.integer(64, False), L.decimal(5, 0)),
    "int_decimal_scale": (L.integer(32), L.decimal(10, 2)),
    "text": (L.STRING, L.LARGE_STRING),
    "bytes": (L.BINARY_VIEW, L.BINARY),
    "time_units": (L.time("ms"), L.time("us")),
    "time_stamps": (L.timestamp("ms"), L.timestamp("us")),
    "zones": (L.timestamp("us", "Asia/Tokyo"), L.timestamp("us", "Europe/Paris")),
    "zone_or_none": (L.timestamp("us"), L.timestamp("us", "UTC")),
    "dates": (L.DATE32, L.DATE64),
    "list": (L.list_of(L.integer(8)), L.list_of(L.integer(32), "large")),
    "map_values": (L.map_of(L.STRING, L.integer(16)), L.map_of(L.STRING, L.integer(64))),
    "map_both": (L.map_of(L.integer(8), L.STRING), L.map_of(L.integer(32), L.LARGE_STRING)),
    "map_keys": (L.map_of(L.integer(8), L.STRING), L.map_of(L.STRING, L.STRING)),
    "struct": (L.struct_of(("b", L.integer(16)), ("a", L.STRING)), L.struct_of(("a", L.STRING), ("b", L.integer(32)))),
    "deep": (L.list_of(L.list_of(L.integer(8))), L.list_of(L.list_of(L.integer(16)))),
    "int_float": (L.integer(64), L.floating(64)),
    "missing": (None, L.BOOL),
    "extra": (L.BOOL, None),
}


@equals("""
    SELECT * FROM (VALUES ('same', 'ok', 'string'), ('null_any', 'ok', 'int32'), ('int_widths', 'ok', 'int64'),
    ('signs', 'fails', NULL), ('float_widths', 'ok', 'float64'), ('decimal_precision', 'ok', 'decimal(18, 2)'),
    ('decimal_scale', 'fails', NULL), ('int_decimal', 'ok', 'decimal(10, 0)'), ('uint64_decimal', 'ok', 'decimal(20, 0)'), ('int_decimal_scale', 'fails', NULL),
    ('text', 'ok', 'large_string'), ('bytes', 'ok', 'large_binary'), ('time_units', 'ok', 'time[us]'), ('time_stamps', 'ok', 'timestamp[us]'),
    ('zones', 'ok', 'timestamp[us, tz=UTC]'), ('zone_or_none', 'fails', NULL), ('dates', 'fails', NULL),
    ('list', 'ok', 'large_list<int32>'), ('map_values', 'ok', 'map<string, int64>'), ('map_both', 'ok', 'map<int32, large_string>'), ('map_keys', 'fails', NULL),
    ('struct', 'ok', 'struct<a: string, b: int32>'), ('deep', 'fails', NULL),
    ('int_float', 'fails', NULL), ('missing', 'fails', NULL), ('extra', 'fails', NULL)) t(name, verdict, common)""")
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [Schema(tuple((n, pair[i]) for n, pair in RULES.items() if pair[i] is not None)) for i in (0, 1)]
    rows = [(c.name, "ok" if c.ok else "fails", str(c.common) if c.common else None) for c in compare_schemas(*sides).columns]
    return spark.createDataFrame(rows, "name string, verdict string, common string")


#: Each strict flag with columns that agree without it alone.
FLAGS = {
    "strict_null_types": ("null_any",),
    "strict_int_widths": ("int_widths",),
    "strict_integer_vs_decimal": ("int_decimal", "uint64_decimal"),
    "strict_decimal_precision": ("decimal_precision",),
    "strict_float_widths": ("float_widths",),
    "strict_large_variants": ("text", "bytes", "list"),
    "strict_temporal_units": ("time_units", "time_stamps"),
    "strict_tz_names": ("zones",),
    "strict_nested_children": ("list", "map_values", "map_both", "struct"),
    "strict_struct_field_ordering": ("struct",),
}


@equals("""
    SELECT flag, name, true AS without, false AS "with" FROM (VALUES ('strict_null_types', 'null_any'), ('strict_int_widths', 'int_widths'),
    ('strict_integer_vs_decimal', 'int_decimal'), ('strict_integer_vs_decimal', 'uint64_decimal'), ('strict_decimal_precision', 'decimal_precision'),
    ('strict_float_widths', 'float_widths'), ('strict_large_variants', 'text'), ('strict_large_variants', 'bytes'), ('strict_large_variants', 'list'),
    ('strict_temporal_units', 'time_units'), ('strict_temporal_units', 'time_stamps'), ('strict_tz_names', 'zones'), ('strict_nested_children', 'list'),
    ('strict_nested_children', 'map_values'), ('strict_nested_children', 'map_both'), ('strict_nested_children', 'struct'),
    ('strict_struct_field_ordering', 'struct')) t(flag, name)""")
def strict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for flag, names in FLAGS.items():
        for name in names:
            sides = [[(name, k)] for k in RULES[name]]
            rows.append((flag, name, compare_schemas(*sides).ok, compare_schemas(*sides, Policy(**{flag: True})).ok))
    return spark.createDataFrame(rows, "flag string, name string, without boolean, `with` boolean")


@equals("""
    SELECT * FROM (VALUES ('twice', 'duplicate column names in actual: [''o_custkey'']'), ('twins', 'duplicate column names in expected: [''O_CUSTKEY'', ''o_custkey'']'),
    ('struct', 'duplicate struct field names in actual: [''x'']')) t(name, problem)""")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    twins = orders.select("*", F.col("o_custkey").alias("O_CUSTKEY"))
    found = [
        ("twice", compare_schemas(orders.select("*", "o_custkey").schema, orders.schema).problems),
        ("twins", compare_schemas(orders.schema, twins.schema, Policy()).problems),
        ("none", compare_schemas(twins.schema, twins.schema, Policy(case_sensitive_column_names=True)).problems),
    ]
    x, y = ("x", L.integer(8)), ("y", L.integer(8))
    fields = compare_schemas([("s", L.struct_of(x, x, y))], [("s", L.struct_of(x, y))]).columns[0].problem
    rows = [(name, p) for name, problems in found for p in problems]
    return spark.createDataFrame([*rows, ("struct", fields)], "name string, problem string")


@equals("""
    SELECT * FROM (VALUES ('any', true, ''), ('swapped', false, 'column order differs: expected [''n_nationkey'', ''n_name'', ''n_regionkey''], actual [''n_name'', ''n_nationkey'', ''n_regionkey'']'),
    ('case', true, '')) t(name, ok, problem)""")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    swapped, strict = nation.select("n_name", "n_nationkey", "n_regionkey").schema, Policy(strict_column_ordering=True)
    upper = nation.toDF(*[n.upper() for n in nation.columns]).schema
    found = {"any": compare_schemas(swapped, nation.schema), "swapped": compare_schemas(swapped, nation.schema, strict), "case": compare_schemas(upper, nation.schema, strict)}
    return spark.createDataFrame([(n, c.ok, "; ".join(c.problems)) for n, c in found.items()], "name string, ok boolean, problem string")


@equals("""
    SELECT * FROM (VALUES ('strict_column_ordering allow_extra_columns_in_result', 'SchemaPolicyError'),
    ('strict_struct_field_ordering allow_extra_fields_in_structs', 'SchemaPolicyError'), ('strict_column_ordering allow_extra_fields_in_structs', 'none'),
    ('no_such_flag', 'TypeError')) t(flags, outcome)""")
def policy_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = (
        "strict_column_ordering allow_extra_columns_in_result", "strict_struct_field_ordering allow_extra_fields_in_structs",
        "strict_column_ordering allow_extra_fields_in_structs", "no_such_flag",
    )
    rows = [(flags, _outcome(lambda: Policy(**{f: True for f in flags.split()}))) for flags in cases]
    return spark.createDataFrame(rows, "flags string, outcome string")


# Casts.


def _cast(actual: DataFrame, expected: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return cast_to_common(actual, expected, compare_schemas(actual.schema, expected.schema, policy))[0]


@equals("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'decimal(20,0)' AS kind FROM lineitem")
def promote_int_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    out = _cast(lines, lines.withColumn("l_linenumber", F.col("l_linenumber").cast("decimal(20,0)")))
    kind = F.lit(out.schema["l_linenumber"].dataType.simpleString()).alias("kind")
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), kind)


@equals("SELECT c_custkey, c_nationkey, c_name FROM customer")
def cast_reorder_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer")
    actual = customers.select(
        F.col("c_name").alias("C_NAME"), F.col("c_nationkey").cast("smallint").alias("C_NATIONKEY"), F.col("c_custkey").alias("C_CustKey")
    )
    return _cast(actual, customers.select("c_custkey", "c_nationkey", "c_name"))


@equals("SELECT c_custkey, c_nationkey::BIGINT AS n, c_name AS name FROM customer")
def cast_struct_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer")
    actual = customers.select("c_custkey", F.struct("c_name", F.col("c_nationkey").cast("smallint").alias("n"), "c_acctbal").alias("s"))
    expected = customers.select("c_custkey", F.struct(F.col("c_nationkey").cast("bigint").alias("n"), "c_name").alias("s"))
    out = _cast(actual, expected, Policy(allow_extra_fields_in_structs=True))
    return out.select("c_custkey", F.col("s.n").alias("n"), F.col("s.c_name").alias("name"))


@equals("SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, 'array<double>' AS kind FROM embeddings")
def cast_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of 32-bit floats against one of 64-bit floats."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = _cast(vectors, vectors.withColumn("embedding", F.col("embedding").cast("array<double>")))
    kind = F.lit(out.schema["embedding"].dataType.simpleString()).alias("kind")
    return out.select("vec_id", F.size("embedding").alias("n"), F.col("embedding")[0].alias("first"), F.element_at("embedding", -1).alias("last"), kind)


@equals("SELECT p_partkey, p_size::BIGINT AS size, p_partkey AS key, 'map<string,bigint>' AS kind FROM part")
def cast_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of small integers against one of large ones."""
    part = _read(spark, sf_dir, "part")

    def side(first, second) -> DataFrame:
        return part.select("p_partkey", F.create_map(F.lit("size"), first, F.lit("key"), second).alias("facts"))

    small = F.col("p_size").cast("int")
    out = _cast(side(small, F.col("p_partkey").cast("int")), side(small.cast("bigint"), F.col("p_partkey").cast("bigint")))
    kind = F.lit(out.schema["facts"].dataType.simpleString()).alias("kind")
    return out.select("p_partkey", F.col("facts")["size"].alias("size"), F.col("facts")["key"].alias("key"), kind)


@equals("SELECT p_partkey, NULL::INTEGER AS x, 0 AS n, 'int array<string>' AS kinds FROM part")
def cast_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold nothing but nulls take the other side's type, in lists too."""
    part = _read(spark, sf_dir, "part").select("p_partkey")
    out = _cast(part.withColumns({"x": F.lit(None), "l": F.array()}), part.withColumns({"x": F.lit(1), "l": F.array(F.lit("a"))}))
    kinds = F.lit(" ".join(out.schema[n].dataType.simpleString() for n in ("x", "l")))
    return out.select("p_partkey", "x", F.size("l").alias("n"), kinds.alias("kinds"))


@equals("SELECT s_name, s_suppkey FROM supplier")
def extra_columns_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _read(spark, sf_dir, "supplier")
    return _cast(supplier, supplier.select("s_name", "s_suppkey"), Policy(allow_extra_columns_in_result=True))


# Order.


def _sorted(df: DataFrame, sort_by: list[str]) -> DataFrame:
    keys = SortTable.of(Schema.of(df.schema), Policy()).keys(sort_by)
    return sorted_positions(df, keys, df.count()).withColumnRenamed(POSITION, "position")


@equals("""
    SELECT *, row_number() OVER (ORDER BY o_orderkey NULLS LAST, o_custkey NULLS LAST, o_orderstatus NULLS LAST,
    o_totalprice NULLS LAST, o_orderdate NULLS LAST, o_orderpriority NULLS LAST) - 1 AS position FROM orders""")
def sort_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(_read(spark, sf_dir, "orders"), [])


@equals("""
    SELECT *, row_number() OVER (ORDER BY c_nationkey NULLS LAST, c_mktsegment NULLS LAST, c_custkey NULLS LAST, c_name NULLS LAST,
    c_acctbal NULLS LAST) - 1 AS position FROM customer""")
def sort_by_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(_read(spark, sf_dir, "customer"), ["C_NATIONKEY", "c_mktsegment", "c_nationkey"])


@equals("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM orders")
def given_order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return given_positions(in_order).withColumnRenamed(POSITION, "position")


# Rows and cells.


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _read(spark, sf_dir, "orders")
    changed = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.withColumn("o_totalprice", changed), orders


def _listed(diffs: DataFrame) -> DataFrame:
    return diffs.select(F.col(POSITION).alias("position"), F.concat_ws(",", "columns").alias("columns"))


_ROW_DIFFS = """
WITH a AS (
  SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS price,
         row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders
), e AS (SELECT o_totalprice AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)
SELECT position, 'o_totalprice' AS columns FROM a JOIN e USING (position) WHERE a.price IS DISTINCT FROM e.price
"""


@equals("SELECT count(*) FILTER (o_orderstatus <> 'F') AS actual, count(*) AS expected FROM orders")
def row_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    found = compare_tables(orders.where("o_orderstatus <> 'F'"), orders).row_count
    return spark.createDataFrame([(found.actual, found.expected)], "actual long, expected long")


@equals(_ROW_DIFFS)
def row_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(compare_tables(*_orders(spark, sf_dir), sort_by=["o_orderkey"]).diffs)


@equals("""
    WITH b AS (
      SELECT o_orderkey AS k, o_orderstatus AS es, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderstatus END AS s,
             round(o_totalprice * 100)::BIGINT AS ec,
             round((o_totalprice + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END) * 100)::BIGINT AS c,
             row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders
    )
    SELECT position, 'o_orderstatus' AS "column", es AS expected, coalesce(s, '-') AS actual FROM b WHERE es IS DISTINCT FROM s
    UNION ALL
    SELECT position, 'cents', ec::VARCHAR, c::VARCHAR FROM b WHERE ec IS DISTINCT FROM c""")
def cell_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual, expected = _orders(spark, sf_dir)
    status = F.when(F.col("o_orderkey") % 89 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    sides = [df.select("o_orderkey", s.alias("o_orderstatus"), cents.alias("cents")) for df, s in ((actual, status), (expected, F.col("o_orderstatus")))]
    found = compare_tables(*sides).cell_diffs()
    return found.select(F.col("row").alias("position"), "column", F.coalesce("expected", F.lit("-")).alias("expected"), F.coalesce("actual", F.lit("-")).alias("actual"))


@equals("""
    WITH b AS (
      SELECT row_number() OVER (ORDER BY event_id) - 1 AS position,
             CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 <> 0 THEN value END AS a,
             CASE WHEN event_id % 20 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 <> 0 THEN value END AS e FROM events
    )
    SELECT position, 'value' AS columns FROM b WHERE a IS DISTINCT FROM e""")
def null_nan_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(nan: int, null: int) -> DataFrame:
        value = F.when(F.col("event_id") % nan == 0, F.lit(float("nan"))).when(F.col("event_id") % null != 0, F.col("value"))
        return _read(spark, sf_dir, "events").select("event_id", value.alias("value"))

    return _listed(compare_tables(side(10, 7), side(20, 7), sort_by=["event_id"]).diffs)


@equals("""
    SELECT position, 'embedding' AS columns FROM (
      SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings
    ) WHERE vec_id % 11 = 0 AND (-embedding[1] - 1) IS DISTINCT FROM embedding[1]""")
def nested_array_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    negated = F.transform("embedding", lambda x, i: F.when((i == 0) & (F.col("vec_id") % 11 == 0), -x - 1).otherwise(x))
    return _listed(compare_tables(vectors.withColumn("embedding", negated), vectors, sort_by=["vec_id"]).diffs)


@equals("""
    SELECT position, 'facts' AS columns FROM (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part)
    WHERE p_partkey % 13 = 0""")
def map_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(step: int) -> DataFrame:
        size = F.when(F.col("p_partkey") % 13 == 0, F.col("p_size") + step).otherwise(F.col("p_size"))
        return _read(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("size"), size, F.lit("key"), F.lit(1)).alias("facts"))

    return _listed(compare_tables(side(1), side(0), sort_by=["p_partkey"]).diffs)


@equals(f"SELECT * FROM ({_ROW_DIFFS}) ORDER BY position LIMIT 10")
def top10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_diffs(spark, sf_dir).orderBy("position").limit(10)


@equals("""
    WITH c AS (SELECT * REPLACE (CASE WHEN l_orderkey = 1 THEN 9 ELSE l_linenumber END AS l_linenumber) FROM lineitem)
    SELECT 'shuffled' AS side, count(*) = 0 AS same FROM (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM lineitem)
    UNION ALL
    SELECT 'changed', count(*) = 0 FROM (
      (SELECT * FROM c EXCEPT ALL SELECT * FROM lineitem) UNION ALL (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM c))""")
def multiset_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    shuffled = lines.repartition(7, "l_suppkey")
    changed = lines.withColumn("l_linenumber", F.when(F.col("l_orderkey") == 1, 9).otherwise(F.col("l_linenumber")))
    rows = [(name, compare_tables(df, lines).ok) for name, df in (("shuffled", shuffled), ("changed", changed))]
    return spark.createDataFrame(rows, "side string, same boolean")


@equals("""
    WITH b AS (
      SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS position FROM lineitem
    )
    SELECT position, 'a`b' AS columns FROM b WHERE l_orderkey % 101 = 0""")
def any_column_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns called like the engine's own, and with a backtick."""
    names = ["__position", "__part", "l_partkey", "a`b"]

    def side(step: int) -> DataFrame:
        quantity = F.when(F.col("l_orderkey") % 101 == 0, F.col("l_quantity") + step).otherwise(F.col("l_quantity"))
        return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quantity.alias("q")).toDF(*names)

    return _listed(compare_tables(side(1), side(0), sort_by=["__position"]).diffs)


@equals("""
    SELECT side, position, o_custkey, o_orderkey FROM (
      SELECT 'actual' AS side, o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus <> 'F'
      UNION ALL
      SELECT 'expected', o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 FROM orders)""")
def sorted_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compared sides in their order, which are there although their lengths differ."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    found = compare_tables(_read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey"), orders, sort_by=["o_custkey"])
    sides = [given_positions(df).withColumn("side", F.lit(name)) for name, df in (("actual", found.actual), ("expected", found.expected))]
    return sides[0].unionByName(sides[1]).withColumnRenamed(POSITION, "position")


# Reports and errors, as rows.


def _error(call: Callable[[], object]) -> BaseException | None:
    """What a call raises."""
    try:
        call()
    except Exception as e:
        return e
    return None


def _outcome(call: Callable[[], object]) -> str:
    found = _error(call)
    return "none" if found is None else type(found).__name__


@equals("""
    WITH d AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders),
         x AS (SELECT *, row_number() OVER (ORDER BY position) AS i FROM d WHERE o_orderkey % 97 = 0),
         n AS (SELECT count(*) AS n FROM x), m AS (SELECT count(*) AS n FROM d)
    SELECT 0 AS line, (SELECT n FROM n) || ' of ' || (SELECT n FROM m) || ' rows differ:' AS text
    UNION ALL
    SELECT i::INTEGER, '  row ' || position || ', column ''o_custkey'': expected ' || o_custkey || ', actual ' || (o_custkey + 7) FROM x WHERE i <= 10
    UNION ALL
    SELECT 11, '  ... and ' || ((SELECT n FROM n) - 10) || ' more rows' WHERE (SELECT n FROM n) > 10""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    changed = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 7).otherwise(F.col("o_custkey"))
    found = compare_tables(orders.withColumn("o_custkey", changed), orders, sort_by=["o_orderkey"])
    return spark.createDataFrame(list(enumerate(summary(found).splitlines())), "line int, text string")


@equals("""
    SELECT 'shuffled' AS side, 'none' AS raised, '' AS text
    UNION ALL SELECT 'changed', 'TableMismatchError', count(*) FILTER (o_orderkey % 97 = 0) || ' of ' || count(*) || ' rows differ:' FROM orders
    UNION ALL SELECT 'shorter', 'TableMismatchError', 'The tables have different lengths: expected ' || count(*) || ' rows, actual '
                     || count(*) FILTER (o_orderstatus <> 'F') || ' rows' FROM orders
    UNION ALL SELECT 'narrower', 'TableMismatchError', 'The schemas disagree.'""")
def assert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, orders = _orders(spark, sf_dir)
    sides = {
        "shuffled": orders.repartition(5, "o_custkey"), "changed": changed, "shorter": orders.where("o_orderstatus <> 'F'"), "narrower": orders.drop("o_custkey"),
    }
    rows = []
    for name, df in sides.items():
        e = _error(lambda: assert_equals(df, orders, sort_by=["o_orderkey"]))
        rows.append((name, "none" if e is None else type(e).__name__, "" if e is None else str(e).splitlines()[0]))
    return spark.createDataFrame(rows, "side string, raised string, text string")


@equals("""
    SELECT name, raised, broken_test, detail FROM (VALUES
    ('no table', 'TableConversionError', true, 'actual TypeError'), ('bad fixture', 'TableConversionError', true, 'expected TypeError'),
    ('sort by nothing there', 'SortColumnError', true, 'o_clerk missing'), ('sort by a list', 'SortColumnError', true, 'embedding unsortable'),
    ('sort the given order', 'SortOptionsError', true, 'o_orderkey'), ('sort by none in the given order', 'SortOptionsError', true, ''),
    ('policy', 'SchemaPolicyError', true, ''), ('no common schema', 'ValueError', false, ''), ('no fixture', 'MissingFixtureError', false, 'fees sales'),
    ('no query', 'ScriptParseError', false, '1')) t(name, raised, broken_test, detail)
    UNION ALL
    SELECT 'mismatch', 'TableMismatchError', false, CAST(count(*) FILTER (o_orderkey % 97 = 0) AS VARCHAR) FROM orders
    UNION ALL
    SELECT 'does not fit', 'SchemaCastError', true, 'o_orderdate actual timestamp[us] timestamp[ns] ' || count(*) || ' values do not fit, among them '
           || min(strftime(o_orderdate + INTERVAL 2000 YEAR, '%Y-%m-%d %H:%M:%S')) FROM orders""")
def errors_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each way in which a comparison or a snippet cannot be had, with what the error carries."""
    orders, vectors = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "embeddings")
    bad = FixtureData([("x",)], [FixtureColumn("o_orderkey", SqlType.BIGINT)])
    late = orders.select((F.col("o_orderdate") + F.expr("make_ym_interval(2000, 0)")).alias("o_orderdate"))
    nanos = to_df(pa.table({"o_orderdate": pa.array([0], pa.int64()).cast(pa.timestamp("ns"))}), "expected", spark)
    cases = {
        "no table": (lambda: compare_tables(object(), orders), lambda e: f"{e.side} {type(e.cause).__name__}"),
        "bad fixture": (lambda: compare_tables(orders, bad), lambda e: f"{e.side} {type(e.cause).__name__}"),
        "sort by nothing there": (lambda: compare_tables(orders, orders, ["o_clerk"]), lambda e: f"{e.column} {e.reason}"),
        "sort by a list": (lambda: compare_tables(vectors, vectors, ["embedding"]), lambda e: f"{e.column} {e.reason}"),
        "sort the given order": (lambda: compare_tables(orders, orders, ["o_orderkey"], sort_results=False), lambda e: " ".join(e.sort_by)),
        "sort by none in the given order": (lambda: compare_tables(orders, orders, [], sort_results=False), lambda e: " ".join(e.sort_by)),
        "policy": (lambda: Policy(strict_column_ordering=True, allow_extra_columns_in_result=True), lambda e: ""),
        "does not fit": (lambda: compare_tables(late, nanos), lambda e: f"{e.column} {e.side} {e.source} {e.target} {e.cause}"),
        "no common schema": (lambda: cast_to_common(orders, vectors, compare_schemas(orders.schema, vectors.schema)), lambda e: ""),
        "no fixture": (lambda: _snippet(spark, "fees").run({}), lambda e: f"{e.tag} {e.alias}"),
        "no query": (lambda: Script("SELECT a FROM (b").check(spark), lambda e: str(e.line)),
        "mismatch": (lambda: assert_equals(*_orders(spark, sf_dir), ["o_orderkey"]), lambda e: str(e.comparison.diff_count)),
    }
    rows = []
    for name, (call, detail) in cases.items():
        e = _error(call)
        rows.append((name, type(e).__name__, isinstance(e, ComparisonError), detail(e)))
    return spark.createDataFrame(rows, "name string, raised string, broken_test boolean, detail string")


@equals("""
    SELECT * FROM (VALUES ('list', 0, 'spending'), ('run', 0, 'Tables are equal'), ('schema', 1, 'FAILED'), ('no fixture', 2, 'ERROR'), ('no tag', 2, 'ERROR'),
    ('no flag', 2, 'ERROR'), ('demo', 1, 'FAILED')) t(command, code, text)
    UNION ALL SELECT 'differ', 1, count(*) || ' of ' || count(*) || ' rows differ:' FROM supplier""")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of the command line, and a line that it prints."""
    from tessera.__main__ import main

    supplier, script = f"{sf_dir}/supplier.parquet", str(SCRIPT_PATH)
    given = ["--fixture", f"supplier={supplier}", "--expected"]
    commands = {
        "list": (["list", script], 0),
        "run": (["run", script, "every_supplier", *given, supplier, "--sort-by", "s_suppkey"], 0),
        "differ": (["run", script, "moved_suppliers", *given, supplier], 1),
        "schema": (["run", script, "every_supplier", *given, f"{sf_dir}/nation.parquet"], 0),
        "no fixture": (["run", script, "every_supplier"], 0),
        "no tag": (["run", script, "no_such_tag"], 0),
        "no flag": (["run", script, "every_supplier", *given, supplier, "--policy", "no_such_flag"], 0),
        "demo": (["demo"], None),
    }
    rows = []
    for name, (arguments, line) in commands.items():
        said = io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(said):
            code = main(arguments)
        lines = said.getvalue().splitlines()
        rows.append((name, code, "FAILED" if line is None and "FAILED" in lines else lines[line or 0]))
    return spark.createDataFrame(rows, "command string, code int, text string")

