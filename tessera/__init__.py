"""Tessera: SQL snippet testing and table comparison on Spark DataFrames."""

from tessera.errors import (
    ComparisonError,
    MissingFixtureError,
    NoResultError,
    SchemaCastError,
    SchemaPolicyError,
    ScriptParseError,
    SnippetError,
    SortColumnError,
    SortOptionsError,
    TableConversionError,
)
from tessera.operators.compare import RowCountMismatch, RowDiff, TableComparison, cast_to_common, compare_tables
from tessera.operators.report import TableMismatchError, assert_equals, summary
from tessera.plans.policy import Policy
from tessera.plans.schemas import ColumnComparison, SchemaComparison, compare_schemas
from tessera.plans.script import Script
from tessera.plans.snippet import Snippet, by_tag
from tessera.sources.fixtures import FixtureColumn, FixtureData, SourceFixture, SqlType
from tessera.sources.tables import to_df

__version__ = "0.1.0"

__all__ = [
    "ColumnComparison", "ComparisonError", "FixtureColumn", "FixtureData", "MissingFixtureError", "NoResultError", "Policy",
    "RowCountMismatch", "RowDiff", "SchemaCastError", "SchemaComparison", "SchemaPolicyError", "Script", "ScriptParseError",
    "Snippet", "SnippetError", "SortColumnError", "SortOptionsError", "SourceFixture", "SqlType", "TableComparison",
    "TableConversionError", "TableMismatchError", "assert_equals", "by_tag", "cast_to_common", "compare_schemas",
    "compare_tables", "summary", "to_df",
]
