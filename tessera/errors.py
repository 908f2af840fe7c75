"""Errors of the library.

A ``ComparisonError`` says that a test itself is broken: unusable inputs or arguments. A mismatch of data is no error of
this kind but ``TableMismatch`` (an AssertionError), raised by ``assert_equals``. Snippet errors say that a script or its
fixtures cannot be run.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, Literal

Side = Literal["actual", "expected"]


class ComparisonError(Exception):
    """The comparison could not be carried out."""


class TableConversionError(ComparisonError):
    """One of the two inputs is no table and could not be made into one."""

    def __init__(self, side: Side, cause: BaseException) -> None:
        self.side, self.cause = side, cause
        super().__init__(f"the {side} input is not usable as a table: {cause}")


class SortColumnError(ComparisonError):
    """A column named for sorting is missing from the expected table, or has a type without an order."""

    def __init__(self, column: str, reason: Literal["missing", "unsortable"], available: Sequence[str], type_: Any = None) -> None:
        self.column, self.reason, self.available, self.type = column, reason, tuple(available), type_
        if reason == "missing":
            detail = f"there is no column {column!r} to sort by; there are {', '.join(map(repr, available)) or 'none'}"
        else:
            detail = f"column {column!r} cannot be sorted by: values of type {type_} have no order here"
        super().__init__(detail)


class SortOptionsError(ComparisonError):
    """Sort columns were named although the rows are to be kept in their given order."""

    def __init__(self, sort_by: Sequence[str]) -> None:
        self.sort_by = tuple(sort_by)
        super().__init__(f"sort_by={list(self.sort_by)} needs sort_results=True; rows kept as given are not sorted")


class SchemaPolicyError(ComparisonError):
    """A policy asks for two things that exclude each other."""


class SchemaCastError(ComparisonError):
    """A value does not fit the common type of its column; ``cause`` counts such values and has one of them."""

    def __init__(self, column: str, side: Side, source: Any, target: Any, cause: BaseException) -> None:
        self.column, self.side, self.source, self.target, self.cause = column, side, source, target, cause
        super().__init__(f"{side} column {column!r} cannot go from {source} to {target}: {cause}")


class SnippetError(Exception):
    """A snippet could not be found, rewritten or run."""


class MissingFixtureError(SnippetError):
    """A source of the snippet has no fixture."""

    def __init__(self, alias: str, tag: str) -> None:
        self.alias, self.tag = alias, tag
        super().__init__(f"snippet {tag!r} reads {alias!r}, for which no fixture was given")


class ScriptParseError(SnippetError):
    """A statement of a script is not valid SQL."""

    def __init__(self, message: str, offset: int, line: int) -> None:
        self.offset, self.line = offset, line
        super().__init__(f"statement at line {line}: {message}")


class NoResultError(SnippetError):
    """The statement gives no rows to look at."""
