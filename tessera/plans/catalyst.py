"""The one place that calls Spark's own parser, and what is read off its unresolved plans (classic sessions only)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


_SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}


class ParseFailure(Exception):
    """The parser's message for a text that is no query."""


@dataclass(frozen=True)
class Source:
    """What a FROM clause reads: its key, its place in the text, and what stands there."""

    key: str
    start: int
    stop: int  # inclusive
    form: str  # table (no alias), aliased (a table under an alias), query (a derived table)
    node: Any = None


def parse(spark: SparkSession, sql: str) -> Any:
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        message = str(e.java_exception.getMessage()) if isinstance(e, Py4JJavaError) else str(e)
        raise ParseFailure(message.strip().splitlines()[0] if message.strip() else "no valid SQL") from e


def _name(node: Any) -> str:
    return node.getClass().getSimpleName()


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _span(node: Any) -> tuple[int, int]:
    origin = node.origin()
    return origin.startIndex().get(), origin.stopIndex().get()


def sources(plan: Any) -> Iterator[Source]:
    """The tables and derived tables that a query's own FROM clause names, from left to right."""
    kind = _name(plan)
    if kind == "UnresolvedRelation":
        yield Source(_items(plan.multipartIdentifier())[-1], *_span(plan), "table")
    elif kind == "SubqueryAlias":
        inner = plan.child()
        while _name(inner) in ("UnresolvedSubqueryColumnAliases", "Sample"):
            inner = inner.child()
        if _name(inner) == "UnresolvedRelation":
            yield Source(plan.alias(), *_span(inner), "aliased")
        elif _name(inner) not in ("UnresolvedTableValuedFunction", "UnresolvedInlineTable", "LocalRelation", "Range"):
            alias = plan.alias()
            yield Source("" if alias.startswith("__auto_generated") else alias, *_span(plan), "query", inner)
    elif kind == "LateralJoin":
        yield from sources(plan.left())
    else:
        for child in _items(plan.children()):
            yield from sources(child)


def relations(plan: Any) -> set[str]:
    """The first names of all tables read anywhere in a plan, subquery expressions included, in lower case."""
    found: set[str] = set()
    plans, expressions = [plan], []
    while plans or expressions:
        if expressions:
            e = expressions.pop()
            if _name(e) in _SUBQUERIES:
                plans.append(e.plan())
            expressions += _items(e.children())
            continue
        node = plans.pop()
        if _name(node) == "UnresolvedRelation":
            found.add(_items(node.multipartIdentifier())[0].lower())
        if _name(node) == "UnresolvedWith":
            plans += [pair._2() for pair in _items(node.cteRelations())]
        plans += _items(node.children())
        expressions += _items(node.expressions())
    return found
