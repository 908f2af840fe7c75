"""Running one SELECT of a script over fixtures instead of the tables that it names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import MissingFixtureError, NoResultError, ScriptParseError
from tessera.plans import catalyst
from tessera.plans.catalyst import Source
from tessera.plans.script import Found, Script, tokens
from tessera.sources.fixtures import FixtureData, SourceFixture, by_alias


@dataclass(frozen=True)
class Snippet:
    """A tagged SELECT that can be run with fixtures.

    Only what its own FROM clause names is replaced, each alias by the fixture of that alias. Tables in subqueries of
    other clauses stay. CTEs are kept where they are still read, and dropped where the fixtures took their place.
    """

    spark: SparkSession
    tag: str
    found: Found

    @property
    def sql(self) -> str:
        return self.found.sql

    def _sources(self) -> list[Source]:
        try:
            plan = catalyst.parse(self.spark, self.sql)
        except catalyst.ParseFailure as e:
            raise ScriptParseError(str(e), self.found.start, 1) from e
        return list(catalyst.sources(plan))

    def source_aliases(self) -> list[str]:
        """The names that fixtures are given for; an unnamed derived table is ''."""
        return list(dict.fromkeys(s.key for s in self._sources()))

    def rewritten(self, views: Mapping[str, str], descend: bool = False) -> str:
        """The SQL text with each source replaced by the view of its alias."""
        text = self.sql
        for s in sorted(self._replaced(views, self._sources(), descend), key=lambda s: -s.start):
            view, own = views[s.key], text[s.start : s.stop + 1]
            if s.form == "table":
                new = f"{view} AS `{s.key}`"
            elif s.form == "aliased":
                new = view
            else:
                close = _closing(own)
                new = view + (own[close + 1 :] if s.key else " AS `__unnamed`")
            text = text[: s.start] + new + text[s.stop + 1 :]
        return self._with(text)

    def _replaced(self, views: Mapping[str, str], found: list[Source], descend: bool) -> list[Source]:
        out = []
        for s in found:
            if s.key in views:
                out.append(s)
            elif descend and s.form == "query" and not s.key:
                out += self._replaced(views, list(catalyst.sources(s.node)), descend)
            else:
                raise MissingFixtureError(s.key, self.tag)
        return out

    def _with(self, text: str) -> str:
        """With the CTEs in front that the text, or one that is kept, still reads."""
        read, kept = catalyst.relations(catalyst.parse(self.spark, text)), []
        for cte in reversed(self.found.ctes):
            if cte.name.lower() in read:
                kept.append(cte.text)
                whole = f"WITH {cte.text} SELECT 1"
                read |= catalyst.relations(catalyst.parse(self.spark, whole))
        return f"WITH {', '.join(reversed(kept))} {text}" if kept else text

    def run(self, fixtures: Iterable[SourceFixture] | Mapping[str, FixtureData | DataFrame], descend: bool = False) -> DataFrame:
        """The snippet's rows over the fixtures, lazily. Fixtures for other names are ignored.

        With ``descend`` an unnamed derived table may stay if fixtures replace what it reads.
        """
        given, stem = by_alias(fixtures), uuid.uuid4().hex
        views = {alias: f"__fx_{stem}_{i}" for i, alias in enumerate(given)}
        text = self.rewritten(views, descend)
        try:
            for alias, view in views.items():
                given[alias].to_df(self.spark).createOrReplaceTempView(view)
            result = self.spark.sql(text)
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)
        if not result.columns:
            raise NoResultError(f"snippet {self.tag!r} gives no result set")
        return result

    def run_with_fixtures(self, fixtures: Iterable[SourceFixture]) -> DataFrame:
        return self.run(fixtures)


def _closing(text: str) -> int:
    """Where the parenthesis that opens a text is closed."""
    return next(t.start for t in tokens(text) if t.kind == "mark" and t.value == ")" and t.depth == 0)


def by_tag(spark: SparkSession, tag: str, script: Script | str | Path) -> Snippet | None:
    """The snippet of a script or of a file, or None if no SELECT has the tag."""
    script = script if isinstance(script, Script) else Script.from_path(script)
    found = script.find(tag)
    return Snippet(spark, tag, found) if found else None
