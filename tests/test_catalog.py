"""Each registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert rows == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key)


def test_entry(spark):
    (row,) = entry.entry(spark).collect()
    assert row.column == "with_fee" and row.expected == "0" and int(row.actual) > 250
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_optional_parts_may_be_absent(monkeypatch):
    def absent(name):
        def load(_):
            raise ModuleNotFoundError(f"no {name}", name=name)

        return load

    for name in ("tessera.llm", "corpus_pipeline"):
        monkeypatch.setattr(entry.importlib, "import_module", absent(name))
        assert entry._optional("tessera.llm.registry") is None
    monkeypatch.setattr(entry.importlib, "import_module", absent("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("tessera.llm.registry")
