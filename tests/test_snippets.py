"""Tags, scopes, source lists, substitution and the command line."""

import pytest

import tessera as t
from tessera.__main__ import main
from tessera.catalog import SCRIPT_PATH
from tessera.plans.script import tag_of

SQL = """
select 'it''s; -- @tag(in_text)' as x, "a;b" as y from q0; -- @tag(nothing_follows)
with one as (
  -- an ordinary comment
  select num from numbers
), two as (
  -- @tag(two)
  -- and another comment
  select num, num + 2 as n2 from numbers
), three as (
  select num
  -- @tag(misplaced)
  from numbers
), four as (
  select num + 4 as n4 from ( /* @mark( inner ) */
    select distinct num from numbers
  )
)
-- @tag(main)
select a.num, b.n2, missing.c from one a left join two b on a.num = b.num join other on true
where a.num in (select num from three) order by 1;
-- @tag(first)
select num from t1 union all select num from t2;
-- @tag(two)
select 'second two' as x from t3;
select * from (-- @tag(limited)
  select num, count(*) as n from db.events e group by num having count(*) > 1 order by num limit 5) z
"""


@pytest.fixture
def script():
    return t.Script(SQL)


def nums(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "num int")


def test_tag_grammar():
    assert tag_of("-- @tag(a)") == tag_of("--@any ( a )  ") == tag_of("/*\n @tag(a)\n*/") == "a"
    for bad in ("-- @tag(a) b", "-- tag(a)", "-- @tag(a b)", "-- @tag()", "-- @tag((a))", "-- see @tag(a)"):
        assert tag_of(bad) is None


def test_tags_bind_to_the_select_that_follows(script):
    assert set(script.tags) == {"two", "inner", "main", "first", "limited"}
    assert script.find("two").sql.startswith("select num, num + 2")
    assert script.find("misplaced") is None and script.find("in_text") is None
    assert script.find("inner").sql == "select distinct num from numbers"
    assert script.find("first").sql == "select num from t1"
    assert script.find("limited").sql.endswith("limit 5")
    assert len(script.statements) == 5


def test_sources(spark, script):
    def aliases(tag):
        return t.by_tag(spark, tag, script).source_aliases()

    assert aliases("two") == ["numbers"] and aliases("limited") == ["e"] and aliases("first") == ["t1"]
    assert aliases("main") == ["a", "b", "other"]
    assert t.by_tag(spark, "none", script) is None


def test_run(spark, script):
    two = t.by_tag(spark, "two", script)
    assert [tuple(r) for r in two.run({"numbers": nums(spark, 1, 5), "unused": nums(spark)}).collect()] == [(1, 3), (5, 7)]
    with pytest.raises(t.MissingFixtureError) as e:
        two.run({"NUMBERS": nums(spark, 1)})
    assert e.value.alias == "numbers" and e.value.tag == "two"
    last = [t.SourceFixture("numbers", nums(spark, 1)), t.SourceFixture("numbers", nums(spark, 9))]
    assert two.run_with_fixtures(iter(last)).collect()[0].num == 9
    assert two.run({"numbers": nums(spark)}).count() == 0
    assert t.by_tag(spark, "inner", script).run({"numbers": nums(spark, 2, 2, 3)}).count() == 2
    events = nums(spark, 3, 3, 4, 1, 1)
    assert [tuple(r) for r in t.by_tag(spark, "limited", script).run({"e": events}).collect()] == [(1, 2), (3, 2)]


def test_ctes_stay_only_where_they_are_read(spark, script):
    main_ = t.by_tag(spark, "main", script)
    text = main_.rewritten({"a": "va", "b": "vb", "other": "vo"})
    assert "three as" in text and "two as" not in text and "one as" not in text
    joined = t.by_tag(spark, "customer_report", SCRIPT_PATH)
    assert "WITH" not in joined.rewritten({k: f"v_{k}" for k in "csh"})


def test_self_join_takes_a_fixture_for_each_alias(spark):
    pairs = t.by_tag(spark, "neighbours", SCRIPT_PATH)
    assert pairs.source_aliases() == ["a", "b"]
    a, b = (spark.createDataFrame(rows, "suppkey long, name string") for rows in ([(1, "x"), (3, "y")], [(2, "z"), (3, "w")]))
    assert [tuple(r) for r in pairs.run({"a": a, "b": b}).collect()] == [(1, "x", 2, "z")]


def test_derived_tables(spark):
    script = t.Script("-- @tag(q)\nselect n + 1 as m from (select num as n from numbers)\n;-- @tag(r)\nselect z.b from y as z(b), (select 1 as one) d")
    q = t.by_tag(spark, "q", script)
    assert q.source_aliases() == [""]
    assert q.run({"": spark.sql("select 4 as n")}).first().m == 5
    assert q.run({"numbers": nums(spark, 7)}, descend=True).first().m == 8
    with pytest.raises(t.MissingFixtureError):
        q.run({"numbers": nums(spark, 7)})
    r = t.by_tag(spark, "r", script)
    assert r.source_aliases() == ["z", "d"]
    assert r.run({"z": nums(spark, 3), "d": nums(spark, 1)}).first().b == 3


def test_views_do_not_stay(spark, script):
    t.by_tag(spark, "two", script).run({"numbers": nums(spark, 1)}).collect()
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("__fx_")]


def test_parse_errors(spark):
    with pytest.raises(t.ScriptParseError) as e:
        t.Script("select 1;\n\nselect a from (b").check(spark)
    assert e.value.offset == 9
    with pytest.raises(t.ScriptParseError):
        t.by_tag(spark, "bad", t.Script("-- @tag(bad)\nselect a from b where group by (")).source_aliases()


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "q.sql"
    path.write_text(SQL)
    spark.createDataFrame([(1,), (5,)], "num int").write.parquet(str(tmp_path / "n.parquet"))
    spark.createDataFrame([(5, 7), (1, 3)], "num int, n2 int").write.parquet(str(tmp_path / "good.parquet"))
    spark.createDataFrame([(5, 7), (1, 4)], "num int, n2 int").write.parquet(str(tmp_path / "bad.parquet"))
    run = ["run", str(path), "two", "--fixture", f"numbers={tmp_path}/n.parquet"]
    assert main([*run, "--expected", str(tmp_path / "good.parquet")]) == 0
    assert main([*run, "--expected", str(tmp_path / "bad.parquet"), "--sort-by", "num"]) == 1
    assert "row 0, column 'n2': expected 4, actual 3" in capsys.readouterr().out
    assert main([*run, "--expected", str(tmp_path / "bad.parquet"), "--sort-by", "zzz"]) == 2
    assert main(["run", str(path), "two"]) == 2 and "numbers" in capsys.readouterr().err
    assert main(["list", str(path)]) == 0 and "inner" in capsys.readouterr().out
    assert main(["demo"]) == 1
    assert capsys.readouterr().out.endswith("FAILED\n1 of 3 rows differ:\n  row 1, column 'wanted': expected 2, actual 1\n")
    assert main([]) == 0
