import duckdb

from tessera.llm import mixing


def test_mix_matches_sql_and_its_targets(spark, docs_dir):
    rows, n = [], 0
    for s, count in (("b", 300), ("a", 90), (None, 40), ("é", 20), ("z", 0), ("c", 5)):
        for i in range(count):
            rows.append((n, "w " * (i % 37), "en", s, 0))
            n += 1
    rows += [(n, None, "en", "a", 0), (n + 1, "x " * 900, "en", "b", 0)]
    path = docs_dir(rows)
    got = mixing.op7_mixing(spark, path).collect()
    duckdb.sql(f"create or replace view documents as select * from '{path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(f"select doc_id, size, source_size, target, taken from ({mixing.OP7_SQL})").fetchall()}
    assert {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in got} == want
    source = {r[0]: r[3] for r in rows}
    most = max(r["size"] for r in got)
    for name in {"a", "b", None, "é", "c"}:
        own = [r for r in got if source[r.doc_id] == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= most
        assert own[0].target <= 2 * own[0].source_size
    assert all(r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert abs(sum({source[r.doc_id]: r.target for r in got}.values()) - 1.5 * total) < 1e-6
    assert {r.doc_id: r.taken for r in mixing.op7_mixing(spark, path).collect()} == {r.doc_id: r.taken for r in got}


def test_odd_rows(spark, small_docs, no_docs):
    out = mixing.mix(small_docs)
    assert out.count() == small_docs.count() and out.schema["size"].dataType.simpleString() == "bigint"
    named = mixing.mix(small_docs.withColumnRenamed("lang", "__row").withColumnRenamed("n_chars", "__copy"))
    assert {r["__row"] for r in mixing.emit(named).collect()} <= {"en", "fr", "de", "es", None} and "__copy" in named.columns
    emitted = mixing.emit(out)
    assert emitted.count() == sum(r.copies for r in out.collect())
    assert mixing.mix(no_docs).count() == 0
    assert {r.taken for r in mixing.mix(small_docs.where("text is null")).collect()} == {0}
