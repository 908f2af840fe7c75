import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm.common import shared_dir


def _input(spark, tmp_path):
    rng = random.Random(6)
    words = [a + b + c for a in ("ta", "re", "no", "li") for b in ("ne", "ri", "ka", "do") for c in ("m", "st", "la", "p")]
    rows, labels = [], []
    for i in range(300):
        own = [rng.choice(words) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            own[3], own[20] = "grubby", "snarl"
        if i % 25 == 1:
            own[5] = "password=abcdefghijklmnop"
        text = " ".join(own)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(1, 60)] + [rows[2], (2000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = _input(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    clean, unique, redacted, mixed, packed = kept
    ids = {r.doc_id for r in clean.collect()}
    toxic = {i for i in range(300) if i % 6 == 0}
    assert len(ids & toxic) <= 3 and len({i for i in range(300)} - toxic - ids) <= 3
    texts = [r.text for r in unique.collect()]
    assert len(texts) == len(set(texts)) and not any(r.doc_id in range(1001, 1060) for r in unique.collect())
    assert set(texts) <= {r.text for r in clean.collect()}
    assert {r.text.split(" ", 1)[0] for r in clean.collect() if r.text} <= {t.split(" ", 1)[0] for t in texts if t}
    out = {r.doc_id: r for r in redacted.collect()}
    assert len(out) == len(texts)
    assert not any("abcdefghijklmnop" in (r.text or "") for r in out.values())
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text and "<assign>" in r.text)
    assert mixed.count() > 0 and packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert packed.count() == mixed.count() and rows
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    assert pipeline.run(spark, str(tmp_path)).columns == packed.columns
    (left,) = set(os.listdir(shared)) - before  # the last stage alone; what others wrote is gone
    assert left.startswith("tessera-pipeline-") and os.listdir(f"{shared}/{left}") == [str(len(pipeline.STAGES))]


def test_a_text_of_many_secrets(spark, tmp_path):
    _input(spark, tmp_path)
    text = " x\n".join(("token=abcdefghijkl%05d" % i, "%018x" % (i * 7919 + 2**69))[i % 2] for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "plain", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in pipeline.secrets_stage(spark, docs, str(tmp_path)).collect()}
    assert out[1].text == " x\n".join(("<assign>", "<hex>")[i % 2] for i in range(20_000)) and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[2].n_chars) == ("plain", 5)


def test_one_of_each_group_of_near_copies_stays(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(2000) if rng.random() < 0.7 else rng.randrange(12)}" for _ in range(300)]
        for copy in range(3):
            own = list(words)
            for _ in range(copy * 2):  # 2 or 4 words of 300 changed: shingles resemble by 0.87 or more
                own[rng.randrange(300)] = f"new{rng.random()}"
            text = " ".join(own)
            rows.append((base * 10 + copy, text, "en", "s", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()}
    assert {base * 10 for base in range(40)} <= kept and len(kept) <= 40 + 4


def test_stages_on_odd_rows_and_none(spark, tmp_path, small_docs, no_docs):
    _input(spark, tmp_path)
    clashing = small_docs.withColumnRenamed("size", "secrets").withColumns(
        {n: F.col("secrets") for n in ("toxicity", "size", "copies", "fingerprint", "component")}
    )
    empty = clashing.limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, clashing, str(tmp_path))
        rows = out.collect()
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if name == "packing":
            assert len({(r.doc_id, r.piece) for r in rows}) >= 6
            continue
        assert out.dtypes == clashing.dtypes and rows
        own = {(r.doc_id, r.secrets) for r in clashing.collect()}
        assert {(r.doc_id, r.secrets) for r in rows} <= own
        if name in ("toxicity", "secrets"):
            assert len(rows) == clashing.count()
        if name == "near_duplicates":
            assert [r.doc_id for r in rows].count(1) == 1


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
