"""A training corpus from ``documents`` in five stages, each written as Parquet and reread as the next one's input.

1. toxicity: documents above their language's threshold go;
2. near_duplicates: of each group of near copies one document stays, the one with the smallest doc_id; candidates meet in
   SimHash balls, and a link takes shingles of five words that resemble each other by 0.8 or more;
3. secrets: spans that look like secrets are replaced by their kind, and n_chars follows;
4. mixing: documents are taken as often as systematic sampling to the sources' targets takes them;
5. packing: what is left is packed into token sequences.

All stages but the last return the columns of their input, whatever further columns are called. Rows that a stage takes
twice are packed twice.

Defined cases: null texts count as empty and pass the first stage as an empty document does; of rows without an id, one
of each group stays; an empty input gives an empty output; a null source is a source of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, secrets, simhash, toxicity
from tessera.llm.common import Scratch, cleared

#: No SQL: the classifier is trained and the packing is a search. Tests hold the stages against brute force instead.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def filtering(stage: Stage) -> Stage:
    """A stage that returns its input's columns; those it does not know are out of its operator's way meanwhile."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {n: n if n in CORE else f"__aside_{i}" for i, n in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*aside.values()), sf_dir)
        return out.select(*[F.col(k).alias(n) for n, k in aside.items()])

    return run_stage


@filtering
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).where(~F.col("toxic_rejected"))


@filtering
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share the kept id are told apart by a hash of the text, the smallest of which stays."""
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    found = simhash.near_copies(keyed, keep=("doc_id", "__text_key"))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min(F.struct(F.col("doc_id"), F.col("__text_key"))).alias("kept")
    )
    kept = first.select(F.col("kept.doc_id").alias("__id"), F.col("kept.__text_key").alias("__key")).distinct()
    kept = Scratch(spark, "near-duplicates").write(kept)  # the join then deals both sides itself, and can split repeated rows
    chosen = keyed.join(
        kept, keyed["doc_id"].eqNullSafe(kept["__id"]) & (keyed["__text_key"] == kept["__key"]), "left_semi"
    )
    # Repeated rows have the same id and text.
    return chosen.dropDuplicates(["doc_id", "__text_key"])


@filtering
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secrets.redact(secrets.scan(docs))
    length = F.when(F.size("secrets") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length)


@filtering
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. What a stage wrote on its way goes with its end, and its input with it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        with cleared():
            docs = scratch.write(stage(spark, docs, sf_dir))
        if number:
            scratch.drop(number)
    return docs
