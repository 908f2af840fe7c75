"""Mixing sources to target weights by systematic sampling.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. They share a budget of words (150 % of all)
by weight; a target stops at twice its source's size and the excess is reshared until none is above. Within a source
every document expects the same number of copies, target over size. Documents are ordered by size, so that the sample
is stratified by length; the prefix sums of the expected copies get one random offset for the source, and a document
is emitted once for each integer that its interval crosses. The words taken miss the target by less than the largest
document.

The prefix sum runs over a range-partitioned order: each part counts its rows by source, the counts are summed over
the parts, and each row adds its place within the part. No source meets in one task. What is gathered in one place has
one row for each source, about 40 bytes: a task sorts ten million sources in its share of an executor's memory, and
spills beyond that.

Defined cases: a null text has size 0; a document of size 0 is counted like any other; null doc_id and null source are
values of their own, nulls last; repeated rows are documents of their own; an empty table gives none; extra columns
pass through ``mix`` whatever they are called, but for ones named like an output, which the output replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
ADDED = ("size", "source_size", "target", "copies", "taken")


def size_of(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources are capped in order of size over weight: with those before it at their caps, a source is capped if the
    rest of the budget, shared by weight, exceeds its own cap.
    """
    everything = Window.partitionBy()  # one row for each source
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("i", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") + 1).cast("int")).cast("long").alias("weight"),
    )
    by_cap = Window.orderBy(
        (F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    )
    upto = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = (
        weighed.withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("n_total", F.lit(budget) * F.sum("source_size").over(everything))
        .withColumn("w_total", F.sum("weight").over(everything))
        .withColumn("left", F.col("n_total") - (F.sum("cap").over(upto) - F.col("cap")))
        .withColumn("w_left", F.col("w_total") - (F.sum("weight").over(upto) - F.col("weight")))
        .withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("weight"))
    )
    # The capped ones come first in the order; the others share what is left after all of them.
    last = (
        shared.withColumn("n_rest", F.col("n_total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("w_rest", F.col("w_total") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything))
    )
    share = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("n_rest") * F.col("weight") / F.col("w_rest"))
    return last.select("source", "source_size", share.alias("target"))


def offset_of(source: str = "source", seed: int = 17) -> Column:
    """The random offset of a source, at least 0 and below 1, from a hash of its name and the seed."""
    named = F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("null"))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), named)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = 1.5,
    most: int = 2,
    seed: int = 17,
    keep_text: bool = True,
) -> DataFrame:
    """``documents`` with size, source_size, target (both of the source), copies and taken (copies times size).

    Without ``keep_text`` the text is dropped once it has been measured.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    base = documents.drop(*ADDED).withColumn("size", size_of())
    (row,) = common.fresh(base, "__row")
    rows = scratch.write((base if keep_text else base.drop("text")).withColumn(row, F.monotonically_increasing_id()))
    # Keys alone are ordered; the rest of the row waits in the written table.
    order = [F.col(n).asc_nulls_last() for n in ("source", "size", "doc_id")] + [F.col("__row")]
    ranged = scratch.write(
        rows.select(F.col(row).alias("__row"), "source", "size", "doc_id")
        .repartitionByRange(common.partitions(spark), *order)
        .withColumn("__part", F.spark_partition_id())
    )
    counts = ranged.groupBy("__part", "source").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("__part").alias("p"), F.col("source").alias("q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    plan = targets(counts.groupBy("source").agg(F.sum("s").alias("source_size")), weights, budget, most)
    plan = plan.withColumn("offset", offset_of(seed=seed)).withColumnRenamed("source", "r")
    within = Window.partitionBy("__part", "source").orderBy(*order)
    placed = (
        ranged.withColumn("place", F.row_number().over(within))
        .join(starts, (F.col("__part") == F.col("p")) & F.col("source").eqNullSafe(F.col("q")))
        .join(plan, F.col("source").eqNullSafe(F.col("r")))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("start") + F.col("place")
    crossed = (F.floor(at * rate + F.col("offset")) - F.floor((at - 1) * rate + F.col("offset"))).cast("long")
    marked = placed.select(
        F.col("__row").alias(row), "source_size", "target", crossed.alias("copies"), (crossed * F.col("size")).alias("taken")
    )
    return rows.join(marked, row).drop(row)


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    (copy,) = common.fresh(mixed, "__copy")
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mixed.where("copies > 0").withColumn(copy, F.explode(copies)).drop(copy)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(documents.select("doc_id", "source", "text"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS w_all,
         sum(2 * source_size) OVER w - 2 * source_size AS cap_before, sum(weight) OVER w - weight AS w_before
  FROM s WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT *, cap * (w_all - w_before) <= (budget - cap_before) * weight AS capped FROM o
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE
           (budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE * weight
           / (w_all - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::DOUBLE END AS target,
         ('0x' || substr(md5('17|' || coalesce('s:' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM c
), p AS (
  SELECT doc_id, d.size, source_size, target, u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, doc_id NULLS LAST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(k * rate + u) - floor((k - 1) * rate + u)) * size)::BIGINT AS taken FROM p
"""
