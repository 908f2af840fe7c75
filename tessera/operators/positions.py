"""Row positions in a global order.

Rows are range-partitioned by the whole order, sorted within each part and numbered there; each part adds the rows of
those before it. Small tables have few parts, and every table takes the same way. The order ends in the row's place in
the input, so that ties keep it and no key, however frequent, fills one part. Rows in given order are numbered where
they are. Numbered rows are checkpointed, so that part numbers stay what they are when an executor is lost; only one
count for each part is gathered.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import order_keys
from tessera.types import Kind

ROWS_PER_PART = 50_000
POSITION = "__position"
_WITHIN = (1 << 33) - 1


def stable(df: DataFrame) -> DataFrame:
    """Written to the cluster's checkpoint folder; a temporary one serves on a local master alone."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint()


def ordered(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """``df``, whose column ``place`` is the place in the input, lazily sorted by the order and then by that."""
    return df.withColumn(place, F.monotonically_increasing_id()).orderBy(*order, place).drop(place)


def _numbered(cells: DataFrame, position: str) -> DataFrame:
    """Positions from the order in which the rows lie."""
    own = stable(cells.withColumn(position, F.monotonically_increasing_id()))
    part = F.shiftright(position, 33).cast("int")
    sizes = own.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one number for each part
    before, total = [], 0
    for row in sizes:
        before.append((row.p, total))
        total += row.n
    offsets = cells.sparkSession.createDataFrame(before, "`__part` int, `__before` long")
    joined = own.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(position, F.col("__before") + F.col(position).bitwiseAND(F.lit(_WITHIN))).drop("__part", "__before")


def _plainly(df: DataFrame, work) -> DataFrame:
    """``work`` on columns called c0, c1 and so on, whatever they are called; its own columns come after them."""
    out = work(df.toDF(*[f"c{i}" for i in range(len(df.columns))]))
    return out.toDF(*df.columns, *out.columns[len(df.columns) :])


def sorted_positions(df: DataFrame, keys: Sequence[tuple[int, Kind]], rows: int, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``df`` with the 0-based position of each row in ascending order of the keys (places of columns), ties in input order."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, -(-rows // rows_per_part)))

    def work(cells: DataFrame) -> DataFrame:
        order = [*key_columns(keys), F.col("__place")]
        ranged = cells.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
        return _numbered(ranged.sortWithinPartitions(*order).drop("__place"), POSITION)

    return _plainly(df, work)


def key_columns(keys: Sequence[tuple[int, Kind]]) -> list[Column]:
    """Sort keys of columns called c0, c1 and so on."""
    return [c for i, kind in keys for c in order_keys(F.col(f"c{i}"), kind)]


def given_positions(df: DataFrame) -> DataFrame:
    """``df`` with the 0-based position of each row in the order in which it is given."""
    return _plainly(df, lambda cells: _numbered(cells, POSITION))
