"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions alone.

A text is cut into paragraphs: its lines, and within a line what ends in punctuation. Each paragraph hashes to a wide
vector, and a document's fingerprint is the sum of its paragraphs' vectors with every lane modulo a power of two. So
the fingerprint does not depend on their order, and the fingerprint of a text with paragraphs inserted or deleted is
had by adding or subtracting vectors (``combine``).

The vector has the number of paragraphs, ``STRONG`` wide lanes of hash bits that decide equality, and ``LANES``
narrow lanes of single bits, three to a long with a guard bit each. The narrow lanes of a sum, read as sums of random
signs, are a linear sketch of the multiset: their cosine estimates the cosine of two multisets (``likeness``), with a
standard error of about one over the root of ``LANES``.

Each document needs its successor in the order of ids. Rows have a key that no other row has: the id, a hash of the text
and the row's place in the input. A first pass range-partitions the keys alone and takes the least of each part, so
ranges hold even shares of the rows whatever the ids: neither null ids, nor one id, nor one row repeated very often
fill a range. A second pass finds each row's range by binary search in those keys and
sends the row there; the row that opens a range also goes to the end of the range before it. So texts move once. A range
holds ``ROWS_PER_RANGE`` rows, or the root of all rows if that is more, so that the keys remain few. Both
passes number the rows as they are read, so the input must be a table or something written.

Defined cases: a null text is empty; an empty text has no paragraph and is like itself only; null ids come last;
rows that share an id are ordered by the hash of the text; the last row's successor is the first row, which for a single
row is itself; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

BOUNDARY = r"\n+|(?<=[.!?;:,|])[ \t]+"
SHIFTS, FIELD, MODULUS = 21, 21, 1 << 20
ONES = 1 | (1 << FIELD) | (1 << 2 * FIELD)
ROOM = (MODULUS - 1) * ONES
WIDE = (1 << 56) - 1
HASHES, STRONG = 2, 2
LANES = 3 * SHIFTS * HASHES
ROWS_PER_RANGE = 20_000


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _wide_sum(hashes: Column) -> Column:
    return F.aggregate(
        hashes, F.lit(0).cast("long"), lambda a, x: (a + x.bitwiseAND(F.lit(WIDE))).bitwiseAND(F.lit(WIDE))
    )


def _narrow_sums(hashes: Column) -> Column:
    def one(i: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            return (a + F.call_function("shiftright", x, i).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(ROOM))

        return F.aggregate(hashes, F.lit(0).cast("long"), step)

    return F.transform(F.sequence(F.lit(0), F.lit(SHIFTS - 1)), one)


def vector(text: Column, boundary: str = BOUNDARY) -> Column:
    """The fingerprint of a text as an array of longs: count, strong lanes, packed narrow lanes."""
    units = F.filter(F.split(F.coalesce(text, F.lit("")), boundary), lambda u: u != "")
    hashed = _bind(
        units,
        lambda us: F.struct(
            F.transform(us, lambda u: F.xxhash64(u)).alias("a"),
            F.transform(us, lambda u: F.xxhash64(F.concat(F.lit("\x01"), u))).alias("b"),
        ),
    )
    return _bind(
        hashed,
        lambda h: F.concat(
            F.array((F.size(h["a"]) % MODULUS).cast("long"), _wide_sum(h["a"]), _wide_sum(h["b"])),
            _narrow_sums(h["a"]),
            _narrow_sums(h["b"]),
        ),
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the paragraphs of both (sign 1), or of the first without the second's (sign -1)."""

    def lane(x: Column, y: Column, i: Column) -> Column:
        if sign < 0:  # the complement of each lane; guard bits keep the fields apart
            wide = (x + F.lit(WIDE + 1) - y).bitwiseAND(F.lit(WIDE))
            fields = ((x.bitwiseOR(F.lit(MODULUS * ONES))) - y).bitwiseAND(F.lit(ROOM))
            count = F.pmod(x - y, F.lit(MODULUS))
        else:
            wide = (x + y).bitwiseAND(F.lit(WIDE))
            fields = (x + y).bitwiseAND(F.lit(ROOM))
            count = F.pmod(x + y, F.lit(MODULUS))
        return F.when(i == 0, count).when(i <= STRONG, wide).otherwise(fields)

    zipped = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.transform(zipped, lambda z, i: lane(z["a"], z["b"], i))


def signs(v: Column) -> Column:
    """The narrow lanes as sums of signs, each within plus or minus half the modulus."""

    def lane(x: Column, field: int) -> Column:
        ones = F.shiftright(x, field * FIELD).bitwiseAND(F.lit(MODULUS - 1))
        centred = (2 * ones - v[0] + F.lit(3 * MODULUS // 2)).bitwiseAND(F.lit(MODULUS - 1))
        return (centred - F.lit(MODULUS // 2)).cast("double")

    packed = F.slice(v, 2 + STRONG, HASHES * SHIFTS)
    return F.flatten(F.transform(packed, lambda x: F.array(lane(x, 0), lane(x, 1), lane(x, 2))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(equal: Column, a: Column, b: Column) -> Column:
    """From 0 to 1, of two columns of ``signs``; 1 for equal fingerprints."""
    scale = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(equal, 1.0).otherwise(F.when(scale > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / scale))).otherwise(0.0))


def as_text(v: Column) -> Column:
    return F.lower(F.concat_ws(".", F.transform(v, lambda x: F.hex(x))))


def _key(id_: Column, hash_: Column, row: Column) -> Column:
    """Keys in order: ids ascending and nulls last, then the text's hash, then the place in the input."""
    return F.struct(id_.isNull().cast("int").alias("n"), id_.alias("id"), hash_.alias("h"), row.alias("r"))


def _constants(values: list, kind: T.DataType) -> Column:
    """Values as one array; numbers are written as a single text, which the optimiser folds into one constant."""
    if not isinstance(kind, T.IntegralType):
        return F.array(*[F.lit(v).cast(kind) for v in values])
    parts = F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",")
    return parts.try_cast(T.ArrayType(kind))  # an empty part is null


def with_next(documents: DataFrame, carried: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """(doc_id, text) with each carried column and next_<name> of it and of text, from the row after.

    The carried expressions are of doc_id and text and are worked out once rows are in their ranges.
    """
    if ranges is None:
        n = documents.select("doc_id").count()
        ranges = max(common.partitions(documents.sparkSession), -(-n // max(ROWS_PER_RANGE, math.isqrt(n))))
    kind = documents.schema["doc_id"].dataType
    rows = documents.select("doc_id", "text").withColumn(
        "__key", _key(F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id())
    )
    parts = rows.select("__key").repartitionByRange(ranges, "__key").withColumn("part", F.spark_partition_id())
    least = [r.least for r in parts.groupBy("part").agg(F.min("__key").alias("least")).collect()]  # one for each range
    least.sort(key=lambda k: (k.n, k.n == 0 and k.id, k.h, k.r))
    count = max(1, len(least))
    fields = {"n": T.IntegerType(), "id": kind, "h": T.LongType(), "r": T.LongType()}
    columns = {n: _constants([k[n] for k in least], t) for n, t in fields.items()}

    def opening(i: Column) -> Column:
        """The key that opens a range."""
        return F.struct(*[F.element_at(c, i + 1).alias(n) for n, c in columns.items()])

    key = F.col("__key")
    steps = [1 << b for b in reversed(range((count - 1).bit_length()))]
    place = F.aggregate(
        F.array(*[F.lit(s) for s in steps]).cast("array<int>"),
        F.lit(0),
        lambda at, s: F.when(at + s < count, F.when(opening(at + s) <= key, at + s).otherwise(at)).otherwise(at),
    )
    at = F.col("__range")
    own = F.struct(at.alias("at"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.pmod(at - 1, F.lit(count)).alias("at"), F.lit(1).alias("ghost"))
    dealt = rows.withColumn("__range", place if least else F.lit(0)).withColumn(
        "__place", F.explode(F.when(opening(at).eqNullSafe(key), F.array(own, ghost)).otherwise(F.array(own)) if least else F.array(own))
    )
    met = dealt.select("doc_id", "text", "__key", "__place.at", "__place.ghost").repartition(ranges, "at").withColumns(carried)
    after = Window.partitionBy("at").orderBy("ghost", "__key")
    names = ["text", *carried]
    return met.select("*", *[F.lead(n).over(after).alias(f"next_{n}") for n in names]).where("ghost = 0").drop("__key", "at", "ghost")


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(documents, {"v": vector(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)
    edited = (
        paired.withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
        .select("doc_id", "n_chars", "edited", "v", "next_v")
        .withColumn("edited_v", vector(F.col("edited")))
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .select("doc_id", "n_chars", "edited_sha256", "v", "edited_v", "next_v")
        .select("*", signs(F.col("v")).alias("s"), signs(F.col("edited_v")).alias("edited_s"), signs(F.col("next_v")).alias("next_s"))
    )
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("v")).alias("fingerprint"),
        as_text(F.col("edited_v")).alias("edited_fingerprint"),
        likeness(F.col("v") == F.col("edited_v"), F.col("s"), F.col("edited_s")).alias("near_edited"),
        likeness(F.col("v") == F.col("next_v"), F.col("s"), F.col("next_s")).alias("near_next"),
    )
