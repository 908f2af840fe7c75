"""What several operators share: whole-text decoding in Arrow batches, and cutting lineage safely."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every ASCII byte that is neither a letter nor a digit becomes a space, A-Z become a-z; other bytes stay.
_SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(_SPACED).split()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 of each text; null stays None."""
    return column.cast(pa.binary()).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_scratches: list[Scratch] = []


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and not the lineage.

    Results are lazy and may read them, so they stay until ``clear``, ``clear_all`` or the end of a ``cleared`` block.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        self.count = 0
        _scratches.append(self)

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        path = self.path()
        df.write.options(**options).parquet(path)
        # The schema is stated: an empty table may leave no file to infer it from.
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def drop(self, number: int) -> None:
        """Delete the table that was written as the given number (from 1)."""
        self._delete(f"{self.root}/{number}")

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear_all() -> None:
    """Delete all that this driver wrote to the shared folder; for when the results have been written elsewhere."""
    while _scratches:
        _scratches.pop().clear()


@contextmanager
def cleared() -> Iterator[None]:
    """Delete at the end of the block what operators wrote to the shared folder within it; results must be written by then."""
    before = set(map(id, _scratches))
    try:
        yield
    finally:
        for own in [s for s in _scratches if id(s) not in before]:
            own.clear()
            _scratches.remove(own)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that the table does not have, whatever the case."""
    have = {n.lower() for n in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name as ``F.col`` reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def id_text(doc_id: str = "doc_id"):
    """The id as text; null ids count as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def fold(modulus: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.encode(id_text(doc_id), "UTF-8")), F.lit(modulus))


def local_fold(doc_id: object, modulus: int) -> int:
    """The same in Python, for rows that are already there."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches holding about ``limit`` bytes of text each (one row at least), with their texts."""
    for batch in batches:
        texts = [t or b"" for t in text_bytes(batch.column(column))]
        begin, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(t) + 1
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]
