"""Run a stream over what its source holds now, and look at the result as a table.

Snippets are ordinary SQL over DataFrames, so one can be run with a streaming fixture; this is how it is tested.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from tessera.operators.compare import TableComparison, compare_tables
from tessera.plans.policy import Policy


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append the stream's rows to Parquet files until its source is used up, and read them back."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def stream_equals(
    stream: DataFrame, expected: Any, path: str, checkpoint: str, sort_by: Sequence[str] | None = None, policy: Policy = Policy()
) -> TableComparison:
    """Compare all that a stream delivers with an expected table."""
    return compare_tables(drain(stream, path, checkpoint), expected, sort_by, policy)
