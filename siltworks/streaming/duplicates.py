"""Duplicates on a stream: keyed state that a watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siltworks.functions.columns import col


def first_rows_stream(df: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The rows of a stream whose key, null-safely compared, no row within ``late`` of it had before.

    A row that arrives later than ``late`` behind the newest event time is left out, and a key's state goes once the watermark
    has passed it, so state is bounded by the keys of that span. Of rows of one key in a micro-batch any one stays. A restart from
    the same checkpoint repeats nothing. The event time becomes a timestamp of the session's zone.
    """
    timed = df.withColumn(time, col(time).cast("timestamp"))
    return timed.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
