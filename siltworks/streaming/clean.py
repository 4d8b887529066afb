"""The stateless part of cleaning on a stream.

Rules that look at a row alone run unchanged on a streaming DataFrame: marker normalisation, conversions that
null what they can't read, dropping and constant filling of missing values. Rules with statistics of the whole
table do not; ``fixed_bounds`` gives outlier treatment by bounds known beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltworks.functions.columns import col, usable
from siltworks.operators.formats import apply_formats
from siltworks.operators.missing import apply_missing
from siltworks.operators.normalise import normalize_markers

STATELESS = ("drop_rows", "constant", "zero", "empty")


def clean_stream(df: DataFrame, formats: list[dict] = (), missing: list[dict] = (), bounds: dict[str, tuple[float, float]] | None = None, markers: bool = True) -> DataFrame:
    """Normalise, convert, treat missing values and cap to fixed bounds, row by row."""
    for rule in missing:
        if (rule.get("action") or rule.get("strategy")) not in STATELESS:
            raise ValueError(f"a stream takes only {', '.join(STATELESS)}: {rule}")
    df = normalize_markers(df) if markers else df
    df = apply_missing(apply_formats(df, list(formats), on_error="null"), list(missing), on_error="null")
    for name, (low, high) in (bounds or {}).items():
        df = fixed_bounds(df, name, low, high)
    return df


def fixed_bounds(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """The column as double, capped to known bounds; missing stays missing."""
    if low >= high:
        raise ValueError("low must be below high")
    v = usable(df, name).cast("double")
    new = F.when(v < low, F.lit(float(low))).when(v > high, F.lit(float(high))).otherwise(col(name).cast("double"))
    return df.select(*[new.alias(c) if c == name else col(c) for c in df.columns])


def completeness_stream(df: DataFrame, time: str, names: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, n_rows and n_present of each column per window of event time; rows later than ``late`` are left out."""
    counts = [F.count(usable(df, c)).alias(f"n_{c}") for c in names]
    timed = df.withColumn(time, col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n_rows"), *counts).select(F.col("window.start").alias("window_start"), "n_rows", *[f"n_{c}" for c in names])


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet with exactly-once files; ``once`` takes what is there and ends."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
