"""Load-time normalisation of textual missing markers, previews, flattening."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.columns import as_text, col, free_names, type_class

# Texts that mean a missing value, compared without case and outer white space.
MARKERS = ("", " ", "na", "n/a", "nan", "null", "none")
#: Preview limits: rows, columns, characters of a cell, bytes of the whole as JSON.
ROWS, COLUMNS, CELL, JSON_BYTES = 10, 50, 100, 5 * 1024 * 1024


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if type_class(f.dataType) == "string"]


def _is_marker(c: Column, markers: tuple[str, ...], strip: bool) -> Column:
    text = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "") if strip else c
    known = sorted({(m.strip() if strip else m).lower() for m in markers})
    return F.lower(text).isin(*known)


def normalize_markers(df: DataFrame, markers: tuple[str, ...] = MARKERS, strip: bool = True) -> DataFrame:
    """Null in place of the markers in text columns; other values keep their white space."""
    text = set(_text_columns(df))
    return df.select(*[F.when(_is_marker(col(c), markers, strip), None).otherwise(col(c)).alias(c) if c in text else col(c) for c in df.columns])


def marker_counts(df: DataFrame, markers: tuple[str, ...] = MARKERS, strip: bool = True) -> DataFrame:
    """column_name, replaced of each text column, in one pass."""
    names = _text_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, replaced long")
    wide = df.agg(*[F.count_if(_is_marker(col(c), markers, strip)).alias(f"c{i}") for i, c in enumerate(names)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("replaced")) for i, c in enumerate(names)])))


def preview(df: DataFrame, rows: int = ROWS, cols: int = COLUMNS, cell: int = CELL) -> DataFrame:
    """The first rows and columns as text, long cells cut with an ellipsis, nested values as JSON."""

    def cut(c: str) -> Column:
        text = as_text(df, c)
        return F.when(F.length(text) > cell, F.concat(F.substring(text, 1, cell), F.lit("…"))).otherwise(text).alias(c)

    return df.limit(rows).select(*[cut(c) for c in df.columns[:cols]])


def typed_preview(df: DataFrame, rows: int = ROWS, cols: int = COLUMNS, cell: int = CELL) -> DataFrame:
    """row_no and the preview's columns: the types of the columns as row 0, then the rows from 1 in their order."""
    (number,) = free_names(df, "row_no")
    kinds = df.sparkSession.createDataFrame([(0, *[f.dataType.simpleString() for f in df.schema][:cols])], T.StructType([T.StructField(number, T.LongType()), *[T.StructField(c, T.StringType()) for c in df.columns[:cols]]]))
    # A limited frame is one partition, whose numbers follow its order.
    shown = preview(df, rows, cols, cell)
    return kinds.unionByName(shown.select((F.monotonically_increasing_id() + 1).alias(number), *map(col, shown.columns)))


def adaptive_preview(df: DataFrame, rows: int = ROWS, cols: int = COLUMNS, cell: int = CELL, json_bytes: int = JSON_BYTES) -> list[dict] | None:
    """A preview as records, with as many of its at most ``rows`` rows as fit in ``json_bytes``; None if not one does."""
    records = [r.asDict() for r in preview(df, rows, cols, cell).collect()]
    while records and len(json.dumps(records, ensure_ascii=False).encode()) > json_bytes:
        records.pop()
    return records or None


def flatten(df: DataFrame) -> DataFrame:
    """Fields of structs as columns ``a.b``, at any depth; arrays and maps stay."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType) and f.dataType.fields:
                out += leaves(f.dataType, here)
            else:
                c = col(here[0])
                for part in here[1:]:
                    c = c.getField(part)
                out.append(c.alias(".".join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def safe_name(name: str) -> str:
    """A column name without dots and quotes, for sinks that want one."""
    return re.sub(r"[^\w]+", "_", name).strip("_") or "column"
