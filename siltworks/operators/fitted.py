"""Preparation in two steps: fit on some rows, transform any others; the fitted state is a value with a JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.columns import as_text, col, free_names
from siltworks.functions.quantiles import quantiles
from siltworks.operators import prepare
from siltworks.sources.scratch import scratch_path

KINDS = ("onehot", "ordinal", "standard", "minmax", "robust")
#: What becomes of values that fitting did not see: zeros or null, a place of their own, or an error.
UNSEEN = ("ignore", "other", "raise")


@dataclass(frozen=True)
class Fitted:
    """``state`` holds the values of a column in order (onehot, ordinal), or center and spread of each column."""

    kind: str
    names: tuple[str, ...]
    state: tuple = field(default=())
    unseen: str = "ignore"

    def __post_init__(self):
        if self.kind not in KINDS or self.unseen not in UNSEEN:
            raise ValueError(f"unknown kind or rule: {self.kind}, {self.unseen}")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` prepared by what was fitted; it need not hold any row of the fit.

        Missing values stay missing, or are 0 in all of onehot's columns. Values unseen by onehot and ordinal: ignore gives
        zeros or null; other a column ``<name>_other``, or the place after the last; raise looks at the data once and raises
        with their number.
        """
        if self.kind in ("standard", "minmax", "robust"):
            return prepare.scaled(df, list(self.names), [tuple(s) for s in self.state])
        (name,), values = self.names, list(self.state)
        text = as_text(df, name)
        new = text.isNotNull() & ~text.isin(values) if values else text.isNotNull()
        if self.unseen == "raise" and (n := df.filter(new).count()):
            raise ValueError(f"{n} values of {name} were not seen in fitting")
        if self.kind == "onehot":
            if self.unseen != "other":
                return prepare.one_hot(df, name, values)
            (mark,) = free_names(df, f"{name}_other")
            marked = df.withColumn(mark, F.when(new, 1).otherwise(0))
            return prepare.one_hot(marked, name, values).select(*[col(c) for c in df.columns if c != name], *[col(f"{name}_{v}") for v in values], col(mark))
        placed = prepare.ordinal(df, name, values)
        if self.unseen != "other":
            return placed
        place = F.when(new, F.lit(len(values))).otherwise(F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), text).cast("int") - 1)
        return df.select(*[F.when(text.isNotNull(), place).cast("int").alias(c) if c == name else col(c) for c in df.columns])

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "names": self.names, "state": self.state, "unseen": self.unseen}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Fitted:
        d = json.loads(text)
        return cls(d["kind"], tuple(d["names"]), tuple(tuple(s) if isinstance(s, list) else s for s in d["state"]), d["unseen"])


def fit(df: DataFrame, kind: str, names: str | list[str], unseen: str = "ignore", approximate: bool = False) -> Fitted:
    """Fit one column's values (onehot, ordinal; at most ``prepare.MAX_CATEGORIES``) or the scales of several columns at once."""
    names = [names] if isinstance(names, str) else list(names)
    if kind in ("onehot", "ordinal"):
        if len(names) != 1:
            raise ValueError(f"{kind} is of one column")
        return Fitted(kind, tuple(names), tuple(prepare.categories(df, names[0])), unseen)
    values = prepare.numbers(df, names)
    if kind == "robust":
        return Fitted(kind, tuple(names), tuple((q[1], q[2] - q[0]) if q else (None, None) for q in quantiles(df, values, [0.25, 0.5, 0.75], approximate)), unseen)
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown kind: {kind}")
    center, spread = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, lambda v: F.max(v) - F.min(v))
    row = df.agg(*[x.alias(f"s{i}{k}") for i, v in enumerate(values) for k, x in enumerate((center(v), spread(v)))]).first()
    return Fitted(kind, tuple(names), tuple(zip(row[::2], row[1::2])), unseen)


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """value, place: the values of a column in order, from 0; a written table, whatever their number.

    The values are dealt out by ranges and numbered within each; the ranges' sizes, one number per range, give where each begins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "dictionary")
    values = df.select(as_text(df, name).alias("value")).filter("value is not null").distinct()
    values.repartitionByRange("value").select("value", F.spark_partition_id().alias("part")).write.parquet(path)
    dealt = spark.read.schema("value string, part int").parquet(path)
    begins, total = [], 0
    for part, n in sorted(dealt.groupBy("part").count().collect()):
        begins.append((part, total))
        total += n
    place = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    starts = spark.createDataFrame(begins, "part int, begins long")
    return dealt.withColumn("own", place).join(F.broadcast(starts), "part").select("value", (F.col("begins") + F.col("own")).alias("place"))


def sparse_one_hot(df: DataFrame, name: str, places: DataFrame, out: str | None = None) -> DataFrame:
    """The column as a sparse vector of as many entries as ``places`` (a ``dictionary``) has, with 1 at the value's place.

    Missing and unseen values have no entry. For columns of any number of values: the dictionary is joined, not spelled out
    in the plan. ``out`` names the vector, by default as the column.
    """
    from pyspark.ml.feature import OneHotEncoderModel, OneHotEncoder

    size = places.count()
    text, place, vector = free_names(df, "text", "place", "vector")
    known = places.select(F.col("value").alias(text), F.col("place").alias(place))
    # One more category than values is dropped by the encoder: it has no entry.
    index = F.coalesce(F.col(place), F.lit(size)).cast("double")
    nominal = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
    placed = df.withColumn(text, as_text(df, name)).join(known, text, "left").drop(text).withColumn(place, index.alias(place, metadata=nominal))
    model: OneHotEncoderModel = OneHotEncoder(inputCols=[place], outputCols=[vector], dropLast=True).fit(placed.limit(0))
    done = model.transform(placed)
    target = out or name
    kept = [c for c in df.columns if c != name and c.lower() != target.lower()]
    return done.select(*[col(c) for c in kept], F.col(vector).alias(target))
