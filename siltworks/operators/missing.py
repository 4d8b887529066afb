"""Treatment of missing values by rule."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.columns import INTEGRAL, TEMPORAL, col, dtype, free_names, is_numeric, missing, type_class, usable
from siltworks.functions.order import carried, interpolated
from siltworks.functions.quantiles import quantiles_beside
from siltworks.operators.outliers import together

STRATEGIES = ("drop_rows", "mean", "median", "mode", "constant", "ffill", "bfill", "interpolate", "zero", "empty")
# The words that a boolean constant may be.
TRUE_WORDS = ("true", "1", "oui", "yes")
FALSE_WORDS = ("false", "0", "non", "no")


@dataclass(frozen=True)
class MissingRule:
    column: str
    action: str
    value: object = None

    @classmethod
    def from_dict(cls, rule: dict) -> MissingRule:
        action = rule.get("action") or rule.get("strategy")
        if not rule.get("column") or not action:
            raise ValueError(f"a missing-value rule needs column and action: {rule}")
        value = rule.get("value")
        return cls(rule["column"], action, rule.get("constant") if value is None else value)


def allowed_missing_strategies(kind) -> list[str]:
    """The strategies offered for a type; zero and empty can be asked for as well."""
    some = ["drop_rows", "mode", "constant", "ffill", "bfill"]
    return {"numeric": ["drop_rows", "mean", "median", "mode", "constant", "ffill", "bfill"], "string": some, "boolean": some, "temporal": some, "other": ["drop_rows", "constant"]}[type_class(kind)]


def missing_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """column_name, n_missing in one pass; taken before and after, it shows what a treatment does."""
    names = names or df.columns
    wide = df.agg(*[F.count_if(missing(df, c)).alias(f"c{i}") for i, c in enumerate(names)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_missing")) for i, c in enumerate(names)])))


def _constant(kind: T.DataType, value, name: str) -> tuple[Column, T.DataType]:
    """The literal, and the type that the column gets."""
    if value is None or (isinstance(value, str) and not value.strip() and type_class(kind) != "string"):
        raise ValueError(f"constant for {name} needs a value")
    text = str(value).strip()
    try:
        if is_numeric(kind):
            number = float(text.replace(",", "."))
            if isinstance(kind, INTEGRAL):
                if number == int(number):
                    return F.lit(int(number)).cast(kind), kind
                return F.lit(number), T.DoubleType()
            return F.lit(number).cast(kind), kind
        if isinstance(kind, T.BooleanType):
            if text.lower() not in TRUE_WORDS + FALSE_WORDS:
                raise ValueError
            return F.lit(text.lower() in TRUE_WORDS), kind
        if isinstance(kind, T.DateType):
            return F.lit(date.fromisoformat(text[:10])), kind
        if isinstance(kind, TEMPORAL):
            return F.lit(datetime.fromisoformat(text).isoformat(sep=" ")).cast(kind), kind
    except ValueError:
        raise ValueError(f"{value!r} is no constant for {name} of type {kind.simpleString()}") from None
    if type_class(kind) == "string":
        return F.lit(str(value)), kind
    raise ValueError(f"{name} of type {kind.simpleString()} takes no constant")


def apply_missing(df: DataFrame, rules: list[dict | MissingRule], order_by: str | list[str] | None = None, partition_by: list[str] | None = None, on_error: str = "raise", approximate: bool = False) -> DataFrame:
    """Treat missing values rule by rule; each rule's statistics see what the rules before left.

    mean and median make integers and decimals double; ``approximate`` takes a sketch for the median. mode takes the
    smallest of equally frequent values. These three look at the data when the rule is applied, and rules of different
    columns without a drop_rows between them take their passes together. ffill and bfill need ``order_by``. So does
    interpolate, which makes the column double and draws a line over the first order column between the last and the next
    value present; what is missing before the first or after the last one stays so. Where a column has nothing to take a
    mean, median or mode of, ``on_error`` raise raises, null leaves the column's values as they are.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error must be raise or null, not {on_error}")
    rules = [r if isinstance(r, MissingRule) else MissingRule.from_dict(r) for r in rules]
    order_by = [order_by] if isinstance(order_by, str) else order_by
    while rules:
        n = together([r.column for r in rules], [r.action == "drop_rows" for r in rules])
        some, rules = rules[:n], rules[n:]
        for r in some:
            _check(df, r, order_by, partition_by or [])
        found = _statistics(df, [(r.column, r.action) for r in some if r.action in ("mean", "median", "mode")], approximate)
        for r in some:
            df = _apply(df, r, found.get(r.column), order_by, partition_by or [], on_error)
    return df


def _replace(df: DataFrame, name: str, new: Column) -> DataFrame:
    return df.select(*[new.alias(c) if c == name else col(c) for c in df.columns])


def _check(df: DataFrame, r: MissingRule, order_by: list[str] | None, partition_by: list[str]) -> None:
    kind = dtype(df, r.column)
    if r.action not in STRATEGIES:
        raise ValueError(f"unknown strategy: {r.action}; known: {', '.join(STRATEGIES)}")
    if r.action in ("mean", "median", "zero", "interpolate") and not is_numeric(kind):
        raise ValueError(f"{r.action} needs a numeric column, not {r.column} of type {kind.simpleString()}")
    if r.action == "empty" and not is_numeric(kind) and type_class(kind) != "string":
        raise ValueError(f"empty needs a numeric or text column, not {r.column} of type {kind.simpleString()}")
    if r.action == "mode" and type_class(kind) == "other":
        raise ValueError(f"mode needs an atomic column, not {r.column} of type {kind.simpleString()}")
    if r.action in ("ffill", "bfill", "interpolate"):
        if not order_by:
            raise ValueError(f"{r.action} needs order_by")
        for c in [*order_by, *partition_by]:
            dtype(df, c)


def _apply(df: DataFrame, r: MissingRule, value: Column | None, order_by: list[str] | None, partition_by: list[str], on_error: str) -> DataFrame:
    kind, gone = dtype(df, r.column), missing(df, r.column)
    if r.action == "drop_rows":
        return df.filter(~gone)
    if r.action == "constant":
        value, becomes = _constant(kind, r.value, r.column)
        return _replace(df, r.column, F.when(gone, value).otherwise(col(r.column).cast(becomes)))
    if r.action in ("zero", "empty"):
        return _replace(df, r.column, F.when(gone, F.lit(0 if is_numeric(kind) else "").cast(kind)).otherwise(col(r.column)))
    if r.action in ("ffill", "bfill"):
        return _fill(df, r.column, r.action == "ffill", order_by, partition_by)
    if r.action == "interpolate":
        return interpolated(df, r.column, usable(df, r.column), gone, order_by, partition_by)
    if value is None:
        if on_error == "raise":
            raise ValueError(f"{r.column} has no value to take the {r.action} of")
        return df if r.action == "mode" else _replace(df, r.column, col(r.column).cast("double"))
    becomes = kind if r.action == "mode" else T.DoubleType()
    return _replace(df, r.column, F.when(gone, value).otherwise(col(r.column)).cast(becomes))


def _statistics(df: DataFrame, wanted: list[tuple[str, str]], approximate: bool) -> dict[str, Column | None]:
    """The columns' means, medians or modes as literals, None without values; so each rule adds one projection to the plan.

    Means and medians of all columns share their passes; a mode takes one, over values counted with partial sums.
    """
    out: dict[str, Column | None] = {}
    medians, means = ([c for c, a in wanted if a == action] for action in ("median", "mean"))
    number = lambda c: usable(df, c).cast("double")
    if medians or means:
        found, averages = quantiles_beside(df, [number(c) for c in medians], [0.5], [F.avg(number(c)) for c in means], approximate)
        out |= {c: F.lit(q[0]) if q else None for c, q in zip(medians, found)} | {c: None if a is None else F.lit(a) for c, a in zip(means, averages)}
    for name in (c for c, a in wanted if a == "mode"):
        # The value comes as text, which casts back to the same value.
        counts = df.select(usable(df, name).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        value = counts.agg(F.min(F.struct(-F.col("n"), "v"))["v"].cast("string")).first()[0]
        out[name] = None if value is None else F.lit(value).cast(dtype(df, name))
    return out


def _fill(df: DataFrame, name: str, forward: bool, order_by: list[str], partition_by: list[str]) -> DataFrame:
    """Last (or next) value present in order, within the rows of equal ``partition_by``."""
    (fill,) = free_names(df, "fill")
    present = F.when(usable(df, name).isNotNull(), col(name))
    return carried(df, present, order_by, partition_by, (forward,), [fill]).select(*[F.col(fill).alias(c) if c == name else col(c) for c in df.columns])
