"""Outlier bounds, counts and treatment by IQR, z-score and MAD.

The bounds of all columns are computed together when an operator is called and enter the plan as numbers, so each
rule of a chain adds one projection or filter to it, whatever came before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import col, dtype, is_numeric, numeric_columns, usable
from siltworks.functions.order import interpolated
from siltworks.functions.quantiles import quantiles, quantiles_beside
from siltworks.operators.profile import histogram

METHODS = ("iqr", "z", "mad")
IQR_K, Z_THRESHOLD, MAD_THRESHOLD = 1.5, 3.0, 3.5
#: Makes the MAD of normal data estimate its standard deviation.
MAD_SCALE = 1.4826
ACTIONS = ("drop", "flag", "median", "mean", "constant", "cap", "custom_cap", "interpolate")


@dataclass(frozen=True)
class Thresholds:
    """A threshold of 0 or None means the default."""

    iqr_k: float | None = IQR_K
    z: float | None = Z_THRESHOLD
    mad: float | None = MAD_THRESHOLD


def _check(df: DataFrame, names: list[str], method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}; known: {', '.join(METHODS)}")
    for c in names:
        if not is_numeric(dtype(df, c)):
            raise ValueError(f"not a numeric column: {c}")


Bounds = tuple[float, float] | None


@dataclass(frozen=True)
class _Wanted:
    """What is asked of a column: bounds by a method, and quantiles or the mean beside."""

    column: str
    method: str | None
    thresholds: Thresholds
    shares: tuple[float, ...] = ()


@dataclass(frozen=True)
class _Found:
    bounds: Bounds
    quantiles: list[float] | None
    mean: float | None


def _statistics(df: DataFrame, wanted: list[_Wanted], approximate: bool, more: list[Column] = ()) -> tuple[list[_Found], list]:
    """All that is asked of all columns together: the passes of one column's quantiles, and one or two more for spreads by MAD.

    Bounds are None where the spread is 0 or there are no values. ``more`` are aggregates for the first pass.
    """
    of = {"iqr": (0.25, 0.75), "mad": (0.5,)}
    values = [usable(df, w.column).cast("double") for w in wanted]
    asked = [[*of.get(w.method, ()), *w.shares] for w in wanted]
    ranked = [i for i, a in enumerate(asked) if a]
    moments = [m for v in values for m in (F.avg(v), F.stddev_pop(v))]
    found, beside = quantiles_beside(df, [values[i] for i in ranked], [asked[i] for i in ranked], [*moments, *more], approximate)
    ranks = dict(zip(ranked, found))
    by_mad = [i for i, w in enumerate(wanted) if w.method == "mad"]
    centers = {i: ranks[i][0] if ranks[i] else None for i in by_mad}
    off = [F.abs(values[i] - F.lit(centers[i]).cast("double")) for i in by_mad]
    spreads = dict(zip(by_mad, quantiles(df, off, [0.5], approximate)))

    def ends(i: int, w: _Wanted) -> Bounds:
        if w.method == "z":
            center, spread = beside[2 * i : 2 * i + 2]
            reach = float(w.thresholds.z or Z_THRESHOLD) * spread if spread else 0
            # Infinities have neither mean nor spread.
            return (center - reach, center + reach) if spread and math.isfinite(spread) else None
        if w.method == "iqr":
            k, q = float(w.thresholds.iqr_k or IQR_K), ranks[i]
            return (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) if q and q[1] > q[0] else None
        if w.method == "mad":
            k, c, s = float(w.thresholds.mad or MAD_THRESHOLD) * MAD_SCALE, centers[i], spreads[i] and spreads[i][0]
            return (c - k * s, c + k * s) if s else None
        return None

    out = []
    for i, w in enumerate(wanted):
        q = ranks.get(i)
        out.append(_Found(ends(i, w), q[len(of.get(w.method, ())) :] if q else None, beside[2 * i]))
    return out, beside[len(moments) :]


def _bounds(df: DataFrame, names: list[str], method: str, t: Thresholds, approximate: bool) -> list[Bounds]:
    """low, high of each column; None where the spread is 0 or there are no values."""
    return [f.bounds for f in _statistics(df, [_Wanted(c, method, t) for c in names], approximate)[0]] if names else []


def _row(df: DataFrame, structs: list[Column], schema: str) -> DataFrame:
    """The structs of literals as rows; none give an empty frame."""
    spark = df.sparkSession
    return spark.range(1).select(F.inline(F.array(*structs))) if structs else spark.createDataFrame([], schema)


def outlier_bounds(df: DataFrame, names: list[str] | None = None, method: str = "iqr", thresholds: Thresholds = Thresholds(), approximate: bool = False) -> DataFrame:
    """column_name, low, high; null ends mean that no value is an outlier."""
    names = numeric_columns(df) if names is None else names
    _check(df, names, method)
    number = lambda x: F.lit(x).cast("double")
    found = [b or (None, None) for b in _bounds(df, names, method, thresholds, approximate)]
    return _row(df, [F.struct(F.lit(c).alias("column_name"), number(b[0]).alias("low"), number(b[1]).alias("high")) for c, b in zip(names, found)], "column_name string, low double, high double")


def outlier_overview(df: DataFrame, names: list[str] | None = None, method: str = "iqr", thresholds: Thresholds = Thresholds(), approximate: bool = False) -> DataFrame:
    """column_name, n_outliers, pct of the values present; 0 where there are no values or no spread."""
    names = numeric_columns(df) if names is None else names
    _check(df, names, method)
    bounds = _bounds(df, names, method, thresholds, approximate)
    if not names:
        return _row(df, [], "column_name string, n_outliers long, pct double")
    value = [usable(df, c).cast("double") for c in names]
    out = [(v < F.lit(b[0])) | (v > F.lit(b[1])) if b else F.lit(False) for v, b in zip(value, bounds)]
    wide = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(value)], *[F.count_if(o).alias(f"o{i}") for i, o in enumerate(out)])
    pct = lambda i: F.when(F.col(f"n{i}") > 0, F.round(F.col(f"o{i}") * F.lit(100.0) / F.col(f"n{i}"), 2)).otherwise(F.lit(0.0))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"o{i}").alias("n_outliers"), pct(i).alias("pct")) for i, c in enumerate(names)])))


BOX = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def boxplot_stats(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """min, q1, median, q3, max of the values present; all null without any."""
    _check(df, [name], "iqr")
    q = quantiles(df, [usable(df, name).cast("double")], list(BOX.values()), approximate)[0] or [None] * len(BOX)
    return df.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(c) for c, x in zip(BOX, q)])


def column_detail(df: DataFrame, name: str, method: str = "iqr", thresholds: Thresholds = Thresholds(), bins: int = 50, approximate: bool = False) -> DataFrame:
    """part, label, value of one column's detail view: its box, the bounds of the method, and a histogram.

    part is box (labels min to max), bounds (low, high; null without a spread) or histogram (label: bucket, value:
    rows in it; buckets that hold none are left out).
    """
    _check(df, [name], method)
    (found,), _ = _statistics(df, [_Wanted(name, method, thresholds, tuple(BOX.values()))], approximate)
    bounds, box = found.bounds or (None, None), found.quantiles or [None] * len(BOX)
    part = lambda kind, label, value: F.struct(F.lit(kind).alias("part"), F.lit(label).alias("label"), F.lit(value).cast("double").alias("value"))
    ends = [*[part("box", c, x) for c, x in zip(BOX, box)], *[part("bounds", c, b) for c, b in zip(("low", "high"), bounds)]]
    bars = histogram(df, name, bins).filter("bucket is not null").select(F.lit("histogram").alias("part"), F.col("bucket").cast("string").alias("label"), F.col("n").cast("double").alias("value"))
    return _row(df, ends, "").unionByName(bars)


def before_after(df: DataFrame, rules: list[dict | OutlierRule], approximate: bool = False) -> DataFrame:
    """What outlier rules would do: column_name, stage (before, after), n_rows, n_values, n_outliers and the box.

    A row for each numeric column that a rule names and each stage. Outliers of both stages are told by the bounds
    that the column's rule has before the treatment.
    """
    rules = [r if isinstance(r, OutlierRule) else OutlierRule.from_dict(r) for r in rules]
    last = {r.column: r for r in rules}
    for r in rules:
        _check_rule(df, r, None)
    box = tuple(BOX.values())
    before, _ = _statistics(df, [_Wanted(c, r.method, r.thresholds(), box) for c, r in last.items()], approximate)
    bounds = {c: f.bounds for c, f in zip(last, before)}
    if together([r.column for r in rules], [r.action == "drop" for r in rules]) == len(rules):
        treated = df
        for r, f in zip(rules, before):
            treated = _apply(treated, r, _new_value(r), _Found(f.bounds, f.quantiles and f.quantiles[2:3], f.mean), None, [])
    else:
        treated = apply_outliers(df, rules, approximate)
    schema = "column_name string, stage string, n_rows long, n_values long, n_outliers long, " + ", ".join(f"{c} double" for c in BOX)
    rows = []
    for stage, frame in (("before", df), ("after", treated)):
        value = {c: usable(frame, c).cast("double") for c in last}
        out = {c: (v < F.lit(bounds[c][0])) | (v > F.lit(bounds[c][1])) if bounds[c] else F.lit(False) for c, v in value.items()}
        more = [F.count(F.lit(1)), *[x for c in last for x in (F.count(value[c]), F.count_if(out[c]))]]
        if stage == "before":
            boxes, counts = [f.quantiles for f in before], list(frame.agg(*[m.alias(f"m{i}") for i, m in enumerate(more)]).first())
        else:
            boxes, counts = quantiles_beside(frame, list(value.values()), list(box), more, approximate)
        for i, (c, q) in enumerate(zip(last, boxes)):
            rows.append((c, stage, counts[0], counts[1 + 2 * i], counts[2 + 2 * i], *(q or [None] * len(BOX))))
    return df.sparkSession.createDataFrame(rows, schema)


def sample_numeric(df: DataFrame, name: str, n: int = 5000, seed: int = 42, key: str | None = None) -> DataFrame:
    """value: n values present, the same ones each time: the first in the order of a hash of key (or value) and seed."""
    _check(df, [name], "iqr")
    v = usable(df, name).cast("double")
    turn = F.md5(F.concat_ws(":", (col(key) if key else v).cast("string"), F.lit(str(seed))))
    rows = df.select(v.alias("value"), turn.alias("turn")).filter("value is not null")
    return rows.orderBy("turn", "value").limit(n).select("value")


def sample_fraction(df: DataFrame, name: str, n: int = 5000, seed: int = 42, key: str | None = None) -> DataFrame:
    """value: each value present with the chance that gives about n of them, then at most n; the same ones each time for a ``key``."""
    v = usable(df, name).cast("double")
    if key is None:
        rows = df.select(v.alias("value")).filter("value is not null")
        return rows.sample(False, min(1.0, max(1e-4, n / max(1, rows.count()))), seed).limit(n)
    turn = F.md5(F.concat_ws(":", col(key).cast("string"), F.lit(str(seed))))
    rows = df.select(v.alias("value"), turn.alias("turn")).filter("value is not null")
    share = min(1.0, max(1e-4, n / max(1, rows.count())))
    drawn = rows.filter(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") < share * 2.0**32)
    return drawn.orderBy("turn", "value").limit(n).select("value")


@dataclass(frozen=True)
class OutlierRule:
    column: str
    action: str
    method: str = "iqr"
    iqr_k: float | None = IQR_K
    z_threshold: float | None = Z_THRESHOLD
    mad_threshold: float | None = MAD_THRESHOLD
    constant: float | str | None = None
    lower_bound: float | str | None = None
    upper_bound: float | str | None = None

    def thresholds(self) -> Thresholds:
        return Thresholds(self.iqr_k, self.z_threshold, self.mad_threshold)

    @classmethod
    def from_dict(cls, rule: dict) -> OutlierRule:
        if not rule.get("column") or not rule.get("action"):
            raise ValueError(f"an outlier rule needs column and action: {rule}")
        method = rule.get("method") or rule.get("outliers_method")
        if not method:
            raise ValueError(f"an outlier rule needs a method: {rule}")
        names = ("iqr_k", "z_threshold", "mad_threshold", "constant", "lower_bound", "upper_bound")
        return cls(rule["column"], rule["action"], {"zscore": "z"}.get(method, method), **{k: rule[k] for k in names if k in rule})


def _number(value, what: str) -> float:
    try:
        return float(str(value).replace(",", "."))
    except ValueError:
        raise ValueError(f"{what} must be a number, not {value!r}") from None


def apply_outliers(df: DataFrame, rules: list[dict | OutlierRule], approximate: bool = False, order_by: str | list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Treat outliers rule by rule; each rule's statistics see what the rules before left.

    Missing values are no outliers. Replacement makes the column double. Without bounds (no values, no spread) a
    rule changes nothing, but ``flag`` adds its column of 0 and replacements still make it double; that holds for
    ``custom_cap`` too, whose own bounds apply only where the data has any. ``interpolate`` needs ``order_by``; outliers
    between two other values become what the line between them gives, those before the first or after the last one null.

    Rules of different columns don't see one another unless one drops rows, so their statistics are taken together.
    """
    rules = [r if isinstance(r, OutlierRule) else OutlierRule.from_dict(r) for r in rules]
    order_by = [order_by] if isinstance(order_by, str) else order_by
    while rules:
        n = together([r.column for r in rules], [r.action == "drop" for r in rules])
        some, rules = rules[:n], rules[n:]
        for r in some:
            _check_rule(df, r, order_by)
        new = [_new_value(r) for r in some]
        found, _ = _statistics(df, [_Wanted(r.column, r.method, r.thresholds(), (0.5,) if r.action == "median" else ()) for r in some], approximate)
        for r, value, f in zip(some, new, found):
            df = _apply(df, r, value, f, order_by, partition_by or [])
    return df


def _check_rule(df: DataFrame, r: OutlierRule, order_by: list[str] | None) -> None:
    _check(df, [r.column], r.method)
    if r.action not in ACTIONS:
        raise ValueError(f"unknown action: {r.action}; known: {', '.join(ACTIONS)}")
    if r.action == "interpolate" and not order_by:
        raise ValueError("interpolate needs order_by")


def together(columns: list[str], drops: list[bool]) -> int:
    """How many of the first rules look at the same rows and at columns of their own."""
    seen = set()
    for i, c in enumerate(columns):
        if c in seen:
            return i
        seen.add(c)
        if drops[i]:
            return i + 1
    return len(columns)


def _apply(df: DataFrame, r: OutlierRule, new: float | tuple[float, float] | None, found: _Found, order_by: list[str] | None, partition_by: list[str]) -> DataFrame:
    v, number, bounds = usable(df, r.column).cast("double"), col(r.column).cast("double"), found.bounds
    low, high = map(F.lit, bounds) if bounds else (None, None)
    out = F.coalesce((v < low) | (v > high), F.lit(False)) if bounds else F.lit(False)
    if r.action == "drop":
        return df.filter(~out) if bounds else df
    if r.action == "flag":
        name = f"is_outlier_{r.column}"
        return df.select(*[col(c) for c in df.columns if c.lower() != name.lower()], F.when(out, 1).otherwise(0).alias(name))
    if not bounds:
        value = number
    elif r.action == "interpolate":
        return interpolated(df, r.column, F.when(~out, v), out, order_by, partition_by)
    elif r.action == "cap":
        value = F.when(v < low, low).when(v > high, high).otherwise(number)
    elif r.action == "custom_cap":
        value = F.when(v < F.lit(new[0]), F.lit(new[0])).when(v > F.lit(new[1]), F.lit(new[1])).otherwise(number)
    else:
        new = {"mean": found.mean, "median": found.quantiles and found.quantiles[0]}.get(r.action, new)
        value = F.when(out, F.lit(new)).otherwise(number)
    return df.select(*[value.alias(c) if c == r.column else col(c) for c in df.columns])


def _new_value(r: OutlierRule) -> float | tuple[float, float] | None:
    """What the rule itself puts in the place of outliers, checked before any pass over the data."""
    if r.action == "constant":
        if r.constant is None or r.constant == "":
            raise ValueError("constant needs a value")
        return _number(r.constant, "constant")
    if r.action == "custom_cap":
        if r.lower_bound in (None, "") or r.upper_bound in (None, ""):
            raise ValueError("custom_cap needs lower_bound and upper_bound")
        least, most = _number(r.lower_bound, "lower_bound"), _number(r.upper_bound, "upper_bound")
        if least >= most:
            raise ValueError("lower_bound must be below upper_bound")
        return least, most
    return None
