"""Removal of duplicate rows by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import col, dtype

ACTIONS = ("first", "last", "none")


@dataclass(frozen=True)
class DuplicateRule:
    columns: tuple[str, ...]
    action: str

    @classmethod
    def from_dict(cls, rule: dict) -> DuplicateRule:
        if not rule.get("columns") or not rule.get("action"):
            raise ValueError(f"a duplicate rule needs columns and action: {rule}")
        return cls(tuple(rule["columns"]), rule["action"])


def apply_duplicates(df: DataFrame, rules: list[dict | DuplicateRule], order_by: str | list[str] | None = None) -> DataFrame:
    """Keep the first, the last, or none of the rows of a key that occurs more than once; null equals null.

    ``order_by`` should order rows totally; rows it ties are decided by the whole row as JSON text. Without it,
    first keeps an arbitrary row and last is an error. Each key's row is an aggregate with partial
    results, so a key that holds much of the table is reduced before the shuffle; no window, no self-join.
    """
    order = [order_by] if isinstance(order_by, str) else order_by
    for rule in rules:
        df = _apply(df, rule if isinstance(rule, DuplicateRule) else DuplicateRule.from_dict(rule), order)
    return df


def _apply(df: DataFrame, r: DuplicateRule, order_by: list[str] | None) -> DataFrame:
    if r.action not in ACTIONS:
        raise ValueError(f"unknown action: {r.action}; known: {', '.join(ACTIONS)}")
    for c in [*r.columns, *(order_by or [])]:
        dtype(df, c)
    if r.action == "last" and not order_by:
        raise ValueError("last needs order_by")
    keys = [col(c).alias(f"_key{i}") for i, c in enumerate(r.columns)]
    row = F.struct(*[col(c) for c in df.columns])
    if r.action == "none":
        kept = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(row).alias("_row")).filter("_n = 1")
    elif not order_by:
        return df.dropDuplicates(list(r.columns))
    else:
        # Nulls first, as an ascending sort has them.
        place = F.struct(*[F.struct(col(c).isNotNull(), col(c)) for c in order_by], F.to_json(row))
        kept = df.groupBy(*keys).agg((F.min_by if r.action == "first" else F.max_by)(row, place).alias("_row"))
    return kept.select("_row.*")
