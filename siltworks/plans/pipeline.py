"""Cleaning pipelines: ordered steps of rules that can be kept, shown, stored and replayed."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.columns import missing
from siltworks.operators.duplicates import apply_duplicates
from siltworks.operators.formats import apply_formats
from siltworks.operators.missing import apply_missing
from siltworks.operators.outliers import apply_outliers
from siltworks.sources.scratch import scratch_path

STEPS = ("formats", "missing_values", "duplicates", "outliers")
ALIASES = {"missing": "missing_values"}


def step_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in STEPS:
        raise ValueError(f"unknown step: {name}; known: {', '.join(STEPS)}")
    return name


@dataclass(frozen=True)
class Pipeline:
    """Steps ``(name, rules)`` in the order in which they run; at most one of each name. A value: changes give a new one."""

    steps: tuple[tuple[str, tuple[Mapping, ...]], ...] = ()

    def with_step(self, name: str, rules: list[Mapping]) -> Pipeline:
        """The step at the end; an earlier one of its name goes."""
        name = step_name(name)
        return Pipeline((*self.without(name).steps, (name, tuple(rules))))

    def without(self, name: str) -> Pipeline:
        name = step_name(name)
        return Pipeline(tuple(s for s in self.steps if s[0] != name))

    def cleared(self) -> Pipeline:
        """No steps: the start again. Data that was written stays."""
        return Pipeline()

    def rules(self, name: str) -> list[Mapping]:
        """A step's rules in force: of several for one column the last; all of them for duplicates."""
        name = step_name(name)
        found = [r for n, rules in self.steps if n == name for r in rules]
        return found if name == "duplicates" else list({r.get("column"): r for r in found}.values())

    def apply(self, df: DataFrame, order_by: str | list[str] | None = None, partition_by: list[str] | None = None, on_error: str = "raise", approximate: bool = False, written: bool = False) -> DataFrame:
        """Run the steps in turn; each sees the columns and values that the steps before left.

        Statistics read what they are of when a step is applied. With ``written`` each step's result but the last one's is a
        Parquet table in the shared folder, so that later steps read that instead of computing the steps before again;
        the tables stay as long as the folder.
        """
        for number, (name, rules) in enumerate(self.steps):
            rules = list(rules)
            if number and written:
                path = scratch_path(df.sparkSession, "step")
                df.write.parquet(path)
                df = df.sparkSession.read.schema(df.schema).parquet(path)
            if name == "formats":
                df = apply_formats(df, rules, on_error)
            elif name == "missing_values":
                df = apply_missing(df, rules, order_by, partition_by, on_error, approximate)
            elif name == "duplicates":
                df = apply_duplicates(df, rules, order_by)
            else:
                df = apply_outliers(df, rules, approximate, order_by, partition_by)
        return df

    def trace(self, df: DataFrame, order_by: str | list[str] | None = None, partition_by: list[str] | None = None, on_error: str = "raise") -> DataFrame:
        """step_no, step, n_rows, n_missing: rows and missing cells before the first step (0) and after each.

        Each step's result is written to the shared folder and counted there, so no step is computed twice.
        """
        spark, rows, steps = df.sparkSession, [], [(0, "", df), *[(i, s[0], s) for i, s in enumerate(self.steps, 1)]]
        for number, name, step in steps:
            if number:
                df = Pipeline((step,)).apply(df, order_by, partition_by, on_error)
                path = scratch_path(spark, "trace")
                df.write.parquet(path)
                df = spark.read.schema(df.schema).parquet(path)
            gone = [F.count_if(missing(df, c)) for c in df.columns]
            counts = df.agg(F.count(F.lit(1)).alias("n"), *[g.alias(f"m{i}") for i, g in enumerate(gone)]).first()
            rows.append((number, name, counts[0], sum(counts[1:])))
        return spark.createDataFrame(rows, "step_no int, step string, n_rows long, n_missing long")

    def history(self) -> list[tuple[int, str, str, str, str]]:
        """step_no, step, target, action, parameters of each rule."""
        out = []
        for number, (name, rules) in enumerate(self.steps, 1):
            for r in rules:
                target = ", ".join(r["columns"]) if name == "duplicates" else r.get("column", "")
                rest = {k: v for k, v in r.items() if k not in ("column", "columns", "action", "strategy") and v is not None}
                out.append((number, name, target, r.get("action") or r.get("strategy") or "", json.dumps(rest, sort_keys=True, ensure_ascii=False) if rest else ""))
        return out

    def describe(self, spark: SparkSession, card: Mapping | None = None) -> DataFrame:
        """The history as a frame; entries of a dataset's card come before it, as rows of step number 0."""
        before = [(0, "dataset", k, "", v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)) for k, v in (card or {}).items()]
        return spark.createDataFrame(before + self.history(), "step_no int, step string, target string, action string, parameters string")

    def to_json(self) -> str:
        return json.dumps([{"step": n, "params": [dict(r) for r in rules]} for n, rules in self.steps], ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        out = cls()
        for step in json.loads(text):
            if "step" not in step or "params" not in step:
                raise ValueError(f"a step needs step and params: {step}")
            out = out.with_step(step["step"], step["params"])
        return out
