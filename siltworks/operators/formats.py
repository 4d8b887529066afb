"""Type conversions by rule: to_numeric, to_integer, to_string, to_date, to_boolean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.columns import FLOATING, TEMPORAL, as_text, col, dtype, is_numeric, type_class, usable
from siltworks.operators import dates

ACTIONS = ("to_numeric", "to_integer", "to_string", "to_date", "to_boolean")
# The words that count as true and as false.
TRUE_WORDS = ("true", "vrai", "yes", "oui", "1")
FALSE_WORDS = ("false", "faux", "no", "non", "0")
DATE_FORMATS = ("yyyy-MM-dd",)
#: In place of formats: those that all of a column's values together tell.
INFER = "infer"
#: Bad values that are shown at most.
EXAMPLES = 5


@dataclass(frozen=True)
class FormatRule:
    column: str
    action: str

    @classmethod
    def from_dict(cls, rule: dict) -> FormatRule:
        if not rule.get("column") or not rule.get("action"):
            raise ValueError(f"a format rule needs column and action: {rule}")
        return cls(rule["column"], rule["action"])


def allowed_format_actions(kind) -> list[str]:
    """The conversions offered for a type."""
    return {
        "string": list(ACTIONS),
        "numeric": ["to_numeric", "to_integer", "to_string", "to_boolean"],
        "boolean": ["to_string", "to_boolean"],
        "temporal": ["to_date", "to_string"],
        "other": ["to_string"],
    }[type_class(kind)]


def _bare(text: Column) -> Column:
    """Without white space around it, of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _to_double(df: DataFrame, name: str) -> Column:
    """The value as double, null where it isn't one; a decimal comma counts as a point."""
    if is_numeric(dtype(df, name)):
        return usable(df, name).cast("double")
    if type_class(dtype(df, name)) == "boolean":
        return col(name).cast("double")
    text = F.regexp_replace(_bare(as_text(df, name)), ",", ".")
    # The cast also reads words for not-a-number and infinity and type suffixes, which are no numbers here; nor are texts too large for one.
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def _word(df: DataFrame, name: str) -> Column:
    v = usable(df, name)
    if isinstance(dtype(df, name), FLOATING):
        v = F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    return F.lower(_bare(v.cast("string")))


def _fail(df: DataFrame, name: str, bad: Column, what: str) -> None:
    """One pass counts bad values; if there are any, another finds examples, the least few different ones."""
    v = F.when(bad, as_text(df, name))
    if n := df.agg(F.count(v)).first()[0]:
        some = df.select(v.alias("v")).filter("v is not null").distinct().orderBy("v").limit(EXAMPLES).collect()
        raise ValueError(f"{n} values of {name} {what}, such as {', '.join(repr(r.v) for r in some)}")


def _check_words(df: DataFrame, name: str, word: Column) -> None:
    # At most three words are kept: two good ones and a third that is too many.
    words = [r.w for r in df.select(word.alias("w")).filter("w is not null").distinct().limit(3).collect()]
    if len(words) != 2 or not (set(words) & set(TRUE_WORDS)) or not (set(words) & set(FALSE_WORDS)):
        raise ValueError(f"{name} must hold exactly one true and one false word, not {sorted(words)}")


def _converted(df: DataFrame, name: str, action: str, date_formats: tuple[str, ...] | str) -> Column:
    """The new value, null where it can't be read; raises where the column's type does not suit."""
    kind = dtype(df, name)
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}; known: {', '.join(ACTIONS)}")
    unfit = isinstance(kind, TEMPORAL) if action != "to_date" else is_numeric(kind) or type_class(kind) == "boolean"
    if action != "to_string" and (unfit or type_class(kind) == "other"):
        becomes = {"to_date": "date", "to_boolean": "boolean"}.get(action, "number")
        raise ValueError(f"{name} of type {kind.simpleString()} can't become a {becomes}")
    if action == "to_string":
        return as_text(df, name)
    if action == "to_date":
        if isinstance(kind, TEMPORAL):
            return col(name).cast("date")
        if date_formats == INFER:
            return dates.read_dates(df, name, dates.date_formats(df, name))
        return F.coalesce(*[F.try_to_date(_bare(col(name)), f) for f in date_formats])
    if action == "to_boolean":
        word = _word(df, name)
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    number = _to_double(df, name)
    if action == "to_numeric":
        return number
    exact = col(name) if is_numeric(kind) and not isinstance(kind, FLOATING) else F.when(_bare(as_text(df, name)).rlike(r"^[+-]?\d+$"), _bare(as_text(df, name)).try_cast("bigint"))
    # Whole numbers beyond 2^53 keep their digits.
    return F.coalesce(exact.try_cast("bigint"), F.when(number % 1 == 0, number).try_cast("bigint"))


def convert(df: DataFrame, name: str, action: str, on_error: str = "raise", date_formats: tuple[str, ...] | str = DATE_FORMATS) -> DataFrame:
    """Convert one column. ``on_error`` raise looks at the data once and names bad values; null makes them null, lazily.

    ``date_formats`` infer takes dates in the forms that ``dates.date_formats`` knows, in one more pass, which raises where the
    order of day and month stays open.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error must be raise or null, not {on_error}")
    new = _converted(df, name, action, date_formats)
    if on_error == "raise":
        there = usable(df, name).isNotNull()
        if action in ("to_numeric", "to_integer"):
            number = _to_double(df, name)
            _fail(df, name, there & number.isNull(), "are no numbers")
            if action == "to_integer":
                _fail(df, name, number % 1 != 0, "have a fraction")
        elif action == "to_date":
            _fail(df, name, there & new.isNull(), "are no dates" if date_formats == INFER else f"are no dates of {', '.join(date_formats)}")
        elif action == "to_boolean":
            _check_words(df, name, _word(df, name))
    return df.select(*[new.alias(c) if c == name else col(c) for c in df.columns])


def format_problems(df: DataFrame, rules: list[dict | FormatRule], date_formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """column_name, action, n_bad, example of each rule: the values present that its conversion would null, and the least of them.

    One pass over all rules, each on the columns as they are. Rules whose type does not suit raise as ``convert`` does.
    """
    aggregates, rows = [], []
    for i, rule in enumerate(rules):
        rule = rule if isinstance(rule, FormatRule) else FormatRule.from_dict(rule)
        new, v = _converted(df, rule.column, rule.action, date_formats), usable(df, rule.column)
        bad = F.when(v.isNotNull() & new.isNull(), as_text(df, rule.column))
        aggregates += [F.count(bad).alias(f"n{i}"), F.min(bad).alias(f"e{i}")]
        rows.append(F.struct(F.lit(rule.column).alias("column_name"), F.lit(rule.action).alias("action"), F.col(f"n{i}").alias("n_bad"), F.col(f"e{i}").alias("example")))
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, action string, n_bad long, example string")
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def format_examples(df: DataFrame, rules: list[dict | FormatRule], date_formats: tuple[str, ...] | str = DATE_FORMATS, limit: int = EXAMPLES) -> DataFrame:
    """column_name, action, value, n: of each rule the least ``limit`` different values that its conversion would null, and how often they occur.

    One grouping for all rules; of each group only the rows of the first ranks are shuffled.
    """
    cells = []
    for rule in rules:
        rule = rule if isinstance(rule, FormatRule) else FormatRule.from_dict(rule)
        new, v = _converted(df, rule.column, rule.action, date_formats), usable(df, rule.column)
        bad = F.when(v.isNotNull() & new.isNull(), as_text(df, rule.column))
        cells.append(F.struct(F.lit(rule.column).alias("column_name"), F.lit(rule.action).alias("action"), bad.alias("value")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column_name string, action string, value string, n long")
    counts = df.select(F.inline(F.array(*cells))).filter("value is not null").groupBy("column_name", "action", "value").agg(F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(Window.partitionBy("column_name", "action").orderBy("value"))
    return counts.withColumn("turn", turn).filter(F.col("turn") <= limit).drop("turn")


def apply_formats(df: DataFrame, rules: list[dict | FormatRule], on_error: str = "raise", date_formats: tuple[str, ...] | str = DATE_FORMATS) -> DataFrame:
    """Convert columns rule by rule. Numbers are double, integers bigint, dates date."""
    for rule in rules:
        rule = rule if isinstance(rule, FormatRule) else FormatRule.from_dict(rule)
        df = convert(df, rule.column, rule.action, on_error, date_formats)
    return df
