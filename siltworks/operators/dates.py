"""Dates in free form: the formats of a text column, decided by all of its values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import as_text

_TIME = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?"
_MONTH, _LONG_MONTH = r"[A-Za-z]{3}\.?", r"[A-Za-z]{4,9}"


@dataclass(frozen=True)
class Shape:
    """Texts that a pattern tells, and the formats that may read their date part, which is the pattern's first group."""

    name: str
    pattern: str
    formats: tuple[str, ...]


#: Every text has at most one shape. Where two formats read a shape, the whole column decides which one does.
SHAPES = (
    Shape("iso", rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}}){_TIME}$", ("yyyy-M-d",)),
    Shape("year first", rf"^(\d{{4}}/\d{{1,2}}/\d{{1,2}}){_TIME}$", ("yyyy/M/d",)),
    Shape("digits", r"^(\d{8})$", ("yyyyMMdd",)),
    Shape("slashes", rf"^(\d{{1,2}}/\d{{1,2}}/\d{{4}}){_TIME}$", ("d/M/yyyy", "M/d/yyyy")),
    Shape("dashes", rf"^(\d{{1,2}}-\d{{1,2}}-\d{{4}}){_TIME}$", ("d-M-yyyy", "M-d-yyyy")),
    Shape("dots", rf"^(\d{{1,2}}\.\d{{1,2}}\.\d{{4}}){_TIME}$", ("d.M.yyyy",)),
    Shape("day and month", rf"^(\d{{1,2}} {_MONTH} \d{{4}}){_TIME}$", ("d MMM yyyy",)),
    Shape("day and long month", rf"^(\d{{1,2}} {_LONG_MONTH} \d{{4}}){_TIME}$", ("d MMMM yyyy",)),
    Shape("month and day", rf"^({_MONTH} \d{{1,2}}, \d{{4}}){_TIME}$", ("MMM d, yyyy",)),
    Shape("long month and day", rf"^({_LONG_MONTH} \d{{1,2}}, \d{{4}}){_TIME}$", ("MMMM d, yyyy",)),
)


def _bare(df: DataFrame, name: str) -> Column:
    return F.regexp_replace(as_text(df, name), r"^\s+|\s+$", "")


def _readings(df: DataFrame, name: str) -> list[tuple[Shape, list[Column]]]:
    """For each shape what its formats make of a value: null for one of another shape or that is no day of the calendar."""
    text = _bare(df, name)
    out = []
    for shape in SHAPES:
        # A month's first letter is a capital, its others are not; a point after it goes.
        day = F.regexp_replace(F.initcap(F.regexp_extract(text, shape.pattern, 1)), r"\.(?= )", "") if "MMM" in shape.formats[0] else F.regexp_extract(text, shape.pattern, 1)
        out.append((shape, [F.when(text.rlike(shape.pattern), F.try_to_date(day, f)) for f in shape.formats]))
    return out


def date_formats(df: DataFrame, name: str) -> dict[str, str]:
    """The format of each shape that the column's values have, by one aggregate.

    Where a shape can have the day first or the month first, a day above twelve tells which. Where values tell both, or
    none does, and others remain that the two read as different dates, it raises ValueError with the numbers of each kind.
    """
    readings, wanted = _readings(df, name), []
    for shape, read in readings:
        a, b = read[0], read[-1]
        wanted += [F.count_if(F.coalesce(*read).isNotNull()), F.count_if(a.isNotNull() & b.isNull()), F.count_if(a.isNull() & b.isNotNull()), F.count_if(a != b)]
    row = df.agg(*[w.alias(f"n{i}") for i, w in enumerate(wanted)]).first()
    found = {}
    for i, (shape, _) in enumerate(readings):
        n, first, last, either = row[4 * i : 4 * i + 4]
        if not n:
            continue
        if either and bool(first) == bool(last):
            raise ValueError(f"{name}: {either} dates with {shape.name} can be read with the day or the month first; {first} are with the day first, {last} with the month first")
        found[shape.name] = shape.formats[-1] if last and not first else shape.formats[0]
    return found


def read_dates(df: DataFrame, name: str, formats: dict[str, str]) -> Column:
    """The date that a text of any shape has, null for others; times of day and zones are left out.

    ``formats`` are those that ``date_formats`` found. What a shape's format cannot read is read by its other one.
    """
    read = [c for shape, columns in _readings(df, name) for _, c in sorted(zip(shape.formats, columns), key=lambda x: x[0] != formats.get(shape.name))]
    return F.coalesce(*read)
