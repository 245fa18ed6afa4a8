"""Dates in Italian and European texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Italian months by their first three letters
MONTHS = ["gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic"]


#: What a free text is cut into: numbers, words, and what separates one date of a list or range from the next.
PIECE = "\\d+|\\p{L}+|[,;]|\\.{2,}"


def month_number(c: Column) -> Column:
    """01 to 12 by the first three letters; null otherwise."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c, 1, 3)))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def iso_date(day: Column, month: Column, year: Column) -> Column:
    """yyyy-mm-dd as text. The month is a name, or a number that is left as it is; null if the day or the month is blank."""
    known = F.coalesce(F.when(month.rlike("\\d{2}"), month), month_number(month))
    parts = F.array(year.cast("string"), known, F.lpad(F.btrim(day), 2, "0"))
    there = F.forall(F.array(day, month), lambda x: F.coalesce(F.btrim(x) != "", F.lit(False)))
    return F.when(there & known.isNotNull(), F.array_join(parts, "-"))


def is_day(piece: Column) -> Column:
    return piece.rlike("^\\d{1,2}$")


def is_month(piece: Column) -> Column:
    return is_day(piece) | piece.rlike("^\\p{L}{3,}$")


def is_year(piece: Column) -> Column:
    return piece.rlike("^\\d{2,4}$")


def european_parts(c: Column) -> Column:
    """day, month and year of the first whole date in a free text; null parts if there is none.

    The text is cut into pieces, and a date is a day, a month and a year that follow each other. Of a list or a range of days that share a
    month ("7,8,10 Mar 2014", "8..11 Feb 2010") that is the last day: commas and dots between days are pieces too, so no date goes over them.
    """
    pieces = F.regexp_extract_all(c, F.lit(f"({PIECE})"), F.lit(1))
    places = F.sequence(F.lit(0), F.greatest(F.size(pieces) - 3, F.lit(0)))
    whole = F.filter(places, lambda i: is_day(F.get(pieces, i)) & is_month(F.get(pieces, i + 1)) & is_year(F.get(pieces, i + 2)))
    at = F.get(whole, F.lit(0))
    return F.struct(F.get(pieces, at).alias("day"), F.get(pieces, at + 1).alias("month"), F.get(pieces, at + 2).alias("year"))


def days_of(days: Column, year: Column) -> Column:
    """D1-D2/MM of a year as ISO dates; what is missing is xx."""
    parts = F.split(days, "/")
    month = F.coalesce(F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lit("xx"))
    return F.transform(F.split(F.get(parts, F.lit(0)), "-"), lambda x: F.concat_ws("-", year.cast("string"), month, F.when(x == "", "xx").otherwise(F.lpad(x, 2, "0"))))
