"""Timings as hundredths of a second, and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: minutes are optional, and neither pattern is anchored
FIRST = "(?:(\\d{1,2})[':.])?(\\d{1,2})[.\"](\\d{1,2})"
SECOND = "(\\d{1,2})[: ](\\d{1,2})[: ](\\d{1,2})"


def to_hundredths(minutes: Column, seconds: Column, hundredths: Column) -> Column:
    zero = F.lit(0)
    return F.coalesce(minutes, zero) * 6000 + F.coalesce(seconds, zero) * 100 + F.coalesce(hundredths, zero)


def format_timing(n: Column) -> Column:
    """m'ss"hh; null stays null."""
    return F.concat(F.floor(n / 6000).cast("string"), F.lit("'"), F.lpad((F.floor(n / 100) % 60).cast("string"), 2, "0"), F.lit('"'), F.lpad((n % 100).cast("string"), 2, "0"))


def parse_timing(text: Column) -> Column:
    """Hundredths of the first timing in the text; a single digit after the seconds is tenths. Null if there is none."""

    def by(pattern: str) -> Column:
        part = [F.regexp_extract(text, pattern, k) for k in (1, 2, 3)]
        minutes = F.when(part[0] == "", 0).otherwise(part[0].try_cast("int"))
        return F.when(part[1] != "", to_hundredths(minutes, part[1].try_cast("int"), F.rpad(part[2], 2, "0").try_cast("int")))

    return F.coalesce(by(FIRST), by(SECOND))


def convert_timing(text: Column) -> Column:
    """1:00.66 with an apostrophe behind the minutes; what begins with a letter (NT, DNS, DSQ) stays."""
    return F.when(text.rlike("^[A-Za-z]"), text).otherwise(F.regexp_replace(text, "^([^:]*):", "$1'"))


def parse_timing_staging(text: Column) -> Column:
    """As parse_timing, but 0 for what can't be parsed; backticks are apostrophes, and m'ss has no hundredths."""
    plain = F.btrim(F.translate(F.coalesce(text, F.lit("")), "`’", "''"))
    whole = F.when(plain.rlike("^\\d+'\\d{1,2}$"), F.concat(plain, F.lit(".00"))).otherwise(plain)
    return F.coalesce(parse_timing(whole), F.lit(0))


def parse_score(text: Column) -> Column:
    """Apostrophes and underscores go, a last comma before up to three digits is a decimal point, and the numeric beginning counts; else 0."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "['_]", ""), ",(\\d{1,3})$", ".$1")
    return F.coalesce(F.regexp_extract(plain, "^\\s*([-+]?\\d+(?:\\.\\d+)?)", 1).try_cast("double"), F.lit(0.0))


def full_year(two_digits: Column, season_year: Column) -> Column:
    """Four digits stay; two are of the last century if that makes less than 110 years."""
    return F.when(two_digits >= 100, two_digits).when(season_year - 1900 - two_digits < 110, two_digits + 1900).otherwise(two_digits + 2000)


def match_percent(weight: Column) -> Column:
    return F.round(weight * 100, 1)


def adjusted_weight(weight: Column, same_team: Column) -> Column:
    """Up or down by 0.05, inside 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight + F.when(same_team, 0.05).otherwise(-0.05)))
