"""What headings and names of crawled files say: genders, names of persons, places and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "
#: Month from which a season's results count for the category of the year after.
SEASON_STARTS = 9


def header_gender(c: Column) -> Column:
    """F, M or X of an event's heading, which begins with it, or else F or M behind the age of a category; null if neither says."""
    text = F.upper(F.btrim(F.translate(c, NBSP, " ")))
    by_age = F.regexp_extract(text, "M(?:ASTER\\s*)?\\d{2,3}\\s*([FM])", 1)
    begins = F.when(text.rlike("^(FEMMIN|F\\s*-)"), "F").when(text.rlike("^(MASCH|M\\s*-)"), "M").when(text.rlike("^(MIST[OI]|MIX)"), "X")
    return F.coalesce(begins, F.when(by_age != "", by_age))


def crawled_name(c: Column) -> Column:
    """last_name and first_name: what stands before and behind the last hard blank, or else all words but the last, and the last; one word is a surname."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^[\\s ]+|[\\s ]+$", ""))
    cut = F.when(F.instr(text, NBSP) > 0, F.array(F.regexp_extract(text, f"(?s)^(.*){NBSP}", 1), F.regexp_extract(text, f"([^{NBSP}]*)$", 1)))
    words = F.split(text, "\\s+")
    n = F.size(words)
    by_words = F.when(n > 1, F.array(F.array_join(F.slice(words, F.lit(1), n - 1), " "), F.get(words, n - 1))).otherwise(F.array(text, F.lit("")))
    parts = F.coalesce(cut, by_words)
    return F.struct(F.btrim(F.get(parts, F.lit(0))).alias("last_name"), F.btrim(F.get(parts, F.lit(1))).alias("first_name"))


def place_and_dates(url: Column) -> Column:
    """place and dates of <code>_<year>_<month>_<day>-<day>_<place>_<rest>.<extension> at the end of a URL; null where the name is of another form."""
    name = F.regexp_replace(F.element_at(F.split(url, "/"), -1), "\\.[^.]+$", "")
    parts = F.split(name, "_")
    days = F.split(F.get(parts, F.lit(3)), "-")
    whole = (F.size(parts) >= 6) & (F.size(days) == 2)
    day = lambda k: F.concat_ws("-", F.get(parts, F.lit(1)), F.lpad(F.get(parts, F.lit(2)), 2, "0"), F.lpad(F.get(days, F.lit(k)), 2, "0"))
    return F.struct(F.when(whole, F.get(parts, F.lit(4))).alias("place"), F.when(whole, F.concat_ws(",", day(0), day(1))).alias("dates"))


def category_age(year_of_birth: Column, day: Column) -> Column:
    """The age that a category counts: that of the year in which the season ends."""
    return F.year(day) + F.when(F.month(day) >= SEASON_STARTS, 1).otherwise(0) - year_of_birth
