"""Titles of events, strokes and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what makes a stroke, tried in this order
STROKES = [("SL", "stile|sl"), ("DO", "do"), ("RA", "ra"), ("FA", "fa|de|df|dl"), ("MI", "mi|mx")]
NORMAL = [("stile(?:\\slibero)?", "SL"), ("mi(?:sti)?", "MI"), ("do(?:rso)?", "DO"), ("ra(?:na)?", "RA"), ("fa(?:rfalla)?|de(?:lfino)?|df|dl", "FA")]
TITLE = "(?i)(?:(\\d)x)?(\\d{2,4})m?\\W+(\\w[\\w\\s]*)"


def parse_event(title: Column) -> Column:
    """phases, length (of all phases) and stroke; null if the title has no length and style."""
    phases, length, style = (F.regexp_extract(title, TITLE, k) for k in (1, 2, 3))
    n = F.when(phases == "", 1).otherwise(phases.try_cast("int"))
    stroke = F.coalesce(*(F.when(style.rlike(f"(?i){pattern}"), F.lit(code)) for code, pattern in STROKES))
    mixed = F.when((stroke == "MI") & (n > 1), "MX").otherwise(stroke)
    return F.when(length != "", F.struct(n.alias("phases"), (n * length.try_cast("int")).alias("length"), mixed.alias("stroke")))


def normalized_title(title: Column) -> Column:
    for pattern, code in NORMAL:
        title = F.regexp_replace(title, f"(?i){pattern}", code)
    return title


def is_relay(title: Column) -> Column:
    return title.rlike("(?i)(4|6|8)x\\d{2,3}")


def relay_code(title: Column) -> Column:
    """S4X50SL from a relay's title; an unknown stroke raises."""
    e = parse_event(title)
    phase = (e["length"] / e["phases"]).cast("int")
    return F.when(is_relay(title), F.when(e["stroke"].isNull(), F.raise_error(F.concat(F.lit("unknown stroke in "), title))).otherwise(F.concat(F.lit("S"), e["phases"].cast("string"), F.lit("X"), phase.cast("string"), e["stroke"])))


def category_code(code: Column) -> Column:
    """Two or three bare digits, with an X or not, are a masters' category; other codes are in capitals."""
    return F.when(code.rlike("(?i)^\\d{2,3}x?$"), F.concat(F.lit("M"), code)).otherwise(F.upper(code))


def relay_category_code(code: Column, known: list[str]) -> Column:
    """Bare digits are the first known category that begins with them; 80X is the one that ends at 79; null if none is known."""
    codes = F.array(*map(F.lit, known))
    ends = F.filter(codes, lambda c: F.endswith(c, F.lit("-79")))
    begins = F.filter(codes, lambda c: F.startswith(c, F.concat(code, F.lit("-"))))
    return F.when(code.rlike("(?i)^80x$"), F.get(ends, F.lit(0))).when(code.rlike("(?i)^\\d{2,3}x?$"), F.get(begins, F.lit(0))).otherwise(F.upper(code))


def relay_range(base: Column) -> Column:
    """The twenty years from a base age: 240-259."""
    return F.concat(base.cast("string"), F.lit("-"), (base + 19).cast("string"))


def relay_band(code: Column) -> Column:
    """The band of ages of a relay's code: M80 and M100 have twenty years, older ones forty; U80 is 60-79, and other codes have all ages."""
    plain = F.upper(F.btrim(F.coalesce(code, F.lit(""))))
    base = F.regexp_extract(plain, "^M(\\d{2,3})$", 1).try_cast("int")
    band = F.concat(base.cast("string"), F.lit("-"), (base + F.when(base <= 100, 19).otherwise(39)).cast("string"))
    return F.when(plain == "U80", "60-79").otherwise(F.coalesce(band, F.lit("000-999")))
