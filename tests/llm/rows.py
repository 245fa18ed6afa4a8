"""Small tables with what goes wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = "an be con da en fi go ha in jo ka lo mi no or pe qui ra sa tu".split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(words))


def documents():
    texts = [None, "", "  \n\t ", "one", "one two", prose(1, 60), prose(1, 60), prose(2, 3000), "ÀÉ ß İI ſ  x²", "a" * 5000, "\x00 \x1c\x1d odd \x85 blanks"]
    return [(k, t, "en" if k % 3 else None, None if k == 4 else "s", None if t is None else len(t)) for k, t in enumerate(texts)] + [(None, prose(3, 80), "fr", "s", 1), (5, prose(1, 60), "en", "s", 1)]


def table(spark, extra: bool = True):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(documents(), SCHEMA)
    return df.selectExpr("*", "1 as id", "'x' as block", "2 as n", "'y' as kind", "3 as spans", "4 as part", "5 as component", "6 as __text") if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
