"""Files of the import: CSV of unknown delimiter, paged texts, drop folders, and the sinks that write them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.names import is_blank


def read_sniffed_csv(spark: SparkSession, path: str, wanted: list[str], separators: str = ",;") -> DataFrame:
    """A CSV file with a header whose delimiter is the first of separators under which the header has the wanted columns."""
    for sep in separators:
        df = spark.read.csv(path, sep=sep, header=True)
        if set(wanted) <= set(df.columns):
            return df.select(*wanted)
    raise ValueError(f"no separator of {separators!r} gives the columns {wanted} in {path}")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """startURL, date, isCancelled, name, place, meetingUrl, year; blanks are null, the flag is a boolean, the year a number."""
    df = spark.read.csv(path, header=True)
    text = {c: F.when(~is_blank(F.col(c)), F.btrim(c)).alias(c) for c in df.columns}
    clean = df.select(*text.values())
    return clean.withColumns({"isCancelled": F.coalesce(F.lower("isCancelled").isin("true", "1", "yes", "annullata"), F.lit(False)), "year": F.col("year").try_cast("int")})


def paged_lines(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, page, line, value: pages end at form feeds, lines at line ends."""
    pages = texts.select(*keys, F.posexplode(F.split(text, "\f")).alias("page", "__page"))
    return pages.select(*keys, "page", F.posexplode(F.split("__page", "\r?\n")).alias("line", "value"))


def read_paged_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, page, line and value of whole text files."""
    return paged_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), "value", ["path"])


def write_grid(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """A grid as CSV under the columns' titles."""
    df.select(*(F.col(c).alias(title) for c, title in columns.items())).write.csv(path, header=True)


def next_sequence(spark: SparkSession, folder: str) -> int:
    """One more than the largest number that a file in folder begins with; the number of files where none does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    numbers = [int(m[0]) for n in names if (m := re.match(r"\d+", n))]
    return max(numbers) + 1 if numbers else len(names)


def replace_with_backup(df: DataFrame, path: str) -> None:
    """Writes aside, moves what is there to path.bak, and the new files into place."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(of(path)):
        fs.delete(of(f"{path}.bak"), True)
        fs.rename(of(path), of(f"{path}.bak"))
    fs.rename(of(f"{path}.new"), of(path))
