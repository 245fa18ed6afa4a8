"""Change sets: what a merge, a purge or an import would write, as rows; and their rendering as SQL statements.

A change is (step, operation, table, id, column, value). Nothing is written in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType

from podium.functions.names import sql_literal
from podium.operators.ranking import numbered

WHOLE = (IntegerType, LongType, ShortType)


def present(c: Column, kind: object) -> Column:
    """Not blank: null, false, '' and white space are blank, 0 is not."""
    if isinstance(kind, BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, StringType):
        return c.isNotNull() & (F.btrim(c) != "")
    return c.isNotNull()


def diff_rows(incoming: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value) of what an import writes: all that isn't blank of a new row; of a stored one, what isn't blank and differs."""
    old = stored.select(key, F.lit(True).alias("__stored"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = incoming.join(old, key, "left")
    kinds = {c: incoming.schema[c].dataType for c in columns}
    cells = [
        F.when(present(F.col(c), kinds[c]) & (F.col("__stored").isNull() | ~F.col(c).eqNullSafe(F.col(f"__{c}"))), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
        for c in columns
    ]
    return joined.select(key, F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select(key, "x.column", "x.value")


def merged_columns(pairs: DataFrame, columns: dict[str, tuple[Column, Column]]) -> list[Column]:
    """For each column of a merge, the source's value if it wins: numbers above 0, floats also by more than 0.001, true, and texts that are there and differ."""
    out = []
    for name, (source, target) in columns.items():
        kind = pairs.select(source.alias("x")).schema["x"].dataType
        if isinstance(kind, BooleanType):
            wins = F.coalesce(source, F.lit(False))
        elif isinstance(kind, WHOLE):
            wins = F.coalesce(source > 0, F.lit(False))
        elif isinstance(kind, DoubleType | FloatType):
            wins = F.coalesce((source > 0) & (target.isNull() | (F.abs(source - target) > 0.001)), F.lit(False))
        else:
            wins = source.isNotNull() & (F.btrim(source) != "") & ~source.eqNullSafe(target)
        out.append(F.when(wins, source).otherwise(target).alias(name))
    return out


def deletions(tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Deletes of ids, table after table in the order of their foreign keys."""
    parts = [df.select(F.lit(k).alias("step"), F.lit("DELETE").alias("operation"), F.lit(name).alias("table"), F.col(key).cast("long").alias("id")) for k, (name, df, key) in enumerate(tables, 1)]
    return reduce(DataFrame.unionByName, parts)


def insert_statement(table: str, columns: dict[str, Column]) -> Column:
    """INSERT of the columns that aren't blank; blank ones, false too, are left out."""
    text = {k: F.when(c.isNotNull() & ~F.btrim(c.cast("string")).isin("", "false"), c) for k, c in columns.items()}
    names = F.concat_ws(", ", *(F.when(c.isNotNull(), F.lit(k)) for k, c in text.items()))
    values = F.concat_ws(", ", *(F.when(c.isNotNull(), sql_literal(c)) for c in text.values()))
    return F.concat(F.lit(f"INSERT INTO {table} ("), names, F.lit(", created_at, updated_at) VALUES ("), values, F.lit(", NOW(), NOW());"))


def update_statement(table: str, key: Column, changes: Column) -> Column:
    """UPDATE from an array of (column, value), in the columns' order."""
    sets = F.array_join(F.transform(F.array_sort(changes), lambda x: F.concat(x["column"], F.lit("="), sql_literal(x["value"]))), ", ")
    return F.concat(F.lit(f"UPDATE {table} SET updated_at=NOW(), "), sets, F.lit(" WHERE id="), key.cast("string"), F.lit(";"))


def script(statements: DataFrame, order: list[str]) -> DataFrame:
    """Numbered lines between START TRANSACTION and COMMIT; they are numbered in ranges of the order."""
    body = numbered(statements, order, "line").select(F.col("line").cast("long").alias("line"), "statement")
    n = body.groupBy().agg(F.count("*").alias("n"))
    first = n.select(F.lit(0).cast("long").alias("line"), F.lit("START TRANSACTION;").alias("statement"))
    last = n.select((F.col("n") + 1).alias("line"), F.lit("COMMIT;").alias("statement"))
    return first.unionByName(body).unionByName(last)


def upserts(incoming: DataFrame, stored: DataFrame, natural_key: list[str], id_column: str) -> DataFrame:
    """incoming with `target_id` and `operation`: a known id wins, then the stored row of the natural key (the least id), else it is new."""
    by_key = stored.groupBy(*natural_key).agg(F.min(id_column).alias("__found"))
    joined = incoming.join(by_key, natural_key, "left")
    target = F.coalesce(F.col(id_column), F.col("__found"))
    return joined.withColumn("target_id", target).withColumn("operation", F.when(target.isNull(), "INSERT").otherwise("UPDATE")).drop("__found")


def applied(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored after (key, column, value) changes and without the rows of null columns' deletes."""
    pivot = changes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__new"))
    joined = stored.join(pivot, key, "left")
    kinds = {f.name: f.dataType for f in stored.schema}
    return joined.select(*(F.coalesce(F.try_element_at("__new", F.lit(c)).cast(kinds[c]), F.col(c)).alias(c) if c != key else F.col(c) for c in stored.columns))
