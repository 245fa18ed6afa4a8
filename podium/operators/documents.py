"""Keys and ids inside nested documents, changed together with all that refers to them.

The keys that a document has are taken out, whatever their depth, and joined with the table of new keys as (document, key) rows; what is found comes back to
each document as maps of its own keys, and one expression rewrites all of its leaves. The table of keys is never on the driver, a document's maps are as small as the
document, and orders can't change, as nothing is taken apart. A look-up in a map goes through its keys, so a document's keys are dealt to as many small maps as they
need: a look-up costs the same in a document of any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.nested import leaves, rewritten


#: Keys of a document in one map, on average.
MAP_KEYS = 4


def found_at(key: Column) -> Column:
    """What with_found has found for a key, or null."""
    return F.try_element_at(F.get("__found", F.pmod(F.xxhash64(key), F.size("__found").cast("long")).cast("int")), key)


def with_found(documents: DataFrame, id_column: str, columns: list[str], wanted: Callable[[str], bool], table: DataFrame, key: str, value: str) -> DataFrame:
    """documents with __found, maps from the keys that it has in the wanted leaves to the table's values; a key is in the map that its hash says."""
    parts = [x for c in columns if (x := leaves(F.col(c), documents.schema[c].dataType, wanted)) is not None]
    keys = documents.select(id_column, F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias(key)).where(F.col(key).isNotNull())
    found = keys.join(table.select(F.col(key).cast("string").alias(key), value).dropDuplicates([key]), key)
    sizes = found.groupBy(id_column).agg(F.ceil(F.count("*") / MAP_KEYS).alias("__maps"))
    entry = F.struct(F.col(key).alias("key"), F.col(value).alias("value"))
    dealt = found.join(sizes, id_column).select(id_column, F.pmod(F.xxhash64(key), "__maps").cast("int").alias("__at"), entry.alias("__entry"))
    places = sizes.select(id_column, F.explode(F.sequence(F.lit(0), (F.col("__maps") - 1).cast("int"))).alias("__at"), F.lit(None).cast(dealt.schema["__entry"].dataType).alias("__entry"))
    parts_of = dealt.unionByName(places).groupBy(id_column, "__at").agg(F.collect_list("__entry").alias("__entries"))  # without the nulls
    lists = parts_of.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("__at", "__entries"))).alias("__lists"))
    return documents.join(lists.select(id_column, F.transform("__lists", lambda x: F.map_from_entries(x["__entries"])).alias("__found")), id_column, "left")


def renamed(documents: DataFrame, id_column: str, columns: list[str], keys: DataFrame, wanted: Callable[[str], bool] = lambda name: name.endswith("key")) -> DataFrame:
    """documents with all keys of the wanted leaves renamed by keys (old, new); a key without a new one stays."""
    found = with_found(documents, id_column, columns, wanted, keys, "old", "new")
    change = lambda name, leaf: F.coalesce(found_at(leaf), leaf) if wanted(name) else None
    return found.withColumns({c: rewritten(F.col(c), documents.schema[c].dataType, change) for c in columns}).drop("__found")


def synced(documents: DataFrame, id_column: str, column: str, row_id: str, stored: DataFrame, attributes: list[str]) -> DataFrame:
    """documents whose rows in column (an array of structs) have the stored attributes of their id; ids that aren't stored are cleared. found and unknown count the ids."""
    kind = documents.schema[column].dataType
    table = stored.select(F.col("id").cast("string").alias("__id"), F.struct(*attributes).alias("__row"))
    found = with_found(documents, id_column, [column], lambda name: name == row_id, table, "__id", "__row")
    row = lambda x: found_at(x[row_id].cast("string"))

    def fields(x):
        out = []
        for f in kind.elementType.fields:
            own = x[f.name]
            if f.name == row_id:
                own = F.when(row(x).isNotNull(), own)
            elif f.name in attributes:
                own = F.when(row(x).isNotNull(), row(x)[f.name]).otherwise(own)
            out.append(own.alias(f.name))
        return F.struct(*out)

    has = lambda x: x[row_id].isNotNull()
    count = lambda test: F.size(F.filter(column, test)).cast("long")
    return found.withColumns({"found": count(lambda x: has(x) & row(x).isNotNull()), "unknown": count(lambda x: has(x) & row(x).isNull()), column: F.transform(column, fields)}).drop("__found")
