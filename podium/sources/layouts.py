"""Pages of text read by layouts, as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.layout import Layout, read_page

#: Rows that a task gives out at once, however many its pages have.
AT_ONCE = 10_000


def layout_rows(pages: DataFrame, layouts: list[Layout], keys: list[str], text: str = "text") -> DataFrame:
    """keys, layout, n, context, key and fields (a map) for each match of each page; pages are read on their own, in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                name, found = read_page(row[-1] or "", layouts)
                for n, (context, key, fields) in enumerate(found):
                    out.append((*row[:-1], name, n, context, key, {k: v for k, v in fields.items() if v is not None}))
                    if len(out) == AT_ONCE:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    columns = [*keys, "layout", "n", "context", "key", "fields"]
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, text).mapInPandas(run, f"{kinds}, layout string, n int, context string, key string, fields map<string,string>")


def merged_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of the same context and key over all pages as one: the last value of each field that has one."""
    fields = rows.select(*keys, "context", "key", "page", "n", F.explode("fields").alias("field", "value"))
    last = fields.groupBy(*keys, "context", "key", "field").agg(F.max_by("value", F.struct("page", "n")).alias("value"))
    return last.groupBy(*keys, "context", "key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
