r"""Ranked lexical search with whole-number weights: each query's best documents among all.

1.  Postings: a pass over the texts gives each document's terms with their counts, its length and its place, which is
    unique where ids repeat. Document lengths are summed up; each posting has the bucket of its term, and inside a slice of
    documents the postings are in the order of bucket and term.
2.  The terms that are asked for are a small table; their document frequencies are counted over all postings of them and make the weights.
3.  Postings and the queries' terms are joined by bucket and term; each match gets its score in 64-bit integers.
4.  Scores are summed by query and document. Postings are dealt by document, so all that a document has for a query is in one task,
    and a term that every document has is spread over all tasks.
5.  The k best of each query by a window; every task keeps only its own k best before anything is shuffled.

Null texts and those without a term have no postings; they don't count in N. Rows that share an id are ranked each on its own. Rows without an
id come behind equal scores with one. Queries without terms have no rows, nor do queries without an id; queries that share
an id are one query, of all their terms. An empty table of documents or queries has an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import Tables, bounded_broadcast, small_batches

#: Terms are runs of digits, letters and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 64


def lowered(text: str) -> str:
    """text with A-Z alone in lower case."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def term_counts(texts: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, n, terms, counts) of each text: its length in terms, its terms and how often it has each."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        for batch in batches:
            own = [Counter(find(lowered(t))) if t else Counter() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([c.total() for c in own], pa.int64()), pa.array([list(c) for c in own], pa.list_(pa.string())), pa.array([list(c.values()) for c in own], pa.list_(pa.int64()))],
                names=["id", "n", "terms", "counts"],
            )

    return texts.select(id_column, text).mapInArrow(run, "id long, n long, terms array<string>, counts array<long>")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(counted: DataFrame) -> DataFrame:
    """A row for each document and term: (place, id, m, bucket, term, tf)."""
    pairs = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf"))).alias("x")
    return counted.where("n > 0").select("place", "id", "m", pairs).select("place", "id", "m", bucket(F.col("x.term")).alias("bucket"), "x.term", "x.tf")


def query_terms(queries: DataFrame, id_column: str, text: str) -> DataFrame:
    """(query, bucket, term, times): each query's terms, and how often it has each."""
    rows = term_counts(queries, id_column, text).where("id is not null").select(F.col("id").alias("query"), F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("times"))).alias("x"))
    return rows.groupBy("query", bucket(F.col("x.term")).alias("bucket"), F.col("x.term").alias("term")).agg(F.sum("x.times").alias("times"))


def ranked(documents: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query with a score above 0."""
    tables = Tables(documents.sparkSession, "ranked-search")
    counted = tables.keep(term_counts(documents, id_column, text).withColumn("place", F.monotonically_increasing_id()), "term-counts")
    asked = tables.keep(query_terms(queries, query_id, query_text), "query-terms")
    total = counted.where("n > 0").agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    # the product may pass 64 bits where the quotient doesn't
    norm = 100 - 25 + F.expr(f"cast((cast(25 as decimal(38, 0)) * n * {total.N}) div {max(total.L, 1)} as bigint)")
    terms = tables.keep(asked.select("bucket", "term").distinct(), "terms")
    found = postings(counted.withColumn("m", norm)).join(bounded_broadcast(terms), ["bucket", "term"], "left_semi")
    frequency = found.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2 * total.N + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighted = tables.keep(asked.join(frequency, ["bucket", "term"]).select("query", "bucket", "term", (weight * F.col("times")).alias("w")), "weights")
    dealt = found.repartition("place").sortWithinPartitions("bucket", "term")
    matches = dealt.join(bounded_broadcast(weighted), ["bucket", "term"]).select("query", "place", "id", F.expr("w * ((1000000000 * tf) div (1000 * tf + 12 * m))").alias("score"))
    scores = matches.groupBy("query", "place").agg(F.sum("score").alias("score"), F.first("id").alias("id")).where("score > 0")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "place")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
