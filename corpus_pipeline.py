"""A training corpus in five stages; each works on all that its predecessor kept, and its decisions take effect.

quality        texts that the weakly supervised rules reject go
near_copies    of each group of texts that share 80 % of their five-word shingles, over any number of links, one row stays
benchmark      texts that overlap with a benchmark item go
secrets        secrets in texts give way to a mark
packing        what is left is cut and packed into sequences of 1024 tokens; a row a piece

Null and empty texts fail the quality rules. near_copies decides by row, whatever its id: rows that share an id but not
their text both stay. The row that stays of a group has the smallest id (a missing one is the largest) and, among rows of that id,
the smallest hash of all columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import decontaminate, jaccard_join, packing, quality, secrets
from podium.llm.common import Tables, bounded_broadcast, table, unused, written

WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, tables = unused(docs, "row"), Tables(spark, "near-copies")
    rows = tables.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = tables.keep(jaccard_join.components(rows, WORDS, PERCENT, row).select(F.col(row).alias("at"), "component_id"), "groups")
    order = rows.select(F.col(row).alias("at"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), F.col(row).alias("at")).alias("least"))
    first = groups.join(order, "at").groupBy("component_id").agg(F.min("least").alias("least")).select(F.col("least.at").alias(row))
    return rows.join(bounded_broadcast(tables.keep(first, "kept-rows")), row, "left_semi").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, secrets.default_models(spark, docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: No SQL has the tokenizers, the trained models or the search by spaced seeds; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
