"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import decontaminate, jaccard_join, language, minhash, ngram_lm, packing, pfor, pii, quality, ranked_search, secrets, shards, vector_codes
from podium.llm.common import scratch, table, unused

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets.scan(documents, secrets.default_models(spark, documents))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col(quality.ADDED)
    return quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"), q["base_failed"].alias("base_failed"), q["kept"].alias("kept"), q["posterior"].alias("posterior"),
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.train_and_score(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("cost")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    network = language.train(*language.sample(documents, ~held_out, rows=4000))
    return language.predict(documents, network, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, scratch(spark, "shards"), documents.schema)
    # sixteen arrivals: what came in the hours of a day, say; all rows arrive
    arrival = unused(documents, "arrival")
    store.append(documents.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(16))), arrival)
    store.compact()
    return store.read().select(
        "doc_id", F.md5("text").alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.col("__run").alias("run_id"), F.col("__tier").alias("tier"), F.col("__files").alias("run_files"), F.lit(store.version()).cast("long").alias("version"),
    )


def op11_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_errors(*vector_codes.compressed(table(spark, sf_dir, "embeddings")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_lm_scores, op4_ngram_join, op5_token_ids, op6_packing, op7_pii, op8_language, op9_decontamination, op10_sharding, op11_near_copies, op12_vector_codes, op13_ranked_search)}


JOIN_SQL = r"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [list_aggregate(w, 'string_agg', ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from words),
    sizes as (select doc_id, count(*) as n from shingles group by 1),
    common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= PERCENT * (p.n + q.n - c)),
    walk(x, y) as (select x, y from links union select walk.x, links.y from walk join links on links.x = walk.y)
    select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id from documents d left join sizes using (doc_id) left join (select x as doc_id, min(y) as m from walk group by 1) using (doc_id)"""
OP4_SQL = JOIN_SQL.replace("PERCENT", "90")
OP11_SQL = f"select *, doc_id = component_id as kept from ({JOIN_SQL.replace('PERCENT', '85')})"




def op12_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Lloyd's rounds one after another, each from all vectors."""
    x = "list_transform(embedding, lambda y: cast(floor(4096 * cast(y as double)) as bigint))"
    floor = lambda k: f"cast((sum(x[{k}]) - ((sum(x[{k}]) % count(*)) + count(*)) % count(*)) // count(*) as bigint)"
    steps = [
        f"kept as materialized (select vec_id, label, {x} as v from embeddings where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0)",
        "parts as materialized (select vec_id, label, p, v[p * 8 + 1 : p * 8 + 8] as x from kept, range(8) t(p))",
        "c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts where vec_id in (select vec_id from kept order by vec_id limit 16))",
    ]
    for r in range(rounds + 1):
        distance = "+".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in range(1, 9))
        steps.append(f"a{r} as materialized (select vec_id, label, parts.p, any_value(x) as x, min(({distance}) * 16 + e) as best from parts join c{r} on parts.p = c{r}.p group by 1, 2, 3)")
        if r < rounds:
            steps.append(f"m{r} as materialized (select p, best % 16 as e, [{', '.join(floor(k) for k in range(1, 9))}] as c from a{r} group by 1, 2)")
            steps.append(f"c{r + 1} as materialized (select p, e, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (p, e))")
    steps += [
        f"coded as (select vec_id, label, string_agg(printf('%02x', best % 16), '' order by p) as code, cast(sum(best // 16) as bigint) as error from a{rounds} group by 1, 2)",
        "labels_of as (select label, cast(sum(error) as bigint) as label_error from coded group by 1)",
        f"books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from c{rounds})",
    ]
    return "with " + ",\n    ".join(steps) + "\n    select vec_id, code, error, label_error, codebooks_sha256 from coded join labels_of on coded.label is not distinct from labels_of.label, books"


OP13_SQL = r"""with words as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
    lengths as (select doc_id, count(*) as n from words group by 1),
    totals as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from lengths),
    norms as (select doc_id, 100 - 25 + (25 * n * n_docs) // n_terms as m from lengths, totals),
    postings as (select doc_id, term, count(*) as tf from words group by 1, 2),
    weights as (select term, cast(floor(1000 * ln(cast(2 * any_value(n_docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from postings, totals group by 1),
    asked as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
    scores as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from asked join weights using (term) join postings using (term) join norms using (doc_id) group by 1, 2),
    placed as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scores where score > 0)
    select item_id, rank, doc_id, score from placed where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": OP4_SQL, "op11_near_copies": OP11_SQL, "op12_vector_codes": op12_sql(), "op13_ranked_search": OP13_SQL}
