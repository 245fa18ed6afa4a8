"""Queries of headings, crawled names and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import headers
from podium.plans import domain as d
from podium.plans.merges import run
from podium.plans.registry import query

HEADINGS = "select p_partkey, case p_partkey % 10 when 0 then 'Femminile ' when 1 then '  MASCHI - ' when 2 then 'Misti ' when 3 then 'mix ' when 4 then 'F - ' when 5 then 'm- ' when 6 then 'Master 80F ' when 7 then 'M95M ' when 8 then 'Master 120x ' else '' end || p_type || ' ' || p_brand as heading from part"
FILES = "select o_orderkey, 'https://example.org/' || o_orderpriority || '/' || case when o_orderkey % 5 = 0 then 'notes_2024' else 'C' || cast(o_custkey as string) || '_' || cast(year(o_orderdate) as string) || '_' || cast(month(o_orderdate) as string) || '_' || cast(dayofmonth(o_orderdate) as string) || case when o_orderkey % 7 = 0 then '' else '-' || cast(dayofmonth(o_orderdate) + 1 as string) end || '_' || o_orderstatus || 'place_web' end || '.pdf' as url from orders"


@query("F45", f"""with h as ({HEADINGS}), t as (select p_partkey, upper(trim(heading)) as x from h) select p_partkey, case when regexp_matches(x, '^(FEMMIN|F\\s*-)') then 'F' when regexp_matches(x, '^(MASCH|M\\s*-)') then 'M' when regexp_matches(x, '^(MIST[OI]|MIX)') then 'X' else nullif(regexp_extract(x, 'M(?:ASTER\\s*)?\\d{{2,3}}\\s*([FM])', 1), '') end as gender from t""")
def heading_genders(spark: SparkSession, sf: str) -> DataFrame:
    h = run(spark, HEADINGS, {"part": d.table(spark, sf, "part")})
    return h.select("p_partkey", headers.header_gender(F.col("heading")).alias("gender"))


@query("F42", f"""with f as ({FILES}), p as (select o_orderkey, string_split(regexp_replace(string_split(url, '/')[-1], '\\.[^.]+$', ''), '_') as p from f), q as (select *, string_split(p[4], '-') as days, len(p) >= 6 and len(string_split(p[4], '-')) = 2 as whole from p)
    select o_orderkey, case when whole then p[5] end as place, case when whole then p[2] || '-' || lpad(p[3], 2, '0') || '-' || lpad(days[1], 2, '0') || ',' || p[2] || '-' || lpad(p[3], 2, '0') || '-' || lpad(days[2], 2, '0') end as dates from q""")
def places_of_files(spark: SparkSession, sf: str) -> DataFrame:
    f = run(spark, FILES, {"orders": d.table(spark, sf, "orders")})
    return f.select("o_orderkey", headers.place_and_dates(F.col("url")).alias("x")).select("o_orderkey", "x.*")


@query("F33", f"""with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')[1 : 1 + doc_id % 4] as words from documents)
    select doc_id, case when len(words) > 1 then (case when doc_id % 3 = 0 then array_to_string(words[1 : -2], '{headers.NBSP}') else array_to_string(words[1 : -2], ' ') end) else coalesce(words[1], '') end as last_name, case when len(words) > 1 then words[-1] else '' end as first_name from w""")
def names_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Names read out of the first words of each text, some joined by hard blanks."""
    k = F.col("doc_id")
    words = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != ""), F.lit(1), (1 + k % 4).cast("int"))
    name = F.when(k % 3 == 0, F.array_join(words, headers.NBSP)).otherwise(F.array_join(words, " "))
    return d.table(spark, sf, "documents").select("doc_id", headers.crawled_name(name).alias("x")).select("doc_id", "x.*")


@query("F60 F15", d.sql("results", """ select mir_id, cast(year(meeting_date) + case when month(meeting_date) >= 9 then 1 else 0 end - 1940 - swimmer_id % 65 as bigint) as age from results"""))
def category_ages(spark: SparkSession, sf: str) -> DataFrame:
    """The age that counts for each result's category."""
    return d.results(spark, sf).select("mir_id", headers.category_age(1940 + F.col("swimmer_id") % 65, F.col("meeting_date")).cast("long").alias("age"))
