"""Queries of nested documents: layouts, dictionaries, wide and long forms, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.plans import domain as d
from podium.plans.registry import query


@query("F70 A12", d.sql("results", """, e as (select meeting_id, event, pool, min(mir_id) as first, count(*) as n, sum(hundredths) as total from results group by 1, 2, 3) select meeting_id, string_agg(event || '/' || cast(pool as varchar) || ':' || cast(n as varchar) || '=' || cast(total as varchar), ' ' order by first) as events from e group by 1"""))
def regrouped_events(spark: SparkSession, sf: str) -> DataFrame:
    e = d.results(spark, sf).groupBy("meeting_id", "event", "pool").agg(F.min("mir_id").alias("first"), F.count("*").alias("n"), F.sum("hundredths").alias("total"))
    text = F.format_string("%s/%d:%d=%d", "event", F.col("pool"), F.col("n"), F.col("total"))
    return e.select("meeting_id", "first", text.alias("x")).groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "x"))), lambda s: s["x"]), " ").alias("events"))


@query("F71", d.sql("results", """select swimmer_id, max_by(team_id, mir_id) as team_id, count(distinct team_id) as seen from results group by 1"""))
def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    return d.results(spark, sf).groupBy("swimmer_id").agg(F.max_by("team_id", "mir_id").alias("team_id"), F.count_distinct("team_id").alias("seen"))


@query("F72 F74", d.sql("laps", """select mir_id, max(case when length = 25 then cumulative end) as lap25, max(case when length = 50 then cumulative end) as lap50, max(case when length = 75 then cumulative end) as lap75, max(case when length = 100 then cumulative end) as lap100 from laps group by 1"""))
def laps_to_columns(spark: SparkSession, sf: str) -> DataFrame:
    wide = d.laps(spark, sf).groupBy("mir_id").pivot("length", [25, 50, 75, 100]).agg(F.max("cumulative"))
    return wide.select("mir_id", *(F.col(str(n)).alias(f"lap{n}") for n in (25, 50, 75, 100)))


@query("F72 F76", d.sql("laps", """select mir_id, length, cumulative from laps where (mir_id + length) % 3 > 0"""))
def columns_to_laps(spark: SparkSession, sf: str) -> DataFrame:
    # at size, results can share a mir_id: a cell holds the laps of all of them
    wide = d.laps(spark, sf).groupBy("mir_id").pivot("length", [25, 50, 75, 100]).agg(F.collect_list("cumulative"))
    holes = wide.select("mir_id", *(F.when((F.col("mir_id") + n) % 3 > 0, F.col(str(n))).alias(str(n)) for n in (25, 50, 75, 100)))
    return holes.unpivot("mir_id", ["25", "50", "75", "100"], "length", "laps").select("mir_id", F.col("length").cast("int").alias("length"), F.explode("laps").alias("cumulative"))


@query("F73", """select c_custkey, case when c_custkey % 4 = 1 then '' when c_custkey % 4 = 2 then 'a' when c_custkey % 4 = 3 then 'a,b' else 'a,b,c,d' end as swimmers from customer""")
def stop_at_gap(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(*(F.when(k % 4 != n, F.lit(x)) for n, x in ((1, "a"), (2, "b"), (3, "c"), (9, "d"))))
    gap = F.aggregate(F.transform(names, lambda x, i: F.when(x.isNull(), i)), F.lit(4), lambda a, x: F.least(a, F.coalesce(x, a)))
    return d.table(spark, sf, "customer").select("c_custkey", F.array_join(F.slice(names, F.lit(1), gap), ",").alias("swimmers"))


@query("F75 U21", """select p_partkey, kind, v as timing from (select p_partkey, unnest(['25_m', '50_m', '25_f', '50_f']) as kind, unnest([cast(p_size as varchar), case when p_partkey % 3 = 0 then '-' else cast(p_size + 1 as varchar) end, cast(p_size + 2 as varchar), case when p_partkey % 5 = 0 then '-' else cast(p_size + 3 as varchar) end]) as v from part) where v <> '-'""")
def timing_groups(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    wide = d.table(spark, sf, "part").select("p_partkey", s.cast("string").alias("25_m"), F.when(k % 3 == 0, "-").otherwise((s + 1).cast("string")).alias("50_m"), (s + 2).cast("string").alias("25_f"), F.when(k % 5 == 0, "-").otherwise((s + 3).cast("string")).alias("50_f"))
    return wide.unpivot("p_partkey", ["25_m", "50_m", "25_f", "50_f"], "kind", "timing").where("timing <> '-'")


@query("F77 A23", d.sql("results", """select relay_id, bool_or(team_id % 7 = 0) as any_missing, count(*) filter (where team_id % 7 = 0) as missing from results group by 1"""))
def rescanned_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.results(spark, sf).groupBy("relay_id").agg(F.collect_list(F.struct(F.when(F.col("team_id") % 7 != 0, F.col("team_id")).alias("team"))).alias("rows"))
    return rows.select("relay_id", F.exists("rows", lambda r: r["team"].isNull()).alias("any_missing"), F.size(F.filter("rows", lambda r: r["team"].isNull())).cast("long").alias("missing"))


@query("F78 S03", """select event_id, event_type, json_extract_string(props, '$.k') as k, props is not null as has_props from events""")
def json_requests(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("props").isNotNull().alias("has_props"))


@query("F79", """select c_custkey, '0=' || c_mktsegment || ';1=' || cast(c_nationkey as varchar) || ';10=z' as params from customer""")
def nested_params(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.create_map(F.lit("10"), F.lit("z"), F.lit("1"), F.col("c_nationkey").cast("string"), F.lit("0"), F.col("c_mktsegment")))
    entries = F.map_entries(F.from_json(body, "map<string,string>"))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].alias("v"))))
    return d.table(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(ordered, lambda e: F.concat(e["i"].cast("string"), F.lit("="), e["v"])), ";").alias("params"))


@query("F80", """select doc_id, sha256(text) as digest from documents""")
def content_digests(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("K07 K12 S03", """select o_orderkey, '{"_meta":{"phase":1,"schema_version":"1.0"},"data":{"id":' || cast(o_orderkey as varchar) || ',"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}}' as body from orders""")
def phase_files(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.struct(F.lit(1).alias("phase"), F.lit("1.0").alias("schema_version"))
    data = F.struct(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return d.table(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(meta.alias("_meta"), data.alias("data"))).alias("body"))


@query("S04", """select page_id, coalesce(try_cast(nullif(regexp_extract('{"name":"x","layoutType":' || cast(1 + page_id % 4 as varchar) || ',"r":[]}', '"layoutType"\\s*:\\s*(\\d+)', 1), '') as integer), 0) as layout from pages""")
def sniffed_layout(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"name":"x","layoutType":'), (1 + F.col("page_id") % 4).cast("string"), F.lit(',"r":[]}'))
    found = F.regexp_extract(F.substring(body, 1, 128), '"layoutType"\\s*:\\s*(\\d+)', 1)
    return d.table(spark, sf, "pages").select("page_id", F.coalesce(found.try_cast("int"), F.lit(0)).alias("layout"))


@query("S11 S14", """select page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') as lang, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') as heading, len(regexp_extract_all(html, '<li>')) as items from pages""")
def page_headers(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return d.table(spark, sf, "pages").select("page_id", one('<html lang="([a-z]+)"').alias("lang"), one("<title>([^<]*)</title>").alias("title"), one("<h1>([^<]*)</h1>").alias("heading"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"))


@query("P01 P09", """select conv_id, turn, role from conversations where text is not null and trim(text) <> ''""")
def present_turns(spark: SparkSession, sf: str) -> DataFrame:
    from podium.functions.names import is_blank

    return d.table(spark, sf, "conversations").where(~is_blank(F.col("text"))).select("conv_id", "turn", "role")
