"""Queries of windows: best results, ranks, splits, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.operators import ranking as rank
from podium.plans import domain as d
from podium.plans.registry import query

AS_OF = "2001-12-31"
OUT = ["mir_id", "swimmer_id", "event", "pool", "hundredths"]


def best_sql(where: str) -> str:
    return d.sql("results", f"""select mir_id, swimmer_id, event, pool, hundredths from (select *, row_number() over (partition by swimmer_id, event, pool order by hundredths, meeting_date desc, mir_id) as n
        from results where not disqualified and hundredths > 0 and {where}) where n = 1""")


@query("W01 S02 J02 Q3 Q5", best_sql("make_date(season, 12, 31) >= date '2001-12-31' - interval 3 year"))
def best_results_3y(spark: SparkSession, sf: str) -> DataFrame:
    return rank.best_results(d.results(spark, sf), 3, AS_OF).select(*OUT)


@query("W01 Q2", best_sql("make_date(season, 12, 31) >= date '2001-12-31' - interval 5 year"))
def best_results_5y(spark: SparkSession, sf: str) -> DataFrame:
    return rank.best_results(d.results(spark, sf), 5, AS_OF).select(*OUT)


@query("W01", best_sql("true"))
def best_results_all_time(spark: SparkSession, sf: str) -> DataFrame:
    return rank.best_results(d.results(spark, sf)).select(*OUT)


@query("W01 S02", best_sql("make_date(season, 12, 31) >= date '2001-12-31' - interval 3 year and event in ('ECONOMY', 'PROMO', 'STANDARD')"))
def best_results_events_3y(spark: SparkSession, sf: str) -> DataFrame:
    return rank.best_results(d.results(spark, sf), 3, AS_OF, ["ECONOMY", "PROMO", "STANDARD"]).select(*OUT)


@query("K02 K03 F04", d.sql("results swimmers", """select s.name || ' (' || cast(year_of_birth as varchar) || ')' as swimmer, event, case when pool = 1 then '25' else '50' end as pool, cast(hundredths // 6000 as varchar) || '''' || lpad(cast(hundredths // 100 % 60 as varchar), 2, '0') || '"' || lpad(cast(hundredths % 100 as varchar), 2, '0') as timing, cast(meeting_date as varchar) as day
    from (select *, row_number() over (partition by swimmer_id, event, pool order by hundredths, meeting_date desc, mir_id) as n from results where not disqualified and hundredths > 0) join swimmers s using (swimmer_id) where n = 1"""))
def best_results_export(spark: SparkSession, sf: str) -> DataFrame:
    from podium.functions.timing import format_timing

    best = rank.best_results(d.results(spark, sf)).join(d.swimmers(spark, sf), "swimmer_id")
    return best.select(F.format_string("%s (%d)", "name", F.col("year_of_birth")).alias("swimmer"), "event", F.when(F.col("pool") == 1, "25").otherwise("50").alias("pool"), format_timing(F.col("hundredths")).alias("timing"), F.col("meeting_date").cast("string").alias("day"))


@query("W02", d.sql("results", """select mir_id, stored_rank, rank from (select *, row_number() over (partition by meeting_id, event, pool order by (hundredths = 0), hundredths, mir_id) as rank from results) where rank <> stored_rank"""))
def recompute_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return rank.ranks(d.results(spark, sf), ["meeting_id", "event", "pool"]).where("rank <> stored_rank").select("mir_id", "stored_rank", "rank")


@query("W03", d.sql("results", """select mir_id, row_number() over (partition by meeting_id, event, pool order by hundredths, mir_id) as rank from results where hundredths > 0"""))
def rank_timed(spark: SparkSession, sf: str) -> DataFrame:
    return rank.ranks(d.results(spark, sf), ["meeting_id", "event", "pool"], "drop").select("mir_id", "rank")


@query("W04", d.sql("results", """select mir_id, case when hundredths > 0 then row_number() over (partition by meeting_id, event order by case when hundredths = 0 then 603900 else hundredths end, mir_id) end as rank from results"""))
def rank_parsed(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("meeting_id", "event").orderBy(F.when(F.col("hundredths") == 0, 603900).otherwise(F.col("hundredths")), "mir_id")
    return d.results(spark, sf).select("mir_id", F.when(F.col("hundredths") > 0, F.row_number().over(order).cast("long")).alias("rank"))


@query("W05", d.sql("laps", """select mir_id, length, cumulative - lag(cumulative, 1, 0) over (partition by mir_id order by length) as delta from laps"""))
def lap_delta(spark: SparkSession, sf: str) -> DataFrame:
    return rank.lap_deltas(d.laps(spark, sf)).select("mir_id", "length", "delta")


@query("W06", d.sql("laps", """select mir_id, length, cast(sum(delta) over (partition by mir_id order by length) as bigint) as from_start from (select *, cumulative - lag(cumulative, 1, 0) over (partition by mir_id order by length) as delta from laps)"""))
def lap_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return rank.running_totals(rank.lap_deltas(d.laps(spark, sf))).select("mir_id", "length", "from_start")


@query("W07 Q9", d.sql("laps", """, holes as (select mir_id, length, case when (mir_id + length) % 3 = 0 then 0 else cumulative end as cumulative, case when (mir_id + length) % 5 = 0 then null else cumulative - lag(cumulative, 1, 0) over (partition by mir_id order by length) end as delta from laps),
    near as (select *, coalesce(lag(cumulative) over (partition by mir_id order by length), 0) as before, sum(coalesce(delta, 0)) over (partition by mir_id order by length) as summed from holes)
    select mir_id, length, cast(case when cumulative > 0 and not coalesce(delta > 0, false) then cumulative - before else delta end as bigint) as delta, cast(case when coalesce(delta > 0, false) and not cumulative > 0 then summed else cumulative end as bigint) as cumulative from near"""))
def completed_laps(spark: SparkSession, sf: str) -> DataFrame:
    laps = rank.lap_deltas(d.laps(spark, sf))
    at = F.col("mir_id") + F.col("length")
    holes = laps.select("mir_id", "length", F.when(at % 3 == 0, 0).otherwise(F.col("cumulative")).alias("cumulative"), F.when(at % 5 != 0, F.col("delta")).alias("delta"))
    return rank.completed_halves(holes).select("mir_id", "length", F.col("full_delta").alias("delta"), F.col("full_cumulative").alias("cumulative"))


@query("W08", d.sql("results", """select distinct season from results where event like 'ECO%' order by season desc limit 3"""))
def latest_seasons(spark: SparkSession, sf: str) -> DataFrame:
    return d.results(spark, sf).where("event like 'ECO%'").select("season").distinct().orderBy(F.col("season").desc()).limit(3)


@query("W09", d.sql("badges", """select season, swimmer_id, club from (select *, row_number() over (partition by swimmer_id order by season desc, club desc) as n from badges where season <> 1999) where n <= 2"""))
def other_badges(spark: SparkSession, sf: str) -> DataFrame:
    return rank.first_per(d.badges(spark, sf).where("season <> 1999"), ["swimmer_id"], [F.col("season").desc(), F.col("club").desc()], 2)


@query("W10", d.sql("results", """select team_id, mir_id from (select team_id, mir_id, row_number() over (partition by team_id order by mir_id) as n from results) where n <= 3"""))
def team_references(spark: SparkSession, sf: str) -> DataFrame:
    return rank.first_per(d.results(spark, sf), ["team_id"], [F.col("mir_id")], 3).select("team_id", "mir_id")


@query("W11 S10", """select event_id, last_value(header ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as header from (select event_id, user_id, case when event_type = 'signup' then 'S' || cast(event_id as varchar) when event_type = 'error' then 'E' || cast(event_id as varchar) end as header from events)""")
def carried_header(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("event_type") == "signup", F.concat(F.lit("S"), F.col("event_id").cast("string"))).when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id").cast("string")))
    return rank.carried(d.table(spark, sf, "events").withColumn("h", head), "h", ["user_id"], "event_id", "header").select("event_id", "header")


@query("W12", d.sql("results", """, programs as (select meeting_id, row_number() over (partition by meeting_id order by event, pool) as o, count(*) as s from results group by meeting_id, event, pool),
    walk(meeting_id, o, s, used, page) as (select meeting_id, o, s, s, 1 from programs where o = 1 union all select p.meeting_id, p.o, p.s, case when w.used + p.s > 100 then p.s else w.used + p.s end, case when w.used + p.s > 100 then w.page + 1 else w.page end from walk w join programs p on p.meeting_id = w.meeting_id and p.o = w.o + 1)
    select meeting_id, o as program, s as rows, page from walk"""))
def page_packing(spark: SparkSession, sf: str) -> DataFrame:
    programs = d.results(spark, sf).groupBy("meeting_id", "event", "pool").agg(F.count("*").alias("rows"))
    numbered = programs.withColumn("program", F.row_number().over(Window.partitionBy("meeting_id").orderBy("event", "pool")))
    return rank.greedy_pages(numbered, ["meeting_id"], "program", "rows", 100)


@query("W13", d.sql("results", """, valid as (select * from results where not disqualified and hundredths > 0), now as (select swimmer_id, event, pool, min(hundredths) as hundredths from valid where season = 2000 group by 1, 2, 3), old as (select swimmer_id, event, pool, min(hundredths) as old_hundredths from valid where season < 2000 group by 1, 2, 3)
    select n.*, old_hundredths from now n left join old o on n.swimmer_id = o.swimmer_id and n.event = o.event and n.pool = o.pool"""))
def current_vs_previous(spark: SparkSession, sf: str) -> DataFrame:
    valid, key = d.results(spark, sf).where("not disqualified and hundredths > 0"), ["swimmer_id", "event", "pool"]
    now = valid.where("season = 2000").groupBy(*key).agg(F.min("hundredths").alias("hundredths"))
    old = valid.where("season < 2000").groupBy(*key).agg(F.min("hundredths").alias("old_hundredths"))
    return now.join(old, key, "left")


@query("W14", d.sql("results swimmers", """, legs as (select relay_id, mir_id, case when swimmer_id % 3 > 0 then gender end as gender from results join swimmers using (swimmer_id)),
    numbered as (select *, row_number() over (partition by relay_id, gender is null order by mir_id) as n, count(*) over (partition by relay_id) // 2 - count(*) filter (where gender = 'F') over (partition by relay_id) as wanted from legs)
    select mir_id, coalesce(gender, case when n <= wanted then 'F' else 'M' end) as gender from numbered"""))
def mixed_relay_genders(spark: SparkSession, sf: str) -> DataFrame:
    legs = d.results(spark, sf).join(d.swimmers(spark, sf), "swimmer_id").select("relay_id", "mir_id", F.when(F.col("swimmer_id") % 3 > 0, F.col("gender")).alias("g"))
    # legs without a gender come last in one order of a relay, so it is dealt and sorted once
    order = Window.partitionBy("relay_id").orderBy(F.col("g").isNull(), "mir_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(order) - F.count("g").over(whole)
    wanted = F.floor(F.count("*").over(whole) / 2) - F.count_if(F.col("g") == "F").over(whole)
    return d.dealt(legs, spark, sf, "relay_id").select("mir_id", F.coalesce("g", F.when(nth <= wanted, "F").otherwise("M")).alias("gender"))
