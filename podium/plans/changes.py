"""Queries of change sets: diffs, merges, purges, upserts and checks before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.functions.timing import format_timing
from podium.operators import changes as ch
from podium.operators import relational as rel
from podium.operators.ranking import first_per
from podium.operators import season
from podium.plans import domain as d
from podium.plans.registry import query
from podium.sources.shared import STRAIGHT, Steps

STORED = "select c_custkey as id, case when c_custkey % 5 > 0 then c_name end as name, case when c_custkey % 4 = 0 then null else c_mktsegment end as segment, c_nationkey as nation, c_custkey % 2 = 0 as active from customer where c_custkey % 3 > 0"
INCOMING = "select c_custkey as id, case when c_custkey % 7 = 0 then ' ' else c_name end as name, case when c_custkey % 2 = 0 then 'SPORT' else c_mktsegment end as segment, case when c_custkey % 6 = 0 then 0 else c_nationkey end as nation, c_custkey % 5 = 0 as active from customer"


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = d.table(spark, sf, "customer")
    k = F.col("c_custkey")
    stored = c.where(k % 3 > 0).select(k.alias("id"), F.when(k % 5 > 0, F.col("c_name")).alias("name"), F.when(k % 4 > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"), (k % 2 == 0).alias("active"))
    incoming = c.select(k.alias("id"), F.when(k % 7 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 2 == 0, "SPORT").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 6 == 0, 0).otherwise(F.col("c_nationkey")).alias("nation"), (k % 5 == 0).alias("active"))
    return incoming, stored


def _cells(names: dict[str, str]) -> str:
    return " union all ".join(f"select i.id, '{n}' as column, cast(i.{n} as varchar) as value from i left join s on i.id = s.id where {p.format(c='i.' + n)} and (s.id is null or i.{n} is distinct from s.{n})" for n, p in names.items())


CELLS = _cells({"name": "{c} is not null and trim({c}) <> ''", "segment": "{c} is not null and trim({c}) <> ''", "nation": "{c} is not null", "active": "coalesce({c}, false)"})


@query("U04 Q16", f"with i as ({INCOMING}), s as ({STORED}) {CELLS}")
def diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ch.diff_rows(*sides(spark, sf), "id", ["name", "segment", "nation", "active"])


@query("U02 K06", f"""with i as ({INCOMING}), s as ({STORED}), c as ({CELLS}) select id, 'UPDATE customers SET updated_at=NOW(), ' || string_agg(c.column || '=''' || replace(value, '''', '''''') || '''', ', ' order by c.column) || ' WHERE id=' || cast(id as varchar) || ';' as statement from c where id in (select id from s) group by id""")
def update_script(spark: SparkSession, sf: str) -> DataFrame:
    incoming, stored = sides(spark, sf)
    cells = ch.diff_rows(incoming, stored, "id", ["name", "segment", "nation", "active"]).join(stored.select("id"), "id", "left_semi")
    return cells.groupBy("id").agg(F.collect_list(F.struct("column", "value")).alias("x")).select("id", ch.update_statement("customers", F.col("id"), F.col("x")).alias("statement"))


@query("U01 Q15", f"""with i as ({INCOMING}), n as (select id, nullif(trim(name), '') as name, segment, nation, active from i where id % 3 = 0)
    select id, 'INSERT INTO customers (' || concat_ws(', ', 'id', case when name is not null then 'name' end, 'segment', 'nation', case when active then 'active' end) || ', created_at, updated_at) VALUES (' || concat_ws(', ', '''' || cast(id as varchar) || '''', '''' || replace(name, '''', '''''') || '''', '''' || segment || '''', '''' || cast(nation as varchar) || '''', case when active then '''true''' end) || ', NOW(), NOW());' as statement from n""")
def insert_script(spark: SparkSession, sf: str) -> DataFrame:
    incoming, stored = sides(spark, sf)
    new = incoming.join(stored.select("id"), "id", "left_anti")
    return new.select("id", ch.insert_statement("customers", {c: F.col(c) for c in ("id", "name", "segment", "nation", "active")}).alias("statement"))


@query("U03 U16 K06", d.sql("results laps", """, r as (select distinct mir_id from results where meeting_id = 199805), l as (select mir_id * 4 + length // 25 - 1 as id from laps where mir_id in (select mir_id from r))
    select 1 as step, 'DELETE' as operation, 'laps' as table, id from l union all select 2, 'DELETE', 'results', mir_id from r union all select 3, 'DELETE', 'meetings', 199805"""))
def purge_changes(spark: SparkSession, sf: str) -> DataFrame:
    r = d.results(spark, sf).where("meeting_id = 199805").select("mir_id").distinct()
    laps = d.laps(spark, sf).join(r, "mir_id", "left_semi").distinct().select((F.col("mir_id") * 4 + F.expr("length div 25") - 1).alias("id"))
    meeting = spark.range(1).select(F.lit(199805).alias("id"))
    return ch.deletions([("laps", laps, "id"), ("results", r, "mir_id"), ("meetings", meeting, "id")])


@query("K06", """select line, statement from (select 0 as line, 'START TRANSACTION;' as statement union all select row_number() over (order by s_suppkey), 'DELETE FROM teams WHERE id=' || cast(s_suppkey as varchar) || ';' from supplier where s_suppkey % 2 = 0 union all select count(*) + 1, 'COMMIT;' from supplier where s_suppkey % 2 = 0)""")
def transaction_script(spark: SparkSession, sf: str) -> DataFrame:
    gone = d.table(spark, sf, "supplier").where("s_suppkey % 2 = 0")
    return ch.script(gone.select("s_suppkey", F.concat(F.lit("DELETE FROM teams WHERE id="), F.col("s_suppkey").cast("string"), F.lit(";")).alias("statement")), ["s_suppkey"])


@query("U09 U10", f"""with a as ({INCOMING}), b as ({STORED}) select b.id, case when trim(a.name) <> '' and a.name is distinct from b.name then a.name else b.name end as name, case when a.nation > 0 then a.nation else b.nation end as nation, case when a.active then true else b.active end as active from b join a on a.id = b.id""")
def column_merge(spark: SparkSession, sf: str) -> DataFrame:
    source, target = sides(spark, sf)
    pairs = target.alias("t").join(source.alias("s"), F.col("t.id") == F.col("s.id"))
    return pairs.select(F.col("t.id").alias("id"), *ch.merged_columns(pairs, {c: (F.col(f"s.{c}"), F.col(f"t.{c}")) for c in ("name", "nation", "active")}))


@query("U10 J11", d.sql("results", """, a as (select event, pool, count(*) as n from results where meeting_id = 199706 group by 1, 2), b as (select event, pool, count(*) as n from results where meeting_id = 199707 group by 1, 2)
    select coalesce(a.event, b.event) as event, coalesce(a.pool, b.pool) as pool, case when b.n is null then 'move' when a.n is null then 'keep' else 'merge' end as action, coalesce(a.n, 0) + coalesce(b.n, 0) as expected from a full outer join b on a.event = b.event and a.pool = b.pool"""))
def meeting_merge(spark: SparkSession, sf: str) -> DataFrame:
    g = d.results(spark, sf).groupBy("meeting_id", "event", "pool").agg(F.count("*").alias("n"))
    a, b = g.where("meeting_id = 199706").select("event", "pool", F.col("n").alias("a")), g.where("meeting_id = 199707").select("event", "pool", F.col("n").alias("b"))
    action = F.when(F.col("b").isNull(), "move").when(F.col("a").isNull(), "keep").otherwise("merge")
    return a.join(b, ["event", "pool"], "full_outer").select("event", "pool", action.alias("action"), (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("expected"))


@query("U05 N07 N09 E14", d.sql("badges", """, incoming as (select season, swimmer_id, club, case when swimmer_id % 10 = 0 then swimmer_id * 100 + club end as id from badges), stored as (select season, swimmer_id, club, swimmer_id * 100 + club as id from badges where season < 1999)
    select i.season, i.swimmer_id, i.club, coalesce(i.id, s.id) as target_id, case when coalesce(i.id, s.id) is null then 'INSERT' else 'UPDATE' end as operation from incoming i left join stored s on s.season = i.season and s.swimmer_id = i.swimmer_id and s.club = i.club"""))
def badge_upserts(spark: SparkSession, sf: str) -> DataFrame:
    b, made = d.badges(spark, sf), F.col("swimmer_id") * 100 + F.col("club")
    incoming = b.withColumn("id", F.when(F.col("swimmer_id") % 10 == 0, made))
    return ch.upserts(incoming, b.where("season < 1999").withColumn("id", made), ["season", "swimmer_id", "club"], "id").drop("id")


@query("U06 U07", d.sql("results badges", """select r.mir_id, r.hundredths > 0 or r.disqualified as timed, b.club is not null as has_badge from results r left join (select * from badges where club <> 2) b on b.season = r.season and b.swimmer_id = r.swimmer_id and b.club = r.team_id % 5 where not ((r.hundredths > 0 or r.disqualified) and b.club is not null)"""))
def invalid_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = d.results(spark, sf).withColumn("club", F.col("team_id") % 5)
    b = d.badges(spark, sf).where("club <> 2").withColumn("has", F.lit(True))
    timed, has = (F.col("hundredths") > 0) | F.col("disqualified"), F.col("has").isNotNull()
    return r.join(b, ["season", "swimmer_id", "club"], "left").where(~(timed & has)).select("mir_id", timed.alias("timed"), has.alias("has_badge"))


@query("U08 N11", d.sql("results", """, programs as (select season + 1 as season, event, pool, min(mir_id) as program_id from results group by 1, 2, 3) select r.mir_id, p.program_id, p.program_id is null as new_program from results r left join programs p on p.season = r.season and p.event = r.event and p.pool = r.pool"""))
def program_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each result in the programs of the season before its own."""
    r = d.results(spark, sf)
    programs = r.groupBy((F.col("season") + 1).alias("season"), "event", "pool").agg(F.min("mir_id").alias("program_id"))
    return r.join(programs, ["season", "event", "pool"], "left").select("mir_id", "program_id", F.col("program_id").isNull().alias("new_program"))


@query("U11 U13", d.sql("badges results", """, pairs as (select a.season, a.swimmer_id, a.club as source, b.club as target from badges a join badges b on a.season = b.season and a.swimmer_id = b.swimmer_id where a.club = 3 and b.club = 1)
    select r.mir_id, p.target as club, p.source as old_club from results r join pairs p on p.season = r.season and p.swimmer_id = r.swimmer_id and r.team_id % 5 = p.source"""))
def badge_merge(spark: SparkSession, sf: str) -> DataFrame:
    b = d.badges(spark, sf)
    pairs = b.where("club = 3").select("season", "swimmer_id", F.col("club").alias("old_club")).join(b.where("club = 1").select("season", "swimmer_id", "club"), ["season", "swimmer_id"])
    return d.results(spark, sf).withColumn("old_club", F.col("team_id") % 5).join(pairs, ["season", "swimmer_id", "old_club"]).select("mir_id", "club", "old_club")


@query("U12 J12", d.sql("results", """, duplicates as (select c_custkey as swimmer_id, c_custkey - 1 as target_id from customer where c_custkey % 16 = 1) select distinct coalesce(target_id, swimmer_id) as swimmer_id, season, team_id % 5 as club from results left join duplicates using (swimmer_id)"""))
def swimmer_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Badges of all swimmers after each duplicate has given way to its target."""
    duplicates = d.swimmers(spark, sf).where("swimmer_id % 16 = 1").select("swimmer_id", (F.col("swimmer_id") - 1).alias("target_id"))
    merged = d.results(spark, sf).join(duplicates, "swimmer_id", "left")
    return merged.select(F.coalesce("target_id", "swimmer_id").alias("swimmer_id"), "season", (F.col("team_id") % 5).alias("club")).distinct()


@query("U14 J03 J05", d.sql("results", """, moved as (select mir_id, meeting_id, swimmer_id, event, pool, case when team_id % 5 = 2 then 1 else team_id % 5 end as club, team_id % 5 = 2 as changed from results)
    select mir_id, club, changed, row_number() over (partition by meeting_id, swimmer_id, event, pool, club order by changed, mir_id) > 1 as doomed from moved"""))
def team_in_meeting(spark: SparkSession, sf: str) -> DataFrame:
    club = F.col("team_id") % 5
    moved = d.results(spark, sf).select("mir_id", "meeting_id", "swimmer_id", "event", "pool", F.when(club == 2, 1).otherwise(club).alias("club"), (club == 2).alias("changed"))
    nth = F.row_number().over(Window.partitionBy("meeting_id", "swimmer_id", "event", "pool", "club").orderBy("changed", "mir_id"))
    return moved.select("mir_id", "club", "changed", (nth > 1).alias("doomed"))


@query("U17", d.sql("results", """, own as (select distinct season, 'M' || cast((season - 1940 - swimmer_id % 65) // 5 * 5 as varchar) as code, (season - 1940 - swimmer_id % 65) // 5 * 5 as age_begin from results where season - 1940 - swimmer_id % 65 >= 25)
    select cast(o.season + 1 as integer) as season, o.code, cast(o.age_begin as integer) as age_begin, cast(o.age_begin + 4 as integer) as age_end from own o where o.season < (select max(season) from results) and not exists (select 1 from own n where n.season = o.season + 1 and n.code = o.code)"""))
def category_clone(spark: SparkSession, sf: str) -> DataFrame:
    """Categories that each season lacks and the one before it has, as rows to insert."""
    r = d.results(spark, sf)
    age = F.expr("(season - 1940 - swimmer_id % 65) div 5 * 5").cast("int")
    own = r.where("season - 1940 - swimmer_id % 65 >= 25").select("season", age.alias("age_begin")).distinct()
    last = F.broadcast(r.agg(F.max("season").alias("last")))
    next_season = own.select((F.col("season") + 1).cast("int").alias("season"), "age_begin").join(last, F.col("season") <= F.col("last")).drop("last")
    missing = next_season.join(own, ["season", "age_begin"], "left_anti")
    return missing.select("season", F.concat(F.lit("M"), F.col("age_begin").cast("string")).alias("code"), "age_begin", (F.col("age_begin") + 4).alias("age_end"))


@query("U18 J14 Q12", d.sql("swimmers results age_bands", """, year as (select r.mir_id, coalesce(s.year_of_birth, 1900) as yob, r.season from results r left join (select * from swimmers where swimmer_id % 4 > 0) s using (swimmer_id))
    select mir_id, case when yob = 1900 then null else (select code from age_bands where greatest(season - yob, 16) between age_begin and age_end order by age_begin limit 1) end as category from year"""))
def recomputed_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.results(spark, sf).join(d.swimmers(spark, sf).where("swimmer_id % 4 > 0"), "swimmer_id", "left").select("mir_id", F.greatest(F.col("season") - F.col("year_of_birth"), F.when(F.col("year_of_birth").isNotNull(), 16)).alias("age"))
    ages = rel.first_match_in_range(rows.select("age").distinct().where("age is not null"), d.bands(spark, d.AGE_BANDS), F.col("age"))
    return rows.join(F.broadcast(ages), "age", "left").select("mir_id", F.col("code").alias("category"))


@query("U20", d.sql("results", """select mir_id, 'T' || cast(case when team_id = 3 then 4 else team_id end as varchar) || '/' || event as staging_key from results"""))
def cascaded_edit(spark: SparkSession, sf: str) -> DataFrame:
    edits = spark.createDataFrame([(3, 4)], "team_id long, new_id long")
    r = d.results(spark, sf).join(F.broadcast(edits), "team_id", "left")
    return r.select("mir_id", F.concat(F.lit("T"), F.coalesce("new_id", "team_id").cast("string"), F.lit("/"), F.col("event")).alias("staging_key"))


@query("U22 J11 A16", d.sql("results", """, a as (select season, swimmer_id, event, pool, min({'m': mir_id, 'h': hundredths}).h as t from results group by 1, 2, 3, 4)
    select b.season, a.swimmer_id, a.event, a.pool, case when a.t = b.t or b.t = 0 then 'same' when a.t // 100 = b.t // 100 then 'close' else 'conflict' end as band from a join a b on a.swimmer_id = b.swimmer_id and a.event = b.event and a.pool = b.pool and a.season + 1 = b.season"""))
def timing_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """The first timing of each season against that of the season before."""
    key = ["season", "swimmer_id", "event", "pool"]
    b = d.results(spark, sf).groupBy(*key).agg(F.min(F.struct("mir_id", "hundredths"))["hundredths"].alias("b"))
    a = b.withColumn("season", F.col("season") + 1).withColumnRenamed("b", "a")
    band = F.when((F.col("a") == F.col("b")) | (F.col("b") == 0), "same").when(F.floor(F.col("a") / 100) == F.floor(F.col("b") / 100), "close").otherwise("conflict")
    return a.join(b, key).select(*key, band.alias("band"))


@query("U23 J19 E11 Q7", d.sql("badges results", """, many as (select season, swimmer_id, club from badges where (season, swimmer_id) in (select (season, swimmer_id) from badges group by season, swimmer_id having count(*) > 1)),
    meetings as (select distinct swimmer_id, season, team_id % 5 as club, meeting_id from results)
    select a.season, a.swimmer_id, a.club as first_club, b.club as second_club, case when exists (select 1 from meetings x join meetings y on x.meeting_id = y.meeting_id and x.swimmer_id = y.swimmer_id where x.swimmer_id = a.swimmer_id and x.season = a.season and y.season = a.season and x.club = a.club and y.club = b.club) then 'conflict' else 'possible' end as kind
    from many a join many b on a.season = b.season and a.swimmer_id = b.swimmer_id and a.club < b.club"""))
def possible_badge_merges(spark: SparkSession, sf: str) -> DataFrame:
    b, key = d.badges(spark, sf), ["season", "swimmer_id"]
    pairs = b.withColumnRenamed("club", "first_club").join(b.withColumnRenamed("club", "second_club"), key).where("first_club < second_club")
    m = d.results(spark, sf).select(*key, (F.col("team_id") % 5).alias("club"), "meeting_id").distinct()
    shared = m.withColumnRenamed("club", "first_club").join(m.withColumnRenamed("club", "second_club"), [*key, "meeting_id"]).where("first_club < second_club").select(*key, "first_club", "second_club").distinct().withColumn("both", F.lit(True))
    return pairs.join(shared, [*key, "first_club", "second_club"], "left").select(*key, "first_club", "second_club", F.when(F.col("both"), "conflict").otherwise("possible").alias("kind"))


@query("U24", d.sql("badges", """select swimmer_id, season from badges a where club = 4 and not exists (select 1 from badges b where b.swimmer_id = a.swimmer_id and b.season = a.season and b.club <> 4)"""))
def orphan_badges(spark: SparkSession, sf: str) -> DataFrame:
    b = d.badges(spark, sf)
    return b.where("club = 4").join(b.where("club <> 4"), ["swimmer_id", "season"], "left_anti").select("swimmer_id", "season")


@query("U25 W08 G18", d.sql("badges swimmers", """, latest as (select distinct season from badges order by season desc limit 3) select swimmer_id, string_agg(cast(season as varchar) || ':' || cast((season - year_of_birth) // 5 * 5 as varchar), ' ' order by season) as categories from (select distinct season, swimmer_id from badges) join swimmers using (swimmer_id) where season in (select season from latest) group by 1"""))
def category_map(spark: SparkSession, sf: str) -> DataFrame:
    b = d.badges(spark, sf).select("season", "swimmer_id").distinct()
    latest = b.select("season").distinct().orderBy(F.col("season").desc()).limit(3)
    band = (F.expr("(season - year_of_birth) div 5") * 5).cast("string")
    rows = b.join(F.broadcast(latest), "season", "left_semi").join(d.swimmers(spark, sf), "swimmer_id").select("swimmer_id", "season", F.concat(F.col("season").cast("string"), F.lit(":"), band).alias("x"))
    return rows.groupBy("swimmer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("season", "x"))), lambda s: s["x"]), " ").alias("categories"))


@query("U26", d.sql("badges results", """, dup as (select season, swimmer_id from badges group by 1, 2 having count(*) > 1) select b.season, b.swimmer_id, b.club, count(r.mir_id) as results from badges b join dup using (season, swimmer_id) left join results r on r.season = b.season and r.swimmer_id = b.swimmer_id and r.team_id % 5 = b.club
    where (b.season, b.swimmer_id) in (select (season, swimmer_id) from badges where club = 0) group by 1, 2, 3"""))
def duplicate_badges(spark: SparkSession, sf: str) -> DataFrame:
    b, key = d.badges(spark, sf), ["season", "swimmer_id"]
    dup = rel.duplicate_keys(b, key).drop("n").join(b.where("club = 0"), key, "left_semi")
    r = d.results(spark, sf).withColumn("club", F.col("team_id") % 5).groupBy(*key, "club").agg(F.count("*").alias("results"))
    return b.join(dup, key, "left_semi").join(r, [*key, "club"], "left").select(*key, "club", F.coalesce("results", F.lit(0)).alias("results"))


@query("E15 F06", d.sql("results", """, r as (select *, season * 12 + meeting_id % 100 as month from results)
    select i.mir_id, s.mir_id as stored_id, case when i.event = s.event and i.team_id % 5 = s.team_id % 5 and i.hundredths = s.hundredths then 'perfect' when i.event = s.event and i.team_id % 5 = s.team_id % 5 then 'partial' when i.event = s.event then 'team mismatch' else 'other event' end as tier, abs(i.hundredths - s.hundredths) as gap
    from r i join r s on s.swimmer_id = i.swimmer_id and (s.month = i.month or s.month = i.month + 1) where i.pool = 1"""))
def result_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Each meeting's results of the first pool against the swimmer's stored ones of that meeting and of the next."""
    r = d.results(spark, sf).withColumn("month", F.col("season") * 12 + F.col("meeting_id") % 100)
    i, s = r.where("pool = 1").alias("i"), r.withColumn("month", F.explode(F.array("month", F.col("month") - 1))).alias("s")
    same_event, same_team, same_time = F.col("i.event") == F.col("s.event"), F.col("i.team_id") % 5 == F.col("s.team_id") % 5, F.col("i.hundredths") == F.col("s.hundredths")
    tier = F.when(same_event & same_team & same_time, "perfect").when(same_event & same_team, "partial").when(same_event, "team mismatch").otherwise("other event")
    pairs = i.join(s, (F.col("i.swimmer_id") == F.col("s.swimmer_id")) & (F.col("i.month") == F.col("s.month")))
    return pairs.select(F.col("i.mir_id").alias("mir_id"), F.col("s.mir_id").alias("stored_id"), tier.alias("tier"), F.abs(F.col("i.hundredths") - F.col("s.hundredths")).alias("gap"))


@query("E16", d.sql("relay_swimmers", """select relay_id, string_agg(cast(leg_swimmer as varchar), '>' order by leg_swimmer) as swimmers, count(*) as legs from relay_swimmers group by 1 having count(*) > 1"""))
def relay_report(spark: SparkSession, sf: str) -> DataFrame:
    g = d.relay_swimmers(spark, sf).groupBy("relay_id").agg(F.array_sort(F.collect_list("leg_swimmer")).alias("x"), F.count("*").alias("legs"))
    return g.where("legs > 1").select("relay_id", F.array_join(F.transform("x", lambda v: v.cast("string")), ">").alias("swimmers"), "legs")


@query("E17", """select s_suppkey, coalesce(n_nationkey, -1) as city_id, n_nationkey is null as new_city from supplier left join (select * from nation where n_regionkey <> 2) on n_nationkey = s_nationkey""")
def find_or_prepare(spark: SparkSession, sf: str) -> DataFrame:
    cities = d.table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_nationkey"))
    joined = d.table(spark, sf, "supplier").join(cities, "s_nationkey", "left")
    return joined.select("s_suppkey", F.coalesce("n_nationkey", F.lit(-1)).alias("city_id"), F.col("n_nationkey").isNull().alias("new_city"))


@query("E18 A18", d.sql("results swimmers", """select relay_id, count(*) filter (where swimmer_id % 4 = 0) as no_year, count(*) filter (where swimmer_id % 6 = 0) as no_gender, bool_or(stored_rank = 1 and hundredths = 0) as orphan from results join swimmers using (swimmer_id) group by 1 having count(*) filter (where swimmer_id % 4 = 0 or swimmer_id % 6 = 0) > 0"""))
def relay_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    r, k = d.results(spark, sf).join(d.swimmers(spark, sf), "swimmer_id"), F.col("swimmer_id")
    g = r.groupBy("relay_id").agg(F.count_if(k % 4 == 0).alias("no_year"), F.count_if(k % 6 == 0).alias("no_gender"), F.bool_or((F.col("stored_rank") == 1) & (F.col("hundredths") == 0)).alias("orphan"))
    return g.where("no_year + no_gender > 0")


@query("E19 J16", d.sql("swimmers", """select s.swimmer_id, coalesce(case when s.swimmer_id % 3 > 0 then s.year_of_birth end, a.year_of_birth) as year_of_birth, coalesce(case when s.swimmer_id % 2 > 0 then s.gender end, a.gender) as gender from swimmers s left join swimmers a on a.swimmer_id = s.swimmer_id + 1"""))
def blanks_filled(spark: SparkSession, sf: str) -> DataFrame:
    s, k = d.swimmers(spark, sf), F.col("swimmer_id")
    aux = s.select((k - 1).alias("swimmer_id"), F.col("year_of_birth").alias("y"), F.col("gender").alias("g"))
    return s.join(aux, "swimmer_id", "left").select("swimmer_id", F.coalesce(F.when(k % 3 > 0, F.col("year_of_birth")), F.col("y")).alias("year_of_birth"), F.coalesce(F.when(k % 2 > 0, F.col("gender")), F.col("g")).alias("gender"))


@query("G01 G02 P03", """select c_custkey, c_name, c_mktsegment from customer where c_mktsegment = 'BUILDING' and c_nationkey in (1, 2, 3) and c_acctbal >= 0""")
def grid_filter(spark: SparkSession, sf: str) -> DataFrame:
    return grid(d.table(spark, sf, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": [1, 2, 3], "c_acctbal": (0, None)}, ["c_custkey", "c_name", "c_mktsegment"], ["c_name"])


def grid(df: DataFrame, filters: dict, columns: list[str], order: list[str]) -> DataFrame:
    """A grid: equal to a value, one of a list, or inside a range (from, to; None is open); nothing for None."""
    for name, want in filters.items():
        if isinstance(want, tuple):
            low, high = want
            df = df.where((F.col(name) >= low) if low is not None else F.lit(True)).where((F.col(name) <= high) if high is not None else F.lit(True))
        elif isinstance(want, list):
            df = df.where(F.col(name).isin(want))
        elif want is not None:
            df = df.where(F.col(name) == want)
    return df.orderBy(*order).select(*columns)


@query("G10 G11", """select source, string_agg(lang, ',' order by lang) as langs, 'https://x.org/' || source || '.pdf' as url from (select distinct source, lang from documents where lang is not null and trim(lang) <> '') group by 1""")
def corpus_values(spark: SparkSession, sf: str) -> DataFrame:
    g = d.table(spark, sf, "documents").where("lang is not null and trim(lang) <> ''").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))
    return g.withColumn("url", F.format_string("https://x.org/%s.pdf", "source"))


@query("G12 N01", """select count(*) as total, count(*) filter (where o_orderkey is not null) as found, count(*) filter (where o_orderkey is null) as unknown from (select c_custkey, c_custkey * 7 as id from customer) left join orders on o_orderkey = id""")
def fixture_sync(spark: SparkSession, sf: str) -> DataFrame:
    ids = d.table(spark, sf, "customer").select((F.col("c_custkey") * 7).alias("o_orderkey"))
    known = d.table(spark, sf, "orders").select("o_orderkey", F.lit(True).alias("known"))
    return ids.join(known, "o_orderkey", "left").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNotNull()).alias("found"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query("K04 F04", d.sql("results", """select row_number() over (order by best, swimmer_id) as place, swimmer_id, cast(best // 6000 as varchar) || '''' || lpad(cast(best // 100 % 60 as varchar), 2, '0') || '"' || lpad(cast(best % 100 as varchar), 2, '0') as timing from (select swimmer_id, min(hundredths) as best from results where hundredths > 0 group by 1) order by best, swimmer_id limit 50"""))
def ranking_export(spark: SparkSession, sf: str) -> DataFrame:
    best = d.results(spark, sf).where("hundredths > 0").groupBy("swimmer_id").agg(F.min("hundredths").alias("best"))
    top = best.orderBy("best", "swimmer_id").limit(50)
    return top.select(F.row_number().over(Window.orderBy("best", "swimmer_id")).cast("long").alias("place"), "swimmer_id", format_timing(F.col("best")).alias("timing"))


@query("N13 N15 E14", d.sql("results", """, l as materialized (select mir_id, unnest([25, 50, 75, 100]) as length from results where hundredths > 0), s as materialized (select mir_id, length, true as stored from l where length <= 50)
    select mir_id, length, case when stored then 'UPDATE' else 'INSERT' end as operation from l left join s using (mir_id, length)"""))
def lap_upserts(spark: SparkSession, sf: str) -> DataFrame:
    laps = d.laps(spark, sf)
    stored = laps.where("length <= 50").select("mir_id", "length", F.lit(True).alias("stored"))
    return laps.join(stored, ["mir_id", "length"], "left").select("mir_id", "length", F.when(F.col("stored"), "UPDATE").otherwise("INSERT").alias("operation"))


@query("E08 L08", d.sql("results", """select swimmer_id, mir_id, weight from (select swimmer_id, mir_id, cast(least(1, greatest(0, (mir_id % 100) / 100.0 + case when team_id % 5 = 0 then 0.05 else -0.05 end)) * 1000 as bigint) as weight,
    row_number() over (partition by swimmer_id order by (team_id % 5 = 0) desc, (pool = 1) desc, mir_id % 100 desc, mir_id) as n from results) where n = 1"""))
def chosen_candidate(spark: SparkSession, sf: str) -> DataFrame:
    r, team = d.results(spark, sf), F.col("team_id") % 5 == 0
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("mir_id") % 100) / 100 + F.when(team, 0.05).otherwise(-0.05)))
    best = first_per(r, ["swimmer_id"], [team.desc(), (F.col("pool") == 1).desc(), (F.col("mir_id") % 100).desc(), F.col("mir_id")])
    return best.select("swimmer_id", "mir_id", F.round(weight * 1000).cast("long").alias("weight"))


def _season_fix_sql(rounds: int = 12) -> str:
    parts = ["b as materialized (select season, swimmer_id, team_id, count(*) as n from results group by all)", "alias_0 as materialized (select distinct season, team_id, team_id as root from b)"]
    for k in range(rounds):
        parts += [
            f"g_{k} as materialized (select season, swimmer_id, root, sum(n) as n from b join alias_{k} using (season, team_id) group by all)",
            f"e_{k} as materialized (select distinct season, min(root) as x, max(root) as y from g_{k} group by season, swimmer_id having count(*) = 2 and min(n) <= 1 and min(root) % {CLUBS} = max(root) % {CLUBS})",
            f"s_{k} as (select season, x, y from e_{k} union select season, y, x from e_{k})",
            f"w_{k}(season, x, y) as (select season, x, y from s_{k} union select w.season, w.x, s.y from w_{k} w join s_{k} s on s.season = w.season and s.x = w.y)",
            f"r_{k} as (select season, x as root, least(x, min(y)) as next from w_{k} group by season, x)",
            f"alias_{k + 1} as materialized (select a.season, team_id, coalesce(next, a.root) as root from alias_{k} a left join r_{k} using (season, root))",
        ]
    return d.sql("results", ", " + ", ".join(parts) + f""" select season, swimmer_id, team_id, survivor from (select *, first_value(team_id) over (partition by season, swimmer_id, root order by n desc, team_id) as survivor from b join alias_{rounds} using (season, team_id)) where team_id <> survivor""")


#: Teams are of so many clubs, by the remainder of their id.
CLUBS = 5


@query("U19 U11 U23 G15 G16", _season_fix_sql())
def season_fix(spark: SparkSession, sf: str) -> DataFrame:
    """Badges that go in each season, once check and merge have come to an end."""
    n = d.partitions(spark, sf)
    r = d.results(spark, sf, dealt_to=min(n, STRAIGHT)).select("season", "swimmer_id", "team_id").repartition(n, "season", "swimmer_id")
    steps = Steps(spark, "season-fix")
    own = steps.keep(season.by_swimmer(r.groupBy("season", "swimmer_id", "team_id").agg(F.count("*").alias("n"))), "swimmers")
    teams, _ = season.renamed_teams(own, CLUBS, steps)
    return season.badge_merges(season.badges_of(own.where(F.size("badges") > 1)), teams, n)


ENTITIES = {
    # entity: (survey row, natural key), over the last season's results, that come in, and all earlier ones, that are stored
    "calendar": ("N02", ["month", "event"]),
    "event": ("N10", ["month", "pool"]),
    "program": ("N11", ["event", "pool", "gender"]),
    "affiliation": ("N07", ["team_id"]),
    "swimmer": ("N08", ["swimmer_id"]),
    "relay swimmer": ("N15", ["relay_team", "pool"]),
    "relay lap": ("N16", ["relay_team", "pool", "gender"]),
}
_key_sql = {"month": "meeting_id % 100", "event": "event", "pool": "pool", "gender": "case when swimmer_id % 2 = 0 then 'F' else 'M' end", "team_id": "team_id", "swimmer_id": "swimmer_id", "relay_team": "team_id % 17"}
_entity_sql = ", keyed as (" + " union all ".join(f"select '{name}' as entity, concat_ws('/', {', '.join(_key_sql[k] for k in keys)}) as key, mir_id, season from results" for name, (_, keys) in ENTITIES.items()) + """),
    last as (select max(season) as season from results), stored as (select entity, key, min(mir_id) as found from keyed where season < (select season from last) group by 1, 2)
    select n.entity, n.key, found as target_id, case when found is null then 'INSERT' else 'UPDATE' end as operation
    from (select distinct entity, key from keyed where season = (select season from last)) n left join stored s on n.entity = s.entity and n.key = s.key"""


@query("U05 N02 N07 N08 N10 N11 N15 N16", d.sql("results", _entity_sql))
def entity_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """What the last season brings of each entity, with the stored row that it updates, if there is one."""
    r = d.results(spark, sf).withColumns({"month": F.col("meeting_id") % 100, "gender": F.when(F.col("swimmer_id") % 2 == 0, "F").otherwise("M"), "relay_team": F.col("team_id") % 17})
    text = lambda keys: F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    own = F.array(*(F.struct(F.lit(name).alias("entity"), text(keys).alias("key")) for name, (_, keys) in ENTITIES.items()))
    last = F.broadcast(d.results(spark, sf).agg(F.max("season").alias("last")))
    keyed = r.join(last, F.col("season") <= F.col("last")).select("mir_id", (F.col("season") == F.col("last")).alias("comes"), F.inline(own))
    incoming = keyed.where("comes").select("entity", "key").distinct().withColumn("id", F.lit(None).cast("long"))
    return ch.upserts(incoming, keyed.where("not comes").withColumnRenamed("mir_id", "id"), ["entity", "key"], "id").select("entity", "key", "target_id", "operation")


@query("Q21 P05 Q13 Q19", d.sql("age_bands results", """select mir_id, event || '/' || cast(swimmer_id as varchar) as key from results where starts_with(event || '/' || cast(swimmer_id as varchar), 'PROMO/1') and season - 1940 not in (select age_begin from age_bands where code = 'U25')"""))
def key_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.col("event"), F.lit("/"), F.col("swimmer_id").cast("string"))
    undivided = F.broadcast(d.bands(spark, d.AGE_BANDS).where("code = 'U25'").select("age_begin"))
    r = d.results(spark, sf).where(key.startswith("PROMO/1")).withColumn("age_begin", F.col("season") - 1940)
    return r.join(undivided, "age_begin", "left_anti").select("mir_id", key.alias("key"))
