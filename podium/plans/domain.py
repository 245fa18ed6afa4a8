"""The competition domain over the driver's tables, as DataFrames and as the same in SQL.

Meetings are months of order dates, seasons their years, swimmers are customers, teams suppliers, individual
results line items, relay results orders. A result of returnflag N and linestatus F has no time (0).

mir_id is in the order of order and line, whose factors fit 61 bits to 34 billion orders; rows that share both, as the given tables
have, are told apart by a remainder of part and supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mir_id() -> Column:
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 8388608 + (F.col("l_partkey") * 100003 + F.col("l_suppkey")) % 8388593


def partitions(spark: SparkSession, sf_dir: str, rows: int = 500_000) -> int:
    """So many that one has about so many results, however large the tables are."""
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(few, -(-table(spark, sf_dir, "lineitem").count() // rows))


def dealt(df: DataFrame, spark: SparkSession, sf_dir: str, key: str, rows: int = 500_000) -> DataFrame:
    """Results by key, in partitions of about so many of them."""
    return df.repartition(partitions(spark, sf_dir, rows), key)


def results(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None, dealt_to: int | None = None) -> DataFrame:
    """Individual results with the keys of their hierarchy; the joins are inner along foreign keys. With ids only those of these mir_id, which are looked up before the joins.
    With dealt_to the joins run in so many partitions, each of which holds its orders and parts and sorts nothing."""
    lines = table(spark, sf_dir, "lineitem")
    if ids is not None:
        lines = lines.join(ids.select(F.col("mir_id").alias("__wanted")), mir_id() == F.col("__wanted"), "left_semi")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    day = F.to_date("o_orderdate")
    by = lambda df, key: df.repartition(dealt_to, key) if dealt_to else df
    held = lambda df, key: by(df, key).hint("shuffle_hash") if dealt_to else df
    placed = by(lines, "l_orderkey").join(held(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        by(placed, "l_partkey").join(held(parts, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            mir_id().alias("mir_id"),
            F.col("l_orderkey").alias("relay_id"),
            F.col("o_custkey").alias("swimmer_id"),
            F.col("l_suppkey").alias("team_id"),
            F.year(day).alias("season"),
            (F.year(day) * 100 + F.month(day)).alias("meeting_id"),
            day.alias("meeting_date"),
            F.col("p_type").alias("event"),
            (1 + F.col("l_linenumber") % 2).alias("pool"),
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.lit(0)).otherwise(F.floor("l_extendedprice")).cast("long").alias("hundredths"),
            (F.col("l_returnflag") == "R").alias("disqualified"),
            F.col("l_linenumber").alias("stored_rank"),
        )
    )


def swimmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("swimmer_id"),
        F.col("c_name").alias("name"),
        (1940 + F.col("c_custkey") % 65).alias("year_of_birth"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("city_id"))


def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season, swimmer and team of every entry; five clubs."""
    return results(spark, sf_dir).select("season", "swimmer_id", (F.col("team_id") % 5).alias("club")).distinct()


def relay_swimmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("relay_id", "meeting_id", (F.col("team_id") % 3).alias("leg_swimmer")).distinct()


def laps(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Four laps a timed result; cumulative hundredths."""
    return (
        results(spark, sf_dir, ids)
        .where("hundredths > 0")
        .select("mir_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("lap"), F.col("hundredths"))
        .select("mir_id", (F.col("lap") * 25).alias("length"), F.floor(F.col("hundredths") * F.col("lap") / 4).cast("long").alias("cumulative"))
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("route")).agg(F.count("*").alias("count"))


#: Age bands of individual categories and of relays (sums of four ages), with codes.
AGE_BANDS = [("U25", 16, 24), *((f"M{a}", a, a + 4) for a in range(25, 100, 5))]
RELAY_BANDS = [(f"{a}-{a + 39}", a, a + 39) for a in range(80, 400, 40)]


def bands(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "code string, age_begin int, age_end int")


def band_values(rows: list[tuple[str, int, int]]) -> str:
    return ", ".join(f"('{c}', {a}, {b})" for c, a, b in rows)


_CTE = {
    "results": """select ((l_orderkey * 8 + l_linenumber) * 8388608 + (l_partkey * 100003 + l_suppkey) % 8388593) as mir_id, l_orderkey as relay_id, o_custkey as swimmer_id,
        l_suppkey as team_id, cast(year(o_orderdate) as integer) as season, cast(year(o_orderdate) * 100 + month(o_orderdate) as integer) as meeting_id,
        cast(o_orderdate as date) as meeting_date, p_type as event, cast(1 + l_linenumber % 2 as integer) as pool,
        case when l_returnflag = 'N' and l_linestatus = 'F' then 0 else cast(floor(l_extendedprice) as bigint) end as hundredths,
        l_returnflag = 'R' as disqualified, l_linenumber as stored_rank
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "swimmers": "select c_custkey as swimmer_id, c_name as name, 1940 + c_custkey % 65 as year_of_birth, case when c_custkey % 2 = 0 then 'F' else 'M' end as gender from customer",
    "teams": "select s_suppkey as team_id, s_name as name, s_nationkey as city_id from supplier",
    "badges": "select distinct season, swimmer_id, team_id % 5 as club from results",
    "relay_swimmers": "select distinct relay_id, meeting_id, team_id % 3 as leg_swimmer from results",
    "laps": "select mir_id, k * 25 as length, cast(floor(hundredths * k / 4) as bigint) as cumulative from results, (values (1), (2), (3), (4)) t(k) where hundredths > 0",
    "usage_log": "select cast(ts as date) as day, event_type as route, count(*) as count from events group by 1, 2",
    "age_bands": f"select * from (values {band_values(AGE_BANDS)}) t(code, age_begin, age_end)",
    "relay_bands": f"select * from (values {band_values(RELAY_BANDS)}) t(code, age_begin, age_end)",
}
_NEEDS = {"badges": ["results"], "relay_swimmers": ["results"], "laps": ["results"]}


def sql(names: str, body: str) -> str:
    """body behind the definitions of these names; further definitions in body begin with a comma."""
    wanted: list[str] = []
    for name in names.split():
        for x in [*_NEEDS.get(name, []), name]:
            if x not in wanted:
                wanted.append(x)
    return "with recursive " + ",\n".join(f"{x} as ({_CTE[x]})" for x in wanted) + "\n" + body
