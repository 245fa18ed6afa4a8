"""What shows only in large tables: keys that collide, documents of many keys."""

import datetime

import duckdb
from pyspark.sql import functions as F

from podium.operators import documents, ranking
from podium.plans import registry
from tests import oracle


def test_laps_of_results_that_share_a_mir_id(spark, tmp_path):
    day = datetime.datetime(2000, 5, 1)
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(1, 2, 3, 4, 1000.0, "A", "O"), (1, 2, 3, 4, 3000.0, "A", "O")], line).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2, "LARGE")], "p_partkey long, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert oracle.differences(registry.queries()["columns_to_laps"](spark, str(tmp_path)), con, registry.oracle_sql()["columns_to_laps"]) == ""


def test_laps_at_one_place_count_together(spark):
    laps = spark.createDataFrame([(1, 25, 10, 10), (1, 25, 15, 5), (1, 50, 22, 7)], "mir_id long, length int, cumulative long, delta long")
    assert sorted(r.from_start for r in ranking.running_totals(laps).collect()) == [15, 15, 22]
    holes = laps.withColumn("cumulative", F.lit(0))
    assert sorted(r.full_cumulative for r in ranking.completed_halves(holes).collect()) == [15, 15, 22]


def test_a_document_of_many_keys_has_small_maps(spark):
    rows = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: F.struct(k.cast("string").alias("a_key")))
    docs = spark.range(2).select(F.col("id").alias("document"), rows.alias("rows"))
    keys = spark.range(1, 1500).select(F.col("id").cast("string").alias("old"), (-F.col("id")).cast("string").alias("new"))
    found = documents.with_found(docs, "document", ["rows"], lambda name: name.endswith("key"), keys, "old", "new")
    assert max(r.n for r in found.select(F.array_max(F.transform("__found", F.size)).alias("n")).collect()) < 40
    got = documents.renamed(docs, "document", ["rows"], keys).select(F.col("rows.a_key").alias("k")).collect()
    assert all(r.k == [str(-k) if k < 1500 else str(k) for k in range(1, 2001)] for r in got)


def test_a_job_that_a_late_event_ends_waits_for_the_watermark(spark, tmp_path):
    """The last event of all comes more than six hours after the run before it, but the watermark is an hour behind it."""
    con, start = duckdb.connect(), "timestamp '2024-01-01 00:00:00'"
    rows = [(1, 1, "view", 0), (2, 1, "view", 390), (3, 2, "error", 20), (4, 2, "purchase", 30), (5, 3, "view", 5), (6, 4, "error", 1)]
    values = ", ".join(f"({e}, {u}, '{kind}', {start} + interval {minutes} minute, 1.0)" for e, u, kind, minutes in rows)
    con.sql(f"copy (select cast(e as bigint) as event_id, cast(u as bigint) as user_id, k as event_type, t as ts, cast(v as double) as value from (values {values}) x(e, u, k, t, v)) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    assert oracle.differences(registry.queries()["stream_queue_runs"](spark, str(tmp_path)), con, registry.oracle_sql()["stream_queue_runs"]) == ""


def test_badges_without_a_swimmer_are_merged_like_others(spark, tmp_path):
    """Those of orders without a customer are two badges once a swimmer's have joined teams 6 and 11."""
    con, day = duckdb.connect(), datetime.datetime(2000, 5, 1)
    orders = [(1, None, day), (2, 5, day), (3, 7, day), (4, 8, None)]
    teams = [(1, 1), (1, 6), (1, 11), (2, 6), (2, 11), (3, 2), (3, 6), (3, 7), (4, 3), (4, 8)]
    lines = [(order, 2, team, k, 1000.0, "A", "O") for k, (order, team) in enumerate(teams)]
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string"
    tables = {"lineitem": (lines, line), "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"), "part": ([(2, "LARGE")], "p_partkey long, p_type string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = registry.queries()["season_fix"](spark, str(tmp_path))
    assert oracle.differences(found, con, registry.oracle_sql()["season_fix"]) == ""
    assert {(r.swimmer_id, r.team_id, r.survivor) for r in found.collect()} == {(None, 6, 1), (None, 11, 1), (5, 11, 6)}
