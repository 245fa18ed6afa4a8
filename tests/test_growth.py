"""What queries leave out as tables grow: work done twice, tables written for nothing, rows that can't meet."""

import pytest
from pyspark.sql import functions as F

from podium.functions import nested
from podium.operators import commit as cm
from podium.operators import season
from podium.operators.commit import Entity
from podium.plans import domain as d
from podium.plans import changes, merges, registry, sections
from podium.sources.shared import Steps
from tests import oracle

SF = oracle.folder("sf0.001")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def names(steps):
    return [path.rsplit("/", 1)[1].split("-", 1)[1] for _, path in steps.kept]


def test_form_pairs_are_read_once(spark):
    df = spark.createDataFrame([("pool[2][name]=a&pool[name]=b&pool[1][x]=c",)], "form string").select(nested.form_params(F.col("form"), "pool", ["name", "address"]).alias("x"))
    assert optimized(df).count("regexp_extract(") <= 4
    assert [tuple(r) for r in df.first().x] == [(1, "b", None), (2, "a", None)]


def test_results_and_laps_are_counted_before_they_meet(spark):
    assert "Join Inner" in (plan := optimized(registry.queries()["eager_children"](spark, SF))) and "Generate" not in plan


def test_relays_are_sorted_once(spark):
    assert optimized(registry.queries()["mixed_relay_genders"](spark, SF)).count("Window [") == 1


def test_rows_are_dealt_to_more_partitions_as_tables_grow(spark):
    n = d.table(spark, SF, "lineitem").count()
    assert d.dealt(d.results(spark, SF), spark, SF, "mir_id", 100).rdd.getNumPartitions() == -(-n // 100)


def test_laps_of_given_results_only(spark):
    ids = d.results(spark, SF).where("meeting_id = 199804").select("mir_id").distinct()
    own = d.laps(spark, SF, ids)
    wanted = d.laps(spark, SF).join(ids, "mir_id", "left_semi")
    assert own.count() == wanted.count() > 0 and own.exceptAll(wanted).isEmpty()


@pytest.mark.parametrize("build", [merges.tree_merge, merges.purge_tables])
def test_placed_results_are_not_written_again(spark, build):
    steps = Steps(spark, "test")
    build(spark, SF, steps)
    assert "placed" not in names(steps) and {"event-ids", "program-ids"} <= set(names(steps))


def test_swimmer_merges_write_only_rows_of_their_swimmers(spark):
    steps = Steps(spark, "test")
    merges.merged(spark, SF, steps)
    assert not {"own_laps", "own_legs", "own_results"} & set(names(steps))
    ids = steps.kept[names(steps).index("results-of-pairs")][0].select(F.col("swimmer_id") % 16).distinct().collect()
    assert {r[0] for r in ids} <= {0, 1, 2, 3}


def test_report_lines_are_made_in_one_pass(spark):
    steps = Steps(spark, "test")
    sections.report_rows(spark, SF, steps)
    assert "lines" not in names(steps)
    lines = sections.report_lines(merges.run(spark, sections.TIMED, {"results": d.results(spark, SF)}))
    views = {"results": d.results(spark, SF)}
    views["timed"] = merges.run(spark, sections.TIMED, views)
    views["report"] = merges.run(spark, sections.REPORT, views)
    told = merges.run(spark, sections.PAGED, views)
    assert lines.count() == told.count() and lines.exceptAll(told).isEmpty()
    assert optimized(lines).count("l_orderkey") < optimized(told).count("l_orderkey")


def test_stored_keys_are_looked_up_only_where_nothing_is_staged(spark):
    parent, child = Entity("parent", columns=("name",)), Entity("child", {"parent_id": "parent"}, ("n",), ("parent_id", "n"))
    stored = {
        "parent": spark.range(1, 101).select(F.concat(F.lit("p"), F.col("id")).alias("key"), "id", F.lit("x").alias("name")),
        "child": spark.range(1, 101).select("id", F.col("id").alias("parent_id"), F.lit(1).alias("n")),
    }
    staged = {
        "parent": spark.createDataFrame([("new", None, "y")], "key string, id long, name string"),
        "child": spark.createDataFrame([("a", None, None, "new", 1), ("b", None, None, "p7", 1), ("c", None, None, "p7", 2), ("d", None, None, "?", 1)], "key string, id long, parent_id long, parent_id_key string, n int"),
    }
    steps = Steps(spark, "test")
    plan = cm.plan([parent, child], staged, stored, steps)
    assert steps.kept[names(steps).index("parent-keys")][0].count() == 1
    assert {(r.operation, r.id, r.columns.get("parent_id")) for r in plan.tables["child"].collect()} == {("INSERT", 101, "101"), ("INSERT", 102, "7"), ("INSERT", 103, None)}
    assert [(r.key, r.reason) for r in plan.faults.collect()] == [("d", "parent_id not found: ?")]


def test_a_seasons_badges_are_dealt_as_tables_grow_and_few_are_looked_at_again(spark, monkeypatch):
    steps = Steps(spark, "test")
    monkeypatch.setattr(changes, "Steps", lambda *_: steps)
    monkeypatch.setattr(d, "partitions", lambda *_: 19, raising=False)
    found = registry.queries()["season_fix"](spark, SF)
    first, files = steps.kept[0][0], len(steps.kept[0][0].inputFiles())
    assert files == 19 and found.rdd.getNumPartitions() == 19
    assert 0 < steps.kept[names(steps).index("open")][0].count() < first.count() / 5


def test_badges_meet_teams_in_partitions_that_tasks_write_straight(spark):
    badges = spark.createDataFrame([(2000, 1, 1, 2), (2000, 1, 6, 1), (2000, 2, 6, 1)], "season int, swimmer_id long, team_id long, n long")
    teams = spark.createDataFrame([(2000, 1, 1), (2000, 6, 1)], "season int, team_id long, root long")
    merges = season.badge_merges(badges, teams, 300)
    assert [optimized(merges).count(f"], {n}\n") for n in (200, 300)] == [2, 1]
    assert [tuple(r) for r in merges.collect()] == [(2000, 1, 6, 1)]
