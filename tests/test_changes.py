"""Commits, merges and purges on small tables."""

import pytest
from pyspark.sql import functions as F

from podium.operators import commit, merge, purge
from podium.operators.commit import Check, Entity
from podium.operators.purge import ForeignKey
from podium.sources.shared import Conflict, Steps, Versions

ENTITIES = [
    Entity("meeting", columns=("name",), required=("name",)),
    Entity("session", {"meeting_id": "meeting"}, ("day",), required=("meeting_id",)),
    Entity("team", columns=("name",), required=("name",)),
    Entity("affiliation", {"team_id": "team"}, ("season",), ("team_id", "season"), required=("team_id",), agrees=True),
    Entity("result", {"session_id": "session", "team_id": "team"}, ("time", "late"), ("session_id", "team_id"), required=("session_id", "team_id"), checks=(Check("affiliation", {"team_id": "team_id"}, "team without affiliation"),)),
]
STAGED = {
    "meeting": "key string, id long, name string",
    "session": "key string, id long, meeting_id long, meeting_id_key string, day string",
    "team": "key string, id long, name string",
    "affiliation": "key string, id long, team_id long, team_id_key string, season int",
    "result": "key string, id long, session_id long, session_id_key string, team_id long, team_id_key string, time int, late boolean",
}
STORED = {
    "meeting": "key string, id long, name string",
    "session": "key string, id long, meeting_id long, day string",
    "team": "key string, id long, name string",
    "affiliation": "key string, id long, team_id long, season int",
    "result": "key string, id long, session_id long, team_id long, time int, late boolean",
}


@pytest.fixture
def store(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "store"))
    rows = {"meeting": [("m1", 4, "old")], "session": [], "team": [("red", 7, "red"), ("blue", 9, "blue")], "affiliation": [(None, 3, 7, 2000)], "result": [(None, 50, 1, 7, 100, False)]}
    versions.publish({k: spark.createDataFrame(v, STORED[k]) for k, v in rows.items()})
    return versions


def staged(spark, **more):
    rows = {
        "meeting": [("m1", 4, "new"), ("m2", None, "second")],
        "session": [("s1", None, None, "m1", "mon"), ("s2", None, None, "m2", "tue")],
        "team": [("red", 7, "red"), ("green", None, "green"), ("azure", None, "azure")],
        "affiliation": [("red", 3, None, "red", 2000), ("green", None, None, "green", 2000), ("azure", None, None, "azure", 2000)],
        "result": [("r1", None, None, "s1", None, "red", 0, False), ("r2", None, None, "s2", None, "green", 200, True), ("r3", None, None, "s2", None, "green", 300, True), ("r4", None, None, "s2", None, "azure", None, None)],
    } | more
    return {k: spark.createDataFrame(v, STAGED[k]) for k, v in rows.items()}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_commit_fills_five_levels(spark, store):
    version, plan = commit.commit(ENTITIES, staged(spark), store)
    assert version == 2
    read = {k: {r.id: r for r in store.read(k).collect()} for k in STORED}
    assert (read["meeting"][4].name, read["meeting"][5].name) == ("new", "second")
    assert {(r.id, r.meeting_id) for r in read["session"].values()} == {(1, 4), (2, 5)}
    # new ids are dense, in the order of keys
    assert (read["team"][10].name, read["team"][11].name) == ("azure", "green")
    assert {(r.id, r.team_id) for r in read["affiliation"].values()} == {(3, 7), (4, 10), (5, 11)}
    # r1 is the stored one of its natural key; zero isn't blank, false is; r2 and r3 are one row
    assert (read["result"][50].time, read["result"][50].session_id) == (0, 1)
    assert sorted((r.id, r.session_id, r.team_id, r.time, r.late) for r in read["result"].values() if r.id != 50) == [(51, 2, 11, 200, True), (52, 2, 10, None, None)]
    assert {r.entity: (r.staged, r.inserts, r.updates, r.faults) for r in store.read("commit_log").collect()} == {
        "meeting": (2, 1, 1, 0), "session": (2, 2, 0, 0), "team": (3, 2, 0, 0), "affiliation": (3, 2, 0, 0), "result": (4, 2, 1, 0),
    }
    counted = {r.entity: r["count"] for r in plan.changes.groupBy("entity").count().collect()}
    assert counted == {"meeting": 2, "session": 2, "team": 2, "affiliation": 2, "result": 3}
    # what is stored already changes nothing
    same = {"meeting": [("m1", 4, "new")], "session": [("s1", 1, None, "m1", "mon")], "team": [("red", 7, "red")], "affiliation": [("red", None, None, "red", 2000)], "result": [("r1", None, None, "s1", None, "red", 0, False)]}
    again, plan = commit.commit(ENTITIES, staged(spark, **same), store)
    assert [row[2:] for row in plan.log] == [(0, 0, 0)] * 5
    assert rows_of(store.read("result", 1)) == [(None, 50, 1, 7, 100, False)]


FAULTY = [
    ("result", ("r5", None, None, "nowhere", None, "red", 1, True), "session_id not found: nowhere"),
    ("result", ("r6", 777, None, "s1", None, "red", 1, True), "id 777 is not stored"),
    ("result", ("r7", None, None, "s1", None, "blue", 1, True), "team without affiliation"),
    ("result", ("r8", None, None, None, None, "red", 1, True), "session_id is missing"),
    ("affiliation", ("red too", 3, None, "red", 1999), "id 3 has other links"),
    ("meeting", ("m9", None, "  "), "name is missing"),
    ("meeting", (None, None, "x"), "no key"),
]


def test_faults_leave_nothing(spark, store):
    rows = staged(spark)
    for name, row, _ in FAULTY:
        rows[name] = rows[name].unionByName(spark.createDataFrame([row], STAGED[name]))
    before = {k: rows_of(store.read(k)) for k in STORED}
    with pytest.raises(commit.Refused, match="7 faults") as refused:
        commit.commit(ENTITIES, rows, store)
    assert {tuple(r) for r in refused.value.faults.collect()} == {(name, row[0], reason) for name, row, reason in FAULTY}
    assert store.version() == 1
    assert {k: rows_of(store.read(k)) for k in STORED} == before


def test_a_fault_in_the_last_table_leaves_nothing(spark, store):
    rows = staged(spark, result=[("r1", None, None, "s1", None, "red", 0, False), FAULTY[2][1]])
    with pytest.raises(commit.Refused, match="result r7: team without affiliation"):
        commit.commit(ENTITIES, rows, store)
    assert (store.version(), store.read("meeting").first().name) == (1, "old")


def test_a_slower_writer_is_refused(spark, store):
    base = store.version()
    store.publish({"team": store.read("team")}, base)
    with pytest.raises(Conflict):
        store.publish({"team": store.read("team").limit(0)}, base)
    assert store.read("team").count() == 2


def test_nothing_staged(spark, store):
    nothing = {k: spark.createDataFrame([], v) for k, v in STAGED.items()}
    version, plan = commit.commit(ENTITIES, nothing, store)
    assert (version, plan.changes.count(), plan.faults.count()) == (2, 0, 0)


def test_missing_rows(spark):
    have = spark.createDataFrame([("a", 1, "x")], "key string, id long, extra string")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    assert rows_of(commit.missing_rows(have, wanted, ["key"])) == [("a", 1, "x"), ("b", None, None)]


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([], {}),
        ([(1, 2)], {1: 2}),
        ([(3, 2), (2, 1), (1, 0)], {3: 0, 2: 0, 1: 0}),
        ([(k, k - 1) for k in range(1, 40)], dict.fromkeys(range(1, 40), 0)),
        ([(5, 5), (6, 5), (6, 5), (None, 1), (1, None)], {6: 5}),
    ],
)
def test_chains_end_at_their_roots(spark, pairs, want):
    got = merge.closure(spark.createDataFrame(pairs, "source long, target long"), Steps(spark, "t"))
    assert {r.source: r.root for r in got.collect()} == want


@pytest.mark.parametrize("circle", [[(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (9, 1)], [(7, 8), (8, 9), (9, 10), (10, 8), (1, 0)]])
def test_circles_are_refused(spark, circle):
    with pytest.raises(merge.Circle):
        merge.closure(spark.createDataFrame(circle, "source long, target long"), Steps(spark, "t"))


def test_two_targets_are_refused(spark):
    with pytest.raises(ValueError, match="more than one target"):
        merge.closure(spark.createDataFrame([(1, 2), (1, 3)], "source long, target long"), Steps(spark, "t"))


def merge_tables(spark, conflict=False):
    pairs = spark.createDataFrame([(3, 2), (2, 1), (12, 11)], "source long, target long")
    badges = spark.createDataFrame([(100, 1, 2000, 5), (99, 2, 2000, 5), (101, 3, 2000, 6), (110, 12, 2000, 5), (120, 50, 2000, 5)], "id long, swimmer_id long, season int, team_id long")
    results = [(1, 1, 5, 100, "a", 60), (2, 2, 5, 99, "a", 60), (3, 3, 6, 101, "b", 70), (4, 12, 5, 110, "c", 80), (5, 50, 5, 120, "a", 60)] + ([(6, 11, 5, 111, "c", 81)] if conflict else [])
    laps = spark.createDataFrame([(k * 10, k, s) for k, s, *_ in results], "id long, result_id long, swimmer_id long")
    legs = spark.createDataFrame([(1, 1, 100, "r1"), (2, 3, 101, "r1"), (3, 12, 110, "r2"), (4, 50, 120, "r2")], "id long, swimmer_id long, badge_id long, relay_id string")
    return pairs, badges, spark.createDataFrame(results, "id long, swimmer_id long, team_id long, badge_id long, program string, hundredths long"), laps, legs, ["program"]


def test_a_merge_moves_all_children(spark):
    made = merge.merge_swimmers(*merge_tables(spark), Steps(spark, "t"))
    assert made.conflicts.count() == 0
    got = {(r.table, r.operation, r.id): (r.swimmer_id, r.badge_id) for r in made.changes.collect()}
    assert got == {
        ("laps", "DELETE", 20): (None, None), ("laps", "UPDATE", 30): (1, None), ("laps", "UPDATE", 40): (11, None),
        ("results", "DELETE", 2): (None, None), ("results", "UPDATE", 3): (1, 101), ("results", "UPDATE", 4): (11, 110),
        ("relay_swimmers", "DELETE", 2): (None, None), ("relay_swimmers", "UPDATE", 3): (11, 110),
        ("badges", "DELETE", 99): (None, None), ("badges", "UPDATE", 101): (1, None), ("badges", "UPDATE", 110): (11, None),
        ("swimmers", "DELETE", 3): (None, None), ("swimmers", "DELETE", 2): (None, None), ("swimmers", "DELETE", 12): (None, None),
    }


def test_a_conflict_keeps_its_root_out(spark):
    made = merge.merge_swimmers(*merge_tables(spark, conflict=True), Steps(spark, "t"))
    assert rows_of(made.conflicts) == [(11, "c", 2)]
    assert {r.source for r in made.roots.collect()} == {2, 3}
    assert not [r for r in made.changes.collect() if r.swimmer_id == 11 or r.id in (12, 110)]
    forced = merge.merge_swimmers(*merge_tables(spark, conflict=True), Steps(spark, "t"), force=True)
    assert {r.source for r in forced.roots.collect()} == {2, 3, 12}


KEYS = [ForeignKey("event", "meeting_id", "meeting"), ForeignKey("result", "event_id", "event"), ForeignKey("lap", "result_id", "result"), ForeignKey("record", "result_id", "result"), ForeignKey("record", "meeting_id", "meeting")]


def purge_tables(spark):
    return {
        "meeting": spark.createDataFrame([(1,), (2,), (3,)], "id long"),
        "event": spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "id long, meeting_id long"),
        "result": spark.createDataFrame([(100, 10), (101, 11), (200, 20), (999, None)], "id long, event_id long"),
        "lap": spark.createDataFrame([(1000, 100), (2000, 200)], "id long, result_id long"),
        "record": spark.createDataFrame([(7, 100, None), (8, 200, 1), (9, 200, 2), (6, 101, 1)], "id long, result_id long, meeting_id long"),
    }


def test_a_purge_leaves_no_orphan(spark):
    tables = purge_tables(spark)
    gone = purge.doomed(tables, KEYS, "meeting", spark.createDataFrame([(1,), (1,), (77,)], "id long"), Steps(spark, "t"))
    deleted = purge.deletes(gone)
    assert [(r.step, r.table, r.id) for r in deleted.orderBy("step", "id").collect()] == [(1, "record", 6), (1, "record", 7), (1, "record", 8), (2, "lap", 1000), (3, "result", 100), (3, "result", 101), (4, "event", 10), (4, "event", 11), (5, "meeting", 1)]
    assert purge.orphans(tables, KEYS, deleted).count() == 0
    assert purge.orphans(tables, KEYS, deleted.where("table <> 'lap'")).count() == 1
    kept = purge.deletes(gone, {"meeting", "event"})
    assert {r.table for r in kept.collect()} == {"record", "lap", "result"}


def test_foreign_keys_in_a_circle(spark):
    with pytest.raises(ValueError, match="circle"):
        purge.below([*KEYS, ForeignKey("event", "lap_id", "lap")], "meeting")


def test_the_meeting_purge_has_the_steps_of_its_graph():
    from podium.plans import merges

    order = [n for n in reversed(purge.below(merges.KEYS, "meetings"))]
    assert order == list(reversed(merges.PURGED))
    assert len(order) == 16
    assert len([n for n in order if n not in merges.SPARED]) == 8
    at = {n: k for k, n in enumerate(order)}
    assert all(at[k.child] < at[k.parent] for k in merges.KEYS)


def test_numbers_are_dense(spark):
    from podium.operators.ranking import numbered

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(8)
    got = {r.v: r.n for r in numbered(df, ["v"], "n", start=10).collect()}
    assert got == {v: v + 11 for v in range(1000)}


def test_trees_are_merged_level_by_level(spark):
    branches = [merge.Branch("session", "meeting_id", ("day",)), merge.Branch("event", "session_id", ("kind",)), merge.Branch("result", "event_id", ("swimmer",), ("time",))]
    tables = {
        "session": spark.createDataFrame([(10, 1, "mon"), (20, 2, "mon"), (21, 2, "tue"), (30, 3, "mon")], "id long, meeting_id long, day string"),
        "event": spark.createDataFrame([(100, 10, "a"), (200, 20, "a"), (201, 20, "b"), (202, 21, "a"), (300, 30, "a")], "id long, session_id long, kind string"),
        "result": spark.createDataFrame([(1, 100, "x", 50), (2, 200, "x", 51), (3, 200, "y", 60), (4, 201, "x", 70), (5, 202, "x", 80), (6, 300, "x", 0), (7, 300, "z", 9)], "id long, event_id long, swimmer string, time long"),
    }
    roots = merge.closure(spark.createDataFrame([(3, 2), (2, 1)], "source long, target long"), Steps(spark, "t"))
    got = {tuple(r)[1:] for r in merge.merge_trees(roots, branches, tables, Steps(spark, "t")).collect()}
    assert got == {
        ("session", "DELETE", 20, None, None), ("session", "DELETE", 30, None, None), ("session", "UPDATE", 21, "meeting_id", 1),
        ("event", "DELETE", 200, None, None), ("event", "DELETE", 300, None, None), ("event", "UPDATE", 201, "session_id", 10),
        ("result", "DELETE", 2, None, None), ("result", "DELETE", 6, None, None), ("result", "UPDATE", 3, "event_id", 100), ("result", "UPDATE", 7, "event_id", 100), ("result", "UPDATE", 1, "time", 51),
    }
