"""Typed and nested documents, and the season's check and merge, on small tables."""

import random

from pyspark.sql import functions as F

from podium.functions import nested
from podium.operators import documents, season
from podium.sources.shared import Steps


def fields_of(spark, kind, body):
    df = spark.createDataFrame([(kind, body)], "kind string, body string")
    return [tuple(x) for x in df.select(nested.request_fields(F.col("kind"), F.col("body")).alias("x")).first().x]


def test_requests_are_read_by_their_type(spark):
    assert fields_of(spark, "0", '{"team_id": "12", "season_id": 7, "more": {"a": [1]}}') == [("team_id", "12", None), ("season_id", "7", None)]
    assert fields_of(spark, "0", '{"team_id": "x", "season_id": null}') == [("team_id", None, "not bigint"), ("season_id", None, "missing")]
    assert fields_of(spark, "5", "{}") == [("reason", None, None)]
    assert fields_of(spark, "4", "{}") == []
    assert fields_of(spark, "zz", "{}") == [("*", None, "unknown type")]
    assert fields_of(spark, None, "{}") == [("*", None, "unknown type")]
    for broken in ('{"a', "[1]", '"text"', "", None):
        assert fields_of(spark, "0", broken) == [("*", None, "no JSON object")]
    assert {name: len(fields_of(spark, name, "{}")) for name in nested.REQUEST_FIELDS} == {k: len(v) for k, v in nested.REQUEST_FIELDS.items()}


def sessions_of(spark, form):
    df = spark.createDataFrame([(form,)], "form string")
    return [tuple(x) for x in df.select(nested.form_params(F.col("form"), "pool", ["id", "name"]).alias("x")).first().x]


def test_form_parameters(spark):
    assert sessions_of(spark, "pool[10][id]=3&pool[2][id]=4&pool[0][name]=a+b%21&pool[name]=all") == [(0, None, "a b!"), (2, "4", "all"), (10, "3", "all")]
    # the last of repeated ones; other roots, names and forms are left out
    assert sessions_of(spark, "pool[1][id]=1&pool[1][id]=2&city[1][id]=9&pool[1][secret]=x&pool[[id]=7&pool=5&pool[1][id][x]=6&&=") == [(1, "2", None)]
    assert sessions_of(spark, "pool[name]=only") == []
    assert sessions_of(spark, "") == sessions_of(spark, None) == []


DOCS = "id long, rows array<struct<swimmer_key string, n int, laps array<struct<swimmer_key string, other string>>>>, head struct<team_key string, name string>"


def test_keys_are_renamed_at_any_depth(spark):
    rows = [
        (1, [("b", 1, [("a", "a"), ("b", "b")]), ("a", 2, []), (None, 3, None)], ("t", "t")),
        (2, [], None),
        (3, None, ("zz", "zz")),
    ]
    df = spark.createDataFrame(rows, DOCS)
    keys = spark.createDataFrame([("a", "A"), ("b", "B"), ("t", "T"), ("unused", "U")], "old string, new string")
    got = {r.id: r for r in documents.renamed(df, "id", ["rows", "head"], keys).collect()}
    assert [(x.swimmer_key, x.n, x.laps and [tuple(y) for y in x.laps]) for x in got[1].rows] == [("B", 1, [("A", "a"), ("B", "b")]), ("A", 2, []), (None, 3, None)]
    assert tuple(got[1].head) == ("T", "t")
    assert (got[2].rows, got[2].head, got[3].rows, tuple(got[3].head)) == ([], None, None, ("zz", "zz"))
    assert documents.renamed(df.limit(0), "id", ["rows"], keys).count() == 0
    assert documents.renamed(df, "id", ["rows", "head"], keys.limit(0)).collect() == df.collect()


def test_rows_are_synced_by_id(spark):
    df = spark.createDataFrame([(1, [(5, "x"), (6, "y"), (None, "z")]), (2, [])], "doc long, swimmers array<struct<swimmer_id long, name string>>")
    stored = spark.createDataFrame([(5, "five")], "id long, name string")
    got = {r.doc: r for r in documents.synced(df, "doc", "swimmers", "swimmer_id", stored, ["name"]).collect()}
    assert [tuple(x) for x in got[1].swimmers] == [(5, "five"), (None, "y"), (None, "z")]
    assert [(r.found, r.unknown) for r in (got[1], got[2])] == [(1, 1), (0, 0)]


def plain_roots(badges, club):
    """All groups checked in every round."""
    root = {(s, t): t for s, _, t, _ in badges}
    while True:
        groups = {}
        for s, w, t, n in badges:
            at = groups.setdefault((s, w), {})
            at[root[s, t]] = at.get(root[s, t], 0) + n
        edges = [(s, *sorted(at)) for (s, _), at in groups.items() if len(at) == 2 and min(at.values()) <= 1 and len({x % club for x in at}) == 1]
        if not edges:
            return root
        for s, a, b in edges:
            a, b = (min(x for x in root.values() if x == y) if y in root.values() else y for y in (a, b))
            ra, rb = a, b
            for key, value in list(root.items()):
                if key[0] == s and value in (ra, rb):
                    root[key] = min(ra, rb)
            edges[:] = [(x, min(ra, rb) if x == s and p in (ra, rb) else p, min(ra, rb) if x == s and q in (ra, rb) else q) for x, p, q in edges]


def test_check_and_merge_come_to_an_end(spark):
    r = random.Random(2)
    badges = sorted({(2000 + k % 2, w, r.randrange(12)): r.choice([1, 1, 3]) for k in range(2) for w in range(60) for _ in range(r.choice([1, 2, 2, 3]))}.items())
    badges = [(s, w, t, n) for (s, w, t), n in badges]
    df = spark.createDataFrame(badges, "season int, swimmer_id long, team_id long, n long")
    teams, checked = season.joined_teams(df, 3, Steps(spark, "t"))
    got = {(x.season, x.team_id): x.root for x in teams.collect()}
    assert got == plain_roots(badges, 3)
    assert len(checked) > 1
    left = season.badge_merges(df, teams).collect()
    assert all(got[x.season, x.team_id] == got[x.season, x.survivor] for x in left)
    assert season.joined_teams(df.limit(0), 3, Steps(spark, "t"))[0].count() == 0


def test_a_round_checks_what_the_last_one_has_changed(spark):
    """Each swimmer of a chain is decided by the one before; all others are checked once."""
    chain = [(0, 3), (0, 3, 6), (3, 6, 9), (6, 9, 12)]
    badges = [(2000, w, t, 1) for w, own in enumerate(chain) for t in own] + [(2000, 100 + w, t, 2) for w in range(50) for t in (100 + w, 201 + w)]
    df = spark.createDataFrame(badges, "season int, swimmer_id long, team_id long, n long")
    teams, checked = season.joined_teams(df, 3, Steps(spark, "t"))
    assert {x.team_id: x.root for x in teams.collect() if x.team_id <= 12} == dict.fromkeys((0, 3, 6, 9, 12), 0)
    assert checked == [54, 3, 4, 4, 4]
