"""A season's badges checked and merged until nothing is left to merge, each round only where the last one has changed something.

A swimmer with two badges of teams of one club in a season, of which one has a single result at most, has been registered under two names of one team: the teams are one in
that season, and so are all badges of both. Teams that become one leave other swimmers with two badges where they had three, so the check is repeated. It is semi-naive: a round looks only at
swimmers with a badge of a team that the round before has joined, and the work falls with the changes. Teams keep their club, and results of a team only grow, so after the first
look only swimmers whose badges of a season are all of one club, with a single result at most in one of them, can ever be sure; the badges of all others are not moved again before the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.components import connected_components
from podium.sources.shared import STRAIGHT, Steps

#: The badges of a team are dealt to so many tasks.
SHARES = 8


def by_swimmer(badges: DataFrame) -> DataFrame:
    """(season, swimmer_id, badges): those of badges (season, swimmer_id, team_id, n) of a swimmer and season in one row; no shuffle if badges are dealt by both. Badges without season or team are of no team."""
    whole = badges.where("season is not null and team_id is not null")
    return whole.groupBy("season", "swimmer_id").agg(F.collect_list(F.struct("team_id", "n")).alias("badges"))


def badges_of(own: DataFrame) -> DataFrame:
    """by_swimmer's rows as badges."""
    return own.select("season", "swimmer_id", F.inline("badges"))


def renamed_teams(own: DataFrame, club: int, steps: Steps, most: int = 100) -> tuple[DataFrame, list[int]]:
    """(season, team_id, root) of the teams that are one with others, of by_swimmer's stored rows: the least of them; and how many groups each round has checked."""
    clubs = F.transform("badges", lambda b: b.team_id % club)
    can = (F.size("badges") > 1) & (F.array_min("badges.n") <= 1) & (F.array_min(clubs) == F.array_max(clubs))
    badges = steps.keep(badges_of(own.where(can)), "open")
    alias = steps.keep(badges.select("season", "team_id").distinct().withColumn("root", F.col("team_id")), "teams")
    looked, checked = badges, []
    for _ in range(most):
        # badges of the touched swimmers, under the names their teams have now
        groups = looked.join(alias, ["season", "team_id"]).groupBy("season", "swimmer_id", "root").agg(F.sum("n").alias("n"))
        of = groups.groupBy("season", "swimmer_id").agg(F.count("*").alias("roots"), F.min("n").alias("least"), F.min("root").alias("a"), F.max("root").alias("b"))
        of = steps.keep(of, "checked")
        checked.append(of.count() if checked else own.count())
        sure = of.where((F.col("roots") == 2) & (F.col("least") <= 1) & (F.col("a") % club == F.col("b") % club)).select("season", "a", "b").distinct()
        at = lambda c: F.struct("season", F.col(c).alias("root"))
        edges = steps.keep(sure.select(at("a").alias("src"), at("b").alias("dst")), "joined")
        if edges.isEmpty():
            moved = alias.where("team_id <> root")
            return steps.keep(moved.unionByName(moved.select("season", F.col("root").alias("team_id"), "root").distinct()), "named"), checked
        new = connected_components(edges, steps.keep, drop=steps.drop).where("node <> component").select("node.season", "node.root", F.col("component.root").alias("next"))
        new = steps.keep(new, "renamed")
        alias = steps.keep(alias.join(new, ["season", "root"], "left").select("season", "team_id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "teams")
        # a root that others have joined has changed too
        changed = alias.join(new.select("season", F.col("next").alias("root")).distinct(), ["season", "root"], "left_semi").select("season", "team_id")
        alias = alias.drop("moved")
        touched = steps.keep(badges.join(changed, ["season", "team_id"], "left_semi").select("season", "swimmer_id").distinct(), "touched")
        # null-safe: results without a swimmer are a group like others
        looked = badges.join(touched, (badges.season == touched.season) & badges.swimmer_id.eqNullSafe(touched.swimmer_id), "left_semi")
    raise RuntimeError(f"not stable after {most} rounds")


def joined_teams(badges: DataFrame, club: int, steps: Steps, most: int = 100) -> tuple[DataFrame, list[int]]:
    """(season, team_id, root) of badges (season, swimmer_id, team_id, n): the least of the teams that are one; and how many groups each round has checked."""
    own = steps.keep(by_swimmer(badges), "swimmers")
    named, checked = renamed_teams(own, club, steps, most)
    teams = badges_of(own).select("season", "team_id").distinct()
    return steps.keep(teams.join(named, ["season", "team_id"], "left").withColumn("root", F.coalesce("root", "team_id")), "all-teams"), checked


def badge_merges(badges: DataFrame, teams: DataFrame, partitions: int | None = None) -> DataFrame:
    """(season, swimmer_id, team_id, survivor): of a swimmer's badges of teams that are one, the one of most results stays (the least team of equal ones), the others go. Teams that stand
    alone may be left out. Badges meet each other in so many partitions (the session's by default), and teams in no more than STRAIGHT, as only the teams of a partition are held there."""
    partitions = partitions or int(badges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = min(partitions, STRAIGHT)
    key, order = ["season", "team_id", "share"], Window.partitionBy("season", "swimmer_id", "root").orderBy(F.col("n").desc(), "team_id")
    shared = badges.withColumn("share", F.pmod(F.hash("swimmer_id"), F.lit(SHARES))).repartition(met, *key)
    named = teams.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(met, *key).hint("shuffle_hash")
    rows = shared.join(named, key).repartition(partitions, "season", "swimmer_id").withColumn("survivor", F.first("team_id").over(order))
    return rows.where("team_id <> survivor").select("season", "swimmer_id", "team_id", "survivor")
