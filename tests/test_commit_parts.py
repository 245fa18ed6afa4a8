"""A commit reads narrow tables, and makes only what its caller reads."""

import pytest
from pyspark.sql import functions as F

from podium.operators import commit as cm
from podium.operators.commit import Entity
from podium.plans import commits
from podium.sources.shared import Steps
from tests import oracle

SF = oracle.folder("sf0.001")


def names(steps):
    return [path.rsplit("/", 1)[1].split("-", 1)[1] for _, path in steps.kept]


def small(spark):
    stored = {"parent": spark.createDataFrame([("p", 1, "x")], "key string, id long, name string"), "child": spark.createDataFrame([], "id long, parent_id long, n int")}
    staged = {
        "parent": spark.createDataFrame([("p", 1, "y")], "key string, id long, name string"),
        "child": spark.createDataFrame([("a", None, None, "p", 1), ("b", None, None, "?", 1)], "key string, id long, parent_id long, parent_id_key string, n int"),
    }
    return [Entity("parent", columns=("name",)), Entity("child", {"parent_id": "parent"}, ("n",))], staged, stored


def test_only_faults_or_only_changes_are_made(spark):
    steps = Steps(spark, "test")
    found = cm.plan(*small(spark), steps, faults_only=True)
    assert [(r.key, r.reason) for r in found.faults.collect()] == [("b", "parent_id not found: ?")]
    assert not {"parent-changes", "child-changes", "child-rows"} & set(names(steps)) and "parent-keys" in names(steps)
    steps = Steps(spark, "test")
    found = cm.plan(*small(spark), steps, changes_only=True)
    assert {(r.entity, r.operation, r.id) for r in found.changes.collect()} == {("parent", "UPDATE", 1), ("child", "INSERT", 1), ("child", "INSERT", 2)}
    assert "faults" not in names(steps)
    with pytest.raises(ValueError):
        found.refuse()


def test_seasons_are_staged_from_narrow_tables(spark):
    steps = Steps(spark, "test")
    staged, stored = commits.tables(spark, SF, steps)
    numbers = steps.kept[names(steps).index("numbers")][0]
    assert not [f.name for f in numbers.schema if f.name.endswith("_key")]
    files = [f for f in staged["individual_result"].inputFiles() if "numbers" in f]
    assert files and stored["meeting"].where(F.col("id").isNull()).isEmpty()
    scans = staged["individual_result"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_last" in scans
