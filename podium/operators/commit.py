"""Commits of staged documents into many tables, in the order of their foreign keys, all or nothing.

Each entity's staged rows carry their own key, the keys of what they refer to, and ids where an earlier step has found them. A level of the
commit takes one entity:

1.  Links are filled: an id that is there stays; else the key is looked up among the rows of the level above, with the ids that these have just got,
    and among the stored rows.
2.  The stored row is found: by the id, else by the natural key, where the entity has one.
3.  What can't be committed becomes a fault: an id that isn't stored, or whose stored row has another natural key; a link that leads nowhere; a
    column that has to be there; a check against another entity.
4.  Staged rows of one key, or of one natural key, are one row, that of the smallest key. New rows get the ids that follow the largest stored one, in the order of their
    keys, dense and in parallel: rows are numbered inside ranges of keys, and the ranges' counts are added up.
5.  Changes: of a new row all that isn't blank, of a stored one what isn't blank and differs.

The levels' key maps and changes are written tables, so a level joins its rows once with each of its parents, and nothing comes to the driver but counts, bounds and,
if the commit is refused, a few faults. What is stored is far more than what is staged, so little of it is moved: keys are looked up among the staged rows first, and among the stored ones only for
rows that have found nothing there; stored rows are looked for only between the least and the largest of the staged ids and natural keys, which are taken while the staged rows are written. Nothing is stored until all levels are through: then each changed table is written anew and one manifest is renamed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from podium.operators.changes import present
from podium.operators.ranking import numbered
from podium.sources.shared import Steps, Versions

CHANGES = "step int, entity string, operation string, id long, columns map<string,string>"


@dataclass(frozen=True)
class Check:
    """A row is refused if the committed rows of another entity have none with these columns: ours to theirs."""

    entity: str
    on: dict[str, str]
    reason: str


@dataclass(frozen=True)
class Entity:
    """How rows of one table are found, linked and written. Staged rows have key and id, for each link its id column and `<column>_key`, and the columns."""

    name: str
    links: dict[str, str] = field(default_factory=dict)  # id column: entity; in the order of the tables
    columns: tuple[str, ...] = ()
    natural: tuple[str, ...] = ()  # finds the stored row where the id doesn't; none: only an id does
    required: tuple[str, ...] = ()
    trusted: bool = False  # an id is taken as it is, and its row isn't touched
    agrees: bool = False  # the stored row of an id must have the staged row's natural key
    always: tuple[str, ...] = ()  # written with every update, even if nothing else differs
    partial: Callable[[Column], Column] | None = None  # a shorter key that also leads to the row, if it leads to one only
    checks: tuple[Check, ...] = ()

    @property
    def written(self) -> tuple[str, ...]:
        return (*self.links, *self.columns)


class Refused(RuntimeError):
    """Faults were found; nothing has been stored."""

    def __init__(self, faults: DataFrame, count: int):
        super().__init__(f"{count} faults: " + "; ".join(f"{r.entity} {r.key}: {r.reason}" for r in faults.orderBy("entity", "key", "reason").limit(5).collect()))
        self.faults, self.count = faults, count


def missing_rows(staged: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """staged, and a row for each of wanted (key and some of its columns) that it has none for; what wanted doesn't say is null."""
    new = wanted.join(staged.select(*on).distinct(), on, "left_anti").dropDuplicates(on)
    return staged.unionByName(new, allowMissingColumns=True)


def between(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """The rows that an equal value between these bounds can meet; none if there is no value."""
    return df.where(F.lit(False) if low is None or high is None else F.col(column).between(F.lit(low), F.lit(high)))


@dataclass
class Plan:
    """What a commit would do."""

    changes: DataFrame | None  # CHANGES, of all levels
    faults: DataFrame | None  # entity, key, reason
    log: list[tuple[str, int, int | None, int | None, int | None]]  # entity, staged rows, inserts, updates, faults
    tables: dict[str, DataFrame | None]  # the changes of each level
    steps: Steps

    def refuse(self) -> None:
        """Raises Refused if there are faults."""
        if self.faults is None:
            raise ValueError("this plan was made without its faults")
        count = sum(row[-1] for row in self.log)
        if count:
            raise Refused(self.faults, count)


def plan(entities: list[Entity], staged: dict[str, DataFrame], stored: dict[str, DataFrame], steps: Steps, changes_only: bool = False, faults_only: bool = False) -> Plan:
    """The changes of staged rows, level after level. stored tables have id, the written columns and, where links lead to them by key, key.

    What a caller doesn't read can be left out: the faults, so that the plan can't be refused, or the changes, with the rows that no later level asks for."""
    keys: dict[str, list[DataFrame]] = {}
    state: dict[str, DataFrame] = {}
    changes, faults, log = {}, [], []
    asked = {p for e in entities for p in (*e.links.values(), *(c.entity for c in e.checks))}
    for step, e in enumerate(entities, 1):
        level = Level(step, e, steps)
        level.run(staged[e.name], stored[e.name], keys, None if changes_only else state, not faults_only, not faults_only or e.name in asked)
        keys[e.name], state[e.name], changes[e.name] = level.keys, level.state, level.changes
        faults.append(level.faults)
        log.append(level.log)
    if changes_only:
        return Plan(reduce(DataFrame.unionByName, changes.values()), None, [(*row, None) for row in log], changes, steps)
    refused = steps.keep(reduce(DataFrame.unionByName, faults), "faults")
    of = {r.entity: r["count"] for r in refused.groupBy("entity").count().collect()}  # a row an entity
    return Plan(None if faults_only else reduce(DataFrame.unionByName, changes.values()), refused, [(*row, of.get(row[0], 0)) for row in log], changes, steps)


class Level:
    def __init__(self, step: int, entity: Entity, steps: Steps):
        self.step, self.entity, self.steps = step, entity, steps
        self.keys, self.state, self.changes, self.faults = [], None, None, None

    def run(self, staged: DataFrame, stored: DataFrame, keys: dict[str, list[DataFrame]], state: dict[str, DataFrame] | None, changes: bool = True, asked: bool = True) -> None:
        """Without state no faults are looked for, without changes none are made; rows are only made if there are changes or a later level has asked for them."""
        e, keep = self.entity, self.steps.keep
        linked, ends = self.linked(staged, keys)
        found, seen = self.observed(self.found(linked, stored, ends), "found", staged=F.count("*"), low=F.min("target"), high=F.max("target"))
        self.log = (e.name, seen["staged"], None, None)
        if state is not None:
            self.faults = self.refused(found, state)
        if not asked:
            return
        # rows of one group are one row; the smallest key stands for it
        group = F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("id"), *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in e.natural), F.lit(None).cast("string").alias("key"))).otherwise(F.struct(F.lit(None).cast("long").alias("id"), *self.group_key()))
        wanted = dict.fromkeys(("key", "target", *e.written, *e.natural))
        grouped = found.select(group.alias("group"), *wanted)
        first = grouped.groupBy("group").agg(F.min_by(F.struct(*(F.col(c) for c in grouped.columns if c != "group")), "key").alias("row")).select("group", "row.*")
        last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = numbered(first.where("target is null"), ["key"], "row_id", self.steps, last)
        rows = keep(first.where("target is not null").withColumn("row_id", F.col("target")).unionByName(fresh), f"{e.name}-rows")
        own = grouped.select("group", "key").join(rows.select("group", F.col("row_id").alias("id")), "group").select("key", "id")
        self.keys, self.state = self.all_keys(own, stored), self.committed(rows, stored)
        if not changes:
            return
        self.changes, counts = self.observed(self.changed(rows, stored, seen["low"], seen["high"]), "changes", inserts=F.count_if(F.col("operation") == "INSERT"), updates=F.count_if(F.col("operation") == "UPDATE"))
        self.log = (e.name, seen["staged"], counts["inserts"], counts["updates"])

    def linked(self, staged: DataFrame, keys: dict[str, list[DataFrame]]) -> tuple[DataFrame, dict[str, object]]:
        """staged with the ids of its links, as a written table, and the bounds of its ids and natural keys; `unlinked` lists the links that lead nowhere."""
        links = self.entity.links
        lost = lambda c: F.col(f"{c}_key").isNotNull() & F.col(c).isNull()
        ends = {"id_low": F.min(F.when(F.col("id") > 0, F.col("id"))), "id_high": F.max("id")}
        for k, c in enumerate(self.entity.natural):
            ends |= {f"low_{k}": F.min(c), f"high_{k}": F.max(c)}
        ends |= {f"lost_{k}": F.count_if(lost(c)) for k, c in enumerate(links)}
        rows = staged.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in links})
        for column, parent in links.items():
            rows = self.looked_up(rows, column, keys[parent][0])
        rows, seen = self.observed(rows, "linked", **ends)
        further = [c for k, c in enumerate(links) if seen[f"lost_{k}"] and len(keys[links[c]]) > 1]
        if further:
            for column in further:  # only rows that have found nothing meet the stored keys
                rows = rows.where(~lost(column)).unionByName(self.looked_up(rows.where(lost(column)), column, keys[links[column]][1]))
            rows, seen = self.observed(rows, "linked", **ends)
        nowhere = [F.when(lost(c), F.lit(c)) for c in links]
        return rows.withColumn("unlinked", F.filter(F.array(*nowhere), lambda x: x.isNotNull()) if nowhere else F.array().cast("array<string>")), seen

    def looked_up(self, rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
        of = keys.select(F.col("key").alias(f"{column}_key"), F.col("id").alias("__linked"))
        return rows.join(of, f"{column}_key", "left").withColumn(column, F.coalesce(column, "__linked")).drop("__linked")

    def found(self, rows: DataFrame, stored: DataFrame, ends: dict[str, object]) -> DataFrame:
        """rows with target, the id of the stored row, and what the id alone leads to."""
        e = self.entity
        by_id = between(stored, "id", ends["id_low"], ends["id_high"]).select(F.col("id").alias("__id"), F.struct(*(F.col(c) for c in e.natural)).alias("__natural") if e.natural else F.lit(None).cast("string").alias("__natural"))
        rows = rows.join(by_id, F.col("id") == F.col("__id"), "left")
        known = F.when(F.col("id") > 0, F.col("id") if e.trusted else F.col("__id"))
        if e.natural:
            near = stored
            for k, c in enumerate(e.natural):
                near = between(near, c, ends[f"low_{k}"], ends[f"high_{k}"])
            by_key = near.groupBy(*e.natural).agg(F.min("id").alias("__same"))
            rows = rows.join(by_key, list(e.natural), "left")
            differs = (F.col("id") > 0) & F.col("__id").isNotNull() & ~F.struct(*(F.col(c) for c in e.natural)).eqNullSafe(F.col("__natural")) if e.agrees else F.lit(False)
            rows = rows.withColumn("target", F.coalesce(known, F.when(F.coalesce(F.col("id"), F.lit(0)) <= 0, F.col("__same"))))
        else:
            differs = F.lit(False)
            rows = rows.withColumn("target", known)
        unknown = F.lit(False) if e.trusted else (F.col("id") > 0) & F.col("__id").isNull()
        return rows.withColumns({"unknown": F.coalesce(unknown, F.lit(False)), "differs": F.coalesce(differs, F.lit(False))}).drop("__id", "__same", "__natural")

    def refused(self, rows: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
        e = self.entity
        kinds = {f.name: f.dataType for f in rows.schema}
        reasons = [
            F.when(F.col("unknown"), F.concat(F.lit("id "), F.col("id").cast("string"), F.lit(" is not stored"))),
            F.when(F.col("differs"), F.concat(F.lit("id "), F.col("id").cast("string"), F.lit(" has other links"))),
            *(F.when(F.array_contains("unlinked", c), F.concat(F.lit(f"{c} not found: "), F.col(f"{c}_key"))) for c in e.links),
            *(F.when(~F.array_contains("unlinked", c) & ~present(F.col(c), kinds[c]), F.lit(f"{c} is missing")) for c in e.required),
        ]
        for k, check in enumerate(e.checks):
            theirs = state[check.entity].select(*(F.col(b).alias(f"__{k}_{a}") for a, b in check.on.items())).distinct().withColumn(f"__there_{k}", F.lit(True))
            rows = rows.join(theirs, [F.col(a) == F.col(f"__{k}_{a}") for a in check.on], "left")
            whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in check.on))
            reasons.append(F.when(whole & F.col(f"__there_{k}").isNull(), F.lit(check.reason)))
        reasons.append(F.when(F.col("key").isNull(), F.lit("no key")))
        return rows.select(F.lit(e.name).alias("entity"), "key", F.explode(F.filter(F.array(*reasons), lambda x: x.isNotNull())).alias("reason"))

    def group_key(self) -> list[Column]:
        """What makes new rows one: the natural key if all of it is there, else the key."""
        natural = self.entity.natural
        whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in natural), F.lit(bool(natural)))
        return [*(F.when(whole, F.col(c)).alias(c) for c in natural), F.when(~whole, F.col("key")).alias("key")]

    def all_keys(self, own: DataFrame, stored: DataFrame) -> list[DataFrame]:
        """(key, id): of staged rows, and partial keys that lead to one row and are no key themselves; then of stored rows, for what isn't among the first."""
        exact = own.groupBy("key").agg(F.min("id").alias("id"))
        of = stored.where("key is not null").groupBy("key").agg(F.min("id").alias("id")) if "key" in stored.columns else None
        if self.entity.partial is None:
            return [self.steps.keep(exact, f"{self.entity.name}-keys"), *([] if of is None else [of])]
        if of is not None:
            exact = exact.unionByName(of.join(exact.select("key"), "key", "left_anti"))
        exact = self.steps.keep(exact, f"{self.entity.name}-exact-keys")
        short = exact.select(self.entity.partial(F.col("key")).alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("most")).where("id = most and key is not null").select("key", "id")
        return [self.steps.keep(exact.unionByName(short.join(exact.select("key"), "key", "left_anti")), f"{self.entity.name}-keys")]

    def changed(self, rows: DataFrame, stored: DataFrame, low: int | None, high: int | None) -> DataFrame:
        """A row for each row that is new or differs, with the columns to write."""
        e = self.entity
        old = between(stored, "id", low, high).select(F.col("id").alias("row_id"), F.lit(True).alias("__stored"), *(F.col(c).alias(f"__{c}") for c in e.written))
        joined = rows.where("target is null").withColumns({"__stored": F.lit(None).cast("boolean"), **{f"__{c}": F.lit(None).cast(stored.schema[c].dataType) for c in e.written}})
        if not e.trusted:  # new ids are above all stored ones
            joined = joined.unionByName(rows.where("target is not null").join(old, "row_id", "left"))
        kinds = {c: rows.schema[c].dataType for c in e.written}
        there, new = {c: present(F.col(c), kinds[c]) for c in e.written}, F.col("__stored").isNull()
        cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        cells = F.array(*(F.when(there[c] & (new | F.lit(c in e.always) | ~F.col(c).eqNullSafe(F.col(f"__{c}"))), cell(c)) for c in e.written))
        out = joined.select(
            F.lit(self.step).alias("step"), F.lit(e.name).alias("entity"), F.when(new, "INSERT").otherwise("UPDATE").alias("operation"),
            F.col("row_id").alias("id"), F.map_from_entries(F.filter(cells, lambda x: x.isNotNull())).alias("columns"),
        )
        return out.where((F.col("operation") == "INSERT") | (F.size("columns") > 0))

    def observed(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """df as a written table, and its counts, taken while it is written."""
        seen = Observation(f"{self.entity.name}-{name}")
        table = self.steps.keep(df.observe(seen, *(c.alias(k) for k, c in counts.items())), f"{self.entity.name}-{name}")
        return table, seen.get

    def committed(self, rows: DataFrame, stored: DataFrame) -> DataFrame:
        """(id, links, natural key) of all rows after this level, for the checks of later ones."""
        wanted = list(dict.fromkeys((*self.entity.links, *self.entity.natural)))
        own = rows.select(F.col("row_id").alias("id"), *wanted)
        return own.unionByName(stored.select("id", *wanted).join(own.select("id"), "id", "left_anti"))


def after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """stored with its changes: each column that is written takes the new value, new ids are new rows."""
    new = changes.select(F.col("id").alias("__id"), F.col("columns").alias("__new"))
    joined = stored.join(new, F.col("id") == F.col("__id"), "full_outer")
    value = lambda f: F.coalesce(F.try_element_at("__new", F.lit(f.name)).cast(f.dataType), F.col(f.name))
    return joined.select(*(F.coalesce("id", "__id").alias("id") if f.name == "id" else value(f).alias(f.name) for f in stored.schema))


def commit(entities: list[Entity], staged: dict[str, DataFrame], store: Versions, name: str = "commit") -> tuple[int, Plan]:
    """Plans the staged rows against the store's newest version and publishes the next one, with all changed tables and the log at once; or raises Refused, and nothing has changed."""
    base = store.version()
    stored = {e.name: store.read(e.name, base) for e in entities}
    made = plan(entities, staged, stored, Steps(store.spark, name))
    made.refuse()
    log = store.spark.createDataFrame(made.log, "entity string, staged long, inserts long, updates long, faults long")
    touched = {row[0] for row in made.log if row[2] or row[3]}
    return store.publish({e.name: after(stored[e.name], made.tables[e.name]) for e in entities if e.name in touched} | {"commit_log": log}, base), made
