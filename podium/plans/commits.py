"""A season's documents committed into the tables of all earlier ones, over sixteen entities in the order of their foreign keys.

What is stored and what comes in are said in SQL that Spark and DuckDB share; the commit itself is podium.operators.commit, and _oracle() says it in SQL
once more. The last season comes in. Stored are the earlier seasons, and of the last one some meetings, sessions, badges and the like, as an
earlier import leaves them; stored rows are known by id, by natural key, or not at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import commit as cm
from podium.operators.commit import Check, Entity
from podium.plans import domain as d
from podium.plans.registry import query
from podium.sources.shared import Steps

ENTITIES = [
    Entity("meeting", columns=("name", "header_date"), required=("name",)),
    Entity("calendar", {"meeting_id": "meeting"}, ("season_id", "meeting_code", "updated_at"), ("season_id", "meeting_code"), required=("meeting_id",), always=("updated_at",)),
    Entity("city", columns=("name",), required=("name",)),
    Entity("swimming_pool", {"city_id": "city"}, ("length",), required=("city_id", "length")),
    Entity("meeting_session", {"meeting_id": "meeting", "swimming_pool_id": "swimming_pool"}, ("session_order", "scheduled_date"), required=("meeting_id",)),
    Entity("team", columns=("name",), required=("name",)),
    Entity("team_affiliation", {"team_id": "team"}, ("season_id",), ("team_id", "season_id"), required=("team_id",), agrees=True),
    Entity("swimmer", columns=("complete_name", "gender", "year_of_birth"), required=("complete_name",), partial=lambda key: F.regexp_extract(key, r"^[FM]\|(.*)$", 1)),
    Entity("badge", {"swimmer_id": "swimmer", "team_id": "team", "team_affiliation_id": "team_affiliation"}, ("season_id", "category", "number"), ("season_id", "swimmer_id", "team_id"), required=("swimmer_id", "team_id", "team_affiliation_id"), trusted=True),
    Entity("meeting_event", {"meeting_session_id": "meeting_session"}, ("event_type",), ("meeting_session_id", "event_type"), required=("meeting_session_id",)),
    Entity("meeting_program", {"meeting_event_id": "meeting_event"}, ("category", "gender"), ("meeting_event_id", "category", "gender"), required=("meeting_event_id",)),
    Entity(
        "individual_result", {"meeting_program_id": "meeting_program", "swimmer_id": "swimmer", "team_id": "team", "badge_id": "badge"}, ("hundredths", "disqualified"), ("meeting_program_id", "swimmer_id", "team_id"),
        required=("meeting_program_id", "swimmer_id", "team_id", "badge_id"),
        checks=(Check("badge", {"badge_id": "id", "swimmer_id": "swimmer_id", "team_id": "team_id"}, "badge of another swimmer or team"), Check("team_affiliation", {"team_id": "team_id", "season_id": "season_id"}, "team without affiliation")),
    ),
    Entity("lap", {"individual_result_id": "individual_result"}, ("length", "from_start"), ("individual_result_id", "length"), required=("individual_result_id", "length")),
    Entity("relay_result", {"meeting_program_id": "meeting_program", "team_id": "team", "team_affiliation_id": "team_affiliation"}, ("hundredths",), ("meeting_program_id", "team_id"), required=("meeting_program_id", "team_id", "team_affiliation_id")),
    Entity("relay_swimmer", {"relay_result_id": "relay_result", "swimmer_id": "swimmer", "badge_id": "badge"}, ("relay_order",), ("relay_result_id", "swimmer_id", "relay_order"), required=("relay_result_id", "swimmer_id", "badge_id")),
    Entity("relay_lap", {"relay_swimmer_id": "relay_swimmer"}, ("length", "from_start"), ("relay_swimmer_id", "length"), required=("relay_swimmer_id", "length")),
]

_s = lambda x: f"cast({x} as string)"
#: Results with the keys of all that they belong to; season_last tells what comes in.
BASE = f"""select mir_id, swimmer_id, team_id, cast(season as bigint) as season, meeting_id, meeting_id % 100 as month, meeting_date, event, pool, hundredths, disqualified,
    season = (select max(season) from results) as season_last, meeting_id % 25 as nation, case when swimmer_id % 2 = 0 then 'F' else 'M' end as gender,
    'M' || {_s('(season - 1940 - swimmer_id % 65) - (season - 1940 - swimmer_id % 65) % 5')} as category, {_s('meeting_id')} as meeting_key, 'city ' || {_s('meeting_id % 25')} as city_key,
    'city ' || {_s('meeting_id % 25')} || '/' || {_s('pool')} as pool_key, {_s('meeting_id')} || '/' || {_s('pool')} as session_key, 'team ' || {_s('team_id')} as team_key,
    case when swimmer_id % 2 = 0 then 'F' else 'M' end || '|swimmer ' || {_s('swimmer_id')} || '|' || {_s('1940 + swimmer_id % 65')} as swimmer_key,
    {_s('meeting_id')} || '/' || {_s('pool')} || '/' || event as event_key, 'result ' || {_s('mir_id')} as result_key from results"""
#: Teams and swimmers that an earlier import has stored.
TEAM, SWIMMER = "team_id % 10 <> 3", "swimmer_id % 9 <> 4"
RELAYS = """select session_key, team_key, min(mir_id) as id, min(season) as season, min(meeting_id) as meeting_id, min(pool) as pool, min(team_id) as team_id, min(hundredths) as hundredths, bool_and(season_last) as season_last from base group by session_key, team_key"""
#: The first three swimmers of a team in a session, and one who need not be of that team.
LEGS = """select session_key, team_key, swimmer_id, swimmer_key, relay_order from (select session_key, team_key, swimmer_id, swimmer_key, row_number() over (partition by session_key, team_key order by swimmer_id) as relay_order from (select distinct session_key, team_key, swimmer_id, swimmer_key from base) x) y where relay_order <= 3
    union all select r.session_key, r.team_key, m.swimmer_id, m.swimmer_key, 4 as relay_order from relays r join (select session_key, max(swimmer_id) as swimmer_id from base group by session_key) x on r.session_key = x.session_key join (select distinct swimmer_id, swimmer_key from base) m on m.swimmer_id = x.swimmer_id"""
VIEWS = {"base": BASE, "relays": RELAYS, "legs": LEGS}
#: The same for Spark, in tables of numbers: results, what is one of a place (a program of a meeting) and of a person (a swimmer of a team in a season), and legs with their relays. Keys are made where they are read.
_of_place = f"""meeting_id % 100 as month, meeting_id % 25 as nation, {_s('meeting_id')} as meeting_key, 'city ' || {_s('meeting_id % 25')} as city_key, 'city ' || {_s('meeting_id % 25')} || '/' || {_s('pool')} as pool_key,
    {_s('meeting_id')} || '/' || {_s('pool')} as session_key, {_s('meeting_id')} || '/' || {_s('pool')} || '/' || event as event_key"""
_grouped = f"case when swimmer_id % 2 = 0 then 'F' else 'M' end as gender, 'M' || {_s('(season - 1940 - swimmer_id % 65) - (season - 1940 - swimmer_id % 65) % 5')} as category"
_keys = f"{_s('meeting_id')} || '/' || {_s('pool')} as session_key, 'team ' || {_s('team_id')} as team_key"
_swimmer_key = f"case when swimmer_id % 2 = 0 then 'F' else 'M' end || '|swimmer ' || {_s('swimmer_id')} || '|' || {_s('1940 + swimmer_id % 65')} as swimmer_key"
_of_person = f"{_grouped}, 'team ' || {_s('team_id')} as team_key, {_swimmer_key}"
#: Written tables, in this order, and views of them.
NARROW = {
    "numbers": "select mir_id, swimmer_id, team_id, cast(season as bigint) as season, meeting_id, meeting_date, event, pool, hundredths, disqualified, season = (select max(season) from results) as season_last from results",
    "programs": f"select season, season_last, meeting_id, pool, event, gender, category, min(mir_id) as mir_id, min(meeting_date) as meeting_date from (select *, {_grouped} from numbers) x group by season, season_last, meeting_id, pool, event, gender, category",
    "entries": "select swimmer_id, team_id, season, season_last, min(mir_id) as mir_id from numbers group by swimmer_id, team_id, season, season_last",
    "relays": f"select {_keys}, * from (select meeting_id, pool, team_id, min(mir_id) as id, min(season) as season, min(hundredths) as hundredths, bool_and(season_last) as season_last from numbers group by meeting_id, pool, team_id) x",
    "raced": f"""select l.*, r.id, r.season, r.hundredths, r.season_last from (select meeting_id, pool, team_id, swimmer_id, relay_order from (select meeting_id, pool, team_id, swimmer_id, row_number() over (partition by meeting_id, pool, team_id order by swimmer_id) as relay_order from (select distinct meeting_id, pool, team_id, swimmer_id from numbers) x) y where relay_order <= 3
        union all select r.meeting_id, r.pool, r.team_id, swimmer_id, 4 as relay_order from relays r join (select meeting_id, pool, max(swimmer_id) as swimmer_id from numbers group by meeting_id, pool) x on r.meeting_id = x.meeting_id and r.pool = x.pool where swimmer_id is not null) l
        join relays r on l.meeting_id = r.meeting_id and l.pool = r.pool and l.team_id = r.team_id""",
}
SHOWN = {
    "base": f"select *, {_of_place}, {_of_person}, 'result ' || {_s('mir_id')} as result_key from numbers",
    "places": f"select *, {_of_place} from programs",
    "people": f"select *, {_of_person} from entries",
    "legs": f"select *, {_keys}, {_swimmer_key} from raced",
}
#: Where Spark reads an entity's rows; legs have what their relays have.
SOURCES = dict.fromkeys(("meeting", "calendar", "city", "swimming_pool", "meeting_session", "meeting_event", "meeting_program"), "places") | dict.fromkeys(("team", "team_affiliation", "swimmer", "badge"), "people")
#: Stored tables that are read often and made by a shuffle.
WRITTEN = ("team", "team_affiliation", "swimmer")

_id = lambda when, value: f"case when {when} then cast({value} as bigint) end as id"
_none = "cast(null as bigint)"
STAGED = {
    "meeting": f"select meeting_key as key, {_id('month <= 6', 'meeting_id')}, 'Meeting ' || meeting_key as name, {_s('min(meeting_date)')} as header_date from base where season_last group by meeting_key, meeting_id, month",
    "calendar": f"select distinct meeting_key as key, {_none} as id, {_none} as meeting_id, meeting_key as meeting_id_key, season as season_id, 'm' || {_s('month')} as meeting_code, '2000-01-01' as updated_at from base where season_last",
    "city": f"select distinct city_key as key, {_id('nation % 5 <> 4', 'nation + 1')}, 'City of ' || city_key as name from base where season_last",
    "swimming_pool": f"select distinct pool_key as key, {_id('nation % 5 <> 4 and pool = 1', 'nation + 1')}, {_none} as city_id, city_key as city_id_key, pool * 25 as length from base where season_last",
    "meeting_session": f"select session_key as key, {_id('month <= 3 and pool = 1', 'meeting_id * 10 + pool')}, {_none} as meeting_id, meeting_key as meeting_id_key, {_none} as swimming_pool_id, pool_key as swimming_pool_id_key, pool as session_order, {_s('min(meeting_date)')} as scheduled_date from base where season_last group by session_key, month, pool, meeting_id, meeting_key, pool_key",
    "team": f"select distinct team_key as key, {_id(TEAM, 'team_id')}, upper(team_key) as name from base where season_last",
    "team_affiliation": f"select distinct team_key as key, {_id(f'{TEAM} and team_id % 8 = 0', 'season * 1000000000 + team_id')}, {_none} as team_id, team_key as team_id_key, season as season_id from base where season_last",
    "swimmer": f"select distinct swimmer_key as key, {_id(SWIMMER, 'swimmer_id')}, 'Swimmer ' || {_s('swimmer_id')} as complete_name, gender, 1940 + swimmer_id % 65 as year_of_birth from base where season_last",
    "badge": f"select swimmer_key || '/' || team_key as key, {_id(f'{TEAM} and {SWIMMER} and (swimmer_id + team_id) % 6 = 0', 'min(mir_id)')}, {_none} as swimmer_id, case when swimmer_id % 5 = 0 then substring(swimmer_key, 3) else swimmer_key end as swimmer_id_key, {_none} as team_id, team_key as team_id_key, {_none} as team_affiliation_id, team_key as team_affiliation_id_key, season as season_id, min(category) as category, {_s('min(swimmer_id)')} as number from base where season_last group by swimmer_key, team_key, swimmer_id, team_id, season",
    "meeting_event": f"select distinct event_key as key, {_none} as id, {_none} as meeting_session_id, session_key as meeting_session_id_key, event as event_type from base where season_last union all select distinct session_key || '/relay', {_none}, {_none}, session_key, 'relay' from base where season_last",
    "meeting_program": f"select distinct event_key || '/' || category || '/' || gender as key, {_none} as id, {_none} as meeting_event_id, event_key as meeting_event_id_key, category, gender from base where season_last union all select distinct session_key || '/relay', {_none}, {_none}, session_key || '/relay', 'relay', 'X' from base where season_last",
    "individual_result": f"select result_key as key, {_none} as id, {_none} as meeting_program_id, event_key || '/' || category || '/' || gender as meeting_program_id_key, {_none} as swimmer_id, swimmer_key as swimmer_id_key, {_none} as team_id, team_key as team_id_key, {_none} as badge_id, swimmer_key || '/' || team_key as badge_id_key, season as season_id, hundredths, disqualified from base where season_last",
    "lap": f"select result_key || '/' || {_s('k * 25')} as key, {_none} as id, {_none} as individual_result_id, result_key as individual_result_id_key, k * 25 as length, cast(floor(hundredths * k / 4) as bigint) as from_start from base, (values (1), (2), (3), (4)) t(k) where season_last and hundredths > 0",
    "relay_result": f"select session_key || '/relay/' || team_key as key, {_none} as id, {_none} as meeting_program_id, session_key || '/relay' as meeting_program_id_key, {_none} as team_id, team_key as team_id_key, {_none} as team_affiliation_id, team_key as team_affiliation_id_key, hundredths from relays where season_last",
    "relay_swimmer": f"select l.session_key || '/relay/' || l.team_key || '/' || {_s('relay_order')} as key, {_none} as id, {_none} as relay_result_id, l.session_key || '/relay/' || l.team_key as relay_result_id_key, {_none} as swimmer_id, swimmer_key as swimmer_id_key, {_none} as badge_id, swimmer_key || '/' || l.team_key as badge_id_key, relay_order from legs l join relays r on l.session_key = r.session_key and l.team_key = r.team_key where season_last",
    "relay_lap": f"select l.session_key || '/relay/' || l.team_key || '/' || {_s('relay_order')} || '/50' as key, {_none} as id, {_none} as relay_swimmer_id, l.session_key || '/relay/' || l.team_key || '/' || {_s('relay_order')} as relay_swimmer_id_key, 50 as length, hundredths * relay_order as from_start from legs l join relays r on l.session_key = r.session_key and l.team_key = r.team_key where season_last",
}
_both = f"{TEAM} and {SWIMMER}"
STORED = {
    "meeting": "select distinct meeting_key as key, cast(meeting_id as bigint) as id, 'Meeting ' || meeting_key as name, cast(null as string) as header_date from base where not season_last or month <= 6",
    "calendar": f"select distinct meeting_key as key, cast(meeting_id as bigint) as id, cast(meeting_id as bigint) as meeting_id, season as season_id, 'm' || {_s('month')} as meeting_code, '1999-01-01' as updated_at from base where not season_last or month <= 3",
    "city": "select distinct city_key as key, cast(nation + 1 as bigint) as id, 'City ' || city_key as name from base where nation % 5 <> 4",
    "swimming_pool": "select distinct pool_key as key, cast(nation + 1 as bigint) as id, cast(nation + 1 as bigint) as city_id, 25 as length from base where nation % 5 <> 4 and pool = 1",
    "meeting_session": "select distinct session_key as key, cast(meeting_id * 10 + pool as bigint) as id, cast(meeting_id as bigint) as meeting_id, cast(nation + 1 as bigint) as swimming_pool_id, pool as session_order, cast(null as string) as scheduled_date from base where pool = 1 and (not season_last or month <= 3)",
    "team": f"select distinct team_key as key, team_id as id, team_key as name from base where {TEAM}",
    "team_affiliation": f"select distinct cast(null as string) as key, season * 1000000000 + team_id as id, team_id, season as season_id from base where {TEAM} and (not season_last or team_id % 4 = 0)",
    "swimmer": f"select distinct swimmer_key as key, swimmer_id as id, 'Swimmer ' || {_s('swimmer_id')} as complete_name, gender, cast(null as int) as year_of_birth from base where {SWIMMER}",
    "badge": f"select cast(null as string) as key, min(mir_id) as id, swimmer_id, team_id, season * 1000000000 + team_id as team_affiliation_id, season as season_id, min(category) as category, '?' as number from base where {_both} and (not season_last or (swimmer_id + team_id) % 3 = 0) group by swimmer_id, team_id, season",
    "meeting_event": "select cast(null as string) as key, min(mir_id) as id, cast(meeting_id * 10 + pool as bigint) as meeting_session_id, event as event_type from base where pool = 1 and (not season_last or (month <= 3 and event like 'ECO%')) group by meeting_id, pool, event",
    "meeting_program": "select cast(null as string) as key, min(mir_id) as id, cast(null as bigint) as meeting_event_id, category, gender from base where not season_last group by meeting_id, pool, event, category, gender",
    "individual_result": "select result_key as key, mir_id as id, cast(null as bigint) as meeting_program_id, swimmer_id, team_id, cast(null as bigint) as badge_id, hundredths, disqualified from base where not season_last",
    "lap": "select cast(null as string) as key, mir_id * 4 + k - 1 as id, mir_id as individual_result_id, k * 25 as length, cast(floor(hundredths * k / 4) as bigint) as from_start from base, (values (1), (2), (3), (4)) t(k) where not season_last and hundredths > 0",
    "relay_result": "select cast(null as string) as key, id, cast(null as bigint) as meeting_program_id, team_id, season * 1000000000 + team_id as team_affiliation_id, hundredths from relays where not season_last",
    "relay_swimmer": "select cast(null as string) as key, r.id * 4 + relay_order - 1 as id, r.id as relay_result_id, swimmer_id, cast(null as bigint) as badge_id, relay_order from legs l join relays r on l.session_key = r.session_key and l.team_key = r.team_key where not season_last",
    "relay_lap": "select cast(null as string) as key, r.id * 4 + relay_order - 1 as id, r.id * 4 + relay_order - 1 as relay_swimmer_id, 50 as length, hundredths * relay_order as from_start from legs l join relays r on l.session_key = r.session_key and l.team_key = r.team_key where not season_last",
}
#: The same for Spark, whose people are one for each swimmer, team and season.
STORED_BADGES = f"select cast(null as string) as key, mir_id as id, swimmer_id, team_id, season * 1000000000 + team_id as team_affiliation_id, season as season_id, category, '?' as number from people where {_both} and (not season_last or (swimmer_id + team_id) % 3 = 0)"
#: Badges that relays need and nobody has staged.
NEEDED_BADGES = f"select swimmer_key || '/' || l.team_key as key, {_none} as id, swimmer_key as swimmer_id_key, l.team_key as team_id_key, l.team_key as team_affiliation_id_key, season as season_id, '?' as number from legs l join relays r on l.session_key = r.session_key and l.team_key = r.team_key where season_last"
#: What goes wrong in staged documents: ids that aren't stored or have other links, links that lead nowhere, a result with another's badge.
FAULTS = {
    "team_affiliation": "case when team_id_key = 'team 2' then 77 when id % 16 = 0 then id - 1000000000 else id end as id",
    "meeting_event": "case when key like '%/relay' then meeting_session_id_key when event_type like 'PROMO%' then 'no session' else meeting_session_id_key end as meeting_session_id_key",
    "individual_result": "case when hundredths % 50 = 0 then (select min(key) from {badge}) else badge_id_key end as badge_id_key",
}


def told(name: str, text: str) -> str:
    """An entity's rows in SQL for Spark."""
    text = text.replace("from legs l join relays r on l.session_key = r.session_key and l.team_key = r.team_key", "from legs l")
    text = re.sub(r"\br\.(?=id\b|season)", "l.", text) if "from legs l" in text else text
    return text.replace("from base", f"from {SOURCES.get(name, 'base')}")


def tables(spark: SparkSession, sf: str, steps: Steps) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What is staged and what is stored."""
    views = {"results": d.results(spark, sf)}
    run = lambda text: spark.sql(_braced(text), **{k: v for k, v in views.items() if "{" + k + "}" in _braced(text)})
    for name, text in NARROW.items():
        views[name] = steps.keep(run(text), name, by="season_last")
    for name, text in SHOWN.items():
        views[name] = run(text)
    staged = {e.name: run(told(e.name, STAGED[e.name])) for e in ENTITIES}
    staged["badge"] = cm.missing_rows(staged["badge"], run(told("badge", NEEDED_BADGES)), ["key"])
    stored = {e.name: run(told(e.name, STORED_BADGES if e.name == "badge" else STORED[e.name])) for e in ENTITIES}
    return staged, stored | {n: steps.keep(stored[n], f"{n}-stored") for n in WRITTEN}


def _braced(text: str) -> str:
    for name in ("results", *NARROW, *SHOWN):
        text = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)
    return text


def faulty(spark: SparkSession, staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = dict(staged)
    for name, text in FAULTS.items():
        column = text.rsplit(" as ", 1)[1]
        others = [c for c in staged[name].columns if c != column]
        views = {"rows": staged[name]} | ({"badge": staged["badge"]} if "{badge}" in text else {})
        out[name] = spark.sql(f"select {', '.join(others)}, {text} from {{rows}}", **views).select(*staged[name].columns)
    return out


def written(e: Entity) -> Column:
    return F.concat_ws(";", *(F.when(F.col("columns")[c].isNotNull(), F.concat(F.lit(f"{c}="), F.col("columns")[c])) for c in e.written))


def _oracle(faults: bool = False) -> str:
    parts = [f"{name} as materialized ({text})" for name, text in VIEWS.items()]
    for e in ENTITIES:
        n, rows = e.name, STAGED[e.name]
        if n == "badge":
            rows = f"select * from ({rows}) s union all by name select distinct on (key) * from ({NEEDED_BADGES}) w where key not in (select key from ({rows}) s2)"
        if faults and n in FAULTS:
            text = FAULTS[n].replace("{badge}", f"({STAGED['badge']}) b")
            rows = f"select * replace ({text}) from ({rows}) s"
        parts.append(f"{n}_staged as materialized ({rows})")
        parts.append(f"{n}_stored as materialized ({STORED[n]})")
        linked = ", ".join(f"coalesce(case when s.{c} > 0 then s.{c} end, {c}_of.id) as {c}" for c in e.links)
        joins = " ".join(f"left join {p}_keys {c}_of on {c}_of.key = s.{c}_key" for c, p in e.links.items())
        parts.append(f"{n}_linked as materialized (select s.* {f'replace ({linked})' if linked else ''} from {n}_staged s {joins})")
        same = f"left join (select {', '.join(e.natural)}, min(id) as id from {n}_stored group by all) same on {' and '.join(f'same.{c} = l.{c}' for c in e.natural)}" if e.natural else ""
        by_key = "when coalesce(l.id, 0) <= 0 then same.id" if e.natural else ""
        differs = f"st.id is not null and not ({' and '.join(f'l.{c} is not distinct from st.{c}' for c in e.natural)})" if e.agrees else "false"
        parts.append(f"{n}_found as materialized (select l.*, case when l.id > 0 then {'l.id' if e.trusted else 'st.id'} {by_key} end as target, l.id > 0 and st.id is null and {not e.trusted} as unknown, {differs} as differs from {n}_linked l left join {n}_stored st on st.id = l.id {same})")
        natural = f"when {' and '.join(f'{c} is not null' for c in e.natural)} then concat_ws('~', {', '.join(e.natural)})" if e.natural else ""
        parts.append(f"{n}_grouped as materialized (select *, case when target is not null then 'id ' || target {natural} else key end as grp from {n}_found)")
        parts.append(f"{n}_first as materialized (select * from {n}_grouped qualify row_number() over (partition by grp order by key) = 1)")
        parts.append(f"{n}_rows as materialized (select *, coalesce(target, (select coalesce(max(id), 0) from {n}_stored) + row_number() over (partition by target is null order by key)) as row_id from {n}_first)")
        exact = f"select g.key, min(r.row_id) as id from {n}_grouped g join {n}_rows r using (grp) group by 1"
        exact = f"with own as ({exact}) select * from own union all select key, min(id) from {n}_stored where key is not null and key not in (select key from own) group by 1"
        if e.partial:
            exact = f"with exact as ({exact}) select * from exact union all select substring(key, 3), min(id) from exact group by 1 having min(id) = max(id)"
        parts.append(f"{n}_keys as materialized ({exact})")
        kinds = {"disqualified": "and r.disqualified"}
        cells = ", ".join(f"case when r.{c} is not null {kinds.get(c, '')} and trim(cast(r.{c} as varchar)) <> '' and (st.id is null or {c in e.always} or r.{c} is distinct from st.{c}) then '{c}=' || r.{c} end" for c in e.written)
        parts.append(f"{n}_changes as (select '{n}' as entity, case when st.id is null then 'INSERT' else 'UPDATE' end as operation, row_id as id, concat_ws(';', {cells}) as columns from {n}_rows r left join {n}_stored st on st.id = r.row_id where {'target is null' if e.trusted else 'true'})")
    if not faults:
        union = " union all ".join(f"select {k} as step, * from {e.name}_changes where operation = 'INSERT' or columns <> ''" for k, e in enumerate(ENTITIES, 1))
        return d.sql("results", ", " + ",\n".join(parts) + "\n" + union)
    states = ["badge_state as (select row_id as id, swimmer_id, team_id from badge_rows union all select id, swimmer_id, team_id from badge_stored where id not in (select row_id from badge_rows))"]
    reasons = []
    for e in ENTITIES:
        n = e.name
        reasons += [f"select '{n}' as entity, key, 'id ' || id || ' is not stored' as reason from {n}_found where unknown", f"select '{n}', key, 'id ' || id || ' has other links' from {n}_found where differs"]
        reasons += [f"select '{n}', key, '{c} not found: ' || {c}_key from {n}_found where {c}_key is not null and {c} is null" for c in e.links]
        reasons += [f"select '{n}', key, '{c} is missing' from {n}_found where {c} is null {f'and {c}_key is null' if c in e.links else ''}" for c in e.required]
    reasons += [
        "select 'individual_result', f.key, 'badge of another swimmer or team' from individual_result_found f left join badge_state b on b.id = f.badge_id and b.swimmer_id = f.swimmer_id and b.team_id = f.team_id where b.id is null and f.badge_id is not null and f.swimmer_id is not null and f.team_id is not null",
        "select 'individual_result', f.key, 'team without affiliation' from individual_result_found f left join (select team_id, season_id from team_affiliation_rows union select team_id, season_id from team_affiliation_stored) b on b.team_id = f.team_id and b.season_id = f.season_id where b.team_id is null and f.team_id is not null",
    ]
    return d.sql("results", ", " + ",\n".join(parts + states) + "\n" + " union all ".join(reasons))


@query("U05 U07 U08 N01 N02 N03 N04 N05 N06 N07 N08 N09 N10 N11 N12 N13 N14 N15 N16 E14 A13", _oracle())
def entity_commit(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered change set of the season's documents: sixteen tables, new ids in each, links filled level by level."""
    steps = Steps(spark, "entity-commit")
    plan = cm.plan(ENTITIES, *tables(spark, sf, steps), steps, changes_only=True)
    parts = [plan.tables[e.name].select("step", "entity", "operation", "id", written(e).alias("columns")) for e in ENTITIES]
    steps.drop_all_but(*plan.tables.values())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("U06 U07 N07", _oracle(faults=True))
def commit_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Why faulty documents are refused, all faults of all levels."""
    steps = Steps(spark, "commit-faults")
    staged, stored = tables(spark, sf, steps)
    return cm.plan(ENTITIES, faulty(spark, staged), stored, steps, faults_only=True).faults


def _log_oracle() -> str:
    return f"""select entity, cast(count(*) filter (where operation = 'INSERT') as bigint) as inserts, cast(count(*) filter (where operation = 'UPDATE') as bigint) as updates from ({_oracle()}) c group by 1"""


@query("K10 T01", _log_oracle())
def commit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts and updates of each entity, observed while the changes are written."""
    steps = Steps(spark, "commit-log")
    log = cm.plan(ENTITIES, *tables(spark, sf, steps), steps, changes_only=True).log
    steps.drop_all_but()
    return spark.createDataFrame([(name, inserts, updates) for name, _, inserts, updates, _ in log if inserts or updates], "entity string, inserts long, updates long")
