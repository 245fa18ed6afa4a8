"""Queries of nested and typed documents: requests by type, form parameters, renamed keys and synced rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import nested
from podium.operators import documents
from podium.plans import domain as d
from podium.plans.merges import run
from podium.plans.registry import query

#: Requests as the events' users might have sent them: nine types and one that nobody knows, fields left out or of another kind here and there, and bodies that are broken.
_v = lambda name, value, when="true": f"""case when {when} then ',"{name}":' || {value} else '' end"""
_text = lambda x: f"""'"' || cast({x} as string) || '"'"""
REQUESTS = f"""select event_id, case event_id % 11 when 0 then '0' when 1 then '1a' when 2 then '1b' when 3 then '1b1' when 4 then '2b1' when 5 then '3b' when 6 then '3c' when 7 then '4' when 8 then '5' when 9 then '1b' else '9' end as kind,
    case when event_id % 97 = 0 then '{{"broken' when event_id % 89 = 0 then '[1,2]' when event_id % 83 = 0 then cast(null as string) else '{{"at":1' || {_v('team_id', _text('user_id'))} || {_v('season_id', 'cast(event_id as string)', 'user_id % 3 > 0')} || {_v('meeting_id', 'cast(user_id as string)')}
    || {_v('results_url', _text('event_type'), 'user_id % 4 > 0')} || {_v('parent_meeting_id', _text('event_id'))} || {_v('parent_meeting_class', _text("'Meeting'"))} || {_v('event_type_id', 'cast(user_id % 20 as string)')} || {_v('minutes', _text("case when user_id % 5 = 0 then 'x' else cast(user_id % 3 as string) end"))}
    || {_v('seconds', _text('event_id % 60'))} || {_v('hundredths', 'cast(event_id % 100 as string)', 'event_id % 13 > 0')} || {_v('swimmer_id', _text('user_id'))} || {_v('swimmer_last_name', _text('upper(event_type)'))} || {_v('swimmer_year_of_birth', _text("case when user_id % 7 = 0 then '19?0' else '1969' end"))}
    || {_v('gender_type_id', 'null', 'user_id % 6 = 0')} || {_v('result_id', 'cast(event_id as string)')} || {_v('result_class', _text("'MeetingIndividualResult'"))} || {_v('team', _text("'T ' || event_type"), 'user_id % 2 = 0')} || {_v('type3c_last_name', _text('event_type'))} || {_v('type3c_year_of_birth', '1970')} || '}}' end as body from events"""


def _request_sql() -> str:
    rows = " union all ".join(f"select '{kind}', '{f.rstrip('?')}', '{t}', {f.endswith('?')}" for kind, fields in nested.REQUEST_FIELDS.items() for f, t in fields.items())
    cast = " ".join(f"when type = '{t}' then cast(try_cast(raw as {t}) as varchar)" for t in ("int", "bigint"))
    return f"""with requests as materialized ({REQUESTS}), fields(kind, field, type, optional) as ({rows}), ok as (select *, body is not null and json_valid(body) and json_type(case when json_valid(body) then body end) = 'OBJECT' as whole from requests),
        raws as (select event_id, kind, field, type, optional, json_extract_string(body, '$.' || field) as raw from ok join fields using (kind) where whole), v as (select *, case {cast} else raw end as value from raws)
        select event_id, kind, field, value, case when raw is null then case when not optional then 'missing' end when value is null then 'not ' || type end as reason from v
        union all select event_id, kind, '*', null, case when whole is not true then 'no JSON object' else 'unknown type' end from ok where whole is not true or kind not in ({', '.join(f"'{k}'" for k in nested.REQUEST_FIELDS)})"""


@query("F78 S03", _request_sql())
def typed_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of requests of nine types, and why one has no value."""
    requests = run(spark, REQUESTS, {"events": d.table(spark, sf, "events")})
    return requests.select("event_id", "kind", F.explode(nested.request_fields(F.col("kind"), F.col("body"))).alias("x")).select("event_id", "kind", "x.*")


FORMS = """select event_id, 'pool[0][swimming_pool_id]=' || cast(user_id as string) || '&pool[name]=Stadio+' || event_type || '&pool[10][name]=n' || cast(event_id as string) || case when event_id % 3 = 0 then '&pool[2][address]=Via%20' || event_type || '&pool[2][swimming_pool_id]=7&pool[2][swimming_pool_id]=8' else '' end
    || case when event_id % 4 = 0 then '&pool[[name]=z&pool[]=5&pool&other[0][name]=no&pool[1][secret]=s' else '' end || '&pool[address]=common' as form from events"""
ALLOWED = ["swimming_pool_id", "name", "address"]
_pair = "^([^=\\[\\]]+)(?:\\[(\\d+)\\])?\\[([^=\\[\\]]+)\\]=(.*)$"


@query("F79 G07", f"""with forms as ({FORMS}), p as (select event_id, unnest(string_split(form, '&')) as x, generate_subscripts(string_split(form, '&'), 1) as n from forms),
    f as (select event_id, n, try_cast(nullif(regexp_extract(x, '{_pair}', 2), '') as integer) as index, regexp_extract(x, '{_pair}', 3) as name, url_decode(replace(regexp_extract(x, '{_pair}', 4), '+', ' ')) as value from p where regexp_extract(x, '{_pair}', 1) = 'pool'),
    i as (select distinct event_id, index from f where index is not null), top as (select event_id, name, arg_max(value, n) as value from f where index is null group by 1, 2), own as (select event_id, index, name, arg_max(value, n) as value from f where index is not null group by 1, 2, 3)
    select i.event_id, i.index, {', '.join(f"coalesce((select value from own where own.event_id = i.event_id and own.index = i.index and name = '{n}'), (select value from top where top.event_id = i.event_id and name = '{n}')) as {n}" for n in ALLOWED)} from i""")
def form_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of a form's sessions, from parameters in brackets."""
    forms = run(spark, FORMS, {"events": d.table(spark, sf, "events")})
    return forms.select("event_id", F.explode(nested.form_params(F.col("form"), "pool", ALLOWED)).alias("x")).select("event_id", "x.*")


KEY = "case when swimmer_id % 2 = 0 then 'F' else 'M' end || '|swimmer ' || cast(swimmer_id as string)"
#: New keys: of stored swimmers by their row, of others a made-up one; one swimmer in five keeps the key.
KEYS = f"select distinct {KEY} as old, case when swimmer_id % 3 = 0 then 'stored ' || cast(swimmer_id * 7 as string) else 'someone ' || cast(swimmer_id % 97 as string) end as new from results where swimmer_id % 5 > 0"
ROWS = f"select meeting_id, pool, event, mir_id, {KEY} as swimmer_key, 'team ' || cast(team_id as string) as team_key, swimmer_id * 3 as stored_id, hundredths from results"


def nested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each meeting, pool and event: its swimmers, and results with laps that name the swimmer again."""
    rows = run(spark, ROWS, {"results": d.results(spark, sf)})
    lap = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: F.struct(k.alias("lap"), F.col("swimmer_key").alias("swimmer_key")))
    result = F.struct("mir_id", "swimmer_key", "team_key", lap.alias("laps"))
    swimmer = F.struct(F.col("swimmer_key").alias("key"), F.col("stored_id").alias("swimmer_id"), F.lit("?").alias("name"), F.lit(None).cast("int").alias("year_of_birth"))
    return rows.groupBy(F.concat_ws("/", "meeting_id", "pool", "event").alias("document")).agg(F.array_sort(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set(swimmer)).alias("swimmers"))


@query("G13 E19 F71", d.sql("results", f""", keys as ({KEYS}), rows as materialized (select concat_ws('/', meeting_id, pool, event) as document, mir_id, coalesce(new, swimmer_key) as key from ({ROWS}) r left join keys on old = swimmer_key), swimmers as (select distinct concat_ws('/', meeting_id, pool, event) as document, swimmer_key, coalesce(new, swimmer_key) as key from ({ROWS}) r left join keys on old = swimmer_key)
    select document, 'results' as path, row_number() over (partition by document order by mir_id) - 1 as at, key from rows union all select document, 'laps', (row_number() over (partition by document order by mir_id, k) - 1), key from rows, (values (1), (2)) t(k)
    union all select document, 'swimmers', row_number() over (partition by document order by swimmer_key) - 1, key from swimmers"""))
def renamed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of swimmers renamed in documents, wherever they are named, with their places."""
    docs = documents.renamed(nested_documents(spark, sf), "document", ["results", "swimmers"], run(spark, KEYS, {"results": d.results(spark, sf)}))
    place = lambda path, keys: docs.select("document", F.lit(path).alias("path"), F.posexplode(keys).alias("at", "key")).withColumn("at", F.col("at").cast("long"))
    laps = F.flatten(F.transform("results", lambda r: F.transform(r["laps"], lambda x: x["swimmer_key"])))
    return place("results", F.col("results.swimmer_key")).unionByName(place("laps", laps)).unionByName(place("swimmers", F.col("swimmers.key")))


@query("G12", d.sql("results", f""", ids as materialized (select distinct concat_ws('/', meeting_id, pool, event) as document, swimmer_key, stored_id from ({ROWS}) r), joined as (select i.*, c_custkey as swimmer_id, coalesce(c_name, '?') as name, 1940 + c_custkey % 65 as year_of_birth from ids i left join customer on c_custkey = stored_id),
    counted as (select document, count(swimmer_id) as found, count(*) - count(swimmer_id) as unknown from joined group by 1) select document, swimmer_key as key, swimmer_id, name, cast(year_of_birth as integer) as year_of_birth, found, unknown from joined join counted using (document)"""))
def synced_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Swimmers of documents with what is stored of them; ids that nobody has are cleared, and both are counted."""
    stored = d.swimmers(spark, sf).select(F.col("swimmer_id").alias("id"), "name", F.col("year_of_birth").cast("int").alias("year_of_birth"))
    docs = documents.synced(nested_documents(spark, sf), "document", "swimmers", "swimmer_id", stored, ["name", "year_of_birth"])
    return docs.select("document", "found", "unknown", F.explode("swimmers").alias("s")).select("document", "s.*", "found", "unknown")
