"""Queries of scalar functions, over texts derived from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import dates, events, names, timing
from podium.plans import domain as d
from podium.plans.registry import query

TIMING_TEXT = """case r.mir_id % 5 when 0 then cast(hundredths // 6000 as varchar) || '''' || lpad(cast(hundredths // 100 % 60 as varchar), 2, '0') || '"' || lpad(cast(hundredths % 100 as varchar), 2, '0')
    when 1 then cast(hundredths // 6000 as varchar) || ':' || lpad(cast(hundredths // 100 % 60 as varchar), 2, '0') || '.' || cast(hundredths % 10 as varchar) when 2 then lpad(cast(hundredths // 100 % 60 as varchar), 2, '0') || '.' || lpad(cast(hundredths % 100 as varchar), 2, '0')
    when 3 then cast(hundredths // 6000 % 60 as varchar) || ' ' || lpad(cast(hundredths // 100 % 60 as varchar), 2, '0') || ' ' || lpad(cast(hundredths % 100 as varchar), 2, '0') else 'DNS' end"""


def timing_texts(spark: SparkSession, sf: str) -> DataFrame:
    r, h = d.results(spark, sf), F.col("hundredths")
    m, s, c = F.floor(h / 6000).cast("string"), F.lpad((F.floor(h / 100) % 60).cast("string"), 2, "0"), F.lpad((h % 100).cast("string"), 2, "0")
    kind = F.col("mir_id") % 5
    text = F.when(kind == 0, F.concat(m, F.lit("'"), s, F.lit('"'), c)).when(kind == 1, F.concat(m, F.lit(":"), s, F.lit("."), (h % 10).cast("string"))).when(kind == 2, F.concat(s, F.lit("."), c)).when(kind == 3, F.concat((F.floor(h / 6000) % 60).cast("string"), F.lit(" "), s, F.lit(" "), c)).otherwise("DNS")
    return r.select("mir_id", "hundredths", text.alias("text"))


def parsed_sql(column: str) -> str:
    first, second = timing.FIRST.replace("'", "''"), timing.SECOND
    x = lambda p, k: f"regexp_extract({column}, '{p}', {k})"
    by = lambda p: f"case when {x(p, 2)} <> '' then coalesce(try_cast({x(p, 1)} as integer), 0) * 6000 + cast({x(p, 2)} as integer) * 100 + cast(rpad({x(p, 3)}, 2, '0') as integer) end"
    return f"coalesce({by(first)}, {by(second)})"


@query("F07", d.sql("results", f""", texts as (select mir_id, {TIMING_TEXT} as text from results r) select mir_id, case when regexp_matches(text, '^[A-Za-z]') or position(':' in text) = 0 then text
    else left(text, position(':' in text) - 1) || '''' || substr(text, position(':' in text) + 1) end as timing from texts"""))
def converted_timings(spark: SparkSession, sf: str) -> DataFrame:
    return timing_texts(spark, sf).select("mir_id", timing.convert_timing(F.col("text")).alias("timing"))


@query("F01 Q17", d.sql("results", f", texts as (select mir_id, {TIMING_TEXT} as text from results r) select mir_id, {parsed_sql('text')} as hundredths from texts"))
def parse_timings(spark: SparkSession, sf: str) -> DataFrame:
    return timing_texts(spark, sf).select("mir_id", timing.parse_timing(F.col("text")).alias("hundredths"))


@query("F02", d.sql("results", f", texts as (select mir_id, case when mir_id % 7 = 0 then cast(hundredths // 6000 as varchar) || '`' || lpad(cast(hundredths // 100 % 60 as varchar), 2, '0') else {TIMING_TEXT} end as text from results r), plain as (select mir_id, trim(replace(text, '`', '''')) as text from texts), whole as (select mir_id, case when regexp_matches(text, '^\\d+''\\d{{1,2}}$') then text || '.00' else text end as text from plain) select mir_id, coalesce({parsed_sql('text')}, 0) as hundredths from whole"))
def parse_staging_timings(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("hundredths")
    short = F.concat(F.floor(h / 6000).cast("string"), F.lit("`"), F.lpad((F.floor(h / 100) % 60).cast("string"), 2, "0"))
    text = F.when(F.col("mir_id") % 7 == 0, short).otherwise(F.col("text"))
    return timing_texts(spark, sf).select("mir_id", timing.parse_timing_staging(text).alias("hundredths"))


@query("F03 F04 F06", d.sql("results", """select mir_id, hundredths // 6000 as minutes, hundredths // 100 % 60 as seconds, hundredths % 100 as rest, abs(hundredths - 123456) as gap from results"""))
def timing_parts(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("hundredths")
    return d.results(spark, sf).select("mir_id", F.floor(h / 6000).alias("minutes"), (F.floor(h / 100) % 60).alias("seconds"), (h % 100).alias("rest"), F.abs(h - 123456).alias("gap"))


@query("F05", d.sql("results", f", texts as (select mir_id, {TIMING_TEXT} as text from results r) select mir_id, regexp_replace(regexp_replace(text, '^(\\d{{1,2}})\\D', '\\1'''), '\\D(\\d{{1,2}})$', '\"\\1') as timing from texts"))
def formatted_timings(spark: SparkSession, sf: str) -> DataFrame:
    return timing_texts(spark, sf).select("mir_id", F.regexp_replace(F.regexp_replace("text", "^(\\d{1,2})\\D", "$1'"), "\\D(\\d{1,2})$", '"$1').alias("timing"))


@query("F08 Q18", """with texts as (select o_orderkey, case o_orderkey % 5 when 0 then cast(o_orderkey % 1000 as varchar) || ',' || cast(o_orderkey % 97 as varchar) when 1 then '''' || cast(o_orderkey % 900 as varchar) || '.5' when 2 then '1.044,06' when 3 then 'n.d.' else cast(o_orderkey % 700 as varchar) || '_,25 p' end as text from orders),
    plain as (select o_orderkey, regexp_replace(regexp_replace(text, '[''_]', '', 'g'), ',(\\d{1,3})$', '.\\1') as text from texts) select o_orderkey, coalesce(try_cast(regexp_extract(text, '^\\s*([-+]?\\d+(?:\\.\\d+)?)', 1) as double), 0) as score from plain""")
def parse_scores(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda x: (k % x).cast("string")
    text = F.when(k % 5 == 0, F.concat(n(1000), F.lit(","), n(97))).when(k % 5 == 1, F.concat(F.lit("'"), n(900), F.lit(".5"))).when(k % 5 == 2, "1.044,06").when(k % 5 == 3, "n.d.").otherwise(F.concat(n(700), F.lit("_,25 p")))
    return d.table(spark, sf, "orders").select("o_orderkey", timing.parse_score(text).alias("score"))


@query("F10 F11 F16", d.sql("swimmers", """select swimmer_id, case when yy >= 100 then yy when 2001 - 1900 - yy < 110 then yy + 1900 else yy + 2000 end as year from (select swimmer_id, case when swimmer_id % 3 = 0 then year_of_birth else year_of_birth % 100 - 20 end as yy from swimmers)"""))
def full_years(spark: SparkSession, sf: str) -> DataFrame:
    yy = F.when(F.col("swimmer_id") % 3 == 0, F.col("year_of_birth")).otherwise(F.col("year_of_birth") % 100 - 20)
    return d.swimmers(spark, sf).select("swimmer_id", timing.full_year(yy, F.lit(2001)).alias("year"))


@query("F13 F14 F12 P17", """select part_id, round(w * 100, 1) as percentage, greatest(0, least(1, w + case when part_id % 2 = 0 then 0.05 else -0.05 end)) as adjusted, case when w * 100 >= 90 then 'green' when w * 100 >= 70 then 'yellow' when w * 100 >= 50 then 'red' end as band from (select p_partkey as part_id, cast(p_partkey % 101 as double) / 100 as w from part)""")
def weights_and_bands(spark: SparkSession, sf: str) -> DataFrame:
    w = (F.col("p_partkey") % 101).cast("double") / 100
    band = F.when(w * 100 >= 90, "green").when(w * 100 >= 70, "yellow").when(w * 100 >= 50, "red")
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), timing.match_percent(w).alias("percentage"), timing.adjusted_weight(w, F.col("p_partkey") % 2 == 0).alias("adjusted"), band.alias("band"))


@query("F20 F24", """with m as (select o_orderkey, o_orderdate as t, ['gennaio','Febbraio','MAR','apr','maggio','Giugno','lug','agosto','Sett','ottobre','nov','dicembre'][month(o_orderdate)] as name from orders)
    select o_orderkey, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then strftime(t, '%Y-%m-%d') else cast(year(t) as varchar) || '-' || lpad(cast(month(t) as varchar), 2, '0') || '-' || lpad(cast(dayofmonth(t) as varchar), 2, '0') end as iso from m""")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    t, k = F.col("o_orderdate"), F.col("o_orderkey")
    months = F.array(*map(F.lit, ["gennaio", "Febbraio", "MAR", "apr", "maggio", "Giugno", "lug", "agosto", "Sett", "ottobre", "nov", "dicembre"]))
    month = F.when(k % 4 == 0, "").when(k % 4 == 1, F.date_format(t, "MM")).otherwise(F.get(months, F.month(t) - 1))
    return d.table(spark, sf, "orders").select("o_orderkey", dates.iso_date(F.dayofmonth(t).cast("string"), month, F.year(t)).alias("iso"))


@query("F21 F23", """with texts as (select o_orderkey, case when o_orderkey % 6 = 0 then 'rinviata' else 'dom ' || case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%d/%m/%Y') else strftime(o_orderdate, '%d-%m-%y') end || ' ore 9' end as text from orders)
    select o_orderkey, nullif(regexp_extract(text, '(\\d{1,2})[-./\\s](\\d{1,2}|[a-zA-Z]{3,})[-./\\s](\\d{2,4})', 1), '') as day, nullif(regexp_extract(text, '(\\d{1,2})[-./\\s](\\d{1,2}|[a-zA-Z]{3,})[-./\\s](\\d{2,4})', 2), '') as month, nullif(regexp_extract(text, '(\\d{1,2})[-./\\s](\\d{1,2}|[a-zA-Z]{3,})[-./\\s](\\d{2,4})', 3), '') as year from texts""")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 6 == 0, "rinviata").otherwise(F.concat(F.lit("dom "), F.when(k % 2 == 0, F.date_format(t, "dd/MM/yyyy")).otherwise(F.date_format(t, "dd-MM-yy")), F.lit(" ore 9")))
    return d.table(spark, sf, "orders").select("o_orderkey", dates.european_parts(text).alias("p")).select("o_orderkey", "p.*")


@query("F22", """select o_orderkey, list_aggregate(list_transform(string_split(cast(dayofmonth(o_orderdate) as varchar) || '-' || cast(dayofmonth(o_orderdate) + 1 as varchar), '-'), lambda x: cast(year(o_orderdate) as varchar) || '-' || lpad(cast(month(o_orderdate) as varchar), 2, '0') || '-' || lpad(x, 2, '0')), 'string_agg', ' ') as days from orders""")
def days_dates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("o_orderdate")
    text = F.concat(F.dayofmonth(t).cast("string"), F.lit("-"), (F.dayofmonth(t) + 1).cast("string"), F.lit("/"), F.month(t).cast("string"))
    return d.table(spark, sf, "orders").select("o_orderkey", F.array_join(dates.days_of(text, F.year(t)), " ").alias("days"))


@query("F25 F26", """select o_orderkey, cast(cast(o_orderdate as date) - interval 36 month as date)::varchar as cutoff, (cast(o_orderdate as date) - 6)::varchar as week, strftime(o_orderdate, '%Y%m%d') as stamp from orders""")
def rolling_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return d.table(spark, sf, "orders").select("o_orderkey", F.add_months(day, -36).cast("string").alias("cutoff"), F.date_sub(day, 6).cast("string").alias("week"), F.date_format("o_orderdate", "yyyyMMdd").alias("stamp"))


NAME = "case c_custkey % 4 when 0 then 'Rossi' when 1 then '  Bianchi   Anna' when 2 then case when c_custkey % 8 = 2 then 'De Luca Maria' else 'Verdi Anna Maria' end else 'Della Torre Carlo D`Amico' end"


def name_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "Rossi").when(k % 4 == 1, "  Bianchi   Anna").when(k % 4 == 2, F.when(k % 8 == 2, "De Luca Maria").otherwise("Verdi Anna Maria")).otherwise("Della Torre Carlo D`Amico")
    return d.table(spark, sf, "customer").select("c_custkey", text.alias("text"))


@query("F30 F32 F33", f"""with t as (select c_custkey, string_split(trim(regexp_replace(replace({NAME}, '`', ''''), ' +', ' ', 'g')), ' ') as w from customer),
    h as (select *, case when len(w) > 3 or (len(w) = 3 and upper(w[1]) in ({', '.join(f"'{p}'" for p in names.PARTICLES)})) then 2 else 1 end as n from t)
    select c_custkey, list_aggregate(w[1:n], 'string_agg', ' ') as last_name, case when len(w) > 1 then list_aggregate(w[n + 1:], 'string_agg', ' ') end as first_name from h""")
def split_names(spark: SparkSession, sf: str) -> DataFrame:
    return name_texts(spark, sf).select("c_custkey", names.split_name(F.col("text")).alias("n")).select("c_custkey", "n.*")


@query("F31", f"""with t as (select c_custkey, case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then 'DE' else 'Neri' end as l, case when c_custkey % 5 = 0 then 'Luca Maria' else 'Ugo' end as f from customer)
    select c_custkey, not (l = '' or f = '' or (upper(l) in ({', '.join(f"'{p}'" for p in names.PARTICLES)}) and contains(f, ' '))) as reliable from t""")
def reliable_parts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    last, first = F.when(k % 3 == 0, "").when(k % 3 == 1, "DE").otherwise("Neri"), F.when(k % 5 == 0, "Luca Maria").otherwise("Ugo")
    return d.table(spark, sf, "customer").select("c_custkey", (~(names.is_blank(last) | names.is_blank(first) | (F.upper(last).isin(names.PARTICLES) & first.contains(" ")))).alias("reliable"))


@query("F34 F36", """select c_custkey, upper(trim(regexp_replace(translate('Nicolò ' || c_name || '  D’Élia', 'òÉ’', 'oE'''), ' +', ' ', 'g'))) as swimmer, regexp_replace(lower('A.S.D. ' || c_name), '[^a-z0-9]', '', 'g') as label from customer""")
def normalized_swimmers(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Nicolò "), F.col("c_name"), F.lit("  D’Élia"))
    return d.table(spark, sf, "customer").select("c_custkey", names.normalized_swimmer(text).alias("swimmer"), names.team_label(F.concat(F.lit("A.S.D. "), F.col("c_name"))).alias("label"))


def stripped(column: str) -> str:
    for word in names.ABBREVIATIONS:
        column = f"regexp_replace({column}, '\\b{word}\\b', '', 'g')"
    return f"trim(regexp_replace({column}, ' +', ' ', 'g'))"


@query("F35 F37", f"""with t as (select s_suppkey, case s_suppkey % 3 when 0 then 'A.S.D. ' || s_name when 1 then s_name || ' Ssd Srl' else 'Nuòto ' || s_name || ' S.S.' end as text, s_name from supplier)
    select s_suppkey, {stripped("upper(replace(translate(text, 'ò', 'o'), '.', ''))")} as team, (starts_with(upper(text), upper(s_name)) or starts_with(upper(s_name), upper(text))) and abs(length(text) - length(s_name)) < 9 as near from t""")
def normalized_teams(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_name")
    text = F.when(k % 3 == 0, F.concat(F.lit("A.S.D. "), n)).when(k % 3 == 1, F.concat(n, F.lit(" Ssd Srl"))).otherwise(F.concat(F.lit("Nuòto "), n, F.lit(" S.S.")))
    return d.table(spark, sf, "supplier").select("s_suppkey", names.normalized_team(text).alias("team"), names.almost_equal(text, n).alias("near"))


@query("F38", """with t as (select s_suppkey, case s_suppkey % 3 when 0 then 'Via Roma 1 - Riccione (RN)' when 1 then 'Reggio Emilia (RE); Via Melato 2' else 'Piscina - Via Po; Bologna' end as text from supplier),
    w as (select s_suppkey, regexp_split_to_array(text, '\\W*[-;]\\W*') as w from t),
    c as (select *, not regexp_matches(w[-1], '[(\\[]\\w+[)\\]]?') and regexp_matches(w[1], '[(\\[]\\w+[)\\]]?') as head from w)
    select s_suppkey, regexp_replace(case when head then w[1] else w[-1] end, '\\W*[(\\[].*$', '') as city, nullif(regexp_extract(case when head then w[1] else w[-1] end, '[(\\[](\\w+)', 1), '') as area, list_aggregate(case when head then w[2:] else w[:len(w) - 1] end, 'string_agg', '; ') as rest from c""")
def addresses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, "Via Roma 1 - Riccione (RN)").when(k % 3 == 1, "Reggio Emilia (RE); Via Melato 2").otherwise("Piscina - Via Po; Bologna")
    return d.table(spark, sf, "supplier").select("s_suppkey", names.tokenized_address(text).alias("a")).select("s_suppkey", "a.*")


@query("F39 F40 F41 F42", """select doc_id, trim(regexp_replace(regexp_replace(text, '\\r?\\n', '; ', 'g'), '[ \\t]+', ' ', 'g')) as line, regexp_replace(regexp_replace(lower('Finale ' || source || ' (2024)!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as file, regexp_extract('https://x.org/r/' || source || '/20240102/a.html', '/r/([^/]+)/(\\d{8})', 2) as day from documents""")
def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://x.org/r/"), F.col("source"), F.lit("/20240102/a.html"))
    return d.table(spark, sf, "documents").select("doc_id", names.normalized_text(F.col("text")).alias("line"), names.file_safe(F.concat(F.lit("Finale "), F.col("source"), F.lit(" (2024)!"))).alias("file"), F.regexp_extract(url, "/r/([^/]+)/(\\d{8})", 2).alias("day"))


@query("F43 F44 J14", d.sql("swimmers", """, k as (select swimmer_id, case when swimmer_id % 3 = 0 then '' else gender end || '|' || upper(name) || '|ANNA|' || cast(year_of_birth as varchar) || '|TEAM' as key from swimmers)
    select swimmer_id, key, '|' || split_part(key, '|', 2) || '|' || split_part(key, '|', 3) || '|' || split_part(key, '|', 4) as partial, case when swimmer_id % 3 = 0 then null else upper(key[1:1]) end as gender from k"""))
def swimmer_keys(spark: SparkSession, sf: str) -> DataFrame:
    g = F.when(F.col("swimmer_id") % 3 != 0, F.col("gender"))
    keys = d.swimmers(spark, sf).select("swimmer_id", names.swimmer_key(g, F.upper("name"), F.lit("ANNA"), F.col("year_of_birth"), F.lit("TEAM")).alias("key"))
    return keys.select("swimmer_id", "key", names.partial_key(F.col("key")).alias("partial"), names.gender_code(F.get(F.split("key", "\\|"), F.lit(0))).alias("gender"))


@query("F46 K06", """select c_custkey, 'UPDATE customers SET name = ''' || replace('D''' || c_name, '''', '''''') || ''' WHERE id = ' || cast(c_custkey as varchar) || ';' as statement from customer""")
def sql_literals(spark: SparkSession, sf: str) -> DataFrame:
    name = names.sql_literal(F.concat(F.lit("D'"), F.col("c_name")))
    return d.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("UPDATE customers SET name = "), name, F.lit(" WHERE id = "), F.col("c_custkey").cast("string"), F.lit(";")).alias("statement"))


TITLE_SQL = "['50 stile libero', '4x50m Misti', '100m dorso', '200 - rana', '4x100 sl', 'apertura', '100 Farfalla M25', '400 mx'][1 + p_partkey % 8]"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    every = F.array(*map(F.lit, ["50 stile libero", "4x50m Misti", "100m dorso", "200 - rana", "4x100 sl", "apertura", "100 Farfalla M25", "400 mx"]))
    return d.table(spark, sf, "part").select("p_partkey", F.get(every, (F.col("p_partkey") % 8).cast("int")).alias("title"))


_x = lambda k: f"regexp_extract(title, '{events.TITLE}', {k})"
_stroke = "case " + " ".join(f"when regexp_matches({_x(3)}, '(?i){p}') then '{c}'" for c, p in events.STROKES) + " end"


@query("F50 F53 F54 F56", f"""with t as (select p_partkey, {TITLE_SQL} as title from part), e as (select p_partkey, title, coalesce(try_cast({_x(1)} as integer), 1) as n, try_cast({_x(2)} as integer) as len, {_stroke} as s from t)
    select p_partkey, case when len is not null then n end as phases, n * len as length, case when len is null then null when s = 'MI' and n > 1 then 'MX' else s end as stroke, regexp_matches(title, '(?i)(4|6|8)x\\d{{2,3}}') as relay from e""")
def parse_events(spark: SparkSession, sf: str) -> DataFrame:
    t = titles(spark, sf)
    return t.select("p_partkey", events.parse_event(F.col("title")).alias("e"), events.is_relay(F.col("title")).alias("relay")).select("p_partkey", "e.*", "relay")


_normal = "title"
for _p, _c in events.NORMAL:
    _normal = f"regexp_replace({_normal}, '(?i){_p}', '{_c}', 'g')"


_KNOWN = [code for code, *_ in d.RELAY_BANDS] + ["60-79"]
_CODES = "case p_partkey % 6 when 0 then 'M80' when 1 then 'm120 ' when 2 then '80X' when 3 then '160' when 4 then 'u80' end"


@query("F57 F58", f"""with t as (select p_partkey, {_CODES} as code from part) select p_partkey, case when regexp_matches(code, '(?i)^\\d{{2,3}}x?$') then 'M' || code else upper(code) end as category,
    case when code = '80X' then '60-79' when code = '160' then '160-199' else upper(code) end as relay,
    case p_partkey % 6 when 0 then '80-99' when 1 then '120-159' when 4 then '60-79' else '000-999' end as band from t""")
def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    code = F.when(k == 0, "M80").when(k == 1, "m120 ").when(k == 2, "80X").when(k == 3, "160").when(k == 4, "u80")
    part = d.table(spark, sf, "part").select("p_partkey", code.alias("code"))
    return part.select("p_partkey", events.category_code(F.col("code")).alias("category"), events.relay_category_code(F.col("code"), _KNOWN).alias("relay"), events.relay_band(F.col("code")).alias("band"))


@query("F51 F52 F55 F58", f"""with t as (select p_partkey, {TITLE_SQL} as title from part) select p_partkey, {_normal} as normal, case title when '4x50m Misti' then 'S4X50MX' when '4x100 sl' then 'S4X100SL' end as relay, case when p_partkey % 2 = 0 then 'M' || cast(25 + 5 * (p_partkey % 4) as varchar) else 'U25' end as category, cast(80 + 40 * (p_partkey % 5) as varchar) || '-' || cast(80 + 40 * (p_partkey % 5) + 19 as varchar) as ages from t""")
def event_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.when(k % 2 == 0, (25 + 5 * (k % 4)).cast("string")).otherwise("U25")
    return titles(spark, sf).select("p_partkey", events.normalized_title(F.col("title")).alias("normal"), events.relay_code(F.col("title")).alias("relay"), events.category_code(code).alias("category"), events.relay_range(80 + 40 * (k % 5)).alias("ages"))


@query("F45 F59 F60", """select p_partkey, case when p_partkey % 3 = 0 then 'F' when p_partkey % 3 = 1 then 'M' else 'X' end as gender, split_part('1-50SL-M' || cast(25 + p_partkey % 30 as varchar) || '-F', '-', 3) as category from part""")
def header_genders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    header = F.when(k % 3 == 0, "50 SL Femmine").when(k % 3 == 1, "50 SL Maschi").otherwise("4x50 Misti")
    gender = F.when(header.rlike("(?i)femm|donne|women"), "F").when(header.rlike("(?i)masch|uomini|\\bmen"), "M").otherwise("X")
    key = F.concat(F.lit("1-50SL-M"), (25 + k % 30).cast("string"), F.lit("-F"))
    return d.table(spark, sf, "part").select("p_partkey", gender.alias("gender"), F.get(F.split(key, "-"), F.lit(2)).alias("category"))


@query("P01 P02 P04 P05 P06", """select c_custkey, c_name from customer where (c_name like '%ust%er#%00%' or starts_with(c_name, 'Customer#0000001')) and (contains(lower(coalesce(c_name, '')), 'omer') or contains(lower(c_mktsegment), 'omer'))""")
def text_filters(spark: SparkSession, sf: str) -> DataFrame:
    c, q = d.table(spark, sf, "customer"), "omer"
    words = F.array_join(F.slice(F.split(F.lit("ust er# 00 zz"), " "), 1, 3), "%")
    like = F.like("c_name", F.concat(F.lit("%"), words, F.lit("%")))
    has = F.lit(len(q) < 3) | F.lower(F.coalesce("c_name", F.lit(""))).contains(q) | F.lower("c_mktsegment").contains(q)
    return c.where((like | F.col("c_name").startswith("Customer#0000001")) & has).select(*[x for x in ("c_custkey", "c_name", "c_nickname") if x in c.columns])


@query("P07 P08 P10 P16 P18", """select c_custkey, coalesce(pct, 0) < 89 or conflict as review, lower(trim(edited)) <> lower(trim(c_name)) and trim(edited) <> '' as edited, case when c_custkey % 2 = 0 then '✔' else '-' end as mark, c_name || ' (' || coalesce(cast(pct as varchar), '?') || '%)' as label
    from (select c_custkey, c_name, case when c_custkey % 5 > 0 then c_custkey % 100 end as pct, c_custkey % 17 = 0 as conflict, case c_custkey % 3 when 0 then '' when 1 then ' ' || upper(c_name) else c_name || 'x' end as edited from customer)""")
def review_predicates(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_name")
    pct = F.when(k % 5 > 0, k % 100)
    edited = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" "), F.upper(n))).otherwise(F.concat(n, F.lit("x")))
    same = F.lower(F.btrim(edited)) != F.lower(F.btrim(n))
    return d.table(spark, sf, "customer").select("c_custkey", ((F.coalesce(pct, F.lit(0)) < 89) | (k % 17 == 0)).alias("review"), (same & (F.btrim(edited) != "")).alias("edited"), F.when(k % 2 == 0, "✔").otherwise("-").alias("mark"), F.concat(n, F.lit(" ("), F.coalesce(pct.cast("string"), F.lit("?")), F.lit("%)")).alias("label"))


@query("P09 P10 P11 P12 P13", d.sql("results badges", """, issues as (select r.relay_id, r.mir_id, b.club is null as no_badge, r.hundredths = 0 as no_time, s.year_of_birth > 2000 as odd_year from results r
    left join (select * from badges where club < 4) b on b.season = r.season and b.swimmer_id = r.swimmer_id and b.club = r.team_id % 5 join (select c_custkey as swimmer_id, 1940 + c_custkey % 65 as year_of_birth from customer) s on s.swimmer_id = r.swimmer_id)
    select relay_id, count(*) filter (where no_badge or no_time or odd_year) as issues, bool_or(no_badge) as any_badge, bool_or(no_time) as any_time from issues group by 1 having count(*) filter (where no_badge or no_time or odd_year) > 0"""))
def relays_with_issues(spark: SparkSession, sf: str) -> DataFrame:
    r = d.results(spark, sf).withColumn("club", F.col("team_id") % 5)
    b = d.badges(spark, sf).where("club < 4").withColumn("has", F.lit(True))
    rows = r.join(b, ["season", "swimmer_id", "club"], "left").join(d.swimmers(spark, sf), "swimmer_id")
    no_badge, no_time, odd = F.col("has").isNull(), F.col("hundredths") == 0, F.col("year_of_birth") > 2000
    return rows.groupBy("relay_id").agg(F.count_if(no_badge | no_time | odd).alias("issues"), F.bool_or(no_badge).alias("any_badge"), F.bool_or(no_time).alias("any_time")).where("issues > 0")
