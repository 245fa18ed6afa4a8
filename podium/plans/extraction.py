"""Queries of extraction: documents are rendered from results, and reading them must give the results back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.functions.layout import Context, Field, Layout
from podium.plans import domain as d
from podium.plans.registry import query
from podium.sources import files, html, layouts
from podium.sources.shared import scratch


PAGE_SQL = """, p as (select meeting_id, event, pool, swimmer_id, hundredths, mir_id, row_number() over (partition by meeting_id, event, pool order by hundredths, mir_id) as place from results where hundredths > 0)"""


def programs(spark: SparkSession, sf: str) -> DataFrame:
    r = d.results(spark, sf).where("hundredths > 0")
    return r.withColumn("place", F.row_number().over(Window.partitionBy("meeting_id", "event", "pool").orderBy("hundredths", "mir_id")))


@query("S07 S08", d.sql("results", PAGE_SQL + """ select meeting_id, dense_rank() over (partition by meeting_id order by event, pool) - 1 as page, place as line, cast(place as varchar) || ' ' || cast(swimmer_id as varchar) || ' ' || cast(hundredths as varchar) as value from p"""))
def paged_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(" ", F.col("place").cast("string"), F.col("swimmer_id").cast("string"), F.col("hundredths").cast("string"))
    pages = programs(spark, sf).groupBy("meeting_id", "event", "pool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("x")))), lambda s: s["x"]), "\r\n").alias("body"))
    body = F.concat(F.lit("PROGRAM\r\n"), F.col("body"))
    texts = pages.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event", "pool", body.alias("x")))), lambda s: s["x"]), "\f").alias("text"))
    lines = files.paged_lines(texts, "text", ["meeting_id"]).where("line > 0")
    return lines.withColumns({"page": F.col("page").cast("long"), "line": F.col("line").cast("long")})


@query("S05 K01 F75", """select p_partkey, p_brand, p_size from part""")
def sniffed_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    d.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size").write.csv(path, sep=";", header=True)
    df = files.read_sniffed_csv(spark, path, ["p_partkey", "p_brand", "p_size"])
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_size").cast("int").alias("p_size"))


@query("S06 K05", """select o_orderkey % 2 = 0 as "isCancelled", 'M' || cast(o_orderkey as varchar) as name, case when o_orderkey % 3 = 0 then null else 'place' end as place, cast(year(o_orderdate) as integer) as year from orders""")
def calendar_csv(spark: SparkSession, sf: str) -> DataFrame:
    path, k = scratch(spark, "calendar"), F.col("o_orderkey")
    rows = d.table(spark, sf, "orders").select(F.lit("u").alias("startURL"), F.lit("1/1").alias("date"), F.when(k % 2 == 0, "Annullata").otherwise("").alias("isCancelled"), F.concat(F.lit(" M"), k.cast("string")).alias("name"), F.when(k % 3 == 0, " ").otherwise("place").alias("place"), F.lit("m").alias("meetingUrl"), F.year("o_orderdate").alias("year"))
    files.write_grid(rows, path, {c: c for c in rows.columns})
    return files.read_calendar(spark, path).select("isCancelled", "name", "place", "year")


@query("K08 S03", """select c_custkey, c_name, c_nationkey from customer""")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "json")
    c = d.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    c.write.json(path)
    return spark.read.schema(c.schema).json(path)


@query("S09 S10 S12 W11", d.sql("results", PAGE_SQL + """ select meeting_id, row_number() over (partition by meeting_id order by event, pool, place) - 1 as row, event || ' ' || cast(pool as varchar) as category, cast(swimmer_id as varchar) as swimmer, cast(hundredths as varchar) as timing, case when place % 2 = 0 then 'b' end as split from p"""))
def html_results(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.concat(F.lit("<tr class='result'><td>"), F.col("swimmer_id").cast("string"), F.lit("<td> "), F.col("hundredths").cast("string"), F.lit(" </td></tr>"), F.when(F.col("place") % 2 == 0, "<tr class=continued><td><b>b</b></td>").otherwise(""))
    per = programs(spark, sf).groupBy("meeting_id", "event", "pool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", cells.alias("x")))), lambda s: s["x"]), "").alias("rows"))
    table = F.concat(F.lit("<tr class='header'><th>"), F.col("event"), F.lit("</th><th>"), F.col("pool").cast("string"), F.lit("</th></tr>"), F.col("rows"))
    pages = per.groupBy("meeting_id").agg(F.concat(F.lit("<html><table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event", "pool", table.alias("x")))), lambda s: s["x"]), "\n"), F.lit("</table>")).alias("html"))
    c = F.col("cells")
    return html.ranking_rows(pages, "meeting_id").select(F.col("meeting_id").cast("int").alias("meeting_id"), F.col("row").cast("long").alias("row"), "category", F.get(c, F.lit(0)).alias("swimmer"), F.get(c, F.lit(1)).alias("timing"), F.get(c, F.lit(2)).alias("split"))


#: Two layouts of our own for the rendered pages: with and without a place before the result.
LAYOUTS = [
    Layout("placed", (
        Context("meeting", r"^MEETING \d+", (Field("code", r"MEETING (\d+)"),)),
        Context("event", r"^EVENT ", (Field("event", r"EVENT (\w+)"), Field("pool", r"\b(1|2)\b"))),
        Context("result", r"^\s*\d+\. \d+ +\d+'\d\d", (Field("place", r"^\s*(\d+)\."), Field("swimmer", r"(\d+) "), Field("timing", r"(\d+'\d\d\"\d\d)")), repeat=True, parent="event"),
    )),
    Layout("plain", (
        Context("event", r"^EVENT ", (Field("event", r"EVENT (\w+)"), Field("pool", r"\b(1|2)\b"))),
        Context("result", r"^\d+ \d+'\d\d", (Field("swimmer", r"^(\d+)"), Field("timing", r"(\d+'\d\d\"\d\d)")), repeat=True, parent="event"),
        Context("note", r"^NOTE", required=False),
    )),
]


@query("R01 R02 R09 X02", d.sql("results", PAGE_SQL + """, t as (select *, cast(hundredths // 6000 as varchar) || '''' || lpad(cast(hundredths // 100 % 60 as varchar), 2, '0') || '"' || lpad(cast(hundredths % 100 as varchar), 2, '0') as timing, meeting_id % 2 = 0 as placed from p)
    select meeting_id, event, pool, case when placed then 'placed' else 'plain' end as layout, case when placed then cast(place as varchar) end as place, cast(swimmer_id as varchar) as swimmer, timing from t"""))
def layout_results(spark: SparkSession, sf: str) -> DataFrame:
    from podium.functions.timing import format_timing

    placed = F.col("meeting_id") % 2 == 0
    line = F.concat(F.when(placed, F.concat(F.lit("  "), F.col("place").cast("string"), F.lit(". "))).otherwise(""), F.col("swimmer_id").cast("string"), F.when(placed, "  ").otherwise(" "), format_timing(F.col("hundredths")))
    per = programs(spark, sf).groupBy("meeting_id", "event", "pool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("x")))), lambda s: s["x"]), "\n").alias("rows"))
    head = F.when(placed, F.concat(F.lit("MEETING "), F.col("meeting_id").cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(head, F.lit("\nEVENT "), F.col("event"), F.lit(" pool "), F.col("pool").cast("string"), F.lit("\n"), F.col("rows"), F.when(placed, "").otherwise("\nNOTE end"))
    rows = layouts.layout_rows(per.select("meeting_id", "event", "pool", text.alias("text")), LAYOUTS, ["meeting_id", "event", "pool"])
    f = F.col("fields")
    return rows.where("context = 'result'").select("meeting_id", "event", "pool", "layout", f["place"].alias("place"), f["swimmer"].alias("swimmer"), f["timing"].alias("timing"))


@query("R07 F37 A01", d.sql("results", """select season, event, pool, swimmer_id, l.t as team_id, l.h as hundredths, rows from (select season, event, pool, swimmer_id, max({'m': mir_id, 't': team_id, 'h': hundredths}) as l, count(*) as rows from results group by 1, 2, 3, 4)"""))
def merged_section_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = ["season", "event", "pool", "swimmer_id"]
    last = d.results(spark, sf).groupBy(*key).agg(F.max(F.struct("mir_id", "team_id", "hundredths")).alias("l"), F.count("*").alias("rows"))
    return last.select(*key, "l.team_id", "l.hundredths", "rows")
