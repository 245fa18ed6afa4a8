"""Operators on small tables, where each case has a known result."""

import datetime
import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from podium.functions import dates, events, headers, names, timing
from podium.functions.layout import Context, Field, Layout, read_page
from podium.functions.similarity import Texts, winkler
from podium.operators import changes, ranking, relational, resolve
from podium.operators.components import connected_components
from podium.sources import files, html, layouts
from podium.streaming import queues, usage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("1'23\"45", 8345), ("59.5", 5950), ('12"34.56', 1234), ("1 02 03", 6203), ("DNS", None), (None, None), ("", None), ("2:03.4", 12340)])
def test_timings(spark, text, want):
    assert one(spark, timing.parse_timing(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("1'23", 8300), ("1`23", 8300), (None, 0), ("x", 0)])
def test_staging_timings(spark, text, want):
    assert one(spark, timing.parse_timing_staging(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("1.044,06", 1.044), ("'12,5", 12.5), ("n.d.", 0.0), (None, 0.0), ("_7_", 7.0)])
def test_scores(spark, text, want):
    assert one(spark, timing.parse_score(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("Rossi", ("Rossi", None)), ("De Luca Maria", ("De Luca", "Maria")), ("Verdi Anna Maria", ("Verdi", "Anna Maria")), ("A B C D", ("A B", "C D")), ("  ", None), (None, None)])
def test_names(spark, text, want):
    got = one(spark, names.split_name(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


def test_keys_keep_their_bars(spark):
    key = names.swimmer_key(F.lit(None).cast("string"), F.lit("ROSSI"), F.lit("ANNA"), F.lit(1970), F.lit("TEAM"))
    assert one(spark, key) == "|ROSSI|ANNA|1970|TEAM"
    assert one(spark, names.partial_key(key)) == "|ROSSI|ANNA|1970"
    assert one(spark, names.partial_key(F.lit("ROSSI|ANNA|1970|TEAM"))) == "|ROSSI|ANNA|1970"


def test_dates(spark):
    assert one(spark, dates.iso_date(F.lit("5"), F.lit("Settembre"), F.lit("2023"))) == "2023-09-05"
    assert one(spark, dates.iso_date(F.lit(" "), F.lit("set"), F.lit("2023"))) is None
    assert one(spark, dates.iso_date(F.lit("5"), F.lit("zzz"), F.lit("2023"))) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("lun 15 Sett 2023", ("15", "Sett", "2023")), ("mer, 15/4/2001", ("15", "4", "2001")), ("25-12-1965", ("25", "12", "1965")), ("5 7 2023", ("5", "7", "2023")),
        ("15-16 Sett 2023", ("16", "Sett", "2023")), ("17/18 Dic 2024", ("18", "Dic", "2024")), ("lun 15, mar 16 Sett 2023", ("16", "Sett", "2023")), ("lun 15..mar 16 Sett 2023", ("16", "Sett", "2023")),
        ("4-5/Mar/2008", ("5", "Mar", "2008")), ("7,8,10 Mar 2014", ("10", "Mar", "2014")), ("7,8,10,11 Marzo 2014", ("11", "Marzo", "2014")), ("8...11 Feb 2010", ("11", "Feb", "2010")),
        ("rinviata", (None, None, None)), ("", (None, None, None)), (None, (None, None, None)), ("12 ore 9", (None, None, None)),
    ],
)
def test_european_dates(spark, text, want):
    assert tuple(one(spark, dates.european_parts(F.lit(text).cast("string")))) == want


def test_relay_codes(spark):
    assert one(spark, events.relay_code(F.lit("4x50m stile"))) == "S4X50SL"
    with pytest.raises(Exception, match="unknown stroke"):
        one(spark, events.relay_code(F.lit("4x50m zzz")))


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.9611111111111111), ("", "", 0.0), ("a", "", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, want):
    assert winkler([a], [b])[0] == pytest.approx(want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(pairs, "src long, dst long"), resolve.kept)
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in parent}


def test_a_long_chain_is_one_component(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(chain, resolve.kept)
    assert got.count() == 201
    assert got.select("component").distinct().first().component == 0


def test_later_twins_have_no_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, k string")
    assert [r.id for r in relational.later_twins(df, ["k"], [F.col("id")]).collect()] == [2]


def test_diffs_never_write_blanks(spark):
    stored = spark.createDataFrame([(1, "x", 5, True)], "id long, name string, n int, flag boolean")
    new = spark.createDataFrame([(1, " ", 0, False), (2, "y", None, True)], "id long, name string, n int, flag boolean")
    assert {tuple(r) for r in changes.diff_rows(new, stored, "id", ["name", "n", "flag"]).collect()} == {(1, "n", "0"), (2, "name", "y"), (2, "flag", "true")}


def test_changes_apply(spark):
    stored = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id long, name string, n int")
    new = spark.createDataFrame([(1, "z", 7)], "id long, name string, n int")
    after = changes.applied(stored, changes.diff_rows(new, stored, "id", ["name", "n"]), "id")
    assert {tuple(r) for r in after.collect()} == {(1, "z", 7), (2, "y", 6)}


def test_pages(spark):
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate([60, 30, 20, 120, 10])], "m long, o long, s long")
    got = {r.o: r.page for r in ranking.greedy_pages(df, ["m"], "o", "s", 100).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}


def test_sniffed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code;label\nM25;x,y\n")
    assert [tuple(r) for r in files.read_sniffed_csv(spark, str(tmp_path / "a.csv"), ["code", "label"]).collect()] == [("M25", "x,y")]
    with pytest.raises(ValueError, match="no separator"):
        files.read_sniffed_csv(spark, str(tmp_path / "a.csv"), ["other"])


def test_paged_texts_and_sequences(spark, tmp_path):
    (tmp_path / "07-x.txt").write_text("a\nb\fc\n")
    (tmp_path / "12-y.txt").write_text("d")
    rows = {(r.path[-8:], r.page, r.line, r.value) for r in files.read_paged_texts(spark, str(tmp_path)).collect()}
    assert ("07-x.txt", 1, 0, "c") in rows
    assert ("07-x.txt", 0, 1, "b") in rows
    assert files.next_sequence(spark, str(tmp_path)) == 13
    assert files.next_sequence(spark, str(tmp_path / "none")) == 0


def test_replacement_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_with_backup(spark.range(2), path)
    files.replace_with_backup(spark.range(5), path)
    assert (spark.read.parquet(path).count(), spark.read.parquet(f"{path}.bak").count()) == (5, 2)


def test_html_rows_survive_bad_pages():
    assert html.table_rows(None) == []
    assert html.table_rows("<table><tr class=a><td>1<td>2<tr><th>x &amp; y</table>") == [("a", ["1", "2"]), ("", ["x & y"])]


def test_layouts():
    layout = Layout("l", (Context("head", "^HEAD", (Field("n", r"(\d+)"),)), Context("row", r"^\d+ ", (Field("a", r"^(\d+)"), Field("b", r"(\w+)$")), repeat=True), Context("foot", "^END", required=False)))
    name, found = read_page("HEAD 7\n1 x\n2 y\nEND", [layout])
    assert name == "l"
    assert [(c, f) for c, _, f in found] == [("head", {"n": "7"}), ("row", {"a": "1", "b": "x"}), ("row", {"a": "2", "b": "y"}), ("foot", {})]
    assert read_page("1 x", [layout]) == (None, [])
    assert read_page("  ", [layout]) == (None, [])


def test_streams_take_new_files(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double"
    day = datetime.datetime(2024, 1, 1)
    folder.mkdir()

    def land(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        for k, f in enumerate((tmp_path / name).glob("*.parquet")):
            f.rename(folder / f"{name}-{k}.parquet")

    land("a", [(1, 1, day, "view", 1.0), (2, 2, day, "view", 2.0)])
    stream = spark.readStream.schema(schema).parquet(str(folder))
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    usage.run_now(usage.latest_states(stream), table, checkpoint, "update", ["user_id"])
    assert usage.run_now(usage.daily_usage(stream), str(tmp_path / "t2"), str(tmp_path / "c2")).first()["count"] == 2
    seen = usage.Progress()
    spark.streams.addListener(seen)
    land("b", [(3, 1, day + datetime.timedelta(days=1), "error", 3.0)])
    left = usage.run_now(usage.latest_states(stream), table, checkpoint, "update", ["user_id"])
    spark.streams.removeListener(seen)
    assert {r.user_id: r.event_type for r in left.collect()} == {1: "error", 2: "view"}


def test_drop_folder(spark, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "a.json").write_text('{"k": 1}\n')
    stream = usage.drop_folder(spark, str(tmp_path / "new"), str(tmp_path / "done"), "k long")
    assert usage.run_now(stream, str(tmp_path / "t"), str(tmp_path / "c"), "append").first().k == 1


def test_the_readme_claims_only_upserts_that_are_built():
    from pathlib import Path

    from podium.plans.changes import ENTITIES

    coverage = (Path(__file__).parent.parent / "README.md").read_text().split("Without a query")[0]
    claimed = {x.split()[0] for line in coverage.splitlines() if line.startswith("* N01") for x in line[2:].split(". ")[0].split("; ") if "`entity_upserts`" in x}
    assert claimed == {row for row, _ in ENTITIES.values()}


def test_result_keys_fit_at_any_size():
    orders, parts, suppliers = 6_000_000_000, 200_000_000, 10_000_000  # a thousand times a gigabyte
    key = (orders * 8 + 7) * 8388608 + 8388592
    assert key * 4 + 3 < 2**63
    assert parts * 100003 + suppliers < 2**63
    # order by order, then line, whatever part and supplier
    assert (5 * 8 + 1) * 8388608 + 8388592 < (5 * 8 + 2) * 8388608


def test_relay_bands(spark):
    from podium.functions import events, timing

    codes = [("M80", "80-99"), ("M100", "100-119"), ("m120", "120-159"), ("M240", "240-279"), ("U80", "60-79"), ("", "000-999"), (None, "000-999"), ("X", "000-999")]
    df = spark.createDataFrame(codes, "code string, band string").withColumn("got", events.relay_band(F.col("code")))
    assert [r.got for r in df.collect()] == [b for _, b in codes]
    known = ["80-119", "160-199", "60-79"]
    got = spark.createDataFrame([("80X",), ("160",), ("999",), ("abs",)], "c string").select(events.relay_category_code(F.col("c"), known)).collect()
    assert [r[0] for r in got] == ["60-79", "160-199", None, "ABS"]
    assert spark.range(1).select(events.relay_range(F.lit(240))).first()[0] == "240-259"
    timings = spark.createDataFrame([("1:00.66",), ("NT",), ("DSQ-",), ("35.20",)], "t string").select(timing.convert_timing(F.col("t"))).collect()
    assert [r[0] for r in timings] == ["1'00.66", "NT", "DSQ-", "35.20"]


def plain_jaro_winkler(a, b):
    """By the definition, character by character."""
    reach, taken, mine = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if at is not None:
            taken.add(at)
            mine.append(c)
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(mine, sorted(taken), strict=True)) // 2
    plain = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return plain + prefix * 0.1 * (1 - plain) if plain > 0.7 else plain


def test_similarities_of_a_batch_are_those_of_its_pairs():
    r = random.Random(8)
    texts = ["".join(r.choice("abcdeé ") for _ in range(r.randint(0, 14))) for _ in range(600)]
    a, b = texts[:300], texts[300:]
    assert max(abs(x - plain_jaro_winkler(p, q)) for x, p, q in zip(winkler(a, b), a, b, strict=True)) < 1e-12


@pytest.mark.parametrize("least", [0.8, 0.89, 0.95])
@pytest.mark.parametrize("block", [[], ["g"]])
def test_the_index_of_names_loses_none(spark, least, block):
    r = random.Random(int(least * 100))
    names = ["".join(r.choice("abcdefghilmnorstu ") for _ in range(r.randint(3, 16))) for _ in range(120)]
    for k in range(0, 120, 2):
        own = list(names[k])
        own[r.randrange(len(own))] = r.choice("abcxyz")
        names[k + 1] = "".join(own)
    names += [names[0], names[1], "", "a", "ab", "ba", "é", "aa"]
    df = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(names)] + [(999, None, 0)], "id long, name string, g int")
    got = {(x.query_id, x.row_id): x.weight for x in resolve.candidates(df, df, block, least).collect()}
    want = {(i, j): w for i, a in enumerate(names) for j, b in enumerate(names) if i != j and (not block or i % 2 == j % 2) and (w := plain_jaro_winkler(a, b)) >= least}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_the_index_compares_few_names(spark, monkeypatch):
    """Names of which few are alike: what is compared grows with the names, not with their square."""
    r, compared = random.Random(5), {}
    for size in (400, 1600):
        names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(size)]
        df = spark.createDataFrame([(n,) for n in names], "name string")
        bags = df.select(resolve.bag(F.col("name")).alias("bag")).distinct()
        compared[size] = resolve.similar_bags(bags, [], 0.95).count()
    assert compared[1600] < 6 * compared[400] < 6 * 2 * 400


@pytest.mark.parametrize(("least", "top", "smaller"), [(0.8, None, False), (0.8, None, True), (0.0, 2, False), (0.7, 1, False)])
def test_rows_in_tiles_are_those_of_all_pairs(spark, monkeypatch, least, top, smaller):
    """Tiles of few rows, names with more copies than a tile has rows, an empty name and a null."""
    monkeypatch.setattr(resolve, "JOINED", 0)
    monkeypatch.setattr(resolve, "TILE", 4)
    r = random.Random(8)
    names = ["".join(r.choice("abc ") for _ in range(r.randint(1, 8))) for _ in range(30)] + ["common"] * 11 + ["", "x" * 70, "x" * 69 + "y", None]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string").withColumn("b", F.col("id") % 2)
    got = resolve.candidates(df, df, ["b"], least, top=top, smaller=smaller)
    want = set()
    for i, a in enumerate(names):
        found = sorted((-winkler([a], [b])[0], j) for j, b in enumerate(names) if a is not None and b is not None and i % 2 == j % 2 and (i < j if smaller else i != j) and winkler([a], [b])[0] >= least)
        want |= {(i, j, -w) for w, j in found[:top]}
    assert {(x.query_id, x.row_id, x.weight) for x in got.collect()} == want
    tiles = resolve.block_sizes(df.where("name is not null"), df.where("name is not null"), ["b"])[3]
    assert tiles >= 25  # no row of the search holds a block


def test_two_names_of_a_row_count_as_one(spark, monkeypatch):
    monkeypatch.setattr(resolve, "JOINED", 0)
    df = spark.createDataFrame([(1, "ab", "nuoto"), (2, "nuoto", "cd"), (3, "zz", "yy")], "id long, name string, other string")
    assert [(x.query_id, x.row_id, x.weight) for x in resolve.candidates(df, df, [], 0.9, ["name", "other"], smaller=True).collect()] == [(1, 2, 1.0)]


def test_clusters_of_copies_need_no_pairs(spark, monkeypatch):
    """A thousand rows of one name, a chain of similar names over several tiles, names apart, an empty one."""
    monkeypatch.setattr(resolve, "TILE", 4)
    chain = ["abcdefghij", "abcdefghiz", "abcdefghyz", "abcdefgxyz", "abcdefwxyz"]
    rows = [(k, "common") for k in range(100, 1100)] + [(k, n) for k, n in enumerate(chain)] + [(50, "qqq"), (51, ""), (52, "")]
    got = {x.node: x.component for x in resolve.clusters(spark.createDataFrame(rows, "id long, name string"), 0.93).collect()}
    assert got == {**{k: 100 for k in range(100, 1100)}, **{k: 0 for k in range(5)}}


def test_texts_at_once_are_as_similar_as_one_by_one():
    r = random.Random(4)
    for width in (3, 9, 20, 40, 70):
        theirs, mine = (["".join(r.choice("abcé ") for _ in range(r.randint(0, width))) for _ in range(40)] for _ in range(2))
        texts = Texts(theirs)
        for text in sorted(mine):
            weight, (at, found) = winkler([text] * 40, theirs), texts.similar(text, 0.6)
            assert {k: w for k, w in enumerate(weight) if w >= 0.6} == dict(zip(at.tolist(), found.tolist(), strict=True))


class Taken:
    """Stands for a table of pages: keeps the function that mapInPandas gets."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        return run


PAGE_ID = StructType([StructField("id", LongType())])


def test_layout_rows_are_given_out_in_parts(monkeypatch):
    """A task doesn't hold the rows of all of its pages."""
    monkeypatch.setattr(layouts, "AT_ONCE", 10)
    plain = Layout("plain", (Context("event", r"^EVENT ", (Field("event", r"EVENT (\w+)"),)), Context("result", r"^\d+ ", (Field("n", r"^(\d+)"),), repeat=True, parent="event")))
    pages = pd.DataFrame([(k, "\n".join(["EVENT a", *(f"{n} x" for n in range(34))])) for k in range(3)], columns=["id", "text"])
    parts = list(layouts.layout_rows(Taken(PAGE_ID), [plain], ["id"])(iter([pages])))
    assert max(map(len, parts)) == 10
    assert [tuple(x) for x in pd.concat(parts)[["id", "n"]].to_numpy()] == [(k, n) for k in range(3) for n in range(35)]


def test_html_rows_are_given_out_in_parts(monkeypatch):
    page = "<table><tr class=header><th>a &amp; b</th></tr>" + "".join(f"<tr class=result><td>{n}<td> x&lt;y z </td></tr><tr class=continued><td><b>b</b> c</td>" for n in range(35))
    whole = list(html.results_of(page))
    assert whole == [("a & b", [str(n), "x<y z", "b c"]) for n in range(35)]
    monkeypatch.setattr(html, "AT_ONCE", 10)
    parts = list(html.ranking_rows(Taken(PAGE_ID), "id")(iter([pd.DataFrame([(1, page), (2, None), (3, page)], columns=["id", "html"])])))
    assert max(map(len, parts)) == 10
    assert sum(map(len, parts)) == 70
    for piece in (1, 2, 7, 30, 200):
        monkeypatch.setattr(html, "PIECE", piece)
        assert list(html.results_of(page)) == whole


QUEUED = "event_id long, user_id long, event_type string, ts timestamp"


def queue_files(spark, folder):
    """Five files of events in the order of time; an hour between events of a queue, a day between some."""
    r = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    events = sorted((start + datetime.timedelta(hours=r.randint(0, 200), seconds=k), r.randrange(6), r.choice(["purchase", "error", "view", "error"])) for k in range(400))
    rows = [(k, user, kind, at) for k, (at, user, kind) in enumerate(events)]
    for k in range(5):
        spark.createDataFrame(rows[k * 80 : k * 80 + 80], QUEUED).coalesce(1).write.parquet(f"{folder}/{k}")
    return rows


def plain_jobs(rows, open_after):
    jobs, out = {}, []
    for _, user, kind, at in rows:
        job = jobs.get(user)
        if job and at - job[1] > queues.IDLE:
            out.append((user, job[2], job[3], False, "idle"))
            job = None
        started, _, runs, failures = job or (at, at, 0, 0)
        job = (started, at, runs + 1, failures + (kind == "error"))
        if kind == "purchase" or job[2] >= queues.MOST_RUNS:
            out.append((user, job[2], job[3], kind == "purchase", "done" if kind == "purchase" else "given up"))
            job = None
        jobs[user] = job
    out += [(user, job[2], job[3], False, "idle") for user, job in jobs.items() if job and job[1] + queues.IDLE < open_after]
    return sorted(out)


def test_a_queue_that_is_killed_processes_nothing_twice(spark, tmp_path):
    rows = queue_files(spark, tmp_path / "in")
    stream = spark.readStream.schema(QUEUED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ended = queues.runs(stream, "user_id", "event_type = 'purchase'", "event_type = 'error'")
    want = plain_jobs(rows, rows[-1][3] - datetime.timedelta(hours=1))

    def jobs_of(df):
        return sorted((r.queue, r.process_runs, r.failures, r.done, r.ended) for r in df.collect())

    assert jobs_of(queues.append_now(ended, str(tmp_path / "whole"), str(tmp_path / "whole-state"))) == want
    # killed in the middle of the third batch, after its files are written
    before = spark.conf.get(queues.PROVIDER)
    spark.conf.set(queues.PROVIDER, queues.ROCKS)

    def dying(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / "killed" / f"batch={number}"))
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ended.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "killed-state")).trigger(availableNow=True).foreachBatch(dying).start().awaitTermination()
    spark.conf.set(queues.PROVIDER, before)
    assert jobs_of(queues.append_now(ended, str(tmp_path / "killed"), str(tmp_path / "killed-state"))) == want


@pytest.mark.parametrize(("text", "want"), [("Femminile 50 SL", "F"), ("  maschi", "M"), ("F - 100 DO", "F"), ("Misti 4x50", "X"), ("MIX", "X"), ("Master 80F", "F"), ("M95M", "M"), ("Master 120X", None), ("50 SL", None), ("", None), (None, None)])
def test_genders_of_headings(spark, text, want):
    assert one(spark, headers.header_gender(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("DE LUCA ANNA MARIA PIA", ("DE LUCA ANNA", "MARIA PIA")), ("ROSSI DE PAOLA", ("ROSSI DE", "PAOLA")), ("DELLA TORRE CARLO", ("DELLA TORRE", "CARLO")), ("ROSSI ANNA", ("ROSSI", "ANNA")), (" ROSSI ", ("ROSSI", "")), ("", ("", "")), (None, ("", ""))],
)
def test_crawled_names(spark, text, want):
    got = one(spark, headers.crawled_name(F.lit(text).cast("string")))
    assert (got.last_name, got.first_name) == want


def test_places_of_files_and_ages(spark):
    assert tuple(one(spark, headers.place_and_dates(F.lit("https://x.org/a/C1_2024_3_5-16_Roma_web.pdf")))) == ("Roma", "2024-03-05,2024-03-16")
    for other in ("https://x.org/C1_2024_3_5_Roma_web.pdf", "notes.pdf", "", None):
        assert tuple(one(spark, headers.place_and_dates(F.lit(other).cast("string")))) == (None, None)
    ages = [one(spark, headers.category_age(F.lit(1980), F.lit(x).cast("date"))) for x in ("2024-08-31", "2024-09-01", None)]
    assert ages == [44, 45, None]
