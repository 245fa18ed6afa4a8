"""Similarity join, decontamination, shards and the pipeline against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from podium.llm import common, decontaminate, jaccard_join, minhash, shards
from podium.llm.common import WordHashes
from tests.llm import rows


def ngrams(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_components(docs, n, percent):
    sets = {d: ngrams(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}


def copies(seed):
    r = random.Random(seed)
    docs = []
    for k in range(60):
        base = rows.prose(k, r.choice([8, 30, 120, 400])).split()
        for _ in range(r.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                words[r.randrange(len(words))] = r.choice(["new", "other", "words"])
            docs.append(" ".join(words))
    passage = rows.prose(999, 55)
    docs = [f"{t} {passage}" if k % 3 == 0 else t for k, t in enumerate(docs)]
    r.shuffle(docs)
    return [(k, t) for k, t in enumerate([None, "", "one", "two words", *docs])]


@pytest.mark.parametrize(("n", "percent", "small"), [(3, 90, 512), (5, 80, 512), (3, 90, 2), (5, 80, 2)])
def test_components_are_those_of_brute_force(spark, monkeypatch, n, percent, small):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", small)
    docs = copies(n * percent + small)
    got = jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string"), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain_components(docs, n, percent)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = copies(7)
    got = jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain_components(docs, 3, 90)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_search_is_exact(percent):
    r = np.random.default_rng(percent)
    base = r.integers(0, 2**63, 80).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = base[r.random(80) < r.choice([0.85, 0.95, 1.0])]
        sets.append(np.unique(np.concatenate([own, r.integers(0, 2**63, r.integers(1, 12)).astype(np.uint64)])))

    def closure(links):
        parent = list(range(len(sets)))
        for a, b in links:
            ra, rb = jaccard_join.union_root(parent, a), jaccard_join.union_root(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
        return [jaccard_join.union_root(parent, k) for k in range(len(sets))]

    pairs = [(a, b) for a in range(120) for b in range(a) if 100 * len(c := np.intersect1d(sets[a], sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - len(c))]
    assert closure(jaccard_join.search(sets, len(sets), percent)) == closure(pairs)
    across = jaccard_join.search(sets, 60, percent)
    assert all((a, b) in set(pairs) for a, b in across)
    assert closure(across) == closure([(a, b) for a, b in pairs if b < 60 <= a])


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    r, linked = np.random.default_rng(9), 0
    sign = jaccard_join.Signatures(percent, (jaccard_join.RARE // r.integers(1, 50, 1 << jaccard_join.BUCKET_BITS)).astype(np.int32))
    for _ in range(3000):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 150)).astype(np.uint64) * np.uint64(2))
        rate = 1 - (100 - percent) / 100 * r.random()
        b = np.unique(np.concatenate([a[r.random(len(a)) < rate], r.integers(0, 2**63, r.integers(0, 2 + len(a) * (100 - percent) // 100)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= percent * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
            linked += 1
            assert len(np.intersect1d(sign(a), sign(b)))
    assert linked > 300


def test_texts_that_share_a_passage_are_no_candidates():
    hashes, sign = WordHashes(), jaccard_join.Signatures(90)
    passage = rows.prose(999, 55)
    signed = [set(sign(jaccard_join.ngram_set(f"{rows.prose(k, 200)} {passage}".encode().split(), hashes, 3)).tolist()) for k in range(80)]
    assert sum(bool(a & b) for a, b in itertools.combinations(signed, 2)) == 0


def growing(size):
    """Groups of near copies, as many as the size asks for, and one group of a third of all texts."""
    r, docs = random.Random(size), []
    for k in range(size):
        words = rows.prose(k % (size // 3) if k % 3 else 10**6, 150).split()
        words[r.randrange(150)] = f"x{r.randrange(100)}"
        docs.append((k, " ".join(words)))
    return docs


def test_work_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    rows_of = {}
    for size in (150, 600):
        docs, counted = growing(size), []
        keep = jaccard_join.Tables.keep
        monkeypatch.setattr(jaccard_join.Tables, "keep", lambda self, df, name: (t := keep(self, df, name), counted.append(t.count()))[0])
        got = jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string"))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain_components(docs, 3, 90)
        rows_of[size] = max(counted)
        monkeypatch.setattr(jaccard_join.Tables, "keep", keep)
    assert rows_of[600] < 6 * rows_of[150]


def test_join_hard_rows(spark):
    got = jaccard_join.components(rows.table(spark)).collect()
    assert len(got) == len(rows.documents())
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[k].n_shingles, by_id[k].component_id) for k in (0, 1, 2)] == [(0, 0), (0, 1), (0, 2)]
    assert by_id[6].component_id == 5
    assert jaccard_join.components(rows.empty(spark)).count() == 0


def seeds_of_texts(*items):
    return decontaminate.Seeds.of([(i, WordHashes()(decontaminate.tokens(t))) for i, t in items])


def test_planted_passages(spark, monkeypatch):
    items = [(k, rows.prose(500 + k, 40)) for k in range(30)] + [(90, None), (91, ""), (92, "too short"), (93, rows.prose(7000, 9))]
    r, docs, planted = random.Random(2), [], set()
    for k in range(150):
        words = rows.prose(9000 + k, 200).split()
        if k % 3 == 0:
            item = items[k % 30]
            copy = item[1].split()
            for _ in range(k % 4):  # substitutions
                copy[r.randrange(len(copy))] = "zzz"
            words[50:50] = [w.upper() if k % 2 else w for w in copy]
            planted.add((k, item[0]))
        docs.append((k, " ".join(words)))
    docs += [(500, rows.prose(7000, 9)), (501, None), (502, "")]
    planted.add((500, 93))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in found} == planted
    assert {x.doc_id for x in decontaminate.clean(d, b).collect()} == {k for k, _ in docs} - {k for k, _ in planted}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    monkeypatch.setattr(decontaminate, "HELD_SEEDS", 0)  # the same by a shuffle
    assert sorted(decontaminate.contaminated(d, b).collect()) == sorted(found)
    odd = d.selectExpr("*", "1 as row", "2 as diagonals", "'x' as seed")
    left = decontaminate.clean(odd, b)
    assert left.columns == odd.columns
    assert {x.doc_id for x in left.collect()} == {k for k, _ in docs} - {k for k, _ in planted}


@pytest.mark.parametrize("size", [8, 9, 10, 12, 13, 15, 18])
def test_every_accepted_copy_of_a_short_item_is_found(size):
    item = [f"w{k}" for k in range(size)]
    seeds, hashes = seeds_of_texts((1, " ".join(item))), WordHashes()
    for n in range(size - -(-4 * size // 5) + 1):
        for places in itertools.combinations(range(size), n):
            h = hashes([w.encode() for w in ["before", *("zzz" if k in places else w for k, w in enumerate(item)), "after"]])
            same = np.array([k not in places for k in range(size)])
            a, b = decontaminate.best_stretch(same)
            matches = int(same[a:b].sum())
            accepted = (matches >= 12 or 5 * matches >= 4 * size) and 5 * matches >= 4 * (b - a)
            assert bool(decontaminate.overlaps(h, np.array([len(h)]), seeds)) == accepted, places


@pytest.mark.parametrize(("quoted", "changed", "least"), [(15, 3, 0.85), (20, 4, 0.9), (25, 5, 0.95), (40, 8, 0.99), (40, 0, 1.0)])
def test_recall_of_long_items(quoted, changed, least):
    """Of an item of forty tokens a part is quoted, with substitutions anywhere in it: the share of accepted copies that the seeds find."""
    item = [f"w{k}" for k in range(40)]
    seeds, hashes, r = seeds_of_texts((1, " ".join(item))), WordHashes(), random.Random(quoted)
    found = accepted = 0
    for _ in range(1000):
        at, places = r.randint(0, 40 - quoted), set(r.sample(range(quoted), changed))
        words = ["zzz" if k in places else w for k, w in enumerate(item[at : at + quoted])]
        same = np.array([k not in places for k in range(quoted)])
        a, b = decontaminate.best_stretch(same)
        matches = int(same[a:b].sum())
        if matches >= 12 and 5 * matches >= 4 * (b - a):
            accepted += 1
            h = hashes([w.encode() for w in ["before", *words, "after"]])
            found += bool(decontaminate.overlaps(h, np.array([len(h)]), seeds))
    assert accepted > 100
    assert found >= least * accepted, (found, accepted)


def test_items_of_a_few_tokens_match_whole(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_TOKENS", 6)
    seeds = seeds_of_texts((7, "Two words"), (8, "a b c d e"), (9, ""), (10, None), (11, "one"))
    texts = ["say two, words", "two other words", "", "a b c d e", "a b c d x", "x a b c", "d e", "One"]
    words = [decontaminate.tokens(t) for t in texts]
    h, ends = WordHashes()([w for own in words for w in own]), np.cumsum([len(w) for w in words])
    assert sorted((doc, seeds.items[i], *x) for doc, i, *x in decontaminate.overlaps(h, ends, seeds)) == [(0, 7, 2, 2, 1, 0), (3, 8, 5, 5, 0, 0), (7, 11, 1, 1, 0, 0)]


def test_decontamination_hard_rows(spark):
    b = spark.createDataFrame([(1, rows.prose(2, 300))], "item_id long, text string")
    df = rows.table(spark)
    assert [r.doc_id for r in decontaminate.contaminated(df, b).collect()] == [7]
    assert decontaminate.clean(df, b).columns == df.columns
    assert decontaminate.clean(rows.empty(spark), b).count() == 0


def same_rows(df, other):
    return sorted(map(str, map(tuple, df.select(other.columns).collect()))) == sorted(map(str, map(tuple, other.collect())))


def test_shards(spark, tmp_path):
    df = rows.table(spark)
    store = shards.ShardStore(spark, str(tmp_path / "s"), df.schema, fan_in=2, target_bytes=3000, base_bytes=1000)
    assert store.read().count() == 0
    # arrivals of any text, null among them, named as a column of the table
    odd = F.element_at(F.array(*map(F.lit, ["01", "1", "a/b=c%", "__HIVE_DEFAULT_PARTITION__", None])), F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int") + 1)
    store.append(df.withColumn("came", odd), "came")
    assert len(store.runs()) == df.select(odd).distinct().count()
    assert same_rows(store.read(), df)
    first, open_reader = store.version(), store.read()
    store.compact()
    runs = store.runs()
    assert same_rows(store.read(), df)
    assert sum(r.rows for r in runs) == df.count()
    tiers = [store.tier(r) for r in runs]
    assert all(tiers.count(t) < store.fan_in for t in tiers)
    assert store.version() > first
    assert not store.due(runs)
    assert same_rows(store.read(store.version() - 1), df)
    with pytest.raises(shards.Conflict):
        store.commit(store.version() - 1, [])
    assert store.runs() == runs
    before = store.version()
    store.append(rows.empty(spark).selectExpr("*", *(f"null as {c}" for c in df.columns[5:])).withColumn("came", F.lit(1)), "came")
    assert (store.version(), store.runs()) == (before + 1, runs)
    del open_reader


def test_a_reader_survives_one_commit(spark, tmp_path):
    df = rows.table(spark).withColumn("came", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    store = shards.ShardStore(spark, str(tmp_path / "s"), df.drop("came").schema, fan_in=2, base_bytes=1 << 20)
    store.append(df, "came")
    reader = store.read()
    assert store.compact() == 1
    assert same_rows(reader, df.drop("came"))
    clash = shards.ShardStore(spark, str(tmp_path / "t"), df.withColumn("__run", F.lit(1)).drop("came").schema)
    clash.append(df.withColumn("__run", F.lit(1)), "came")
    with pytest.raises(ValueError, match="__run"):
        clash.read()
    assert same_rows(clash.read(added=("run_", "tier_", "files_")), df.withColumn("__run", F.lit(1)).drop("came"))


def pipeline_rows():
    docs, items = [], [(k, rows.prose(300_000 + k, 45)) for k in range(5)]
    for k in range(80):
        lines = [x.capitalize() + "." for x in (rows.prose(k * 100 + j, 12) for j in range(10))]
        if k % 10 == 1:
            lines = [" | ".join(x.split()) for x in lines]  # rejected
        elif k % 10 == 2:
            lines[3] = items[k % 5][1]  # contaminated
        elif k % 10 == 3:
            lines[5] += " password: abcd1234efgh"
        docs.append((k, "\n".join(lines), "en", "s", 0))
    docs += [(100 + k, docs[10 * k + 4][1] + " Extra.", "en", "s", 0) for k in range(4)] + [(200, docs[4][1], "en", "s", 0), (201, None, "en", "s", None), (300, docs[5][1], "en", "s", 0), (5, docs[5][1], "en", "s", 0)]
    return docs, items


def test_near_copies_are_decided_by_row(spark):
    a, b, c, d = (rows.prose(40 + k, 60) for k in range(4))
    docs = [(0, a), (1, a), (1, b), (1, c), (1, c), (2, c + " more"), (None, b), (None, d), (None, d), (3, d + " more"), (4, None), (4, "")]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs], rows.SCHEMA)
    got = corpus_pipeline.near_copies(spark, df, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(0, a), (1, b), (1, c), (3, d + " more"), (4, None), (4, "")], key=str)


def test_the_pipeline(spark, tmp_path):
    docs, items = pipeline_rows()
    spark.createDataFrame(docs, rows.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, df = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, ids = [], {r.doc_id for r in df.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == "doc_id text lang source n_chars".split()
        kept.append({r.doc_id for r in df.collect()})
    rejected = {k for k in range(80) if k % 10 == 1} | {201}
    assert kept[0] == ids - rejected
    assert kept[1] == kept[0] - {100, 101, 102, 103, 200, 300}
    assert kept[2] == kept[1] - {k for k in range(80) if k % 10 == 2}
    assert kept[3] == kept[2]
    texts = [r.text for r in df.collect()]
    assert len(texts) == len(kept[3])
    assert sum("[SECRET]" in t for t in texts) == 8
    assert not any("abcd1234efgh" in t for t in texts)
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == kept[3]


def test_the_pipeline_on_nothing(spark, tmp_path):
    rows.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_on_hard_rows(spark, tmp_path):
    rows.table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got <= {5, 7, None}


def test_sql_of_the_join(spark):
    from podium.llm import queries
    from tests import oracle

    sf = oracle.folder("sf0.001")
    assert oracle.differences(queries.op4_ngram_join(spark, sf), oracle.connect(sf), queries.OP4_SQL) == ""


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 3])
@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_minhash_components_are_those_of_brute_force(spark, monkeypatch, n, percent, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "STAR_SETS", 2 if chunk == 3 else 256)
    docs = copies(n * percent)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as bands", "2 as id", "3 as kept")
    got = minhash.components(df, n, percent).collect()
    plain = plain_components(docs, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_hard_rows(spark):
    got = minhash.components(rows.table(spark)).collect()
    assert len(got) == len(rows.documents())
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[k].n_shingles, by_id[k].component_id, by_id[k].kept) for k in (0, 1, 2)] == [(0, 0, True), (0, 1, True), (0, 2, True)]
    assert (by_id[6].component_id, by_id[6].kept, by_id[None].kept) == (5, False, False)
    assert minhash.components(rows.empty(spark)).count() == 0


def test_linked_sets_that_no_center_links(spark):
    """All share a bucket with a center that none of them is linked with: the stars confirm nothing, the search of the bucket finds the links."""
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    docs = [(0, " ".join(words[:300]))]
    for k in range(1, 41):
        own = words[:300]
        family = k % 4
        own[family * 40 : family * 40 + 60] = [f"f{family}x{j}" for j in range(60)]
        own[r.integers(250, 299)] = f"own{k}"
        docs.append((k, " ".join(own)))
    got = minhash.components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == plain_components(docs, 3, 85)


@pytest.mark.parametrize("size", [7, 20, 60, 300, 3000])
def test_bins_agree_as_often_as_sets(size):
    """Densified bins estimate the similarity without bias, of small sets too; linked sets share a band."""
    r, sketch, agree, missed = np.random.default_rng(size), minhash.Sketch(), [], 0
    for _ in range(200):
        union = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
        cut = int(0.15 * size)
        a, b = (np.sort(np.delete(union, r.choice(size, part, replace=False))) for part in (cut // 2, 0))
        b = np.sort(np.delete(b, r.choice(len(b), cut - cut // 2, replace=False)))
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        agree.append((sketch.values(a) == sketch.values(b)).mean() - jaccard)
        missed += jaccard >= 0.85 and not len(np.intersect1d(sketch(a), sketch(b)))
    assert abs(np.mean(agree)) < 0.01
    assert missed == 0


def test_a_large_bucket_makes_few_pairs(spark, monkeypatch):
    """One group of near copies: pairs grow with the texts, not with their square."""
    monkeypatch.setattr(minhash, "CHUNK", 16)
    docs = [(k, rows.prose(1, 200) + f" end{k}") for k in range(300)]
    pairs, keep = [], minhash.Tables.keep

    def counting(self, df, name):
        table = keep(self, df, name)
        if name == "candidate-pairs":
            pairs.append(table.count())
        return table

    monkeypatch.setattr(minhash.Tables, "keep", counting)
    got = minhash.components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {x.component_id for x in got.collect()} == {0}
    assert 299 <= pairs[0] < 20 * 300


def test_a_bucket_goes_on_with_a_set_of_its_own(spark):
    """1 and 2 share a bucket of their chunk; 3, of another chunk, shares one with 2 alone, and has to meet 2, not 1 in its place."""
    bands = lambda *signatures: np.array(signatures, np.int64).tobytes()
    two = spark.sparkContext.parallelize([(1, bands(7, 11)), (2, bands(7, 20)), (3, bands(9, 20)), (4, bands(12, 13))], 2)
    passed = minhash.chunked(spark.createDataFrame(two, "node long, bands binary")).collect()
    assert {(r.node, r.center) for r in passed if r.center is not None} == {(2, 1)}
    assert {(r.signature, r.node) for r in passed if r.center is None} == {(7, 1), (11, 1), (20, 2), (9, 3), (20, 3), (12, 4), (13, 4)}


def test_dense_clusters_have_few_edges_in_the_rounds(spark):
    from podium.operators import components
    from podium.sources.shared import kept

    sizes = []

    def counting(df, name):
        table = kept(df, name)
        sizes.append((name, table.count()))
        return table

    edges = spark.createDataFrame([(a, b) for a in range(60) for b in range(60) if a != b] + [(100, 101)], "src long, dst long")
    got = components.connected_components(edges, counting).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}
    assert dict(sizes)["edges"] == 2 * 60


def test_sql_of_near_copies(spark):
    from podium.llm import queries
    from tests import oracle

    sf = oracle.folder("sf0.001")
    assert oracle.differences(queries.op11_near_copies(spark, sf), oracle.connect(sf), queries.OP11_SQL) == ""
