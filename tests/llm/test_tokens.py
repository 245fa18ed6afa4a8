"""Token caches, patched blocks and packing against the library and exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from podium.llm import common, packing, pfor
from podium.llm.token_cache import TokenCache
from tests.llm import rows

WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["a  b\n\n c \t d 　f ", "it's  we'll <|endoftext|> x <|startoftext|>y", "\x1c a\x1f!b \x85 z", "é ́x", "ΣΑΣ ΟΔΟΣ, Straße x² 3 ²3 a²3", "don't I'M 'S", "a_b __ c1d2", "İI ſK ŉ"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_the_library_s(path):
    cache, library = TokenCache(path, limit=20), Tokenizer.from_file(path)
    texts = [*ODD, *(t for _, t, *_ in rows.documents())]
    for _ in range(2):
        ids, sizes = cache.ids_of_all(texts)
        ends = np.cumsum(sizes)
        for text, n, end in zip(texts, sizes, ends, strict=True):
            assert ids[end - n : end].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abÀé²3 _'!\n\t ́ſΣ", max_size=60))
def test_ids_of_any_text(text):
    for path in (WORDS, BYTES):
        ids, _ = CACHES[path].ids_of_all([text])
        assert ids.tolist() == LIBRARIES[path].encode(text, add_special_tokens=False).ids


CACHES, LIBRARIES = ({p: f(p) for p in (WORDS, BYTES)} for f in (TokenCache, Tokenizer.from_file))


def test_a_hot_id_is_spread_over_parts(spark, tmp_path):
    """A third of the rows share an id: they come to several tasks, and starts stay right."""
    docs = [(5 if k % 3 == 0 else k, f"{rows.prose(k, 30)}") for k in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pfor.write_ids(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), str(tmp_path / "ids"), WORDS, 1, segment_ids=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "ids"))
    of_five = {r.part for r in files.collect() if 5 in pfor.unpack_segment(r.data)[0]}
    assert len(of_five) > 1
    got, at = pfor.read_ids(files).orderBy("start").collect(), 0
    assert [r.doc_id for r in got] == sorted(d for d, _ in docs)
    for r in got:
        assert r.start == at
        at += r.n_tokens


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    data = pfor.pack_segment(np.arange(3), np.array([1, 2, 3]), ids)
    docs, tokens, back = pfor.unpack_segment(data)
    assert (docs.tolist(), tokens.tolist(), back.tolist()) == ([0, 1, 2], [1, 2, 3], ids.tolist())
    for k in range(-(-len(ids) // pfor.BLOCK)):
        assert pfor.read_block(data, k).tolist() == ids[k * pfor.BLOCK : (k + 1) * pfor.BLOCK].tolist()


def test_outliers_are_exceptions():
    ids = np.full(1280, 7, np.uint32)
    ids[::64] = 40_000
    assert len(pfor.pack_segment(np.zeros(0), np.zeros(0), ids)) < 400


def test_files_round_trip(spark):
    df = rows.table(spark)
    library, at = Tokenizer.from_file(WORDS), 0
    got = pfor.round_trip(df, WORDS, 1).orderBy("start").collect()
    want = sorted(((d, t) for d, t, *_ in rows.documents()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    for r, (_, text) in zip(got, want, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert pfor.round_trip(rows.empty(spark), WORDS, 1).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_packing_places_every_id_once(lengths):
    pieces = packing.pack(lengths, 1024)
    sequences, documents = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence, []).append((p.offset, p.length))
        documents.setdefault(p.document, []).append((p.start, p.length))
    for own, total in [(sorted(x), None) for x in sequences.values()] + [(sorted(documents.get(k, [])), n) for k, n in enumerate(lengths)]:
        at = 0
        for start, n in own:
            assert start == at
            assert n > 0
            at += n
        assert at == total if total is not None else at <= 1024
    assert len(sequences) == -(-sum(lengths) // 1024) if lengths else not sequences


def test_packing_balances_cost():
    lengths = [500] * 40 + [24] * 800
    spent = {}
    for p in packing.pack(lengths, 1024):
        spent[p.sequence] = spent.get(p.sequence, 0) + packing.cost(p.length)
    full = sorted(spent.values())[1:]
    assert max(full) < 1.2 * min(full)


def test_packing_hard_rows(spark):
    df = rows.table(spark)
    got = packing.pack_documents(df, BYTES).collect()
    assert {r.doc_id for r in got} == {d for d, *_ in rows.documents()}
    assert {r.doc_tokens for r in got if r.doc_id == 0} == {1}
    assert packing.pack_documents(rows.empty(spark), BYTES).count() == 0


def test_packing_is_bounded_by_ids(spark):
    """Long texts are packed in groups of few; the pieces are whole all the same."""
    docs = [(k, rows.prose(k, 700)) for k in range(12)] + [(99, rows.prose(99, 40_000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    got = packing.pack_documents(df, BYTES, group_ids=3000).collect()
    assert len({r.sequence_id >> 40 for r in got}) == 1
    of: dict[int, list] = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    for pieces in of.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == pieces[0].doc_tokens
    assert {d for d, _ in docs} == set(of)


def by_search(lengths, capacity):
    """The method by plain search: the sequence of each piece, or None if no sequence has room."""
    order = sorted((k for k, n in enumerate(lengths)), key=lambda k: (-lengths[k], k))
    bins = sum(lengths) // capacity
    used, spent, at = [0] * bins, [0.0] * bins, {}
    for k in order:
        fit = [b for b in range(bins) if used[b] + lengths[k] <= capacity]
        at[k] = min(fit, key=lambda b: (spent[b], -used[b], b), default=None)
        if at[k] is not None:
            used[at[k]] += lengths[k]
            spent[at[k]] += packing.cost(lengths[k])
    return at


@pytest.mark.parametrize("seed", range(8))
def test_pieces_go_to_the_cheapest_sequence_with_room(seed):
    r = np.random.default_rng(seed)
    lengths = [700] * 70 * (seed % 2) + [365] * 40 + [300] * 60 + r.integers(1, 1024, 300).tolist()
    at = by_search(lengths, 1024)
    pieces = packing.pack(lengths, 1024)
    whole = {p.document: p.sequence for p in pieces if p.length == lengths[p.document]}
    assert all(whole[k] == b for k, b in at.items() if b is not None)
    assert {p.document for p in pieces} == set(range(len(lengths)))


def test_segments_of_a_part_follow_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BATCH_ROWS", 20)
    texts = [(k, rows.prose(k, 40)) for k in range(60)] + [(7, rows.prose(99, 5)), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    pfor.write_ids(df, str(tmp_path / "ids"), WORDS, 1, segment_ids=150)
    files = spark.read.parquet(str(tmp_path / "ids"))
    assert files.count() > files.select("part").distinct().count()
    got = sorted(pfor.read_ids(files).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted([k for k, _ in texts if k is not None] + [None], key=lambda k: (k is not None, k))
