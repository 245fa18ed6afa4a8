"""Language scores, languages, and n-gram tries against brute force and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.llm import language, ngram_lm
from podium.llm.elias_fano import Mapped, Sequence, Trie
from tests.llm import rows


@pytest.mark.parametrize(("n", "top"), [(0, 0), (1, 5), (5, 3), (1000, 10**6), (20000, 2**63 - 2), (3000, 1000)])
def test_sequences(n, top):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, top + 1, n).astype(np.uint64))
    s = Sequence.of(values)
    at = r.integers(0, n, 500) if n else np.zeros(0, np.int64)
    assert (s.get(at) == values[at]).all()
    target = r.integers(0, top + 1, 500).astype(np.uint64)
    assert (s.successor(target, np.zeros(500, np.int64), np.full(500, n)) == np.searchsorted(values, target)).all()


def test_tries_find_what_they_hold():
    r = np.random.default_rng(2)
    pairs = np.unique(np.stack([r.zipf(1.4, 30000) % 300, r.integers(0, 2000, 30000)], 1), axis=0).astype(np.uint64) * np.uint64(2**50 + 7)
    log10 = -r.random(len(pairs)) * 9
    data = Trie.of(pairs[:, 0], pairs[:, 1], log10).to_bytes()
    assert len(data) < 6 * len(pairs)
    with Mapped(data) as trie:
        found, code = trie.find(pairs[:, 0], pairs[:, 1])
        assert found.all()
        assert np.abs(code / -Trie.STEPS - log10).max() <= 0.5 / Trie.STEPS + 1e-9
        assert not trie.find(pairs[:, 0], pairs[:, 1] + np.uint64(1))[0].any()
    empty = Trie.of(*[np.zeros(0, np.uint64)] * 2, np.zeros(0))
    assert not empty.find(pairs[:5, 0], pairs[:5, 1])[0].any()


def test_packing_of_columns():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint8), np.array([1, 2**31], np.uint32)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, ngram_lm.unpacked(ngram_lm.packed(*arrays)), strict=True))
    totals = np.array([0, 1, 63, 64, 1000, 10**9])
    assert np.abs(np.log10(ngram_lm.coded_totals(ngram_lm.total_codes(totals))[1:] / totals[1:])).max() <= 0.026


def held(column="doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(7)) == 2


def test_scores_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 500)
    docs = [(k, rows.prose(k % 30, 50) + " " + rows.prose(k, 20)) for k in range(200)] + [(200, None), (201, ""), (202, "Ünseen WORDS only")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in ngram_lm.train_and_score(df, held()).collect()}
    words = {k: [*(t or "").encode().lower().split(), None] for k, t in docs}
    unigrams, bigrams, contexts = Counter(), Counter(), Counter()
    for k, w in words.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            before = ["", *w[:-1]]
            unigrams.update(w)
            contexts.update(before)
            bigrams.update(zip(before, w, strict=True))
    n, v = sum(unigrams.values()), len(unigrams)
    for k, w in words.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(unigrams[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((unigrams[x] + 1) / (n + v + 1)) for x in w))
        model = sum(math.log10((bigrams[a, b] + ngram_lm.PRIOR * (unigrams[b] + 1) / (n + v + 1)) / (contexts[a] + ngram_lm.PRIOR)) for a, b in zip(["", *w[:-1]], w, strict=True))
        assert abs(r.score - model) <= 0.08 * len(w)
    out = [r for k, r in got.items() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_hard_rows(spark):
    df = rows.table(spark)
    got = ngram_lm.train_and_score(df, held()).collect()
    assert len(got) == df.count()
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert ngram_lm.train_and_score(rows.empty(spark), held()).count() == 0
    assert {r.train_tokens for r in ngram_lm.train_and_score(df, F.lit(True)).collect()} == {0}


LETTERS = {"aa": "abcdef", "bb": "ghijkl", "cc": "cdefgh"}


def labelled(n):
    r = random.Random(n)
    out = []
    for k in range(n):
        lang = "aa bb cc".split()[k % 3]
        out.append((k, " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 7))) for _ in range(60)), lang))
    return out


def test_languages_of_held_out_rows(spark):
    df = spark.createDataFrame(labelled(300), "doc_id long, text string, lang string")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    network = language.train(*language.sample(df, ~out, 400), steps=150)
    got = language.predict(df, network, {"doc_id": F.col("doc_id"), "held_out": out, "truth": F.col("lang")}).where("held_out").collect()
    assert sum(r.lang_pred == r.truth for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_hard_rows(spark):
    df = rows.table(spark)
    network = language.train(*language.sample(df, F.lit(True), 100), steps=5)
    got = {r.doc_id: r for r in language.predict(df, network, {"doc_id": F.col("doc_id")}).collect()}
    assert all(got[k].lang_pred == "und" for k in (0, 1, 2))
    assert got[7].lang_pred in network.langs
    assert language.train([], []) is None
    assert {r.lang_pred for r in language.predict(df, None, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert language.predict(rows.empty(spark), network, {"doc_id": F.col("doc_id")}).count() == 0


def test_terms_are_the_convolution():
    r = np.random.default_rng(4)
    network = language.train(["abc def"] * 4 + ["xyz uvw"] * 4, ["a"] * 4 + ["b"] * 4, steps=3)
    window = r.integers(0, 256, (2, language.WINDOW)).astype(np.uint8)
    peaks = []
    for f in network.filters:
        w = len(f)
        x = np.stack([network.embedding[window[:, k : k + language.WINDOW - w + 1]] for k in range(w)], 2)
        peaks.append(np.einsum("nlwd,wdf->nlf", x, f).max(axis=1))
    hidden = np.maximum(np.concatenate(peaks, 1) + network.bias, 0)
    want = language.log_softmax(hidden @ network.out + network.out_bias)
    assert np.allclose(network.log_probabilities(window, network.terms()), want, atol=1e-4)


def test_what_is_no_letter_is_undetermined(spark):
    texts = ["²½", "Ⅷ 12", "1_2 ...", "ª", "x²", "中", "\u0301", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    network = language.train(["abc def", "ghi jkl"] * 20, ["aa", "bb"] * 20, steps=5)
    got = {r.doc_id: r.lang_pred for r in language.predict(df, network, {"doc_id": F.col("doc_id")}).collect()}
    assert {k for k, x in got.items() if x == "und"} == {0, 1, 2, 6, 7}


def test_rare_languages_are_learned(spark):
    """One text in two hundred is of a third language; the sample has as many of it as there are."""
    docs = [(k, t, "cc" if k % 200 == 0 else "aa" if k % 2 else "bb") for k, (_, t, _) in enumerate(labelled(2000))]
    _, langs = language.sample(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True), 300)
    assert langs.count("cc") == 10
    assert 60 < langs.count("aa") < 160
    assert language.sample(spark.createDataFrame([], "doc_id long, text string, lang string"), F.lit(True), 300) == ([], [])
