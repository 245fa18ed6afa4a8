"""Vector codes and ranked search against plain Python and SQL."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from podium.llm import common, queries, ranked_search, vector_codes
from tests import oracle
from tests.llm import rows


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_ranked_search"])
def test_same_rows_as_sql(spark, name):
    sf = oracle.folder("sf0.001")
    assert oracle.differences(queries.queries()[name](spark, sf), oracle.connect(sf), queries.oracle_sql()[name]) == ""


def plain_codes(vectors, rounds, entries=16):
    """Lloyd's rounds from all vectors, in Python's whole numbers."""
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(min(kept)[2])
    kept = [x for x in kept if len(x[2]) == width]
    bounds = [k * width // 8 for k in range(9)]
    cut = lambda v: [v[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    first = sorted(kept)[:entries]
    books = [[cut(v)[p] for _, _, v in first] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min(range(len(book)), key=lambda e: (gap(part, book[e]), e))
    for _ in range(rounds):
        for p in range(8):
            of = [(nearest(cut(v)[p], books[p]), cut(v)[p]) for _, _, v in kept]
            for e in range(len(books[p])):
                own = [x for k, x in of if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, lab, v in kept:
        codes = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, lab, bytes(codes).hex(), sum(gap(x, books[p][c]) for (p, x), c in zip(enumerate(cut(v)), codes, strict=True))))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def hard_vectors():
    r = np.random.default_rng(4)
    own = [(k, k % 3 if k % 4 else None, (r.normal(size=16) * (1 + k % 3)).tolist()) for k in range(60)]
    own += [(100 + k, 1, own[0][2]) for k in range(40)]  # a third are one vector
    return own + [(200, 1, None), (201, 1, []), (202, 2, [None] * 16), (203, 2, [float("nan")] * 16), (204, None, [float("inf")] + [0.0] * 15), (205, 5, [0.0] * 16), (206, 5, [-0.0001] * 16)]


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_codes_are_those_of_whole_rounds(spark, rounds):
    vectors = hard_vectors()
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").repartition(5).selectExpr("*", "1 as part", "'x' as code", "2 as n")
    codes, books = vector_codes.compressed(df, rounds=rounds)
    expected, digest = plain_codes(vectors, rounds)
    assert sorted(map(tuple, codes.collect()), key=str) == sorted(expected, key=str)
    assert books.digest() == digest
    total = Counter()
    for _, lab, _, error in expected:
        total[lab] += error
    of_label = {i: total[lab] for i, lab, _, _ in expected}
    assert {r.vec_id: r.label_error for r in vector_codes.with_label_errors(codes, books).collect()} == of_label


def test_only_what_has_moved_is_shuffled(spark, monkeypatch):
    """The rows of deltas of a round are entries that gained or lost parts; a settled round has none."""
    seen = []
    take = vector_codes.take_deltas
    monkeypatch.setattr(vector_codes, "take_deltas", lambda state, books: (seen.append(state.where("part is not null").count()), take(state, books)))
    vectors = [(k, 0, [float(k % 16)] * 8) for k in range(160)]
    codes, _ = vector_codes.compressed(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").coalesce(1))
    assert seen[0] == 8 * 16
    assert seen[1:] == [0] * 5
    assert {r.error for r in codes.collect()} == {0}


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    codes, books = vector_codes.compressed(spark.createDataFrame([], schema))
    assert (codes.count(), books, vector_codes.with_label_errors(codes, books).count()) == (0, None, 0)
    # repeated rows and ids, no id, another length, beyond the range, fewer ids than entries
    odd = [(1, 1, [1.0] * 9), (1, 1, [1.0] * 9), (1, 2, [2.0] * 9), (None, 3, [5.0] * 9), (2, None, [3.0] * 8), (3, 4, [1e30] * 9)]
    codes, books = vector_codes.compressed(spark.createDataFrame(odd, schema))
    got = codes.collect()
    assert sorted((r.vec_id is None, r.vec_id, r.label) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 3, 4), (True, None, 3)]
    assert all(len(e) == 2 for e in books.entries)


def plain_ranks(documents, items, k):
    terms = lambda t: re.findall(ranked_search.TERM, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    counted = [(i, at, Counter(terms(t))) for at, (i, t) in enumerate(documents)]
    counted = [x for x in counted if x[2]]
    n_docs, total, df = len(counted), sum(c.total() for _, _, c in counted), Counter(t for _, _, c in counted for t in c)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = [t for i, text in items if i == item for t in terms(text)]
        scores = []
        for i, at, c in counted:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, at, i))
        out += [(item, rank, x[4], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return out


def hard_documents():
    docs = [(k, rows.prose(k % 20, 10 + 7 * (k % 9)) + " The common word") for k in range(90)]
    docs += [(500, None), (501, ""), (502, " .,;:!? \n"), (503, "É é ſ İ x² Ünï"), (None, rows.prose(3, 40)), (7, docs[7][1]), (504, "the " * 50_000 + "rare"), (505, "a" * 100_000), (506, "THE tHe the")]
    items = [(k, rows.prose(k, 8) + " THE the common x² é É nowhere") for k in range(6)] + [(10, None), (11, ""), (12, "..."), (None, "the"), (13, "the"), (13, "rare"), (14, "absent")]
    return docs, items


@pytest.mark.parametrize("broadcast", [True, False])
def test_ranks_are_those_of_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs, items = hard_documents()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6, "doc_id").selectExpr("*", "1 as place", "'x' as terms", "2 as bucket", "3 as n")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as query", "2 as w")
    got = sorted(map(tuple, ranked_search.ranked(d, b).collect()))
    assert got == plain_ranks(docs, items, 20)


def test_rank_of_nothing(spark):
    docs, items = hard_documents()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.ranked(d.limit(0), b).count() == 0
    assert ranked_search.ranked(d, b.limit(0)).count() == 0
    assert ranked_search.ranked(d.where("text is null"), b).count() == 0
