"""Quality rules against plain Python, and the model against planted defects."""

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from podium.llm import quality
from tests.llm import rows

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def counted(df):
    q = F.col(quality.ADDED)
    return [tuple(r) for r in quality.features(df).select(*(q[c] for c in FIELDS)).collect()]


def test_counts(spark):
    r = random.Random(3)
    texts = [t for _, t, *_ in rows.documents()]
    texts += ["".join(r.choice(["a", "b", "c d", " ", "\n", "\x0b", "#", "|", "a b c a b c ", "é ü"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    texts += ["a b c " * 400, " ".join(r.choice("xyz") for _ in range(900))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert counted(df) == [plain(t) for t in texts]


def test_no_python_on_the_executors(spark):
    plan = quality.features(rows.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def planted(n=400):
    r = random.Random(1)
    out = []
    for k in range(n):
        words = rows.prose(k, 120).split()
        lines = [" ".join(words[j : j + 12]).capitalize() + "." for j in range(0, 120, 12)]
        good = k % 8 > 0
        if not good:
            kind = (k // 8) % 4
            if kind == 0:
                lines = ["%%% ".join(x.split()) + "$$$ ###" for x in lines]
            elif kind == 1:
                lines = [lines[0]] * 10
            elif kind == 2:
                lines = [x.upper() + "!!" for x in lines[:5]] * 3
            else:
                lines = [" | ".join(x.split()) for x in lines]
        out.append((k, "\n".join(lines), good))
    r.shuffle(out)
    return out


def test_planted_defects(spark):
    df = spark.createDataFrame(planted(), "doc_id long, text string, good boolean")
    judged = quality.judged(df).select("good", F.col(quality.ADDED)["kept"].alias("kept"), F.col(quality.ADDED)["posterior"].alias("p")).collect()
    assert all(r.kept == r.good for r in judged)
    assert all(0 <= r.p <= 1 for r in judged)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.tuples(*[st.sampled_from([-1, 0, 1])] * len(quality.RULES)), st.integers(1, 1000)), max_size=12))
def test_any_patterns_fit(patterns):
    model = quality.fit(patterns)
    assert 0 < model.share < 1
    assert all(0 < r < 1 for r in (*model.bad_on_good, *model.bad_on_bad))


def test_hard_rows(spark):
    df = rows.table(spark)
    out = quality.judged(df)
    assert out.count() == df.count()
    assert quality.kept(df).columns == df.columns
    failed = {r.doc_id: r[1] for r in out.select("doc_id", F.col(quality.ADDED)["base_failed"]).collect()}
    assert failed[0]
    assert failed[1]
    assert quality.judged(rows.empty(spark)).count() == 0


def test_the_plan_of_kept_is_small(spark):
    plan = quality.kept(rows.table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.sub(r"\[[-0-9.,E ]*\]", "", plan)) < 20_000  # without the constant array of posteriors
    assert "xxhash64" not in plan


def test_columns_of_the_same_names_stay(spark):
    df = rows.table(spark).selectExpr("*", "1 as __quality", "2 as quality_words", "3 as QUALITY_N", "4 as quality_counts")
    assert counted(df.drop("__quality")) == [plain(t) for _, t, *_ in rows.documents()]
    got = quality.kept(df)
    assert got.columns == df.columns
    assert {r["__quality"] for r in got.collect()} <= {1}


def test_the_column_is_the_posterior(spark):
    n = len(quality.RULES)
    model = quality.fit([((1,) * n, 90), ((-1, *(1, 0) * ((n - 1) // 2)), 10)])
    patterns = [tuple(random.Random(k).choice((-1, 0, 1)) for _ in range(n)) for k in range(50)]
    df = spark.createDataFrame(patterns, ", ".join(f"{r} int" for r in quality.RULES))
    got = [r[0] for r in df.select(model.posterior_of({r: F.col(r) for r in quality.RULES})).collect()]
    assert all(abs(a - model.posterior(p)) < 1e-12 for a, p in zip(got, patterns, strict=True))


def noisy_votes(seed, n=20_000):
    """Votes of rules of known rates: the first two trip now and then on good texts, and no rule sees every bad one."""
    r = random.Random(seed)
    on_good = [0.08, 0.05, 0.002, 0.004, 0.001, 0.003, 0.002, 0.004, 0.003]
    on_bad = [0.15, 0.3, 0.6, 0.7, 0.5, 0.4, 0.55, 0.65, 0.45]
    truth = [r.random() < 0.85 for _ in range(n)]
    return [(g, tuple(0 if r.random() < 0.1 else -1 if r.random() < rate else 1 for rate in (on_good if g else on_bad))) for g in truth], on_good, on_bad


def test_noisy_rules_are_outvoted():
    for seed in range(3):
        rows_of, on_good, on_bad = noisy_votes(seed)
        model = quality.fit(list(Counter(v for _, v in rows_of).items()))
        assert all(abs(a - b) < 0.02 for a, b in zip(model.bad_on_good, on_good, strict=True))
        assert all(abs(a - b) < 0.05 for a, b in zip(model.bad_on_bad, on_bad, strict=True))
        assert abs(model.share - 0.85) < 0.01
        wrong = sum((model.posterior(v) >= 0.5) != g for g, v in rows_of)
        all_must_pass = sum((-1 not in v) != g for g, v in rows_of)
        assert wrong < all_must_pass / 5


def test_a_noisy_rule_rejects_no_text_by_itself(spark):
    """Good texts of which one in eight is shouted: the rule of capitals trips on them alone, and they are kept; texts of planted defects go."""
    texts = [(k, t.upper() if good and k % 8 == 1 else t, good) for k, t, good in planted(800)]
    df = spark.createDataFrame(texts, "doc_id long, text string, good boolean")
    q = F.col(quality.ADDED)
    judged = quality.judged(df).select("doc_id", "good", q["kept"].alias("kept"), q["vote_capitals"].alias("v")).collect()
    shouted = [r for r in judged if r.good and r.v < 0]
    assert len(shouted) == 100
    assert all(r.kept for r in shouted)
    assert all(r.kept == r.good for r in judged)


def test_labels_are_met(spark):
    """On labelled texts, on which nothing is trained: all bad ones go, and good ones only by the base rule."""
    from tests import oracle

    sf = oracle.folder("sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    q = F.col(quality.ADDED)
    got = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").select("quality", q["kept"].alias("kept"), q["base_failed"].alias("base")).collect()
    assert sum(r.kept for r in got if not r.quality) == 0
    assert sum(not r.kept and not r.base for r in got if r.quality) <= 0.01 * len(got)
