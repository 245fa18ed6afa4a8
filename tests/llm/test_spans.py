"""Secrets and personal data against plain regular expressions."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import pii, secrets
from tests.llm import rows

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = ["token", "PassWord", "api_key", "apikey", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCD1234WXYZ", "0f", "deadbeef01", "x@y.z", "@", "a.b", "..", "1.2.3.4", "255", ".", "+1 ", "(415) ", "555-7713", "4111 1111 1111 1111", "-", "12", "\n", "é", "+", "%", "://", "account no 12345678"]
texts = st.lists(st.sampled_from(PIECES), max_size=30).map("".join)


def plain_secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def luhn(digits):
    total = 0
    for k, x in enumerate(digits[::-1]):
        v = int(x) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_pii(text):
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return found


@settings(max_examples=400, deadline=None)
@given(texts)
def test_patterns_of_secrets(text):
    assert secrets.pattern_spans(text) == plain_secrets(text)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_patterns_of_personal_data(text):
    assert [s for s in pii.find(text, pii.automaton()) if s[2] in pii.KINDS[:4]] == plain_pii(text)


def test_case_letters_are_ascii():
    assert secrets.pattern_spans("paſſword=abcdefghij") == []
    assert secrets.pattern_spans("API_KEY: abcdefgh") == [(0, 17, "assign")]


def test_added_personal_data():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, account no. 1234567 and ftp://bob:pw@host.org"
    assert [k for *_, k in pii.find(text, pii.automaton())][-3:] == ["login", "iban", "account"]
    assert pii.find("IBAN: GB83 WEST 1234 5698 7654 32", pii.automaton()) == []


@pytest.fixture(scope="module")
def models(spark):
    df = spark.createDataFrame([(k, rows.prose(k, 80)) for k in range(60)], "doc_id long, text string")
    return secrets.train(secrets.labelled_samples(df))


def test_held_out_samples(models):
    r = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_ones = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(100)]
    ordinary = ["_".join(rows.prose(k, 4).split()) + "_v2" for k in range(1000, 1100)] + ["/".join(rows.prose(k, 5).split()) for k in range(1100, 1200)]
    assert sum(bool(models.spans(x, [])) for x in random_ones) >= 95
    assert sum(bool(models.spans(x, [])) for x in ordinary) == 0


def test_keys_of_letters_short_keys_and_keys_in_runs(models):
    letters, short, key = "qXzKvBwTjRgLpZcNxHfWdQkVmYbJsGtD", "x7Kq9ZbR2vWmT4Lp", "Zq8xK2vB7nR4wT9jL3gY6pXc"
    path = "/".join(rows.prose(77, 60).split())
    ordinary = "_".join(rows.prose(78, 30).split())
    for text in (letters, short, key):
        assert models.spans(f"see {text} é", []) == [(4, 4 + len(text), "markov")]
    text = f"{path}/{key}={ordinary} {ordinary}"
    assert models.spans(text, []) == [(len(path) + 1, len(path) + 1 + len(key), "markov")]
    text = "AKIA" + "A1B2C3D4E5F6G7H8" + "/" + key
    base = secrets.pattern_spans(text)
    assert [k for *_, k in base] == ["access"]
    assert secrets.without(text, base + models.spans(text, base), "#") == "#"
    assert models.spans("", []) == []


def test_added_spans_never_touch_base_ones(models):
    text = "token=ZmFrZUtleTEyMzQ1Njc4OTBhYmNkZWZnaGlqa2w x ZmFrZUtleTEyMzQ1Njc4OTBhYmNkZWZnaGlqa2w"
    base = secrets.pattern_spans(text)
    assert len(base) == 1
    assert all(start >= base[0][1] for start, *_ in models.spans(text, base))


def test_hard_rows(spark, models):
    df = rows.table(spark)
    got = secrets.scan(df, models).collect()
    assert len(got) == df.count()
    none = next(r for r in got if r.doc_id == 0)
    assert (none.n_assign, none.n_access, none.n_hex, none.spans, none.base_sha256) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert pii.scan(df).count() == df.count()
    assert secrets.scan(rows.empty(spark), models).count() == 0
    assert pii.scan(rows.empty(spark)).count() == 0


def test_redaction(spark, models):
    df = spark.createDataFrame([(1, "a token=abcdefghijkl b"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r.text for r in secrets.redact(df, models).orderBy("doc_id").collect()] == ["a [SECRET] b", None, "clean"]
    assert secrets.without("abcdef", [(1, 3, "x"), (2, 4, "y")], "#") == "a#ef"


def test_training_on_nothing(spark):
    model = secrets.train(spark.createDataFrame([], "text string, is_secret boolean"))
    assert model.spans("x9" * 30, []) == []
