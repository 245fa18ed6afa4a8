r"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues; a local
parser at each anchor expands to the left and right and validates what it found: an email address, an
IP address, a card number (Luhn), a phone number, a URL with a user's password, an IBAN (remainder 97)
or an account number behind a cue. The automaton reads a text once, and a parser reads what its anchor
touches; digits inside an accepted stretch start no second parser.

Null and empty texts have no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from podium.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+")
LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s@/]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
ACCOUNT = re.compile(r"(?: (?:number|num|no|nr)\.?[ :#=]{1,2}| ?[:#=] ?)([0-9]{6,17})(?![0-9])")
CUES = {"scheme": ("://",), "iban": ("IBAN", "iban", "Iban"), "account": ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT")}

Span = tuple[int, int, str]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in ("@", "+", *"0123456789"):
        found.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def is_iban(value: str) -> bool:
    body = value.replace(" ", "")
    if not 15 <= len(body) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def find(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans, by kind as listed and then by start. The first four kinds are what leftmost matching of their patterns gives."""
    spans: list[Span] = []
    email = ip = card = phone = 0  # where each kind's last match ended
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= ip:
                if m := QUAD.match(text, at):
                    ip = m.end()
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
                        spans.append((at, ip, "ip"))
                else:
                    ip = RUN.match(text, at).end()
            if at >= card:
                if m := DIGITS.match(text, at):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, card, "card"))
                else:
                    card = at + 1
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                spans.append((start, email, "email"))
        elif kind == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append((at, phone, "phone"))
        elif kind == "scheme":
            if m := LOGIN.match(text, last + 1):
                spans.append((m.start(), m.end(), "login"))
        elif kind == "iban":
            start = last + 1
            while start < len(text) and start <= last + 3 and text[start] in " :=":
                start += 1
            m = IBAN.match(text, start)
            if m and is_iban(m[0]):
                spans.append((m.start(), m.end(), "iban"))
        elif m := ACCOUNT.match(text, last + 1):
            spans.append((m.start(1), m.end(1), "account"))
    return sorted(set(spans), key=lambda s: (KINDS.index(s[2]), s[0], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def scan(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: counts and spans kind:start:end (code points, end exclusive); base_sha256 digests the first four kinds."""
    small_batches(documents.sparkSession)
    kind = documents.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                body = value.as_py() or ""
                spans = find(body, anchors)
                base = [s for s in spans if s[2] in KINDS[:4]]
                kinds = [s[2] for s in base]
                row = (*map(kinds.count, KINDS[:4]), len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:5]), *(pa.array(x, pa.string()) for x in out[5:])],
                names=[id_column, "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"],
            )

    return documents.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, {SCHEMA}")
