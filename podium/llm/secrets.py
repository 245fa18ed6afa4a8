r"""Secret scan: fixed patterns, and Markov models of characters for what no pattern names.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers,
are trained from labelled samples; a run of identifier characters is a secret when the log-likelihood
ratio of the two exceeds the log of the prior odds, which are higher against short runs. What a pattern's
span leaves of a run is a run. If a run as a whole is none, its best-scoring stretch may be, widened to the
next / or = on both sides; then what is left of the run is searched again.

Null and empty texts have no spans. Repeated rows are scanned each on its own. Training on an empty
table of samples gives models that never prefer a secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import hash_sample, small_batches

ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: The characters of runs that can hold a secret that no pattern names.
IN_RUN = np.array([chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" for c in range(128)])
KINDS = ("assign", "access", "hex", "markov")
#: Log of the prior odds against a secret, and the least ratio a character.
LOG_ODDS, LEAST_MEAN = math.log(1e5), 0.4
#: The log of the odds grows by 1 for each character that a run is shorter than this.
COMMON_LENGTH = 20

Span = tuple[int, int, str]


def pattern_spans(text: str) -> list[Span]:
    """Spans of the three fixed patterns, by start and then by kind as listed."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


@dataclass
class MarkovModels:
    """ratio[a, b]: log of P(b | a) in random strings over that in identifiers; row 0 is the start."""

    ratio: np.ndarray

    def score(self, run: str) -> float:
        codes = np.frombuffer(run.encode(), np.uint8)
        return float(self.ratio[np.concatenate(([0], codes[:-1])), codes].sum())

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 127)
        inside = np.concatenate([[False], IN_RUN[codes], [False]])
        for start, end, _ in taken:
            inside[start + 1 : end + 1] = False
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        before = np.concatenate([[0], codes[:-1]])
        before[starts] = 0
        step = self.ratio[before, codes]
        # no stretch has more than its positive steps
        most = np.concatenate([[0], np.cumsum(np.maximum(step, 0))])
        found = []
        for k in np.flatnonzero(most[ends] - most[starts] > LOG_ODDS).tolist():
            found += self.secrets_in(text, step, int(starts[k]), int(ends[k]))
        return in_order(found)

    def secrets_in(self, text: str, step: np.ndarray, start: int, end: int) -> list[Span]:
        """The run itself, or its best stretches."""
        if is_secret(float(step[start:end].sum()), end - start):
            return [(start, end, "markov")]
        found, left = [], [(start, end)]
        while left:
            start, end = left.pop()
            total = np.concatenate([[0], np.cumsum(step[start:end] - LEAST_MEAN)])
            low = np.minimum.accumulate(total)
            b = int((total - low).argmax())
            a = int(total[: b + 1].argmin())
            # of so many stretches the best is chosen
            if b > a and is_secret(float(step[start + a : start + b].sum()) - math.log(end - start), b - a):
                first = max(text.rfind(c, start, start + a) + 1 for c in "/=")
                last = min(at if (at := text.find(c, start + b, end)) >= 0 else end for c in "/=")
                first = max(first, start)
                found.append((first, last, "markov"))
                left += [(x, y) for x, y in ((start, first), (last, end)) if x < y]
        return found


def is_secret(score: float, length: int) -> bool:
    return score > LOG_ODDS + max(0, COMMON_LENGTH - length) and score > LEAST_MEAN * length


def train(samples: DataFrame, text: str = "text", is_secret: str = "is_secret", smoothing: float = 0.5) -> MarkovModels:
    """Both models from labelled samples; what reaches the driver has at most 2 x 129 x 128 rows, whatever the samples."""
    chars = F.split(F.regexp_replace(text, "[^\\x21-\\x7E]", ""), "")
    pairs = (
        samples.where(F.col(text).isNotNull() & F.col(is_secret).isNotNull())
        .select(F.col(is_secret).cast("boolean").alias("secret"), F.filter(chars, lambda c: c != "").alias("chars"))
        .select("secret", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), F.slice("chars", 1, F.greatest(F.size("chars") - 1, F.lit(0)))).alias("a"), F.col("chars").alias("b"))).alias("pair"))
        .groupBy("secret", F.ascii("pair.a").alias("a"), F.ascii("pair.b").alias("b"))
        .count()
    )
    counts = np.full((2, 128, 128), smoothing)
    for secret, a, b, n in pairs.where("b is not null").collect():
        counts[int(secret), a or 0, b] += n
    # only the printable characters of identifiers share the mass
    seen = np.zeros(128, bool)
    seen[[*range(0x21, 0x7F)]] = True
    counts[:, :, ~seen] = 0
    chance = counts / counts.sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(seen, np.log(chance[1]) - np.log(chance[0]), 0.0)
    return MarkovModels(ratio)


def labelled_samples(documents: DataFrame, rows: int = 1000, generated: int = 3000) -> DataFrame:
    """Labelled samples: random strings by rule, and identifiers built of the words of a bounded sample of documents.

    rows bounds the documents (those of small hashes of doc_id); generated is the number of random strings.
    """
    spark = documents.sparkSession
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    shape = F.col("id") % 4
    random = spark.range(generated).select(
        F.when(shape == 0, F.substring(digest, 1, 40))
        .when(shape == 1, F.substring(b64, 1, 32))
        .when(shape == 2, F.translate(F.substring(b64, 1, 40), "+/", "-_"))
        .otherwise(F.upper(F.regexp_replace(b64, "[+/]", "")))
        .alias("text"),
        F.lit(True).alias("is_secret"),
    )
    words = (
        hash_sample(documents.where("text is not null").select("doc_id", "text"), rows)
        .select(F.regexp_extract_all("text", F.lit("\\b([A-Za-z]{3,12})\\b"), F.lit(1)).alias("w"), F.xxhash64("doc_id").alias("h"))
        .where(F.size("w") >= 4)
        .select("w", "h", F.explode(F.sequence(F.lit(1), F.least(F.size("w") - 3, F.lit(60)))).alias("i"))
    )
    w = [F.try_element_at("w", F.col("i") + k) for k in range(3)]
    low = [F.lower(x) for x in w]
    style = F.pmod(F.col("h") + F.col("i"), F.lit(6))
    plain = words.select(
        F.when(style == 0, F.concat_ws("_", *low))
        .when(style == 1, F.concat(low[0], F.initcap(low[1]), F.initcap(low[2])))
        .when(style == 2, F.concat_ws("-", *low, F.pmod("h", F.lit(100)).cast("string")))
        .when(style == 3, F.upper(F.concat_ws("_", *low)))
        .when(style == 4, F.concat_ws("/", *low))
        .otherwise(F.concat(low[0], low[1], F.lit("_v"), F.pmod("i", F.lit(20)).cast("string")))
        .alias("text"),
        F.lit(False).alias("is_secret"),
    )
    return random.unionByName(plain)


SCHEMA = "n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def scan(documents: DataFrame, models: MarkovModels, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: counts and spans kind:start:end (code points, end exclusive); base_sha256 digests the fixed patterns' spans."""
    small_batches(documents.sparkSession)
    kind = documents.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                body = value.as_py() or ""
                base = pattern_spans(body)
                more = models.spans(body, base)
                kinds = [s[2] for s in base]
                row = (*map(kinds.count, KINDS[:3]), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(in_order(base + more)))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])],
                names=[id_column, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    return documents.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, {SCHEMA}")


def redact(documents: DataFrame, models: MarkovModels, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """documents with every span of the scan replaced by mark; the other columns and the columns' order stay, nulls too."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(at):
                body = value.as_py()
                if body:
                    base = pattern_spans(body)
                    body = without(body, base + models.spans(body, base), mark)
                texts.append(body)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(run, documents.schema)


def without(text: str, spans: list[Span], mark: str) -> str:
    """text with the union of the spans replaced, each connected stretch by one mark."""
    parts, at, last = [], 0, -1
    for start, end, _ in sorted(spans):
        if start > last:
            parts += [text[at:start], mark]
            last = at = end
        else:
            last = at = max(at, end)
    return "".join([*parts, text[at:]])


def default_models(spark: SparkSession, documents: DataFrame) -> MarkovModels:
    return train(labelled_samples(documents))
