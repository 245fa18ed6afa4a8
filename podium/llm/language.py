r"""Language of texts by a small convolutional network over bytes.

Texts are read in lower case. Bytes are embedded; filters of several widths slide over a fixed-length window, each filter keeps its
largest response, and a softmax layer reads those. The network is trained in numpy on the driver, from a
bounded sample of labelled rows; a whole text is cut into windows, predicted in batches on the executors,
and the windows' log-probabilities are averaged by their bytes. Since a filter's response is a sum of one
term a byte, prediction looks terms up instead of multiplying.

A null text, or one without a letter, is `und` with score 0, and so is every text where nothing was
learned. Rows with a null label or text are not learned from. Repeated rows count as often as they come; ties of languages go to the first in the alphabet. An
empty table has an empty result. Long texts are cut into as many windows as they fill. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import small_batches

WIDTHS, FILTERS, DEPTH, WINDOW = (2, 3, 4), 16, 8, 192
UNKNOWN = "und"
#: Windows predicted at once: what a step holds is this times WINDOW times FILTERS floats.
AT_ONCE = 512
#: Languages that are learned, the most frequent ones, and rows of each that the sample has at least, as far as there are so many.
MOST_LANGS, LEAST_ROWS = 500, 50


def has_letter(text: str | None) -> bool:
    """Letters are what Unicode calls so; digits, numbers as superscripts or Roman numerals, and marks are none."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Network:
    langs: list[str]
    embedding: np.ndarray  # 256 x DEPTH
    filters: list[np.ndarray]  # of each width: width x DEPTH x FILTERS
    bias: np.ndarray  # of all filters
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def terms(self) -> list[list[np.ndarray]]:
        """For each width and place in it: what each byte adds to each filter."""
        return [[(self.embedding @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]

    def log_probabilities(self, windows: np.ndarray, terms: list[list[np.ndarray]]) -> np.ndarray:
        peaks = []
        for of_width in terms:
            n = windows.shape[1] - len(of_width) + 1
            response = of_width[0][windows[:, :n]]
            for k, term in enumerate(of_width[1:], 1):
                response += term[windows[:, k : k + n]]
            peaks.append(response.max(axis=1))
        hidden = np.maximum(np.concatenate(peaks, axis=1) + self.bias, 0)
        return log_softmax(hidden @ self.out + self.out_bias)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows of bytes that begin at starts and stop at ends, filled up with zeros."""
    at = starts[:, None] + np.arange(WINDOW)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0) if len(data) else np.zeros(at.shape, np.uint8)


def train(texts: list[str], labels: list[str], steps: int = 300, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Adam over random windows; each language weighs the same."""
    langs = sorted(set(labels))
    if not langs:
        return None
    random = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    raw = [np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8) for t in texts]
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    sizes = len(WIDTHS) * FILTERS
    weights = [random.normal(0, 0.3, (256, DEPTH)), *(random.normal(0, (2 / (w * DEPTH)) ** 0.5, (w, DEPTH, FILTERS)) for w in WIDTHS), np.zeros(sizes), random.normal(0, 0.1, (sizes, len(langs))), np.zeros(len(langs))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        of = random.integers(0, len(langs), batch)
        rows = np.array([random.choice(by_lang[k]) for k in of])
        x = np.zeros((batch, WINDOW), np.uint8)
        for i, r in enumerate(rows):
            start = random.integers(0, max(1, len(raw[r]) - WINDOW + 1))
            part = raw[r][start : start + WINDOW]
            x[i, : len(part)] = part
        embedding, filters, bias, out, out_bias = weights[0], weights[1:-3], *weights[-3:]
        peaks, places = [], []
        for f in filters:
            n = WINDOW - len(f) + 1
            response = sum((embedding @ f[k])[x[:, k : k + n]] for k in range(len(f)))
            place = response.argmax(axis=1)
            places.append(place)
            peaks.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0])
        before = np.concatenate(peaks, axis=1) + bias
        hidden = np.maximum(before, 0)
        chance = np.exp(log_softmax(hidden @ out + out_bias))
        chance[np.arange(batch), of] -= 1
        chance /= batch
        d_hidden = (chance @ out.T) * (before > 0)
        grads = [np.zeros_like(embedding)]
        for k, f in enumerate(filters):
            d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
            d_filter = np.zeros_like(f)
            for j in range(len(f)):
                read = x[np.arange(batch)[:, None], places[k] + j]
                d_filter[j] = np.einsum("bfd,bf->df", embedding[read], d)
                np.add.at(grads[0], read, d[:, :, None] * f[j].T[None])
            grads.append(d_filter)
        grads += [d_hidden.sum(axis=0), hidden.T @ chance, chance.sum(axis=0)]
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    f32 = [w.astype(np.float32) for w in weights]
    return Network(langs, f32[0], f32[1:-3], *f32[-3:])


def sample(documents: DataFrame, learn: Column, rows: int, chars: int = 600) -> tuple[list[str], list[str]]:
    """Labelled stretches, about as many of each language, those of small hashes: `rows` in all, but LEAST_ROWS of each at least; a stretch begins at a hashed place of its text.

    The driver gets a row a language, of MOST_LANGS languages, and the stretches.
    """
    own = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = own.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGS).collect()
    if not found:
        return [], []
    each = max(LEAST_ROWS, rows // len(found))
    # hashes up to the share that gives so many
    limits = [(r.lang, min(int(-(2**63) + min(1.0, 1.1 * each / r["count"]) * (2**64 - 1)), 2**63 - 1)) for r in found]
    shares = F.broadcast(documents.sparkSession.createDataFrame(limits, "lang string, most long"))
    at = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    parts = own.select("doc_id", F.substr("text", at, F.lit(chars)).alias("part"), "lang", F.xxhash64("doc_id", "text", "lang").alias("hashed"))
    picked = parts.join(shares, "lang").where(F.col("hashed") <= F.col("most")).orderBy("hashed", "doc_id", "part").limit(2 * each * len(found)).collect()
    stretches = [(r.part, r.lang) for r in sorted(picked, key=lambda r: (r.doc_id is None, r.doc_id, r.part)) if has_letter(r.part)]
    return [t for t, _ in stretches], [y for _, y in stretches]


def predict(documents: DataFrame, network: Network | None, passed: dict[str, Column], text: str = "text") -> DataFrame:
    """passed columns, lang_pred, score; only the text is read for a prediction."""
    small_batches(documents.sparkSession)
    names = list(passed)
    rows = documents.select(*(c.alias(k) for k, c in passed.items()), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = network.terms() if network else []
        for batch in batches:
            texts = batch.column(len(names))
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = np.array([has_letter(t) for t in texts.to_pylist()], bool)
            if network and known.any():
                best, score = of_texts(network, terms, texts)
                for i in np.flatnonzero(known):
                    langs[i], scores[i] = network.langs[best[i]], score[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def of_texts(network: Network, terms: list[list[np.ndarray]], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    n = np.maximum(1, -(-size // WINDOW))
    doc = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[:-1][doc] + nth * WINDOW
    ends = offsets[1:][doc]
    total = np.zeros((len(texts), len(network.langs)))
    weight = np.maximum(np.minimum(ends - starts, WINDOW), 1)
    for k in range(0, len(doc), AT_ONCE):
        part = slice(k, k + AT_ONCE)
        logs = network.log_probabilities(windows_of(raw, starts[part], ends[part]), terms)
        np.add.at(total, doc[part], logs * weight[part, None])
    total /= np.maximum(np.bincount(doc, weight, len(texts)), 1)[:, None]
    chance = np.exp(log_softmax(total))
    best = chance.argmax(axis=1)
    return best, chance[np.arange(len(texts)), best]
