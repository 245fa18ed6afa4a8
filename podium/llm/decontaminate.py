r"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over 12 consecutive tokens of which it reads 8, so that a copy with substitutions
still has windows where all that a mask reads is unchanged. The hashes of the benchmark's windows are
looked up in those of every document, and around each hit the diagonal is compared token by token: the best
stretch counts a match as 1 and a mismatch as -2. A document is contaminated by an item if the stretch has
LEAST_MATCHES matching tokens, or LEAST_SHARE of the item, and at most one token in five differs.

Items of up to DENSE_ITEM tokens have the seed DENSE of three tokens in a row instead. Of what is accepted,
m tokens match and k <= m / 4 differ, so m - 2k - 2 of its windows at least are unchanged: a diagonal is
compared if it has as many hits as the least of these for the item's size, and none that would be accepted is lost.

Tokens are lower-case words without ASCII punctuation. Items of fewer than LEAST_ITEM tokens match only
where all their tokens follow each other unchanged; null and empty texts match nothing; equal items each match, and so do
repeated rows of documents. Of equally good stretches the first is given. Further columns stay as they are.

The seeds of the benchmark are a table. Up to HELD_SEEDS of them, which are counted first, each task holds them and joins by
look-up. Beyond, a bit map of fixed size leaves out the windows of documents that no seed has, the others are joined with the seeds in
a shuffle, their hits are counted by diagonal, and the diagonals go back to their documents to be compared. Both give the same rows, and
both read the documents' windows once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import Tables, WordHashes, bounded_broadcast, mix, small_batches, unused

MASKS = ("111010011011", "110110101101", "101101110011", "110011101101", "111111110000")
LEAST_MATCHES, LEAST_SHARE, LEAST_SAME = 12, 0.8, 0.8
#: Shorter items match only unchanged.
LEAST_ITEM = 8
#: The seed of short items, and the largest of these.
DENSE, DENSE_ITEM = "111", 32
#: Documents are searched together up to so many tokens, so that the hits of frequent words stay few at a time.
PIECE_TOKENS = 100_000
#: Seeds that a task holds (24 bytes each), and the bits of the map that most windows fail at.
HELD_SEEDS, TABLE_BITS = 1_000_000, 22

#: A-Z to a-z, ASCII punctuation to blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each window of the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, hash_of(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += h[k : k + n] * np.uint64(((2 * k + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return mix(total)


def hash_of(mask: str) -> int:
    return int(mask, 2) * 0x100000001B3 + len(mask)


def masks_for(size: int) -> list[str]:
    """The masks of an item of so many tokens: one over all of them, the dense one, or the spaced ones."""
    return ["1" * size] if size < LEAST_ITEM else [DENSE] if size <= DENSE_ITEM else list(MASKS)


def least_hits(size: int) -> int:
    """So many hits at least has each accepted diagonal of an item of so many tokens."""
    if not LEAST_ITEM <= size <= DENSE_ITEM:
        return 1
    least = min(LEAST_MATCHES, math.ceil(LEAST_SHARE * size))
    return min(m - (len(DENSE) - 1) * (k + 1) for m in range(least, size + 1) for k in range(size - m + 1) if m >= LEAST_SAME * (m + k))


def seeds_of(h: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """The seeds of an item, by mask."""
    return [(mask, seed_hashes(h, mask)) for mask in masks_for(len(h))] if len(h) else []


@dataclass
class Seeds:
    """Seeds of benchmark items, sorted by hash, and the items' tokens."""

    items: list[int]
    tokens: list[np.ndarray]
    masks: list[str]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, np.ndarray]]) -> Seeds:
        items = [(i, h) for i, h in items if len(h)]
        masks: dict[str, None] = {}
        keys, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, h) in enumerate(items):
            for mask, own in seeds_of(h):
                masks[mask] = None
                keys.append(own)
                item.append(np.full(len(own), k))
                place.append(np.arange(len(own)))
        all_keys, all_items, all_places = map(np.concatenate, (keys, item, place))
        order = np.argsort(all_keys, kind="stable")
        table = np.zeros(1 << TABLE_BITS, bool)
        table[all_keys >> np.uint64(64 - TABLE_BITS)] = True
        return cls([i for i, _ in items], [h for _, h in items], list(masks), all_keys[order], all_items[order], all_places[order], table, np.array([least_hits(len(h)) for _, h in items], np.int64))

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in h, items, and places in these, of windows with equal hashes."""
        for mask in self.masks:
            own = seed_hashes(h, mask)
            at = np.flatnonzero(self.table[own >> np.uint64(64 - TABLE_BITS)])
            low, high = np.searchsorted(self.keys, own[at], "left"), np.searchsorted(self.keys, own[at], "right")
            n = high - low
            if n.any():
                where = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(at, n), self.item[where], self.place[where]


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """Where the sum of 1 for a match and -2 for a mismatch is largest."""
    score = np.where(same, 1, -2)
    total = np.concatenate([[0], np.cumsum(score)])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end


def compared(h: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(matches, aligned, start in the document, start in the item) of the best stretch of a diagonal, if it is accepted."""
    first, last = max(0, diagonal), min(len(h), diagonal + len(item))
    same = h[first:last] == item[first - diagonal : last - diagonal]
    a, b = best_stretch(same)
    matches, aligned = int(same[a:b].sum()), b - a
    enough = matches == len(item) if len(item) < LEAST_ITEM else matches >= LEAST_MATCHES or matches >= LEAST_SHARE * len(item)
    return (matches, aligned, first + a, first + a - diagonal) if enough and matches >= LEAST_SAME * aligned else None


def overlaps(h: np.ndarray, ends: np.ndarray, benchmark: Seeds) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, matches, aligned, start in the document, start in the item), the best stretch of each pair; ends: of the documents in h."""
    found, first, at = [], 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, at + PIECE_TOKENS, "right")))
        own = overlaps_of_piece(h[at : ends[last - 1]], ends[first:last] - at, benchmark)
        found += [(first + doc, *x) for doc, *x in own]
        first, at = last, int(ends[last - 1])
    return found


def overlaps_of_piece(h: np.ndarray, ends: np.ndarray, benchmark: Seeds) -> list[tuple[int, int, int, int, int, int]]:
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    seen = set()
    starts = np.concatenate([[0], ends[:-1]])
    for at, item, place in benchmark.hits(h):
        diagonals = at - place
        least = benchmark.least[item]
        if (least > 1).any():
            _, inverse, count = np.unique((diagonals + DENSE_ITEM) * len(benchmark.items) + item, return_inverse=True, return_counts=True)
            many = count[inverse] >= least
            at, item, diagonals = at[many], item[many], diagonals[many]
        docs = np.searchsorted(ends, at, "right")
        for doc, i, diagonal in set(zip(docs.tolist(), item.tolist(), diagonals.tolist(), strict=True)):
            if (doc, i, diagonal) in seen:
                continue
            seen.add((doc, i, diagonal))
            found = compared(h[starts[doc] : ends[doc]], benchmark.tokens[i], diagonal - int(starts[doc]))
            if found and found > best.get((doc, i), (0, 0, 0, 0)):
                best[doc, i] = found
    return [(doc, i, *x) for (doc, i), x in best.items()]


def over_texts(batch: pa.RecordBatch, column: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    words = [tokens(t) for t in batch.column(column).to_pylist()]
    return hashes([w for own in words for w in own]), np.cumsum([len(w) for w in words])


def items_of(benchmark: DataFrame, tables: Tables, item: str, text: str) -> DataFrame:
    """A written table of the items with tokens: number (of the row), item, their hashes, the masks and the number of seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            h = [hashes(tokens(t)) for t in batch.column(1).to_pylist()]
            masks = [masks_for(len(x)) if len(x) else [] for x in h]
            seeds = [sum(max(0, len(x) - len(m) + 1) for m in own) for x, own in zip(h, masks, strict=True)]
            columns = [batch.column(0).cast(pa.int64()), pa.array([x.tobytes() for x in h], pa.binary()), pa.array(masks, pa.list_(pa.string())), pa.array(seeds, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "tokens", "masks", "seeds"])

    rows = benchmark.select(item, text).mapInArrow(run, "item long, tokens binary, masks array<string>, seeds long")
    return tables.keep(rows.where("octet_length(tokens) > 0").withColumn("number", F.monotonically_increasing_id()), "benchmark-items")


def hits_by_join(numbered: DataFrame, row: str, text: str, items: DataFrame, tables: Tables) -> DataFrame:
    """(row, number, diagonal) that have as many hits as the item asks for: the windows of documents joined with the seeds in a shuffle."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, number, place, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(raw.as_py(), np.uint64)
                for _, own in seeds_of(h):
                    for x, values in ((keys, own), (number, np.full(len(own), k)), (place, np.arange(len(own))), (least, np.full(len(own), least_hits(len(h))))):
                        x.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x), pa.int64()) for x in (number, place, least))], names=["seed", "number", "place", "least"])

    wanted = tables.keep(items.select("number", "tokens").mapInArrow(seeds, "seed long, number long, place long, least long"), "seeds")
    top = F.shiftrightunsigned("seed", 64 - TABLE_BITS)
    words = wanted.groupBy(F.shiftright(top, 15).alias("bucket")).agg(F.bitmap_construct_agg(top.bitwiseAND(F.lit(32767))).alias("bits"))
    table = np.zeros((1 << TABLE_BITS) // 32768 * 4096, np.uint8)
    for at, bits in words.collect():  # of fixed size
        table[4096 * at : 4096 * (at + 1)] = np.frombuffer(bits, np.uint8)
    masks = [r[0] for r in items.select(F.explode("masks")).distinct().collect()]  # a dozen, whatever the benchmark

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), np.unpackbits(table, bitorder="little").astype(bool)
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            h, ends = over_texts(batch, 1, hashes)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            for mask in masks:
                own = seed_hashes(h, mask)
                at = np.flatnonzero(known[own >> np.uint64(64 - TABLE_BITS)])
                doc = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(at - starts[doc], pa.int64())], names=["seed", "row", "at"])

    hits = numbered.select(row, text).mapInArrow(windows, "seed long, row long, at long").join(wanted, "seed")
    counted = hits.groupBy("row", "number", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("hits"), F.first("least").alias("least"))
    return counted.where("hits >= least").select("row", "number", "diagonal")


FOUND = "n_matches long, n_aligned long, doc_start long, item_start long"


def overlapping(documents: DataFrame, benchmark: DataFrame, text: str, item: str, tables: Tables) -> DataFrame:
    """A row for each document and item that overlap, by a shuffle: documents' columns without the text, item_id and where."""
    row, taken = unused(documents, "row"), unused(documents, "diagonals")
    numbered = tables.keep(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = tables.keep(hits_by_join(numbered, row, text, benchmark, tables), "diagonals")
    of = found.join(benchmark.select("number", "item", "tokens"), "number")
    own = tables.keep(of.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("number", "item", "diagonal", "tokens")).alias(taken)), "diagonals-of-rows")
    asked = numbered.join(own, row).select(text, taken, *(c for c in documents.columns if c != text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at, rows = [], []
            for k, (body, diagonals) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                h, best = hashes(tokens(body)), {}
                for x in diagonals:
                    where = compared(h, np.frombuffer(x["tokens"], np.uint64), x["diagonal"])
                    if where and where > best.get(x["number"], ((0, 0, 0, 0), 0))[0]:
                        best[x["number"]] = where, x["item"]
                at += [k] * len(best)
                rows += [(i, *where) for where, i in best.values()]
            columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[j] for r in rows], pa.int64()) for j in range(5))], names=[*batch.schema.names[2:], "item_id", *(x.split()[0] for x in FOUND.split(", "))])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in asked.schema.fields[2:])
    return asked.mapInArrow(run, f"{kinds}item_id long, {FOUND}")


def held(items: DataFrame) -> list[tuple[int, np.ndarray]] | None:
    """The items, if they have so few seeds that a task holds them."""
    if items.agg(F.coalesce(F.sum("seeds"), F.lit(0))).first()[0] > HELD_SEEDS:
        return None
    return [(r[0], np.frombuffer(r[1], np.uint64)) for r in items.select("item", "tokens").collect()]


def contaminated(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, n_matches, n_aligned, doc_start, item_start (in tokens)."""
    small_batches(documents.sparkSession)
    tables = Tables(documents.sparkSession, "contaminated")
    table = items_of(benchmark, tables, item, text)
    items, schema = held(table), f"doc_id long, item_id long, {FOUND}"
    texts = documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    if items is None:
        return overlapping(texts, table, "text", item, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, hashes = Seeds.of(items), WordHashes()
        for batch in batches:
            h, ends = over_texts(batch, 1, hashes)
            ids = batch.column(0).to_pylist()
            rows = [(ids[doc], seeds.items[i], *x) for doc, i, *x in overlaps(h, ends, seeds)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return texts.mapInArrow(run, schema)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of documents that overlap with no benchmark item, with their own columns."""
    small_batches(documents.sparkSession)
    tables = Tables(documents.sparkSession, "clean")
    table = items_of(benchmark, tables, item, "text")
    items, at = held(table), documents.columns.index(text)
    if items is None:
        row = unused(documents, "row")
        numbered = tables.keep(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = overlapping(numbered.select(F.col(row).alias("found"), F.col(text).alias("text")), table, "text", item, tables)
        dirty = tables.keep(found.select(F.col("found").alias(row)).distinct(), "dirty")
        return numbered.join(bounded_broadcast(dirty), row, "left_anti").select(*documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, hashes = Seeds.of(items), WordHashes()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for doc, *_ in overlaps(*over_texts(batch, at, hashes), seeds):
                keep[doc] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
