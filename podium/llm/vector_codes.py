"""Product codes of vectors by a Lloyd iteration that is maintained by deltas.

A component x becomes the integer floor(4096 * x); a vector is cut into PARTS equal parts; each part position has a codebook,
which starts as the parts of the ENTRIES smallest ids. What a round keeps is one table: the vectors, the codes that each had in the
round before, and, from each task, one row for each entry that gained or lost a part: how many, and the sum of those parts, plus
for the entry a part has moved to and minus for the one it has left. Only these rows are shuffled; the driver adds
them to the running sums of the codebooks (PARTS x ENTRIES entries, whatever the table) and divides. All sums are whole numbers,
so neither the order of the rows nor a task that runs twice changes a bit.

Vectors that are null or empty, or hold a null, a NaN or an infinity, are left out, as are those of another length than
the first of the codebooks' rows. Components beyond 32768 either way count as that. If the length is no multiple of PARTS, parts
differ by one component. Rows that share an id are coded each on its own; a codebook starts with one of them, the one
of the smallest bytes. Rows without an id are coded and start no codebook, unless no row has an id: then the result is empty. With fewer than ENTRIES ids
codebooks are as much smaller. An empty table has an empty result. Labels may be null; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import Tables, bounded_broadcast, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Squared distances of components up to this fit a long, summed over any part.
LARGEST = 1 << 27

STATE = "vec_id long, label long, vector binary, code binary, part int, entry int, n long, sums array<long>"


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Which rows have a vector of finite components, and these vectors as integers' bytes."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # of rows that aren't null; nulls are NaN
    ends = np.cumsum(length)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = (length > 0) & (bad[ends] == bad[ends - length])
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.clip(np.floor(x * SCALE), -LARGEST, LARGEST)
    whole = np.where(np.isfinite(scaled), scaled, 0).astype("<i4")
    return good, [whole[e - n : e].tobytes() for e, n in zip(ends[good].tolist(), length[good].tolist(), strict=True)]


def prepared(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, vector) of the rows that have one, as integers."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, own = whole_vectors(batch.column(2))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).filter(keep), batch.column(1).cast(pa.int64()).filter(keep), pa.array(own, pa.binary())], names=["vec_id", "label", "vector"])

    return vectors.select(id_column, label, vector).mapInArrow(run, "vec_id long, label long, vector binary")


def smallest_ids(rows: DataFrame, entries: int) -> list[bytes]:
    """The vectors of the smallest ids; a task passes on no more than it could have of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, bytes] = {}
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is not None and (key not in best or value < best[key]):
                    best[key] = value
            best = dict(sorted(best.items())[:entries])
        yield pa.RecordBatch.from_pydict({"vec_id": pa.array(list(best), pa.int64()), "vector": pa.array(list(best.values()), pa.binary())})

    least = rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector binary").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return [r.vector for r in least.orderBy("vec_id").limit(entries).collect()]


@dataclass
class Codebooks:
    """The entries of each part, and the running count and sum of the parts assigned to each."""

    bounds: list[int]
    entries: list[np.ndarray]  # of each part: entry x component
    counts: list[list[int]]
    sums: list[list[list[int]]]

    @classmethod
    def of(cls, first: list[bytes]) -> Codebooks:
        vectors = [np.frombuffer(x, "<i4").astype(np.int64) for x in first]
        width = len(vectors[0])
        vectors = [x for x in vectors if len(x) == width]
        bounds = [k * width // PARTS for k in range(PARTS + 1)]
        entries = [np.stack([x[a:b] for x in vectors]) for a, b in zip(bounds, bounds[1:], strict=False)]
        return cls(bounds, entries, [[0] * len(vectors) for _ in entries], [[[0] * e.shape[1] for _ in vectors] for e in entries])

    @property
    def width(self) -> int:
        return self.bounds[-1]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector's parts, ties to the lower index, and the squared distances summed over the parts."""
        codes, error = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), np.int64)
        for k, entries in enumerate(self.entries):
            gap = vectors[:, None, self.bounds[k] : self.bounds[k + 1]] - entries[None]
            distance = (gap * gap).sum(axis=2)
            codes[:, k] = distance.argmin(axis=1)
            error += distance.min(axis=1)
        return codes, error

    def add(self, part: int, entry: int, n: int, sums: list[int]) -> None:
        self.counts[part][entry] += n
        self.sums[part][entry] = [a + b for a, b in zip(self.sums[part][entry], sums, strict=True)]

    def move(self) -> None:
        """Each entry becomes the floor of its parts' mean; unused ones stay."""
        for k, counts in enumerate(self.counts):
            self.entries[k] = np.array([[s // n for s in sums] if n else old.tolist() for n, sums, old in zip(counts, self.sums[k], self.entries[k], strict=True)], np.int64).reshape(self.entries[k].shape)

    def digest(self) -> str:
        """SHA-256 of all components in order."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def of_width(batch: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of batch whose vector has this width, and their vectors; rows of deltas have none."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.binary_length(batch.column("vector")), 4 * width), False))
    return batch, np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i4").astype(np.int64).reshape(-1, width)


def reassigned(state: DataFrame, books: Codebooks) -> DataFrame:
    """state with new codes, and a row for each entry that has gained or lost parts in a task."""
    held = "code" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(books.entries[0])
        counts = np.zeros((PARTS, size), np.int64)
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        moved = np.zeros((PARTS, size), bool)
        for batch in batches:
            batch, vectors = of_width(batch, books.width)
            codes, _ = books.nearest(vectors)
            before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS) if held else None
            for k in range(PARTS):
                changed = codes[:, k] != before[:, k] if held else np.ones(len(codes), bool)
                own = vectors[changed, books.bounds[k] : books.bounds[k + 1]]
                for sign, entry in ((1, codes[changed, k]), *([(-1, before[changed, k])] if held else [])):
                    np.add.at(counts[k], entry, sign)
                    np.add.at(sums[k], entry, sign * own)
                    moved[k, entry] = True
            n = len(codes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("vector"), pa.array([x.tobytes() for x in codes], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "label", "vector", "code", "part", "entry", "n", "sums"],
            )
        part, entry = np.nonzero(moved)
        n = len(part)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array([sums[p][e].tolist() for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))],
            names=["vec_id", "label", "vector", "code", "part", "entry", "n", "sums"],
        )

    return state.mapInArrow(run, STATE)


def take_deltas(state: DataFrame, books: Codebooks) -> None:
    """Adds what has moved to the running sums: at most an entry's components for each entry come to the driver."""
    moved = state.where("part is not null").select("part", "entry", "n", "sums")
    summed = moved.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value")).groupBy("part", "entry", "at").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in summed.collect():  # PARTS x ENTRIES x (components + 1) rows at most
        found.setdefault((r.part, r.entry), {})[r.at] = r.value
    for (part, entry), values in found.items():
        books.add(part, entry, values[0], [values[k] for k in range(1, len(values))])


def coded(state: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of the vectors under these codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, vectors = of_width(batch, books.width)
            codes, error = books.nearest(vectors)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes().hex() for x in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label long, code string, error long")


def compressed(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of each vector, and the codebooks (None if no row starts one)."""
    tables = Tables(vectors.sparkSession, "vector-codes")
    state = tables.keep(prepared(vectors, id_column, vector, label), "vectors")
    first = smallest_ids(state, entries)
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, label long, code string, error long"), None
    books = Codebooks.of(first)
    for _ in range(rounds):
        after = tables.keep(reassigned(state, books), "assigned")
        tables.drop(state)
        state = after
        take_deltas(state, books)
        books.move()
    codes = tables.keep(coded(state.where("part is null") if rounds else state, books), "codes")
    tables.drop(state)
    return codes, books


def with_label_errors(codes: DataFrame, books: Codebooks | None) -> DataFrame:
    """codes with label_error, the error summed over the rows of the same label, and the digest of the codebooks."""
    summed = Tables(codes.sparkSession, "label-errors").keep(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "sums")
    joined = codes.join(bounded_broadcast(summed), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
