r"""Token ids as patched frame-of-reference blocks.

A segment holds the ids of consecutive documents. Its ids are cut into blocks of 128; a block keeps its
minimum, a bit width that a percentile of its differences needs, the packed differences, and a list of
exceptions (place and high bits) for the larger ones. An index has where each block starts, so that any
block is read alone. Layout, little-endian:

    magic "PFR1", u32 ids, u32 blocks, u32 documents
    i64 document ids, u32 tokens of each document
    u32 start of each block in the body (and its end)
    body; a block: u32 minimum, u8 width, u8 exceptions, packed differences (16 x width bytes), u8 places, u32 high bits

Files are written by Spark's Parquet writer, one segment a row, in the shared folder: executors see each
other's files, a lost task is run again, and a segment's row tells its range of documents.

A part is a task of the sorted range, whose rows are the same when it runs again. A null or empty text has its end id alone. Repeated ids of documents keep their rows, in a stable order by
text. An empty table gives no segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import bounded_broadcast, ids_in, ids_out, scratch, small_batches, written
from podium.llm.token_cache import token_cache

BLOCK, MAGIC = 128, b"PFR1"
PERCENTILE = 90


def widths_of(x: np.ndarray) -> np.ndarray:
    """Bits that each value, of at most 53 bits, needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int8)


def encode_ids(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks in the body, with its end, and the body."""
    n = len(ids)
    if not n:
        return np.zeros(1, "<u4"), b""
    blocks = -(-n // BLOCK)
    grid = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], ids.dtype)]).astype(np.int64).reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    need = widths_of(rest)
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(need, at, axis=1)[:, at].astype(np.int64)
    over = need > width[:, None]
    patches = over.sum(axis=1)
    sizes = 6 + 16 * width + 5 * patches
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(int(starts[-1]), np.uint8)
    at = starts[:-1]
    for k in range(4):
        body[at + k] = (low >> (8 * k)) & 255
    body[at + 4], body[at + 5] = width, patches
    for w in np.unique(width):
        if w == 0:
            continue
        own = np.flatnonzero(width == w)
        for part in np.array_split(own, max(1, len(own) // 512)):
            raw = rest[part].astype("<u4" if w > 16 else "<u2").view(np.uint8).reshape(len(part), BLOCK, -1)
            bits = np.unpackbits(raw, axis=2, count=w, bitorder="little").reshape(len(part), -1)
            packed = np.packbits(bits, axis=1, bitorder="little")
            body[(at[part] + 6)[:, None] + np.arange(16 * w)] = packed
    row, place = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
    first = at[row] + 6 + 16 * width[row]
    body[first + nth] = place
    high = rest[row, place] >> width[row]
    for k in range(4):
        body[first + patches[row] + 4 * nth + k] = (high >> (8 * k)) & 255
    return starts.astype("<u4"), body.tobytes()


def decode_ids(n: int, starts: np.ndarray, body: bytes) -> np.ndarray:
    """The ids of encode_ids."""
    raw = np.frombuffer(body, np.uint8)
    at = starts[:-1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint32)
    low = sum(raw[at + k].astype(np.int64) << (8 * k) for k in range(4))
    width, patches = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    grid = np.zeros((len(at), BLOCK), np.int64)
    for w in np.unique(width):
        if w == 0:
            continue
        own = np.flatnonzero(width == w)
        for part in np.array_split(own, max(1, len(own) // 512)):
            packed = raw[(at[part] + 6)[:, None] + np.arange(16 * w)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
            grid[part] = bits @ (1 << np.arange(w, dtype=np.int64))
    row = np.repeat(np.arange(len(at)), patches)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
    first = at[row] + 6 + 16 * width[row]
    place = raw[first + nth]
    high = sum(raw[first + patches[row] + 4 * nth + k].astype(np.int64) << (8 * k) for k in range(4))
    grid[row, place] += high << width[row]
    return (grid + low[:, None]).reshape(-1)[:n].astype(np.uint32)


def pack_segment(doc_ids: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> bytes:
    starts, body = encode_ids(ids)
    head = MAGIC + np.array([len(ids), len(starts) - 1, len(doc_ids)], "<u4").tobytes()
    return b"".join([head, doc_ids.astype("<i8").tobytes(), tokens.astype("<u4").tobytes(), starts.tobytes(), body])


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, tokens of each, and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks, docs = np.frombuffer(data, "<u4", 3, 4)
    at = 16
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    tokens = np.frombuffer(data, "<u4", docs, at := at + 8 * int(docs))
    starts = np.frombuffer(data, "<u4", int(blocks) + 1, at := at + 4 * int(docs))
    return doc_ids, tokens, decode_ids(int(n), starts, data[at + 4 * (int(blocks) + 1) :])


def read_block(data: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, by the index."""
    n, blocks, docs = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    at = 16 + 12 * docs
    a, b = (int(x) for x in np.frombuffer(data, "<u4", 2, at + 4 * k))
    body = at + 4 * (blocks + 1)
    return decode_ids(min(BLOCK, n - k * BLOCK), np.array([0, b - a]), data[body + a : body + b])


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int, segment_ids: int = 1 << 20, id_column: str = "doc_id", text: str = "text") -> None:
    """Encodes documents in ascending order of ids, equal ones of hashes of their texts, and writes segments of about segment_ids ids to path.

    Columns of the files: part (of the order), start (ids of the part before the segment), n_tokens, data.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache = TaskContext.get().partitionId(), token_cache(tokenizer, 600_000)
        docs: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal start, held
            tokens = np.concatenate(sizes)
            data = pack_segment(np.concatenate(docs), tokens, np.concatenate(parts))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()), "n_tokens": pa.array([int(tokens.sum())], pa.int64()), "data": pa.array([data], pa.binary())})
            start, held = start + int(tokens.sum()), 0
            for x in (docs, parts, sizes):
                x.clear()
            return row

        for batch in batches:
            ids, n = cache.ids_of_all(batch.column(1).to_pylist())
            docs.append(ids_in(batch.column(0)))
            parts.append(np.insert(ids, np.cumsum(n), end_id).astype(np.uint32))
            sizes.append(n + 1)
            held += len(ids) + len(n)
            if held >= segment_ids:
                yield flush()
        if docs:
            yield flush()

    # rows of one id are spread by their texts
    rows = documents.select(F.col(id_column).alias("id"), F.col(text).alias("body"), F.xxhash64(text).alias("hashed"))
    ordered = rows.repartitionByRange("id", "hashed").sortWithinPartitions("id", "hashed", "body").select("id", "body")
    ordered.mapInArrow(run, "part int, start long, n_tokens long, data binary").write.parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """From written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Ids before a segment: those of the earlier parts, and those of its own part, which it holds. The parts are one row for each task of
    the writer, and are broadcast if there are few.
    """
    from pyspark.sql import Window

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = bounded_broadcast(written(parts.select("part", before.alias("before")), "token-parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, tokens, ids = unpack_segment(data.as_py())
                ends = np.cumsum(tokens.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                starts = ends - tokens
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids_out(doc_ids), "start": pa.array(starts + first, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return files.join(places, "part").select((F.col("before") + F.col("start")).alias("first"), "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the ids of documents into the shared folder and reads the files back."""
    path = scratch(documents.sparkSession, "token-ids")
    write_ids(documents, path, tokenizer, end_id)
    return read_ids(documents.sparkSession.read.parquet(path))
