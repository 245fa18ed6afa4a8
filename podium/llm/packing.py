r"""Cost-balanced packing of token ids into sequences.

A document's ids are cut into full sequences, and what is left over, less than a sequence, is packed. The
cost of a piece is linear in its tokens plus quadratic (attention stays inside a piece). Groups of pieces
are packed on their own: descending by length, each goes to the sequence of the lowest cost that has room
for it. A group gets as many sequences as its tokens need; a piece that no sequence has room for is cut to
fill the free places, so only a group's last sequence can need padding. Where what is left is no power of
two, it is the one sequence that is padded.

A group is what one task read, of `group` documents and what is left of a batch: no shuffle, and no task gathers more. A task
that runs again reads the same files in the same order and numbers its sequences alike. Null and empty
texts have their end id alone. Repeated rows are packed each, and rows of one id share it. Of equally long pieces the first one goes first;
of equally cheap sequences, the fullest. An empty table gives no piece. Further columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from podium.llm.common import small_batches
from podium.llm.token_cache import token_cache

#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, in units of one token's feed-forward work.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


@dataclass(frozen=True)
class Piece:
    document: int  # place in the group
    start: int
    length: int
    sequence: int
    offset: int


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int) -> list[Piece]:
    """Pieces of documents of these lengths; sequences are numbered from 0, offsets are gapless from 0."""
    pieces: list[Piece] = []
    sequence = 0
    left: list[tuple[int, int, int]] = []
    for k, n in enumerate(lengths):
        full = n // capacity
        for j in range(full):
            pieces.append(Piece(k, j * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            left.append((n % capacity, k, full * capacity))
    left.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in left)
    bins = total // capacity  # the last, part-filled one takes what is left at the end
    used = [0] * bins
    # open sequences by their free places, each a heap by cost; the least cost with room for n is the least of the heaps from n on
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    rooms[capacity] = [(0.0, b) for b in range(bins)]
    cheapest = np.full(capacity + 1, np.inf)
    if bins:
        cheapest[capacity] = 0.0
    late: list[tuple[int, int, int]] = []
    for n, k, start in left:
        room = n + int(cheapest[n:].argmin())
        if cheapest[room] == np.inf:
            late.append((n, k, start))
            continue
        spent, b = heapq.heappop(rooms[room])
        cheapest[room] = rooms[room][0][0] if rooms[room] else np.inf
        pieces.append(Piece(k, start, n, sequence + b, used[b]))
        used[b] += n
        heapq.heappush(rooms[room - n], (spent + cost(n), b))
        cheapest[room - n] = rooms[room - n][0][0] if room > n else np.inf
    free = [b for b in range(bins) if used[b] < capacity]
    tail = 0
    for n, k, start in late:
        while n and free:
            b = free[-1]
            take = min(n, capacity - used[b])
            pieces.append(Piece(k, start, take, sequence + b, used[b]))
            used[b] += take
            start, n = start + take, n - take
            if used[b] == capacity:
                free.pop()
        if n:
            pieces.append(Piece(k, start, n, sequence + bins, tail))
            tail += n
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, group: int = 8192, group_ids: int = 1 << 23, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece; sequence_id holds the task above bit 40. A task packs up to `group` documents together, or as many as have `group_ids` ids, which bounds what it holds."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, first = token_cache(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        docs: list[int] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held
            lengths = [len(x) // 4 for x in ids]
            pieces = pack(lengths, capacity)
            columns = {
                "doc_id": pa.array([docs[p.document] for p in pieces], pa.int64()),
                "start": pa.array([p.start for p in pieces], pa.int64()),
                "length": pa.array([p.length for p in pieces], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[p.document][4 * p.start : 4 * (p.start + p.length)]) for p in pieces], pa.int64()),
                "doc_tokens": pa.array([lengths[p.document] for p in pieces], pa.int64()),
                "sequence_id": pa.array([first + p.sequence for p in pieces], pa.int64()),
                "offset": pa.array([p.offset for p in pieces], pa.int64()),
                "cost": pa.array([cost(p.length) for p in pieces], pa.float64()),
            }
            first += 1 + max(p.sequence for p in pieces)
            docs.clear()
            ids.clear()
            held = 0
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            docs += batch.column(0).to_pylist()
            found, sizes = cache.ids_of_all(batch.column(1).to_pylist())
            raw, ends = found.astype("<u4").tobytes(), 4 * np.cumsum(sizes)
            ids += [raw[b - 4 * n : b] + end for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            held += len(found) + len(sizes)
            if len(docs) >= group or held >= group_ids:
                yield flush()
        if docs:
            yield flush()

    return documents.select(id_column, text).mapInArrow(run, SCHEMA)
