r"""Documents linked by the Jaccard similarity of their word n-grams, exactly.

1.  Each text becomes its set of n-gram hashes. Texts of one set are one class, whose representative is its
    smallest id; only representatives are compared.
2.  Linked sets differ in at most K of their n-grams, where K depends on their sizes. The space of hashes is cut
    into K + 1 + r ranges, so both have the same n-grams in r + 1 ranges at least. Each set leaves out its r
    ranges of fewest n-grams and signs the others, each with a hash of all n-grams inside. The fullest range on
    which both agree is left out by neither, so linked sets have a signature in common. Sizes are of classes, one
    100 / percent times the other; a set signs for its own class and for the one below. A signature stands for
    several n-grams at once, so frequent n-grams and shared passages don't bring texts together.
3.  What signatures connect is a candidate group, dealt to blocks of bounded size which all have the group's first
    set; a block is searched for T-occurrences. Its n-grams are an inverted index; for each set the longest lists are put aside
    (DivideSkip), the short ones are merged by a heap, and what occurs often enough in those is probed for in the
    long ones by binary search.
4.  A signature whose sets, after that, are of more than one component has sets in several blocks that
    were never compared. Those outside its largest component are searched against all of its sets, in pairs of blocks. Signatures
    of the same sets are searched once, and a candidate group at once if that is less work than its signatures one by one.
5.  The links' connected components get their smallest id.

No candidate is capped and no link is lost. Null and empty texts have an empty set, link with nothing and are
their own component. Texts of fewer words than n are one n-gram, the whole. Repeated rows are of one class. A
row without an id links nothing; it has the component of its class, or none. Rows that share an id are one document
here, whatever their texts. Further columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import Tables, WordHashes, bounded_broadcast, mix, small_batches, words_of
from podium.operators.components import connected_components

#: A block has about so many sets, and n-grams, at most.
BLOCK_SETS, BLOCK_GRAMS = 512, 1 << 21
#: Signatures that a task joins before it passes them on.
CHUNK_SIGNATURES = 1 << 21
#: Buckets of the n-grams' frequencies, their slices, and tasks whose counts are added up first.
BUCKET_BITS, SLICES, TASKS_TOGETHER = 22, 64, 128
#: The weight of an n-gram that one text has; one that c texts have weighs a c-th.
RARE = 1 << 20
#: The weight of the logarithm in DivideSkip's number of long lists.
MU = 0.0085
#: Set to all bits of a content hash and of a second hash of a set.
CONTENT, SECOND = np.uint64(0x5851F42D4C957F2D), np.uint64(0xA5A5A5A55A5A5A5A)


def ngram_set(words: list[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """The distinct hashes of the n-grams, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = mix(total + h[k : len(h) - size + 1 + k])
    return np.unique(total)


def set_hash(grams: np.ndarray) -> int:
    return int(mix(grams).sum(dtype=np.uint64).astype(np.int64))


def bucket(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def rarity(documents: DataFrame, n: int, text: str) -> np.ndarray:
    """The weight of an n-gram for each bucket of hashes, from how many texts have one of the bucket: of one size for any corpus.

    All texts are counted. It says which ranges are weak; any weights give the same links.
    """
    small_batches(documents.sparkSession)
    slice_size = (1 << BUCKET_BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, counts = WordHashes(), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, bucket(ngram_set(words_of(text), hashes, n)), 1)
        if counts.any():
            group = TaskContext.get().partitionId() // TASKS_TOGETHER
            parts = [counts[k : k + slice_size].astype("<i8").tobytes() for k in range(0, 1 << BUCKET_BITS, slice_size)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "group": pa.array([group] * SLICES, pa.int32()), "counts": pa.array([zlib.compress(x, 1) for x in parts], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in rows.column("counts"))
        return pa.table({"slice": rows.column("slice")[:1], "group": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "slice int, group int, counts binary"
    summed = documents.select(text).mapInArrow(run, schema).groupBy("slice", "group").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in summed.collect():  # SLICES rows
        counts[row.slice * slice_size : (row.slice + 1) * slice_size] = np.frombuffer(zlib.decompress(row.counts), "<i8")
    return (RARE // np.maximum(counts, 1)).astype("<i4")


@dataclass(frozen=True)
class Scheme:
    """How sets of one class of sizes, and the larger ones they can be linked with, are signed."""

    spare: int  # the weakest ranges, which are left out
    bounds: np.ndarray  # between the ranges
    salts: np.ndarray  # of the ranges


class Signatures:
    def __init__(self, percent: int, weights: np.ndarray | None = None):
        self.percent, self.weights = percent, weights
        self.first = [1]  # the smallest size of each class
        self.schemes: list[Scheme | None] = []

    def _grow(self) -> None:
        k, low = len(self.schemes), self.first[-1]
        high = 100 * low // self.percent  # the largest of the class
        self.first.append(high + 1)
        # sizes n and m of linked sets: they share 100 / (100 + percent) * percent / 100 of n + m at least
        differ = (100 - self.percent) * (high + 100 * high // self.percent) // (100 + self.percent)
        if not differ:  # such sets are linked only if they are equal
            self.schemes.append(None)
            return
        spare = 1 + differ // 4
        ranges = differ + 1 + spare
        bounds = np.array([(j << 64) // ranges for j in range(1, ranges)], np.uint64)
        self.schemes.append(Scheme(spare, bounds, mix(np.arange(ranges, dtype=np.uint64) + np.uint64(k << 32))))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The signatures of a set of n-grams, which is sorted."""
        n = len(grams)
        while self.first[-1] <= n:
            self._grow()
        own = bisect_right(self.first, n) - 1
        total, strength, out = None, None, [np.zeros(0, np.uint64)]
        for scheme in self.schemes[max(0, own - 1) : own + 1] if n else ():
            if scheme is None:
                continue
            if total is None:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ CONTENT), dtype=np.uint64)])
                # whole numbers: a range is as strong in one set as in another
                strength = np.arange(n + 1) if self.weights is None else np.concatenate([[0], np.cumsum(self.weights[bucket(grams)], dtype=np.int64)])
            at = np.concatenate([[0], np.searchsorted(grams, scheme.bounds), [n]])
            full = np.argsort(np.diff(strength[at]), kind="stable")[scheme.spare :]
            out.append(mix(total[at[full + 1]] - total[at[full]] + scheme.salts[full]))
        return np.concatenate(out)


def described(documents: DataFrame, n: int, percent: int, id_column: str, text: str) -> DataFrame:
    """For each row (node, n, hash1, hash2) of its set; and, with n = -1, a row for each node whose signature hash1, a smaller node, has too.

    Signatures are in no table: they are shuffled once, and what they have in common is all that is left. A task joins some CHUNK_SIGNATURES of them
    itself and passes each on once, with one node for all that it has joined. So a signature that a third of all sets have comes to a
    task once for thousands of sets, and its rows are fewer than those of the task's other signatures.
    """
    small_batches(documents.sparkSession)
    packed = zlib.compress(rarity(documents, n, text).tobytes(), 1)
    names = ["node", "signature", "n", "hash1", "hash2"]

    def spread(salt: np.ndarray) -> pa.Array:
        """Rows that are no signatures are spread over the tasks."""
        return pa.array(mix(np.arange(len(salt), dtype=np.uint64) + salt.view(np.uint64)).view(np.int64))

    def joined(nodes: list[int], signed: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        signature = np.concatenate([np.zeros(0, np.uint64), *signed])
        node = np.repeat(np.array(nodes, np.int64), [len(s) for s in signed])
        order = np.lexsort((node, signature))
        signature, node = signature[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]])) if len(node) else np.zeros(0, np.int64)
        near = np.repeat(node[start], np.diff(np.append(start, len(node))))
        # what a chunk has connected has one edge a node, and signs as its smallest node
        parent = {x: x for x in nodes}
        for a, b in np.unique(np.stack([node[node != near], near[node != near]], axis=1), axis=0).tolist():
            a, b = union_root(parent, a), union_root(parent, b)
            parent[max(a, b)] = min(a, b)
        root = {x: union_root(parent, x) for x in parent}
        src, dst = np.array([(x, r) for x, r in root.items() if x != r], np.int64).reshape(-1, 2).T
        none = pa.nulls(len(src), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(src), spread(np.ascontiguousarray(dst)), pa.array(np.full(len(src), -1)), pa.array(dst), none], names=names)
        for k in range(0, len(start), 1 << 17):
            part = start[k : k + (1 << 17)]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([root[x] for x in node[part].tolist()], pa.int64()), pa.array(signature[part].view(np.int64)), none, none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = WordHashes(), Signatures(percent, np.frombuffer(zlib.decompress(packed), "<i4"))
        seen: set[tuple[int, int, int]] = set()
        nodes: list[int] = []
        signed: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = [ngram_set(words_of(t), hashes, n) for t in batch.column(1).to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            first = np.array([set_hash(s) for s in sets], np.int64)
            second = np.array([set_hash(s ^ SECOND) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), spread(first), pa.array(size), pa.array(first), pa.array(second)], names=names)
            for node, s, *key in zip(ids, sets, size.tolist(), first.tolist(), second.tolist(), strict=True):
                if node is None or not len(s) or tuple(key) in seen:
                    continue
                seen.add(tuple(key))
                nodes.append(node)
                signed.append(sign(s))
                held += len(signed[-1])
            if held >= CHUNK_SIGNATURES:
                yield from joined(nodes, signed)
                seen, nodes, signed, held = set(), [], [], 0
        if nodes:
            yield from joined(nodes, signed)

    rows = documents.select(id_column, text).mapInArrow(run, "node long, signature long, n long, hash1 long, hash2 long")
    least = F.first("node").over(Window.partitionBy("signature").orderBy("node"))
    of = rows.withColumn("least", least).where("n is not null or node <> least")
    return of.select("node", F.coalesce("n", F.lit(-1)).alias("n"), F.when(F.col("n").isNull(), F.col("least")).otherwise(F.col("hash1")).alias("hash1"), "hash2")


def union_root(parent: list[int] | dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def merged_by_heap(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """What occurs in ascending lists, and how often."""
    found: list[int] = []
    count: list[int] = []
    last = None
    for x in heapq.merge(*lists):
        if x == last:
            count[-1] += 1
        else:
            found.append(x)
            count.append(1)
            last = x
    return np.array(found, np.int64), np.array(count, np.int64)


def search(sets: list[np.ndarray], index: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect what T-occurrence search links: the first `index` sets are indexed, the others are queries.

    With index == len(sets), each is a query against those before it. Pairs that are connected already are left out.
    """
    sizes = np.array([len(s) for s in sets])
    itself = index == len(sets)
    owner = np.repeat(np.arange(index), sizes[:index])
    grams, gram = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets[:index]]), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    postings = owner[order]  # of each n-gram, ascending
    ends = np.cumsum(np.bincount(gram, minlength=len(grams)))
    starts = np.concatenate([[0], ends[:-1]])
    keys = gram[order].astype(np.int64) * max(index, 1) + postings  # ascending: list, then set
    parent = list(range(len(sets)))
    links = []
    for q in range(0 if itself else index, len(sets)):
        at = np.searchsorted(grams, sets[q])
        lists = at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == sets[q])] if len(grams) else at[:0]
        least = -(-percent * int(sizes[q]) // 100)  # what the smallest linked set has in common
        if len(lists) < least:
            continue
        # of sets before the query, where each is one
        stop = np.searchsorted(keys, lists * index + q) if itself else ends[lists]
        length = stop - starts[lists]
        by_length = np.argsort(length, kind="stable")
        longest = int(length.max())
        if not longest:
            continue
        put_aside = min(least - 1, int(least / (MU * math.log(longest + 1) + 1)))
        short, long = by_length[: len(lists) - put_aside], lists[by_length[len(lists) - put_aside :]]
        found, count = merged_by_heap([postings[starts[lists[g]] : stop[g]].tolist() for g in short.tolist() if length[g]])
        if not len(found):
            continue
        # 100 * common >= percent * union, with union = sizes - common
        need = -(-percent * (sizes[q] + sizes[found]) // (100 + percent))
        ok = (count + len(long) >= need) & (np.minimum(sizes[q], sizes[found]) >= need)
        found, count, need = found[ok], count[ok], need[ok]
        left = len(long)
        for chunk in np.array_split(long, max(1, len(long) // 24)) if len(found) else []:
            probe = chunk[:, None] * index + found[None, :]
            place = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            count = count + (keys[place] == probe).sum(axis=0)
            left -= len(chunk)
            ok = count + left >= need
            found, count, need = found[ok], count[ok], need[ok]
            if not len(found):
                break
        for c in found[count >= need].tolist():
            mine, other = union_root(parent, q), union_root(parent, c)
            if mine != other:
                parent[max(mine, other)] = min(mine, other)
                links.append((q, c))
    return links


def links_in(blocks: DataFrame, percent: int) -> DataFrame:
    """Links inside each (part, low, high) of blocks (.., asks, node, grams), whose rows come together: rows that ask are compared with the others, or all rows if none asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[bool, int, np.ndarray]] = []
        key = None
        out: list[tuple[int, int]] = []

        def finish() -> None:
            if len(own) > 1:
                out.extend((own[a][1], own[b][1]) for a, b in search([r[2] for r in own], sum(not r[0] for r in own), percent))
            own.clear()

        def drained() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["src", "dst"])
            out.clear()
            return done

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for part, low, high, asks, node, grams in zip(*columns, strict=True):
                if (part, low, high) != key:
                    finish()
                    key = (part, low, high)
                own.append((asks, node, np.frombuffer(grams, np.uint64)))
            if out:
                yield drained()
        finish()
        if out:
            yield drained()

    keys = ["part", "low", "high"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys, "asks", "node").select(*keys, "asks", "node", "grams").mapInArrow(run, "src long, dst long")


def sets_of(documents: DataFrame, wanted: DataFrame, n: int, id_column: str, text: str) -> DataFrame:
    """wanted (node, hash1, ...), a written table, with the sets of the texts as grams."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.col(id_column).alias("node"), F.col(text).alias("body"))
    rows = texts.join(bounded_broadcast(wanted), "node").select(*wanted.columns, "body")
    hashed = wanted.columns.index("hash1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            grams = [ngram_set(words_of(t), hashes, n) for t in batch.column(batch.num_columns - 1).to_pylist()]
            # of rows that share an id, the one whose set is meant
            mine = [set_hash(s) == h for s, h in zip(grams, batch.column(hashed).to_pylist(), strict=True)]
            whole = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s.tobytes() for s in grams], pa.binary())], names=[*batch.schema.names[:-1], "grams"])
            yield whole.filter(pa.array(mine))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, grams binary")


def signed(sets: DataFrame, percent: int) -> DataFrame:
    """(signature, node, label, component) of sets (node, label, component, grams); without weights, as all of these are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signatures(percent)
        for batch in batches:
            own = [sign(np.frombuffer(x.as_py(), np.uint64)) for x in batch.column(3)]
            times = [len(s) for s in own]
            of = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), times), pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)), *of], names=["signature", "node", "label", "component"])

    return sets.select("node", "label", "component", "grams").mapInArrow(run, "signature long, node long, label long, component long")


def across_blocks(documents: DataFrame, hits: DataFrame, hashes: DataFrame, n: int, percent: int, id_column: str, text: str, tables: Tables) -> DataFrame | None:
    """Links between the nodes of hits (signature, node, label, component), a written table, that share a signature and are not of one label; None if there is no
    such signature. hashes (node, hash1) says which sets are meant."""
    blocks = lambda size: F.ceil(size / F.lit(BLOCK_SETS)).cast("int")
    size, main = F.col("size"), F.col("main")

    def parts(members: DataFrame, part: str) -> DataFrame:
        """What is of more than one label in each part: how many, the label of most, and two hashes of all."""
        of = members.groupBy("component", part, "label").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        return of.groupBy("component", part).agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("labels > 1")

    once = parts(hits, "signature").groupBy("component", "size", "x", "y").agg(F.min(F.struct("signature", "main")).alias("l"))
    lists = tables.keep(once.select("component", F.col("l.signature").alias("part"), "size", F.col("l.main").alias("main")), "open-signatures")
    if lists.isEmpty():
        return None
    listed = hits.withColumnRenamed("signature", "part")
    members = tables.keep(listed.join(bounded_broadcast(lists), ["component", "part"]).select("component", "part", "node", "label", "size", "main"), "open-members")
    # a component whose lists have much in common is less work as a whole
    whole = members.select("component", F.col("component").alias("part"), "node", "label").distinct()
    as_whole = parts(whole, "part").select("component", "part", "size", "main")
    work = as_whole.join(lists.groupBy("component").agg(F.sum("size").alias("listed")), "component")
    left = size - main["c"]
    cheap = tables.keep(work.where(size * blocks(left) + left * blocks(size) <= F.col("listed")).select("component", "part", "size", "main"), "whole-components")
    by_list = members.join(bounded_broadcast(cheap).select("component"), "component", "left_anti")
    own = whole.join(bounded_broadcast(cheap), ["component", "part"]).unionByName(by_list)
    own = own.select("part", "node", "label", main["label"].alias("main"), blocks(size).alias("lows"), blocks(left).alias("highs"))
    at = lambda count: F.array(F.pmod(F.xxhash64("node"), F.col(count)).cast("int"))
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    indexed = own.select("node", F.struct("part", F.lit(False).alias("asks"), at("lows").alias("low"), every("highs").alias("high")).alias("at"))
    asking = own.where("label <> main").select("node", F.struct("part", F.lit(True).alias("asks"), every("lows").alias("low"), at("highs").alias("high")).alias("at"))
    places = indexed.unionByName(asking).groupBy("node").agg(F.collect_list("at").alias("at"))
    wanted = tables.keep(places.join(hashes, "node").select("node", "hash1", "at"), "block-places")
    sets = sets_of(documents, wanted, n, id_column, text).select("node", "grams", F.explode("at").alias("at"))
    sets = sets.select("node", "grams", "at.part", "at.asks", F.explode("at.low").alias("low"), "at.high")
    return tables.keep(links_in(sets.withColumn("high", F.explode("high")), percent), "links-across")


def components(documents: DataFrame, n: int = 3, percent: int = 90, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id_column, n_shingles, and component_id, the smallest id among what it is linked with over any number of links."""
    tables = Tables(documents.sparkSession, "ngram-join")
    passed = tables.keep(described(documents, n, percent, id_column, text), "ngram-sets")
    key = ["n", "hash1", "hash2"]
    rows = passed.where("n >= 0").select(F.col("node").alias("id"), *key)
    classes = tables.keep(rows.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("first")), "ngram-classes")
    near = tables.keep(passed.where("n < 0").select(F.col("node").alias("src"), F.col("hash1").alias("dst")).distinct(), "candidate-edges")
    grouped = tables.keep(connected_components(near, tables.keep, drop=tables.drop), "candidate-nodes")
    found = rows.join(bounded_broadcast(grouped).withColumnRenamed("node", "id"), "id").groupBy(*key).agg(F.min("component").alias("component"))
    members = tables.keep(found.join(classes, key).select(F.col("first").alias("node"), *key, "component"), "candidates")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("grams"), F.min("node").alias("center")).where("size > 1")
    groups = tables.keep(sizes.select("component", "center", blocks.alias("blocks")), "candidate-groups")
    low = F.when(F.col("node") == F.col("center"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    dealt = tables.keep(members.join(bounded_broadcast(groups), "component").select("node", "hash1", F.col("component").alias("part"), low.alias("low"), "blocks"), "blocks")
    sets = sets_of(documents, dealt, n, id_column, text).withColumn("low", F.explode("low")).withColumns({"high": F.col("low"), "asks": F.lit(False)})
    links = tables.keep(links_in(sets, percent), "links")
    joined = tables.keep(connected_components(links, tables.keep, drop=tables.drop), "linked")
    split = dealt.where("blocks > 1").select("node", "hash1", F.col("part").alias("component"))
    if not split.isEmpty():
        label = joined.withColumnRenamed("component", "label")
        nodes = tables.keep(split.join(label, "node", "left").select("node", "hash1", F.coalesce("label", "node").alias("label"), "component"), "split-nodes")
        hits = tables.keep(signed(sets_of(documents, nodes, n, id_column, text), percent).distinct(), "signed")
        more = across_blocks(documents, hits, nodes.select("node", "hash1"), n, percent, id_column, text, tables)
        if more is not None:
            joined = tables.keep(connected_components(links.unionByName(more), tables.keep, drop=tables.drop), "linked")
    reached = joined.select(F.col("node").alias("first"), F.col("component").alias("reached"))
    named = tables.keep(classes.join(reached, "first", "left").select(*key, F.coalesce("reached", "first").alias("component_id")), "class-components")
    tables.drop_all_but(passed, named)
    return rows.join(named, key, "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
