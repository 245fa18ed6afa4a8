r"""Near copies by one-permutation hashing, banded buckets and stars, confirmed on the whole sets.

1.  Each text becomes its set of n-gram hashes. Texts of one set are one class, whose representative is its smallest id; only
    representatives are sketched.
2.  One permutation: the space of hashes is cut into BINS bins, and a bin's value is its smallest hash. A bin without one
    takes the value of the first full bin in a probing order of its own, the same for all sets (optimal densification), so that
    bins of linked sets agree as often as the sets do, for small sets too.
3.  A band is ROWS bins; a hash of its values is a bucket. Of two sets of Jaccard similarity 0.85, the expected share of
    pairs that agree in no band is (1 - 0.85 ** 8) ** 64 = 1.4e-9.
4.  A bucket's sets are joined to one of them by a star, first inside a chunk of representatives, of which the bucket's smallest goes on
    for the bucket, then over all chunks. Candidate pairs are at most as many as representatives times bands, however large a bucket is.
5.  Each pair of a star is confirmed by the whole sets; large stars are dealt to blocks that all have the centre.
6.  Where a bucket's sets are of more than one component after that, pairs of its sets were not compared, as neither is the centre. What is
    outside the bucket's largest component is searched against all of it, in blocks, exactly. So no pair that shares a bucket is lost.
7.  The links' connected components get their smallest id.

No bucket is capped. Null and empty texts have an empty set, link with nothing and are their own component. Texts of fewer words than n are
one n-gram, the whole. Repeated rows are of one class. A row without an id links nothing; it has the component of its class, or none. Rows
that share an id are one document here, whatever their texts. Long texts have one sketch of the same size. An empty table has an empty
result. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import Tables, WordHashes, bounded_broadcast, mix, small_batches, words_of
from podium.llm.jaccard_join import SECOND, across_blocks, ngram_set, set_hash, sets_of, union_root
from podium.operators.components import connected_components

BINS, ROWS = 512, 8
#: Representatives that are joined before anything is shuffled, and sets of a star in one block.
CHUNK, STAR_SETS = 32_768, 256
#: Up to so many full bins the first one of each probing order is looked up; with more of them, probing ends soon.
FEW_FULL = 96


class Sketch:
    """Signatures of sets: one hash of each band."""

    def __init__(self, bins: int = BINS, rows: int = ROWS):
        self.bins, self.rows = bins, rows
        self.bounds = np.array([(j << 64) // bins for j in range(1, bins)], np.uint64)
        self.salts = mix(np.arange(1, bins + 1, dtype=np.uint64))
        random = np.random.default_rng(bins)
        self.probes = np.stack([random.permutation(bins) for _ in range(bins)]).astype(np.int16)  # of each bin, all bins in its order
        self.ranks = np.argsort(self.probes, axis=1).astype(np.int16)

    def values(self, grams: np.ndarray) -> np.ndarray:
        """The value of each bin, from a sorted set that isn't empty."""
        starts = np.concatenate([[0], np.searchsorted(grams, self.bounds)])
        full = starts < np.append(starts[1:], len(grams))
        source = np.arange(self.bins)
        empty, own = np.flatnonzero(~full), np.flatnonzero(full)
        if len(own) <= FEW_FULL:
            source[empty] = own[self.ranks[np.ix_(empty, own)].argmin(axis=1)]
        else:
            for attempt in range(self.bins):
                if not len(empty):
                    break
                source[empty] = self.probes[empty, attempt]
                empty = empty[~full[source[empty]]]
        return grams[starts[source]]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        return mix(mix(self.values(grams) ^ self.salts).reshape(-1, self.rows).sum(axis=1, dtype=np.uint64))


def sketched(documents: DataFrame, n: int, percent: int, id_column: str, text: str) -> DataFrame:
    """(id, n, hash1, hash2, bands) of each row; of a batch's equal sets, one has the bands, and sets too small to be linked with another have none."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = WordHashes(), Sketch()
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            sets = [ngram_set(words_of(t), hashes, n) for t in batch.column(1).to_pylist()]
            first = [set_hash(s) for s in sets]
            second = [set_hash(s ^ SECOND) for s in sets]
            bands: list[bytes | None] = []
            seen: set[tuple[int, int, int]] = set()
            for node, s, a, b in zip(ids.to_pylist(), sets, first, second, strict=True):
                needed = node is not None and 100 * len(s) >= percent * (len(s) + 1) and (len(s), a, b) not in seen
                bands.append(sketch(s).tobytes() if needed else None)
                if needed:
                    seen.add((len(s), a, b))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.binary())], names=["id", "n", "hash1", "hash2", "bands"]
            )

    return documents.select(id_column, text).mapInArrow(run, "id long, n long, hash1 long, hash2 long, bands binary")


def chunked(representatives: DataFrame) -> DataFrame:
    """(node, signature, center): what a chunk's buckets join, as stars (signature is null); and the buckets that go on, each with its own smallest node of the chunk (center is null).

    A bucket goes on with a node that is in it, so that two sets which share a bucket of their own are compared with each other, whatever chunks they are of."""

    def joined(nodes: np.ndarray, bands: np.ndarray) -> Iterator[pa.RecordBatch]:
        signature, node = bands.ravel(), np.repeat(nodes, bands.shape[1])
        order = np.lexsort((node, signature))
        signature, node = signature[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
        least = np.repeat(node[start], np.diff(np.append(start, len(node))))
        pairs = np.unique(np.stack([node[node != least], least[node != least]], axis=1), axis=0)
        parent = {x: x for x in nodes.tolist()}
        for a, b in pairs.tolist():
            a, b = union_root(parent, a), union_root(parent, b)
            parent[max(a, b)] = min(a, b)
        # a node whose root isn't in a star with it is joined to its root too
        own = np.array([(x, union_root(parent, x)) for x in parent], np.int64).reshape(-1, 2)
        edges = np.unique(np.concatenate([pairs, own[own[:, 0] != own[:, 1]]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.nulls(len(edges), pa.int64()), pa.array(edges[:, 1])], names=["node", "signature", "center"])
        for k in range(0, len(start), 1 << 17):
            mine = start[k : k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(signature[mine]), pa.nulls(len(mine), pa.int64())], names=["node", "signature", "center"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, bands, held = [], [], 0
        for batch in batches:
            nodes.append(batch.column(0).to_numpy())
            bands.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, -1))
            held += batch.num_rows
            if held >= CHUNK:
                yield from joined(np.concatenate(nodes), np.concatenate(bands))
                nodes, bands, held = [], [], 0
        if held:
            yield from joined(np.concatenate(nodes), np.concatenate(bands))

    return representatives.select("node", "bands").mapInArrow(run, "node long, signature long, center long")


def stars(hits: DataFrame, tables: Tables) -> DataFrame:
    """(src, dst): each node of hits (signature, node), a written table, and the smallest node that has the same signature, if that is another."""
    least = F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size")
    shared = tables.keep(hits.groupBy("signature").agg(*least).where("least < most"), "shared-signatures")
    # most signatures have two nodes: these are an edge without a join
    pairs = shared.where("size = 2").select(F.col("most").alias("src"), F.col("least").alias("dst"))
    large = tables.keep(shared.where("size > 2").select("signature", "least"), "large-signatures")
    return pairs.unionByName(hits.join(bounded_broadcast(large), "signature").where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst")))


def confirmed(documents: DataFrame, edges: DataFrame, hashes: DataFrame, n: int, percent: int, id_column: str, text: str, tables: Tables) -> DataFrame:
    """The edges (src, dst) whose whole sets are linked."""
    sizes = tables.keep(edges.groupBy(F.col("dst").alias("part")).agg(F.ceil(F.count("*") / STAR_SETS).cast("int").alias("blocks")), "stars")
    large = bounded_broadcast(tables.keep(sizes.where("blocks > 1"), "large-stars"))
    asking = edges.select(F.col("src").alias("node"), F.col("dst").alias("part")).join(large, "part", "left")
    asking = asking.select("node", F.struct("part", F.array(F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")).alias("low"), F.lit(True).alias("asks")).alias("at"))
    centers = sizes.select(F.col("part").alias("node"), F.struct("part", F.sequence(F.lit(0), F.col("blocks") - 1).alias("low"), F.lit(False).alias("asks")).alias("at"))
    places = asking.unionByName(centers).groupBy("node").agg(F.collect_list("at").alias("at"))  # a node has no more stars than bands
    wanted = tables.keep(places.join(hashes, "node").select("node", "hash1", "at"), "star-places")
    sets = sets_of(documents, wanted, n, id_column, text).select("node", "grams", F.explode("at").alias("at"))
    sets = sets.select("node", "grams", "at.part", "at.asks", F.explode("at.low").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, center = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for part, low, asks, node, grams in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = np.frombuffer(grams, np.uint64)
                if not asks:
                    key, center = (part, low), own
                elif (part, low) == key and len(center):
                    common = int((center[np.minimum(np.searchsorted(center, own), len(center) - 1)] == own).sum())
                    if 100 * common >= percent * (len(own) + len(center) - common):
                        out.append((node, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["src", "dst"])

    dealt = sets.repartition("part", "low").sortWithinPartitions("part", "low", "asks", "node")
    return dealt.select("part", "low", "asks", "node", "grams").mapInArrow(run, "src long, dst long")


def bucketed(representatives: DataFrame) -> DataFrame:
    """(signature, node, label) of each representative (node, label, bands) and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            times = len(bands) // max(1, batch.num_rows)
            of = [pa.array(np.repeat(batch.column(k).to_numpy(), times)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(bands), *of], names=["signature", "node", "label"])

    return representatives.select("node", "label", "bands").mapInArrow(run, "signature long, node long, label long")


def components(documents: DataFrame, n: int = 3, percent: int = 85, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id_column, n_shingles, component_id (the smallest id among what it is linked with over any number of links) and kept (whether that is its own)."""
    tables = Tables(documents.sparkSession, "minhash")
    rows = tables.keep(sketched(documents, n, percent, id_column, text), "sketches")
    key = ["n", "hash1", "hash2"]
    classes = tables.keep(rows.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("node"), F.max("bands").alias("bands")), "classes")
    own = classes.where("bands is not null")
    passed = tables.keep(chunked(own), "buckets")
    inside = passed.where("center is not null").select(F.col("node").alias("src"), F.col("center").alias("dst"))
    edges = tables.keep(inside.unionByName(stars(passed.where("center is null"), tables)).distinct(), "candidate-pairs")
    hashes = classes.select("node", "hash1")
    links = tables.keep(confirmed(documents, edges, hashes, n, percent, id_column, text, tables), "links")
    joined = tables.keep(connected_components(links, tables.keep, drop=tables.drop), "linked")
    # buckets that hold more than one component, and sets that no star has compared
    ends = tables.keep(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct(), "candidates")
    labels = ends.join(joined.withColumnRenamed("component", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    hits = tables.keep(bucketed(own.join(labels, "node").select("node", "label", "bands")), "hits")
    several = hits.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high and size > 2").select("signature")
    unsettled = tables.keep(several, "unsettled-buckets")
    if not unsettled.isEmpty():
        groups = tables.keep(connected_components(edges, tables.keep, drop=tables.drop), "candidate-groups")
        left = tables.keep(hits.join(bounded_broadcast(unsettled), "signature").join(groups, "node").select("signature", "node", "label", "component"), "unsettled")
        more = across_blocks(documents, left, hashes, n, percent, id_column, text, tables)
        if more is not None:
            joined = tables.keep(connected_components(links.unionByName(more), tables.keep, drop=tables.drop), "linked")
    reached = joined.select("node", F.col("component").alias("reached"))
    named = tables.keep(classes.join(reached, "node", "left").select(*key, F.coalesce("reached", "node").alias("component_id")), "class-components")
    tables.drop_all_but(rows, named)
    of = rows.select("id", *key).join(named, key, "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return of.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")) & F.col(id_column).isNotNull())
