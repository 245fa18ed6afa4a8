r"""Bigram language model in sharded Elias-Fano tries, trained on and asked by all documents.

Documents are gathered into blocks: the hashes of a block's words, and its tokens as numbers of these. What a
block sends is deduplicated in it, and goes to shards by hash, so neither a frequent word nor a frequent
bigram comes to a task more than once a block.

1.  Words: a block sends the hashes and training counts of its words to the words' shards, which add up over
    all blocks and answer with the totals.
2.  Bigrams: a block sends its distinct bigrams, with the totals of their words and its training counts. A
    shard adds up, smooths (Dirichlet: each context starts with PRIOR tokens dealt by the unigrams), builds
    its trie, maps it into memory, and answers for every bigram with a quantised log-probability, from the
    trie or by backing off.
3.  Each block adds up what its documents' tokens got.

A shard's bigrams are a slice by hash of context and word, so a frequent context is spread over all shards. The
number of shards grows with the tokens. Every table between the steps is written to the shared folder.

Tokens are words in lower case and one end a document. Null and empty texts have only the end. Repeated rows
count as often as they come. Nothing is learned from an empty training set: then N and V are 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import WordHashes, ids_in, ids_out, mix, scratch, small_batches, words_of, written
from podium.llm.elias_fano import Mapped, Trie

#: Tokens of a block and, on average, bigrams of a shard.
BLOCK_TOKENS, SHARD_TOKENS = 2_000_000, 400_000
#: Tokens that each context starts with.
PRIOR = 6.0
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n end", b"\n begin"))

#: Totals of words below this are sent as they are; larger ones in twentieths of a decimal logarithm.
EXACT = 64

BLOCKS = "block long, n_tokens long, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed planes: all first bytes, all second bytes, and so on."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], "<u4").tobytes()
    planes = [np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.compress(head + b"".join(planes), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays of packed(), as unsigned integers."""
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, out = 4 + 8 * n, []
    for size, length in np.frombuffer(raw, "<u4", 2 * n, 4).reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1))
        at += size * length
    return out


def total_codes(totals: np.ndarray) -> np.ndarray:
    large = EXACT + np.rint(20 * np.log10(np.maximum(totals, 1) / EXACT))
    return np.where(totals < EXACT, totals, np.minimum(large, 255)).astype(np.uint8)


def coded_totals(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < EXACT, codes, EXACT * 10.0 ** ((codes.astype(np.float64) - EXACT) / 20))


def blocks_of(documents: DataFrame, held_out: Column, id_column: str, text: str) -> DataFrame:
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, hashes = TaskContext.get().partitionId() << 32, WordHashes()
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        words: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, total
            distinct, tokens, n = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            rank = np.empty(len(n), np.uint32)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(n))  # frequent words have small numbers, which pack well
            by_rank = np.empty(len(n), np.uint64)
            by_rank[rank] = distinct
            data = packed(np.concatenate(ids).view(np.uint64), np.concatenate(held).astype(np.uint8), np.concatenate(sizes).astype(np.uint32), by_rank, rank[tokens])
            row = pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "data": pa.array([data], pa.binary())})
            for x in (ids, held, sizes, words):
                x.clear()
            block, total = block + 1, 0
            return row

        for batch in batches:
            texts = [words_of(t) for t in batch.column(2).to_pylist()]
            size = np.array([len(t) + 1 for t in texts])
            h = hashes([w for t in texts for w in t])
            words.append(np.insert(h, np.cumsum(size - 1), END))
            ids.append(ids_in(batch.column(0)))
            held.append(np.array(batch.column(1).to_pylist(), bool))
            sizes.append(size)
            total += len(words[-1])
            if total >= BLOCK_TOKENS:
                yield flush()
        if total:
            yield flush()

    return rows.mapInArrow(run, BLOCKS)


class Block:
    """A row of blocks."""

    def __init__(self, number: int, data: bytes):
        self.number = number
        ids, held, sizes, self.words, tokens = unpacked(data)
        self.doc_ids, self.held_out, self.sizes, self.tokens = ids.view(np.int64), held.astype(bool), sizes.astype(np.int64), tokens.astype(np.int64)
        self.by_hash = np.argsort(self.words, kind="stable")

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        return cls(table.column("block")[0].as_py(), table.column("data")[0].as_py())

    def totals(self, answers: pa.Table) -> np.ndarray:
        """Of each word, from the answers of the words' shards."""
        out = np.empty(len(self.words), np.int64)
        out[self.by_hash] = np.concatenate([np.zeros(0, np.uint32), *answered(answers, "word")])
        return out

    def trained(self) -> np.ndarray:
        """Of each token, whether it is learned from."""
        return np.repeat(~self.held_out, self.sizes)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct bigrams in order of their hash, each token's place in them, and the training counts.

        A key is context times the number of words plus word; the context after the last word is the begin.
        """
        n = len(self.words)
        context = np.concatenate([[n], self.tokens[:-1]])
        context[np.cumsum(self.sizes)[:-1]] = n
        context *= n
        context += self.tokens
        keys, of = np.unique(context, return_inverse=True)
        del context
        order = np.argsort(self.bigram_hash(keys), kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        of = back[of]
        counts = np.bincount(of, self.trained(), len(keys)).astype(np.int64)
        return keys[order], of, counts

    def context_hashes(self) -> np.ndarray:
        return np.append(self.words, BEGIN)

    def bigram_hash(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.words)
        return mix(mix(self.context_hashes()[keys // n]) + self.words[keys % n])


def slices(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ends of the slices of sorted hashes that go to each shard."""
    step = (1 << 64) // shards
    return np.append(np.searchsorted(hashes, np.array([k * step for k in range(1, shards)], np.uint64)), len(hashes)).astype(np.int64)


def word_requests(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(number, data.as_py())
                words = block.words[block.by_hash]
                counts = np.bincount(block.tokens, block.trained(), len(words)).astype(np.uint32)[block.by_hash]
                start = 0
                for shard, end in enumerate(slices(words, shards).tolist()):
                    if end > start:
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "block": pa.array([number], pa.int64()), "data": [packed(words[start:end], counts[start:end])]})
                    start = end

    return blocks.select("block", "data").mapInArrow(run, "shard long, block long, data binary")


def word_answers(requests: DataFrame) -> DataFrame:
    """Totals for each request, and, as block -1, the shard's tokens and distinct words."""

    def run(table: pa.Table) -> pa.Table:
        asked = [unpacked(x.as_py()) for x in table.column("data")]
        words, counts = [x[0] for x in asked], np.concatenate([x[1] for x in asked]).astype(np.int64)
        distinct, of = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(of, counts, len(distinct)).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        answers = [packed(total[of[e - len(w) : e]].astype(np.uint32)) for w, e in zip(words, ends.tolist(), strict=True)]
        n = table.num_rows + 1
        return pa.table({
            "kind": pa.array(["word"] * n), "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int64()),
            "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "data": pa.array([*answers, b""], pa.binary()),
            "n": pa.array([*[0] * (n - 1), int(total.sum())], pa.int64()), "v": pa.array([*[0] * (n - 1), int((total > 0).sum())], pa.int64()),
        })

    return requests.groupBy("shard").applyInArrow(run, "kind string, shard long, block long, data binary, n long, v long")


def answered(table: pa.Table, kind: str) -> list[np.ndarray]:
    """A block's answers of one kind, in the order of the shards."""
    rows = sorted((s, d) for k, s, d in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True) if k == kind)
    return [unpacked(d)[0] for _, d in rows]


def short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of a hash: inside a shard two of these tell a bigram from all others."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def bigram_requests(blocks: DataFrame, answers: DataFrame, shards: int, begins: int) -> DataFrame:
    """Runs of equal contexts: their hashes, codes of totals and lengths; words' hashes, codes of totals and training counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("shard", "block", "data")}
        if left.num_rows and right.num_rows:
            block = Block.of(left)
            codes = total_codes(np.append(block.totals(right), begins))
            keys, _, counts = block.bigrams()
            n, hashes, start = len(block.words), short(block.context_hashes()), 0
            for shard, end in enumerate(slices(block.bigram_hash(keys), shards).tolist()):
                if end > start:
                    part = sending_order(keys[start:end], hashes, n)
                    context, word = np.divmod(keys[start:end][part], n)
                    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                    runs = np.diff(np.append(first, len(word))).astype(np.uint32)
                    own = hashes[context[first]]
                    out["data"].append(packed(np.diff(own, prepend=np.uint32(0)), codes[context[first]], runs, hashes[word], codes[word], counts[start:end][part].astype(np.uint32)))
                    out["shard"].append(shard)
                    out["block"].append(block.number)
                start = end
        return pa.table({k: pa.array(v, pa.binary() if k == "data" else pa.int64()) for k, v in out.items()})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "shard long, block long, data binary")


def sending_order(keys: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """By the hash of the context, so that differences are small; then by the context and the word."""
    return np.lexsort((keys, hashes[keys // n]))


def bigram_answers(requests: DataFrame, n: int, v: int) -> DataFrame:
    """A code for each bigram asked for, and the shard's trie as block -1."""

    def run(table: pa.Table) -> pa.Table:
        asked = [unpacked(x.as_py()) for x in table.column("data")]
        spread = lambda k, f: np.concatenate([np.repeat(f(x[k]), x[2]) for x in asked])
        context, context_total = spread(0, lambda x: np.cumsum(x, dtype=np.uint32)), coded_totals(spread(1, np.asarray))
        words = [x[3] for x in asked]
        word, word_total, counts = np.concatenate(words), coded_totals(np.concatenate([x[4] for x in asked])), np.concatenate([x[5] for x in asked])
        unigram = (word_total + 1.0) / (n + v + 1.0)
        order = np.lexsort((word, context))
        c, w = context[order], word[order]
        first = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first)) if len(order) else np.zeros(0, np.int64)
        at, total = order[first][total > 0], total[total > 0]
        trie = Trie.of(context[at], word[at], np.log10((total + PRIOR * unigram[at]) / (context_total[at] + PRIOR)))
        data = trie.to_bytes()
        with Mapped(data) as mapped:
            found, code = mapped.find(context, word)
        back_off = Trie.quantised(np.log10(PRIOR * unigram / (context_total + PRIOR)))
        code = np.where(found, code, back_off)
        ends = np.cumsum([len(x) for x in words])
        answers = [packed(code[e - len(x) : e]) for x, e in zip(words, ends.tolist(), strict=True)]
        rows = table.num_rows + 1
        return pa.table({
            "kind": pa.array([*["bigram"] * (rows - 1), "trie"]), "shard": pa.array([table.column("shard")[0].as_py()] * rows, pa.int64()),
            "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "data": pa.array([*answers, data], pa.binary()),
        })

    return requests.groupBy("shard").applyInArrow(run, "kind string, shard long, block long, data binary")


def block_scores(blocks: DataFrame, answers: DataFrame, shards: int, n: int, v: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        block = Block.of(left)
        totals = block.totals(right).astype(np.float64)
        keys, of, _ = block.bigrams()
        n_words, hashes, start = len(block.words), short(block.context_hashes()), 0
        asked = np.empty(len(keys), np.uint8)
        told = iter(answered(right, "bigram"))
        for end in slices(block.bigram_hash(keys), shards).tolist():
            if end > start:
                asked[start + sending_order(keys[start:end], hashes, n_words)] = next(told)
                start = end
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        sums = lambda x: np.bincount(doc, x, len(block.sizes))
        return pa.table({
            "doc_id": ids_out(block.doc_ids), "held_out": pa.array(block.held_out), "n_tokens": pa.array(block.sizes, pa.int64()),
            "n_known": pa.array(sums(totals[block.tokens] > 0).astype(np.int64)), "base_score": pa.array(sums(np.log10((totals + 1) / (n + v + 1.0))[block.tokens])),
            "score": pa.array(sums((asked / -float(Trie.STEPS))[of])),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def bucketed(blocks: DataFrame) -> DataFrame:
    """blocks as a table in the shared folder, in buckets: what is grouped by block later finds them where they are.

    Only a table of the catalog has buckets; its name is dropped at once, and its files, which are not the catalog's, stay.
    """
    spark, name = blocks.sparkSession, f"lm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(buckets, "block").option("path", scratch(spark, "lm-blocks")).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved from here on
    spark.sql(f"drop table {name}")
    return table


def train_and_score(documents: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows that aren't held out and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    blocks = bucketed(blocks_of(documents, held_out, id_column, text))
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(8, -(-tokens // SHARD_TOKENS))
    words = written(word_answers(word_requests(blocks, shards)), "lm-words")
    n, v = words.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    begins = documents.where(~F.coalesce(held_out, F.lit(False))).count()
    told = words.where("block >= 0").select("kind", "shard", "block", "data")
    bigrams = written(bigram_answers(bigram_requests(blocks, told, shards, begins), n, v), "lm-tries")
    scores = block_scores(blocks, told.unionByName(bigrams.where("block >= 0")), shards, n, v)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
