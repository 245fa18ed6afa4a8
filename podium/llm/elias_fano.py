"""Elias-Fano sequences and a two-level n-gram trie over them, in flat byte arrays that can be memory-mapped."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: Bits set in a byte, and where the k-th of them is.
COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
SELECT = np.array([[next((j for j in range(8) if b >> j & 1 and bin(b & (1 << j) - 1).count("1") == k), 0) for k in range(8)] for b in range(256)], np.uint8)


class Sequence:
    """A monotone sequence: the low bits of each value packed, the high bits as unary gaps in a bit vector.

    A count of the ones before each 64 bits makes any value readable on its own.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        v = values.astype(np.uint64)
        low = np.zeros(n * width // 8 + 16, np.uint8)
        if width and n:
            bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if n * width < 1 << 22 else None
            if bits is not None:
                packed = np.packbits(bits.reshape(-1), bitorder="little")
            else:  # a multiple of eight values at a time, so that bytes don't straddle
                step = (1 << 22) // width // 8 * 8
                packed = np.concatenate([np.packbits(((v[k : k + step, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") for k in range(0, n, step)])
            low[: len(packed)] = packed
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) if n else 0) // 64 + 1
        bits = np.zeros(size * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(COUNT[high].reshape(-1, 8).sum(axis=1))]).astype(np.uint32)
        return cls(n, width, low, high, ones)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        word = np.searchsorted(self.ones, i, "right") - 1
        rest = i - self.ones[word]
        byte = word * 8
        for _ in range(7):
            here = COUNT[self.high[byte]]
            onward = rest >= here
            rest = rest - np.where(onward, here, 0)
            byte = byte + onward
            if not onward.any():
                break
        # a step that stays marks the byte; later steps must not leave it, and don't: rest < here there
        place = byte * 8 + SELECT[self.high[byte], rest]
        value = (place - i).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bit = i * self.width
            words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
            value |= (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
        return value

    def successor(self, target: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each target the first place in [first, last) whose value isn't less, or last."""
        low, high = first.astype(np.int64), last.astype(np.int64)
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = self.get(middle) < target[active]
            low[active] = np.where(less, middle + 1, low[active])
            high[active] = np.where(less, high[active], middle)
            active = active[low[active] < high[active]]
        return low

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.ones]

    @classmethod
    def from_arrays(cls, a: list[np.ndarray]) -> Sequence:
        return cls(int(a[0][0]), int(a[0][1]), *a[1:4])


class Trie:
    """Bigrams of one shard: words and contexts by hash, pointers into the entries, and a code for each entry.

    An entry is its word's rank plus the rank of its context times the number of words, so that the entries of
    all contexts are one monotone sequence, and a context's are searched relative to it. Codes are quantised
    log-probabilities: code k stands for -k / STEPS.
    """

    STEPS = 20

    def __init__(self, words: Sequence, contexts: Sequence, pointers: Sequence, entries: Sequence, codes: np.ndarray):
        self.words, self.contexts, self.pointers, self.entries, self.codes = words, contexts, pointers, entries, codes

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, log10: np.ndarray) -> Trie:
        """From hashes of contexts and words, sorted by both, without repetition."""
        words, rank = np.unique(word, return_inverse=True)
        contexts, owner, n = np.unique(context, return_inverse=True, return_counts=True)
        entries = rank.astype(np.uint64) + owner.astype(np.uint64) * np.uint64(len(words))
        return cls(Sequence.of(words), Sequence.of(contexts), Sequence.of(np.concatenate([[0], np.cumsum(n)])), Sequence.of(entries), cls.quantised(log10))

    @classmethod
    def quantised(cls, log10: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(-log10 * cls.STEPS), 0, 255).astype(np.uint8)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each bigram is there, and its code if so; bigrams sorted by context are found fastest."""
        found, code = np.zeros(len(word), bool), np.zeros(len(word), np.uint8)
        if not self.entries.n or not len(word):
            return found, code
        known, place = self._rank(self.contexts, context)
        also, rank = self._rank(self.words, word)
        at = np.flatnonzero(known & also)
        owner = place[at]
        target = rank[at].astype(np.uint64) + owner.astype(np.uint64) * np.uint64(self.words.n)
        last = self.pointers.get(owner + 1).astype(np.int64)
        where = self.entries.successor(target, self.pointers.get(owner), last)
        inside = np.flatnonzero(where < last)
        hit = inside[self.entries.get(where[inside]) == target[inside]]
        found[at[hit]] = True
        code[at[hit]] = self.codes[where[hit]]
        return found, code

    @staticmethod
    def _rank(of: Sequence, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each value is in the sequence, and where; the sequence, of one shard's words, is read through once."""
        all_values = of.get(np.arange(of.n))
        place = np.minimum(np.searchsorted(all_values, values), max(of.n - 1, 0))
        return (all_values[place] == values) if of.n else np.zeros(len(values), bool), place

    def to_bytes(self) -> bytes:
        arrays = [a for s in (self.words, self.contexts, self.pointers, self.entries) for a in s.arrays()] + [self.codes]
        head = np.array([len(arrays), *(x for a in arrays for x in ("uqIB".index({"uint8": "u", "int64": "q", "uint32": "I"}[a.dtype.name]), len(a)))], np.int64)
        parts = [head.tobytes()]
        for a in arrays:
            data = a.tobytes()
            parts += [data, b"\0" * (-len(data) % 8)]
        return b"".join(parts)

    @classmethod
    def from_buffer(cls, data: bytes | mmap.mmap) -> Trie:
        """Arrays over the buffer; nothing is copied."""
        n = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, 2 * n, 8)
        at, arrays = 8 + 16 * n, []
        for kind, size in head.reshape(-1, 2).tolist():
            dtype = np.dtype(("u1", "i8", "u4")[kind])
            arrays.append(np.frombuffer(data, dtype, size, at))
            at += -(-size * dtype.itemsize // 8) * 8
        return cls(*(Sequence.from_arrays(arrays[4 * k : 4 * k + 4]) for k in range(4)), arrays[16])


class Mapped:
    """A trie's bytes as a memory-mapped file of this task; the file is gone when it ends."""

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)

    def __enter__(self) -> Trie:
        return Trie.from_buffer(self.map)

    def __exit__(self, *_: object) -> None:
        self.file.close()  # the mapping goes with the last array over it
