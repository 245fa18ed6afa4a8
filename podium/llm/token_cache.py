r"""Token ids of whole texts through the tokenizers library, piece by piece.

A byte-pair encoding never joins what its first split has separated. Both vocabularies' first split ends a
piece where white space follows something else, and where a Latin letter is followed by an ASCII character
that is no letter. So a text's ids are those of its pieces, one after the other, and a piece that returns is
looked up. White space is Unicode's, as in the library.

New words are given to the library many at once: a word's ids begin, or end, where the vocabulary marks it.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
from tokenizers import Tokenizer

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
PIECE = re.compile(f"[{SPACE}]*(?:[{LATIN}]+(?=[\\x00-@\\[-`{{-\\x7f]|\\Z)|[^{SPACE}]+)|[{SPACE}]+")
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD, SPACED_WORD = re.compile(f"[{SPACE}]*[{LATIN}]+"), re.compile(f" [{LATIN}]+")
TOGETHER = 2000


@lru_cache(maxsize=1)
def token_cache(path: str, limit: int = 300_000) -> TokenCache:
    """The cache of this Python worker, which Spark uses for one task after the other."""
    return TokenCache(path, limit)


class TokenCache:
    """Remembers up to `limit` pieces (and what one batch adds), then starts anew."""

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.ends, self.begins = np.zeros(size, bool), np.zeros(size, bool)
        for token, k in vocabulary.items():
            self.ends[k], self.begins[k] = token.endswith("</w>"), token.startswith("Ġ")
        self.marks_ends = bool(self.ends.any())
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)  # of a piece
        self.words: dict[str, int] = defaultdict(count().__next__)  # of what the library is given for a piece
        self.word_of = np.zeros(1 << 16, np.int64)
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)  # of a word's ids
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def ids_of_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.index) > self.limit:
            self._forget()
        old = len(self.index)
        split = [PIECE.findall(text) if text else [] for text in texts]
        ends = np.cumsum([0, *map(len, split)], dtype=np.int64)
        pieces = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]))
        if len(self.index) > old:
            self._learn(list(islice(reversed(self.index), len(self.index) - old))[::-1], old)
        at = self.word_of[pieces]
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[ends])

    def _learn(self, new: list[str], first: int) -> None:
        old = len(self.words)
        given = [x.strip(BLANKS).lower() if WORD.fullmatch(x) else x for x in new] if self.marks_ends else new
        of = np.fromiter(map(self.words.__getitem__, given), np.int64, len(new))
        self.word_of = grown(self.word_of, first + len(new))
        self.word_of[first : first + len(new)] = of
        self.start, self.size = grown(self.start, len(self.words)), grown(self.size, len(self.words))
        unknown = list(islice(reversed(self.words), len(self.words) - old))[::-1]
        plain = (WORD if self.marks_ends else SPACED_WORD).fullmatch
        many = np.array([bool(plain(w)) for w in unknown], bool)
        together, alone = np.flatnonzero(many), np.flatnonzero(~many)
        for k in range(0, len(together), TOGETHER):
            at = together[k : k + TOGETHER]
            part = [unknown[j] for j in at]
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.marks_ends else "").join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1 if self.marks_ends else np.append(np.flatnonzero(self.begins[ids])[1:], len(ids))
            if len(ends) != len(part):  # the marks don't tell these apart
                alone = np.append(alone, at)
                continue
            starts = np.append(0, ends[:-1])
            self.start[old + at], self.size[old + at] = self._keep(ids) + starts, ends - starts
        for j, found in zip(alone.tolist(), self.tokenizer.encode_batch_fast([unknown[j] for j in alone], add_special_tokens=False), strict=True):
            self.start[old + j], self.size[old + j] = self._keep(np.array(found.ids, np.uint32)), len(found.ids)

    def _keep(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        self.ids = grown(self.ids, self.used)
        self.ids[at : self.used] = ids
        return at


def grown(x: np.ndarray, size: int) -> np.ndarray:
    """x with room for size entries."""
    return x if size <= len(x) else np.concatenate([x, np.zeros(2 * size - len(x), x.dtype)])
