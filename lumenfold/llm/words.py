"""Words as 64-bit hashes, many texts at once. Words are runs of anything but ASCII white space; A-Z are lower-cased."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from .common import only

#: Words a worker keeps; it starts anew beyond that, so its memory is bounded.
KEPT = 300_000
#: Characters of the rows that are split at once.
PART = 1 << 20


class _Numbers(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.new.append(xxhash.xxh64_intdigest(word))
        return i


class Hasher:
    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers, self.hashes, self.used = _Numbers(), np.zeros(1 << 16, np.uint64), 0

    def alone(self) -> None:
        only("words", self.clear)

    def __call__(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all rows' words one after another, and the number of each row's. Rows are split into words some at a time."""
        hashes, counts, at = [], [], 0
        while at < len(rows):
            size, end = 0, at
            while end < len(rows) and size < PART:
                size += len(rows[end])
                end += 1
            h, n = self._part(rows[at:end])
            hashes.append(h)
            counts.append(n)
            at = end
        return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def numbered(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes of all rows' words in ascending order, the words as numbers of these, and the number of each row's."""
        if len(self.numbers) > KEPT:
            self.clear()
        found, counts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(rows):
            size, end = 0, at
            while end < len(rows) and size < PART:
                size += len(rows[end])
                end += 1
            n, i = self._numbers(rows[at:end])
            counts.append(n)
            found.append(i)
            at = end
        numbers = np.concatenate(found)
        met = np.zeros(self.used, bool)
        met[numbers] = True
        distinct = np.flatnonzero(met)
        hashes = self.hashes[distinct]
        order = np.argsort(hashes)
        place = np.zeros(self.used, np.int32)
        place[distinct[order]] = np.arange(len(distinct), dtype=np.int32)
        return hashes[order], place[numbers], np.concatenate(counts)

    def _part(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > KEPT:
            self.clear()
        counts, at = self._numbers(rows)
        return self.hashes[at], counts

    def _numbers(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [r.encode("utf-8", "surrogatepass").lower().split() for r in rows]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.numbers.new:
            end = self.used + len(self.numbers.new)
            if end > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(max(end - len(self.hashes), len(self.hashes)), np.uint64)])
            self.hashes[self.used : end] = self.numbers.new
            self.used = end
            self.numbers.new.clear()
        return counts, at


#: One for a Python worker.
hasher = Hasher()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbours."""
    return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[1:] + np.uint64(0xD1B54A32D192ED03)))
