"""External induced suffix sorting with common prefixes (after Bingmann, Fischer and Osipov, 2013), in batches of vector operations.

Suffixes starting at a local minimum (a smaller type preceded by a larger: LMS) are sorted first. The substrings between them get names in
their order; where names repeat, the string of names is sorted by the same procedure, recursively. The sorted minima are the seeds of two
passes: the larger-type suffixes are induced from left to right, the smaller-type ones from right to left. A priority queue carries each
suffix as a tuple of its first character and type (the priority), its position, and its common prefix with the one queued before it under
the same priority: one more than the least common prefix met between the two that induced them. Equals leave the queue as they came.

The queue is cut into ranges of priorities. What it holds beyond `memory` entries goes to files below `folder`, and comes back a range at a
time; a range that is worked on is cut again where it would be too large. So it holds a few batches in memory, however long the string. The
string itself, with a type for each place, is read at random and stays in memory, as do the names of its minima while they are sorted.
Order and common prefixes matter up to `depth` characters only; beyond that order is arbitrary, and prefixes are given as `depth`."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Entries a queue holds in memory; an entry takes 9 to 17 bytes.
IN_MEMORY = 8 << 20
#: Ranges of priorities in a queue; strings of up to LEAST names are sorted in memory, longer ones by recursion.
RANGES, LEAST = 1 << 10, 2 << 20

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


class Store:
    """Batches of entries, in memory or in files of the folder, which go when the store is closed."""

    def __init__(self, folder: str | None) -> None:
        self.folder, self.files, self.written = folder, [], 0

    def put(self, batches: list[Entries]) -> list[tuple]:
        from pyarrow import fs

        if self.folder is None:
            raise MemoryError("the queue is full, and there is no folder for what it holds")
        where, root = fs.FileSystem.from_uri(self.folder)
        where.create_dir(root, recursive=True)
        path, at, out = f"{root}/queue-{uuid.uuid4().hex}", 0, []
        with where.open_output_stream(path) as f:
            for batch in batches:
                f.write(b"".join(np.ascontiguousarray(x).tobytes() for x in batch))
                out.append((where, path, at, len(batch[0]), [x.dtype for x in batch]))
                at += sum(x.nbytes for x in batch)
        self.files.append((where, path))
        self.written += at
        return out

    @staticmethod
    def get(place: tuple) -> Entries:
        where, path, at, n, kinds = place
        with where.open_input_file(path) as f:
            f.seek(at)
            raw = f.read(n * sum(k.itemsize for k in kinds))
        out, at = [], 0
        for k in kinds:
            out.append(np.frombuffer(raw, k, n, at))
            at += n * k.itemsize
        return tuple(out)

    def close(self) -> None:
        for where, path in self.files:
            where.delete_file(path)
        self.files = []


class Queue:
    """A priority queue of (priority, position, common prefix) whose priorities never fall below those taken."""

    def __init__(self, priorities: int, memory: int, store: Store) -> None:
        self.shift = 0
        while priorities >> self.shift > RANGES:
            self.shift += 1
        self.held: list[list] = [[] for _ in range((priorities >> self.shift) + 1)]
        self.at, self.size, self.memory, self.store = -1, 0, memory, store

    def push(self, k: np.ndarray, p: np.ndarray, c: np.ndarray) -> Entries | None:
        """Entries in ascending order of priority, equals in theirs. Those of the range that is worked on are given back if it holds several
        priorities: their place may be before what is left of it."""
        part = k >> self.shift
        back = None
        if self.shift:
            n = int(np.searchsorted(part, self.at, "right"))
            if n:
                back = k[:n], p[:n], c[:n]
                k, p, c, part = k[n:], p[n:], c[n:], part[n:]
        if len(k):
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() + [len(k)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.held[int(part[a])].append((k[a:b], p[a:b], c[a:b]))
            self.size += len(k)
            if self.size > self.memory:
                self.spill()
        return back

    def spill(self) -> None:
        places = [(r, i) for r, held in enumerate(self.held) for i, x in enumerate(held) if len(x) == 3]
        for (r, i), at in zip(places, self.store.put([self.held[r][i] for r, i in places]), strict=True):
            self.held[r][i] = at
        self.size = 0

    def take(self) -> Entries | None:
        """All of the lowest range, in order; None if nothing is left."""
        self.at = max(0, self.at)
        while self.at < len(self.held) and not self.held[self.at]:
            self.at += 1
        if self.at == len(self.held):
            return None
        batches, self.held[self.at] = self.held[self.at], []
        self.size -= sum(len(x[0]) for x in batches if len(x) == 3)
        batches = [x if len(x) == 3 else Store.get(x) for x in batches]
        out = tuple(np.concatenate(x) for x in zip(*batches, strict=True)) if len(batches) > 1 else batches[0]
        return _ordered(out) if self.shift else out


def _ordered(entries: Entries) -> Entries:
    order = np.argsort(entries[0], kind="stable")
    return tuple(x[order] for x in entries)


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of the smaller type: less than the one that follows. The last suffix is not."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    at = np.where(differs, np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # a run of equal characters has the type of what ends it
    up = np.append(text[:-1] < text[1:], False)
    return up[at]


class _Least:
    """Least of any stretch of a batch's common prefixes, from those of stretches of each power of two."""

    def __init__(self, c: np.ndarray) -> None:
        levels = max(1, len(c).bit_length())
        self.table = np.empty((levels, len(c)), np.uint8)
        self.table[0] = c
        for j in range(1, levels):
            half = 1 << (j - 1)
            self.table[j] = self.table[j - 1]
            np.minimum(self.table[j - 1][:-half], self.table[j - 1][half:], out=self.table[j][: len(c) - half])
        self.log = np.zeros(len(c) + 2, np.uint8)
        for j in range(1, levels + 1):
            self.log[1 << j :] = j

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """From a to b, both included."""
        j = self.log[b - a + 1].astype(np.int64)
        return np.minimum(self.table[j, a], self.table[j, b - (1 << j) + 1])


class _Text:
    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, self.depth, self.n = text, depth, len(text)
        self.small = _types(text)
        self.kind = np.int32 if len(text) < 1 << 31 else np.int64

    def runs(self, p: np.ndarray) -> np.ndarray:
        """How often the character at each place is repeated from there on, up to depth."""
        out = np.ones(len(p), np.int64)
        alive = np.arange(len(p))
        for r in range(1, self.depth):
            q = p[alive] + r
            alive = alive[(q < self.n) & (self.text[np.minimum(q, self.n - 1)] == self.text[p[alive]])]
            if not len(alive):
                break
            out[alive] += 1
        return out

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at a and b, up to depth, of which `known` characters are known already."""
        out, n = np.minimum(known, self.depth), self.n
        alive = np.flatnonzero(out < self.depth)
        step = 8 if self.text.dtype == np.uint8 else 1
        if step == 8:
            padded = np.concatenate([self.text, np.zeros(16, np.uint8)])
            words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        while len(alive):
            x, y = a[alive] + out[alive], b[alive] + out[alive]
            inside = (x < n) & (y < n)
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            if step == 8:
                differ = words[x] ^ words[y]
                low = differ & (~differ + np.uint64(1))
                same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            else:
                same = (self.text[x] == self.text[y]).astype(np.int64)
            out[alive] += np.where(inside, same, 0)
            alive = alive[inside & (same == step) & (out[alive] < self.depth)]
        return np.minimum(np.minimum(out, self.depth), n - np.maximum(a, b))

    def induce(self, queue: Queue, priority, small: bool) -> Iterator[Entries]:
        """Takes all entries in order; each induces the suffix before it, if that has the type. priority(characters) is that of an induced one."""
        text, types, depth = self.text, self.small, self.depth
        since = np.full(queue.shift + (len(queue.held) << queue.shift) + 2, 255, np.uint8)  # least prefix met since the last one was queued, by priority
        last_k, last_p = -1, 0
        left, width = None, 1 << 12
        while True:
            if left is None or not len(left[0]):
                left = queue.take()
                if left is None:
                    return
            if queue.shift and len(left[0]) > width:
                k, p, c = (x[:width] for x in left)
            else:
                k, p, c = left
            before = p - 1
            found = before >= 0
            found &= types[before] if small else ~types[before]
            keys = priority(text[before])
            if queue.shift:  # up to the first that an induced one has to go before
                least = np.minimum.accumulate(np.where(found, keys, np.iinfo(keys.dtype).max))
                late = np.flatnonzero(k[1:] > least[:-1])
                m = int(late[0]) + 1 if len(late) else len(k)
                width = max(1 << 10, 2 * m) if m < len(k) else 2 * width
                k, p, c, found, keys = k[:m], p[:m], c[:m], found[:m], keys[:m]
                left = tuple(x[m:] for x in left)
            else:
                left = None
            # where the priority changes, characters differ, or one type ends and the other begins
            other = np.flatnonzero(np.concatenate([[k[0] != last_k], k[1:] != k[:-1]]))
            c = c.copy()
            if len(other):
                k0 = np.where(other > 0, k[other - 1], last_k)
                p0 = np.where(other > 0, p[other - 1], last_p)
                c[other] = 0
                same = np.flatnonzero((k0 >> 1 == k[other] >> 1) & (k0 >= 0))
                if len(same):
                    at = other[same]
                    c[at] = np.minimum(self.runs(p0[same].astype(np.int64)), self.runs(p[at].astype(np.int64)))
            last_k, last_p = int(k[-1]), int(p[-1])
            yield k, p, c
            at = np.flatnonzero(found)
            if len(at):
                keys = keys[at]
                order = np.argsort(keys, kind="stable")
                at, keys = at[order], keys[order]
                least = _Least(c)
                first = np.concatenate([[True], keys[1:] != keys[:-1]])
                lows = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
                prefix = least(lows, at)
                heads = np.flatnonzero(first)
                prefix[heads] = np.minimum(prefix[heads], since[keys[heads]])
                prefix = np.minimum(prefix, depth - 1).astype(np.uint8) + np.uint8(1)
                tails = np.append(heads[1:], len(at)) - 1
                np.minimum(since, np.uint8(c.min()), out=since)
                rest = at[tails] + 1
                since[keys[tails]] = np.where(rest < len(c), least(np.minimum(rest, len(c) - 1), np.full(len(rest), len(c) - 1)), 255)
                back = queue.push(keys, p[at] - p.dtype.type(1), prefix)
                if back is not None:
                    left = _ordered(tuple(np.concatenate(x) for x in zip(left, back, strict=True)))
            else:
                np.minimum(since, np.uint8(c.min()), out=since)


def _names(t: _Text, lms: np.ndarray) -> np.ndarray:
    """Names of the substrings from each minimum to the next, in their order: characters are compared first, then types."""
    bits = (2 * int(t.text.max()) + 2).bit_length()
    per = max(1, 63 // bits)
    ends = np.append(lms[1:], t.n - 1)

    def packed(at: np.ndarray, end: np.ndarray, r: int) -> np.ndarray:
        key = np.zeros(len(at), np.int64)
        for j in range(per):
            q = np.minimum(at + (r + j), t.n - 1)
            key = key << bits | np.where(at + (r + j) <= end, 2 * t.text[q].astype(np.int64) + t.small[q] + 1, 0)
        return key

    _, names, counts = np.unique(packed(lms, ends, 0), return_inverse=True, return_counts=True)
    reach = per
    while reach < t.depth:
        tied = np.flatnonzero((counts[names] > 1) & (lms + reach <= ends))
        if not len(tied):
            break
        key = packed(lms[tied], ends[tied], reach)
        names, counts = _refined(names, counts, tied, key)
        reach += per
    return names


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Positions in ascending order of their suffixes' first `depth` names: ranks of so many names give those of twice as many, among equals."""
    rank, reach, m = names, 1, len(names)
    counts = np.bincount(rank)
    while reach < depth:
        tied = np.flatnonzero(counts[rank] > 1)
        if not len(tied):
            break
        after = np.where(tied + reach < m, rank[np.minimum(tied + reach, m - 1)] + 1, 0)
        rank, counts = _refined(rank, counts, tied, after)
        reach *= 2
    return np.argsort(rank, kind="stable")


def _refined(names: np.ndarray, counts: np.ndarray, tied: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names told apart by `key` where they are `tied`, and how often each occurs."""
    high = int(key.max()) + 1
    if int(names.max()) < (1 << 62) // high:
        both = names[tied] * high + key
        order = np.argsort(both)
        b = both[order]
        a = b // high
    else:
        order = np.lexsort((key, names[tied]))
        a, b = names[tied][order], key[order]
    group = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    part = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    starts = np.repeat(part, np.diff(np.append(part, len(a)))) - np.repeat(group, np.diff(np.append(group, len(a))))
    names = (np.cumsum(counts) - counts)[names]  # names leave gaps, in which a group's parts fit
    names[tied[order]] += starts
    used = np.bincount(names, minlength=len(names))
    names = (np.cumsum(used > 0) - 1)[names]
    return names, used[used > 0]


def _seeds(t: _Text, lms: np.ndarray, memory: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """The minima in the order of their suffixes, and the common prefix of each with the one before."""
    names = _names(t, lms)
    m = len(lms)
    if int(names.max()) + 1 == m:
        order, known = np.empty(m, np.int64), np.zeros(m, np.int64)
        order[names] = np.arange(m)
    elif m <= LEAST:
        order, known = _doubled(names, t.depth // 2 + 1), np.zeros(m, np.int64)
    else:  # a name stands for two characters at least
        blocks = list(_descending(names, t.depth // 2 + 1, memory, store))
        order = np.concatenate([p for p, _ in blocks])[::-1].astype(np.int64)
        equal = np.concatenate([c for _, c in blocks]).astype(np.int64)
        equal = np.append(0, equal[:0:-1])  # of each with the one before it, now in ascending order
        known = np.zeros(m, np.int64)
        reach = np.maximum(order[1:], order[:-1]) + equal[1:]
        inside = reach < m
        known[1:] = np.where(inside, lms[np.minimum(order[1:] + equal[1:], m - 1)] - lms[order[1:]], 0)
    sorted_ = lms[order]
    common = np.zeros(m, np.uint8)
    common[1:] = t.common(sorted_[:-1], sorted_[1:], known[1:])
    return sorted_, common


def _descending(text: np.ndarray, depth: int, memory: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in batches of (positions, common prefix with the one given before)."""
    n = len(text)
    if depth <= 1 or n < 2:
        values = text.tolist()
        order = np.array(sorted(range(n), key=lambda i: values[i : i + depth], reverse=True), np.int64)
        t = _Text(text, depth)
        yield order, np.append(0, t.common(order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64))).astype(np.uint8)[:n]
        return
    t = _Text(text, depth)
    lms = np.flatnonzero(t.small[1:] & ~t.small[:-1]) + 1
    characters = int(text.max()) + 1
    key = np.int32 if 2 * characters + 2 < 1 << 31 else np.int64
    queue = Queue(2 * characters, memory, store)
    # The end of the string is less than anything: the last suffix is the first that is induced.
    queue.push(np.array([2 * int(text[-1])], key), np.array([n - 1], t.kind), np.zeros(1, np.uint8))
    if len(lms):
        seeds, common = _seeds(t, lms, memory, store)
        queue.push(2 * text[seeds].astype(key) + key(1), seeds.astype(t.kind), common)
        del seeds, common
    larger: list[tuple] = []
    held = 0
    for entries in t.induce(queue, lambda x: 2 * x.astype(key), False):
        own = entries[0] & 1 == 0
        if own.any():
            larger.append(tuple(x[own] for x in entries))
            held += len(larger[-1][0])
        if held > memory:
            fresh = [i for i, x in enumerate(larger) if len(x) == 3]
            for i, place in zip(fresh, store.put([larger[i] for i in fresh]), strict=True):
                larger[i] = place
            held = 0
    queue = Queue(2 * characters, memory, store)
    after = np.uint8(0)
    while larger:
        entries = larger.pop()
        k, p, c = entries if len(entries) == 3 else Store.get(entries)
        # in descending order, an entry's prefix is the one that the next larger had with it
        queue.push(key(2 * (characters - 1) + 1) - k[::-1], p[::-1], np.append(after, c[:0:-1]))
        after = c[0]
    for _, p, c in t.induce(queue, lambda x: key(2 * (characters - 1)) - 2 * x.astype(key), True):
        yield p, c


def descending(text: np.ndarray, depth: int, memory: int = IN_MEMORY, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of text, an array of bytes, in descending order of their first `depth` bytes (255 at most): batches of positions, and of the
    bytes each has in common with the one before it, up to depth."""
    if not len(text):
        return
    store = Store(folder)
    try:
        yield from _descending(text, depth, memory, store)
    finally:
        store.close()


def suffix_order(text: np.ndarray, depth: int, memory: int = IN_MEMORY, folder: str | None = None) -> np.ndarray:
    """Positions of all suffixes of text, in ascending order of their first `depth` bytes."""
    found = [p for p, _ in descending(text, depth, memory, folder)]
    return np.concatenate(found)[::-1].astype(np.int64) if found else np.zeros(0, np.int64)
