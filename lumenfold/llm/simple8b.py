"""Simple-8b: selectors pack varying counts of ids into 64-bit words. Blocks of ids have word offsets, so each can be decoded by itself, and
both directions work on many blocks at once.

A word holds its selector in the lowest 4 bits and ids from the lowest bit up. Selectors 1 to 14 stand for LANES; selector 0 is an escape:
the next word is one id of more than 60 bits. The last word of a block may have room for more ids than the block still has."""

from __future__ import annotations

import numpy as np

#: (ids in a word, bits of an id), by selector from 1 on.
LANES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, BLOCK = 0, 1024
#: Blocks worked on at once: their arrays stay in the processor's cache and are not mapped anew each time.
PART = 512
_COUNTS = np.array([1] + [n for n, _ in LANES], dtype=np.int64)


def _choices(bits: np.ndarray) -> np.ndarray:
    """The first selector at each place whose lanes fit all the ids of its stretch; the widest id of a stretch is a running maximum, put
    together from those of shorter stretches."""
    widest = {1: bits}

    def most(count: int) -> np.ndarray:
        if count not in widest:
            part = max(c for c in widest if c < count)
            rest = count - part
            rest = min((c for c in widest if c >= rest), default=rest)
            shift = count - rest
            out, tail = widest[part].copy(), most(rest)
            np.maximum(out[:-shift], tail[shift:], out=out[:-shift])
            widest[count] = out
        return widest[count]

    choice = np.zeros(len(bits), dtype=np.uint8)
    for selector in range(len(LANES), 0, -1):
        choice[most(LANES[selector - 1][0]) < selector] = selector
    return choice


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offset of each block's first word with the number of words at the end."""
    parts = [_encode(ids[i : i + PART * block], block) for i in range(0, max(1, len(ids)), PART * block)]
    before = np.cumsum([0] + [len(w) for w, _ in parts])
    return np.concatenate([w for w, _ in parts]), np.append(np.concatenate([o[:-1] + b for (_, o), b in zip(parts, before, strict=False)]), before[-1])


def _encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """All blocks advance by one word in step."""
    ids = np.asarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // block)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    # One row a block, followed by zeros, which fit any lane: the last word of a block may be open-ended.
    stride = block + LANES[0][0]
    grid = np.zeros((blocks, stride), dtype=np.uint64)
    whole = n // block
    grid[:whole, :block] = ids[: whole * block].reshape(whole, block)
    if whole < blocks:
        grid[whole, : n - whole * block] = ids[whole * block :]
    padded = grid.reshape(-1)
    narrow = padded.astype(np.uint32) if int(ids.max()) < 1 << 32 else padded
    bits = np.zeros(len(padded), dtype=np.uint8)
    for _, b in LANES:
        if int(ids.max()) >> b:
            bits += (narrow >= narrow.dtype.type(1 << b)).view(np.uint8)
    choice = _choices(bits)
    at = np.arange(blocks, dtype=np.int64) * stride
    ends = at + np.minimum(block, n - np.arange(blocks, dtype=np.int64) * block)
    starts: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    alive = np.arange(blocks)
    while len(alive):
        here = at[alive]
        starts.append(here)
        owners.append(alive)
        at[alive] = here + _COUNTS[choice[here]]
        alive = alive[at[alive] < ends[alive]]
    places, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(owner.astype(np.uint16) if blocks <= 1 << 16 else owner, kind="stable")  # by radix where it can be
    places, owner = places[order], owner[order]
    selectors = choice[places]
    sizes = 1 + (selectors == ESCAPE).astype(np.int64)
    per_block = np.bincount(owner, weights=sizes, minlength=blocks).astype(np.int64)
    first = np.cumsum(per_block) - per_block
    offset = np.cumsum(sizes) - sizes
    words = np.zeros(int(per_block.sum()), dtype=np.uint64)
    for selector, (count, width) in enumerate(LANES, 1):
        rows = np.flatnonzero(selectors == selector)
        if len(rows):
            word = np.full(len(rows), selector, dtype=np.uint64)
            for k in range(count):
                word |= padded[places[rows] + k] << np.uint64(4 + k * width)
            words[offset[rows]] = word
    rows = np.flatnonzero(selectors == ESCAPE)
    if len(rows):
        words[offset[rows] + 1] = padded[places[rows]]
    return words, np.append(first, len(words)).astype(np.int64)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids. `offsets` are those of encode(); a part of the blocks is decoded with their words and offsets from 0."""
    words = np.asarray(words, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for b in range(0, len(offsets) - 1, PART):
        ends = offsets[b : b + PART + 1]
        part = out[b * block : (b + PART) * block]
        _decode(words[ends[0] : ends[-1]], ends - ends[0], part, block)
    return out


def _decode(words: np.ndarray, offsets: np.ndarray, out: np.ndarray, block: int) -> None:
    n = len(out)
    selectors = (words & np.uint64(15)).astype(np.int64)
    head = np.ones(len(words), dtype=bool)
    if (selectors == ESCAPE).any():
        # A word after an escape is data. Escaped data may look like an escape too: walk those few in order.
        for i in np.flatnonzero(selectors == ESCAPE).tolist():
            if head[i]:
                head[i + 1] = False
    heads = np.flatnonzero(head)
    kinds = selectors[heads]
    counts = _COUNTS[kinds]
    owner = np.searchsorted(offsets, heads, "right") - 1
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    first = np.searchsorted(heads, offsets[:-1], "left")
    place = before - before[first][owner] + owner * block
    left = np.minimum((owner + 1) * block, n) - place
    for selector, (count, width) in enumerate(LANES, 1):
        rows = np.flatnonzero(kinds == selector)
        if not len(rows):
            continue
        w, p, room = words[heads[rows]], place[rows], left[rows]
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            if k:
                live = room > k
                if not live.all():
                    w, p, room = w[live], p[live], room[live]
            out[p + k] = (w >> np.uint64(4 + k * width)) & mask
    rows = np.flatnonzero(kinds == ESCAPE)
    if len(rows):
        out[place[rows]] = words[heads[rows] + 1]
