"""Repeated substrings across documents, exact, over the UTF-8 bytes of whole texts.

A stretch of LENGTH bytes has an anchor: the least hash of its K-byte grams, which equal stretches share wherever they stand.
1. Texts are staged in chunks. Each chunk asks, by anchor, which of its anchors occur in more than one document of the corpus.
2. Only stretches with such anchors go on. Within a chunk the least document of each distinct stretch stands for all; runs of such
   stretches that share an anchor go, as bytes, to the anchor's bucket: a third of all rows being copies sends no more than a chunk's worth.
   Where an anchor's runs hold more than HOT_BYTES in all, its stretches go one by one to buckets by content instead, which are as many
   as their bytes need: equal ones still meet, and no bucket grows with how common an anchor is.
3. A bucket sorts the suffixes of its bytes by induction, with common prefixes (see induced.py); neighbours that have LENGTH bytes in common
   are one group, and every stretch of a group whose document isn't the least is covered.
4. Answers go back by chunk, which marks covered bytes and returns what is left of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staged as S
from .common import LAST_ID, arrow_schema, batch, bounded_batches, discard, pick, scratch, written
from .induced import IN_MEMORY, descending
from .words import mixed

LENGTH, K = 50, 24
#: Buckets of runs for a bucket of anchors: what a bucket holds besides the queues takes some forty bytes of memory a byte.
RUN_BUCKETS = 2
#: Bytes of runs from which on an anchor is hot, and bytes of stretches for which there is one more bucket of hot ones.
HOT_BYTES, HOT_BUCKET = 1 << 20, 4 << 20
#: Bytes of the longest run of an anchor that occurs once, and stretches in it.
_RUN, _RUN_STRETCHES = 2 * LENGTH - K, LENGTH - K + 1
#: From so many runs of an anchor on, a chunk counts runs of the same bytes once.
_MANY = 16
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_KEY_BITS = 48


def _paired(a: np.ndarray, step: int, level: int) -> np.ndarray:
    """Hashes of stretches twice as long, from those of length `step`."""
    return (a[:-step] ^ (a[:-step] >> np.uint64(31))) * _C[level] + a[step:]


#: Stretches whose hashes are computed at once: their arrays stay in the processor's cache.
_PART = 1 << 15


def _grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all K-grams, and of all pairs of bytes."""
    h2 = _paired((text.astype(np.uint64) + np.uint64(1)) * _C[0], 1, 1)
    h8 = _paired(_paired(h2, 2, 2), 4, 3)
    h16 = _paired(h8, 8, 4)
    n = len(text) - K + 1
    return mixed((h16[:n] ^ (h16[:n] >> np.uint64(29))) * _C[5] + h8[16 : 16 + n]), h2


def _anchors(text: np.ndarray) -> np.ndarray:
    """The least gram of each stretch."""
    least, width = _grams(text)[0], 1
    while 2 * width <= LENGTH - K + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LENGTH - K + 1 - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _contents(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the stretches at ascending positions."""
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(text) + _PART, _PART))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if b > a:
            low = k * _PART
            grams, pairs = _grams(text[low : low + _PART + LENGTH - 1])
            p = at[a:b] - low
            out[a:b] = mixed(mixed(grams[p]) + grams[p + K] * _C[1] + pairs[p + LENGTH - 2] * _C[2])
    return out


def _order(content: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indices by content, then rank, then place. The rank being ascending, or nearly, one sort of numbers that hold both the content's upper
    bits and the place will do; where upper bits agree and contents don't, the plain way is taken."""
    n = len(content)
    if n and (rank[1:] >= rank[:-1]).all():
        bits = np.uint64(max(1, int(n - 1).bit_length()))
        packed = (content >> bits << bits) | np.arange(n, dtype=np.uint64)
        packed.sort()
        order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        upper = packed >> bits
        full = content[order]
        if (full[1:] == full[:-1])[upper[1:] == upper[:-1]].all():
            return order
    return np.lexsort((rank, content))


class Stretches:
    """The stretches of a chunk's texts, which lie one after another in `text`; those across two texts are not valid."""

    def __init__(self, chunk: S.Chunk) -> None:
        raw = b"".join(chunk.texts)
        self.sizes = np.fromiter(map(len, chunk.texts), np.int64, len(chunk.texts))
        self.ends = np.cumsum(self.sizes)
        self.text = np.frombuffer(raw, np.uint8)
        self.ranks = np.array([LAST_ID if i is None else i for i in chunk.ids], np.int64)
        n = len(raw)
        if n < LENGTH:
            self.keys, self.heads, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        least = np.empty(n - LENGTH + 1, np.uint64)
        for low in range(0, len(least), _PART):
            high = min(len(least), low + _PART)
            least[low:high] = _anchors(self.text[low : high + LENGTH - 1])
        # Runs of stretches with one anchor in one text.
        valid = np.zeros(n - LENGTH + 1, bool)
        starts = self.ends - self.sizes
        long = self.sizes >= LENGTH
        step = np.zeros(n + 1, np.int8)
        np.add.at(step, starts[long], 1)
        np.add.at(step, (self.ends - LENGTH + 1)[long], -1)
        valid = np.cumsum(step[: n - LENGTH + 1]) > 0
        change = np.ones(len(valid), bool)
        change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        change[starts[(starts < len(valid)) & (self.sizes > 0)]] = True
        at = np.flatnonzero(change)
        lengths = np.diff(np.append(at, len(valid)))
        own = valid[at]
        self.heads, self.lengths = at[own], lengths[own]
        self.keys = mixed(least[self.heads]) >> np.uint64(64 - _KEY_BITS)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, "right")

    def asked(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """By bucket: the distinct anchors, whether each occurs in several documents of this chunk already, and the bytes of its runs, in
        units of the longest run."""
        ranks = self.ranks[self.owner(self.heads)]
        order = np.lexsort((ranks, self.keys))
        k, r = self.keys[order], ranks[order]
        first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(k)) - 1
        distinct, several = k[at], r[at] != r[last] if len(k) else np.zeros(0, bool)
        sizes = self.lengths[order] + LENGTH - 1
        held = np.add.reduceat(sizes, at) if len(at) else at
        heads = self.heads[order]
        for i in np.flatnonzero(last - at >= _MANY).tolist():
            part = slice(int(at[i]), int(last[i]) + 1)
            held[i] = sum(map(len, {self.text[h : h + n].tobytes() for h, n in zip(heads[part].tolist(), sizes[part].tolist(), strict=True)}))
        units = (-(-held // _RUN)).astype(np.uint32)
        cuts = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            yield b, S.joined(S.deltas(distinct[part]), S.squeezed(np.packbits(several[part]).tobytes()), S.planes(units[part]))

    def shared(self, answers: dict[int, bytes], buckets: int) -> None:
        """Keeps the runs whose anchors the answers call shared, and groups their stretches by content within the chunk; knows the hot ones."""
        distinct = np.unique(self.keys)
        cuts = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
        keep, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        for b, blob in answers.items():
            part = slice(cuts[b], cuts[b + 1])
            keep[part], hot[part] = (np.unpackbits(np.frombuffer(S.spread(x), np.uint8), count=cuts[b + 1] - cuts[b]).astype(bool) for x in S.parts(blob))
        self.hot = distinct[hot]
        own = keep[np.searchsorted(distinct, self.keys)] if len(distinct) else np.zeros(0, bool)
        heads, lengths, keys = self.heads[own], self.lengths[own], self.keys[own]
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        self.at = np.repeat(heads - (ends - lengths), lengths) + np.arange(total)
        self.at_key = np.repeat(keys, lengths)
        content = _contents(self.text, self.at)
        self.at_rank = np.repeat(self.ranks[self.owner(heads)], lengths)
        order = _order(content, self.at_rank)
        sorted_content = content[order]
        first = np.concatenate([[True], sorted_content[1:] != sorted_content[:-1]]) if total else np.zeros(0, bool)
        self.group = np.empty(total, np.int64)
        self.group[order] = np.cumsum(first) - 1
        self.group_head = order[first]  # an index into `at`; lexsort is stable, so the first place of the least document
        self.local = self.at_rank > self.at_rank[self.group_head][self.group] if total else np.zeros(0, bool)
        self.content = content if len(self.hot) else None

    def sent(self, buckets: int, hot_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of group heads that follow each other and share an anchor: indices into `at` in order, and by run its first, its count and its
        bucket, ascending. A stretch of a hot anchor is a run of its own, its bucket one of those after the others, by content."""
        heads = np.sort(self.group_head)
        if not len(heads):
            return heads, heads, heads, heads
        p, k = self.at[heads], self.at_key[heads]
        new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (k[1:] != k[:-1]) | (self.at_rank[heads][1:] != self.at_rank[heads][:-1])])
        if self.content is not None:
            hot = np.isin(k, self.hot)
            new |= hot
        first = np.flatnonzero(new)
        key = k[first]
        bucket = _bucket(key, buckets)
        if self.content is not None:
            own = hot[first]
            bucket[own] = buckets + _bucket(self.content[heads[first[own]]] >> np.uint64(64 - _KEY_BITS), hot_buckets)
            order = np.lexsort((np.where(own, np.uint64(0), key), bucket))
        else:
            order = np.argsort(key, kind="stable")
        first, count = first[order], np.diff(np.append(first, len(heads)))[order]
        return heads, first, count, bucket[order]

    def notes(self, heads: np.ndarray, begin: np.ndarray, count: np.ndarray, key: np.ndarray) -> bytes:
        """What is needed once the buckets have judged the sent runs: where they start and end, in the order they were sent; stretches of the
        same document that repeat a sent one, by its number; and the stretches that are covered within the chunk."""
        sent = np.full(len(self.group_head), -1, np.int64)
        order = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(heads))
        sent[self.group[heads[order]]] = np.arange(len(heads))
        is_head = np.zeros(len(self.at), bool)
        is_head[self.group_head] = True
        again = np.flatnonzero(~self.local & ~is_head)
        where = self.at[heads[begin]] if len(heads) else heads
        return S.joined(S.planes(where), S.planes(count), S.planes(key), S.planes(self.at[again]), S.planes(sent[self.group[again]]), S.planes(np.diff(self.at[self.local], prepend=0)))


def noted(notes: bytes, answers: dict[int, bytes]) -> np.ndarray:
    """Positions of covered stretches, from notes and the buckets' answers."""
    start, count, key, again, of, local = (S.unplanes(x, np.int64) for x in S.parts(notes))
    ends = np.cumsum(count)
    marks = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    cuts = np.concatenate([[0], ends])
    for k in np.unique(key).tolist():
        a, b = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
        part = slice(int(cuts[a]), int(cuts[b]))
        marks[part] = np.unpackbits(np.frombuffer(S.spread(answers[k]), np.uint8), count=part.stop - part.start).astype(bool)
    places = np.repeat(start - (ends - count), count) + np.arange(len(marks))
    return np.concatenate([places[marks], again[marks[of]], np.cumsum(local)])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys, so that a bucket's keys lie together in sorted order."""
    return ((keys >> np.uint64(_KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _several(table: pa.Table) -> list[tuple[int, bytes]]:
    """Answers of a bucket: by chunk, which of its anchors occur in several chunks, or in several documents of any, and which of these are hot;
    for chunk -1 the bytes of their runs."""
    rows = [(c, *S.parts(b)) for c, b in zip(table["chunk"].to_pylist(), table["blob"].to_pylist(), strict=True)]
    keys = [S.undeltas(k) for _, k, _, _ in rows]
    flags = [np.unpackbits(np.frombuffer(S.spread(f), np.uint8), count=len(k)).astype(bool) for (_, _, f, _), k in zip(rows, keys, strict=True)]
    distinct, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    several = count > 1
    several[place[np.concatenate(flags)]] = True
    units = np.bincount(place, weights=np.concatenate([S.unplanes(u, np.uint32) for _, _, _, u in rows]), minlength=len(distinct))
    hot = several & (units * _RUN > HOT_BYTES)
    ends = np.cumsum([len(k) for k in keys]).tolist()
    bits = lambda x: S.squeezed(np.packbits(x).tobytes())
    out = [(c, S.joined(bits(several[own]), bits(hot[own]))) for (c, *_), own in ((r, place[e - len(k) : e]) for r, k, e in zip(rows, keys, ends, strict=True))]
    return out + ([(-1, S.planes(np.array([units[hot].sum() * _RUN], np.int64)))] if hot.any() else [])


def covered(ids: np.ndarray, counts: np.ndarray, text: np.ndarray, memory: int = IN_MEMORY, folder: str | None = None) -> np.ndarray:
    """Of runs of stretches (a document's rank, how many; their bytes one after another), which stretches also start in a lesser document.
    Suffixes come sorted with their common prefixes: stretches between which none is shorter than LENGTH are one group."""
    sizes = counts + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    total = int(counts.sum())
    ends = np.cumsum(counts)
    number = np.full(len(text), -1, np.int32 if total < 1 << 31 else np.int64)
    number[np.repeat(begins - (ends - counts), counts) + np.arange(total)] = np.arange(total)
    order, groups, breaks = [], [], 0
    for positions, common in descending(text, LENGTH, memory, folder):
        found = number[positions]
        group = breaks + np.cumsum(common < LENGTH)
        breaks = int(group[-1])
        own = found >= 0
        order.append(found[own])
        groups.append(group[own])
    order, group = np.concatenate(order), np.concatenate(groups)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    rank = np.repeat(ids, counts)[order]
    least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, total)))
    out = np.zeros(total, bool)
    out[order] = rank > least
    return out


def _judged(table: pa.Table, folder: str) -> list[tuple[int, bytes]]:
    """Answers of a bucket: by chunk, which of the stretches it sent are covered."""
    chunks, ids, counts, places = [], [], [], []
    known: dict[bytes, int] = {}  # a run of the same bytes is sorted once, for its least document
    least: list[int] = []
    for c, b in zip(table["chunk"].to_pylist(), table["blob"].to_pylist(), strict=True):
        i, n, t = S.parts(b)
        chunks.append(c)
        ids.append(S.unplanes(i, np.int64))
        counts.append(S.unplanes(n, np.int64))
        raw, end, own = S.spread(t), 0, []
        for rank, size in zip(ids[-1].tolist(), (counts[-1] + LENGTH - 1).tolist(), strict=True):
            run = raw[end : end + size]
            end += size
            k = known.setdefault(run, len(least))
            own.append(k)
            if k == len(least):
                least.append(rank)
            elif rank < least[k]:
                least[k] = rank
        places.append(np.array(own))
    sizes = np.fromiter(map(len, known), np.int64, len(known)) - (LENGTH - 1)
    first = np.array(least)
    marks = covered(first, sizes, np.frombuffer(b"".join(known), np.uint8), folder=folder)
    begins = np.cumsum(sizes) - sizes
    out = []
    for c, i, n, k in zip(chunks, ids, counts, places, strict=True):
        ends = np.cumsum(n)
        at = np.repeat(begins[k] - (ends - n), n) + np.arange(int(n.sum()))
        own = marks[at] | np.repeat(i > first[k], n)
        out.append((c, S.squeezed(np.packbits(own).tobytes())))
    return out


BLOBS = "chunk long, bucket int, path string, blob binary"
REPEATS = "doc_id long, n_bytes long, spans array<struct<start long, end long>>, kept binary"


def _by_bucket(blobs: DataFrame, answer) -> DataFrame:
    schema = arrow_schema(BLOBS)

    def group(table: pa.Table) -> pa.Table:
        found = answer(table)
        return pa.Table.from_batches([batch([[c for c, _ in found], [table["bucket"][0].as_py()] * len(found), [None] * len(found), [b for _, b in found]], schema)])

    return blobs.groupBy("bucket").applyInArrow(group, BLOBS)


def _hot_buckets(settled: DataFrame) -> int:
    """How many buckets the hot stretches need: each of them takes LENGTH bytes there."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [int(S.unplanes(blob, np.int64)[0]) for blob in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["n"])

    held = settled.where("chunk = -1").select("blob").mapInArrow(opened, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    return -(-held // _RUN * _RUN_STRETCHES * LENGTH // HOT_BUCKET)


def repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, the spans of bytes covered by a LENGTH-byte string that also starts in a document with a
    smaller doc_id, and the bytes that are left.

    A null or empty text has no bytes and nothing is removed. A null doc_id counts as larger than all others; rows of one doc_id are not
    smaller than each other, so neither removes from the other. An empty table gives none. Staged files, requests and answers are all
    written tables of the shared folder: a lost executor repeats tasks, not stages."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, doc_id="long", text="string")
    buckets, most = S.buckets_for(rows), S.chunk_bytes(rows)
    runs = RUN_BUCKETS * buckets
    folder = scratch(spark, "repeats")
    schema = arrow_schema(BLOBS)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in S.chunks(batches, most):
            by_id = sorted(range(len(chunk.ids)), key=lambda i: (chunk.ids[i] is None, chunk.ids[i] or 0))
            chunk = S.Chunk([chunk.ids[i] for i in by_id], [chunk.texts[i] for i in by_id])
            path = S.put(f"{folder}/chunks", f"{number:016x}", chunk.dump())
            asked = [(-1, path, None), *((b, None, blob) for b, blob in Stretches(chunk).asked(buckets))]
            yield batch([[number] * len(asked), [a[0] for a in asked], [a[1] for a in asked], [a[2] for a in asked]], schema)

    first = written(rows.mapInArrow(stage, BLOBS), f"{folder}/anchors")
    manifest = written(first.where("bucket = -1").select("chunk", "path"), f"{folder}/manifest")
    settled = written(_by_bucket(first.where("bucket >= 0"), _several), f"{folder}/shared")
    discard(f"{folder}/anchors")
    shared = settled.where("chunk >= 0")
    hots = _hot_buckets(settled)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, path, answers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = Stretches(S.Chunk.load(S.get(path)))
                found.shared({a["bucket"]: a["blob"] for a in answers or ()}, buckets)
                heads, begin, count, key = found.sent(runs, hots)
                S.put(f"{folder}/notes", f"{number:016x}", found.notes(heads, begin, count, key))
                if not len(heads):
                    continue
                start = found.at[heads[begin]]
                rank = found.at_rank[heads[begin]]
                cuts = np.searchsorted(key, np.arange(runs + hots + 1))
                raw = found.text.tobytes()
                out = []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    body = b"".join(raw[s : s + c + LENGTH - 1] for s, c in zip(start[part].tolist(), count[part].tolist(), strict=True))
                    out.append((k, S.joined(S.planes(rank[part]), S.planes(count[part]), S.squeezed(body, 3))))
                    if k >= runs:
                        yield batch([[number], [k], [None], [out.pop()[1]]], schema)
                yield batch([[number] * len(out), [k for k, _ in out], [None] * len(out), [x for _, x in out]], schema)

    segments = S.answered(manifest, shared).mapInArrow(send, BLOBS)
    judged = written(_by_bucket(segments, lambda table: _judged(table, f"{folder}/queues")), f"{folder}/judged")
    out_schema = arrow_schema(REPEATS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, path, answers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                chunk = S.Chunk.load(S.get(path))
                notes = S.get(f"{folder}/notes/{number:016x}")
                at = noted(notes, {a["bucket"]: a["blob"] for a in answers or ()})
                size = sum(map(len, chunk.texts))
                step = np.bincount(at, minlength=size + 1) - np.bincount(at + LENGTH, minlength=size + 1)
                yield _rows(chunk, np.cumsum(step[:-1]) > 0, out_schema)

    return S.answered(manifest, judged).mapInArrow(finish, REPEATS)


def _rows(chunk: S.Chunk, gone: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    spans, kept, end = [], [], 0
    for raw in chunk.texts:
        own = gone[end : end + len(raw)]
        end += len(raw)
        if not own.any():
            spans.append([])
            kept.append(raw)
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        kept.append(np.frombuffer(raw, np.uint8)[~own].tobytes())
    return batch([chunk.ids, [len(t) for t in chunk.texts], spans, kept], schema)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """repeats() with removed bytes and spans counted and what is left digested."""
    return repeats(docs).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
