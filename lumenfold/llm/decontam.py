"""Benchmark decontamination by winnowing: of each window of consecutive k-gram hashes the smallest is kept, fingerprints of documents and
items are joined, and each hit is extended along its diagonal. With K + W - 1 equal to the window of ten words, every shared run of ten words
holds a common fingerprint, so no occurrence is missed; extension compares words themselves, so none is invented."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, bounded_batches, pick, texts, whole_rows

#: A window has this many words; K-grams are selected from windows of W consecutive ones, and K + W - 1 = WINDOW.
WINDOW, K, W = 10, 6, 5
#: Items are joined in blocks of at most this many bytes of text: the size of what is broadcast. Each block is one pass over the documents.
BLOCK_BYTES = 8 << 20

#: ASCII characters that are not letters or digits separate words; A-Z become lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word ids; the largest value stands for grams with an unknown word (id 0)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for j in range(k):
        h = _mixed(h + ids[j : j + n].astype(np.uint64) + np.uint64(1))
        known &= ids[j : j + n] > 0
    return np.where(known, h >> np.uint64(1), np.uint64(2**64 - 1))


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Positions whose hash is the smallest of a window of w that holds them (all of them on a tie); all known ones if there are fewer than w."""
    n = len(hashes)
    known = hashes != np.uint64(2**64 - 1)
    if n < w:
        return np.flatnonzero(known)
    least = np.lib.stride_tricks.sliding_window_view(hashes, w).min(axis=1)
    chosen = np.zeros(n, dtype=bool)
    for j in range(w):
        chosen[j : j + len(least)] |= hashes[j : j + len(least)] == least
    return np.flatnonzero(chosen & known)


class Index:
    """Fingerprints of a block of items. Word ids are exact: the block's own vocabulary, 0 for words outside it."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[str, np.ndarray]] = []
        found: list[tuple[int, int, int]] = []
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            if not len(ids):
                continue
            at = len(self.items)
            self.items.append((item_id, ids))
            if len(ids) < WINDOW:
                self.short.setdefault(len(ids), {}).setdefault(ids.tobytes(), []).append(at)
            else:
                h = gram_hashes(ids, K)
                found += [(int(h[p]), at, int(p)) for p in winnow(h)]
        found.sort()
        self.hashes = np.array([f[0] for f in found], dtype=np.uint64)
        self.places = [(f[1], f[2]) for f in found]
        self.firsts = {n: np.unique(np.array([np.frombuffer(k, np.int32)[0] for k in grams], dtype=np.int32)) for n, grams in self.short.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, apart and sorted, and the ids of items with an occurring window."""
        ids = np.fromiter(map(self.vocabulary.get, words, _ZEROS), dtype=np.int32, count=len(words))
        spans: set[tuple[int, int]] = set()
        items: set[str] = set()
        if len(self.hashes) and len(ids) >= WINDOW:
            h = gram_hashes(ids, K)
            at = winnow(h)
            at = at[self._present(h[at])] if len(at) else at
            done: dict[tuple[int, int], int] = {}  # by item and diagonal: how far the document has been compared
            for p in at.tolist():
                low, high = np.searchsorted(self.hashes, h[p], "left"), np.searchsorted(self.hashes, h[p], "right")
                for item, q in self.places[low:high]:
                    line = (item, p - q)
                    if done.get(line, -1) > p:
                        continue
                    a, b = self._extended(ids, p, self.items[item][1], q)
                    done[line] = b
                    if b - a >= WINDOW:
                        spans.add((a, b))
                        items.add(self.items[item][0])
        for n, grams in self.short.items():
            for p in np.flatnonzero(np.isin(ids, self.firsts[n])).tolist():
                for item in grams.get(ids[p : p + n].tobytes(), ()):
                    spans.add((p, p + n))
                    items.add(self.items[item][0])
        return merged(sorted(spans)), items

    def _present(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h

    @staticmethod
    def _extended(doc: np.ndarray, p: int, item: np.ndarray, q: int) -> tuple[int, int]:
        """The longest run of equal words on the diagonal through (p, q); empty if the words at the hit differ."""
        back, ahead = min(p, q), min(len(doc) - p, len(item) - q)
        same = doc[p - back : p + ahead] == item[q - back : q + ahead]
        if not same[back]:
            return p, p
        left = np.flatnonzero(~same[:back])
        right = np.flatnonzero(~same[back:])
        return p - back + (int(left[-1]) + 1 if len(left) else 0), p + (int(right[0]) if len(right) else ahead)


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self) -> int:
        return 0


_ZEROS = _Zeros()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


HITS = "doc_id long, key long, n_words long, spans array<struct<start int, end int>>, items array<string>"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most BLOCK_BYTES; an item over that is a block of its own. Items come to the driver one partition at a time."""
    block, held = [], 0
    for r in pick(benchmark, item_id="string", text="string").toLocalIterator():
        n = 4 * len(r["text"] or "") + 64
        if block and held + n > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append(("" if r["item_id"] is None else r["item_id"], r["text"]))
        held += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, the spans of hit words, and the ids (as strings, sorted) of items with occurring windows.

    Null and empty texts have no words and no hits; items without words match nothing; a null item_id counts as an empty string; repeated
    documents give repeated rows and repeated items count once; empty tables give no rows or no hits. While the benchmark is one block there is
    no shuffle; with more, each row carries a position made by the scan and the blocks' hits of a row are brought together by it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("key"), "text")
    schema = arrow_schema(HITS)

    def scanned(index) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, spans, items = [], [], []
                for t in texts(b.column(2)):
                    words = words_of(t)
                    s, i = index.value.hits(words)
                    n.append(len(words))
                    spans.append([{"start": x, "end": y} for x, y in s])
                    items.append(sorted(i))
                yield batch([b.column(0), b.column(1), n, spans, items], schema)

        return rows.mapInArrow(scan, HITS)

    found: DataFrame | None = None
    many = False
    for block in _blocks(benchmark):
        one = scanned(spark.sparkContext.broadcast(Index(block)))
        many, found = found is not None, one if found is None else found.unionByName(one)
    if not many:
        return found
    # Several blocks: a row is known by its id and the hash of its text; rows alike in both have alike hits.
    per = found.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    own = scanned(spark.sparkContext.broadcast(Index([]))).select("doc_id", "key", "n_words")
    joined = own.join(per, own["doc_id"].eqNullSafe(per["doc_id"]) & (own["key"] == per["key"])).select(own["doc_id"], own["key"], "n_words", "spans", "items")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([*b.columns[:3], [[{"start": x, "end": y} for x, y in merged(sorted((s["start"], s["end"]) for s in r))] for r in b.column(3).to_pylist()], b.column(4)], schema)

    return joined.mapInArrow(merge, HITS)


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with hit words and items counted and the items' ids digested."""
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs. Null and empty texts stay. One map for each block of items."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain, (text,), own = whole_rows(docs, "text")

    def clean_of(index):
        @F.pandas_udf("boolean")
        def clean(column: pd.Series) -> pd.Series:
            return pd.Series([not index.value.hits(words_of(t))[0] for t in column], dtype=bool)

        return clean

    for block in _blocks(benchmark):
        plain = plain.where(clean_of(spark.sparkContext.broadcast(Index(block)))(text.cast("string")))
    return plain.toDF(*own)
