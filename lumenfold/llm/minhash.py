"""Near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate links, exact confirmation.

1. Every text becomes its set of shingles (pairs of words, as 64-bit hashes). Texts with one set are one class, its least id its node.
2. A set's hashes fall into BINS bins, each bin keeping its least; an empty bin takes the value of the first bin with one in an order of its
   own (optimal densification, Shrivastava 2017). BANDS bands of ROWS bins make bucket keys. A pair at similarity 0.8 shares no bucket with
   probability (1 - 0.8**5)**40, about 1e-7; a more similar pair with less.
3. In each bucket every member is paired with the least one only, if set sizes and parities allow, and the link is confirmed on the full
   sets. Members only meet those of their own class of set sizes and the two beside it, as links need sizes within the threshold. Parities are those of the numbers of hashes in PARITIES cells: where two sets' parities differ, at least one hash is in one set only,
   so their number bounds the sets' difference from below and the similarity from above. No link is lost by that, and pairs that share a
   bucket by a common passage, or are near the threshold below it, mostly go untested.
4. Confirmed links make components. Buckets whose members still are in several components go another round without the hubs that have met
   all members, with HUB_GROWTH times as many hubs, until no two members of different components are left untested. So the star bounds the pairs
   of a group of copies to its size, and yet no link between components that share a bucket is lost."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_schema, batch, bounded_batches, cut, discard_since, kept, made, pick, scratch, sieved, texts, whole_rows, written
from .components import components

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Cells of the parity sketch, a multiple of 64; growth of the number of hubs of a bucket from round to round.
PARITIES, HUB_GROWTH = 1024, 32
#: Links need 100 * |A and B| >= PERCENT * |A or B|, on shingles of SHINGLE words.
PERCENT, SHINGLE = 80, 2
#: Nodes of null ids start here, after all others.
_NULLS = 1 << 62

_ORDERS = np.stack([np.random.default_rng(1000 + b).permutation(BINS) for b in range(BINS)])


def shingle_set(hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; with fewer words than a shingle has, the whole sequence is one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    if shingle == 2 and n >= 2:
        return np.unique(W.pair_hashes(hashes))
    k = min(shingle, n)
    h = np.full(n - k + 1, np.uint64(k if n < shingle else 0), np.uint64)
    for j in range(k):
        h = W.mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j])
    return np.unique(h)


def signature(values: np.ndarray) -> np.ndarray:
    """The least value in each bin of a sorted, not empty set, empty bins filled."""
    bins = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    out = np.zeros(BINS, np.uint64)
    out[bins[first]] = values[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        orders = _ORDERS[empty]
        out[empty] = out[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
    return out


def parities(values: np.ndarray) -> np.ndarray:
    """Whether the number of hashes in each cell is odd, as 64-bit numbers."""
    odd = np.bincount((values & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = W.mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _node(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_NULLS) + F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1)))


SETS = "doc_id long, node long, n_shingles long, hi long, lo long, sketch array<long>, bands array<long>"


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    schema = arrow_schema(SETS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            W.hasher.alone()
            hashes, counts = W.hasher(list(texts(b.column(2))))
            n, hi, lo, sketches, bands = [], [], [], [], []
            for h in np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []:
                s = shingle_set(h, shingle)
                digest = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), ">i8")
                n.append(len(s))
                hi.append(int(digest[0]))
                lo.append(int(digest[1]))
                least = signature(s) if len(s) else None
                sketches.append([] if least is None else parities(s))
                bands.append([] if least is None else band_keys(least))
            yield batch([b.column(0), b.column(1), n, hi, lo, sketches, bands], schema)

    return rows.select("doc_id", "node", "text").mapInArrow(scan, SETS)


LINKS = "a long, b long, linked boolean"


def _confirmed(pairs: DataFrame, held: DataFrame, shingle: int, percent: int) -> DataFrame:
    """pairs (a, b) with whether they are linked on their full sets. Both texts are joined to the pair; a hub with many members is split by
    the join's skew handling, and a task computes a hub's set once for all its members in a row."""
    schema = arrow_schema(LINKS)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, np.zeros(0, np.uint64)
        for batch_ in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch_.columns)
            linked = []
            hashes, counts = W.hasher([x or "" for x in tb])
            for i, h in enumerate(np.split(hashes, np.cumsum(counts)[:-1]) if a else []):
                if (a[i], ta[i]) != last:
                    last, hub = (a[i], ta[i]), shingle_set(W.hasher([ta[i] or ""])[0], shingle)
                linked.append(similar(hub, shingle_set(h, shingle), percent))
            yield batch([a, b, linked], schema)

    with_b = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(test, LINKS)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included), kept.

    A null or empty text, or one without words, has an empty set and is linked with nothing: it is kept. A null doc_id sorts after all others:
    its component_id is the least id it is linked with, else null, and then one row of each such text is kept like any least one. Rows that
    share a doc_id count as one document in different versions, linked with each other. An empty table gives none."""
    rows = pick(docs, doc_id="long", text="string").withColumn("node", _node(F.col("doc_id"), F.col("text")))
    return _grouped(rows, shingle, percent).select("doc_id", "n_shingles", F.when(F.col("least") < _NULLS, F.col("least")).alias("component_id"), (F.col("node") == F.col("least")).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without those whose text is linked, by one or more links, with that of a smaller doc_id; of rows of one
    doc_id and text one stays. Different texts of one doc_id are documents of their own, the smaller one that with the lesser hash."""
    plain, (doc_id, text), own = whole_rows(docs, "doc_id", "text")
    plain = plain.withColumns({"node": _node(doc_id, text), "version": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))})
    groups = scratch(docs.sparkSession, "groups")
    versions = plain.select("node", "version").distinct()
    # Nodes are numbered anew, in their order, only if some doc_id has several texts: the texts are shuffled for it.
    if not versions.groupBy("node").count().where("count > 1").isEmpty():
        numbers = cut(versions.orderBy("node", "version").withColumn("number", F.monotonically_increasing_id()), "numbers")
        plain = plain.join(numbers, ["node", "version"]).drop("node").withColumnRenamed("number", "node")
    mark = made()
    rows = plain.select(doc_id.cast("long").alias("doc_id"), "node", text.cast("string").alias("text"))
    found = written(_grouped(rows, shingle, percent).select("node", "least"), groups)
    discard_since(mark)
    left = plain.join(found.where(F.col("node") != F.col("least")).select("node").distinct(), "node", "left_anti")
    # The rows by node are few to count; the texts are shuffled for it only if some node has several rows.
    if not found.groupBy("node").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["node"])
    return left.select(*[f"_{i}" for i in range(len(own))]).toDF(*own)


def _neighbours() -> Column:
    """The classes of set sizes that a set of class `size` can be linked with: each is a little wider than the threshold."""
    return F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)


def _grouped(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, node, n_shingles and the least node of each row's component, from rows (doc_id, node, text)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    mark = made()
    full = cut(_sets(rows, shingle), "sets")
    # bands and sketch are those of the set: any row of a class has the same
    first = [F.first(c).alias(c) for c in ("sketch", "bands")]
    classes = cut(full.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("node").alias("node"), F.first("n_shingles").alias("n"), *first), "classes")
    buckets = classes.select("node", F.explode("bands").alias("key"))
    met = cut(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "met")
    # Both sides of a join by bucket are tables as they are stored, so that the join may split a large one.
    inside = cut(buckets.join(met, "key"), "inside")
    size = F.floor(F.ln(F.col("n").cast("double")) / (1.0001 * math.log(100 / percent))).cast("int")
    open_ = inside.join(classes.select("node", "n", size.alias("size"), "sketch"), "node")
    open_, at = kept(open_.select("key", "size", "node", "n", "sketch", F.col("node").alias("c")), "open")
    sets, at_sets = kept(full.select("doc_id", "node", "n_shingles", "hi", "lo"), "rows")
    classes, at_classes = kept(classes.select("hi", "lo", "node"), "names")
    wanted = open_.select("node").distinct()
    held, at_held = kept(sieved(rows, F.col("node"), wanted, F.col("node")).join(wanted, "node").select("node", "text"), "held")
    needed = [at_sets, at_classes, at_held]
    discard_since(mark, at, *needed)
    tested: DataFrame | None = None
    labels: DataFrame | None = None
    hubs_each = 1
    while not open_.isEmpty():
        part = F.pmod(F.xxhash64("node", F.lit(hubs_each)), F.lit(hubs_each))
        hubs = open_.groupBy("key", "size", part.alias("part")).agg(F.min(F.struct("node", "n", "c", "sketch")).alias("h"))
        hubs = cut(hubs.select("key", "size", F.col("h.node").alias("a"), F.col("h.n").alias("na"), F.col("h.c").alias("ca"), F.col("h.sketch").alias("sa")), "hubs")
        differing = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sa")[i])) for i in range(PARITIES // 64)), F.lit(0))
        # |A ^ B| <= (|A| + |B|) (100 - percent) / (100 + percent) is the similarity's threshold
        near = (F.col("ca") != F.col("c")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na")) & (differing * (100 + percent) <= (F.col("n") + F.col("na")) * (100 - percent))
        around = hubs.withColumn("size", F.explode(_neighbours()))
        pairs = open_.join(around, (open_["key"] == around["key"]) & (open_["size"] == around["size"]) & near).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        done, at_links = kept(_confirmed(pairs, held, shingle, percent), "links")
        needed.append(at_links)
        tested = done.select("a", "b") if tested is None else tested.unionAll(done.select("a", "b"))
        fresh = done.where("linked").select("a", "b")
        if labels is None or not fresh.isEmpty():
            known = fresh if labels is None else fresh.unionAll(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels, at_labels = kept(components(known), "labels")
        # a hub has met every member of its bucket that is in another component and of a size near enough
        left = open_.join(hubs.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti")
        left = left.drop("c").join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        left = cut(left.select("key", "size", "node", "n", "sketch", "c"), "left")
        several = left.select("key", F.explode(_neighbours()).alias("size"), "c").groupBy("key", "size").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key", "size")
        open_, at = kept(left.join(cut(several, "several"), ["key", "size"]), "open")
        discard_since(mark, at, at_labels, *needed)
        hubs_each = min(HUB_GROWTH * hubs_each, 1 << 20)
    if labels is None:
        labels = spark.createDataFrame([], "node long, component long")
    named = classes.select("hi", "lo", "node").join(labels, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("c"))
    out = sets.select("doc_id", "node", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    least = F.when(F.col("n_shingles") > 0, F.coalesce("c", "node")).otherwise(F.col("node"))
    return out.select("doc_id", "node", "n_shingles", least.alias("least"))
