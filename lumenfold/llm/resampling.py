"""Target-distribution importance resampling: documents are drawn by how much more their features belong to a target than to the source.

Features are hashed to buckets, both sides are counted by bucket, and a document's weight is the sum of its buckets' gains, looked up in one array.
A seeded Gumbel term makes the draw of the highest scores one without replacement. Scores are integers, so which are drawn follows from an exact
histogram: counts summed from the highest score down give the rank at which each score begins, and where the ranks run out is the cutoff."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch, bounded_batches, cut, pick

#: Buckets of features, words of a feature, the draw's seed, per cent of the eligible documents drawn, and words that make one eligible.
BUCKETS, NGRAM, SEED, PER_CENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Scores are ranked in ranges of 2^8, these in ranges of 2^16, and so on: no window holds more than 256 rows, but for the last one's, whose rows are
#: the ranges of 2^32 scores.
LEVELS = (8, 16, 24, 32)
#: Rows of one document are looked after in so many cells.
CELLS = 4096
#: Bytes of a text split at once.
PART = 1 << 20

#: ASCII characters that are not letters or digits separate words; A-Z become lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str | None, n: int = NGRAM) -> Iterator[list[bytes]]:
    """A text's runs of one to n words, some at a time; a run may reach over from one part to the next."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at, last = 0, []
    while at < len(data):
        end = len(data)
        if end - at > PART:
            stop = data.find(b" ", at + PART)
            end = stop if stop >= 0 else end
        words = data[at:end].split()
        at = end
        out = list(words)
        for k in range(2, n + 1):
            run = last[len(last) - min(len(last), k - 1) :] + words
            out += [b" ".join(run[i : i + k]) for i in range(len(run) - k + 1)]
        last = (last + words)[-(n - 1) :] if n > 1 else []
        yield out


def _bucketed(column: pa.Array, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, buckets of some of its features), row after row."""
    for i, text in enumerate(column.to_pylist()):
        for part in features(text, n):
            yield i, np.fromiter(map(zlib.crc32, part), np.uint32, len(part)) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all whole texts by bucket. A task adds its texts up in one array and sends a row a bucket."""
    schema = arrow_schema("bucket int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, found in _bucketed(b.column(0), n, buckets):
                total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield batch([met.astype(np.int32), total[met]], schema)

    bounded_batches(docs.sparkSession)
    return pick(docs, text="string").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from bucket_counts() of both sides: one array of fixed size."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    rows = both.select("bucket", F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))).collect()  # a row a bucket at most
    s, t = np.zeros(buckets), np.zeros(buckets)
    for bucket, a, b in rows:
        s[bucket], t[bucket] = a, b
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """The Gumbel term of a document, in thousandths, from a hash of its id. A null id counts as the text ""."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight and score of every row, and the cell of the row."""
    ddl = "doc_id long, n_features long, weight long"
    schema, buckets = arrow_schema(ddl), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, found in _bucketed(b.column(1), n, buckets):
                count[i] += len(found)
                weight[i] += gain[found].sum()
            yield batch([b.column(0), count, weight], schema)

    bounded_batches(docs.sparkSession)
    df = pick(docs, doc_id="long", text="string").mapInArrow(weigh, ddl)
    return df.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long").alias("score"), F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)).cast("int").alias("cell"))


def offsets(histogram: DataFrame) -> DataFrame:
    """score, n and `above`, the number of rows of higher scores: sums from the highest score down, by ranges, each range's from that above it."""
    levels = [histogram.select(F.col("score").alias("k0"), "n")]
    for i in range(len(LEVELS)):
        shift = LEVELS[i] - (LEVELS[i - 1] if i else 0)
        levels.append(levels[i].groupBy(F.shiftright(f"k{i}", shift).alias(f"k{i + 1}")).agg(F.sum("n").alias("n")))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = len(LEVELS)
    known = levels[top].select(f"k{top}", before(Window.orderBy(F.desc(f"k{top}"))).alias("above"))
    for i in reversed(range(top)):
        up, shift = f"k{i + 1}", LEVELS[i] - (LEVELS[i - 1] if i else 0)
        here = levels[i].withColumn(up, F.shiftright(f"k{i}", shift))
        here = here.withColumn("within", before(Window.partitionBy(up).orderBy(F.desc(f"k{i}"))))
        known = here.join(known.select(up, "above"), up).select(f"k{i}", "n", (F.col("within") + F.col("above")).alias("above"))
    return known.withColumnRenamed("k0", "score")


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """rows (doc_id, n_features, weight, score, cell; a stored table, as it is read several times) with the rank of those drawn, null for others.

    Rows of the surviving scores are numbered by doc_id within each score. What one document's repeated rows add is counted by cells first, so that
    they may be any part of the table."""
    eligible = rows.where(F.col("n_features") >= least_words)
    table = cut(offsets(eligible.groupBy("score").agg(F.count("*").alias("n"))), "ranks")
    total = table.agg(F.sum("n")).first()[0] or 0
    most = per_cent * total // 100
    cutoff = table.where(F.col("above") < most).agg(F.min("score")).first()[0]
    columns = ["doc_id", "n_features", "weight", "score"]
    if cutoff is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    survives = (F.col("n_features") >= least_words) & (F.col("score") >= cutoff)
    alive = rows.where(survives).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("no_id", F.col("doc_id").isNull())
    cell = ["score", "no_id", "id", "cell"]
    alive = alive.withColumn("i", F.row_number().over(Window.partitionBy(*cell).orderBy("n_features")))
    cells = alive.groupBy(*cell).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("score").orderBy("no_id", "id", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*cell, before.alias("before")).join(table.select("score", "above"), "score")
    rank = (F.col("above") + F.col("before") + F.col("i")).cast("long")
    placed = alive.join(cells, cell).select(*columns, F.when(rank <= most, rank).alias("rank"))
    return placed.unionByName(rows.where(~survives).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, and its rank among the PER_CENT drawn of those with LEAST_WORDS words (else null).

    A null or empty text has no features, weight 0, and is never drawn. A null doc_id counts as "" in the draw and comes after all others on a tie.
    Repeated rows have one score and follow one another in rank, in any order. An empty table gives none; an empty target makes rare words weigh
    more than frequent ones. Columns of other names, in any case, do no harm."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return drawn(cut(scored(docs, gain), "scores"))
