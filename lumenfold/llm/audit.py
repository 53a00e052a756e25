"""Filter interaction audit: every order of a set of filters is replayed over all documents' flags, and what each filter does at each step counted.

Direct relational replay: a document's flags meet the 120 orders, a broadcast table of fixed size; the five steps are exploded; the first
failure says which step removes it; conditional sums by part, order and step are combined on the map side, so that one row a task, part, order
and step is exchanged, whatever the number of documents."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

#: The filters, one letter each, in the order of their bits.
FILTERS = "ABCDE"
#: Bounds of A (words), B (per cent of words that are distinct), C (per cent of code points that are capitals), and D's characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
#: Rows of one text are looked after in so many cells, so that no task holds all copies of a text.
CELLS = 4096


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def document_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, and the bits of the filters that the document fails by itself (A to D), with its text's SHA-256 and the cell of the row."""
    df = pick(docs, doc_id="long", text="string", source="string").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size("words")
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")).cast("long") < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.char_length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    bits = sum((F.when(c, F.lit(_bit(k))).otherwise(F.lit(0)) for k, c in fails.items()), F.lit(0))
    return df.select("doc_id", "part", bits.cast("int").alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest"), F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)).cast("int").alias("cell"))


def with_copies(flags: DataFrame) -> DataFrame:
    """flags with E's bit set where a smaller doc_id has the same text. A text's least doc_id is found by cells first, and joined back by cells."""
    cells = flags.groupBy("digest", "cell").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    firsts = cells.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n")).where("n > 1").select("digest", "least")
    known = cells.select("digest", "cell").join(firsts, "digest")
    copied = F.when(F.col("least") < F.col("doc_id"), F.lit(_bit("E"))).otherwise(F.lit(0))
    return flags.join(known, ["digest", "cell"], "left").select("doc_id", "part", F.col("bits").bitwiseOR(copied).alias("bits"))


def with_labels(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """flags with `good` (labelled quality 1) and `toxic` (labelled toxic 1); without a label, or without an id, neither."""
    own = pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null")
    own = own.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    named = flags.where("doc_id is not null").join(own, "doc_id", "left").select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return named.unionByName(flags.where("doc_id is null").select("part", "bits", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def orders(spark) -> DataFrame:
    """All orders of FILTERS: a number, the letters, and the bits of the steps. A table of fixed size."""
    rows = [(i, "".join(p), [_bit(k) for k in p]) for i, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "number int, filter_order string, steps array<int>")


def replay(flags: DataFrame) -> DataFrame:
    """The counts by part, order and step, from one row (part, bits, good, toxic) a document."""
    known = orders(flags.sparkSession)
    bits, steps = F.col("bits"), len(FILTERS)

    def failed(bit: Column) -> Column:
        return bits.bitwiseAND(bit) != 0

    first = F.lit(steps + 1)
    for k in reversed(range(steps)):
        first = F.when(failed(F.col("steps")[k]), F.lit(k + 1)).otherwise(first)
    runs = flags.crossJoin(F.broadcast(known.select("number", "steps"))).select("part", "number", "bits", "good", "toxic", "steps", first.alias("first"))
    at = runs.select("part", "number", "bits", "good", "toxic", "first", F.posexplode("steps").alias("place", "bit"))
    step = F.col("place") + 1
    fails, removed = failed(F.col("bit")), F.col("first") == step
    counts = {
        "kept": F.col("first") > step,
        "removed": removed,
        "redundant": fails & (F.col("first") < step),
        "unique_fails": bits == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    summed = at.groupBy("part", "number", step.alias("step"), "bit").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    # a filter's removals over all orders: one group has as many rows as there are orders
    summed = summed.join(summed.groupBy("part", "bit").agg(F.sum("removed").alias("shapley")), ["part", "bit"])
    return summed.join(F.broadcast(known), "number").select("part", "filter_order", "step", *counts, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of FILTERS and step: documents kept after the step, removed at it, redundant, failing the step's filter only, good
    and toxic ones lost, and the filter's removals over all orders.

    A null text is empty: it fails A alone. A null source is the part "". A null doc_id has no label and is nobody's copy; its text makes no other
    row a copy. Rows of one doc_id are documents of their own, and not copies of one another. Several labels of a doc_id count as good or toxic if any
    says so. An empty table gives none. Columns of other names, in any case, do no harm."""
    return replay(with_labels(with_copies(cut(document_flags(docs), "flags")), labels))
