"""Splits and sample sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import RANK_DOMAIN, SPLIT_DOMAIN, tagged_sha256, third

#: The splits, in the order that hashes and ranks count them.
SPLITS = ("generation", "calibration", "test")


def _named(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SPLITS]), index + 1)


def assign_splits(samples: DataFrame, key: str, seed: int, domain: str = SPLIT_DOMAIN) -> DataFrame:
    """Adds `split`, a function of the id and the seed alone: no shuffle."""
    return samples.withColumn("split", _named(third(F.col(key), seed, domain)))


def require_splits(assigned: DataFrame) -> DataFrame:
    """assigned, if each of the three splits has a row; else an error. The driver sees at most three names."""
    found = {r["split"] for r in assigned.select("split").distinct().collect()}
    if found != set(SPLITS):
        raise ValueError(f"without rows: {sorted(set(SPLITS) - found)}")
    return assigned


def fixed_count_splits(samples: DataFrame, key: str, count: int, seed: int, by: list[str] | None = None, domain: str = RANK_DOMAIN, strict: bool = True) -> DataFrame:
    """Adds `split` and `ordinal`: ids in the order of their hashes, `count` for each split in turn; later ids have no split.

    Only ids near the front matter: each task keeps its own first 3 * count by the limit on the rank, so what meets in one task stays small
    however many ids there are. Where strict, an id met twice among them, or fewer than 3 * count of them, is an error."""
    if count <= 0:
        raise ValueError("count has to be positive")
    by = by or []
    order = [tagged_sha256(F.lit(domain), F.lit(seed), F.col(key)), F.col(key)]
    group = Window.partitionBy(*(by or [F.lit(0)]))
    # the limit has to be on the rank as it is for the plan to see it
    ranked = samples.withColumn("_rank", F.row_number().over(group.orderBy(*order))).where(F.col("_rank") <= 3 * count)
    ranked = ranked.withColumn("ordinal", F.col("_rank") - 1)
    if strict:
        again = F.lag(key).over(group.orderBy("_rank")).eqNullSafe(F.col(key)) & (F.col("_rank") > 1)
        few = F.count("*").over(group) < 3 * count
        problem = F.when(F.col("_again"), F.lit("an id is met twice")).when(F.col("_few"), F.lit(f"fewer than {3 * count} ids"))
        ranked = ranked.withColumns({"_again": again, "_few": few}).withColumn("ordinal", F.when(problem.isNotNull(), F.raise_error(problem).cast("int")).otherwise(F.col("ordinal"))).drop("_again", "_few")
    return ranked.drop("_rank").withColumn("split", _named(F.floor(F.col("ordinal") / count).cast("int")))


def split_violations(members: DataFrame) -> DataFrame:
    """From members (task, split, sample_id, row_index, row_sha256): (kind, task, key) for ids or rows met twice in a split, in several splits,
    with several hashes or in several tasks, and for splits without members or outside the three."""
    cast = lambda c: F.col(c).cast("string").alias("key")
    within = members.groupBy("task", "split", "sample_id").count().where("count > 1").select(F.lit("duplicate_id").alias("kind"), "task", cast("sample_id"))
    per_id = members.groupBy("task", "sample_id").agg(F.count_distinct("split").alias("splits"), F.count_distinct("row_sha256").alias("hashes"))
    across = per_id.where("splits > 1").select(F.lit("split_leakage").alias("kind"), "task", cast("sample_id"))
    conflicting = per_id.where("hashes > 1").select(F.lit("conflicting_hashes").alias("kind"), "task", cast("sample_id"))
    rows = members.groupBy("task", "row_index").agg(F.count_distinct("sample_id").alias("ids")).where("ids > 1").select(F.lit("duplicate_row_index").alias("kind"), "task", cast("row_index"))
    tasks = members.groupBy("sample_id").agg(F.count_distinct("task").alias("tasks"), F.min("task").alias("task")).where("tasks > 1").select(F.lit("id_in_several_tasks").alias("kind"), "task", cast("sample_id"))
    unknown = members.where(~F.col("split").isin(*SPLITS)).select(F.lit("unknown_split").alias("kind"), "task", cast("split")).distinct()
    found = members.groupBy("task").agg(F.collect_set("split").alias("found"))
    missing = found.select(F.lit("empty_split").alias("kind"), "task", F.explode(F.array_except(F.array(*[F.lit(s) for s in SPLITS]), "found")).alias("key"))
    out = within
    for part in (across, conflicting, rows, tasks, unknown, missing):
        out = out.unionByName(part)
    return out


def ordered_digest(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """SHA-256 of each group's values in order, as a JSON array. Groups are dealt to tasks and sorted there; a task passes its rows once and carries
    the hash along, so a group of any size takes the memory of one batch. Equal places are taken in the order of their values."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    rows = df.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.to_json(F.struct(F.lit(1).alias("_"), *by), {"ignoreNullFields": "false"}).alias("_g"), F.substr(text, F.lit(2), F.length(text) - 2).alias("_j"))
    rows = rows.repartition("_g").sortWithinPartitions("_g", *[f"_o{i}" for i in range(len(order))], "_j").select(*by, "_g", "_j")
    out = T.StructType([*[df.schema[c] for c in by], T.StructField(name, T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, row, state = None, None, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_arrays([*row.columns, pa.array([state.hexdigest()])], [*row.schema.names, name])
        for b in batches:
            for i, (g, j) in enumerate(zip(b.column("_g").to_pylist(), b.column("_j").to_pylist(), strict=True)):
                if g != group:
                    if group is not None:
                        state.update(b"]")
                        yield done()
                    group, row, state = g, b.slice(i, 1).select(by), hashlib.sha256(b"[")
                else:
                    state.update(b",")
                state.update(j.encode())
        if group is not None:
            state.update(b"]")
            yield done()

    return rows.mapInArrow(fold, out)


def ids_digest(members: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 of the ordered ids of each group, as a JSON array. An id met twice in a group is an error."""
    most = members.groupBy(*by, "sample_id").count().groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max("count").alias("_most"))
    out = ordered_digest(members, by, ["ordinal"], F.col("sample_id"), "sample_ids_sha256")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    once = F.when(F.col("_most") == 1, F.col("sample_ids_sha256")).otherwise(F.raise_error(F.lit("sample ids must be unique")).cast("string"))
    return out.join(most, same).select(*by, once.alias("sample_ids_sha256"))


def selected(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Members joined to their rows by id; those whose row is missing or has another hash have a `problem`."""
    joined = members.join(rows.withColumnRenamed("row_sha256", "found_sha256"), "sample_id", "left")
    problem = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("found_sha256") != F.col("row_sha256"), "hash mismatch")
    return joined.withColumn("problem", problem)


def remaining(planned: DataFrame, done: DataFrame, keys: Iterable[str] = ("task", "split", "sample_id", "kind")) -> DataFrame:
    """Planned rows not yet done."""
    return planned.join(done, list(keys), "left_anti")


def appended(entries: DataFrame, fresh: DataFrame, keys: Iterable[str] = ("task", "split", "sample_id", "kind")) -> DataFrame:
    """A checkpoint's entries with fresh ones; a fresh entry with a known key is left out. (Sinks sort by the keys, see sinks.checkpoint.)"""
    keys = list(keys)
    return entries.unionByName(fresh.dropDuplicates(keys).join(entries, keys, "left_anti"))


def grid(spark, **dimensions: Iterable[object]) -> DataFrame:
    """All combinations of small named lists of values: the experiment's cells, numbered by `cell`. Cells are made where they are used: a number of
    a range is read in the mixed radix of the lists' lengths, the last one counting fastest."""
    lists = {name: list(values) for name, values in dimensions.items()}
    total = math.prod(len(v) for v in lists.values())
    stride, columns = total, []
    for name, values in lists.items():
        stride = stride // len(values) if values else 1
        place = F.floor(F.col("id") / max(stride, 1)) % max(len(values), 1)
        columns.append(F.get(F.array(*[F.lit(v) for v in values]), place.cast("int")).alias(name))
    return spark.range(total).select(F.col("id").alias("cell"), *columns)


def expanded(cells: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the entries they are to be evaluated on: those that agree in `keys`. A cell without any keeps a row with null entries, so that it
    is seen to be missing."""
    return cells.join(entries, keys, "left")
