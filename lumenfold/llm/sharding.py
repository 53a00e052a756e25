"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix; DataFrame functions only.

1. Rows fall into blocks by a hash of their content; block sizes are counted.
2. The matrix of block-to-shard counts is drawn exactly: the whole of the shards' capacities is split between the left and the right half of
   the blocks by hypergeometric draws, then each half is split again, until a row of counts stands for each block.
3. Each block is permuted locally (ranked by a random key), and its first a[0] rows go to shard 0, the next a[1] to shard 1, and so on.
4. After the exchange each shard is permuted again: a second random key orders it; slots are ranks in that order.

No task holds a whole shard: the second order is by ranges of the key, and slots add the counts of the ranges before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

SHARDS, SEED = 24, 2024
#: Rows aimed at in a block and in a range of a shard; the number of blocks and ranges follows from the row count.
BLOCK_ROWS = 8_192
#: At most so many blocks, so that the matrix stays small enough to broadcast; blocks grow beyond BLOCK_ROWS then.
MOST_BLOCKS = 1 << 16
#: At most so many ranges of a shard: their counts are broadcast.
MOST_RANGES = 1 << 12
#: Rows that are alike are numbered by so many cells.
CELLS = 4096
_UNIT = float(1 << 53)
#: Logarithms of 0! to 15!.
_SMALL = "array(" + ", ".join(f"{math.lgamma(n + 1)!r}D" for n in range(16)) + ")"


def _uniform(*parts: Column) -> Column:
    """In [0, 1), 53 bits from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(_UNIT)


def _log_factorial(n: str) -> str:
    """SQL: from a table below 16, by Stirling's series (exact to about 1e-13) from there on."""
    x = f"(CAST({n} AS DOUBLE) + 1)"
    return f"IF({n} < 16, {_SMALL}[CAST(least({n}, 15) AS INT)], ({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)))"


def _choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def _hypergeometric(good: str, bad: str, drawn: str, u: str) -> str:
    """SQL: how many of `drawn` balls are good, by inversion of u from the mode outwards. The mode's probability comes from log factorials, its
    neighbours' from the ratio of successive terms. The walk covers 12 standard deviations on both sides, or the whole range if that is less."""
    up = "IF(s.i < q.hi, s.up * (q.g - s.i) * (q.d - s.i) / ((s.i + 1D) * (q.b - q.d + s.i + 1)), 0D)"
    down = "IF(s.j > q.lo, s.down * s.j * (q.b - q.d + s.j) / ((q.g - s.j + 1D) * (q.d - s.j + 1)), 0D)"
    step = f"""IF(s.done, s, transform(array(named_struct('up', {up}, 'down', {down})), t -> named_struct('rest', s.rest - t.up - t.down, 'up', t.up, 'down', t.down,
        'i', least(s.i + 1, q.hi), 'j', greatest(s.j - 1, q.lo), 'got', CASE WHEN s.rest < t.up THEN s.i + 1 WHEN s.rest < t.up + t.down THEN s.j - 1 ELSE s.got END,
        'done', s.rest < t.up + t.down))[0])"""
    walk = f"aggregate(sequence(1, r.reach), named_struct('rest', q.u - a, 'up', a, 'down', a, 'i', r.m, 'j', r.m, 'got', r.m, 'done', q.u < a), (s, k) -> {step}, s -> s.got)"
    at_mode = f"exp({_choose('q.g', 'r.m')} + {_choose('q.b', '(q.d - r.m)')} - {_choose('(q.g + q.b)', 'q.d')})"
    n = "greatest(q.g + q.b, 2D)"
    mode = "greatest(q.lo, least(q.hi, CAST(floor((q.d + 1D) * (q.g + 1) / (q.g + q.b + 2)) AS BIGINT)))"
    reach = f"CAST(least(1e9D, ceil(12 * sqrt(CAST(q.d AS DOUBLE) * q.g * q.b * greatest(q.g + q.b - q.d, 0) / ({n} * {n} * ({n} - 1)))) + 12) AS INT)"
    return f"""transform(array(named_struct('g', {good}, 'b', {bad}, 'd', {drawn}, 'u', {u}, 'lo', greatest(0L, {drawn} - {bad}), 'hi', least({drawn}, {good}))), q ->
        transform(array(named_struct('m', {mode}, 'reach', {reach})), r -> IF(q.lo = q.hi, q.lo, transform(array({at_mode}), a -> {walk})[0]))[0])[0]"""


def _split(seed: int) -> str:
    """SQL: multivariate hypergeometric. Of the room of the shards, how much goes to a part of `wanted` rows; one draw a shard."""
    u = f"shiftrightunsigned(xxhash64({seed}, low, width, size(v.out)), 11) / {_UNIT!r}D"
    draw = _hypergeometric("c", "(v.rest - c)", "v.want", u)
    return f"""aggregate(room, named_struct('rest', aggregate(room, 0L, (x, y) -> x + y), 'want', wanted, 'out', CAST(array() AS ARRAY<BIGINT>)),
        (v, c) -> transform(array({draw}), got -> named_struct('rest', v.rest - c, 'want', v.want - got, 'out', concat(v.out, array(got))))[0], v -> v.out)"""


def communication_matrix(sizes: DataFrame, blocks: int, shards: int, seed: int = SEED) -> DataFrame:
    """From sizes (block int, n long): (block, ends), where ends are the running counts of the block's rows by shard.

    Every level splits each node (low, width, room) of blocks in two. All of it is over at most `blocks` rows, MOST_BLOCKS at most, which is
    why the running sums of their sizes may be broadcast."""
    spark = sizes.sparkSession
    from pyspark.sql import Window

    edges = spark.range(0, blocks + 1, 1, 1).select(F.col("id").cast("int").alias("edge"))
    edges = edges.join(F.broadcast(sizes), F.col("edge") == F.col("block") + 1, "left")
    edges = cut(edges.select("edge", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("edge")).cast("long").alias("before")), "shard-sizes")
    total = F.col("total")
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (F.floor(total / shards) + F.when(s < total % shards, 1).otherwise(0)).cast("long"))
    nodes = edges.agg(F.min("edge").alias("low"), F.max("edge").alias("width"), F.min("before").alias("first"), F.max("before").alias("total")).select("low", "width", "first", room.alias("room"))
    while blocks > 1:
        blocks = (blocks + 1) // 2
        half = F.ceil(F.col("width") / 2).cast("int")
        nodes = nodes.withColumn("half", half).join(F.broadcast(edges), F.col("low") + F.col("half") == F.col("edge"))
        nodes = nodes.withColumn("wanted", F.col("before") - F.col("first")).withColumn("part", F.expr(f"IF(width > 1, {_split(seed)}, room)"))
        left = F.struct("low", F.col("half").alias("width"), "first", F.col("part").alias("room"))
        right = F.struct((F.col("low") + F.col("half")).alias("low"), (F.col("width") - F.col("half")).alias("width"), F.col("before").alias("first"), F.zip_with("room", "part", lambda a, b: a - b).alias("room"))
        nodes = nodes.select(F.explode(F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(left))).alias("x")).select("x.*")
    running = F.aggregate("room", F.array().cast("array<bigint>"), lambda s, x: F.concat(s, F.array(x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)))))
    return nodes.select(F.col("low").alias("block"), running.alias("ends"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with `again`, 0, 1, 2... among rows alike in id, size and checksum: so that equal rows have keys of their own, and the numbers do not
    depend on the partitioning. Rows are counted by cells first, as any part of a table may be copies of one row; a cell is one of CELLS a key has."""
    own = ["no_id", "id", "size", "text_crc32"]
    rows = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    cells = rows.groupBy(*own, "cell").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(_window(own, "cell")) - F.col("n")).alias("before")
    later = cells.select(*own, "cell", before).where("before > 0")
    each = rows.withColumn("i", F.row_number().over(_window([*own, "cell"], "doc_id")) - 1)
    return each.join(later, [*own, "cell"], "left").select("doc_id", "size", "text_crc32", (F.col("i") + F.coalesce("before", F.lit(0))).cast("long").alias("again"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is `rows`: shard sizes differ by one at most.

    A null text counts as empty: size 8 and the checksum of nothing. Null and repeated doc_ids are rows like others; rows alike in id, size
    and checksum are numbered and shuffled like others. An empty table gives none. The result depends on the rows and the seed, not on their partitioning."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = pick(docs, doc_id="long", text="string").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)).cast("int")  # written, so that it stays
    rows = cut(_numbered(cut(rows.withColumn("cell", place), "shard-rows")), "shard-rows")
    total = rows.count()
    blocks = max(1, min(MOST_BLOCKS, -(-total // block_rows)))
    ranges = max(1, min(MOST_RANGES, -(-total // (shards * block_rows))))
    key = (F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("again"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), *key), F.lit(blocks)).cast("int"))
    matrix = communication_matrix(rows.groupBy("block").agg(F.count("*").alias("n")), blocks, shards, seed)
    local = F.row_number().over(_window("block", F.xxhash64(F.lit(seed), F.lit("local"), *key), *key)) - 1
    ranked = rows.withColumn("local", local)
    # At most MOST_BLOCKS rows of `shards` numbers.
    placed = ranked.join(F.broadcast(matrix), "block").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("local"))).cast("int"))
    second = _uniform(F.lit(seed), F.lit("slot"), *key)
    placed = placed.select("doc_id", "size", "text_crc32", "again", "shard", second.alias("u")).withColumn("range", F.floor(F.col("u") * ranges).cast("int"))
    placed = cut(placed, "shard-placed")
    before = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = before.select("shard", "range", (F.sum("n").over(_window("shard", "range")) - F.col("n")).alias("before"))
    slot = F.row_number().over(_window(("shard", "range"), "u", *key)) - 1
    out = placed.withColumn("at", slot).join(F.broadcast(before), ["shard", "range"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _window(by, *order):
    from pyspark.sql import Window

    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
