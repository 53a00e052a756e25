"""What the operators of this subpackage share: column picking, shared folders, bounded Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches sent to Python hold at most this many rows and bytes, so that long texts cannot fill a worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Null ids sort after every other id.
LAST_ID = (1 << 63) - 1

_own: dict[str, str] = {}
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast to the given types. Other columns, even with the same name in another case or twice, do no harm:
    an exact name wins over a differently cased one, the first over a later one. A missing column reads as null."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])

    def at(name: str):
        exact = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
        return F.col(f"_{exact[0]}") if exact else F.lit(None)

    return plain.select(*[at(n).cast(k).alias(n) for n, k in kinds.items()])


_caches: dict[str, object] = {}


def only(name: str, clear) -> None:
    """To be called in a worker before cache `name` is used there: a worker lives through many stages, and caches of other operators' are cleared,
    so that it never holds more than one."""
    others = [k for k in _caches if k != name]
    for k in others:
        _caches.pop(k)()
    _caches[name] = clear
    if others:
        import ctypes
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches follow BATCH_ROWS and BATCH_BYTES from now on, unless the session has smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        value = int(now) if now and now.lstrip("-").isdigit() else 0
        if value <= 0 or value > most:
            spark.conf.set(key, str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset (a single machine), an own temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; removed when the driver ends."""
    path = f"{shared_root(spark)}/lumenfold/{what}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    atexit.register(discard, path)
    return path


def made() -> int:
    """How many folders scratch() has given so far: a mark for discard_since()."""
    return len(_made)


def discard_since(mark: int, *kept: str) -> None:
    """Removes the folders given since the mark, but for those kept. For when what was made from them is written."""
    for path in [p for p in _made[mark:] if p not in kept]:
        discard(path)
        _made.remove(path)


def discard(path: str) -> None:
    """Removes a folder that no later work reads."""
    try:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(path)
        where.delete_dir(at)
    except (OSError, pa.ArrowException, ValueError):
        pass


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table in the shared folder, read back: later work depends on these files, not on df's lineage."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """cut(), and the folder, to be named to discard_since() while it is needed."""
    path = scratch(df.sparkSession, what)
    return written(df, path), path


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df with its lineage cut by a written table."""
    return written(df, scratch(df.sparkSession, what))


#: Bits of a sieve, and of one row of it: a sieve is 8 MB, however much goes into it.
SIEVE_BITS, _ROW_BITS = 1 << 26, 1 << 15


def sieved(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """df without most of the rows whose key is not among wanted's, and with all others: a bit for each hash of a wanted key, put together by
    aggregates of a fixed size and broadcast. So the exact join after it need not exchange the whole of df. With some hundred million keys and
    more it lets most rows through, which costs time only."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    words = wanted.select(bit(wanted_key).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("v"))
    per_row = _ROW_BITS // 64
    rows = words.groupBy(F.floor(F.col("w") / per_row).cast("long").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("w", F.lit(per_row)).cast("int"), "v"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    sieve = cut(rows.select("_row", at.alias("_words")), "sieve")
    known = df.withColumn("_bit", bit(key)).join(F.broadcast(sieve), F.shiftright(F.col("_bit"), 15) == F.col("_row"))
    held = F.call_function("shiftright", F.get("_words", F.pmod(F.shiftright("_bit", 6), F.lit(per_row)).cast("int")), F.pmod("_bit", F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return known.where(held != 0).drop("_bit", "_row", "_words")


def settle(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver's references to them are collected: that is done now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The texts, null as empty."""
    return (x or "" for x in column.to_pylist())


def whole_rows(docs: DataFrame, *names: str) -> tuple[DataFrame, list, list[str]]:
    """docs under plain column names, the columns called `names` in it (null literals where missing), and docs' own names to go back to by
    toDF(): so that rows can be filtered whole, whatever their columns are called."""
    own = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(own))])

    def at(name: str):
        found = [i for i, n in enumerate(own) if n == name] or [i for i, n in enumerate(own) if n.lower() == name.lower()]
        return F.col(f"_{found[0]}") if found else F.lit(None).cast("string")

    return plain, [at(n) for n in names], own
