"""What the operators of this subpackage share: inputs, row keys, shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.shared import shared_dir, written

RID = "_veil_rid"
#: Rows of a narrow table that are sent to all executors at most; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
SALTS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are over."""
    gc.collect()
    with contextlib.suppress(Exception):  # events that wait for listeners hold their plans
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    with contextlib.suppress(Exception):
        spark.sparkContext._jvm.System.gc()


def drop_written(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, or plans over one, and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        here = shared_dir(spark).rsplit("/", 1)[-1]
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/{here}/" in top + "/":  # never an input of the caller's
                path = hadoop(top)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sent(small: DataFrame, label: str, limit: int = 1_000_000) -> DataFrame:
    """``small``, written once; marked to be sent to all executors if it has no more than ``limit`` rows."""
    small = written(small, label)
    return F.broadcast(small) if small.count() <= limit else small


def hot_join(rows: DataFrame, answers: DataFrame, key: str | list[str], how: str = "left", limit: int | None = None) -> DataFrame:
    """``rows`` joined with ``answers`` (one row a key, written), whose column ``rows`` tells how many rows ask.

    Up to ``limit`` (BROADCAST_ROWS) answers are sent to all executors. Beyond that they meet the rows by a shuffle, where the rows
    of hot keys (a hundred-thousandth of all rows or more, so a hundred thousand keys at most) are dealt to SALTS
    tasks by their other columns and these keys' answers go to each.
    """
    key = [key] if isinstance(key, str) else key
    value = [c for c in answers.columns if c not in (*key, "rows")]
    n, total = answers.agg(F.count(F.lit(1)), F.sum("rows")).first()
    if n <= (BROADCAST_ROWS if limit is None else limit):
        return rows.join(F.broadcast(answers.select(*key, *value)), key, how)
    most = max(1000, total // 100_000)
    hot = F.broadcast(answers.where(F.col("rows") > most).select(*key, F.lit(True).alias("_hot")))
    other = [c for c in rows.columns if c not in key]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*other), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("rows") > most, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return dealt.join(answers.select(*key, *value, F.explode(every).alias("_salt")), [*key, "_salt"], how).drop("_salt")


def keyed(docs: DataFrame, *columns: str, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``id_column``, ``columns`` and a unique non-null long key RID.

    The id itself is the key where it is unique and never null (one aggregate over that column tells).
    Otherwise the rows are written once with a generated key, so that every later scan sees the same one.
    """
    kept = docs.select(id_column, *columns)
    n, distinct, least = docs.agg(F.count(F.lit(1)), F.count_distinct(id_column), F.min(F.col(id_column).cast("long"))).first()
    if n == distinct and (least is not None or n == 0):
        return kept.withColumn(RID, F.col(id_column).cast("long"))
    return written(kept.withColumn(RID, F.monotonically_increasing_id()), "keyed")


def held_out(column: str, mod: int) -> "F.Column":
    """True where crc32 of the id as text leaves no remainder (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod == 0


_HELD: list[dict] = []


def held_cache(cache: dict) -> dict:
    """Register what a worker remembers from task to task, so that tasks of other operators can have it dropped."""
    _HELD.append(cache)
    return cache


def forget() -> None:
    """At the start of a task that remembers nothing: drop what the worker's earlier tasks remembered, and trim."""
    for cache in _HELD:
        cache.clear()
    trim()


def trim() -> None:
    """Give freed memory of earlier tasks back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def string_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes as one flat array, and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs inside hands Python at most ``rows`` rows at once; for whole texts, of which Spark else holds 10,000 on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a record batch whose ``column`` holds about ``limit`` bytes each (a longer text stands alone)."""
    _, offsets = string_bytes(batch.column(column))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield batch.slice(begin, min(end, n) - begin)
        begin = min(end, n)
