"""Masking of a stream of parts: the batch plans on each micro-batch, numbering on over all batches of a bundle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.plans.masking import analyze, mask


def contact_stream(parts: DataFrame) -> DataFrame:
    """Contact candidates of streamed parts; stateless, so it plans like a batch."""
    from veilspark.operators.channels import contacts

    return contacts(parts)


def mask_stream(parts: DataFrame, entries: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, level: str = "strong", trigger: dict | None = None) -> StreamingQuery:
    """Mask micro-batches of (bundle_id, part_id, part_index, text); ``sink`` gets masked parts, mapping and batch number.

    A bundle may span batches: each batch's mapping is kept beside the checkpoint, a folder a batch, and later batches
    keep its placeholders and number on from it. A batch that is run again sees the mappings of earlier batches only
    and overwrites its own, so it gives the same result, and a sink that overwrites by batch number is exactly-once.
    """
    state = f"{checkpoint.rstrip('/')}-mappings"
    kept = ["bundle_id", "key", "category", "placeholder", "number", "batch"]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _earlier(spark, state, number)
        found = analyze(batch.select("part_id", "text"), entries)
        masked, mapping = mask(found, batch.select("bundle_id", "part_id", "part_index"), level, known=known)
        mapping.withColumn("batch", F.lit(number)).select(kept).write.mode("overwrite").parquet(f"{state}/{number:012d}")
        sink(masked, mapping, number)

    return parts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _earlier(spark: SparkSession, state: str, number: int) -> DataFrame | None:
    """The mappings of the batches before ``number``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = sorted(x.getPath().getName() for x in files.listStatus(path))
    names = [x for x in names if x.isdigit() and int(x) < number]
    return spark.read.parquet(*[f"{state}/{x}" for x in names]) if names else None
