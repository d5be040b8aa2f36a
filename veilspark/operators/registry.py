"""Document registry and layer caches as append-only parquet tables with last-write-wins reads.

A write appends rows with ``created_at`` and a write number; a read keeps the newest row of each key and leaves out
keys whose newest row is a tombstone. Nothing is rewritten, so a lost executor costs only its task.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions.scalars import preview
from veilspark.shared import written

KEYS = {
    "documents": ["content_hash"],
    "ner": ["content_hash", "model", "flatten"],
    "llm_detection": ["content_hash", "model", "flatten", "detector_version"],
    "mask_draft": ["content_hash"],
}


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row written for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("write_no"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class Registry:
    """Layer tables under one folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def holds(self, layer: str) -> bool:
        """Whether anything was ever written to a layer."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{layer}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def put(self, layer: str, rows: DataFrame, write_no: int | None = None, deleted: bool = False) -> None:
        """Append rows; a later write wins over an earlier one of the same instant, by the clock's nanoseconds."""
        write_no = time.time_ns() if write_no is None else write_no
        out = rows.withColumn("write_no", F.lit(write_no).cast("long")).withColumn("deleted", F.lit(deleted))
        if "created_at" not in out.columns:
            out = out.withColumn("created_at", F.current_timestamp())
        out.write.mode("append").parquet(f"{self.root}/{layer}")

    def get(self, layer: str) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{layer}")
        return newest(rows, KEYS[layer]).where("not deleted").drop("deleted", "write_no")

    def delete(self, layer: str, keys: DataFrame, write_no: int | None = None) -> None:
        """Write tombstones for the given keys, or for all rows that hold the given part of a key."""
        if self.holds(layer):
            gone = self.get(layer).drop("created_at").join(keys.distinct(), keys.columns, "left_semi")
            self.put(layer, gone, write_no, deleted=True)

    def delete_documents(self, hashes: DataFrame, layer: str | None = None) -> None:
        """Delete documents (content_hash) with all their layers, or of one layer only."""
        if layer is not None and layer not in KEYS:
            raise ValueError(f"unknown layer: {layer}")
        for name in [layer] if layer else KEYS:
            self.delete(name, hashes.select("content_hash"))

    def document(self, content_hash: str) -> DataFrame:
        """The registered document of a hash; one that is not registered is an error."""
        found = self.get("documents").where(F.col("content_hash") == content_hash) if self.holds("documents") else None
        if found is None or not found.limit(1).count():
            raise LookupError(f"not registered: {content_hash}")
        return found

    def patch(self, content_hash: str, **values: str) -> DataFrame:
        """Change columns of a registered document, such as its kind; it keeps its place in the list."""
        kept = self.document(content_hash)
        unknown = set(values) - set(kept.columns)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        for column, value in values.items():
            kept = kept.withColumn(column, F.lit(value).cast(kept.schema[column].dataType))
        self.put("documents", kept)
        return self.document(content_hash)

    def draft(self, content_hash: str) -> DataFrame:
        """The reviewer's edits of a registered document: one row of (added, removed) spans, empty where none are kept."""
        self.document(content_hash)
        empty = self.spark.createDataFrame([(content_hash, [], [])], DRAFT)
        if not self.holds("mask_draft"):
            return empty
        kept = self.get("mask_draft").where(F.col("content_hash") == content_hash).select("content_hash", F.array_sort("added").alias("added"), F.array_sort("removed").alias("removed"))
        return kept if kept.limit(1).count() else empty

    def save_draft(self, content_hash: str, added: list[tuple[int, int]], removed: list[tuple[int, int]]) -> DataFrame:
        self.document(content_hash)
        rows = [(content_hash, sorted(set(added)), sorted(set(removed)))]
        self.put("mask_draft", self.spark.createDataFrame(rows, DRAFT))
        return self.draft(content_hash)

    def delete_orphans(self, execute: bool = False) -> DataFrame:
        """Hashes that a layer holds and no registered document has, with their rows in each layer; deleted on demand only."""
        layers = [k for k in KEYS if k != "documents" and self.holds(k)]
        documents = self.get("documents").select("content_hash") if self.holds("documents") else self.spark.createDataFrame([], "content_hash string")
        found = None
        for name in layers:
            rows = orphans(self.get(name), documents).groupBy("content_hash").agg(F.count(F.lit(1)).alias("rows")).withColumn("layer", F.lit(name))
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], "content_hash string, layer string, rows bigint")
        found = found.select("content_hash", "layer", "rows")
        if execute:
            found = written(found, "orphans")  # as it was before they go
            for name in layers:
                self.delete(name, found.where(F.col("layer") == name).select("content_hash"))
        return found


DRAFT = "content_hash string, added array<struct<start:int,end:int>>, removed array<struct<start:int,end:int>>"


def register(parts: DataFrame, kind: str = "text") -> DataFrame:
    """Registry rows of (name, chunks): content hash, kind, name, characters, chunks, in the registry's shape."""
    from veilspark.functions.scalars import content_hash

    size = F.aggregate("chunks", F.lit(0), lambda s, c: s + F.length(c))
    ok = parts.where(F.exists("chunks", lambda c: F.trim(c) != ""))
    return ok.select(content_hash(F.col("chunks")).alias("content_hash"), F.lit(kind).alias("source_kind"), F.col("name").alias("source_name"), size.alias("char_count"), F.size("chunks").alias("chunk_count"), "chunks")


def listing(documents: DataFrame, ner: DataFrame, llm: DataFrame) -> DataFrame:
    """Registered documents, newest first, with their distinct models and whether a detector has seen them."""
    models = ner.groupBy("content_hash").agg(F.array_sort(F.collect_set("model")).alias("models"))
    seen = llm.select("content_hash").distinct().withColumn("has_llm", F.lit(True))
    out = documents.join(models, "content_hash", "left").join(seen, "content_hash", "left")
    return out.withColumn("models", F.coalesce("models", F.array().cast("array<string>"))).withColumn("has_llm", F.coalesce("has_llm", F.lit(False))).orderBy(F.desc("created_at"), "content_hash")


def orphans(layer: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of a layer whose document is not registered."""
    return layer.join(documents.select("content_hash"), "content_hash", "left_anti")


def hits_and_misses(wanted: DataFrame, layer: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return wanted.join(layer, keys), wanted.join(layer.select(*keys), keys, "left_anti")


def distinct_values(layer: DataFrame, column: str) -> DataFrame:
    """The models or detector versions that a layer holds for each document: content_hash, values."""
    return layer.groupBy("content_hash").agg(F.array_sort(F.collect_set(column)).alias("values"))


def full_audit(documents: DataFrame, ner: DataFrame, llm: DataFrame, drafts: DataFrame, width: int = 60) -> DataFrame:
    """Every hash that any table knows, newest first, with what is known of it.

    ``documents``: a registry's; ``ner``: content_hash, model, created_at, text; ``llm``: content_hash, detector_version,
    created_at. A document that is not registered has the time of its first layer and the text of its first analysis.
    """
    body = F.array_join(F.transform("chunks", lambda c: c), "")
    d = documents.select("content_hash", F.lit(True).alias("registered"), "source_kind", "source_name", F.col("char_count").alias("chars"), "chunk_count", F.col("created_at").alias("registered_at"), body.alias("body"))
    first = ner.groupBy("content_hash").agg(F.array_sort(F.collect_set("model")).alias("ner_models"), F.min("created_at").alias("ner_at"), F.min_by("text", "created_at").alias("analysed"))
    seen = llm.groupBy("content_hash").agg(F.array_sort(F.collect_set("detector_version")).alias("llm_versions"), F.min("created_at").alias("llm_at"))
    every = d.select("content_hash").unionByName(first.select("content_hash")).unionByName(seen.select("content_hash")).unionByName(drafts.select("content_hash")).distinct()
    out = every.join(d, "content_hash", "left").join(first, "content_hash", "left").join(seen, "content_hash", "left").join(drafts.select("content_hash", F.lit(True).alias("has_draft")).distinct(), "content_hash", "left")
    none, text = F.array().cast("array<string>"), F.coalesce("body", "analysed", F.lit(""))
    return out.select(
        "content_hash",
        F.coalesce("registered", F.lit(False)).alias("registered"),
        "source_kind",
        "source_name",
        F.coalesce("chars", F.length(text)).alias("char_count"),
        "chunk_count",
        F.coalesce("ner_models", none).alias("ner_models"),
        F.coalesce("llm_versions", none).alias("llm_versions"),
        F.coalesce("has_draft", F.lit(False)).alias("has_draft"),
        F.coalesce("registered_at", F.least("ner_at", "llm_at")).alias("created_at"),
        preview(text, width).alias("preview"),
    ).orderBy(F.desc("created_at"), "content_hash")


def audit(documents: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Every hash that any table knows: registered or not, and its rows in each layer."""
    every = documents.select("content_hash")
    for df in layers.values():
        every = every.unionByName(df.select("content_hash"))
    out = every.distinct().join(documents.select("content_hash", F.lit(True).alias("registered")), "content_hash", "left")
    for name, df in layers.items():
        out = out.join(df.groupBy("content_hash").agg(F.count(F.lit(1)).alias(name)), "content_hash", "left").fillna(0, [name])
    return out.fillna(False, ["registered"])


def draft_selection(auto: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Spans selected after a reviewer's edits: automatic ones and added ones without the removed."""
    cols = ["content_hash", "start", "end"]
    return auto.select(*cols).unionByName(added.select(*cols)).distinct().join(removed.select(*cols), cols, "left_anti")
