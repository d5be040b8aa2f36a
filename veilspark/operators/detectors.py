"""Detectors given by the caller: language models over windows, entity models over parts, retries, cached results."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.prepare import resolve_overlaps, windows
from veilspark.operators.channels import detect
from veilspark.operators.registry import KEYS, Registry
from veilspark.shared import written
from veilspark.sources.codecs import detection_from_json, detection_to_json

#: Retries after the first call, the first wait in seconds (doubled each time), and the pause before each call.
RETRIES, BASE_WAIT, THROTTLE = 5, 2.0, 0.5


class Busy(Exception):
    """Raised by a detector that is asked too often; ``after`` says how many seconds to wait, where it is known."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def with_retry(finder: Callable, retries: int = RETRIES, base_wait: float = BASE_WAIT, throttle: float = THROTTLE, pause: Callable[[float], None] = time.sleep) -> Callable:
    """``finder`` asked again after ``Busy``, as often as ``retries`` says; any other error ends the job."""

    def call(*args):
        for attempt in range(retries + 1):
            if throttle > 0 and not attempt:
                pause(throttle)
            try:
                return finder(*args)
            except Busy as e:
                if attempt == retries:
                    raise
                pause(e.after if e.after is not None else base_wait * 2**attempt)

    return call


def detect_documents(texts: DataFrame, finder: Callable[[str], list[tuple[str, str]]], max_tokens: int = 15_000, overlap: int = 0) -> DataFrame:
    """Run a detector over the windows of texts (part_id, text): part_id, spans, not_found.

    ``spans`` are (start, end, ene_type) without those inside another, in order of place; ``not_found`` are (ene_type,
    surface) that the detector named and the window does not hold, once each, in order. A text without windows has neither.
    """
    kind = texts.schema["part_id"].dataType.simpleString()
    cut = texts.select("part_id", "text", F.posexplode(windows(F.col("text"), max_tokens, overlap)).alias("k", "w"))
    pieces = cut.select(F.struct("part_id", "k").alias("part_id"), F.col("w.start").alias("start"), F.expr("substring(text, w.start + 1, w.end - w.start)").alias("text"))
    found = detect(pieces, finder).select("part_id.part_id", "part_id.k", "start", "end", "ene_type", "found", "surface", F.col("place"))
    each = found.groupBy("part_id").agg(F.collect_list(F.when(F.col("found"), F.struct("start", "end", "ene_type"))).alias("all"), F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("k", "place", "ene_type", "surface")))).alias("missing"))
    outer = resolve_overlaps(F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    first = lambda s: F.get(F.filter("all", lambda x: (x["start"] == s["start"]) & (x["end"] == s["end"])), F.lit(0))["ene_type"]
    spans = F.transform(outer, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), first(s).alias("ene_type")))
    missing = F.array_distinct(F.transform("missing", lambda x: F.struct(x["ene_type"].alias("ene_type"), x["surface"].alias("surface"))))
    out = texts.select("part_id").join(each.select("part_id", spans.alias("spans"), missing.alias("not_found")), "part_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(each.select(spans.alias("spans"), missing.alias("not_found")).schema[c].dataType)).alias(c)
    return out.select(F.col("part_id").cast(kind), none("spans"), none("not_found"))


def cached_detect(registry: Registry, documents: DataFrame, finder: Callable[[str], list[tuple[str, str]]], model: str, version: str, flatten: bool = True, force: bool = False, max_tokens: int = 15_000, overlap: int = 0) -> DataFrame:
    """Detections of documents (content_hash, text) by way of the registry's layer: content_hash, spans, not_found, cached.

    What the layer has under the same hash, model, flattening and version is read; the rest is detected and put there.
    With ``force`` all is detected anew and put over what was there.
    """
    layer, keys = "llm_detection", KEYS["llm_detection"]
    named = documents.select("content_hash", "text").dropDuplicates(["content_hash"]).withColumn("model", F.lit(model)).withColumn("flatten", F.lit(flatten)).withColumn("detector_version", F.lit(version))
    wanted, known = named, None
    if not force and registry.holds(layer):
        rows = registry.get(layer).select(*keys, "detections")
        known = named.drop("text").join(rows, keys)
        wanted = named.join(rows.select(*keys), keys, "left_anti")
    new = detect_documents(wanted.select(F.col("content_hash").alias("part_id"), "text"), finder, max_tokens, overlap)
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["ene_type"].alias("ene_type"), F.lit(None).cast("string").alias("reason"), F.lit("exact").alias("how")))
    made = new.select(F.col("part_id").alias("content_hash"), F.lit(model).alias("model"), F.lit(flatten).alias("flatten"), F.lit(version).alias("detector_version"), detection_to_json(spans, F.col("not_found"), F.lit(model), F.lit(version)).alias("detections"))
    before = None if known is None else written(known.select("content_hash", "detections"), "known").withColumn("cached", F.lit(True))
    made = written(made, "detected")
    registry.put(layer, made)
    out = made.select("content_hash", "detections").withColumn("cached", F.lit(False))
    out = out if before is None else out.unionByName(before)
    return out.select("content_hash", detection_from_json(F.col("detections")).alias("d"), "cached").select("content_hash", "d.spans", "d.not_found", "cached")


def entities(parts: DataFrame, model: str, find: Callable[[list[str]], list[list[tuple[str, int, int]]]], labels: list[str] | None = None, batch_chars: int = 20_000) -> DataFrame:
    """Entities of parts by a model given by the caller: part_id, model, label, start, end, surface.

    ``find`` gets texts of ``batch_chars`` together (a longer text alone) and returns (label, start, end) of each text. With ``labels``
    only these stay. Null texts have no entities.
    """
    kind = parts.schema["part_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            out, at = [], 0
            while at < len(texts):
                to, size = at + 1, len(texts[at] or "")
                while to < len(texts) and size + len(texts[to] or "") <= batch_chars:
                    size += len(texts[to] or "")
                    to += 1
                for part, text, found in zip(ids[at:to], texts[at:to], find([t or "" for t in texts[at:to]])):
                    out += [(part, model, label, s, e, (text or "")[s:e]) for label, s, e in found if labels is None or label in labels]
                at = to
            types = (batch.column(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=["part_id", "model", "label", "start", "end", "surface"])

    return parts.select("part_id", "text").mapInArrow(run, f"part_id {kind}, model string, label string, start int, end int, surface string")


def token_debug(toks: DataFrame, found: DataFrame) -> DataFrame:
    """Tokens (part_id, i, start, end, surface, and tag where there is one) with the entity they stand in: label and B, I or O."""
    e = found.select("part_id", "label", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    inside = (F.col("start") < F.col("e_end")) & (F.col("e_start") < F.col("end"))
    met = toks.join(e, "part_id").where(inside).groupBy("part_id", "i").agg(F.min(F.struct("e_start", "e_end", "label")).alias("x"))
    out = toks.where(F.trim("surface") != "").join(met, ["part_id", "i"], "left")
    iob = F.when(F.col("x").isNull(), "O").when(F.col("x.e_start") >= F.col("start"), "B").otherwise("I")
    return out.select(*toks.columns, F.coalesce("x.label", F.lit("")).alias("label"), iob.alias("iob"))
