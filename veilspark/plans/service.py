"""Requests as plans: parts of bundles from texts, stored documents or files are checked, resolved, analysed and masked.

A request's parts are rows (bundle_id, part_id, part_index, text, content_hash, file_path). Everything that is not right
about them is told in one error before any analysis. Spans of answers are in the original text's coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.functions.prepare import back_project, body
from veilspark.operators import channels as C
from veilspark.operators import consensus as K
from veilspark.operators import rewrite as R
from veilspark.operators.registry import Registry, register
from veilspark.plans.masking import Analysis, analyze, selected
from veilspark.shared import written
from veilspark.sources.files import chunks, load

PARTS = "bundle_id string, part_id string, part_index int, text string, content_hash string, file_path string"
SOURCES = ("text", "content_hash", "file_path")


def request(spark: SparkSession, text: str | None = None, parts: list[dict] | None = None, bundle_id: str = "_") -> DataFrame:
    """The parts of one bundle, from a single text or a list of {id, text | content_hash | file_path}."""
    if (text is None) == (parts is None):
        raise ValueError("give either a text or parts")
    given = [{"id": "_", "text": text}] if parts is None else parts
    if not given:
        raise ValueError("no parts")
    return spark.createDataFrame([(bundle_id, p["id"], k, *(p.get(s) for s in SOURCES)) for k, p in enumerate(given)], PARTS)


def checked(parts: DataFrame) -> DataFrame:
    """``parts`` if each has exactly one source and a name of its own in its bundle; else ValueError, with what is wrong."""
    sources = sum((F.col(s).isNotNull().cast("int") for s in SOURCES), F.lit(0))
    named = parts.groupBy("bundle_id", "part_id").agg(F.count(F.lit(1)).alias("n"), F.max((sources != 1).cast("int")).alias("bad"))
    seen = named.agg(F.count(F.lit(1)), F.sum("bad"), F.count_if(F.col("n") > 1), F.min(F.when(F.col("bad") > 0, F.col("part_id"))), F.min(F.when(F.col("n") > 1, F.col("part_id")))).first()
    if not seen[0]:
        raise ValueError("no parts")
    wrong = [f"{n} parts {what}, such as {name!r}" for n, what, name in ((seen[1], f"do not have exactly one of {', '.join(SOURCES)}", seen[3]), (seen[2], "share their name", seen[4])) if n]
    if wrong:
        raise ValueError("; ".join(wrong))
    return parts


def resolved(parts: DataFrame, registry: Registry | None = None, loaders: dict | None = None) -> DataFrame:
    """Checked parts with their ``chunks``: the text, what the registry stores, or what the file holds.

    A hash that is not registered is a LookupError. Files are read once each, whatever number of parts name them.
    """
    spark = parts.sparkSession
    kept = ["bundle_id", "part_id", "part_index"]
    out = parts.where("text is not null").select(*kept, F.array("text").alias("chunks"))
    stored = parts.where("content_hash is not null")
    if stored.limit(1).count():
        known = registry.get("documents").select("content_hash", "chunks") if registry and registry.holds("documents") else spark.createDataFrame([], "content_hash string, chunks array<string>")
        lost = stored.join(known.select("content_hash"), "content_hash", "left_anti").agg(F.count(F.lit(1)), F.min("content_hash")).first()
        if lost[0]:
            raise LookupError(f"{lost[0]} parts name documents that are not registered, such as {lost[1]}")
        out = out.unionByName(stored.join(known, "content_hash").select(*kept, "chunks"))
    files = parts.where("file_path is not null")
    if files.limit(1).count():
        named = [r[0] for r in files.select("file_path").distinct().collect()]  # a request's own list of paths
        cut = chunks(load(spark, named, loaders))
        read = cut.groupBy(_plain_path("file_path").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("chunks"))
        met = files.withColumn("path", _plain_path("file_path")).join(read, "path", "left")
        out = out.unionByName(met.select(*kept, F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks")))
    return out


def _plain_path(column: str):
    return F.regexp_replace(F.col(column), "^[a-z]+:/+", "/")


def ingest(registry: Registry, documents: DataFrame, kind: str = "text") -> DataFrame:
    """Register (name, chunks); documents without any text are not registered. Returns their hashes and sizes."""
    rows = register(documents, kind)
    registry.put("documents", rows)
    return rows.drop("chunks")


def ingest_files(spark: SparkSession, registry: Registry, path: str, loaders: dict | None = None, name: str | None = None) -> DataFrame:
    """Load the files under ``path``, split them, and register each under its file name, or ``name``."""
    cut = chunks(load(spark, path, loaders))
    each = cut.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("chunks"))
    named = F.lit(name) if name else F.element_at(F.split("file_path", "/"), -1)
    return ingest(registry, each.select(named.alias("name"), "chunks"), "file")


@dataclass
class Prepared:
    """An analysis of a request, with the bodies that map prepared places to original ones. Parts are named by bundle and id."""

    analysis: Analysis
    bodies: DataFrame
    bundles: DataFrame


def prepared(parts: DataFrame, entries: DataFrame | None = None, flatten: bool = True, **channels) -> Prepared:
    """Analyse resolved parts (with ``chunks``): tables are made prose where ``flatten`` says so."""
    named = parts.withColumn("name", F.to_json(F.struct("bundle_id", "part_id")))
    held = written(named.select("bundle_id", "part_id", "part_index", F.col("name"), body(F.col("chunks"), flatten).alias("b")), "bodies")
    bodies = held.select(F.col("name").alias("part_id"), "b.text", "b.original_text", "b.offset_map")
    found = analyze(bodies.select("part_id", "text"), entries, **channels)
    return Prepared(found, bodies, held.select("bundle_id", F.col("part_id").alias("id"), F.col("name").alias("part_id"), "part_index"))


def _original(chosen: DataFrame, bodies: DataFrame) -> DataFrame:
    """Spans at their places in the original text, with the surface that stands there."""
    moved = R.in_original(chosen, bodies).join(bodies.select("part_id", "original_text"), "part_id")
    return moved.withColumn("surface", F.expr("substring(original_text, start + 1, end - start)")).select(*chosen.columns)


def _answer(request: Prepared, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    mapping = written(R.numbered(_original(chosen, request.bodies), C.term_table(request.analysis.keys)), "mapping")
    texts = request.bodies.select("part_id", F.col("original_text").alias("text")).join(request.bundles, "part_id")
    masked = R.apply_mapping(texts, mapping)
    where = lambda x: F.struct(F.get_json_object(x["part_id"], "$.part_id").alias("part_id"), x["start"].alias("start"), x["end"].alias("end"))
    return masked.select("bundle_id", F.col("id").alias("part_id"), "masked_text"), mapping.withColumn("occurrences", F.transform("occurrences", where))


def mask_request(parts: DataFrame, entries: DataFrame | None = None, registry: Registry | None = None, level: str = "strong", flatten: bool = True, return_pending: bool = True, models: tuple[str, ...] = (), version: str = "", loaders: dict | None = None, **channels) -> dict[str, DataFrame]:
    """Mask bundles of a request: masked_parts, mapping, pending (empty where it is not asked for), detector.

    Nothing is confirmed by a reviewer: strong entities are masked wherever they occur, weaker ones are pending.
    """
    S.levels_at_or_above(level)  # an unknown level is an error before any work
    held = prepared(resolved(checked(parts), registry, loaders), entries, flatten, **channels)
    found = held.analysis
    chosen = written(selected(found, held.bundles.select("bundle_id", "part_id", "part_index"), level), "chosen")
    more = written(R.expanded(chosen, found.tokens, found.parts, C.term_table(found.keys)), "expanded").join(held.bundles, "part_id")
    order = F.struct("part_index", F.lit(1).alias("late"), F.lit(0).alias("ordinal"), F.col("start"), F.col("end"))
    chosen = chosen.unionByName(more.select("bundle_id", "part_id", order.alias("ordinal"), "start", "end", "surface", "category", "confidence", "votes"))
    masked, mapping = _answer(held, chosen)
    spark = parts.sparkSession
    detector = spark.createDataFrame([(level, list(models), version, flatten, "unconfirmed")], "mask_level string, models array<string>, detector_version string, flatten boolean, status string")
    pending = _pending(held, level)
    return {"masked_parts": masked, "mapping": mapping, "pending": pending if return_pending else pending.limit(0), "detector": detector}


def _pending(held: Prepared, level: str) -> DataFrame:
    """What a reviewer should see, with original places and the best category of each system."""
    found = held.analysis
    places = found.candidates.select("part_id", F.col("start").alias("s"), F.col("end").alias("e"))
    both = places.join(held.bodies.select("part_id", "offset_map"), "part_id").withColumn("o", back_project(F.col("s"), F.col("e"), F.col("offset_map"))).drop("offset_map")
    groups = K.groups(found.candidates, found.keys).join(held.bundles, "part_id")
    each = groups.select("*", F.explode("members").alias("m")).join(both.withColumnRenamed("part_id", "p"), (F.col("part_id") == F.col("p")) & (F.col("m.start") == F.col("s")) & (F.col("m.end") == F.col("e")))
    again = each.groupBy("bundle_id", "part_id", "id", "part_index", "ordinal", "surface", "category", "confidence", "votes").agg(F.array_sort(F.collect_list("o")).alias("members"))
    out = R.pending(again.withColumn("part_id", F.col("id")).drop("id"), level)
    return out.withColumn("votes", K.system_votes(F.col("votes")))


def analyze_request(parts: DataFrame, entries: DataFrame | None = None, registry: Registry | None = None, level: str = "strong", flatten: bool = True, loaders: dict | None = None, **channels) -> dict[str, DataFrame]:
    """For a reviewer, in the coordinates of the prepared text: groups, auto_selection, text.

    ``groups``: surface, category, confidence, count, votes by channel, occurrences (start, end, confidence) of each entity;
    ``auto_selection``: the spans that ``level`` selects; ``text``: the prepared text.
    """
    levels = S.levels_at_or_above(level)
    held = prepared(resolved(checked(parts), registry, loaders), entries, flatten, **channels)
    found, names = held.analysis, held.bundles.select("bundle_id", "part_id", "id")
    groups = K.groups(found.candidates, found.keys)
    own = found.candidates.select(F.col("part_id").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("confidence").alias("own"))
    members = groups.select("part_id", "ordinal", F.explode("members").alias("m")).join(own, (F.col("part_id") == F.col("p")) & (F.col("m.start") == F.col("s")) & (F.col("m.end") == F.col("e")))
    seen = members.groupBy("part_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("s", "e", "own"))).alias("o"))
    places = F.transform("o", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), S.to_wire(x["own"]).alias("confidence")))
    shown = groups.join(seen, ["part_id", "ordinal"]).join(names, "part_id")
    shown = shown.select("bundle_id", F.col("id").alias("part_id"), "ordinal", "surface", "category", S.to_wire(F.col("confidence")).alias("confidence"), "count", K.vote_map(F.col("votes")).alias("votes"), places.alias("occurrences"))
    chosen = groups.where(F.col("confidence").isin(*levels)).select("part_id", F.explode("members").alias("m")).join(names, "part_id")
    auto = chosen.select("bundle_id", F.col("id").alias("part_id"), "m.start", "m.end").distinct()
    text = held.bodies.join(names, "part_id").select("bundle_id", F.col("id").alias("part_id"), "text")
    return {"groups": shown, "auto_selection": auto, "text": text}


def apply_request(parts: DataFrame, selection: DataFrame, entries: DataFrame | None = None, registry: Registry | None = None, flatten: bool = True, loaders: dict | None = None, **channels) -> dict[str, DataFrame]:
    """Mask exactly the candidates at a reviewer's spans (bundle_id, part_id, start, end, prepared places): masked_parts, mapping."""
    held = prepared(resolved(checked(parts), registry, loaders), entries, flatten, **channels)
    spans = selection.join(held.bundles.select("bundle_id", F.col("id").alias("part_id"), F.col("part_id").alias("name")), ["bundle_id", "part_id"]).select(F.col("name").alias("part_id"), "start", "end").distinct()
    c = held.analysis.candidates.join(spans, ["part_id", "start", "end"], "left_semi").join(held.bundles, "part_id")
    order = F.struct("part_index", F.lit(0).alias("late"), F.lit(0).alias("ordinal"), F.col("start"), F.col("end"))
    masked, mapping = _answer(held, c.select("bundle_id", "part_id", order.alias("ordinal"), "start", "end", "surface", "category", "confidence", "votes"))
    return {"masked_parts": masked, "mapping": mapping}


def unmask_request(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Texts (bundle_id, text) with the placeholders of their bundle's mapping restored."""
    return R.unmasked(texts.withColumnRenamed("text", "masked_text"), mapping)
