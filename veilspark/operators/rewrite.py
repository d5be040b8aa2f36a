"""From a selection to masked text and back: numbering, rewriting, expansion, pending entities, unmasking."""

from __future__ import annotations

import bisect
import html
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import scalars as S
from veilspark.functions.prepare import back_project
from veilspark.operators.channels import own_term_runs, with_terms



def numbered(selected: DataFrame, terms: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Mapping of a bundle's selected spans to placeholders.

    ``selected``: bundle_id, part_id, ordinal (order of selection in the bundle), start, end, surface, category,
    confidence, votes. One placeholder for each exact surface, or for each canonical term that ``terms`` (key, cs,
    canonical, mask) gives a mask; numbers run by category in order of first appearance, fixed masks take none.
    With ``known``, the mapping so far of bundles that go on, what it names keeps its placeholder and numbers go on.
    """
    c = with_terms(selected, terms)
    key = F.when(F.col("mask").isNotNull(), F.concat(F.lit("c:"), S.normalize("canonical"))).otherwise(F.concat(F.lit("s:"), F.col("surface")))
    best = F.struct((-S.confidence_rank(F.col("confidence"))).alias("c"), S.category_rank(F.col("category")).alias("r"), "ordinal", "surface", "category", "confidence")
    member = F.struct("ordinal", "part_id", "start", "end", "surface", "votes")
    g = c.groupBy("bundle_id", key.alias("key")).agg(F.min("ordinal").alias("first"), F.min(best).alias("b"), F.max("mask").alias("mask"), F.max("canonical").alias("canonical"), F.array_sort(F.collect_list(member)).alias("m"))
    g = g.withColumn("category", F.col("b.category"))
    if known is None:
        g = g.withColumn("old", F.lit(None).cast("string")).withColumn("used", F.lit(0))
    else:
        g = g.join(known.groupBy("bundle_id", "key").agg(F.min("placeholder").alias("old")), ["bundle_id", "key"], "left")
        g = g.join(known.groupBy("bundle_id", "category").agg(F.max("number").alias("used")), ["bundle_id", "category"], "left")
    fresh = F.col("mask").isNull() & F.col("old").isNull()
    w = Window.partitionBy("bundle_id", "category", fresh).orderBy("first")
    g = g.withColumn("number", F.when(fresh, F.row_number().over(w) + F.coalesce("used", F.lit(0))))
    named = F.concat(F.lit("["), S.placeholder_prefix(F.col("category")), F.col("number").cast("string"), F.lit("]"))
    votes = F.array_distinct(F.flatten(F.transform("m", lambda x: x["votes"])))
    return g.select(
        "bundle_id",
        F.coalesce("mask", "old", named).alias("placeholder"),
        "category",
        F.array_distinct(F.transform("m", lambda x: x["surface"])).alias("surfaces"),
        F.when(F.col("mask").isNotNull(), F.col("canonical")).otherwise(F.col("b.surface")).alias("canonical"),
        F.col("b.confidence").alias("confidence"),
        S.decided_by(votes).alias("decided_by"),
        F.transform("m", lambda x: F.struct(x["part_id"].alias("part_id"), x["start"].alias("start"), x["end"].alias("end"))).alias("occurrences"),
        "first",
        "key",
        "number",
    )


@F.arrow_udf(T.StringType())
def _rewritten(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, marks in zip(texts.to_pylist(), spans.to_pylist()):
        if text is None or not marks:
            out.append(text)
            continue
        kept, low = [], None
        for x in sorted(marks, key=lambda x: (x["start"], x["end"], x["placeholder"]), reverse=True):
            if low is None or x["end"] <= low:
                kept.append(x)
                low = x["start"]
        pieces, at = [], 0
        for x in reversed(kept):
            pieces += [text[at : x["start"]], x["placeholder"]]
            at = x["end"]
        out.append("".join(pieces) + text[at:])
    return pa.array(out, pa.string())


def rewrite(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced; of overlapping spans the later start stays, the longer of equal starts."""
    return _rewritten(text, spans)


def apply_mapping(parts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Masked texts of all parts (bundle_id, part_id, text): columns of ``parts`` and masked_text."""
    spans = mapping.select("bundle_id", "placeholder", F.explode("occurrences").alias("o"))
    spans = spans.groupBy("bundle_id", F.col("o.part_id").alias("part_id")).agg(F.collect_list(F.struct("o.start", "o.end", "placeholder")).alias("spans"))
    masked = F.when(F.col("spans").isNull(), F.col("text")).otherwise(rewrite(F.col("text"), F.col("spans")))
    return parts.join(spans, ["bundle_id", "part_id"], "left").withColumn("masked_text", masked).drop("spans")


@F.arrow_udf(T.StringType())
def _restored(texts: pa.Array, entries: pa.Array) -> pa.Array:
    out = []
    for text, known in zip(texts.to_pylist(), entries.to_pylist()):
        held = {}
        for e in known or ():
            value = e["canonical"] if e["canonical"] is not None else next(iter(e["surfaces"] or ()), None)
            if e["placeholder"] and value is not None:
                held[e["placeholder"]] = value
        there = sorted((p for p in held if p in text), key=lambda p: (-len(p), p)) if text else ()
        for p in there:
            text = text.replace(p, held[p])
        out.append(text)
    return pa.array(out, pa.string())


def unmask(text: Column, entries: Column) -> Column:
    """Placeholders replaced by canonical surfaces, longest placeholder first; unknown ones stay.

    ``entries``: array of (placeholder, canonical, surfaces).
    """
    return _restored(text, entries)


def unmasked(masked: DataFrame, mapping: DataFrame) -> DataFrame:
    entries = mapping.groupBy("bundle_id").agg(F.collect_list(F.struct("placeholder", "canonical", "surfaces")).alias("entries"))
    restored = F.when(F.col("entries").isNull(), F.col("masked_text")).otherwise(unmask(F.col("masked_text"), F.col("entries")))
    return masked.join(entries, "bundle_id", "left").withColumn("restored", restored).drop("entries")


def expanded(selected: DataFrame, source: DataFrame, parts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Further occurrences of selected surfaces as token runs in the same part, where they meet no selected span.

    Surfaces that are case-sensitive ``terms`` spread with their case, all others without. The best confidence, then
    the best category, of a surface's spans names the category.
    """
    s = with_terms(selected, terms).withColumn("key", F.when(F.col("cs"), S.normalize_case_kept("surface")).otherwise(S.normalize("surface")))
    best = F.struct((-S.confidence_rank(F.col("confidence"))).alias("c"), S.category_rank(F.col("category")).alias("r"), "start", "end", "category")
    want = s.where("key <> ''").groupBy("part_id", "key", "cs").agg(F.min(best)["category"].alias("category"))
    hits = own_term_runs(source, want.select("part_id", "key", "cs", F.lit("").alias("canonical"), "category"), guard=False)
    taken = selected.groupBy("part_id").agg(F.collect_set(F.struct("start", "end")).alias("taken"))
    h = hits.groupBy("part_id").agg(F.collect_list(F.struct("start", "end", "category")).alias("h")).join(taken, "part_id").join(parts.select("part_id", "text"), "part_id")
    free = h.select("part_id", F.explode(_free(F.col("text"), F.col("h"), F.col("taken"))).alias("x"))
    votes = F.array(F.struct(F.lit("collected").alias("channel"), F.lit("展開").alias("label")))
    return free.select("part_id", "x.start", "x.end", "x.surface", "x.category", F.lit("確定").alias("confidence"), votes.alias("votes"))


_FREE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surface", T.StringType()), T.StructField("category", T.StringType())]))


@F.arrow_udf(_FREE)
def _free(texts: pa.Array, hits: pa.Array, taken: pa.Array) -> pa.Array:
    """The hits of each part that meet no taken span, with their text."""
    out = []
    for text, found, spans in zip(texts.to_pylist(), hits.to_pylist(), taken.to_pylist()):
        spans = sorted((x["start"], x["end"]) for x in spans)
        reach = list(itertools.accumulate((e for _, e in spans), max))  # the furthest end of the spans up to each
        kept = []
        for x in found:
            k = bisect.bisect_left(spans, (x["end"],))  # spans that begin before the hit ends
            if not k or reach[k - 1] <= x["start"]:
                kept.append({"start": x["start"], "end": x["end"], "surface": text[x["start"] : x["end"]], "category": x["category"]})
        out.append(kept)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("category", pa.string())]))
    return pa.array(out, kind)


def in_original(candidates: DataFrame, bodies: DataFrame) -> DataFrame:
    """Spans moved from prepared to original coordinates; those of inserted characters alone go."""
    c = candidates.join(bodies.select("part_id", "offset_map"), "part_id")
    c = c.withColumn("_o", back_project(F.col("start"), F.col("end"), F.col("offset_map"))).where("_o is not null")
    return c.withColumn("start", F.col("_o.start")).withColumn("end", F.col("_o.end")).select(*candidates.columns)


def pending(groups: DataFrame, level: str = "strong") -> DataFrame:
    """Entities below the mask level that a reviewer should see, merged over the parts of a bundle.

    ``groups``: bundle_id, part_index, part_id and the columns of entity groups. The first part's category,
    confidence and votes stay; occurrences are appended.
    """
    out = set(S.levels_at_or_above("faint")) - set(S.levels_at_or_above(level)) - {"微弱"}
    g = groups.where(F.col("confidence").isin(*sorted(out)) if out else F.lit(False)).withColumn("k", S.normalize("surface"))
    row = F.struct("part_index", "ordinal", "part_id", "surface", "category", "confidence", "votes", "members")
    m = g.groupBy("bundle_id", "k").agg(F.array_sort(F.collect_list(row)).alias("m"))
    first = F.get("m", F.lit(0))
    occurrences = F.flatten(F.transform("m", lambda x: F.transform(x["members"], lambda s: F.struct(x["part_id"].alias("part_id"), s["start"].alias("start"), s["end"].alias("end")))))
    return m.select("bundle_id", first["surface"].alias("surface"), first["category"].alias("category"), S.to_wire(first["confidence"]).alias("confidence"), first["votes"].alias("votes"), occurrences.alias("occurrences"))


@F.arrow_udf(T.StringType())
def _marked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, marks in zip(texts.to_pylist(), spans.to_pylist()):
        if text is None or marks is None:
            out.append(None)
            continue
        pieces, at = [], 0
        for x in sorted(marks, key=lambda x: (x["start"], x["end"], x["colour"])):
            if x["start"] >= at:
                pieces += [html.escape(text[at : x["start"]]), '<mark style="background:', x["colour"], '">', html.escape(text[x["start"] : x["end"]]), "</mark>"]
                at = x["end"]
        out.append("".join(pieces) + html.escape(text[at:]))
    return pa.array(out, pa.string())


def highlighted(text: Column, spans: Column) -> Column:
    """HTML with marks: spans sorted by start, those that overlap an earlier one dropped, texts escaped.

    ``spans``: array of (start, end, colour).
    """
    return _marked(text, spans)
