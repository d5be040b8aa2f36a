"""The whole of masking as plans: analyse parts, mask a bundle, list what is pending, restore."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scalars import levels_at_or_above
from veilspark.operators import channels as C
from veilspark.operators import consensus as K
from veilspark.operators import rewrite as R
from veilspark.shared import written


@dataclass
class Analysis:
    """Tables of an analysis. Votes and candidates are computed once and kept in the shared folder.

    ``tokens`` are supplied tokens, or the parts themselves, which the default tokeniser reads where tokens are needed.
    """

    parts: DataFrame
    tokens: DataFrame
    candidates: DataFrame
    keys: DataFrame | None


def analyze(parts: DataFrame, entries: DataFrame | None = None, tokens: DataFrame | None = None, entities: DataFrame | None = None, llm_spans: DataFrame | None = None, allowlist: DataFrame | None = None, extra_terms: DataFrame | None = None) -> Analysis:
    """Candidates of parts (part_id, text) from a dictionary, supplied entities and spans, and contact shapes.

    Case-sensitive terms are met and spread with their case only. Two passes: strong candidates of the first are looked up again in their part, as session votes.
    """
    toks = tokens if tokens is not None else parts.select("part_id", "text")
    keys = written(C.terms(entries), "terms") if entries is not None else None
    votes = []
    if keys is not None:
        votes += [C.term_votes(C.dictionary_hits(toks, keys)), C.term_votes(C.cjk_substring_hits(toks, keys), note="辞書·内包"), C.term_votes(C.partial_hits(toks, keys), note="辞書·部分")]
    if "tag" in toks.columns:
        votes.append(C.pos_votes(toks))
    if entities is not None:
        votes.append(C.ner_votes(entities, parts))
    if llm_spans is not None:
        votes.append(C.llm_votes(llm_spans))
    contacts = C.contacts(parts)
    if not votes:
        return Analysis(parts, toks, K.demoted(contacts) if allowlist is None else K.allowed(contacts, allowlist, toks), keys)
    every = votes[0]
    for v in votes[1:]:
        every = every.unionByName(v)
    every = written(every, "votes")
    first = written(K.merged(every, parts), "candidates")
    promoted = K.promoted_terms(first, extra_terms)
    again = written(session_votes(toks, written(promoted, "promoted")), "votes")
    found = K.merged(every.unionByName(again), parts)
    found = K.demoted(K.with_contacts(found, contacts))
    if allowlist is not None:
        found = K.allowed(written(found, "candidates"), allowlist, toks)
    return Analysis(parts, toks, written(found, "candidates"), keys)


def session_votes(toks: DataFrame, promoted: DataFrame) -> DataFrame:
    """Whole matches of each part's own promoted terms, one pass over a part with its terms."""
    own = promoted.select("part_id", "key", F.lit(False).alias("cs"), F.col("surface").alias("canonical"), "category")
    return C.term_votes(C.own_term_runs(toks, own, guard=True), "session", "確認済")


def selected(analysis: Analysis, bundles: DataFrame, level: str = "strong") -> DataFrame:
    """Members of entities at or above a level, in the bundle's order: by part, then entity, then place."""
    groups = K.groups(analysis.candidates, analysis.keys).where(F.col("confidence").isin(*levels_at_or_above(level)))
    m = groups.join(bundles, "part_id").select("bundle_id", "part_id", "part_index", "ordinal", "category", "confidence", "votes", F.explode("members").alias("m"))
    own = analysis.candidates.select("part_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("surface"), F.col("category").alias("own_category"), F.col("confidence").alias("own_confidence"), F.col("votes").alias("own_votes"))
    m = m.join(own, (m["part_id"] == own["part_id"]) & (F.col("m.start") == own["s"]) & (F.col("m.end") == own["e"])).drop(own["part_id"])
    order = F.struct("part_index", F.lit(0).alias("late"), F.col("ordinal"), F.col("m.start"), F.col("m.end"))
    return m.select("bundle_id", "part_id", order.alias("ordinal"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), "surface", F.col("own_category").alias("category"), F.col("own_confidence").alias("confidence"), F.col("own_votes").alias("votes"))


def mask(analysis: Analysis, bundles: DataFrame, level: str = "strong", expand: bool = True, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked parts, mapping) of bundles (bundle_id, part_id, part_index) under one mapping a bundle.

    ``known`` is the mapping so far of bundles that go on.
    """
    chosen = written(selected(analysis, bundles, level), "chosen")
    if expand:
        more = written(R.expanded(chosen, analysis.tokens, analysis.parts, C.term_table(analysis.keys)), "expanded").join(bundles, "part_id")
        order = F.struct("part_index", F.lit(1).alias("late"), F.lit(0).alias("ordinal"), F.col("start"), F.col("end"))
        chosen = chosen.unionByName(more.select("bundle_id", "part_id", order.alias("ordinal"), "start", "end", "surface", "category", "confidence", "votes"))
    mapping = written(R.numbered(chosen, C.term_table(analysis.keys), known), "mapping")
    parts = analysis.parts.join(bundles.select("bundle_id", "part_id"), "part_id")
    return R.apply_mapping(parts, mapping), mapping


def apply_selection(analysis: Analysis, bundles: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``mask``, for the candidates at a reviewer's spans (part_id, start, end), in text order and not expanded."""
    c = analysis.candidates.join(spans.select("part_id", "start", "end").distinct(), ["part_id", "start", "end"], "left_semi").join(bundles, "part_id")
    order = F.struct("part_index", F.lit(0).alias("late"), F.lit(0).alias("ordinal"), F.col("start"), F.col("end"))
    chosen = c.select("bundle_id", "part_id", order.alias("ordinal"), "start", "end", "surface", "category", "confidence", "votes")
    mapping = written(R.numbered(chosen, C.term_table(analysis.keys)), "mapping")
    return R.apply_mapping(analysis.parts.join(bundles.select("bundle_id", "part_id"), "part_id"), mapping), mapping


def unmask(masked: DataFrame, mapping: DataFrame) -> DataFrame:
    return R.unmasked(masked, mapping)


def pending(analysis: Analysis, bundles: DataFrame, level: str = "strong") -> DataFrame:
    return R.pending(K.groups(analysis.candidates, analysis.keys).join(bundles, "part_id"), level)
