"""From votes to candidates: interval clusters, two-system consensus, promotion, demotion, allowlist, groups.

Votes are rows (part_id, seq, start, end, category, channel, label); candidates are rows (part_id, start, end,
surface, category, confidence, votes). Everything is planned around one exchange on part_id.
"""

from __future__ import annotations

import bisect
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark import model as M
from veilspark.functions import scalars as S

VOTES = "array<struct<channel:string,label:string>>"


def _channel_order(channel: Column) -> Column:
    out = F.lit(5)  # models
    for k, v in M.CHANNEL_ORDER.items():
        out = F.when(channel == k, F.lit(v)).otherwise(out)
    return out


def _clustered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Number the groups of overlapping spans; spans that only touch stay apart."""
    order = Window.partitionBy(*by).orderBy("start", "end", "ord", "seq")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") >= F.coalesce(reach, F.lit(-1)), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def clusters(votes: DataFrame) -> DataFrame:
    """Votes with ``cluster``, and ``ord``, the order of their channel."""
    return _clustered(votes.withColumn("ord", _channel_order(F.col("channel"))), ["part_id"], "cluster")


def emitted(clustered: DataFrame) -> DataFrame:
    """Spans (part_id, cluster, e_start, e_end) that clusters stand for.

    A cluster with anchors (dict, session) yields each anchor span and the merged rest that meets no anchor;
    one without yields its whole extent.
    """
    by = ["part_id", "cluster"]
    anchor = F.col("channel").isin(*M.ANCHORS)
    has = F.max(anchor).over(Window.partitionBy(*by))
    rows = clustered.withColumn("anchor", anchor).withColumn("has", has)
    whole = rows.where("not has").groupBy(*by).agg(F.min("start").alias("e_start"), F.max("end").alias("e_end"))
    spans = rows.where("anchor").select(*by, F.col("start").alias("e_start"), F.col("end").alias("e_end")).distinct()
    loose = rows.where("has and not anchor")
    free = loose.alias("m").join(spans.alias("a"), [F.col(f"m.{c}") == F.col(f"a.{c}") for c in by] + [F.col("m.start") < F.col("a.e_end"), F.col("a.e_start") < F.col("m.end")], "left_anti")
    merged = _clustered(free, by, "segment").groupBy(*by, "segment").agg(F.min("start").alias("e_start"), F.max("end").alias("e_end")).drop("segment")
    return whole.unionByName(spans).unionByName(merged).distinct()


def system_category(votes: Column, surface: Column, llm: bool) -> Column:
    """The best category that one system's votes name; NER's special votes are weakened by the surface."""
    mine = F.filter(votes, lambda v: ((v["channel"] == "llm") == F.lit(llm)) & ~v["channel"].isin(*M.DECISIVE))
    category = F.filter(F.transform(mine, lambda v: S.vote_category(v["channel"], v["label"])), lambda c: c.isNotNull())
    if not llm:
        code = S.looks_like_code(surface)
        person = code | S.looks_like_nonperson_latin(surface)
        category = F.transform(category, lambda c: F.when((c == "人名") & person, "その他").when((c == "社名") & code, "その他").otherwise(c))
    return S.category_of_rank(F.array_min(F.transform(category, lambda c: S.category_rank(c))))


def _spans(votes: list[dict]) -> list[tuple[int, int, list[dict]]]:
    """Spans that a part's votes stand for, each with the votes that it meets, all in order of (start, end, ord, seq)."""
    out, at = [], 0
    while at < len(votes):
        to, reach = at + 1, votes[at]["end"]
        while to < len(votes) and votes[to]["start"] < reach:
            reach = max(reach, votes[to]["end"])
            to += 1
        cluster, at = votes[at:to], to
        anchors = sorted({(v["start"], v["end"]) for v in cluster if v["channel"] in M.ANCHORS})
        found = list(anchors)
        if not anchors:
            found = [(cluster[0]["start"], reach)]
        else:
            ends = list(itertools.accumulate((e for _, e in anchors), max))
            rest = None
            for v in cluster:
                k = bisect.bisect_left(anchors, (v["end"],))  # anchors that begin before the vote ends
                if v["channel"] in M.ANCHORS or (k and ends[k - 1] > v["start"]):
                    continue
                if rest and v["start"] < rest[1]:
                    rest = rest[0], max(rest[1], v["end"])
                    continue
                found += [rest] if rest else []
                rest = v["start"], v["end"]
            found += [rest] if rest else []
        starts, ends = [v["start"] for v in cluster], list(itertools.accumulate((v["end"] for v in cluster), max))
        for lo, hi in sorted(set(found)):
            first, last = bisect.bisect_right(ends, lo), bisect.bisect_left(starts, hi)
            met = [v for v in cluster[first:last] if v["end"] > lo]
            if met:
                out.append((lo, hi, met))
    return out


def resolved(votes: DataFrame, parts: DataFrame) -> DataFrame:
    """(part_id, start, end, surface, votes, first): the spans of a part's clusters with the votes that count for each.

    A part's votes are gathered once and settled in one pass; the windows of ``clusters`` and ``emitted`` say the same.
    """
    kind = votes.schema["part_id"].dataType.simpleString()
    row = F.struct("start", "end", _channel_order(F.col("channel")).alias("ord"), "seq", "channel", "label", "category")
    held = votes.groupBy("part_id").agg(F.array_sort(F.collect_list(row)).alias("v")).join(parts.select("part_id", "text"), "part_id")

    def run(batches):
        vote = pa.list_(pa.struct([("channel", pa.string()), ("label", pa.string())]))
        for batch in batches:
            out = []
            for part, mine, text in zip(*(c.to_pylist() for c in batch.columns)):
                for lo, hi, met in _spans(mine):
                    counted = dict.fromkeys((v["channel"], v["label"]) for v in met if v["channel"] not in M.DECISIVE or (lo <= v["start"] and v["end"] <= hi))
                    out.append((part, lo, hi, (text or "")[lo:hi], [{"channel": c, "label": x} for c, x in counted], met[0]["category"]))
            types = (batch.column(0).type, pa.int32(), pa.int32(), pa.string(), vote, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 6, types)], names=["part_id", "start", "end", "surface", "votes", "first"])

    return held.select("part_id", "v", "text").mapInArrow(run, f"part_id {kind}, start int, end int, surface string, votes {VOTES}, first string")


def merged(votes: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates of the clusters of votes: category and confidence by the consensus of the two systems."""
    out = resolved(votes, parts)
    out = out.withColumn("ner", system_category(F.col("votes"), F.col("surface"), False)).withColumn("model", system_category(F.col("votes"), F.col("surface"), True))
    named = F.filter(F.transform(F.filter("votes", lambda v: v["channel"] == "dict"), lambda v: S.vote_category(v["channel"], v["label"])), lambda c: c.isNotNull())
    special = sum((F.when(F.col(c).isNotNull() & ~F.col(c).isin(*M.PLAIN), 1).otherwise(0) for c in ("ner", "model")), F.lit(0))
    silent = F.col("ner").isNull() & F.col("model").isNull()
    best = S.category_of_rank(F.least(S.category_rank(F.col("ner")), S.category_rank(F.col("model"))))
    out = out.withColumn("named", F.get(named, F.lit(0))).withColumn("category", F.coalesce("named", F.when(silent, F.col("first")).otherwise(best)))
    confirmed = ~F.col("category").isin(*M.PLAIN) & F.exists("votes", lambda v: (v["channel"] == "session") & (S.vote_category(v["channel"], v["label"]) == F.col("category")))
    level = F.when(F.col("named").isNotNull(), "確定").when(confirmed, "強").when(silent, "中").when(special >= 2, "強").when(special == 1, "中").otherwise("弱")
    return out.select("part_id", "start", "end", "surface", "category", level.alias("confidence"), "votes")


def promoted_terms(candidates: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(part_id, key, surface, category) of strong candidates worth looking for again in their part; first wins."""
    good = candidates.where((F.col("confidence") == "強") & ~F.col("category").isin(*M.PLAIN) & ~S.has_separator(F.col("surface")))
    rows = good.select("part_id", S.normalize("surface").alias("key"), "surface", "category", F.lit(0).alias("late"), "start", "end")
    if extra is not None:
        rows = rows.unionByName(extra.where(~S.has_separator(F.col("surface"))).select("part_id", S.normalize("surface").alias("key"), "surface", "category", F.lit(1).alias("late"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    w = Window.partitionBy("part_id", "key").orderBy("late", "start", "end")
    return rows.where("key <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("part_id", "key", "surface", "category")


def with_contacts(candidates: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts replace whatever overlaps them."""
    c, k = candidates.alias("c"), contacts.select("part_id", F.col("start").alias("k_start"), F.col("end").alias("k_end")).alias("k")
    kept = c.join(k, [F.col("c.part_id") == F.col("k.part_id"), F.col("c.start") < F.col("k_end"), F.col("k_start") < F.col("c.end")], "left_anti")
    return kept.unionByName(contacts.select(*candidates.columns))


def demoted(candidates: DataFrame) -> DataFrame:
    """Code-like, jargon and plain candidates of middle confidence become faint, identifiers of the model excepted."""
    known = F.exists("votes", lambda v: (v["channel"] == "llm") & v["label"].isin(*M.LLM_IDENTIFIERS))
    s = F.col("surface")
    noise = S.looks_like_code(s) | (S.is_jargon_caps(s) & ~F.col("category").isin("社名", "商標")) | (F.col("category") == "その他")
    return candidates.withColumn("confidence", F.when(F.col("confidence").isin("中", "弱") & ~known & noise, "微弱").otherwise(F.col("confidence")))


def allowed(candidates: DataFrame, entries: DataFrame, toks: DataFrame | None = None) -> DataFrame:
    """Candidates on the allowlist (surface, partial, case_sensitive) become 除外, unless a dictionary names them.

    Partial entries match runs of parts of the surface, or of the tokens that cover it where ``toks`` is given.
    """
    from veilspark.operators.channels import ATOM, BROADCAST_TERMS, term_runs, tokens

    cs = F.coalesce("case_sensitive", F.lit(False))
    tidy = F.trim(F.regexp_replace("surface", r"(?U)\s+", " "))
    keys = entries.select(F.when(cs, S.normalize_case_kept(tidy)).otherwise(S.normalize(tidy)).alias("key"), cs.alias("cs"), F.coalesce("partial", F.lit(False)).alias("partial")).where("key <> ''").distinct()
    small = (lambda d: F.broadcast(d)) if keys.count() <= BROADCAST_TERMS else (lambda d: d)
    c = candidates.withColumn("ci", S.allow_key(F.col("surface"))).withColumn("ck", S.normalize_case_kept(F.trim(F.regexp_replace("surface", r"(?U)\s+", " "))))
    ci = keys.where("not cs").select(F.col("key").alias("ci"), F.lit(True).alias("hit_ci")).distinct()
    ck = keys.where("cs").select(F.col("key").alias("ck"), F.lit(True).alias("hit_ck")).distinct()
    c = c.join(small(ci), "ci", "left").join(small(ck), "ck", "left")
    part = keys.where("partial").select("key", "cs", F.lit("").alias("canonical"), F.lit("").alias("category"))
    if toks is None:
        pieces = candidates.select(F.struct("part_id", "start", "end").alias("part_id"), F.lit(0).alias("i"), F.lit(0).alias("start"), F.length("surface").alias("end"), "surface")
    else:
        toks = tokens(toks) if "text" in toks.columns else toks
        t = toks.select("part_id", "i", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("surface").alias("t_surface"))
        over = candidates.select("part_id", "start", "end").join(t, "part_id").where("t_start < end and start < t_end")
        pieces = over.select(F.struct("part_id", "start", "end").alias("part_id"), "i", F.col("t_start").alias("start"), F.col("t_end").alias("end"), F.col("t_surface").alias("surface"))
    inner = term_runs(pieces, part, False, ATOM).select("part_id.*", F.lit(True).alias("hit_in")).distinct() if part.limit(1).count() else None
    c = c.join(inner, ["part_id", "start", "end"], "left") if inner is not None else c.withColumn("hit_in", F.lit(None).cast("boolean"))
    named = F.exists("votes", lambda v: v["channel"] == "dict")
    hit = F.coalesce("hit_ci", "hit_ck", "hit_in", F.lit(False))
    return c.withColumn("confidence", F.when(hit & ~named, "除外").otherwise(F.col("confidence"))).select(*candidates.columns)


def tally(candidates: DataFrame) -> DataFrame:
    """Channels that voted for each category of each candidate: (part_id, start, end, category, channels)."""
    v = candidates.select("part_id", "start", "end", F.explode("votes").alias("v"))
    v = v.select("part_id", "start", "end", S.vote_category(F.col("v.channel"), F.col("v.label")).alias("category"), F.col("v.channel").alias("channel"))
    return v.where(F.col("category").isNotNull()).groupBy("part_id", "start", "end", "category").agg(F.count_distinct("channel").alias("channels"))


def groups(candidates: DataFrame, keys: DataFrame | None = None, by: str = "part_id") -> DataFrame:
    """Entities: occurrences of one normalised surface (or canonical term), in order of first appearance.

    The best confidence, then the best category, then the first occurrence represents an entity.
    """
    from veilspark.operators.channels import term_table, with_terms

    c = with_terms(candidates, term_table(keys)).withColumn("name", F.col("canonical")).withColumn("ci", S.normalize("surface"))
    c = c.withColumn("key", F.coalesce(S.normalize("name"), "ci"))
    best = F.struct((-S.confidence_rank(F.col("confidence"))).alias("c"), S.category_rank(F.col("category")).alias("r"), "start", "end", "surface", "category", "confidence", "name")
    member = F.struct("start", "end", "surface", "votes")
    g = c.groupBy(by, "key").agg(F.min(best).alias("b"), F.array_sort(F.collect_list(member)).alias("m"), F.min(F.struct("start", "end")).alias("first"))
    votes = F.array_distinct(F.flatten(F.transform("m", lambda x: x["votes"])))
    spans = F.transform("m", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    out = g.select(by, "key", F.coalesce("b.name", "b.surface").alias("surface"), "b.category", "b.confidence", votes.alias("votes"), spans.alias("members"), F.size("m").alias("count"), "first")
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy("first"))).drop("first")


def system_votes(votes: Column) -> Column:
    """The best category of each of the two systems' votes: a map of ner and llm, without a system that names none."""
    best = lambda mine: S.category_of_rank(F.array_min(F.transform(F.filter(F.transform(F.filter(votes, mine), lambda v: S.vote_category(v["channel"], v["label"])), lambda c: c.isNotNull()), lambda c: S.category_rank(c))))
    ner = best(lambda v: ~v["channel"].isin(*M.DECISIVE, "collected", "llm"))
    llm = best(lambda v: v["channel"] == "llm")
    return F.map_filter(F.map_from_arrays(F.array(F.lit("ner"), F.lit("llm")), F.array(ner, llm)), lambda _, v: v.isNotNull())


def vote_map(votes: Column) -> Column:
    """channel -> its labels, distinct in order, joined."""
    channels = F.array_distinct(F.transform(votes, lambda v: v["channel"]))
    labels = lambda c: F.array_join(F.array_distinct(F.transform(F.filter(votes, lambda v: v["channel"] == c), lambda v: v["label"])), " / ")
    return F.map_from_entries(F.transform(channels, lambda c: F.struct(c, labels(c))))
