"""Maintenance analytics: token summaries, leak reports, vote audits, glossaries, dictionary redundancy, result diffs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.operators.registry import Registry
from veilspark.shared import written


def split_votes(candidates: DataFrame) -> DataFrame:
    """Candidates with their channels per category, and whether votes are split or differ from the decision."""
    v = candidates.select("*", F.explode("votes").alias("v")).withColumn("c", S.vote_category(F.col("v.channel"), F.col("v.label"))).where("c is not null")
    each = v.groupBy("part_id", "start", "end", "surface", "category", "c").agg(F.count_distinct("v.channel").alias("n"))
    top = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), S.category_rank(F.col("c")).alias("r"), "c", "n")))
    g = each.groupBy("part_id", "start", "end", "surface", "category").agg(top.alias("t"))
    line = F.array_join(F.transform("t", lambda x: F.concat(x["c"], F.lit("="), x["n"].cast("string"))), " ")
    return g.select("part_id", "start", "end", "surface", "category", line.alias("tally"), ((F.size("t") > 1) | (F.get("t", F.lit(0))["c"] != F.col("category"))).alias("split"))


def leak_counts(embedded: DataFrame) -> DataFrame:
    """Of tokens that hold a trademark or company name: how many per category."""
    return embedded.where(F.col("category").isin("商標", "社名")).groupBy("category").agg(F.count(F.lit(1)).alias("tokens"))


def leaks(embedded_tokens: DataFrame) -> DataFrame:
    """As ``leak_counts`` but by token and term, of token occurrences (token, canonical, category), most first."""
    out = embedded_tokens.where(F.col("category").isin("商標", "社名")).groupBy("token", "canonical", "category").agg(F.count(F.lit(1)).alias("tokens"))
    return out.orderBy(F.desc("tokens"), "token", "canonical")


def token_summary(tagged: DataFrame) -> DataFrame:
    """One row: tokens, proper nouns, tokens inside entities, and proper nouns that no entity covers.

    ``tagged``: tag, in_entity.
    """
    proper = F.contains("tag", F.lit("固有名詞"))
    return tagged.agg(F.count(F.lit(1)).alias("tokens"), F.count_if(proper).alias("proper_nouns"), F.count_if("in_entity").alias("in_entities"), F.count_if(proper & ~F.col("in_entity")).alias("missed"))


def proper_noun_kinds(tagged: DataFrame) -> DataFrame:
    kind = S.proper_noun_subtype(F.col("tag"))
    return tagged.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("tokens"))


def interesting_tokens(tagged: DataFrame) -> DataFrame:
    """Tokens in entities, proper nouns, or unknown to the tokeniser."""
    return tagged.where(F.col("in_entity") | F.contains("tag", F.lit("固有名詞")) | F.coalesce("oov", F.lit(False)))


def match_abbreviations(candidates: DataFrame, glossary: DataFrame) -> DataFrame:
    """Abbreviations (name) that meet a glossary term by normalised key in another spelling: name, term."""
    a = candidates.select("name").distinct().where(S.is_abbreviation(F.col("name"))).withColumn("key", S.normalize("name"))
    g = glossary.select("term").distinct().withColumn("key", S.normalize("term"))
    return a.join(g, "key").where("name <> term").select("name", "term")


def compare_glossary(entries: DataFrame, glossary: DataFrame) -> DataFrame:
    """Dictionary entries with the glossary term of the canonical, else of the first alias that has one."""
    g = glossary.select(S.normalize("term").alias("gkey"), "term").groupBy("gkey").agg(F.min("term").alias("term"))
    e = entries.select("canonical", "category", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    spelled = e.select("canonical", F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("place", "spelling")).withColumn("gkey", S.normalize("spelling"))
    best = spelled.join(g, "gkey").groupBy("canonical").agg(F.min_by(F.struct("term", "place"), "place").alias("b"))
    how = F.when(F.col("b").isNull(), "none").when(F.col("b.place") == 0, "canonical").otherwise("alias")
    return e.join(best, "canonical", "left").select("canonical", "category", F.col("b.term").alias("term"), how.alias("matched_by"))


def redundancy(entries: DataFrame) -> DataFrame:
    """Dictionary spellings with ``duplicate`` (a key that came before) and ``too_short`` (one-character partial)."""
    key = S.normalize("surface")
    w = Window.partitionBy("key").orderBy("ordinal")
    e = entries.withColumn("key", key).withColumn("duplicate", F.row_number().over(w) > 1)
    return e.withColumn("too_short", F.coalesce("partial", F.lit(False)) & (F.length("key") <= 1))


def result_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(surface, category, confidence) of two runs with change = lost, gained or kept."""
    cols = ["surface", "category", "confidence"]
    a, b = before.select(*cols).distinct(), after.select(*cols).distinct()
    tag = lambda df, what: df.withColumn("change", F.lit(what))
    return tag(a.subtract(b), "lost").unionByName(tag(b.subtract(a), "gained")).unionByName(tag(a.intersect(b), "kept"))


JUDGED = "row int, term string, mask string, confidence string, category string, reason string"
MASK_ORDER, SURE_ORDER = ["要マスク", "要確認", "不要"], ["高", "中", "低"]  # fixed values, in the order of a review


def judged(glossary: DataFrame, judge: Callable[[list[str]], dict[str, tuple[str, str, str, str]]], kept: str | None = None, batch: int = 25) -> DataFrame:
    """Rows of a glossary (row, term) with (mask, confidence, category, reason) from ``judge``, asked for in batches.

    What ``judge`` does not answer is 要確認 of low confidence; so are all rows of a batch that failed. With ``kept``, a
    folder, rows that an earlier run judged are read from there, and what this one judges is added, failed batches excepted,
    so that a later run asks for these again.
    """
    spark, unsure = glossary.sparkSession, ("要確認", "低", "")
    todo, done = glossary.select("row", "term"), None
    if kept and Registry(spark, kept).holds("judged"):
        done = spark.read.schema(JUDGED).parquet(f"{kept}/judged").dropDuplicates(["row"])
        todo = todo.join(done.select("row"), "row", "left_anti")

    def run(batches):
        for block in batches:
            rows, terms = (c.to_pylist() for c in block.columns)
            for k in range(0, len(terms), batch):
                part, out = terms[k : k + batch], []
                try:
                    said = judge(part)
                    out = [(*(said.get(t) or (*unsure, "未判定")), True) for t in part]
                except Exception as e:  # noqa: BLE001  the caller's function may fail in any way; a later run asks again
                    out = [(*unsure, f"バッチ判定に失敗: {e}", False) for _ in part]
                columns = [rows[k : k + batch], part, *zip(*out)]
                types = (pa.int32(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["row", "term", "mask", "confidence", "category", "reason", "answered"])

    new = written(todo.select(F.col("row").cast("int"), "term").mapInArrow(run, JUDGED + ", answered boolean"), "judged")
    if kept:
        new.where("answered").drop("answered").write.mode("append").parquet(f"{kept.rstrip('/')}/judged")
    out = new.drop("answered")
    return out if done is None else out.unionByName(done.join(glossary.select("row"), "row", "left_semi").select(out.columns))


def by_judgement(rows: DataFrame) -> DataFrame:
    """Judged rows as a reviewer reads them: what must be masked first, the surest first; ``certain`` says what is both."""
    place = lambda c, order: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0)), F.lit(9))
    certain = (F.col("mask") == MASK_ORDER[0]) & (F.col("confidence") == SURE_ORDER[0])
    return rows.withColumn("certain", certain).orderBy(place("mask", MASK_ORDER), place("confidence", SURE_ORDER), "row")


def for_review(groups: DataFrame) -> DataFrame:
    """Entities in the order a reviewer reads them: masked first, then by confidence and surface."""
    rank = S.confidence_rank(F.col("confidence"))
    return groups.withColumn("masked", rank >= 3).orderBy(F.desc("masked"), F.desc(rank), "surface")
