"""Operator 4: benchmark decontamination, in DataFrame functions only.

Texts are lower-cased (A-Z only) and cut into words of ASCII letters, digits and all non-ASCII characters. A
window is WINDOW consecutive words of an item; an item of fewer words is one window. The hashes of all windows
form the build side of a broadcast hash join; document words stream past it as window hashes, and each hash
that meets is verified word by word inside the join. A document row whose text is null has no words. One pass
over the documents: each also sends a mark that meets no window, so that rows without hits stay.

Repeated rows are answered each; a null item id counts as the empty string; items that repeat an id are one
item; empty tables give empty results (documents) or no hits (benchmark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import RID, keyed, sent

WINDOW = 8
#: Windows that are broadcast at most (about 300 bytes each); beyond it Spark joins by shuffle.
BROADCAST_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Each distinct window once: ``size``, ``h``, ``window`` (its words) and ``items`` (ids as strings)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    cut = items.select("item", "size", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("size")))).alias("window"))
    return cut.groupBy("size", "window").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("window"))


def _window_hashes(size: int) -> Column:
    """Hashes of all windows of ``size`` words of the array ``w``."""
    starting_at = F.transform("w", lambda _, i: F.xxhash64(F.slice("w", i + 1, size)))
    return F.slice(starting_at, F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(0)))


def scan(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row: RID, id, n_words, ``hits`` (array of word index and size) and ``items`` (sorted ids)."""
    return _scan_keyed(keyed(docs, "text", id_column=id_column), benchmark, id_column, broadcast_windows)


def _scan_keyed(docs: DataFrame, benchmark: DataFrame, id_column: str, broadcast_windows: int) -> DataFrame:
    windows = benchmark_windows(benchmark)
    sizes = {r[0]: r[1] for r in windows.groupBy("size").count().collect()}  # at most WINDOW rows
    build = windows.select(F.col("size").alias("b_size"), F.col("h").alias("b_h"), F.col("window").alias("b_window"), "items")
    lengths = sorted(sizes, reverse=True) or [WINDOW]
    d = docs.select(RID, id_column, words(F.col("text")).alias("w"))
    if sum(sizes.values()) > broadcast_windows:
        return _scan_by_shuffle(d, build, lengths, id_column)
    build = F.broadcast(build)
    n = F.size("w")
    hashes = [_window_hashes(k) for k in lengths]
    seen = d.select(RID, id_column, "w", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), *hashes)).alias("at", "h"))
    size, index, skipped = F.lit(lengths[0]), F.col("at") - 1, F.lit(0)
    for before, k in zip(lengths, lengths[1:]):
        skipped = skipped + F.greatest(n - before + 1, F.lit(0))
        size = F.when(F.col("at") - 1 >= skipped, F.lit(k)).otherwise(size)
        index = F.when(F.col("at") - 1 >= skipped, F.col("at") - 1 - skipped).otherwise(index)
    seen = seen.select(RID, id_column, "w", "at", "h", size.alias("size"), index.alias("index"))
    cut = F.slice(seen["w"], F.greatest(seen["index"] + 1, F.lit(1)), seen["size"])
    # as two bounds it is no join key, so words are cut out for meeting hashes alone
    meets = (seen["h"] == build["b_h"]) & (cut <= build["b_window"]) & (cut >= build["b_window"])
    met = seen.join(build, meets, "left").where(F.col("b_h").isNotNull() | (F.col("at") == 0))
    hit = F.when(F.col("b_h").isNotNull(), F.struct("index", "size"))
    rows = met.select(RID, id_column, F.size("w").alias("n_words"), hit.alias("hit"), "items")
    grouped = rows.groupBy(RID).agg(F.first(id_column).alias(id_column), F.max("n_words").cast("bigint").alias("n_words"), F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return grouped


def _scan_by_shuffle(d: DataFrame, build: DataFrame, lengths: list[int], id_column: str) -> DataFrame:
    """The scan where the windows are too many to send: hashes and places alone are shuffled, words meet theirs afterwards."""
    placed = lambda k: F.transform(_window_hashes(k), lambda h, i: F.struct(h.alias("h"), i.alias("index"), F.lit(k).alias("size")))
    seen = d.select(RID, F.explode(F.concat(*map(placed, lengths))).alias("x")).select(RID, "x.h", "x.index", "x.size")
    met = seen.join(build, (F.col("h") == F.col("b_h")) & (F.col("size") == F.col("b_size")))
    asked = met.groupBy(RID).agg(F.collect_list(F.struct("index", "size", F.col("b_window").alias("window"), "items")).alias("asked"))
    none = F.array().cast(asked.schema["asked"].dataType)
    held = d.join(asked, RID, "left").withColumn("asked", F.coalesce("asked", none))
    true = F.filter("asked", lambda x: F.slice("w", x["index"] + 1, x["size"]) == x["window"])
    hits = F.array_distinct(F.transform(true, lambda x: F.struct(x["index"].alias("index"), x["size"].alias("size"))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(true, lambda x: x["items"]))))
    return held.select(RID, id_column, F.size("w").cast("bigint").alias("n_words"), hits.alias("hits"), items.alias("items"))


def covered(hits: Column) -> Column:
    """Indexes of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["index"], x["index"] + x["size"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", min_items: int = 2, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    s = scan(docs, benchmark, id_column, broadcast_windows)
    return s.select(
        id_column,
        "n_words",
        F.size(covered(F.col("hits"))).cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def without_spans(text: Column, hit_words: Column) -> Column:
    """``text`` without the words at the indexes ``hit_words`` and what stands between two of them."""
    kept = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))
    between = F.split(text, WORD_ANY_CASE, -1)
    pairs = F.zip_with(between, kept, lambda s, w: F.struct(s.alias("s"), w.alias("w")))  # once, not once a word
    gone = lambda i: F.array_contains(hit_words, i)
    parts = F.transform(pairs, lambda x, i: F.concat(F.when(gone(i) & gone(i - 1), F.lit("")).otherwise(x["s"]), F.when(gone(i), F.lit("")).otherwise(F.coalesce(x["w"], F.lit("")))))
    return F.array_join(parts, "")


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", min_items: int = 2) -> DataFrame:
    """``docs`` without the documents that hold windows of ``min_items`` items, and without the hit spans of the rest.

    The columns of ``docs`` stay as they are, but for ``text`` and, where there is one, ``n_chars``.
    """
    columns = docs.columns
    d = keyed(docs, *[c for c in columns if c != id_column], id_column=id_column)
    found = _scan_keyed(d, benchmark, id_column, BROADCAST_WINDOWS)
    found = found.select(F.col(RID), covered(F.col("hits")).alias("_veil_hit"), F.size("items").alias("_veil_items")).where("_veil_items > 0")
    joined = d.join(sent(found, "hits"), RID, "left").where(F.coalesce("_veil_items", F.lit(0)) < min_items)
    text = F.when(F.col("_veil_items").isNull(), F.col("text")).otherwise(without_spans(F.col("text"), F.col("_veil_hit")))
    out = joined.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("_veil_items").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_W} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 8) AS size, array_to_string(w[s : s + least(len(w), 8) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, size, s, array_to_string(w[s : s + size - 1], ' ') AS win
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT r, s, dw.size, item FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT r, s, size FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
