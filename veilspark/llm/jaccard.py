"""Operator 8: exact self-join on the Jaccard similarity of word shingles, by universe partition and pigeonhole.

A text's set holds the hashes of its distinct shingles (SHINGLE words, cut at ASCII white space, A-Z lower-cased;
a shorter text is one shingle). Texts of equal sets are one set from then on. Sets are banded by size; a band's
universe of shingles is cut into segments by hash. A set indexes the subset that it has in every segment, and for
some segments also the one-deletion neighbourhood. ``allocate`` chooses how many segments of which kind a band has,
always more than the pigeonhole principle needs (SPARE).

1. Sets that share a signature meet in a bucket. Each is compared with its bucket's least member, then, where a bucket
   still holds several components, with its greatest. Verified links give components, so the pairs of a group of
   copies are never listed.
2. What is left are buckets with sets of different components. Now the sizes of all buckets are known, and each set is
   allocated the segments that it looks up: as many as the pigeonhole principle needs, those with the fewest members of
   their buckets first. A segment whose buckets hold no other component costs nothing. Text that many unlinked documents
   share fills large buckets, and a set that has enough other text looks none of them up.
3. Each set meets the members of the buckets that it looks up. Of two linked sets the larger (by size, then id)
   finds the smaller: their difference is at most a quarter of either, which is less than the weights looked up.

Before exact verification on the shingles, parity sketches discard pairs: every shingle flips one of 512 bits (of
twice its size for a set of more than WIDE_ABOVE), so sketches differ in no more bits than sets do in shingles.

Null or empty texts and texts of white space have the empty set, link with nothing and are their own component.
A null id is never the smallest; a component of null ids alone has a null id. Repeated rows count as documents
with equal sets. Very long texts are hashed in one piece, about 60 bytes of memory a byte of text. An empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.bytescan import U64, Buffer, mix64
from veilspark.llm.common import RID, drop_written, forget, hot_join, keyed, pieces, release, sent, string_bytes, written
from veilspark.llm.components import components
from veilspark.llm.quality import white
from veilspark.llm.toxicity import LOWER

SHINGLE = 5
LEAST = 4  # smaller sets link with equal sets alone: 100 * i >= 80 * u has no other solution
GROWTH = 1.6  # of the size bands; above 1.25, so that linked sets lie in one band or in two that touch
_WEIGH = (np.arange(1, SHINGLE + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending within a text, and the n+1 cuts between texts."""
    flat = LOWER[flat]
    n_texts = len(offsets) - 1
    gap = white(flat)
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[offsets] = True
    first = ~gap & (np.concatenate(([True], gap[:-1])) | edge[:-1]) if len(flat) else gap
    last = ~gap & (np.concatenate((gap[1:], [True])) | edge[1:]) if len(flat) else gap
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.searchsorted(starts, offsets)
    words = Buffer(flat).hash(starts, ends)
    count = np.diff(cuts)
    text = np.repeat(np.arange(n_texts), count)
    total = np.zeros(len(words), dtype=U64)
    for k in range(SHINGLE):  # a word beyond the text's end adds nothing; only short texts keep such sums
        there = np.arange(len(words)) + k < cuts[text + 1]
        shifted = np.zeros(len(words), dtype=U64)
        shifted[: len(words) - k] = words[k:] if k < len(words) else 0
        total += np.where(there, mix64(shifted * _WEIGH[k]), U64(0))
    rank = np.arange(len(words)) - cuts[text]
    kept = (rank <= count[text] - SHINGLE) | ((count[text] < SHINGLE) & (rank == 0))
    short = np.minimum(count[text], SHINGLE).astype(U64)
    hashes, text = mix64(total + short)[kept], text[kept]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(n_texts + 1))


def set_ids(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set; equal sets have equal ids, and the empty set has 0."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(hashes ^ U64(0xC0FFEE)))))
    size = np.diff(cuts)
    return np.where(size > 0, mix64(sums[cuts[1:]] - sums[cuts[:-1]] + size.astype(U64)), U64(0)).view(np.int64)


def band_edges(most: int) -> list[int]:
    """Least sizes of the bands up to the size ``most``, and of the next one."""
    edges = [LEAST]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 2, math.ceil(edges[-1] * GROWTH)))
    return edges


#: Segments of a band, as a multiple of those that the pigeonhole principle needs; the rest is choice.
SPARE = 1.35


class Band:
    """How a band's universe is cut: the first ``deletions`` of ``segments`` also index one-deletion neighbourhoods."""

    def __init__(self, number: int, least: int, most: int, segments: int, deletions: int):
        self.number, self.least, self.most, self.segments, self.deletions = number, least, most, segments, deletions


def allocate(number: int, least: int, most: int, n_sets: int, shared: float = 0.15, row_cost: float = 1.0, pair_cost: float = 0.02) -> Band:
    """The cheapest cut for ``n_sets`` sets of a band, before any bucket is known.

    A set needs segments of the weights 1 (exact) or 2 (one deletion) up to a quarter of its size plus one. Fewer,
    longer segments make fewer chance meetings but more rows. Rows and chance meetings are both estimated for a
    set of middle size of which the part ``shared`` is text that unrelated sets have too.
    """
    need = most // 4 + 1
    size = (least + most) / 2
    need_here = size / 4 + 1
    best = None
    for part in (0.0, 0.25, 0.5, 0.75, 1.0):
        deletions = math.ceil(SPARE * round(need * part / 2))
        exact = math.ceil(SPARE * max(0, need - 2 * round(need * part / 2)))
        segments = deletions + exact
        spare = 1 if segments < 4 else math.ceil(segments * math.exp(-least / (segments * 1.1)) * 1.5) + 1
        segments += spare
        long = size / segments
        used = min(1.0, need_here / (2 * deletions + exact))
        meets = long * shared * math.exp(-2 * long * (1 - shared))
        rows = n_sets * (exact + deletions * (long + 1))
        pairs = n_sets * n_sets / 2 * used * (exact * meets + deletions * meets * (1 + long) ** 2)
        cost = row_cost * rows + pair_cost * pairs
        if best is None or cost < best[0]:
            best = cost, Band(number, least, most, segments, deletions)
    return best[1]


def _signature(band: Band, segment: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    tag = segment.astype(U64) * U64(0xD6E8FEB86659FD93) + U64((band.number + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    return mix64(total + mix64(tag + count.astype(U64)))


def band_signatures(band: Band, hashes: np.ndarray, cuts: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets ``owners`` in ``band``; of each its owner, its item and the owner's slack.

    A segment of two or more members weighs what its kind does, one of a single member 1, an empty one 0. A set's
    need is one more than the largest difference of a linked set of this band. Its slack is the weight of all its
    segments less its need: so much it may leave out when it looks others up, since a linked set that differs by less
    than the weights looked up differs in one of these segments by less than its weight, and then both have one of its
    signatures. A set whose weights do not suffice has slack -1, takes empty segments too, looks all up, and is looked
    up by larger and smaller sets alike.

    An item tells band, segment, whether the segment weighs 2, and whether the owner's size lies in the band.
    """
    m = band.segments
    size = np.diff(cuts)[owners]
    need = np.minimum(size, band.most) // 4 + 1
    at = np.repeat(np.arange(len(owners)), size)
    pick = np.arange(len(at)) + np.repeat(cuts[owners] - np.concatenate(([0], np.cumsum(size)))[:-1], size)
    h = hashes[pick]
    member = mix64(h ^ U64(0xABCD1234))
    place = at * m + ((h >> U64(17)) % U64(m)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, member = place[order], member[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    begin = np.flatnonzero(new)
    if not len(begin):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    count = np.diff(np.append(begin, len(place)))
    total = np.add.reduceat(member, begin)
    owner, segment = np.divmod(place[begin], m)
    softer = segment < band.deletions
    double = softer & (count >= 2)
    slack = np.bincount(owner, weights=1 + double, minlength=len(owners)).astype(np.int64) - need
    short = slack < 0
    slack = np.where(short, -1, slack).astype(np.int32)
    base = np.int64(band.number) << 34 | (size <= band.most)
    item = base[owner] | segment << 2 | double << 1
    sig, who, what = [_signature(band, segment, total, count)], [owner], [item]
    part = np.repeat(softer & ((count >= 2) | short[owner]), count)
    whole = np.repeat(np.arange(len(begin)), count)[part]
    sig.append(_signature(band, segment[whole], total[whole] - member[part], count[whole] - 1))
    who.append(owner[whole])
    what.append(item[whole])
    for k in np.flatnonzero(short):
        empty = np.setdiff1d(np.arange(m), segment[owner == k])
        sig.append(_signature(band, empty, np.zeros(len(empty), U64), np.zeros(len(empty), np.int64)))
        who.append(np.full(len(empty), k))
        what.append(base[k] | empty << 2)
    who = np.concatenate(who)
    return np.concatenate(sig), owners[who], np.concatenate(what), slack[who]


def signatures(bands: list[Band], hashes: np.ndarray, cuts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets ``chosen`` in their own band and, where a linked set can lie below it, in that one."""
    size = np.diff(cuts)
    out = []
    for band in bands:
        own = chosen[(size[chosen] >= band.least) & (size[chosen] <= band.most)]
        above = chosen[(size[chosen] > band.most) & (4 * size[chosen] <= 5 * band.most)]
        owners = np.concatenate((own, above))
        if len(owners):
            out.append(band_signatures(band, hashes, cuts, owners))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out))


SKETCH = [f"k{i}" for i in range(8)]
WIDE_ABOVE = 256
#: Ids that are broadcast at most, to fetch the texts of sets that meet; beyond it Spark joins by shuffle.
BROADCAST_SETS = 1_000_000


def sketches(hashes: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """For each set the parities of 512 bits, as eight longs."""
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    bit = (mix64(hashes ^ U64(0x51)) % U64(512)).astype(np.int64)
    out = []
    for k in range(8):
        mine = bit >> 6 == k
        words = np.zeros(len(cuts) - 1, dtype=U64)
        np.bitwise_xor.at(words, text[mine], U64(1) << (bit[mine] & 63).astype(U64))
        out.append(words.view(np.int64))
    return out


def wide_sketches(hashes: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    """Parities of as many bits as the next power of two from twice the size on; none for small sets."""
    size = np.diff(cuts)
    bits = np.where(size > WIDE_ABOVE, 1 << np.ceil(np.log2(np.maximum(size, 1) * 2)).astype(np.int64), 0)
    base = np.concatenate(([0], np.cumsum(bits >> 6)))
    words = np.zeros(base[-1], dtype=U64)
    text = np.repeat(np.arange(len(size)), size)
    mine = bits[text] > 0
    bit = mix64(hashes[mine] ^ U64(0x51)).astype(np.int64) & (bits[text[mine]] - 1)
    np.bitwise_xor.at(words, base[text[mine]] + (bit >> 6), U64(1) << (bit & 63).astype(U64))
    return [words[a:b].tobytes() if b > a else None for a, b in zip(base, base[1:])]


def wide_near(x: bytes | None, y: bytes | None, sizes: int) -> bool:
    """Whether two wide sketches leave a link possible; the longer is folded to the length of the shorter."""
    if x is None or y is None:
        return True
    a, b = (np.frombuffer(v, dtype=U64) for v in (x, y))
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= sizes


def document_sets(docs: DataFrame, id_column: str) -> DataFrame:
    """Per row of keyed documents: RID, id, set id, number of shingles and sketch."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        forget()
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, cuts = shingle_hashes(*string_bytes(piece.column(2)))
                columns = [piece.column(0), piece.column(1), pa.array(set_ids(hashes, cuts)), pa.array(np.diff(cuts)), *map(pa.array, sketches(hashes, cuts)), pa.array(wide_sketches(hashes, cuts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[RID, id_column, "s", "n", *SKETCH, "wide"])

    return docs.select(RID, id_column, "text").mapInArrow(run, f"{RID} bigint, `{id_column}` {id_type}, s bigint, n bigint, " + ", ".join(f"{k} bigint" for k in SKETCH) + ", wide binary")


SIGNED = ["sig", "s", "item", "slack"]


def bucket_rows(docs: DataFrame, bands: list[Band]) -> DataFrame:
    """Rows (sig, s, item, slack) of every bucket that holds two sets or more, with the bucket's least set ``least``."""
    names = SIGNED

    def emit(batches):
        forget()
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, cuts = shingle_hashes(*string_bytes(piece.column(0)))
                ids = set_ids(hashes, cuts)
                _, first = np.unique(ids, return_index=True)
                chosen = first[(np.diff(cuts)[first] >= LEAST) & np.array([i not in seen for i in ids[first].tolist()], dtype=bool)]
                if len(seen) < 200_000:  # equal sets are left out early; those that are not do no harm
                    seen.update(ids[chosen].tolist())
                sig, owner, item, slack = signatures(bands, hashes, cuts, chosen)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[owner]), pa.array(item), pa.array(slack)], names=names)

    def meeting(batches):
        """Of rows in order of (sig, s): the distinct ones whose sig has another s. A run may span batches."""
        forget()
        last = None
        least = 0  # member of the bucket that the batch before ended in
        told = True  # whether the last distinct row has been sent or is known to be alone so far
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            sig, s = rows[:2]
            if not len(sig):
                continue
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (s[1:] != s[:-1])
            new[0] = last is None or sig[0] != last[0] or s[0] != last[1]
            rows = [x[new] for x in rows]
            sig = rows[0]
            if not len(sig):
                continue
            first = np.ones(len(sig), dtype=bool)
            first[1:] = sig[1:] != sig[:-1]
            rows.append(rows[1][np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))])
            if last is not None and sig[0] == last[0]:
                rows[4][sig == sig[0]] = least
            least = rows[4][-1]
            before = np.concatenate(([False], sig[1:] == sig[:-1]))
            before[0] = last is not None and sig[0] == last[0]
            after = np.concatenate((sig[1:] == sig[:-1], [False]))
            keep = before | after
            out = [x[keep] for x in rows]
            if before[0] and not told:
                out = [np.insert(x, 0, v) for x, v in zip(out, last)]
            last, told = [x[-1] for x in rows], bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[*names, "least"])

    schema = "sig bigint, s bigint, item bigint, slack int"
    rows = docs.select("text").mapInArrow(emit, schema)
    return rows.repartition("sig").sortWithinPartitions("sig", "s").mapInArrow(meeting, schema + ", least bigint")


def looked_up(rows: DataFrame) -> DataFrame:
    """Rows with ``asks``: whether the row's segment is one that the set has to look up in its band.

    Segments leave by falling cost (members of their buckets, for a unit of weight) while the weight that left is at
    most the slack. A set's rows are as many as its segments, so none of the windows grows with a bucket.
    """
    segment = Window.partitionBy("s", "band", "segment")
    rows = rows.withColumn("weight", F.col("item").bitwiseAND(2) / 2 + 1)
    rows = rows.withColumn("cost", F.sum("members").over(segment) / F.col("weight"))
    rows = rows.withColumn("once", F.when(F.row_number().over(segment.orderBy("sig")) == 1, F.col("weight")).otherwise(0))
    gone = F.sum("once").over(Window.partitionBy("s", "band").orderBy(F.desc("cost"), "segment").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("asks", gone > F.col("slack")).drop("weight", "cost", "once")


#: One in so many signatures is looked up first; the pairs that this finds are left out when the others are.
FIRST = 8
#: Of a set's pairs so many are left out at most (the others are found again, and one pair in the end).
KNOWN = 256


def meeting_pairs(met: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of rows that meet in a bucket which one of them has to look up.

    Long sets that share a passage meet in very many buckets. Nearly all such pairs are found in the first part
    of the buckets, and told to the rows that look up the rest.
    """

    def met_in(x: DataFrame, y: DataFrame, new: Column) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        smaller = F.struct("y.n", "y.s") < F.struct("x.n", "x.s")
        found = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.own") | F.col("y.own")) & (smaller | (F.col("y.slack") < 0)) & _near("x", "y") & new)
        return found.select(F.col("x.s").alias("s"), F.col("y.s").alias("other")).distinct()

    early = F.pmod(F.col("sig"), F.lit(FIRST)) == 0
    first = written(met_in(met.where(early & F.col("asks")), met.where(early), F.lit(True)), "first-pairs")
    known = sent(first.groupBy("s").agg(F.slice(F.collect_list("other"), 1, KNOWN).alias("known")), "known")
    rest = met_in(met.where(~early & F.col("asks")).join(known, "s", "left"), met.where(~early), ~F.coalesce(F.array_contains("x.known", F.col("y.s")), F.lit(False)))
    return first.unionByName(rest).select(F.least("s", "other").alias("a"), F.greatest("s", "other").alias("b")).distinct()


def _near(a: str, b: str) -> Column:
    """Whether sizes and sketches leave a link possible (differences of linked sets are a ninth of both sizes at most)."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in SKETCH), F.lit(0))
    return (9 * bits <= n_a + n_b) & (5 * n_a >= 4 * n_b) & (5 * n_b >= 4 * n_a)


def _wide_filter(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs (a, b) whose wide sketches leave a link possible."""

    def run(batches):
        forget()
        for batch in batches:
            keep = [wide_near(x, y, n) for x, y, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    x, y = (wide.select(F.col("s").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"w_{k}")) for k in "ab")
    held = pairs.join(x, "a").join(y, "b").select("a", "b", "w_a", "w_b", F.col("n_a") + F.col("n_b"))
    return held.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link: 100 * intersection >= 80 * union."""
    spark = pairs.sparkSession
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "meeting-sets")
    few = wanted.count() <= BROADCAST_SETS
    asked = sets.join(F.broadcast(wanted) if few else wanted, "s").groupBy("s").agg(F.min(RID).alias(RID))
    asked = written(asked, "meeting-rows")
    held = docs.select(RID, "text").join(F.broadcast(asked) if few else asked, RID).select("s", "text")

    def shingles(batches):
        forget()
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, cuts = shingle_hashes(*string_bytes(piece.column(1)))
                sets = [hashes[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(set_ids(hashes, cuts)), pa.array(sets, pa.binary())], names=["s", "true_s", "members"])

    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    members = held.mapInArrow(shingles, "s bigint, true_s bigint, members binary")
    members = written(members.where("s = true_s").select("s", "members"), "meeting-shingles")
    left = pairs.join(members.withColumnRenamed("members", "x"), pairs["a"] == members["s"]).select("a", "b", "x")
    full = left.join(members.withColumnRenamed("members", "y"), left["b"] == members["s"]).select("a", "b", "x", "y")
    out = written(full.mapInArrow(test, "a bigint, b bigint"), "links")
    drop_written(wanted, asked, members)
    release(spark)
    return out


def rooted(docs: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Per row of keyed documents: RID, id, set id ``s`` and number of shingles; and (s, root) of the sets with links.

    The root is the set id that stands for the component.
    """
    spark = docs.sparkSession
    sets = written(document_sets(docs, id_column), "sets")
    each = sets.groupBy("s").agg(F.first("n").alias("n"), *[F.first(k).alias(k) for k in [*SKETCH, "wide"]])
    most = sets.agg(F.max("n")).first()[0] or 0
    edges = band_edges(most)
    band = sum((F.when(F.col("n") >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    counts = dict(each.select("s", "n").where(F.col("n") >= LEAST).groupBy(band.alias("band")).count().collect())  # a row for each band
    bands = [allocate(k, edges[k], edges[k + 1] - 1, counts.get(k, 0)) for k in range(len(edges) - 1)]
    buckets = written(bucket_rows(docs, bands), "buckets")
    release(spark)
    wide = written(each.join(buckets.select("s").distinct(), "s", "left_semi"), "meeting")
    each = wide.drop("wide")

    def linked(pairs: DataFrame) -> DataFrame:
        few = written(_wide_filter(pairs, wide), "pairs")
        out = verified(few, docs, sets)
        drop_written(few)
        return out

    def compared(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().alias("p").join(each.alias("x"), F.col("p.a") == F.col("x.s")).join(each.alias("y"), F.col("p.b") == F.col("y.s")).where(_near("x", "y"))
        return linked(near.select("p.a", "p.b"))

    def open_buckets(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """Of ``rows`` those of buckets that hold several components: with the component ``c``, how many members the
        bucket has, and its greatest member ``b`` and that one's component ``d``.

        A bucket of one component stays so, hence ``rows`` may be those that were open before.
        """
        few = F.broadcast(parts) if parts.count() <= BROADCAST_SETS else parts
        placed = rows.select(*SIGNED).join(few, F.col("s") == F.col("node"), "left").select(*SIGNED, F.coalesce("component", "s").alias("c"))
        several = placed.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("members"), F.max(F.struct("s", "c")).alias("x")).where("lo <> hi")
        return placed.join(several.select("sig", "members", F.col("x.s").alias("b"), F.col("x.c").alias("d")), "sig")

    def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
        """Components of the components so far, which are stars already, and further links."""
        return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    parts = components(compared(buckets.where("least <> s").select(F.col("least").alias("a"), F.col("s").alias("b"))))
    still = written(open_buckets(buckets, parts), "open")
    drop_written(buckets)
    release(spark)
    parts = joined(parts, compared(still.where("c <> d").select(F.col("s").alias("a"), "b")))
    again = open_buckets(still, parts).drop("b", "d").join(each, "s").withColumn("band", F.shiftright("item", 34)).withColumn("segment", F.shiftright("item", 2)).withColumn("own", F.col("item").bitwiseAND(1) == 1)
    met = written(looked_up(again).drop("item", "band", "segment", "members", "gone"), "met")
    drop_written(still)
    release(spark)
    parts = joined(parts, linked(meeting_pairs(met)))
    drop_written(wide, met)
    release(spark)
    return sets.select(RID, id_column, "s", "n"), parts.select(F.col("node").alias("s"), F.col("component").alias("root"))


def _stands_for(sets: DataFrame, parts: DataFrame, value: Column) -> DataFrame:
    """Per set of shingles: s, rows (how many documents have it) and ``value``'s minimum over its component."""
    own = sets.where("n > 0").groupBy("s").agg(F.count(F.lit(1)).alias("rows"), F.min(value).alias("least"))
    own = written(own.join(parts, "s", "left").withColumn("root", F.coalesce("root", "s")), "own")
    best = own.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min("least").alias("best"))
    return written(hot_join(own.drop("least"), best, "root"), "stands").select("s", "rows", "best")


def link_components(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, n_shingles, component_id."""
    sets, parts = rooted(keyed(docs, "text", id_column=id_column), id_column)
    found = hot_join(sets, _stands_for(sets, parts, F.col(id_column)), "s")
    component = F.when(F.col("n") > 0, F.col("best")).otherwise(F.col(id_column))
    return found.select(id_column, F.col("n").alias("n_shingles"), component.alias("component_id"))


def distinct_documents(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, that of the least id; rows with the empty set all stay."""
    d = keyed(docs, *[c for c in docs.columns if c != id_column], id_column=id_column)
    sets, parts = rooted(d, id_column)
    first = _stands_for(sets, parts, F.struct(F.col(id_column).isNull().alias("none"), id_column, RID))
    goes = hot_join(sets.where("n > 0"), first, "s").where(F.col(RID) != F.col(f"best.{RID}")).select(RID)
    return d.join(sent(goes, "copies"), RID, "left_anti").select(*docs.columns)


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = s.doc_id
"""
