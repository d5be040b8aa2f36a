"""Operator 9: removal of repeated byte strings, by merging Burrows-Wheeler transforms of shards.

Every byte inside a string of LENGTH bytes that also starts anywhere else is removed. The work is cut so that
suffixes which can be equal over LENGTH bytes meet, and only these:

1. A text's possible starts are dealt to content-chosen anchors (the least 8-byte hash among the next
   LENGTH - KEY + 1 positions). Starts in a row that have the same anchor form a segment; equal strings have equal
   bytes from the anchor on, KEY at least, so the hash of these is a key under which they meet. Keys of one segment
   are done; they are found by counts that tasks combine before anything is shuffled.
2. A segment with the bytes its strings reach is its stretch. Equal stretches (by a 128-bit hash) are one from then on,
   with a count; one of each is fetched.
3. The stretches of a key go to one task. Its shards (some stretches each) build their transforms: the letters before
   the suffixes, in the suffixes' order, letters being two bytes. Only suffixes that lead back to a start matter, so
   column i is that of the suffixes LENGTH - 2 i bytes behind one. The transforms are merged: the interleave of all
   shards is refined column by column, by a stable distribution on the letters that it brings together. It
   holds shards only; the n-th place of a shard is that shard's n-th suffix, so no suffix is compared or sorted again.
   Blocks of equal prefixes only ever split, and a suffix alone in its block leaves its shard and the interleave. Common prefix lengths follow from those of the step before: two
   neighbours of one letter have two bytes more than the least between the places they came from. Where LENGTH bytes
   are common lie the repeated intervals; a stretch that counts twice is repeated throughout.
4. A key of more than MAX_FAMILY different stretches is split by its next bytes: its starts are dealt by their distance to
   the anchor to ranges of a quarter of the width, in which equal strings have more bytes in common, whose hash is the finer key.
   Ranges of one start have whole strings for keys, so this ends.
5. Each segment whose stretch has repeated intervals gets them at its place.

Texts are UTF-8 bytes, null counts as empty, a text shorter than LENGTH keeps all bytes. Repeated rows are repeats
of each other. A very long text is one piece, about 100 bytes of memory a byte. An empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.bytescan import U64, Buffer, mix64, sliding_argmin
from veilspark.llm.common import RID, drop_written, forget, hot_join, keyed, pieces, release, small_batches, string_bytes, written

LENGTH = 200
KEY = 51
GRAM = 8
MAX_FAMILY = 2_000
#: Suffixes that one merge holds (about 300 bytes each), unless one key has more.
MERGE_STARTS = 1 << 17
SHARD_STRINGS = 512
#: Spans that are broadcast at most, to cut the texts; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts that a task scans, or turns to Python objects, at once.
PIECE = 1 << 18
SPANS = "_veil_spans"


def segments(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, key: int = KEY):
    """Segments of all texts: text, first start in the text, number of starts, distance to the anchor, key, and places.

    ``places`` are the buffer, and first byte and end of the stretch in it.
    """
    none = np.zeros(0, np.int64)
    buf = Buffer(flat)
    if len(flat) < length:
        return none, none, none, none, none.view(U64), (buf, none, none)
    anchor = sliding_argmin(buf.grams(GRAM), length - key + 1)
    ok = np.zeros(len(flat) + 1, dtype=np.int32)
    size = np.diff(offsets)
    able = size >= length
    np.add.at(ok, offsets[:-1][able], 1)
    np.add.at(ok, offsets[1:][able] - length + 1, -1)
    ok = np.cumsum(ok)[: len(anchor)] > 0
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    begin[offsets[:-1][able]] = True
    starts = np.flatnonzero(begin)
    stops = np.flatnonzero(begin | ~ok)
    stops = np.append(stops, len(ok))
    many = stops[np.searchsorted(stops, starts, "right")] - starts
    text = np.searchsorted(offsets, starts, "right") - 1
    return text, starts - offsets[text], many, anchor[starts] - starts, buf.hash(anchor[starts], anchor[starts] + key), (buf, starts, starts + many - 1 + length)


def stretch_ids(places) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each stretch."""
    buf, start, end = places
    return buf.hash(start, end), buf.hash(start, end, 1)


class Shard:
    """The transform of some strings: the letters before their suffixes, a column for each depth, in the suffixes' order.

    The column of depth d is that of the suffixes that lie ``length`` - d bytes behind one of the ``many`` first starts of
    each string, ordered by their first d bytes. Letters are two bytes, but for the last of an odd length.
    """

    def __init__(self, flat: np.ndarray, pairs: np.ndarray, offsets: np.ndarray, many: np.ndarray, length: int):
        self.flat, self.pairs, self.length, self.depth = flat, pairs, length, 0
        self.start = np.repeat(offsets[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)

    def column(self) -> np.ndarray:
        """The letters of this depth; the suffixes go on to those that they begin with these letters, in their order."""
        left = self.length - self.depth
        letter = self.pairs[self.start + (left - 2)] if left > 1 else self.flat[self.start].astype(np.uint16)
        self.start = self.start[np.argsort(letter, kind="stable")]
        self.depth += min(2, left)
        return letter

    def keep(self, these: np.ndarray) -> None:
        """Go on with some suffixes only, told in their order."""
        self.start = self.start[these]


class _Least:
    """Least values between places of an array, any two at once."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.level = np.zeros(n + 1, dtype=np.uint8)  # of each width: the greatest power of two in it
        for k in range(1, n.bit_length()):
            self.level[1 << k :] = k
        self.rows = np.empty((max(1, n.bit_length()), n), dtype=values.dtype)
        self.rows[0] = values
        for k in range(1, len(self.rows)):
            half = 1 << k - 1
            np.minimum(self.rows[k - 1, : n - 2 * half + 1], self.rows[k - 1, half : n - half + 1], out=self.rows[k, : n - 2 * half + 1])

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value of each [lo, hi)."""
        level = self.level[hi - lo].astype(np.int64)
        return np.minimum(self.rows[level, lo], self.rows[level, hi - (1 << level)])


def merge(shards: list[Shard], length: int = LENGTH, drop_unique: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of ``shards`` by refining their interleave to ``length`` bytes.

    Returns starts in order and the common prefix length of each with the one before (0 at the first). With
    ``drop_unique`` a suffix alone in its block leaves, since no string that it begins has an equal.
    """
    sizes = [len(s.start) for s in shards]
    turn = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), sizes)
    fresh = np.zeros(len(turn), dtype=bool)
    fresh[:1] = True
    common = np.zeros(len(turn), dtype=np.int16)  # at the first place of a block: bytes shared with the place before
    for depth in range(0, length, 2):
        n, width = len(turn), min(2, length - depth)
        letter = np.empty(n, dtype=np.uint16)
        letter[np.argsort(turn, kind="stable")] = np.concatenate([s.column() for s in shards])
        block = np.cumsum(fresh, dtype=np.int32) - 1
        heads = common[fresh]
        order = np.argsort(letter, kind="stable")
        turn, letter, block = turn[order], letter[order], block[order]
        other = letter[1:] != letter[:-1]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = other | (block[1:] != block[:-1])
        common = np.zeros(n, dtype=np.int16)
        if width == 2:
            common[1:][other] = (letter[1:][other] >> 8) == (letter[:-1][other] >> 8)
        near = np.flatnonzero(fresh[1:] & ~other) + 1
        if len(near):
            common[near] = width + _Least(heads).between(block[near - 1] + 1, block[near] + 1)
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        if drop_unique and 8 * np.count_nonzero(alone) > n:
            common[~fresh] = length
            stays = ~alone
            told = stays[np.argsort(turn, kind="stable")]
            for s, these in zip(shards, np.split(told, np.cumsum(np.bincount(turn, minlength=len(shards)))[:-1])):
                s.keep(these)
            kept = np.flatnonzero(stays)
            if len(kept):  # what leaves between two places bounds what they share
                common = np.minimum.reduceat(common, np.append(0, kept[:-1] + 1))
                common[0] = 0
            else:
                common = common[:0]
            turn, fresh = turn[stays], fresh[stays]
            if not len(turn):
                break
    common[~fresh] = length
    start = np.empty(len(turn), dtype=np.int64)
    start[np.argsort(turn, kind="stable")] = np.concatenate([s.start for s in shards]) if shards else []
    return start, common


def repeated_starts(strings: list[bytes], many: np.ndarray, length: int = LENGTH, shard_strings: int = SHARD_STRINGS) -> np.ndarray:
    """For the first ``many`` starts of each string, laid end to end: whether the string there has an equal."""
    out = np.zeros(int(many.sum()), dtype=bool)
    if not len(out):
        return out
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    pairs = flat[:-1].astype(np.uint16) << 8 | flat[1:]  # all letters, one at each place
    cuts = range(0, len(strings), shard_strings)
    start, common = merge([Shard(flat, pairs, offsets[k : k + shard_strings + 1], many[k : k + shard_strings], length) for k in cuts], length)
    equal = common >= length  # repeated intervals: places that share all bytes with the one before
    equal[:-1] |= equal[1:].copy()
    hit = start[equal]
    text = np.searchsorted(offsets, hit, "right") - 1
    out[(np.cumsum(many) - many)[text] + hit - offsets[text]] = True
    return out


def _each_piece(batches, column: str):
    for batch in batches:
        yield from pieces(batch, column, PIECE)


def _busy_keys(docs: DataFrame) -> DataFrame:
    """(key, rows): keys of two segments or more, counted within each piece of a task's texts first."""

    def run(batches):
        forget()
        for piece in _each_piece(batches, "text"):
            key, n = np.unique(segments(*string_bytes(piece.column(0)))[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("rows")).where("rows > 1")


def _marks(docs: DataFrame, busy: DataFrame) -> DataFrame:
    """Each segment of a busy key: key, the two hashes of its stretch, RID, first start, number of starts, anchor."""

    def run(batches):
        forget()
        for piece in _each_piece(batches, "text"):
            text, start, many, anchor, key, places = segments(*string_bytes(piece.column(1)))
            one, two = stretch_ids(places)
            rid = piece.column(0).to_numpy()
            columns = [pa.array(x.view(np.int64)) for x in (key, one, two)] + [pa.array(rid[text]), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int16)), pa.array(anchor.astype(np.int16))]
            yield pa.RecordBatch.from_arrays(columns, names=[*STRETCH, RID, "at", "many", "anchor"])

    found = docs.select(RID, "text").mapInArrow(run, f"key bigint, one bigint, two bigint, {RID} bigint, at int, many smallint, anchor smallint")
    return hot_join(found, busy, "key", "inner")


STRETCH = ["key", "one", "two"]


def _stretches(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Each different stretch once: key, its hashes, how often it occurs (``rows``), many, anchor, bytes."""
    each = marks.groupBy(*STRETCH).agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(RID, "at", "many", "anchor")).alias("x"))
    asked = each.groupBy(F.col(f"x.{RID}").alias(RID)).agg(F.collect_list(F.struct(*STRETCH, "rows", "x.many", "x.anchor", "x.at")).alias("asked"))
    asked = written(asked, "asked")

    def run(batches):
        forget()
        names = [*STRETCH, "rows", "many", "anchor"]
        for piece in _each_piece(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for text, wanted in zip(piece.column(0), piece.column(1)):
                raw = text.as_py().encode("utf-8")
                for x in wanted.as_py():
                    for column, name in zip(out, names):
                        column.append(x[name])
                    out[6].append(raw[x["at"] : x["at"] + x["many"] - 1 + LENGTH])
            types = (*[pa.int64()] * 4, pa.int16(), pa.int16(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[*names, "bytes"])

    held = docs.select(RID, "text")
    if asked.count() <= BROADCAST_ROWS:  # texts of which nothing is asked are not shuffled
        held = held.join(F.broadcast(asked.select(RID)), RID, "left_semi")
    return held.join(asked, RID).select("text", "asked").mapInArrow(run, _STRETCH_ROWS)


_STRETCH_ROWS = "key bigint, one bigint, two bigint, rows bigint, many smallint, anchor smallint, bytes binary"
_SPANS = "array<struct<lo:int,hi:int>>"


def _merged(stretches: DataFrame) -> DataFrame:
    """(key, one, two, spans): the byte ranges of each stretch that merges find repeated."""

    def answer(rows):
        many = np.array([r[4] for r in rows], dtype=np.int64)
        hit = repeated_starts([r[6] for r in rows], many)
        first = np.cumsum(many) - many
        hit |= np.repeat(np.array([r[3] for r in rows]) > 1, many)
        gap = np.zeros(len(hit) + 1, dtype=bool)
        gap[first] = True
        lo = np.flatnonzero(hit & (gap[:-1] | ~np.concatenate(([False], hit[:-1]))))
        end = np.flatnonzero(hit & (np.append(gap[1:-1], True) | ~np.concatenate((hit[1:], [False]))))
        of = np.searchsorted(first, lo, "right") - 1
        who, cut = np.unique(of, return_index=True)
        spans = pa.StructArray.from_arrays([pa.array((lo - first[of]).astype(np.int32)), pa.array((end - first[of] + LENGTH).astype(np.int32))], names=["lo", "hi"])
        listed = pa.ListArray.from_arrays(pa.array(np.append(cut, len(of)).astype(np.int32)), spans)
        return pa.RecordBatch.from_arrays([*(pa.array([rows[i][k] for i in who], pa.int64()) for k in range(3)), listed], names=[*STRETCH, "spans"])

    def run(batches):
        forget()
        rows: list = []
        starts = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if starts >= MERGE_STARTS and row[0] != rows[-1][0]:
                    yield answer(rows)
                    rows, starts = [], 0
                rows.append(row)
                starts += row[4]
        if rows:
            yield answer(rows)

    dealt = stretches.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"key bigint, one bigint, two bigint, spans {_SPANS}")


def _finer(stretches: DataFrame, width: int) -> DataFrame:
    """Stretches cut by ranges of ``width`` distances to the anchor, with the parent's key and hashes and their place in it."""

    def run(batches):
        forget()
        for batch in batches:
            flat, offsets = string_bytes(batch.column(6))
            buf = Buffer(flat)
            far = batch.column(5).to_numpy().astype(np.int64)  # distances of the first start, and of the last
            near = far - batch.column(4).to_numpy() + 1
            times = far // width - near // width + 1
            row = np.repeat(np.arange(len(far)), times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + (near // width)[row]
            least, most = np.maximum(part * width, near[row]), np.minimum(part * width + width - 1, far[row])
            place = far[row] - most
            start, end = offsets[row] + place, offsets[row] + far[row] - least + LENGTH
            # bytes that all strings of the whole range have, also where this stretch has some of its distances only
            shared = offsets[row] + far[row] - part * width
            context = mix64(buf.hash(shared, shared - width + 1 + LENGTH) ^ mix64(part.astype(U64) + U64(width << 20)))
            hashes = [pa.array(x.view(np.int64)) for x in (context, *stretch_ids((buf, start, end)))]
            up = batch.take(pa.array(row))
            strings = pa.array([flat[x:y].tobytes() for x, y in zip(start, end)], pa.binary())
            small = [pa.array(x.astype(np.int16)) for x in (most - least + 1, most)]
            yield pa.RecordBatch.from_arrays([*up.columns[:3], pa.array(place.astype(np.int32)), *hashes, up.column(3), *small, strings], names=["up_key", "up_one", "up_two", "place", *STRETCH, "rows", "many", "anchor", "bytes"])

    return stretches.mapInArrow(run, f"up_key bigint, up_one bigint, up_two bigint, place int, {_STRETCH_ROWS}")


def _intervals(stretches: DataFrame, max_family: int, width: int = LENGTH - KEY + 1) -> DataFrame:
    """(key, one, two, spans) of written stretches; keys of too many are split by their next bytes."""
    large = stretches.groupBy("key").count().where(F.col("count") > max_family).select("key") if width > 1 else None
    large = written(large, "large") if large is not None else None
    if large is None or not large.limit(1).count():
        return written(_merged(stretches), "merged")
    few = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    out = written(_merged(stretches.join(few, "key", "left_anti")), "merged")
    width = (width + 3) // 4
    parts = written(_finer(stretches.join(few, "key", "left_semi"), width), "finer")
    each = written(parts.groupBy(*STRETCH).agg(F.sum("rows").alias("rows"), F.min("many").alias("many"), F.min("anchor").alias("anchor"), F.min("bytes").alias("bytes")), "finer-stretches")
    found = _intervals(each, max_family, width)
    back = parts.drop("bytes").join(found, STRETCH).select(F.col("up_key").alias("key"), F.col("up_one").alias("one"), F.col("up_two").alias("two"), F.transform("spans", lambda x: F.struct((x["lo"] + F.col("place")).alias("lo"), (x["hi"] + F.col("place")).alias("hi"))).alias("spans"))
    return out.unionByName(written(back.groupBy(*STRETCH).agg(F.flatten(F.collect_list("spans")).alias("spans")), "finer-merged"))


def _runs(batches):
    """Rows of a key and spans that overlap: the spans' union as runs, which neither overlap nor touch."""
    forget()
    for batch in batches:
        spans = batch.column(1)
        row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        lo, hi = (x.to_numpy().astype(np.int64) for x in spans.flatten().flatten())
        order = np.lexsort((lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        wide = np.int64(1) << 32  # rows are laid far apart, so that no run goes on into the next row
        end = np.maximum.accumulate(row * wide + hi)
        new = np.ones(len(row), dtype=bool)
        new[1:] = row[1:] * wide + lo[1:] > end[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row))[: len(first)] - 1
        runs = pa.StructArray.from_arrays([pa.array(lo[first].astype(np.int32)), pa.array((end[last] - row[last] * wide).astype(np.int32))], names=["lo", "hi"])
        cuts = np.searchsorted(row[first], np.arange(len(spans) + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs)], names=[RID, "spans"])


def repeated_spans(docs: DataFrame, max_family: int = MAX_FAMILY) -> DataFrame:
    """Per keyed text with repeats: RID and ``spans``, the maximal runs [lo, hi) of repeated bytes in order."""
    spark = docs.sparkSession
    with small_batches(spark):
        busy = written(_busy_keys(docs), "busy")
        release(spark)
        marks = written(_marks(docs, busy).drop("rows"), "marks")
        release(spark)
        stretches = written(_stretches(docs, marks), "stretches")
    found = _intervals(stretches, max_family)
    found = written(found.join(stretches.select(*STRETCH, "rows"), STRETCH), "found")
    here = hot_join(marks.select(*STRETCH, RID, "at"), found, STRETCH, "inner", min(BROADCAST_ROWS, 200_000))
    spans = here.select(RID, F.transform("spans", lambda x: F.struct((x["lo"] + F.col("at")).alias("lo"), (x["hi"] + F.col("at")).alias("hi"))).alias("spans"))
    gathered = spans.groupBy(RID).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = written(gathered.mapInArrow(_runs, f"{RID} bigint, spans {_SPANS}"), "spans")
    drop_written(busy, marks, stretches, found)
    release(spark)
    return out


def _cut_text(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``raw`` without the union of ``spans``, and how many runs that union has."""
    kept, at, n = [], 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            kept.append(raw[at:lo])
            n += 1
        end = max(end, hi)
        at = end
    kept.append(raw[at:])
    return b"".join(kept), n


def report(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        forget()
        for batch in _each_piece(batches, "text"):
            out = []
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8")
                kept, n = _cut_text(raw, [(x["lo"], x["hi"]) for x in spans.as_py() or ()])
                out.append((i, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            types = (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_spans(docs, id_column)
    return joined.select(id_column, "text", SPANS).mapInArrow(run, f"`{id_column}` {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated bytes removed from ``text``; of a character cut in two no byte stays.

    All rows and columns stay; ``n_chars``, where there is one, is counted anew for changed texts.
    """
    columns = docs.columns

    def run(batches):
        forget()
        for batch in _each_piece(batches, "text"):
            text, spans = batch.column("text").to_pylist(), batch.column(SPANS).to_pylist()
            new = [t if not x else _cut_text(t.encode("utf-8"), [(s["lo"], s["hi"]) for s in x])[0].decode("utf-8", "ignore") for t, x in zip(text, spans)]
            out = {c: batch.column(c) for c in columns}
            if "n_chars" in out:
                out["n_chars"] = pa.array([n if t == u else len(u) for n, t, u in zip(out["n_chars"].to_pylist(), text, new)], out["n_chars"].type)
            out["text"] = pa.array(new, out["text"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=columns)

    return _with_spans(docs, id_column, *[c for c in columns if c not in (id_column, "text")]).select(*columns, SPANS).mapInArrow(run, docs.schema)


def _with_spans(docs: DataFrame, id_column: str, *others: str) -> DataFrame:
    d = keyed(docs, "text", *others, id_column=id_column)
    spans = repeated_spans(d).withColumnRenamed("spans", SPANS)
    rows = spans.agg(F.sum(F.size(SPANS))).first()[0] or 0
    return d.join(F.broadcast(spans) if rows <= BROADCAST_ROWS else spans, RID, "left")
