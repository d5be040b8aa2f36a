"""Operator 7: language-model scoring with Brown classes.

A text is its words (cut at ASCII white space, A-Z lower-cased) and one end. All counts are taken over the
training part of the whole corpus, spread over the cluster:

* unigrams: every distinct word (by a 64-bit hash) with its count;
* bigrams of word types: the TYPES_TOP most frequent words are a type each, all others share TYPES_REST pools by a
  hash of their last bytes and length, so that the table is bounded whatever the vocabulary;
* exchange clustering on the driver moves one type at a time to the class that raises the likelihood of the class
  bigrams most, until a pass moves none (or PASSES passes);
* every word beyond the types then moves, all at once in each of ROUNDS rounds, from its pool's class to the class
  that its own counts of classes before and after it favour most, by the same gain. A round holds if the likelihood
  of the class bigrams, counted anew over the whole training part, rises.

A word not seen in training has the class of its pool. The model's probability of a word is P(class | class before) * P(word | class),
both smoothed: transitions with the class unigram, emissions by adding ADD to every known word of the class and
to one unknown word. Texts start in a class of their own; the end is a class of its own with one word.

A vocabulary of up to BROADCAST_WORDS words is sent to all executors as sorted arrays (13 bytes a word). A larger
one is looked up by joins: texts are gathered into chunks, a chunk asks for the counts of its distinct words, and
answers meet the chunk's texts again. Both ways give the same scores.

Null counts as empty (one end). With no training text nothing is known and all scores come from the smoothing.
A very long text is one piece, about 100 bytes of memory a byte. Repeated rows are scored each and count each; other
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.bytescan import U64, Buffer, mix64
from veilspark.llm.common import RID, forget, held_out, keyed, pieces, release, string_bytes, written
from veilspark.llm.quality import white
from veilspark.llm.toxicity import LOWER

FOLDS = 10
CLASSES = 32
TYPES_TOP = 640
TYPES_REST = 256
PASSES = 12
ROUNDS = 1
ADD = 0.1
MIX = 0.9  # weight of the class bigram against the class unigram
CHUNK_BYTES = 24 << 20
BROADCAST_WORDS = 8_000_000
END = -1  # stands for the end among word hashes


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and pools of all words, and the cuts between texts."""
    flat = LOWER[flat]
    gap = white(flat)
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[offsets] = True
    first = ~gap & (np.concatenate(([True], gap[:-1])) | edge[:-1]) if len(flat) else gap
    last = ~gap & (np.concatenate((gap[1:], [True])) | edge[1:]) if len(flat) else gap
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = Buffer(flat).hash(starts, ends).view(np.int64)
    hashes = np.where(hashes == END, 0, hashes)
    tail = flat[ends - 1].astype(U64) << U64(8) | flat[np.maximum(ends - 2, starts)].astype(U64) if len(ends) else np.zeros(0, U64)
    pool = mix64(tail << U64(4) | np.minimum(ends - starts, 15).astype(U64)) % U64(TYPES_REST)
    return hashes, pool.astype(np.int32), np.searchsorted(starts, offsets)


def _pieces_of(batches, column: int, name: str):
    for batch in batches:
        for piece in pieces(batch, name):
            yield piece, word_hashes(*string_bytes(piece.column(column)))


def unigrams(docs: DataFrame) -> DataFrame:
    """(w, pool, n) of the training texts; the end is not among them."""

    def run(batches):
        forget()
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 21):
                w, pool, _ = word_hashes(*string_bytes(piece.column(0)))
                w, at, n = np.unique(w, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(pool[at]), pa.array(n)], names=["w", "pool", "n"])

    part = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "w bigint, pool int, n bigint")
    return part.groupBy("w").agg(F.first("pool").alias("pool"), F.sum("n").alias("n"))


def type_bigrams(docs: DataFrame, top: np.ndarray) -> np.ndarray:
    """Counts of adjacent types in training texts, with a start row and an end column: a bounded square table.

    ``top`` holds the hashes of the words that are types of their own, ascending. Types are 0 to len(top) - 1 for these, then the
    pools, then the border (start before, end after).
    """
    n_types = len(top) + TYPES_REST + 1
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        forget()
        known = shared.value
        table = np.zeros(n_types * n_types, dtype=np.int64)
        for _, (w, pool, cuts) in _pieces_of(batches, 0, "text"):
            kind = types_of(w, pool, known)
            n = np.diff(cuts)
            line = np.full(len(kind) + len(n) + 1, n_types - 1, dtype=np.int64)  # borders between texts are shared
            line[np.arange(len(kind)) + 1 + np.repeat(np.arange(len(n)), n)] = kind
            table += np.bincount(line[:-1] * n_types + line[1:], minlength=n_types * n_types)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], names=["cell", "n"])

    cells = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.toArrow()
    out = np.zeros(n_types * n_types)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(n_types, n_types)


def types_of(w: np.ndarray, pool: np.ndarray, top: np.ndarray) -> np.ndarray:
    if not len(top):
        return pool.astype(np.int64)
    at = np.minimum(np.searchsorted(top, w), len(top) - 1)
    return np.where(top[at] == w, at, len(top) + pool).astype(np.int64)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each type (the last type, the border, keeps the last class for itself).

    Starts from classes dealt out by falling frequency and moves types one by one to the class of the greatest
    likelihood sum of f(N(c, d)) - f(N(c)) - f(N(d)), f(x) = x log x, where all but the types concerned stay.
    """
    n_types = len(bigrams)
    seen = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    of = np.full(n_types, classes, dtype=np.int64)
    inner = np.argsort(-seen[:-1], kind="stable")
    of[inner] = np.arange(n_types - 1) % classes
    n_c = classes + 1
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    hot = np.eye(n_c)[of]
    to_class, from_class = bigrams @ hot, bigrams.T @ hot  # counts of a type followed by, or after, a class
    table = hot.T @ to_class
    for _ in range(passes):
        moved = 0
        for t in inner:
            if not seen[t]:
                continue
            c, self_n = of[t], bigrams[t, t]
            out_row, in_row = to_class[t].copy(), from_class[t].copy()
            out_row[c] -= self_n
            in_row[c] -= self_n
            bare = table.copy()  # without t
            bare[c] -= out_row
            bare[:, c] -= in_row
            bare[c, c] -= self_n
            rows, cols = bare.sum(axis=1), bare.sum(axis=0)
            total_out, total_in = out_row.sum() + self_n, in_row.sum() + self_n
            # what the likelihood gains where t joins class k: its row, its column and their crossing
            gain = (f(bare + out_row) - f(bare)).sum(axis=1) + (f(bare + in_row[:, None]) - f(bare)).sum(axis=0)
            diag = np.diag(bare)
            gain += f(diag + out_row + in_row + self_n) - f(diag + out_row) - f(diag + in_row) + f(diag)
            gain -= f(rows + total_out) - f(rows) + f(cols + total_in) - f(cols)
            k = int(np.argmax(gain[:classes]))
            if k != c and gain[k] > gain[c] + 1e-9:
                moved += 1
                table = bare
                table[k] += out_row
                table[:, k] += in_row
                table[k, k] += self_n
                of[t] = k
                to_class[:, c] -= bigrams[:, t]
                to_class[:, k] += bigrams[:, t]
                from_class[:, c] -= bigrams[t]
                from_class[:, k] += bigrams[t]
        if not moved:
            break
    return of


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, up to what no class changes."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum())


def best_classes(table: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """For each word alone, the class that it joins with the greatest likelihood; its own on ties.

    ``before`` and ``after`` count the classes beside each word without the word itself, ``twice`` the word beside itself.
    """
    f, out, n_c = xlogx, np.empty(len(own), dtype=np.int64), len(table)
    for at in range(0, len(own), 256):
        c, i, o, s = own[at : at + 256], before[at : at + 256], after[at : at + 256], twice[at : at + 256, None]
        k = np.arange(len(c))
        bare = np.repeat(table[None], len(c), axis=0)  # without the word
        bare[k, c] -= o
        bare[k, :, c] -= i
        bare[k, c, c] -= s[:, 0]
        was = f(bare)
        rows, cols, diag = bare.sum(axis=2) + i, bare.sum(axis=1) + o, bare[:, np.arange(n_c), np.arange(n_c)]  # totals with the word beside them
        gain = (f(bare + o[:, None, :]) - was).sum(axis=2) + (f(bare + i[:, :, None]) - was).sum(axis=1)
        gain += f(diag + o + i + s) - f(diag + o) - f(diag + i) + f(diag)
        gain -= f(rows + o.sum(axis=1, keepdims=True) + s) - f(rows) + f(cols + i.sum(axis=1, keepdims=True) + s) - f(cols)
        gain[:, table.sum(axis=0) == 0] = -np.inf  # words that move at once would all meet in an empty class
        best = np.argmax(gain[:, : n_c - 1], axis=1)
        out[at : at + 256] = np.where(gain[k, best] > gain[k, c] + 1e-9, best, c)
    return out


class ClassModel:
    """Transitions and emissions; all that scoring needs besides the counts of a text's own words."""

    def __init__(self, top: np.ndarray, of: np.ndarray, table: np.ndarray, class_words: np.ndarray, tokens: int, distinct: int):
        self.top, self.of, self.tokens, self.distinct = top, of, tokens, distinct
        n_c = CLASSES + 1
        after = table.sum(axis=0)
        uni = (after + 1) / (after.sum() + n_c)
        self.step = np.log10(MIX * (table + uni) / (table.sum(axis=1, keepdims=True) + 1) + (1 - MIX) * uni)
        self.class_tokens, self.class_words = after, class_words  # tokens and distinct words of each class

    def emission(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ADD) / (self.class_tokens[c] + ADD * (self.class_words[c] + 1)))

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ADD) / (self.tokens + ADD * (self.distinct + 1)))

    def score(self, c: np.ndarray, n: np.ndarray, cuts: np.ndarray, ends: int):
        """Per text: tokens, known tokens, base score and model score, given each word's class and training count."""
        many = np.diff(cuts)
        place = np.arange(len(c)) + np.repeat(np.arange(len(many)), many)
        line = np.full(len(c) + len(many), CLASSES, dtype=np.int64)  # every text's words, then its end
        count = np.full(len(line), ends, dtype=np.float64)
        line[place], count[place] = c, n
        before = np.concatenate(([CLASSES], line[:-1]))
        border = cuts + np.arange(len(cuts))
        model = self.step[before, line] + np.where(line == CLASSES, 0.0, self.emission(np.minimum(line, CLASSES), count))
        base = self.base(count)
        add = lambda x: np.add.reduceat(x, border[:-1]) if len(many) else np.zeros(0)
        return many + 1, add((count > 0).astype(np.int64)), add(base), add(model)


def fit(docs: DataFrame, counts: DataFrame, broadcast_words: int = BROADCAST_WORDS, types_top: int = TYPES_TOP, rounds: int = ROUNDS) -> tuple[ClassModel, int, DataFrame]:
    """The model, how many ends were seen, and (w, n, c): each word's count and class. ``counts`` are the written unigrams."""
    n_end = docs.where(~F.col("held_out")).count()
    # the most frequent words; a report of a fixed size, ties by hash
    best = counts.orderBy(F.desc("n"), "w").limit(types_top).select("w").collect()
    top = np.sort(np.array([r[0] for r in best], dtype=np.int64))
    bigrams = type_bigrams(docs, top)
    of = exchange(bigrams)
    hot = np.eye(CLASSES + 1)[of]
    table = hot.T @ bigrams @ hot

    def first(batches):
        for batch in batches:
            w, pool = (batch.column(k).to_numpy() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(of[types_of(w, pool, top)].astype(np.int8))], names=["w", "n", "c"])

    known = written(counts.select("w", "pool", "n").mapInArrow(first, "w bigint, n bigint, c tinyint"), "classes")
    for _ in range(rounds):
        moved = written(known.join(placed(docs, known, top, of, table, broadcast_words), "w", "left").select("w", "n", F.coalesce("k", "c").alias("c")), "classes")
        release(docs.sparkSession)
        then = class_bigrams(docs, moved, top, of, broadcast_words)
        if likelihood(then) <= likelihood(table) + 1e-6:
            break
        known, table = moved, then
    words, tokens = np.zeros(CLASSES + 1), n_end
    for r in known.groupBy("c").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("t")).collect():  # a row for each class
        words[r["c"]], tokens = r["words"], tokens + r["t"]
    return ClassModel(top, of, table, words, tokens, int(words.sum()) + (n_end > 0)), n_end, known


def _line(c: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words with a border before, between and after the texts, and the words' places in it."""
    n = np.diff(cuts)
    line = np.full(len(c) + len(n) + 1, CLASSES, dtype=np.int64)
    place = np.arange(len(c)) + 1 + np.repeat(np.arange(len(n)), n)
    line[place] = c
    return line, place


def class_bigrams(docs: DataFrame, known: DataFrame, top: np.ndarray, of: np.ndarray, broadcast_words: int) -> np.ndarray:
    """Counts of adjacent classes in training texts, a square table of fixed size."""
    n_c = CLASSES + 1

    def run(piece, *found):
        w, pool, cuts = word_hashes(*string_bytes(piece.column("text")))
        line, _ = _line(_classes(w, pool, top, of, *found)[0], cuts)
        table = np.bincount(line[:-1] * n_c + line[1:], minlength=n_c * n_c)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n_c * n_c)), pa.array(table)], names=["cell", "n"])

    cells = spread(docs.where(~F.col("held_out")), known, run, "cell bigint, n bigint", broadcast_words).groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(n_c * n_c)
    for r in cells.collect():  # a row for each cell
        out[r["cell"]] = r["n"]
    return out.reshape(n_c, n_c)


def placed(docs: DataFrame, known: DataFrame, top: np.ndarray, of: np.ndarray, table: np.ndarray, broadcast_words: int) -> DataFrame:
    """(w, k): the words beyond the types that join another class, and which."""
    side = CLASSES + 2  # the classes, the border, and the word itself

    def run(piece, *found):
        w, pool, cuts = word_hashes(*string_bytes(piece.column("text")))
        c = _classes(w, pool, top, of, *found)[0]
        line, place = _line(c, cuts)
        word = np.zeros(len(line), dtype=np.int64)
        word[place] = w
        inner = np.flatnonzero(types_of(w, np.zeros(len(w), np.int32), top) >= len(top)) if len(top) else np.arange(len(w))
        p, w, c = place[inner], w[inner], c[inner]
        beside = [np.where((word[p + d] == w) & (line[p + d] != CLASSES), side - 1, line[p + d]) for d in (-1, 1)]
        context = beside[0] * side + beside[1]
        order = np.lexsort((context, w))
        w, c, context = w[order], c[order], context[order]
        new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (context[1:] != context[:-1])))) if len(w) else order
        n = np.diff(np.append(new, len(w)))
        return pa.RecordBatch.from_arrays([pa.array(w[new]), pa.array(c[new].astype(np.int8)), pa.array(context[new].astype(np.int16)), pa.array(n.astype(np.int32))], names=["w", "c", "context", "n"])

    def settle(w, c, context, n):
        starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        many = np.diff(np.append(starts, len(w)))
        # words of a single context, class and count are alike: one stands for all
        code = (c[starts].astype(np.int64) * side * side + context[starts]) << 31 | n[starts]
        code = np.where(many == 1, code, -1 - np.arange(len(starts)))
        _, one, back = np.unique(code, return_index=True, return_inverse=True)
        chosen = np.empty(len(one), dtype=np.int64)
        for at in range(0, len(one), 4096):
            part = one[at : at + 4096]
            rows = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(many[part])[:-1])), many[part]) + np.arange(many[part].sum())
            row = np.repeat(np.arange(len(part)), many[part])
            seen = [np.zeros((len(part), side)) for _ in "ba"]
            for table_of, beside in zip(seen, divmod(context[rows].astype(np.int64), side)):
                np.add.at(table_of, (row, beside), n[rows])
            chosen[at : at + 4096] = best_classes(table, c[starts[part]].astype(np.int64), seen[0][:, :-1], seen[1][:, :-1], seen[1][:, -1])
        k = chosen[back]
        go = np.flatnonzero(k != c[starts])
        return pa.RecordBatch.from_arrays([pa.array(w[starts][go]), pa.array(k[go].astype(np.int8))], names=["w", "k"])

    def choose(batches):
        forget()
        rest = None
        for batch in batches:
            got = [x.to_numpy() for x in batch.columns]
            got = [np.concatenate(x) for x in zip(rest, got)] if rest else got
            cut = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0  # the last word may go on
            rest = [x[cut:] for x in got]
            if cut:
                yield settle(*(x[:cut] for x in got))
        if rest and len(rest[0]):
            yield settle(*rest)

    seen = spread(docs.where(~F.col("held_out")), known, run, "w bigint, c tinyint, context smallint, n int", broadcast_words)
    return seen.repartition("w").sortWithinPartitions("w").mapInArrow(choose, "w bigint, k tinyint")


def _classes(w: np.ndarray, pool: np.ndarray, top: np.ndarray, of: np.ndarray, w_known: np.ndarray, n_known: np.ndarray, c_known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and training counts of the words ``w``, looked up among ascending ``w_known``; else the pool's class and 0."""
    of_pool = of[len(top) + pool] if len(w) else np.zeros(0, np.int64)
    if not len(w_known):
        return of_pool, np.zeros(len(w))
    each, back = np.unique(w, return_inverse=True)  # in order, so that the lookups stay close to each other
    at = np.minimum(np.searchsorted(w_known, each), len(w_known) - 1)
    hit = w_known[at] == each
    return np.where(hit[back], c_known[at][back], of_pool).astype(np.int64), np.where(hit, n_known[at], 0)[back]


def spread(docs: DataFrame, known: DataFrame, run, schema: str, broadcast_words: int) -> DataFrame:
    """``run(piece, w, n, c)`` over pieces of ``docs``, with what is known of their words, ascending."""
    spark = docs.sparkSession
    kept = [x for x in docs.columns if x != RID]
    if known.count() <= broadcast_words:
        got = known.select("w", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"), "c").toArrow()
        arrays = [got.column(k).to_numpy() for k in range(3)]
        order = np.argsort(arrays[0], kind="stable")
        vocabulary = spark.sparkContext.broadcast([x[order] for x in arrays])
        del got, arrays

        def direct(batches):
            forget()
            for batch in batches:
                for piece in pieces(batch, "text"):
                    yield run(piece, *vocabulary.value)

        return docs.select(*kept).mapInArrow(direct, schema)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64(RID), F.lit(chunks)).cast("int")

    def ask(batches):
        """The distinct words of a chunk's part in this task."""
        forget()
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for k in np.unique(parts):
                part = batch.filter(pa.array(parts == k))
                words = [np.unique(word_hashes(*string_bytes(p.column(1)))[0]) for p in pieces(part, "text")]
                w = np.unique(np.concatenate(words))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), k, np.int32)), pa.array(w)], names=["chunk", "w"])

    def answer(key, texts: pa.Table, known: pa.Table) -> pa.Table:  # noqa: ARG001
        arrays = [known.column(k).to_numpy() for k in ("w", "n", "c")]
        order = np.argsort(arrays[0], kind="stable")
        parts = [run(p, *(x[order] for x in arrays)) for batch in texts.combine_chunks().to_batches() for p in pieces(batch, "text")]
        return pa.Table.from_batches(parts)

    dealt = docs.withColumn("chunk", chunk)
    asked = dealt.select("chunk", "text").mapInArrow(ask, "chunk int, w bigint").distinct()
    told = written(asked.join(known, "w").select("chunk", "w", "n", "c"), "told")
    release(spark)
    return dealt.select("chunk", *kept).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(answer, schema)


def score_corpus(docs: DataFrame, id_column: str = "doc_id", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = keyed(docs, "text", id_column=id_column).withColumn("held_out", held_out(id_column, FOLDS))
    counts = written(unigrams(docs), "unigrams")
    release(spark)
    model, n_end, known = fit(docs, counts, broadcast_words)
    release(spark)
    names = [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    shared = spark.sparkContext.broadcast((model, n_end))

    def scored(piece, *found) -> pa.RecordBatch:
        model, n_end = shared.value
        w, pool, cuts = word_hashes(*string_bytes(piece.column("text")))
        c, n = _classes(w, pool, model.top, model.of, *found)
        n_tokens, seen, base, score = model.score(c, n, cuts, n_end)
        columns = [piece.column(id_column), piece.column("held_out"), *map(pa.array, (n_tokens, seen)), pa.array(np.full(len(base), model.tokens)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return spread(docs, known, scored, schema, broadcast_words)
