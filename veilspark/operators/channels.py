"""Span channels: every one yields votes (part_id, seq, start, end, category, channel, label)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark import model as M
from veilspark.functions.prepare import split_on_separators
from veilspark.functions.scalars import fold, fold_case_kept, normalize, normalize_case_kept, vote_category

#: Script runs: Latin and digits with inner marks, kana, kanji, one other character. White space separates.
TOKEN = re.compile(r"[A-Za-z0-9]+|[぀-ゟ]+|[゠-ヿー]+|[㐀-鿿豈-﫿]+|(?:(?![A-Za-z])[^\W\d_])+|\S")
#: Rows of a term list that are broadcast at most; beyond it Spark joins by shuffle.
BROADCAST_TERMS = 1_000_000


def tokens(parts: DataFrame, keep_spaces: bool = False) -> DataFrame:
    """Default tokeniser: (part_id, i, start, end, surface) by script runs. Morphemes can be supplied instead."""
    pattern = re.compile(TOKEN.pattern + r"|\s+") if keep_spaces else TOKEN
    kind = parts.schema["part_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, order, start, end, surface = [], [], [], [], []
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, m in enumerate(pattern.finditer(text or "")):
                    ids.append(part)
                    order.append(i)
                    start.append(m.start())
                    end.append(m.end())
                    surface.append(m[0])
            arrays = [pa.array(ids, batch.column(0).type), *(pa.array(x, pa.int32()) for x in (order, start, end)), pa.array(surface, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part_id", "i", "start", "end", "surface"])

    return parts.select("part_id", "text").mapInArrow(run, f"part_id {kind}, i int, start int, end int, surface string")


def pattern_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern as array of (start, end, surface), in one pass over each text."""
    compiled = re.compile(pattern)

    @F.arrow_udf("array<struct<start:int,end:int,surface:string>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string())]))
        return pa.array([None if t is None else [{"start": m.start(), "end": m.end(), "surface": m[0]} for m in compiled.finditer(t)] for t in texts.to_pylist()], kind)

    return spans(text)


def contacts(parts: DataFrame) -> DataFrame:
    """Mail addresses as candidates of their own: category 連絡先, confidence 強."""
    hits = parts.where(F.contains("text", F.lit("@"))).select("part_id", F.explode(pattern_spans(F.col("text"), M.EMAIL)).alias("s"))
    votes = F.array(F.struct(F.lit("regex").alias("channel"), F.lit("連絡先").alias("label")))
    return hits.select("part_id", "s.start", "s.end", "s.surface", F.lit("連絡先").alias("category"), F.lit("強").alias("confidence"), votes.alias("votes"))


def terms(entries: DataFrame) -> DataFrame:
    """One row for each spelling of each dictionary entry: key, cs, partial, canonical, category, mask."""
    spelled = entries.select("*", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling"))
    cs, partial = F.coalesce("case_sensitive", F.lit(False)), F.coalesce("partial", F.lit(False))
    keyed = spelled.select(F.when(cs, normalize_case_kept("spelling")).otherwise(normalize("spelling")).alias("key"), cs.alias("cs"), partial.alias("partial"), "canonical", "category", "mask")
    first = Window.partitionBy("key", "cs", "partial").orderBy("canonical")
    return keyed.where(F.col("key") != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


#: Terms that one worker holds as a table of their beginnings; beyond it tokens meet the terms by joins.
HELD_TERMS = 100_000
ATOM = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\x00-\x7F\s]+|\S")
_LATIN = re.compile(r"[A-Za-z0-9_-]")


class _Terms:
    """Terms by key, and all beginnings of keys, so that a run of tokens stops where no term goes on."""

    def __init__(self, rows):
        self.by_key: dict[str, tuple] = {}
        self.cased: dict[str, tuple] = {}
        for key, cs, canonical, category in rows:
            (self.cased if cs else self.by_key).setdefault(key, (canonical, category))
        self.begins, self.cased_begins = ({k[:n] for k in d for n in range(1, len(k) + 1)} for d in (self.by_key, self.cased))

    def runs(self, toks: list[tuple[int, int, str]], folded: dict, guard: bool, literal: bool = False):
        """Hits (i, n, start, end, canonical, category, cs) in order of i, then n."""
        keys, longest = [], 1 if literal else M.MAX_RUN
        for _, _, surface in toks:
            pair = folded.get(surface)
            if pair is None:
                pair = folded[surface] = (surface, surface) if literal else (fold(surface), fold_case_kept(surface))
            keys.append(pair)
        for i, (start, _, _) in enumerate(toks):
            if not keys[i][0]:
                continue
            for cs, table, begins in ((False, self.by_key, self.begins), (True, self.cased, self.cased_begins)):
                run = ""
                for n in range(1, min(longest, len(toks) - i) + 1):
                    run += keys[i + n - 1][cs]
                    if run not in begins:
                        break
                    if run in table:
                        end = toks[i + n - 1][1]
                        if guard and i and toks[i - 1][1] == start and _LATIN.match(keys[i - 1][0][-1:]):
                            continue
                        if guard and i + n < len(toks) and toks[i + n][0] == end and _LATIN.match(keys[i + n][0][:1]):
                            continue
                        yield (i, n, start, end, *table[run], cs)


def _longest(hits) -> list:
    """Leftmost-longest hits without overlap, case-insensitive before case-sensitive at equal length."""
    out, at = [], 0
    for hit in sorted(hits, key=lambda h: (h[0], -h[1], h[6], h[2:6])):
        if hit[0] >= at:
            out.append(hit)
            at = hit[0] + hit[1]
    return out


def _rows_of(source: DataFrame) -> DataFrame:
    """``source`` with one row for each part: texts (part_id, text) as they are, supplied tokens as an array ``toks``."""
    if "text" in source.columns:
        return source.select("part_id", "text")
    return source.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct("i", "start", "end", "surface"))).alias("toks"))


def _toks(value, cut: re.Pattern | None) -> list[tuple[int, int, str]]:
    toks = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(value or "")] if value is None or isinstance(value, str) else [(x["start"], x["end"], x["surface"]) for x in value]
    return toks if cut is None else [(s + m.start(), s + m.end(), m[0]) for s, _, x in toks for m in cut.finditer(x)]


def term_runs(source: DataFrame, keys: DataFrame | None, guard: bool, cut: re.Pattern | None = None, literal: bool = False) -> DataFrame:
    """Term hits on token runs of each part, without overlap: part_id, i, n, start, end, canonical, category, cs.

    ``source`` holds parts (part_id, text), read by the default tokeniser, or tokens. ``keys`` are terms for all parts;
    if None, ``source`` has a column ``terms``, each part's own (key, cs, canonical, category). A part is settled in one
    pass; nothing is shuffled but supplied tokens. ``cut`` splits tokens first. Null texts have no tokens. ``literal``: a token
    is met with the keys alone and as it is written, and so are its neighbours with the guard.
    """
    own = keys is None
    if not own and keys.count() > HELD_TERMS:
        toks = tokens(source) if "text" in source.columns else source
        return greedy(_runs(atoms(toks) if cut else toks, keys, guard, literal))
    shared = None if own else source.sparkSession.sparkContext.broadcast([tuple(r) for r in keys.select("key", "cs", "canonical", "category").orderBy("key", "cs", "canonical").collect()])  # at most HELD_TERMS
    rows = source if own else _rows_of(source)
    kind = rows.schema["part_id"].dataType.simpleString()
    held = next(c for c in ("text", "toks") if c in rows.columns)

    def run(batches):
        every, folded = None if own else _Terms(shared.value), {}
        for batch in batches:
            part_type, out = batch.column(0).type, []
            terms = batch.column(2).to_pylist() if own else [None] * batch.num_rows
            for part, value, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), terms):
                table = every or _Terms((x["key"], x["cs"], x["canonical"], x["category"]) for x in mine or ())
                out += [(part, *h) for h in _longest(table.runs(_toks(value, cut), folded, guard, literal))]
                if len(folded) > 200_000:
                    folded.clear()
            types = (part_type, *[pa.int32()] * 4, pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 8, types)], names=["part_id", "i", "n", "start", "end", "canonical", "category", "cs"])

    schema = f"part_id {kind}, i int, n int, start int, end int, canonical string, category string, cs boolean"
    return rows.select("part_id", held, *(["terms"] if own else [])).mapInArrow(run, schema)


def own_term_runs(source: DataFrame, terms: DataFrame, guard: bool) -> DataFrame:
    """As ``term_runs``, for terms (part_id, key, cs, canonical, category) that count in their own part only."""
    mine = terms.groupBy("part_id").agg(F.sort_array(F.collect_set(F.struct("key", "cs", "canonical", "category"))).alias("terms"))
    return term_runs(_rows_of(source).join(mine, "part_id"), None, guard)


def _runs(toks: DataFrame, keys: DataFrame, guard: bool, literal: bool = False) -> DataFrame:
    """Token runs whose joined keys are terms: part_id, i, n, start, end, canonical, category, cs.

    For term lists too large for a worker. Runs are made by window functions over a part's tokens, none longer in
    tokens or characters than the longest term, and met with the terms by an equi-join.
    """
    limits = keys.agg(F.max(F.length("key")).alias("chars"), F.bool_or("cs").alias("cs")).first()
    longest = limits["chars"] or 0
    w = Window.partitionBy("part_id").orderBy("i")
    folds = (F.col, F.col) if literal else (normalize, normalize_case_kept)
    t = toks.withColumn("ci", folds[0]("surface")).withColumn("ck", folds[1]("surface"))
    ahead = F.collect_list(F.struct("end", "ci", "ck", "start")).over(w.rowsBetween(0, 0 if literal else M.MAX_RUN - 1))
    t = t.select("part_id", "i", "start", F.lag("end").over(w).alias("before_end"), F.lag("ci").over(w).alias("before"), F.collect_list(F.struct("start", "ci")).over(w.rowsBetween(1, M.MAX_RUN)).alias("after"), ahead.alias("run"))
    t = t.where(F.length(F.get("run", F.lit(0))["ci"]) > 0)
    # a run can only be a term if its first token begins one
    starts = keys.select(folds[0]("key").alias("k")).select(F.explode(F.expr("transform(sequence(1, length(k)), i -> substring(k, 1, i))")).alias("begins")).distinct()
    t = t.withColumn("begins", F.get("run", F.lit(0))["ci"]).join(_small(starts), "begins", "left_semi")
    latin = _LATIN.pattern
    cut = t.select("*", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("n"))
    part = F.slice("run", F.lit(1), F.col("n"))
    ci = F.array_join(F.transform(part, lambda x: x["ci"]), "")
    ck = F.array_join(F.transform(part, lambda x: x["ck"]), "")
    cut = cut.select("part_id", "i", "n", "start", "before", "before_end", "after", F.get("run", F.col("n") - 1)["end"].alias("end"), ci.alias("ci"), ck.alias("ck")).where(F.length("ci") <= longest)
    if guard:
        nxt = F.get("after", F.col("n") - 1)
        left = (F.col("before_end") == F.col("start")) & F.substring("before", -1, 1).rlike(latin)
        right = (nxt["start"] == F.col("end")) & F.substring(nxt["ci"], 1, 1).rlike(latin)
        cut = cut.where(~F.coalesce(left, F.lit(False)) & ~F.coalesce(right, F.lit(False)))
    build = _small(keys.select("key", "cs", "canonical", "category"))
    cols = ["part_id", "i", "n", "start", "end", "canonical", "category", "cs"]
    hit = cut.join(build.where("not cs"), cut["ci"] == F.col("key")).select(*cols)
    if limits["cs"]:
        hit = hit.unionByName(cut.join(build.where("cs"), cut["ck"] == F.col("key")).select(*cols))
    return hit


def greedy(hits: DataFrame) -> DataFrame:
    """Leftmost-longest hits without overlap, case-insensitive before case-sensitive at equal length."""
    names = ["i", "n", "start", "end", "canonical", "category", "cs"]
    kind = hits.schema["part_id"].dataType.simpleString()
    grouped = hits.groupBy("part_id").agg(F.collect_list(F.struct(*names)).alias("h"))

    def run(batches):
        for batch in batches:
            out = [(part, *x) for part, h in zip(*(c.to_pylist() for c in batch.columns)) for x in _longest(tuple(y[k] for k in names) for y in h)]
            types = (batch.column(0).type, *[pa.int32()] * 4, pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 8, types)], names=["part_id", *names])

    return grouped.mapInArrow(run, f"part_id {kind}, i int, n int, start int, end int, canonical string, category string, cs boolean")


def dictionary_hits(source: DataFrame, keys: DataFrame, literal: bool = False) -> DataFrame:
    """Whole matches of terms on token runs: not inside a longer Latin identifier. ``source``, ``literal``: as in ``term_runs``."""
    return term_runs(source, keys, guard=True, literal=literal)


def atoms(parts_tokens: DataFrame) -> DataFrame:
    """Tokens cut into identifier parts, runs of other letters, and single marks, for partial matching."""
    cut = parts_tokens.select("part_id", "i", "start", F.posexplode(pattern_spans(F.col("surface"), ATOM.pattern)).alias("k", "s"))
    w = Window.partitionBy("part_id").orderBy("ti", "k")
    cut = cut.select("part_id", F.col("i").alias("ti"), "k", (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"), F.col("s.surface").alias("surface"))
    return cut.select("part_id", (F.row_number().over(w) - 1).alias("i"), "start", "end", "surface")


def partial_hits(source: DataFrame, keys: DataFrame) -> DataFrame:
    """Matches of partial terms on runs of atoms, without the guard."""
    return term_runs(source, keys.where("partial"), guard=False, cut=ATOM)


def cjk_substring_hits(source: DataFrame, keys: DataFrame) -> DataFrame:
    """Terms of two or more CJK characters inside one token but not all of it; overlapping hits all count.

    Tokens are normalised character by character, each kept with its place, so half-width letters that change the
    length are found where they stand. Case-sensitive terms are met with their case. Terms beyond HELD_TERMS are met by
    a join on the token's substrings of their lengths.
    """
    cjk = keys.where(F.length("key") >= 2).where(F.col("key").rlike("^[぀-ヿ㐀-鿿豈-﫿]+$")).select("key", "cs", "canonical", "category")
    kind = source.schema["part_id"].dataType.simpleString()
    n_terms = cjk.count()
    held = n_terms <= HELD_TERMS
    sizes = sorted(r[0] for r in cjk.select(F.length("key")).distinct().collect())  # lengths of terms, few
    shared = source.sparkSession.sparkContext.broadcast({(r[1], r[0]): (r[2], r[3]) for r in cjk.orderBy(F.desc("canonical")).collect()} if held else {})

    def run(batches):
        terms, plain = shared.value, re.compile(r"[\x00-\x7f]*")
        for batch in batches:
            out = []
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start, _, surface in _toks(value, None):
                    if not n_terms or plain.fullmatch(surface):
                        continue
                    for cs, by in ((False, fold), (True, fold_case_kept)):
                        chars = [(c, i) for i, ch in enumerate(surface) for c in by(ch)]
                        whole = "".join(c for c, _ in chars)
                        for n in sizes:
                            for k in range(len(whole) - n + 1) if len(whole) > n else ():
                                if not held or (cs, whole[k : k + n]) in terms:
                                    out.append((part, start + chars[k][1], start + chars[k + n - 1][1] + 1, whole[k : k + n], cs, *terms.get((cs, whole[k : k + n]), (None, None))))
            types = (batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 7, types)], names=["part_id", "start", "end", "key", "cs", "canonical", "category"])

    rows = _rows_of(source)
    found = rows.select(*rows.columns[:2]).mapInArrow(run, f"part_id {kind}, start int, end int, key string, cs boolean, canonical string, category string")
    found = found if held else found.drop("canonical", "category").join(cjk, ["key", "cs"])
    return found.select("part_id", "start", "end", "canonical", "category")


def term_table(keys: DataFrame | None) -> DataFrame | None:
    """The terms (key, cs, canonical, mask) by which surfaces find their entry, one for each key."""
    return None if keys is None else keys.groupBy("key", "cs").agg(F.min(F.struct("canonical", "mask")).alias("x")).select("key", "cs", "x.canonical", "x.mask")


def with_terms(spans: DataFrame, terms: DataFrame | None) -> DataFrame:
    """``spans`` with ``cs`` (whether the surface is a case-sensitive term), and the ``canonical`` and ``mask`` of its term.

    A surface that is a case-sensitive term is that term; else it is looked up without case.
    """
    if terms is None:
        none = F.lit(None).cast("string")
        return spans.withColumn("cs", F.lit(False)).withColumn("canonical", none).withColumn("mask", none)
    kept = terms.where("cs").select(F.col("key").alias("_ck"), F.struct("canonical", "mask").alias("_kept"))
    plain = terms.where("not cs").select(F.col("key").alias("_ci"), F.struct("canonical", "mask").alias("_plain"))
    s = spans.withColumn("_ck", normalize_case_kept("surface")).withColumn("_ci", normalize("surface"))
    s = s.join(_small(kept), "_ck", "left").join(_small(plain), "_ci", "left").withColumn("_t", F.coalesce("_kept", "_plain"))
    return s.withColumn("cs", F.col("_kept").isNotNull()).withColumn("canonical", F.col("_t.canonical")).withColumn("mask", F.col("_t.mask")).drop("_ck", "_ci", "_kept", "_plain", "_t")


def embedded_audit(source: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct tokens that hold a term of two or more characters without being one: token, canonical, category.

    ``source``: as in ``term_runs``. Up to HELD_TERMS terms are held by each worker, which tells a token's terms once; more
    are met by a join on the tokens' substrings of the terms' lengths.
    """
    k = keys.where("not cs").where(F.length("key") >= 2).select("key", "canonical", "category").dropDuplicates(["key"])
    if k.count() > HELD_TERMS:
        return _embedded_by_join(tokens(source) if "text" in source.columns else source, k)
    shared = source.sparkSession.sparkContext.broadcast({r[0]: (r[1], r[2]) for r in k.collect()})  # at most HELD_TERMS

    def run(batches):
        terms, told = shared.value, {}
        sizes = sorted({len(x) for x in terms})
        for batch in batches:
            out = set()
            for value in batch.column(0).to_pylist():
                for _, _, surface in _toks(value, None):
                    held = told.get(surface)
                    if held is None:
                        c = fold(surface)
                        held = () if c in terms else tuple({terms[c[i : i + n]] for n in sizes if n < len(c) for i in range(len(c) - n + 1) if c[i : i + n] in terms})
                        if len(told) > 200_000:
                            told.clear()
                        told[surface] = held
                    out.update((surface, *x) for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 3)], names=["token", "canonical", "category"])

    rows = _rows_of(source)
    return rows.select(rows.columns[1]).mapInArrow(run, "token string, canonical string, category string").distinct()


def _embedded_by_join(toks: DataFrame, k: DataFrame) -> DataFrame:
    t = toks.select(F.col("surface").alias("token")).distinct().withColumn("ci", normalize("token"))
    whole = t.join(k.select("key"), t["ci"] == k["key"], "left_anti")
    sizes = [r[0] for r in k.select(F.length("key")).distinct().collect()]  # lengths of terms, few
    grams = None
    for n in sizes:
        g = whole.where(F.length("ci") > n).select("token", F.explode(F.expr(f"transform(sequence(1, length(ci) - {n} + 1), i -> substring(ci, i, {n}))")).alias("key"))
        grams = g if grams is None else grams.unionByName(g)
    return grams.join(_small(k), "key").select("token", "canonical", "category").distinct()


def term_votes(hits: DataFrame, channel: str = "dict", note: str = "辞書") -> DataFrame:
    return hits.select("part_id", F.lit(0).alias("seq"), "start", "end", "category", F.lit(channel).alias("channel"), F.concat("category", F.lit(f"({note})")).alias("label"))


def pos_votes(toks: DataFrame) -> DataFrame:
    """Proper-noun tags of supplied tokens (with a column ``tag``)."""
    v = toks.select("part_id", F.col("i").alias("seq"), "start", "end", vote_category(F.lit("sudachi"), F.col("tag")).alias("category"), F.lit("sudachi").alias("channel"), F.col("tag").alias("label"))
    return v.where(F.col("category").isNotNull())


def ner_votes(entities: DataFrame, parts: DataFrame) -> DataFrame:
    """Entities (part_id, model, label, start, end) of the six labels that count, split at sentence marks."""
    known = entities.withColumn("category", vote_category(F.col("model"), F.col("label"))).where(F.col("category").isNotNull())
    e = known.join(parts.select("part_id", "text"), "part_id")
    cut = e.select("part_id", "model", "label", "category", F.posexplode(split_on_separators(F.col("text"), F.col("start"), F.col("end"))).alias("seq", "s"))
    return cut.select("part_id", "seq", "s.start", "s.end", "category", F.col("model").alias("channel"), "label")


def llm_votes(spans: DataFrame) -> DataFrame:
    """Every span of a language-model detector (part_id, start, end, ene_type); an unknown type is その他."""
    category = F.coalesce(vote_category(F.lit("llm"), F.col("ene_type")), F.lit("その他"))
    return spans.select("part_id", F.lit(0).alias("seq"), "start", "end", category.alias("category"), F.lit("llm").alias("channel"), F.col("ene_type").alias("label"))


def detect(windows: DataFrame, finder: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """Run a detector on windows (part_id, start, text): (part_id, start, end, ene_type, found, surface, place).

    ``finder`` returns (type, surface) pairs, which are located in the text; a surface that does not occur is returned
    with found = false and without a place in the text. ``place`` is the pair's number in the answer.
    """
    kind = windows.schema["part_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for part, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (ene_type, surface) in enumerate(finder(text)):
                    places = [m.start() for m in re.finditer(re.escape(surface), text)] if surface else []
                    out += [(part, start + p, start + p + len(surface), ene_type, True, surface, k) for p in places] or [(part, None, None, ene_type, False, surface, k)]
            types = (batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=["part_id", "start", "end", "ene_type", "found", "surface", "place"])

    return windows.select("part_id", "start", "text").mapInArrow(run, f"part_id {kind}, start int, end int, ene_type string, found boolean, surface string, place int")


def feature_scan(names: DataFrame, term_list: DataFrame) -> DataFrame:
    """How many names hold each term: (term, files), most first.

    A term of ASCII tokens alone counts as a run of a name's tokens; one with other letters as a part of the
    name, both NFKC and case-folded.
    """
    from veilspark.functions.scalars import ascii_tokens

    n = names.select("name", ascii_tokens(F.col("name")).alias("t"))
    other = F.col("term").rlike("[぀-ヿ㐀-鿿豈-﫿]") | (F.size("k") == 0)
    k = term_list.select("term", ascii_tokens(F.col("term")).alias("k")).distinct()
    runs_of = k.where(~other).select("term", F.array_join("k", " ").alias("key"), F.size("k").alias("n"))
    sizes = [r[0] for r in runs_of.select("n").distinct().collect()]  # lengths of terms, few
    hits = None
    for m in sizes:
        g = _grams(n, m).distinct().join(_small(runs_of.where(F.col("n") == m)), "key").select("term", "name")
        hits = g if hits is None else hits.unionByName(g)
    plain = F.regexp_replace(normalize("term"), "^$", "")
    parts = k.where(other).select("term", plain.alias("key"), F.length(plain).alias("n")).where("n > 0")
    folded = names.select("name", normalize("name").alias("c")).distinct()
    for m in [r[0] for r in parts.select("n").distinct().collect()]:
        g = folded.where(F.length("c") >= m).select("name", F.explode(F.expr(f"transform(sequence(1, length(c) - {m} + 1), i -> substring(c, i, {m}))")).alias("key")).distinct()
        g = g.join(_small(parts.where(F.col("n") == m)), "key").select("term", "name")
        hits = g if hits is None else hits.unionByName(g)
    if hits is None:
        hits = names.select(F.lit("").alias("term"), "name").limit(0)
    return hits.groupBy("term").agg(F.count_distinct("name").alias("files")).orderBy(F.desc("files"), "term")


def _grams(n: DataFrame, m: int) -> DataFrame:
    return n.where(F.size("t") >= m).select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - (m - 1)), lambda i: F.array_join(F.slice("t", i, F.lit(m)), " "))).alias("key"))


def contains_partial(surfaces: DataFrame, keys: DataFrame) -> DataFrame:
    """The surfaces (column ``surface``) in which a run of parts is one of the partial terms ``keys``."""
    rows = surfaces.select("surface").distinct()
    runs = term_runs(rows.select(F.col("surface").alias("part_id"), F.lit(0).alias("i"), F.lit(0).alias("start"), F.length("surface").alias("end"), "surface"), keys, False, ATOM)
    return rows.join(runs.select(F.col("part_id").alias("surface")).distinct(), "surface", "left_semi")
