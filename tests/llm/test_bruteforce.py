"""Scores and the pipeline against plain Python, and long texts through every operator."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import bag, frame, labels, prose, rows, words  # noqa: F401  rows is a fixture


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_toxicity_scores_and_table_gradients():
    from veilspark.llm import toxicity as T
    from veilspark.llm.bytescan import Buffer

    rng = random.Random(3)
    texts = [prose(rng, n) for n in (0, 1, 23, 24, 25, 60)] + ["é日本 " * 30]
    net = T.Network(5)
    raw = [t.encode() for t in texts]
    flat, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))

    def one_hash(b):
        return int(Buffer(np.frombuffer(b, np.uint8)).hash(np.array([0]), np.array([len(b)]))[0])

    def vector(word):
        b = word.encode()
        chars = b" " + b + b" "
        grams = [chars[k : k + n] for n in T.CHAR_NGRAMS for k in range(len(chars) - n + 1)]
        mean = sum((net.p["char"][one_hash(g) % T.CHAR_ROWS].astype(float) for g in grams), np.zeros(T.CHAR_DIM)) / max(1, len(grams))
        return np.concatenate((net.p["word"][one_hash(b) % T.WORD_ROWS], mean))

    def logit(window):
        x = [vector(w) for w in window] + [np.zeros(T.WORD_DIM + T.CHAR_DIM)] * (T.WINDOW - len(window))
        states = np.zeros((T.WINDOW, 2 * T.HIDDEN))
        for k, d in enumerate("fb"):
            h, u, n = np.zeros(T.HIDDEN), net.p[f"u{d}"], T.HIDDEN
            for t in range(T.WINDOW) if d == "f" else reversed(range(T.WINDOW)):
                g = x[t] @ net.p[f"w{d}"] + net.p[f"c{d}"]
                z, r = sigmoid(g[:n] + h @ u[:, :n]), sigmoid(g[n : 2 * n] + h @ u[:, n : 2 * n])
                c = np.tanh(g[2 * n :] + (r * h) @ u[:, 2 * n :])
                h = (1 - z) * h + z * c
                states[t, k * n : (k + 1) * n] = h
        e = states @ net.p["att"]
        e[len(window) :] = -1e4
        a = np.exp(e - e.max())
        return (a / a.sum()) @ states @ net.p["out"] + net.p["bias"][0]

    def score(t):
        w = words(t)
        starts = [0] + [k for k in range(T.STRIDE, len(w), T.STRIDE) if k + T.WINDOW - T.STRIDE < len(w)]
        return sigmoid(max(logit(w[s : s + T.WINDOW]) for s in starts))

    got = T.score_texts(net, flat, offsets)
    assert np.allclose(got, [score(t) for t in texts], atol=1e-5)
    alone = [T.score_texts(net, np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert np.allclose(got, alone, atol=1e-6)  # whatever is scored beside it

    w = T.Words(flat, offsets)
    start, size, text = w.windows()
    at, mask = T._layout(w, start, size)
    y = (np.arange(len(start)) % 2).astype(np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    grads = net.gradients(w, at, mask, y)

    def loss():
        z = net.forward(net.inputs(w).astype(np.float64), at, mask)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name in ("word", "char"):
        ids, g = grads[name]
        for k in rng.sample(range(len(ids)), 3):
            j = rng.randrange(g.shape[1])
            keep = net.p[name][ids[k], j]
            both = []
            for by in (1e-2, -1e-2):
                net.p[name][ids[k], j] = keep + by
                both.append(loss())
            net.p[name][ids[k], j] = keep
            assert abs((both[0] - both[1]) / 2e-2 - g[k, j]) < 1e-3 + 0.05 * abs(g[k, j])


def test_quality_scores():
    import pyarrow as pa

    from veilspark.llm import quality as Q
    from veilspark.llm.bytescan import Buffer, mix64

    rng = random.Random(4)
    texts = ["", None, "a", "ab ab", "É日本 x", prose(rng, 40), "x" * 700 + " tail", " lead\ttrail \n"]
    weights = np.random.default_rng(1).normal(size=Q.BUCKETS)

    def one_hash(b):
        return Buffer(np.frombuffer(b, np.uint8)).hash(np.array([0]), np.array([len(b)]))

    def rows_of(text):
        raw = (text or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        h = [one_hash(x) for x in w]
        out = [int(x[0]) % Q.BUCKETS for x in h]
        for a, b in zip(h, h[1:]):
            out.append(int(Q.REPEATED if a[0] == b[0] else mix64(a * np.uint64(3) + b)[0]) % Q.BUCKETS)
        for n in Q.NGRAMS:
            out += [int(one_hash(raw[k : k + n])[0]) % Q.BUCKETS for k in range(len(raw) - n + 1) if not re.search(rb"[\x20\x09-\x0D]", raw[k + 1 : k + n - 1])]
        return out

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    want = [sigmoid(np.mean([weights[r] for r in rows_of(t)] or [0.0]) + 0.25) for t in texts]
    assert np.allclose(Q.score_batch(batch, "text", weights, 0.25), want)


def test_class_model_scores(spark, rows):  # noqa: F811
    from veilspark.llm import brown as B
    from veilspark.llm.common import held_out, keyed, written

    rng = random.Random(6)
    many = rows + [(100 + k, prose(rng, 30)) for k in range(60)]
    docs = frame(spark, many)
    held = keyed(docs, "text").withColumn("held_out", held_out("doc_id", B.FOLDS))
    model, ends, known = B.fit(held, written(B.unigrams(held), "unigrams"))
    classes = {r["w"]: (r["c"], r["n"]) for r in known.collect()}

    def word(x):
        raw = x.encode()
        w, pool, _ = B.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return classes.get(int(w[0]), (int(model.of[len(model.top) + pool[0]]), 0))

    n_c, train = B.CLASSES + 1, [(i, t) for i, t in many if zlib.crc32(("" if i is None else str(i)).encode()) % B.FOLDS]
    table, tokens, kinds = np.zeros((n_c, n_c)), collections.Counter(), collections.defaultdict(set)
    for _, t in train:
        line = [word(x)[0] for x in words(t)] + [B.CLASSES]
        for a, b in zip([B.CLASSES, *line], line):
            table[a, b] += 1
        for x, c in zip(words(t), line):
            tokens[c] += 1
            kinds[c].add(x)
    # texts follow one another, so the border after the last one is before the first
    after = table.sum(axis=0)
    uni = (after + 1) / (after.sum() + n_c)

    def score(t):
        total, before = 0.0, B.CLASSES
        for x in [*words(t), None]:
            c, n = word(x) if x is not None else (B.CLASSES, ends)
            total += math.log10(B.MIX * (table[before, c] + uni[c]) / (table[before].sum() + 1) + (1 - B.MIX) * uni[c])
            if x is not None:
                total += math.log10((n + B.ADD) / (tokens[c] + B.ADD * (len(kinds[c]) + 1)))
            before = c
        return total

    got = collections.Counter((r["doc_id"], round(r["score"], 5)) for r in B.score_corpus(docs).collect())
    assert got == collections.Counter((i, round(score(t), 5)) for i, t in many)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A table of documents with copies, shared passages, benchmark passages, toxic rows, nulls and repeated ids."""
    rng = random.Random(11)
    top = tmp_path_factory.mktemp("small")
    base, shared, item = prose(rng, 80), prose(rng, 70), [prose(rng, 14) for _ in range(3)]
    near = base.split()
    near[40] = "other"
    docs = [(1, base), (2, base), (3, " ".join(near)), (4, prose(rng, 30) + " " + shared), (5, shared + " " + prose(rng, 40)), (6, None), (7, ""), (7, None), (None, prose(rng, 25))]
    docs += [(8, prose(rng, 20) + " " + item[0] + " " + prose(rng, 9)), (9, " ".join([item[0], prose(rng, 15), item[1]]))]
    docs += [(20 + k, prose(rng, 30) + (" idiot scum loser moron idiot" if k % 3 == 0 else "")) for k in range(90)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{top}/documents.parquet")
    labels(spark, docs).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), docs, item


def test_pipeline_against_brute_force(spark, small):
    import sentencepiece as spm

    import corpus_pipeline
    from veilspark.llm.queries import tokenizer_model
    from veilspark.llm.toxicity import score_toxicity

    top, docs, item = small
    table = lambda name: spark.read.parquet(f"{top}/{name}.parquet")
    scored = collections.Counter((r["doc_id"], r["predicted"]) for r in score_toxicity(table("documents"), table("labels")).collect())
    kept = [(i, t) for i, t in docs if not scored[i, 1]]
    assert not any("idiot" in (t or "") for _, t in kept) and len(kept) == sum("idiot" not in (t or "") for _, t in docs)
    sets = [frozenset(tuple(words(t)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))) if words(t) else frozenset() for _, t in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    best = {}
    for k, (i, _) in enumerate(kept):
        place = (i is None, i or 0, k)
        if sets[k] and (root[k] not in best or place < best[root[k]]):
            best[root[k]] = place
    kept = [x for k, x in enumerate(kept) if not sets[k] or best[root[k]][2] == k]
    seen = collections.Counter(r[k : k + 200] for r in ((t or "").encode() for _, t in kept) for k in range(len(r) - 199))

    def cut(t):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 199):
            if seen[raw[k : k + 200]] > 1:
                gone[k : k + 200] = True
        return bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")

    kept = [(i, cut(t)) for i, t in kept]
    wins = collections.defaultdict(set)
    for n, t in enumerate(item):
        for k in range(len(t.split()) - 7):
            wins[tuple(t.split()[k : k + 8])].add(n)
    left = []
    for i, t in kept:
        w = list(re.finditer(r"[a-z]+", t))
        hit, found = set(), set()
        for k in range(len(w) - 7):
            met = wins.get(tuple(x[0] for x in w[k : k + 8]), ())
            found |= set(met)
            hit |= set(range(k, k + 8)) if met else set()
        if len(found) < 2:
            spans = [(w[k].start() if k - 1 not in hit else w[k - 1].end(), w[k].end()) for k in sorted(hit)]
            for a, b in reversed(spans):
                t = t[:a] + t[b:]
            left.append((i, t))
    assert 9 not in dict(left) and item[0][:40] not in dict(left)[8]
    sp = spm.SentencePieceProcessor(model_file=tokenizer_model())
    want = collections.Counter()
    for i, t in left:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    out = corpus_pipeline.run(spark, top)
    assert bag(out, "doc_id", "n_tokens", "ids_sha256") == want
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "decontamination", "encoding"]


def test_pipeline_of_an_empty_table(spark, small, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts(spark):
    """A text beyond every piece's limit, its copy, and a copy with a changed end, through each operator."""
    from veilspark.llm import brown, decontaminate, jaccard, media, quality, sentencepieces, suffixdedup, toxicity
    from veilspark.llm.queries import tokenizer_model

    rng = random.Random(12)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(150_000))
    docs = frame(spark, [(1, long), (2, long), (3, long[:-20_000] + prose(rng, 2000)), (4, prose(rng, 50)), (5, "z" * 200_000)])
    some = labels(spark, [(k, "x" * k) for k in (1, 2, 3, 4, 5)])
    bench = spark.createDataFrame([(1, long[5_000:5_200])], "item_id bigint, text string")
    found = {r["doc_id"]: r for r in jaccard.link_components(docs).collect()}
    assert [found[k]["component_id"] for k in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 5] and found[1]["n_shingles"] == 150_000 - 4 and found[5]["n_shingles"] == 1
    cut = {r["doc_id"]: r for r in suffixdedup.report(docs).collect()}
    assert cut[1]["n_removed"] == len(long) and cut[3]["n_bytes"] - cut[3]["n_removed"] < 30_000 and cut[5]["n_removed"] == 200_000 and cut[4]["n_removed"] == 0
    assert bag(decontaminate.report(docs, bench), "doc_id", "n_items") == collections.Counter([(1, 1), (2, 1), (3, 1), (4, 0), (5, 0)])
    for out in (toxicity.score_toxicity(docs, some), quality.score_quality(docs, some)):
        scores = {r["doc_id"]: r["score"] for r in out.collect()}
        assert len(scores) == 5 and scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert {r["doc_id"]: r["n_tokens"] for r in brown.score_corpus(docs).collect()}[1] == 150_001
    sizes = {r["doc_id"]: r["n_bytes"] for r in media.media_columns(docs).collect()}
    assert sizes[1] == len(long) and sizes[5] == 200_000
    got = {r["doc_id"]: r["decoded_sha256"] for r in sentencepieces.encode_documents(docs, tokenizer_model()).collect()}
    assert got[1] == got[2] == hashlib.sha256(long.encode()).hexdigest()
