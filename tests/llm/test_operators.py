"""Each operator on a small table of awkward rows against brute force, and on an empty one."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

VOCABULARY = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()
#: Columns whose names the operators use inside.
CLASH = "s bigint, n bigint, key string, h string, w string, items string, spans string, chunk int, score double"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = prose(rng, 90)
    near = base.split()
    near[45] = "changed"
    shared = prose(rng, 60)
    out = [
        (1, None), (2, ""), (3, " \n "), (4, "one"), (5, "Four words right here"), (6, base), (7, base), (8, " ".join(near)), (8, " ".join(near)),
        (9, prose(rng, 20) + " " + shared), (10, shared + " " + prose(rng, 30)), (11, "é日本🙂 " * 90), (12, "x" * 900), (13, prose(rng, 400)), (None, "no id " + prose(rng, 20)), (None, None),
        (14, base.upper()), (15, prose(rng, 12) + " idiot scum loser moron"), (16, "a b c d e f g"),
    ]
    return out


def frame(spark, rows):
    filled = [(i, t, "en", "src", len(t or ""), 1, 2, "k", "h", "w", "i", "s", 3, 0.5) for i, t in rows]
    return spark.createDataFrame(filled, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}").repartition(3)


def bag(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def labels(spark, rows, toxic=lambda t: int("idiot" in (t or "")), quality=lambda t: int(len(t or "") > 50)):
    return spark.createDataFrame([(i, quality(t), toxic(t)) for i, t in rows if i is not None] + [(999, None, None), (1, None, 0)], "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, rows):
    from veilspark.llm.toxicity import score_toxicity, without_toxic

    rng = random.Random(1)
    many = rows + [(100 + k, prose(rng, 40) + (" you idiot scum " if k % 3 == 0 else " ") + prose(rng, 20)) for k in range(150)]
    docs = frame(spark, many)
    got = {(r["doc_id"], r["score"], r["held_out"], r["predicted"]) for r in score_toxicity(docs, labels(spark, many)).collect()}
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, _, p in got)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, h, _ in got if i is not None)
    held = [(i, p) for i, _, h, p in got if h and i is not None and i >= 100]
    assert held and np.mean([p == (i % 3 == 1) for i, p in held]) > 0.9  # 100 + k with k a multiple of 3
    kept = without_toxic(docs, labels(spark, many))
    assert kept.columns == docs.columns and 110 < kept.count() < len(many)
    assert score_toxicity(docs.limit(0), labels(spark, [])).count() == 0


def test_network_gradients():
    from veilspark.llm.toxicity import Network, Words, _layout

    net = Network(3)
    text = b"one two three four one two"
    ws = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    start, size, _ = ws.windows()
    at, mask = _layout(ws, start, size)
    y = np.array([1.0], np.float32)

    def loss():
        logit = net.forward(net.inputs(ws), at, mask)
        return float(np.mean(np.log1p(np.exp(-logit))))

    g = net.gradients(ws, at, mask, y)
    for name in ("wf", "ub", "cf", "att", "out", "bias"):
        k = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, eps = net.p[name][k], 1e-2
        net.p[name][k] = old + eps
        up = loss()
        net.p[name][k] = old - eps
        down = loss()
        net.p[name][k] = old
        assert abs((up - down) / (2 * eps) - g[name][k]) < 2e-3, name


def test_html():
    from veilspark.llm.pagediff import main_text, page_lines, shared_lines

    page = "<html><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>cookies</div><article><h1>T&eacute;st</h1><p>A <b>b</b>\n c<br><p>D</article><div class=comments><p>me too</div><footer>f</footer><script>x='</p>'</script></body></html>"
    assert main_text(page_lines(page), None) == "Tést\nA b c\nD"
    one = page_lines("<div>Top</div><p>Mine</p><div>Bottom</div>")
    two = page_lines("<div>Top</div><p>Other</p><p>More</p><div>Bottom</div>")
    assert main_text(one, two) == "Mine" and main_text(two, one) == "Other\nMore" and main_text(one, one) == "Top\nMine\nBottom"
    assert page_lines(None) == [] and page_lines("<") == [("<", False, False)] and page_lines("<p") == [("<p", False, False)]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in "ab")
        best = max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(range(len(a)), n) if _inside([a[i] for i in c], b)), default=0)
        assert len(shared_lines(a, b)) == best


def test_html_keeps_what_holds_the_article():
    from veilspark.llm.pagediff import main_text, page_lines

    text = lambda page: main_text(page_lines(page), None)
    long = "words of the page " * 9
    for name in ("content with-sidebar", "has-sidebar", "no-ads", "sidebar"):
        assert text(f"<div class='{name}'><article><h1>T</h1><p>a</article></div><div class=ad>x</div>") == "T\na"
    for head in ("<header class='entry-header'><h1>T</h1></header>", "<div class='article-header'><h1>T</h1></div>"):
        assert text(f"<div class='site-header'>s</div><article>{head}<p>a</article>") == "T\na"
    assert text(f"<form><div class='page widget'><p>{long}</div></form><div class=ad>x</div>") == long.strip()
    assert text(f"<article><p>a</article><div class=comments><article>{long}</article></div><nav>{long}</nav>") == "a"
    assert text("<main><h1>T</h1><p>a <span class=share>b</span> c</main><div hidden><article>x</article></div>") == "T\na c"


def _inside(x, y):
    it = iter(y)
    return all(v in it for v in x)


def test_html_table(spark):
    from veilspark.llm.pagediff import extract

    data = [(1, "http://h/a/1", "<div>Top</div><p>Mine</p>"), (2, "http://h/a/2", "<div>Top</div><p>Other</p>"), (3, None, None), (4, "http://g/", ""), (4, "http://g/", "")]
    pages = spark.createDataFrame([(*r, "x") for r in data], "page_id bigint, url string, html string, text string")
    assert bag(extract(pages), "page_id", "url", "text", "n_chars") == collections.Counter([(1, "http://h/a/1", "Mine", 4), (2, "http://h/a/2", "Other", 5), (3, None, "", 0), (4, "http://g/", "", 0), (4, "http://g/", "", 0)])
    assert extract(pages.limit(0)).count() == 0


def test_html_copies(spark):
    from veilspark.llm.pagediff import extract

    pages = lambda n: [(k, f"http://h/a/{k}", f"<div>Top</div><p>{'Mine' if k < n else f'Other {k}'}</p><div>End</div>") for k in range(n + 2)]
    for n in (1, 5):
        got = extract(spark.createDataFrame(pages(n), "page_id bigint, url string, html string").coalesce(1)).collect()
        assert {(r["page_id"], r["text"]) for r in got} == {*((k, "Mine") for k in range(n)), (n, f"Other {n}"), (n + 1, f"Other {n + 1}")}
    got = extract(spark.createDataFrame(pages(5)[:5], "page_id bigint, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Top\nMine\nEnd"}


def test_sentencepieces(spark, rows):
    import sentencepiece

    from veilspark.llm.queries import tokenizer_model
    from veilspark.llm.sentencepieces import PieceCodec, encode_documents, load_vocabulary

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())
    codec = PieceCodec(load_vocabulary(tokenizer_model()), units_kept=50)
    rng = random.Random(3)
    alphabet = "aabcdeeehinorst   \n▁ßéüñ.,!?$#|0123456789日本語🙂\t​\x00"
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert codec.encode(t) == ids and codec.decode(ids) == sp.decode(ids)
    for _ in range(500):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(32000))) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == sp.decode(ids)

    def want(t):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    got = bag(encode_documents(frame(spark, rows), tokenizer_model()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == collections.Counter((i, *want(t)) for i, t in rows)


def test_long_units_are_encoded_in_linear_time():
    import time

    import sentencepiece as spm

    from veilspark.llm.queries import tokenizer_model
    from veilspark.llm.sentencepieces import PieceCodec, load_vocabulary

    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    codec = PieceCodec(load_vocabulary(tokenizer_model()))
    began = time.time()
    ids = codec.encode(text)
    assert time.time() - began < 15  # a second or two alone; quadratic work takes minutes
    assert ids == spm.SentencePieceProcessor(model_file=tokenizer_model()).encode(text, add_bos=True, add_eos=True)


def test_decontamination(spark, rows):
    from veilspark.llm.decontaminate import clean, report

    text = dict((i, t) for i, t in rows if i)
    w = text[13].split()
    items = [(1, " ".join(w[5:25])), (2, " ".join(w[100:108])), (3, "One"), (None, "a B c d e f g"), (5, None), (6, "!!"), (2, "unrelated words only in this one item here")]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, h string")

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    wins = collections.defaultdict(set)
    for i, t in items:
        x = cut(t)
        n = min(8, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            wins[tuple(x[k : k + n])].add("" if i is None else str(i))

    def want(t):
        x = cut(t)
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(x) - n + 1):
                if tuple(x[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(x[k : k + n])]
        return len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2

    docs = frame(spark, rows)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(report(docs, bench), *cols) == collections.Counter((i, *want(t)) for i, t in rows)
    assert bag(report(docs, bench, broadcast_windows=0), *cols) == collections.Counter((i, *want(t)) for i, t in rows)
    left = clean(docs, bench)
    assert left.columns == docs.columns and bag(report(left, bench), "n_hit").keys() == {(0,)}
    assert bag(report(docs, bench.limit(0)), "n_hit").keys() == {(0,)}


def test_quality(spark, rows):
    from veilspark.llm.quality import score_quality

    rng = random.Random(4)
    many = rows + [(100 + k, (prose(rng, 60) if k % 2 else " ".join(f"{x}###" for x in prose(rng, 60).split()))) for k in range(200)]
    lab = labels(spark, many, quality=lambda t: int("###" not in (t or "")))
    got = {r["doc_id"]: r for r in score_quality(frame(spark, many), lab).collect()}
    held = [r for r in got.values() if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert held and np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert score_quality(frame(spark, rows).limit(0), lab.limit(0)).count() == 0


def test_fixity(spark):
    from veilspark.llm.warcfixity import audit, leaves

    from pyspark.sql import functions as F

    data = [(k, f"http://h/{k}", "<p>" * (k % 7)) for k in range(2100)] + [(None, None, None), (None, "u", "x"), (5, None, "dup"), (5, None, "dup")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    out = audit(leaves(pages), leaves(pages, F.col("page_id").isin(3, 999, 1000, 2099) & F.col("url").isNotNull()))
    assert {r["page_id"] for r in out.where("not intact").collect()} == {3, 999, 1000, 2099}
    assert out.count() == len(data)
    ours = [r for r in out.collect() if r["archive"] == 0]
    at = 0
    for r in sorted(ours, key=lambda r: r["offset"]):
        assert r["offset"] == at
        at += r["length"]
    assert audit(leaves(pages.limit(0)), leaves(pages.limit(0))).count() == 0


def test_fixity_losses(spark):
    from veilspark.llm.warcfixity import audit, leaves

    from pyspark.sql import functions as F

    data = [(k, f"http://h/{k}", "<p>" * (k % 7)) for k in range(3050)] + [(None, "u", "x"), (5, None, "dup"), (5, None, "dup")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    full, cut = leaves(pages), leaves(pages.where("coalesce(page_id, 0) not in (7, 1999) and coalesce(page_id, 0) < 3000 and (page_id <> 5 or url is not null) is not false"), longer=F.col("page_id") == 1500)
    gone = {7, 1999, *range(3000, 3050)}
    for ours, theirs, name in ((full, cut, "missing"), (cut, full, "extra")):
        out = audit(ours, theirs).collect()
        told = collections.Counter((r["page_id"], r["status"]) for r in out if not r["intact"])
        assert told == collections.Counter([*((k, name) for k in gone), (5, name), (5, name), (1500, "damaged")])
        assert len(out) == len(data) and all(r["intact"] == (r["status"] == "intact") for r in out)


def test_language_model(spark, rows):
    from veilspark.llm.brown import score_corpus

    rng = random.Random(6)
    many = rows + [(100 + k, prose(rng, 30)) for k in range(60)]
    docs = frame(spark, many)
    got = score_corpus(docs).collect()
    again = score_corpus(docs, broadcast_words=0).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    counts = collections.Counter()
    for i, t in many:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            counts.update([*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*words(t), None])
    want = collections.Counter((i, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), total, round(base(t), 6)) for i, t in many)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert score_corpus(docs.limit(0)).count() == 0


def test_every_word_is_placed(spark):
    from pyspark.sql import functions as F
    from veilspark.llm import brown

    rng = np.random.default_rng(1)
    n_c, n_w = brown.CLASSES + 1, 60
    of = rng.integers(0, n_c - 1, n_w + 1)
    of[-1] = n_c - 1
    b = rng.poisson(0.7, (n_w + 1, n_w + 1)).astype(float)
    hot = np.eye(n_c)[of]
    table = hot.T @ b @ hot
    bare = b - np.diag(np.diag(b))
    got = brown.best_classes(table, of[:-1], (bare.T @ hot)[:-1], (bare @ hot)[:-1], np.diag(b)[:-1])

    def moved(t, k):
        new = of.copy()
        new[t] = k
        return brown.likelihood(np.eye(n_c)[new].T @ b @ np.eye(n_c)[new])

    for t in range(n_w):
        assert moved(t, got[t]) >= max(moved(t, k) for k in range(n_c - 1) if table[:, k].any()) - 1e-6

    r = random.Random(3)
    many = [(k, " ".join(x for _ in range(40) for x in (r.choice("ab"), r.choice(("p", f"x{r.randrange(90)}ss")), "mid", r.choice(("q", f"y{r.randrange(90)}ss"))))) for k in range(60)]
    docs = frame(spark, many).withColumn("held_out", F.lit(False))
    counts = brown.written(brown.unigrams(docs), "unigrams")
    for words_sent in (10**6, 0):
        start, _, before = brown.fit(docs.withColumn(brown.RID, F.col("doc_id")), counts, words_sent, types_top=5, rounds=0)
        model, _, known = brown.fit(docs.withColumn(brown.RID, F.col("doc_id")), counts, words_sent, types_top=5)
        of_word = lambda known: {x["w"]: x["c"] for x in known.collect()}
        old, new = of_word(before), of_word(known)
        assert old.keys() == new.keys() and old != new
        flat = brown.string_bytes(brown.pa.array([t for _, t in many]))
        w, _, cuts = brown.word_hashes(*flat)

        def tallied(of):
            line = brown._line(np.array([of[x] for x in w.tolist()]), cuts)[0]
            return np.bincount(line[:-1] * n_c + line[1:], minlength=n_c * n_c).reshape(n_c, n_c)

        assert brown.likelihood(tallied(new)) > brown.likelihood(tallied(old))
        assert (model.class_tokens == tallied(new).sum(axis=0)).all()


def test_exchange_raises_likelihood():
    from veilspark.llm.brown import exchange

    rng = np.random.default_rng(0)
    b = rng.integers(0, 2, (41, 41)).astype(float)
    b[:10, 10:20] += 50
    b[10:20, :10] += 50

    def likelihood(of):
        hot = np.eye(5)[of]
        t = hot.T @ b @ hot
        f = lambda x: np.sum(x[x > 0] * np.log(x[x > 0]))
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    of = exchange(b, classes=4, passes=0)
    start = np.where(of == 4, 4, of)
    best = exchange(b, classes=4, passes=20)
    assert likelihood(best) > likelihood(start) and best[-1] == 4


def test_similarity_join(spark, rows):
    from veilspark.llm.jaccard import distinct_documents, link_components

    rng = random.Random(7)
    many = list(rows)
    base = prose(rng, 120).split()
    for k in range(40):  # a group of near copies on both sides of the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(50)}"
        many.append((200 + k, " ".join(copy)))
    sets = []
    for i, t in many:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[find(b)] = find(a)
    group = collections.defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if s:
            group[find(k)].append(i)
    least = {k: min((i for i in g if i is not None), default=None) for k, g in group.items()}
    want = collections.Counter((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets))
    docs = frame(spark, many)
    assert bag(link_components(docs), "doc_id", "n_shingles", "component_id") == want
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(group) + sum(not s for _, s in sets)
    assert link_components(docs.limit(0)).count() == 0


def test_signatures_lose_no_link():
    """Any choice of segments that leaves out no more weight than the slack looks a linked set up."""
    from veilspark.llm.jaccard import allocate, band_edges, signatures

    rng = random.Random(8)
    edges = band_edges(400)
    for share in (0.0, 0.02, 1e9):  # all exact, mixed, and as many deletions as the rule allows
        bands = [allocate(k, edges[k], edges[k + 1] - 1, 1000, pair_cost=share) for k in range(len(edges) - 1)]
        for _ in range(150):
            n = rng.randint(4, 300)
            x = set(rng.getrandbits(63) for _ in range(n))
            y = set(x)
            while True:  # as different as a link allows
                z = set(y)
                z.discard(rng.choice(sorted(z))) if rng.random() < 0.5 else z.add(rng.getrandbits(63))
                if 100 * len(x & z) < 80 * len(x | z):
                    break
                y = z
            if x == y:
                continue
            h = np.concatenate([np.array(sorted(v), np.uint64) for v in (x, y)])
            rows = list(zip(*signatures(bands, h, np.array([0, len(x), len(x) + len(y)]), np.array([0, 1]))))
            size = len(x), len(y)
            shared = set(r[0] for r in rows if r[1] == 0) & set(r[0] for r in rows if r[1] == 1)
            found = False
            for me in (0, 1):
                for band in set(int(r[2]) >> 34 for r in rows if r[1] == me):
                    mine = [r for r in rows if r[1] == me and int(r[2]) >> 34 == band]
                    other = {r[0]: r for r in rows if r[1] != me and int(r[2]) >> 34 == band}
                    if not other or not (mine[0][2] & 1 or next(iter(other.values()))[2] & 1):
                        continue
                    met = {int(r[2]) >> 2 for r in mine if r[0] in shared}
                    segments = {int(r[2]) >> 2: 1 + (int(r[2]) >> 1 & 1) for r in mine}
                    left = int(mine[0][3])
                    for s in sorted(segments, key=lambda s: (s not in met, rng.random())):  # those that meet leave first
                        if segments[s] > left:
                            break
                        left -= segments[s]
                        met.discard(s)
                    larger = (size[me], me) > (size[1 - me], 1 - me)
                    found |= bool(met) and (larger or next(iter(other.values()))[3] < 0)
            assert found


@pytest.mark.parametrize("family", [2_000, 1])
def test_repeats(spark, rows, family, monkeypatch):
    from veilspark.llm import common
    from veilspark.llm import suffixdedup as D

    if family == 1:  # keys are split down to single strings, and nothing is broadcast
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(D, "BROADCAST_ROWS", 0)

    plain = D.repeated_spans
    monkeypatch.setattr(D, "repeated_spans", lambda d: plain(d, family))
    docs = frame(spark, rows)
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(r[k : k + 200] for _, r in raws for k in range(len(r) - 199))

    def want(r):
        kept, n = D._cut_text(r, [(k, k + 200) for k in range(len(r) - 199) if seen[r[k : k + 200]] > 1])
        return len(r), len(r) - len(kept), n, hashlib.sha256(kept).hexdigest()

    assert bag(D.report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == collections.Counter((i, *want(r)) for i, r in raws)
    if family > 1:
        out = D.without_repeats(docs)
        assert out.columns == docs.columns and out.count() == len(rows)
        assert D.report(docs.limit(0)).count() == 0


def test_merge_against_sorting():
    from veilspark.llm.suffixdedup import Shard, merge, repeated_starts

    rng = random.Random(9)
    for _ in range(60):
        n = rng.choice((9, 12, 13))
        strings = [bytes(rng.choice(b"ab") for _ in range(n + rng.randint(0, 20))) for _ in range(rng.randint(1, 12))]
        many = np.array([len(s) - n + 1 for s in strings])
        every = [s[k : k + n] for s in strings for k in range(len(s) - n + 1)]
        count = collections.Counter(every)
        assert list(repeated_starts(strings, many, n, shard_strings=3)) == [count[x] > 1 for x in every]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        flat = np.frombuffer(b"".join(strings), np.uint8)
        pairs = flat[:-1].astype(np.uint16) << 8 | flat[1:]
        shards = [Shard(flat, pairs, offsets[k : k + 4], many[k : k + 3], n) for k in range(0, len(strings), 3)]
        start, common = merge(shards, n, drop_unique=False)
        order = [bytes(flat[x : x + n]) for x in start]
        assert order == sorted(every)
        for a, b, c in zip(order, order[1:], common[1:]):
            assert c == next((k for k in range(n) if a[k] != b[k]), n)


def test_media(spark, rows, tmp_path):
    import tarfile

    from veilspark.llm import media

    docs = frame(spark, rows)
    root = f"file://{tmp_path}"
    index = media.store(docs, root, shard_bytes=2000)
    index = index.sparkSession.createDataFrame(index.collect(), index.schema)
    out = {}
    for r in media.read_columns(index, root).collect():
        out.setdefault(r["doc_id"], r)
    for i, t in rows:
        if i is None:
            continue
        p = media.payload(t)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert len(p) % 64 == 0 and len(p) >= 64 and media.decode_png(media.encode_png(p)) == p
    assert out[6]["media_sha256"] == out[7]["media_sha256"]
    names = [m.name for f in tmp_path.glob("*.tar") for m in tarfile.open(f)]
    assert len(names) >= len({r["digest"] for r in index.collect()})
    heads = {r["digest"]: (r["width"], r["height"]) for r in media.read_headers(index, root).collect()}
    assert all(heads[r["media_sha256"]] == (64, r["payload_bytes"] // 64) for r in out.values())
    broken = bytearray(media.encode_png(media.payload("x")))
    broken[50] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))
    assert media.media_columns(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, src)
    docs = spark.read.parquet(f"{src}/documents.parquet")
    n = out.count()
    assert 0 < n < docs.count() and out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "decontamination", "encoding"]
