from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.operators import channels, consensus, registry, rewrite
from veilspark.plans.masking import analyze, mask, unmask

ENTRY = "canonical string, category string, aliases array<string>, mask string, partial boolean, case_sensitive boolean, note string"


def entries(spark, *rows):
    base = {"category": "社名", "aliases": [], "mask": None, "partial": False, "case_sensitive": False, "note": None}
    return spark.createDataFrame([tuple((base | r)[k.split()[0]] for k in ENTRY.split(", ")) for r in rows], ENTRY)


def parts(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "part_id string, text string")


def hits(spark, texts, kind, *rows):
    """Matched surfaces of each text, under one dictionary."""
    toks = channels.tokens(parts(spark, *texts))
    keys = channels.terms(entries(spark, *rows))
    find = {"whole": channels.dictionary_hits, "partial": channels.partial_hits, "cjk": channels.cjk_substring_hits}[kind]
    out = [[] for _ in texts]
    for r in find(toks, keys).orderBy("start").collect():
        k = int(r["part_id"][1:])
        out[k].append(texts[k][r["start"] : r["end"]])
    return out


def test_whole_matches(spark):
    texts = ["iASのみ", "iASMapを確認", "IF-Xを使用", "AB-Xを使用", "社Aです", "LB SONY EGA Phase-L", "STS, ＳＴＳ / Sts, sts", ""]
    rows = [{"canonical": x} for x in ("iAS", "IF-", "AB-X", "社A", "SONY")] + [{"canonical": "STS", "case_sensitive": True}]
    assert hits(spark, texts, "whole", *rows) == [["iAS"], [], [], ["AB-X"], ["社A"], ["SONY"], ["STS", "ＳＴＳ"], []]


def test_partial_and_substring_matches(spark):
    texts = ["IF-Xを使用, IF-Yのログ", "IFは共通部品", "iASMapを確認", "ECBTypeの確認"]
    rows = [{"canonical": x, "partial": True} for x in ("IF-", "iAS", "CB")]
    assert hits(spark, texts, "partial", *rows) == [["IF-", "IF-"], [], ["iAS"], []]
    assert hits(spark, ["エクスモーションオリジナル", "日本語"], "cjk", {"canonical": "エクスモーション"}, {"canonical": "本"}) == [["エクスモーション"], []]


def test_consensus(spark):
    e, g = "ja_ginza_electra", "ja_ginza"
    cases = [
        ("田中商事", [(0, 2, "llm", "Person")], [("田中", "人名", "中")]),
        ("田中商事", [(0, 2, "llm", "Person"), (0, 2, e, "PERSON")], [("田中", "人名", "強")]),
        ("佐伯", [(0, 2, g, "PERSON"), (0, 2, e, "PERSON"), (0, 2, "sudachi", "名詞-固有名詞-人名-姓")], [("佐伯", "人名", "中")]),
        ("アクメ", [(0, 3, e, "COMPANY"), (0, 3, "llm", "Person")], [("アクメ", "人名", "強")]),
        ("長崎", [(0, 2, e, "CITY"), (0, 2, "llm", "City")], [("長崎", "地名", "弱")]),
        ("情報.D-CapCorrExecY", [(0, 4, g, "Person"), (3, 8, "dict", "商標(辞書·部分)")], [("D-Cap", "商標", "確定")]),
        ("FIARSL", [(0, 6, g, "Person")], [("FIARSL", "その他", "弱")]),
        ("IBM", [(0, 3, g, "Company"), (0, 3, "llm", "Company")], [("IBM", "社名", "強")]),
        ("ab", [(0, 1, "llm", "Person"), (1, 2, "llm", "Person")], [("a", "人名", "中"), ("b", "人名", "中")]),
    ]
    rows = [(f"p{k}", i, s, t, None, ch, label) for k, (_, votes, _) in enumerate(cases) for i, (s, t, ch, label) in enumerate(votes)]
    v = spark.createDataFrame(rows, "part_id string, seq int, start int, end int, category string, channel string, label string")
    v = v.withColumn("category", F.coalesce(consensus.S.vote_category(F.col("channel"), F.col("label")), F.lit("その他")))
    got = [[] for _ in cases]
    for r in consensus.merged(v, parts(spark, *[c[0] for c in cases])).orderBy("start").collect():
        got[int(r["part_id"][1:])].append((r["surface"], r["category"], r["confidence"]))
    assert got == [c[2] for c in cases]


def test_masking_and_back(spark):
    texts = ["SONY と Sony は同じ会社。連絡は a@example.com へ。SONY", "SONYとCanonの展示会。", "Canonの新製品をSONYが評価。", "eXmotion とエクスモーションと eXmotion"]
    p = parts(spark, *texts)
    place = {"p0": ("one", 0), "p1": ("two", 0), "p2": ("two", 1), "p3": ("three", 0)}
    bundles = spark.createDataFrame([(k, b, i) for k, (b, i) in place.items()], "part_id string, bundle_id string, part_index int")
    found = analyze(p, entries(spark, {"canonical": "SONY"}, {"canonical": "Canon"}, {"canonical": "eXmotion", "aliases": ["エクスモーション"], "mask": "〔社A〕"}))
    masked, mapping = mask(found, bundles)
    masked = spark.createDataFrame(masked.collect(), masked.schema)
    mapping = spark.createDataFrame(mapping.collect(), mapping.schema)
    out = {r["part_id"]: r["masked_text"] for r in masked.collect()}
    assert out["p0"] == "[社1] と [社2] は同じ会社。連絡は [連絡先1] へ。[社1]"
    assert (out["p1"], out["p2"]) == ("[社1]と[社2]の展示会。", "[社2]の新製品を[社1]が評価。")
    assert out["p3"].count("〔社A〕") == 3 and mapping.where("bundle_id = 'three'").count() == 1
    back = {r["part_id"]: r["restored"] for r in unmask(masked, mapping).collect()}
    assert [back[f"p{k}"] for k in range(3)] == texts[:3]


def test_unmask_longest_first(spark):
    rows = [("[社1]の[人物1]が[社10]を担当。[社99]", [("[社1]", "社A", []), ("[社10]", "社J", []), ("[人物1]", None, ["小坂"])])]
    d = spark.createDataFrame(rows, "t string, m array<struct<placeholder:string,canonical:string,surfaces:array<string>>>")
    assert d.select(rewrite.unmask(F.col("t"), F.col("m"))).first()[0] == "社Aの小坂が社Jを担当。[社99]"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6)), max_size=6))
def test_rewrite_keeps_later_spans(spark, spans):
    text = "abcdefghijklmnopqrstuvwxyz"
    rows = [(text, [(s, s + n, f"<{s}>") for s, n in spans])]
    out = spark.createDataFrame(rows, "t string, s array<struct<start:int,end:int,placeholder:string>>").select(rewrite.rewrite(F.col("t"), F.col("s"))).first()[0]
    kept, lo = [], 99
    for s, e in sorted({(s, s + n) for s, n in spans}, reverse=True):
        if e <= lo:
            kept.append((s, e))
            lo = s
    want = text
    for s, e in kept:
        want = want[:s] + f"<{s}>" + want[e:]
    assert out == want


def test_allowlist(spark):
    c = spark.createDataFrame([("p", 0, 2, "FB", "社名", "中", [("llm", "Company")]), ("p", 3, 5, "fb", "社名", "確定", [("dict", "社名(辞書)")]), ("p", 6, 15, "GetFBData", "社名", "中", [("llm", "Company")]), ("p", 20, 23, "FBI", "社名", "中", [("llm", "Company")])], f"part_id string, start int, end int, surface string, category string, confidence string, votes {consensus.VOTES}")
    allow = spark.createDataFrame([("FB", True, False, None)], "surface string, partial boolean, case_sensitive boolean, note string")
    assert {r["surface"]: r["confidence"] for r in consensus.allowed(c, allow).collect()} == {"FB": "除外", "fb": "確定", "GetFBData": "除外", "FBI": "中"}


def test_registry(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path))
    row = lambda v: spark.createDataFrame([("h", "m", True, v)], "content_hash string, model string, flatten boolean, analysis string")
    r.put("ner", row("old"))
    r.put("ner", row("new"), write_no=1)
    assert [x["analysis"] for x in r.get("ner").collect()] == ["new"]
    r.delete("ner", spark.createDataFrame([("h", "m", True)], "content_hash string, model string, flatten boolean"), write_no=2)
    assert r.get("ner").count() == 0


def test_stream(spark, tmp_path):
    from veilspark.streaming.masking import mask_stream

    src = tmp_path / "in"
    rows = [("b", "p0", 0, "SONY の a@example.com"), ("b", "p1", 1, "SONY")]
    schema = "bundle_id string, part_id string, part_index int, text string"
    spark.createDataFrame(rows, schema).write.parquet(str(src))
    seen = []
    mask_stream(spark.readStream.schema(schema).parquet(str(src)), entries(spark, {"canonical": "SONY"}), lambda m, _, n: seen.extend(r["masked_text"] for r in m.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == ["[社1]", "[社1] の [連絡先1]"]


def test_loaders(spark, tmp_path):
    from veilspark.sources import files

    (tmp_path / "a.txt").write_bytes("株式会社ｱﾙﾌｧ".encode("cp932"))
    (tmp_path / "b.html").write_text("<p>x<script>no</script></p><p>y</p>")
    got = {r["file_name"]: r["text"] for r in files.load(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "株式会社アルファ", "b.html": "x\ny"}
    assert files.joined(files.chunks(files.load(spark, str(tmp_path / "b.html")))).first()["text"] == "x\ny"


def test_case_sensitive_terms_keep_their_case(spark):
    """A case-sensitive term is masked and spread with its case only; its fixed mask and canonical are found."""
    p = parts(spark, "STS and sts and Sts here, ＳＴＳ", "abc ABC")
    bundles = spark.createDataFrame([("p0", "one", 0), ("p1", "one", 1)], "part_id string, bundle_id string, part_index int")
    found = analyze(p, entries(spark, {"canonical": "STS", "case_sensitive": True}, {"canonical": "ABC", "case_sensitive": True, "mask": "〔甲〕"}))
    masked, mapping = mask(found, bundles)
    out = {r["part_id"]: r["masked_text"] for r in masked.collect()}
    assert out["p0"].startswith("[社1] and sts and Sts here, [社") and out["p1"] == "abc 〔甲〕"
    assert {r["canonical"] for r in mapping.where("placeholder = '〔甲〕'").collect()} == {"ABC"}


def test_spans_of_a_part_are_those_of_the_windows(spark):
    import random

    rng = random.Random(4)
    rows = []
    for k in range(120):
        for seq in range(rng.randint(1, 9)):
            start = rng.randint(0, 25)
            channel = rng.choice(["dict", "session", "llm", "ja_ginza", "sudachi"])
            rows.append((f"p{k}", seq, start, start + rng.randint(1, 7), "社名", channel, "x"))
    v = spark.createDataFrame(rows, "part_id string, seq int, start int, end int, category string, channel string, label string")
    want = {(r["part_id"], r["e_start"], r["e_end"]) for r in consensus.emitted(consensus.clusters(v)).collect()}
    p = spark.createDataFrame([(f"p{k}", "abcdefghij" * 4) for k in range(120)], "part_id string, text string")
    got = {(r["part_id"], r["start"], r["end"]) for r in consensus.resolved(v, p).collect()}
    assert got == want


def test_terms_beyond_a_worker_meet_by_joins(spark, monkeypatch):
    texts = ["iASのみ, iAS iASiAS", "IF-Xを使用 SONY Sony", "STS Sts sts SONY-", "社AB社A です", ""]
    rows = [{"canonical": x} for x in ("iAS", "IF-", "社A", "SONY", "SONY -", "です")] + [{"canonical": "STS", "case_sensitive": True}, {"canonical": "CB", "partial": True}]
    p, keys = parts(spark, *texts), channels.terms(entries(spark, *rows))
    both = []
    for limit in (100_000, 0):
        monkeypatch.setattr(channels, "HELD_TERMS", limit)
        both.append([sorted(map(tuple, find(p, keys).collect())) for find in (channels.dictionary_hits, channels.partial_hits, channels.cjk_substring_hits, channels.embedded_audit)])
    assert both[0] == both[1] and len(both[0][0]) > 5
    assert sorted(map(tuple, channels.dictionary_hits(channels.tokens(p), keys).collect())) == both[0][0]


def test_substring_of_half_width_and_cased_tokens(spark):
    got = hits(spark, ["ｴｸｽﾓｰｼｮﾝｵﾘｼﾞﾅﾙ を", "日本語a"], "cjk", {"canonical": "オリ"}, {"canonical": "日本", "case_sensitive": True})
    assert got == [["ｵﾘ"], ["日本"]]


def test_long_texts_are_masked_in_linear_time(spark):
    import time

    text = " ".join(f"w{k}@example.com" if k % 3 == 0 else f"word{k}" for k in range(20_000))
    p = spark.createDataFrame([("p", text, "b")], "part_id string, text string, bundle_id string")
    took = []
    for _ in range(2):  # the first run starts the workers
        began = time.time()
        c = channels.contacts(p).withColumn("bundle_id", F.lit("b")).withColumn("ordinal", F.struct("start", "end"))
        mapping = rewrite.numbered(c)
        out = rewrite.unmasked(rewrite.apply_mapping(p, mapping), mapping).select("masked_text", "restored").first()
        took.append(time.time() - began)
    assert out["restored"] == text and "@" not in out["masked_text"] and min(took) < 60


def test_a_bundle_over_two_batches_is_restored(spark, tmp_path):
    from veilspark.streaming.masking import mask_stream

    source, got = tmp_path / "in", []
    schema = "bundle_id string, part_id string, part_index int, text string"
    texts = [("b", "p0", 0, "SONY and Canon"), ("b", "p1", 1, "Nikon, Canon"), ("c", "p2", 0, "Nikon")]

    def sink(masked, mapping, number):
        got.append(([tuple(r) for r in masked.select("bundle_id", "part_id", "masked_text").collect()], mapping.select("bundle_id", "placeholder", "canonical").collect()))

    terms = entries(spark, *({"canonical": x} for x in ("SONY", "Canon", "Nikon")))
    for k in (0, 1):
        spark.createDataFrame(texts[k : k + 1] if k == 0 else texts[1:], schema).coalesce(1).write.mode("append").json(f"{source}")
        stream = mask_stream(spark.readStream.schema(schema).json(f"{source}"), terms, sink, f"file://{tmp_path}/check")
        stream.awaitTermination()
    masked = {p: t for rows, _ in got for _, p, t in rows}
    assert masked["p0"] == "[社1] and [社2]" and masked["p1"] == "[社3], [社2]" and masked["p2"] == "[社1]"
    names = {(r["bundle_id"], r["placeholder"]): r["canonical"] for _, m in got for r in m}
    assert names == {("b", "[社1]"): "SONY", ("b", "[社2]"): "Canon", ("b", "[社3]"): "Nikon", ("c", "[社1]"): "Nikon"}
