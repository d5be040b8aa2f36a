"""Requests, the registry's verbs, detectors, codecs and term tables."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_masking import entries
from veilspark.functions.scalars import content_hash
from veilspark.operators import audit, channels, consensus, detectors
from veilspark.operators.registry import Registry, full_audit
from veilspark.plans import service
from veilspark.sources import codecs, files

TABLE = "| 名前 | 会社 |\n| --- | --- |\n| 佐伯 | SONY |"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def registry(spark, tmp_path):
    return Registry(spark, f"file://{tmp_path}/registry")


def stored(spark, registry, *texts):
    docs = spark.createDataFrame([(f"n{k}", [t]) for k, t in enumerate(texts)], "name string, chunks array<string>")
    service.ingest(registry, docs)
    return [r[0] for r in docs.select(content_hash(F.col("chunks"))).collect()]


def test_requests_are_checked(spark):
    for given in ({}, {"text": "a", "parts": []}, {"parts": []}):
        with pytest.raises(ValueError):
            service.request(spark, **given)
    for bad in ([{"id": "a", "text": "x"}, {"id": "a", "text": "y"}], [{"id": "a"}], [{"id": "a", "text": "x", "content_hash": "h"}]):
        with pytest.raises(ValueError, match="'a'"):
            service.checked(service.request(spark, parts=bad))
    with pytest.raises(LookupError, match="not registered"):
        service.resolved(service.request(spark, parts=[{"id": "a", "content_hash": "h"}]))
    with pytest.raises(ValueError, match="level"):
        service.mask_request(service.request(spark, text="x"), level="all")


def test_mask_request(spark, registry, tmp_path):
    (h,) = stored(spark, registry, TABLE)
    (tmp_path / "memo.txt").write_text("Canon と SONY の件。")
    parts = service.request(spark, parts=[{"id": "a", "text": "SONY (Canon) a@example.com"}, {"id": "b", "content_hash": h}, {"id": "c", "file_path": str(tmp_path / "memo.txt")}])
    spans = spark.createDataFrame([('{"bundle_id":"_","part_id":"b"}', 7, 9, "Person")], "part_id string, start int, end int, ene_type string")
    out = service.mask_request(parts, entries(spark, {"canonical": "SONY"}, {"canonical": "Canon"}), registry, llm_spans=spans)
    assert rows_of(out["masked_parts"], "part_id", "masked_text") == [("a", "[社1] ([社2]) [連絡先1]"), ("b", TABLE.replace("SONY", "[社1]")), ("c", "[社2] と [社1] の件。")]
    assert rows_of(out["pending"], "surface", "confidence") == [("佐伯", "medium")]
    seen = out["pending"].first()
    assert [(o["part_id"], TABLE[o["start"] : o["end"]]) for o in seen["occurrences"]] == [("b", "佐伯")] and seen["votes"] == {"llm": "人名"}
    assert out["detector"].first()["status"] == "unconfirmed"
    texts = out["masked_parts"].select("bundle_id", F.col("masked_text").alias("text"))
    assert [r["restored"] for r in service.unmask_request(texts, out["mapping"]).orderBy("restored").collect()] == sorted(["SONY (Canon) a@example.com", TABLE, "Canon と SONY の件。"])


def test_analyze_and_apply(spark, registry):
    (h,) = stored(spark, registry, TABLE)
    parts = service.request(spark, parts=[{"id": "d", "content_hash": h}])
    terms = entries(spark, {"canonical": "SONY"})
    seen = service.analyze_request(parts, terms, registry)
    text = seen["text"].first()["text"]
    assert text == "名前、会社。\n佐伯、SONY。"
    group = seen["groups"].first()
    assert (group["surface"], group["confidence"], group["count"], group["votes"]) == ("SONY", "certain", 1, {"dict": "社名(辞書)"})
    spans = rows_of(seen["auto_selection"], "start", "end")
    assert [text[a:b] for a, b in spans] == ["SONY"] and [(o["start"], o["end"], o["confidence"]) for o in group["occurrences"]] == [(*spans[0], "certain")]
    none = spark.createDataFrame([], "bundle_id string, part_id string, start int, end int")
    for selection, want in ((seen["auto_selection"], TABLE.replace("SONY", "[社1]")), (none, TABLE)):
        assert service.apply_request(parts, selection, terms, registry)["masked_parts"].first()["masked_text"] == want


def test_documents_and_drafts(spark, registry):
    with pytest.raises(LookupError):
        registry.document("none")
    one, two = stored(spark, registry, "一つ目", "二つ目")
    assert registry.patch(one, source_kind="kb").first()["source_kind"] == "kb"
    with pytest.raises(ValueError):
        registry.patch(one, colour="red")
    assert registry.draft(one).first()["added"] == []
    saved = registry.save_draft(one, [(5, 7), (0, 2), (0, 2)], [(3, 4)]).first()
    assert [tuple(x) for x in saved["added"]] == [(0, 2), (5, 7)] and [tuple(x) for x in saved["removed"]] == [(3, 4)]
    ner = spark.createDataFrame([(h, "m", True, "text") for h in (one, two, "lost")], "content_hash string, model string, flatten boolean, text string")
    registry.put("ner", ner)
    with pytest.raises(ValueError):
        registry.delete_documents(ner.select("content_hash"), "unknown")
    drill = registry.delete_orphans()
    assert rows_of(drill, "content_hash", "layer", "rows") == [("lost", "ner", 1)] and registry.get("ner").count() == 3
    registry.delete_orphans(execute=True)
    assert rows_of(registry.get("ner"), "content_hash") == sorted([(one,), (two,)])
    registry.delete_documents(spark.createDataFrame([(two,)], "content_hash string"), "ner")
    assert rows_of(registry.get("documents"), "content_hash") == sorted([(one,), (two,)]) and rows_of(registry.get("ner"), "content_hash") == [(one,)]
    audit_rows = {r["content_hash"]: r for r in full_audit(registry.get("documents"), registry.get("ner"), spark.createDataFrame([("x", "v1", None)], "content_hash string, detector_version string, created_at timestamp"), registry.get("mask_draft")).collect()}
    assert audit_rows[one]["has_draft"] and audit_rows[one]["preview"] == "一つ目" and audit_rows[one]["ner_models"] == ["m"]
    assert not audit_rows["x"]["registered"] and audit_rows["x"]["llm_versions"] == ["v1"]
    registry.delete_documents(spark.createDataFrame([(one,)], "content_hash string"))
    assert rows_of(registry.get("documents"), "content_hash") == [(two,)] and registry.get("ner").count() == 0 and registry.get("mask_draft").count() == 0
    stored(spark, registry, "一つ目")
    assert registry.get("documents").count() == 2  # put again after a delete


def test_cached_detection(spark, registry):
    asked = spark.sparkContext.accumulator(0)

    def finder(text):
        asked.add(1)
        return [("Person", "佐伯"), ("Company", "アルファ"), ("Company", "アル"), ("Person", "不在"), ("Person", "不在")]

    docs = spark.createDataFrame([("h1", "アルファの佐伯。佐伯"), ("h2", "無し")], "content_hash string, text string")
    for cached in (False, True):
        got = {r["content_hash"]: r for r in detectors.cached_detect(registry, docs, finder, "m", "v1").collect()}
        assert [(s["start"], s["end"], s["ene_type"]) for s in got["h1"]["spans"]] == [(0, 4, "Company"), (5, 7, "Person"), (8, 10, "Person")]
        assert [tuple(x) for x in got["h1"]["not_found"]] == [("Person", "不在")] and got["h2"]["spans"] == [] and len(got["h2"]["not_found"]) == 4
        assert got["h1"]["cached"] == cached
    assert asked.value == 2
    assert not detectors.cached_detect(registry, docs, finder, "m", "v2").first()["cached"]
    assert not detectors.cached_detect(registry, docs, finder, "m", "v1", force=True).first()["cached"]


def test_retries():
    calls, waits = [], []

    def busy(times, after=None):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise detectors.Busy("busy", after)
            return "done"

        return call

    assert detectors.with_retry(busy(2), base_wait=2, throttle=0, pause=waits.append)() == "done" and waits == [2, 4]
    calls.clear(), waits.clear()
    assert detectors.with_retry(busy(1, 7.0), throttle=0.5, pause=waits.append)() == "done" and waits == [0.5, 7.0]
    calls.clear()
    with pytest.raises(detectors.Busy):
        detectors.with_retry(busy(9), retries=5, throttle=0, pause=lambda _: None)()
    assert len(calls) == 6


def test_codecs_keep_what_they_write(spark):
    spans, missing = [(0, 2, 'a"b', None, "exact")], [("Person", "x\\y\n")]
    d = spark.createDataFrame([(spans, missing)], "s array<struct<start:int,end:int,ene_type:string,reason:string,how:string>>, n array<struct<ene_type:string,surface:string>>")
    text = d.select(codecs.detection_to_json(F.col("s"), F.col("n"), F.lit("m"), F.lit("v")).alias("j"))
    assert json.loads(text.first()["j"]) == {"model": "m", "detector_version": "v", "spans": [[0, 2, 'a"b', None, "exact"]], "not_found": [["Person", "x\\y\n"]]}
    back = text.select(codecs.detection_from_json(F.col("j")).alias("d")).first()["d"]
    assert [tuple(x) for x in back["spans"]] == spans and [tuple(x) for x in back["not_found"]] == missing
    toks, found = [(0, 1, "社", "名詞", "NOUN")], [("社", "Company", 0, 1)]
    a = spark.createDataFrame([("社", "|社|", [1], toks, found)], "t string, o string, m array<int>, k array<struct<start:int,end:int,surface:string,tag:string,pos:string>>, e array<struct<text:string,label:string,start:int,end:int>>")
    text = a.select(codecs.analysis_to_json(*map(F.col, "tomke")).alias("j"))
    assert json.loads(text.first()["j"])["tokens"] == [[0, 1, "社", "名詞", "NOUN"]]
    back = text.select(codecs.analysis_from_json(F.col("j")).alias("d")).first()["d"]
    assert [tuple(x) for x in back["tokens"]] == toks and [tuple(x) for x in back["entities"]] == found and back["offset_map"] == [1]


def test_rows_become_entries(spark):
    rows = [(2, "アルファ", "Company", "yes", ""), (3, "ｱﾙﾌｧ", "社名", "", ""), (4, "STS", "何か", "多分", "○"), (5, " ", "Person", "", "")]
    got, warnings = codecs.entries_of_rows(spark.createDataFrame(rows, "row int, term string, kind string, partial string, case_sensitive string"))
    assert rows_of(got, "canonical", "category", "partial", "case_sensitive") == [("STS", "商標", False, True), ("アルファ", "社名", True, False)]
    assert rows_of(warnings, "row", "about") == [(4, "kind"), (4, "partial")]


def test_judgements_go_on_where_they_stopped(spark, tmp_path):
    g = spark.createDataFrame([(1, "甲"), (2, "乙"), (3, "丙")], "row int, term string")

    def fails(terms):
        if "乙" in terms:
            raise RuntimeError("busy")
        return {"甲": ("不要", "高", "", "general"), "丙": ("要マスク", "高", "社名", "name")}

    first = {r["term"]: r["mask"] for r in audit.judged(g.coalesce(1), fails, str(tmp_path), batch=1).collect()}
    assert first == {"甲": "不要", "乙": "要確認", "丙": "要マスク"}
    out = audit.by_judgement(audit.judged(g, lambda t: {x: ("要確認", "中", "", "") for x in t}, str(tmp_path))).collect()
    assert [(r["term"], r["mask"], r["certain"]) for r in out] == [("丙", "要マスク", True), ("乙", "要確認", False), ("甲", "不要", False)]


def test_entities_tokens_and_scans(spark):
    p = spark.createDataFrame([("a", "佐伯 SONY"), ("b", None)], "part_id string, text string")
    found = detectors.entities(p, "m", lambda texts: [[("Person", 0, 2), ("Date", 3, 4)] if t else [] for t in texts], labels=["Person"])
    assert rows_of(found, "part_id", "label", "surface") == [("a", "Person", "佐伯")]
    seen = detectors.token_debug(channels.tokens(p, keep_spaces=True), found)
    assert rows_of(seen, "surface", "label", "iob") == [("SONY", "", "O"), ("佐伯", "Person", "B")]
    names = spark.createDataFrame([("HTTPServer設計書",), ("server plan",), ("サーバ",)], "name string")
    terms = spark.createDataFrame([("Server",), ("設計",), ("ｻｰﾊﾞ",), ("plan server",), ("",)], "term string")
    assert [tuple(r) for r in channels.feature_scan(names, terms).collect()] == [("Server", 2), ("設計", 1), ("ｻｰﾊﾞ", 1)]
    keys = channels.terms(entries(spark, {"canonical": "IAS", "partial": True}))
    assert rows_of(channels.contains_partial(spark.createDataFrame([("IASMap",), ("biases",)], "surface string"), keys), "surface") == [("IASMap",)]
    votes = spark.createDataFrame([([("llm", "City"), ("ja_ginza", "Person"), ("sudachi", "名詞-固有名詞-地名-一般"), ("dict", "社名(辞書)")],)], f"votes {consensus.VOTES}")
    assert votes.select(consensus.system_votes(F.col("votes"))).first()[0] == {"ner": "人名", "llm": "地名"}


def test_display_and_sinks(spark, tmp_path):
    p = spark.createDataFrame([("a", "佐伯 SONY")], "part_id string, text string")
    spans = spark.createDataFrame([("a", 3, 7, "Company"), ("a", 0, 2, "person"), ("a", 4, 6, "x")], "part_id string, start int, end int, label string")
    assert [(e["start"], e["label"]) for e in files.display_data(p, spans).first()["ents"]] == [(0, "person"), (3, "Company")]
    assert rows_of(files.with_colours(spans, {"PERSON": "#fff"}), "label", "colour") == [("Company", "#dcdcdc"), ("person", "#fff"), ("x", "#dcdcdc")]
    files.write_rows(spark.createDataFrame([("a\nb", 1)], "t string, n int"), f"{tmp_path}/out.csv")
    raw = [f.read_bytes() for f in (tmp_path / "out.csv").glob("part-*.csv")]
    assert "﻿t,n\na b,1\n".encode() in raw
    files.write_rows(spark.createDataFrame([("a\nb", 1)], "t string, n int"), f"{tmp_path}/out.json")
    assert [json.loads(x) for f in (tmp_path / "out.json").glob("part-*.json") for x in f.read_text().splitlines()] == [{"t": "a b", "n": 1}]
