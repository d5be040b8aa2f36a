"""What grows with the input: rows of joins, texts in shuffles, tables in the shared folder."""

import os
import random

import pytest

from tests.llm.test_operators import frame, prose
from veilspark.llm import jaccard, suffixdedup
from veilspark.shared import shared_dir


def join_rows(spark, since, what):
    """Rows that joins whose plan holds ``what`` made in the executions from ``since`` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    for k in range(since, store.executionsCount()):
        e = store.executionsList().apply(k)
        nodes, values = store.planGraph(e.executionId()).allNodes(), store.executionMetrics(e.executionId())
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and what in node.desc():
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


@pytest.fixture(scope="module")
def relatives():
    """Texts of 1,400 words of which any two share about seven tenths of their shingles, too few for a link."""
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1400)).split()
    out = []
    for k in range(16):
        own = list(base)
        for i in rng.sample(range(len(own)), 32):
            own[i] = f"own{k}x{i}"
        out.append(" ".join(own))
    return out


def test_long_relatives_meet_a_few_times(spark, relatives):
    store = spark._jsparkSession.sharedState().statusStore()
    since = store.executionsCount()
    docs = frame(spark, list(enumerate(relatives)))
    found = {r["component_id"] for r in jaccard.link_components(docs).collect()}
    assert len(found) == len(relatives)
    pairs = len(relatives) * (len(relatives) - 1) // 2
    made = join_rows(spark, since, "NOT (c#")
    assert 0 < made < 20 * pairs, made


@pytest.mark.parametrize("first, known", [(1, 64), (4, 0), (4, 1), (10**9, 64)])
def test_parts_of_buckets_lose_no_pair(spark, monkeypatch, first, known):
    monkeypatch.setattr(jaccard, "FIRST", first)
    monkeypatch.setattr(jaccard, "KNOWN", known)
    rng = random.Random(2)
    sets = {s: rng.sample(range(40), 12) for s in range(-6, 6)}
    sets[7] = [1000]
    zero = ", ".join(f"k{i} bigint" for i in range(8))
    met = spark.createDataFrame([(sig * 7919, s, -1 if s == 7 else 3, s // 2, 5000 + abs(s), True, rng.random() < 0.7, *[0] * 8) for s, sigs in sets.items() for sig in sigs], f"sig bigint, s bigint, slack int, c bigint, n bigint, own boolean, asks boolean, {zero}")
    rows = met.collect()
    want = {(min(x.s, y.s), max(x.s, y.s)) for x in rows for y in rows if x.asks and x.sig == y.sig and x.c != y.c and ((y.n, y.s) < (x.n, x.s) or y.slack < 0)}
    found = [tuple(r) for r in jaccard.meeting_pairs(met).collect()]
    assert want and sorted(found) == sorted(want)


def test_near_copies_leave_no_tables_of_steps(spark):
    there = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(there))
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(12)]
    docs = frame(spark, list(enumerate(base + [b + " and a few words more" for b in base])))
    assert jaccard.distinct_documents(docs).count() == 12
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(there)) - before}
    assert not left & {"buckets", "placed", "open", "met", "meeting", "pairs", "meeting-sets", "meeting-rows", "meeting-shingles"}


def test_least_set_of_a_bucket_that_spans_batches(spark):
    rng = random.Random(6)
    base = [prose(rng, 30) for _ in range(3)]
    docs = frame(spark, list(enumerate(f"{b} {prose(rng, 6)}" for b in base for _ in range(30)))).selectExpr("doc_id as _veil_rid", "text")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        rows = jaccard.bucket_rows(docs, [jaccard.Band(0, 4, 10**6, 12, 6)]).collect()
    finally:
        spark.conf.set(name, before)
    least = {}
    for r in rows:
        least[r.sig] = min(least.get(r.sig, r.s), r.s)
    assert rows and all(r.least == least[r.sig] for r in rows)


def test_spans_of_a_text_are_runs(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(300))
    docs = frame(spark, [(k, f"{k} {passage} {prose(rng, 30)}") for k in range(6)]).selectExpr("doc_id as _veil_rid", "text")
    for r in suffixdedup.repeated_spans(docs).collect():
        spans = [(x.lo, x.hi) for x in r.spans]
        assert spans and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
