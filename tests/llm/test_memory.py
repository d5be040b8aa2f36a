"""What tasks hold at once, where executors have little memory beside the JVM's."""

import tracemalloc

import numpy as np
import pyarrow as pa

from veilspark.llm import common, suffixdedup, toxicity

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    before = spark.conf.get(ROWS)
    with common.small_batches(spark, 10):
        got = [r["n"] for r in spark.range(0, 95, 1, 1).mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) == 95 and max(got) == 10 and spark.conf.get(ROWS) == before


def test_repeats_read_texts_in_small_batches(spark, monkeypatch):
    seen, plain = {}, suffixdedup.written
    monkeypatch.setattr(suffixdedup, "written", lambda df, label: seen.update({label: int(spark.conf.get(ROWS))}) or plain(df, label))
    passage = "".join(map(str, range(150)))
    docs = spark.createDataFrame([(1, "a" + passage), (2, "b" + passage), (3, None)], "doc_id bigint, text string")
    assert [r["n_removed"] for r in suffixdedup.report(docs).orderBy("doc_id").collect()] == [len(passage), len(passage), 0]
    assert max(seen[k] for k in ("busy", "marks", "stretches")) <= 1000


def test_repeats_scan_little_at_once():
    text = np.random.default_rng(7).integers(97, 123, 2_000, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text] * 2_000)})
    tracemalloc.start()
    for piece in suffixdedup._each_piece([batch], "text"):
        suffixdedup.stretch_ids(suffixdedup.segments(*common.string_bytes(piece.column(0)))[5])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000


def test_toxicity_scores_little_at_once(monkeypatch):
    rng = np.random.default_rng(7)
    words = np.array([rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode() for n in rng.integers(3, 10, 200_000)])
    texts = [" ".join(rng.choice(words, 100)) for _ in range(4_000)]

    class Docs:  # takes the function that tasks run
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda p: type("B", (), {"value": p}))})})
        schema = None
        mapInArrow = staticmethod(lambda run, schema: run)

    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *_, **__: toxicity.Network())
    run = toxicity.without_toxic(Docs, None, threshold=2.0)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    tracemalloc.start()
    rows = sum(b.num_rows for b in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 66_000_000
