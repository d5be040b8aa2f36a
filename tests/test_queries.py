"""Queries on rows that their SQL leaves out or cannot say, against brute force."""

import re

import pytest

import __spark_entry__ as e
from veilspark.operators import channels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    texts = ["f(a)(b)[c]x", "((x))y", "a)(b", "HTTPServer ABc XMLHttp2 plain", "(a) (b)", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{top}/documents.parquet")
    turns = [(1, 0, "Ask Bartholomew"), (1, 1, ""), (1, 2, None), (2, 0, "")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, text string").write.parquet(f"{top}/conversations.parquet")
    return str(top), texts


def padded(text):
    out = ""
    for k, c in enumerate(text):
        out += " " * (c in "([{" and k > 0 and not text[k - 1].isspace()) + c + " " * (c in ")]}" and k + 1 < len(text) and not text[k + 1].isspace())
    return out


def test_bracket_pad(spark, tables):
    got = {r["doc_id"]: r["padded"] for r in e.queries()["bracket_pad"](spark, tables[0]).collect()}
    assert got == {k: padded(t) for k, t in enumerate(tables[1])}


def test_subword_counts(spark, tables):
    got = {r["surface"]: r["parts"] for r in e.queries()["subword_counts"](spark, tables[0]).collect()}
    words = {w for t in tables[1] for w in t.split()}
    assert got == {w: len(re.findall("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+", w)) for w in words}


def test_empty_turns(spark, tables):
    for name, column, first in (("bundle_masked", "masked_text", "Ask [人物1]"), ("bundle_unmask", "restored", "Ask Bartholomew")):
        got = {(r["bundle_id"], r["part_id"]): r[column] for r in e.queries()[name](spark, tables[0]).collect()}
        assert got == {(1, 0): first, (1, 1): "", (1, 2): "", (2, 0): ""}, name


def test_case_sensitive_hits_are_single_words_as_written(spark, tmp_path, monkeypatch):
    texts = ["Erin er. Eriner", "Er\niner The", "Ｔｈｅ The the", "Erinerß ßThe éThe ﬁLicense", "_The The- T-he The.", "TheThe The2 (The)", "Tʰe", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = re.compile("(?<![A-Za-z0-9_-])(?:Eriner|License|The)(?![A-Za-z0-9_-])")
    expected = sorted((k, m.start(), m.end(), m[0]) for k, t in enumerate(texts) for m in words.finditer(t or ""))
    for held in (channels.HELD_TERMS, 0):
        monkeypatch.setattr(channels, "HELD_TERMS", held)
        assert sorted(map(tuple, e.queries()["case_sensitive_hits"](spark, str(tmp_path)).collect())) == expected
