"""Scalar functions on columns. All but the Unicode normalisers are built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilspark import model as M


# ---- normalisation: Spark has neither NFKC nor case folding, so these are Arrow UDFs ----


def fold(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", text).casefold())


def fold_case_kept(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))


@F.pandas_udf(StringType())
def normalize(s: pd.Series) -> pd.Series:
    """NFKC, case-folded, without white space."""
    return s.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def normalize_case_kept(s: pd.Series) -> pd.Series:
    return s.map(fold_case_kept, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def allow_key(surface: Column) -> Column:
    """Key of an allowlist entry: white space runs are one, then as a dictionary key."""
    return normalize(F.trim(F.regexp_replace(surface, r"(?U)\s+", " ")))


# ---- shapes of surfaces ----


def looks_like_code(surface: Column) -> Column:
    """Whether a surface has a shape that names of persons and companies do not have."""
    s = F.btrim(surface, F.lit(M.EDGE_QUOTES))
    sep = re.escape(M.CJK_SEPARATORS)
    balanced = F.regexp_count(s, F.lit(r"[(（]")) == F.regexp_count(s, F.lit(r"[)）]"))
    return (
        s.rlike(M.CODE_MARKER)
        | ~s.rlike(M.NAME_CHAR)
        | s.rlike(M.ASCII_DIGIT_CODE)
        | s.rlike(f"[A-Za-z][{sep}]|[{sep}][A-Za-z]")
        | s.rlike(M.DANGLING)
        | ~balanced
        | ((F.length(s) == 1) & ~s.rlike(M.KANJI))
    )


def looks_like_nonperson_latin(surface: Column) -> Column:
    """Latin words without any Japanese letter, not all of them in title case."""
    words = F.regexp_extract_all(surface, F.lit("[A-Za-z]+"), F.lit(0))
    odd = F.exists(words, lambda w: ~w.rlike("^[A-Z][a-z]*$"))
    return ~surface.rlike(M.JP_LETTER) & (F.size(words) > 0) & odd


def is_jargon_caps(surface: Column) -> Column:
    return surface.rlike(r"^[\x00-\x7F]*$") & surface.rlike("[A-Z]") & ~surface.rlike("[a-z]")


def has_separator(surface: Column) -> Column:
    return surface.rlike("[" + re.escape(M.SEPARATORS) + "]")


def is_cjk(surface: Column) -> Column:
    return surface.rlike(r"^[぀-ヿ㐀-鿿豈-﫿]+$")


def subwords(surface: Column) -> Column:
    """Parts of an identifier: capital runs, title-case and lower-case words, digits."""
    return F.regexp_extract_all(surface, F.lit(M.SUBWORD), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit("[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(words, lambda w: F.lower(w))


def is_abbreviation(term: Column) -> Column:
    """Without spaces, of identifier characters, not in title case, a core of up to ten, with a capital or digit."""
    core = F.regexp_replace(term, "[^A-Za-z0-9]", "")
    return term.rlike(r"^[A-Za-z0-9_.\-/]+$") & ~term.rlike("^[A-Z][a-z]+$") & (F.length(core) <= 10) & (F.length(core) > 0) & term.rlike("[A-Z0-9]")


def expand_terms(term: Column) -> Column:
    """A term, its form without parentheses, the alternatives inside them, and parts of an identifier list."""
    bare = F.trim(F.regexp_replace(term, r"[(（][^)）]*[)）]", ""))
    inner = F.flatten(F.transform(F.regexp_extract_all(term, F.lit(r"[(（]([^)）]*)[)）]"), F.lit(1)), lambda x: F.split(x, "[,、/]")))
    listed = F.when(term.rlike(r"^[A-Za-z0-9_]+(\s*,\s*[A-Za-z0-9_]+)+$"), F.split(term, ",")).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.trim(term), bare), inner, listed)
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))


# ---- categories, levels, small codecs ----


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def vote_category(channel: Column, label: Column) -> Column:
    pos = F.lit(None).cast("string")
    for prefix, category in reversed(M.POS_CATEGORY.items()):
        pos = F.when(F.startswith(label, F.lit(prefix)), category).otherwise(pos)
    stem = F.nullif(F.substring_index(label, "(", 1), F.lit(""))
    return (
        F.when(channel.isin("dict", "session"), stem)
        .when(channel == "regex", F.nullif(label, F.lit("")))
        .when(channel == "llm", _lookup(label, M.LLM_CATEGORY))
        .when(channel == "sudachi", pos)
        .otherwise(_lookup(F.upper(label), M.NER_CATEGORY))
    )


def category_rank(category: Column) -> Column:
    out = F.lit(99)
    for k, v in enumerate(M.CATEGORIES):
        out = F.when(category == v, F.lit(k)).otherwise(out)
    return out


def category_of_rank(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in enumerate(M.CATEGORIES):
        out = F.when(rank == k, F.lit(v)).otherwise(out)
    return out


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(0)
    for k, v in M.CONFIDENCE_RANK.items():
        out = F.when(confidence == k, F.lit(v)).otherwise(out)
    return out


def to_wire(confidence: Column) -> Column:
    return F.coalesce(_lookup(confidence, M.CONFIDENCE_WIRE), confidence)


def from_wire(level: Column) -> Column:
    return F.coalesce(_lookup(level, {v: k for k, v in M.CONFIDENCE_WIRE.items()}), level)


def levels_at_or_above(level: str) -> list[str]:
    """Confidences that a mask level selects; excluded never is one."""
    names = {v: k for k, v in M.CONFIDENCE_WIRE.items() if v != "excluded"}
    if level not in names:
        raise ValueError(f"unknown mask level: {level}")
    least = M.CONFIDENCE_RANK[names[level]]
    return [k for k, v in M.CONFIDENCE_RANK.items() if v >= least and v >= 0]


def decided_by(votes: Column) -> Column:
    """Which evidence settled a candidate, from its array of (channel, label)."""
    has = lambda c: F.exists(votes, lambda v: v["channel"] == c)
    ner = F.exists(votes, lambda v: ~v["channel"].isin(*M.DECISIVE, "llm", "collected"))
    return (
        F.when(has("dict"), "dict")
        .when(has("regex"), "regex")
        .when(ner & has("llm"), "consensus")
        .when(has("llm"), "llm")
        .when(has("session"), "session")
        .otherwise("ner")
    )


def placeholder_prefix(category: Column) -> Column:
    return F.coalesce(_lookup(category, M.PLACEHOLDER_PREFIX), F.lit("語"))


def content_hash(chunks: Column) -> Column:
    """SHA-256 over the chunks, each followed by a NUL."""
    return F.sha2(F.concat_ws("", F.transform(chunks, lambda c: F.concat(c, F.lit("\x00")))), 256)


def detector_version(static: str, max_tokens: int = 15_000, overlap: int = 0, target: str = "") -> Column:
    return F.lit(f"{static}|win{max_tokens}ov{overlap}|tgt{target}")


def context_snippet(text: Column, start: Column, end: Column, width: int = 20) -> Column:
    lo = F.greatest(start - width, F.lit(0))
    hi = F.least(end + width, F.length(text))
    left, right = F.when(lo > 0, "…").otherwise(""), F.when(hi < F.length(text), "…").otherwise("")
    part = lambda a, b: F.substring(text, a + 1, b - a)
    return F.concat(left, part(lo, start), F.lit("《"), part(start, end), F.lit("》"), part(end, hi), right)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, width: int = 60) -> Column:
    flat = one_line(text)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("…"))).otherwise(flat)


def proper_noun_subtype(tag: Column) -> Column:
    parts = F.split(tag, "-")
    at = F.array_position(parts, "固有名詞")
    return F.when(at > 0, F.get(parts, at.cast("int")))


def parse_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "yes", "y", "on", "○", "はい")


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
