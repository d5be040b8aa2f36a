"""Text preparation: tables, brackets, paragraphs, bodies with offset maps, segments, windows, splitters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import model as M

PIECE_BYTES = 40_000
BODY = "text string, original_text string, offset_map array<int>"

# ---- built-in forms, for texts alone ----


def flatten_tables(text: Column) -> Column:
    """Rows of Markdown tables become sentences of their cells; ruler rows go; other lines stay."""

    def cells(line: Column) -> Column:
        parts = F.transform(F.split(line, r"\|"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
        return F.filter(parts, lambda c: c != "")

    def flat(line: Column) -> Column:
        row = cells(line)
        return F.when(~F.contains(line, F.lit("|")), line).when(F.size(row) == 0, "").otherwise(F.concat(F.array_join(row, M.CELL_JOINER), F.lit(M.ROW_END)))

    def ruler(line: Column) -> Column:
        row = cells(line)
        return F.contains(line, F.lit("|")) & (F.size(row) > 0) & F.forall(row, lambda c: c.rlike("^:?-+:?$"))

    return F.array_join(F.transform(F.filter(F.split(text, "\n", -1), lambda x: ~ruler(x)), flat), "\n")


def pad_brackets(text: Column) -> Column:
    """A space before an opening and after a closing bracket that touches something."""
    o, c = re.escape(M.BRACKET_OPEN), re.escape(M.BRACKET_CLOSE)
    text = F.regexp_replace(text, f"(?<=[{c}])(?=[{o}])", "  ")
    text = F.regexp_replace(text, rf"(?U)(?<=\S)(?=[{o}])", " ")
    return F.regexp_replace(text, rf"(?U)(?<=[{c}])(?=\S)", " ")


def clean_pdf(text: Column) -> Column:
    """Joins broken lines, keeps paragraphs, evens out bullets, numbers and spaces."""
    text = F.regexp_replace(text, "(?<![。！？.!?])\n(?!\n)", " ")
    text = F.regexp_replace(text, "\n{2,}", "\n\n")
    text = F.regexp_replace(text, "(?U)\n([•\\-–])\\s*", "\n$1 ")
    text = F.regexp_replace(text, "(?U)\n(\\d+(?:\\.\\d+)*\\.)\\s*", "\n$1 ")
    return F.regexp_replace(F.regexp_replace(text, " +", " "), r"(?U)^\s+|\s+$", "")


def compose_maps(outer: Column, inner: Column) -> Column:
    return F.transform(inner, lambda j: F.when(j == -1, F.lit(-1)).otherwise(F.get(outer, j)))


def back_project(start: Column, end: Column, offset_map: Column) -> Column:
    """The original span of a span in prepared text; null where all its characters were inserted."""
    kept = F.filter(F.slice(offset_map, start + 1, end - start), lambda x: x != -1)
    return F.when(F.size(kept) > 0, F.struct(F.get(kept, F.lit(0)).alias("start"), (F.get(kept, F.size(kept) - 1) + 1).alias("end")))


def segments(text: Column) -> Column:
    """Non-blank parts between blank lines: array of (start, end, tokens), a token being a character."""
    parts = F.split(text, M.CHUNK_SEPARATOR, -1)
    step = lambda done, p: F.struct(
        (done["at"] + F.length(p) + 2).alias("at"),
        F.when(F.regexp_replace(p, r"(?U)\s+", "") == "", done["out"])
        .otherwise(F.concat(done["out"], F.array(F.struct(done["at"].alias("start"), (done["at"] + F.length(p)).alias("end"), F.length(p).alias("tokens")))))
        .alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,tokens:int>>").alias("out"))
    return F.aggregate(parts, zero, step, lambda done: done["out"])


def windows(text: Column, max_tokens: int = 15_000, overlap: int = 0) -> Column:
    """Greedy packing of segments into windows of up to ``max_tokens``; a larger segment stands alone.

    With ``overlap``, a window but the first reaches back over whole segments until these hold that many tokens.
    """
    segs = segments(text)
    empty = F.array().cast("array<struct<a:int,b:int>>")
    pack = lambda s, x: F.struct(
        (s["i"] + 1).alias("i"),
        F.when(s["i"] == 0, x["tokens"]).when(s["tok"] + x["tokens"] <= max_tokens, s["tok"] + x["tokens"]).otherwise(x["tokens"]).alias("tok"),
        F.when(s["i"] == 0, F.lit(0)).when(s["tok"] + x["tokens"] <= max_tokens, s["a"]).otherwise(s["i"]).alias("a"),
        F.when((s["i"] > 0) & (s["tok"] + x["tokens"] > max_tokens), F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), (s["i"] - 1).alias("b"))))).otherwise(s["out"]).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("tok"), F.lit(0).alias("a"), empty.alias("out"))
    done = lambda s: F.when(s["i"] == 0, empty).otherwise(F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), (s["i"] - 1).alias("b")))))
    groups = F.aggregate(segs, zero, pack, done)

    def first(g: Column, k: Column) -> Column:
        if overlap <= 0:
            return g["a"]
        back = F.aggregate(
            F.reverse(F.slice(segs, F.lit(1), g["a"])),
            F.struct(g["a"].alias("i"), F.lit(0).alias("acc")),
            lambda s, x: F.when(s["acc"] < overlap, F.struct((s["i"] - 1).alias("i"), (s["acc"] + x["tokens"]).alias("acc"))).otherwise(s),
            lambda s: s["i"],
        )
        return F.when(k == 0, g["a"]).otherwise(back)

    return F.transform(groups, lambda g, k: F.struct(F.get(segs, first(g, k))["start"].alias("start"), F.get(segs, g["b"])["end"].alias("end")))


def resolve_overlaps(spans: Column) -> Column:
    """Spans not inside another one (the earlier of equals), in order of (start, longest first)."""
    real = F.filter(spans, lambda s: s["start"] < s["end"])
    order = F.array_sort(F.transform(real, lambda s: F.struct((s["start"] - s["end"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    kept = F.aggregate(
        F.transform(order, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when(F.exists(out, lambda k: (k["start"] <= s["start"]) & (s["end"] <= k["end"])), out).otherwise(F.concat(out, F.array(s))),
    )
    by_start = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("k"))))
    return F.transform(by_start, lambda s: F.struct(s["start"].alias("start"), (-s["k"]).alias("end")))


def split_on_separators(text: Column, start: Column, end: Column) -> Column:
    """Non-empty parts of a span between 、 。 and line ends: array of (start, end)."""
    parts = F.split(F.substring(text, start + 1, end - start), "[、。\n]", -1)
    step = lambda s, p: F.struct(
        (s["at"] + F.length(p) + 1).alias("at"),
        F.when(p == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(p)).alias("end"))))).alias("out"),
    )
    return F.aggregate(parts, F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), step, lambda s: s["out"])


# ---- kernels that carry an offset map ----


def _flatten_with_map(text: str) -> tuple[str, list[int]]:
    lines, at = [], 0
    for line in text.split("\n"):
        if "|" not in line:
            lines.append([(ch, at + i) for i, ch in enumerate(line)])
        else:
            cells, pos = [], at
            for cell in line.split("|"):
                lead = len(cell) - len(cell.lstrip())
                body = cell.strip()
                if body:
                    cells.append([(ch, pos + lead + i) for i, ch in enumerate(body)])
                pos += len(cell) + 1
            if not cells or not all(re.fullmatch(":?-+:?", "".join(ch for ch, _ in c)) for c in cells):
                row: list[tuple[str, int]] = []
                for k, cell in enumerate(cells):
                    row += ([(M.CELL_JOINER, -1)] if k else []) + cell
                lines.append(row + [(M.ROW_END, -1)] if cells else [])
        at += len(line) + 1
    out: list[tuple[str, int]] = []
    for k, line in enumerate(lines):
        out += ([("\n", -1)] if k else []) + line
    return "".join(ch for ch, _ in out), [p for _, p in out]


def _pad_with_map(text: str) -> tuple[str, list[int]]:
    out, where = [], []
    for i, ch in enumerate(text):
        if ch in M.BRACKET_OPEN and i and not text[i - 1].isspace():
            out.append(" ")
            where.append(-1)
        out.append(ch)
        where.append(i)
        if ch in M.BRACKET_CLOSE and i + 1 < len(text) and not text[i + 1].isspace():
            out.append(" ")
            where.append(-1)
    return "".join(out), where


def byte_safe_pieces(text: str, limit: int = PIECE_BYTES) -> list[str]:
    """``text`` in parts of up to ``limit`` UTF-8 bytes, cut between lines where that suffices."""
    if len(text.encode()) <= limit:
        return [text]
    out, held, size = [], "", 0
    for line in text.splitlines(keepends=True):
        n = len(line.encode())
        if size + n > limit and held:
            out.append(held)
            held, size = "", 0
        if n <= limit:
            held, size = held + line, size + n
            continue
        for ch in line:
            m = len(ch.encode())
            if size + m > limit:
                out.append(held)
                held, size = "", 0
            held, size = held + ch, size + m
    return [*out, held] if held else out


def build_body(chunks: list[str], flatten: bool = True) -> tuple[str, str, list[int]]:
    """Prepared text, original text, and for each prepared character its original place (-1: inserted)."""
    text, original, where = "", "", []
    for chunk in chunks:
        for piece in byte_safe_pieces(chunk):
            flat, first = _flatten_with_map(piece) if flatten else (piece, list(range(len(piece))))
            padded, second = _pad_with_map(flat)
            if not padded.strip():
                continue
            if where:
                where += [len(original), len(original) + 1]
                text, original = text + M.CHUNK_SEPARATOR, original + M.CHUNK_SEPARATOR
            where += [-1 if j == -1 or first[j] == -1 else first[j] + len(original) for j in second]
            text, original = text + padded, original + piece
    return text, original, where


def body(chunks: Column, flatten: bool = True) -> Column:
    """struct(text, original_text, offset_map) of an array of chunks."""

    @F.pandas_udf(BODY)
    def build(s: pd.Series) -> pd.DataFrame:
        rows = [build_body([c for c in (x if x is not None else []) if c is not None], flatten) for x in s]
        return pd.DataFrame(rows, columns=["text", "original_text", "offset_map"])

    return build(chunks)


# ---- splitters ----

DEFAULT_SEPARATORS = ["\n\n", "\n", "(?<=[。！？])", r"\. ", "! ", r"\? ", " ", ""]
PDF_SEPARATORS = ["\n\n\n", "\n\n", "(?<=[。！？])", r"\. ", "! ", r"\? ", " ", ""]
EXCEL_SEPARATORS = ["\n", r"\|", ""]


def recursive_split(text: str, separators: list[str], size: int, overlap: int, length: Callable[[str], int] = len) -> list[str]:
    """The published recursive procedure: split at the first separator that occurs, merge up to ``size``, recurse."""
    at = next((k for k, s in enumerate(separators) if s == "" or re.search(s, text)), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep == "":
        parts = list(text)
    else:
        cut = re.split(f"({sep})", text)
        parts = [p for p in [cut[0], *(a + b for a, b in zip(cut[1::2], cut[2::2]))] if p]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        out.extend(_merge(held, size, overlap, length))
        held.clear()

    for p in parts:
        if length(p) < size:
            held.append(p)
            continue
        flush()
        out.extend(recursive_split(p, rest, size, overlap, length) if rest else [p])
    flush()
    return [o for o in out if o]


def _merge(parts: list[str], size: int, overlap: int, length: Callable[[str], int]) -> Iterator[str]:
    held: list[str] = []
    total = 0
    for p in parts:
        n = length(p)
        if held and total + n > size:
            if text := "".join(held).strip():
                yield text
            while held and (total > overlap or total + n > size):
                total -= length(held.pop(0))
        held.append(p)
        total += n
    if text := "".join(held).strip():
        yield text


def markdown_sections(text: str, size: int, length: Callable[[str], int] = len) -> list[tuple[str, dict[str, str]]]:
    """Sections under their headings, packed while they fit; each with its headings as metadata."""
    sections: list[tuple[list[tuple[int, str]], str]] = []
    heads: list[tuple[int, str]] = []
    lines: list[str] = []

    def close() -> None:
        if content := "\n".join(lines).strip():
            sections.append((list(heads), content))
        lines.clear()

    for line in text.split("\n"):
        m = re.match(r"^(#{1,9})\s+(.*)$", line)
        if not m:
            lines.append(line)
            continue
        close()
        level = len(m[1])
        heads[:] = [h for h in heads if h[0] < level] + [(level, m[2].strip())]
    close()
    out: list[tuple[str, dict[str, str]]] = []
    held, meta, before = "", {}, []
    for path, content in sections:
        shared = 0
        while held and shared < min(len(before), len(path)) and before[shared] == path[shared]:
            shared += 1
        piece = "\n".join([*(f"{'#' * n} {h}" for n, h in path[shared:]), content])
        if held and len(held) + 2 + len(piece) <= size:
            held = f"{held}\n\n{piece}"
        else:
            if held:
                out.append((held, meta))
            held = "\n".join([*(f"{'#' * n} {h}" for n, h in path), content])
            meta = {f"h{n}": h for n, h in path}
        before = path
    if held:
        out.append((held, meta))
    return [(t, m) for text, m in out for t in (recursive_split(text, DEFAULT_SEPARATORS, size, 0, length) if len(text) > size else [text])]


SPLITTERS = {
    "md": lambda t: [x for x, _ in markdown_sections(t, 800)],
    "docx": lambda t: [x for x, _ in markdown_sections(t, 800)],
    "pdf": lambda t: recursive_split(t, PDF_SEPARATORS, 900, 50),
    "xlsx": lambda t: recursive_split(t, EXCEL_SEPARATORS, 900, 0),
    "xls": lambda t: recursive_split(t, EXCEL_SEPARATORS, 900, 0),
    "xlsm": lambda t: recursive_split(t, EXCEL_SEPARATORS, 900, 0),
}


def split_text(file_type: Column, text: Column) -> Column:
    """Chunks of a text by the splitter of its file type (the default one for other types)."""

    @F.pandas_udf("array<string>")
    def run(kind: pd.Series, s: pd.Series) -> pd.Series:
        default = lambda t: recursive_split(t, DEFAULT_SEPARATORS, 900, 50)
        return pd.Series([SPLITTERS.get((k or "").lower().lstrip("."), default)(t) if t else [] for k, t in zip(kind, s)])

    return run(file_type, F.when(F.lower(file_type) == "pdf", clean_pdf(text)).otherwise(text))
