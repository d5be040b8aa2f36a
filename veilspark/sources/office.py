"""Readers of zipped office files by the standard library: texts to Markdown, sheets to tables, slides to text.

Each takes a file's bytes and returns the texts of its documents, sheets or slides. Broken files raise ValueError.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

# Fixed values of the formats: styles by name, and what stands for pictures, tables and notes.
HEADINGS = {"Title": 1, "Subtitle": 2} | {f"Heading {n}": n for n in range(1, 10)}
LISTS = {f"List{kind}{level}" for kind in ("", " Bullet", " Continue", " Number") for level in ("", " 2", " 3")} | {"List Paragraph"}
PICTURE_IN_TEXT, PICTURE_ON_SLIDE, NOTES = "[画像]", "[Image]", "[SLIDE NOTES]"
BAND = 8000  # slide units: shapes whose tops round to one multiple are read from the left


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _all(element: ElementTree.Element | None, name: str):
    return [] if element is None else [x for x in element.iter() if _name(x) == name]


def _one(element: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for step in path:
        element = None if element is None else next((x for x in element if _name(x) == step), None)
    return element


def _value(element: ElementTree.Element | None, name: str, default: str | None = None) -> str | None:
    if element is None:
        return default
    return next((v for k, v in element.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


class _Package:
    """The parts of a zipped file and the relations between them."""

    def __init__(self, raw: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile as e:
            raise ValueError("not an office file, or a broken one") from e
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except (ElementTree.ParseError, zipfile.BadZipFile) as e:
            raise ValueError(f"broken part: {name}") from e

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Id to (kind, target) of a part; targets inside the file are full names."""
        folder, base = posixpath.split(name)
        out = {}
        for r in _all(self.xml(f"{folder}/_rels/{base}.rels"), "Relationship"):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = r.get("Type", "").rsplit("/", 1)[-1], target
        return out


# ---- texts ----


def _on(properties: ElementTree.Element | None, name: str) -> bool:
    flag = _one(properties, name)
    return flag is not None and _value(flag, "val", "1") not in ("0", "false", "off", "none")


def _run_text(run: ElementTree.Element) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    return "".join((x.text or "") if _name(x) == "t" else marks.get(_name(x), "") for x in run)


def _run(run: ElementTree.Element) -> str:
    if _all(run, "drawing"):
        return PICTURE_IN_TEXT
    text = _run_text(run)
    stars = 2 * _on(_one(run, "rPr"), "b") + _on(_one(run, "rPr"), "i")
    return "*" * stars + text + "*" * stars if text else ""


def _plain_paragraph(paragraph: ElementTree.Element) -> str:
    return "".join(_run_text(r) for x in paragraph for r in ([x] if _name(x) == "r" else x if _name(x) == "hyperlink" else []) if _name(r) == "r")


def _paragraph(paragraph: ElementTree.Element, styles: dict[str, str], links: dict[str, tuple[str, str]]) -> str:
    if not _plain_paragraph(paragraph).strip():
        return ""
    text = ""
    for x in paragraph:
        if _name(x) == "r":
            text += _run(x)
        elif _name(x) == "hyperlink":
            shown = "".join(_run_text(r) for r in x if _name(r) == "r")
            target = links.get(_value(x, "id") or "", ("", ""))[1]
            text += f"[{shown or target}]({target})" if target else shown
    style = styles.get(_value(_one(paragraph, "pPr", "pStyle"), "val") or "", "Normal")
    if style in HEADINGS:
        return "#" * HEADINGS[style] + " " + text
    if style in LISTS:
        depth = {"2": 1, "3": 2}.get(style[-1], 0)
        return "  " * depth + ("1. " if "Number" in style else "- ") + text
    return text


def _cell(cell: ElementTree.Element) -> str:
    texts = (_plain_paragraph(p).strip() for p in cell if _name(p) == "p")
    return " ".join(t for t in texts if t)


def _table(table: ElementTree.Element) -> str:
    rows = [[_cell(c) for c in row if _name(c) == "tc"] for row in table if _name(row) == "tr"]
    if not rows or not rows[0]:
        return ""
    shown = [rows[0], ["---"] * len(rows[0]), *(r for r in rows[1:] if any(r))]
    return "\n".join(f"| {' | '.join(r)} |" for r in shown)


def read_docx(raw: bytes) -> list[str]:
    """One Markdown text: headings, lists, emphasis, links, pictures and tables in order; none of an empty file."""
    package = _Package(raw)
    document = package.xml("word/document.xml")
    if document is None:
        raise ValueError("no document inside")
    names = {}
    for s in _all(package.xml("word/styles.xml"), "style"):
        name = _value(_one(s, "name"), "val") or ""
        names[_value(s, "styleId") or ""] = name.title() if name.lower().startswith(("heading ", "list ")) or name.lower() in ("title", "subtitle", "list") else name
    links = package.relations("word/document.xml")
    parts = []
    for x in _one(document, "body") if _one(document, "body") is not None else []:
        parts.append(_paragraph(x, names, links) if _name(x) == "p" else _table(x) if _name(x) == "tbl" else "")
    text = "\n\n".join(p for p in parts if p)
    return [text] if text.strip() else []


# ---- sheets ----


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date_styles(package: _Package) -> list[bool]:
    styles = package.xml("xl/styles.xml")
    own = {_value(f, "numFmtId"): _value(f, "formatCode") or "" for f in _all(styles, "numFmt")}
    dated = lambda k: k is not None and (14 <= int(k) <= 22 or bool(re.search(r"[ymdhs]", re.sub(r"\"[^\"]*\"|\[[^\]]*\]", "", own.get(k, "")), re.I)))
    return [dated(_value(x, "numFmtId")) for x in (_one(styles, "cellXfs") if _one(styles, "cellXfs") is not None else [])]


def _cells(package: _Package, sheet: ElementTree.Element, shared: list[str], dates: list[bool]) -> list[dict[int, object]]:
    """Rows from the first on, each a column's number to its value: texts, floats, integers, truth values."""
    rows: list[dict[int, object]] = []
    for row in _all(sheet, "row"):
        number = int(row.get("r", len(rows) + 1))
        rows += [{} for _ in range(number - len(rows))]
        for k, c in enumerate(x for x in row if _name(x) == "c"):
            kind, value = c.get("t", "n"), _one(c, "v")
            text = value.text if value is not None else None
            at = _column(c.get("r", "")) if c.get("r") else k
            if kind == "s" and text is not None:
                rows[-1][at] = shared[int(text)]
            elif kind == "inlineStr":
                rows[-1][at] = "".join(t.text or "" for t in _all(c, "t"))
            elif kind == "b" and text is not None:
                rows[-1][at] = text == "1"
            elif kind in ("str", "e", "d") and text is not None:
                rows[-1][at] = text
            elif text is not None:
                value = float(text)
                style = int(c.get("s", "0"))
                if style < len(dates) and dates[style]:
                    value = datetime(1899, 12, 30) + timedelta(days=round(value * 86400) / 86400)
                rows[-1][at] = value
    return rows


def table_text(rows: list[dict[int, object]]) -> str:
    """Rows of cells, the first of them the header, as a compact table; empty where no cell has a value.

    Nameless columns are Col_n and a name that came before gets a number; numbers of columns of numbers alone have up to eight digits; line
    ends become spaces; rows and columns without a value go.
    """
    if not rows:
        return ""
    width = max((max(r, default=-1) for r in rows), default=-1) + 1
    names, seen = [], {}
    for k in range(width):
        name = str(rows[0].get(k, "")).strip()
        name = f"Col_{k + 1}" if not name or name.startswith("Unnamed:") else name
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
    body = []
    numeric = [all(isinstance(r.get(k, 0.0), float) for r in rows[1:]) for k in range(width)]
    for r in rows[1:]:
        shown = []
        for k in range(width):
            v = r.get(k, "")
            v = f"{v:.8g}" if isinstance(v, float) and numeric[k] else f"{v:.0f}" if isinstance(v, float) and v.is_integer() else str(v)
            shown.append(v.strip().replace("\n", " "))
        if any(shown):
            body.append(shown)
    kept = [k for k in range(width) if any(r[k] for r in body)]
    if not kept:
        return ""
    lines = [[names[k].replace("\n", " ") for k in kept], [":---" for _ in kept], *([r[k] for k in kept] for r in body)]
    return "\n".join("|" + "|".join(c.strip() for c in line) + "|" for line in lines)


def joined_headers(levels: list[list[str | None]]) -> list[str]:
    """Names of columns under headers of several levels: the levels that have one, joined; else the column's number."""
    out = []
    for k, column in enumerate(zip(*levels)):
        said = [str(x).strip() for x in column if x is not None and str(x).strip()]
        out.append(" > ".join(said) or f"Col_{k + 1}")
    return out


def read_xlsx(raw: bytes) -> list[str]:
    """A table for each sheet with a value, in the order of the book."""
    package = _Package(raw)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise ValueError("no book inside")
    shared = ["".join(t.text or "" for t in _all(s, "t") if t is not None) for s in (package.xml("xl/sharedStrings.xml") if package.xml("xl/sharedStrings.xml") is not None else [])]
    dates, links = _date_styles(package), package.relations("xl/workbook.xml")
    out = []
    for s in _all(book, "sheet"):
        sheet = package.xml(links.get(_value(s, "id") or "", ("", ""))[1])
        out.append(table_text(_cells(package, sheet, shared, dates)) if sheet is not None else "")
    return [t for t in out if t]


# ---- slides ----


def _frame(body: ElementTree.Element | None) -> str:
    lines = ("".join((x.text or "") if _name(x) == "t" else "\n" if _name(x) == "br" else "" for x in p.iter()).strip() for p in (body if body is not None else []) if _name(p) == "p")
    return "\n".join(line for line in lines if line)


def _place(shape: ElementTree.Element) -> tuple[int, int] | None:
    for holder in ("spPr", "grpSpPr"):
        off = _one(shape, holder, "xfrm", "off")
        if off is not None:
            return int(off.get("y", 0)), int(off.get("x", 0))
    off = _one(shape, "xfrm", "off")
    return None if off is None else (int(off.get("y", 0)), int(off.get("x", 0)))


def _csv(rows: list[list[str]]) -> str:
    quoted = lambda t: '"' + t.replace('"', '""') + '"' if "," in t or '"' in t else t
    return "\n".join(",".join(quoted(c) for c in row) for row in rows)


def _shapes(tree: ElementTree.Element, inherited) -> list[str]:
    """Texts of shapes: bands from the top, in a band from the left; groups in their place."""
    found = []
    for k, x in enumerate(tree):
        if _name(x) in ("sp", "grpSp", "pic", "graphicFrame"):
            top, left = _place(x) or inherited(x) or (0, 0)
            found.append((round(top / BAND) * BAND, left, k, x))
    out = []
    for *_, x in sorted(found, key=lambda f: f[:3]):
        if _name(x) == "grpSp":
            out += _shapes(x, inherited)
        elif _name(x) == "pic":
            out.append(PICTURE_ON_SLIDE)
        elif _name(x) == "graphicFrame":
            for t in _all(x, "tbl"):
                rows = [[_frame(_one(c, "txBody")).replace("\n", " ").strip() for c in r if _name(c) == "tc"] for r in t if _name(r) == "tr"]
                if any(any(r) for r in rows):
                    out.append(f"[Table] ({len(rows)} rows, {len(rows[0])} cols)\n{_csv(rows)}")
        elif _frame(_one(x, "txBody")):
            out.append(_frame(_one(x, "txBody")))
    return out


def _holder(shape: ElementTree.Element) -> tuple[str, str] | None:
    ph = _one(shape, "nvSpPr", "nvPr", "ph")
    return None if ph is None else (ph.get("type", "body"), ph.get("idx", "0"))


def slides(raw: bytes) -> list[tuple[int, list[str], str]]:
    """(number, texts of shapes in reading order, notes) of each slide."""
    package = _Package(raw)
    show = package.xml("ppt/presentation.xml")
    if show is None:
        raise ValueError("no slides inside")
    links = package.relations("ppt/presentation.xml")
    out = []
    for n, s in enumerate(_all(show, "sldId"), 1):
        name = links.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), ("", ""))[1]
        slide = package.xml(name)
        own = package.relations(name)
        layout = next((package.xml(t) for kind, t in own.values() if kind == "slideLayout"), None)
        places = {_holder(x): _place(x) for x in _all(layout, "sp") if _holder(x)}
        tree = _one(slide, "cSld", "spTree")
        texts = _shapes(tree, lambda x: places.get(_holder(x))) if tree is not None else []
        notes = next((package.xml(t) for kind, t in own.values() if kind == "notesSlide"), None)
        said = [_frame(_one(x, "txBody")) for x in _all(notes, "sp") if (_holder(x) or ("",))[0] == "body"]
        out.append((n, texts, "\n".join(t for t in said if t)))
    return out


def read_pptx(raw: bytes, combined: bool = False, notes_first: bool = False) -> list[str]:
    """A text for each slide with content, or one of all slides under numbered rulers; notes after the shapes, or before."""
    out, whole = [], []
    for n, texts, notes in slides(raw):
        said = [f"{NOTES}\n{notes}"] if notes else []
        parts = said + texts if notes_first else texts + said
        if parts:
            out.append("\n\n".join(parts).strip())
            whole += [f"\n=== Slide {n} ===", *parts, ""]
    return ["\n".join(whole).strip()] if combined else out
