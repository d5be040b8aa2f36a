"""Operator 2: main text of web pages by differencing each page with its nearest URL.

A page is cut into lines (blocks) in page order. Lines in menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, as their elements, roles or class names say, are left out first, since in the given pages no
two neighbours share such a line, and what they do share is text of their articles (figures in the README), but never an element that
holds the page's article, or most of its text where only a class name, id or form says so. Each page is then paired
with the page of the same host whose path is nearest in sort order and that is not its copy (the longer common
prefix of the pages before and after the run of copies it stands in), the two line lists are aligned by their longest common subsequence, and shared lines are
deleted: anywhere on a page without an article element, and inside an article where the line is only links or
stands in a list of them. Two pages that share nearly all lines are copies of one page; nothing is deleted where all
pages of the host that a task holds are copies of one.

Pages are dealt out by ranges of (host, path), so a large host spreads over many tasks; the first page of a
range takes the page after it, so for at most two pages a task the neighbour depends on where ranges end. A run of copies is held by its task until the page after it comes. A null or empty html gives the empty text; a null url is a host of its own kind
without path. Repeated rows are answered each, other columns do not matter, an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPY_SHARE = 0.9
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>\"']++|[\"'])*+)>", re.S)
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label map mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var video audio wbr".split())
OUT = frozenset("nav footer aside form menu dialog button select option fieldset head".split())
MAIN = frozenset(("article", "main"))
HINT = re.compile(r"(?:^|[\s_-])(?:ad|ads|adbox|advert|adverts|advertisement|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|footer|header|masthead|cookie|cookies|consent|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|comment|comments|commentlist|disqus|respond|replies|reply|pagination|pager|skip|toolbar)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: An open element of these ends where one of the same kind, or their container, begins or ends.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


#: Class names that say what a page has or lacks, not what the element is.
MODIFIER = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no)[_-]\S*", re.I)
#: Of the hints, those that name a part of an article too, and those that hold other people's articles.
HEADER = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead)(?=$|[\s_-])", re.I)
REPLIES = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|respond|replies|reply|related|recommended)(?:$|[\s_-])", re.I)


def _left_out(tag: str, attributes: str, in_main: bool) -> str:
    """Why an element is left out: hidden, element, replies, hint; empty where it is not."""
    why = ""
    if tag in OUT or (tag == "header" and not in_main):
        why = "hint" if tag == "form" else "element"
    if not attributes or tag in MAIN or tag in ("html", "body"):
        return why
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "hidden"
        if name == "role" and value.lower() in ROLES:
            why = why or ("hint" if value.lower() == "form" else "element")
        if name in ("class", "id"):
            value = MODIFIER.sub(" ", value)
            value = HEADER.sub(" ", value) if in_main else value
            if HINT.search(value):
                why = "replies" if REPLIES.search(value) else why or "hint"
    return why


class _Gone:
    """An open or closed element that is to be left out, and what stands in it."""

    def __init__(self, why: str):
        self.why, self.size, self.main_size, self.holds, self.kept = why, 0, 0, set(), False

    def settle(self, size: int, main_size: int) -> None:
        """Keep it where it holds the article or most of the page's text (of ``size``, in articles ``main_size``)."""
        if self.why == "hidden":
            return
        other = main_size - self.main_size
        if "main" in self.holds or (self.holds and (not other or (self.why != "replies" and self.main_size >= other))):
            self.kept = True
        elif self.why == "hint" or (self.why == "replies" and not main_size):
            self.kept = 2 * self.size > size


def page_lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """Lines of a page in order: text, whether inside an article or main element, whether only links."""
    found: list[tuple[list[tuple[str, tuple[_Gone, ...], bool]], bool]] = []  # lines: their parts, whether in an article
    parts: list[tuple[str, tuple[_Gone, ...], bool]] = []  # text, elements around it that may be left out, whether a link
    stack: list[tuple[str, bool]] = []  # open elements, and whether each may be left out
    out: tuple[_Gone, ...] = ()
    gone: list[_Gone] = []
    main = links = size = main_size = 0

    def close_line():
        if parts:
            found.append((parts.copy(), main > 0))
            parts.clear()

    def pop():
        nonlocal out, main, links
        tag, left = stack.pop()
        out = out[:-1] if left else out
        main -= tag in MAIN
        links -= tag == "a"

    page = page or ""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            parts.append((text, out, links > 0))
            n = len(text.strip())
            size, main_size = size + n, main_size + n * (main > 0)
            for g in out:
                g.size, g.main_size = g.size + n, g.main_size + n * (main > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            if tag not in INLINE:
                close_line()
            if any(t == tag for t, _ in stack):
                while stack and stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            if tag not in INLINE:
                close_line()
            m = RAW[tag].search(page, at)
            at = m.end() if m else end
            continue
        if tag in ("br", "hr", "img", "wbr"):
            if tag == "hr":
                close_line()
            elif tag == "br":
                parts.append(("\n", out, links > 0))
            continue
        if tag not in INLINE:
            close_line()
            if tag == "p" or tag not in CLOSES:  # an open paragraph, with what is open in it, ends here
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] not in INLINE), -1)
                if k >= 0 and stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
            elif stack and stack[-1][0] in CLOSES[tag]:
                pop()
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in MAIN:
            for g in out:
                g.holds.add(tag)
        why = _left_out(tag, attributes, main > 0)
        if why:
            gone.append(_Gone(why))
            out = (*out, gone[-1])
        stack.append((tag, bool(why)))
        main += tag in MAIN
        links += tag == "a"
    close_line()
    for g in gone:
        g.settle(size, main_size)
    lines: list[tuple[str, bool, bool]] = []
    for line, inside in found:
        line = [p for p in line if all(g.kept for g in p[1])]
        text = " ".join(entities.unescape("".join(p[0] for p in line)).split())
        if text:
            said = [p[2] for p in line if not p[0].isspace()]
            lines.append((text, inside, all(said)))
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indexes in ``a`` of a longest common subsequence with ``b``, by bit vectors."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    kept = [i for i, line in enumerate(a) if line in where]
    if not kept:
        return set()
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for i in kept:
        m = where[a[i]]
        v = ((v + (v & m)) | (v & ~m)) & full
        rows.append(v)
    out, i, j = set(), len(kept), len(b)
    length = lambda i, j: (~rows[i] & ((1 << j) - 1)).bit_count()
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            out.add(kept[i - 1])
            i, j = i - 1, j - 1
    return out


def copies(a: list, b: list) -> bool:
    """Whether two line lists share nearly all lines in order."""
    most = max(len(a), len(b))
    if a == b:
        return True
    if min(len(a), len(b)) < COPY_SHARE * most or (Counter(t for t, _, _ in a) & Counter(t for t, _, _ in b)).total() < COPY_SHARE * most:
        return False
    return len(shared_lines([t for t, _, _ in a], [t for t, _, _ in b])) >= COPY_SHARE * most


def main_text(lines: list[tuple[str, bool, bool]], partner: list[tuple[str, bool, bool]] | None) -> str:
    has_main = any(inside for _, inside, _ in lines)
    shared: set[int] = set()
    if partner and not copies(lines, partner):
        shared = shared_lines([t for t, _, _ in lines], [t for t, _, _ in partner])
    return "\n".join(t for i, (t, inside, links) in enumerate(lines) if inside >= has_main and not (i in shared and (links or not has_main)))


def _nearer(path: str, before, after):
    """The neighbour on the same host with the longer common path prefix; the one before on ties."""
    if before is None or after is None:
        return before or after
    return after if len(commonprefix((path, after[0]))) > len(commonprefix((path, before[0]))) else before


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    ids = f"page_id {types['page_id']}, url {types['url']}"

    def cut(batches):
        for batch in batches:
            flat = [page_lines(h.as_py()) for h in batch.column(2)]
            columns = [pa.array([[x[k] for x in lines] for lines in flat], pa.list_(t)) for k, t in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "line", "inside", "links"])

    def differ(batches):
        before, run = None, []  # the row before a run of copies, and the run; exact copies share their lines

        def answers(after):
            known: dict = {}
            for page_id, url, host, path, lines in run:
                near = [(x[3], x[4]) if x and x[2] == host else None for x in (before, after)]
                partner = _nearer(path, *near)
                if partner and all(near) and copies(lines, partner[1]):  # no copy of the run's first page, but of this one
                    partner = near[0] if partner is near[1] else near[1]
                key = (id(lines), id(partner and partner[1]))
                if key not in known:
                    known[key] = main_text(lines, partner[1] if partner else None)
                yield page_id, url, known[key], len(known[key])

        def packed(done, like):
            types = (like.column(0).type, like.column(1).type, pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 4, types)], names=["page_id", "url", "text", "n_chars"])

        last = None
        for batch in batches:
            done, last = [], batch
            for page_id, url, host, path, line, inside, links in zip(*(c.to_pylist() for c in batch.columns)):
                row = (page_id, url, host, path, list(zip(line, inside, links)))
                if run and run[0][2] == host and copies(row[4], run[0][4]):
                    run.append((*row[:4], run[0][4]) if row[4] == run[0][4] else row)
                    continue
                done += answers(row)
                before, run = run[-1] if run else None, [row]
            yield packed(done, batch)
        if run:
            yield packed(list(answers(None)), last)

    lines = pages.select("page_id", "url", "html").mapInArrow(cut, f"{ids}, line array<string>, inside array<boolean>, links array<boolean>")
    address = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 2)
    placed = lines.select("page_id", "url", F.lower(address).alias("host"), path.alias("path"), "line", "inside", "links")
    order = ("host", "path", "url", "page_id")
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(differ, f"{ids}, text string, n_chars bigint")
