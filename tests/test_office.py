"""Office files made here by hand, read by the loaders."""

import io
import zipfile

import pytest

from veilspark.sources import office
from veilspark.sources.files import load

W = 'xmlns:w="w" xmlns:r="r"'




def files(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    par = lambda body, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{body}</w:p>'
    cell = lambda *t: "<w:tc>" + "".join(par(run(x)) for x in t) + "</w:tc>"
    body = par(run("計画"), "h1") + par(run("a", "<w:b/>") + run("b", "<w:i/>") + run("c", "<w:b/><w:i/>") + run("d", '<w:b w:val="0"/>'))
    body += par(run("一"), "lb2") + par(run("二"), "ln") + par("") + par(run("x") + "<w:r><w:drawing/></w:r>")
    body += f'<w:p>{run("see ")}<w:hyperlink r:id="r1">{run("here")}</w:hyperlink></w:p>'
    body += f"<w:tbl><w:tr>{cell('k')}{cell('v', 'w')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("h1", "heading 1"), ("lb2", "List Bullet 2"), ("ln", "List Number")))
    return files({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>", "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Type="t/hyperlink" Target="http://x.example" TargetMode="External"/></Relationships>'})


def xlsx():
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>量</t></is></c><c r="D1" t="s"><v>0</v></c></row>'
    rows += '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>3</v></c><c r="C3"><v>0.123456789</v></c></row><row r="4"><c r="A4" s="1"><v>45000</v></c><c r="C4"><v>2</v></c></row>'
    sheet = f'<worksheet xmlns="m"><sheetData>{rows}</sheetData></worksheet>'
    book = '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Type="t/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="t/worksheet" Target="/xl/worksheets/s2.xml"/></Relationships>'
    styles = '<styleSheet xmlns="m"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    return files({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/styles.xml": styles, "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>品</t></si><si><r><t>ね</t></r><r><t>じ\n大</t></r></si></sst>', "xl/worksheets/s1.xml": sheet, "xl/worksheets/s2.xml": '<worksheet xmlns="m"><sheetData/></worksheet>'})


def pptx():
    box = lambda t, x, y: f'<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p/></p:txBody></p:sp>'
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f'<p:graphicFrame><p:xfrm><a:off x="0" y="90000"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr>{cell("a,b")}{cell("c")}</a:tr><a:tr>{cell("say &quot;x&quot;")}{cell("")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="50000"/></a:xfrm></p:grpSpPr>{box("g2", 9, 0)}{box("g1", 1, 0)}</p:grpSp>'
    picture = '<p:pic><p:spPr><a:xfrm><a:off x="0" y="200000"/></a:xfrm></p:spPr></p:pic>'
    slide = lambda inner: f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    rel = lambda *r: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="t/{k}" Target="{t}"/>' for i, k, t in r) + "</Relationships>"
    notes = '<p:notes xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>memo</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
    show = '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/></p:sldIdLst></p:presentation>'
    return files(
        {
            "ppt/presentation.xml": show,
            "ppt/_rels/presentation.xml.rels": rel(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
            "ppt/slides/slide1.xml": slide(picture + table + group + box("right", 500, 1000) + box("left", 5, 3000)),
            "ppt/slides/_rels/slide1.xml.rels": rel(("n", "notesSlide", "../notesSlides/n1.xml")),
            "ppt/notesSlides/n1.xml": notes,
            "ppt/slides/slide2.xml": slide(""),
        }
    )


def test_texts_sheets_and_slides():
    assert office.read_docx(docx()) == ["# 計画\n\n**a***b****c***d\n\n  - 一\n\n1. 二\n\nx[画像]\n\nsee [here](http://x.example)\n\n| k | v w |\n| --- | --- |\n| 1 | 2 |"]
    assert office.read_xlsx(xlsx()) == ["|品|Col_2|量|\n|:---|:---|:---|\n|ねじ 大|3|0.12345679|\n|2023-03-15 00:00:00||2|"]
    shapes = ["left", "right", "g1", "g2", '[Table] (2 rows, 2 cols)\n"a,b",c\n"say ""x""",', "[Image]"]
    assert office.read_pptx(pptx()) == ["\n\n".join([*shapes, "[SLIDE NOTES]\nmemo"])]
    assert office.read_pptx(pptx(), combined=True, notes_first=True) == ["=== Slide 1 ===\n" + "\n".join(["[SLIDE NOTES]\nmemo", *shapes])]


def test_headers_of_levels():
    assert office.joined_headers([["売上", None, ""], ["上期", "下期", " "]]) == ["売上 > 上期", "下期", "Col_3"]


@pytest.mark.parametrize("read", [office.read_docx, office.read_xlsx, office.read_pptx])
def test_broken_files(read):
    for raw in (b"", b"no zip", files({"a": "b"})):
        with pytest.raises(ValueError):
            read(raw)


def test_loaded_by_extension(spark, tmp_path):
    for name, raw in (("a.docx", docx()), ("b.XLSX", xlsx()), ("c.pptx", pptx()), ("d.txt", "ＡＢ".encode("cp932"))):
        (tmp_path / name).write_bytes(raw)
    got = {r["file_name"]: (r["file_type"], r["text"]) for r in load(spark, str(tmp_path)).collect()}
    assert got["d.txt"] == ("txt", "AB") and got["b.XLSX"][0] == "xlsx" and got["a.docx"][1].startswith("# 計画") and len(got) == 4
    (tmp_path / "e.xyz").write_bytes(b"x")
    with pytest.raises(Exception, match="no loader for .xyz"):
        load(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none"))
