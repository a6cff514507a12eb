"""Word files made with the standard library."""

import io
import zipfile

import pytest

from examlake.operators.segmentation import parsed_questions
from examlake.sources.word import docx_lines, word_lines

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
NUMBERING = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
STYLES = f'<w:styles {NS}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style><w:style w:styleId="L"><w:name w:val="List Number"/><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style><w:style w:styleId="M"><w:name w:val="Own"/><w:basedOn w:val="L"/></w:style></w:styles>'


def p(*runs, style=None):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}{''.join(runs)}</w:p>"


def r(text, line=False):
    inner = "<w:br/>".join(f'<w:t xml:space="preserve">{x}</w:t>' for x in text.split("\n"))
    return f"<w:r>{'<w:rPr><w:u w:val=\"single\"/></w:rPr>' if line else ''}{inner}</w:r>"


def docx(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/numbering.xml", NUMBERING)
        z.writestr("word/styles.xml", STYLES)
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="media/i.png"/></Relationships>')
    return out.getvalue()


CELL = "<w:tc><w:tcPr>{}</w:tcPr><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
FILE = docx(
    p(r("期末试卷"), style="H"),
    p(r("水的化学式是"), r("  ", line=True), r(" ", line=True), r("。"), style="M"),
    p(r("第二题？\nA. 甲 B. 乙\nC. 丙"), style="M"),
    f'<w:tbl><w:tr>{CELL.format("", "年份")}{CELL.format("<w:gridSpan w:val=\"2\"/>", "产量")}</w:tr><w:tr>{CELL.format("<w:vMerge/>", "")}{CELL.format("", "")}{CELL.format("", "5")}</w:tr><w:tr>{CELL.format("", "")}</w:tr></w:tbl>',
    p('<w:r><a:blip r:embed="r1"/></w:r>'),
)


def test_lines():
    lines = docx_lines(FILE)
    assert [x["text"] for x in lines] == ["期末试卷", "1. 水的化学式是____。", "2. 第二题？", "A. 甲 B. 乙", "C. 丙", "年份  产量", "5", ""]
    assert lines[0]["is_heading"] and (lines[1]["number"], lines[1]["blanks"]) == (1, 2) and lines[3]["number"] is None
    assert lines[5]["cells"] == ["年份", "产量", ">"] and lines[6]["cells"] == ["^", "", "5"] and lines[7]["ref"] == "media/i.png"


def test_scan_and_parse(spark):
    files = spark.createDataFrame([("a", FILE), ("b", b"PK\x03\x04 broken"), ("c", b"%PDF-1"), ("d", None)], "path string, content binary")
    rows = word_lines(files)
    assert {x.path for x in rows.where("error is not null").collect()} == {"b", "c", "d"}
    found = parsed_questions(rows.where("error is null and not image").withColumnRenamed("path", "paper_id"), source="docx").orderBy("seq").collect()
    assert [(q.no, q.type, len(q.options)) for q in found] == [(1, "blank", 0), (2, "single", 3)]


@pytest.mark.parametrize("content", [b"", b"PK\x03\x04"])
def test_damaged(content):
    with pytest.raises(zipfile.BadZipFile):
        docx_lines(content)
