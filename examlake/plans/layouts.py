"""Queries on pages and files: the same page layer, boxes and Word file for each key of a table, and SQL the lines that they stand for."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators.segmentation import parsed_questions
from ..sources.word import NAMESPACES, kind_column, word_lines
from . import bridges as B
from .fixtures import spread, sql_rows

_SPAN = "page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, size double, sup boolean, dir_x double, dir_y double"


def _line(page: int, block: int, *spans: tuple, turned: bool = False) -> list[tuple]:
    """Spans of one line: text, x0, y0, x1, y1, size and, for superscripts, True."""
    return [(page, block, 1, i, s[0], *map(float, s[1:6]), len(s) > 6, 0.7 if turned else 1.0, 0.7 if turned else 0.0) for i, s in enumerate(spans)]


SPANS = [
    row
    for page in (1, 2, 3)
    for row in _line(page, 1, ("某某 试卷一", 50, 10, 110, 20, 10)) + _line(page, 2, (f"- {page} -", 290, 780, 310, 789, 9)) + _line(page, 3, ("水印", 100, 300, 200, 400, 40), turned=True)
] + [
    *_line(1, 4, ("第一部分 数学", 50, 100, 150, 116, 16)),
    *_line(1, 5, ("x", 50, 140, 55, 150, 10), ("2", 55, 140, 58, 145, 6, True), ("+y", 58, 140, 68, 150, 10), ("3", 68, 140, 71, 147, 7)),
    *_line(2, 4, ("1", 100, 200, 106, 210, 10), ("=", 110, 207, 116, 217, 10), ("2", 100, 214, 106, 224, 10), ("0.5", 120, 207, 135, 217, 10)),
    *_line(2, 5, ("A. 甲", 50, 300, 75, 310, 10)), *_line(2, 6, ("B. 乙", 200, 301, 225, 311, 10)),
    *_line(2, 7, ("3", 60, 400, 66, 410, 10)), *_line(2, 8, ("4", 60, 414, 66, 424, 10)),
    *_line(3, 4, ("—" * 10, 50, 500, 150, 510, 10)), *_line(3, 5, ("试卷", 50, 550, 70, 560, 10)), *_line(3, 6, ("答案____", 50, 600, 90, 610, 10)),
]
IMAGES = [(1, 300.0, 300.0, 330.0, 330.0, "raster"), (1, 300.0, 400.0, 310.0, 410.0, "raster"), (2, 300.0, 500.0, 350.0, 550.0, "drawing"), (2, 400.0, 500.0, 450.0, 530.0, "drawing"), (3, 300.0, 730.0, 350.0, 780.0, "raster"), *[(p, 20.0, 650.0, 60.0, 690.0, "raster") for p in (1, 2, 3)]]
PAGE_LINES = [
    (0, 1, "第一部分 数学", 50.0, 100.0, 16.0, True, False, 0), (1, 1, "x²+y³", 50.0, 140.0, 10.0, False, False, 0), (2, 1, "", 300.0, 300.0, 30.0, False, True, 0),
    (3, 2, "1/2 = 0.5", 100.0, 206.0, 12.0, False, False, 0), (4, 2, "A. 甲  B. 乙", 50.0, 300.0, 11.0, False, False, 0), (5, 2, "3/4", 60.0, 407.0, 10.0, False, False, 0), (6, 2, "", 300.0, 500.0, 50.0, False, True, 0),
    (7, 3, "答案____", 50.0, 600.0, 10.0, False, False, 1),
]
BOXES = [
    (1, "做的。", 95.0, 11.0, 125.0, 21.0), (1, "1.", 10.0, 10.0, 20.0, 20.0), (1, "水是", 25.0, 10.0, 45.0, 20.0), (1, "A", 10.0, 40.0, 18.0, 50.0), (1, "甲", 22.0, 40.0, 32.0, 50.0), (1, "B. 乙", 80.0, 41.0, 110.0, 51.0),
    (1, "2. 看图", 10.0, 200.0, 50.0, 210.0), (2, "3. 下一题", 10.0, 10.0, 60.0, 20.0), (2, "续", 64.0, 10.0, 74.0, 20.0), (2, "尾", 88.0, 11.0, 98.0, 21.0),
]
SCANNED = [(0, 1, "1. 水是____做的。", 10.0, 10.0, 11.0, False, 1), (1, 1, "A 甲  B. 乙", 10.0, 40.0, 11.0, False, 0), (2, 1, "2. 看图", 10.0, 200.0, 10.0, False, 0), (3, 1, "", 10.0, 62.0, 138.0, True, 0), (4, 2, "3. 下一题续  尾", 10.0, 10.0, 11.0, False, 0)]


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "supplier", "s_suppkey", SPANS, _SPAN)


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page layers of three pages as lines: headings, superscripts, fractions, rows in pieces, pictures; no headers, watermarks and separators."""
    images = spread(spark, sf_dir, "supplier", "s_suppkey", IMAGES, "page int, x0 double, y0 double, x1 double, y1 double, kind string")
    pages = spread(spark, sf_dir, "supplier", "s_suppkey", [(p, 800.0) for p in (1, 2, 3)], "page int, height double")
    return P.page_lines(_spans(spark, sf_dir), images, pages).select("paper_id", "pos", "page", "text", "x", "y", "height", "is_heading", "image", "blanks")


def page_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page, the size of its body text, its lines that are formulas or headings, and whether the paper has a text layer."""
    spans = _spans(spark, sf_dir)
    lines = P.span_lines(P.horizontal(spans)).groupBy("paper_id", "page").agg(F.count_if("formula").alias("n_formulas"), F.count_if("is_heading").alias("n_headings"), F.count("*").alias("n_lines"))
    return lines.join(P.body_sizes(P.horizontal(spans)), ["paper_id", "page"]).join(P.has_text_layer(spans), "paper_id")


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised boxes as lines: rows, blanks in gaps, options, pictures between rows."""
    boxes = spread(spark, sf_dir, "customer", "c_custkey", BOXES, "page int, text string, x0 double, y0 double, x1 double, y1 double")
    return P.scanned_lines(boxes).select("paper_id", "pos", "page", "text", "x", "y", "height", "image", "blanks")


_CELL = "<w:tc><w:tcPr>{}</w:tcPr><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"


def word_file(name: str) -> bytes:
    """A small Word file: a heading, numbered paragraphs with underlined blanks and a soft break, a table with merged cells, a picture."""
    run = lambda text, line=False: f'<w:r>{"<w:rPr><w:u w:val=\"single\"/></w:rPr>" if line else ""}' + "<w:br/>".join(f'<w:t xml:space="preserve">{t}</w:t>' for t in text.split("\n")) + "</w:r>"
    paragraph = lambda style, *runs: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{"".join(runs)}</w:p>'
    rows = [[("", "年份"), ('<w:gridSpan w:val="2"/>', "产量")], [("<w:vMerge/>", ""), ("", name), ("", "5")], [("", "")]]
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(_CELL.format(*c) for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    body = paragraph("H", run("期末试卷")) + paragraph("M", run(f"{name} 的化学式是"), run("  ", True), run(" ", True), run("。")) + paragraph("M", run("第二题？\nA. 甲 B. 乙\nC. 丙")) + table + '<w:p><w:r><a:blip r:embed="r1"/></w:r></w:p>'
    parts = {
        "word/document.xml": f"<w:document {NAMESPACES}><w:body>{body}</w:body></w:document>",
        "word/numbering.xml": f'<w:numbering {NAMESPACES}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
        "word/styles.xml": f'<w:styles {NAMESPACES}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style><w:style w:styleId="L"><w:name w:val="List Number"/><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style><w:style w:styleId="M"><w:name w:val="Own"/><w:basedOn w:val="L"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="media/i.png"/></Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for part, text in parts.items():
            archive.writestr(zipfile.ZipInfo(part, (2000, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a Word file for each supplier; every seventh is damaged or something else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("s_suppkey").to_pylist()
            other = [b"PK\x03\x04 broken", b"%PDF-1.7", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"text"]
            files = [other[k // 7 % 4] if k % 7 == 0 else word_file(name) for k, name in zip(keys, batch.column("s_name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"s{k}.docx" for k in keys]), pa.array(files, pa.binary())], names=["path", "content"])

    return B.for_files(B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")).mapInArrow(run, "path string, content binary")


def word_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files as lines; those that can't be read as one row with an error."""
    rows = word_lines(_files(spark, sf_dir))
    return rows.select("path", "pos", "text", "number", "blanks", "is_heading", "image", "ref", F.array_join("cells", "/").alias("cells"), F.col("error").isNotNull().alias("failed"))


def imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what their first bytes say they are, and how many of each gave lines."""
    files = _files(spark, sf_dir)
    failed = word_lines(files).groupBy("path").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
    return files.select("path", kind_column("content").alias("kind")).join(failed, "path").groupBy("kind").agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if("failed").alias("failed"))


def word_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of Word files, their lines joined by indents."""
    lines = word_lines(_files(spark, sf_dir)).where("error is null").withColumnRenamed("path", "paper_id")
    return parsed_questions(lines, source="docx").select("paper_id", "seq", "no", "type", "title", F.size("options").cast("long").alias("n_options"), F.col("blanks").cast("long").alias("blanks"), "image")


QUERIES = {f.__name__: f for f in (page_lines, page_figures, scanned_lines, word_scan, imported_files, word_questions)}

_FILE_LINES = [(0, "期末试卷", None, 0, True, False, None, None), (1, "1. {} 的化学式是____。", 1, 2, False, False, None, None), (2, "2. 第二题？", 2, 0, False, False, None, None), (3, "A. 甲 B. 乙", None, 0, False, False, None, None), (4, "C. 丙", None, 0, False, False, None, None),
               (5, "年份  产量", None, 0, False, False, None, "年份/产量/>"), (6, "{}  5", None, 0, False, False, None, "^/{}/5"), (7, "", None, 0, False, True, "media/i.png", None)]
_PLAIN = "SELECT page, text, size, sup, block, line, y0, y1 FROM spans WHERE round(dir_x, 2) = 1 AND round(dir_y, 2) = 0"
ORACLE_SQL = {
    "page_lines": f"""WITH v(pos, page, text, x, y, height, is_heading, image, blanks) AS ({sql_rows(PAGE_LINES)}) SELECT s_suppkey AS paper_id, CAST(pos AS INTEGER) AS pos, CAST(page AS INTEGER) AS page, text, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(height AS DOUBLE) AS height,
        is_heading, image, CAST(blanks AS INTEGER) AS blanks FROM supplier CROSS JOIN v""",
    "page_figures": f"""WITH spans(page, block, line, span, text, x0, y0, x1, y1, size, sup, dir_x, dir_y) AS ({sql_rows(SPANS)}), plain AS ({_PLAIN}),
        l AS (SELECT page, block, max(size) >= 13 AS is_heading, coalesce(greatest(max(y1) FILTER (NOT sup) - min(y1) FILTER (NOT sup), max(y0) FILTER (NOT sup) - min(y0) FILTER (NOT sup)) > 0.5 * max(size) FILTER (NOT sup), false) AS formula FROM plain GROUP BY ALL),
        f AS (SELECT page, count(*) FILTER (formula) AS n_formulas, count(*) FILTER (is_heading) AS n_headings, count(*) AS n_lines FROM l GROUP BY 1), b AS (SELECT page, list_sort(list(size) FILTER (NOT sup))[CAST(count(*) FILTER (NOT sup) // 2 AS INTEGER) + 1] AS body FROM plain GROUP BY 1)
        SELECT s_suppkey AS paper_id, CAST(page AS INTEGER) AS page, n_formulas, n_headings, n_lines, CAST(body AS DOUBLE) AS body, (SELECT sum(length(trim(text))) > 50 FROM spans) AS has_text FROM supplier CROSS JOIN f JOIN b USING (page)""",
    "scanned_lines": f"""WITH v(pos, page, text, x, y, height, image, blanks) AS ({sql_rows(SCANNED)}) SELECT c_custkey AS paper_id, CAST(pos AS INTEGER) AS pos, CAST(page AS INTEGER) AS page, text, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(height AS DOUBLE) AS height, image,
        CAST(blanks AS INTEGER) AS blanks FROM customer CROSS JOIN v""",
    "word_scan": f"""WITH v(pos, text, number, blanks, is_heading, image, ref, cells) AS ({sql_rows(_FILE_LINES)}) SELECT 's' || s_suppkey || '.docx' AS path, CAST(pos AS INTEGER) AS pos, replace(text, '{{}}', s_name) AS text, CAST(number AS INTEGER) AS number, CAST(blanks AS INTEGER) AS blanks, is_heading, image, ref,
        replace(cells, '{{}}', s_name) AS cells, false AS failed FROM supplier CROSS JOIN v WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 's' || s_suppkey || '.docx', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM supplier WHERE s_suppkey % 7 = 0""",
    "imported_files": "SELECT CASE WHEN s_suppkey % 7 <> 0 THEN 'docx' ELSE (['docx', 'pdf', 'doc', NULL])[s_suppkey // 7 % 4 + 1] END AS kind, count(*) FILTER (s_suppkey % 7 <> 0) AS ok, count(*) FILTER (s_suppkey % 7 = 0) AS failed FROM supplier GROUP BY 1",
    "word_questions": """SELECT 's' || s_suppkey || '.docx' AS paper_id, CAST(no AS INTEGER) AS seq, CAST(no AS INTEGER) AS no, type, '期末试卷' AS title, CAST(n_options AS BIGINT) AS n_options, CAST(blanks AS BIGINT) AS blanks, CASE WHEN no = 2 THEN 'yes' END AS image FROM supplier
        CROSS JOIN (VALUES (1, 'blank', 0, 2), (2, 'single', 3, 0)) v(no, type, n_options, blanks) WHERE s_suppkey % 7 <> 0""",
}
