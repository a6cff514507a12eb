"""Edits, spans and workbooks."""

import io
import zipfile
from xml.etree import ElementTree

from examlake.operators.lifecycle import carried_over, confirmed, edited, picture_options
from examlake.operators.spans import located, question_pictures, question_spans
from examlake.sources.sheets import workbooks

Q = "paper_id long, seq int, unit string, no int, type string, stem string, options array<string>, blanks int, image string, source string, issues array<string>, crop string, page int, y0 double"
ROWS = [
    (1, 1, "", 1, "single", "甲（ ）", ["x", None], 0, None, "text", ["手工标记"], "old1", 1, 10.0),
    (1, 2, "", 3, "blank", "乙（　）", [], 0, None, "text", [], None, 1, 50.0),
    (1, 3, "", 3, "multi", None, [], 0, "yes", "text", [], "old3", 2, 20.0),
]


def test_lifecycle(spark):
    q = spark.createDataFrame(ROWS, Q)
    assert all(r.reviewed and not r.issues for r in confirmed(q).collect())
    got = {r.seq: r for r in edited(q).collect()}
    assert got[1].issues == [] and got[1].options == ["x", ""] and got[2].blanks == 1 and got[2].issues == ["题号不连续：上一题 1，本题 3"] and "选项只有 0 个" in got[3].issues
    pictures = {r.seq: r for r in picture_options(q).collect()}
    assert pictures[1].options == ["x", None] and pictures[2].type == "single" and len(pictures[2].options) == 4 and pictures[2].issues and not pictures[3].issues
    carried = {r.seq: r for r in carried_over(q.drop("crop"), q).collect()}
    assert carried[1].crop == "old1" and carried[2].crop == carried[3].crop == "old3" and carried[2].image is None and carried[3].image == "yes"


def test_spans(spark):
    q = spark.createDataFrame(ROWS, Q)
    assert [(r.next_page, r.next_y) for r in question_spans(q).orderBy("seq").collect()] == [(1, 50.0), (2, 20.0), (None, None)]
    pictures = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 1, 10.0, "b"), (1, 1, 49.0, "c"), (1, 2, 1.0, "d"), (1, 9, 9.0, "e"), (2, 1, 1.0, "f")], "paper_id long, page int, y double, ref string")
    assert {r.ref: r.seq for r in located(pictures, q).collect()} == {"a": None, "b": 1, "c": 1, "d": 2, "e": 3, "f": None}
    assert {r.seq: (r.n_pictures, r.first_ref) for r in question_pictures(q, pictures).collect()} == {1: (2, "b"), 2: (1, "d"), 3: (1, "e")}


def test_workbooks(spark):
    rows = spark.createDataFrame([(1, 2, "b & <c>", 5), (1, 1, None, 4), (2, 1, "x", None)], "attempt_id long, seq int, answer string, n int")
    books = {r.attempt_id: bytes(r.content) for r in workbooks(rows, "attempt_id", "seq", "汇总", {"answer": "我的答案", "n": "空数"}).collect()}
    with zipfile.ZipFile(io.BytesIO(books[1])) as archive:
        sheet = ElementTree.fromstring(archive.read("xl/worksheets/sheet1.xml"))
    assert ["".join(c.itertext()) for c in sheet.iter() if c.tag.endswith("}c")] == ["我的答案", "空数", "", "4", "b & <c>", "5"]
