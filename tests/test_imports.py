"""Files of many kinds in a folder: results, rejects, ids, questions, and the same as they arrive."""

import json

from examlake.plans.layouts import word_file
from examlake.sources import imports as M

TEXT = "1. 甲是谁？\nA. 一\nB. 二\n2. 乙？\nA. 三\nB. 四\n"


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode() if isinstance(content, str) else content)


def by_name(rows):
    return {r.path.rpartition("/")[2]: r for r in rows}


def test_a_folder(spark, tmp_path):
    box = lambda text, top: {"page": 1, "text": text, "x0": 10, "y0": top, "x1": 90, "y1": top + 10}
    put(tmp_path, "a/paper 1.txt", TEXT)
    put(tmp_path, "b/paper 1.txt", TEXT)
    put(tmp_path, "UPPER.DOCX", word_file("水"))
    put(tmp_path, "text.docx", TEXT)
    put(tmp_path, "cut.docx", word_file("水")[:300])
    put(tmp_path, "old.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")
    put(tmp_path, "word.doc", word_file("水"))
    put(tmp_path, "latin.txt", b"\xe9t\xe9")
    put(tmp_path, "none.txt", " \n")
    put(tmp_path, "noending", "x")
    put(tmp_path, "scan.json", json.dumps({"boxes": [box("1. 甲？", 10), box("A. 一", 30), box("B. 二", 50)], "more": 1}))
    put(tmp_path, "empty.json", json.dumps({"boxes": []}))
    put(tmp_path, "bare.json", json.dumps({"spans": [], "pages": []}))
    put(tmp_path, "broken.json", '{"boxes": [')
    files = M.folder(spark, f"file://{tmp_path}")
    lines = M.imported_lines(files)
    results = M.import_results(M.manifest(files), lines).collect()
    found = by_name(results)
    assert len(results) == 14 and len({r.paper_id for r in results}) == 14 and sum(r.path.endswith("paper 1.txt") for r in results) == 2
    assert {n: r.n_lines for n, r in found.items() if r.error is None} == {"paper 1.txt": 6, "UPPER.DOCX": 8, "word.doc": 8, "scan.json": 3}
    assert found["old.doc"].error.endswith(": doc") and found["text.docx"].error.endswith(": unknown") and found["cut.docx"].error.startswith("damaged file") and found["cut.docx"].kind == "docx"
    assert (found["latin.txt"].error, found["none.txt"].error, found["empty.json"].error, found["bare.json"].error) == ("not UTF-8", "no lines", "no lines", "no text layer")
    assert found["broken.json"].error == "neither page layer nor boxes" and found["noending"].error.endswith(": ")
    assert found["paper 1.txt"].paper_id.startswith("paper1-") and found["noending"].paper_id.startswith("noending-")
    asked = {(r.paper_id.split("-")[0], r.no, r.source) for r in M.imported_questions(lines).collect()}
    assert asked == {("paper1", 1, "text"), ("paper1", 2, "text"), ("UPPER", 1, "docx"), ("UPPER", 2, "docx"), ("word", 1, "docx"), ("word", 2, "docx"), ("scan", 1, "ocr")}


def test_no_files_and_files_without_content(spark):
    none = spark.createDataFrame([], "path string, content binary")
    assert M.imported_lines(none).count() == 0 and M.import_results(M.manifest(none), M.imported_lines(none)).count() == 0
    files = spark.createDataFrame([("x.txt", None)], "path string, content binary")
    assert [(r.n_lines, r.error) for r in M.import_results(M.manifest(files), M.imported_lines(files)).collect()] == [(0, "no content")]


def test_arriving_files_are_imported_once(spark, tmp_path):
    run = lambda: M.import_arriving(M.folder(spark, f"file://{tmp_path}/in", stream=True), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    put(tmp_path, "in/a.txt", TEXT)
    put(tmp_path, "in/b.pdf", "%PDF")
    run()
    put(tmp_path, "in/below/c.txt", "1. 甲？")
    run()
    run()
    seen = [(r.path.rpartition("/")[2], r.n_lines, r.error, r.batch) for r in spark.read.parquet(f"file://{tmp_path}/out/results").collect()]
    assert sorted(seen) == [("a.txt", 6, None, 0), ("b.pdf", 0, "files of this kind are not read: pdf", 0), ("c.txt", 1, None, 1)]
    assert spark.read.parquet(f"file://{tmp_path}/out/lines").groupBy("batch").count().orderBy("batch").collect() == [(0, 6), (1, 1)]
