"""Folders of JSON files as a data source: lookups by key, drafts, damaged files, writing."""

import json

from examlake.sources import files as X


def paper(i, **more):
    return json.dumps({"id": i, "title": "t" + i, "questions": [{"no": 1, "stem": "甲"}]} | more, ensure_ascii=False, indent=1)


def test_papers_drafts_and_damaged_files(spark, tmp_path):
    for name, text in (("a", paper("a")), ("b", paper("b")), ("draft", paper("d")), ("cut", paper("c")[:20]), ("list", "[1]"), ("empty", ""), ("noid", '{"title": "x"}')):
        (tmp_path / f"{name}.json").write_text(text, "utf-8")
    (tmp_path / "bytes.json").write_bytes(b'{"id": "\xff"}')
    (tmp_path / "other.txt").write_text("x")
    files = X.exam_files(spark, f"file://{tmp_path}")
    assert sorted((r.id, r.title, r.questions[0].stem) for r in X.papers_in(files).collect()) == [("a", "ta", "甲"), ("b", "tb", "甲")]
    assert sum(r.n for r in X.damaged(files).collect()) == 4
    assert X.exam_files(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_a_lookup_opens_one_file(spark, tmp_path):
    for i in "abc":
        (tmp_path / f"{i}.json").write_text(paper(i), "utf-8")
    reader = X.ExamFilesReader({"path": f"file://{tmp_path}", "ids": '["b"]'})
    assert [p.found for p in reader.partitions()] == [[("", ["b"])]]
    # the others can't be opened: a scan would say so
    for i in "ac":
        (tmp_path / f"{i}.json").write_bytes(b"\xff")
    look = lambda *ids: X.exam_files(spark, f"file://{tmp_path}", ids=ids)
    assert [r.id for r in X.papers_in(look("b")).collect()] == ["b"] and look("b").where("error is not null").count() == 0
    assert sorted((r.id, r.error is None) for r in look("b", "c", "none", "../b", "draft").collect()) == [("b", True), ("c", False)]
    files = X.exam_files(spark, f"file://{tmp_path}")
    assert look("b").unionByName(files).unionByName(look("a")).groupBy("id").count().orderBy("id").collect() == [("a", 2), ("b", 2), ("c", 1)]


def test_attempts_lie_in_folders(spark, tmp_path):
    attempt = lambda i, p: json.dumps({"id": i, "paper_id": p, "submitted_at": "2024", "rows": [{"no": 1, "answer": "A"}]})
    rows = [("p1", "20240101-100000"), ("p1", "20240102-100000"), ("p2", "20240103-100000")]
    X.write_files(spark.createDataFrame([(p, i, attempt(i, p)) for p, i in rows], "folder string, id string, json string"), f"file://{tmp_path}")
    (tmp_path / "p1" / "draft.json").write_text("{}")
    of = lambda **keys: X.exam_files(spark, f"file://{tmp_path}", nested=True, **keys)
    assert [(r.paper_id, r.id) for r in X.attempts_in(of()).collect()] == [("p2", rows[2][1]), ("p1", rows[1][1]), ("p1", rows[0][1])]
    assert [r.id for r in X.attempts_in(of(folders=["p1"])).collect()] == [rows[1][1], rows[0][1]]
    assert [r.id for r in of(folders=["p1"], ids=["20240101-100000"]).collect()] == [rows[0][1]]
    X.write_files(spark.createDataFrame([("p2", rows[2][1], attempt("new", "p2"))], "folder string, id string, json string"), f"file://{tmp_path}")
    assert [r.id for r in X.attempts_in(of(folders=["p2"])).collect()] == ["new"]
    assert not [p for p in tmp_path.rglob(".*") if ".json" not in p.name]  # nothing half written is left
