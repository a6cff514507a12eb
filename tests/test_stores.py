"""Papers as JSON, changes by key, and streams of saves and papers."""

import json
import time

from examlake.operators.rewriting import rewritten, rewritten_chunks, text_chunks
from examlake.sources import papers as P
from examlake.streaming.saves import latest_saves, parse_arriving, saves_an_hour


def paper(i, **more):
    return {"id": f"p{i}", "title": f"t{i}", "source": "s", "import_path": "text", "created_at": "2024", "units": ["甲"], "questions": [{"unit": "甲", "no": 1, "type": "single", "stem": "x", "options": ["a"], "reviewed": i % 2 == 0, "issues": []}, {"no": 2, "type": "blank"}], "raw_text": "r"} | more


def test_json_papers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(paper(1), ensure_ascii=False) + "\n{broken\n" + json.dumps(paper(2)) + "\n", "utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"title": "no id"}) + "\n" + json.dumps(paper(3, unknown=1)) + "\n", "utf-8")
    table = P.read_json(spark, f"file://{tmp_path}")
    assert sorted(r.id for r in table.collect()) == ["p1", "p2", "p3"]
    again = P.from_json(P.as_json(table))
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect())) and again.schema == table.schema
    attempts = spark.createDataFrame([("p1",), ("p1",), ("x",)], "paper_id string")
    assert sorted((r.id, r["count"], r.to_review, r.attempts) for r in P.listed(table, attempts).collect()) == [("p1", 2, 1, 2), ("p2", 2, 0, 0), ("p3", 2, 1, 0)]
    new = table.where("id = 'p2'").withColumn("title", P.safe_id("title")).unionByName(table.where("id = 'p1'").withColumn("id", P.F.lit("p9")))
    assert sorted(r.id for r in P.upserted(table, new, "id").collect()) == ["p1", "p2", "p3", "p9"]
    assert [r.id for r in P.orphaned(table.where("id < 'p3'"), table.where("id = 'p1'")).collect()] == ["p2"]


def test_one_paper_a_file(spark, tmp_path):
    for name, i in (("p1.json", 1), ("p2.json", 2), ("draft_p3.json", 3)):
        (tmp_path / name).write_text(json.dumps(paper(i), ensure_ascii=False, indent=1), "utf-8")
    (tmp_path / "broken.json").write_text("{\n 'id': ", "utf-8")
    table = P.read_json(spark, f"file://{tmp_path}", one_a_file=True)
    assert [r.id for r in P.listed(table, spark.createDataFrame([], "paper_id string")).collect()] == ["p2", "p1"]


def test_a_last_line_end_begins_no_line(spark):
    text = "\n".join(f"{k}. 题" for k in range(1, 26))
    rows = text_chunks(spark.createDataFrame([(1, text + "\n"), (2, text), (3, "1. 题\n")], "paper_id long, text string")).collect()
    found = {(r.paper_id, r.chunk): r.text for r in rows}
    assert found[1, 1] == found[2, 1] and found[1, 1].endswith("25. 题") and found[3, 0] == "1. 题\n"


def test_failing_and_slow_chunks(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def rewriter(text):
        if "slow" in text:
            time.sleep(0.5)
        if "bad" in text:
            raise ValueError("no")
        if "once" in text:
            try:
                open(seen, "x").close()
            except FileExistsError:
                return text.upper()
            raise OSError("busy")
        return text.upper()

    chunks = spark.createDataFrame([(1, k, t) for k, t in enumerate(["slow a", "b", "bad c", "once d", "e"])], "paper_id long, chunk int, text string").coalesce(1)
    rows = rewritten_chunks(chunks, rewriter, parallel=3, delays=(0.0, 0.0)).collect()
    assert [(r.chunk, r.text, r.error) for r in rows] == [(0, "SLOW A", None), (1, "B", None), (2, "bad c", "ValueError: no"), (3, "ONCE D", None), (4, "E", None)]
    assert [tuple(r) for r in rewritten(chunks, rewriter, delays=()).collect()] == [(1, "SLOW A\n\nB\n\nbad c\n\nONCE D\n\nE", 1)]


def test_attempts(spark):
    drafts = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "paper_id string, user_id int")
    done = drafts.where("user_id = 1")
    kept, left = P.submitted(done.limit(0), drafts, done)
    assert kept.count() == 2 and [tuple(r) for r in left.collect()] == [("p", 2)]


def test_streams(spark, tmp_path):
    saves = "paper_id long, user_id long, saved_at timestamp, save_id long"
    rows = [(1, 1, "2024-01-01 10:00:00", 1), (1, 1, "2024-01-01 10:30:00", 2), (1, 1, "2024-01-01 10:30:00", 3), (2, 1, "2024-01-01 12:00:00", 4)]
    spark.createDataFrame(rows, "paper_id long, user_id long, saved_at string, save_id long").selectExpr("paper_id", "user_id", "cast(saved_at as timestamp) saved_at", "save_id").write.parquet(f"file://{tmp_path}/saves")
    stream = spark.readStream.schema(saves).parquet(f"file://{tmp_path}/saves")
    for name, query, mode in (("last", latest_saves(stream), "complete"), ("hours", saves_an_hour(stream), "update")):
        query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.paper_id, r.save_id) for r in spark.table("last").collect()) == [(1, 3), (2, 4)]
    assert sorted((r.paper_id, r.saves) for r in spark.table("hours").collect()) == [(1, 3), (2, 1)]
    spark.createDataFrame([(1, "1. 甲？\nA. 一\nB. 二"), (2, None)], "paper_id long, text string").write.parquet(f"file://{tmp_path}/papers")
    found = []
    parse_arriving(spark.readStream.schema("paper_id long, text string").parquet(f"file://{tmp_path}/papers"), lambda df, n: found.extend(df.withColumn("image", P.F.col("image")).collect()), f"file://{tmp_path}/checkpoint").awaitTermination()
    assert [(r.paper_id, r.no, r.reviewed) for r in found] == [(1, 1, True)]
