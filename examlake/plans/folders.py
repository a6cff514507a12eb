"""Queries on folders of files: papers one a file, files of many kinds; and on autosaves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as X
from ..sources import imports as M
from ..sources.store import scratch
from ..streaming.settled import settled_saves as settled
from . import bridges as B
from .layouts import word_file

#: Seconds after which a save is kept in the query: events of one user lie far apart.
QUIET = 7200.0


def paper_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each customer, one in a file; damaged files and drafts among them. All papers that are found, how many files were damaged, and papers looked up by id."""
    question = lambda n: F.struct(F.lit("甲").alias("unit"), n.cast("int").alias("no"), F.col("c_mktsegment").alias("stem"), (n % 2 == 0).alias("reviewed"))
    papers = B.for_files(B.table(spark, sf_dir, "customer")).select("c_custkey", F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 5 + 1).cast("int")), question).alias("questions"))
    json = F.to_json(F.struct("id", "title", "questions"), {"pretty": "true"})
    rows = papers.select("c_custkey", "id", F.when(F.col("c_custkey") % 11 == 0, F.left(json, F.lit(30))).otherwise(json).alias("json"))
    path = scratch(spark)
    X.write_files(rows, path)
    X.exam_files(spark, path).write.parquet(f"{path}-read")  # each file is opened once, for papers and for damages
    files = spark.read.parquet(f"{path}-read")
    listed = lambda what, found: X.papers_in(found).select(F.lit(what).alias("what"), "id", "title", F.size("questions").cast("long").alias("n"))
    wanted = [str(k) for k in range(5, 60, 5)]
    lost = X.damaged(files).select(F.lit("damaged").alias("what"), F.lit("").alias("id"), F.col("error").alias("title"), "n")
    return listed("all", files).unionByName(listed("looked up", X.exam_files(spark, path, ids=wanted))).unionByName(lost)


def settled_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves after which a user is quiet for two hours; purchases hand in."""
    saves = B.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("paper_id"), "user_id", F.col("ts").alias("saved_at"), F.col("event_id").alias("save_id"), F.col("props").alias("answers"), (F.col("event_type") == "purchase").alias("done"))
    return settled(saves.unionByName(saves.where("save_id % 3 = 0")), QUIET).select("paper_id", "user_id", "save_id", "answers")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a file for each customer, of eight kinds; texts, names and places vary with its columns."""

    def word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [word_file(name) for name in batch.column("c_name").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary())], names=["path", "content"])

    rows = B.for_files(B.table(spark, sf_dir, "customer")).withColumn("k", F.col("c_custkey") % 8)
    place = lambda ending: F.concat(F.lit("in/"), F.col("c_mktsegment"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(f".{ending}"))
    y, text = F.col("c_nationkey").cast("double"), lambda *parts: F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.col(p) for p in parts])
    # the second row of boxes is lower where the nation's key is even: then a picture lies between them
    box = lambda x0, x1, top, t: F.struct(F.lit(1).alias("page"), t.alias("text"), F.lit(x0).alias("x0"), (top).alias("y0"), F.lit(x1).alias("x1"), (top + 10).alias("y1"))
    boxes = F.struct(F.array(box(10.0, 20.0, y, F.lit("1.")), box(25.0, 95.0, y, F.col("c_name")), box(10.0, 90.0, y + F.when(y % 2 == 0, 200.0).otherwise(20.0), text("=A. ", "c_mktsegment"))).alias("boxes"))
    span = lambda block, top, t: F.struct(F.lit(1).alias("page"), F.lit(block).alias("block"), F.lit(1).alias("line"), F.lit(0).alias("span"), t.alias("text"), F.lit(50.0).alias("x0"), top.alias("y0"), F.lit(300.0).alias("x1"), (top + 10).alias("y1"), F.lit(10.0).alias("size"), F.lit(False).alias("sup"), F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))
    long = F.when(F.col("c_custkey") % 16 < 8, F.repeat("c_mktsegment", F.lit(8))).otherwise(F.col("c_mktsegment"))
    layer = F.struct(F.array(F.struct(F.lit(1).alias("page"), F.lit(800.0).alias("height"))).alias("pages"), F.array(span(2, y + 200, long), span(1, y + 100, text("=1. ", "c_name"))).alias("spans"), F.array().cast(f"array<struct<{M.IMAGE}>>").alias("images"))
    pasted = text("=1. ", "c_name", "=？\n\n  A. ", "c_mktsegment", "=\n")
    content = F.encode(F.when(F.col("k") == 0, pasted).when(F.col("k") == 3, F.to_json(boxes)).when(F.col("k") == 4, F.to_json(layer)).when(F.col("k") == 2, F.concat(F.lit("PK\x03\x04 "), "c_name")).when(F.col("k") == 6, F.lit(" \n")).otherwise(F.col("c_name")), "UTF-8")
    endings = {0: "TXT", 2: "docx", 3: "json", 4: "json", 5: "pdf", 6: "txt", 7: "json"}
    path = F.coalesce(*[F.when(F.col("k") == k, place(e)) for k, e in endings.items()])
    plain = rows.where("k <> 1").select(path.alias("path"), content.alias("content"))
    return plain.unionByName(rows.where("k = 1").select(place("docx").alias("path"), "c_name").mapInArrow(word, "path string, content binary"))


def mixed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file, with the texts of its lines."""
    path = scratch(spark)
    _files(spark, sf_dir).write.parquet(f"{path}/files")  # as they would lie in a folder, made once
    results, lines = M.imported(spark.read.parquet(f"{path}/files"), path)
    texts = lines.where("text <> ''").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "/").alias("texts"))
    results = results.join(texts, "paper_id", "left")
    shown = F.regexp_replace("error", r"^damaged file: .*", "damaged file")
    return results.select("path", F.regexp_extract("paper_id", "^(.*)-[0-9a-f]{16}$", 1).alias("name"), "kind", "n_lines", "texts", shown.alias("error"))


QUERIES = {f.__name__: f for f in (paper_files, settled_saves, mixed_import)}

ORACLE_SQL = {
    "paper_files": """WITH p AS (SELECT 'all' AS what, c_custkey AS k, c_name AS title, c_custkey % 5 + 1 AS n FROM customer WHERE c_custkey % 11 <> 0) SELECT what, CAST(k AS VARCHAR) AS id, title, n FROM p
        UNION ALL SELECT 'looked up', CAST(k AS VARCHAR), title, n FROM p WHERE k BETWEEN 5 AND 59 AND k % 5 = 0
        UNION ALL SELECT 'damaged', '', 'damaged: JSONDecodeError', count(*) FILTER (c_custkey % 11 = 0) FROM customer HAVING count(*) FILTER (c_custkey % 11 = 0) > 0""",
    "settled_saves": f"""WITH f AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
        SELECT user_id % 50 AS paper_id, user_id, event_id AS save_id, props AS answers FROM f WHERE event_type <> 'purchase' AND (next IS NULL OR epoch_us(next) - epoch_us(ts) >= {round(QUIET * 1_000_000)})""",
    "mixed_import": """WITH c AS (SELECT *, c_custkey % 8 AS k, c_custkey % 16 < 8 AS long FROM customer), r AS (SELECT *, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'docx' WHEN 2 THEN 'docx' WHEN 3 THEN 'boxes' WHEN 4 THEN 'layer' WHEN 6 THEN 'text' END AS kind,
            CASE k WHEN 0 THEN '1. ' || c_name || '？/A. ' || c_mktsegment WHEN 1 THEN '期末试卷/1. ' || c_name || ' 的化学式是____。/2. 第二题？/A. 甲 B. 乙/C. 丙/年份  产量/' || c_name || '  5' WHEN 3 THEN '1. ' || c_name || '/A. ' || c_mktsegment
                WHEN 4 THEN CASE WHEN long THEN '1. ' || c_name || '/' || repeat(c_mktsegment, 8) END END AS texts,
            CASE k WHEN 2 THEN 'damaged file' WHEN 4 THEN CASE WHEN NOT long THEN 'no text layer' END WHEN 5 THEN 'files of this kind are not read: pdf' WHEN 6 THEN 'no lines' WHEN 7 THEN 'neither page layer nor boxes' END AS error FROM c)
        SELECT 'in/' || c_mktsegment || '/c' || c_custkey || (['.TXT', '.docx', '.docx', '.json', '.json', '.pdf', '.txt', '.json'])[CAST(k + 1 AS INTEGER)] AS path, 'c' || c_custkey AS name, kind,
            CAST(CASE WHEN texts IS NULL THEN 0 ELSE length(texts) - length(replace(texts, '/', '')) + 1 + CASE WHEN k = 1 OR k = 3 AND c_nationkey % 2 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS n_lines, texts, error FROM r""",
}
