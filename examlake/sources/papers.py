"""Papers, attempts and drafts as tables: JSON in and out, changes by key as joins. A change gives the new table; where it is written is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "struct<unit: string, no: int, type: string, stem: string, options: array<string>, blanks: int, image: string, crop: string, `group`: string, material: string, material_crop: string, "
    "m_page: int, m_y0: double, reviewed: boolean, issues: array<string>, page: int, y0: double, end_page: int, y1: double, source: string>"
)
PAPER = f"id string, title string, source string, import_path string, created_at string, units array<string>, questions array<{QUESTION}>, raw_text string"
ATTEMPT = "id string, paper_id string, submitted_at string, marks array<string>, unanswered array<string>, rows array<struct<unit: string, no: int, type: string, answer: string, marked: boolean, key: string>>"


def safe_id(name: Column | str) -> Column:
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"[^A-Za-z0-9_\-]", "")


def read_json(spark: SparkSession, path: str, schema: str = PAPER, one_a_file: bool = False, drafts: str = "draft") -> DataFrame:
    """The papers (or attempts) in a folder of JSON files, one a line, or (one_a_file) one in each file on any number of lines. What doesn't parse is dropped, and so are files whose name begins with `drafts`."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", one_a_file).json(path)
    return rows.where("id is not null").where(~F.col("_metadata.file_name").startswith(drafts))


def as_json(papers: DataFrame) -> DataFrame:
    """id, json: each row as one JSON text."""
    return papers.select("id", F.to_json(F.struct(*papers.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame, schema: str = PAPER) -> DataFrame:
    """Rows (json) as papers; texts that aren't such JSON are dropped."""
    return rows.select(F.from_json("json", schema).alias("p")).where("p.id is not null").select("p.*")


def upserted(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """table with rows in place of those of equal keys."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def without(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """table without the rows of these keys: deleting a paper, its attempts and its pictures."""
    return table.join(rows.select(*key), list(key), "left_anti")


def orphaned(drafts: DataFrame, papers: DataFrame) -> DataFrame:
    """Of deleted drafts (id), those without a confirmed copy: their pictures may go."""
    return drafts.join(papers.select("id"), "id", "left_anti")


def latest_drafts(saves: DataFrame) -> DataFrame:
    """The last save (saved_at, then save_id) of each attempt's draft: paper_id, user_id, ..."""
    columns = [c for c in saves.columns if c not in ("paper_id", "user_id")]
    return saves.groupBy("paper_id", "user_id").agg(F.max_by(F.struct(*columns), F.struct("saved_at", "save_id")).alias("last")).select("paper_id", "user_id", "last.*")


def submitted(attempts: DataFrame, drafts: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """attempts with those handed in (done: the columns of attempts), and the drafts (paper_id, user_id) that are left."""
    return attempts.unionByName(done), without(drafts, done, "paper_id", "user_id")


def listed(papers: DataFrame, attempts: DataFrame) -> DataFrame:
    """id, title, source, import_path, created_at, count, to_review, attempts of papers (PAPER) and attempts (paper_id), by falling id."""
    n = attempts.groupBy("paper_id").agg(F.count("*").alias("attempts")).withColumnRenamed("paper_id", "id")
    review = F.size(F.filter("questions", lambda q: ~F.coalesce(q["reviewed"], F.lit(True))))
    rows = papers.select("id", "title", "source", "import_path", "created_at", F.coalesce(F.size("questions"), F.lit(0)).alias("count"), F.coalesce(review, F.lit(0)).alias("to_review"))
    return rows.join(n, "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).orderBy(F.desc("id"))


def clipboard(summary: DataFrame, unanswered: str = "未作答") -> DataFrame:
    """attempt_id, text: an attempt's summary (attempt_id, seq, unit, no, type, answer) with tabs; units only if there is any."""
    has = F.max(F.col("unit") != "")
    row = F.struct("seq", "unit", F.concat_ws("\t", F.col("no").cast("string"), "type", F.when(F.col("answer") == "", unanswered).otherwise(F.col("answer"))).alias("line"))
    rows = summary.groupBy("attempt_id").agg(has.alias("has"), F.array_sort(F.collect_list(row)).alias("rows"))
    prefix = lambda unit, line: F.when(F.col("has"), F.concat(unit, F.lit("\t"), line)).otherwise(line)
    lines = F.concat(F.array(prefix(F.lit("单元"), F.lit("题号\t题型\t我的答案"))), F.transform("rows", lambda r: prefix(r["unit"], r["line"])))
    return rows.select("attempt_id", F.array_join(lines, "\n").alias("text"))
