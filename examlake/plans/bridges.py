"""Exam-shaped views of the supplied tables, in DataFrame functions and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("single", "multi", "judge", "blank", "essay")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table for each partition that its papers are dealt out to.
ROWS_A_PART = 100_000


def parts_for(of: DataFrame) -> int:
    """In how many partitions to deal out what comes from a table: as many as it has rows for, so a task holds no more of a larger table, and as many as the session has at least."""
    return max(int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-of.count() // ROWS_A_PART))


#: Files that one task makes or reads: their tables are small, and what is done for each row is not.
FILES_A_PART = 1000


def for_files(rows: DataFrame) -> DataFrame:
    """rows of a table with a file for each of them, dealt out: by its bytes alone, one task would make them all."""
    return rows.repartition(max(1, -(-rows.count() // FILES_A_PART)))


def by_paper(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """rows by their paper in parts_for(of) partitions; few rows stay in as many as adaptive execution finds."""
    parts = parts_for(of)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each order, a question for each of its lines that has a part."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    # joined first: what follows paper by paper then needs no further exchange
    out = by_paper(line.join(part, "l_partkey"), line, "l_orderkey").withColumn("seq", F.row_number().over(order))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    n_options = (F.col("l_quantity").cast("int") % 9).cast("int")
    return out.select(
        F.col("l_orderkey").alias("paper_id"), "seq", F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("unit"), F.col("l_linenumber").alias("no"),
        F.element_at(kinds, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("type"), F.when(F.col("l_partkey") % 17 == 0, "").otherwise(F.col("p_name")).alias("stem"),
        F.transform(F.when(n_options > 0, F.sequence(F.lit(1), n_options)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("o"), i.cast("string"))).alias("options"),
        (F.col("l_partkey") % 3).cast("int").alias("blanks"), F.when(F.col("l_suppkey") % 7 == 0, "yes").alias("image"), F.when(F.col("l_partkey") % 4 == 0, "ocr").otherwise("text").alias("source"),
        F.array().cast("array<string>").alias("issues"),
    )


QUESTIONS = """questions AS (
    SELECT l_orderkey AS paper_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS seq,
        CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS unit, l_linenumber AS no,
        (['single', 'multi', 'judge', 'blank', 'essay'])[CAST(l_suppkey % 5 + 1 AS INTEGER)] AS type,
        CASE WHEN l_partkey % 17 = 0 THEN '' ELSE p_name END AS stem,
        list_transform(generate_series(1, CAST(trunc(l_quantity) AS INTEGER) % 9), lambda i: 'o' || i) AS options,
        CAST(l_partkey % 3 AS INTEGER) AS blanks, CASE WHEN l_suppkey % 7 = 0 THEN 'yes' END AS image,
        CASE WHEN l_partkey % 4 = 0 THEN 'ocr' ELSE 'text' END AS source
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ISSUES = (
    QUESTIONS
    + """, numbered AS (SELECT *, lag(no) OVER (PARTITION BY paper_id, unit ORDER BY seq) AS before, len(options) AS n FROM questions),
    checked AS (SELECT *, list_filter([
        CASE WHEN no <> before + 1 THEN '题号不连续：上一题 ' || before || '，本题 ' || no END,
        CASE WHEN type IN ('single', 'multi') AND n < 2 THEN '选项只有 ' || n || ' 个' END,
        CASE WHEN type IN ('single', 'multi') AND n > 7 THEN '选项多达 ' || n || ' 个，可能粘连了下一题' END,
        CASE WHEN type = 'blank' AND blanks < 1 THEN '填空题没有空位' END,
        CASE WHEN trim(stem) = '' AND image IS NULL THEN '题干为空' END,
        CASE WHEN length(stem) > 600 THEN '题干过长，可能混入了解析或材料' END,
        CASE WHEN source = 'ocr' AND type = 'single' AND n BETWEEN 1 AND 3 THEN 'OCR 卷选项不足 4 个' END,
        CASE WHEN source = 'ocr' AND length(stem) BETWEEN 1 AND 5 AND image IS NULL THEN 'OCR 卷题干过短' END], lambda x: x IS NOT NULL) AS issues FROM numbered)"""
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt a paper: the answers to the questions whose order line has more than ten pieces, the last line of a key counts."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    unit = F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag"))
    letters = F.array(F.lit("C"), F.when(F.col("l_partkey") % 2 == 0, "A").otherwise(""), F.when(F.col("l_partkey") % 3 == 0, " B").otherwise(""))
    empty = F.array(F.lit(""), F.lit(" "))
    return line.select(
        (F.col("l_orderkey") * 10).alias("attempt_id"), F.col("l_orderkey").alias("paper_id"), F.concat_ws("|", unit, F.col("l_linenumber").cast("string")).alias("key"),
        F.when(F.col("l_partkey") % 5 == 0, empty).otherwise(letters).alias("values"), (F.col("l_suppkey") % 2 == 0).alias("is_list"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("saved_at"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).where("saved_at % 11 = 0").select("attempt_id", "key")


ANSWERS = """saved AS (
    SELECT l_orderkey * 10 AS attempt_id, l_orderkey AS paper_id, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END || '|' || l_linenumber AS key,
        CASE WHEN l_partkey % 5 = 0 THEN ['', ' '] ELSE ['C', CASE WHEN l_partkey % 2 = 0 THEN 'A' ELSE '' END, CASE WHEN l_partkey % 3 = 0 THEN ' B' ELSE '' END] END AS vals,
        l_suppkey % 2 = 0 AS is_list, l_partkey * 100000 + l_suppkey AS saved_at
    FROM lineitem WHERE l_quantity > 10),
    answers AS (SELECT * FROM saved QUALIFY row_number() OVER (PARTITION BY attempt_id, key ORDER BY saved_at DESC) = 1),
    marks AS (SELECT DISTINCT attempt_id, key, true AS marked FROM saved WHERE saved_at % 11 = 0)"""

SUMMARY = (
    QUESTIONS
    + ", "
    + ANSWERS
    + """, summary AS (
    SELECT t.attempt_id, q.paper_id, q.seq, q.unit, q.no, CASE q.type WHEN 'single' THEN '单选' WHEN 'multi' THEN '多选' WHEN 'judge' THEN '判断' WHEN 'blank' THEN '填空' ELSE '简答' END AS type,
        CASE WHEN a.vals IS NULL THEN ''
            WHEN q.type IN ('single', 'multi', 'judge') AND a.is_list THEN array_to_string(list_sort(list_filter(a.vals, lambda x: x <> '')), ' ')
            WHEN q.type IN ('single', 'multi', 'judge') THEN array_to_string(list_transform(a.vals, lambda x: trim(x)), '')
            WHEN q.type = 'blank' THEN CASE WHEN len(list_filter(a.vals, lambda x: trim(x) <> '')) > 0 THEN array_to_string(list_transform(a.vals, lambda x: trim(x)), '；') ELSE '' END
            ELSE regexp_replace(array_to_string(a.vals, chr(10)), '^ +| +$', '', 'g') END AS answer,
        coalesce(m.marked, false) AS marked, q.unit || '|' || q.no AS key
    FROM questions q JOIN (SELECT DISTINCT attempt_id, paper_id FROM answers) t USING (paper_id)
    LEFT JOIN answers a ON a.attempt_id = t.attempt_id AND a.key = q.unit || '|' || q.no
    LEFT JOIN marks m ON m.attempt_id = t.attempt_id AND m.key = q.unit || '|' || q.no)"""
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers of ten lines a page; lines of the heights 0, 80, ... of a page of 800."""
    from ..sources.text import text_lines

    lines = text_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text"))
    return lines.select("paper_id", "pos", "text", (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), (F.col("pos") % 10 * 80.0).alias("y"), F.lit(800.0).alias("page_height"))


LINES = r"""parts AS (SELECT doc_id AS paper_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT paper_id, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM parts) WHERE regexp_replace(parts[i], '^\s+|\s+$', '', 'g') <> '')"""

REPEATED = (
    LINES
    + r""", pages AS (SELECT *, CAST(pos // 10 + 1 AS INTEGER) AS page, pos % 10 * 80.0 AS y, regexp_replace(text, '\s+', '', 'g') AS norm FROM lines),
    counted AS (SELECT paper_id, count(DISTINCT page) AS n_pages FROM pages GROUP BY 1),
    repeated AS (SELECT paper_id, norm FROM pages JOIN counted USING (paper_id) WHERE n_pages >= 3 AND length(norm) >= 4 AND NOT regexp_full_match(norm, '[^\pL\pN]+')
        GROUP BY paper_id, norm, n_pages HAVING count(DISTINCT page) >= greatest(3, n_pages * 0.5))"""
)
