"""The queries of the exam-document engine and the same questions as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display_label, ends_sentence, masked, question_key, section_type, slug, weighted_length
from ..operators.layout import repeated_strings, without_furniture
from ..operators.reports import answer_summary, attempt_listing, exported_paper, exported_summary, latest_answers, paper_listing, paper_units, unanswered
from ..operators.validation import validated
from ..sources.text import text_lines
from . import bridges as B
from . import editing, folders, layouts, typeset


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text scan over all documents."""
    papers = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return text_lines(papers).select("paper_id", "pos", "text", "blanks")


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions on all lines."""
    text = F.col("text")
    return document_lines(spark, sf_dir).select(
        "paper_id", "pos", F.round(weighted_length("text"), 2).alias("width"), ends_sentence("text").alias("ends"), section_type(F.concat(F.lit("一、"), text)).alias("kind"), slug(F.left(text, F.lit(12))).alias("slug"), masked("text").alias("masked")
    )


def full_line_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of a full line of each page: the element at nine tenths of its sorted widths."""
    rows = B.pages(spark, sf_dir).select("paper_id", "page", F.round(weighted_length("text"), 2).alias("width"))
    widths = F.array_sort(F.collect_list("width"))
    return rows.groupBy("paper_id", "page").agg(widths.alias("widths")).select("paper_id", "page", F.get("widths", F.floor(F.size("widths") * 0.9).cast("int")).alias("full"))


def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(B.pages(spark, sf_dir))


def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without headers, watermarks, separators and page numbers."""
    return without_furniture(B.pages(spark, sf_dir)).select("paper_id", "pos", "page")


def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(B.questions(spark, sf_dir)).select("paper_id", "seq", F.size("issues").cast("long").alias("n_issues"), F.array_join("issues", ";").alias("issues"), "reviewed")


def validation_by_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validated(B.questions(spark, sf_dir)).select("paper_id", F.explode("issues").alias("issue"))
    return found.groupBy(F.substring("issue", 1, 6).alias("issue")).agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_listing(validated(B.questions(spark, sf_dir)))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_units(B.questions(spark, sf_dir))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_summary(B.questions(spark, sf_dir), latest_answers(B.answers(spark, sf_dir)), B.marks(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempt_listing(_summary(spark, sf_dir))


def unanswered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unanswered(_summary(spark, sf_dir))


def summary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported_summary(_summary(spark, sf_dir))


def paper_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported_paper(B.questions(spark, sf_dir))


def keys_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that several questions of a paper share, with their label."""
    keyed = B.questions(spark, sf_dir).select("paper_id", question_key().alias("key"), display_label().alias("label"))
    return keyed.groupBy("paper_id", "key", "label").agg(F.count("*").alias("n")).where("n > 1")


def question_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most twenty questions of a paper, in order."""
    rows = B.questions(spark, sf_dir).select("paper_id", F.floor((F.col("seq") - 1) / 20).cast("int").alias("chunk"), "seq")
    return rows.groupBy("paper_id", "chunk").agg(F.min("seq").alias("first"), F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of all papers after validation."""
    return listing(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (document_lines, text_functions, full_line_width, repeated_headers, body_lines, validation_verdict, validation_by_issue, listing, units, summary, attempts, unanswered_labels, summary_sheet, paper_sheet, keys_and_labels, question_chunks)
} | typeset.QUERIES | editing.QUERIES | layouts.QUERIES | folders.QUERIES

_WIDTH = r"round(length(regexp_replace(text, '[\x{0}-\x{2E80}]', '', 'g')) + length(regexp_replace(text, '[^\x{0}-\x{2E80}]', '', 'g')) * 0.55, 2)"
ORACLE_SQL: dict[str, str] = {
    "document_lines": f"WITH {B.LINES} SELECT paper_id, pos, text, CAST(len(regexp_extract_all(text, '[_＿]{{2,}}')) AS INTEGER) AS blanks FROM lines",
    "text_functions": rf"""WITH {B.LINES} SELECT paper_id, pos, CAST({_WIDTH} AS DOUBLE) AS width, regexp_matches(text, '[。．.！!？?：:；;）)”"」』]$') AS ends, 'single' AS kind,
        coalesce(nullif(regexp_replace(left(text, 12), '[^A-Za-z0-9_\-]', '', 'g'), ''), 'paper') AS slug, '******' || right(text, 4) AS masked FROM lines""",
    "full_line_width": f"""WITH {B.REPEATED} SELECT paper_id, page, (list_sort(list(CAST({_WIDTH} AS DOUBLE))))[CAST(floor(count(*) * 0.9) AS INTEGER) + 1] AS "full" FROM pages GROUP BY ALL""",
    "repeated_headers": f"WITH {B.REPEATED} SELECT paper_id, norm FROM repeated",
    "body_lines": rf"""WITH {B.REPEATED}, rest AS (SELECT * FROM pages ANTI JOIN repeated USING (paper_id, norm))
        SELECT paper_id, pos, page FROM rest p WHERE NOT (length(norm) <= 3 AND EXISTS (SELECT 1 FROM repeated r WHERE r.paper_id = p.paper_id AND contains(r.norm, p.norm)))
        AND NOT (regexp_full_match(norm, '[^\pL\pN]+') AND length(norm) >= 6)
        AND NOT ((y < 56 OR y > 736) AND regexp_full_match(text, '\s*(第\s*\d+\s*页.*|[-—–]?\s*\d{{1,3}}\s*[-—–]?|\d+\s*/\s*\d+)\s*'))""",
    "validation_verdict": f"WITH {B.ISSUES} SELECT paper_id, seq, len(issues) AS n_issues, array_to_string(issues, ';') AS issues, len(issues) = 0 AS reviewed FROM checked",
    "validation_by_issue": f"WITH {B.ISSUES} SELECT left(issue, 6) AS issue, count(*) AS n, count(DISTINCT paper_id) AS papers FROM (SELECT paper_id, unnest(issues) AS issue FROM checked) GROUP BY 1",
    "listing": f"""WITH {B.ISSUES} SELECT paper_id, count(*) AS n_questions, count(*) FILTER (len(issues) > 0) AS n_to_review, count(image) AS n_with_image,
        {', '.join(f"count(*) FILTER (type = '{k}') AS n_{k}" for k in B.KINDS)} FROM checked GROUP BY paper_id""",
    "units": f"WITH {B.QUESTIONS} SELECT paper_id, string_agg(unit, ',' ORDER BY seq) AS units FROM (SELECT paper_id, unit, min(seq) AS seq FROM questions WHERE unit <> '' GROUP BY 1, 2) GROUP BY 1",
    "summary": f"WITH {B.SUMMARY} SELECT * FROM summary",
    "attempts": f"WITH {B.SUMMARY} SELECT attempt_id, paper_id, count(*) FILTER (answer <> '') AS answered, count(*) AS total FROM summary GROUP BY 1, 2",
    "unanswered_labels": f"WITH {B.SUMMARY} SELECT attempt_id, paper_id, string_agg(CASE WHEN unit <> '' THEN unit || '-' ELSE '' END || no, ',' ORDER BY seq) AS labels FROM summary WHERE answer = '' GROUP BY 1, 2",
    "summary_sheet": f"WITH {B.SUMMARY} SELECT attempt_id, seq, unit, no, type, CASE WHEN answer = '' THEN '未作答' ELSE answer END AS answer, CASE WHEN marked THEN '★' ELSE '' END AS mark FROM summary",
    "paper_sheet": f"""WITH {B.QUESTIONS} SELECT paper_id, seq, unit, no, CASE type WHEN 'single' THEN '单选' WHEN 'multi' THEN '多选' WHEN 'judge' THEN '判断' WHEN 'blank' THEN '填空' ELSE '简答' END AS type, stem,
        {', '.join(f"coalesce(options[{i + 1}], '') AS {x}" for i, x in enumerate('ABCDEFG'))}, blanks FROM questions""",
    "keys_and_labels": f"WITH {B.QUESTIONS} SELECT paper_id, unit || '|' || no AS key, CASE WHEN unit <> '' THEN unit || '-' ELSE '' END || no AS label, count(*) AS n FROM questions GROUP BY ALL HAVING count(*) > 1",
    "question_chunks": f"WITH {B.QUESTIONS} SELECT paper_id, CAST((seq - 1) // 20 AS INTEGER) AS chunk, min(seq) AS first, count(*) AS n FROM questions GROUP BY 1, 2",
} | typeset.ORACLE_SQL | editing.ORACLE_SQL | layouts.ORACLE_SQL | folders.ORACLE_SQL
