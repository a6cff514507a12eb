"""Listings of papers and attempts, answer summaries and lists of unanswered questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TYPE_LABELS, display_label, formatted_answer, question_key, type_label

UNANSWERED, MARK = "未作答", "★"


def paper_listing(questions: DataFrame) -> DataFrame:
    """paper_id, n_questions, n_to_review (a missing verdict counts as reviewed), n_with_image and a count for each type."""
    counts = [F.count_if(F.col("type") == kind).alias(f"n_{kind}") for kind in TYPE_LABELS]
    return questions.groupBy("paper_id").agg(
        F.count("*").alias("n_questions"), F.count_if(~F.coalesce("reviewed", F.lit(True))).alias("n_to_review"), F.count_if(F.coalesce("image", F.lit("")) != "").alias("n_with_image"), *counts
    )


def paper_units(questions: DataFrame) -> DataFrame:
    """paper_id, units: the names of a paper's units as they first appear."""
    first = questions.where("unit <> ''").groupBy("paper_id", "unit").agg(F.min("seq").alias("seq"))
    in_order = F.array_sort(F.collect_list(F.struct("seq", "unit")))
    return first.groupBy("paper_id").agg(F.array_join(F.transform(in_order, lambda u: u["unit"]), ",").alias("units"))


def latest_answers(answers: DataFrame) -> DataFrame:
    """One row for each attempt, paper and key: the last one saved (saved_at)."""
    return answers.groupBy("attempt_id", "paper_id", "key").agg(F.max_by(F.struct("values", "is_list"), "saved_at").alias("last")).select("attempt_id", "paper_id", "key", "last.values", "last.is_list")


def answer_summary(questions: DataFrame, answers: DataFrame, marks: DataFrame) -> DataFrame:
    """attempt_id, paper_id, seq, unit, no, type (label), answer, marked, key: a row for each attempt and question.

    answers: attempt_id, paper_id, key, values, is_list; marks: attempt_id, key. A key that several questions share gives each of them the answer.
    """
    attempts = answers.select("attempt_id", "paper_id").distinct()
    asked = questions.withColumn("key", question_key()).join(attempts, "paper_id")
    rows = asked.join(answers, ["attempt_id", "paper_id", "key"], "left").join(marks.select("attempt_id", "key").distinct().withColumn("marked", F.lit(True)), ["attempt_id", "key"], "left")
    return rows.select("attempt_id", "paper_id", "seq", "unit", "no", type_label("type").alias("type"), formatted_answer().alias("answer"), F.coalesce("marked", F.lit(False)).alias("marked"), "key")


def attempt_listing(summary: DataFrame) -> DataFrame:
    """attempt_id, paper_id, answered, total."""
    return summary.groupBy("attempt_id", "paper_id").agg(F.count_if(F.col("answer") != "").alias("answered"), F.count("*").alias("total"))


def unanswered(summary: DataFrame) -> DataFrame:
    """attempt_id, paper_id, labels: what has no answer, in the paper's order, with commas."""
    rows = summary.where("answer = ''").select("attempt_id", "paper_id", "seq", display_label().alias("label"))
    in_order = F.array_sort(F.collect_list(F.struct("seq", "label")))
    return rows.groupBy("attempt_id", "paper_id").agg(F.array_join(F.transform(in_order, lambda x: x["label"]), ",").alias("labels"))


def exported_summary(summary: DataFrame) -> DataFrame:
    """The columns of the exported sheet: unit, no, type, answer (or that there is none), mark."""
    return summary.select("attempt_id", "seq", "unit", "no", "type", F.when(F.col("answer") == "", UNANSWERED).otherwise(F.col("answer")).alias("answer"), F.when(F.col("marked"), MARK).otherwise("").alias("mark"))


def exported_paper(questions: DataFrame) -> DataFrame:
    """unit, no, type, stem, options A to G, blanks."""
    options = [F.coalesce(F.get("options", F.lit(i)), F.lit("")).alias(letter) for i, letter in enumerate("ABCDEFG")]
    return questions.select("paper_id", "seq", "unit", "no", type_label("type").alias("type"), "stem", *options, "blanks")
