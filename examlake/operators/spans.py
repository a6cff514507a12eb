"""Places on pages: what part of a paper a question takes up, and which pictures and lines lie in it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import picture_name


def question_spans(questions: DataFrame) -> DataFrame:
    """questions (paper_id, seq, page, y0) with next_page and next_y: where the next question starts; null for a paper's last."""
    order = Window.partitionBy("paper_id").orderBy("seq")
    return questions.withColumn("next_page", F.lead("page").over(order)).withColumn("next_y", F.lead("y0").over(order))


def located(items: DataFrame, questions: DataFrame) -> DataFrame:
    """items (paper_id, page, y) with seq: the last question of the paper that starts at or before the item's place; null before the first.

    An as-of join as one window over both tables, so no pair of rows is formed that isn't in the result.
    """
    names = items.columns
    starts = questions.select("paper_id", "page", F.col("y0").alias("y"), F.col("seq").alias("_seq"), F.lit(0).alias("_item"))
    both = items.withColumn("_seq", F.lit(None).cast("int")).withColumn("_item", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("paper_id").orderBy("page", "y", "_item", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("seq", F.last("_seq", ignorenulls=True).over(order)).where("_item = 1").select(*names, "seq")


def beside(rows: DataFrame, others: DataFrame, keys: Sequence[str], **found: Column) -> DataFrame:
    """rows with columns `found`, aggregates over those others that have a row's keys, as `_other` with their further columns; where a key is null, or there are none, null.

    A left join as one window over both tables: what already lies by its papers is not dealt out once more by all keys.
    """
    more = [c for c in others.columns if c not in keys]
    theirs = others.select(*keys, F.struct(F.lit(True).alias("_is"), *more).alias("_other"))
    both = rows.withColumn("_other", F.lit(None).cast(theirs.schema["_other"].dataType)).unionByName(theirs, allowMissingColumns=True)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    both = both.withColumns({name: F.when(known, column.over(Window.partitionBy(*keys))) for name, column in found.items()})
    return both.where("_other is null").drop("_other")


def question_pictures(questions: DataFrame, pictures: DataFrame) -> DataFrame:
    """paper_id, seq, n_pictures, first_ref of questions that have pictures (paper_id, page, y, ref) in their span."""
    inside = located(pictures, questions).where("seq is not null")
    return inside.groupBy("paper_id", "seq").agg(F.count("*").alias("n_pictures"), F.min_by("ref", F.struct("page", "y", "ref")).alias("first_ref"))


#: Beyond the end of any page; the share of a page above its footer, and heights of pages that aren't known.
NO_END, ABOVE_FOOTER, USUAL_HEIGHT = 1_000_000, 0.93, 800.0


def span_ends(questions: DataFrame) -> DataFrame:
    """questions (paper_id, seq, page, y0, end_page, y1) with stop_y, where a question ends on its page, and over_y, where it ends on the next one (null: it doesn't reach it).

    It ends where the next question starts, if that is on the same or the next page, or earlier where the parser saw an end.
    """
    near = (F.col("next_page") >= F.col("page")) & (F.col("next_page") <= F.col("page") + 1)
    place = lambda page, y: F.struct(page.cast("int").alias("page"), y.cast("double").alias("y"))
    start, seen = place(F.col("page"), F.col("y0")), place(F.col("end_page"), F.col("y1"))
    out = question_spans(questions).withColumn("stop", F.when(near, place(F.col("next_page"), F.col("next_y"))).otherwise(place(F.col("page"), F.lit(NO_END))))
    known = (F.col("end_page") != 0) & (F.col("y1") != 0) & (seen < F.col("stop")) & (seen > start)
    out = out.withColumn("stop", F.when(known, seen).otherwise(F.col("stop")))
    same = F.col("stop.page") == F.col("page")
    return out.withColumns({"stop_y": F.when(same, F.col("stop.y")).otherwise(F.lit(float(NO_END))), "over_y": F.when(~same, F.col("stop.y"))}).drop("stop", "next_page", "next_y")


def crop_plan(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, seq, file, page, y0, to_page, y1: what to cut from which pages, for each question and for each material before one. pages: paper_id, page, height.

    questions as for span_ends, with unit, no, group, m_page, m_y0. A question that goes over the page has to_page after its page.
    """
    tall = pages.select("paper_id", "page", (F.coalesce("height", F.lit(USUAL_HEIGHT)) * ABOVE_FOOTER).alias("bottom"))
    own = beside(span_ends(questions).where("page > 0"), tall, ["paper_id", "page"], bottom=F.max("_other.bottom"))
    bottom = F.coalesce("bottom", F.lit(USUAL_HEIGHT * ABOVE_FOOTER))
    cut = own.select("paper_id", "seq", picture_name().alias("file"), "page", "y0", F.when(F.col("over_y").isNull(), F.col("page")).otherwise(F.col("page") + 1).alias("to_page"), F.coalesce("over_y", F.least("stop_y", bottom)).alias("y1"))
    before = questions.where("`group` is not null and m_page > 0 and struct(m_page, m_y0) < struct(page, y0)")
    return cut.unionByName(before.select("paper_id", "seq", picture_name(prefix="m").alias("file"), F.col("m_page").alias("page"), F.col("m_y0").alias("y0"), F.col("page").alias("to_page"), F.col("y0").alias("y1")))


def material_items(items: DataFrame, questions: DataFrame) -> DataFrame:
    """items (paper_id, page, y) with seq: those between the start of a question's material and the question; few questions have one of their own."""
    owners = questions.where("`group` is not null and m_page > 0").select("paper_id", "seq", F.struct("m_page", "m_y0").alias("_from"), F.struct("page", "y0").alias("_to"))
    place = F.struct(F.col("page"), F.col("y"))
    return items.join(owners, "paper_id").where((place >= F.col("_from")) & (place < F.col("_to"))).select(*items.columns, "seq")


def question_texts(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """paper_id, seq, text: the original lines (paper_id, pos, page, y, text) of each question, with its own material's; without any, the question as parsed.

    questions: paper_id, seq, no, stem, options, page, y0, group, material, m_page, m_y0; those without a page get no row.
    """
    starts = questions.where("page > 0")
    own = located(lines.select("paper_id", "pos", "page", "y", "text"), starts).where("seq is not null")
    both = own.unionByName(material_items(lines.select("paper_id", "pos", "page", "y", "text"), starts.where("material is not null")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "y", "pos", "text"))), lambda x: x["text"]), "\n")
    found = both.groupBy("paper_id", "seq").agg(text.alias("found"))
    return starts.join(found, ["paper_id", "seq"], "left").select("paper_id", "seq", F.coalesce("found", F.array_join(question_lines(), "\n")).alias("text"))


def question_lines(no: str = "no", stem: str = "stem", options: str = "options") -> Column:
    """A question as lines: number and stem, and a letter before each option."""
    head = F.concat(F.col(no).cast("string"), F.lit(". "), F.coalesce(F.col(stem), F.lit("")))
    return F.concat(F.array(head), F.transform(F.coalesce(F.col(options), F.array().cast("array<string>")), lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), F.coalesce(o, F.lit("")))))
