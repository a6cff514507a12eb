"""What to cut from which pages, piece by piece, and where each piece lies in the picture that is stacked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spans import ABOVE_FOOTER, USUAL_HEIGHT, beside, located, material_items

_PIECE = ("paper_id", "seq", "file", "page", "y0", "y1")


def crop_pieces(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, seq, file, page, y0, y1: the pieces of a crop_plan(), one a page: the rest of the first page, whole pages between, the top of the last. pages: paper_id, page, height. Pieces without height are left out."""
    bottoms = pages.select("paper_id", "page", (F.coalesce("height", F.lit(USUAL_HEIGHT)) * ABOVE_FOOTER).alias("bottom"))
    each = plan.withColumn("first", F.col("page")).withColumn("page", F.explode(F.sequence("page", F.greatest("page", "to_page"))))
    each = beside(each, bottoms, ["paper_id", "page"], bottom=F.max("_other.bottom"))
    top = F.when(F.col("page") == F.col("first"), F.col("y0")).otherwise(0.0)
    stop = F.when(F.col("page") == F.greatest("first", "to_page"), F.col("y1")).otherwise(F.coalesce("bottom", F.lit(USUAL_HEIGHT * ABOVE_FOOTER)))
    return each.select("paper_id", "seq", "file", "page", top.alias("y0"), stop.alias("y1")).where("y1 > y0")


def recropped(pieces: DataFrame, manual: DataFrame) -> DataFrame:
    """pieces with those that were cut by hand (manual: the same columns) in place of all that their file had."""
    kept = beside(pieces, manual.select("paper_id", "file"), ["paper_id", "file"], _again=F.bool_or("_other._is")).where("_again is null")
    return kept.select(*_PIECE).unionByName(manual.select(*_PIECE).where("y1 > y0"))


def stacked(pieces: DataFrame) -> DataFrame:
    """paper_id, seq, file, piece, page, y0, y1, at: pieces of one file that overlap or touch on a page as one, numbered from 1 from top to bottom; at: how far below the top of the stacked picture each starts."""
    down = Window.partitionBy("paper_id", "file").orderBy("page", "y0", "y1")
    on_page = Window.partitionBy("paper_id", "file", "page").orderBy("y0", "y1")
    begins = F.coalesce(F.col("y0") > F.max("y1").over(on_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = pieces.withColumn("begins", begins).withColumn("piece", F.sum(F.col("begins").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("paper_id", "file", "piece").agg(F.min("seq").alias("seq"), F.min("page").alias("page"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    above = F.sum(F.col("y1") - F.col("y0")).over(Window.partitionBy("paper_id", "file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    return whole.select("paper_id", "seq", "file", F.col("piece").cast("int").alias("piece"), "page", "y0", "y1", F.coalesce(above, F.lit(0.0)).alias("at"))


def assigned_pictures(questions: DataFrame, pictures: DataFrame) -> DataFrame:
    """paper_id, seq, part, page, y, ref: pictures (paper_id, page, y, ref) in a question's span (part "question") or between the start of its material and the question ("material"). One before the first question that is no material's has no row."""
    columns = ("paper_id", "page", "y", "ref")
    shown = pictures.select(*columns)
    own = located(shown, questions).where("seq is not null").withColumn("part", F.lit("question"))
    return own.unionByName(material_items(shown, questions).withColumn("part", F.lit("material"))).select("paper_id", "seq", "part", "page", "y", "ref")
