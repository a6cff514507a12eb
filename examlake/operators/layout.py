"""Page layout: repeated headers and watermarks, page numbers, separators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeezed

LEAST_PAGES, SHARE, LEAST_LENGTH, FRAGMENT = 3, 0.5, 4, 3
TOP, BOTTOM = 0.07, 0.92
#: Letters and digits of any script are what punctuation is not; how page numbers are written.
PUNCTUATION = r"^[^\p{L}\p{N}]+$"
PAGE_NUMBER = r"(?U)^\s*(?:第\s*\d+\s*页.*|[-—–]?\s*\d{1,3}\s*[-—–]?|\d+\s*/\s*\d+)\s*$"


def repeated_strings(lines: DataFrame) -> DataFrame:
    """paper_id, norm: strings, white space aside, on at least half of the pages of papers of at least three pages."""
    norm = lines.select("paper_id", "page", squeezed("text").alias("norm")).where(F.length("norm") >= LEAST_LENGTH).where(~F.col("norm").rlike(PUNCTUATION))
    seen = norm.groupBy("paper_id", "norm").agg(F.count_distinct("page").alias("on_pages"))
    pages = lines.groupBy("paper_id").agg(F.count_distinct("page").alias("pages")).where(f"pages >= {LEAST_PAGES}")
    return seen.join(pages, "paper_id").where(f"on_pages >= greatest({LEAST_PAGES}, pages * {SHARE})").select("paper_id", "norm")


def without_furniture(lines: DataFrame) -> DataFrame:
    """lines (paper_id, page, text, y, page_height) without repeated strings and their short fragments, separators and page numbers.

    All that is asked about other lines of a paper is a window, so the lines move once, to the task of their paper.
    """
    paper, string = Window.partitionBy("paper_id"), Window.partitionBy("paper_id", "norm")
    out = lines.withColumn("norm", squeezed("text"))
    out = out.withColumns({"pages": F.size(F.collect_set("page").over(paper)), "on_pages": F.size(F.collect_set("page").over(string))})
    repeated = (F.col("pages") >= LEAST_PAGES) & (F.col("on_pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * SHARE)) & (F.length("norm") >= LEAST_LENGTH) & ~F.col("norm").rlike(PUNCTUATION)
    out = out.withColumn("repeated", repeated).withColumn("all_repeated", F.collect_set(F.when(F.col("repeated"), F.col("norm"))).over(paper))
    fragment = (F.length("norm") <= FRAGMENT) & F.exists("all_repeated", lambda x: F.contains(x, F.col("norm")))
    edge = (F.col("y") < F.col("page_height") * TOP) | (F.col("y") > F.col("page_height") * BOTTOM)
    separator = F.col("norm").rlike(PUNCTUATION) & (F.length("norm") >= 6)
    return out.where(~F.col("repeated") & ~fragment & ~separator & ~(edge & F.col("text").rlike(PAGE_NUMBER))).select(lines.columns)
