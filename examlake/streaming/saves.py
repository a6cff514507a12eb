"""Autosaves and papers as streams: the same operators, over what arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segmentation import parsed_questions
from ..operators.validation import validated
from ..sources.papers import latest_drafts
from ..sources.text import text_lines


def latest_saves(saves: DataFrame) -> DataFrame:
    """latest_drafts() over a stream, for a sink in update or complete mode; the state has one row for each user and paper."""
    return latest_drafts(saves)


def saves_an_hour(saves: DataFrame, late: str = "10 minutes") -> DataFrame:
    """hour, paper_id, saves: autosaves by the hour they were made in; later ones than `late` behind the latest are dropped, so the state stays bounded."""
    hours = saves.withWatermark("saved_at", late).groupBy(F.window("saved_at", "1 hour").alias("w"), "paper_id").agg(F.count("*").alias("saves"))
    return hours.select(F.col("w.start").alias("hour"), "paper_id", "saves")


def parse_arriving(papers: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query over a stream of papers (paper_id, text): each batch's papers, parsed and validated, go to sink(questions, batch). A paper arrives whole; one that arrives again is parsed again."""

    def each(batch: DataFrame, number: int) -> None:
        sink(validated(parsed_questions(text_lines(batch))), number)

    return papers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
