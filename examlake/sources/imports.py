"""Files of many kinds as papers: each goes where its name and first bytes say, and what can't be read is a row with an error.

Text, Word files, page layers and recognised boxes (both as JSON: {"pages", "spans", "images"} or {"boxes"}) give the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import slug
from ..operators.pages import has_text_layer, page_lines, scanned_lines
from ..operators.segmentation import parsed_questions
from .text import text_lines
from .word import kind_column, word_lines

SPAN = "page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, size double, sup boolean, dir_x double, dir_y double"
IMAGE = "page int, x0 double, y0 double, x1 double, y1 double, kind string"
BOX = "page int, text string, x0 double, y0 double, x1 double, y1 double"
LAYER = f"pages array<struct<{'page int, height double'}>>, spans array<struct<{SPAN}>>, images array<struct<{IMAGE}>>, boxes array<struct<{BOX}>>"
#: What parsed_questions() calls the lines of each kind.
SOURCES = {"text": "text", "docx": "docx", "layer": "pdf", "boxes": "ocr"}
#: Columns of all kinds of lines, and what stands where a kind has none.
LINE = {"page": "1", "y": "cast(pos as double)", "x": "0.0D", "height": "1.0D", "blanks": "0", "source": "''", "is_heading": "false", "image": "false", "number": "cast(null as int)", "cells": "cast(null as array<string>)", "error": "cast(null as string)"}


def _routed(files: DataFrame) -> DataFrame:
    """path, paper_id, kind, error, content; and layer for JSON."""
    name = F.regexp_extract("path", r"([^/]*?)(?:\.([^./]*))?$", 1)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    text = F.col("content").cast("string")
    first = F.coalesce(kind_column("content"), F.lit("unknown"))
    layer = F.when(ending == "json", F.from_json(text, LAYER))
    # the place is part of the digest: equal files in two folders are two papers, and a file that is imported again keeps its id
    digest = F.left(F.sha2(F.concat(F.encode("path", "UTF-8"), F.lit(b"\0"), F.coalesce("content", F.lit(b""))), 256), F.lit(16))
    rows = files.select("path", "content", F.concat_ws("-", slug(name), digest).alias("paper_id"), layer.alias("layer"), ending.alias("ending"), first.alias("first"), F.is_valid_utf8(text).alias("valid"))
    kind: Column = (
        F.when(F.col("ending").isin("docx", "doc") & (F.col("first") == "docx"), "docx")
        .when((F.col("ending") == "txt") & F.col("valid"), "text")
        .when(F.col("layer.spans").isNotNull(), "layer")
        .when(F.col("layer.boxes").isNotNull(), "boxes")
    )
    error = F.when(F.col("content").isNull(), "no content").when(kind.isNotNull(), None).when(F.col("ending").isin("docx", "doc"), F.concat(F.lit("not a Word file that is read here: "), "first"))
    error = error.when(F.col("ending") == "txt", "not UTF-8").when(F.col("ending") == "json", "neither page layer nor boxes").otherwise(F.concat(F.lit("files of this kind are not read: "), "ending"))
    return rows.select("path", "paper_id", kind.alias("kind"), error.alias("error"), "content", "layer")


def manifest(files: DataFrame) -> DataFrame:
    """path, paper_id, kind (null: none that is read), error: where each of files (path, content) goes."""
    return _routed(files).select("path", "paper_id", "kind", "error")


def _uniform(lines: DataFrame) -> DataFrame:
    return lines.select("paper_id", F.col("pos").cast("int").alias("pos"), "text", *[(F.col(c) if c in lines.columns else F.expr(other)).alias(c) for c, other in LINE.items()])


def imported_lines(files: DataFrame) -> DataFrame:
    """paper_id, pos, text and the columns of LINE: the lines of all files that are read. A damaged Word file gives one row with its error, a page layer without text one with "no text layer"."""
    routed = _routed(files).where("error is null")
    of = lambda kind: routed.where(F.col("kind") == kind)
    part = lambda kind, name: of(kind).select("paper_id", F.inline(f"layer.{name}"))
    pasted = text_lines(of("text").select("paper_id", F.col("content").cast("string").alias("text")))
    word = word_lines(of("docx").select(F.col("paper_id").alias("path"), "content")).withColumnRenamed("path", "paper_id")
    spans = part("layer", "spans")
    with_text = has_text_layer(spans)
    layers = page_lines(spans, part("layer", "images"), part("layer", "pages")).join(with_text.where("has_text").select("paper_id"), "paper_id", "left_semi")
    bare = of("layer").select("paper_id").join(with_text.where("has_text").select("paper_id"), "paper_id", "left_anti")
    none = bare.select("paper_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("text"), F.lit("no text layer").alias("error"))
    out = _uniform(pasted)
    for lines in (word, layers, scanned_lines(part("boxes", "boxes")), none):
        out = out.unionByName(_uniform(lines))
    return out


def import_results(found: DataFrame, lines: DataFrame) -> DataFrame:
    """path, paper_id, kind, n_lines, error: what became of each file of manifest() by its imported_lines(); the rows with an error are the rejects. A file without a line is one."""
    n = lines.groupBy("paper_id").agg(F.count_if(F.col("error").isNull()).alias("n_lines"), F.min("error").alias("later"))
    rows = found.join(n, "paper_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    return rows.select("path", "paper_id", "kind", "n_lines", F.coalesce("error", "later", F.when(F.col("n_lines") == 0, "no lines")).alias("error"))


def imported_questions(lines: DataFrame) -> DataFrame:
    """The questions (parsed_questions) of imported_lines(), each paper read as what it came from."""
    out = None
    for source in SOURCES.values():
        questions = parsed_questions(lines.where((F.col("source") == source) & F.col("error").isNull()).drop("error"), source)
        out = questions if out is None else out.unionByName(questions)
    return out


def folder(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, content of the files in a folder and those below it, now or as they arrive. Spark's file sources pass over files of no bytes."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    return reader.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def imported(files: DataFrame, path: str, batch: int = 0) -> tuple[DataFrame, DataFrame]:
    """import_results() and imported_lines() of files, written to tables below path as one batch (in place of what was written under its number) and read back: files are read for the lines and
    for the manifest and not again."""
    spark = files.sparkSession
    tables = {name: f"{path.rstrip('/')}/{name}/batch={batch}" for name in ("lines", "manifest", "results")}
    imported_lines(files).write.mode("overwrite").parquet(tables["lines"])
    manifest(files).write.mode("overwrite").parquet(tables["manifest"])
    lines = spark.read.parquet(tables["lines"])
    import_results(spark.read.parquet(tables["manifest"]), lines).write.mode("overwrite").parquet(tables["results"])
    return spark.read.parquet(tables["results"]), lines


def import_arriving(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over a stream of files (folder): each batch is imported() to the tables below path, which are partitioned by batch. The checkpoint names the files that are done,
    so each is imported once; a batch that was broken off comes again under its number and is written again in its place."""
    return files.writeStream.foreachBatch(lambda batch, number: imported(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
