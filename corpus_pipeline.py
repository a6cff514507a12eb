"""From raw documents to packed training windows: five stages, each over all that its predecessor kept.

Each takes a table with COLUMNS at least (others are left behind) and returns COLUMNS, the last one pieces. A stage over an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm.decontamination import contaminated
from examlake.llm.minhash import near_duplicates
from examlake.llm.packing import packed_sequences
from examlake.llm.shared import drop_paths, table, working_tables, written
from examlake.llm.suffixes import repeated_strings
from examlake.llm.toxicity import with_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither the toxicity model nor tokenization.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. The score is computed beside the row, so the texts don't travel.

    Null and empty texts score lowest and stay, as does everything where no label is known; each of several rows with one doc_id is judged by its own text.
    """
    return with_scores(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id. Documents without words and those without doc_id link with nothing and stay; rows with one doc_id stay or go together."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that occur earlier; a document of which that leaves nothing but white space goes.

    Documents without a word from the start (null, empty or blank) repeat nothing and stay; a null text is then an empty one. Rows with one doc_id get one of
    their languages and sources.
    """
    beside = docs.groupBy(F.col("doc_id").alias("id")).agg(F.first("lang").alias("lang"), F.first("source").alias("source"))
    rest = repeated_strings(docs, texts=True).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select("doc_id", "text")
    rest = rest.join(beside, F.col("doc_id").eqNullSafe(F.col("id")))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. One without doc_id can't be named by the operator and stays; rows with one doc_id stay or go together."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows that hold the sources in proportion; a null text is one piece of one id, an empty table has none."""
    return packed_sequences(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's result is written and read again, and what it worked with is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with working_tables() as paths:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_paths(spark, [*before, *paths[:-1]])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
