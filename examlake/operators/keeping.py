"""Papers kept in a store, from draft to paper and back, with the attempts made at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.papers import ATTEMPT, PAPER
from ..sources.store import Change, Kind, Store

_SAVE = "paper_id string, user_id string, saved_at timestamp, save_id long, answers string"
KINDS = {"drafts": Kind(PAPER, ("id",), "id"), "papers": Kind(PAPER, ("id",), "id"), "attempts": Kind(ATTEMPT, ("id",), "paper_id"), "saves": Kind(_SAVE, ("paper_id", "user_id"), "paper_id")}


def paper_store(spark: SparkSession, path: str, **more) -> Store:
    return Store(spark, path, KINDS, **more)


def _questions(**fields) -> Column:
    return F.transform("questions", lambda q: q.withField("reviewed", fields["reviewed"]).withField("issues", fields["issues"]))


def saved(store: Store, papers: DataFrame, table: str = "drafts") -> int:
    """Papers (PAPER) in place of those of their ids."""
    return store.change(**{table: Change(put=papers)})


def confirmed(store: Store, ids: DataFrame) -> int:
    """Drafts (id) become papers, all questions reviewed and without issues, and are drafts no more; in one version. Ids without a draft are passed over."""
    def moved(version: int | None) -> dict[str, Change]:
        drafts = store.table("drafts", version, having=ids.select("id"))
        papers = drafts.withColumn("questions", _questions(reviewed=F.lit(True), issues=F.array().cast("array<string>")))
        return {"papers": Change(put=papers, placed=True), "drafts": Change(remove=ids.select("id"))}

    return store.changed(moved)


def reopened(store: Store, ids: DataFrame) -> int:
    """Copies of papers (id) as drafts; the papers stay, a draft that was there is replaced."""
    return store.changed(lambda version: {"drafts": Change(put=store.table("papers", version, having=ids.select("id")), placed=True)})


def deleted(store: Store, ids: DataFrame) -> int:
    """Papers (id) go, with their drafts, attempts and saved answers."""
    by_paper = ids.select(F.col("id").alias("paper_id"))
    return store.change(papers=Change(remove=ids.select("id")), drafts=Change(remove=ids.select("id")), attempts=Change(remove=by_paper), saves=Change(remove=by_paper))


def handed_in(store: Store, attempts: DataFrame) -> int:
    """Attempts (ATTEMPT and user_id) are added, and their users' saved answers at those papers go."""
    return store.change(attempts=Change(put=attempts.drop("user_id")), saves=Change(remove=attempts.select("paper_id", "user_id").distinct()))
