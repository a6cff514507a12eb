"""Saves that nothing follows for a while: what is kept of a stream of autosaves, with state for each user and paper."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Seconds without another save after which one is kept.
QUIET = 1.5
#: The streaming state that the processor needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def _whole(saves: DataFrame) -> DataFrame:
    """The saves that have a user, a paper and a moment (a time with or without zone), the latter in microseconds too (at)."""
    done = F.coalesce("done", F.lit(False)) if "done" in saves.columns else F.lit(False)
    rows = saves.where("paper_id is not null and user_id is not null and saved_at is not null and save_id is not null").withColumn("saved_at", F.col("saved_at").cast("timestamp"))
    return rows.select("paper_id", "user_id", "saved_at", F.unix_micros("saved_at").alias("at"), F.col("save_id").cast("long").alias("save_id"), F.col("answers").cast("string").alias("answers"), done.alias("done"))


def settled_saves(saves: DataFrame, quiet: float = QUIET) -> DataFrame:
    """paper_id, user_id, saved_at, save_id, answers: the saves (these columns, and done where an attempt is handed in) of a user and paper that no other save or hand-in follows for `quiet` seconds.

    Of saves made at one moment the last by save_id counts. Repeated rows count once; rows without a moment, user or paper are left out. Handing in keeps nothing: the answers came with the attempt.
    """
    rows = _whole(saves).dropDuplicates(["paper_id", "user_id", "at", "save_id"])
    follows = F.lead("at").over(Window.partitionBy("paper_id", "user_id").orderBy("at", "save_id"))
    alone = F.coalesce(follows - F.col("at") >= _micros(quiet), F.lit(True))
    return rows.withColumn("alone", alone).where("alone and not done").select("paper_id", "user_id", "saved_at", "save_id", "answers")


class _Settling(StatefulProcessor):
    """Keeps a key's saves until the watermark has passed their quiet time; then all that may follow them is known, in whatever order it came."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "at long, save_id long", "answers string, done boolean")

    def _due(self, at: int) -> int:
        """The millisecond at which nothing more can follow closely."""
        return -(-(at + self.quiet) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, save_id, answers, done in zip(batch["at"].tolist(), batch["save_id"].tolist(), batch["answers"].tolist(), batch["done"].tolist(), strict=True):
                self.pending.updateValue((at, save_id), (answers, done))
                self.handle.registerTimer(self._due(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        found = sorted((tuple(k), tuple(v)) for k, v in self.pending.iterator())
        kept = []
        for n, ((at, save_id), (answers, done)) in enumerate(found):
            if self._due(at) > now:
                break
            if not done and (n + 1 == len(found) or found[n + 1][0][0] - at >= self.quiet):
                kept.append((*key, at, save_id, answers))
            self.pending.removeKey((at, save_id))
        if kept:
            yield pd.DataFrame(kept, columns=["paper_id", "user_id", "at", "save_id", "answers"])

    def close(self) -> None:
        pass


def settling_saves(saves: DataFrame, quiet: float = QUIET, late: str = "1 minute") -> DataFrame:
    """settled_saves() over a stream, in append mode: each row comes once, when the watermark has passed its quiet time.

    Saves later than `late` behind the latest are dropped, and so are replays of saves that have been judged; the state of a user and paper holds what isn't judged yet and nothing else. Needs STATE_STORE.
    """
    kinds = dict(saves.dtypes)
    rows = _whole(saves).withWatermark("saved_at", late)
    schema = f"paper_id {kinds['paper_id']}, user_id {kinds['user_id']}, at long, save_id long, answers string"
    out = rows.groupBy("paper_id", "user_id").transformWithStateInPandas(_Settling(_micros(quiet)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select("paper_id", "user_id", F.timestamp_micros("at").alias("saved_at"), "save_id", "answers")
