"""The stream of autosaves against the same in one batch: replays, other orders, late saves, hand-ins."""

import datetime as dt
import random

from examlake.streaming.settled import STATE_STORE, settled_saves, settling_saves

SAVE = "paper_id long, user_id long, saved_at timestamp, save_id long, answers string, done boolean"
START = dt.datetime(2024, 1, 1, 10, tzinfo=dt.UTC)


def save(seconds, n, key=(1, 1), done=False):
    return (*key, START + dt.timedelta(seconds=seconds), n, f"a{n}", done)


def test_quiet_times(spark):
    rows = [save(0, 1), save(1, 2), save(2.5, 3), save(2.5, 4), save(10, 5), save(11, 6, done=True), save(20, 7), save(20, 7), save(21.4, 8, (1, 2)), (None, 1, START, 9, "x", False), save(30, 10, done=True), save(40, 11)]
    got = settled_saves(spark.createDataFrame(rows, SAVE)).collect()
    assert sorted(r.save_id for r in got) == [2, 4, 7, 8, 11]
    assert settled_saves(spark.createDataFrame([], SAVE)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [save(round(rng.uniform(0, 60), 1), n, (rng.randrange(3), rng.randrange(2)), rng.random() < 0.1) for n in range(200)]
    rows.sort(key=lambda r: r[2])
    # three arrivals, each with some of the next part and replays of its own; all within the time allowed for being late
    third = len(rows) // 3
    parts = [rows[:third] + rows[third + 5 : third + 15], rows[third : 2 * third] + rows[third - 10 : third], rows[2 * third :] + rows[2 * third - 5 : 2 * third]]
    end = [save(1000, 1000, (9, 9))]  # brings the watermark behind all others
    late = [save(5, 2000, (0, 0))]  # and one far behind it
    rng.shuffle(parts[1])
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        for k, part in enumerate([*parts, end, late]):
            spark.createDataFrame(part, SAVE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
            stream = spark.readStream.schema(SAVE).parquet(f"file://{tmp_path}/in/*")
            query = settling_saves(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()  # each arrival goes on from the state that the last one left
    finally:
        spark.conf.unset(STATE_STORE[0]) if before is None else spark.conf.set(STATE_STORE[0], before)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    expected = settled_saves(spark.createDataFrame(rows, SAVE)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(expected) > 20
