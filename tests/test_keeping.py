"""The versioned store: atomic changes by key, readers at a version, killed and competing writers."""

import json

import pytest
from pyspark.sql import functions as F

from examlake.operators import keeping as K
from examlake.sources.papers import ATTEMPT, PAPER
from examlake.sources.store import Change, Kind, Store


def papers(spark, *ids, title="t"):
    rows = [json.dumps({"id": i, "title": title + i, "questions": [{"no": 1, "reviewed": False, "issues": ["x"]}, {"no": 2, "reviewed": True, "issues": []}]}) for i in ids]
    return spark.createDataFrame([(r,) for r in rows], "json string").select(F.from_json("json", PAPER).alias("p")).select("p.*")


def ids(spark, *found):
    return spark.createDataFrame([(i,) for i in found], "id string")


def of(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return K.paper_store(spark, f"file://{tmp_path}/store", buckets=4)


def test_a_papers_way(spark, store):
    assert of(store.table("papers")) == [] and store.versions() == []
    assert K.saved(store, papers(spark, "a", "b", "c")) == 1
    assert K.saved(store, papers(spark, "b", title="new ")) == 2 and sorted(r.title for r in store.table("drafts").collect()) == ["new b", "ta", "tc"]
    K.confirmed(store, ids(spark, "a", "b", "nobody"))
    assert of(store.table("drafts")) == ["c"] and of(store.table("papers")) == ["a", "b"]
    assert all(q.reviewed and q.issues == [] for r in store.table("papers").collect() for q in r.questions)
    K.reopened(store, ids(spark, "a"))
    assert of(store.table("drafts")) == ["a", "c"] and of(store.table("papers")) == ["a", "b"]
    # a reader at a version sees what it was
    assert of(store.table("drafts", version=1)) == ["a", "b", "c"] and of(store.table("papers", version=2)) == []


def test_deleting_takes_attempts_along(spark, store):
    K.saved(store, papers(spark, "a", "b"), "papers")
    saves = spark.sql("select * from values ('a', 'u1', timestamp'2024-01-01', 1L, 'x'), ('a', 'u2', timestamp'2024-01-01', 2L, 'y'), ('b', 'u1', timestamp'2024-01-01', 3L, 'z') as t(paper_id, user_id, saved_at, save_id, answers)")
    store.change(saves=Change(put=saves))
    done = spark.createDataFrame([("t1", "a", None, None, None, None), ("t2", "b", None, None, None, None)], ATTEMPT).withColumn("user_id", F.lit("u1"))
    K.handed_in(store, done)
    assert of(store.table("attempts")) == ["t1", "t2"] and of(store.table("saves"), "save_id") == [2]
    K.deleted(store, ids(spark, "a"))
    assert of(store.table("papers")) == ["b"] and of(store.table("attempts")) == ["t2"] and of(store.table("saves"), "save_id") == []


def test_a_killed_writer_leaves_the_old_version(spark, store, monkeypatch):
    K.saved(store, papers(spark, "a"))
    monkeypatch.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        K.confirmed(store, ids(spark, "a"))
    monkeypatch.undo()
    assert of(store.table("drafts")) == ["a"] and of(store.table("papers")) == [] and store.versions() == [1]
    assert store.vacuum() == 2 and of(store.table("drafts")) == ["a"]


def test_the_second_of_two_writers_works_on_what_the_first_left(spark, store, monkeypatch):
    K.saved(store, papers(spark, "a"))
    real, raced = Store._publish, []

    def publish(self, manifest, version):
        if not raced:
            raced.append(1)
            K.saved(K.paper_store(spark, store.path, buckets=4), papers(spark, "b", title="again "))
        return real(self, manifest, version)

    monkeypatch.setattr(Store, "_publish", publish)
    assert K.saved(store, papers(spark, "c")) == 3 and of(store.table("drafts")) == ["a", "b", "c"]
    raced.clear()
    K.confirmed(store, ids(spark, "b", "c"))
    assert of(store.table("papers")) == ["b", "c"] and of(store.table("drafts")) == ["a"]  # b, saved again meanwhile, was moved as it was then
    assert sorted(r.title for r in store.table("papers").collect()) == ["again b", "tc"]


def test_a_lookup_reads_one_bucket_and_a_change_keeps_the_others(spark, store):
    K.saved(store, papers(spark, *"abcdefghij"))
    found = store.table("drafts", of=["d"])
    assert of(found) == ["d"] and len({f.rpartition("/")[0] for f in found.inputFiles()}) == 1
    before = store.manifest()["drafts"]
    K.saved(store, papers(spark, "d", title="new "))
    assert sum(before[b] != f for b, f in store.manifest()["drafts"].items()) == 1
    store.vacuum(kept=1)
    assert store.versions() == [2] and of(store.table("drafts")) == list("abcdefghij")


def exchanged(node):
    """The columns of each exchange in a plan."""
    below = [node.children().apply(k) for k in range(node.children().size())]
    own = [node.output().mkString(" ")] if node.nodeName() == "Exchange" else []
    return own + [x for child in below for x in exchanged(child)]


def test_changes_deal_out_keys_and_no_whole_rows(spark, store, monkeypatch):
    K.saved(store, papers(spark, *"abcdefgh"))
    real, seen = Store._written, []

    def written(self, name, rows, *more, **options):
        seen.extend(exchanged(rows._jdf.queryExecution().executedPlan()))
        return real(self, name, rows, *more, **options)

    monkeypatch.setattr(Store, "_written", written)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        K.confirmed(store, ids(spark, *"abcde"))
        K.reopened(store, ids(spark, *"bc"))
        K.deleted(store, ids(spark, *"ch"))
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert seen and not [x for x in seen if "questions" in x]
    assert of(store.table("papers")) == list("abde") and of(store.table("drafts")) == list("bfg")
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 0


def test_rows_are_told_apart_beyond_a_block_of_bits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", {"t": Kind("id long, part long, v string", ("id",), "part")}, buckets=2)
    rows = spark.range(70_000).select("id", F.when(F.col("id") % 5 > 0, 1).cast("long").alias("part"), F.lit("old").alias("v"))
    store.change(t=Change(put=rows))
    thirds = rows.where("id % 3 = 0")
    assert {r.id for r in store.table("t", having=thirds.select("id")).collect()} == set(range(0, 70_000, 3))
    store.change(t=Change(put=rows.where("id % 7 = 0").withColumn("v", F.lit("new")), remove=thirds.select("id")))
    got = {r.id: r.v for r in store.table("t").collect()}
    assert got == {k: "old" if k % 7 else "new" for k in range(70_000) if k % 3 or k % 7 == 0} and store.table("t").count() == len(got)
    store.change(t=Change(remove=spark.range(1).select(F.lit(1).cast("long").alias("part"))))
    assert {r.id % 5 for r in store.table("t").collect()} == {0}  # null meets no key, so its rows stay
