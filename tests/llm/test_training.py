"""The toxicity model against counts over all labelled documents."""

from collections import Counter

import pytest

from examlake.llm import toxicity as T


def test_every_labelled_document_is_learned_from(spark):
    n = 21_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('alpha ', id) as text")
    letters, _, _ = T.fitted(docs, spark.range(n).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as toxic"))
    assert letters["  a"] == n


def test_probabilities_are_those_of_all_features(spark):
    texts = [(i, " ".join(["common", f"word{'abcdefg'[i % 7]}", "vile" if i % 5 == 0 else "mild", "v1le" if i % 15 == 0 else "so", f"x{i}"]), int(i % 5 == 0)) for i in range(120)]
    docs = spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string").repartition(3)
    letters, odds, _ = T.fitted(docs, spark.createDataFrame([(x[0], x[2]) for x in texts], "doc_id long, toxic int"))
    model, toxic, every = T.Letters(letters), Counter(), Counter()
    for _, text, label in texts:
        found = {f for t in T.tokens(text) for w in T.readings(t, model) for f in T.features(w)}
        every.update(found)
        toxic.update(found if label else ())
    share = lambda t, n: (t / n + 9 / (2 * n) - 3 * ((t / n * (1 - t / n) + 9 / (4 * n)) / n) ** 0.5) / (1 + 9 / n)
    expected = {f: share(t, every[f]) for f, t in toxic.items() if t > 2 and share(t, every[f]) > T.LEAST}
    assert "=vile" in odds and "=common" not in odds and odds == pytest.approx(expected)
