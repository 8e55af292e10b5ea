"""The inverted file against the exact nearest topic."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import inverted_file, topics


def test_recall_and_the_exact_way(spark, monkeypatch):
    rng = np.random.default_rng(1)
    hubs = rng.standard_normal((30, 16))
    t = [(i, (hubs[i % 30] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(900)]
    d = [(i, (np.array(t[int(rng.integers(900))][1]) + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    docs, refs = spark.createDataFrame(d, "vec_id long, embedding array<double>"), spark.createDataFrame(t, "topic_id long, centroid array<double>")
    monkeypatch.setattr(inverted_file, "LIST", 10)
    monkeypatch.setattr(inverted_file, "PACK", 50)
    index = inverted_file.InvertedFile(refs)
    probes = index.probes_for(docs)
    assert 1 <= probes <= 12 and index.measured_recall(docs, probes) >= inverted_file.RECALL
    exact = {r["vec_id"]: (r["topic_id"], round(r["similarity"], 9)) for r in topics.nearest_topic(docs, refs).collect()}
    got = {r["vec_id"]: (r["topic_id"], round(r["similarity"], 9)) for r in index.search(docs, probes).collect()}
    assert len(got) == 1500 and sum(got[i] == exact[i] for i in got) >= 0.9 * len(got)
    assert all(got[i][1] <= exact[i][1] for i in got)
    every = {r["vec_id"]: (r["topic_id"], round(r["similarity"], 9)) for r in index.search(docs, 30).collect()}
    assert every == exact


def test_odd_vectors_and_ties(spark):
    refs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "topic_id string, centroid array<double>")
    docs = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0])], "vec_id int, embedding array<double>")
    assert [(r[0], r[1]) for r in inverted_file.InvertedFile(refs).search(docs, 2).collect()] == [(1, "a")]
    index = inverted_file.InvertedFile(refs.limit(0))
    assert index.search(docs, 2).count() == 0 and index.probes_for(docs.limit(0)) == 1
    assert inverted_file.InvertedFile(refs).search(docs.where(F.col("vec_id") > 1), 2).count() == 0
