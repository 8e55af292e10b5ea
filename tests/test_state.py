"""Cooldown and drift as state of a stream against the batch queries, with a restart in between."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import series, topics
from tidemark.streaming import state

EVENTS = "monitor_id string, topic_id string, kind string, detected_on date"
VECTORS = "topic_id int, vec_id long, embedding array<double>"


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cooldown_stream_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    first = dt.date(2024, 1, 1)
    rows = sorted({(f"m{rng.integers(2)}", f"t{rng.integers(3)}", ["burst", "decline"][rng.integers(2)], first + dt.timedelta(int(rng.integers(40)))) for _ in range(260)}, key=lambda r: r[3])
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    # days come up to two days out of order
    waves = [[] for _ in range(8)]
    for i, r in enumerate(sorted(rows, key=lambda r: r[3] + dt.timedelta(int(rng.integers(3))))):
        waves[i * 8 // len(rows)].append(r)
    for wave in waves[:4]:
        spark.createDataFrame(wave, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    fired = lambda: state.cooldowns(stream(spark, folder, EVENTS))
    state.take_in(fired(), root, "append")
    early = state.results(spark, root, fired().schema).count()
    for wave in [*waves[4:], [("", "", state.CLOSE, first + dt.timedelta(400))]]:
        spark.createDataFrame(wave, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    state.take_in(fired(), root, "append")  # a new query from the checkpoint
    got = sorted(tuple(r)[:4] for r in state.results(spark, root, fired().schema).collect())
    want = sorted((r["monitor_id"], r["topic_id"], r["kind"], r["detected_on"]) for r in series.cooldown_history(spark.createDataFrame(rows, EVENTS), ["monitor_id", "topic_id"]).collect())
    assert got == want and 0 < early < len(want) < len(rows)


def test_drift_stream_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), i, rng.standard_normal(4).tolist()) for i in range(150)]
    home = spark.createDataFrame([(t, rng.standard_normal(4).tolist()) for t in range(3)], "topic_id int, centroid array<double>")
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    run = lambda: state.drifts(stream(spark, folder, VECTORS), home)
    for half in (rows[:80], rows[80:]):
        for i in range(0, len(half), 30):
            spark.createDataFrame([*half[i : i + 30], (9, 1000, [0.0] * 4)], VECTORS).coalesce(1).write.mode("append").parquet(folder)
        state.take_in(run(), root, "update")
    last = state.results(spark, root, run().schema).groupBy("topic_id").agg(F.max_by(F.struct("doc_count", "drift_score", "moved"), "doc_count").alias("x")).select("topic_id", "x.*")
    got = {r["topic_id"]: (r["doc_count"], round(r["drift_score"], 9), round(r["moved"], 9)) for r in last.collect()}
    all_rows = spark.createDataFrame(rows, VECTORS)
    score = {r["topic_id"]: (r["doc_count"], r["drift_score"]) for r in topics.drift_scores(all_rows, home).collect()}
    moved = {r["topic_id"]: r["moved"] for r in topics.centroid_drift(all_rows, home).collect()}
    assert got == {t: (n, round(s, 9), round(moved[t], 9)) for t, (n, s) in score.items()}
