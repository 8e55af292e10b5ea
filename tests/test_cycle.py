import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_engine import SF
from test_engine import test_query_equals_sql as same
from tidemark import fixtures, registry_cycle
from tidemark.operators import discovery
from tidemark.plans import cycle


@pytest.mark.parametrize("name", ["density_clusters", "candidate_resolution", "topic_merge", "snapshot_long", "eval_stability", "det_novelty", "event_identity", "backfill_outcome", "topic_context", "eval_groundedness", "stream_daily_counts"])
def test_cycle_query_equals_sql(spark, name):
    same(spark, name)


def test_near_pairs_and_clusters_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    homes = rng.normal(size=(4, 8))
    x = np.concatenate([h + rng.normal(scale=0.15, size=(12, 8)) for h in homes] + [rng.normal(size=(15, 8)), np.zeros((1, 8))])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x[:-1] / np.linalg.norm(x[:-1], axis=1, keepdims=True)
    near = {(i, j) for i in range(len(u)) for j in range(len(u)) if i != j and u[i] @ u[j] >= 0.9}
    assert {tuple(r) for r in discovery.near_pairs(rows, 0.9).collect()} == near
    degree = {i: sum(a == i for a, _ in near) for i in range(len(u))}
    core = {i for i, n in degree.items() if n >= 4}
    label = {i: i for i in core}
    for _ in core:
        label = {i: min([label[i], *[label[j] for j in core if (i, j) in near]]) for i in core}
    want = dict(label)
    for i in set(degree) - core:
        own = [label[j] for j in core if (i, j) in near]
        if own:
            want[i] = min(own)
    assert dict(map(tuple, discovery.density_clusters(rows, 0.9).collect())) == want
    assert discovery.density_clusters(rows.limit(20), 0.9).count() == 0


def test_clusters_count_copies_without_pairing_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 6))
    base[1], base[3] = base[0] + 0.05, base[2] + 0.05
    # a group of many copies, a pair of small groups near each other, a border row, groups too small, zeros
    times = [60, 1, 3, 2, 4, 5, 1, 1, 1, 1, 1, 1]
    x = np.concatenate([np.repeat(base, times, axis=0), np.zeros((8, 6))])
    ids = rng.permutation(len(x))
    rows = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    u = {int(i): r / np.linalg.norm(r) for i, r in zip(ids, x, strict=True) if r.any()}
    near = {i: {j for j in u if j != i and u[i] @ u[j] >= 0.95} for i in u}
    core = {i for i in u if len(near[i]) >= 4}
    want = {i: i for i in core}
    for _ in core:
        want = {i: min([want[i], *[want[j] for j in near[i] & core]]) for i in core}
    want |= {i: min(want[j] for j in near[i] & core) for i in set(u) - core if near[i] & core}
    made, pairs = [], discovery.near_pairs

    def counted(*args):
        made.append(pairs(*args))
        return made[-1]

    monkeypatch.setattr(discovery, "near_pairs", counted)
    assert dict(map(tuple, discovery.density_clusters(rows, 0.95).collect())) == want
    assert made[0].count() <= 12 * 11 < 60 * 59


def test_residue_is_what_no_topic_takes(spark):
    e = fixtures.table(spark, SF, "embeddings").collect()
    x, label = np.array([r["embedding"] for r in e], float), np.array([r["label"] for r in e])
    cen = np.stack([x[label == k].mean(0) for k in np.unique(label)])
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    left = {e[i]["vec_id"] for i in np.flatnonzero((unit(x) @ unit(cen).T).max(1) < 0.55)}
    got = {r["vec_id"] for r in registry_cycle.queries()["residue_clusters"](spark, SF).collect()}
    # clusters reach vectors that the sample of every fifth never holds
    assert got <= left and (len(left) < 30 or any(i % 5 for i in got))


def test_matching_takes_the_most_alike_first(spark):
    rng = np.random.default_rng(5)
    s = [(i, j, round(float(rng.random()), 1)) for i in range(7) for j in range(5)]
    used, want = (set(), set()), set()
    for i, j, v in sorted(s, key=lambda r: (-r[2], r[0], r[1])):
        if i not in used[0] and j not in used[1]:
            used[0].add(i), used[1].add(j), want.add((i, j, v))
    df = spark.createDataFrame(s, "cluster_id long, topic_id long, s double")
    assert {tuple(r) for r in discovery.match_one_to_one(df).collect()} == want
    assert discovery.match_one_to_one(df.limit(0)).count() == 0


def test_no_references_is_not_relevant(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    refs = spark.createDataFrame([], "centroid array<double>")
    assert tuple(discovery.theme_relevance(docs, refs).first()) == (1, 0.0, False)


def test_detection_measures_name_every_method(spark):
    day = lambda d: dt.date(2026, 8, d)
    ev = spark.createDataFrame([("m", day(3), "x", "pelt"), ("m", day(20), "y", "pelt")], "monitor_id string, detected_on date, event_id string, method string")
    lab = spark.createDataFrame([("m", day(5)), ("m", day(10))], "monitor_id string, occurred_on date")
    got = {r["method"]: (r["events"], r["hits"], r["precision"], r["recall"], r["mean_lead"]) for r in cycle.detection_measures(ev, lab, ["robust_z", "pelt"]).collect()}
    assert got == {"robust_z": (0, 0, 0.0, 0.0, None), "pelt": (2, 1, 0.5, 0.5, 2.0), "ensemble": (2, 1, 0.5, 0.5, 2.0)}


def test_events_are_one_a_key_and_kind_and_cool_down(spark):
    start = dt.date(2026, 6, 1)
    # a spread in the history lets the score and the burst fire on one day
    p = spark.createDataFrame([("s", start + dt.timedelta(i), 10.0 + i % 3 if i < 25 else 90.0, "clean") for i in range(26)], "topic_id string, bucket date, value double, quality string")
    day = F.lit(start + dt.timedelta(25))
    none = spark.createDataFrame([], "topic_id string, kind string, detected_on date")
    got = cycle.trend_events(p, none, ["topic_id"], day).collect()
    assert [r["method"] for r in got if r["kind"] == "burst"] == ["kleinberg"]
    past = spark.createDataFrame([("s", "burst", start + dt.timedelta(24))], none.schema)
    assert "burst" not in {r["kind"] for r in cycle.trend_events(p, past, ["topic_id"], day).collect()}


def test_events_emerge_flip_and_rest_after_earlier_runs(spark):
    start, last = dt.date(2026, 6, 1), dt.date(2026, 6, 26)
    schema = "topic_id string, bucket date, value double, quality string"
    old = [("s", start + dt.timedelta(i), 10.0 + i % 3 if i < 24 else 90.0, "clean") for i in range(26)]
    p = spark.createDataFrame([*old, ("new", last, 8.0, "clean"), ("small", last, 2.0, "clean")], schema)
    mood = spark.createDataFrame([("s", start + dt.timedelta(i), (0.5 if i < 16 else -0.5) + i % 2 / 50, "clean") for i in range(26)], schema)
    none = spark.createDataFrame([], "topic_id string, kind string, detected_on date")
    alone = {(r["topic_id"], r["kind"]) for r in cycle.trend_events(p, none, ["topic_id"], F.lit(last), sentiment=mood).collect()}
    assert {("new", "emergence"), ("s", "sentiment_flip"), ("s", "burst")} <= alone and not any(t == "small" for t, _ in alone)
    # the burst of the day before suppresses today's
    again = {(r["topic_id"], r["kind"]) for r in cycle.daily_runs(p, ["topic_id"], last, before=1, sentiment=mood).collect()}
    assert ("s", "burst") not in again and ("new", "emergence") in again


def test_normalisation_of_few_days_tests_nothing(spark):
    p = spark.createDataFrame([("t", dt.date(2026, 6, d), float(d), 10.0) for d in range(1, 6)], "topic_id string, bucket date, value double, total double")
    got = {r["arm"]: (r["tested"], r["status"]) for r in cycle.normalisation(p).collect()}
    assert got == {"raw_count": (0, "measured"), "prevalence": (0, "measured"), "per_author": (0, "unavailable")}


def test_every_cycle_query_reads_the_tables(spark):
    for name in ("cluster_topic_match", "eval_detection", "eval_corroboration"):
        assert registry_cycle.queries()[name](spark, SF).count() > 0
