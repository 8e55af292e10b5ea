"""A detector that fails stops no other; a flip without variance has a score; topics without a metric have a reason."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.plans import cycle, views

START = dt.date(2026, 6, 1)
POINTS = "topic_id string, bucket date, value double, quality string"


def test_a_failing_detector_stops_no_other(spark, monkeypatch):
    points = spark.createDataFrame([("s", START + dt.timedelta(i), 10.0 + i % 3 if i < 25 else 90.0, "clean") for i in range(26)], POINTS)
    days = [START + dt.timedelta(25)]
    whole = {(r["kind"], r["method"]) for r in cycle.corrected(points, ["topic_id"], days, failed={}).collect()}
    plain = {(r["kind"], r["method"]) for r in cycle.corrected(points, ["topic_id"], days).collect()}
    own = series.detect_robust_z
    monkeypatch.setattr(series, "detect_robust_z", lambda *a, **k: own(*a, **k).withColumn("statistic", F.raise_error(F.lit("a broken detector")).cast("double")))
    failed: dict = {}
    left = {(r["kind"], r["method"]) for r in cycle.corrected(points, ["topic_id"], days, failed=failed).collect()}
    assert whole == plain and ("burst", "robust_z") in whole and left == whole - {("burst", "robust_z")} and left
    assert list(failed) == ["robust_z"] and failed["robust_z"]


def test_flips_without_variance_have_a_bounded_severity_and_scores_are_numbers(spark):
    near = [("flat", START + dt.timedelta(i), 0.5 if i < 14 else -0.5, "clean") for i in range(21)] + [("loud", START + dt.timedelta(i), (0.4 if i < 14 else -0.4) + 0.05 * (i % 3), "clean") for i in range(21)]
    got = {r["topic_id"]: r["statistic"] for r in series.detect_changepoint(spark.createDataFrame(near, POINTS), ["topic_id"], F.lit(START + dt.timedelta(20)), kind="sentiment_flip").collect()}
    assert got["flat"] == -series.CERTAIN and -series.CERTAIN < got["loud"] < 0
    day = START + dt.timedelta(20)
    events = spark.createDataFrame([("m", t, day, "sentiment_flip", abs(s)) for t, s in got.items()], "monitor_id string, topic_id string, detected_on date, kind string, severity double")
    metric = [("m", day, None, t, 2, 10, 0.9) for t in ("flat", "loud", "still")] + [("m", day, "s", t, 0, 10, 0.9) for t in ("flat", "loud", "still")] + [("m", day, "s", None, 1, 30, 0.9)]
    metrics = spark.createDataFrame(metric, "monitor_id string, bucket date, source_name string, topic_id string, grouping_id long, doc_count long, author_diversity double")
    trust = spark.createDataFrame([("m", day, True)], "monitor_id string, bucket date, trusted boolean")
    scores = views.trend_scores(views.score_components(metrics, events), trust)
    by = {r["topic_id"]: r for r in scores.collect()}
    assert all(not math.isnan(r["value"]) for r in by.values()) and by["flat"]["sentiment"] == 1.0 and 0 < by["loud"]["sentiment"] < 1 and by["still"]["sentiment"] == 0.0
    every = spark.createDataFrame([("m", day, t) for t in ("flat", "loud", "still", "silent")] + [("m", day - dt.timedelta(1), "flat")], "monitor_id string, bucket date, topic_id string")
    late = trust.unionByName(spark.createDataFrame([("m", day - dt.timedelta(1), False)], trust.schema))
    reasons = {(r["topic_id"], r["bucket"]): r["withheld_reason"] for r in views.scores_of_all(scores, every, late).collect()}
    assert reasons[("silent", day)] == "no_metric_for_day" and reasons[("flat", day - dt.timedelta(1))] == "day_untrustworthy" and reasons[("flat", day)] is None and len(reasons) == 5
