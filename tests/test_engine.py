import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import registry_cycle as registry
from tidemark.functions import stats, text
from tidemark.operators import rollup, series, topics
from tidemark.plans import views

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)[:19] if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.mark.parametrize("name", ["daily_rollup", "near_dups", "language_guess", "quota_topk", "robust_baseline", "bh_correction", "nearest_topic", "trend_scores", "source_health"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "events documents embeddings lineitem supplier customer orders nation pages labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr(plain(r)) for r in found.fetchall())
    assert sorted(repr(plain(tuple(r))) for r in got.select(*names).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def points(spark, values, start=dt.date(2026, 6, 1), quality=None):
    rows = [("s", start + dt.timedelta(i), float(v), (quality or {}).get(i, "clean")) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic_id string, bucket date, value double, quality string"), F.lit(rows[-1][1])


def kinds(spark, values):
    p, day = points(spark, values)
    return {r["kind"] for r in series.bh_correction(series.trend_candidates(p, ["topic_id"], day), ["topic_id"]).where("kept").collect()}


def test_spike_is_a_burst(spark):
    # a flat history has no spread, so the score of the spike comes from the burst detector
    assert "burst" in kinds(spark, [10] * 25 + [50])


def test_slow_rise_is_growth_and_no_burst(spark):
    found = kinds(spark, [10 + i for i in range(26)])
    assert "sustained_growth" in found and "burst" not in found


def test_weekend_rhythm_is_no_trend(spark):
    found = kinds(spark, [5 if (dt.date(2026, 6, 1) + dt.timedelta(i)).weekday() >= 5 else 10 for i in range(28)])
    assert not found & {"sustained_growth", "decline"}


def test_gates(spark):
    for values, reason in (([1] * 26, "below_volume_floor"), ([10] * 5, "insufficient_baseline"), ([10] * 26, None)):
        p, day = points(spark, values)
        assert series.gate_outcomes(p, ["topic_id"], day).first()["reason"] == reason


def test_truncated_points_stay_out_of_the_baseline(spark):
    p, day = points(spark, [10] * 20 + [999, 10], quality={20: "truncated"})
    assert series.robust_baseline(p, ["topic_id"], day).first()["clean_days"] == 20


def test_tail_probabilities():
    assert stats.poisson_upper(3, 2.0) == pytest.approx(0.3233235838)
    assert stats.poisson_lower(1, 2.0) == pytest.approx(0.4060058497)
    assert stats.poisson_upper(60, 5.0) == pytest.approx(7.7e-43, rel=0.1)
    assert stats.student_two_sided(2.0, 10) == pytest.approx(0.07338803)


def test_source_verdicts(spark):
    rows = [("a", 0, 1, None, 2), ("b", 0, 2, 10.0, 10), ("c", 2, 0, 20.0, 10), ("d", 18, 0, 20.0, 10)]
    h = spark.createDataFrame([("m", *r) for r in rows], "monitor_id string, source_name string, latest long, consecutive_empty long, rows_median_28d double, history long")
    assert {r["source_name"]: r["state"] for r in views.source_health(h).collect()} == {"a": "healthy", "b": "broken", "c": "degraded", "d": "healthy"}


def test_event_match_and_lead(spark):
    day = lambda d: dt.date(2026, 8, d)
    ev = spark.createDataFrame([("m", day(3), "x"), ("m", day(20), "y")], "monitor_id string, detected_on date, event_id string")
    lab = spark.createDataFrame([("m", day(5)), ("m", day(10))], "monitor_id string, occurred_on date")
    assert [(r["event_id"], r["lead_days"]) for r in views.match_events(ev, lab).collect()] == [("x", 2)]


def test_text_functions(spark):
    row = spark.createDataFrame([("  a  b  ", "mail x.y@z.org or +1 415-555-2671 see https://a.b/c")], "a string, b string").select(text.clean_text(F.col("a")), text.strip_pii(F.col("b"))).first()
    assert row[0] == "a b" and row[1] == "mail [email] or [phone] see [link]"


def test_local_day(spark):
    row = spark.sql("select timestamp'2026-08-13 17:30:00' t").select(text.local_day(F.col("t"), F.lit("Asia/Jakarta")).cast("string")).first()
    assert row[0] == "2026-08-14"


def test_share_and_absent_sources(spark):
    cols = "document_id long, monitor_id string, source_name string, topic_id string, bucket date, is_relevant boolean, sentiment_score double, sentiment_label string, engagement int, author_hash string, rating int"
    d = dt.date(2026, 8, 10)
    docs = spark.createDataFrame([(i, "m", "play", "t", d, True, 0.5, "positive", 1, f"a{i}", 4) for i in range(4)], cols)
    led = spark.createDataFrame([("m", "play", d, 10, False), ("m", "rss", d, 0, False)], "monitor_id string, source_name string, bucket date, kept long, quota_hit boolean")
    rows = rollup.daily_rollup(docs, led).collect()
    assert len(rows) == 4 and {(r["doc_count"], r["sample_size"], r["doc_count_share"]) for r in rows} == {(4, 10, 0.4)}


def test_merged_topics_and_cycles(spark):
    t = spark.createDataFrame([("t7", "t6"), ("t6", "t5"), ("t5", None), ("x", "y"), ("y", "x")], "topic_id string, merged_into string")
    assert {r[0]: r[1] for r in topics.resolve_merged(t).collect()} == {"t7": "t5", "t6": "t5", "t5": "t5", "x": None, "y": None}
