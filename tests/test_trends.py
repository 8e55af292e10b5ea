"""The detection cycle, landed payloads and topic upkeep: queries against SQL, functions against plain versions."""

import datetime as dt
import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_engine import plain
from tidemark import registry_cycle as registry
from tidemark.functions import text
from tidemark.operators import series, topics
from tidemark.plans import cycle, views
from tidemark.sources import ingest

TABLES = "events documents embeddings lineitem supplier customer orders nation pages labels conversations".split()


@pytest.mark.parametrize("name", ["feed_items", "unify_items", "news_items", "payload_validation", "fetch_ledger_runs", "stage_rerun_recompute", "topic_drift_score", "refit_remap", "merged_registry", "view_topic_history", "backfill_plan", "bucket_bounds_with_clock_changes", "resolve_merged", "trend_candidates", "trend_events", "opportunity_score"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name.startswith(("trend", "opp")) else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr(plain(r)) for r in found.fetchall())
    assert want and sorted(repr(plain(tuple(r))) for r in got.select(*names).collect()) == want


def test_simhash_keeps_repeated_keys_apart_and_links_every_near_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40)
    rows = [(int(i), int(b) ^ int(sum(1 << int(x) for x in rng.choice(63, k, replace=False)))) for i, (b, k) in enumerate(zip(np.repeat(base, 5), list(range(5)) * 40, strict=True))]
    near = {r["doc_id"]: r["near_duplicate_of"] for r in text.near_duplicates(spark.createDataFrame(rows, "doc_id long, simhash long")).collect()}
    for i, h in rows:
        assert near[i] == min((j for j, g in rows if j < i and (h ^ g).bit_count() <= 3), default=None)

    def own(t):
        total = [0] * 64
        for w in re.findall(r"\w+", (t or "").lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            total = [s + (1 if h >> i & 1 else -1) for i, s in enumerate(total)]
        u = sum(1 << i for i, s in enumerate(total) if s > 0)
        return u - (1 << 64) if u >= 1 << 63 else u

    docs = [(1, "The cat sat on the mat, the cat."), (1, "another text under the same key"), (2, None), (3, ""), (4, "Straße été " * 400)]
    got = Counter((r["doc_id"], r["simhash"]) for r in text.simhash(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == Counter((i, own(t)) for i, t in docs)
    assert text.simhash(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_matches_of_many_blocks(spark):
    rng = np.random.default_rng(4)
    x, r = rng.normal(size=(60, 5)), np.vstack([rng.normal(size=(25, 5)), np.zeros((1, 5))])
    docs = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, [0.0] * 5)], "vec_id long, embedding array<double>")
    refs = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(r)] + [(40, [float(v) for v in r[3]])], "topic_id int, centroid array<double>")
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit(x) @ unit(r[:25]).T
    for block in (4, 8192):
        got = {q["vec_id"]: (q["topic_id"], q["similarity"]) for q in topics.best_matches(docs, refs, "vec_id", "topic_id", block=block).collect()}
        assert len(got) == 61 and got[99] == (None, None)
        assert all(got[i][0] == s[i].argmax() and got[i][1] == pytest.approx(s[i].max()) for i in range(60))
    assert topics.best_matches(docs, refs.limit(0), "vec_id", "topic_id").where("topic_id is not null").count() == 0


def test_cooldown_of_a_span_equals_day_by_day(spark):
    rng = np.random.default_rng(6)
    start = dt.date(2026, 1, 1)
    rows = [(f"t{t}", "burst", start + dt.timedelta(int(d))) for t in range(5) for d in sorted(set(rng.integers(0, 30, 15).tolist()))]
    got = {tuple(r) for r in series.cooldown_history(spark.createDataFrame(rows, "topic_id string, kind string, detected_on date"), ["topic_id"]).collect()}
    want, last = set(), {}
    for t, k, d in sorted(rows):
        if t not in last or (d - last[t]).days >= 3:
            last[t] = d
            want.add((t, k, d))
    assert got == want


def test_matching_by_runs_equals_matching_whole(spark):
    rng = np.random.default_rng(7)
    start = dt.date(2026, 1, 1)
    labels = sorted({start + dt.timedelta(int(d)) for d in rng.integers(0, 200, 40)})
    events = [(start + dt.timedelta(int(d)), f"e{i}") for i, d in enumerate(rng.integers(0, 200, 60))]
    used, want = set(), set()
    for on in labels:
        free = [(abs((on - d).days), d, e) for d, e in events if abs((on - d).days) <= 3 and e not in used]
        if free:
            _, d, e = min(free)
            used.add(e)
            want.add(("m", on, e, (on - d).days))
    ev = spark.createDataFrame([("m", d, e) for d, e in events], "monitor_id string, detected_on date, event_id string")
    lab = spark.createDataFrame([("m", d) for d in labels], "monitor_id string, occurred_on date")
    assert {tuple(r) for r in views.match_events(ev, lab).collect()} == want


def test_drift_by_blocks_equals_one_walk(spark):
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(50, 4)), np.ones(4)
    rows = spark.createDataFrame([(i, 7, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, topic_id int, embedding array<double>")
    home = spark.createDataFrame([(7, [1.0] * 4)], "topic_id int, centroid array<double>")
    total = 0.0
    for v in x:
        total += 0.02 * np.linalg.norm(c - v)
        c = 0.98 * c + 0.02 * v
    for block in (6, 512):
        row = topics.drift_scores(rows, home, block=block).first()
        assert row["doc_count"] == 50 and row["drift_score"] == pytest.approx(total)


def test_replay_of_arms_equals_a_plain_one_and_rates_alarms(spark):
    rng = np.random.default_rng(9)
    start = dt.date(2026, 1, 1)
    v = rng.integers(5, 15, 40).astype(float)
    v[[25, 33]] = 90
    rows = spark.createDataFrame([("t", start + dt.timedelta(i), float(x), 100.0) for i, x in enumerate(v)], "topic_id string, bucket date, value double, total double")
    labels = spark.createDataFrame([("t", start + dt.timedelta(26))], "topic_id string, occurred_on date")
    fired = [i for i in range(14, 40) if (m := np.median(v[:i])) is not None and (s := np.median(abs(v[:i] - m)) * 1.4826) > 0 and abs(v[i] - m) / s >= 3.5]
    got = {r["arm"]: r for r in cycle.normalisation(rows, labels=labels).collect()}
    for arm in ("raw_count", "prevalence"):
        assert (got[arm]["tested"], got[arm]["fired"]) == (26, len(fired))
        assert got[arm]["variation"] == pytest.approx(v.std() / v.mean())
        assert got[arm]["false_positive_rate"] == pytest.approx(1 - 1 / len(fired))
    assert got["per_author"]["status"] == "unavailable" and got["per_author"]["false_positive_rate"] is None


def test_gates_log_what_correction_and_cooldown_take(spark):
    start = dt.date(2026, 6, 1)
    points = spark.createDataFrame([("s", start + dt.timedelta(i), 10.0 + i % 3 if i < 24 else 90.0, "clean") for i in range(26)] + [("low", start + dt.timedelta(25), 1.0, "clean")], "topic_id string, bucket date, value double, quality string")
    days = [start + dt.timedelta(24), start + dt.timedelta(25)]
    found = cycle.corrected(points, ["topic_id"], days)
    events = cycle.event_history(points, ["topic_id"], days)
    log = {(r["topic_id"], r["day"], r["kind"], r["reason"]) for r in cycle.gate_log(points, ["topic_id"], days, found, events).collect()}
    assert ("s", days[0], None, None) in log and ("low", days[1], None, "below_volume_floor") in log and ("s", days[1], "burst", "cooldown") in log
    assert views.without_evidence(events.withColumn("event_id", F.lit("e")), spark.createDataFrame([], "event_id string")).count() == events.count()


def test_report_isolates_a_failing_measure(spark):
    good = spark.createDataFrame([(0.5, 3)], "value double, sample_size long")
    got = {r["measure"]: (r["value"], r["status"], r["computed_over"]) for r in cycle.report({"good": good, "none": good.limit(0), "bad": lambda: good.select("nothing")}, "x").collect()}
    assert got == {"good": (0.5, "ok", "x"), "none": (None, "not_available", "x"), "bad": (None, "failed", "x")}


def test_atom_and_rss_entries(spark):
    rss = "<rss><channel><item><link>https://www.a.org/1</link><title>t</title><pubDate>Tue, 30 Jan 2024 10:00:00 +0100</pubDate></item></channel></rss>"
    atom = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>x</id><link href="https://b.org/2"/><summary>s</summary><updated>2024-01-30T09:00:00Z</updated></entry><entry><link href="https://b.org/3"/></entry></feed>'
    got = {r["external_id"]: r for r in ingest.parse_feed(spark.createDataFrame([(rss,), (atom,)], "payload string")).collect()}
    assert set(got) == {"https://www.a.org/1", "x", "https://b.org/3"}
    assert got["x"]["body"] == "s" and got["x"]["published_at"] == got["https://www.a.org/1"]["published_at"] and got["https://b.org/3"]["published_at"] is None
    items = {r["external_id"]: r["author"] for r in ingest.unify_items([ingest.parse_feed(spark.createDataFrame([(rss,)], "payload string"))]).collect()}
    assert items == {"https://www.a.org/1": "a.org"}


def test_long_merge_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(70)] + [(100, 101), (101, 102), (102, 100), (200, 999)]
    got = {r[0]: r[1] for r in topics.resolve_merged(spark.createDataFrame(rows, "topic_id long, merged_into long")).collect()}
    assert all(got[i] == 0 for i in range(70)) and got[100] is None and got[101] is None and got[200] is None


def test_new_vocabulary_is_a_candidate_of_the_job(spark):
    start = dt.date(2026, 6, 1)
    points = spark.createDataFrame([(t, start + dt.timedelta(i), 10.0 + i % 3, "clean") for t in ("s", "same") for i in range(26)], "topic_id string, bucket date, value double, quality string")
    old, new = "rivers barns sheep hills fences gates crows ponds lanes fields", "rockets orbits engines fuels pads crews suits visors hatches docks"
    texts = spark.createDataFrame([("s", False, old), ("s", True, new), ("same", False, old), ("same", True, old)], "topic_id string, today boolean, text string")
    none = spark.createDataFrame([], "topic_id string, kind string, detected_on date")
    got = {(r["topic_id"], r["kind"]) for r in cycle.trend_events(points, none, ["topic_id"], F.lit(start + dt.timedelta(25)), texts=texts, stop=["the"]).collect()}
    assert ("s", "novelty") in got and ("same", "novelty") not in got
