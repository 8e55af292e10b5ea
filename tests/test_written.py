"""The written daily table: which files a recompute touches, reruns, pruning, days that fail, changes that broke off."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rollup
from tidemark.sources import daily_table

DAYS = ["2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i, f"m{i % 2}", DAYS[i % 4], f"s{i % 3}", None if i % 11 == 0 else f"t{i % 5}", i % 9 != 0, (i % 7 - 3) / 4 if i % 6 else None, f"a{i % 10}", i % 5 + 1, i)
        for i in range(200)
    ]
    d = spark.createDataFrame(rows, "document_id long, monitor_id string, bucket string, source_name string, topic_id string, is_relevant boolean, sentiment_score double, author_hash string, rating int, engagement int")
    label = F.when(F.col("sentiment_score") >= 0.05, "positive").when(F.col("sentiment_score") <= -0.05, "negative").when(F.col("sentiment_score").isNotNull(), "neutral")
    return d.withColumn("bucket", F.col("bucket").cast("date")).withColumn("sentiment_label", label)


def ledger_of(docs):
    return docs.groupBy("monitor_id", "source_name", "bucket").agg(F.count("*").alias("kept")).withColumn("quota_hit", F.lit(False))


def rows_of(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns) if c != "reason") for r in df.collect())))


@pytest.fixture
def table(spark, docs, tmp_path):
    t = daily_table.daily_metrics(spark, str(tmp_path / "daily"), rollup.daily_rollup(docs, ledger_of(docs)))
    assert t.read().isEmpty()
    done, failed = daily_table.roll_up(t, docs, ledger_of(docs), docs)
    assert [str(x) for x in done] == DAYS and not failed
    return t


def by_day(table):
    return {day: {f for f in table.files() if f.startswith(f"bucket={day}/")} for day in DAYS}


def test_a_recompute_rewrites_its_days_only_and_twice_changes_nothing(spark, docs, table):
    assert rows_of(table.read()) == rows_of(rollup.daily_rollup(docs, ledger_of(docs)))
    before = by_day(table)
    assert all("grouping_id=" in f for f in table.files())
    fewer = docs.where("not (topic_id = 't3' and bucket = '2024-03-02')")
    late = docs.where("bucket in ('2024-03-02', '2024-03-03')")
    daily_table.late_arrivals(table, fewer, ledger_of(docs), late)
    after = by_day(table)
    assert before[DAYS[0]] == after[DAYS[0]] and before[DAYS[3]] == after[DAYS[3]]
    assert not before[DAYS[1]] & after[DAYS[1]] and not before[DAYS[2]] & after[DAYS[2]]
    want = rows_of(rollup.daily_rollup(fewer, ledger_of(docs)))
    assert rows_of(table.read()) == want and table.read().where("topic_id = 't3' and bucket = '2024-03-02'").isEmpty()
    daily_table.late_arrivals(table, fewer, ledger_of(docs), late)
    assert rows_of(table.read()) == want
    assert {r["reason"] for r in table.read().where("bucket = '2024-03-02'").collect()} == {"late_arrival"}


def test_one_monitor_of_a_day_and_days_and_grains_that_end_empty(spark, docs, table):
    only = docs.where("monitor_id = 'm0' and bucket = '2024-03-03'")
    other = table.read().where("not (monitor_id = 'm0' and bucket = '2024-03-03')")
    want = rows_of(other)
    daily_table.late_arrivals(table, docs.where("monitor_id = 'm1' or topic_id is null"), ledger_of(docs), only)
    assert rows_of(table.read().where("not (monitor_id = 'm0' and bucket = '2024-03-03')")) == want
    # no document of a topic is left that day: two grains go, with their folders
    daily_table.roll_up(table, docs.where("topic_id is null"), ledger_of(docs), docs.where("bucket = '2024-03-01'"))
    assert {f.split("/")[1] for f in by_day(table)[DAYS[0]]} == {"grouping_id=1", "grouping_id=3"}
    nothing = docs.limit(0)
    daily_table.roll_up(table, nothing, ledger_of(nothing), docs.where("bucket = '2024-03-04'"))
    assert not by_day(table)[DAYS[3]] and table.read().where("bucket = '2024-03-04'").isEmpty()


def test_a_day_that_fails_stays_and_stops_no_other(spark, docs, table):
    before = by_day(table)
    bad = docs.withColumn("engagement", F.when(F.col("bucket") == "2024-03-02", F.raise_error(F.lit("broken day")).cast("int")).otherwise(F.col("engagement") + 1))
    done, failed = daily_table.roll_up(table, bad, ledger_of(docs), docs)
    assert sorted(map(str, done)) == [DAYS[0], DAYS[2], DAYS[3]] and [str(x) for x in failed] == [DAYS[1]]
    after = by_day(table)
    assert after[DAYS[1]] == before[DAYS[1]] and not after[DAYS[0]] & before[DAYS[0]]


def test_a_change_that_broke_off_is_finished_or_dropped(spark, docs, table, monkeypatch):
    fewer = docs.where("topic_id <> 't1'")
    monkeypatch.setattr(daily_table.DayTable, "_apply", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.replace(rollup.daily_rollup(fewer, ledger_of(docs)).withColumn("reason", F.lit("x")), docs.select("monitor_id", "bucket").distinct())
    assert rows_of(table.read()) == rows_of(rollup.daily_rollup(docs, ledger_of(docs)))
    monkeypatch.undo()
    table.recover()
    assert rows_of(table.read()) == rows_of(rollup.daily_rollup(fewer, ledger_of(docs)))
    spark.range(1).write.parquet(f"{table.path}/_pending/half/rows")
    table.recover()
    assert rows_of(table.read()) == rows_of(rollup.daily_rollup(fewer, ledger_of(docs)))


def test_upsert_by_keys_with_nulls(spark, table, tmp_path):
    t = daily_table.DayTable(spark, str(tmp_path / "other"), spark.createDataFrame([], "day string, k string, v int").schema, ("day",))
    t.upsert(spark.createDataFrame([("a/b", None, 1), ("a/b", "x", 2), (None, "x", 3)], "day string, k string, v int"), ["day", "k"])
    t.upsert(spark.createDataFrame([("a/b", None, 4), (None, "x", 5), ("c", "x", 6)], "day string, k string, v int"), ["day", "k"])
    assert rows_of(t.read()) == sorted(map(repr, [("a/b", None, 4), ("a/b", "x", 2), (None, "x", 5), ("c", "x", 6)]))
