"""Ranks in groups of any size and bands stored by day, against the windows and the whole-table query."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import band_index, ranks, series, topics


@pytest.mark.parametrize("hot", [0.0, 1.0, 0.4])
def test_ranks_equal_the_window_and_spread_a_hot_group(spark, hot):
    rows = spark.range(5000).select(F.when(F.col("id") < 5000 * hot, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.xxhash64("id") % 1000).alias("v"), F.col("id").alias("own"))
    got = ranks.ranked(rows, ["g"], [F.desc("v"), F.col("own")], "place", "total")
    w = Window.partitionBy("g").orderBy(F.desc("v"), "own")
    want = rows.select("*", F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy("g")).alias("total"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = rows.repartitionByRange(F.col("g"), F.desc("v"), F.col("own")).groupBy(F.spark_partition_id()).count().collect()
        again = ranks.ranked(rows, ["g"], [F.desc("v"), F.col("own")], "place", "total")
        assert sorted(map(repr, again.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) >= 3 and max(r["count"] for r in spread) < 3000  # one group, all rows, several tasks
    assert ranks.ranked(rows.limit(0), ["g"], [F.col("v")]).count() == 0


def test_correction_and_drift_equal_their_windows(spark):
    c = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 9)).alias("m"), F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000 * F.when(F.col("id") % 50 == 0, 0.001).otherwise(1.0)).alias("p_value"))
    kept = lambda df: {r["id"]: r["kept"] for r in df.collect()}
    got, want = kept(ranks.bh_correction(c, ["m"])), kept(series.bh_correction(c, ["m"]))
    assert got == want and 0 < sum(got.values()) < 3000
    v = spark.range(900).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 4).cast("int").alias("topic_id"), F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 5)]).alias("embedding"))
    t = spark.createDataFrame([(i, [0.1 * i, 0.2, 0.3, 0.4]) for i in range(4)], "topic_id int, centroid array<double>")
    of = lambda df: {r["topic_id"]: (r["doc_count"], round(r["moved"], 9)) for r in df.collect()}
    assert of(ranks.centroid_drift(v, t)) == of(topics.centroid_drift(v, t))


def test_bands_by_day_equal_the_whole_table_without_a_shuffle_of_the_old(spark):
    base = [0x0123456789ABCDEF, 0x7EDCBA9876543210, 0x00FF00FF00FF00FF]
    rows = [(i, base[i % 3] ^ (1 << (i * 7 % 63)) ^ (1 << (i * 11 % 63)) if i % 4 else base[i % 3]) for i in range(240)]
    hashes = spark.createDataFrame(rows, "doc_id long, simhash long")
    index = band_index.BandIndex(spark, "bands_of_test", 4)
    got = {}
    for day in range(4):
        got |= {r["doc_id"]: r["near_duplicate_of"] for r in index.link(hashes.where(F.floor(F.col("doc_id") / 60) == day)).collect()}
    want = {r["doc_id"]: r["near_duplicate_of"] for r in tx.near_duplicates(hashes).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 100
    stored = spark.table("bands_of_test")
    assert stored.count() == 20 * stored.select("simhash").distinct().count()
    plan = index.earlier(hashes.where("doc_id >= 180"))._jdf.queryExecution().executedPlan().toString()
    # the stored side's branch: from its scan up to the join there is a sort at most
    scan = [line for line in plan.split("\n") if "bands_of_test" in line][0]
    depth = re_depth(scan)
    above = []
    for line in reversed(plan.split("\n")[: plan.split("\n").index(scan)]):
        if re_depth(line) < depth:
            above.append(line)
            depth = re_depth(line)
            if "SortMergeJoin" in line:
                break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above)


def re_depth(line):
    return len(line) - len(line.lstrip(" :+-*|()0123456789"))
