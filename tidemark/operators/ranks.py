"""Ranks within groups of any size, without a window task for a group.

Rows are range-partitioned by group and order and sorted within their part; a row's place is its place in the part plus
the counts of its group's earlier parts. The window that adds those up has a row for each group and part. A group
with all rows is so spread over all tasks. Ties keep an order of their own, fixed when the rows are first written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.discovery import stored


def ranked(rows: DataFrame, keys: list[str], order: list[Column], place: str = "place", total: str | None = None) -> DataFrame:
    """rows with ``place`` (from 1) in the group of ``keys`` and, where asked for, the group's ``total``; null keys are a group of their own."""
    names = [f"_key{i}" for i in range(len(keys))]
    own = rows.withColumns({n: F.col(k) for n, k in zip(names, keys, strict=True)}).withColumn("_own", F.monotonically_increasing_id())
    by = [*[F.col(k) for k in keys], *order, F.col("_own")]
    own = stored(own)
    ranged = stored(own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_own")).withColumn("_part", F.shiftright("_at", 33))
    parts = ranged.groupBy(*names, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_start"))
    group = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select(*[F.col(n).alias(f"{n}s") for n in names], F.col("_part").alias("_of"), (before - F.col("_start") + 1).alias("_shift"), F.sum("_n").over(group).alias("_total"))
    same = [F.col(n).eqNullSafe(F.col(f"{n}s")) for n in names]
    met = ranged.join(shifts, [F.col("_part") == F.col("_of"), *same])
    return met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(place), *([F.col("_total").alias(total)] if total else []))


def bh_correction(candidates: DataFrame, family: list[str], alpha: float = 0.1) -> DataFrame:
    """Benjamini-Hochberg as ``series.bh_correction``, where a family may hold most of all rows: candidates with rank, n and kept."""
    met = stored(ranked(candidates, family, [F.col("p_value")], "rank", "n"))
    passed = met.where(F.col("p_value") <= F.col("rank") * alpha / F.col("n")).groupBy(*[F.col(f).alias(f"_{f}") for f in family]).agg(F.max("rank").alias("_last"))
    same = [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in family]
    out = met.join(passed, same, "left")
    return out.select(*candidates.columns, "rank", "n", F.coalesce(F.col("rank") <= F.col("_last"), F.lit(False)).alias("kept"))


def centroid_drift(assigned: DataFrame, topics: DataFrame, rate: float = 0.02) -> DataFrame:
    """The moving centroid as ``topics.centroid_drift``, where a topic may hold most of all rows."""
    met = ranked(assigned.select("topic_id", "vec_id", "embedding"), ["topic_id"], [F.desc("vec_id")], "place", "n")
    # vectors whose weight no double holds any more still count
    x = met.select("topic_id", "n", (F.lit(rate) * F.pow(F.lit(1 - rate), F.col("place") - 1)).alias("w"), F.posexplode("embedding").alias("i", "x"))
    by = x.groupBy("topic_id", "i").agg(F.sum(F.col("w") * F.col("x")).alias("added"), F.first("n").alias("n"))
    c = topics.select("topic_id", F.posexplode("centroid").alias("i", "c"))
    out = c.join(by, ["topic_id", "i"]).withColumn("new", F.pow(F.lit(1 - rate), F.col("n")) * F.col("c") + F.col("added"))
    return out.groupBy("topic_id").agg(F.first("n").cast("long").alias("doc_count"), F.sqrt(F.sum((F.col("new") - F.col("c")) * (F.col("new") - F.col("c")))).alias("moved"))
