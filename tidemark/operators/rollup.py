"""Daily metrics: one row per day for each source and topic, each source, each topic, and all.

``grouping_id`` tells a null topic from "every topic". Each document goes through one expand and one partial
aggregation; sample sizes join afterwards, by grain, from the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["monitor_id", "bucket", "source_name", "topic_id"]


def sample_context(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(present, absent) sources of each day: kept summed over runs, quota flags or-ed."""
    by = ledger.groupBy("monitor_id", "source_name", "bucket").agg(F.sum("kept").alias("sample_size"), F.max("quota_hit").alias("quota_hit"))
    return by.where("sample_size > 0"), by.where("sample_size = 0").withColumn("reason", F.lit("empty")).drop("sample_size", "quota_hit")


def ledger_violations(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Days of a source that hold documents although the ledger has no row, or kept none."""
    days = docs.groupBy("monitor_id", "source_name", "bucket").agg(F.count("*").alias("documents"))
    met = days.join(ledger.groupBy("monitor_id", "source_name", "bucket").agg(F.sum("kept").alias("kept")), ["monitor_id", "source_name", "bucket"], "left")
    return met.where(F.coalesce("kept", F.lit(0)) == 0).select("monitor_id", "source_name", "bucket", "documents", F.when(F.col("kept").isNull(), "ledger_missing").otherwise("sample_zero").alias("violation"))


def rollup_input(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Relevant documents of present sources."""
    present, _ = sample_context(ledger)
    return docs.where("is_relevant").join(present.select("monitor_id", "source_name", "bucket"), ["monitor_id", "source_name", "bucket"], "left_semi")


def figures() -> list:
    return [
        F.count("document_id").alias("doc_count"), F.avg("sentiment_score").alias("sentiment_mean"), F.expr("percentile(sentiment_score, 0.25)").alias("sentiment_p25"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negatives"), F.sum("engagement").alias("engagement_sum"), F.count_distinct("author_hash").alias("authors"), F.avg("rating").alias("rating_mean"),
    ]


def daily_rollup(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """The four grains. A document without a topic counts in the source's row and the day's, and in no topic's."""
    rows = rollup_input(docs, ledger)
    sets = [[], ["source_name"], ["topic_id"], ["source_name", "topic_id"]]
    sets = [["monitor_id", "bucket", *s] for s in sets]
    cols = [F.col(c) for c in KEYS]
    by = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping("source_name").alias("no_source"), F.grouping("topic_id").alias("no_topic"), *figures())
    by = by.where(~((F.col("no_topic") == 0) & F.col("topic_id").isNull()))
    present, _ = sample_context(ledger)
    by_source = present.select("monitor_id", "bucket", F.col("source_name").alias("s"), F.col("sample_size").alias("own"), F.col("quota_hit").alias("own_hit"))
    by_day = present.groupBy("monitor_id", "bucket").agg(F.sum("sample_size").alias("day_size"), F.max("quota_hit").alias("day_hit"))
    # a day with a present source has an overall row even without documents
    overall = by_day.select("monitor_id", "bucket").join(by.where("no_source = 1 and no_topic = 1").drop("source_name", "topic_id", "no_source", "no_topic"), ["monitor_id", "bucket"], "left")
    text = F.lit(None).cast("string")
    overall = overall.withColumn("source_name", text).withColumn("topic_id", text).withColumn("no_source", F.lit(1).cast("byte")).withColumn("no_topic", F.lit(1).cast("byte"))
    by = by.where("no_source = 0 or no_topic = 0").unionByName(overall.select(by.columns))
    met = by.join(by_day, ["monitor_id", "bucket"]).join(by_source, (F.col("source_name") == F.col("s")) & (by["monitor_id"] == by_source["monitor_id"]) & (by["bucket"] == by_source["bucket"]), "left")
    size = F.when(F.col("no_source") == 0, F.col("own")).otherwise(F.col("day_size"))
    n = F.coalesce("doc_count", F.lit(0))
    share = lambda x: F.coalesce(F.when(n > 0, x / n), F.lit(0.0))
    return met.select(
        by["monitor_id"], by["bucket"], "source_name", "topic_id", (F.col("no_source") * 2 + F.col("no_topic")).cast("long").alias("grouping_id"), n.cast("long").alias("doc_count"),
        F.round(F.when(size > 0, n / size).otherwise(0.0), 6).alias("doc_count_share"), size.cast("long").alias("sample_size"), F.when(F.col("no_source") == 0, F.col("own_hit")).otherwise(F.col("day_hit")).alias("quota_hit"),
        F.round("sentiment_mean", 6).alias("sentiment_mean"), F.round("sentiment_p25", 6).alias("sentiment_p25"), F.round(share(F.col("negatives")), 6).alias("negativity_rate"),
        F.col("engagement_sum").cast("long").alias("engagement_sum"), F.round(share(F.col("authors")), 6).alias("author_diversity"), F.round("rating_mean", 6).alias("rating_mean"),
    )


def intent_counts(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counts of intents for each monitor, day and topic, as a map; two aggregations, no list of documents."""
    by = rollup_input(docs, ledger).where("topic_id is not null and intent is not null").groupBy("monitor_id", "bucket", "topic_id", "intent").count()
    return by.groupBy("monitor_id", "bucket", "topic_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("intent", "count")))).alias("intent_counts"))


def late_recompute(docs: DataFrame, ledger: DataFrame, late: DataFrame, reason: str = "late_arrival") -> DataFrame:
    """The rollup of only those local days that late (or otherwise changed) documents touch."""
    days = late.select("monitor_id", "bucket").distinct()
    keep = lambda df: df.join(days, ["monitor_id", "bucket"], "left_semi")
    return daily_rollup(keep(docs), keep(ledger)).withColumn("reason", F.lit(reason))


def without(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new; nulls are equal."""
    names = [f"_new_{k}" for k in keys]
    other = new.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    return old.join(other, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left_anti")


def upsert_keep_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new, and the new."""
    return without(old, new, keys).unionByName(new)


def prune_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a recompute of their day no longer supports."""
    days = new.select("monitor_id", "bucket").distinct()
    return without(old.join(days, ["monitor_id", "bucket"], "left_semi").select(old.columns), new, keys)
