"""The engine's input tables as views over the star-schema and event tables: deterministic expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The intents a verdict may name.
INTENTS = ("bug_report", "feature_request", "praise", "complaint", "question", "comparison", "pricing", "churn", "other")


#: The day on which changes are planted.
PLANT_DAY = "2024-01-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their enrichment and topic, one row for each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k).withColumn("ts", F.col("ts").cast("timestamp"))
    score = F.when(F.col("k") % 11 != 0, (F.col("value") - 50) / (50 + F.abs(F.col("value") - 50)))
    zone = F.when(F.col("user_id") % 2 == 0, "UTC").otherwise("Asia/Jakarta")
    e = e.withColumn("s", score)
    return e.select(
        F.col("event_id").alias("document_id"), F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("monitor_id"), F.col("event_type").alias("source_name"),
        F.concat(F.lit("e"), (F.col("user_id") % 7).cast("string")).alias("entity_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("author_hash"), F.col("ts").alias("published_at"),
        F.to_date(F.from_utc_timestamp("ts", zone)).alias("bucket"), zone.alias("zone"), F.when(F.col("k") % 13 != 0, F.concat(F.lit("t"), (F.col("k") % 8).cast("string"))).alias("topic_id"),
        (F.col("k") % 10 != 7).alias("is_relevant"), F.col("s").alias("sentiment_score"),
        F.when(F.col("s") >= 0.05, "positive").when(F.col("s") <= -0.05, "negative").when(F.col("s").isNotNull(), "neutral").alias("sentiment_label"),
        F.when(F.col("k") % 3 != 0, 1 + F.col("k") % 5).alias("rating"), F.when(F.col("k") % 4 != 0, F.col("k")).alias("engagement"),
        F.when(F.col("k") % 5 != 0, F.element_at(F.array(*[F.lit(i) for i in INTENTS]), F.col("k") % 9 + 1)).alias("intent"), F.col("k"),
    )


def planted(spark: SparkSession, sf_dir: str, day: str = PLANT_DAY) -> DataFrame:
    """The feedback view with changes planted, so that detectors meet what they look for at their own thresholds.

    Topic t1 holds a fifth of its documents before the day (a burst on it), t2 grows day by day, t3's sentiment
    turns ten days before, t6's turns then and does not vary on either side, t4 has no document before the day (it emerges), t5 falls to a third nine days before.
    """
    docs, on = feedback(spark, sf_dir), F.lit(day).cast("date")
    topic, i = F.coalesce("topic_id", F.lit("")), F.col("document_id")
    early = F.col("bucket") < on
    gone = (
        ((topic == "t1") & early & (i % 5 != 0)) | ((topic == "t2") & (i % 30 > F.dayofmonth("bucket"))) | ((topic == "t4") & early)
        | ((topic == "t5") & (F.col("bucket") >= F.date_sub(on, 9)) & (i % 3 != 0))
    )
    flat = F.when(F.col("bucket") < F.date_sub(on, 10), 0.5).otherwise(-0.5)
    s = F.when((topic == "t6") & F.col("sentiment_score").isNotNull(), flat).when(topic == "t3", F.abs("sentiment_score") * F.when(F.col("bucket") < F.date_sub(on, 10), 1.0).otherwise(-1.0)).otherwise(F.col("sentiment_score"))
    label = F.when(F.col("sentiment_score") >= 0.05, "positive").when(F.col("sentiment_score") <= -0.05, "negative").when(F.col("sentiment_score").isNotNull(), "neutral")
    return docs.where(~gone).withColumn("sentiment_score", s).withColumn("sentiment_label", label)


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each monitor, source and local day: rows kept (0 where the source was absent) and whether the quota was hit."""
    by = docs.groupBy("monitor_id", "source_name", "bucket").agg(F.count("*").alias("n"))
    day, size = F.dayofmonth("bucket"), F.length("source_name")
    absent = (day + size) % 17 == 0
    return by.select("monitor_id", "source_name", "bucket", F.when(absent, 0).otherwise(F.col("n")).cast("long").alias("kept"), ((day * 7 + size) % 10 == 0).alias("quota_hit"))


def planted_ledger(docs: DataFrame) -> DataFrame:
    """The ledger with the quota hit by one source only, so that most days are clean."""
    return ledger(docs).withColumn("quota_hit", F.col("quota_hit") & (F.col("source_name") == "view"))


def runs(docs: DataFrame) -> DataFrame:
    days = docs.select("monitor_id", "bucket").distinct()
    return days.withColumn("status", F.when(F.dayofmonth("bucket") % 9 == 0, "partial").otherwise("complete"))


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_id, bucket, value: rows per ship day of each return flag and line status, a long series."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("topic_id"), F.to_date("l_shipdate").alias("bucket")).agg(F.count("*").cast("double").alias("value"))


#: The same views as DuckDB SQL, for the oracle.
FEEDBACK_SQL = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
e2 AS (SELECT *, CASE WHEN k % 11 <> 0 THEN (value - 50) / (50 + abs(value - 50)) END AS s FROM e),
feedback AS (SELECT event_id AS document_id, 'm' || (user_id % 2) AS monitor_id, event_type AS source_name, 'e' || (user_id % 7) AS entity_id, sha256(CAST(user_id AS VARCHAR)) AS author_hash,
  ts AS published_at, CAST(CASE WHEN user_id % 2 = 0 THEN ts ELSE ts + INTERVAL 7 HOUR END AS DATE) AS bucket, CASE WHEN k % 13 <> 0 THEN 't' || (k % 8) END AS topic_id,
  k % 10 <> 7 AS is_relevant, s AS sentiment_score, CASE WHEN s >= 0.05 THEN 'positive' WHEN s <= -0.05 THEN 'negative' WHEN s IS NOT NULL THEN 'neutral' END AS sentiment_label,
  CASE WHEN k % 3 <> 0 THEN 1 + k % 5 END AS rating, CASE WHEN k % 4 <> 0 THEN k END AS engagement,
  CASE WHEN k % 5 <> 0 THEN ['bug_report','feature_request','praise','complaint','question','comparison','pricing','churn','other'][k % 9 + 1] END AS intent, k FROM e2),
ledger AS (SELECT monitor_id, source_name, bucket, CAST(CASE WHEN (day(bucket) + length(source_name)) % 17 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS kept, (day(bucket) * 7 + length(source_name)) % 10 = 0 AS quota_hit
  FROM feedback GROUP BY 1, 2, 3),
runs AS (SELECT DISTINCT monitor_id, bucket, CASE WHEN day(bucket) % 9 = 0 THEN 'partial' ELSE 'complete' END AS status FROM feedback)"""

DAILY_SQL = """
daily AS (SELECT l_returnflag || l_linestatus AS topic_id, CAST(l_shipdate AS DATE) AS bucket, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"""

_GONE = f"""((coalesce(topic_id, '') = 't1' AND bucket < DATE '{PLANT_DAY}' AND document_id % 5 <> 0) OR (coalesce(topic_id, '') = 't2' AND document_id % 30 > day(bucket))
  OR (coalesce(topic_id, '') = 't4' AND bucket < DATE '{PLANT_DAY}') OR (coalesce(topic_id, '') = 't5' AND bucket >= DATE '{PLANT_DAY}' - 9 AND document_id % 3 <> 0))"""
_PLANT = f"""feedback1 AS (SELECT *, CASE WHEN topic_id = 't6' AND sentiment_score IS NOT NULL THEN CASE WHEN bucket < DATE '{PLANT_DAY}' - 10 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END WHEN topic_id = 't3' THEN abs(sentiment_score) * CASE WHEN bucket < DATE '{PLANT_DAY}' - 10 THEN 1 ELSE -1 END ELSE sentiment_score END AS ns FROM feedback0 WHERE NOT {_GONE}),
feedback AS (SELECT document_id, monitor_id, source_name, entity_id, author_hash, published_at, bucket, topic_id, is_relevant, ns AS sentiment_score,
  CASE WHEN ns >= 0.05 THEN 'positive' WHEN ns <= -0.05 THEN 'negative' WHEN ns IS NOT NULL THEN 'neutral' END AS sentiment_label, rating, engagement, intent, k FROM feedback1),
ledger AS ("""
_HIT = "% 10 = 0 AS quota_hit"
PLANTED_SQL = FEEDBACK_SQL.replace(_HIT, _HIT.replace(" AS", " AND source_name = 'view' AS")).replace("feedback AS (SELECT event_id", "feedback0 AS (SELECT event_id").replace("ledger AS (", _PLANT)
