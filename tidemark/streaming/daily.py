"""Daily counts kept by a stream: events arrive as files, late ones amend their day, repeats are dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.discovery import shared_folder


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """``path`` is a folder of files or one file; the pattern covers both."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def daily_counts(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Rows and value by day and type; an event id counts once within the lateness allowed."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    by = e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def run_available(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """Take in what has landed, then stop. Each batch writes the days it touched; the newest batch of a day holds."""
    root = f"{shared_folder(spark, 'spark-stream-')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    by = spark.read.schema("day date, event_type string, n long, total double, batch long").parquet(f"{root}/out").groupBy("day", "event_type")
    return by.agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("day", "event_type", "x.n", F.round("x.total", 4).alias("total"))
