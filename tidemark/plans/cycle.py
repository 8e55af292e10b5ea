"""The detection cycle's events, what the reports read of it, and its measures against labels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.operators.discovery import stored
from tidemark.operators.topics import dot
from tidemark.plans import views


def emergence(metrics: DataFrame, least_days: int = 14) -> DataFrame:
    """Topics on the first day they have a metrics row; only where too few clean days lie before, p is 0."""
    w = Window.partitionBy("monitor_id", "topic_id").orderBy("bucket")
    seen = metrics.withColumn("first_seen", F.min("bucket").over(w)).withColumn("before", F.count("*").over(w) - 1)
    return seen.where((F.col("first_seen") == F.col("bucket")) & (F.col("before") < least_days)).select("monitor_id", "topic_id", "bucket", F.lit(0.0).alias("p_value"))


def novelty(docs: DataFrame, stop: list[str], top: int = 10, least: float = 0.5, keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """(keys, today, text): the share of today's heaviest terms that are not among the days' before.

    Two pseudo-documents for each key, smoothed idf; a key without text on either side has no row.
    """
    words = docs.select(*keys, "today", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term")).where(~F.col("term").isin(stop))
    tf = words.groupBy(*keys, "term").agg(F.count_if("today").alias("new"), F.count_if(~F.col("today")).alias("old"))
    idf = F.log(F.lit(3.0) / (1 + (F.col("new") > 0).cast("int") + (F.col("old") > 0).cast("int"))) + 1
    sides = tf.select(*keys, "term", F.explode(F.array(F.struct(F.lit(True).alias("today"), (F.col("new") * idf).alias("w")), F.struct(F.lit(False).alias("today"), (F.col("old") * idf).alias("w")))).alias("s")).select(*keys, "term", "s.*").where("w > 0")
    place = F.row_number().over(Window.partitionBy(*keys, "today").orderBy(F.desc("w"), "term"))
    best = sides.withColumn("place", place).where(F.col("place") <= top)
    by = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("today"), F.col("term")))).alias("new"), F.collect_list(F.when(~F.col("today"), F.col("term"))).alias("old"))
    by = by.where("size(new) > 0 and size(old) > 0").withColumn("fresh", F.array_except("new", "old"))
    ratio = F.size("fresh") / F.size("new")
    return by.select(*keys, ratio.alias("statistic"), (ratio >= least).alias("fired"), F.array_join("fresh", " ").alias("terms"))


def emerging(points: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Candidates of keys first seen on the day, over the volume floor but without a baseline; p is 0."""
    first = points.where((F.col("value") > 0) & (F.col("bucket") <= day)).groupBy(*keys).agg(F.min("bucket").alias("first_seen"), F.max(F.when(F.col("bucket") == day, F.col("value"))).alias("latest"))
    new = series.gate_outcomes(points, keys, day).where("reason = 'insufficient_baseline'").join(first.where(F.col("first_seen") == day), keys)
    value = F.col("latest")
    return new.select(*keys, F.lit("emergence").alias("kind"), F.lit("emergence").alias("method"), value.alias("statistic"), F.lit(0.0).alias("p_value"), value.alias("observed"), F.lit(0.0).alias("expected"), F.lit("rising").alias("direction"))


def sentiment_flips(points: DataFrame, sentiment: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Change points of the daily sentiment, not deseasonalised, of the keys whose volume passes the gates."""
    passed = series.gate_outcomes(points, keys, day).where("passed").select(*keys)
    return series.detect_changepoint(sentiment.join(passed, keys), keys, day, kind="sentiment_flip")


def novel(points: DataFrame, texts: DataFrame, keys: list[str], day: Column, stop: list[str]) -> DataFrame:
    """Candidates of new vocabulary, of the keys whose volume passes the gates; p is 0. ``texts``: keys, today, text."""
    passed = series.gate_outcomes(points, keys, day).where("passed").select(*keys)
    met = novelty(texts, stop, keys=tuple(keys)).where("fired").join(passed, keys)
    share = F.col("statistic")
    return met.select(*keys, F.lit("novelty").alias("kind"), F.lit("ctfidf").alias("method"), share.alias("statistic"), F.lit(0.0).alias("p_value"), share.alias("observed"), F.lit(0.0).alias("expected"), F.lit("rising").alias("direction"))


def survivors(parts: dict[str, Callable[[], DataFrame]], failed: dict[str, str]) -> DataFrame:
    """The candidates of all detectors as one job; where that fails, each runs alone, and ``failed`` gets the error of each that does."""
    try:
        return stored(reduce(DataFrame.unionByName, [find() for find in parts.values()]))
    except Exception:
        kept = []
        for name, find in parts.items():
            try:
                kept.append(stored(find()))
            except Exception as e:
                failed[name] = str(e).splitlines()[0]
        if not kept:
            raise
        return reduce(DataFrame.unionByName, kept)


def all_candidates(points: DataFrame, keys: list[str], day: Column, sentiment: DataFrame | None = None, texts: DataFrame | None = None, stop: list[str] | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """Every detector's candidates: the ensemble, emergence where the baseline gate fails, flips of sentiment, new vocabulary.

    With ``failed`` one failing detector is named there and skipped, and the others' candidates stay.
    """
    parts = series.detectors(points, keys, day) | {"emergence": lambda: emerging(points, keys, day)}
    if sentiment is not None:
        parts["sentiment_flip"] = lambda: sentiment_flips(points, sentiment, keys, day)
    if texts is not None:
        parts["ctfidf"] = lambda: novel(points, texts, keys, day, stop or [])
    return reduce(DataFrame.unionByName, [find() for find in parts.values()]) if failed is None else survivors(parts, failed)


def trend_events(points: DataFrame, past: DataFrame, keys: list[str], day: Column, alpha: float = 0.1, sentiment: DataFrame | None = None, texts: DataFrame | None = None, stop: list[str] | None = None) -> DataFrame:
    """Gates, detectors, false-discovery correction, cooldown and one event for each key and kind, as one job.

    A family of the correction is a monitor's day: all keys but the topic. ``sentiment`` holds the series of mean
    sentiment in the columns of ``points``; without it nothing flips.
    """
    found = all_candidates(points, keys, day, sentiment, texts, stop)
    kept = series.bh_correction(found, [k for k in keys if k != "topic_id"], alpha).where("kept")
    return series.collapse_events(series.cooldown(kept, past, keys, day), keys, day)


def daily_runs(points: DataFrame, keys: list[str], day: dt.date, before: int = series.COOLDOWN, alpha: float = 0.1, sentiment: DataFrame | None = None, texts: DataFrame | None = None, stop: list[str] | None = None) -> DataFrame:
    """Events of the day, after the days before it have run: what ``event_history`` keeps of it."""
    return event_history(points, keys, [day - dt.timedelta(back) for back in range(before, -1, -1)], alpha, sentiment, texts, stop).where(F.col("detected_on") == F.lit(day))


def corrected(points: DataFrame, keys: list[str], days: list[dt.date], alpha: float = 0.1, sentiment: DataFrame | None = None, texts: DataFrame | None = None, stop: list[str] | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """Candidates of all the days at once, with their rank within a monitor's day and whether the correction keeps them.

    The first day is the first run ever: it has no past. ``texts`` may carry the day (``day``), or else tells of the last one.
    """
    dated = [*keys, "day"]
    mood = None if sentiment is None else series.as_of(sentiment, days)
    if texts is not None and "day" not in texts.columns:
        texts = texts.withColumn("day", F.lit(days[-1]))
    found = all_candidates(series.as_of(points, days), dated, F.col("day"), mood, texts, stop, failed)
    return series.bh_correction(found, [k for k in dated if k != "topic_id"], alpha)


def event_history(points: DataFrame, keys: list[str], days: list[dt.date], alpha: float = 0.1, sentiment: DataFrame | None = None, texts: DataFrame | None = None, stop: list[str] | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """Events of a run of days, each with the cooldown that the events before it leave."""
    kept = corrected(points, keys, days, alpha, sentiment, texts, stop, failed).where("kept")
    events = series.collapse_events(kept, [*keys, "day"], F.col("day")).drop("day")
    return events.join(series.cooldown_history(events, keys), [*keys, "kind", "detected_on"], "left_semi")


def gate_log(points: DataFrame, keys: list[str], days: list[dt.date], candidates: DataFrame, events: DataFrame) -> DataFrame:
    """keys, day, kind, passed, reason: one row for each topic and gate of its series, and for each candidate kind that
    the correction or the cooldown takes away."""
    dated = [*keys, "day"]
    own = series.gate_outcomes(series.as_of(points, days), dated, F.col("day")).select(*dated, F.lit(None).cast("string").alias("kind"), "passed", "reason")
    kinds = candidates.groupBy(*dated, "kind").agg(F.max("kept").alias("kept"))
    fired = events.select(*keys, F.col("detected_on").alias("day"), "kind", F.lit(True).alias("fired"))
    lost = kinds.join(fired, [*dated, "kind"], "left").where("fired is null")
    reason = F.when(F.col("kept"), "cooldown").otherwise("corrected_away")
    return own.unionByName(lost.select(*dated, "kind", F.lit(False).alias("passed"), reason.alias("reason")))


def event_identity(found: DataFrame, order: list[str]) -> DataFrame:
    """One event of each monitor, topic, day and kind: the method last in ``order`` wins; severity is the statistic's size."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    by = found.groupBy("monitor_id", "topic_id", "detected_on", "kind").agg(F.max(F.struct(rank.alias("rank"), F.abs("statistic").alias("severity"), "method")).alias("x"))
    return by.select("monitor_id", "topic_id", "detected_on", "kind", "x.method", "x.severity")


def backfill_outcome(days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, collected): nothing collected is failed, some days failed is partial; with both lists of days."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("day").cast("string")))), ",")
    by = days.groupBy(*keys).agg(F.count_if("collected").alias("ok"), F.count("*").alias("n"), listed(F.col("collected")).alias("collected_on"), listed(~F.col("collected")).alias("failed_on"))
    status = F.when(F.col("ok") == 0, "failed").when(F.col("ok") < F.col("n"), "partial").otherwise("complete")
    return by.select(*keys, status.alias("status"), "collected_on", "failed_on")


def topic_context(statistics: DataFrame, picked: DataFrame) -> DataFrame:
    """A topic's statistics with its representatives in order; topics without any are left out."""
    docs = picked.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda s: s["vec_id"]).alias("document_ids"))
    return statistics.join(docs, "topic_id")


def _rate(hits: str, of: str) -> Column:
    return F.coalesce(F.col(hits) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))


def detection_measures(events: DataFrame, labels: DataFrame, methods: list[str], tolerance: int = 3) -> DataFrame:
    """Precision, recall and mean lead of each method and of all together; methods without events have rows too.

    One matching job for all: the method, and the ensemble as one more, are keys of it.
    """
    spark = events.sparkSession
    arms = events.select(F.explode(F.array(F.col("method"), F.lit("ensemble"))).alias("method"), "monitor_id", "detected_on", "event_id")
    names = spark.createDataFrame([(m,) for m in [*methods, "ensemble"]], "method string")
    wanted = labels.select("monitor_id", "occurred_on").join(F.broadcast(names), how="inner", on=F.lit(True))
    met = views.match_events(arms, wanted, tolerance, ("method", "monitor_id")).groupBy("method").agg(F.count("*").alias("hits"), F.avg("lead_days").alias("mean_lead"))
    by = names.join(arms.groupBy("method").agg(F.count("*").alias("events")), "method", "left").join(met, "method", "left")
    by = by.join(labels.agg(F.count("*").alias("labels")), how="inner", on=F.lit(True)).na.fill(0, ["events", "hits"])
    return by.select("method", "events", "hits", _rate("hits", "events").alias("precision"), _rate("hits", "labels").alias("recall"), "mean_lead")


def corroboration(events: DataFrame, breadth: DataFrame, labels: DataFrame, least: float = 0.5, tolerance: int = 3) -> DataFrame:
    """Hit rates of events on days of wide and of narrow breadth; events of a topic and day without a score are left out."""
    b = breadth.select("monitor_id", "topic_id", F.col("bucket").alias("detected_on"), F.when(F.col("breadth") >= least, "wide").otherwise("narrow").alias("side"))
    scored = events.join(b, ["monitor_id", "topic_id", "detected_on"])
    sides = events.sparkSession.createDataFrame([("wide",), ("narrow",)], "side string")
    wanted = labels.select("monitor_id", "occurred_on").join(F.broadcast(sides), how="inner", on=F.lit(True))
    hits = views.match_events(scored.select("side", "monitor_id", "detected_on", "event_id"), wanted, tolerance, ("side", "monitor_id")).groupBy("side").agg(F.count("*").alias("hits"))
    by = sides.join(scored.groupBy("side").agg(F.count("*").alias("events")), "side", "left").join(hits, "side", "left").na.fill(0, ["events", "hits"])
    return by.select("side", "events", "hits", _rate("hits", "events").alias("hit_rate"))


def normalisation(points: DataFrame, z: float = 3.5, least_days: int = 14, labels: DataFrame | None = None, tolerance: int = 3) -> DataFrame:
    """(topic_id, bucket, value, total): how the raw count and its share of the day fare under a daily replay.

    Each day is held against all clean days before it, ``least_days`` or more, by a window over the topic's days so
    far. A third arm has no data and says so. With ``labels`` (topic_id, occurred_on) the share of alarms that match none.
    """
    long = points.select("topic_id", "bucket", F.explode(F.create_map(F.lit("raw_count"), F.col("value"), F.lit("prevalence"), F.col("value") / F.col("total"))).alias("arm", "x"))
    before = Window.partitionBy("topic_id", "arm").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("past", F.array_sort(F.collect_list("x").over(before))).where(F.size("past") >= least_days)
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    seen = seen.withColumn("m", middle(F.col("past")))
    seen = seen.withColumn("away", F.array_sort(F.transform("past", lambda y: F.abs(y - F.col("m"))))).withColumn("mad", middle(F.col("away")) * 1.4826)
    seen = seen.select("topic_id", "arm", "bucket", ((F.col("mad") > 0) & (F.abs(F.col("x") - F.col("m")) / F.col("mad") >= z)).alias("fires"))
    fired = seen.groupBy("topic_id", "arm").agg(F.count("*").alias("tested"), F.count_if("fires").alias("fired"))
    spread = long.groupBy("topic_id", "arm").agg((F.stddev_pop("x") / F.nullif(F.avg("x"), F.lit(0.0))).alias("variation"))
    met = spread.join(fired, ["topic_id", "arm"], "left").select("topic_id", "arm", "variation", F.coalesce("tested", F.lit(0)).alias("tested"), F.coalesce("fired", F.lit(0)).alias("fired"), F.lit("measured").alias("status"))
    none = points.select("topic_id").distinct().select("topic_id", F.lit("per_author").alias("arm"), F.lit(None).cast("double").alias("variation"), F.lit(0).cast("long").alias("tested"), F.lit(0).cast("long").alias("fired"), F.lit("unavailable").alias("status"))
    met = met.unionByName(none)
    if labels is None:
        return met
    alarms = seen.where("fires").select("topic_id", "arm", F.col("bucket").alias("detected_on"), F.concat_ws("|", "topic_id", "arm", "bucket").alias("event_id"))
    wanted = labels.join(met.select("topic_id", "arm").distinct(), "topic_id").select("topic_id", "arm", "occurred_on")
    hits = views.match_events(alarms, wanted, tolerance, ("topic_id", "arm")).groupBy("topic_id", "arm").agg(F.count("*").alias("hits"))
    rate = F.when((F.col("status") == "measured") & (F.col("fired") > 0), 1 - F.coalesce("hits", F.lit(0)) / F.col("fired"))
    return met.join(hits, ["topic_id", "arm"], "left").select(*met.columns, rate.alias("false_positive_rate"))


def groundedness(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """Mean cosine of each field's vector to its context's evidence, without pairs: with the mean of unit vectors. Blank is 0."""
    unit = lambda c: F.transform(c, lambda x: x / F.nullif(F.sqrt(dot(F.col(c), F.col(c))), F.lit(0.0)))
    by = evidence.select("context", F.posexplode(unit("embedding")).alias("i", "u")).groupBy("context", "i").agg(F.avg("u").alias("u"))
    mean = by.groupBy("context").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda s: s["u"]).alias("mean"))
    met = fields.join(mean, "context", "left").withColumn("own", unit("embedding"))
    return met.select("context", "field", "vec_id", F.when(F.col("blank"), 0.0).otherwise(F.coalesce(dot(F.col("own"), F.col("mean")), F.lit(0.0))).alias("groundedness"))


def report(parts: dict[str, DataFrame | Callable[[], DataFrame]], computed_over: str = "") -> DataFrame:
    """One long table of (value, sample_size) measures, each with what it was computed over.

    A measure without a row, or with a null, reads as not available; one that can't be planned or computed reads as
    failed, and the others stay.
    """
    rows = []
    for name, part in parts.items():
        try:
            df = part() if callable(part) else part
            row = df.agg(F.first("value").cast("double").alias("value"), F.first("sample_size").cast("long").alias("sample_size")).first()
            rows.append((name, row["value"], row["sample_size"] or 0, "not_available" if row["value"] is None else "ok"))
        except PySparkException:
            rows.append((name, None, 0, "failed"))
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "measure string, value double, sample_size long, status string").withColumn("computed_over", F.lit(computed_over))
