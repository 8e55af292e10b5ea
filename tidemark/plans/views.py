"""Read views, scores, insights, evaluation and upkeep over the daily metrics and events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the topic score and of the opportunity score.
SCORE_WEIGHTS = {"burst": 0.3, "growth": 0.2, "novelty": 0.15, "breadth": 0.2, "sentiment": 0.15}
FAMILIES = {"burst": ["burst"], "growth": ["sustained_growth", "decline"], "novelty": ["novelty", "emergence"], "sentiment": ["sentiment_flip"]}
OPPORTUNITY = {"share": 0.2, "negativity": 0.25, "score": 0.2, "breadth": 0.15, "intent": 0.15, "recency": 0.05}


def timeseries(metrics: DataFrame, metric: str, topic: str | None, source: str | None, start: str, end: str) -> DataFrame:
    rows = metrics.where(F.col("topic_id").eqNullSafe(F.lit(topic)) & F.col("source_name").eqNullSafe(F.lit(source)) & F.col("bucket").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    grain = (2 if source is None else 0) + (1 if topic is None else 0)
    quality = F.when(F.col("quota_hit"), "truncated").when(F.col("doc_count") == 0, "partial").otherwise("clean")
    return rows.where(F.col("grouping_id") == grain).select("monitor_id", "bucket", F.col(metric).cast("double").alias("value"), quality.alias("quality"))


def overview(metrics: DataFrame) -> DataFrame:
    rows = metrics.where("grouping_id = 3")
    return rows.groupBy("monitor_id").agg(F.sum("doc_count").alias("documents"), F.round(F.avg("sentiment_mean"), 6).alias("sentiment"))


def ranking(metrics: DataFrame, scores: DataFrame, start: str, end: str) -> DataFrame:
    """Figures of each topic over the days from start to end, its newest surviving score and that day's breadth; most documents first."""
    rows = metrics.where("grouping_id = 2 and topic_id is not null").where(F.col("bucket").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    by = rows.groupBy("monitor_id", "topic_id").agg(F.sum("doc_count").alias("documents"), F.round(F.avg("doc_count_share"), 6).alias("share"), F.round(F.avg("sentiment_mean"), 6).alias("sentiment"))
    return by.join(latest_score(scores, start, end), ["monitor_id", "topic_id"], "left").orderBy(F.desc("documents"), "monitor_id", "topic_id")


def topic_history(metrics: DataFrame, survivors: DataFrame, topic: str) -> DataFrame:
    """A topic's daily rows, those kept under ids that it has absorbed included. ``survivors``: topic_id, survivor."""
    own = survivors.where(F.col("survivor") == topic).select("topic_id")
    return metrics.where("grouping_id = 2").join(F.broadcast(own), "topic_id", "left_semi").select("bucket", "monitor_id", "topic_id", "doc_count").orderBy("bucket", "monitor_id", "topic_id")


def share_of_voice(docs: DataFrame, key: str, value: Column) -> DataFrame:
    by = docs.groupBy(key).agg(F.count("*").alias("documents"), F.avg(value).alias("mean_value"))
    return by.select(key, "documents", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 6).alias("share"), F.round("mean_value", 6).alias("mean_value"))


def data_quality(ledger: DataFrame) -> DataFrame:
    """Rows sampled, truncated days, and how many sources had a failed validation or an error on any day."""
    by = ledger.groupBy("monitor_id").agg(F.sum("kept").alias("sample"), F.array_sort(F.collect_set(F.when(F.col("quota_hit"), F.date_format("bucket", "yyyy-MM-dd")))).alias("truncated_days"))
    failed = F.coalesce("validation_failed", F.lit(False)) | F.col("error").isNotNull()
    bad = ledger.groupBy("monitor_id", "source_name").agg(F.max(failed).alias("failed")).groupBy("monitor_id").agg(F.count_if("failed").alias("sources_failed"), F.count_if(~F.col("failed")).alias("sources_ok"))
    return by.join(bad, "monitor_id")


def page(docs: DataFrame, after: tuple[str, int] | None, limit: int, topic: str | None = None, source: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keyset paging, newest first: the row after the cursor on, limit + 1 rows to see whether more follow.

    Optional filters: topic, source, and UTC days from ``start`` to ``end``, both whole.
    """
    for c, value in (("topic_id", topic), ("source_name", source)):
        if value is not None:
            docs = docs.where(F.col(c) == value)
    if start:
        docs = docs.where(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end:
        docs = docs.where(F.col("published_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    if after:
        at = F.lit(after[0]).cast("timestamp")
        docs = docs.where((F.col("published_at") < at) | ((F.col("published_at") == at) & (F.col("document_id") < after[1])))
    return docs.orderBy(F.desc("published_at"), F.desc("document_id")).limit(limit + 1)


def in_range(rows: DataFrame, day: str, start: str, end: str, kind: str | None = None) -> DataFrame:
    """Events of the days from start to end, newest first, of one kind or of all."""
    rows = rows.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy(F.desc(day), F.desc("event_id"))


def insights_in_range(insights: DataFrame, start: str, end: str, kind: str | None = None) -> DataFrame:
    """Insights whose whole period lies within the days from start to end, newest first, of one kind or of all."""
    rows = insights.where((F.col("period_start") >= F.lit(start).cast("date")) & (F.col("period_end") <= F.lit(end).cast("date")))
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy(F.desc("period_end"), "insight_id")


def breadth_ratio(metrics: DataFrame) -> DataFrame:
    """Sources with the topic over sources active that day."""
    topic = metrics.where("grouping_id = 0").groupBy("monitor_id", "bucket", "topic_id").agg(F.count_distinct("source_name").alias("own"))
    day = metrics.where("grouping_id = 1").groupBy("monitor_id", "bucket").agg(F.count_distinct("source_name").alias("active"))
    return topic.join(day, ["monitor_id", "bucket"]).select("monitor_id", "bucket", "topic_id", F.round(F.col("own") / F.col("active"), 6).alias("breadth"))


def day_trust(runs: DataFrame) -> DataFrame:
    return runs.groupBy("monitor_id", "bucket").agg((~F.max(F.col("status") == "partial")).alias("trusted"))


def score_components(metrics: DataFrame, events: DataFrame) -> DataFrame:
    """monitor_id, bucket, topic_id, author_diversity, burst, growth, novelty, sentiment, breadth, volume of each topic's day.

    The largest severity among the day's events of each family (0 without one), breadth, and the documents.
    """
    key = ["monitor_id", "bucket", "topic_id"]
    strongest = lambda kinds: F.coalesce(F.max(F.when(F.col("kind").isin(kinds), F.col("severity"))), F.lit(0.0))
    by = events.withColumn("bucket", F.col("detected_on")).groupBy(*key).agg(*[strongest(kinds).alias(f) for f, kinds in FAMILIES.items()])
    rows = metrics.where("grouping_id = 2").select(*key, "author_diversity", F.col("doc_count").cast("double").alias("volume"))
    met = rows.join(by, key, "left").join(breadth_ratio(metrics), key, "left")
    return met.select(*key, "author_diversity", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in (*FAMILIES, "breadth")], "volume")


def trend_scores(components: DataFrame, trust: DataFrame, least_diversity: float = 0.5, penalty: float = 0.5) -> DataFrame:
    """Families over the day's largest (breadth as it is), weighted; less a penalty for few authors; withheld on untrusted days."""
    day = Window.partitionBy("monitor_id", "bucket")
    normal = {c: F.col(c) if c == "breadth" else F.coalesce(F.col(c) / F.nullif(F.max(c).over(day), F.lit(0.0)), F.lit(0.0)) for c in SCORE_WEIGHTS}
    met = components.select("monitor_id", "bucket", "topic_id", "author_diversity", "volume", *[x.alias(c) for c, x in normal.items()]).join(trust, ["monitor_id", "bucket"], "left")
    met = met.withColumn("few", F.coalesce(F.col("author_diversity") < least_diversity, F.lit(False)))
    raw = sum((F.lit(w) * F.col(c) for c, w in SCORE_WEIGHTS.items()), F.lit(0.0)) * F.when(F.col("few"), 1 - penalty).otherwise(1.0)
    good = F.coalesce("trusted", F.lit(True))
    shown = [F.round(F.when(good, F.col(c)), 6).alias(c) for c in (*SCORE_WEIGHTS, "volume")]
    return met.select(
        "monitor_id", "bucket", "topic_id", F.round(F.when(good, raw), 6).alias("value"), *shown,
        F.when(good & F.col("few"), F.lit(penalty)).alias("concentration_penalty"), F.when(~good, "day_untrustworthy").alias("withheld_reason"),
    )


def scores_of_all(scores: DataFrame, topics: DataFrame, trust: DataFrame) -> DataFrame:
    """scores with a row for each topic (monitor_id, bucket, topic_id) that has no metric that day: withheld, for the day's fault or for that."""
    key = ["monitor_id", "bucket", "topic_id"]
    lacking = topics.select(*key).distinct().join(scores, key, "left_anti").join(trust, ["monitor_id", "bucket"], "left")
    reason = F.when(F.coalesce("trusted", F.lit(True)), "no_metric_for_day").otherwise("day_untrustworthy")
    none = [F.lit(None).cast(scores.schema[c].dataType).alias(c) for c in scores.columns if c not in (*key, "withheld_reason")]
    return scores.unionByName(lacking.select(*key, *none, reason.alias("withheld_reason")))


def latest_score(scores: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """monitor_id, topic_id, score, breadth of each topic's newest score in the period that was not withheld."""
    rows = scores.where("withheld_reason is null")
    if start:
        rows = rows.where(F.col("bucket") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("bucket") <= F.lit(end).cast("date"))
    by = rows.groupBy("monitor_id", "topic_id").agg(F.max_by(F.struct("value", "breadth"), "bucket").alias("x"))
    return by.select("monitor_id", "topic_id", F.col("x.value").alias("score"), F.col("x.breadth").alias("breadth"))


def event_evidence(events: DataFrame, docs: DataFrame, limit: int = 5) -> DataFrame:
    """The newest relevant documents in an event's window, of new vocabulary those of the strongest sentiment first.

    The best of each topic's day are found first, in one pass over the documents; windows, once each, choose among their
    days' best, and events take what their window chose. So no event meets a document that another of its day outdoes.
    """
    topic, window = ["monitor_id", "topic_id"], ["monitor_id", "topic_id", "detected_on", "span", "loud"]
    span = F.when(F.col("method").isin("mann_kendall", "pelt"), 7).otherwise(1)
    asked = events.select("event_id", *topic, "detected_on", span.alias("span"), F.coalesce(F.col("method") == "ctfidf", F.lit(False)).alias("loud"))

    def best(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("strength"), F.desc("published_at"), "document_id")
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)

    orders = F.broadcast(asked.select("loud").distinct())  # two rows at most
    strength = F.when(F.col("loud"), F.abs(F.coalesce("sentiment_score", F.lit(0.0)))).otherwise(F.lit(0.0))
    rows = docs.where("is_relevant and topic_id is not null").join(orders, how="inner", on=F.lit(True))
    daily = best(rows.select(*topic, F.to_date("published_at").alias("day"), "loud", strength.alias("strength"), "published_at", "document_id"), [*topic, "day", "loud"]).drop("place")
    days = asked.select(*window).distinct().withColumn("day", F.explode(F.sequence(F.date_sub("detected_on", F.col("span") - 1), F.col("detected_on"))))
    told = best(days.join(daily, [*topic, "day", "loud"]), window).select(*window, "strength", "published_at", "document_id")
    met = best(asked.join(told, window), ["event_id"])
    return met.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "document_id"))), lambda s: s["document_id"]).alias("evidence_ids"))


def without_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Events that no document supports: the job must not write these."""
    return events.join(evidence, "event_id", "left_anti")


def alert_matches(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events by enabled rules of their kind, or of any. Two equal joins rather than one condition with "or"."""
    on = rules.where("enabled")
    own = events.join(on.where("rule_kind is not null"), F.col("kind") == F.col("rule_kind"))
    # a rule of any kind meets each kind that occurs: few rows, so that events are never crossed with rules
    any_kind = on.where("rule_kind is null").select("rule_id")
    each = events.select("kind").distinct().join(any_kind, how="inner", on=F.lit(True)).withColumnRenamed("kind", "rule_kind")
    every = events.join(each, F.col("kind") == F.col("rule_kind"))
    return own.select("rule_id", "event_id").unionByName(every.select("rule_id", "event_id")).select("rule_id", "event_id", F.lit("pending").alias("state")).dropDuplicates(["rule_id", "event_id"])


def delivery_states(attempts: DataFrame, most: int = 3) -> DataFrame:
    n = F.col("attempts") + 1
    state = F.when((F.col("channel") != "webhook") | F.col("channel").isNull(), "abandoned").when(F.col("ok"), "delivered").when(n >= most, "abandoned").otherwise("failed")
    return attempts.select("delivery_id", n.alias("attempts"), state.alias("state"))


def topic_statistics(metrics: DataFrame, docs: DataFrame) -> DataFrame:
    """Figures of a whole period for each topic, intents as shares of its documents."""
    rows = metrics.where("grouping_id = 2 and topic_id is not null").groupBy("monitor_id", "topic_id").agg(
        F.sum("doc_count").alias("documents"), F.avg("doc_count_share").alias("share"), F.avg("sentiment_mean").alias("sentiment"), F.avg("negativity_rate").alias("negativity")
    )
    wanted = docs.where("intent in ('feature_request', 'bug_report')").groupBy("monitor_id", "topic_id").agg(F.count("*").alias("asks"))
    met = rows.join(wanted, ["monitor_id", "topic_id"], "left")
    return met.select("monitor_id", "topic_id", "documents", F.round("share", 6).alias("share"), F.round("sentiment", 6).alias("sentiment"), F.round("negativity", 6).alias("negativity"), F.round(F.coalesce("asks", F.lit(0)) / F.col("documents"), 6).alias("ask_share"))


def intent_mix(docs: DataFrame, metrics: DataFrame) -> DataFrame:
    """monitor_id, topic_id, intent_mix: each intent's share of the topic's documents in the period, as a map."""
    total = metrics.where("grouping_id = 2 and topic_id is not null").groupBy("monitor_id", "topic_id").agg(F.sum("doc_count").alias("documents"))
    by = docs.where("topic_id is not null and intent is not null").groupBy("monitor_id", "topic_id", "intent").agg(F.count("*").alias("n")).join(total, ["monitor_id", "topic_id"])
    entry = F.struct("intent", F.round(F.col("n") / F.col("documents"), 6).alias("share"))
    return by.groupBy("monitor_id", "topic_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("intent_mix"))


def period_statistics(metrics: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """All that an insight is told of a topic's period: figures, the mix of intents, breadth over the period and the latest score that was not withheld."""
    key = ["monitor_id", "topic_id"]
    stats = topic_statistics(metrics, docs)
    mix, score = intent_mix(docs, metrics), latest_score(scores).select(*key, "score")
    met = stats.join(mix, key, "left").join(period_breadth(metrics), key, "left").join(score, key, "left")
    return met.select(*stats.columns, "intent_mix", F.round("breadth", 6).alias("breadth"), "score")


def period_breadth(metrics: DataFrame) -> DataFrame:
    """Distinct sources of each topic over the distinct sources of its monitor, in the whole period."""
    own = metrics.where("grouping_id = 0").groupBy("monitor_id", "topic_id").agg(F.count_distinct("source_name").alias("own"))
    every = metrics.where("grouping_id = 1").groupBy("monitor_id").agg(F.count_distinct("source_name").alias("active"))
    return own.join(every, "monitor_id").select("monitor_id", "topic_id", (F.col("own") / F.col("active")).alias("breadth"))


def days_since(metrics: DataFrame, today: Column) -> DataFrame:
    """Days since each topic was last mentioned."""
    last = metrics.where("grouping_id = 2 and doc_count > 0").groupBy("monitor_id", "topic_id").agg(F.max("bucket").alias("last"))
    return last.select("monitor_id", "topic_id", F.datediff(today, "last").cast("double").alias("days_since"))


def opportunity_score(stats: DataFrame) -> DataFrame:
    w = OPPORTUNITY
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = w["share"] * F.least(F.lit(1.0), z("share")) + w["negativity"] * z("negativity") * F.abs(z("sentiment")) + w["score"] * z("score") + w["breadth"] * z("breadth") + w["intent"] * z("ask_share") + w["recency"] / (1 + z("days_since"))
    return stats.select("monitor_id", "topic_id", F.round(score, 6).alias("opportunity"))


def insight_gates(topics: DataFrame) -> DataFrame:
    """The first gate that stops a topic: day, evidence, change."""
    reason = F.when(~F.col("trusted"), "day_untrustworthy").when(F.col("evidence") < 3, "evidence_too_thin").when(~F.col("changed"), "no_change")
    return topics.select("topic_id", reason.isNull().alias("passed"), reason.alias("reason"))


def grounding_check(completions: DataFrame) -> DataFrame:
    """Rejected whole when nothing, or anything outside its context, is cited."""
    return completions.select("topic_id", ((F.size("cited") > 0) & (F.size(F.array_except("cited", "supplied")) == 0)).alias("accepted"))


def digest_evidence(accepted: DataFrame, key: str) -> DataFrame:
    return accepted.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cited")))).alias("evidence_ids"))


def relevance_measures(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    met = labels.join(predictions, "document_id", "left").select("relevant", F.coalesce("predicted", F.lit(False)).alias("predicted"))
    hit, said, true = F.count_if(F.col("relevant") & F.col("predicted")), F.count_if("predicted"), F.count_if("relevant")
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return met.agg(ratio(hit, said).alias("precision"), ratio(hit, true).alias("recall"), F.count("*").alias("sample_size"))


def match_events(events: DataFrame, labels: DataFrame, tolerance: int = 3, keys: tuple[str, ...] = ("monitor_id",)) -> DataFrame:
    """Labels in order of date take their closest unused event within the tolerance.

    Labels more than twice the tolerance apart can't want the same event, so a group is one run of labels that
    lie closer: its length is bounded by the days that labels cover without a gap, not by a monitor's history.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("occurred_on")
    gap = F.datediff("occurred_on", F.lag("occurred_on").over(order))
    runs = labels.select(*keys, "occurred_on").distinct().withColumn("starts", F.coalesce((gap > 2 * tolerance).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("starts").over(order)).drop("starts")
    days = runs.withColumn("day", F.explode(F.sequence(F.date_sub("occurred_on", tolerance), F.date_add("occurred_on", tolerance))))
    near = days.join(events.withColumn("day", F.col("detected_on")), [*keys, "day"]).select(*keys, "run", "occurred_on", "detected_on", "event_id")
    fields = {f.name: f.dataType.simpleString() for f in near.schema.fields}

    def greedy(key, pdf):
        used, out = set(), []
        for on, group in pdf.sort_values(["occurred_on", "detected_on", "event_id"]).groupby("occurred_on", sort=True):
            free = [(abs((r.occurred_on - r.detected_on).days), r.detected_on, r.event_id) for r in group.itertuples() if r.event_id not in used]
            if free:
                _, day, event = min(free)
                used.add(event)
                out.append((*key[:-1], on, event, (on - day).days))
        return pd.DataFrame(out, columns=[*keys, "occurred_on", "event_id", "lead_days"])

    schema = "".join(f"{k} {fields[k]}, " for k in keys) + f"occurred_on date, event_id {fields['event_id']}, lead_days int"
    return near.groupBy(*keys, "run").applyInPandas(greedy, schema)


def label_contamination(labels: DataFrame) -> DataFrame:
    who = F.lower(F.trim(F.coalesce("labelled_by", F.lit(""))))
    return labels.select("label_id", ((who == "") | who.rlike("pipeline|system|auto|model")).alias("rejected"))


# What in a reference points into the system's own output.
OWN_OUTPUT = ("trend_events/", "insights/", "generation_skips/", "/monitors/")


def event_contamination(labels: DataFrame) -> DataFrame:
    """Event labels without a reference from outside: a blank one, or one into the system's own output."""
    at = F.lower(F.coalesce("external_reference", F.lit("")))
    own = F.when(F.trim(at) == "", "blank_reference")
    for mark in OWN_OUTPUT:
        own = own.when(at.contains(mark), "own_output")
    return labels.select("label_id", own.isNotNull().alias("rejected"), own.alias("reason"))


def run_status(outcomes: DataFrame, expected_volume: bool = True) -> DataFrame:
    by = outcomes.groupBy("monitor_id", "bucket").agg(F.sum("kept").alias("kept"), F.max(F.col("kept") == 0).alias("any_failed"), F.max(F.col("kept") > 0).alias("any_collected"))
    status = F.when((F.col("kept") == 0) & F.lit(expected_volume), "failed").when(F.col("any_failed") & F.col("any_collected"), "partial").when(F.col("any_failed"), "failed").otherwise("complete")
    return by.select("monitor_id", "bucket", status.alias("status"))


def health_history(ledger: DataFrame, last: int = 28) -> DataFrame:
    """Latest days of each source: their median, and how many of the newest in a row were empty."""
    order = Window.partitionBy("monitor_id", "source_name").orderBy(F.desc("bucket"))
    near = ledger.withColumn("place", F.row_number().over(order)).where(F.col("place") <= last)
    by = near.groupBy("monitor_id", "source_name").agg(F.expr("median(kept)").alias("m"), F.count("*").alias("history"), F.min(F.when(F.col("kept") > 0, F.col("place"))).alias("first_kept"), F.max(F.when(F.col("place") == 1, F.col("kept"))).alias("latest"))
    return by.select("monitor_id", "source_name", F.when(F.col("history") >= 5, F.col("m")).alias("rows_median_28d"), "history", (F.coalesce("first_kept", F.col("history") + 1) - 1).cast("long").alias("consecutive_empty"), "latest")


def source_health(history: DataFrame) -> DataFrame:
    state = F.when(F.col("history") < 5, "healthy").when((F.col("latest") == 0) & (F.col("consecutive_empty") >= 2), "broken").when(F.col("latest") < 0.5 * F.col("rows_median_28d"), "degraded").otherwise("healthy")
    return history.select("monitor_id", "source_name", state.alias("state"), F.col("latest").alias("observed"), F.col("rows_median_28d").alias("expected"))


def scraper_alerts(health: DataFrame) -> DataFrame:
    """An alert row, with what was seen and what was expected, for each source that is broken or degraded."""
    return health.where("state in ('broken', 'degraded')").select("monitor_id", "source_name", F.col("state").alias("kind"), "observed", "expected")


def retained(docs: DataFrame, monitors: DataFrame, today: Column) -> DataFrame:
    """docs without those past their monitor's retention: what a rewrite of the table keeps. Monitors without a rule keep all."""
    met = docs.join(F.broadcast(monitors.select("monitor_id", "retention_days")), "monitor_id", "left")
    return met.where(F.col("retention_days").isNull() | (F.to_date("published_at") >= F.date_sub(today, F.col("retention_days")))).select(docs.columns)


def retention_preview(docs: DataFrame, monitors: DataFrame, today: Column) -> DataFrame:
    old = docs.join(monitors, "monitor_id").where(F.to_date("published_at") < F.date_sub(today, F.col("retention_days")))
    return old.groupBy("monitor_id").agg(F.count("*").alias("to_delete"))


def backfill_plan(jobs: DataFrame, sources: DataFrame, today: Column) -> DataFrame:
    """(job_id, day, source) of the jobs whose window is in order, past, and free of active ones."""
    a, b = jobs.where("state = 'submitted'").alias("a"), jobs.where("state in ('pending', 'running')").alias("b")
    clash = (F.col("a.monitor_id") == F.col("b.monitor_id")) & (F.col("a.first_day") <= F.col("b.last_day")) & (F.col("b.first_day") <= F.col("a.last_day"))
    free = a.join(b, clash, "left_anti").where((F.col("first_day") <= F.col("last_day")) & (F.col("last_day") <= today))
    return free.withColumn("day", F.explode(F.sequence("first_day", "last_day"))).join(sources, "monitor_id").select("job_id", "day", "source_name")
