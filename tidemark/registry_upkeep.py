"""Queries of landed payloads, enrichment stages, topic upkeep, views and reports that need more than one expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixtures import FEEDBACK_SQL, INTENTS, feedback, ledger, table
from tidemark.functions import text as tx
from tidemark.operators import discovery, rollup, topics
from tidemark.operators.discovery import cut
from tidemark.plans import cycle, views
from tidemark.registry import _COH, _HEALTH, _LANG, _NEAR, _ROLLUP, _VEC, _WS, _docs, _metrics, _near_topics, _topics, oracle_sql, query
from tidemark.sources import ingest

# ---- payloads -------------------------------------------------------------------------------------------------
# Each type of event is a kind of source; a day's events of it are one landed payload.

_AT = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_USER = "concat('u', user_id)"
_NOTE = "concat('note ', k)"
_PLAY = f"to_json(collect_list(named_struct('reviewId', cast(event_id as string), 'userName', if(k % 6 = 0, null, {_USER}), 'content', {_NOTE}, 'score', if(k % 3 = 0, null, 1 + k % 5), 'at', {_AT}, 'appVersion', concat('1.', k % 4))))"
_APP = f"to_json(named_struct('feed', named_struct('entry', collect_list(named_struct('id', named_struct('label', cast(event_id as string)), 'author', named_struct('name', named_struct('label', {_USER})), 'content', named_struct('label', {_NOTE}), 'im:rating', if(k % 3 = 0, null, named_struct('label', cast(1 + k % 5 as string))), 'updated', named_struct('label', {_AT}), 'im:version', named_struct('label', concat('2.', k % 4)))))))"
_DISC = f"to_json(named_struct('posts', collect_list(named_struct('id', event_id, 'username', {_USER}, 'blurb', if(k % 4 = 0, '', {_NOTE}), 'cooked', concat('<p>', k, '</p>'), 'created_at', {_AT}, 'like_count', k))))"
_HN = f"to_json(named_struct('hits', collect_list(named_struct('objectID', cast(event_id as string), 'title', {_NOTE}, 'author', {_USER}, 'created_at', {_AT}, 'points', k, 'url', concat('https://www.host', k % 5, '.org/', event_id)))))"
_RSS_AT = "concat(date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss'), ' +0000')"
_RSS = f"concat('<rss><channel>', array_join(collect_list(concat('<item>', if(k % 7 = 0, '', concat('<guid>g', event_id, '</guid>')), '<link>https://WWW.feed', k % 5, '.org/', event_id, '</link><title>note ', k, '</title><description>about ', k, '</description>', if(k % 10 = 0, '', concat('<pubDate>', {_RSS_AT}, '</pubDate>')), '</item>')), ''), '</channel></rss>')"
_ATOM = f"concat('<feed xmlns=\"http://www.w3.org/2005/Atom\">', array_join(collect_list(concat('<entry>', if(k % 7 = 0, '', concat('<id>g', event_id, '</id>')), '<link href=\"https://WWW.feed', k % 5, '.org/', event_id, '\"/><title>note ', k, '</title><summary>about ', k, '</summary>', if(k % 10 = 0, '', concat('<updated>', {_AT}, '</updated>')), '</entry>')), ''), '</feed>')"


def _landed(spark, d, kind: str, payload: str, which: str = "true") -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).where(F.col("event_type") == kind)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts")).where(which).groupBy("day").agg(F.expr(payload).alias("payload")).select("payload")


_E = "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, date_trunc('second', ts) AS t FROM events)"


def _item_sql(kind: str, source: str, author: str, body: str = "NULL", title: str = "NULL", at: str = "t", url: str = "NULL", rating: str = "NULL", version: str = "NULL", engagement: str = "NULL", key: str = "CAST(event_id AS VARCHAR)") -> str:
    return (
        f"SELECT '{source}' AS source_name, {key} AS external_id, {author} AS author, CAST({title} AS VARCHAR) AS title, CAST({body} AS VARCHAR) AS body, CAST({at} AS TIMESTAMP) AS published_at, CAST({url} AS VARCHAR) AS url, "
        f"CAST({rating} AS INTEGER) AS rating, CAST({version} AS VARCHAR) AS app_version, CAST({engagement} AS INTEGER) AS engagement FROM e WHERE event_type = '{kind}'"
    )


_RATING = "CASE WHEN k % 3 = 0 THEN 0 ELSE 1 + k % 5 END"
_ITEM_SQL = {
    "play": _item_sql("click", "play", "CASE WHEN k % 6 = 0 THEN '' ELSE 'u' || user_id END", body="'note ' || k", rating=_RATING, version="'1.' || (k % 4)"),
    "appstore": _item_sql("view", "appstore", "'u' || user_id", body="'note ' || k", rating=_RATING, version="'2.' || (k % 4)"),
    "discourse": _item_sql("purchase", "discourse", "'u' || user_id", body="CASE WHEN k % 4 = 0 THEN '<p>' || k || '</p>' ELSE 'note ' || k END", engagement="k"),
    "hackernews": _item_sql("signup", "hackernews", "'u' || user_id", title="'note ' || k", url="'https://www.host' || (k % 5) || '.org/' || event_id", engagement="k"),
    "rss": _item_sql("error", "rss", "'feed' || (k % 5) || '.org'", title="'note ' || k", body="'about ' || k", at="CASE WHEN k % 10 <> 0 THEN t END", url="'https://WWW.feed' || (k % 5) || '.org/' || event_id", key="CASE WHEN k % 7 = 0 THEN 'https://WWW.feed' || (k % 5) || '.org/' || event_id ELSE 'g' || event_id END"),
}


def _parsed(spark, d, kind: str) -> DataFrame:
    if kind == "rss":
        both = _landed(spark, d, "error", _RSS, "day(day) % 2 = 1").unionByName(_landed(spark, d, "error", _ATOM, "day(day) % 2 = 0"))
        return ingest.parse_feed(both)
    name, payload = {"play": ("click", _PLAY), "appstore": ("view", _APP), "discourse": ("purchase", _DISC), "hackernews": ("signup", _HN)}[kind]
    return ingest.parse_payloads(_landed(spark, d, name, payload), kind)


@query(_E + " " + _ITEM_SQL["play"])
def play_items(spark, d):
    return ingest.unify_items([_parsed(spark, d, "play")])


@query(_E + " " + _ITEM_SQL["appstore"])
def appstore_items(spark, d):
    return ingest.unify_items([_parsed(spark, d, "appstore")])


@query(_E + " " + _ITEM_SQL["discourse"])
def discourse_items(spark, d):
    return ingest.unify_items([_parsed(spark, d, "discourse")])


@query(_E + " " + _ITEM_SQL["hackernews"])
def hackernews_items(spark, d):
    return ingest.unify_items([_parsed(spark, d, "hackernews")])


@query(_E + " " + _ITEM_SQL["rss"])
def feed_items(spark, d):
    return ingest.unify_items([_parsed(spark, d, "rss")])


@query(_E + " " + " UNION ALL ".join(_ITEM_SQL.values()))
def unify_items(spark, d):
    return ingest.unify_items([_parsed(spark, d, kind) for kind in _ITEM_SQL])


@query(_E + ", i AS (" + " UNION ALL ".join(_ITEM_SQL.values()) + ") SELECT source_name, external_id, coalesce(nullif(body, ''), nullif(title, '')) AS body, published_at, url, rating, app_version, engagement, sha256(author) AS author_hash, sha256(coalesce(coalesce(nullif(body, ''), nullif(title, '')), '') || chr(31) || coalesce(CAST(rating AS VARCHAR), '')) AS content_hash FROM i")
def document_rows(spark, d):
    return ingest.document_rows(ingest.unify_items([_parsed(spark, d, kind) for kind in _ITEM_SQL]))


_PAGES = (
    r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a)"""
    + f", c AS (SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN url END AS url, CASE WHEN page_id % 11 <> 0 THEN nullif(trim(regexp_replace(t, '{_WS}', ' ', 'g')), '') END AS body FROM b)"
)


def _news(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "pages")
    item = "concat('<item><guid>n', page_id, '</guid><link>https://news.example/r/', page_id, '</link><title>page ', page_id, '</title></item>')"
    feed = p.groupBy((F.col("page_id") % 50).alias("feed")).agg(F.expr(f"concat('<rss><channel>', array_join(collect_list({item}), ''), '</channel></rss>')").alias("payload"))
    landed = p.select(F.concat(F.lit("https://news.example/r/"), "page_id").alias("link"), F.when(F.col("page_id") % 9 != 0, F.col("url")).alias("resolved_url"), F.when(F.col("page_id") % 11 != 0, tx.page_text(F.col("html"))).alias("page_text"))
    return ingest.news_articles(ingest.parse_feed(feed), landed)


@query(_PAGES + " SELECT 'n' || page_id AS external_id, 'page ' || page_id AS title, body, url FROM c WHERE coalesce(url, '') <> '' AND body IS NOT NULL")
def news_items(spark, d):
    return _news(spark, d)[0].select("external_id", "title", "body", "url")


@query(_PAGES + " SELECT 'news' AS source_name, count(*) FILTER (WHERE coalesce(url, '') <> '' AND body IS NOT NULL) AS articles, count(*) FILTER (WHERE coalesce(url, '') = '' OR body IS NULL) AS filtered FROM c")
def news_filtered(spark, d):
    return _news(spark, d)[1]


@query("WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, bool_or(event_id % 97 = 0) AS lacks FROM events GROUP BY 1, 2) SELECT event_type || ' ' || CAST(day AS VARCHAR) AS payload_id, CASE WHEN day(day) % 13 = 0 THEN 'content_type' WHEN day(day) % 11 = 0 THEN 'malformed' WHEN day(day) % 7 = 0 THEN 'path_missing' WHEN lacks THEN 'field_missing' WHEN n < 60 THEN 'below_floor' END AS failed_check FROM e")
def payload_validation(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date(F.col("ts").cast("timestamp")))
    item = F.struct(F.when(F.col("event_id") % 97 != 0, F.col("event_id")).alias("id"), F.col("user_id").alias("user"))
    by = e.groupBy("event_type", "day").agg(F.collect_list(item).alias("items"))
    n = F.dayofmonth("day")
    whole = F.to_json(F.struct("items"))
    body = F.when(n % 11 == 0, F.substring(whole, 1, 9)).when(n % 7 == 0, F.lit("{}")).otherwise(whole)
    kind = F.when(n % 13 == 0, "text/html").otherwise("application/json")
    landed = by.select(F.concat_ws(" ", "event_type", F.col("day").cast("string")).alias("payload_id"), kind.alias("content_type"), body.alias("body"))
    return ingest.payload_validation(landed, "$.items", 60, ("id", "user"))


@query(f"WITH {FEEDBACK_SQL}, r AS (SELECT document_id AS external_id, source_name, CAST(published_at AS DATE) AS day, entity_id AS adapter, row_number() OVER (PARTITION BY source_name, CAST(published_at AS DATE) ORDER BY entity_id, published_at DESC, document_id) AS place FROM feedback), q AS (SELECT * FROM r WHERE place <= 40) SELECT *, count(*) OVER (PARTITION BY source_name, day) >= 40 AS allowance_reached FROM q")
def quota_by_adapter(spark, d):
    i = feedback(spark, d).select(F.col("document_id").alias("external_id"), "source_name", F.to_date("published_at").alias("day"), F.col("entity_id").alias("adapter"), "published_at")
    return ingest.quota_topk(i, ["source_name", "day"], 40, "adapter").select("external_id", "source_name", "day", "adapter", "place", "allowance_reached")


@query("WITH e AS (SELECT event_type AS source_name, CAST(ts AS DATE) AS run, event_id FROM events), a AS (SELECT source_name, run, count(*) AS attempted, count(*) FILTER (WHERE event_id % 3 <> 0) AS kept FROM e GROUP BY 1, 2), s AS (SELECT a.source_name, b.run FROM (SELECT DISTINCT source_name FROM e UNION SELECT 'silent') a, (SELECT DISTINCT run FROM e) b) SELECT s.source_name, s.run, coalesce(attempted, 0) AS attempted, CASE WHEN day(s.run) % 6 = 0 AND s.source_name = 'click' THEN 0 ELSE coalesce(kept, 0) END AS kept, CASE WHEN day(s.run) % 6 = 0 AND s.source_name = 'click' THEN 0 ELSE coalesce(attempted - kept, 0) END AS duplicates, CASE WHEN day(s.run) % 6 = 0 AND s.source_name = 'click' THEN 'failed' WHEN coalesce(attempted, 0) = 0 THEN 'empty' WHEN kept = 0 THEN 'duplicates_only' ELSE 'collected' END AS outcome_kind, CASE WHEN day(s.run) % 6 = 0 AND s.source_name = 'click' THEN 'timeout' END AS error FROM s LEFT JOIN a USING (source_name, run)")
def fetch_ledger_runs(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source_name"), F.to_date(F.col("ts").cast("timestamp")).alias("run"), "event_id")
    days, names = e.select("run").distinct(), e.select("source_name").distinct()
    sources = names.unionByName(names.limit(1).select(F.lit("silent").alias("source_name"))).join(days, how="inner", on=F.lit(True))
    errors = days.where(F.dayofmonth("run") % 6 == 0).select(F.lit("click").alias("source_name"), "run", F.lit("timeout").alias("error"))
    return ingest.fetch_ledger(sources, e, e.where("event_id % 3 <> 0"), errors, "run")


# ---- enrichment -----------------------------------------------------------------------------------------------


@query(_LANG + rf" SELECT doc_id, language, language IS NULL OR language IN ('en', 'de') AS accepted, CASE WHEN language IS NULL OR language IN ('en', 'de') THEN len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) >= 3 END AS is_relevant FROM lang")
def language_gate(spark, d):
    docs = table(spark, d, "documents")
    met = docs.join(tx.language(docs), "doc_id").select("doc_id", "language", (tx.relevance(F.col("text")) > 0).alias("is_relevant"))
    return tx.language_gate(met, ["en", "de"], ["is_relevant"])


_BASIS = "CASE theme % 3 WHEN 0 THEN 'description' WHEN 1 THEN 'queries' ELSE 'corpus' END"


@query(f"WITH b AS (SELECT label AS theme, vec_id, min(vec_id) OVER (PARTITION BY label) = vec_id AS described, vec_id % 4 = 0 AS asked FROM embeddings) SELECT theme, {_BASIS} AS basis, vec_id FROM b WHERE CASE theme % 3 WHEN 0 THEN described WHEN 1 THEN asked ELSE true END")
def theme_references(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("theme"), "vec_id")
    basis = F.when(F.col("theme") % 3 == 0, "description").when(F.col("theme") % 3 == 1, "queries").otherwise("corpus")
    described = e.groupBy("theme").agg(F.min("vec_id").alias("vec_id"))
    return discovery.references_by_basis(e.select("theme").distinct().withColumn("basis", basis), described, e.where("vec_id % 4 = 0"), e)


_INTENT_LIST = "[" + ", ".join(f"'{i}'" for i in INTENTS) + "]"


@query(f"WITH h AS (SELECT doc_id, sha256(coalesce(text, '') || chr(31)) AS h FROM documents), v AS (SELECT h, {_INTENT_LIST}[min(doc_id) % 9 + 1] AS intent, 0.5::DOUBLE AS intent_confidence FROM h WHERE doc_id % 3 <> 0 GROUP BY 1) SELECT doc_id, intent, intent_confidence FROM h LEFT JOIN v USING (h)")
def intent_attach(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text"), F.lit(None)).alias("content_hash"), F.lit("p1").alias("prompt_version"))
    intent = F.element_at(F.array(*[F.lit(i) for i in INTENTS]), (F.min("doc_id") % 9 + 1).cast("int"))
    landed = docs.where("doc_id % 3 <> 0").groupBy("content_hash", "prompt_version").agg(intent.alias("intent"), F.lit(0.5).alias("intent_confidence"))
    return tx.attach_intents(docs, landed, ["content_hash", "prompt_version"]).select("doc_id", "intent", "intent_confidence")


@query("SELECT source, doc_id, CAST(ceil(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 40.0) AS INTEGER) AS batch FROM documents")
def intent_batches(spark, d):
    return tx.verdict_batches(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"])


def _stages(spark, d) -> tuple[DataFrame, DataFrame]:
    """Enrichments as they stand, and what sentiment made anew of every third document."""
    docs = feedback(spark, d)
    old = docs.select("document_id", "monitor_id", "source_name", "topic_id", "bucket", "is_relevant", "sentiment_score", "sentiment_label", "rating", "engagement", "author_hash", F.create_map(F.lit("language"), F.lit("v1"), F.lit("sentiment"), F.lit("v1")).alias("model_versions"))
    new = old.where("document_id % 3 = 0 and dayofmonth(bucket) <= 10").withColumn("sentiment_score", F.lit(-0.5)).withColumn("sentiment_label", F.lit("negative")).withColumn("model_versions", F.create_map(F.lit("sentiment"), F.lit("v2"), F.lit("intent"), F.lit("v9")))
    return old, new


_RERAN = "document_id % 3 = 0 AND day(bucket) <= 10"
_STAGE = {"sentiment": ["sentiment_score", "sentiment_label"]}


@query(f"WITH {FEEDBACK_SQL} SELECT document_id, round(CASE WHEN {_RERAN} THEN -0.5 ELSE sentiment_score END, 6) AS sentiment_score, CASE WHEN {_RERAN} THEN 'negative' ELSE sentiment_label END AS sentiment_label, 'v1' AS language_version, CASE WHEN {_RERAN} THEN 'v2' ELSE 'v1' END AS sentiment_version FROM feedback")
def stage_rerun(spark, d):
    out = tx.rerun_stages(*_stages(spark, d), "document_id", _STAGE)
    return out.select("document_id", F.round("sentiment_score", 6).alias("sentiment_score"), "sentiment_label", F.col("model_versions")["language"].alias("language_version"), F.col("model_versions")["sentiment"].alias("sentiment_version"))


_RERUN_SQL = FEEDBACK_SQL.replace("feedback AS (SELECT event_id", "feedback0 AS (SELECT event_id").replace("ledger AS (", f"feedback AS (SELECT document_id, monitor_id, source_name, entity_id, author_hash, published_at, bucket, topic_id, is_relevant, CASE WHEN {_RERAN} THEN -0.5::DOUBLE ELSE sentiment_score END AS sentiment_score, CASE WHEN {_RERAN} THEN 'negative' ELSE sentiment_label END AS sentiment_label, rating, engagement, intent, k FROM feedback0),\nledger AS (")


@query(_ROLLUP.replace(FEEDBACK_SQL, _RERUN_SQL) + ", touched AS (SELECT DISTINCT monitor_id, bucket FROM feedback WHERE document_id % 3 = 0 AND day(bucket) <= 10) SELECT m.*, 'stage_rerun' AS reason FROM metrics m SEMI JOIN touched USING (monitor_id, bucket)")
def stage_rerun_recompute(spark, d):
    """A stage runs again, and every local day that it touches is rolled up anew."""
    old, new = _stages(spark, d)
    return rollup.late_recompute(tx.rerun_stages(old, new, "document_id", _STAGE), ledger(feedback(spark, d)), new, "stage_rerun")


def _berlin(d: str) -> str:
    """Hours that Berlin is ahead of UTC at a date's first moment: two after the last Sunday of March up to that of October (1995: of September)."""
    y = f"year({d})"
    sunday = lambda m: f"({m} - CAST(isodow({m}) % 7 AS INTEGER))"
    until = f"CASE WHEN {y} = 1995 THEN make_date({y}, 9, 30) ELSE make_date({y}, 10, 31) END"
    return f"to_hours(CASE WHEN {d} > {sunday(f'make_date({y}, 3, 31)')} AND {d} <= {sunday(f'({until})')} THEN 2 ELSE 1 END)"


@query(f"WITH b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS bucket FROM orders), t AS (SELECT bucket, CAST(bucket + 1 AS DATE) AS after FROM b), r AS (SELECT bucket, CAST(bucket AS TIMESTAMP) - {_berlin('bucket')} AS starts_at, CAST(after AS TIMESTAMP) - {_berlin('after')} AS ends_at FROM t) SELECT *, CAST(date_diff('hour', starts_at, ends_at) AS BIGINT) AS hours FROM r")
def bucket_bounds_with_clock_changes(spark, d):
    b = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("bucket")).distinct()
    lo, hi = tx.day_bounds(F.col("bucket"), F.lit("Europe/Berlin"))
    return b.select("bucket", lo.alias("starts_at"), hi.alias("ends_at"), ((F.unix_timestamp(hi) - F.unix_timestamp(lo)) / 3600).cast("long").alias("hours"))


@query("SELECT lang, string_agg(term, ', ' ORDER BY place) AS label FROM (" + oracle_sql()["ctfidf_keywords"] + ") WHERE place <= 3 GROUP BY 1")
def topic_labels(spark, d):
    docs = table(spark, d, "documents")
    return topics.topic_labels(topics.keywords(docs, "lang", "text", tx.STOP_WORDS["en"]), docs, "lang")


# ---- topic upkeep ---------------------------------------------------------------------------------------------


@query(_VEC.replace("WITH", "WITH RECURSIVE", 1) + ", a AS (SELECT label AS topic_id, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings), w AS (SELECT topic_id, 0::BIGINT AS i, centroid AS c, 0::DOUBLE AS score FROM cen UNION ALL SELECT w.topic_id, a.i, list_transform(range(1, 65), lambda j: 0.98 * w.c[j] + 0.02 * a.x[j]), w.score + 0.02 * list_distance(w.c, a.x) FROM w JOIN a ON a.topic_id = w.topic_id AND a.i = w.i + 1) SELECT topic_id, i AS doc_count, round(score, 5) AS drift_score FROM w QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY i DESC) = 1")
def topic_drift_score(spark, d):
    e, t = _topics(spark, d)
    return topics.drift_scores(e.withColumnRenamed("label", "topic_id"), t).withColumn("drift_score", F.round("drift_score", 5))


@query("WITH s AS (SELECT l_suppkey * 100 + l_partkey % 100 AS topic_id, CAST(max(l_shipdate) AS DATE) AS last_seen FROM lineitem GROUP BY 1), m AS (SELECT *, CASE WHEN topic_id % 10 = 0 THEN 'merged' ELSE 'active' END AS status FROM s) SELECT topic_id, last_seen, CASE WHEN status = 'active' AND last_seen < DATE '2001-06-30' - 60 THEN 'dormant' ELSE status END AS status FROM m")
def dormant_topics(spark, d):
    seen = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 100 + F.col("l_partkey") % 100).alias("topic_id")).agg(F.to_date(F.max("l_shipdate")).alias("last_seen"))
    return topics.mark_dormant(seen.withColumn("status", F.when(F.col("topic_id") % 10 == 0, "merged").otherwise("active")), F.lit("2001-06-30").cast("date"))


@query(_NEAR + ", took AS (SELECT DISTINCT topic_id FROM best WHERE s >= 0.55) SELECT topic_id, CASE WHEN topic_id IN (SELECT topic_id FROM took) THEN DATE '2024-01-30' ELSE DATE '2024-01-01' END AS last_seen FROM cen")
def touched_topics(spark, d):
    e, t = _near_topics(spark, d)
    old = t.select("topic_id", F.lit("2024-01-01").cast("date").alias("last_seen"))
    return topics.touch_topics(old, topics.assign_topics(topics.nearest_topic(e, t)), F.lit("2024-01-30").cast("date"))


_REFIT = "WITH l AS (SELECT vec_id AS document_id, label AS topic_id, (label + CASE WHEN vec_id % {n} = 0 THEN 1 ELSE 0 END) % 10 AS to_id FROM embeddings)"


def _refit(spark, d, n: int) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("label").alias("topic_id"))
    proposed = e.select("document_id", (F.lit(100) + (F.col("topic_id") + F.when(F.col("document_id") % n == 0, 1).otherwise(0)) % 10).alias("cluster_id"))
    match = e.select(F.col("topic_id")).distinct().select((F.col("topic_id") + 100).alias("cluster_id"), "topic_id")
    return topics.refit(e, proposed, match)


@query(_REFIT.format(n=7) + " SELECT document_id, to_id AS topic_id, CASE WHEN to_id <> topic_id THEN topic_id END AS moved_from FROM l")
def refit_remap(spark, d):
    return _refit(spark, d, 7)[0]


@query(_REFIT.format(n=7) + " SELECT topic_id AS from_topic, to_id AS to_topic, count(*) AS documents, 'refit_remap' AS event FROM l WHERE to_id <> topic_id GROUP BY 1, 2")
def refit_lineage(spark, d):
    return _refit(spark, d, 7)[1]


@query(_REFIT.format(n=2) + " SELECT document_id, topic_id, CAST(NULL AS INTEGER) AS moved_from FROM l")
def refit_below_agreement(spark, d):
    return _refit(spark, d, 2)[0]


def _merge(spark, d) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("topic_id"))
    t = s.withColumn("status", F.when(F.col("topic_id") % 7 == 0, "dormant").otherwise("active")).withColumn("merged_into", F.lit(None).cast("long"))
    return topics.merge_registry(t, s.where("topic_id % 2 = 1").withColumn("into_id", F.col("topic_id") * 3 - F.col("topic_id") * 3 % 2))


_MERGED = "WITH t AS (SELECT s_suppkey AS topic_id, CASE WHEN s_suppkey % 7 = 0 THEN 'dormant' ELSE 'active' END AS status, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey * 3 - s_suppkey * 3 % 2 END AS into_id FROM supplier), ok AS (SELECT topic_id, into_id FROM t WHERE status = 'active' AND into_id <> topic_id AND into_id IN (SELECT topic_id FROM t WHERE status = 'active'))"


@query(_MERGED + " SELECT t.topic_id, CASE WHEN ok.into_id IS NOT NULL THEN 'merged' ELSE status END AS status, ok.into_id AS merged_into FROM t LEFT JOIN ok USING (topic_id)")
def merged_registry(spark, d):
    return _merge(spark, d)[0]


@query(_MERGED + " SELECT topic_id AS from_topic, into_id AS to_topic, 'merge' AS event FROM ok")
def merge_lineage(spark, d):
    return _merge(spark, d)[1]


@query(_ROLLUP + " SELECT bucket, monitor_id, topic_id, doc_count FROM metrics WHERE grouping_id = 2 AND topic_id IN ('t5', 't6', 't7')")
def view_topic_history(spark, d):
    """t7 went into t6 and that into t5: the survivor's history holds the rows of all three."""
    m = _metrics(spark, d)
    into = F.when(F.col("topic_id") == "t7", "t6").when(F.col("topic_id") == "t6", "t5")
    registry = m.where("topic_id is not null").select("topic_id").distinct().withColumn("merged_into", into)
    return views.topic_history(m, topics.resolve_merged(registry, cut), "t5")


# ---- views, reports, upkeep -----------------------------------------------------------------------------------


@query(f"WITH {FEEDBACK_SQL}, l AS (SELECT *, (day(bucket) + length(source_name)) % 23 = 0 AS vf, CASE WHEN kept = 0 AND monitor_id = 'm0' THEN 'timeout' END AS error FROM ledger), b AS (SELECT monitor_id, source_name, bool_or(vf OR error IS NOT NULL) AS bad FROM l GROUP BY 1, 2) SELECT l.monitor_id, CAST(sum(kept) AS BIGINT) AS sample, list_sort(list(DISTINCT CAST(bucket AS VARCHAR)) FILTER (WHERE quota_hit)) AS truncated_days, (SELECT count(*) FROM b WHERE b.monitor_id = l.monitor_id AND bad) AS sources_failed, (SELECT count(*) FROM b WHERE b.monitor_id = l.monitor_id AND NOT bad) AS sources_ok FROM l GROUP BY 1")
def view_data_quality(spark, d):
    led = _docs(spark, d)[1]
    led = led.withColumn("validation_failed", (F.dayofmonth("bucket") + F.length("source_name")) % 23 == 0).withColumn("error", F.when((F.col("kept") == 0) & (F.col("monitor_id") == "m0"), "timeout"))
    return views.data_quality(led)


@query(f"WITH {FEEDBACK_SQL} SELECT document_id, published_at FROM feedback WHERE topic_id = 't3' AND source_name = 'click' AND published_at >= TIMESTAMP '2024-01-05' AND published_at < TIMESTAMP '2024-01-26' AND published_at < TIMESTAMP '2024-01-20' ORDER BY published_at DESC, document_id DESC LIMIT 21")
def view_document_filtered(spark, d):
    return views.page(feedback(spark, d), ("2024-01-20", 0), 20, "t3", "click", "2024-01-05", "2024-01-25").select("document_id", "published_at")


@query("SELECT o_orderkey AS insight_id, CAST(o_orderdate AS DATE) AS period_start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) AS period_end, CASE WHEN o_orderkey % 5 = 0 THEN 'digest' ELSE 'opportunity' END AS kind FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) <= DATE '1996-12-31' AND o_orderkey % 5 = 0")
def view_insights(spark, d):
    o = table(spark, d, "orders")
    start = F.to_date("o_orderdate")
    i = o.select(F.col("o_orderkey").alias("insight_id"), start.alias("period_start"), F.date_add(start, (F.col("o_orderkey") % 7).cast("int")).alias("period_end"), F.when(F.col("o_orderkey") % 5 == 0, "digest").otherwise("opportunity").alias("kind"))
    return views.insights_in_range(i, "1996-01-01", "1996-12-31", "digest")


@query(_HEALTH + ", s AS (SELECT monitor_id, source_name, CASE WHEN history < 5 THEN 'healthy' WHEN latest = 0 AND consecutive_empty >= 2 THEN 'broken' WHEN latest < 0.5 * rows_median_28d THEN 'degraded' ELSE 'healthy' END AS kind, latest AS observed, rows_median_28d AS expected FROM h) SELECT * FROM s WHERE kind <> 'healthy'")
def scraper_alerts(spark, d):
    return views.scraper_alerts(views.source_health(views.health_history(_docs(spark, d)[1])))


@query(f"WITH {FEEDBACK_SQL} SELECT document_id FROM feedback WHERE monitor_id <> 'm0' OR CAST(published_at AS DATE) >= DATE '2024-01-30' - 10")
def retention_kept(spark, d):
    docs = feedback(spark, d)
    rule = docs.where("monitor_id = 'm0'").select("monitor_id").distinct().withColumn("retention_days", F.lit(10))
    return views.retained(docs, rule, F.lit("2024-01-30").cast("date")).select("document_id")


@query("WITH j AS (SELECT o_orderkey AS job_id, 'm' || (o_custkey % 20) AS monitor_id, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) - 1 AS last_day, CASE WHEN o_orderkey % 40 = 1 THEN 'running' WHEN o_orderkey % 40 = 2 THEN 'pending' WHEN o_orderkey % 3 = 0 THEN 'submitted' ELSE 'complete' END AS state FROM orders), f AS (SELECT * FROM j a WHERE state = 'submitted' AND first_day <= last_day AND last_day <= DATE '1998-01-01' AND NOT EXISTS (SELECT 1 FROM j b WHERE b.state IN ('pending', 'running') AND b.monitor_id = a.monitor_id AND a.first_day <= b.last_day AND b.first_day <= a.last_day)) SELECT job_id, CAST(day AS DATE) AS day, 's' || s AS source_name FROM f, unnest(generate_series(CAST(first_day AS TIMESTAMP), CAST(last_day AS TIMESTAMP), INTERVAL 1 DAY)) u(day), range(0, 3) r(s) WHERE (CAST(substr(monitor_id, 2) AS INTEGER) + s) % 4 <> 0")
def backfill_plan(spark, d):
    o = table(spark, d, "orders")
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    state = F.when(k % 40 == 1, "running").when(k % 40 == 2, "pending").when(k % 3 == 0, "submitted").otherwise("complete")
    jobs = o.select(k.alias("job_id"), F.concat(F.lit("m"), F.col("o_custkey") % 20).alias("monitor_id"), start.alias("first_day"), F.date_add(start, (k % 9 - 1).cast("int")).alias("last_day"), state.alias("state"))
    sources = jobs.select("monitor_id").distinct().withColumn("s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((F.substring("monitor_id", 2, 3).cast("int") + F.col("s")) % 4 != 0)
    return views.backfill_plan(jobs, sources.select("monitor_id", F.concat(F.lit("s"), "s").alias("source_name")), F.lit("1998-01-01").cast("date"))


@query(_COH + ", h AS (SELECT round(avg((q - n) / (n * (n - 1))), 6) AS v, count(*) AS n FROM q WHERE n >= 2), l AS (SELECT l.quality = 1 AS rel, coalesce(d.n_chars > 800, false) AS pred FROM labels l LEFT JOIN documents d USING (doc_id)), m AS (SELECT round(count(*) FILTER (WHERE rel AND pred) / CAST(count(*) FILTER (WHERE pred) AS DOUBLE), 6) AS p, round(count(*) FILTER (WHERE rel AND pred) / CAST(count(*) FILTER (WHERE rel) AS DOUBLE), 6) AS r, count(*) AS n FROM l), un AS (SELECT 'coherence' AS measure, v AS value, n AS sample_size, 'ok' AS status FROM h UNION ALL SELECT 'precision', p, n, 'ok' FROM m UNION ALL SELECT 'recall', r, n, 'ok' FROM m UNION ALL SELECT 'diversity', NULL, 0, 'not_available' UNION ALL SELECT 'stability', NULL, 0, 'failed') SELECT *, 'embeddings, labels and documents, whole' AS computed_over FROM un")
def eval_report(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("relevant"))
    pred = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("n_chars") > 800).alias("predicted"))
    m = views.relevance_measures(lab, pred)
    coh = topics.coherence(table(spark, d, "embeddings"), "label").agg(F.round(F.avg("coherence"), 6).alias("value"), F.count("*").alias("sample_size"))
    part = lambda c: m.select(F.col(c).alias("value"), "sample_size")
    parts = {"coherence": coh, "precision": part("precision"), "recall": part("recall"), "diversity": coh.where("false"), "stability": lambda: coh.select("no_such_measure")}
    return cycle.report(parts, "embeddings, labels and documents, whole")
