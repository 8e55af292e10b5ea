"""All queries of the engine and their SQL, by name.

Every query reads its tables whole. What the given tables lack, such as a status or a verdict, is an expression over
ids, in query and SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixtures import DAILY_SQL, FEEDBACK_SQL, INTENTS, daily_counts, feedback, ledger, runs, table
from tidemark.functions import text as tx
from tidemark.operators import rollup, series, topics
from tidemark.operators.discovery import cut, stored
from tidemark.plans import views
from tidemark.sources import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: The day that detection looks at in the long series.
DAY = "1997-06-30"


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- rollup -------------------------------------------------------------------------------------------------

_ROLLUP = f"""WITH {FEEDBACK_SQL},
present AS (SELECT * FROM ledger WHERE kept > 0),
input AS (SELECT f.* FROM feedback f SEMI JOIN present p USING (monitor_id, source_name, bucket) WHERE f.is_relevant),
g AS (SELECT monitor_id, bucket, source_name, topic_id, CAST(grouping(source_name, topic_id) AS BIGINT) AS grouping_id, count(*) AS n, avg(sentiment_score) AS sm, quantile_cont(sentiment_score, 0.25) AS p25,
  count(*) FILTER (WHERE sentiment_label = 'negative') AS neg, sum(engagement) AS eng, count(DISTINCT author_hash) AS authors, avg(rating) AS rm FROM input
  GROUP BY GROUPING SETS ((monitor_id, bucket), (monitor_id, bucket, source_name), (monitor_id, bucket, topic_id), (monitor_id, bucket, source_name, topic_id))
  HAVING NOT (grouping(topic_id) = 0 AND topic_id IS NULL)),
dayt AS (SELECT monitor_id, bucket, sum(kept) AS kept, bool_or(quota_hit) AS quota_hit FROM present GROUP BY 1, 2),
allg AS (SELECT * FROM g WHERE grouping_id <> 3 UNION ALL SELECT d.monitor_id, d.bucket, NULL, NULL, 3, coalesce(g.n, 0), g.sm, g.p25, g.neg, g.eng, g.authors, g.rm FROM dayt d LEFT JOIN g ON g.monitor_id = d.monitor_id AND g.bucket = d.bucket AND g.grouping_id = 3),
metrics AS (SELECT a.monitor_id, a.bucket, a.source_name, a.topic_id, a.grouping_id, CAST(n AS BIGINT) AS doc_count,
  round(n / CAST(CASE WHEN a.grouping_id < 2 THEN p.kept ELSE d.kept END AS DOUBLE), 6) AS doc_count_share, CAST(CASE WHEN a.grouping_id < 2 THEN p.kept ELSE d.kept END AS BIGINT) AS sample_size,
  CASE WHEN a.grouping_id < 2 THEN p.quota_hit ELSE d.quota_hit END AS quota_hit, round(sm, 6) AS sentiment_mean, round(p25, 6) AS sentiment_p25, coalesce(round(neg / CAST(n AS DOUBLE), 6), 0) AS negativity_rate,
  CAST(eng AS BIGINT) AS engagement_sum, coalesce(round(authors / CAST(n AS DOUBLE), 6), 0) AS author_diversity, round(rm, 6) AS rating_mean
  FROM allg a JOIN dayt d USING (monitor_id, bucket) LEFT JOIN present p ON p.monitor_id = a.monitor_id AND p.bucket = a.bucket AND p.source_name = a.source_name)"""


def _docs(spark, d):
    docs = feedback(spark, d)
    return docs, ledger(docs)


def _metrics(spark, d):
    return rollup.daily_rollup(*_docs(spark, d))


@query(_ROLLUP + " SELECT * FROM metrics")
def daily_rollup(spark, d):
    return _metrics(spark, d)


@query(f"WITH {FEEDBACK_SQL} SELECT f.document_id, f.monitor_id, f.bucket FROM feedback f JOIN ledger l USING (monitor_id, source_name, bucket) WHERE f.is_relevant AND l.kept > 0")
def rollup_input(spark, d):
    return rollup.rollup_input(*_docs(spark, d)).select("document_id", "monitor_id", "bucket")


@query(f"WITH {FEEDBACK_SQL} SELECT monitor_id, bucket, topic_id, round(quantile_cont(sentiment_score, 0.25), 6) AS p25, count(*) AS n FROM feedback GROUP BY 1, 2, 3")
def sentiment_p25(spark, d):
    return feedback(spark, d).groupBy("monitor_id", "bucket", "topic_id").agg(F.round(F.expr("percentile(sentiment_score, 0.25)"), 6).alias("p25"), F.count("*").alias("n"))


@query(_ROLLUP + " SELECT monitor_id, bucket, topic_id, intent, count(*) AS n FROM input WHERE topic_id IS NOT NULL AND intent IS NOT NULL GROUP BY 1, 2, 3, 4")
def intent_counts(spark, d):
    return rollup.intent_counts(*_docs(spark, d)).select("monitor_id", "bucket", "topic_id", F.explode("intent_counts").alias("intent", "n"))


@query(f"WITH {FEEDBACK_SQL} SELECT monitor_id, source_name, bucket, CAST(sum(kept) AS BIGINT) AS sample_size, bool_or(quota_hit) AS quota_hit FROM ledger GROUP BY 1, 2, 3 HAVING sum(kept) > 0")
def sample_context(spark, d):
    return rollup.sample_context(_docs(spark, d)[1])[0]


@query(f"WITH {FEEDBACK_SQL} SELECT monitor_id, source_name, bucket, count(*) AS documents, CASE WHEN any_value(l.kept) IS NULL THEN 'ledger_missing' ELSE 'sample_zero' END AS violation FROM feedback f LEFT JOIN (SELECT * FROM ledger WHERE day(bucket) <> 11) l USING (monitor_id, source_name, bucket) WHERE coalesce(l.kept, 0) = 0 GROUP BY 1, 2, 3")
def ledger_violations(spark, d):
    docs, led = _docs(spark, d)
    return rollup.ledger_violations(docs, led.where(F.dayofmonth("bucket") != 11))


@query(_ROLLUP + ", late AS (SELECT DISTINCT monitor_id, bucket FROM feedback WHERE k = 42) SELECT m.*, 'late_arrival' AS reason FROM metrics m SEMI JOIN late USING (monitor_id, bucket)")
def late_recompute(spark, d):
    docs, led = _docs(spark, d)
    return rollup.late_recompute(docs, led, docs.where("k = 42"))


@query(_ROLLUP + ", old AS (SELECT monitor_id, bucket, source_name, topic_id, doc_count FROM metrics), new AS (SELECT monitor_id, bucket, source_name, topic_id, doc_count + 1 AS doc_count FROM metrics WHERE day(bucket) = 5) SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.monitor_id = old.monitor_id AND n.bucket = old.bucket AND n.source_name IS NOT DISTINCT FROM old.source_name AND n.topic_id IS NOT DISTINCT FROM old.topic_id) UNION ALL SELECT * FROM new")
def upsert_keep_latest(spark, d):
    old = _metrics(spark, d).select("monitor_id", "bucket", "source_name", "topic_id", "doc_count")
    new = old.where(F.dayofmonth("bucket") == 5).withColumn("doc_count", F.col("doc_count") + 1)
    return rollup.upsert_keep_latest(old, new, rollup.KEYS)


@query(_ROLLUP + " SELECT m.monitor_id, m.bucket, m.source_name, m.topic_id FROM metrics m WHERE day(m.bucket) IN (3, 4) AND m.topic_id = 't3'")
def prune_diff(spark, d):
    old = _metrics(spark, d).select(*rollup.KEYS)
    return rollup.prune_diff(old, old.where(F.dayofmonth("bucket").isin(3, 4) & ~F.col("topic_id").eqNullSafe("t3")), rollup.KEYS)


# ---- text ---------------------------------------------------------------------------------------------------

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"


@query(f"SELECT doc_id, nullif(trim(regexp_replace(text, '{_WS}', ' ', 'g')), '') AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[email]', 'g'), '(?:\+?[0-9]{1,3}[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b', '[phone]', 'g'), 'https?://\S+', '[link]', 'g') AS stripped FROM documents")
def strip_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.strip_pii(F.col("text")).alias("stripped"))


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS author_hash FROM events")
def author_hash(spark, d):
    return table(spark, d, "events").select("event_id", tx.author_hash(F.col("user_id").cast("string")).alias("author_hash"))


@query("SELECT sha256(coalesce(text, '') || chr(31) || '') AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    h = table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text"), F.lit(None)).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


_SIMHASH = r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents),
c AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h, count(*) AS n FROM tok GROUP BY doc_id, t),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) > 0 AS one FROM c, range(0, 64) r(i) GROUP BY 1, 2),
s AS (SELECT doc_id, sum(CASE WHEN one THEN 1::HUGEINT << i ELSE 0::HUGEINT END) AS u FROM b GROUP BY 1),
sim AS (SELECT d.doc_id, CAST(CASE WHEN coalesce(s.u, 0) >= 9223372036854775808 THEN coalesce(s.u, 0) - 18446744073709551616 ELSE coalesce(s.u, 0) END AS BIGINT) AS simhash FROM documents d LEFT JOIN s USING (doc_id))"""


@query(_SIMHASH + " SELECT * FROM sim")
def simhash(spark, d):
    return tx.simhash(table(spark, d, "documents"))


@query(_SIMHASH + " SELECT a.doc_id, (SELECT min(b.doc_id) FROM sim b WHERE b.doc_id < a.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 3) AS near_duplicate_of FROM sim a")
def near_dups(spark, d):
    return tx.near_duplicates(stored(tx.simhash(table(spark, d, "documents"))))


_STOPS = ", ".join(f"('{w}', '{g}')" for g, ws in tx.STOP_WORDS.items() for w in ws)
_LANG = rf"""WITH words(t, guess) AS (VALUES {_STOPS}), tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM documents),
h AS (SELECT doc_id, guess, count(*) AS n FROM tok JOIN words USING (t) GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS al, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, guess) AS r FROM h),
lang AS (SELECT d.doc_id, d.text, b.guess AS language, round(b.n / CAST(b.al AS DOUBLE), 6) AS confidence FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.r = 1)"""


@query(_LANG + " SELECT doc_id, language, confidence FROM lang")
def language_guess(spark, d):
    return tx.language(table(spark, d, "documents"))


@query(r"SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS relevance_score FROM conversations")
def relevance_floor(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.when(tx.word_count(F.col("text")) >= 3, 1.0).otherwise(0.0).alias("relevance_score"))


_VAL = ", ".join(f"('{w}', {v})" for w, v in tx.VALENCE.items())


@query(rf"WITH v(t, v) AS (VALUES {_VAL}), tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM documents), s AS (SELECT doc_id, CAST(sum(v) AS DOUBLE) AS s FROM tok JOIN v USING (t) GROUP BY 1), o AS (SELECT d.doc_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 6) AS sentiment_score FROM documents d LEFT JOIN s USING (doc_id)) SELECT doc_id, sentiment_score, CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM o")
def sentiment_lexicon(spark, d):
    return tx.sentiment(table(spark, d, "documents"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a)"""
    + f" SELECT page_id, nullif(trim(regexp_replace(t, '{_WS}', ' ', 'g')), '') AS page_text FROM b"
)
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.page_text(F.col("html")).alias("page_text"))


@query(r"WITH o AS (SELECT coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', ''), ''), 'outlet:unknown') AS outlet FROM pages) SELECT outlet, count(*) AS pages, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM o GROUP BY 1")
def outlet_share(spark, d):
    by = table(spark, d, "pages").groupBy(tx.outlet(F.col("url")).alias("outlet")).agg(F.count("*").alias("pages"))
    total = by.agg(F.sum("pages").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("outlet", "pages", F.round(F.col("pages") / F.col("total"), 6).alias("share"))


@query("SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS bucket FROM events")
def local_day_bucket(spark, d):
    return table(spark, d, "events").select("event_id", tx.local_day(F.col("ts").cast("timestamp"), F.lit("Asia/Jakarta")).alias("bucket"))


@query("WITH b AS (SELECT DISTINCT CAST(ts + INTERVAL 7 HOUR AS DATE) AS bucket FROM events) SELECT bucket, CAST(bucket AS TIMESTAMP) - INTERVAL 7 HOUR AS starts_at, CAST(bucket AS TIMESTAMP) + INTERVAL 17 HOUR AS ends_at FROM b")
def bucket_bounds(spark, d):
    zone = F.lit("Asia/Jakarta")
    b = table(spark, d, "events").select(tx.local_day(F.col("ts").cast("timestamp"), zone).alias("bucket")).distinct()
    lo, hi = tx.day_bounds(F.col("bucket"), zone)
    return b.select("bucket", lo.alias("starts_at"), hi.alias("ends_at"))


# ---- ingest -------------------------------------------------------------------------------------------------


def _items(spark, d):
    e = feedback(spark, d)
    return e.select("source_name", F.col("document_id").alias("external_id"), "published_at", "rating", "engagement", "k")


@query(f"WITH {FEEDBACK_SQL} SELECT document_id AS external_id, source_name FROM feedback WHERE published_at > TIMESTAMP '2024-01-15'")
def cursor_increment(spark, d):
    i = _items(spark, d)
    cur = i.select("source_name").distinct().withColumn("cursor_at", F.lit("2024-01-15").cast("timestamp"))
    return ingest.cursor_increment(i, cur).select("external_id", "source_name")


@query(f"WITH {FEEDBACK_SQL}, r AS (SELECT document_id AS external_id, source_name, CAST(published_at AS DATE) AS day, row_number() OVER (PARTITION BY source_name, CAST(published_at AS DATE) ORDER BY published_at DESC, document_id) AS place FROM feedback), q AS (SELECT * FROM r WHERE place <= 40) SELECT *, count(*) OVER (PARTITION BY source_name, day) >= 40 AS allowance_reached FROM q")
def quota_topk(spark, d):
    i = _items(spark, d).withColumn("day", F.to_date("published_at"))
    return ingest.quota_topk(i, ["source_name", "day"], 40).select("external_id", "source_name", "day", "place", "allowance_reached")


@query(f"WITH {FEEDBACK_SQL}, x AS (SELECT source_name, arg_max(document_id, published_at) AS i, max(published_at) AS p, bool_or(k = 99 AND source_name = 'click') AS bad FROM feedback GROUP BY 1) SELECT source_name, CASE WHEN bad THEN -1 ELSE i END AS last_external_id, CASE WHEN bad THEN TIMESTAMP '2023-12-31' ELSE p END AS last_published_at FROM x")
def cursor_advance(spark, d):
    i = _items(spark, d).withColumn("failed", (F.col("k") == 99) & (F.col("source_name") == "click"))
    old = i.select("source_name").distinct().select("source_name", F.lit(-1).cast("long").alias("last_external_id"), F.lit("2023-12-31").cast("timestamp").alias("last_published_at"))
    return ingest.cursor_advance(i, old)


def _batch(spark, d):
    i = _items(spark, d).select("source_name", "external_id", "published_at")
    return i.unionByName(i.where("external_id % 20 = 0")), i.where("external_id % 3 = 0")


@query("SELECT event_type AS source_name, event_id AS external_id FROM events WHERE event_id % 3 <> 0")
def natural_key_dedup(spark, d):
    b, old = _batch(spark, d)
    return ingest.natural_key_dedup(b, old, ["source_name", "external_id"], F.col("published_at")).select("source_name", "external_id")


@query("SELECT event_type AS source_name, count(*) + count(*) FILTER (WHERE event_id % 20 = 0) AS attempted, count(*) FILTER (WHERE event_id % 3 <> 0) AS kept, count(*) FILTER (WHERE event_id % 20 = 0) + count(*) FILTER (WHERE event_id % 3 = 0) AS duplicates, 'collected' AS outcome_kind FROM events GROUP BY 1 UNION ALL SELECT 'silent', 0, 0, 0, 'empty'")
def fetch_ledger(spark, d):
    b, old = _batch(spark, d)
    new = ingest.natural_key_dedup(b, old, ["source_name", "external_id"], F.col("published_at"))
    return ingest.fetch_ledger(b.select("source_name").distinct().unionByName(b.limit(1).select(F.lit("silent").alias("source_name"))), b, new)


@query("SELECT DISTINCT event_type AS source_name, 'u' || user_id AS entity_ref FROM events WHERE user_id % 5 <> 0 AND user_id % 7 <> 0")
def candidate_antijoin(spark, d):
    f = table(spark, d, "events").select(F.col("event_type").alias("source_name"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_ref"), "user_id")
    pick = lambda n: f.where(F.col("user_id") % n == 0).select("source_name", "entity_ref").distinct()
    return ingest.candidate_antijoin(f, pick(5), pick(7)).select("source_name", "entity_ref")


# ---- series and detectors -----------------------------------------------------------------------------------

_POINTS = f"""WITH {DAILY_SQL}, points AS (SELECT *, CASE WHEN day(bucket) % 10 = 0 THEN 'truncated' ELSE 'clean' END AS quality FROM daily WHERE bucket <= DATE '{DAY}' AND bucket > DATE '{DAY}' - 60),
clean AS (SELECT * FROM points WHERE quality = 'clean'),
base AS (SELECT topic_id, median(value) AS m, avg(value) AS lam, count(*) AS n FROM clean WHERE bucket < DATE '{DAY}' GROUP BY 1),
mad AS (SELECT topic_id, median(abs(value - m)) * 1.4826 AS mad FROM clean JOIN base USING (topic_id) WHERE bucket < DATE '{DAY}' GROUP BY 1)"""


def _points(spark, d):
    day = F.lit(DAY).cast("date")
    p = daily_counts(spark, d).where((F.col("bucket") <= day) & (F.col("bucket") > F.date_sub(day, 60)))
    return p.withColumn("quality", F.when(F.dayofmonth("bucket") % 10 == 0, "truncated").otherwise("clean")), day


@query(_ROLLUP + ", t AS (SELECT monitor_id, bucket, topic_id, CAST(doc_count AS DOUBLE) AS value, quota_hit FROM metrics WHERE grouping_id = 2), x AS (SELECT DISTINCT monitor_id, topic_id FROM t), dd AS (SELECT x.*, CAST(DATE '2024-01-30' - CAST(i AS INTEGER) AS DATE) AS bucket FROM x, range(0, 60) r(i)) SELECT dd.monitor_id, dd.topic_id, dd.bucket, t.value, CASE WHEN t.value IS NULL THEN 'absent' WHEN r.status = 'partial' THEN 'partial' WHEN t.quota_hit THEN 'truncated' ELSE 'clean' END AS quality FROM dd LEFT JOIN t USING (monitor_id, topic_id, bucket) LEFT JOIN runs r ON r.monitor_id = dd.monitor_id AND r.bucket = dd.bucket")
def dense_series(spark, d):
    docs, led = _docs(spark, d)
    m = rollup.daily_rollup(docs, led).where("grouping_id = 2").select("monitor_id", "bucket", "topic_id", F.col("doc_count").cast("double").alias("value"), "quota_hit")
    return series.dense_series(m, runs(docs), F.lit("2024-01-30").cast("date"))


@query(_POINTS + " SELECT topic_id, round(m, 6) AS median, round(lam, 6) AS lambda, n AS clean_days, round(mad, 6) AS mad FROM base JOIN mad USING (topic_id)")
def robust_baseline(spark, d):
    p, day = _points(spark, d)
    b = series.robust_baseline(p, ["topic_id"], day)
    return b.select("topic_id", F.round("median", 6).alias("median"), F.round("lambda", 6).alias("lambda"), "clean_days", F.round("mad", 6).alias("mad"))


@query(_POINTS + f", g AS (SELECT topic_id, max(value) FILTER (WHERE bucket = DATE '{DAY}') AS latest, count(*) FILTER (WHERE bucket < DATE '{DAY}' AND quality = 'clean') AS c FROM points GROUP BY 1), r AS (SELECT *, CASE WHEN coalesce(latest, -1) < 5 THEN 'below_volume_floor' WHEN c < 14 THEN 'insufficient_baseline' END AS reason FROM g) SELECT topic_id, reason IS NULL AS passed, reason, c AS clean_days FROM r")
def gate_outcomes(spark, d):
    p, day = _points(spark, d)
    return series.gate_outcomes(p, ["topic_id"], day)


_FLAT = _POINTS + ", w AS (SELECT topic_id, median(value) AS am, count(*) AS n FROM clean GROUP BY 1), wd AS (SELECT topic_id, isodow(bucket) AS wday, median(value) AS dm FROM clean GROUP BY 1, 2), flat AS (SELECT p.topic_id, p.bucket, p.quality, CASE WHEN w.n >= 14 AND w.am <> 0 AND wd.dm IS NOT NULL THEN wd.dm / w.am ELSE 1 END AS f, p.value FROM points p LEFT JOIN w USING (topic_id) LEFT JOIN wd ON wd.topic_id = p.topic_id AND wd.wday = isodow(p.bucket)), adj AS (SELECT topic_id, bucket, quality, f, CASE WHEN f > 0 THEN value / f ELSE value END AS value FROM flat)"


@query(_FLAT + " SELECT topic_id, bucket, round(value, 6) AS value, quality, round(f, 6) AS factor FROM adj")
def deseasonalise(spark, d):
    return series.deseasonalise(_points(spark, d)[0], ["topic_id"]).withColumn("value", F.round("value", 6)).withColumn("factor", F.round("factor", 6))


def _pvalues(spark, d):
    e = feedback(spark, d).where("topic_id is not null")
    return e.groupBy("monitor_id", "bucket", "topic_id").agg((F.abs(F.sum(F.col("k") * 7 % 101)) % 101 / 1000.0).alias("p_value"))


_P = f"WITH {FEEDBACK_SQL}, c AS (SELECT monitor_id, bucket, topic_id, abs(sum(k * 7 % 101)) % 101 / 1000.0::DOUBLE AS p_value FROM feedback WHERE topic_id IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY monitor_id, bucket ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY monitor_id, bucket) AS n FROM c), b AS (SELECT *, max(CASE WHEN p_value <= rk * 0.1::DOUBLE / n THEN p_value END) OVER (PARTITION BY monitor_id, bucket) AS top FROM r)"


@query(_P + " SELECT monitor_id, bucket, topic_id, coalesce(p_value <= top, false) AS kept FROM b")
def bh_correction(spark, d):
    return series.bh_correction(_pvalues(spark, d), ["monitor_id", "bucket"]).select("monitor_id", "bucket", "topic_id", "kept")


@query(f"WITH {FEEDBACK_SQL}, x AS (SELECT DISTINCT topic_id, source_name AS kind FROM feedback WHERE topic_id IS NOT NULL AND bucket = DATE '2024-01-20'), fired AS (SELECT topic_id, source_name AS kind, max(bucket) AS m FROM feedback WHERE topic_id IS NOT NULL AND k % 17 = 0 AND bucket < DATE '2024-01-20' AND bucket >= DATE '2024-01-08' GROUP BY 1, 2) SELECT x.topic_id, x.kind FROM x LEFT JOIN fired USING (topic_id, kind) WHERE m IS NULL OR DATE '2024-01-20' - m >= 3")
def cooldown_filter(spark, d):
    e = feedback(spark, d).where("topic_id is not null")
    day = F.lit("2024-01-20").cast("date")
    c = e.where(F.col("bucket") == day).select("topic_id", F.col("source_name").alias("kind")).distinct()
    return series.cooldown(c, e.where("k % 17 = 0").select("topic_id", F.col("source_name").alias("kind"), F.col("bucket").alias("detected_on")), ["topic_id"], day)


# ---- topics and vectors -------------------------------------------------------------------------------------

_VEC = """WITH c0 AS (SELECT label AS topic_id, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), cen AS (SELECT topic_id, list(m ORDER BY i) AS centroid FROM c0 GROUP BY 1),
sim AS (SELECT vec_id, topic_id, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s FROM embeddings, cen), best AS (SELECT vec_id, topic_id, s FROM sim QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, topic_id) = 1)"""


def _topics(spark, d):
    e = table(spark, d, "embeddings")
    return e, topics.mean_vectors(e.withColumnRenamed("label", "topic_id"), "topic_id")


@query(_VEC + " SELECT vec_id, topic_id, round(s, 6) AS similarity FROM best")
def nearest_topic(spark, d):
    return topics.nearest_topic(*_topics(spark, d)).select("vec_id", "topic_id", F.round("similarity", 6).alias("similarity"))


#: Means of three quarters and of a quarter of each label's vectors: near to the label's mean, and less near.
_CAND = ", cd0 AS (SELECT label * 10 + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS candidate_id, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), cd AS (SELECT candidate_id, list(m ORDER BY i) AS v FROM cd0 GROUP BY 1), cs AS (SELECT candidate_id, topic_id, v, centroid, list_cosine_similarity(v, centroid) AS s FROM cd, cen)"


def _candidates(spark, d):
    e = table(spark, d, "embeddings").withColumn("candidate_id", F.col("label") * 10 + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0))
    return topics.mean_vectors(e, "candidate_id")


@query(_VEC + _CAND + " SELECT candidate_id AS vec_id, topic_id, 'centroid' AS method FROM cs WHERE s >= 0.55 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY round(s, 9) DESC, topic_id) = 1")
def assign_topics(spark, d):
    docs = _candidates(spark, d).withColumnsRenamed({"candidate_id": "vec_id", "centroid": "embedding"})
    return topics.assign_topics(topics.nearest_topic(docs, _topics(spark, d)[1])).select("vec_id", "topic_id", "method")


def _residue(spark, d):
    """The vectors that no topic takes."""
    e, t = _topics(spark, d)
    return topics.residue_pool(e, topics.assign_topics(topics.nearest_topic(e, t)))


#: A third of the vectors of two thirds of the labels moved towards their label's mean, so that topics take some and leave others.
_NEAR = _VEC.replace("sim AS (SELECT vec_id, topic_id, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s FROM embeddings, cen)", """moved AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 AND label % 3 <> 0
THEN list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + centroid[i] / sqrt(list_inner_product(centroid, centroid))) ELSE embedding::DOUBLE[] END AS v FROM embeddings JOIN cen ON topic_id = label),
sim AS (SELECT vec_id, topic_id, list_cosine_similarity(v, centroid) AS s FROM moved, cen)""")


def _near_topics(spark, d):
    """Moved vectors and topics."""
    e, t = _topics(spark, d)
    c = F.col("centroid")
    moved = F.zip_with("embedding", F.transform(c, lambda x: x / F.sqrt(topics.dot(c, c))), lambda x, y: x.cast("double") + y)
    near = F.when((F.col("vec_id") % 3 == 0) & (F.col("label") % 3 != 0), moved).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    return e.join(t, e["label"] == t["topic_id"]).select("vec_id", "label", near.alias("embedding")), t


@query(_NEAR + " SELECT vec_id FROM best WHERE s < 0.55")
def residue_pool(spark, d):
    e, t = _near_topics(spark, d)
    return topics.residue_pool(e, topics.assign_topics(topics.nearest_topic(e, t))).select("vec_id")


@query(_VEC + ", a AS (SELECT label AS topic_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1 AS later, count(*) OVER (PARTITION BY label) AS n FROM embeddings), x AS (SELECT topic_id, i, sum(0.02 * pow(0.98, later) * embedding[i]::DOUBLE) AS mv, any_value(n) AS n FROM a, range(1, 65) r(i) GROUP BY 1, 2), y AS (SELECT x.topic_id, x.n, pow(0.98, x.n) * c0.m + x.mv - c0.m AS delta FROM x JOIN c0 USING (topic_id, i)) SELECT topic_id, any_value(n) AS doc_count, round(sqrt(sum(delta * delta)), 6) AS moved FROM y GROUP BY 1")
def centroid_drift(spark, d):
    e, t = _topics(spark, d)
    return topics.centroid_drift(e.withColumnRenamed("label", "topic_id"), t).withColumn("moved", F.round("moved", 6))


_COH = "WITH u AS (SELECT label, vec_id, i, embedding[i]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS u FROM embeddings, range(1, 65) r(i)), s AS (SELECT label, i, sum(u) AS s, count(*) AS n FROM u GROUP BY 1, 2), q AS (SELECT label, sum(s * s) AS q, any_value(n) AS n FROM s GROUP BY 1)"


@query(_COH + " SELECT label, n, round((q - n) / (n * (n - 1)), 6) AS coherence FROM q WHERE n >= 2")
def eval_coherence(spark, d):
    return topics.coherence(table(spark, d, "embeddings"), "label").withColumn("coherence", F.round("coherence", 6))


@query(_VEC + ", p AS (SELECT list_cosine_similarity(a.centroid, b.centroid) AS s FROM cen a JOIN cen b ON a.topic_id < b.topic_id) SELECT round(1 - avg(s), 6) AS diversity FROM p")
def eval_diversity(spark, d):
    t = _topics(spark, d)[1].withColumn("one", F.lit(1)).withColumnRenamed("centroid", "embedding")
    return topics.coherence(t, "one").select(F.round(1 - F.col("coherence"), 6).alias("diversity"))


@query("WITH l AS (SELECT label AS a, (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2), x AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM c) AS rc, (SELECT sum(m * (m - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS ra, (SELECT sum(m * (m - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS rb, (SELECT sum(n) FROM c) AS al) SELECT round((rc - ra * rb / (al * (al - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (al * (al - 1) / 2)), 6) AS ari FROM x")
def adjusted_rand(spark, d):
    e = table(spark, d, "embeddings")
    l = e.select(F.col("label").alias("a"), ((F.col("label") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)) % 10).alias("b"))
    return topics.adjusted_rand(l).select(F.round("ari", 6).alias("ari"))


_EN = ", ".join(f"'{w}'" for w in tx.STOP_WORDS["en"])


@query(rf"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents), tf AS (SELECT lang, term, count(*) AS tf FROM w WHERE term NOT IN ({_EN}) GROUP BY 1, 2), c AS (SELECT term, sum(tf) AS al, count(*) AS df FROM tf GROUP BY 1 ORDER BY al DESC, term LIMIT 2000), g AS (SELECT count(DISTINCT lang) AS g FROM documents), m AS (SELECT lang, tf.term, tf * (ln((1 + g) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN c USING (term), g), n AS (SELECT lang, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY lang)), 6) AS weight FROM m) SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INTEGER) AS place, term, weight FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) <= 8")
def ctfidf_keywords(spark, d):
    return topics.keywords(table(spark, d, "documents"), "lang", "text", tx.STOP_WORDS["en"])


@query("WITH RECURSIVE t AS (SELECT c_custkey AS topic_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey - 1 END AS merged_into FROM customer), r AS (SELECT topic_id, topic_id AS place FROM t UNION ALL SELECT r.topic_id, t.merged_into FROM r JOIN t ON t.topic_id = r.place WHERE t.merged_into IS NOT NULL) SELECT topic_id, min(place) AS survivor FROM r WHERE place IN (SELECT topic_id FROM t WHERE merged_into IS NULL) GROUP BY 1 UNION ALL SELECT topic_id, NULL FROM t WHERE topic_id - topic_id % 4 NOT IN (SELECT topic_id FROM t)")
def resolve_merged(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("topic_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") - 1).alias("merged_into"))
    return topics.resolve_merged(t, cut)


@query("SELECT l_orderkey AS document_id, l_partkey AS topic_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_shipdate DESC, l_linenumber, l_partkey) = 1")
def assignment_precedence(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("topic_id"), F.when(F.col("l_returnflag") == "R", "manual").otherwise("centroid").alias("method"), F.struct(F.col("l_shipdate"), -F.col("l_linenumber"), -F.col("l_partkey")).alias("assigned_at"))
    return topics.assignment_precedence(a).select("document_id", "topic_id")


@query(_VEC + ", x AS (SELECT e.vec_id, e.label AS topic_id, e.vec_id % 3 AS source, round(1 - s, 9) AS dist FROM embeddings e JOIN sim ON sim.vec_id = e.vec_id AND sim.topic_id = e.label), y AS (SELECT *, row_number() OVER (PARTITION BY topic_id, source ORDER BY dist, vec_id) AS turn, min(dist) OVER (PARTITION BY topic_id, source) AS best FROM x) SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY turn, best, source) AS INTEGER) AS place, vec_id, source FROM y QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY turn, best, source) <= 15")
def representatives(spark, d):
    e, t = _topics(spark, d)
    met = e.join(t, e["label"] == t["topic_id"]).select("vec_id", "topic_id", (F.col("vec_id") % 3).alias("source"), F.round(1 - topics.cosine(F.col("embedding"), F.col("centroid")), 9).alias("distance"))
    return topics.representatives(met)


# ---- views, scores, insights, evaluation, upkeep ---------------------------------------------------------------


@query(_ROLLUP + " SELECT monitor_id, bucket, sentiment_mean AS value, CASE WHEN quota_hit THEN 'truncated' WHEN doc_count = 0 THEN 'partial' ELSE 'clean' END AS quality FROM metrics WHERE grouping_id = 2 AND topic_id = 't3' AND bucket BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def view_timeseries(spark, d):
    return views.timeseries(_metrics(spark, d), "sentiment_mean", "t3", None, "2024-01-05", "2024-01-20")


@query(_ROLLUP + " SELECT monitor_id, CAST(sum(doc_count) AS BIGINT) AS documents, round(avg(sentiment_mean), 6) AS sentiment FROM metrics WHERE grouping_id = 3 GROUP BY 1")
def view_overview(spark, d):
    return views.overview(_metrics(spark, d))


@query("SELECT n_name, count(*) AS documents, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, round(avg(o_totalprice), 4) AS mean_value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1")
def view_share_of_voice(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    met = o.where("o_orderdate >= date'1995-01-01' and o_orderdate < date'1997-01-01'").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return views.share_of_voice(met, "n_name", F.col("o_totalprice")).withColumn("mean_value", F.round("mean_value", 4))


@query(f"WITH {FEEDBACK_SQL} SELECT document_id, published_at FROM feedback WHERE published_at < TIMESTAMP '2024-01-20' ORDER BY published_at DESC, document_id DESC LIMIT 51")
def view_document_page(spark, d):
    return views.page(feedback(spark, d), ("2024-01-20", 0), 50).select("document_id", "published_at")


@query(_ROLLUP + ", t AS (SELECT monitor_id, bucket, topic_id, count(DISTINCT source_name) AS own FROM metrics WHERE grouping_id = 0 GROUP BY 1, 2, 3), a AS (SELECT monitor_id, bucket, count(DISTINCT source_name) AS act FROM metrics WHERE grouping_id = 1 GROUP BY 1, 2) SELECT monitor_id, bucket, topic_id, round(own / CAST(act AS DOUBLE), 6) AS breadth FROM t JOIN a USING (monitor_id, bucket)")
def breadth_ratio(spark, d):
    return views.breadth_ratio(_metrics(spark, d))


@query(f"WITH {FEEDBACK_SQL} SELECT monitor_id, bucket, status <> 'partial' AS trusted FROM runs")
def day_trust(spark, d):
    return views.day_trust(runs(feedback(spark, d)))


def _events(spark, d):
    e = feedback(spark, d).where("topic_id is not null and k % 19 = 0")
    return e.select(F.col("document_id").alias("event_id"), "monitor_id", "topic_id", F.to_date("published_at").alias("detected_on"), F.when(F.col("k") % 2 == 0, "pelt").otherwise("robust_z").alias("method"), F.col("source_name").alias("kind"))


_EV = f"WITH {FEEDBACK_SQL}, ev AS (SELECT document_id AS event_id, monitor_id, topic_id, CAST(published_at AS DATE) AS detected_on, CASE WHEN k % 2 = 0 THEN 'pelt' ELSE 'robust_z' END AS method, source_name AS kind FROM feedback WHERE topic_id IS NOT NULL AND k % 19 = 0)"


@query(_EV + ", m AS (SELECT ev.event_id, f.document_id, row_number() OVER (PARTITION BY ev.event_id ORDER BY f.published_at DESC, f.document_id) AS r FROM ev JOIN feedback f ON f.monitor_id = ev.monitor_id AND f.topic_id = ev.topic_id AND f.is_relevant AND CAST(f.published_at AS DATE) <= detected_on AND CAST(f.published_at AS DATE) > detected_on - CASE WHEN method = 'pelt' THEN 7 ELSE 1 END) SELECT event_id, list(document_id ORDER BY r) AS evidence_ids FROM m WHERE r <= 5 GROUP BY 1")
def event_evidence(spark, d):
    return views.event_evidence(_events(spark, d), feedback(spark, d))


@query(_EV + ", k AS (SELECT DISTINCT kind FROM ev), rules AS (SELECT 'r_' || kind AS rule_id, kind AS rule_kind FROM k WHERE kind <> 'click' UNION ALL SELECT 'any', NULL) SELECT rule_id, event_id, 'pending' AS state FROM ev JOIN rules ON rule_kind IS NULL OR rule_kind = kind")
def alert_matches(spark, d):
    ev = _events(spark, d)
    rules = ev.select("kind").distinct().select(F.concat(F.lit("r_"), F.col("kind")).alias("rule_id"), F.col("kind").alias("rule_kind"), (F.col("kind") != "click").alias("enabled"))
    rules = rules.unionByName(ev.limit(1).select(F.lit("any").alias("rule_id"), F.lit(None).cast("string").alias("rule_kind"), F.lit(True).alias("enabled")))
    return views.alert_matches(ev, rules)


@query("SELECT event_id AS delivery_id, CAST(event_id % 4 + 1 AS INTEGER) AS attempts, CASE WHEN event_id % 6 = 0 THEN 'abandoned' WHEN event_id % 5 = 0 THEN 'delivered' WHEN event_id % 4 + 1 >= 3 THEN 'abandoned' ELSE 'failed' END AS state FROM events")
def delivery_states(spark, d):
    e = table(spark, d, "events")
    a = e.select(F.col("event_id").alias("delivery_id"), (F.col("event_id") % 4).cast("int").alias("attempts"), (F.col("event_id") % 5 == 0).alias("ok"), F.when(F.col("event_id") % 6 != 0, "webhook").alias("channel"))
    return views.delivery_states(a)


_STATS = _ROLLUP + ", asks AS (SELECT monitor_id, topic_id, count(*) AS asks FROM feedback WHERE intent IN ('feature_request', 'bug_report') GROUP BY 1, 2), st AS (SELECT m.monitor_id, m.topic_id, CAST(sum(doc_count) AS BIGINT) AS documents, round(avg(doc_count_share), 6) AS share, round(avg(sentiment_mean), 6) AS sentiment, round(avg(negativity_rate), 6) AS negativity, round(coalesce(any_value(asks), 0) / CAST(sum(doc_count) AS DOUBLE), 6) AS ask_share FROM metrics m LEFT JOIN asks a ON a.monitor_id = m.monitor_id AND a.topic_id = m.topic_id WHERE grouping_id = 2 GROUP BY 1, 2)"


@query(_STATS + " SELECT * FROM st")
def topic_statistics(spark, d):
    return views.topic_statistics(_metrics(spark, d), feedback(spark, d))


@query("SELECT o_orderkey AS topic_id, o_orderkey % 5 <> 0 AND o_orderkey % 4 >= 3 AND o_orderkey % 3 <> 0 AS passed, CASE WHEN o_orderkey % 5 = 0 THEN 'day_untrustworthy' WHEN o_orderkey % 4 < 3 THEN 'evidence_too_thin' WHEN o_orderkey % 3 = 0 THEN 'no_change' END AS reason FROM orders")
def insight_gates(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return views.insight_gates(o.select(k.alias("topic_id"), (k % 5 != 0).alias("trusted"), (k % 4).alias("evidence"), (k % 3 != 0).alias("changed")))


def _completions(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("topic_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("supplied"))
    cited = F.when(F.col("topic_id") % 5 == 0, F.expr("cast(array() as array<bigint>)")).when(F.col("topic_id") % 4 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.slice("supplied", 1, 3))
    return li.select("topic_id", "supplied", cited.alias("cited"))


@query("SELECT DISTINCT l_orderkey AS topic_id, l_orderkey % 5 <> 0 AND l_orderkey % 4 <> 0 AS accepted FROM lineitem")
def grounding_check(spark, d):
    return views.grounding_check(_completions(spark, d))


@query("WITH s AS (SELECT l_orderkey AS t, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_orderkey % 4 <> 0 GROUP BY 1), c AS (SELECT t % 50 AS digest, unnest(p[1:3]) AS i FROM s) SELECT digest, list_sort(list(DISTINCT i)) AS evidence_ids FROM c GROUP BY 1")
def digest_evidence(spark, d):
    c = _completions(spark, d)
    ok = c.join(views.grounding_check(c).where("accepted"), "topic_id").withColumn("digest", F.col("topic_id") % 50)
    return views.digest_evidence(ok, "digest")


@query("WITH p AS (SELECT l.quality = 1 AS rel, coalesce(d.n_chars > 800, false) AS pred FROM labels l LEFT JOIN documents d USING (doc_id)) SELECT round(count(*) FILTER (WHERE rel AND pred) / CAST(count(*) FILTER (WHERE pred) AS DOUBLE), 6) AS precision, round(count(*) FILTER (WHERE rel AND pred) / CAST(count(*) FILTER (WHERE rel) AS DOUBLE), 6) AS recall, count(*) AS sample_size FROM p")
def eval_relevance(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("relevant"))
    pred = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("n_chars") > 800).alias("predicted"))
    return views.relevance_measures(lab, pred)


def _matched(events: str, labels: str) -> str:
    """match: (g, occurred_on, event_id, lead_days) of events (g, event_id, detected_on) and labels (g, occurred_on), one label of each group at a time."""
    return f"""me AS ({events}), ml AS (SELECT g, occurred_on, row_number() OVER (PARTITION BY g ORDER BY occurred_on) AS i FROM ({labels})),
mm(g, i, used, pick) AS (SELECT DISTINCT g, 0::BIGINT, CAST([] AS VARCHAR[]), NULL::VARCHAR FROM ml
UNION ALL SELECT g, i, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, p FROM (SELECT mm.g, ml.i, any_value(mm.used) AS used, arg_min(me.event_id, (abs(ml.occurred_on - me.detected_on), me.detected_on, me.event_id)) AS p
FROM mm JOIN ml ON ml.g = mm.g AND ml.i = mm.i + 1 LEFT JOIN me ON me.g = mm.g AND abs(ml.occurred_on - me.detected_on) <= 3 AND NOT list_contains(mm.used, me.event_id) GROUP BY mm.g, ml.i)),
match AS (SELECT ml.g, ml.occurred_on, me.event_id, CAST(ml.occurred_on - me.detected_on AS INTEGER) AS lead_days FROM mm JOIN ml ON ml.g = mm.g AND ml.i = mm.i JOIN me ON me.g = mm.g AND me.event_id = mm.pick)"""


_LABELS = "SELECT DISTINCT monitor_id, detected_on AS occurred_on FROM ev WHERE day(detected_on) % 5 = 0"
_REV = _EV.replace("WITH", "WITH RECURSIVE", 1)


@query(_REV + ", " + _matched("SELECT monitor_id AS g, CAST(event_id AS VARCHAR) AS event_id, detected_on FROM ev", f"SELECT monitor_id AS g, occurred_on FROM ({_LABELS})") + " SELECT g AS monitor_id, occurred_on, event_id, lead_days FROM match")
def eval_match_events(spark, d):
    ev = _events(spark, d).select("monitor_id", "detected_on", F.col("event_id").cast("string").alias("event_id"))
    lab = ev.where(F.dayofmonth("detected_on") % 5 == 0).select("monitor_id", F.col("detected_on").alias("occurred_on")).distinct()
    return views.match_events(ev, lab)


@query("SELECT conv_id || '-' || turn AS label_id, trim(coalesce(role, '')) = '' OR regexp_matches(lower(role), 'pipeline|system|auto|model') AS rejected FROM conversations")
def label_contamination(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("label_id"), F.col("role").alias("labelled_by"))
    return views.label_contamination(c)


@query(f"WITH {FEEDBACK_SQL} SELECT monitor_id, bucket, CASE WHEN sum(kept) = 0 THEN 'failed' WHEN bool_or(kept = 0) AND bool_or(kept > 0) THEN 'partial' WHEN bool_or(kept = 0) THEN 'failed' ELSE 'complete' END AS status FROM ledger GROUP BY 1, 2")
def run_status(spark, d):
    return views.run_status(_docs(spark, d)[1])


_HEALTH = f"WITH {FEEDBACK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY monitor_id, source_name ORDER BY bucket DESC) AS p FROM ledger), h AS (SELECT monitor_id, source_name, CASE WHEN count(*) >= 5 THEN median(kept) END AS rows_median_28d, count(*) AS history, coalesce(min(p) FILTER (WHERE kept > 0), count(*) + 1) - 1 AS consecutive_empty, max(kept) FILTER (WHERE p = 1) AS latest FROM r WHERE p <= 28 GROUP BY 1, 2)"


@query(_HEALTH + " SELECT * FROM h")
def health_streaks(spark, d):
    return views.health_history(_docs(spark, d)[1])


@query(_HEALTH + " SELECT monitor_id, source_name, CASE WHEN history < 5 THEN 'healthy' WHEN latest = 0 AND consecutive_empty >= 2 THEN 'broken' WHEN latest < 0.5 * rows_median_28d THEN 'degraded' ELSE 'healthy' END AS state, latest AS observed, rows_median_28d AS expected FROM h")
def source_health(spark, d):
    return views.source_health(views.health_history(_docs(spark, d)[1]))


@query(f"WITH {FEEDBACK_SQL} SELECT monitor_id, count(*) AS to_delete FROM feedback WHERE CAST(published_at AS DATE) < DATE '2024-01-30' - CASE WHEN monitor_id = 'm0' THEN 10 ELSE 20 END GROUP BY 1")
def retention_preview(spark, d):
    docs = feedback(spark, d)
    mon = docs.select("monitor_id").distinct().withColumn("retention_days", F.when(F.col("monitor_id") == "m0", 10).otherwise(20))
    return views.retention_preview(docs, mon, F.lit("2024-01-30").cast("date"))
