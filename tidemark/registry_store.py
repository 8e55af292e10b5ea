"""Queries of written tables, states and mergeable figures, added to the registry's."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import registry_upkeep
from tidemark.fixtures import FEEDBACK_SQL, feedback, ledger, table
from tidemark.functions import language_model, main_text, sentiment
from tidemark.functions import text as tx
from tidemark.operators import band_index, inverted_file, ranks, rollup, sketches, topics
from tidemark.operators.discovery import shared_folder, stored
from tidemark.registry import _ROLLUP, _WS, _docs, _metrics, _pvalues, _topics, oracle_sql, query
from tidemark.plans import views
from tidemark.sources import daily_table, ingest
from tidemark.streaming import state

# ---- the written daily table --------------------------------------------------------------------------------


def _written(spark, d, docs, led, days):
    table = daily_table.daily_metrics(spark, f"{shared_folder(spark, 'spark-daily-')}/daily-{uuid.uuid4().hex}", _metrics(spark, d))
    done, failed = daily_table.roll_up(table, docs, led, days)
    if failed:
        raise RuntimeError(f"days that failed: {failed}")
    return table


@query(_ROLLUP + ", late AS (SELECT DISTINCT monitor_id, bucket FROM feedback WHERE k = 42) SELECT m.*, CASE WHEN l.bucket IS NULL THEN 'daily' ELSE 'late_arrival' END AS reason FROM metrics m LEFT JOIN late l USING (monitor_id, bucket)")
def written_late_days(spark, d):
    """A table written without the late documents, then only the days that they touch written anew."""
    docs, led = _docs(spark, d)
    table = _written(spark, d, docs.where("k <> 42 or k is null"), led, led)
    daily_table.late_arrivals(table, docs, led, docs.where("k = 42"))
    return table.read()


@query(_ROLLUP.replace("feedback AS (SELECT", "feedback AS (SELECT * FROM (SELECT").replace("AS intent, k FROM e2)", "AS intent, k FROM e2) WHERE NOT (coalesce(topic_id, '') = 't3' AND day(bucket) IN (3, 4) OR day(bucket) = 9 AND source_name = 'view'))", 1) + " SELECT *, CASE WHEN day(bucket) IN (3, 4, 9) THEN 'stage_rerun' ELSE 'daily' END AS reason FROM metrics")
def written_pruned_days(spark, d):
    """A whole table, then three days written anew without some of their documents: rows that nothing supports any more are gone."""
    docs, led = _docs(spark, d)
    table = _written(spark, d, docs, led, led)
    gone = (F.coalesce("topic_id", F.lit("")) == "t3") & F.dayofmonth("bucket").isin(3, 4) | (F.dayofmonth("bucket") == 9) & (F.col("source_name") == "view")
    left = docs.where(~gone)
    daily_table.roll_up(table, left, ledger(left), docs.where(F.dayofmonth("bucket").isin(3, 4, 9)), "stage_rerun")
    return table.read()


@query(_ROLLUP + ", old AS (SELECT monitor_id, bucket, source_name, topic_id, grouping_id, doc_count FROM metrics), new AS (SELECT monitor_id, bucket, source_name, CASE WHEN grouping_id = 2 THEN topic_id || 'x' ELSE topic_id END AS topic_id, grouping_id, doc_count + 1 AS doc_count FROM metrics WHERE day(bucket) = 5) SELECT * FROM old WHERE NOT (day(bucket) = 5 AND grouping_id <> 2) UNION ALL SELECT * FROM new")
def written_upsert(spark, d):
    """Rows of known keys replaced and rows of new keys added, in the files of one day."""
    rows = _metrics(spark, d).select(*rollup.KEYS, "grouping_id", "doc_count")
    table = daily_table.DayTable(spark, f"{shared_folder(spark, 'spark-daily-')}/daily-{uuid.uuid4().hex}", rows.schema, daily_table.METRICS_BY)
    table.upsert(rows, rollup.KEYS)
    topic = F.when(F.col("grouping_id") == 2, F.concat("topic_id", F.lit("x"))).otherwise(F.col("topic_id"))
    table.upsert(table.read().where(F.dayofmonth("bucket") == 5).withColumn("doc_count", F.col("doc_count") + 1).withColumn("topic_id", topic), rollup.KEYS)
    return table.read()


# ---- nearest of many topics ---------------------------------------------------------------------------------


@query("""WITH t0 AS (SELECT label * 20 + vec_id % 20 AS topic_id, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), t AS (SELECT topic_id, list(m ORDER BY i) AS c FROM t0 GROUP BY 1),
s AS (SELECT vec_id, topic_id, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings, t) SELECT vec_id, topic_id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, topic_id) = 1""")
def nearest_of_many_topics(spark, d):
    """An inverted file of a twentieth of each label's vectors at a time, probed until the sample of documents finds all its nearest."""
    e = table(spark, d, "embeddings")
    index = inverted_file.InvertedFile(topics.mean_vectors(e.withColumn("topic_id", F.col("label") * 20 + F.col("vec_id") % 20), "topic_id"))
    return index.search(e, index.probes_for(e, 1.0)).withColumn("similarity", F.round("similarity", 6))


# ---- mergeable figures --------------------------------------------------------------------------------------


@query(f"WITH {FEEDBACK_SQL} SELECT monitor_id, topic_id, round(quantile_cont(sentiment_score, 0.25), 6) AS p25, count(sentiment_score) AS n FROM feedback WHERE sentiment_score IS NOT NULL GROUP BY 1, 2")
def period_p25_from_counts(spark, d):
    """Quartiles of a whole period from counts by day, exact."""
    daily = sketches.value_counts(feedback(spark, d), sketches.GRAIN, "sentiment_score")
    return sketches.percentiles(daily, ["monitor_id", "topic_id"], "sentiment_score", 0.25).select("monitor_id", "topic_id", F.round("percentile", 6).alias("p25"), "n")


@query(f"WITH {FEEDBACK_SQL}, g AS (SELECT monitor_id, bucket, topic_id, count(*) AS n FROM feedback WHERE sentiment_score IS NOT NULL GROUP BY GROUPING SETS ((monitor_id, bucket, topic_id), (monitor_id, topic_id), (monitor_id))) SELECT *, true AS within_error FROM g")
def sketched_quartiles(spark, d):
    """Sketches by day and topic, merged to topics and to monitors; whether the first quartile of each has the rank that it should."""
    docs = feedback(spark, d).where("sentiment_score is not null")
    finest = sketches.quartile_sketches(docs, sketches.GRAIN, "sentiment_score")
    out = None
    for keys in (["monitor_id", "bucket", "topic_id"], ["monitor_id", "topic_id"], ["monitor_id"]):
        own = sketches.merged_quartiles(finest, keys).select(*[F.col(k).alias(f"{k}_") for k in keys], "n", sketches.quantile("sketch", 0.25).alias("p25"))
        met = docs.join(own, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
        rank = met.groupBy(*keys, "n").agg(F.count_if(F.col("sentiment_score") < F.col("p25")).alias("low"), F.count_if(F.col("sentiment_score") <= F.col("p25")).alias("high"))
        ok = (F.col("low") / F.col("n") <= 0.25 + sketches.RANK_ERROR) & (F.col("high") / F.col("n") >= 0.25 - sketches.RANK_ERROR)
        part = rank.select(*[F.col(k) if k in keys else F.lit(None).cast(t).alias(k) for k, t in (("monitor_id", "string"), ("bucket", "date"), ("topic_id", "string"))], "n", ok.alias("within_error"))
        out = part if out is None else out.unionByName(part)
    return out


_HALVES = f"""WITH {FEEDBACK_SQL}, p AS (SELECT monitor_id, topic_id, author_hash, bool_or(bucket <= DATE '2024-01-15') AS a, bool_or(bucket > DATE '2024-01-15') AS b FROM feedback GROUP BY 1, 2, 3)
SELECT monitor_id, topic_id, count(*) FILTER (WHERE a) AS first_half, count(*) FILTER (WHERE b) AS second_half, count(*) AS authors, count(*) FILTER (WHERE a AND b) AS returning_authors FROM p GROUP BY 1, 2"""


@query(_HALVES)
def returning_authors(spark, d):
    """Distinct authors of two halves of the period, of both together and in both, from the authors of each day, source and topic."""
    daily = sketches.distinct_values(feedback(spark, d), sketches.GRAIN, "author_hash")
    met = sketches.in_both(daily, ["monitor_id", "topic_id"], "author_hash", F.col("bucket") <= F.lit("2024-01-15").cast("date"))
    return met.select("monitor_id", "topic_id", F.col("before").alias("first_half"), F.col("after").alias("second_half"), F.col("all").alias("authors"), F.col("both").alias("returning_authors"))


# ---- states of a stream -------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {FEEDBACK_SQL}, found AS (SELECT DISTINCT monitor_id, topic_id, source_name AS kind, bucket AS detected_on FROM feedback WHERE topic_id IS NOT NULL AND k % 17 = 0), fires AS (SELECT monitor_id, topic_id, kind, min(detected_on) AS detected_on FROM found GROUP BY 1, 2, 3 UNION ALL SELECT f.monitor_id, f.topic_id, f.kind, min(g.detected_on) FROM fires f JOIN found g ON g.monitor_id = f.monitor_id AND g.topic_id = f.topic_id AND g.kind = f.kind AND g.detected_on >= f.detected_on + 3 GROUP BY 1, 2, 3) SELECT * FROM fires")
def stream_cooldown(spark, d):
    """Events landed by week, taken in as a stream that keeps each key's last day; the closing event lets the last days out."""
    root = f"{shared_folder(spark, 'spark-stream-')}/cooldown-{uuid.uuid4().hex}"
    found = feedback(spark, d).where("topic_id is not null and k % 17 = 0").select("monitor_id", "topic_id", F.col("source_name").alias("kind"), F.col("bucket").alias("detected_on")).distinct()
    found.withColumn("week", F.date_format(F.date_trunc("week", "detected_on"), "yyyy-MM-dd")).repartition("week").write.partitionBy("week").parquet(f"{root}/in")
    last = found.agg(F.date_add(F.max("detected_on"), 1000).alias("detected_on"))
    last.select(F.lit("").alias("monitor_id"), F.lit("").alias("topic_id"), F.lit(state.CLOSE).alias("kind"), "detected_on", F.lit("9999").alias("week")).coalesce(1).write.mode("append").partitionBy("week").parquet(f"{root}/in")
    fired = state.cooldowns(spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/in/week=*"))
    state.take_in(fired, root, "append")
    return state.results(spark, root, fired.schema).drop("batch")


@query(registry_upkeep.oracle_sql()["topic_drift_score"])
def stream_topic_drift(spark, d):
    """The vectors of every label as a stream in order of their ids, from the labels' means on."""
    e, t = _topics(spark, d)
    root = f"{shared_folder(spark, 'spark-stream-')}/drift-{uuid.uuid4().hex}"
    e.select(F.col("label").alias("topic_id"), "vec_id", "embedding").repartitionByRange(4, "vec_id").write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    run = state.drifts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/in"), t)
    state.take_in(run, root, "update")
    newest = state.results(spark, root, run.schema).groupBy("topic_id").agg(F.max_by(F.struct("doc_count", "drift_score"), "doc_count").alias("x"))
    return newest.select("topic_id", "x.doc_count", F.round("x.drift_score", 5).alias("drift_score"))


# ---- texts --------------------------------------------------------------------------------------------------


def _fifth(docs):
    return docs.where("doc_id % 5 <> 0 and lang is not null")


@query(rf"""WITH t AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS x FROM documents),
g AS (SELECT doc_id, lang, substr(x, i, 3) AS gram FROM (SELECT doc_id, lang, x, unnest(range(1, length(x) - 1)) AS i FROM t)),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY 1, 2),
kept AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {language_model.GRAMS}), v AS (SELECT count(*) + 1 AS v FROM kept), u AS (SELECT lang, sum(n) + 0.5 * any_value(v) AS n, ln(0.5 / (sum(n) + 0.5 * any_value(v))) AS l FROM c, v GROUP BY 1),
p AS (SELECT c.lang, c.gram, ln((c.n + 0.5) / u.n) AS l FROM c SEMI JOIN kept USING (gram) JOIN u USING (lang)), d AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2),
s AS (SELECT d.doc_id, u.lang, sum(d.n * coalesce(p.l, u.l)) AS s FROM d CROSS JOIN u LEFT JOIN p ON p.lang = u.lang AND p.gram = d.gram GROUP BY 1, 2),
b AS (SELECT doc_id, lang AS language FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1) SELECT doc_id, language FROM documents LEFT JOIN b USING (doc_id)""")
def language_by_trigrams(spark, d):
    """Learned from four fifths of the labelled documents, told for all."""
    docs = table(spark, d, "documents")
    model = language_model.fit(language_model.trigram_counts(_fifth(docs), "lang"), "lang")
    return language_model.predict(docs, model).select("doc_id", "language")


_MARKS = ", ".join(f"('{w}', {v})" for w, v in sentiment.VALENCE.items())
_BOOST = ", ".join(f"('{w}', {v})" for w, v in sentiment.BOOSTERS.items())
_NOT = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(sentiment.NEGATIONS))
_ORDERED = rf"""WITH vl(w, v) AS (VALUES {_MARKS}), bl(w, b) AS (VALUES {_BOOST}),
t AS (SELECT {{id}} AS id, unnest(list_transform(regexp_extract_all(text, '[\p{{{{L}}}}\p{{{{N}}}}_'']+|[!?]'), lambda x, i: {{{{'i': i, 't': x}}}})) AS x FROM {{table}}),
w AS (SELECT id, x.i AS i, x.t AS t, lower(x.t) AS l, x.t NOT IN ('!', '?') AS word, length(x.t) > 1 AND upper(x.t) = x.t AND lower(x.t) <> x.t AS caps FROM t),
f AS (SELECT w.*, coalesce(vl.v, 0)::DOUBLE AS v, coalesce(bl.b, 0)::DOUBLE AS b, l IN ({_NOT}) AS neg FROM w LEFT JOIN vl ON vl.w = l LEFT JOIN bl ON bl.w = l),
m AS (SELECT id, count(*) FILTER (WHERE caps) AS caps, count(*) FILTER (WHERE word) AS words, max(i) FILTER (WHERE l = 'but') AS but, count(*) FILTER (WHERE t = '!') AS ex, count(*) FILTER (WHERE t = '?') AS qu FROM f GROUP BY 1),
g AS (SELECT id, i, v, caps, [coalesce(lag(b, 1) OVER o, 0), coalesce(lag(b, 2) OVER o, 0), coalesce(lag(b, 3) OVER o, 0)] AS bs, [coalesce(lag(v, 1) OVER o, 0), coalesce(lag(v, 2) OVER o, 0), coalesce(lag(v, 3) OVER o, 0)] AS vs,
coalesce(lag(neg, 1) OVER o, false) OR coalesce(lag(neg, 2) OVER o, false) OR coalesce(lag(neg, 3) OVER o, false) AS neg FROM f WHERE word WINDOW o AS (PARTITION BY id ORDER BY i)),
h AS (SELECT id, i, (v + sign(v) * 0.733 * (CASE WHEN g.caps AND m.caps > 0 AND m.caps < m.words THEN 1 ELSE 0 END) + sign(v) * (CASE WHEN vs[1] = 0 THEN bs[1] ELSE 0 END + CASE WHEN vs[2] = 0 THEN bs[2] * 0.95 ELSE 0 END + CASE WHEN vs[3] = 0 THEN bs[3] * 0.9 ELSE 0 END))
* CASE WHEN neg THEN -0.74 ELSE 1 END * CASE WHEN but IS NULL OR i = but THEN 1 WHEN i < but THEN 0.5 ELSE 1.5 END AS v FROM g JOIN m USING (id) WHERE v <> 0),
s AS (SELECT id, round(sum(v), 9) AS s FROM h GROUP BY 1),
z AS (SELECT {{id}} AS id, coalesce(s.s, 0) + sign(coalesce(s.s, 0)) * (least(coalesce(ex, 0), 4) * 0.292 + CASE WHEN qu > 3 THEN 0.96 WHEN qu > 1 THEN qu * 0.18 ELSE 0 END) AS s FROM {{table}} d LEFT JOIN s ON s.id = d.{{id}} LEFT JOIN m ON m.id = d.{{id}}),
r AS (SELECT id, round(s / sqrt(s * s + 15), 6) AS sentiment_score FROM z) SELECT id AS {{id}}, sentiment_score, CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM r"""


@query(_ORDERED.format(id="doc_id", table="documents"))
def sentiment_by_order(spark, d):
    return sentiment.sentiment(table(spark, d, "documents"))


_GONE = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in main_text.NEVER.split("|"))
_TREE = """CASE WHEN dens > 0.333333 THEN false WHEN coalesce(pd, 0) <= 0.555556 THEN words > 16 OR coalesce(nw, 0) > 15 OR coalesce(pw, 0) > 4 ELSE words > 40 OR coalesce(nw, 0) > 17 END"""


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(translate(html, chr(29) || chr(30) || chr(31), '   '), '(?is){_GONE}|<!--.*?-->|<!doctype[^>]*>', chr(29), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<a\b[^>]*>', chr(30), 'g'), '(?is)</a\s*>', chr(31), 'g'), '(?is)</?({main_text.BOUNDS})\b[^>]*>', chr(29), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM a),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
s AS (SELECT page_id, unnest(list_transform(string_split(t, chr(29)), lambda x, i: {{'i': i, 'x': x}})) AS s FROM e),
k AS (SELECT page_id, s.i AS i, trim(regexp_replace(translate(s.x, chr(30) || chr(31), ''), '{_WS}', ' ', 'g')) AS text, trim(regexp_replace(array_to_string(regexp_extract_all(s.x, chr(30) || '([^' || chr(31) || ']*)', 1), ''), '{_WS}', ' ', 'g')) AS linked FROM s),
n AS (SELECT page_id, i, text, len(string_split(text, ' ')) AS words, length(linked) / length(text)::DOUBLE AS dens FROM k WHERE text <> ''),
w AS (SELECT *, lag(words) OVER o AS pw, lag(dens) OVER o AS pd, lead(words) OVER o AS nw FROM n WINDOW o AS (PARTITION BY page_id ORDER BY i)),
g AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS main_text FROM w WHERE {_TREE} GROUP BY 1) SELECT page_id, main_text FROM pages LEFT JOIN g USING (page_id)""")
def page_main_text(spark, d):
    return table(spark, d, "pages").select("page_id", main_text.main_text(F.col("html")).alias("main_text"))


# ---- days against stored days, ranks in groups of any size ----------------------------------------------------


@query(oracle_sql()["near_dups"])
def near_dups_by_day(spark, d):
    """Three days of documents, each linked to itself and to the stored bands of those before it."""
    hashes = stored(tx.simhash(table(spark, d, "documents")))
    index = band_index.BandIndex(spark, f"bands_{uuid.uuid4().hex}", 8)
    last = hashes.agg(F.max("doc_id")).first()[0] or 0
    out = None
    for day in range(3):
        part = index.link(hashes.where(F.floor(F.col("doc_id") * 3 / (last + 1)) == day))
        out = part if out is None else out.unionByName(part)
    return out


@query(oracle_sql()["bh_correction"])
def bh_correction_spread(spark, d):
    return ranks.bh_correction(_pvalues(spark, d), ["monitor_id", "bucket"]).select("monitor_id", "bucket", "topic_id", "kept")


@query(oracle_sql()["centroid_drift"])
def centroid_drift_spread(spark, d):
    e, t = _topics(spark, d)
    return ranks.centroid_drift(e.withColumnRenamed("label", "topic_id"), t).withColumn("moved", F.round("moved", 6))


# ---- cursors, discovery, labels, runs -------------------------------------------------------------------------


@query(f"WITH {FEEDBACK_SQL}, c AS (SELECT source_name, max(document_id) FILTER (WHERE k = 42) AS id, CASE WHEN length(source_name) % 2 = 0 THEN TIMESTAMP '2024-01-15' END AS at FROM feedback GROUP BY 1), s AS (SELECT c.*, f.published_at AS stop_at FROM c LEFT JOIN feedback f ON f.document_id = c.id AND f.source_name = c.source_name) SELECT f.document_id AS external_id, f.source_name FROM feedback f JOIN s USING (source_name) WHERE (s.at IS NULL OR f.published_at > s.at) AND (s.stop_at IS NULL OR f.published_at > s.stop_at OR f.published_at = s.stop_at AND f.document_id < s.id)")
def cursor_stop(spark, d):
    """Fetches that stop at an item's id, by some sources' cursors at a time too."""
    items = feedback(spark, d).select("source_name", F.col("document_id").alias("external_id"), "published_at", "k")
    cursors = items.groupBy("source_name").agg(F.max(F.when(F.col("k") == 42, F.col("external_id"))).alias("last_external_id"))
    cursors = cursors.withColumn("last_published_at", F.when(F.length("source_name") % 2 == 0, F.lit("2024-01-15").cast("timestamp")))
    return ingest.items_until_cursor(items.drop("k"), cursors).select("external_id", "source_name")


_FOUND = "WITH f AS (SELECT 'm' || user_id % 4 AS monitor_id, event_type AS source_name, 'u' || user_id AS entity_ref, 'q' || user_id % 3 AS query FROM events), q AS (SELECT DISTINCT monitor_id, query, monitor_id <> 'm3' AND query <> 'q2' AS accepted FROM f UNION ALL SELECT 'quiet', 'q0', true), r AS (SELECT f.*, CAST(substr(entity_ref, 2) AS BIGINT) % 5 = 0 OR monitor_id = 'm2' AS bad FROM f SEMI JOIN (SELECT * FROM q WHERE accepted) USING (monitor_id, query))"


def _discovery(spark, d):
    e = table(spark, d, "events")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    found = e.select(name("m", F.col("user_id") % 4).alias("monitor_id"), F.col("event_type").alias("source_name"), name("u", F.col("user_id")).alias("entity_ref"), name("q", F.col("user_id") % 3).alias("query"), name("User ", F.col("user_id")).alias("display_name"), "user_id")
    queries = found.select("monitor_id", "query").distinct().withColumn("accepted", (F.col("monitor_id") != "m3") & (F.col("query") != "q2"))
    queries = queries.unionByName(e.limit(1).select(F.lit("quiet").alias("monitor_id"), F.lit("q0").alias("query"), F.lit(True).alias("accepted")))
    key = ["monitor_id", "source_name", "entity_ref"]
    return ingest.discovery(found.drop("user_id"), queries, found.where("user_id % 5 = 0 or monitor_id = 'm2'").select(*key), found.where("user_id % 7 = 0").select(*key).distinct())


@query(_FOUND + " SELECT q.monitor_id, count(r.monitor_id) FILTER (WHERE NOT bad) AS proposed, count(r.monitor_id) FILTER (WHERE bad) AS rejected_known, CASE WHEN q.n = 0 THEN 'no_queries' WHEN count(r.monitor_id) FILTER (WHERE NOT bad) = 0 THEN 'every_surface_empty' END AS reason FROM (SELECT monitor_id, count(*) FILTER (WHERE accepted) AS n FROM q GROUP BY 1) q LEFT JOIN r USING (monitor_id) GROUP BY q.monitor_id, q.n")
def discovery_outcome(spark, d):
    return _discovery(spark, d)[1]


@query(_FOUND + " SELECT monitor_id, source_name, entity_ref, 'User ' || substr(entity_ref, 2) AS display_name, min(query) AS proposed_by_query, 'matched query ' || min(query) AS reason FROM r WHERE NOT bad AND CAST(substr(entity_ref, 2) AS BIGINT) % 7 <> 0 GROUP BY 1, 2, 3")
def discovery_candidates(spark, d):
    return _discovery(spark, d)[0]


_REFERENCE = "CASE o_orderkey % 6 WHEN 0 THEN 'https://news.example/' || o_orderkey WHEN 1 THEN '  ' WHEN 2 THEN 'Trend_Events/' || o_orderkey WHEN 3 THEN 'https://x.example/monitors/' || o_orderkey WHEN 4 THEN NULL ELSE 'release notes ' || o_orderkey END"


@query(f"WITH l AS (SELECT o_orderkey AS label_id, lower({_REFERENCE}) AS x FROM orders) SELECT label_id, coalesce(trim(x), '') = '' OR regexp_matches(x, 'trend_events/|insights/|generation_skips/|/monitors/') AS rejected, CASE WHEN coalesce(trim(x), '') = '' THEN 'blank_reference' WHEN regexp_matches(x, 'trend_events/|insights/|generation_skips/|/monitors/') THEN 'own_output' END AS reason FROM l")
def event_label_contamination(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("label_id"), F.expr(_REFERENCE).alias("external_reference"))
    return views.event_contamination(o)


@query(f"WITH {FEEDBACK_SQL} SELECT monitor_id, source_name, bucket, kept, quota_hit FROM ledger WHERE monitor_id = 'm1' AND bucket = DATE '2024-01-12'")
def run_ledger(spark, d):
    return ingest.run_ledger(ledger(feedback(spark, d)), "m1", "2024-01-12")
