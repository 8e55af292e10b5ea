"""Queries of topic discovery, the detection cycle, its reports and the stream, added to the registry's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import registry_store, registry_trends, registry_upkeep  # noqa: F401  (their queries join the registry)
from tidemark.fixtures import FEEDBACK_SQL, feedback, ledger, runs, table
from tidemark.functions import text as tx
from tidemark.operators import discovery, hierarchy, matching, topics
from tidemark.plans import cycle, views
from tidemark.sources import ingest
from tidemark.registry import _CAND, _EN, _EV, _LABELS, _REV, _ROLLUP, _STATS, _VEC, _candidates, _events, _matched, _metrics, _residue, _topics, oracle_sql, queries, query
from tidemark.streaming import daily

__all__ = ["oracle_sql", "queries"]

# ---- relevance, vectors, clusters ---------------------------------------------------------------------------


@query(_VEC + " SELECT vec_id, round(max(s), 6) AS relevance_score, max(s) >= 0.35 AS is_relevant FROM sim GROUP BY 1")
def theme_relevance(spark, d):
    e, refs = _topics(spark, d)
    return discovery.theme_relevance(e, refs).withColumn("relevance_score", F.round("relevance_score", 6))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM documents),
tf AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8))::UBIGINT % 384 AS BIGINT) AS dim, count(*) AS tf FROM w GROUP BY 1, 2),
idf AS (SELECT dim, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM tf GROUP BY 1),
x AS (SELECT doc_id, dim, tf * idf AS x FROM tf JOIN idf USING (dim)) SELECT doc_id, dim, round(coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 0), 0), 6) AS weight FROM x""")
def hashed_embedding(spark, d):
    return discovery.hashed_embedding(table(spark, d, "documents")).withColumn("weight", F.round("weight", 6))


@query(_VEC.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings JOIN best USING (vec_id) WHERE s < 0.55), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.25),
core AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 4), l AS (SELECT p.a, p.b FROM p SEMI JOIN core c ON c.a = p.a WHERE p.b IN (SELECT a FROM core)),
reach AS (SELECT a, a AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b), lab AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT a AS vec_id, c AS cluster_id FROM lab UNION ALL SELECT p.a, min(lab.c) FROM p JOIN lab ON lab.a = p.b WHERE p.a NOT IN (SELECT a FROM core) GROUP BY 1""")
def density_clusters(spark, d):
    return discovery.density_clusters(_residue(spark, d), 0.25)


@query()
def residue_clusters(spark, d):
    """Clusters of any density of what no topic takes, over all vectors."""
    return hierarchy.density_hierarchy(_residue(spark, d))


@query(_VEC + _CAND + ", b AS (SELECT *, s >= 0.75 AND topic_id % 4 <> 0 AS m FROM cs QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY round(s, 9) DESC, topic_id) = 1) SELECT candidate_id, CASE WHEN m THEN 'merge' ELSE 'new' END AS outcome, CASE WHEN m THEN topic_id END AS topic_id, CASE WHEN m THEN 0.75::DOUBLE ELSE 1 END AS similarity, CASE WHEN m THEN round(0.02 * list_distance(v, centroid), 6) END AS moved FROM b")
def candidate_resolution(spark, d):
    t = _topics(spark, d)[1].withColumn("pinned", F.col("topic_id") % 4 == 0)
    return discovery.candidate_resolution(_candidates(spark, d), t).withColumn("moved", F.round("moved", 6))


#: Labels of either parity are a monitor of their own; every assignment of clusters to topics, by sets of topics taken.
@query(_VEC.replace("WITH", "WITH RECURSIVE", 1) + _CAND + """, c AS (SELECT candidate_id // 10 % 2 AS monitor_id, candidate_id, topic_id, CAST(round(s * 1000000) AS BIGINT) AS s, s AS cosine,
dense_rank() OVER (PARTITION BY candidate_id // 10 % 2 ORDER BY candidate_id) AS i, CAST(1 << (dense_rank() OVER (PARTITION BY topic_id % 2 ORDER BY topic_id) - 1) AS BIGINT) AS bit FROM cs WHERE candidate_id // 10 % 2 = topic_id % 2),
o AS (SELECT DISTINCT monitor_id, i, candidate_id, NULL::INTEGER AS topic_id, 0::BIGINT AS worth, 0::BIGINT AS bit FROM c UNION ALL SELECT monitor_id, i, candidate_id, topic_id, s + 2000000, bit FROM c),
dp(monitor_id, i, taken, worth, pairs) AS (SELECT DISTINCT monitor_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, CAST([] AS BIGINT[][]) FROM c
UNION ALL SELECT dp.monitor_id, o.i, dp.taken | o.bit, max(dp.worth + o.worth), arg_max(CASE WHEN topic_id IS NULL THEN pairs ELSE list_append(pairs, [candidate_id::BIGINT, topic_id::BIGINT]) END, dp.worth + o.worth)
FROM dp JOIN o ON o.monitor_id = dp.monitor_id AND o.i = dp.i + 1 AND dp.taken & o.bit = 0 GROUP BY 1, 2, 3),
top AS (SELECT monitor_id, arg_max(pairs, (i, worth)) AS pairs FROM dp GROUP BY 1), u AS (SELECT monitor_id, unnest(pairs) AS p FROM top)
SELECT u.monitor_id, candidate_id AS cluster_id, topic_id, round(cosine, 6) AS s FROM u JOIN c ON candidate_id = p[1] AND topic_id = p[2]""")
def cluster_topic_match(spark, d):
    clusters = _candidates(spark, d).select((F.floor(F.col("candidate_id") / 10) % 2).alias("monitor_id"), F.col("candidate_id").alias("cluster_id"), "centroid")
    homes = _topics(spark, d)[1].select((F.col("topic_id") % 2).cast("long").alias("monitor_id"), "topic_id", "centroid")
    return matching.optimal_match(matching.similarities(clusters, homes)).withColumn("s", F.round("s", 6))


@query(f"WITH {FEEDBACK_SQL}, a AS (SELECT monitor_id, CASE WHEN k % 9 = 0 THEN 'manual' ELSE 'centroid' END AS method, CAST(published_at AS DATE) AS assigned_on FROM feedback WHERE topic_id IS NOT NULL), w AS (SELECT monitor_id, count(*) FILTER (WHERE method <> 'manual' AND assigned_on > DATE '2024-01-25' - 30 AND assigned_on <= DATE '2024-01-25') AS in_window FROM a GROUP BY 1) SELECT *, CASE WHEN in_window < 5 THEN 'window_too_small' ELSE 'ready' END AS status FROM w")
def refit_window(spark, d):
    a = feedback(spark, d).where("topic_id is not null").select("monitor_id", F.when(F.col("k") % 9 == 0, "manual").otherwise("centroid").alias("method"), F.to_date("published_at").alias("assigned_on"))
    return discovery.refit_window(a, F.lit("2024-01-25").cast("date"))


@query("WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS document_id, l_suppkey AS topic_id FROM lineitem), t AS (SELECT s_suppkey AS topic_id FROM supplier WHERE s_suppkey % 7 <> 0), r AS (SELECT s_suppkey AS topic_id, (s_suppkey * 3) - (s_suppkey * 3) % 2 AS into_id FROM supplier WHERE s_suppkey % 2 = 1), ok AS (SELECT r.* FROM r WHERE topic_id <> into_id AND topic_id IN (SELECT topic_id FROM t) AND into_id IN (SELECT topic_id FROM t)) SELECT document_id, coalesce(into_id, a.topic_id) AS topic_id, CASE WHEN into_id IS NOT NULL THEN a.topic_id END AS merged_from FROM a LEFT JOIN ok ON ok.topic_id = a.topic_id")
def topic_merge(spark, d):
    a = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"), F.col("l_suppkey").alias("topic_id"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("topic_id"))
    status = s.withColumn("status", F.when(F.col("topic_id") % 7 == 0, "dormant").otherwise("active"))
    into = F.col("topic_id") * 3 - F.col("topic_id") * 3 % 2
    return discovery.merge_topics(a, status, s.where("topic_id % 2 = 1").withColumn("into_id", into))


_SNAP = f"WITH {FEEDBACK_SQL}, days(taken_on, shift) AS (VALUES (DATE '2024-01-10', 0), (DATE '2024-01-17', 1), (DATE '2024-01-24', 2)), snap AS (SELECT monitor_id, taken_on, document_id, (k + CASE WHEN k % 6 < shift THEN 1 ELSE 0 END + CASE WHEN monitor_id = 'm0' AND shift = 2 AND k % 10 = 0 THEN 1 ELSE 0 END) % 8 AS topic_id FROM feedback, days WHERE bucket <= taken_on AND k IS NOT NULL)"


def _snapshots(spark, d):
    docs = feedback(spark, d).where("k is not null")
    days = F.array(*[F.struct(F.lit(x).cast("date").alias("taken_on"), F.lit(i).alias("shift")) for i, x in enumerate(("2024-01-10", "2024-01-17", "2024-01-24"))])
    met = docs.withColumn("s", F.explode(days)).where(F.col("bucket") <= F.col("s.taken_on"))
    topic = F.col("k") + F.when(F.col("k") % 6 < F.col("s.shift"), 1).otherwise(0)
    at = ("monitor_id", F.col("s.taken_on").alias("taken_on"), "document_id")
    old = met.select(*at, (topic % 8).alias("topic_id"))
    again = met.where("monitor_id = 'm0' and s.shift = 2").select(*at, ((topic + F.when(F.col("k") % 10 == 0, 1).otherwise(0)) % 8).alias("topic_id"))
    return discovery.replace_snapshots(old, again)


@query(_SNAP + " SELECT * FROM snap")
def snapshot_long(spark, d):
    return _snapshots(spark, d)


_PAIRS = _SNAP + ", sd AS (SELECT DISTINCT monitor_id, taken_on FROM snap), pr AS (SELECT monitor_id, lag(taken_on) OVER w AS earlier, taken_on AS later FROM sd WINDOW w AS (PARTITION BY monitor_id ORDER BY taken_on)), pairs AS (SELECT *, CAST(row_number() OVER (PARTITION BY monitor_id ORDER BY later DESC) AS INTEGER) AS place FROM pr WHERE earlier IS NOT NULL)"


@query(_PAIRS + " SELECT * FROM pairs WHERE place <= 5")
def snapshot_pairs(spark, d):
    return discovery.snapshot_pairs(_snapshots(spark, d), 5)


@query(_PAIRS + ", c AS (SELECT p.monitor_id, p.later, x.topic_id AS a, y.topic_id AS b, count(*) AS n FROM pairs p JOIN snap x ON x.monitor_id = p.monitor_id AND x.taken_on = p.earlier JOIN snap y ON y.monitor_id = p.monitor_id AND y.taken_on = p.later AND y.document_id = x.document_id GROUP BY 1, 2, 3, 4), rc AS (SELECT monitor_id, later, sum(n * (n - 1) / 2.0::DOUBLE) AS rc, sum(n) AS n FROM c GROUP BY 1, 2), ra AS (SELECT monitor_id, later, sum(m * (m - 1) / 2.0::DOUBLE) AS ra FROM (SELECT monitor_id, later, a, sum(n) AS m FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2), rb AS (SELECT monitor_id, later, sum(m * (m - 1) / 2.0::DOUBLE) AS rb FROM (SELECT monitor_id, later, b, sum(n) AS m FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2), x AS (SELECT *, ra * rb / (n * (n - 1) / 2.0::DOUBLE) AS ex FROM rc JOIN ra USING (monitor_id, later) JOIN rb USING (monitor_id, later)) SELECT monitor_id, round(avg((rc - ex) / ((ra + rb) / 2 - ex)), 6) AS stability, count(*) AS pairs FROM x GROUP BY 1")
def eval_stability(spark, d):
    return discovery.stability(_snapshots(spark, d), 5).withColumn("stability", F.round("stability", 6))


# ---- cycle --------------------------------------------------------------------------------------------------


@query(rf"""WITH w AS (SELECT lang AS topic_id, doc_id % 22 = 0 AS today, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents), tf AS (SELECT topic_id, term, count(*) FILTER (WHERE today) AS new, count(*) FILTER (WHERE NOT today) AS old FROM w WHERE term NOT IN ({_EN}) GROUP BY 1, 2),
i AS (SELECT *, ln(3.0::DOUBLE / (1 + (new > 0)::INT + (old > 0)::INT)) + 1 AS idf FROM tf), s AS (SELECT topic_id, term, true AS today, new * idf AS w FROM i WHERE new > 0 UNION ALL SELECT topic_id, term, false, old * idf FROM i WHERE old > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topic_id, today ORDER BY w DESC, term) <= 10), n AS (SELECT a.topic_id, count(*) AS n, count(*) FILTER (WHERE h.term IS NULL) AS f, coalesce(string_agg(a.term, ' ' ORDER BY a.term) FILTER (WHERE h.term IS NULL), '') AS terms FROM b a LEFT JOIN b h ON h.topic_id = a.topic_id AND h.term = a.term AND NOT h.today WHERE a.today GROUP BY 1)
SELECT topic_id, f / n::DOUBLE AS statistic, f / n::DOUBLE >= 0.5 AS fired, terms FROM n WHERE topic_id IN (SELECT topic_id FROM b WHERE NOT today)""")
def det_novelty(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("topic_id"), (F.col("doc_id") % 22 == 0).alias("today"), "text")
    return cycle.novelty(docs, tx.STOP_WORDS["en"])


_METHODS = ["robust_z", "poisson_exact", "kleinberg", "mann_kendall", "pelt"]


def _found(spark, d):
    e = feedback(spark, d).where("topic_id is not null")
    method = F.element_at(F.array(*[F.lit(m) for m in _METHODS]), F.col("k") % 5 + 1)
    return e.groupBy("monitor_id", "topic_id", F.to_date("published_at").alias("detected_on"), F.col("source_name").alias("kind"), method.alias("method")).agg((F.sum("k") - 200).cast("double").alias("statistic"))


@query(f"WITH {FEEDBACK_SQL}, f AS (SELECT monitor_id, topic_id, CAST(published_at AS DATE) AS detected_on, source_name AS kind, k % 5 AS m, abs(sum(k) - 200)::DOUBLE AS severity FROM feedback WHERE topic_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5) SELECT monitor_id, topic_id, detected_on, kind, ['robust_z', 'poisson_exact', 'kleinberg', 'mann_kendall', 'pelt'][m + 1] AS method, severity FROM f QUALIFY row_number() OVER (PARTITION BY monitor_id, topic_id, detected_on, kind ORDER BY m DESC) = 1")
def event_identity(spark, d):
    return cycle.event_identity(_found(spark, d), _METHODS)


@query(f"WITH {FEEDBACK_SQL}, l AS (SELECT monitor_id, source_name, CAST(bucket AS VARCHAR) AS day, kept > 0 AS ok FROM ledger) SELECT monitor_id, source_name, CASE WHEN NOT bool_or(ok) THEN 'failed' WHEN NOT bool_and(ok) THEN 'partial' ELSE 'complete' END AS status, coalesce(string_agg(day, ',' ORDER BY day) FILTER (WHERE ok), '') AS collected_on, coalesce(string_agg(day, ',' ORDER BY day) FILTER (WHERE NOT ok), '') AS failed_on FROM l GROUP BY 1, 2")
def backfill_outcome(spark, d):
    led = ledger(feedback(spark, d))
    return cycle.backfill_outcome(led.select("monitor_id", "source_name", F.col("bucket").alias("day"), (F.col("kept") > 0).alias("collected")), ["monitor_id", "source_name"])


# ---- views --------------------------------------------------------------------------------------------------


@query(f"WITH {FEEDBACK_SQL} SELECT r.monitor_id, r.bucket, r.status, count(*) AS sources, CAST(sum(l.kept) AS BIGINT) AS kept FROM runs r JOIN ledger l USING (monitor_id, bucket) GROUP BY 1, 2, 3")
def view_run_history(spark, d):
    docs = feedback(spark, d)
    return ingest.run_history(runs(docs), ledger(docs))


@query(_STATS + f", y AS (SELECT topic_id AS t, document_id, row_number() OVER (PARTITION BY topic_id, source_name ORDER BY k, document_id) AS turn, min(k) OVER (PARTITION BY topic_id, source_name) AS best, source_name FROM feedback WHERE topic_id IS NOT NULL AND is_relevant), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY turn, best, source_name) AS place FROM y) SELECT st.*, ids AS document_ids FROM st JOIN (SELECT t, list(document_id ORDER BY place) AS ids FROM r WHERE place <= 15 GROUP BY 1) ON t = st.topic_id")
def topic_context(spark, d):
    docs = feedback(spark, d)
    picked = topics.representatives(docs.where("topic_id is not null and is_relevant").select("topic_id", F.col("source_name").alias("source"), F.col("document_id").alias("vec_id"), F.col("k").alias("distance")))
    return cycle.topic_context(views.topic_statistics(_metrics(spark, d), docs), picked)


# ---- evaluation ---------------------------------------------------------------------------------------------


def _marked(spark, d):
    ev = _events(spark, d).withColumn("event_id", F.col("event_id").cast("string"))
    return ev, ev.where(F.dayofmonth("detected_on") % 5 == 0).select("monitor_id", F.col("detected_on").alias("occurred_on")).distinct()


_ARMS = "SELECT unnest([method, 'ensemble']) AS arm, monitor_id, CAST(event_id AS VARCHAR) AS event_id, detected_on FROM ev"
_NAMES = "(VALUES ('robust_z'), ('poisson_exact'), ('kleinberg'), ('pelt'), ('ensemble')) n(method)"


@query(_REV + f", arms AS ({_ARMS}), lb AS ({_LABELS}), " + _matched("SELECT arm || '|' || monitor_id AS g, event_id, detected_on FROM arms", f"SELECT method || '|' || monitor_id AS g, occurred_on FROM lb, {_NAMES}") + f""", h AS (SELECT split_part(g, '|', 1) AS method, count(*) AS hits, avg(lead_days) AS mean_lead FROM match GROUP BY 1), ne AS (SELECT arm AS method, count(*) AS events FROM arms GROUP BY 1), c AS (SELECT count(*) AS labels FROM lb)
SELECT n.method, coalesce(events, 0) AS events, coalesce(hits, 0) AS hits, coalesce(hits / nullif(events, 0)::DOUBLE, 0) AS precision, coalesce(coalesce(hits, 0) / nullif(labels, 0)::DOUBLE, 0) AS recall, mean_lead FROM {_NAMES} LEFT JOIN ne USING (method) LEFT JOIN h USING (method), c""")
def eval_detection(spark, d):
    return cycle.detection_measures(*_marked(spark, d), ["robust_z", "poisson_exact", "kleinberg", "pelt"])


@query(_ROLLUP.replace("WITH", "WITH RECURSIVE", 1) + ", " + _EV.split(FEEDBACK_SQL + ", ", 1)[1] + f""", own AS (SELECT monitor_id, bucket, topic_id, count(DISTINCT source_name) AS own FROM metrics WHERE grouping_id = 0 GROUP BY ALL), act AS (SELECT monitor_id, bucket, count(DISTINCT source_name) AS act FROM metrics WHERE grouping_id = 1 GROUP BY ALL),
sd AS (SELECT CASE WHEN round(own / act::DOUBLE, 6) >= 0.5 THEN 'wide' ELSE 'narrow' END AS side, ev.monitor_id, CAST(event_id AS VARCHAR) AS event_id, detected_on FROM ev JOIN own ON own.monitor_id = ev.monitor_id AND own.topic_id = ev.topic_id AND own.bucket = detected_on JOIN act ON act.monitor_id = ev.monitor_id AND act.bucket = detected_on), lb AS ({_LABELS}),
""" + _matched("SELECT side || '|' || monitor_id AS g, event_id, detected_on FROM sd", "SELECT side || '|' || monitor_id AS g, occurred_on FROM lb, (VALUES ('wide'), ('narrow')) n(side)") + """, h AS (SELECT split_part(g, '|', 1) AS side, count(*) AS hits FROM match GROUP BY 1), ne AS (SELECT side, count(*) AS events FROM sd GROUP BY 1)
SELECT n.side, coalesce(events, 0) AS events, coalesce(hits, 0) AS hits, coalesce(coalesce(hits, 0) / nullif(events, 0)::DOUBLE, 0) AS hit_rate FROM (VALUES ('wide'), ('narrow')) n(side) LEFT JOIN ne USING (side) LEFT JOIN h USING (side)""")
def eval_corroboration(spark, d):
    ev, lab = _marked(spark, d)
    return cycle.corroboration(ev, views.breadth_ratio(_metrics(spark, d)), lab)


@query(_ROLLUP.replace("WITH", "WITH RECURSIVE", 1) + ", t AS (SELECT topic_id, bucket, sum(doc_count)::DOUBLE AS value FROM metrics WHERE grouping_id = 2 GROUP BY 1, 2), tt AS (SELECT *, sum(value) OVER (PARTITION BY bucket) AS total FROM t), lg AS (SELECT topic_id, bucket, 'raw_count' AS arm, value AS x FROM tt UNION ALL SELECT topic_id, bucket, 'prevalence', value / total FROM tt), se AS (SELECT a.topic_id, a.arm, a.bucket, a.x, b.x AS y FROM lg a JOIN lg b ON a.topic_id = b.topic_id AND a.arm = b.arm AND b.bucket < a.bucket), mi AS (SELECT topic_id, arm, bucket, x, median(y) AS m FROM se GROUP BY 1, 2, 3, 4 HAVING count(*) >= 14), ma AS (SELECT topic_id, arm, bucket, x, m, median(abs(y - m)) * 1.4826 AS mad FROM se JOIN mi USING (topic_id, arm, bucket, x) GROUP BY 1, 2, 3, 4, 5), fi AS (SELECT topic_id, arm, count(*) AS tested, count(*) FILTER (WHERE mad > 0 AND abs(x - m) / mad >= 3.5) AS fired FROM ma GROUP BY 1, 2), res AS (SELECT topic_id, arm, round(stddev_pop(x) / avg(x), 6) AS variation, coalesce(any_value(tested), 0) AS tested, coalesce(any_value(fired), 0) AS fired, 'measured' AS status FROM lg LEFT JOIN fi USING (topic_id, arm) GROUP BY 1, 2 UNION ALL SELECT DISTINCT topic_id, 'per_author', NULL, 0, 0, 'unavailable' FROM t), al AS (SELECT topic_id || '|' || arm AS g, topic_id || '|' || arm || '|' || bucket AS event_id, bucket AS detected_on FROM ma WHERE mad > 0 AND abs(x - m) / mad >= 3.5), "
+ _matched("SELECT g, event_id, detected_on FROM al", "SELECT r.topic_id || '|' || r.arm AS g, t.bucket AS occurred_on FROM res r JOIN t ON t.topic_id = r.topic_id AND day(t.bucket) % 10 = 0")
+ ", hi AS (SELECT g, count(*) AS hits FROM match GROUP BY 1) SELECT res.*, CASE WHEN status = 'measured' AND fired > 0 THEN 1 - coalesce(hits, 0) / fired::DOUBLE END AS false_positive_rate FROM res LEFT JOIN hi ON hi.g = topic_id || '|' || arm")
def eval_normalisation(spark, d):
    m = _metrics(spark, d).where("grouping_id = 2").groupBy("topic_id", "bucket").agg(F.sum("doc_count").cast("double").alias("value"))
    total = m.groupBy("bucket").agg(F.sum("value").alias("total"))
    labels = m.where(F.dayofmonth("bucket") % 10 == 0).select("topic_id", F.col("bucket").alias("occurred_on"))
    return cycle.normalisation(m.join(total, "bucket"), labels=labels).withColumn("variation", F.round("variation", 6))


@query("SELECT f.label AS context, CASE f.vec_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'summary' ELSE 'action' END AS field, f.vec_id, round(CASE WHEN f.vec_id % 50 = 1 THEN 0 ELSE avg(list_cosine_similarity(f.embedding::DOUBLE[], e.embedding::DOUBLE[])) END, 6) AS groundedness FROM embeddings f JOIN embeddings e ON e.label = f.label AND e.vec_id % 10 <> 1 WHERE f.vec_id % 10 = 1 GROUP BY f.label, f.vec_id")
def eval_groundedness(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("label", "context")
    kind = F.element_at(F.array(F.lit("title"), F.lit("summary"), F.lit("action")), (F.col("vec_id") % 3 + 1).cast("int"))
    fields = e.where("vec_id % 10 = 1").withColumn("field", kind).withColumn("blank", F.col("vec_id") % 50 == 1)
    return cycle.groundedness(fields, e.where("vec_id % 10 <> 1")).withColumn("groundedness", F.round("groundedness", 6))


# ---- stream -------------------------------------------------------------------------------------------------


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    return daily.run_available(spark, daily.daily_counts(daily.event_stream(spark, f"{d}/events.parquet")))
