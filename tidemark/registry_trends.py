"""Queries of the detection cycle on planted changes: detectors, events, gates, scores, ranking, opportunities.

One SQL text, built once below, replays the whole cycle over four days; each query selects from it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixtures import FEEDBACK_SQL, PLANT_DAY, PLANTED_SQL, planted, planted_ledger, runs
from tidemark.operators import rollup, series
from tidemark.operators.discovery import cut, stored
from tidemark.plans import cycle, views
from tidemark.registry import _ROLLUP, query

KEYS = ["monitor_id", "topic_id"]
DAYS = [dt.date.fromisoformat(PLANT_DAY) - dt.timedelta(back) for back in range(series.COOLDOWN, -1, -1)]


def _day() -> Column:
    return F.lit(DAYS[-1])


# ---- the cycle in SQL -----------------------------------------------------------------------------------------

_SIMPSON = "CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def _normal_p(z: str) -> str:
    """Two-sided tail of the normal distribution, by quadrature over ten units."""
    return f"(SELECT 2 / sqrt(2 * pi()) * sum({_SIMPSON} * exp(-pow(abs({z}) + i * 0.01::DOUBLE, 2) / 2)) * 0.01::DOUBLE / 3 FROM range(0, 1001) g(i))"


def _student_p(t: str, df: str) -> str:
    """Two-sided tail of Student's distribution: with x = sqrt(df) tan(a) the density is a power of a cosine."""
    lo = f"atan(abs({t}) / sqrt({df}))"
    step = f"((pi() / 2 - {lo}) / 1000)"
    return f"(SELECT 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * sum({_SIMPSON} * pow(greatest(cos({lo} + i * {step}), 0), {df} - 1)) * {step} / 3 FROM range(0, 1001) g(i))"


def _poisson_p(k: str, lam: str, upper: bool) -> str:
    span = f"range(0, 400) g(i) WHERE {k} + i > 0 OR {k} >= 0" if upper else f"range(0, 400) g(i) WHERE i <= {k}"
    at = f"({k} + i)" if upper else "i"
    return f"(SELECT sum(exp({at} * ln({lam}) - {lam} - lgamma({at} + 1))) FROM {span})"


def _split(name: str, source: str) -> str:
    """The best split of each series in ``source`` and Welch's test there."""
    return f"""{name}r AS (SELECT monitor_id, topic_id, day, i, n, sum(value) OVER w AS s, sum(value * value) OVER w AS q, sum(value) OVER p AS als, sum(value * value) OVER p AS alq FROM {source}
  WINDOW w AS (PARTITION BY monitor_id, topic_id, day ORDER BY i), p AS (PARTITION BY monitor_id, topic_id, day)),
{name}g AS (SELECT monitor_id, topic_id, day, i AS split, n, s / i AS before, (als - s) / (n - i) AS after, greatest(0, q - s * s / i) AS s1, greatest(0, alq - q - (als - s) * (als - s) / (n - i)) AS s2, alq - als * als / n AS whole FROM {name}r WHERE i BETWEEN 4 AND n - 4),
{name}b AS (SELECT *, s1 / (split - 1) / split AS v1, s2 / (n - split - 1) / (n - split) AS v2 FROM {name}g WHERE round(whole - s1 - s2, 9) > 0 QUALIFY row_number() OVER (PARTITION BY monitor_id, topic_id, day ORDER BY round(whole - s1 - s2, 9) DESC, split) = 1),
{name}t AS (SELECT *, v1 + v2 > 0 AS varies, (after - before) / sqrt(nullif(v1 + v2, 0)) AS t, (v1 + v2) * (v1 + v2) / nullif(v1 * v1 / (split - 1) + v2 * v2 / (n - split - 1), 0) AS df FROM {name}b),
{name}p AS (SELECT *, least(1, {_student_p("t", "df")} * (n - 7)) AS p FROM {name}t WHERE varies UNION ALL SELECT *, 0 AS p FROM {name}t WHERE NOT varies),
{name} AS (SELECT * REPLACE (least({series.CERTAIN}::DOUBLE, greatest(-{series.CERTAIN}::DOUBLE, coalesce(t, sign(after - before) * {series.CERTAIN}::DOUBLE))) AS t) FROM {name}p)"""


def _recent(name: str, source: str, value: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT monitor_id, topic_id, day, bucket, {value} AS value, row_number() OVER (PARTITION BY monitor_id, topic_id, day ORDER BY bucket) AS i, count(*) OVER (PARTITION BY monitor_id, topic_id, day) AS n
  FROM {source} WHERE quality = 'clean' AND {value} IS NOT NULL AND bucket > day - 21) WHERE n >= 8)"""


_SPAN = ", ".join(f"(DATE '{d}')" for d in DAYS)
_K = "monitor_id, topic_id, day"
_CYCLE = (
    _ROLLUP.replace(FEEDBACK_SQL, PLANTED_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", t AS (SELECT monitor_id, bucket, topic_id, CAST(doc_count AS DOUBLE) AS value, quota_hit, sentiment_mean AS mood FROM metrics WHERE grouping_id = 2),
x AS (SELECT DISTINCT monitor_id, topic_id FROM t), dd AS (SELECT x.*, CAST(DATE '{PLANT_DAY}' - CAST(i AS INTEGER) AS DATE) AS bucket FROM x, range(0, 64) r(i)),
pts AS (SELECT dd.monitor_id, dd.topic_id, dd.bucket, t.value, t.mood, CASE WHEN t.value IS NULL THEN 'absent' WHEN r.status = 'partial' THEN 'partial' WHEN t.quota_hit THEN 'truncated' ELSE 'clean' END AS quality
  FROM dd LEFT JOIN t USING (monitor_id, topic_id, bucket) LEFT JOIN runs r ON r.monitor_id = dd.monitor_id AND r.bucket = dd.bucket),
days(day) AS (VALUES {_SPAN}), p AS (SELECT pts.*, day FROM pts JOIN days ON bucket <= day AND bucket > day - 60),
gt AS (SELECT {_K}, max(value) FILTER (WHERE bucket = day) AS latest, count(*) FILTER (WHERE bucket < day AND quality = 'clean' AND value IS NOT NULL) AS c, min(bucket) FILTER (WHERE value > 0) AS first_seen FROM p GROUP BY ALL),
gates AS (SELECT *, CASE WHEN coalesce(latest, -1) < 5 THEN 'below_volume_floor' WHEN c < 14 THEN 'insufficient_baseline' END AS reason FROM gt),
pc AS (SELECT p.* FROM p JOIN gates USING ({_K}) WHERE reason IS NULL), cl AS (SELECT * FROM pc WHERE quality = 'clean' AND value IS NOT NULL),
base AS (SELECT {_K}, median(value) AS m, avg(value) AS lam FROM cl WHERE bucket < day GROUP BY ALL),
mad AS (SELECT {_K}, median(abs(value - m)) * 1.4826::DOUBLE AS mad FROM cl JOIN base USING ({_K}) WHERE bucket < day GROUP BY ALL),
w AS (SELECT {_K}, median(value) AS am, count(*) AS n FROM cl GROUP BY ALL), wd AS (SELECT {_K}, isodow(bucket) AS wday, median(value) AS dm FROM cl GROUP BY ALL),
fac AS (SELECT pc.*, CASE WHEN w.n >= 14 AND w.am <> 0 AND wd.dm IS NOT NULL THEN wd.dm / w.am ELSE 1 END AS f FROM pc LEFT JOIN w USING ({_K}) LEFT JOIN wd ON wd.monitor_id = pc.monitor_id AND wd.topic_id = pc.topic_id AND wd.day = pc.day AND wd.wday = isodow(pc.bucket)),
adj AS (SELECT {_K}, bucket, quality, CASE WHEN f > 0 THEN value / f ELSE value END AS value FROM fac),
la AS (SELECT {_K}, value AS latest FROM adj WHERE bucket = day AND value IS NOT NULL),
zs AS (SELECT *, (latest - m) / mad AS z FROM la JOIN base USING ({_K}) JOIN mad USING ({_K}) WHERE mad > 0),
c1 AS (SELECT {_K}, 'burst' AS kind, 'robust_z' AS method, z AS statistic, {_normal_p("z")} AS p, latest AS observed, m AS expected, CASE WHEN z > 0 THEN 'rising' ELSE 'falling' END AS direction FROM zs WHERE abs(z) >= 3.5),
ps AS (SELECT *, floor(latest) AS k FROM la JOIN base USING ({_K}) WHERE m <= 5 AND lam > 0),
pp AS (SELECT *, CASE WHEN k >= lam THEN {_poisson_p("k", "lam", True)} ELSE {_poisson_p("k", "lam", False)} END AS p FROM ps),
c2 AS (SELECT {_K}, 'burst', 'poisson_exact', k, p, k, lam, CASE WHEN k >= lam THEN 'rising' ELSE 'falling' END FROM pp WHERE p < 0.1),
pk AS (SELECT {_K}, max(value) AS peak, any_value(lam) AS lam FROM adj JOIN base USING ({_K}) WHERE quality = 'clean' AND value IS NOT NULL AND bucket > day - 3 AND lam > 0 AND value >= lam * 1.75 GROUP BY ALL),
pk2 AS (SELECT *, floor(peak) AS k FROM pk), c3 AS (SELECT {_K}, 'burst', 'kleinberg', peak / lam, {_poisson_p("k", "lam", True)}, peak, lam, 'rising' FROM pk2),
{_recent("near", "adj", "value")}, {_recent("moods", "pc", "mood")},
pr AS (SELECT a.monitor_id, a.topic_id, a.day, sum(sign(b.value - a.value)) AS s, median((b.value - a.value) / (b.i - a.i)) AS slope, any_value(a.n) AS n FROM near a JOIN near b ON a.monitor_id = b.monitor_id AND a.topic_id = b.topic_id AND a.day = b.day AND a.i < b.i GROUP BY ALL),
ti AS (SELECT {_K}, sum(c * (c - 1) * (2 * c + 5)) AS tied FROM (SELECT {_K}, value, count(*) AS c FROM near GROUP BY ALL) GROUP BY ALL),
mz AS (SELECT *, (n * (n - 1) * (2 * n + 5) - tied) / 18.0::DOUBLE AS var FROM pr JOIN ti USING ({_K})),
mk AS (SELECT *, CASE WHEN s = 0 OR var <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END AS z FROM mz),
mp AS (SELECT *, {_normal_p("z")} AS p FROM mk),
c4 AS (SELECT {_K}, CASE WHEN z > 0 THEN 'sustained_growth' ELSE 'decline' END, 'mann_kendall', z, p, slope, 0, CASE WHEN z > 0 THEN 'rising' ELSE 'falling' END FROM mp WHERE p < 0.1),
{_split("cp", "near")}, {_split("sf", "moods")},
c5 AS (SELECT {_K}, 'changepoint', 'pelt', t, p, after, before, CASE WHEN after > before THEN 'rising' ELSE 'falling' END FROM cp WHERE p < 0.1),
c6 AS (SELECT {_K}, 'sentiment_flip', 'pelt', t, p, after, before, CASE WHEN after > before THEN 'rising' ELSE 'falling' END FROM sf WHERE p < 0.1),
c7 AS (SELECT {_K}, 'emergence', 'emergence', latest, 0, latest, 0, 'rising' FROM gates WHERE reason = 'insufficient_baseline' AND first_seen = day),
cand AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4 UNION ALL SELECT * FROM c5 UNION ALL SELECT * FROM c6 UNION ALL SELECT * FROM c7),
rk AS (SELECT *, row_number() OVER (PARTITION BY monitor_id, day ORDER BY p) AS r, count(*) OVER (PARTITION BY monitor_id, day) AS n FROM cand),
bh AS (SELECT *, coalesce(p <= max(CASE WHEN p <= r * 0.1::DOUBLE / n THEN p END) OVER (PARTITION BY monitor_id, day), false) AS kept FROM rk),
one AS (SELECT * FROM bh WHERE kept QUALIFY row_number() OVER (PARTITION BY {_K}, kind ORDER BY CASE method WHEN 'robust_z' THEN 1 WHEN 'poisson_exact' THEN 2 ELSE 3 END DESC) = 1),
ons AS (SELECT monitor_id, topic_id, kind, list(day ORDER BY day) AS ds FROM one GROUP BY ALL),
cool AS (SELECT monitor_id, topic_id, kind, ds, 1 AS i, ds[1] AS last, [ds[1]] AS kept FROM ons UNION ALL
  SELECT monitor_id, topic_id, kind, ds, i + 1, CASE WHEN ds[i + 1] - last >= 3 THEN ds[i + 1] ELSE last END, CASE WHEN ds[i + 1] - last >= 3 THEN list_append(kept, ds[i + 1]) ELSE kept END FROM cool WHERE i < len(ds)),
fires AS (SELECT monitor_id, topic_id, kind, unnest(kept) AS day FROM cool WHERE i = len(ds)),
events AS (SELECT one.*, abs(statistic) AS severity FROM one SEMI JOIN fires USING ({_K}, kind))"""
)


def _rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


_SHOWN = f"{_rounded('statistic')}, round(p, 6) AS p_value, {_rounded('observed expected')}, direction"

# ---- the cycle in Spark ---------------------------------------------------------------------------------------


def _inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, metrics, runs, and the series of volume and of sentiment."""
    docs = stored(planted(spark, d))
    metrics, ran = cut(rollup.daily_rollup(docs, planted_ledger(docs))), runs(docs)
    rows = metrics.where("grouping_id = 2").select("monitor_id", "bucket", "topic_id", F.col("doc_count").cast("double").alias("value"), "quota_hit", "sentiment_mean")
    made = series.dense_series(rows, ran, _day(), series.WINDOW + len(DAYS))
    mood = series.dense_series(rows.drop("value").withColumnRenamed("sentiment_mean", "value"), ran, _day(), series.WINDOW + len(DAYS))
    return docs, metrics, ran, cut(made), cut(mood)


def _dated(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The last day's points of the topics that pass the gates: flat ones, their baseline, sentiment."""
    *_, points, mood = _inputs(spark, d)
    passed = series.gate_outcomes(points, KEYS, _day()).where("passed").select(*KEYS)
    inside = lambda x: x.where((F.col("bucket") <= _day()) & (F.col("bucket") > F.date_sub(_day(), series.WINDOW)))
    points = inside(points).join(passed, KEYS)
    return series.deseasonalise(points, KEYS).drop("factor"), series.robust_baseline(points, KEYS, _day()), inside(mood).join(passed, KEYS)


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 6) for c in ("statistic", "p_value", "observed", "expected", "severity") if c in found.columns})


def _detector(source: str) -> str:
    return _CYCLE + f" SELECT monitor_id, topic_id, kind, method, {_SHOWN} FROM cand WHERE day = DATE '{PLANT_DAY}' AND {source}"


@query(_detector("method = 'robust_z'"))
def det_robust_z(spark, d):
    flat, base, _ = _dated(spark, d)
    return _shown(series.detect_robust_z(flat, base, KEYS, _day()))


@query(_detector("method = 'poisson_exact'"))
def det_poisson(spark, d):
    flat, base, _ = _dated(spark, d)
    return _shown(series.detect_poisson(flat, base, KEYS, _day()))


@query(_detector("method = 'kleinberg'"))
def det_burst(spark, d):
    flat, base, _ = _dated(spark, d)
    return _shown(series.detect_burst(flat, base, KEYS, _day()))


@query(_detector("method = 'mann_kendall'"))
def det_mann_kendall(spark, d):
    return _shown(series.detect_trend(_dated(spark, d)[0], KEYS, _day()))


@query(_detector("kind = 'changepoint'"))
def det_changepoint(spark, d):
    return _shown(series.detect_changepoint(_dated(spark, d)[0], KEYS, _day()))


@query(_detector("kind = 'sentiment_flip'"))
def det_sentiment_flip(spark, d):
    *_, points, mood = _inputs(spark, d)
    return _shown(cycle.sentiment_flips(points, mood, KEYS, _day()))


@query(_detector("kind = 'emergence'"))
def det_emergence(spark, d):
    return _shown(cycle.emerging(_inputs(spark, d)[3], KEYS, _day()))


@query(_CYCLE + f" SELECT monitor_id, topic_id, day, kind, method, {_SHOWN}, kept FROM bh")
def trend_candidates(spark, d):
    *_, points, mood = _inputs(spark, d)
    return _shown(cycle.corrected(points, KEYS, DAYS, sentiment=mood)).select("monitor_id", "topic_id", "day", "kind", "method", "statistic", "p_value", "observed", "expected", "direction", "kept")


def _history(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, metrics, runs, events of the four days."""
    docs, metrics, ran, points, mood = _inputs(spark, d)
    return docs, metrics, ran, cycle.event_history(points, KEYS, DAYS, sentiment=mood)


@query(_CYCLE + f" SELECT monitor_id, topic_id, day AS detected_on, kind, method, {_SHOWN}, round(severity, 6) AS severity FROM events")
def trend_events(spark, d):
    return _shown(_history(spark, d)[3])


@query(_CYCLE + f", own AS (SELECT {_K}, NULL AS kind, reason IS NULL AS passed, reason FROM gates), lost AS (SELECT {_K}, kind, bool_or(kept) AS kept FROM bh GROUP BY ALL) SELECT * FROM own UNION ALL SELECT {_K}, kind, false, CASE WHEN kept THEN 'cooldown' ELSE 'corrected_away' END FROM lost l WHERE NOT EXISTS (SELECT 1 FROM fires f WHERE f.monitor_id = l.monitor_id AND f.topic_id = l.topic_id AND f.day = l.day AND f.kind = l.kind)")
def trend_gates(spark, d):
    *_, points, mood = _inputs(spark, d)
    found = cut(cycle.corrected(points, KEYS, DAYS, sentiment=mood))
    return cycle.gate_log(points, KEYS, DAYS, found, cycle.event_history(points, KEYS, DAYS, sentiment=mood))


_NAMED = "ev AS (SELECT concat_ws('|', monitor_id, topic_id, CAST(day AS VARCHAR), kind) AS event_id, monitor_id, topic_id, day AS detected_on, method, kind FROM events)"


def _named(events: DataFrame) -> DataFrame:
    return events.withColumn("event_id", F.concat_ws("|", "monitor_id", "topic_id", F.col("detected_on").cast("string"), "kind"))


@query(_CYCLE + ", " + _NAMED + ", m AS (SELECT ev.event_id, f.document_id, row_number() OVER (PARTITION BY ev.event_id ORDER BY f.published_at DESC, f.document_id) AS r FROM ev JOIN feedback f ON f.monitor_id = ev.monitor_id AND f.topic_id = ev.topic_id AND f.is_relevant AND CAST(f.published_at AS DATE) <= detected_on AND CAST(f.published_at AS DATE) > detected_on - CASE WHEN method IN ('pelt', 'mann_kendall') THEN 7 ELSE 1 END) SELECT event_id, list(document_id ORDER BY r) AS evidence_ids FROM m WHERE r <= 5 GROUP BY 1")
def trend_evidence(spark, d):
    docs, _, _, events = _history(spark, d)
    return views.event_evidence(_named(events), docs)


@query(_CYCLE + ", " + _NAMED + " SELECT event_id, kind, detected_on FROM ev WHERE detected_on BETWEEN DATE '2024-01-28' AND DATE '2024-01-30' AND kind = 'sentiment_flip'")
def view_events(spark, d):
    return views.in_range(_named(_history(spark, d)[3]), "detected_on", "2024-01-28", "2024-01-30", "sentiment_flip").select("event_id", "kind", "detected_on")


# ---- scores ---------------------------------------------------------------------------------------------------

_SCORES = (
    _CYCLE
    + """, fam AS (SELECT monitor_id, day AS bucket, topic_id, coalesce(max(severity) FILTER (WHERE kind = 'burst'), 0) AS b, coalesce(max(severity) FILTER (WHERE kind IN ('sustained_growth', 'decline')), 0) AS g,
  coalesce(max(severity) FILTER (WHERE kind IN ('novelty', 'emergence')), 0) AS v, coalesce(max(severity) FILTER (WHERE kind = 'sentiment_flip'), 0) AS s FROM events GROUP BY ALL),
own AS (SELECT monitor_id, bucket, topic_id, count(DISTINCT source_name) AS own FROM metrics WHERE grouping_id = 0 GROUP BY ALL), act AS (SELECT monitor_id, bucket, count(DISTINCT source_name) AS act FROM metrics WHERE grouping_id = 1 GROUP BY ALL),
br AS (SELECT monitor_id, bucket, topic_id, round(own / CAST(act AS DOUBLE), 6) AS breadth FROM own JOIN act USING (monitor_id, bucket)),
raw AS (SELECT m.monitor_id, m.bucket, m.topic_id, m.author_diversity AS ad, CAST(m.doc_count AS DOUBLE) AS volume, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(v, 0) AS v, coalesce(s, 0) AS s, coalesce(breadth, 0) AS breadth
  FROM metrics m LEFT JOIN fam USING (monitor_id, bucket, topic_id) LEFT JOIN br USING (monitor_id, bucket, topic_id) WHERE m.grouping_id = 2),
nrm AS (SELECT monitor_id, bucket, topic_id, ad, volume, coalesce(b / nullif(max(b) OVER d, 0), 0) AS burst, coalesce(g / nullif(max(g) OVER d, 0), 0) AS growth, coalesce(v / nullif(max(v) OVER d, 0), 0) AS novelty, breadth, coalesce(s / nullif(max(s) OVER d, 0), 0) AS sentiment
  FROM raw WINDOW d AS (PARTITION BY monitor_id, bucket)),
sc0 AS (SELECT n.*, (0.3::DOUBLE * burst + 0.2::DOUBLE * growth + 0.15::DOUBLE * novelty + 0.2::DOUBLE * breadth + 0.15::DOUBLE * sentiment) * CASE WHEN ad < 0.5 THEN 0.5 ELSE 1 END AS value, r.status <> 'partial' AS good FROM nrm n JOIN runs r ON r.monitor_id = n.monitor_id AND r.bucket = n.bucket),
scores AS (SELECT monitor_id, bucket, topic_id, CASE WHEN good THEN round(value, 6) END AS value, CASE WHEN good THEN round(burst, 6) END AS burst, CASE WHEN good THEN round(growth, 6) END AS growth, CASE WHEN good THEN round(novelty, 6) END AS novelty,
  CASE WHEN good THEN round(breadth, 6) END AS breadth, CASE WHEN good THEN round(sentiment, 6) END AS sentiment, CASE WHEN good THEN round(volume, 6) END AS volume, CASE WHEN good AND ad < 0.5 THEN 0.5::DOUBLE END AS concentration_penalty, CASE WHEN NOT good THEN 'day_untrustworthy' END AS withheld_reason FROM sc0)"""
)
_LATEST = ", latest AS (SELECT monitor_id, topic_id, arg_max(value, bucket) AS score, arg_max(breadth, bucket) AS breadth FROM scores WHERE withheld_reason IS NULL GROUP BY ALL)"


def _scores(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, metrics, scores."""
    docs, metrics, ran, events = _history(spark, d)
    return docs, metrics, views.trend_scores(views.score_components(metrics, events), views.day_trust(ran))


@query(_SCORES + " SELECT * FROM scores")
def trend_scores(spark, d):
    return _scores(spark, d)[2]


@query(_SCORES + """, every AS (SELECT DISTINCT d.monitor_id, d.bucket, t.topic_id FROM (SELECT monitor_id, bucket FROM metrics WHERE grouping_id = 3) d JOIN (SELECT DISTINCT monitor_id, topic_id FROM metrics WHERE grouping_id = 2) t USING (monitor_id))
SELECT * FROM scores UNION ALL BY NAME SELECT e.*, CASE WHEN r.status = 'partial' THEN 'day_untrustworthy' ELSE 'no_metric_for_day' END AS withheld_reason FROM every e LEFT JOIN runs r USING (monitor_id, bucket) WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.monitor_id = e.monitor_id AND s.bucket = e.bucket AND s.topic_id = e.topic_id)""")
def trend_scores_of_all(spark, d):
    """Every topic of a monitor on each of its days: where it has no metric, why it has no score."""
    docs, metrics, ran, events = _history(spark, d)
    trust = views.day_trust(ran)
    scores = views.trend_scores(views.score_components(metrics, events), trust)
    days, known = metrics.where("grouping_id = 3").select("monitor_id", "bucket"), metrics.where("grouping_id = 2").select("monitor_id", "topic_id").distinct()
    return views.scores_of_all(scores, days.join(known, "monitor_id"), trust)


@query(_SCORES + _LATEST + """, st AS (SELECT monitor_id, topic_id, CAST(sum(doc_count) AS BIGINT) AS documents, round(avg(doc_count_share), 6) AS share, round(avg(sentiment_mean), 6) AS sentiment, round(avg(negativity_rate), 6) AS negativity FROM metrics WHERE grouping_id = 2 GROUP BY 1, 2),
ic AS (SELECT monitor_id, topic_id, intent, count(*) AS n FROM feedback WHERE topic_id IS NOT NULL AND intent IS NOT NULL GROUP BY 1, 2, 3),
mix AS (SELECT monitor_id, topic_id, string_agg(intent || '=' || printf('%.4f', n / documents::DOUBLE), ',' ORDER BY intent) AS intent_mix, sum(n) FILTER (WHERE intent IN ('feature_request', 'bug_report')) AS asks FROM ic JOIN st USING (monitor_id, topic_id) GROUP BY 1, 2),
pb AS (SELECT monitor_id, topic_id, count(DISTINCT source_name) AS own FROM metrics WHERE grouping_id = 0 GROUP BY 1, 2), pa AS (SELECT monitor_id, count(DISTINCT source_name) AS act FROM metrics WHERE grouping_id = 1 GROUP BY 1)
SELECT st.*, round(coalesce(asks, 0) / CAST(documents AS DOUBLE), 6) AS ask_share, intent_mix, round(own / CAST(act AS DOUBLE), 6) AS breadth, score FROM st LEFT JOIN mix USING (monitor_id, topic_id) LEFT JOIN pb USING (monitor_id, topic_id) LEFT JOIN pa USING (monitor_id) LEFT JOIN latest USING (monitor_id, topic_id)""")
def period_statistics(spark, d):
    docs, metrics, scores = _scores(spark, d)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("intent_mix")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    return views.period_statistics(metrics, docs, scores).withColumn("intent_mix", told)


@query(_SCORES + _LATEST + " SELECT * FROM latest")
def latest_score(spark, d):
    return views.latest_score(_scores(spark, d)[2])


@query(_SCORES + _LATEST.replace("IS NULL", "IS NULL AND bucket BETWEEN DATE '2024-01-10' AND DATE '2024-01-30'") + ", rank AS (SELECT monitor_id, topic_id, CAST(sum(doc_count) AS BIGINT) AS documents, round(avg(doc_count_share), 6) AS share, round(avg(sentiment_mean), 6) AS sentiment FROM metrics WHERE grouping_id = 2 AND bucket BETWEEN DATE '2024-01-10' AND DATE '2024-01-30' GROUP BY 1, 2) SELECT rank.*, score, breadth FROM rank LEFT JOIN latest USING (monitor_id, topic_id)")
def view_ranking(spark, d):
    _, metrics, scores = _scores(spark, d)
    return views.ranking(metrics, scores, "2024-01-10", "2024-01-30")


_PERIOD = """, asks AS (SELECT monitor_id, topic_id, count(*) AS asks FROM feedback WHERE intent IN ('feature_request', 'bug_report') GROUP BY 1, 2),
st AS (SELECT m.monitor_id, m.topic_id, sum(doc_count) AS documents, round(avg(doc_count_share), 6) AS share, round(avg(sentiment_mean), 6) AS sentiment, round(avg(negativity_rate), 6) AS negativity, round(coalesce(any_value(asks), 0) / CAST(sum(doc_count) AS DOUBLE), 6) AS ask_share FROM metrics m LEFT JOIN asks a ON a.monitor_id = m.monitor_id AND a.topic_id = m.topic_id WHERE grouping_id = 2 GROUP BY 1, 2),
pb AS (SELECT monitor_id, topic_id, count(DISTINCT source_name) AS own FROM metrics WHERE grouping_id = 0 GROUP BY 1, 2), pa AS (SELECT monitor_id, count(DISTINCT source_name) AS act FROM metrics WHERE grouping_id = 1 GROUP BY 1),
pd AS (SELECT monitor_id, topic_id, DATE '2024-01-31' - max(bucket) AS days_since FROM metrics WHERE grouping_id = 2 AND doc_count > 0 GROUP BY 1, 2)"""


@query(_SCORES + _LATEST + _PERIOD + " SELECT monitor_id, topic_id, round(0.2::DOUBLE * least(1, coalesce(share, 0)) + 0.25::DOUBLE * negativity * abs(coalesce(sentiment, 0)) + 0.2::DOUBLE * coalesce(score, 0) + 0.15::DOUBLE * (own / CAST(act AS DOUBLE)) + 0.15::DOUBLE * ask_share + 0.05::DOUBLE / (1 + days_since), 6) AS opportunity FROM st LEFT JOIN latest USING (monitor_id, topic_id) JOIN pb USING (monitor_id, topic_id) JOIN pa USING (monitor_id) JOIN pd USING (monitor_id, topic_id)")
def opportunity_score(spark, d):
    docs, metrics, scores = _scores(spark, d)
    stats = views.topic_statistics(metrics, docs).join(views.latest_score(scores).select("monitor_id", "topic_id", "score"), KEYS, "left")
    stats = stats.join(views.period_breadth(metrics), KEYS, "left").join(views.days_since(metrics, F.lit("2024-01-31").cast("date")), KEYS, "left")
    return views.opportunity_score(stats)
