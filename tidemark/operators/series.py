"""Daily series of topics: dense calendars, gates, baselines, weekly seasonality, detectors, correction, events.

Points are (keys, bucket, value, quality); all keys go through every step at once. Windows are bounded
(60 days), so groups are small whatever the number of topics. The day that is tested may itself be one of the
keys (``as_of``), so that one job covers many days.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats

WINDOW, RECENT, MIN_CLEAN, FLOOR, Z, ALPHA, COOLDOWN = 60, 21, 14, 5, 3.5, 0.1, 3
MAD_TO_STD = 1.4826
#: The largest size of a changepoint's statistic: where neither side varies, t has no bound, and a score of the day's largest severity needs one.
CERTAIN = 1000.0


def dense_series(metrics: DataFrame, runs: DataFrame, end: Column, window: int = WINDOW) -> DataFrame:
    """One point for each topic and day of the window; a missing day is absent, not zero."""
    topics = metrics.select("monitor_id", "topic_id").distinct()
    days = topics.withColumn("bucket", F.explode(F.sequence(F.date_sub(end, window - 1), end)))
    met = days.join(metrics, ["monitor_id", "topic_id", "bucket"], "left").join(runs, ["monitor_id", "bucket"], "left")
    quality = F.when(F.col("value").isNull(), "absent").when(F.col("status") == "partial", "partial").when(F.col("quota_hit"), "truncated").otherwise("clean")
    return met.select("monitor_id", "topic_id", "bucket", "value", quality.alias("quality"))


def as_of(points: DataFrame, days: list, window: int = WINDOW, name: str = "day") -> DataFrame:
    """points once for each of the days, as far as that day's window reaches back, with the day as a column."""
    each = points.withColumn(name, F.explode(F.array(*[F.lit(d).cast("date") for d in days])))
    return each.where((F.col("bucket") <= F.col(name)) & (F.col("bucket") > F.date_sub(F.col(name), window)))


def _clean(points: DataFrame) -> DataFrame:
    return points.where("quality = 'clean' and value is not null")


def robust_baseline(points: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Median, scaled MAD, mean and count of the clean points before the day."""
    past = _clean(points).where(F.col("bucket") < day)
    mid = past.groupBy(*keys).agg(F.expr("median(value)").alias("median"), F.avg("value").alias("lambda"), F.count("*").alias("clean_days"))
    mad = past.join(mid, keys).groupBy(*keys).agg((F.expr("median(abs(value - median))") * MAD_TO_STD).alias("mad"))
    return mid.join(mad, keys)


def gate_outcomes(points: DataFrame, keys: list[str], day: Column, floor: float = FLOOR, least: int = MIN_CLEAN) -> DataFrame:
    """Volume floor first, then enough clean history; every topic gets a row."""
    by = points.where(F.col("bucket") <= day).groupBy(*keys).agg(
        F.max(F.when(F.col("bucket") == day, F.col("value"))).alias("latest"), F.count_if((F.col("bucket") < day) & (F.col("quality") == "clean") & F.col("value").isNotNull()).alias("clean_days")
    )
    reason = F.when(F.coalesce("latest", F.lit(-1.0)) < floor, "below_volume_floor").when(F.col("clean_days") < least, "insufficient_baseline")
    return by.select(*keys, reason.isNull().alias("passed"), reason.alias("reason"), F.col("clean_days").cast("long").alias("clean_days"))


def deseasonalise(points: DataFrame, keys: list[str]) -> DataFrame:
    """Values over their weekday's factor; left alone with under 14 clean points, a zero median or factor."""
    clean = _clean(points)
    whole = clean.groupBy(*keys).agg(F.expr("median(value)").alias("all_median"), F.count("*").alias("n"))
    days = clean.groupBy(*keys, F.weekday("bucket").alias("weekday")).agg(F.expr("median(value)").alias("day_median"))
    met = points.withColumn("weekday", F.weekday("bucket")).join(whole, keys, "left").join(days, [*keys, "weekday"], "left")
    factor = F.when((F.col("n") >= 14) & (F.col("all_median") != 0) & F.col("day_median").isNotNull(), F.col("day_median") / F.col("all_median")).otherwise(F.lit(1.0))
    return met.withColumn("factor", factor).select(*keys, "bucket", F.when(F.col("factor") > 0, F.col("value") / F.col("factor")).otherwise(F.col("value")).alias("value"), "quality", "factor")


def _latest(points: DataFrame, keys: list[str], day: Column) -> DataFrame:
    return points.where(F.col("bucket") == day).select(*keys, F.col("value").alias("latest"))


def _found(df: DataFrame, keys: list[str], kind: str | Column, method: str, statistic: Column, p: Column, observed: Column, expected: Column, direction: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(*keys, kind.alias("kind"), F.lit(method).alias("method"), statistic.cast("double").alias("statistic"), p.cast("double").alias("p_value"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"), direction.alias("direction"))


def detect_robust_z(points: DataFrame, base: DataFrame, keys: list[str], day: Column, threshold: float = Z) -> DataFrame:
    met = _latest(points, keys, day).join(base, keys).where("mad > 0 and latest is not null").withColumn("z", (F.col("latest") - F.col("median")) / F.col("mad")).where(F.abs("z") >= threshold)
    return _found(met, keys, "burst", "robust_z", F.col("z"), stats.normal_p("z"), F.col("latest"), F.col("median"), F.when(F.col("z") > 0, "rising").otherwise("falling"))


def detect_poisson(points: DataFrame, base: DataFrame, keys: list[str], day: Column, alpha: float = ALPHA) -> DataFrame:
    met = _latest(points, keys, day).join(base, keys).where("latest is not null and median <= 5 and lambda > 0").withColumn("k", F.col("latest").cast("int").cast("double"))
    met = met.withColumn("p", stats.poisson_p("k", "lambda")).where(F.col("p") < alpha)
    return _found(met, keys, "burst", "poisson_exact", F.col("k"), F.col("p"), F.col("k"), F.col("lambda"), F.when(F.col("k") >= F.col("lambda"), "rising").otherwise("falling"))


def detect_burst(points: DataFrame, base: DataFrame, keys: list[str], day: Column, scale: float = Z / 2, back: int = 3) -> DataFrame:
    """The peak of the clean points of the last days that reach scale times the mean."""
    near = _clean(points).where((F.col("bucket") <= day) & (F.col("bucket") > F.date_sub(day, back)))
    met = near.join(base, keys).where((F.col("lambda") > 0) & (F.col("value") >= F.col("lambda") * scale)).groupBy(*keys).agg(F.max("value").alias("peak"), F.first("lambda").alias("lambda"))
    return _found(met, keys, "burst", "kleinberg", F.col("peak") / F.col("lambda"), stats.poisson_upper_p("peak", "lambda"), F.col("peak"), F.col("lambda"), F.lit("rising"))


def recent_clean(points: DataFrame, keys: list[str], day: Column, recent: int = RECENT, least: int = 8) -> DataFrame:
    """Clean points of the last positions, numbered without gaps, where there are enough of them."""
    near = _clean(points).where((F.col("bucket") <= day) & (F.col("bucket") > F.date_sub(day, recent)))
    numbered = near.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("bucket"))).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return numbered.where(F.col("n") >= least).select(*keys, "bucket", "value", "i", "n")


def mann_kendall(near: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s, z, slope: pairs within windows of at most ``RECENT`` points; ties shrink the variance."""
    a, b = near.alias("a"), near.alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]) & (F.col("a.i") < F.col("b.i"))
    pairs = a.join(b, cond).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(
        F.sum(F.signum(F.col("b.value") - F.col("a.value"))).alias("s"), F.expr("median((b.value - a.value) / (b.i - a.i))").alias("slope"), F.first("a.n").alias("n")
    )
    ties = near.groupBy(*keys, "value").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("tied"))
    var = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("tied")) / 18
    z = F.when((F.col("s") == 0) | (var <= 0), 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt(var))
    return pairs.join(ties, keys).select(*keys, "s", z.alias("z"), "slope")


def detect_trend(points: DataFrame, keys: list[str], day: Column, alpha: float = ALPHA) -> DataFrame:
    met = mann_kendall(recent_clean(points, keys, day), keys).withColumn("p", stats.normal_p("z")).where(F.col("p") < alpha)
    up = F.col("z") > 0
    return _found(met, keys, F.when(up, "sustained_growth").otherwise("decline"), "mann_kendall", F.col("z"), F.col("p"), F.col("slope"), F.lit(0.0), F.when(up, "rising").otherwise("falling"))


def best_split(near: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """The split of each series that takes most off the squared error: running sums, one pass."""
    w = Window.partitionBy(*keys).orderBy("i")
    whole = Window.partitionBy(*keys)
    run = near.withColumn("s", F.sum("value").over(w)).withColumn("q", F.sum(F.col("value") * F.col("value")).over(w)).withColumn("all_s", F.sum("value").over(whole)).withColumn("all_q", F.sum(F.col("value") * F.col("value")).over(whole))
    run = run.where((F.col("i") >= least) & (F.col("i") <= F.col("n") - least))
    n1, n2 = F.col("i"), F.col("n") - F.col("i")
    m1, m2 = F.col("s") / n1, (F.col("all_s") - F.col("s")) / n2
    ss1, ss2 = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * m1), F.greatest(F.lit(0.0), F.col("all_q") - F.col("q") - (F.col("all_s") - F.col("s")) * m2)
    gain = F.col("all_q") - F.col("all_s") * F.col("all_s") / F.col("n") - ss1 - ss2
    run = run.select(*keys, "n", F.col("i").alias("split"), m1.alias("before"), m2.alias("after"), (ss1 / (n1 - 1) / n1).alias("v1"), (ss2 / (n2 - 1) / n2).alias("v2"), F.round(gain, 9).alias("gain"))
    order = Window.partitionBy(*keys).orderBy(F.desc("gain"), "split")
    best = run.withColumn("nth", F.row_number().over(order)).where("nth = 1 and gain > 0")
    v = F.col("v1") + F.col("v2")
    df = v * v / (F.col("v1") * F.col("v1") / (F.col("split") - 1) + F.col("v2") * F.col("v2") / (F.col("n") - F.col("split") - 1))
    t = (F.col("after") - F.col("before")) / F.sqrt(v)
    return best.select(*keys, "split", "before", "after", (F.col("n") - 7).alias("splits"), F.when(v > 0, t).alias("t"), F.when(v > 0, df).alias("df"))


def detect_changepoint(points: DataFrame, keys: list[str], day: Column, alpha: float = ALPHA, kind: str = "changepoint") -> DataFrame:
    """Welch's test at the best split, times the number of splits tried; no variance on either side is certainty, of a bounded size."""
    met = best_split(recent_clean(points, keys, day), keys).withColumn("p", F.when(F.col("t").isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), stats.student_p("t", "df") * F.col("splits")))).where(F.col("p") < alpha)
    return _found(met, keys, kind, "pelt", F.least(F.lit(CERTAIN), F.greatest(F.lit(-CERTAIN), F.coalesce("t", F.signum(F.col("after") - F.col("before")) * CERTAIN))), F.col("p"), F.col("after"), F.col("before"), F.when(F.col("after") > F.col("before"), "rising").otherwise("falling"))


def detectors(points: DataFrame, keys: list[str], day: Column) -> dict[str, Callable[[], DataFrame]]:
    """The ensemble over the topics that pass the gates, by name: baseline of the raw series, tests on the deseasonalised one."""
    passed = gate_outcomes(points, keys, day).where("passed").select(*keys)
    points = points.join(passed, keys)
    base, flat = robust_baseline(points, keys, day), deseasonalise(points, keys).drop("factor")
    return {
        "robust_z": lambda: detect_robust_z(flat, base, keys, day), "poisson_exact": lambda: detect_poisson(flat, base, keys, day), "kleinberg": lambda: detect_burst(flat, base, keys, day),
        "mann_kendall": lambda: detect_trend(flat, keys, day), "pelt": lambda: detect_changepoint(flat, keys, day),
    }


def trend_candidates(points: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """All detectors of the ensemble."""
    return reduce(DataFrame.unionByName, [find() for find in detectors(points, keys, day).values()])


def bh_correction(candidates: DataFrame, family: list[str], alpha: float = 0.1) -> DataFrame:
    """Benjamini-Hochberg within a family: reject up to the largest rank whose p is under its line."""
    order = Window.partitionBy(*family).orderBy("p_value")
    whole = Window.partitionBy(*family)
    ranked = candidates.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    ranked = ranked.withColumn("last", F.max(F.when(F.col("p_value") <= F.col("rank") * alpha / F.col("n"), F.col("rank"))).over(whole))
    return ranked.withColumn("kept", F.coalesce(F.col("rank") <= F.col("last"), F.lit(False))).drop("last")


def cooldown(candidates: DataFrame, events: DataFrame, keys: list[str], day: Column, days: int = COOLDOWN) -> DataFrame:
    """Candidates whose key and kind did not fire in the last days."""
    past = events.where((F.col("detected_on") < day) & (F.col("detected_on") >= F.date_sub(day, days * 4))).groupBy(*keys, "kind").agg(F.max("detected_on").alias("last_on"))
    return candidates.join(past, [*keys, "kind"], "left").where(F.col("last_on").isNull() | (F.datediff(day, "last_on") >= days)).drop("last_on")


def cooldown_history(found: DataFrame, keys: list[str], days: int = COOLDOWN) -> DataFrame:
    """Of (keys, kind, detected_on): which days fire, each at rest for ``days`` after one that fired; over any span in one pass.

    A group is the days of one key and kind, in order: a fold keeps the last one that fired.
    """
    by = found.groupBy(*keys, "kind").agg(F.array_sort(F.collect_set("detected_on")).alias("on"))
    none = F.lit(None).cast("date")
    start = F.struct(none.alias("last"), F.expr("cast(array() as array<date>)").alias("kept"))
    fires = lambda s, d: s["last"].isNull() | (F.datediff(d, s["last"]) >= days)
    fold = F.aggregate("on", start, lambda s, d: F.struct(F.when(fires(s, d), d).otherwise(s["last"]).alias("last"), F.when(fires(s, d), F.concat(s["kept"], F.array(d))).otherwise(s["kept"]).alias("kept")))
    return by.select(*keys, "kind", F.explode(fold["kept"]).alias("detected_on"))


def collapse_events(kept: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """One event for each key and kind; of several burst methods the last in detector order stays."""
    order = F.when(F.col("method") == "robust_z", 1).when(F.col("method") == "poisson_exact", 2).otherwise(3)
    by = kept.groupBy(*keys, "kind").agg(F.max_by(F.struct("method", "statistic", "p_value", "observed", "expected", "direction"), order).alias("e"))
    return by.select(*keys, day.alias("detected_on"), "kind", "e.*").withColumn("severity", F.abs("statistic"))
