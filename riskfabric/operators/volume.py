"""Story-volume windows, their baselines, and early-warning statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskfabric.functions.scoring import alert_band, clamp
from riskfabric.functions.text import half_even, plural
from riskfabric.functions.times import age_hours


def record_windows(rows: DataFrame, candidate: str, story: str, keys=("country", "category", "collected_at")) -> DataFrame:
    """Candidate and distinct-story counts per refresh window (partially aggregated, then shuffled)."""
    return rows.groupBy(*keys).agg(F.countDistinct(story).alias("cluster_count"),
                                   F.countDistinct(candidate).alias("candidate_count"))


def with_baseline(windows: DataFrame, size=30, value="cluster_count", into="baseline") -> DataFrame:
    """Counts of up to ``size`` windows before each window, oldest first.

    The frame excludes the current row: a window never takes part in its own baseline.
    """
    frame = (W.partitionBy("country", "category").orderBy("collected_at").rowsBetween(-size, -1))
    return windows.withColumn(into, F.collect_list(value).over(frame))


def latest_baseline(windows: DataFrame, size=30, value="cluster_count") -> DataFrame:
    """Newest ``size`` counts per series, newest first."""
    rank = F.row_number().over(W.partitionBy("country", "category").orderBy(F.desc("collected_at")))
    kept = windows.withColumn("__rank", rank).filter(F.col("__rank") <= size)
    pair = F.array_sort(F.collect_list(F.struct("__rank", F.col(value).alias("v"))))
    return kept.groupBy("country", "category").agg(F.transform(pair, lambda p: p["v"]).alias("baseline"))


def median_of(values: Column) -> Column:
    """Median of a numeric array (mean of the two middle entries for even sizes)."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def with_robust_statistics(df: DataFrame, baseline="baseline") -> DataFrame:
    """Median, median absolute deviation and population deviation of the baseline array."""
    n = F.size(baseline)
    total = F.aggregate(baseline, F.lit(0.0), lambda s, x: s + x)
    mean = total / n
    spread = F.sqrt(F.aggregate(baseline, F.lit(0.0), lambda s, x: s + (x - F.col("__mean")) * (x - F.col("__mean"))) / n)
    return (df.withColumn("median", median_of(F.col(baseline)))
              .withColumn("__mean", F.when(n > 0, mean))
              .withColumn("mad", median_of(F.transform(baseline, lambda x: F.abs(x - F.col("median")))))
              .withColumn("spread", F.when(n > 0, spread)).drop("__mean"))


def robust_z(value: Column, baseline="baseline", minimum=5) -> Column:
    """Median/MAD z-score, standard deviation when MAD is zero, 0.0 for short baselines."""
    by_mad = F.round(0.6745 * (value - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0)), 2)
    by_spread = F.round((value - F.col("median")) / F.nullif(F.col("spread"), F.lit(0.0)), 2)
    return F.when(F.size(baseline) < minimum, F.lit(0.0)).otherwise(
        F.coalesce(F.when(F.col("mad") > 0, by_mad), F.when(F.col("spread") > 0, by_spread), F.lit(0.0)))


def cusum(value: Column, baseline="baseline", recent=10, minimum=5, order="chronological") -> Column:
    """One-sided robust CUSUM over the last ten windows and the current one, scaled to 0-100.

    ``order='reference'`` walks the oldest ten windows backwards in time, as a newest-first list would.
    """
    series = F.col(baseline)
    walk = (F.slice(series, F.greatest(F.size(series) - recent + 1, F.lit(1)), recent) if order == "chronological"
            else F.reverse(F.slice(series, 1, recent)))
    scale = F.greatest(F.lit(1.0), 1.4826 * F.col("mad"))
    path = F.concat(walk, F.array(value))
    total = F.aggregate(path, F.lit(0.0),
                        lambda c, x: F.greatest(F.lit(0.0), c + (x - F.col("median")) / scale - 0.5))
    short = F.size(series) < minimum
    score = F.when(short, F.lit(0.0)).otherwise(F.round(F.least(F.lit(100.0), total / 5 * 100), 1))
    status = (F.when(short, "Baseline building").when(score >= 70, "Structural shift")
               .when(score >= 40, "Developing shift").otherwise("Stable range"))
    return F.struct(score.alias("score"), status.alias("status"))


def persistence(first_seen: Column, active_windows: Column, source_count: Column, as_of: Column) -> Column:
    """0-100 score of how long and how widely a story has been active."""
    age = F.coalesce(age_hours(as_of, first_seen), F.lit(0.0))
    windows = F.least(F.lit(40), F.greatest(F.lit(0), active_windows - 1) * 12)
    sources = F.least(F.lit(20), F.greatest(F.lit(0), source_count - 1) * 4)
    return half_even(F.least(F.lit(100.0), 20 + windows + F.least(F.lit(20.0), age / 6) + sources))


def early_warning(anomaly: Column, persistence_value: Column, change: Column, source_count: Column, relevance: Column,
                  baseline_windows: Column) -> Column:
    """Weighted warning score with level, confidence and the reasons behind it."""
    anomaly_part = F.least(F.lit(100.0), F.greatest(F.lit(0.0), anomaly) / 3 * 100)
    source_part = F.least(F.lit(100), source_count * 20)
    score = half_even(0.25 * anomaly_part + 0.25 * persistence_value + 0.20 * change + 0.15 * source_part + 0.15 * relevance)
    confidence = half_even(F.least(F.lit(95.0), 20 + F.least(F.lit(25), source_count * 5)
                                   + F.least(F.lit(20), baseline_windows * 3) + F.least(F.lit(20.0), persistence_value / 5)
                                   + F.when(relevance >= 50, 10).otherwise(0)))
    whole = lambda c: half_even(c.cast("double")).cast("string")
    why = F.array_compact(F.array(
        F.concat(source_count.cast("string"), F.lit(" distinct reporting "), plural(source_count, "source")),
        F.concat(F.lit("persistence "), whole(persistence_value), F.lit("/100")),
        F.concat(F.lit("change score "), whole(change), F.lit("/100")),
        F.concat(F.lit("operational relevance "), whole(relevance), F.lit("/100")),
        F.when(baseline_windows < 5, "volume baseline is still building")
         .when(anomaly > 0, F.concat(F.lit("news-volume anomaly robust z "), F.format_string("%+.2f", anomaly)))))
    return F.struct(score.alias("score"), alert_band(score).alias("level"), confidence.alias("confidence"), why.alias("rationale"))


def anomaly_index(patterns: DataFrame, as_of: Column, max_age_days=30) -> DataFrame:
    """Strongest positive anomaly of each country on a 0-100 scale."""
    recent = patterns.filter(F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(max_age_days)))
    peak = F.coalesce(F.max("anomaly_score"), F.lit(0.0))
    return recent.groupBy("country").agg(
        half_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), peak) / 3 * 100)).alias("anomaly_index"))
