"""Queries on story volume: windows, baselines, anomaly, change and early warning."""

from pyspark.sql import functions as F

from riskfabric.operators import volume
from riskfabric.plans import bindings as B
from riskfabric.plans.catalog import VIEWS, check

VIEWS["v_baseline"] = """
SELECT country, category, collected_at, cluster_count, candidate_count,
  coalesce(list(cluster_count) OVER (PARTITION BY country, category ORDER BY collected_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), []) AS baseline
FROM b_windows"""
VIEWS["v_stats"] = """
SELECT *, CAST(0 AS DOUBLE) + list_aggregate(list_transform(baseline, lambda x: abs(x - med)), 'median') AS mad,
  list_aggregate(baseline, 'stddev_pop') AS spread
FROM (SELECT *, CAST(list_aggregate(baseline, 'median') AS DOUBLE) AS med FROM v_baseline)"""
VIEWS["v_cusum"] = """
WITH RECURSIVE steps AS (
  SELECT country, category, collected_at, med, greatest(1.0, 1.4826 * mad) AS scale, 0 AS i, CAST(0 AS DOUBLE) AS c,
    list_concat(baseline[greatest(len(baseline) - 9, 1):], [cluster_count]) AS path
  FROM v_stats WHERE len(baseline) >= 5
  UNION ALL
  SELECT country, category, collected_at, med, scale, i + 1, greatest(0.0, c + (path[i + 1] - med) / scale - 0.5), path
  FROM steps WHERE i < len(path))
SELECT country, category, collected_at, round(least(100.0, c / 5 * 100), 1) AS change_score FROM steps WHERE i = len(path)"""
VIEWS["v_volume"] = """
SELECT s.country, s.category, s.collected_at, s.cluster_count, s.candidate_count, CAST(len(s.baseline) AS BIGINT) AS baseline_windows,
  CASE WHEN len(s.baseline) < 5 THEN 0.0 WHEN mad > 0 THEN round(0.6745 * (s.cluster_count - med) / mad, 2)
       WHEN spread > 0 THEN round((s.cluster_count - med) / spread, 2) ELSE 0.0 END AS anomaly,
  coalesce(c.change_score, 0.0) AS change_score,
  CASE WHEN len(s.baseline) < 5 THEN 'Baseline building' WHEN c.change_score >= 70 THEN 'Structural shift'
       WHEN c.change_score >= 40 THEN 'Developing shift' ELSE 'Stable range' END AS change_status
FROM v_stats s LEFT JOIN v_cusum c USING (country, category, collected_at)"""
VIEWS["v_warning"] = """
SELECT *, CAST(round_even(0.25 * least(100.0, greatest(0.0, anomaly) / 3 * 100) + 0.25 * persistence + 0.20 * change_score
    + 0.15 * least(100, sources * 20) + 0.15 * 57, 0) AS BIGINT) AS warning_score,
  CAST(round_even(least(95.0, 20 + least(25, sources * 5) + least(20, baseline_windows * 3) + least(20.0, persistence / 5) + 10), 0) AS BIGINT) AS confidence
FROM (SELECT *, CAST(1 + candidate_count % 5 AS BIGINT) AS sources, CAST(1 + cluster_count % 4 AS BIGINT) AS active_windows,
  CAST(round_even(least(100.0, 20 + least(40, (cluster_count % 4) * 12)
    + least(20.0, greatest(0.0, (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(collected_at)) / 3600.0) / 6)
    + least(20, (candidate_count % 5) * 4)), 0) AS BIGINT) AS persistence FROM v_volume)"""


def scored_windows(spark, folder):
    df = volume.with_robust_statistics(volume.with_baseline(B.windows(spark, folder)))
    change = volume.cusum(F.col("cluster_count"))
    return df.select("country", "category", "collected_at", "cluster_count", "candidate_count",
                     F.size("baseline").cast("bigint").alias("baseline_windows"),
                     volume.robust_z(F.col("cluster_count")).alias("anomaly"),
                     change["score"].alias("change_score"), change["status"].alias("change_status"))


def warnings(spark, folder):
    df = (scored_windows(spark, folder)
          .withColumn("sources", 1 + F.col("candidate_count") % 5).withColumn("active_windows", 1 + F.col("cluster_count") % 4))
    df = df.withColumn("persistence", volume.persistence(F.col("collected_at"), F.col("active_windows"), F.col("sources"), B.as_of()))
    w = volume.early_warning(F.col("anomaly"), F.col("persistence"), F.col("change_score"), F.col("sources"), F.lit(57), F.col("baseline_windows"))
    return df.withColumn("warning", w)


@check("volume_windows", """SELECT country, category, CAST(epoch(collected_at) AS BIGINT) AS window_start, cluster_count, candidate_count FROM b_windows""")
def volume_windows(spark, folder):
    return B.windows(spark, folder).select("country", "category", F.unix_seconds("collected_at").alias("window_start"),
                                           "cluster_count", "candidate_count")


@check("volume_baseline", """
SELECT country, category, array_to_string(list(cluster_count ORDER BY collected_at DESC), ',') AS baseline FROM (
  SELECT *, row_number() OVER (PARTITION BY country, category ORDER BY collected_at DESC) AS rn FROM b_windows) WHERE rn <= 30
GROUP BY country, category""")
def volume_baseline(spark, folder):
    return volume.latest_baseline(B.windows(spark, folder)).withColumn("baseline", F.array_join("baseline", ","))


@check("volume_anomaly", """SELECT country, category, CAST(epoch(collected_at) AS BIGINT) AS window_start, baseline_windows, anomaly FROM v_volume""")
def volume_anomaly(spark, folder):
    return scored_windows(spark, folder).select("country", "category", F.unix_seconds("collected_at").alias("window_start"),
                                                "baseline_windows", "anomaly")


@check("volume_change", """SELECT country, category, CAST(epoch(collected_at) AS BIGINT) AS window_start, change_score, change_status FROM v_volume""")
def volume_change(spark, folder):
    return scored_windows(spark, folder).select("country", "category", F.unix_seconds("collected_at").alias("window_start"),
                                                "change_score", "change_status")


@check("volume_change_reverse_walk", """
WITH RECURSIVE walk AS (
  SELECT country, category, collected_at, med, greatest(1.0, 1.4826 * mad) AS scale, 0 AS i, CAST(0 AS DOUBLE) AS c,
    list_concat(list_reverse(baseline[1:10]), [cluster_count]) AS path
  FROM v_stats WHERE len(baseline) >= 5
  UNION ALL
  SELECT country, category, collected_at, med, scale, i + 1, greatest(0.0, c + (path[i + 1] - med) / scale - 0.5), path
  FROM walk WHERE i < len(path))
SELECT country, category, CAST(epoch(collected_at) AS BIGINT) AS window_start, round(least(100.0, c / 5 * 100), 1) AS change_score
FROM walk WHERE i = len(path)""")
def volume_change_reverse_walk(spark, folder):
    df = volume.with_robust_statistics(volume.with_baseline(B.windows(spark, folder))).filter(F.size("baseline") >= 5)
    return df.select("country", "category", F.unix_seconds("collected_at").alias("window_start"),
                     volume.cusum(F.col("cluster_count"), order="reference")["score"].alias("change_score"))


@check("volume_persistence", """SELECT country, category, CAST(epoch(collected_at) AS BIGINT) AS window_start, persistence FROM v_warning""")
def volume_persistence(spark, folder):
    return warnings(spark, folder).select("country", "category", F.unix_seconds("collected_at").alias("window_start"), "persistence")


@check("volume_early_warning", """
SELECT country, category, CAST(epoch(collected_at) AS BIGINT) AS window_start, warning_score, confidence,
  CASE WHEN warning_score >= 70 THEN 'Critical' WHEN warning_score >= 45 THEN 'Elevated' WHEN warning_score >= 25 THEN 'Watch' ELSE 'Informational' END AS level,
  sources || ' distinct reporting source' || CASE WHEN sources = 1 THEN '' ELSE 's' END || '|persistence ' || persistence || '/100|change score '
    || CAST(round_even(change_score, 0) AS BIGINT) || '/100|operational relevance 57/100' ||
    CASE WHEN baseline_windows < 5 THEN '|volume baseline is still building' WHEN anomaly > 0 THEN '|news-volume anomaly robust z ' || printf('%+.2f', anomaly) ELSE '' END AS rationale
FROM v_warning""")
def volume_early_warning(spark, folder):
    w = F.col("warning")
    return warnings(spark, folder).select("country", "category", F.unix_seconds("collected_at").alias("window_start"),
                                          w["score"].alias("warning_score"), w["confidence"].alias("confidence"), w["level"].alias("level"),
                                          F.array_join(w["rationale"], "|").alias("rationale"))


@check("volume_country_anomaly_index", """
SELECT country, CAST(round_even(least(100.0, greatest(0.0, max(anomaly)) / 3 * 100), 0) AS BIGINT) AS anomaly_index FROM v_volume GROUP BY country""")
def volume_country_anomaly_index(spark, folder):
    patterns = scored_windows(spark, folder).select("country", F.col("anomaly").alias("anomaly_score"), F.col("collected_at").alias("last_seen"))
    return volume.anomaly_index(patterns, B.as_of())
