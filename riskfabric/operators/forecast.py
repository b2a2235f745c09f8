"""Short-horizon projection of country risk."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.functions.scoring import risk_band
from riskfabric.functions.text import half_even
from riskfabric.operators.store import top_per_key

DAY_US = 86_400_000_000.0


def weighted_regression(points: DataFrame, key="country", time="observed", value="score", half_life=7.0) -> DataFrame:
    """Recency-weighted slope per day (clamped to ±5) and residual RMSE; (0, 18) under two points.

    Three partial aggregations on the same key: range, weighted means, centred moments.
    """
    p = points.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("__t"), F.col(value).cast("double").alias("__y"))
    bounds = p.groupBy(key).agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"), F.count("*").alias("points"))
    rows = p.join(bounds, key).select(
        key, ((F.col("__t") - F.col("__first")) / DAY_US).alias("__x"), "__y",
        F.exp(-F.log(F.lit(2.0)) * ((F.col("__last") - F.col("__t")) / DAY_US) / half_life).alias("__w"))
    means = rows.groupBy(key).agg(F.sum("__w").alias("__sw"), (F.sum(F.col("__w") * F.col("__x")) / F.sum("__w")).alias("__mx"),
                                  (F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")).alias("__my"))
    centred = rows.join(means, key).select(key, "__w", "__sw", (F.col("__x") - F.col("__mx")).alias("__dx"), (F.col("__y") - F.col("__my")).alias("__dy"))
    moments = centred.groupBy(key).agg(
        F.max("__sw").alias("__sw"), F.sum(F.col("__w") * F.col("__dx") * F.col("__dx")).alias("__xx"),
        F.sum(F.col("__w") * F.col("__dx") * F.col("__dy")).alias("__xy"), F.sum(F.col("__w") * F.col("__dy") * F.col("__dy")).alias("__yy"))
    slope = F.coalesce(F.col("__xy") / F.nullif(F.col("__xx"), F.lit(0.0)), F.lit(0.0))
    residual = F.greatest(F.lit(0.0), F.col("__yy") - 2 * slope * F.col("__xy") + slope * slope * F.col("__xx"))
    few = F.col("points") < 2
    return (bounds.select(key, "points").join(moments, key).select(
        key, "points", F.when(few, 0.0).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(-5.0), slope))).alias("slope"),
        F.when(few, 18.0).otherwise(F.sqrt(residual / F.col("__sw"))).alias("rmse")))


def project(events: DataFrame, assessments: DataFrame, horizons=(3, 7), key="country") -> DataFrame:
    """One row per country and horizon; ``events`` need key, observed and the ``risk`` struct."""
    risk = F.col("risk")
    line = weighted_regression(events.select(key, "observed", risk["score"].alias("score")), key)
    facts = events.groupBy(key).agg(
        F.count("*").alias("evidence_count"), F.count_if((risk["source_count"] >= 2) | (risk["primary_source_count"] >= 1)).alias("corroborated_count"),
        F.avg(risk["confidence"]).alias("__confidence"),
        F.max_by(risk["score"], F.struct("observed", "url")).alias("__latest"))
    df = line.join(facts, key).join(assessments.select(key, F.col("score").alias("__assessed")), key, "left")
    baseline = F.coalesce(F.nullif(F.col("__assessed"), F.lit(0)), F.col("__latest")).cast("double")
    confidence = half_even(F.greatest(F.lit(20.0), F.least(F.lit(82.0),
        .55 * F.col("__confidence") + F.least(F.lit(18), F.col("evidence_count") * 3) + F.least(F.lit(12), F.col("corroborated_count") * 3)
        - F.least(F.lit(15.0), F.col("rmse") / 2))))
    uncertainty = half_even(F.greatest(F.lit(8.0), F.least(F.lit(30.0), 8 + F.col("rmse") + 12 / F.sqrt(F.col("evidence_count")))))
    df = df.withColumns({"baseline": baseline, "confidence": confidence, "uncertainty": uncertainty,
                         "direction": F.when(F.col("slope") >= 1.5, "Escalating").when(F.col("slope") <= -1.5, "Easing").otherwise("Broadly stable")})
    df = df.withColumn("days", F.explode(F.lit(list(horizons))))
    df = df.withColumn("score", half_even(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("baseline") + F.col("slope") * F.col("days")))))
    spread = F.least(F.lit(35), half_even(F.col("uncertainty") * F.sqrt(F.col("days") / float(min(horizons)))))
    return df.select(key, "days", "direction", F.round("slope", 2).alias("slope"), F.round("rmse", 2).alias("rmse"), "confidence", "evidence_count",
                     "corroborated_count", "score", risk_band(F.col("score")).alias("level"),
                     F.greatest(F.lit(0), F.col("score") - spread).alias("low"), F.least(F.lit(100), F.col("score") + spread).alias("high"))


def drivers(events: DataFrame, n=3, key="country") -> DataFrame:
    return top_per_key(events, [key], [F.desc("risk.score"), F.desc("observed"), F.desc("url")], n, "rank")


def scenarios(events: DataFrame, n=4, key="country") -> DataFrame:
    """Most common effects per country; equal counts resolve by name."""
    effects = events.select(key, F.explode("risk.effects").alias("outcome")).filter(~F.col("outcome").startswith("monitor for indirect"))
    counted = effects.groupBy(key, "outcome").agg(F.count("*").alias("supporting_events"))
    return top_per_key(counted, [key], [F.desc("supporting_events"), F.asc("outcome")], n, "rank")
