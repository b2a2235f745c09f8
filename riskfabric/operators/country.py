"""Country risk: events, sensors, exposure and anomaly combined for every country in one job.

The scoring window (newest ten events per country) is cut first, with a bounded row_number that
Spark limits before shuffling. Everything after it works on at most ten rows per country; sensors stay
distributed and meet the window as one small array per country.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions.scoring import risk_band, severity_score
from riskfabric.functions.text import half_even, hits, phrase, word_set
from riskfabric.operators.scoring import transport_mode
from riskfabric.operators.store import top_per_key
from riskfabric.session import cut


def newest_events(articles: DataFrame, size=10, time="published_at", tie="url") -> DataFrame:
    """The newest ``size`` events per country, before they are scored."""
    return top_per_key(articles, ["country"], [F.desc(time), F.desc(tie)], size)


def scoring_window(articles: DataFrame, size=10, time="published_at", tie="url") -> DataFrame:
    """Newest ``size`` scored events per country with their recency weight."""
    rank = F.row_number().over(W.partitionBy("country").orderBy(F.desc(time), F.desc(tie)))
    risk = F.col("risk")
    credible = (((risk["source_count"] >= 2) | (risk["primary_source_count"] >= 1))
                & ((F.size(risk["operational_terms"]) > 0) | risk["inferred_route_exposure"]))
    return (articles.withColumn("position", rank).filter(F.col("position") <= size)
            .withColumn("weight", F.pow(F.lit(0.9), F.col("position") - 1)).withColumn("credible", credible))


def signal_corroboration(signals: DataFrame, window: DataFrame, stopwords=V.SIGNAL_STOPWORDS, minimum=2) -> DataFrame:
    """Per located signal: how many events of its country share at least two of its words, and the best overlap.

    ``signals`` has ``matched_country``; ``window`` holds at most ten events per country.
    """
    events = window.groupBy("country").agg(F.collect_list(word_set(F.col("headline"))).alias("__events"))
    own = word_set(phrase(F.col("event_type"), F.col("title"), F.col("summary")))
    ignore = F.array_union(word_set(F.col("matched_country")), F.lit(list(stopwords)))
    tokens = signals.withColumn("__words", F.array_except(own, ignore))
    joined = tokens.join(events.withColumnRenamed("country", "matched_country"), "matched_country", "left")
    joined = joined.withColumn("__shared", F.transform("__events", lambda e: F.size(F.array_intersect(e, F.col("__words")))))
    good = F.filter("__shared", lambda n: n >= minimum)
    return (joined.withColumn("support_count", F.coalesce(F.when(F.col("__shared").isNotNull(), F.size(good)), F.lit(0)).cast("bigint"))
                  .withColumn("best_overlap", F.coalesce(F.array_max(good), F.lit(0)).cast("bigint"))
                  .drop("__events", "__words", "__shared"))


def select_sensor(corroborated: DataFrame) -> DataFrame:
    """Per country the sensor that counts: supported first, then severity, then overlap; newest on ties."""
    best = F.max_by(F.struct("id", "source", "title", "severity", "confidence", "support_count", "best_overlap", F.col("summary").alias("sensor_summary")),
                    F.struct((F.col("support_count") > 0).alias("s"), severity_score(F.col("severity")).alias("v"), F.col("best_overlap").alias("o"),
                             F.col("observed_at").alias("t"), F.col("id").alias("i")))
    strongest = F.max_by(F.struct("id", "source", "title", "severity", "confidence", F.col("summary").alias("sensor_summary")),
                         F.struct(severity_score(F.col("severity")).alias("v"), F.col("observed_at").alias("t"), F.col("id").alias("i")))
    return (corroborated.groupBy(F.col("matched_country").alias("country"))
            .agg(best.alias("sensor"), strongest.alias("strongest_sensor"), F.count("*").alias("sensor_count"))
            .withColumn("sensor_status", F.when(F.col("sensor.support_count") > 0, "Corroborated").otherwise("Provisional")))


def event_statistics(window: DataFrame) -> DataFrame:
    """Everything the country score needs from its (at most ten) events."""
    risk, weight = F.col("risk"), F.col("weight")
    credible = F.col("credible")
    strongest = F.max_by(F.struct(risk.alias("risk"), "headline"),
                         F.struct(credible.alias("c"), risk["score"].alias("s"), (-F.col("position")).alias("p")))
    credible_weight = F.sum(F.when(credible, weight))
    top3 = F.slice(F.sort_array(F.collect_list(F.struct(risk["score"].alias("score"), (-F.col("position")).alias("p"), credible.alias("credible"))), asc=False), 1, 3)
    head3 = F.slice(F.array_sort(F.collect_list(F.struct("position", "headline"))), 1, 3)
    ordered = F.sort_array(F.collect_list(F.struct("position", weight.alias("w"), risk["score"].alias("s"), risk["confidence"].alias("c"), credible.alias("k"))))
    return (window.groupBy("country").agg(
        strongest.alias("strongest"), ordered.alias("events"), top3.alias("top3"), head3.alias("head3"), F.count("*").alias("window_size"),
        F.count_if(credible).alias("credible_count"),
        F.max(credible & risk["level"].isin("Moderate", "Critical")).alias("credible_moderate"),
        F.max(F.size(risk["operational_terms"]) > 0).alias("any_operational"), F.collect_set(risk["mode"]).alias("modes")))


def _weighted(value: str, condition=None) -> Column:
    """Weighted mean over the ordered events; the order keeps the floating sum reproducible."""
    events = F.filter("events", condition) if condition else F.col("events")
    total = lambda f: F.aggregate(events, F.lit(0.0), lambda acc, e: acc + f(e))
    return total(lambda e: e["w"] * e[value]) / total(lambda e: e["w"])


def mode_rollup(modes: Column) -> Column:
    has = lambda m: F.array_contains(modes, m)
    return (F.when(has("Maritime and aviation") | (has("Maritime") & has("Aviation")), "Maritime and aviation")
             .when(has("Maritime"), "Maritime").when(has("Aviation"), "Aviation").otherwise("Multimodal / indirect"))


def event_likelihood(risk: Column, sensor_status: Column) -> Column:
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    count = risk["source_count"]
    total = (15 + points((F.size(risk["operational_terms"]) > 0) | risk["inferred_route_exposure"], 35) + points(count >= 2, 20)
             + points(risk["primary_source_count"] >= 1, 15) + F.least(F.lit(15), F.greatest(F.lit(0), count - 1) * 5)
             + points(sensor_status == "Corroborated", 10))
    return F.least(F.lit(100), total).cast("bigint")


def assess(countries: DataFrame, window: DataFrame, signals: DataFrame, exposures: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Risk of every country.

    ``countries`` (country) is the dimension; ``window`` comes from ``scoring_window``; ``signals`` carry
    ``matched_country``; ``exposures`` (country, exposure_index) and ``anomalies`` (country, anomaly_index)
    have at most one row per country. All joins are on the country key.
    """
    window = cut(window)  # at most ten rows per country, read by the two branches below
    sensors = select_sensor(signal_corroboration(signals, window))
    df = (countries.select("country").join(event_statistics(window), "country", "left").join(sensors, "country", "left")
          .join(exposures.select("country", "exposure_index"), "country", "left").join(anomalies.select("country", "anomaly_index"), "country", "left"))
    risk = F.col("strongest.risk")
    has_events, has_sensor = F.col("window_size").isNotNull(), F.col("sensor_count").isNotNull()
    df = df.withColumn("sensor_status", F.coalesce("sensor_status", F.lit("None")))
    credible_only = lambda e: e["k"]
    total_weight = F.aggregate(F.filter("events", credible_only), F.lit(0.0), lambda acc, e: acc + e["w"])
    df = df.withColumns({"__mean": F.when(F.col("credible_count") > 0, _weighted("s", credible_only)),
                         "concurrency_bonus": F.when(F.col("credible_count") > 0, F.least(F.lit(12), F.greatest(F.lit(0), half_even((total_weight - 1) * 3)))).otherwise(0).cast("bigint"),
                         "recency_score": half_even(_weighted("s")), "event_confidence": half_even(_weighted("c")),
                         "likelihood": event_likelihood(risk, F.col("sensor_status")),
                         "anomaly_component": F.coalesce("anomaly_index", F.lit(0)).cast("bigint")})
    df = df.withColumn("credible_event", F.when(F.col("credible_count") > 0, F.least(F.lit(100), half_even(
        .70 * risk["score"] + .30 * F.col("__mean") + F.col("concurrency_bonus")))).otherwise(F.least(F.lit(37), risk["score"])).cast("bigint"))
    df = df.withColumn("likelihood_impact", half_even(F.col("likelihood") * F.col("credible_event") / 100))
    generic = F.col("credible_event") * .50 + F.col("likelihood_impact") * .286 + F.col("anomaly_component") * .214
    aware = (F.col("credible_event") * .35 + F.col("exposure_index") * .30 + F.col("likelihood_impact") * .20 + F.col("anomaly_component") * .15)
    df = df.withColumn("hybrid", half_even(F.when(F.col("exposure_index").isNull(), generic).otherwise(aware)))
    df = df.withColumn("banded", F.when(F.col("credible_moderate"), F.greatest(F.col("hybrid"), F.lit(38)))
                       .when(F.col("sensor_status") != "Corroborated", F.least(F.col("hybrid"), F.lit(37))).otherwise(F.col("hybrid")))
    top3_mean = half_even(F.aggregate("top3", F.lit(0.0), lambda a, e: a + e["score"]) / F.size("top3"))
    df = df.withColumn("top_three_mean", top3_mean)
    severe = ((risk["level"] == "Critical") & (risk["score"] >= 70) & (risk["source_count"] >= 2)
              & ((F.size(risk["operational_terms"]) > 0) | risk["inferred_route_exposure"]))
    concurrent = (F.size("top3") == 3) & (F.col("top_three_mean") >= 65) & F.forall("top3", lambda e: e["credible"])
    critical_sensor = (F.col("sensor_status") == "Corroborated") & (F.col("sensor.severity") == "Critical") & F.col("any_operational")
    floor = F.when(severe, 75).when(concurrent, 70).when(critical_sensor, 72)
    reason = (F.when(severe, "severe corroborated event").when(concurrent, "concurrent high-impact events").when(critical_sensor, "corroborated critical sensor").otherwise(""))
    sensor_only = half_even(severity_score(F.col("strongest_sensor.severity")) * .35)
    score = F.when(has_events, F.coalesce(F.greatest(F.col("banded"), floor), F.col("banded"))).when(has_sensor, sensor_only).otherwise(0)
    confidence = (F.when(has_events, F.col("event_confidence")).when(has_sensor, F.least(F.lit(45), F.coalesce(F.col("strongest_sensor.confidence"), F.lit(60)))).otherwise(15))
    spread = F.greatest(F.lit(5), 15 - F.least(F.lit(8), F.col("window_size")))
    df = df.withColumns({"score": score.cast("bigint"), "confidence": confidence.cast("bigint")})
    low = F.when(has_events, F.col("confidence") - spread).when(has_sensor, F.col("confidence") - 12).otherwise(5)
    high = F.when(has_events, F.col("confidence") + spread).when(has_sensor, F.col("confidence") + 8).otherwise(30)
    heads = F.array_join(F.transform("head3", lambda h: h["headline"]), "; ")
    level = risk_band(F.col("score"))
    summary = (F.when(has_events, F.concat(F.lit("Latest reporting indicates "), F.lower(level), F.lit(" supply-chain risk for "), F.col("country"), F.lit(". Principal signals: "), heads))
                .when(has_sensor, F.concat(F.col("strongest_sensor.source"), F.lit(" reports "), F.col("strongest_sensor.title"), F.lit(
                    ". This is a provisional operational signal because no independent country reporting currently corroborates it.")))
                .otherwise("No fresh country-specific reporting is stored. Refresh this country before treating the low marker as an assessment."))
    said = word_set(phrase(F.col("strongest_sensor.title"), F.col("strongest_sensor.sensor_summary")))
    sensor_mode = transport_mode(F.size(hits(said, V.MARITIME)) > 0, F.size(hits(said, V.AVIATION)) > 0)
    model = (F.when(~has_events & has_sensor, "Provisional sensor only").when(~has_events, "Insufficient evidence")
              .when(F.col("exposure_index").isNull(), "Generic hybrid (company exposure not configured)").otherwise("Exposure-aware hybrid"))
    return df.select(
        "country", level.alias("level"), "score", "confidence", F.greatest(F.lit(0), low).cast("bigint").alias("confidence_low"),
        F.least(F.lit(100), high).cast("bigint").alias("confidence_high"),
        F.when(has_events, mode_rollup(F.col("modes"))).when(has_sensor, sensor_mode).otherwise("Insufficient evidence").alias("mode"), summary.alias("summary"),
        F.coalesce("window_size", "sensor_count", F.lit(0)).cast("bigint").alias("evidence_count"), "sensor_status",
        F.when(F.col("sensor_status") == "Corroborated", 25).when(F.col("sensor_status") == "Provisional", F.when(has_events, 5).otherwise(0)).otherwise(0).cast("bigint").alias("sensor_weight"),
        F.when(has_events, reason).otherwise("").alias("escalation"), model.alias("model"), "credible_event", "likelihood",
        "likelihood_impact", "anomaly_component", F.col("exposure_index").alias("exposure_component"), "recency_score", "top_three_mean",
        F.coalesce("credible_count", F.lit(0)).cast("bigint").alias("credible_count"), F.coalesce("concurrency_bonus", F.lit(0)).alias("concurrency_bonus"),
        F.coalesce(half_even(F.col("__mean")), F.lit(0)).alias("credible_mean"))


def choropleth(assessment: DataFrame, dimension: DataFrame) -> DataFrame:
    """Map table: ISO-3 code, level code, score, confidence and evidence count."""
    code = F.when(F.col("level") == "Critical", 2).when(F.col("level") == "Moderate", 1).otherwise(0)
    return (assessment.join(dimension.select("country", "iso3"), "country")
            .select("iso3", "country", code.cast("bigint").alias("level_code"), "level", "score", "confidence", "evidence_count"))
