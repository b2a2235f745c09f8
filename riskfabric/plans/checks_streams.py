"""Streaming queries, drained over the driver tables and compared with their batch meaning."""

from pyspark.sql import functions as F

from riskfabric.functions.feeds import ais_class
from riskfabric.operators import store, tracker, transport
from riskfabric.plans import bindings as B
from riskfabric.plans.catalog import check, table
from riskfabric.plans.checks_stories import windowed_stories
from riskfabric.session import cut
from riskfabric.streaming import jobs, patterns, sinks

AS_OF = B.AS_OF_SQL


def event_stream(spark, folder):
    e = jobs.table_stream(spark, folder, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("country", B.pick(B.COUNTRIES, F.col("user_id") % 25)).withColumn("category", F.col("event_type"))


def position_stream(spark, folder):
    k = F.col("event_id")
    return event_stream(spark, folder).select(
        F.col("user_id").cast("string").alias("mmsi"), k, F.col("ts").alias("observed_at"), ((k * 37 % 18000) / 100.0 - 90).alias("latitude"), ((k * 61 % 36000) / 100.0 - 180).alias("longitude"))


@check("stream_upsert_ingest", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM b_events GROUP BY user_id")
def stream_upsert_ingest(spark, folder):
    s = event_stream(spark, folder).select("user_id", "event_id", "value", "ts")
    written = sinks.drain(s, "upsert", prepare=jobs.ingest_batch(["user_id"], ["ts", "event_id"]))
    return sinks.upserted(written, ["user_id"], ["ts", "event_id"]).drop("ts")


@check("stream_upsert_levels", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM b_events GROUP BY user_id")
def stream_upsert_levels(spark, folder):
    """The events as eleven landed files, one batch each, in a store that merges pairs of runs."""
    landed, store_folder = sinks.work_folder(spark, "landed"), sinks.work_folder(spark, "levels")
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "value", "ts")
    e.repartition(11, "event_id").write.option("maxRecordsPerFile", 0).parquet(landed)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    sinks.write_upserts(stream, store_folder, ["user_id"], ["ts", "event_id"], fan=2).awaitTermination()
    return sinks.read_upserts(spark, store_folder, ["user_id"], ["ts", "event_id"]).drop("ts")


@check("stream_distinct_positions", "SELECT mmsi, event_id FROM b_positions")
def stream_distinct_positions(spark, folder):
    twice = position_stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return sinks.drain(jobs.distinct_positions(twice), "distinct").select("mmsi", "event_id")


@check("stream_live_positions", f"""
SELECT mmsi, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY observed_at DESC, event_id DESC) AS rn FROM b_positions) WHERE rn = 1 AND (epoch_us({AS_OF}) - epoch_us(observed_at)) / 60000000.0 <= 360""")
def stream_live_positions(spark, folder):
    written = sinks.drain(jobs.latest_by_slot(position_stream(spark, folder)), "live", mode="update")
    current = sinks.upserted(written, ["mmsi"], ["observed_at", "event_id"])
    return transport.active(current, B.as_of(), 360).select("mmsi", "event_id")


@check("stream_volume_windows", "SELECT country, category, CAST(epoch(collected_at) AS BIGINT) AS window_s, cluster_count AS n FROM b_windows")
def stream_volume_windows(spark, folder):
    written = sinks.drain(jobs.volume_per_window(event_stream(spark, folder)), "volume", mode="complete")
    return sinks.last_batch(written).select("country", "category", F.unix_seconds("window_start").alias("window_s"), "n")


@check("stream_episodes", """
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM b_events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM x)
SELECT user_id, epoch_us(min(ts)) AS start_us, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, grp HAVING epoch_us(max(ts)) + 21600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM b_events) - 1800000000""")
def stream_episodes(spark, folder):
    written = sinks.drain(jobs.episodes(event_stream(spark, folder)), "episodes")
    return written.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@check("stream_static_merge", """
WITH m AS (SELECT user_id, event_id, ts, event_id % 4 = 0 AS is_static, last_value(CASE WHEN event_id % 4 = 0 THEN 'Ship ' || event_id END IGNORE NULLS) OVER w AS static_name,
   last_value(CASE WHEN event_id % 4 <> 0 THEN event_id END IGNORE NULLS) OVER w AS pos FROM b_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(user_id AS VARCHAR) AS mmsi, pos AS event_id, coalesce(static_name, 'MMSI ' || user_id) AS ship_name, CAST(count(*) AS BIGINT) AS emitted FROM m WHERE pos IS NOT NULL GROUP BY ALL""")
def stream_static_merge(spark, folder):
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    static = k % 4 == 0
    frames = event_stream(spark, folder).select(
        user.alias("mmsi"), k, F.when(static, "static").otherwise("position").alias("kind"), F.col("ts").alias("observed_at"), F.col("value").alias("latitude"), F.col("value").alias("longitude"),
        F.when(static, F.concat(F.lit("Ship "), k.cast("string"))).otherwise(F.concat(F.lit("MMSI "), user)).alias("ship_name"), ais_class((30 + k % 70).cast("string")).alias("vessel_type"),
        F.lit("").alias("imo"), F.lit("").alias("call_sign"), F.lit("").alias("destination"))
    written = sinks.drain_stateful(jobs.merge_static(frames), "static")
    return written.groupBy("mmsi", "event_id", "ship_name").agg(F.count("*").alias("emitted"))


@check("stream_present_hazards", """
SELECT id FROM b_signals WHERE source = 'click' AND collected_at >= (SELECT max(collected_at) FROM s_runs WHERE provider = 'GDACS' AND status = 'live') - INTERVAL 3 HOUR""")
def stream_present_hazards(spark, folder):
    from riskfabric.plans.checks_store import runs
    k = F.col("event_id")
    s = event_stream(spark, folder).select(F.concat(F.lit("s-"), k.cast("string")).alias("id"), F.when(F.col("event_type") == "click", "GDACS").otherwise(F.col("event_type")).alias("source"),
                                          F.when(k % 11 == 0, "Critical").otherwise("Watch").alias("severity"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("collected_at"))
    table = sinks.upserted(sinks.drain(s, "hazards", prepare=jobs.ingest_batch(["id"], ["collected_at"])), ["id"], ["collected_at"])
    return store.present_hazards(table, runs(spark, folder)).select("id")


def tracked_stories(spark, folder):
    """Touches of the stories of all windows, landed in parts out of order; a last row without a country closes the last windows."""
    landed = sinks.work_folder(spark, "stories")
    stories = windowed_stories(spark, folder).select("country", "category", "collected_at", "headline", "published_at", "url", "sources")
    stories.write.parquet(landed)
    end = spark.read.parquet(landed).agg((F.max("collected_at") + F.expr("INTERVAL 2 DAYS")).alias("collected_at"))
    end.select(*[F.col(c) if c == "collected_at" else F.lit(None).cast(t).alias(c) for c, t in stories.dtypes]).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(stories.schema).parquet(landed)
    return sinks.drain_stateful(patterns.track_stream(stream, lists=False), "tracker")


@check("stream_pattern_tracker")
def stream_pattern_tracker(spark, folder):
    return tracked_stories(spark, folder).select("country", "category", F.unix_seconds("collected_at").alias("window_s"), "place", "pattern_id", "active_windows", "observation_count")


@check("stream_pattern_scores")
def stream_pattern_scores(spark, folder):
    scored = tracker.latest_patterns(patterns.warnings(tracked_stories(spark, folder).drop("batch")))
    return scored.select("pattern_id", "country", "category", "status", "active_windows", "persistence_score", "early_warning_score", "alert_level", "alert_confidence")
