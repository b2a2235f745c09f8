"""Queries on table maintenance and retrieval."""

from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.operators import store
from riskfabric.plans import bindings as B
from riskfabric.plans.catalog import VIEWS, check, table
from riskfabric.plans.checks_text import key_words_sql
from riskfabric.functions import text

AS_OF = B.AS_OF_SQL

# the incoming batch is the whole orders table re-keyed, so that part of it collides with stored keys
VIEWS["s_incoming"] = """
SELECT o_orderkey * 2 AS o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderpriority FROM orders
UNION ALL SELECT o_orderkey * 3, 'Y', o_totalprice + 2, o_orderpriority FROM orders"""
VIEWS["s_incoming_one"] = """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_totalprice DESC, o_orderstatus DESC) AS rn FROM s_incoming) WHERE rn = 1"""


def orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def incoming(spark, folder):
    o = orders(spark, folder)
    def shifted(n, status):
        return o.select((F.col("o_orderkey") * n).alias("o_orderkey"), F.lit(status).alias("o_orderstatus"),
                        (F.col("o_totalprice") + (n - 1)).alias("o_totalprice"), "o_orderpriority")
    return shifted(2, "X").unionByName(shifted(3, "Y"))


@check("upsert_keep_columns", """
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus,
  CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice,
  CASE WHEN o.o_orderkey IS NULL THEN n.o_orderpriority ELSE o.o_orderpriority END AS o_orderpriority
FROM orders o FULL JOIN s_incoming_one n ON o.o_orderkey = n.o_orderkey""")
def upsert_keep_columns(spark, folder):
    return store.upsert(orders(spark, folder), incoming(spark, folder), ["o_orderkey"], keep_old=["o_orderpriority"],
                        order=["o_totalprice", "o_orderstatus"])


@check("ignore_existing", """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM s_incoming_one n WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = n.o_orderkey)""")
def ignore_existing(spark, folder):
    return store.insert_or_ignore(orders(spark, folder), incoming(spark, folder), ["o_orderkey"], order=["o_totalprice", "o_orderstatus"])


@check("snapshot_replace", f"""
SELECT country, category, article_id, headline FROM b_articles o WHERE NOT EXISTS (SELECT 1 FROM b_articles n WHERE n.coverage_scope = 'International' AND n.publisher < 'src11' AND n.country = o.country AND n.category = o.category)
UNION ALL SELECT country, category, article_id + 1000000000, headline FROM b_articles WHERE coverage_scope = 'International' AND publisher < 'src11'""")
def snapshot_replace(spark, folder):
    a = B.articles(spark, folder)
    old = a.select("country", "category", "article_id", "headline")
    new = (a.filter((F.col("coverage_scope") == "International") & (F.col("publisher") < "src11"))
            .select("country", "category", (F.col("article_id") + 1000000000).alias("article_id"), "headline"))
    return store.replace_groups(old, new, ["country", "category"])


@check("latest_vessels", """
SELECT mmsi, event_id, monitor_country, CAST(epoch_us(observed_at) AS BIGINT) AS observed_us FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY observed_at DESC, event_id DESC) AS rn FROM b_positions) WHERE rn = 1
ORDER BY observed_at DESC, mmsi DESC LIMIT 500""")
def latest_vessels(spark, folder):
    return (store.latest_entities(B.positions(spark, folder), "mmsi", 500, tie="event_id")
            .select("mmsi", "event_id", "monitor_country", F.unix_micros("observed_at").alias("observed_us")))


@check("latest_vessels_area", """
SELECT mmsi, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY observed_at DESC, event_id DESC) AS rn FROM b_positions WHERE monitor_country = 'Netherlands') WHERE rn = 1""")
def latest_vessels_area(spark, folder):
    return store.latest_entities(B.positions(spark, folder), "mmsi", area="Netherlands", tie="event_id").select("mmsi", "event_id")


@check("history_per_vessel", """
SELECT mmsi, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY observed_at DESC, event_id DESC) AS rn FROM b_positions) WHERE rn <= 100""")
def history_per_vessel(spark, folder):
    return store.entity_history(B.positions(spark, folder), "mmsi", limit=100, tie="event_id").select("mmsi", "event_id")


@check("history_one_vessel", """SELECT mmsi, event_id, latitude, longitude FROM b_positions WHERE mmsi = '7' ORDER BY observed_at DESC, event_id DESC LIMIT 100""")
def history_one_vessel(spark, folder):
    return store.entity_history(B.positions(spark, folder), "mmsi", "7", limit=100, tie="event_id").select("mmsi", "event_id", "latitude", "longitude")


@check("position_retention", """
SELECT mmsi, event_id FROM b_positions ORDER BY observed_at DESC, event_id DESC LIMIT 10000""")
def position_retention(spark, folder):
    return store.retain_newest(B.positions(spark, folder), [F.desc("observed_at"), F.desc("event_id")], 10000).select("mmsi", "event_id")


@check("topn_recent_signals", f"""
SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY observed_at DESC, id DESC) AS rn FROM b_signals WHERE observed_at >= {AS_OF} - INTERVAL 7 DAY) WHERE rn <= 100""")
def topn_recent_signals(spark, folder):
    return store.recent_per_source(B.signals(spark, folder), B.as_of(), 100).select("source", "id")


VIEWS["s_runs"] = """
SELECT event_id AS run_id, CASE WHEN event_type = 'click' THEN 'GDACS' ELSE event_type END AS provider,
  CASE WHEN event_id % 7 = 0 THEN 'unavailable' ELSE 'live' END AS status, CAST(user_id AS BIGINT) AS record_count, ts + INTERVAL 5 MINUTE AS collected_at FROM b_events"""


def runs(spark, folder):
    return B.events(spark, folder).select(
        F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "click", "GDACS").otherwise(F.col("event_type")).alias("provider"),
        F.when(F.col("event_id") % 7 == 0, "unavailable").otherwise("live").alias("status"), F.col("user_id").alias("record_count"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("collected_at"))


@check("present_hazards", """
SELECT id, severity, CAST(epoch_us(collected_at) AS BIGINT) AS collected_us FROM b_signals WHERE source = 'click'
  AND collected_at >= (SELECT max(collected_at) FROM s_runs WHERE provider = 'GDACS' AND status = 'live') - INTERVAL 3 HOUR
ORDER BY CASE severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 ELSE 1 END DESC, collected_at DESC LIMIT 600""")
def present_hazards(spark, folder):
    s = B.signals(spark, folder).withColumn("source", F.when(F.col("source") == "click", "GDACS").otherwise(F.col("source")))
    return store.present_hazards(s, runs(spark, folder), limit=600).select("id", "severity", F.unix_micros("collected_at").alias("collected_us"))


@check("newest_articles", "SELECT country, category, article_id FROM b_articles")
def newest_articles(spark, folder):
    return store.newest_articles(B.articles(spark, folder)).select("country", "category", "article_id")


@check("newest_articles_of_group", """
SELECT country, category, article_id FROM (SELECT *, row_number() OVER (PARTITION BY country, category ORDER BY published_at DESC, url DESC) AS rn FROM b_articles) WHERE rn <= 5""")
def newest_articles_of_group(spark, folder):
    """The five newest articles of every country and category (the number is the feature)."""
    return store.newest_articles(B.articles(spark, folder), 5).select("country", "category", "article_id")


@check("newest_articles_overall", """SELECT article_id, country FROM b_articles ORDER BY published_at DESC, url DESC LIMIT 750""")
def newest_articles_overall(spark, folder):
    return (B.articles(spark, folder).select("article_id", "country", "published_at", "url")
            .orderBy(F.desc("published_at"), F.desc("url")).limit(750).select("article_id", "country"))


VIEWS["s_history"] = f"""
SELECT country, category, article_id, headline, url, array_to_string({key_words_sql('headline')}, ' ') AS story_key,
  CASE WHEN article_id % 9 = 0 THEN NULL ELSE published_at END AS published_at, published_at + INTERVAL 30 MINUTE AS observed_at FROM b_articles"""


def history(spark, folder):
    return B.articles(spark, folder).select(
        "country", "category", "article_id", "headline", "url", text.story_key(F.col("headline")).alias("story_key"),
        F.when(F.col("article_id") % 9 != 0, F.col("published_at")).alias("published_at"),
        (F.col("published_at") + F.expr("INTERVAL 30 MINUTES")).alias("observed_at"))


@check("history_latest_stories", """
SELECT country, article_id, story_key FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY coalesce(published_at, observed_at) DESC, observed_at DESC, url DESC) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY country, story_key ORDER BY observed_at DESC, url DESC) AS kn FROM s_history) WHERE kn = 1) WHERE rn <= 10""")
def history_latest_stories(spark, folder):
    return store.latest_stories(history(spark, folder), 10).select("country", "article_id", "story_key")


VIEWS["s_patterns"] = """
SELECT 'p' || event_id AS pattern_id, country, CAST(event_id * 13 % 101 AS BIGINT) AS early_warning_score, round(value, 2) AS anomaly_score,
  CAST(event_id * 7 % 101 AS BIGINT) AS persistence_score, CAST(event_id * 3 % 96 AS BIGINT) AS alert_confidence, ts AS last_seen FROM b_events"""


def patterns(spark, folder):
    k = F.col("event_id")
    return B.events(spark, folder).select(
        F.concat(F.lit("p"), k.cast("string")).alias("pattern_id"), "country", (k * 13 % 101).alias("early_warning_score"),
        F.round("value", 2).alias("anomaly_score"), (k * 7 % 101).alias("persistence_score"), (k * 3 % 96).alias("alert_confidence"),
        F.col("ts").alias("last_seen"))


@check("topn_patterns", f"""
SELECT country, pattern_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY early_warning_score DESC, anomaly_score DESC, persistence_score DESC, last_seen DESC, pattern_id DESC) AS rn
FROM s_patterns WHERE last_seen >= {AS_OF} - INTERVAL 20 DAY) WHERE rn <= 12""")
def topn_patterns(spark, folder):
    return store.ranked_patterns(patterns(spark, folder), B.as_of(), 12, max_age_days=20).select("country", "pattern_id", "rank")


@check("topn_alerts", f"""
SELECT country, pattern_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY early_warning_score DESC, alert_confidence DESC, last_seen DESC, pattern_id DESC) AS rn
FROM s_patterns WHERE last_seen >= {AS_OF} - INTERVAL 30 DAY AND early_warning_score >= 25) WHERE rn <= 10""")
def topn_alerts(spark, folder):
    return store.alerts(patterns(spark, folder), B.as_of(), 10).select("country", "pattern_id", "rank")


@check("pattern_candidates", f"""SELECT pattern_id, country FROM s_patterns WHERE last_seen >= {AS_OF} - INTERVAL 30 DAY""")
def pattern_candidates(spark, folder):
    return store.pattern_candidates(patterns(spark, folder), B.as_of()).select("pattern_id", "country")


@check("active_pattern_counts", f"""
SELECT CAST(count(*) AS BIGINT) AS active_patterns, CAST(count(*) FILTER (WHERE early_warning_score >= 25) AS BIGINT) AS developing,
  CAST(count(*) FILTER (WHERE early_warning_score >= 45) AS BIGINT) AS priority FROM s_patterns WHERE last_seen >= {AS_OF} - INTERVAL 30 DAY""")
def active_pattern_counts(spark, folder):
    return store.active_counts(patterns(spark, folder), B.as_of())


@check("latest_provider_status", """
SELECT provider, run_id, status, record_count FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY collected_at DESC, run_id DESC) AS rn FROM s_runs) WHERE rn = 1""")
def latest_provider_status(spark, folder):
    return store.provider_status(runs(spark, folder)).select("provider", "run_id", "status", "record_count")


@check("run_log", """
SELECT event_type AS provider, CASE WHEN event_type = 'signup' THEN 'setup required' WHEN sum(CASE WHEN event_id % 997 = 3 THEN 1 ELSE 0 END) > 1000000 THEN 'unavailable' WHEN count(*) > 0 THEN 'live' ELSE 'no data' END AS status, CAST(count(*) AS BIGINT) AS record_count FROM events GROUP BY event_type""")
def run_log(spark, folder):
    counts = B.events(spark, folder).groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("record_count")).select(
        "provider", "record_count", (F.col("provider") != "signup").alias("configured"), F.lit(False).alias("failed"), F.lit("").alias("message"))
    return store.run_log(counts, B.as_of()).select("provider", "status", "record_count")


@check("store_statistics", """
SELECT (SELECT count(*) FROM b_signals) AS signals, (SELECT count(*) FROM b_articles) AS articles, (SELECT count(*) FROM s_patterns) AS patterns,
  (SELECT CAST(max(epoch_us(collected_at)) AS BIGINT) FROM s_runs) AS last_us""")
def store_statistics(spark, folder):
    return (store.store_statistics(B.signals(spark, folder), B.articles(spark, folder), patterns(spark, folder), runs(spark, folder))
            .select("signals", "articles", "patterns", F.unix_micros("last_collection").alias("last_us")))


@check("cache_freshness", f"""
SELECT run_id, CASE WHEN 3 + run_id % 4 >= 5 AND record_count > 3 AND collected_at >= {AS_OF} - INTERVAL 600 MINUTE THEN true ELSE false END AS fresh FROM s_runs""")
def cache_freshness(spark, folder):
    r = runs(spark, folder).select("run_id", (3 + F.col("run_id") % 4).alias("format_version"),
                                   F.when(F.col("record_count") > 3, F.col("record_count")).alias("article_count"), "collected_at")
    return store.cache_fresh(r, B.as_of(), 600).select("run_id", "fresh")


VIEWS["s_feedback"] = """SELECT profile, sha1(url) AS article_key, feedback, updated_at, rating_id FROM b_feedback"""


def feedback_rows(spark, folder):
    return B.feedback(spark, folder).select("profile", F.sha1(F.col("url").cast("binary")).alias("article_key"), "feedback", "updated_at", "rating_id")


@check("feedback_upsert", """
WITH incoming AS (SELECT profile, article_key, -3 * feedback AS feedback, updated_at + INTERVAL 1 HOUR AS updated_at, rating_id + 1000000 AS rating_id FROM s_feedback
   UNION ALL SELECT profile || '-new', article_key, feedback, updated_at, rating_id FROM s_feedback),
every_row AS (SELECT *, 0 AS gen FROM (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY profile, article_key ORDER BY updated_at DESC) AS rn FROM s_feedback) WHERE rn = 1)
   UNION ALL SELECT profile, article_key, CASE WHEN feedback > 0 THEN 1 ELSE -1 END, updated_at, rating_id, 1 FROM incoming)
SELECT profile, article_key, CAST(feedback AS BIGINT) AS feedback, rating_id FROM (
  SELECT *, row_number() OVER (PARTITION BY profile, article_key ORDER BY gen DESC, updated_at DESC) AS rn FROM every_row) WHERE rn = 1""")
def feedback_upsert(spark, folder):
    rows = feedback_rows(spark, folder)
    stored = store.latest_per_key(rows, ["profile", "article_key"], ["updated_at"])
    flipped = (rows.withColumn("feedback", -3 * F.col("feedback")).withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 HOUR"))
               .withColumn("rating_id", F.col("rating_id") + 1000000))
    fresh = rows.withColumn("profile", F.concat("profile", F.lit("-new")))
    return store.save_feedback(stored, flipped.unionByName(fresh)).select("profile", "article_key", "feedback", "rating_id")


@check("feedback_for_articles", """
SELECT DISTINCT f.profile, f.article_key, f.rating_id FROM s_feedback f WHERE f.article_key IN (SELECT sha1(url) FROM b_articles WHERE coverage_scope = 'International')""")
def feedback_for_articles(spark, folder):
    wanted = B.articles(spark, folder).filter(F.col("coverage_scope") == "International").select(F.sha1(F.col("url").cast("binary")).alias("article_key"))
    return feedback_rows(spark, folder).join(wanted, "article_key", "left_semi").select("profile", "article_key", "rating_id")


@check("feedback_clear_profile", """SELECT profile, rating_id FROM s_feedback WHERE profile <> 'profile-1'""")
def feedback_clear_profile(spark, folder):
    return store.clear_profile(feedback_rows(spark, folder), "profile-1").select("profile", "rating_id")


@check("route_upsert", """
WITH o AS (SELECT 'CS' || event_id % 900 AS callsign, 'old' AS airline, max(event_id) % 50 AS destination_iata, max(event_id) AS checked_at FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
n AS (SELECT 'CS' || event_id % 1000 AS callsign, 'new' AS airline, max(event_id) % 70 AS destination_iata, max(event_id) AS checked_at FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)
SELECT coalesce(n.callsign, o.callsign) AS callsign, coalesce(n.airline, o.airline) AS airline, coalesce(o.destination_iata, n.destination_iata) AS destination_iata, coalesce(n.checked_at, o.checked_at) AS checked_at
FROM o FULL JOIN n ON o.callsign = n.callsign""")
def route_upsert(spark, folder):
    e, k = table(spark, folder, "events"), F.col("event_id")
    rows = lambda part, calls, name, places: e.filter(part).select(F.concat(F.lit("CS"), (k % calls).cast("string")).alias("callsign"), F.lit(name).alias("airline"), (k % places).alias("destination_iata"), k.alias("checked_at"))
    old = store.latest_per_key(rows(k % 3 == 0, 900, "old", 50), ["callsign"], ["checked_at"])
    return store.save_routes(old, rows(k % 3 != 0, 1000, "new", 70))


@check("exposure_upsert", f"""
SELECT profile, country, {", ".join(f"CAST(least(100, greatest(0, {f})) AS BIGINT) AS {f}" for f in B.EXPOSURE_FIELDS)} FROM b_exposure""")
def exposure_upsert(spark, folder):
    new = B.exposure(spark, folder).withColumn("updated_at", B.as_of())
    old = new.withColumn(B.EXPOSURE_FIELDS[0], F.lit(50).cast("bigint"))
    return store.save_exposure(old, new, B.EXPOSURE_FIELDS).drop("updated_at")


@check("schema_defaults", """
SELECT article_id, coalesce(CASE WHEN article_id % 4 = 0 THEN coverage_scope END, 'International') AS coverage_scope, CAST(1 AS BIGINT) AS format_version,
  'Global strategic waterways' AS monitor_country FROM b_articles""")
def schema_defaults(spark, folder):
    a = B.articles(spark, folder).select("article_id", F.when(F.col("article_id") % 4 == 0, F.col("coverage_scope")).alias("coverage_scope"))
    return store.conform(a, {"coverage_scope": ("string", "International"), "format_version": ("bigint", 1),
                             "monitor_country": ("string", "Global strategic waterways")})


@check("signal_defaults", f"""
SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN country END, CASE WHEN event_id % 3 = 0 THEN location END, 'Global') AS country,
  CAST(floor(epoch(coalesce(CASE WHEN event_id % 5 = 0 THEN collected_at END, {AS_OF}))) AS BIGINT) AS collected_s, '{{}}' AS raw_json FROM b_signals""")
def signal_defaults(spark, folder):
    from riskfabric.sources.landed import with_signal_defaults
    k = F.col("event_id")
    s = B.signals(spark, folder).select(k, F.when(k % 2 == 0, F.col("country")).alias("country"), F.when(k % 3 == 0, F.col("location")).alias("location"),
                                        F.when(k % 5 == 0, F.col("collected_at")).alias("collected_at"))
    return with_signal_defaults(s, B.as_of()).select("event_id", "country", F.floor(F.unix_micros("collected_at") / 1000000).alias("collected_s"), "raw_json")
