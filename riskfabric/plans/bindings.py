"""Views that bind the operators to the driver tables.

Every view exists twice: as a DataFrame and as SQL for the oracle. All of them derive from whole
tables by integer expressions on the keys, so both definitions give the same rows.
"""

from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.plans.catalog import VIEWS, table, text_list

AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

COUNTRIES = ["United Kingdom", "United States", "Netherlands", "Russia", "Iran", "Vietnam", "South Korea", "Türkiye",
             "Congo", "Ukraine", "Israel", "Egypt", "Nigeria", "Germany", "France", "India", "China", "Japan", "Brazil",
             "South Africa", "Taiwan", "Syria", "Myanmar", "Norway", "Finland"]
SUBJECTS = ["Missile attack", "Workers strike", "Severe flood", "Power outage", "Customs delay", "Drone strike",
            "Election debate", "Trade agreement"]
VERBS = ["closes", "disrupts", "delays", "reopens", "threatens", "damages"]
OBJECTS = ["cargo port", "container terminal", "airport freight", "rail line", "oil pipeline", "border crossing",
           "fuel refinery", "warehouse"]
PLACES = ["Odesa", "Rotterdam", "Lagos", "Suez Canal", "Red Sea", "Hormuz", "Heathrow", "Santos", "Mombasa", "Busan"]
SCOPES = ["Primary operational", "Local / regional", "International"]
HAZARDS = ["Earthquake", "Tropical cyclone", "Flood", "Volcano", "Drought", "Wildfire"]
EXPOSURE_FIELDS = list(V.EXPOSURE_WEIGHTS)


def pick(values, index):
    """n-th entry of a list literal."""
    return F.element_at(F.lit(list(values)), (index + 1).cast("int"))


def div(column, n):
    return F.floor(column / n)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def stamp(column):
    return column.cast("timestamp")


# ------------------------------------------------------------------ views
VIEWS["b_country"] = f"""
SELECT n_nationkey, n_name, n_regionkey, ({text_list(COUNTRIES)})[n_nationkey + 1] AS country FROM nation"""


def country(spark, folder):
    nation = table(spark, folder, "nation")
    return nation.withColumn("country", pick(COUNTRIES, F.col("n_nationkey")))


VIEWS["b_events"] = f"""
SELECT event_id, ts, user_id, event_type, value, ({text_list(COUNTRIES)})[user_id % 25 + 1] AS country,
  date_trunc('day', ts) AS day FROM events"""


def events(spark, folder):
    e = table(spark, folder, "events")
    return (e.withColumn("ts", stamp(F.col("ts")))
             .withColumn("country", pick(COUNTRIES, F.col("user_id") % 25))
             .withColumn("day", F.date_trunc("day", "ts")))


VIEWS["b_windows"] = """
SELECT country, event_type AS category, day AS collected_at, CAST(count(*) AS BIGINT) AS cluster_count,
  CAST(count(DISTINCT user_id) AS BIGINT) AS candidate_count FROM b_events GROUP BY ALL"""


def windows(spark, folder):
    from riskfabric.operators.volume import record_windows
    e = events(spark, folder).select("country", F.col("event_type").alias("category"), F.col("day").alias("collected_at"),
                                     F.col("event_id").alias("story"), F.col("user_id").alias("candidate"))
    return record_windows(e, candidate="candidate", story="story")


VIEWS["b_signals"] = f"""
SELECT 's-' || event_id AS id, event_id, event_type AS source,
  ({text_list(HAZARDS)})[event_id % 6 + 1] AS event_type,
  ({text_list(HAZARDS)})[event_id % 6 + 1] || ' ' || ({text_list(OBJECTS)})[(event_id // 6) % 8 + 1] || ' alert ' || country AS title,
  'near ' || ({text_list(PLACES)})[event_id % 10 + 1] || ', ' || country AS location, country,
  CAST((event_id * 37 % 18000) / 100.0 - 90 AS DOUBLE) AS latitude, CAST((event_id * 61 % 36000) / 100.0 - 180 AS DOUBLE) AS longitude,
  CASE WHEN event_id % 11 = 0 THEN 'Critical' WHEN event_id % 4 = 0 THEN 'High' ELSE 'Watch' END AS severity,
  CAST(40 + event_id % 60 AS BIGINT) AS confidence, ts AS observed_at, ts + INTERVAL 5 MINUTE AS collected_at
FROM b_events"""


def signals(spark, folder):
    k = F.col("event_id")
    return events(spark, folder).select(
        F.concat(F.lit("s-"), k.cast("string")).alias("id"), k, F.col("event_type").alias("source"),
        pick(HAZARDS, k % 6).alias("event_type"),
        F.concat(pick(HAZARDS, k % 6), F.lit(" "), pick(OBJECTS, div(k, 6) % 8), F.lit(" alert "), F.col("country")).alias("title"),
        F.concat(F.lit("near "), pick(PLACES, k % 10), F.lit(", "), F.col("country")).alias("location"), "country",
        ((k * 37 % 18000) / 100.0 - 90).alias("latitude"), ((k * 61 % 36000) / 100.0 - 180).alias("longitude"),
        F.when(k % 11 == 0, "Critical").when(k % 4 == 0, "High").otherwise("Watch").alias("severity"),
        (40 + k % 60).alias("confidence"), F.col("ts").alias("observed_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("collected_at"))


VIEWS["b_positions"] = """
SELECT CAST(user_id AS VARCHAR) AS mmsi, event_id, country AS monitor_country,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Vessel ' || user_id END AS ship_name,
  CAST(30 + event_id % 70 AS VARCHAR) AS type_code,
  CASE WHEN event_id % 3 = 0 THEN 'IMO' || user_id ELSE '' END AS imo,
  CASE WHEN event_id % 7 = 0 THEN 'CS' || user_id ELSE '' END AS call_sign,
  CASE WHEN event_id % 2 = 0 THEN 'Busan' ELSE '' END AS destination,
  CAST((event_id * 37 % 18000) / 100.0 - 90 AS DOUBLE) AS latitude, CAST((event_id * 61 % 36000) / 100.0 - 180 AS DOUBLE) AS longitude,
  CAST(event_id % 25 AS DOUBLE) AS speed_knots, ts AS observed_at FROM b_events"""


def positions(spark, folder):
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    return events(spark, folder).select(
        user.alias("mmsi"), k, F.col("country").alias("monitor_country"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Vessel "), user)).alias("ship_name"),
        (30 + k % 70).cast("string").alias("type_code"),
        F.when(k % 3 == 0, F.concat(F.lit("IMO"), user)).otherwise("").alias("imo"),
        F.when(k % 7 == 0, F.concat(F.lit("CS"), user)).otherwise("").alias("call_sign"),
        F.when(k % 2 == 0, "Busan").otherwise("").alias("destination"),
        ((k * 37 % 18000) / 100.0 - 90).alias("latitude"), ((k * 61 % 36000) / 100.0 - 180).alias("longitude"),
        (k % 25).cast("double").alias("speed_knots"), F.col("ts").alias("observed_at"))


_K = "doc_id"
VIEWS["b_articles"] = f"""
SELECT doc_id AS article_id, country, category, headline, publisher, summary, coverage_scope, url,
  list_transform(range(0, 1 + doc_id % 3), lambda j: {{
    'publisher': 'Outlet ' || ((doc_id + j) % 7), 'url': 'https://outlet' || ((doc_id + j) % 7) || '.test/' || doc_id,
    'coverage_scope': ({text_list(SCOPES)})[(doc_id + j) % 3 + 1],
    'source_type': CASE WHEN (doc_id + j) % 6 = 0 THEN 'Port authority' ELSE 'News reporting' END,
    'source_family': 'family' || ((doc_id * (j + 1)) % 7),
    'indexed_by': CASE WHEN (doc_id + j) % 9 = 0 THEN 'GDELT' END, 'headline': headline}}) AS sources,
  published_at FROM (
  SELECT doc_id, ({text_list(COUNTRIES)})[doc_id % 25 + 1] AS country, ({text_list(V.CATEGORIES)})[(doc_id // 25) % 5 + 1] AS category,
    ({text_list(SUBJECTS)})[doc_id % 8 + 1] || ' ' || ({text_list(VERBS)})[(doc_id // 8) % 6 + 1] || ' ' ||
    ({text_list(OBJECTS)})[(doc_id // 5) % 8 + 1] || ' in ' || ({text_list(PLACES)})[(doc_id // 3) % 10 + 1] || ' ' ||
    ({text_list(COUNTRIES)})[doc_id % 25 + 1] || ' - ' || source AS headline,
    source AS publisher, text AS summary, ({text_list(SCOPES)})[doc_id % 3 + 1] AS coverage_scope,
    'https://' || source || '.test/' || doc_id AS url,
    {AS_OF_SQL} - to_minutes(CAST(doc_id * 97 % 43200 AS INTEGER)) AS published_at
  FROM documents)"""


def articles(spark, folder):
    k = F.col("doc_id")
    base = table(spark, folder, "documents").select(
        k, pick(COUNTRIES, k % 25).alias("country"), pick(V.CATEGORIES, div(k, 25) % 5).alias("category"),
        F.concat_ws(" ", pick(SUBJECTS, k % 8), pick(VERBS, div(k, 8) % 6), pick(OBJECTS, div(k, 5) % 8), F.lit("in"),
                    pick(PLACES, div(k, 3) % 10), pick(COUNTRIES, k % 25), F.lit("-"), F.col("source")).alias("headline"),
        F.col("source").alias("publisher"), F.col("text").alias("summary"), pick(SCOPES, k % 3).alias("coverage_scope"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".test/"), k.cast("string")).alias("url"),
        F.timestamp_micros(F.unix_micros(as_of()) - (k * 97 % 43200) * 60_000_000).alias("published_at"))

    def source(j):
        outlet = ((k + j) % 7).cast("string")
        return F.struct(
            F.concat(F.lit("Outlet "), outlet).alias("publisher"),
            F.concat(F.lit("https://outlet"), outlet, F.lit(".test/"), k.cast("string")).alias("url"),
            pick(SCOPES, (k + j) % 3).alias("coverage_scope"),
            F.when((k + j) % 6 == 0, "Port authority").otherwise("News reporting").alias("source_type"),
            F.concat(F.lit("family"), ((k * (j + 1)) % 7).cast("string")).alias("source_family"),
            F.when((k + j) % 9 == 0, "GDELT").alias("indexed_by"), F.col("headline").alias("headline"))

    return base.select(k.alias("article_id"), "country", "category", "headline", "publisher", "summary", "coverage_scope", "url",
                       F.transform(F.sequence(F.lit(0).cast("bigint"), k % 3), source).alias("sources"), "published_at")


VIEWS["b_feedback"] = f"""
SELECT 'profile-' || (c.conv_id // 20) AS profile, c.conv_id * 100 + c.turn AS rating_id, a.article_id, a.headline, a.category, a.country,
  'https://' || a.publisher || '.test/' || a.article_id AS url, c.text AS summary,
  CAST(CASE WHEN (c.conv_id + c.turn) % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS feedback,
  {AS_OF_SQL} - to_minutes(CAST(c.conv_id * 60 + c.turn AS INTEGER)) AS updated_at
FROM conversations c JOIN (SELECT article_id, headline, category, country, publisher FROM b_articles) a
  ON a.article_id = (c.conv_id * 7 + c.turn) % (SELECT count(*) FROM documents)"""


def feedback(spark, folder):
    c = table(spark, folder, "conversations")
    total = table(spark, folder, "documents").agg(F.count("*").alias("total"))
    a = articles(spark, folder).select("article_id", "headline", "category", "country", "url")
    return (c.crossJoin(F.broadcast(total))  # one-row side
             .withColumn("article_id", (F.col("conv_id") * 7 + F.col("turn")) % F.col("total"))
             .join(a, "article_id")
             .select(F.concat(F.lit("profile-"), div(F.col("conv_id"), 20).cast("string")).alias("profile"),
                     (F.col("conv_id") * 100 + F.col("turn")).alias("rating_id"), "article_id", "headline", "category", "country",
                     "url", F.col("text").alias("summary"),
                     F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, 1).otherwise(-1).cast("bigint").alias("feedback"),
                     F.timestamp_micros(F.unix_micros(as_of()) - (F.col("conv_id") * 60 + F.col("turn")) * 60_000_000).alias("updated_at")))


def _exposure_expr(i):
    # raw inputs run past both ends of the 0-100 scale so that clamping matters
    return f"CAST(((n * {7 + 5 * i} + CAST(floor(bal) AS BIGINT) * {3 + i}) % 131) - 10 AS BIGINT)"


VIEWS["b_exposure"] = f"""
SELECT 'analyst' AS profile, country, {", ".join(f"{_exposure_expr(i)} AS {f}" for i, f in enumerate(EXPOSURE_FIELDS))}
FROM (SELECT c_nationkey, count(*) AS n, CAST(avg(CAST(round(abs(c_acctbal) * 100) AS BIGINT)) AS DOUBLE) / 100 AS bal FROM customer GROUP BY 1)
JOIN b_country ON n_nationkey = c_nationkey"""


def exposure(spark, folder):
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("n"), (F.avg(F.round(F.abs("c_acctbal") * 100).cast("bigint")) / 100).alias("bal"))
    names = country(spark, folder).select("n_nationkey", "country")
    return (c.join(F.broadcast(names), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows by definition of the nation table
             .select(F.lit("analyst").alias("profile"), "country", *[
                 ((F.col("n") * (7 + 5 * i) + F.floor("bal") * (3 + i)) % 131 - 10).alias(f) for i, f in enumerate(EXPOSURE_FIELDS)]))
