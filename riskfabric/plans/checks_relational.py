"""Queries on joins, selections and transport."""

from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions import feeds, text
from riskfabric.operators import names, relational, store, transport
from riskfabric.plans import bindings as B
from riskfabric.plans.catalog import VIEWS, check, sql_any, sql_case, sql_tokens, table, text_list
from riskfabric.plans.checks_store import history
from riskfabric.plans.checks_text import key_words_sql, mention_case_sql, _labels_sql

AS_OF = B.AS_OF_SQL
NAMES = f"(SELECT unnest({text_list(B.COUNTRIES)}) AS name)"


@check("active_positions", f"""SELECT mmsi, event_id FROM b_positions WHERE greatest(0, (epoch_us({AS_OF}) - epoch_us(observed_at)) / 60000000.0) <= 1440""")
def active_positions(spark, folder):
    return transport.active(B.positions(spark, folder), B.as_of(), 1440).select("mmsi", "event_id")


@check("union_distinct_feeds", """
WITH feeds AS (SELECT page_id, upper('Source' || page_id % 40) AS publisher, 'u' || page_id % 97 AS url, 1 AS pri FROM pages UNION ALL SELECT doc_id, source, 'u' || doc_id % 97, 2 FROM documents
  UNION ALL SELECT doc_id + 1000000, upper(source), 'u' || doc_id % 97, 3 FROM documents)
SELECT page_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(publisher), url ORDER BY pri DESC, page_id DESC) AS rn FROM feeds) WHERE rn = 1""")
def union_distinct_feeds(spark, folder):
    p, d = table(spark, folder, "pages"), table(spark, folder, "documents")
    link = lambda c: F.concat(F.lit("u"), (F.col(c) % 97).cast("string")).alias("url")
    one = p.select("page_id", F.upper(F.concat(F.lit("Source"), (F.col("page_id") % 40).cast("string"))).alias("publisher"), link("page_id"), F.lit(1).alias("pri"))
    two = d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("publisher"), link("doc_id"), F.lit(2).alias("pri"))
    three = d.select((F.col("doc_id") + 1000000).alias("page_id"), F.upper("source").alias("publisher"), link("doc_id"), F.lit(3).alias("pri"))
    return relational.union_distinct([one, two, three], ["pri", "page_id"]).select("page_id")


@check("anti_join_history", """
SELECT h.country, h.article_id FROM s_history h WHERE NOT EXISTS (SELECT 1 FROM s_history c WHERE c.category = 'Conflicts and war' AND c.country = h.country AND c.story_key = h.story_key)
  AND NOT EXISTS (SELECT 1 FROM s_history c WHERE c.category = 'Conflicts and war' AND c.country = h.country AND c.headline = h.headline)""")
def anti_join_history(spark, folder):
    h = history(spark, folder)
    return relational.not_current(h, h.filter(F.col("category") == "Conflicts and war")).select("country", "article_id")


@check("signal_country_join", f"""
SELECT id, arg_min(name, (-length(name), name)) AS matched_country FROM (
  SELECT s.id, n.name FROM b_signals s JOIN {NAMES} n ON {mention_case_sql("(s.country || ' ' || s.location)", 'n.name')}) GROUP BY id""")
def signal_country_join(spark, folder):
    return relational.locate_signals(B.signals(spark, folder), B.COUNTRIES).filter("matched_country IS NOT NULL").select("id", "matched_country")


@check("signal_country_names", f"""
SELECT s.id, n.name FROM b_signals s JOIN {NAMES} n ON {mention_case_sql("(s.country || ' ' || s.location)", 'n.name')}""")
def signal_country_names(spark, folder):
    """Every country that a signal names, all names searched at once."""
    s = B.signals(spark, folder).select("id", text.phrase(F.col("country"), F.col("location")).alias("place"))
    return names.mentions(s, names.spellings(names.country_names(spark, B.COUNTRIES)), "id", "place")


@check("gazetteer_documents", """
WITH g AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]{4,} [a-z]{4,}') AS name FROM benchmark)
SELECT d.doc_id, g.name FROM (SELECT doc_id, lower(text) AS t FROM documents) d JOIN g ON g.name <> '' AND contains(d.t, g.name)
WHERE regexp_matches(d.t, '(^|[^a-z])' || g.name || '($|[^a-z])')""")
def gazetteer_documents(spark, folder):
    """Documents that hold a pair of words of a benchmark text: a gazetteer that grows with its table."""
    pair = F.regexp_extract(F.lower("text"), "[a-z]{4,} [a-z]{4,}", 0)
    g = table(spark, folder, "benchmark").select(pair.alias("name")).where("name != ''").distinct()
    return names.mentions(table(spark, folder, "documents"), names.spellings(g.withColumn("alias", F.col("name"))), "doc_id", "text")


@check("band_join_exists", """
SELECT a.article_id, EXISTS (SELECT 1 FROM b_articles n WHERE n.coverage_scope = 'International' AND n.country = a.country AND n.category = a.category
  AND (n.article_id % 9 = 0 AND n.article_id % 25 = 3 OR abs(epoch_us(n.published_at - INTERVAL 9 DAY) - epoch_us(a.published_at)) <= 604800000000)) AS has_match FROM b_articles a""")
def band_join_exists(spark, folder):
    a = B.articles(spark, folder).select("article_id", "country", "category", "published_at", "coverage_scope")
    k = F.col("article_id")
    right = a.filter(F.col("coverage_scope") == "International").withColumn(
        "published_at", F.when((k % 9 == 0) & (k % 25 == 3), F.lit(None)).otherwise(F.col("published_at") - F.expr("INTERVAL 9 DAYS")))
    return relational.within_band(a, right, ["country", "category"]).select("article_id", "has_match")


VIEWS["r_det"] = f"""
SELECT country, kind, source AS provider, max_by(id, (observed_at, id)) AS id, max(observed_at) AS observed_at FROM (
  SELECT n.name AS country, s.id, s.source, s.observed_at, unnest({_labels_sql("lower(s.event_type || ' ' || s.title || ' ')", V.HAZARD_MARKERS)}) AS kind
  FROM b_signals s JOIN {NAMES} n ON contains(lower(s.country || ' ' || s.location || ' ' || s.title), lower(n.name))) GROUP BY ALL"""


@check("hazard_attachment", f"""
WITH k AS (SELECT article_id, country, sources, {_labels_sql("lower(headline || ' ' || summary)", V.HAZARD_MARKERS)} AS kinds FROM b_articles),
m AS (SELECT k.article_id, d.provider, max_by(d.id, (d.observed_at, d.id)) AS id FROM (SELECT article_id, country, unnest(kinds) AS kind FROM k) k JOIN r_det d USING (country, kind) GROUP BY ALL)
SELECT k.article_id, CAST(len(k.sources) + count(m.id) AS BIGINT) AS source_count, coalesce(string_agg(m.provider, ',' ORDER BY m.provider), '') AS providers,
  CASE WHEN len(kinds) = 0 THEN 'none' WHEN count(m.id) > 0 THEN 'Officially detected and news corroborated' ELSE 'News reported; no matching official detection stored' END AS status
FROM k LEFT JOIN m USING (article_id) GROUP BY k.article_id, k.sources, k.kinds""")
def hazard_attachment(spark, folder):
    s = B.signals(spark, folder).withColumn("summary", F.lit("")).withColumn("source_url", F.lit(""))
    out = relational.attach_hazard_signals(B.articles(spark, folder), s, B.COUNTRIES)
    return out.select("article_id", F.size("sources").cast("bigint").alias("source_count"), F.array_join("hazard_providers", ",").alias("providers"),
                      F.coalesce("hazard_status", F.lit("none")).alias("status"))


ZONES_SQL = "(VALUES " + ", ".join(f"({i}, {s}, {w}, {n}, {e})" for i, (s, w, n, e) in enumerate(V.MONITORING_ZONES)) + ") z(zone, south, west, north, east)"


@check("geo_zone_join", f"""
SELECT event_id, CAST(zone AS BIGINT) AS zone FROM b_positions JOIN {ZONES_SQL} ON latitude BETWEEN south AND north AND longitude BETWEEN west AND east""")
def geo_zone_join(spark, folder):
    return transport.in_zones(B.positions(spark, folder), transport.monitoring_zones(spark)).select("event_id", "zone")


@check("geo_country_bounds", """
WITH b AS (SELECT country, greatest(-90.0, n_nationkey * 7.0 - 90 - 1.5) AS south, least(90.0, n_nationkey * 7.0 - 80 + 1.5) AS north,
  greatest(-180.0, n_nationkey * 14.0 - 180 - 1.5) AS west, least(180.0, n_nationkey * 14.0 - 160 + 1.5) AS east FROM b_country)
SELECT country, CAST(count(*) AS BIGINT) AS positions FROM b JOIN b_positions ON latitude BETWEEN south AND north AND longitude BETWEEN west AND east GROUP BY country""")
def geo_country_bounds(spark, folder):
    n = F.col("n_nationkey")
    raw = B.country(spark, folder).select("country", (n * 7.0 - 90).alias("south"), (n * 7.0 - 80).alias("north"), (n * 14.0 - 180).alias("west"), (n * 14.0 - 160).alias("east"))
    return transport.in_zones(B.positions(spark, folder), transport.country_bounds(raw)).groupBy("country").agg(F.count("*").alias("positions"))


@check("richest_vessel_record", """
SELECT mmsi, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY (CASE WHEN ship_name <> '' THEN 1 ELSE 0 END + CASE WHEN imo <> '' THEN 1 ELSE 0 END
  + CASE WHEN call_sign <> '' THEN 1 ELSE 0 END + CASE WHEN destination <> '' THEN 1 ELSE 0 END) DESC, event_id DESC) AS rn FROM b_positions) WHERE rn = 1""")
def richest_vessel_record(spark, folder):
    return relational.richest(B.positions(spark, folder), "mmsi", ["ship_name", "imo", "call_sign", "destination"], ["event_id"]).select("mmsi", "event_id")


@check("stratified_articles", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY country, category, coverage_scope ORDER BY published_at DESC, url DESC) AS sn FROM b_articles),
f AS (SELECT *, CASE WHEN sn > CASE coverage_scope WHEN 'Local / regional' THEN 1 ELSE 2 END THEN 1 ELSE 0 END AS fill FROM s)
SELECT country, category, article_id FROM (SELECT *, row_number() OVER (PARTITION BY country, category ORDER BY fill, published_at DESC, url DESC) AS rn FROM f) WHERE rn <= 5""")
def stratified_articles(spark, folder):
    return relational.stratified_selection(B.articles(spark, folder)).select("country", "category", "article_id")


@check("diverse_sample", """
SELECT article_id, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY published_at DESC, sha1(url) DESC) AS rn FROM b_articles) WHERE rn <= 2
ORDER BY published_at DESC, sha1(url) DESC LIMIT 12""")
def diverse_sample(spark, folder):
    a = B.articles(spark, folder).withColumn("article_key", text.article_key(F.col("url"), F.col("country"), F.col("headline")))
    return relational.diverse_sample(a, 2, 12).select("article_id", "country")


@check("refresh_targets", f"""
WITH sig AS (SELECT id, severity, arg_min(name, (-length(name), name)) AS country FROM (SELECT s.id, s.severity, n.name FROM b_signals s JOIN {NAMES} n ON {mention_case_sql("(s.country || ' ' || s.location)", 'n.name')}) GROUP BY ALL),
p AS (SELECT country, CASE severity WHEN 'Critical' THEN 750 WHEN 'High' THEN 650 ELSE 550 END AS priority FROM sig
 UNION ALL SELECT country, 800 FROM b_exposure WHERE route_dependency > 60 UNION ALL SELECT 'Norway', 1000
 UNION ALL SELECT country, 400 + least(100, article_id % 130) FROM b_articles WHERE published_at >= {AS_OF} - INTERVAL 7 DAY)
SELECT country, CAST(max(priority) AS BIGINT) AS priority FROM p GROUP BY country""")
def refresh_targets(spark, folder):
    a = B.articles(spark, folder).select("country", "published_at", (F.col("article_id") % 130).alias("score"))
    e = B.exposure(spark, folder).filter(F.col("route_dependency") > 60)
    return relational.refresh_targets(B.signals(spark, folder), a, e, B.COUNTRIES, B.as_of(), selected="Norway")


@check("hazard_grade_counts", f"""
SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.HAZARD_CODES.items())} END AS event_type, CAST(count(*) AS BIGINT) AS active,
  CAST(count(*) FILTER (WHERE severity = 'Critical') AS BIGINT) AS red, CAST(count(*) FILTER (WHERE severity = 'High') AS BIGINT) AS orange, CAST(count(*) FILTER (WHERE severity = 'Watch') AS BIGINT) AS green
FROM b_signals WHERE event_type <> 'Drought' GROUP BY event_type""")
def hazard_grade_counts(spark, folder):
    d = feeds.hazard_details(F.lit(None).cast("string"), F.col("event_type"), F.col("severity"), F.col("country"), F.col("location"), F.lit(""))
    flat = B.signals(spark, folder).select(d.alias("d")).select("d.event_type", "d.alert")
    return relational.hazard_counts(flat, ["EQ", "TC", "FL", "VO", "WF"])


@check("historical_similarity", f"""
WITH h AS (SELECT * FROM (SELECT country, headline, row_number() OVER (PARTITION BY country ORDER BY published_at DESC, url DESC) AS rn FROM b_articles WHERE published_at < {AS_OF} - INTERVAL 7 DAY) WHERE rn <= 10)
SELECT a.article_id, CAST(count(h.rn) FILTER (WHERE len(list_intersect(list_distinct({sql_tokens('a.headline')}), list_distinct({sql_tokens('h.headline')}))) >= 3) AS BIGINT) AS historical_matches
FROM b_articles a LEFT JOIN h ON h.country = a.country WHERE a.published_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY a.article_id""")
def historical_similarity(spark, folder):
    a = B.articles(spark, folder)
    cut = B.as_of() - F.make_dt_interval(F.lit(7))
    return relational.historical_matches(a.filter(F.col("published_at") >= cut), a.filter(F.col("published_at") < cut), 10).select("article_id", "historical_matches")


@check("history_overlaps", f"""
SELECT a.article_id, CAST(count(h.article_id) FILTER (WHERE len(list_intersect(list_distinct({sql_tokens('a.headline')}), list_distinct({sql_tokens('h.headline')}))) >= 3) AS BIGINT) AS historical_matches
FROM b_articles a LEFT JOIN b_articles h ON h.country = a.country AND h.published_at < {AS_OF} - INTERVAL 7 DAY WHERE a.published_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY a.article_id""")
def history_overlaps(spark, folder):
    a = B.articles(spark, folder)
    week = B.as_of() - F.make_dt_interval(F.lit(7))
    return relational.history_overlaps(a.filter(F.col("published_at") >= week), a.filter(F.col("published_at") < week)).select("article_id", "historical_matches")


# ------------------------------------------------------------------ flights
PREFIXES = ["FDX", "BAW", "UPS", "CLX", "DLH", "N/A", "GTI"]
AIRLINES = ["British Airways", "Global Cargo Lines", "Lufthansa", " Polar Air "]
VIEWS["r_flights"] = f"""
SELECT event_id, CAST(user_id AS VARCHAR) AS icao24, CASE WHEN event_id % 31 = 0 THEN ' ' ELSE lower(({text_list(PREFIXES)})[user_id % 7 + 1]) || user_id || ' ' END AS callsign, country AS monitor_country,
  CAST((event_id * 37 % 18000) / 100.0 - 90 AS DOUBLE) AS latitude, CAST((event_id * 61 % 36000) / 100.0 - 180 AS DOUBLE) AS longitude,
  CAST(event_id * 17 % 600 AS DOUBLE) AS velocity_knots, event_id % 6 = 0 AS on_ground, ts AS observed_at FROM b_events"""
VIEWS["r_routes"] = f"""
SELECT ({text_list(PREFIXES)})[c_custkey % 7 + 1] || c_custkey AS callsign, ({text_list(AIRLINES)})[c_custkey % 4 + 1] AS airline, country AS origin_country, ({text_list(B.COUNTRIES)})[(c_nationkey + c_custkey) % 25 + 1] AS destination_country,
  CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey * 13 % 160 - 80 AS DOUBLE) END AS origin_latitude, CAST(c_custkey * 29 % 340 - 170 AS DOUBLE) AS origin_longitude,
  CAST(c_custkey * 17 % 160 - 80 AS DOUBLE) AS destination_latitude, CAST(c_custkey * 31 % 340 - 170 AS DOUBLE) AS destination_longitude
FROM customer JOIN b_country ON n_nationkey = c_nationkey"""


def flights(spark, folder):
    k, user = F.col("event_id"), F.col("user_id")
    return B.events(spark, folder).select(
        k, user.cast("string").alias("icao24"),
        F.when(k % 31 == 0, " ").otherwise(F.concat(F.lower(B.pick(PREFIXES, user % 7)), user.cast("string"), F.lit(" "))).alias("callsign"),
        F.col("country").alias("monitor_country"), ((k * 37 % 18000) / 100.0 - 90).alias("latitude"), ((k * 61 % 36000) / 100.0 - 180).alias("longitude"),
        (k * 17 % 600).cast("double").alias("velocity_knots"), (k % 6 == 0).alias("on_ground"), F.col("ts").alias("observed_at"))


def routes(spark, folder):
    k = F.col("c_custkey")
    names = B.country(spark, folder).select("n_nationkey", "country")
    return table(spark, folder, "customer").join(F.broadcast(names), F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.concat(B.pick(PREFIXES, k % 7), k.cast("string")).alias("callsign"), B.pick(AIRLINES, k % 4).alias("airline"), F.col("country").alias("origin_country"),
        B.pick(B.COUNTRIES, (F.col("c_nationkey") + k) % 25).alias("destination_country"),
        F.when(k % 10 != 0, (k * 13 % 160 - 80).cast("double")).alias("origin_latitude"), (k * 29 % 340 - 170).cast("double").alias("origin_longitude"),
        (k * 17 % 160 - 80).cast("double").alias("destination_latitude"), (k * 31 % 340 - 170).cast("double").alias("destination_longitude"))


VIEWS["r_joined"] = "SELECT f.*, r.airline, r.origin_country, r.destination_country, r.origin_latitude, r.origin_longitude, r.destination_latitude, r.destination_longitude FROM r_flights f LEFT JOIN r_routes r ON r.callsign = upper(trim(f.callsign))"


def hav(a1, o1, a2, o2):
    h = f"(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2))"
    return f"(6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


@check("geo_great_circle", f"""SELECT event_id, round({hav('latitude', 'longitude', 'destination_latitude', 'destination_longitude')}, 3) AS km FROM r_joined""")
def geo_great_circle(spark, folder):
    j = transport.with_routes(flights(spark, folder), routes(spark, folder))
    return j.select("event_id", F.round(transport.great_circle_km(*[F.col(c) for c in ("latitude", "longitude", "destination_latitude", "destination_longitude")]), 3).alias("km"))


@check("geo_flight_estimates", f"""
WITH d AS (SELECT *, {hav('origin_latitude', 'origin_longitude', 'destination_latitude', 'destination_longitude')} AS rk, {hav('latitude', 'longitude', 'destination_latitude', 'destination_longitude')} AS lk,
  CASE WHEN velocity_knots = 0 THEN 800.0 ELSE least(950.0, greatest(500.0, velocity_knots * 1.852)) END AS sp FROM r_joined)
SELECT event_id, CASE WHEN rk IS NOT NULL AND lk IS NOT NULL THEN CAST(round_even(rk, 0) AS BIGINT) END AS route_km, CASE WHEN rk IS NOT NULL AND lk IS NOT NULL THEN CAST(round_even(rk / 800 * 60 + 35, 0) AS BIGINT) END AS duration_minutes,
  CASE WHEN rk IS NOT NULL AND lk IS NOT NULL THEN CAST(round_even(lk, 0) AS BIGINT) END AS remaining_km,
  CASE WHEN rk IS NOT NULL AND lk IS NOT NULL THEN CAST(epoch({AS_OF}) AS BIGINT) + 60 * CAST(round_even(lk / sp * 60 + 15, 0) AS BIGINT) END AS eta_s FROM d""")
def geo_flight_estimates(spark, folder):
    j = transport.with_routes(flights(spark, folder), routes(spark, folder))
    return j.select("event_id", transport.flight_estimates(B.as_of()).alias("e")).select(
        "event_id", "e.route_km", "e.duration_minutes", "e.remaining_km", F.unix_seconds("e.eta").alias("eta_s"))


_PFX = "substr(upper(trim(callsign)), 1, 3)"


@check("geo_cargo_flights", f"""
SELECT event_id, p IS NOT NULL OR m AS cargo, CASE WHEN p IS NOT NULL THEN 'Callsign prefix ' || {_PFX} || ' is associated with ' || p || ' freight operations'
  WHEN m THEN 'Route metadata identifies freight operator ' || trim(airline) ELSE 'No dedicated-freight operator evidence in the available callsign or route metadata' END AS basis
FROM (SELECT *, {sql_case(_PFX, V.CARGO_PREFIXES)} AS p, {sql_any("lower(coalesce(airline, ''))", V.CARGO_MARKERS)} AS m FROM r_joined)""")
def geo_cargo_flights(spark, folder):
    j = transport.with_routes(flights(spark, folder), routes(spark, folder))
    return j.select("event_id", transport.cargo_assessment(F.col("callsign"), F.col("airline")).alias("c")).select("event_id", "c.cargo", "c.basis")


@check("geo_commercial", f"""
SELECT f.event_id, NOT f.on_ground AND length(trim(f.callsign)) >= 3 AND NOT starts_with(upper(trim(f.callsign)), 'N/A') AS aircraft,
  {sql_any("lower(v.class)", V.COMMERCIAL_VESSEL_TYPES)} OR (v.ship_name <> '' AND v.speed_knots >= 0.5) AS vessel
FROM r_flights f JOIN (SELECT event_id, ship_name, speed_knots, CASE WHEN CAST(type_code AS INT) BETWEEN 60 AND 69 THEN 'Passenger' WHEN CAST(type_code AS INT) BETWEEN 70 AND 79 THEN 'Cargo' WHEN CAST(type_code AS INT) BETWEEN 80 AND 89 THEN 'Tanker' ELSE '' END AS class FROM b_positions) v USING (event_id)""")
def geo_commercial(spark, folder):
    f = flights(spark, folder).select("event_id", transport.commercial_aircraft(F.col("callsign"), F.col("on_ground")).alias("aircraft"))
    v = B.positions(spark, folder).select("event_id", transport.commercial_vessel(feeds.ais_class(F.col("type_code")), F.col("ship_name"), F.col("speed_knots")).alias("vessel"))
    return f.join(v, "event_id")


@check("geo_route_relationship", """
SELECT event_id, CASE WHEN o AND d THEN 'Domestic flight within selected country' WHEN o THEN 'Departing from selected country' WHEN d THEN 'Arriving in selected country'
  WHEN event_id % 2 = 0 THEN 'Transiting selected-country monitoring area' END AS relationship
FROM (SELECT event_id, coalesce(origin_country, '') = monitor_country AS o, coalesce(destination_country, '') = monitor_country AS d FROM r_joined)""")
def geo_route_relationship(spark, folder):
    j = transport.with_routes(flights(spark, folder), routes(spark, folder))
    return j.select("event_id", transport.country_relationship(F.col("origin_country"), F.col("destination_country"), F.col("monitor_country"), F.col("event_id") % 2 == 0).alias("relationship"))


@check("geo_route_path", """
SELECT event_id, CASE WHEN origin_latitude IS NOT NULL AND destination_latitude IS NOT NULL THEN origin_latitude + 2 * latitude + 4 * destination_latitude END AS lat_sum,
  CASE WHEN origin_latitude IS NOT NULL AND destination_latitude IS NOT NULL THEN origin_longitude + 2 * longitude + 4 * destination_longitude END AS lon_sum FROM r_joined""")
def geo_route_path(spark, folder):
    j = transport.with_routes(flights(spark, folder), routes(spark, folder)).select("event_id", transport.route_path().alias("p"))
    total = lambda f: (F.get(F.col("p")[f], F.lit(0)) + 2 * F.get(F.col("p")[f], F.lit(1)) + 4 * F.get(F.col("p")[f], F.lit(2)))
    return j.select("event_id", total("latitudes").alias("lat_sum"), total("longitudes").alias("lon_sum"))


@check("geo_route_refresh", f"""
WITH calls AS (SELECT DISTINCT upper(trim(callsign)) AS callsign FROM r_flights WHERE trim(callsign) <> ''),
cached AS (SELECT callsign, 'cached ' || airline AS airline FROM r_routes WHERE length(callsign) % 2 = 0)
SELECT c.callsign, CASE WHEN k.callsign IS NOT NULL THEN k.airline ELSE r.airline END AS airline, CASE WHEN k.callsign IS NOT NULL THEN 'cached' WHEN r.callsign IS NOT NULL THEN 'matched' ELSE 'unavailable' END AS status
FROM calls c LEFT JOIN cached k USING (callsign) LEFT JOIN r_routes r ON r.callsign = c.callsign""")
def geo_route_refresh(spark, folder):
    r = routes(spark, folder).select("callsign", "airline")
    parity = F.length("callsign") % 2
    cached = r.select("callsign", F.concat(F.lit("cached "), "airline").alias("airline"), F.lit("cached").alias("status"),
                      F.when(parity == 0, B.as_of()).otherwise(B.as_of() - F.expr("INTERVAL 2 DAYS")).alias("checked_at"))
    return transport.route_refresh(flights(spark, folder), cached, r, B.as_of()).drop("checked_at")


@check("geo_traffic_summary", f"""
WITH a AS (SELECT monitor_country, NOT on_ground AND length(trim(callsign)) >= 3 AND NOT starts_with(upper(trim(callsign)), 'N/A') AS commercial,
   {sql_case(_PFX, V.CARGO_PREFIXES)} IS NOT NULL OR {sql_any("lower(coalesce(airline, ''))", V.CARGO_MARKERS)} AS cargo FROM r_joined),
v AS (SELECT monitor_country, CAST(type_code AS INT) BETWEEN 60 AND 89 OR (ship_name <> '' AND speed_knots >= 0.5) AS commercial FROM b_positions)
SELECT monitor_country, cargo_flights, excluded_aircraft, commercial_vessels, unclassified_vessels FROM
 (SELECT monitor_country, CAST(count(*) FILTER (WHERE commercial AND cargo) AS BIGINT) AS cargo_flights, CAST(count(*) FILTER (WHERE commercial AND NOT cargo) AS BIGINT) AS excluded_aircraft FROM a GROUP BY 1)
 JOIN (SELECT monitor_country, CAST(count(*) FILTER (WHERE commercial) AS BIGINT) AS commercial_vessels, CAST(count(*) FILTER (WHERE NOT commercial) AS BIGINT) AS unclassified_vessels FROM v GROUP BY 1) USING (monitor_country)""")
def geo_traffic_summary(spark, folder):
    a = transport.with_routes(flights(spark, folder), routes(spark, folder)).select(
        "monitor_country", transport.commercial_aircraft(F.col("callsign"), F.col("on_ground")).alias("commercial"),
        transport.cargo_assessment(F.col("callsign"), F.col("airline"))["cargo"].alias("cargo"))
    v = B.positions(spark, folder).select("monitor_country", transport.commercial_vessel(feeds.ais_class(F.col("type_code")), F.col("ship_name"), F.col("speed_knots")).alias("commercial"))
    return transport.traffic_summary(a, v)


@check("geo_nearest_position", """
SELECT s_suppkey, arg_min(event_id, (d2, -event_id)) AS event_id, round(min(d2), 6) AS distance2 FROM (
  SELECT s.s_suppkey, p.event_id, pow(p.latitude - (s.s_suppkey * 71 % 18000) / 100.0 + 90, 2) + pow(p.longitude - (s.s_suppkey * 131 % 36000) / 100.0 + 180, 2) AS d2 FROM supplier s, b_positions p) GROUP BY s_suppkey""")
def geo_nearest_position(spark, folder):
    k = F.col("s_suppkey")
    pts = table(spark, folder, "supplier").select(k, ((k * 71 % 18000) / 100.0 - 90).alias("point_latitude"), ((k * 131 % 36000) / 100.0 - 180).alias("point_longitude"))
    near = transport.nearest(pts, B.positions(spark, folder), "s_suppkey", "event_id")
    return near.withColumn("distance2", F.round("distance2", 6))
