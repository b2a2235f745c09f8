"""Queries on landed payloads. The payloads are built by Spark from the driver tables, fifty rows per poll."""

from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.plans import bindings as B
from riskfabric.plans.catalog import check, table, text_list
from riskfabric.sources import landed

AS_OF = B.AS_OF_SQL


def polls(rows, struct, key="event_id", into="x"):
    """One JSON array of at most fifty rows per poll."""
    return rows.groupBy(B.div(F.col(key), 50).alias("sequence")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("__k"), struct.alias("v")))).alias("l")).select(
        "sequence", F.transform("l", lambda e: e["v"]).alias(into))


@check("feed_earthquakes", """
SELECT 'usgs-' || event_id AS id, CASE WHEN m >= 6 THEN 'Critical' WHEN m >= 5 THEN 'High' ELSE 'Watch' END AS severity, coalesce(nullif(country, 'Iran'), 'Unknown') AS location, epoch_us(ts) // 1000 AS observed_ms,
  'USGS recorded a magnitude ' || printf('%.1f', m) || ' earthquake near ' || coalesce(nullif(country, 'Iran'), 'the reported location') || '.' AS summary
FROM (SELECT *, 4.5::DOUBLE + (event_id % 25) / 10.0::DOUBLE AS m FROM b_events)""")
def feed_earthquakes(spark, folder):
    e = B.events(spark, folder)
    item = F.struct(F.col("event_id").cast("string").alias("id"), F.struct((4.5 + (F.col("event_id") % 25) / 10.0).alias("mag"), F.when(F.col("country") != "Iran", F.col("country")).otherwise("").alias("place"),
                    F.unix_millis("ts").alias("time"), F.lit("t").alias("title"), F.lit("u").alias("url")).alias("properties"), F.struct(F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")).alias("geometry"))
    p = polls(e, item, into="features").select(F.to_json(F.struct("features")).alias("payload"))
    return landed.earthquakes(p, B.as_of()).select("id", "severity", "location", F.unix_millis("observed_at").alias("observed_ms"), "summary")


@check("feed_hazards", """
WITH x AS (SELECT *, (['EQ','TC','FL','VO','DR','WF'])[event_id % 6 + 1] AS kind, event_id % 400 AS eid FROM b_events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0)
SELECT 'gdacs-' || kind || '-' || eid AS id, max_by(CASE event_id % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' ELSE 'Watch' END, event_id) AS severity, max_by('GDACS ' || (['red','orange','green'])[event_id % 3 + 1] || ' alert: Event ' || event_id || ' in ' || country, event_id) AS summary,
  max_by(country, event_id) AS location FROM x GROUP BY kind, eid""")
def feed_hazards(spark, folder):
    k = F.col("event_id")
    item = F.struct(F.struct(F.when(k % 7 == 0, "Polygon").otherwise("Point").alias("type"), F.array(F.when(k % 13 == 0, "bad").otherwise("10.5"), F.lit("20")).alias("coordinates")).alias("geometry"),
                    F.struct(F.when(k % 11 == 0, "False").otherwise("true").alias("iscurrent"), B.pick(list(V.HAZARD_LABELS), k % 6).alias("eventtype"), (k % 400).cast("string").alias("eventid"),
                             B.pick(["Red", "Orange", "Green"], k % 3).alias("alertlevel"), F.concat(F.lit("<p>Event  "), k.cast("string"), F.lit("</p> in <b>"), F.col("country"), F.lit("</b>")).alias("htmldescription"), "country").alias("properties"))
    p = polls(B.events(spark, folder), item, into="features").select("sequence", F.lit("EQ").alias("requested_type"), F.to_json(F.struct("features")).alias("payload"))
    return landed.hazards(p, B.as_of()).select("id", "severity", "summary", "location")


@check("feed_conflict_events", f"""
WITH x AS (SELECT event_id, country, user_id, ts, CAST(10 + event_id % 11 AS INT) AS root, event_id % 5 AS quad, event_id % 9 AS sources, (event_id * 7919) % 1000 AS articles FROM b_events WHERE event_id % 17 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id // 200, country, root ORDER BY articles DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM x WHERE root >= 12)
SELECT 'gdelt-' || event_id AS id, CASE WHEN quad = 4 AND articles >= 20 THEN 'Critical' WHEN quad >= 3 THEN 'High' ELSE 'Watch' END AS severity, CAST(least(97, 65 + sources * 3) AS INT) AS confidence, country AS location, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS observed_s
FROM b WHERE rn = 1""")
def feed_conflict_events(spark, folder):
    k = F.col("event_id")
    cells = {0: k.cast("string"), 28: (10 + k % 11).cast("string"), 29: (k % 5).cast("string"), 31: F.lit(""), 32: (k % 9).cast("string"), 33: (k * 7919 % 1000).cast("string"), 52: F.col("country"),
             56: F.when(k % 17 == 0, "").otherwise("1.5"), 57: F.lit("2.5"), 59: F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), 60: F.lit("https://www.site.test/a")}
    lines = B.events(spark, folder).select(B.div(k, 200).alias("export"), F.array_join(F.array(*[cells.get(i, F.lit("")) for i in range(61)]), "\t").alias("value"))
    return landed.conflict_events(lines, B.as_of()).select("id", "severity", "confidence", "location", F.unix_seconds("observed_at").alias("observed_s"))


@check("feed_ais_frames", """
WITH f AS (SELECT event_id AS sequence, event_id % 500 + 1 AS mmsi, event_id % 5 AS k, event_id, ts FROM b_events WHERE event_id % 23 <> 0),
p AS (SELECT * FROM f WHERE k < 3),
s AS (SELECT * FROM f WHERE k >= 3),
j AS (SELECT p.sequence, p.mmsi, p.event_id, max(s.sequence) FILTER (WHERE s.sequence < p.sequence) AS before, max(s.sequence) AS final, p.sequence = max(p.sequence) OVER (PARTITION BY p.mmsi) AS newest
  FROM p LEFT JOIN s ON s.mmsi = p.mmsi GROUP BY p.sequence, p.mmsi, p.event_id),
c AS (SELECT *, CASE WHEN newest THEN final ELSE before END AS st FROM j)
SELECT sequence, CAST(mmsi AS VARCHAR) AS mmsi, CASE WHEN st IS NOT NULL THEN 'SHIP ' || st WHEN event_id % 4 = 0 THEN 'Own ' || event_id ELSE 'MMSI ' || mmsi END AS ship_name,
  CASE WHEN st % 5 = 3 THEN 'Cargo' WHEN newest AND before % 5 = 3 AND st % 5 = 4 THEN 'Cargo' ELSE '' END AS vessel_type,
  CASE WHEN st % 5 = 3 THEN '05/03 10:00 UTC' WHEN newest AND before % 5 = 3 AND st % 5 = 4 THEN '05/03 10:00 UTC' ELSE '' END AS eta,
  (event_id % 90)::DOUBLE AS latitude, (event_id % 30) / 2.0::DOUBLE AS speed_knots FROM c""")
def feed_ais_frames(spark, folder):
    """Frames of all five message types, as their stream carries them."""
    e = B.events(spark, folder)
    k = F.col("event_id")
    kind = B.pick([*landed.POSITION_KINDS, *landed.STATIC_KINDS], k % 5)
    meta = F.struct(F.when(k % 23 != 0, (k % 500 + 1)).alias("MMSI"), F.when((k % 5 < 3) & (k % 4 == 0), F.concat(F.lit("Own "), k.cast("string"))).alias("ShipName"))
    position = F.struct((k % 90).cast("double").alias("Latitude"), F.lit(5.0).alias("Longitude"), ((k % 30) / 2.0).alias("Sog"))
    full = F.struct(F.concat(F.lit("SHIP "), k.cast("string"), F.lit("  ")).alias("Name"), F.lit(70).alias("Type"), F.struct(F.lit(3).alias("Month"), F.lit(5).alias("Day"), F.lit(10).alias("Hour"), F.lit(0).alias("Minute")).alias("Eta"))
    short = F.struct(F.concat(F.lit("SHIP "), k.cast("string")).alias("Name"))
    body = F.struct(*[F.when(k % 5 == i, part).alias(name) for i, (name, part) in enumerate(zip([*landed.POSITION_KINDS, *landed.STATIC_KINDS], [position] * 3 + [full, short]))])
    frames = e.select(k.alias("sequence"), F.to_json(F.struct(kind.alias("MessageType"), meta.alias("MetaData"), body.alias("Message"))).alias("payload"))
    return landed.merge_frames(landed.ais_frames(frames, B.as_of())).select("sequence", "mmsi", "ship_name", "vessel_type", "eta", "latitude", "speed_knots")


@check("feed_article_list", f"""
SELECT article_id, CASE WHEN article_id % 4 = 0 THEN 'Untitled report' ELSE headline END AS headline, publisher || '.test' AS publisher, CAST(epoch(CASE WHEN article_id % 5 = 0 THEN {AS_OF} ELSE published_at END) AS BIGINT) AS published_s FROM b_articles""")
def feed_article_list(spark, folder):
    k = F.col("article_id")
    item = F.struct(F.when(k % 5 != 0, F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'")).alias("seendate"), "url", F.when(k % 3 != 0, F.concat("publisher", F.lit(".test"))).otherwise("").alias("domain"), F.when(k % 4 != 0, F.col("headline")).otherwise("").alias("title"))
    p = polls(B.articles(spark, folder), item, "article_id", "articles").select(F.to_json(F.struct("articles")).alias("payload"))
    return landed.article_list(p, B.as_of()).select(F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint").alias("article_id"), "headline", "publisher", F.unix_seconds("published_at").alias("published_s"))


@check("feed_rss_articles", """
SELECT article_id, headline, CASE article_id % 3 WHEN 0 THEN 'Author ' || article_id WHEN 1 THEN 'Outlet' ELSE publisher END AS publisher, CAST(epoch(published_at) AS BIGINT) - CASE WHEN article_id % 2 = 0 THEN 7200 ELSE 0 END AS published_s, 'https://x.test/' || article_id AS url FROM b_articles""")
def feed_rss_articles(spark, folder):
    k = F.col("article_id")
    text = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    items = B.articles(spark, folder).select(F.concat(
        F.lit("<item><title>"), text(F.col("headline")), F.lit("</title><link>https://r.test/?url=https%3A%2F%2Fx.test%2F"), k.cast("string"), F.lit("</link><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"),
        F.when(k % 2 == 0, " +0200").otherwise(" GMT"), F.lit("</pubDate>"), F.when(k % 3 == 0, F.concat(F.lit("<author>Author "), k.cast("string"), F.lit("</author>"))).when(k % 3 == 1, '<source url="https://o.test">Outlet</source>').otherwise(""), F.lit("</item>")).alias("xml"))
    parsed = items.select(F.from_xml("xml", landed.RSS_ITEM).alias("i")).select("i.*")
    return landed.rss_articles(parsed, B.as_of()).select(F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint").alias("article_id"), "headline", "publisher", F.unix_seconds("published_at").alias("published_s"), "url")


@check("feed_coastal_positions", """
SELECT mmsi, event_id, CASE WHEN CAST(mmsi AS BIGINT) % 3 = 0 THEN 'MMSI ' || mmsi ELSE 'Ship ' || mmsi END AS ship_name, CASE WHEN CAST(mmsi AS BIGINT) % 3 = 0 THEN '' ELSE 'Tanker' END AS vessel_type, latitude, longitude, CAST(floor(epoch(observed_at)) AS BIGINT) AS observed_s,
  CASE WHEN CAST(mmsi AS BIGINT) % 3 <> 0 THEN (CAST(mmsi AS BIGINT) % 90) / 10.0::DOUBLE END AS draught_m FROM b_positions""")
def feed_coastal_positions(spark, folder):
    k, m = F.col("event_id"), F.col("mmsi").cast("bigint")
    p = B.positions(spark, folder)
    seconds = F.unix_seconds("observed_at")
    item = F.struct(m.alias("mmsi"), F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), F.struct(F.when(k % 2 == 0, seconds * 1000).otherwise(seconds).alias("timestampExternal"), k.cast("double").alias("sog")).alias("properties"))
    polled = polls(p, item, into="features").select(F.when(F.col("sequence") % 2 == 0, F.to_json(F.struct("features"))).otherwise(F.to_json("features")).alias("payload"))
    v = p.select(m.alias("mmsi")).distinct().filter(F.col("mmsi") % 3 != 0).select("mmsi", F.struct("mmsi", F.concat(F.lit("Ship "), F.col("mmsi").cast("string")).alias("name"), F.lit(82).alias("shipType"), (F.col("mmsi") % 90).alias("draught")).alias("v"))
    meta = polls(v, F.col("v"), "mmsi", "vessels").select(F.to_json(F.struct("vessels")).alias("payload"))
    return landed.coastal_positions(polled, meta, B.as_of()).select("mmsi", F.col("speed_knots").cast("bigint").alias("event_id"), "ship_name", "vessel_type", "latitude", "longitude", F.unix_seconds("observed_at").alias("observed_s"), "draught_m")


@check("feed_combined_positions", """
SELECT mmsi, event_id, CASE WHEN event_id % 5 = 0 THEN 'MMSI ' || mmsi ELSE ship_name END AS ship_name, destination, CASE WHEN event_id % 60 > 25 THEN (event_id % 60) / 10.0::DOUBLE ELSE (event_id % 60)::DOUBLE END AS draught_m, CAST(floor(epoch(observed_at)) AS BIGINT) AS observed_s FROM b_positions WHERE event_id % 8 <> 0""")
def feed_combined_positions(spark, folder):
    k = F.col("event_id")
    item = F.struct("mmsi", F.col("ship_name").alias("name"), F.col("type_code").alias("shipType"), "destination", (k % 60).cast("double").alias("draught"), F.when(k % 8 != 0, F.col("latitude")).alias("latitude"), "longitude",
                    k.cast("double").alias("speedOverGround"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("msgtime"))
    p = polls(B.positions(spark, folder), item, into="rows").select(F.to_json("rows").alias("payload"))
    return landed.combined_positions(p, B.as_of()).select("mmsi", F.col("speed_knots").cast("bigint").alias("event_id"), "ship_name", "destination", "draught_m", F.unix_seconds("observed_at").alias("observed_s"))


@check("feed_identity_enrichment", """
WITH v AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS e FROM b_events WHERE user_id % 4 <> 3 GROUP BY user_id)
SELECT p.event_id, p.mmsi, CASE WHEN p.imo <> '' THEN p.imo WHEN CAST(p.mmsi AS BIGINT) % 4 <> 3 THEN 'I' || p.mmsi ELSE '' END AS imo, CASE WHEN v.e IS NULL THEN '' ELSE 'Port ' || v.e END AS last_port FROM b_positions p LEFT JOIN v ON CAST(v.user_id AS VARCHAR) = p.mmsi""")
def feed_identity_enrichment(spark, folder):
    e = B.events(spark, folder).filter(F.col("user_id") % 4 != 3)
    user, none = F.col("user_id").cast("string"), F.lit(None).cast("string")
    ids = e.select(user.alias("mmsi")).distinct().select("mmsi", F.concat(F.lit("v"), "mmsi").alias("vessel_id"), none.alias("shipname"), F.concat(F.lit("I"), "mmsi").alias("imo"), none.alias("callsign"), none.alias("shiptype"))
    port = F.concat(F.lit("Port "), F.col("event_id").cast("string"))
    layout = F.col("event_id") % 3
    payload = (F.when(layout == 0, F.to_json(F.struct(F.struct(port.alias("name")).alias("port_visit")))).when(layout == 1, F.to_json(F.struct(port.alias("portName"))))
                .otherwise(F.to_json(F.struct(F.struct(F.struct(port.alias("label")).alias("port")).alias("regions")))))
    visits = e.select(F.concat(F.lit("v"), user).alias("vessel_id"), F.struct("ts", "event_id").alias("start"), payload.alias("payload"))
    ships = B.positions(spark, folder).withColumns({"vessel_type": F.lit(""), "last_port": F.lit(""), "source": F.lit("AIS")})
    return landed.enrich_identity(ships, ids, visits).select("event_id", "mmsi", "imo", "last_port")


@check("feed_aircraft_states", """
SELECT CAST(user_id AS VARCHAR) AS icao24, event_id, CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'CS' || event_id END AS callsign, CASE WHEN event_id % 3 = 0 THEN 100.0 ELSE 50.5 END::DOUBLE AS altitude_m, round((event_id % 300) * 1.94384::DOUBLE, 6) AS velocity_knots, event_id % 2 = 0 AS on_ground
FROM b_events WHERE event_id % 9 <> 0""")
def feed_aircraft_states(spark, folder):
    k = F.col("event_id")
    t = lambda c: c.cast("string")
    cells = {0: t(F.col("user_id")), 1: F.when(k % 4 != 0, F.concat(F.lit("CS"), t(k), F.lit(" "))), 2: F.col("country"), 5: F.when(k % 9 != 0, "1.25"), 6: F.lit("2.5"), 7: F.lit("50.5"), 8: t(k % 2 == 0), 9: t(k % 300), 10: t(k), 13: F.when(k % 3 == 0, "100")}
    state = F.array(*[cells.get(i, F.lit(None).cast("string")) for i in range(17)])
    p = polls(B.events(spark, folder), state, into="states").select(F.to_json(F.struct(F.lit(1706659200).alias("time"), "states")).alias("payload"))
    out = landed.aircraft_states(p, B.as_of(), F.lit("Global"))
    return out.select("icao24", F.col("track_degrees").cast("bigint").alias("event_id"), "callsign", "altitude_m", F.round("velocity_knots", 6).alias("velocity_knots"), "on_ground")
