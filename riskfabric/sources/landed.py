"""Landed feed payloads to tables. Every reader takes a DataFrame with one payload text per row.

A payload is the answer of one poll, so its size is bounded by the provider; parsing is one
``from_json`` per payload and an ``explode``, and nothing is collected.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions import feeds, places
from riskfabric.functions.text import blank, direct_url, lookup, strip_markup
from riskfabric.operators.store import latest_per_key, top_per_key


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file with its text as ``payload``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def with_signal_defaults(df: DataFrame, collected_at: Column) -> DataFrame:
    """Fill collection time, country (location, else Global) and the raw payload."""
    def existing(name, kind="string"):
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)
    return (df.withColumn("collected_at", F.coalesce(existing("collected_at", "timestamp"), collected_at))
              .withColumn("country", F.coalesce(existing("country"), existing("location"), F.lit("Global")))
              .withColumn("raw_json", F.coalesce(existing("raw_json"), F.lit("{}"))))


def earthquakes(payloads: DataFrame, collected_at: Column, limit: int = None) -> DataFrame:
    """GeoJSON feed to signals; with ``limit`` the first features of each poll only (the feed is newest first)."""
    schema = ("features array<struct<id:string,properties:struct<mag:double,place:string,time:bigint,title:string,url:string>,"
              "geometry:struct<coordinates:array<double>>>>")
    features = F.from_json("payload", schema)["features"]
    f = payloads.select(F.explode(features if limit is None else F.slice(features, 1, limit)).alias("f")).select("f.*")
    p, mag = F.col("properties"), F.coalesce(F.col("properties.mag"), F.lit(0.0))
    place = F.nullif(p["place"], F.lit(""))
    rows = f.select(
        F.concat(F.lit("usgs-"), "id").alias("id"), F.lit("USGS").alias("source"), F.lit("Seismic").alias("event_type"), p["title"].alias("title"),
        F.coalesce(place, F.lit("Unknown")).alias("location"), F.get("geometry.coordinates", F.lit(1)).alias("latitude"), F.get("geometry.coordinates", F.lit(0)).alias("longitude"),
        F.when(mag >= 6, "Critical").when(mag >= 5, "High").otherwise("Watch").alias("severity"), F.lit(98).alias("confidence"),
        F.concat(F.lit("USGS recorded a magnitude "), F.format_string("%.1f", mag), F.lit(" earthquake near "), F.coalesce(place, F.lit("the reported location")), F.lit(".")).alias("summary"),
        F.lit("Monitor official shaking, tsunami and infrastructure advisories.").alias("outlook"), p["url"].alias("source_url"), F.lit("USGS").alias("source_name"),
        F.timestamp_millis(p["time"]).alias("observed_at"))
    return with_signal_defaults(rows, collected_at)


def hazards(payloads: DataFrame, collected_at: Column) -> DataFrame:
    """Hazard event lists (``payload``, ``requested_type``) to signals; the last poll of an event wins.

    A poll that failed is simply not landed, so one hazard type never blocks the others. ``sequence`` orders the polls.
    """
    schema = ("features array<struct<geometry:struct<type:string,coordinates:array<string>>,properties:struct<iscurrent:string,eventtype:string,eventid:string,alertlevel:string,"
              "url:struct<report:string>,htmldescription:string,description:string,eventname:string,name:string,country:string>>>")
    f = payloads.select("requested_type", "sequence", F.posexplode(F.from_json("payload", schema)["features"]).alias("at", "f"))
    p, g = F.col("f.properties"), F.col("f.geometry")
    lon, lat = F.get(g["coordinates"], F.lit(0)).try_cast("double"), F.get(g["coordinates"], F.lit(1)).try_cast("double")
    kept = f.filter((g["type"] == "Point") & (F.lower(F.trim(blank(p["iscurrent"]))) != "false") & lon.isNotNull() & lat.isNotNull() & p["eventid"].isNotNull())
    full = lambda c: F.nullif(c, F.lit(""))
    kind = F.upper(F.coalesce(full(p["eventtype"]), F.col("requested_type")))
    label = F.element_at(lookup(V.HAZARD_LABELS), kind)
    alert = F.lower(F.coalesce(full(p["alertlevel"]), F.lit("green")))
    rows = kept.select(
        F.concat(F.lit("gdacs-"), kind, F.lit("-"), p["eventid"]).alias("id"), F.lit("GDACS").alias("source"), F.coalesce(label, kind).alias("event_type"),
        F.coalesce(full(p["eventname"]), full(p["name"]), full(p["description"]), F.concat(F.coalesce(label, F.lit("Hazard")), F.lit(" alert"))).alias("title"),
        F.coalesce(full(p["country"]), F.lit("Global")).alias("location"), lat.alias("latitude"), lon.alias("longitude"),
        F.when(alert == "red", "Critical").when(alert == "orange", "High").otherwise("Watch").alias("severity"), F.lit(95).alias("confidence"),
        F.trim(F.concat(F.lit("GDACS "), alert, F.lit(" alert: "), strip_markup(F.coalesce(full(p["htmldescription"]), p["description"])))).alias("summary"),
        F.lit("Review the official GDACS report, affected countries, event dates and available footprint geometry.").alias("outlook"),
        F.coalesce(full(p["url"]["report"]), F.lit("https://www.gdacs.org/")).alias("source_url"), F.lit("GDACS").alias("source_name"), collected_at.alias("observed_at"),
        F.to_json(F.col("f")).alias("raw_json"), "sequence", "at")
    return with_signal_defaults(latest_per_key(rows, ["id"], ["sequence", "at"]).drop("sequence", "at"), collected_at)


def conflict_events(lines: DataFrame, collected_at: Column, limit: int = None, export="export") -> DataFrame:
    """Tab-separated event exports (columns ``value`` and the name of the ``export``) to signals.

    Most reported row per export, place and root code; with ``limit`` the most reported ones of each export only.
    """
    c = F.split(F.col("value"), "\t", -1)
    at = lambda i: F.get(c, F.lit(i))
    whole = lambda i: F.coalesce(F.nullif(at(i), F.lit("")).try_cast("int"), F.lit(0))
    df = lines.filter(F.size(c) > 60).select(
        F.col(export).alias("export"), at(0).alias("event_id"), at(28).alias("root"), whole(28).alias("root_n"), whole(29).alias("quad"), whole(31).alias("mentions"), whole(32).alias("sources"), whole(33).alias("articles"),
        at(52).alias("place"), at(56).try_cast("double").alias("latitude"), at(57).try_cast("double").alias("longitude"), at(59).alias("added"), at(60).alias("url"))
    df = df.filter((F.col("url") != "") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("root_n") >= 12))
    best = latest_per_key(df, ["export", "place", "root"], ["articles", "event_id"])
    if limit is not None:
        best = top_per_key(best, ["export"], [F.desc("articles"), F.desc("event_id")], limit)
    kind = F.coalesce(F.element_at(lookup(V.CONFLICT_ROOTS), F.col("root")), F.concat(F.lit("Event "), "root"))
    place = F.coalesce(F.nullif("place", F.lit("")), F.lit("Unknown location"))
    host = F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"www\.", "")
    text = lambda n: F.col(n).cast("string")
    rows = best.select(
        F.concat(F.lit("gdelt-"), "event_id").alias("id"), F.lit("GDELT").alias("source"), kind.alias("event_type"), F.concat(kind, F.lit(" signal near "), place).alias("title"),
        place.alias("location"), "latitude", "longitude", F.when((F.col("quad") == 4) & (F.col("articles") >= 20), "Critical").when(F.col("quad") >= 3, "High").otherwise("Watch").alias("severity"),
        F.least(F.lit(97), 65 + F.col("sources") * 3).alias("confidence"),
        F.concat(F.lit("GDELT identified a "), F.lower(kind), F.lit(" signal referenced in "), text("articles"), F.lit(" articles from "), text("sources"), F.lit(" sources with "), text("mentions"), F.lit(" mentions.")).alias("summary"),
        F.lit("Corroborate the source report and monitor later GDELT updates for persistence or escalation.").alias("outlook"), F.col("url").alias("source_url"),
        F.coalesce(F.nullif(host, F.lit("")), F.lit("GDELT source")).alias("source_name"), F.coalesce(compact_time(F.col("added")), collected_at).alias("observed_at"))
    return with_signal_defaults(rows, collected_at)


def compact_time(text: Column) -> Column:
    """``yyyyMMddTHHmmssZ`` to a timestamp."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def article_list(payloads: DataFrame, collected_at: Column) -> DataFrame:
    """JSON article index to feed items."""
    schema = "articles array<struct<seendate:string,url:string,domain:string,title:string>>"
    a = payloads.select(F.explode(F.from_json("payload", schema)["articles"]).alias("a")).select("a.*")
    url = blank(F.col("url"))
    host = F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    publisher = F.coalesce(F.nullif("domain", F.lit("")), host, F.lit("GDELT source"))
    return a.select(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled report")).alias("headline"), publisher.alias("publisher"), F.lit("International").alias("coverage_scope"),
                    url.alias("url"), url.alias("source_home"), F.coalesce(compact_time(F.col("seendate")), F.try_to_timestamp("seendate"), collected_at).alias("published_at"),
                    F.lit("").alias("description"), F.lit("GDELT-indexed news").alias("source_type"), F.lit("GDELT").alias("indexed_by"), places.source_family(publisher, url).alias("source_family"))


RSS_ITEM = ("title string, link string, pubDate string, updated string, description string, author string, news_source string, "
            "source struct<_VALUE:string,_url:string>")


def rss_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files through the XML reader."""
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)


def rss_articles(items: DataFrame, collected_at: Column, coverage_scope="International", source_type="News reporting") -> DataFrame:
    """RSS items to feed items: publisher fallbacks, RFC-822 dates, unwrapped links."""
    headline = F.coalesce("title", F.lit("Untitled report"))
    named = F.coalesce(*[F.nullif(c, F.lit("")) for c in (F.col("news_source"), F.col("author"), F.col("source._VALUE"))])
    suffix = F.when(headline.contains(" - "), F.regexp_extract(headline, r"(?s)^.* - (.*)$", 1))
    publisher = F.coalesce(named, suffix, F.lit("News source"))
    written = F.coalesce("pubDate", "updated")
    bare = F.regexp_replace(F.regexp_replace(written, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT)$", "+0000")
    when = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(written), collected_at)
    home = F.coalesce(F.nullif("source._url", F.lit("")), F.col("link"))
    return items.select(headline.alias("headline"), publisher.alias("publisher"), F.lit(coverage_scope).alias("coverage_scope"), direct_url(F.col("link")).alias("url"), home.alias("source_home"),
                        when.alias("published_at"), blank(F.col("description")).alias("description"), F.lit(source_type).alias("source_type"), places.source_family(publisher, home).alias("source_family"))


POSITION = ["mmsi", "ship_name", "vessel_type", "imo", "call_sign", "last_port", "destination", "eta", "draught_m", "latitude", "longitude", "speed_knots", "course", "heading",
            "observed_at", "collected_at", "source", "monitor_country"]


def _items(value: Column) -> Column:
    """Rows of a payload that is a list, or holds one under features, vessels, locations or data."""
    array = lambda path: F.try_variant_get(value, path, "array<variant>")
    return F.coalesce(array("$"), array("$.features"), array("$.vessels"), array("$.locations"), array("$.data"))


def _first(item: Column, *paths, kind="string") -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(item, p, kind), F.lit("")) if kind == "string" else F.try_variant_get(item, p, kind) for p in paths])


def coastal_positions(locations: DataFrame, metadata: DataFrame, collected_at: Column, area="Finland", provider="Fintraffic AIS") -> DataFrame:
    """Positions joined with vessel metadata by MMSI; several payload layouts, seconds or milliseconds."""
    m = metadata.select(F.explode(_items(F.try_parse_json("payload"))).alias("i"))
    prop = lambda n: (f"$.properties.{n}", f"$.{n}")
    meta = m.select(_first(F.col("i"), *prop("mmsi"), *prop("MMSI"), *prop("id")).alias("mmsi"), _first(F.col("i"), *prop("name")).alias("name"),
                    _first(F.col("i"), *prop("shipType"), *prop("type")).alias("type"), _first(F.col("i"), *prop("imo")).alias("imo"), _first(F.col("i"), *prop("callSign")).alias("call"),
                    _first(F.col("i"), *prop("destination")).alias("destination"), _first(F.col("i"), *prop("eta"), kind="bigint").alias("eta"),
                    _first(F.col("i"), *prop("draught"), kind="double").alias("draught")).filter(F.col("mmsi").isNotNull())
    meta = latest_per_key(meta, ["mmsi"], ["name", "type"])
    number = lambda *p: _first(F.col("i"), *p, kind="double")
    loc = locations.select(F.explode(_items(F.try_parse_json("payload"))).alias("i"))
    raw = F.coalesce(number(*prop("timestampExternal")), number(*prop("timestamp")), number(*prop("time")))
    seconds = F.when(raw > 10_000_000_000, raw / 1000).otherwise(raw)
    written = _first(F.col("i"), *prop("timestampExternal"), *prop("timestamp"), *prop("time"))
    pos = loc.select(_first(F.col("i"), "$.mmsi", "$.properties.mmsi", *prop("MMSI"), *prop("id")).alias("mmsi"),
                     F.coalesce(number("$.geometry.coordinates[1]"), number(*prop("latitude")), number(*prop("lat"))).alias("latitude"),
                     F.coalesce(number("$.geometry.coordinates[0]"), number(*prop("longitude")), number(*prop("lon"))).alias("longitude"),
                     *[F.coalesce(number(*prop(n)), F.lit(0.0)).alias(a) for n, a in (("sog", "speed_knots"), ("cog", "course"), ("heading", "heading"))],
                     F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("bigint")), F.try_to_timestamp(written), collected_at).alias("observed_at"))
    pos = pos.filter(F.col("mmsi").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    text = lambda c: F.trim(blank(F.col(c)))
    return pos.join(meta, "mmsi", "left").select(
        "mmsi", F.trim(F.coalesce("name", F.concat(F.lit("MMSI "), "mmsi"))).alias("ship_name"), feeds.ais_class(F.col("type")).alias("vessel_type"), text("imo").alias("imo"),
        text("call").alias("call_sign"), F.lit("").alias("last_port"), text("destination").alias("destination"), feeds.ais_eta(F.col("eta")).alias("eta"), (F.col("draught") / 10).alias("draught_m"),
        "latitude", "longitude", "speed_knots", "course", "heading", "observed_at", collected_at.alias("collected_at"), F.lit(provider).alias("source"), F.lit(area).alias("monitor_country"))


def combined_positions(payloads: DataFrame, collected_at: Column, area="Norway", provider="BarentsWatch AIS") -> DataFrame:
    """Combined position records; draughts above 25 are decimetres."""
    schema = ("array<struct<mmsi:string,name:string,shipType:string,imoNumber:string,callSign:string,destination:string,eta:string,draught:double,latitude:double,longitude:double,"
              "speedOverGround:double,courseOverGround:double,trueHeading:double,msgtime:string>>")
    i = payloads.select(F.explode(F.from_json("payload", schema)).alias("i")).select("i.*")
    i = i.filter((F.trim(blank(F.col("mmsi"))) != "") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    text, number = (lambda c: F.trim(blank(F.col(c)))), (lambda c: F.coalesce(c, F.lit(0.0)))
    return i.select(
        F.trim("mmsi").alias("mmsi"), F.trim(F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("MMSI "), "mmsi"))).alias("ship_name"), feeds.ais_class(F.col("shipType")).alias("vessel_type"),
        text("imoNumber").alias("imo"), text("callSign").alias("call_sign"), F.lit("").alias("last_port"), text("destination").alias("destination"), text("eta").alias("eta"),
        F.when(F.col("draught") > 25, F.col("draught") / 10).otherwise(F.col("draught")).alias("draught_m"), "latitude", "longitude", number("speedOverGround").alias("speed_knots"),
        number("courseOverGround").alias("course"), number("trueHeading").alias("heading"), F.coalesce(F.try_to_timestamp("msgtime"), collected_at).alias("observed_at"),
        collected_at.alias("collected_at"), F.lit(provider).alias("source"), F.lit(area).alias("monitor_country"))


def port_label(visit: Column) -> Column:
    """Port name across the known layouts of a port-visit payload (variant)."""
    paths = ["$.port_visit.name", "$.port_visit.portName", "$.portVisit.name", "$.portVisit.portName", "$.portName", "$.regions.namedAnchorage.name", "$.regions.namedAnchorage.label",
             "$.regions.namedAnchorage", "$.regions.port.name", "$.regions.port.label", "$.regions.port"]
    text = lambda p: F.nullif(F.try_variant_get(visit, p, "string"), F.lit(""))
    return F.trim(F.coalesce(*[F.when(~F.coalesce(text(p), F.lit("")).startswith("{"), text(p)) for p in paths]))


def enrich_identity(vessels: DataFrame, identities: DataFrame, visits: DataFrame) -> DataFrame:
    """Fill missing identity fields and the newest port. ``identities`` (mmsi, vessel_id, shipname, imo, callsign, shiptype); ``visits`` (vessel_id, start, payload)."""
    one = latest_per_key(identities, ["mmsi"], ["vessel_id"]).select("mmsi", "vessel_id", *[F.col(c).alias(f"__{c}") for c in ("shipname", "imo", "callsign", "shiptype")])
    newest = visits.groupBy("vessel_id").agg(F.max_by("payload", F.struct("start", "payload")).alias("__visit"))
    joined = vessels.join(one, "mmsi", "left").join(newest, "vessel_id", "left")
    fill = lambda own, other: F.coalesce(F.nullif(own, F.lit("")), F.col(f"__{other}"), F.lit(""))
    out = joined.withColumns({
        "ship_name": fill("ship_name", "shipname"), "imo": fill("imo", "imo"), "call_sign": fill("call_sign", "callsign"), "vessel_type": fill("vessel_type", "shiptype"),
        "last_port": F.coalesce(F.nullif(port_label(F.try_parse_json("__visit")), F.lit("")), blank(F.col("last_port"))),
        "source": F.when(F.col("vessel_id").isNotNull(), F.concat(F.coalesce("source", F.lit("AIS")), F.lit(" + Global Fishing Watch"))).otherwise(F.col("source"))})
    return out.select(*vessels.columns)


def aircraft_states(payloads: DataFrame, collected_at: Column, area: Column, provider="OpenSky") -> DataFrame:
    """Positional state arrays (at least 17 entries) to aircraft rows."""
    p = payloads.select(area.alias("monitor_country"), F.try_parse_json("payload").alias("p"))
    s = p.select("monitor_country", F.timestamp_seconds(F.try_variant_get("p", "$.time", "double")).alias("time"), F.explode(F.try_variant_get("p", "$.states", "array<array<string>>")).alias("s"))
    text = lambda i: F.nullif(F.get("s", F.lit(i)), F.lit(""))
    number = lambda i: text(i).try_cast("double")
    return s.filter((F.size("s") >= 17) & number(5).isNotNull() & number(6).isNotNull()).select(
        text(0).alias("icao24"), F.trim(F.coalesce(text(1), text(0))).alias("callsign"), F.coalesce(text(2), F.lit("Unknown")).alias("origin_country"), number(5).alias("longitude"), number(6).alias("latitude"),
        F.coalesce(number(13), number(7)).alias("altitude_m"), (F.coalesce(number(9), F.lit(0.0)) * 1.94384).alias("velocity_knots"), F.coalesce(number(10), F.lit(0.0)).alias("track_degrees"),
        F.coalesce(number(11), F.lit(0.0)).alias("vertical_rate"), F.coalesce(text(8).try_cast("boolean"), F.lit(False)).alias("on_ground"), F.coalesce("time", collected_at).alias("observed_at"),
        collected_at.alias("collected_at"), "monitor_country", F.lit(provider).alias("source"))


STATIC_KINDS = ("ShipStaticData", "StaticDataReport")
POSITION_KINDS = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")


def ais_frames(frames: DataFrame, collected_at: Column) -> DataFrame:
    """Raw AIS stream frames (``payload``, ``sequence``) as static and position rows, ready for ``merge_frames``.

    A frame is static by its message type or because it carries a static message. Frames without a vessel, and positions without a place, mean nothing.
    """
    v = F.try_parse_json("payload")
    under = lambda kinds, *fields: [f"$.Message.{kind}.{field}" for kind in kinds for field in fields]
    meta = lambda *fields: [f"$.{group}.{field}" for group in ("MetaData", "Metadata") for field in fields]
    text = lambda *paths: F.trim(blank(_first(v, *paths)))
    number = lambda *paths: _first(v, *paths, kind="double")
    static = F.coalesce(_first(v, "$.MessageType").isin(*STATIC_KINDS), F.lit(False)) | (_first(v, *[f"$.Message.{kind}" for kind in STATIC_KINDS]).isNotNull())
    part = lambda name: _first(v, *under(STATIC_KINDS, f"Eta.{name}"), kind="int")
    rows = frames.select(
        "sequence", F.when(static, "static").otherwise("position").alias("kind"),
        F.when(static, text(*meta("MMSI"), *under(STATIC_KINDS, "UserID"))).otherwise(text(*meta("MMSI"), *under(POSITION_KINDS, "UserID"))).alias("mmsi"),
        F.when(static, text(*under(STATIC_KINDS, "Name"), *meta("ShipName"))).otherwise(text(*meta("ShipName"))).alias("ship_name"),
        feeds.ais_class(F.when(static, _first(v, *under(STATIC_KINDS, "Type"), *meta("ShipType"))).otherwise(_first(v, *meta("ShipType"), *under(POSITION_KINDS, "ShipType")))).alias("vessel_type"),
        text(*under(STATIC_KINDS, "ImoNumber")).alias("imo"), text(*under(STATIC_KINDS, "CallSign")).alias("call_sign"), text(*under(STATIC_KINDS, "Destination")).alias("destination"),
        feeds.ais_eta_parts(part("Month"), part("Day"), part("Hour"), part("Minute")).alias("eta"), number(*under(STATIC_KINDS, "MaximumPresentStaticDraught")).alias("draught_m"),
        number(*under(POSITION_KINDS, "Latitude"), *meta("latitude", "Latitude")).alias("latitude"), number(*under(POSITION_KINDS, "Longitude"), *meta("longitude", "Longitude")).alias("longitude"),
        *[F.coalesce(number(*under(POSITION_KINDS, n)), F.lit(0.0)).alias(a) for n, a in (("Sog", "speed_knots"), ("Cog", "course"), ("TrueHeading", "heading"))],
        F.coalesce(F.try_to_timestamp(_first(v, *meta("time_utc"))), collected_at).alias("observed_at"))
    return rows.filter((F.col("mmsi") != "") & ((F.col("kind") == "static") | (F.col("latitude").isNotNull() & F.col("longitude").isNotNull())))


def merge_frames(rows: DataFrame) -> DataFrame:
    """Position rows with the static fields their vessel last sent before them; the newest position of a vessel also takes a later static frame."""
    names = ["ship_name", "vessel_type", "imo", "call_sign", "destination", "eta"]
    full = lambda n: F.nullif(F.col(n), F.lit("")) if n in names else F.col(n)
    fields = F.when(F.col("kind") == "static", F.struct(*[full(n).alias(n) for n in [*names, "draught_m"]]))
    upto = W.partitionBy("mmsi").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("mmsi").orderBy("sequence").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.max(F.when(F.col("kind") == "position", F.col("sequence"))).over(whole)
    df = rows.withColumn("__static", F.last(fields, ignorenulls=True).over(upto)).withColumn("__final", F.last(fields, ignorenulls=True).over(whole)).withColumn("__newest", F.col("sequence") == last)
    df = df.filter("kind = 'position'")
    # A later static frame is laid over what the position already took.
    taken = lambda n: F.coalesce(F.when(F.col("__newest"), F.col(f"__final.{n}")), F.col(f"__static.{n}"), F.col(n))
    own = F.coalesce(F.nullif(F.col("ship_name"), F.lit("")), F.concat(F.lit("MMSI "), "mmsi"))
    df = df.withColumn("ship_name", own)
    return df.withColumns({n: taken(n) for n in [*names, "draught_m"]}).drop("__static", "__final", "__newest", "kind")


KEPT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # outer blanks belong to a text


def benchmark_rows(spark: SparkSession, path: str, schema="country string, text string, label string") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', emptyValue="", **KEPT)


def write_results(rows: DataFrame, path: str, kind="csv") -> None:
    """Evaluation results as CSV or JSON files."""
    writer = rows.write.mode("overwrite")
    writer.options(header=True, escape='"', emptyValue='""', **KEPT).csv(path) if kind == "csv" else writer.json(path)
