"""Rules of the end-to-end jobs and the tracker's memory."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskfabric.functions import text
from riskfabric.operators import relational, tracker
from riskfabric.sources import landed


def test_a_link_listed_for_two_countries_stays_for_both(spark):
    rows = [("A", "war", "One", "u", 1), ("A", "war", "ONE", "u", 2), ("B", "war", "One", "u", 3), ("A", "trade", "One", "u", 4)]
    feed = spark.createDataFrame(rows, "country string, category string, publisher string, url string, published_at int")
    got = relational.union_distinct([feed], ["published_at"], within=["country", "category"]).collect()
    assert sorted((r["country"], r["category"], r["published_at"]) for r in got) == [("A", "trade", 4), ("A", "war", 2), ("B", "war", 3)]


def test_patterns_go_on_from_what_is_stored(spark):
    start = datetime(2026, 8, 1)
    rows = []
    for i in range(30):
        head = ["Missile strike closes Odesa cargo port", "Flood halts Rhine barge freight", "Rail union votes for strike"][i % 3] + (" again" if i % 4 == 0 else "")
        rows.append(("X", "war", start + timedelta(hours=6 * (i // 2)), head, f"u{i}", start + timedelta(hours=6 * (i // 2), minutes=i), [(f"P{i % 5}", f"u{i % 7}")]))
    rows.append(("Y", "war", start, "Port closure", "v", start, [("P", "v")]))
    stories = spark.createDataFrame(rows, "country string, category string, collected_at timestamp, headline string, url string, published_at timestamp, sources array<struct<publisher:string,url:string>>")
    whole = tracker.track(stories)
    half = start + timedelta(hours=40)
    first = tracker.track(stories.filter(F.col("collected_at") <= half))
    stored = tracker.latest_patterns(first).withColumn("last_seen", F.col("collected_at"))
    later = tracker.track(stories.filter(F.col("collected_at") > half), stored=stored)
    as_rows = lambda df: sorted((r["country"], r["collected_at"], r["place"], r["pattern_id"], r["active_windows"], r["observation_count"], tuple(map(tuple, r["sources"]))) for r in df.collect())
    assert as_rows(first) + as_rows(later) == sorted(as_rows(whole), key=lambda r: (r[1] > half, r))
    assert whole.filter("active_windows > 3").count() > 0


def test_sources_are_joined_once_by_publisher_and_url():
    assert tracker.joined_sources((("A", "1"),), (("a", "1"), ("B", "2"), ("b", "2"), ("C", None))) == (("A", "1"), ("B", "2"), ("C", None))


def test_feeds_are_read_whole(spark):
    feature = '{"id":"%d","properties":{"mag":5.0,"place":"x","time":0,"title":"t","url":"u"},"geometry":{"coordinates":[1,2]}}'
    poll = spark.createDataFrame([('{"features":[' + ",".join(feature % i for i in range(50)) + "]}",)], "payload string")
    now = F.lit("2026-08-21 00:00:00").cast("timestamp")
    assert landed.earthquakes(poll, now).count() == 50 and landed.earthquakes(poll, now, limit=20).count() == 20
    lines = []
    for export in ("e1", "e2"):
        for i in range(30):
            cells = [""] * 61
            cells[0], cells[28], cells[33], cells[52], cells[56], cells[57], cells[60] = f"{export}-{i}", "14", str(i), f"place {i}", "1", "2", "https://s.test/a"
            lines.append((export, "\t".join(cells)))
    exports = spark.createDataFrame(lines, "export string, value string")
    assert landed.conflict_events(exports, now).count() == 60 and landed.conflict_events(exports, now, limit=20).count() == 40


def test_character_references_are_decoded_once(spark):
    cases = {"a &#8217; b": "a ’ b", "&eacute;&ndash;&#x1F600;": "é–😀", "&amp;lt;": "&lt;", "&unknown; & &": "&unknown; & &", "plain": "plain", "&#39;&apos;": "''", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.unescape_markup(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == cases
