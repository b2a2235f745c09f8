"""Literal expectations of the scoring rules."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskfabric.functions import feeds, places, scoring as bands, text, times, tone
from riskfabric.operators import country, ranking, scoring, store, tracker, transport, volume



def as_of():
    return F.lit("2026-08-21 00:00:00").cast("timestamp")


SOURCE = "array<struct<publisher:string,url:string,coverage_scope:string,source_type:string,source_family:string,indexed_by:string,headline:string>>"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def sources(*families, kind="News reporting"):
    return [dict(publisher=f, url=f"https://{f}", coverage_scope="International", source_type=kind, source_family=f, indexed_by=None, headline="h") for f in families]


def articles(spark, rows):
    schema = (f"country string, headline string, summary string, category string, coverage_scope string, published_at timestamp, url string, sources {SOURCE}")
    full = [(r.get("country", "United Kingdom"), r["headline"], r.get("summary", ""), r.get("category", "Conflicts and war"), r.get("scope", "International"),
             r.get("at", datetime(2026, 8, 20)), r.get("url", f"https://a.test/{i}"), r.get("sources", [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_volume_statistics(spark):
    df = spark.createDataFrame([([2, 3, 3, 4, 4, 100], 10), ([2, 3, 4, 5], 10), ([2, 3, 2, 3, 2, 3], 10)], "baseline array<long>, v long")
    got = volume.with_robust_statistics(df).select(volume.robust_z(F.col("v")).alias("z"), volume.cusum(F.col("v")).alias("c")).collect()
    assert got[0]["z"] == 8.77 and got[1]["z"] == 0.0
    assert got[2]["c"]["score"] >= 40 and got[1]["c"]["status"] == "Baseline building"


def test_ais_and_geography(spark):
    row = one(spark, feeds.ais_class(F.lit("70")), feeds.ais_class(F.lit("82")), feeds.ais_class(F.lit(60).cast("string")),
              transport.great_circle_km(F.lit(51.47), F.lit(-0.45), F.lit(40.64), F.lit(-73.78)), times.duration_text(F.lit(445)),
              transport.cargo_assessment(F.lit("FDX12"), F.lit(None).cast("string"))["cargo"], transport.cargo_assessment(F.lit("BAW12"), F.lit(""))["cargo"])
    assert list(row[:3]) == ["Cargo", "Tanker", "Passenger"] and row[3] > 5000 and row[4] == "7h 25m" and row[5] and not row[6]


@pytest.mark.parametrize("sentence,name,expected", [
    ("U.K. ports reopened after disruption", "United Kingdom", True), ("The carrier told us its port remained closed.", "United States", False),
    ("US port operations remain suspended.", "United States", True), ("Holland rail strike disrupts freight", "Netherlands", True),
    ("The company said a turkey shipment was delayed", "Türkiye", False), ("The cargo vessel will congo through repairs", "Congo", False)])
def test_country_aliases(spark, sentence, name, expected):
    row = one(spark, places.country_mentioned(F.lit(sentence), name), places.country_mentioned(F.lit(sentence), F.lit(name)))
    assert list(row) == [expected, expected]


def test_sentiment_follows_target_and_negation(spark):
    s = tone.country_sentiment(F.lit("Freeland avoided port closure and restored cargo operations."), F.lit("Freeland"))
    t = tone.country_sentiment(F.lit("Otherland faces war. Freeland reports growth."), F.lit("Freeland"))
    row = one(spark, s["label"], t["label"], t["target_explicit"])
    assert list(row) == ["Positive", "Positive", True]


def test_source_identity(spark):
    row = one(spark, places.source_family(F.lit("Reuters report"), F.lit("https://msn.com/a")), places.source_family(F.lit("Daily"), F.lit("https://www.news.example.org/x")),
              places.source_family(F.lit("My Paper!"), F.lit("")))
    assert list(row) == ["reuters", "example.org", "my-paper"]
    origin = places.with_source_origin(spark.createDataFrame([("Some Network", "https://a.tv/x"), ("Some Network", "https://a.de/x")], "publisher string, source_home string"),
                                       places.country_dimension(spark)).collect()
    assert [r["origin_country"] for r in origin] == ["Origin unverified", "Germany"]


def test_relevance_gates(spark):
    rows = [dict(headline="UK port strike delays container freight"), dict(headline="Earthquake damages Indonesian port - Independent Newspaper Nigeria", country="Nigeria", summary="Freight was suspended."),
            dict(headline="Nigeria faces a flood of complaints over port closure", country="Nigeria"), dict(headline="Heathrow Airport closed after outage"),
            dict(headline="Russian strike closes Kyiv rail line", country="Russia")]
    got = [r["relevance"] for r in scoring.with_relevance(scoring.with_tokens(articles(spark, rows))).orderBy("url").collect()]
    assert [g["relevant"] for g in got] == [True, False, False, True, False]
    assert got[2]["metaphorical"] and got[3]["country_inferred"] and got[4]["actor_only"]


def test_exposure_index(spark):
    df = spark.createDataFrame([(100, 80, 60, 40, 20, 10)], "supplier_concentration int, goods_value int, route_dependency int, inventory_vulnerability int, customer_exposure int, substitution_difficulty int")
    assert df.select(scoring.exposure_index().alias("i")).first()["i"] == 62


def risks(spark, rows):
    return scoring.with_risk(scoring.with_tokens(articles(spark, rows)), as_of()).orderBy("url")


def test_article_risk_limits(spark):
    severe = dict(headline="Missile attack closes port and airport, cargo flight suspended in Britain", sources=sources("a.test", "b.test"))
    single = dict(severe, sources=sources("a.test"))
    words = dict(headline="Leaders discuss war and conflict", sources=sources("a.test"))
    solved = dict(headline="UK port reopens after closure cleared", sources=sources("a.test", "b.test"))
    got = [r for r in risks(spark, [severe, single, words, solved]).collect()]
    assert got[0]["risk"]["score"] >= 70 and got[0]["risk"]["level"] == "Critical" and got[0]["risk"]["mode"] == "Maritime and aviation"
    assert got[1]["risk"]["score"] <= 69
    assert got[2]["risk"]["provisional"] and got[2]["risk"]["score"] <= 37
    assert got[3]["connection"]["lifecycle"] == "Recovering / resolved"


def test_country_assessment(spark):
    severe = dict(headline="Missile attack closes port and airport, cargo flight suspended in Britain", sources=sources("a.test", "b.test"))
    df = risks(spark, [severe])
    signals = spark.sql("""SELECT 'x' AS id, 'USGS' AS source, 'Seismic' AS event_type, 'Quake' AS title, '' AS summary, 'Critical' AS severity, 98L AS confidence, timestamp'2026-08-20' AS observed_at, 'Japan' AS matched_country""")
    empty = spark.createDataFrame([], "country string, exposure_index long"), spark.createDataFrame([], "country string, anomaly_index long")
    dim = spark.createDataFrame([("United Kingdom",), ("Japan",), ("Norway",)], "country string")
    got = {r["country"]: r for r in country.assess(dim, country.scoring_window(df), signals, *empty).collect()}
    assert got["United Kingdom"]["score"] >= 75 and got["United Kingdom"]["level"] == "Critical"
    assert got["Japan"]["score"] == 30 and got["Japan"]["sensor_status"] == "Provisional" and got["Japan"]["confidence"] == 45
    assert (got["Norway"]["score"], got["Norway"]["confidence"]) == (0, 15)


def test_tracker_over_two_windows(spark):
    rows = [("Ukraine", "War", datetime(2026, 8, 20, 10), "Missile strike closes Odesa cargo port terminal", "u1", [("One", "a")]),
            ("Ukraine", "War", datetime(2026, 8, 20, 11), "Missile strike closes Odesa cargo port terminals", "u2", [("Two", "b")])]
    df = spark.createDataFrame(rows, "country string, category string, collected_at timestamp, headline string, url string, sources array<struct<publisher:string,url:string>>").withColumn("published_at", F.col("collected_at"))
    touches = tracker.track(df)
    last = touches.orderBy(F.desc("collected_at")).first()
    assert touches.select("pattern_id").distinct().count() == 1 and last["active_windows"] == 2 and len(last["sources"]) == 2
    windows = volume.record_windows(df, candidate="url", story="headline")
    assert tracker.latest_patterns(tracker.score_patterns(touches, windows)).first()["status"] == "Developing"


def preferences(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in ("a", "b"):
        for i in range(40):
            cells = sorted(rng.choice(ranking.DIMENSIONS, 6, replace=False))
            rows.append((p, i, datetime(2026, 1, 1 + i % 20, i % 24, i), [(int(c), float(rng.normal())) for c in cells], float(i % 2), 1.0))
    return spark.createDataFrame(rows, "profile string, doc_id long, updated_at timestamp, features array<struct<idx:bigint,value:double>>, target double, importance double")


def test_training_equals_a_plain_loop(spark):
    rows = preferences(spark)
    got = {r["profile"]: r for r in ranking.train_preferences(rows).collect()}
    assert set(got) == {"a", "b"}
    weights, bias = [0.0] * ranking.DIMENSIONS, 0.0
    examples = sorted(rows.filter("profile = 'a'").collect(), key=lambda r: (r["updated_at"], r["doc_id"]), reverse=True)
    for epoch in range(ranking.EPOCHS):
        rate = ranking.RATE / (1.0 + epoch * ranking.RATE_DECAY)
        for r in examples:
            margin = max(-30.0, min(30.0, bias + sum(weights[f["idx"]] * f["value"] for f in r["features"])))
            error = (r["target"] - 1 / (1 + np.exp(-margin))) * r["importance"]
            bias += rate * error
            for f in r["features"]:
                weights[f["idx"]] = weights[f["idx"]] * (1 - rate * ranking.WEIGHT_DECAY) + rate * error * f["value"]
    assert np.allclose(got["a"]["weights"], weights) and np.isclose(got["a"]["bias"], bias)


def test_diversity_pins_critical_and_keeps_every_story(spark):
    rows = [("p", 1, False, 90, datetime(2026, 1, 1), {"a": 1.0}), ("p", 2, False, 89, datetime(2026, 1, 1), {"a": 1.0}), ("p", 3, False, 70, datetime(2026, 1, 1), {"b": 1.0}), ("p", 4, True, 10, datetime(2026, 1, 1), {"c": 1.0})]
    df = spark.createDataFrame(rows, "profile string, doc_id long, mandatory boolean, recommendation_score long, published_at timestamp, vector map<string,double>")
    got = [r["doc_id"] for r in ranking.diversify(df, ["profile"]).orderBy("rank").collect()]
    assert got == [4, 1, 3, 2]


def test_diversity_equals_the_plain_greedy_rule(spark):
    rng = np.random.default_rng(5)
    rows = []
    for profile, size in (("a", 1), ("b", 120), ("c", 60)):
        for i in range(size):
            vector = None if i % 17 == 3 else {f"t{t}": float(rng.integers(1, 9)) for t in rng.choice(25, rng.integers(0, 6), replace=False)}
            rows.append((profile, i, bool(i % 23 == 5), int(rng.integers(0, 100)), datetime(2026, 1, 1 + int(rng.integers(0, 9))), vector))
        rows.append((profile, size, False, 50, datetime(2026, 1, 1), rows[-1][5]))  # a copy
    df = spark.createDataFrame(rows, "profile string, doc_id long, mandatory boolean, recommendation_score long, published_at timestamp, vector map<string,double>")

    def cosine(a, b):
        dot = sum(v * b.get(t, 0.0) for t, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0

    def plain(profile):
        left, chosen = [r for r in rows if r[0] == profile], []
        while left:
            value = lambda r: 0.78 * r[3] / 100 - 0.22 * max((cosine(r[5] or {}, c[5] or {}) for c in chosen), default=0.0)
            best = max(left, key=lambda r: (r[2], round(value(r), 12), r[4], r[1]))
            left.remove(best)
            chosen.append(best)
        return [r[1] for r in chosen]

    got = {p: [r["doc_id"] for r in ranking.diversify(df, ["profile"]).where(F.col("profile") == p).orderBy("rank").collect()] for p in "abc"}
    assert got == {p: plain(p) for p in "abc"}
    first = ranking.diversify(df, ["profile"], limit=7).where("profile = 'b'").orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in first] == list(zip(got["b"], range(1, 8)))


def test_presence_and_cache(spark):
    s = spark.sql("SELECT * FROM VALUES ('old', 'GDACS', 'High', timestamp'2026-01-01 00:00:00'), ('new', 'GDACS', 'Watch', timestamp'2026-01-01 05:00:00') AS t(id, source, severity, collected_at)")
    r = spark.sql("SELECT 'GDACS' AS provider, 'live' AS status, timestamp'2026-01-01 05:00:00' AS collected_at")
    assert [x["id"] for x in store.present_hazards(s, r).collect()] == ["new"]
    c = spark.sql("SELECT * FROM VALUES (5, 0L, timestamp'2026-08-20 23:58:00'), (5, 3L, timestamp'2026-08-20 23:58:00') AS t(format_version, article_count, collected_at)")
    assert [x["fresh"] for x in store.cache_fresh(c, as_of()).collect()] == [False, True]


def test_alert_wording(spark):
    why = bands.alert_explanation(F.lit("Elevated"), F.lit(2), F.lit(3), F.array(F.lit("Rail")))
    row = one(spark, why["why"], text.fact_variance(F.lit("5 dead"), F.lit("7 dead")))
    assert row[0] == ["Reported by 2 sources", "Remained active across 3 monitoring updates", "Potential exposure: Rail"]
    assert row[1] == "Numeric details differ (5 vs 7)"
