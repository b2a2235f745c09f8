"""A refresh shows all of its tables or none, can be repeated, and goes on from what is stored."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskfabric.operators import refresh, tracker

START = datetime(2026, 8, 1)
STORY = "country string, category string, collected_at timestamp, headline string, published_at timestamp, url string, sources array<struct<publisher:string,url:string>>"


def job(spark, hours, countries, broken=False):
    """One window of stories per country; ``broken`` fails while the last table is written."""
    moment = START + timedelta(hours=hours)
    rows = [(c, "war", moment, head, moment, f"{c}{hours}{i}", [(f"P{hours}", f"{c}{hours}{i}")]) for c in countries
            for i, head in enumerate(["Missile strike closes Odesa cargo port", "Flood halts Rhine barge freight", f"Rail union {hours} votes"][: 2 + hours % 2])]
    stories = spark.createDataFrame(rows, STORY)

    def run(known):
        windows = stories.groupBy("country", "category", "collected_at").agg(F.countDistinct("headline").alias("cluster_count"), F.count("*").alias("candidate_count"))
        log = stories.groupBy("country").agg(F.count("*").alias("article_count"))
        if broken:
            log = log.withColumn("article_count", F.raise_error(F.lit("lost")).cast("long"))
        return stories, tracker.track(stories, stored=known), windows, log
    return run, F.lit(moment)


def state(spark, folder):
    seen = refresh.patterns(spark, folder)
    found = sorted((r.country, r.pattern_id, r.active_windows, r.observation_count, r.baseline_windows, r.early_warning_score, len(r.sources)) for r in seen.collect())
    return found, sorted((r.country, r.url) for r in refresh.current(spark, folder, "articles").collect()), refresh.table(spark, folder, "windows").count(), refresh.table(spark, folder, "refreshes").count()


def collect(spark, folder, run, *args, **kw):
    return refresh.collect(spark, folder, run, *job(spark, *args, **kw))


def test_a_killed_refresh_shows_nothing_and_can_be_repeated(spark, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    assert refresh.patterns(spark, one) is None and refresh.current(spark, one, "articles") is None
    with pytest.raises(Exception, match="lost"):
        collect(spark, one, "1", 0, "XY", broken=True)
    assert refresh.committed(spark, one) is None
    for folder in (one, two):
        assert collect(spark, folder, "1", 0, "XY")
    before = state(spark, one)
    with pytest.raises(Exception, match="lost"):
        collect(spark, one, "2", 7, "X", broken=True)
    assert state(spark, one) == before
    for folder in (one, two):
        assert collect(spark, folder, "2", 7, "X")
    after = state(spark, one)
    assert after == state(spark, two) and not collect(spark, one, "2", 9, "Z") and state(spark, one) == after
    patterns, articles, windows, log = after
    # X: two patterns go on, one is new; Y: as the first run left it. Articles of X are those of the second run.
    assert [(c, active, seen, sources) for c, _, active, seen, _, _, sources in sorted(patterns, key=lambda p: (p[0], -p[2]))] == [("X", 2, 2, 2), ("X", 2, 2, 2), ("X", 1, 1, 1), ("Y", 1, 1, 1), ("Y", 1, 1, 1)]
    assert articles == [("X", "X70"), ("X", "X71"), ("X", "X72"), ("Y", "Y00"), ("Y", "Y01")] and windows == 3 and log == 3
    assert {p[4] for p in patterns if p[0] == "X"} == {1}


def test_a_series_of_refreshes_equals_the_tracker_over_all_windows(spark, tmp_path):
    folder, whole = f"file://{tmp_path}/s", None
    for hours in (0, 7, 14):
        collect(spark, folder, str(hours), hours, "X")
        rows = job(spark, hours, "X")[0](None)[0]
        whole = rows if whole is None else whole.unionByName(rows)
    key = lambda r: (r["pattern_id"], r["collected_at"], r["active_windows"], r["observation_count"], r["first_seen"])
    assert sorted(map(key, refresh.table(spark, folder, "patterns").collect())) == sorted(map(key, tracker.track(whole).collect()))
