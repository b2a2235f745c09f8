"""The tracker over verified key matches equals the plain loop over each series."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from riskfabric.operators import tracker
from riskfabric.plans import bindings as B

STORY = "country string, category string, collected_at timestamp, headline string, published_at timestamp, url string, sources array<struct<publisher:string,url:string>>"
OLD = ("country string, category string, pattern_id string, canonical_key string, first_seen timestamp, last_seen timestamp, active_windows long, observation_count long, "
       "sources array<struct<publisher:string,url:string>>")
START = datetime(2024, 1, 1)


def stories(seed, n=260, hot=0.6):
    """Stories of windows with gaps of more than 30 days; a share of them in one series."""
    rnd, rows = random.Random(seed), []
    for k in range(n):
        series = ("Iran", "Risk") if rnd.random() < hot else (rnd.choice(["Iran", "Egypt"]), rnd.choice(["Risk", "Trade"]))
        moment = START + timedelta(days=rnd.choice([0, 1, 2, 3, 20, 29, 31, 70, 71, 99, 101, 140]), hours=6 * rnd.randrange(3))
        words = [rnd.choice(x) for x in (B.SUBJECTS, B.VERBS, B.OBJECTS, B.PLACES)]
        rows.append((*series, moment, " ".join(words[: rnd.randrange(2, 5)]), moment - timedelta(hours=rnd.randrange(5)), f"u{k}", [(rnd.choice(["One", "one", "Two", None]), f"u{k % 9}")]))
    return rows


def plain(spark, rows, known=()):
    """The plain loop, series by series."""
    placed, out = tracker.window_stories(spark.createDataFrame(rows, STORY)).toPandas(), []
    for name, pdf in placed.groupby(["country", "category"]):
        old = [tracker.Pattern(k[2], k[3], pd.Timestamp(k[4]), pd.Timestamp(k[5]), k[6], k[7], tuple(k[8])) for k in sorted(known, key=lambda k: k[5], reverse=True) if k[:2] == name]
        out.append(tracker.series_rows(pdf, old)[0])
    return pd.concat(out)


def held(frame):
    return sorted((r["country"], r["category"], str(r["collected_at"]), r["place"], r["pattern_id"], r["canonical_key"], r["story_key"], str(r["first_seen"]), r["active_windows"],
                   r["observation_count"], str([(s["publisher"], s["url"]) for s in r["sources"]])) for r in frame.to_dict("records"))


@pytest.mark.parametrize("seed,together", [(1, 2_000), (2, 3), (3, 1)])
def test_tracker_equals_the_plain_loop(spark, monkeypatch, seed, together):
    monkeypatch.setattr(tracker, "KEYS_TOGETHER", together)
    rows = stories(seed)
    got, want = held(tracker.track(spark.createDataFrame(rows, STORY)).toPandas()), held(plain(spark, rows))
    assert got == want and max(r[8] for r in want) > 2


def test_tracker_goes_on_from_stored_patterns(spark):
    rows = stories(5)
    first = [r for r in rows if r[2] < START + timedelta(days=25)]
    rest = [r for r in rows if r[2] >= START + timedelta(days=25)]
    last = {}
    for r in tracker.track(spark.createDataFrame(first, STORY)).collect():
        if r["pattern_id"] not in last or (r["collected_at"], r["place"]) > (last[r["pattern_id"]]["collected_at"], last[r["pattern_id"]]["place"]):
            last[r["pattern_id"]] = r
    known = [(r["country"], r["category"], r["pattern_id"], r["canonical_key"], r["first_seen"], r["collected_at"], r["active_windows"], r["observation_count"],
              [(s["publisher"], s["url"]) for s in r["sources"]]) for r in last.values()]
    known += [("Iran", "Risk", "ancient", "port strike odesa", START - timedelta(days=200), START - timedelta(days=100), 4, 9, [("Old", "u")])]
    # Stored patterns of one moment have no order among each other; times apart make it plain.
    known = [(*k[:5], k[5] - timedelta(seconds=i), *k[6:]) for i, k in enumerate(known)]
    got = held(tracker.track(spark.createDataFrame(rest, STORY), stored=spark.createDataFrame(known, OLD)).toPandas())
    assert got == held(plain(spark, rest, known))


def test_a_life_ends_after_thirty_days(spark):
    days = [0, 30, 60, 91, 92]
    rows = spark.createDataFrame([("X", "Y", START + timedelta(days=d)) for d in days], "country string, category string, collected_at timestamp")
    assert [r.life for r in tracker.lives(rows).orderBy("collected_at").collect()] == [0, 0, 0, 1, 1]


def test_no_stories_no_touches(spark):
    assert tracker.track(spark.createDataFrame([], STORY)).count() == 0


def test_the_ordered_step_gives_added_sources_only(spark):
    rows = [("Iran", "Risk", START + timedelta(hours=6 * k), "Missile attack closes cargo port in Odesa", START, f"u{k}", [("One", f"u{k}")]) for k in range(60)]
    touches = tracker.track(spark.createDataFrame(rows, STORY))
    assert max(touches.toPandas()["source_count"]) == 60
    counts = touches.select("pattern_id", "source_count")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan.replace("collect_list(near", "")  # whole lists were built per touch
    series = tracker.Series(("Iran", "Risk"))
    assert max(len(series.touch(k * 10, "missile", [], [("One", f"u{k}")])[5]) for k in range(1, 61)) == 1
