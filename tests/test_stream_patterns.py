"""The streamed tracker equals the batch tracker, with windows that arrive in parts and out of order."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from riskfabric.operators import tracker, volume
from riskfabric.streaming import patterns, sinks
from tests.test_tracker import START, STORY, held, stories


def landed(spark, folder, parts):
    """One file per part, read one by one in this order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, STORY).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(spark.createDataFrame([], STORY).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def end(rows):
    return [(None, None, max(r[2] for r in rows) + timedelta(days=2), None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 4])
def test_stream_equals_batch(spark, tmp_path, seed):
    rows = stories(seed)
    rnd = random.Random(seed)
    # Each part holds a stretch of time; within two days stories come in any order and batch.
    late = sorted(rows, key=lambda r: r[2] + timedelta(hours=rnd.randrange(48)))
    parts = [late[i : i + 60] for i in range(0, len(late), 60)]
    written = sinks.drain_stateful(patterns.track_stream(landed(spark, tmp_path, [*parts, end(rows)]), "3 days"), "t").drop("batch")
    # The watermark (three days behind the end row) closes all windows up to here.
    table = spark.createDataFrame(rows, STORY)
    last = max(r[2] for r in rows) + timedelta(days=2) - timedelta(days=3)
    closed = table.where(F.col("collected_at") <= F.lit(last))
    want = tracker.track(closed)
    got = written.toPandas()
    assert held(got) == held(want.toPandas()) and len(got) > 200
    windows = volume.record_windows(table, candidate="url", story="headline")
    columns = ["pattern_id", "collected_at", "place", "anomaly_score", "change_score", "change_status", "baseline_windows", "persistence_score", "status", "early_warning_score", "alert_level",
               "alert_confidence"]
    scores = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert scores(patterns.warnings(written)) == scores(tracker.score_patterns(want, windows))


def test_stories_after_their_window_are_too_late_and_old_patterns_are_forgotten(spark, tmp_path):
    story = lambda day, headline: ("Iran", "Risk", START + timedelta(days=day), headline, START + timedelta(days=day), f"u{day}", [("One", f"u{day}")])
    parts = [[story(0, "drone strike on odesa port")], [story(10, "drone strike on odesa port")], [story(50, "drone strike on odesa port")], [story(1, "drone strike on odesa port")],
             [(None, None, START + timedelta(days=60), None, None, None, None)], [(None, None, START + timedelta(days=90), None, None, None, None)]]
    written = sinks.drain_stateful(patterns.track_stream(landed(spark, tmp_path, parts)), "t")
    assert [(r.collected_at, r.active_windows, r.observation_count, r.cluster_count, r.baseline) for r in written.orderBy("collected_at").collect()] == [
        (START, 1, 1, 1, []), (START + timedelta(days=10), 2, 2, 1, [1]), (START + timedelta(days=50), 1, 1, 1, [1, 1])]


def test_stream_without_lists_has_the_same_touches_and_numbers_of_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(patterns, "TOGETHER", 3)
    rows = stories(2)
    late = sorted(rows, key=lambda r: r[2] + timedelta(hours=random.Random(str(r)).randrange(48)))
    written = sinks.drain_stateful(patterns.track_stream(landed(spark, tmp_path, [*[late[i : i + 60] for i in range(0, len(late), 60)], end(rows)]), "3 days", lists=False), "t").drop("batch")
    last = max(r[2] for r in rows) + timedelta(days=2) - timedelta(days=3)
    want = tracker.track(spark.createDataFrame(rows, STORY).where(F.col("collected_at") <= F.lit(last)))
    columns = ["country", "category", "collected_at", "place", "pattern_id", "canonical_key", "first_seen", "active_windows", "observation_count", "source_count"]
    touches = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert "sources" not in written.columns and touches(written) == touches(want) and written.count() > 200
    ends = lambda df, c: sorted((r["pattern_id"], str(r["collected_at"]), r["place"], str([tuple(s) for s in r[c][-r["n"]:]] if r["n"] else [])) for r in df.collect())
    added = written.withColumn("n", F.size("added"))
    assert ends(added, "added") == ends(want.join(added.select("pattern_id", "collected_at", "place", "n"), ["pattern_id", "collected_at", "place"]), "sources")
