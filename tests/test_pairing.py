"""Pairs that are tested on arrays follow the rule for single pairs; cells of any size give the same merged sources."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.operators import cluster, match, pairing
from tests.test_cluster import event_match_by_words


@pytest.mark.parametrize("words", [40, 900])
def test_pairs_on_arrays_follow_the_rule_for_single_pairs(words):
    """With fewer words than bits, and with more, where bits are shared; one text is longer than the bounds look at."""
    rnd = random.Random(3)
    listed = V.EVENT_ACTORS + V.EVENT_ACTIONS + V.EVENT_TARGETS + V.EVENT_ROUTES + V.THREAT_TERMS + ["strike", "attack", "12", "123456"]
    names = [f"{rnd.choice('abc')}word{i}" for i in range(words)]
    rows = [sorted({*rnd.sample(names, rnd.randrange(0, 6)), *rnd.sample(listed, rnd.randrange(0, 4))}) for _ in range(250)]
    rows += [sorted({*r[1:], *rnd.sample(names, 1)}) for r in rows if len(r) > 2] + [[], sorted(names[:40])]
    facts = [{"tokens": r, "key": " ".join(r), "armed": rnd.random() < 0.5} for r in rows]
    events = pairing.Events(pa.array(rows, pa.list_(pa.string())), pa.array([f["armed"] for f in facts]))
    assert events.exact == (words == 40)
    x, y = (np.array(side) for side in zip(*[(i, j) for i in range(len(rows)) for j in rng_of(rnd, len(rows))]))
    near, alike = events.near(events.number[x], events.number[y]), events.ratio(events.number[x], events.number[y])
    assert near.tolist() == [event_match_by_words(facts[i], facts[j]) for i, j in zip(x, y)] and 50 < near.sum() < len(x) / 2
    assert alike.tolist() == [match.sequence_ratio_at_least(facts[i]["key"], facts[j]["key"]) for i, j in zip(x, y)] and alike.sum() > 50


def rng_of(rnd, n):
    return [rnd.randrange(n) for _ in range(40)] + [n - 1]


def test_merged_sources_do_not_depend_on_the_size_of_cells(spark, monkeypatch):
    """Shares of stories and parts of additions, with and without times, a family that is not known and stories that know all."""
    rnd = random.Random(8)
    start = datetime(2024, 1, 10)
    head = lambda: " ".join(rnd.sample(["drone", "strike", "port", "odesa", "flood", "closes", "rail", "busan"], 4))
    when = lambda: None if rnd.random() < 0.1 else start + timedelta(minutes=rnd.randrange(-20000, 20000))
    stories = [(i, rnd.choice("AB"), head(), when(), [f"family{i % 3}"]) for i in range(60)]
    added = [(rnd.choice("AB"), head(), when(), f"u{i}", "p", "s", "t", None if i % 17 == 0 else f"family{i % 5}", "x") for i in range(150)]
    s = spark.createDataFrame(stories, "article_id long, country string, headline string, published_at timestamp, known array<string>")
    s = s.withColumn("sources", F.transform("known", lambda x: F.struct(x.alias("source_family"), F.lit("").alias("url")))).drop("known")
    a = spark.createDataFrame(added, "country string, headline string, published_at timestamp, url string, publisher string, coverage_scope string, source_type string, source_family string, indexed_by string")
    found = lambda: {(r.article_id, x.source_family): x.url for r in cluster.merge_sources(s, a).collect() for x in r.sources if x.url}
    whole = found()
    monkeypatch.setattr(cluster, "STORIES", 7)
    monkeypatch.setattr(cluster, "ADDITIONS", 9)
    assert found() == whole and len(whole) > 100 and all(f is not None for _, f in whole)


@pytest.mark.parametrize("days", [7, None])
def test_blocks_in_one_task_have_the_leaders_of_rounds(spark, monkeypatch, days):
    """Small batches, blocks of which some go through rounds, items without a time, and copies."""
    rnd = random.Random(5)
    start = datetime(2024, 1, 10)
    pool = ["drone", "strike", "port", "odesa", "flood", "closes", "rail", "busan", "12", "talks", "senate", "grain", "convoy", "cargo"]
    rows = [(i, "AAB"[i % 3], " ".join(rnd.sample(pool, rnd.randrange(0, 5))), f"u{i % 13}", None if i % 11 == 0 else start + timedelta(hours=rnd.randrange(900))) for i in range(140)]
    items = spark.createDataFrame(rows + [(1000 + r[0], *r[1:]) for r in rows[::7]], "item_id long, country string, headline string, url string, published_at timestamp")
    found = lambda: {r["item_id"]: r["seed"] for r in cluster.leader_clusters(items, ["country"], days=days).collect()}
    monkeypatch.setattr(pairing, "TOGETHER", 9)
    walked = found()
    monkeypatch.setattr(cluster, "ONE_TASK", 60)
    assert found() == walked and len(walked) == items.count() > 1.5 * len(set(walked.values()))


def test_wording_of_a_large_story_is_linear_in_its_words(spark):
    """20,000 words, each in one headline but for two: the first headline with most shared words, then the longest, leads."""
    heads = [f"Senate {' '.join(f'w{i}x{j}' for j in range(6))}" + (" talks" if i in (7, 2500) else "") for i in range(3000)]
    df = spark.createDataFrame([("Mexico", heads)], "country string, headlines array<string>")
    begun = time.time()
    assert cluster.synthesize(df).first()["event_headline"].lower() == heads[2500].lower()
    assert time.time() - begun < 30
