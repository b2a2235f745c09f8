"""The overlap join over all history equals counting every pair."""

import random

import pytest

from riskfabric.operators import relational


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_equal_every_pair(spark, seed):
    rnd = random.Random(seed)
    pool = ["port"] * 30 + [f"word{chr(97 + i)}" for i in range(24)]  # one word is in most headlines
    head = lambda: rnd.choice([None, "", "port strike"]) if rnd.random() < 0.1 else " ".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))
    rows = lambda n: [(i, "X" if rnd.random() < 0.7 else rnd.choice(["Y", "Z"]), head(), i) for i in range(n)]
    now, past = rows(80), [r for r in rows(300) if r[1] != "Z"]
    past += past[:40]  # the same headlines again
    schema = "id long, country string, headline string, historical_matches int"
    got = {r.id: r.historical_matches for r in relational.history_overlaps(spark.createDataFrame(now, schema), spark.createDataFrame(past, schema)).collect()}
    words = lambda text: set((text or "").split())
    want = {i: sum(c == country and len(words(text) & words(other)) >= 3 for _, c, other, _ in past) for i, country, text, _ in now}
    assert got == want and max(want.values()) > 5 and len(got) == len(now)


def test_no_history(spark):
    schema = "id long, country string, headline string"
    rows = relational.history_overlaps(spark.createDataFrame([(1, "X", "one two three four")], schema), spark.createDataFrame([], schema)).collect()
    assert [(r.id, r.historical_matches) for r in rows] == [(1, 0)]
