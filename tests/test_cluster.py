"""Clustering equals the sequential rule; near-copy leaders equal brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.operators import cluster, match, tracker
from riskfabric.plans import bindings as B


def event_match(a, b):
    """Reference rule on feature rows, written out for single pairs."""
    return match.sequence_ratio_at_least(a["key"], b["key"]) or event_match_by_words(a, b)


def event_match_by_words(a, b):
    ta, tb = set(a["tokens"]), set(b["tokens"])
    shared, union = ta & tb, ta | tb
    if (len(shared) / len(union) if union else 0) >= 0.48:
        return True
    general = set(V.GENERIC_EVENT_WORDS + V.EVENT_ACTORS + V.EVENT_ACTIONS + V.EVENT_TARGETS)
    specific = {w for w in shared - general if len(w) >= 5 and not w.isdigit()}
    blows = {"strike", "attack"}
    if specific and (shared & set(V.THREAT_TERMS) or (a["armed"] and b["armed"] and blows & ta and blows & tb)):
        return True
    roles = [shared & set(x) for x in (V.EVENT_ACTIONS, V.EVENT_TARGETS, V.EVENT_ACTORS, V.EVENT_ROUTES)]
    return bool(roles[0] and roles[1] and (roles[2] or roles[3]) and len(shared) >= 3)


def sequential(rows, days):
    order = sorted(rows, key=lambda r: (r["published_at"], r["url"], r["item_id"]), reverse=True)
    seeds, out = [], {}
    for row in order:
        for seed in seeds:
            near = days is None or abs(row["published_at"] - seed["published_at"]) <= timedelta(days=days)
            if near and event_match(row["f"], seed["f"]):
                out[row["item_id"]] = seed["item_id"]
                break
        else:
            seeds.append(row)
            out[row["item_id"]] = row["item_id"]
    return out


def headlines(spark, n=170):
    rows = []
    for k in range(n):
        text = " ".join([B.SUBJECTS[k % 8], B.VERBS[(k // 8) % 6], B.OBJECTS[(k // 5) % 8], "in", B.PLACES[(k // 3) % 10],
                         ["", "as talks go on", "after long night of 12 reports", "minister says"][k % 4]]).strip()
        rows.append((k, "X" if k % 3 else "Y", text, f"u{k * 7 % 31}", datetime(2024, 1, 1) + timedelta(hours=k * 53 % 700)))
    return spark.createDataFrame(rows, "item_id long, country string, headline string, url string, published_at timestamp")


def test_leader_clusters_equal_the_sequential_rule(spark):
    items = headlines(spark)
    rows = match.with_event_features(items).collect()
    for days in (7, None):
        got = {r["item_id"]: r["seed"] for r in cluster.leader_clusters(items, ["country"], days=days, first_batch=8).collect()}
        want = {}
        for block in ("X", "Y"):
            want.update(sequential([r for r in rows if r["country"] == block], days))
        assert got == want
        assert len(set(want.values())) > 4


def reworded(spark, n=120):
    rnd = random.Random(8)
    words = ["missile", "attack", "closes", "odesa", "cargo", "port", "ports", "strike", "drone", "refinery", "delays", "hormuz", "suez", "canal", "navy", "army", "tanker", "talks"]
    rows = [(k, rnd.choice("XY"), " ".join(rnd.sample(words, rnd.randrange(1, 7))) if k % 11 else None, None if k % 13 == 5 else datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(600))) for k in range(n)]
    return spark.createDataFrame(rows, "id long, country string, headline string, published_at timestamp")


@pytest.mark.parametrize("span", [None, 7 * 86_400_000_000])
@pytest.mark.parametrize("ratio", [True, False])
def test_indexed_matches_equal_all_pairs(spark, span, ratio):
    rows = match.with_event_features(reworded(spark)).withColumn("t", F.unix_micros("published_at"))
    items = rows.select("country", F.col("id").alias("a_id"), F.col("f").alias("a"), F.col("t").alias("t_a"))
    seeds = rows.select("country", F.col("id").alias("b_id"), F.col("f").alias("b"), F.col("t").alias("t_b"))
    got = {(r.a_id, r.b_id) for r in match.matches(items, seeds, ["country"], span, ratio, where=F.col("a_id") < F.col("b_id")).collect()}
    want, all_rows = set(), rows.collect()
    for x in all_rows:
        for y in all_rows:
            near = span is None or x["t"] is None or y["t"] is None or abs(x["t"] - y["t"]) <= span
            if x["id"] < y["id"] and x["country"] == y["country"] and near and (event_match(x["f"], y["f"]) if ratio else event_match_by_words(x["f"], y["f"])):
                want.add((x["id"], y["id"]))
    assert got == want and len(want) > 100


def test_story_keys_that_match_equal_all_pairs(spark):
    rows = reworded(spark).select("id", "country", match.key_features(F.coalesce("headline", F.lit(""))).alias("f"))
    items = rows.select("country", F.col("id").alias("a_id"), F.col("f").alias("a"), F.lit(None).cast("long").alias("t_a"))
    seeds = rows.select("country", F.col("id").alias("b_id"), F.col("f").alias("b"), F.lit(None).cast("long").alias("t_b"))
    got = {(r.a_id, r.b_id) for r in match.matches(items, seeds, ["country"], native=match.near_tokens).collect()}
    want = {(x["id"], y["id"]) for x in rows.collect() for y in rows.collect() if x["country"] == y["country"] and tracker.key_matches(x["f"]["key"], y["f"]["key"])}
    assert got == want and len(want) > 150


def test_ratios_of_many_pairs_equal_single_ones():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdef é中\u0180") for _ in range(rnd.randrange(0, 90))) for _ in range(150)] + ["port strike odesa", "odesa port strikes", "Ā" * 20]
    pairs = [(rnd.choice(texts), rnd.choice(texts)) for _ in range(9000)] + [(t, t[3:]) for t in texts]
    assert match.ratios_at_least(pairs) == [match.sequence_ratio_at_least(a, b) for a, b in pairs]


def brute_leaders(rows):
    want, leaders = {}, []
    for doc, tokens in rows:
        tokens = set(tokens)
        for leader, other in leaders:
            if tokens == other or (tokens | other and len(tokens & other) / len(tokens | other) >= 0.48):
                want[doc] = leader
                break
        else:
            leaders.append((doc, tokens))
            want[doc] = doc
    return want


def test_near_copies_equal_brute_force(spark):
    base = ["alpha beta gamma delta epsilon", "one two three four five six", "red green blue white"]
    rows = [(i, (base[i % 3] + f" extra{i % 7} tail{i % 11}").split()) for i in range(120)] + [(500, []), (501, [])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    assert {r["doc_id"]: r["leader"] for r in match.near_duplicate_leaders(docs).collect()} == brute_leaders(rows)


@pytest.mark.parametrize("seed,shrink", [(1, 0), (2, 1), (3, 2), (4, 4)])
def test_near_copies_of_random_sets_equal_brute_force(spark, seed, shrink):
    rnd = random.Random(seed)
    rows = [(i, rnd.sample([f"w{j}" for j in range(14)], rnd.randrange(2, 8))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    assert {r["doc_id"]: r["leader"] for r in match.near_duplicate_leaders(docs, shrink=shrink).collect()} == brute_leaders(rows)


def test_letter_bound_never_rules_out_a_match(spark):
    rnd = random.Random(5)
    words = ["port", "strike", "cargo", "closure", "odesa", "freight", "é5"]
    pairs = [(" ".join(rnd.sample(words, 4)), " ".join(rnd.sample(words, 4))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").select(*[F.struct(F.col(c).alias("key"), match.letter_counts(F.col(c)).alias("letters")).alias(c) for c in "ab"])
    for r in df.select("a.key", F.col("b.key").alias("other"), match.letters_allow(F.col("a"), F.col("b")).alias("possible")).collect():
        assert r["possible"] or not match.sequence_ratio_at_least(r["key"], r["other"])


def test_reworded_reports_form_one_story(spark):
    rows = [(1, "Ukraine", "Infrastructure and supply chains", "Missile attack closes Odesa cargo port", "Outlet One", "https://one.test/a", "one.test"),
            (2, "Ukraine", "Infrastructure and supply chains", "Odesa port shut after missile strike disrupts freight", "Outlet Two", "https://two.test/b", "two.test")]
    items = (spark.createDataFrame(rows, "item_id long, country string, category string, headline string, publisher string, url string, source_family string")
             .withColumn("published_at", F.expr("timestamp'2026-08-20 10:00:00' + make_interval(0,0,0,0,cast(item_id as int))"))
             .withColumn("coverage_scope", F.lit("International")).withColumn("source_type", F.lit("News reporting"))
             .withColumn("source_home", F.col("url")).withColumn("description", F.lit("")))
    stories = cluster.roll_up(items, cluster.leader_clusters(items, ["country", "category"])).collect()
    assert len(stories) == 1 and len(stories[0]["sources"]) == 2
    assert stories[0]["summary"].endswith("matched across 2 reporting sources.")


def test_event_headline_synthesis(spark):
    df = spark.createDataFrame([
        ("Mexico", ["Attack on cargo convoy kills: 4 dead, delays", "Cargo convoy attack leaves 5 dead and delays freight"]),
        ("Mexico", ["Senate debates reform - The Daily"]), ("Mexico", [])], "country string, headlines array<string>")
    out = [r["event_headline"] for r in cluster.synthesize(df).collect()]
    assert out == ["Attack targets road-freight operations affecting Mexico, with fatalities reported and cargo delays",
                   "Senate debates reform", "Supply-chain development affecting Mexico"]


def test_old_recurring_incident_is_not_merged(spark):
    src = "array<struct<publisher:string,url:string,coverage_scope:string,source_type:string,source_family:string,indexed_by:string,headline:string>>"
    story = spark.sql(f"""SELECT 1L AS article_id, 'Ukraine' AS country, 'Missile attack closes Odesa cargo port' AS headline, timestamp'2026-08-20 10:00:00' AS published_at, cast(array() AS {src}) AS sources""")
    add = spark.sql("""SELECT * FROM VALUES ('Ukraine', 'Missile attack closes Odesa cargo port 3', 'https://old.test/a', 'Old', 'old.test', timestamp'2026-07-01 10:00:00'),
        ('Ukraine', 'Missile attack closes Odesa cargo port', 'https://new.test/a', 'New', 'new.test', timestamp'2026-08-21 10:00:00') AS t(country, headline, url, publisher, source_family, published_at)""")
    add = add.withColumn("coverage_scope", F.lit("International")).withColumn("source_type", F.lit("News reporting")).withColumn("indexed_by", F.lit(None).cast("string"))
    merged = cluster.merge_sources(story, add).first()
    assert [s["source_family"] for s in merged["sources"]] == ["new.test"]


@pytest.mark.parametrize("dense,ratio", [(True, False), (False, False), (True, True)])
def test_merged_sources_are_the_newest_of_each_family_in_the_whole_window(spark, monkeypatch, dense, ratio):
    slices, plain = [], cluster._slice
    monkeypatch.setattr(cluster, "_slice", lambda *a: slices.append(a) or plain(*a))
    rnd = random.Random(7)
    words = ["drone", "strike", "port", "odesa", "flood", "closes", "rail", "busan"] if dense else [f"word{i}" for i in range(400)]
    head = lambda: " ".join(rnd.sample(words, 4))
    start, week = datetime(2024, 1, 10), timedelta(days=7)
    when = lambda: rnd.choice([None, start, start + week, start - week, start + week + timedelta(microseconds=1)]) if rnd.random() < 0.3 else start + timedelta(minutes=rnd.randrange(-20000, 20000))
    stories = [(i, "A", head(), start if i % 3 else when(), [("family1",)]) for i in range(30)]
    added = [("A", head() if dense or i % 4 else stories[i % 30][2], when(), f"u{i}", "p", "s", "t", f"family{i % 6}", "x") for i in range(120)]
    s = spark.createDataFrame(stories, "article_id long, country string, headline string, published_at timestamp, sources array<struct<source_family:string>>")
    s = s.withColumn("sources", F.transform("sources", lambda x: F.struct(x["source_family"].alias("source_family"), F.lit("").alias("url"))))
    a = spark.createDataFrame(added, "country string, headline string, published_at timestamp, url string, publisher string, coverage_scope string, source_type string, source_family string, indexed_by string")
    got = {(r.article_id, x.source_family): x.url for r in cluster.merge_sources(s, a, ratio=ratio).collect() for x in r.sources if x.url}
    f = lambda df, into: match.with_event_features(df, into=into)
    pairs = f(s.select("article_id", "headline", F.col("published_at").alias("ta")), "a").drop("headline").crossJoin(f(a, "b"))
    near = pairs.filter("source_family <> 'family1' AND (ta IS NULL OR published_at IS NULL OR abs(unix_micros(ta) - unix_micros(published_at)) <= 604800000000)")
    tested = match.ratio_matches(F.col("a.key"), F.col("b.key")) if ratio else F.lit(False)
    best = near.filter(match.near_event(F.col("a"), F.col("b")) | tested).groupBy("article_id", "source_family").agg(F.max_by("url", F.struct("published_at", "url")).alias("u"))
    want = {(r.article_id, r.source_family): r.u for r in best.collect()}
    assert got == want and len(want) > 10
    covered = sum(x[5] for x in slices)
    assert covered == 2 * 604800000000 + 1 if dense or ratio else covered < 604800000000  # all slices, or the index after the first ones


@pytest.mark.parametrize("span", [None, 7 * 86_400_000_000])
@pytest.mark.parametrize("ratio", [True, False])
def test_matches_of_copies_equal_matches(spark, span, ratio):
    """Copies of headlines, at other times and with none, are matched once and come back as rows, each pair once."""
    rows = reworded(spark, 40).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("id", F.col("id") * 6 + F.col("n"))
    rows = match.with_event_features(rows).withColumn("t", F.unix_micros("published_at") + F.col("n") * 40 * 3_600_000_000)
    items = rows.select("country", F.col("id").alias("a_id"), F.col("f").alias("a"), F.col("t").alias("t_a"))
    seeds = rows.select("country", F.col("id").alias("b_id"), F.col("f").alias("b"), F.col("t").alias("t_b"))
    where = F.col("a_id") < F.col("b_id")
    also = None if ratio else lambda a, b: {"jaccard": match.jaccard(a["tokens"], b["tokens"])}
    got = match.matches_of_copies(items, seeds, ["country"], span, ratio, where=where, also=also).collect()
    want = {(r.a_id, r.b_id) for r in match.matches(items, seeds, ["country"], span, ratio, where=where).collect()}
    assert {(r.a_id, r.b_id) for r in got} == want and len(got) == len(want) > 500
    if also:
        tokens = {r["id"]: set(r["f"]["tokens"]) for r in rows.collect()}
        assert all(abs(r.jaccard - len(tokens[r.a_id] & tokens[r.b_id]) / max(1, len(tokens[r.a_id] | tokens[r.b_id]))) < 1e-12 for r in got)


@pytest.mark.parametrize("block_bytes", [1 << 26, 2000])
def test_possible_pairs_hold_every_similar_pair(spark, monkeypatch, block_bytes):
    """Sets of 1 to 300 tokens with near copies of other sizes: no similar pair is missed, each comes once, and few others come."""
    monkeypatch.setattr(match, "BLOCK_BYTES", block_bytes)
    rnd = random.Random(6)
    sets = [set(rnd.sample(range(3000), rnd.choice([1, 2, 3, 7, 8, 9, 30, 64, 65, 150, 300]))) for _ in range(120)]
    sets += [set(rnd.sample(sorted(s), max(1, round(len(s) * rnd.uniform(0.4, 1))))) | {rnd.randrange(3000)} for s in sets]
    df = spark.createDataFrame([(i, [f"w{t}" for t in sorted(s)]) for i, s in enumerate(sets)] + [(900, [])], "id long, __set array<string>")
    got = [(r["id"], r["leader"]) for r in match.similar_sets_possible(df).collect()]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.48}
    assert want <= set(got) and len(got) == len(set(got)) < 3 * len(want) and len(want) > 60
