"""End-to-end jobs over all countries at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.functions.text import phrase
from riskfabric.operators import names as gazetteer
from riskfabric.operators import cluster, country, relational, scoring, semantic, store, taxonomy, tracker, volume
from riskfabric.session import cut, kept

BLOCK = ["country", "category"]


HAZARD_CATEGORY = "Environment and hazards"


def stories_of(feeds, item="item_id") -> DataFrame:
    """Distinct feed items of every country and category, clustered into stories."""
    items = cut(relational.union_distinct(feeds, ["published_at", "url"], within=BLOCK))
    clusters = cluster.leader_clusters(items, BLOCK, item)
    return items, cluster.roll_up(items, clusters, item=item)


def relevant_stories(stories: DataFrame) -> DataFrame:
    scored = scoring.with_relevance(scoring.with_tokens(stories)).drop(*scoring.TOKEN_COLUMNS)
    return (scored.withColumn("relevance_score", F.col("relevance.score")).withColumn("relevance_reason", F.col("relevance.reason"))
                  .filter("relevance.relevant").drop("relevance"))


def recent(signals: DataFrame, as_of: Column, days=7) -> DataFrame:
    return signals.filter(F.col("observed_at") >= as_of - F.make_dt_interval(F.lit(days)))


def volume_windows(items: DataFrame, stories: DataFrame, collected_at: Column) -> DataFrame:
    candidates = items.groupBy(*BLOCK).agg(F.count("*").alias("candidate_count"))
    counts = stories.groupBy(*BLOCK).agg(F.count("*").alias("cluster_count"))
    return candidates.join(counts, BLOCK, "left").select(*BLOCK, collected_at.alias("collected_at"), F.coalesce("cluster_count", F.lit(0)).alias("cluster_count"), "candidate_count")


def refreshes(articles: DataFrame, collected_at: Column) -> DataFrame:
    """Refresh log rows: articles per country."""
    return articles.groupBy("country").agg(F.count("*").alias("article_count")).withColumn("collected_at", collected_at)


def country_news(feeds, additions: DataFrame, signals: DataFrame, countries, collected_at: Column, item="item_id", stored_patterns: DataFrame = None):
    """Collection of all categories: (articles, story touches, volume windows, refreshes).

    Patterns go on from ``stored_patterns`` (see ``tracker.track``). Official detections of the last week are attached to hazard news only.
    """
    items, stories = stories_of(feeds, item)
    stories = cut(relevant_stories(stories).withColumn("collected_at", collected_at))
    touches = tracker.track(stories, stored=stored_patterns)
    chosen = relational.stratified_selection(stories)
    merged = cluster.merge_sources(chosen, additions, key=item)
    attached = relational.attach_hazard_signals(merged, recent(signals, collected_at), countries, where=F.col("category") == HAZARD_CATEGORY)
    return attached, touches, volume_windows(items, stories, collected_at), refreshes(attached, collected_at)


def country_snapshot(feeds, signals: DataFrame, countries, collected_at: Column, item="item_id", limit: int = None, stored_patterns: DataFrame = None):
    """Light refresh of one category: (newest relevant stories with hazard evidence, touches, volume windows, refreshes)."""
    items, stories = stories_of(feeds, item)
    newest = cut(store.top_per_key(relevant_stories(stories), ["country"], [F.desc("published_at"), F.desc("url")], limit).withColumn("collected_at", collected_at))
    attached = relational.attach_hazard_signals(newest, recent(signals, collected_at), countries)
    return attached, tracker.track(newest, stored=stored_patterns), volume_windows(items, newest, collected_at), refreshes(newest, collected_at)


def general_news(feeds, item="item_id", limit: int = None) -> DataFrame:
    """Newest stories per country with taxonomy labels; independent of risk."""
    _, stories = stories_of(feeds, item)
    labelled = stories.withColumn("labels", taxonomy.classify(F.col("headline"), F.col("summary")))
    named = labelled.withColumn("category", F.array_join(F.transform("labels", lambda x: x["label"]), " | ")).withColumn("transport_mode", F.lit("General news"))
    return store.top_per_key(named, ["country"], [F.desc("published_at"), F.desc("url")], limit)


def with_semantic_bonus(rows: DataFrame, stored: DataFrame, item="item_id") -> DataFrame:
    """Add the bonus of a semantic model of the ``stored`` articles (doc_id, text); none while it lacks documents or prototypes."""
    vectors = kept(semantic.train(stored), "model")
    protos = cut(semantic.prototypes(vectors))
    scores = semantic.document_scores(rows.select(item, phrase(F.col("headline"), F.col("summary"), F.col("category")).alias("text")), vectors, protos, doc=item)
    trained = semantic.trained(stored, protos).select("trained")
    bonus = F.when(F.col("trained"), scoring.semantic_bonus(F.col("coverage"), F.col("disruption"), F.col("transport"), F.col("severity"))).otherwise(0)
    valued = scores.crossJoin(F.broadcast(trained)).select(item, bonus.cast("bigint").alias("semantic_bonus"))  # one row
    return rows.drop("semantic_bonus").join(valued, item, "left").withColumn("semantic_bonus", F.coalesce("semantic_bonus", F.lit(0).cast("bigint")))


def decision_candidates(rows: DataFrame, as_of: Column, limit: int = None, max_age_days=7, fill_with_context=False, item="item_id", stored: DataFrame = None) -> DataFrame:
    """Recent, relevant, consolidated and decision-relevant stories per country, newest first.

    With ``fill_with_context`` the remaining places go to other consolidated stories; with ``stored`` articles scores carry their semantic bonus.
    """
    recent = rows.filter(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(max_age_days)))
    merged = cluster.consolidate(relevant_stories(recent), item)
    merged = merged if stored is None else with_semantic_bonus(cut(merged), stored, item)
    scored = cut(scoring.with_risk(scoring.with_tokens(merged), as_of).withColumn("decision", scoring.decision_relevant()).drop(*scoring.TOKEN_COLUMNS))
    pool = scored if fill_with_context else scored.filter("decision")
    return store.top_per_key(pool, ["country"], [F.desc("decision"), F.desc("published_at"), F.desc("url")], limit)


def country_risk(rows: DataFrame, signals: DataFrame, exposures: DataFrame, anomalies: DataFrame, countries: DataFrame, names, as_of: Column, item="item_id", stored: DataFrame = None, size=10) -> DataFrame:
    """Map-wide refresh: the ``size`` newest decision events of the last seven days per country, scored again with its exposure, then the risk of every country."""
    events = decision_candidates(rows, as_of, limit=size, item=item, stored=stored).drop("risk", "connection", "evidence", "decision")
    exposed = scoring.with_tokens(events.join(exposures.select("country", "exposure_index"), "country", "left"))
    events = scoring.with_risk(exposed, as_of).drop("exposure_index")
    located = gazetteer.locate(signals, phrase(F.col("country"), F.col("location")), gazetteer.spellings(gazetteer.country_names(signals.sparkSession, names)), "matched_country").filter(F.col("matched_country").isNotNull())
    return country.assess(countries, country.scoring_window(events), located, exposures, anomalies)
