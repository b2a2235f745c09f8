"""Joins and selections specific to event data: band joins, place joins, stratified selection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskfabric.functions.feeds import hazard_kinds
from riskfabric.functions.places import country_mentioned
from riskfabric.functions.text import blank, phrase, word_set
from riskfabric.functions.tone import tone
from riskfabric.operators.store import latest_per_key, top_per_key
from riskfabric.session import cut

WEEK_US = 7 * 86_400_000_000


def union_distinct(feeds, order, keys=("publisher", "url"), within=()) -> DataFrame:
    """Union of feeds, one row per (lower-cased publisher, url), inside the groups of the ``within`` columns.

    The winner is the row with the greatest ``order``, which makes "first wins" independent of
    arrival order; the aggregate combines map-side, so copies collapse before the shuffle.
    """
    merged = feeds[0]
    for feed in feeds[1:]:
        merged = merged.unionByName(feed, allowMissingColumns=True)
    publisher, url = keys
    keyed = merged.withColumn("__publisher", F.lower(blank(F.col(publisher)))).withColumn("__url", blank(F.col(url)))
    return latest_per_key(keyed, [*within, "__publisher", "__url"], order).drop("__publisher", "__url")


def within_band(left: DataFrame, right: DataFrame, keys, days=7, time="published_at", into="has_match") -> DataFrame:
    """Flag rows of ``left`` that have a row of ``right`` with equal keys within ``days``.

    ``right`` is reduced to first and last time per (key, bucket of ``days``) before the join: inside the
    own bucket everything is near enough, in the two neighbouring buckets the nearer end decides.
    A missing time on either side counts as a match. No pair of rows is ever produced.
    """
    span = days * 86_400_000_000
    keys = list(keys)
    moment = F.unix_micros(F.col(time).cast("timestamp"))
    summary = (right.select(*keys, moment.alias("__t")).withColumn("__bucket", F.floor(F.col("__t") / span))
               .groupBy(*keys, "__bucket").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last")))
    per_key = summary.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("__bucket").isNotNull(), F.struct("__bucket", F.struct("__first", "__last"))))).alias("__buckets"),
        F.max(F.col("__bucket").isNull()).alias("__untimed"))
    joined = left.withColumn("__t", moment).join(per_key, keys, "left")
    bucket = F.floor(F.col("__t") / span)
    own = F.col("__buckets")[bucket].isNotNull()
    before = F.coalesce(F.col("__buckets")[bucket - 1]["__last"] >= F.col("__t") - span, F.lit(False))
    after = F.coalesce(F.col("__buckets")[bucket + 1]["__first"] <= F.col("__t") + span, F.lit(False))
    known = F.col("__untimed").isNotNull()
    near = F.when(~known, False).when(F.col("__t").isNull() | F.col("__untimed"), True).otherwise(own | before | after)
    return joined.withColumn(into, near).drop("__t", "__buckets", "__untimed")


def mentioned_countries(text: Column, countries) -> Column:
    """All countries of a bounded list that a text names (one literal pattern each, no join)."""
    return F.array_compact(F.array(*[F.when(country_mentioned(text, c), F.lit(c)) for c in countries]))


def most_specific(names: Column) -> Column:
    """Longest name; equal lengths resolve to the alphabetically first."""
    ranked = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return F.get(ranked, F.lit(0))["n"]


def locate_signals(signals: DataFrame, countries, into="matched_country") -> DataFrame:
    place = phrase(F.col("country"), F.col("location"))
    return signals.withColumn(into, most_specific(mentioned_countries(place, countries)))


def hazard_detections(signals: DataFrame, countries) -> DataFrame:
    """Newest signal per (country named in the place, hazard kind, provider): bounded by the vocabularies."""
    place = F.lower(phrase(F.col("country"), F.col("location"), F.col("title")))
    named = F.array_compact(F.array(*[F.when(place.contains(c.lower()), F.lit(c)) for c in countries]))
    kinds = hazard_kinds(phrase(F.col("event_type"), F.col("title"), F.col("summary")))
    rows = (signals.withColumn("__country", F.explode(named)).withColumn("__kind", F.explode(kinds))
            .select(F.col("__country").alias("country"), F.col("__kind").alias("kind"), F.col("source").alias("provider"), "id", "title",
                    "source_url", "observed_at"))
    return latest_per_key(rows, ["country", "kind", "provider"], ["observed_at", "id"])


def attach_hazard_signals(articles: DataFrame, signals: DataFrame, countries, where: Column = None) -> DataFrame:
    """Add official detections of the same country and hazard kind to the sources of hazard news (of the rows ``where`` holds).

    Detections become one map of kinds per country, bounded by the vocabularies; every article looks its kinds up in the map of its country.
    """
    detections = hazard_detections(signals, countries)
    found = F.collect_list(F.struct("provider", "observed_at", "id", "title", "source_url"))
    per_kind = detections.groupBy("country", "kind").agg(found.alias("__found"))
    per_country = per_kind.groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct("kind", "__found"))).alias("__by_kind"))
    kinds = hazard_kinds(phrase(F.col("headline"), F.col("summary")))
    if where is not None:
        kinds = F.when(where, kinds)
    none = F.array().cast(per_kind.schema["__found"].dataType)
    looked_up = F.flatten(F.transform("__kinds", lambda kind: F.coalesce(F.col("__by_kind")[kind], none)))
    joined = (articles.withColumn("__kinds", kinds).join(per_country, "country", "left")
              .withColumn("__found", F.when(F.size("__kinds") > 0, looked_up)).drop("__kinds", "__by_kind"))
    seen = F.transform("sources", lambda s: s["source_family"])

    def newest(found):
        providers = F.array_distinct(F.transform(found, lambda f: f["provider"]))
        return F.transform(F.array_sort(providers), lambda p: F.array_max(F.filter(
            F.transform(found, lambda f: F.struct(f["observed_at"], f["id"], f["provider"], f["title"], f["source_url"])), lambda f: f["provider"] == p)))

    fresh = F.filter(newest(F.col("__found")), lambda f: ~F.array_contains(seen, f["provider"]))
    joined = joined.withColumn("__fresh", F.coalesce(fresh, F.array().cast("array<struct<observed_at:timestamp,id:string,provider:string,title:string,source_url:string>>")))
    status = (F.when(F.col("__found").isNull(), F.lit(None))
               .when(F.size("__fresh") > 0, "Officially detected and news corroborated")
               .otherwise("News reported; no matching official detection stored"))
    source_type = articles.schema["sources"].dataType.elementType

    def as_source(f):
        given = {
            "publisher": f["provider"], "url": blank(f["source_url"]), "origin_country": F.lit("International / official"),
            "coverage_scope": F.lit("Hazard signal"), "source_family": f["provider"],
            "source_type": F.when(f["provider"].isin("USGS", "GDACS"), "Official hazard detection").otherwise("Open-source event signal"),
            "headline": F.coalesce(f["title"], F.lit("Hazard signal")), "tone": tone(blank(f["title"])),
        }
        return F.struct(*[given.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in source_type.fields])

    return (joined.withColumn("sources", F.concat("sources", F.transform("__fresh", as_source)))
                  .withColumn("hazard_status", status)
                  .withColumn("hazard_providers", F.transform("__fresh", lambda f: f["provider"])).drop("__found", "__fresh"))


def richest(df: DataFrame, key: str, fields, order) -> DataFrame:
    """One row per key: most populated descriptive fields, then ``order``."""
    filled = sum((F.when(blank(F.col(f).cast("string")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return latest_per_key(df.withColumn("__richness", filled), [key], ["__richness"] + list(order)).drop("__richness")


def stratified_selection(df: DataFrame, keys=("country", "category"), scope="coverage_scope", time="published_at", tie="url",
                         quotas=(("Primary operational", 2), ("Local / regional", 1), ("International", 2)), total=5) -> DataFrame:
    """Fill scope quotas by recency, then the rest by recency up to ``total`` rows per key.

    Both cuts are row_number filters with small bounds, so Spark limits each group before shuffling.
    """
    keys = list(keys)
    urls = latest_per_key(df, keys + [tie], [time])
    newest = [F.desc(time), F.desc(tie)]
    largest = max(n for _, n in quotas)
    quota = F.lit(0)
    for label, n in quotas:
        quota = F.when(F.col(scope) == label, n).otherwise(quota)
    by_scope = F.row_number().over(W.partitionBy(*keys, scope).orderBy(*newest))
    # rows beyond the total within their own scope can never be chosen
    pool = urls.withColumn("__n", by_scope).filter(F.col("__n") <= max(total, largest))
    pool = pool.withColumn("__fill", (F.col("__n") > quota).cast("int"))
    chosen = top_per_key(pool, keys, [F.col("__fill"), *newest], total)
    return chosen.drop("__n", "__fill")


def diverse_sample(df: DataFrame, per_group: int, total: int, group="country", key="article_key", time="published_at") -> DataFrame:
    """Newest rows with at most ``per_group`` of each group and distinct keys."""
    one = latest_per_key(df, [key], [time])
    return top_per_key(one, [group], [F.desc(time), F.desc(key)], per_group).orderBy(F.desc(time), F.desc(key)).limit(total)


def refresh_targets(signals: DataFrame, articles: DataFrame, exposures: DataFrame, countries, as_of: Column, selected=None,
                    window_days=7) -> DataFrame:
    """Countries with evidence that can change the map, strongest reason first."""
    located = locate_signals(signals, countries).filter(F.col("matched_country").isNotNull())
    severity = (F.when(F.col("severity") == "Critical", 750).when(F.col("severity") == "High", 650)
                 .when(F.col("severity") == "Watch", 550).otherwise(500))
    parts = [located.select(F.col("matched_country").alias("country"), severity.cast("bigint").alias("priority")),
             exposures.select("country", F.lit(800).cast("bigint").alias("priority")),
             articles.filter(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(window_days)))
                     .select("country", (400 + F.least(F.lit(100), F.col("score"))).cast("bigint").alias("priority"))]
    if selected:
        parts.append(signals.sparkSession.createDataFrame([(selected, 1000)], "country string, priority bigint"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    known = merged.filter(F.col("country").isin(list(countries)))
    return known.groupBy("country").agg(F.max("priority").alias("priority"))


def risk_list(risks: DataFrame, level: str) -> DataFrame:
    return risks.filter(F.col("level") == level).orderBy(F.desc("score"), F.desc("confidence"), "country")


def level_counts(risks: DataFrame) -> DataFrame:
    return risks.groupBy("level").agg(F.count("*").alias("countries"))


def hazard_counts(hazards: DataFrame, types, grades=("red", "orange", "green")) -> DataFrame:
    """Counts per hazard type and alert grade."""
    kept = hazards.filter(F.col("event_type").isin(list(types)) & F.col("alert").isin(list(grades)))
    return kept.groupBy("event_type").agg(F.count("*").alias("active"), *[
        F.count_if(F.col("alert") == g).alias(g) for g in grades])


def historical_matches(current: DataFrame, history: DataFrame, limit: int, minimum=3, into="historical_matches") -> DataFrame:
    """How many of the newest ``limit`` stored headlines of the country share at least three words.

    History is cut to ``limit`` rows per country first, so one small array per country is joined.
    """
    kept = top_per_key(history, ["country"], [F.desc("published_at"), F.desc("url")], limit)
    per_country = kept.groupBy("country").agg(F.collect_list(word_set(F.col("headline"))).alias("__past"))
    joined = current.withColumn("__words", word_set(F.col("headline"))).join(per_country, "country", "left")
    count = F.size(F.filter("__past", lambda p: F.size(F.array_intersect(p, F.col("__words"))) >= minimum))
    return joined.withColumn(into, F.coalesce(F.when(F.col("__past").isNotNull(), count), F.lit(0)).cast("bigint")).drop("__words", "__past")


def history_overlaps(current: DataFrame, history: DataFrame, minimum=3, into="historical_matches") -> DataFrame:
    """How many stored headlines of the country, of all times, share at least ``minimum`` words with each current one.

    Equal word sets are counted before anything is joined. Two sets that share ``minimum`` words have one among the rarest size - minimum + 1 words of each, so only these are
    join keys; a pair is checked at its first common key, once. A headline that is missing or shorter than ``minimum`` words matches nothing.
    """
    words = F.array_sort(F.coalesce(word_set(F.col("headline")), F.array().cast("array<string>")))
    now = current.withColumn("__words", words)
    sets = lambda df, side: df.filter(F.size("__words") >= minimum).groupBy("country", "__words").agg(F.count("*").alias("__n")).withColumn("__side", F.lit(side))
    both = sets(now, "now").unionByName(sets(history.withColumn("__words", words), "past"))
    spread = both.withColumn("__word", F.explode("__words"))
    often = spread.groupBy("country", "__word").agg(F.count("*").alias("__often"))
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("__often", "__word"))), lambda w: w["__word"])
    keyed = spread.join(often, ["country", "__word"]).groupBy("__side", "country", "__words").agg(F.max("__n").alias("__n"), rarest.alias("__keys"))
    keyed = cut(keyed.withColumn("__keys", F.slice("__keys", 1, F.size("__keys") - (minimum - 1))))
    side = lambda name, tag: keyed.filter(F.col("__side") == name).select("country", F.explode("__keys").alias("__word"), F.col("__words").alias(f"__{tag}"), F.col("__keys").alias(f"__{tag}k"),
                                                                         F.col("__n").alias(f"__{tag}n"))
    met = side("now", "a").join(side("past", "b"), ["country", "__word"])
    once = F.get(F.array_intersect("__ak", "__bk"), F.lit(0)) == F.col("__word")
    found = met.filter(once & (F.size(F.array_intersect("__a", "__b")) >= minimum)).groupBy("country", F.col("__a").alias("__words")).agg(F.sum("__bn").alias(into))
    return now.drop(into).join(found, ["country", "__words"], "left").withColumn(into, F.coalesce(into, F.lit(0)).cast("bigint")).drop("__words")


def not_current(history: DataFrame, current: DataFrame) -> DataFrame:
    """Stored stories whose key and headline are both absent from the current set of the country."""
    keys = current.select("country", "story_key").distinct()
    headlines = current.select("country", "headline").distinct()
    return history.join(keys, ["country", "story_key"], "left_anti").join(headlines, ["country", "headline"], "left_anti")
