"""Table maintenance and retrieval: upserts, snapshots, retention, latest rows.

Spark's built-in Parquet tables have no MERGE, so every write is expressed as the new table contents.
Latest-per-key is an aggregation (``max_by`` over a struct), not a window: it combines map-side, so
a key that holds a large share of all rows is reduced before the shuffle. Top-n per key relies on
the partial WindowGroupLimit, which also cuts every key to n rows before the shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _columns(names):
    return [F.col(n) if isinstance(n, str) else n for n in names]


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The row with the greatest ``order`` value(s) of each key.

    Columns are packed so that one aggregation returns the whole row.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*_columns(order)))
    return df.groupBy(*keys).agg(packed.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys, order, n: int = None, rank_column: str = None) -> DataFrame:
    """First ``n`` rows of each key by ``order`` (sort expressions); all rows, ranked, without ``n``."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    ranked = ranked if n is None else ranked.filter(F.col("__rank") <= n)
    return ranked.withColumnRenamed("__rank", rank_column) if rank_column else ranked.drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys, keep_old=(), order=None) -> DataFrame:
    """Contents after writing ``new`` over ``old``; ``keep_old`` columns survive a conflict.

    Repeated keys inside ``new`` are reduced first (greatest ``order`` wins) so the join stays one to one.
    """
    if order is not None:
        new = latest_per_key(new, list(keys), order)
    rest = [c for c in old.columns if c not in keys]
    left = old.select(*keys, F.struct(*rest).alias("__old"))
    right = new.select(*keys, F.struct(*[F.col(c) for c in rest]).alias("__new"))
    merged = left.join(right, list(keys), "full_outer")

    def value(c):
        if c in keep_old:
            return F.when(F.col("__old").isNotNull(), F.col("__old")[c]).otherwise(F.col("__new")[c])
        return F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col("__old")[c])

    return merged.select(*keys, *[value(c).alias(c) for c in rest]).select(*old.columns)


def replace_groups(old: DataFrame, new: DataFrame, groups) -> DataFrame:
    """Snapshot semantics: groups present in ``new`` are replaced as a whole, others stay."""
    touched = new.select(*groups).distinct()
    return old.join(touched, list(groups), "left_anti").unionByName(new.select(*old.columns))


def write_groups(new: DataFrame, path: str, groups) -> None:
    """The same as a dynamic partition overwrite of a table partitioned by ``groups``."""
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*groups).parquet(path))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys, order=None) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet are appended."""
    fresh = latest_per_key(new, list(keys), order) if order is not None else new.dropDuplicates(list(keys))
    return old.unionByName(fresh.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def retain_newest(df: DataFrame, order, n: int = None, since: Column = None, time="observed_at") -> DataFrame:
    """Bounded retention: by age for large tables, or the newest ``n`` rows."""
    kept = df.filter(F.col(time) >= since) if since is not None else df
    return kept.orderBy(*order).limit(n) if n else kept


def latest_entities(df: DataFrame, key: str, limit: int = None, area: str = None, area_column="monitor_country",
                    time="observed_at", tie=None) -> DataFrame:
    """Newest row of each entity, optionally of one area, newest entities first."""
    rows = df.filter(F.col(area_column) == area) if area else df
    newest = latest_per_key(rows, [key], [time] + ([tie] if tie else []))
    return newest.orderBy(F.desc(time), F.desc(key)).limit(limit) if limit else newest


def entity_history(df: DataFrame, key: str, value=None, limit: int = None, time="observed_at", tie=None) -> DataFrame:
    """Newest observations of one entity, or of every entity when ``value`` is None."""
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    if value is not None:
        rows = df.filter(F.col(key) == value).orderBy(*order)
        return rows if limit is None else rows.limit(limit)
    return top_per_key(df, [key], order, limit)


def recent_per_source(df: DataFrame, as_of: Column, per_source: int = None, max_age_days=7, tie="id") -> DataFrame:
    recent = df.filter(F.col("observed_at") >= as_of - F.make_dt_interval(F.lit(max_age_days)))
    return top_per_key(recent, ["source"], [F.desc("observed_at"), F.desc(tie)], per_source)


def present_hazards(signals: DataFrame, runs: DataFrame, provider="GDACS", grace_hours=3, limit: int = None) -> DataFrame:
    """Signals still present in the feed: collected within the grace period of the newest live run."""
    newest = runs.filter((F.col("provider") == provider) & (F.col("status") == "live")).agg(F.max("collected_at").alias("__newest"))
    rank = F.when(F.col("severity") == "Critical", 3).when(F.col("severity") == "High", 2).otherwise(1)
    cutoff = F.col("__newest") - F.make_dt_interval(hours=F.lit(grace_hours))
    live = (signals.filter(F.col("source") == provider).crossJoin(F.broadcast(newest))  # one-row aggregate
            .filter(F.col("collected_at") >= cutoff).drop("__newest"))
    ordered = live.orderBy(rank.desc(), F.desc("collected_at"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def newest_articles(df: DataFrame, per_group: int = None, groups=("country", "category"), tie="url") -> DataFrame:
    return top_per_key(df, list(groups), [F.desc("published_at"), F.desc(tie)], per_group)


def latest_stories(history: DataFrame, limit: int = None, tie="url") -> DataFrame:
    """Latest observation of each distinct story, newest ``limit`` stories per country."""
    one = latest_per_key(history, ["country", "story_key"], ["observed_at", tie])
    when = F.coalesce(F.col("published_at"), F.col("observed_at"))
    return top_per_key(one, ["country"], [when.desc(), F.desc("observed_at"), F.desc(tie)], limit)


def pattern_candidates(patterns: DataFrame, as_of: Column, days=30) -> DataFrame:
    return patterns.filter(F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(days)))


def ranked_patterns(patterns: DataFrame, as_of: Column, limit: int = None, max_age_days=30, tie="pattern_id") -> DataFrame:
    recent = pattern_candidates(patterns, as_of, max_age_days)
    return top_per_key(recent, ["country"], [F.desc("early_warning_score"), F.desc("anomaly_score"), F.desc("persistence_score"),
                                             F.desc("last_seen"), F.desc(tie)], limit, "rank")


def alerts(patterns: DataFrame, as_of: Column, limit: int = None, max_age_days=30, minimum=25, tie="pattern_id") -> DataFrame:
    recent = pattern_candidates(patterns, as_of, max_age_days).filter(F.col("early_warning_score") >= minimum)
    return top_per_key(recent, ["country"], [F.desc("early_warning_score"), F.desc("alert_confidence"), F.desc("last_seen"),
                                             F.desc(tie)], limit, "rank")


def active_counts(patterns: DataFrame, as_of: Column, max_age_days=30) -> DataFrame:
    recent = pattern_candidates(patterns, as_of, max_age_days)
    return recent.agg(F.count("*").alias("active_patterns"), F.count_if(F.col("early_warning_score") >= 25).alias("developing"),
                      F.count_if(F.col("early_warning_score") >= 45).alias("priority"))


def provider_status(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs, ["provider"], ["collected_at", "run_id"])


def store_statistics(signals: DataFrame, articles: DataFrame, patterns: DataFrame, runs: DataFrame) -> DataFrame:
    return (signals.agg(F.count("*").alias("signals")).crossJoin(articles.agg(F.count("*").alias("articles")))
            .crossJoin(patterns.agg(F.count("*").alias("patterns"))).crossJoin(runs.agg(F.max("collected_at").alias("last_collection"))))


def cache_fresh(refreshes: DataFrame, as_of: Column, max_age_minutes=10, version=5) -> DataFrame:
    fresh = ((F.coalesce("format_version", F.lit(0)) >= version) & (F.coalesce("article_count", F.lit(0)) > 0)
             & (F.col("collected_at") >= as_of - F.make_dt_interval(mins=F.lit(max_age_minutes))))
    return refreshes.withColumn("fresh", F.coalesce(fresh, F.lit(False)))


def save_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    sign = F.when(F.col("feedback") > 0, 1).otherwise(-1).cast("bigint")
    return upsert(old, new.withColumn("feedback", sign), ["profile", "article_key"], order=["updated_at"])


def save_routes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Route store: the newest check of a callsign replaces what is stored, but for the destination's IATA code."""
    return upsert(old, new, ["callsign"], keep_old=["destination_iata"], order=["checked_at"])


def clear_profile(feedback: DataFrame, profile: str) -> DataFrame:
    return feedback.filter(~F.col("profile").eqNullSafe(profile))


def save_exposure(old: DataFrame, new: DataFrame, fields, order=("updated_at",)) -> DataFrame:
    clamped = new
    for field in fields:
        clamped = clamped.withColumn(field, F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.col(field).cast("bigint"), F.lit(0)))))
    return upsert(old, clamped, ["profile", "country"], order=list(order))


def conform(df: DataFrame, defaults: dict) -> DataFrame:
    """Additive schema evolution: missing columns appear with their default, NULLs are filled."""
    for name, (kind, default) in defaults.items():
        fallback = F.lit(default).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name).cast(kind), fallback) if name in df.columns else fallback)
    return df


def run_log(counts: DataFrame, collected_at: Column) -> DataFrame:
    """Provider outcome rows (live / no data / unavailable / setup required) from per-provider counts."""
    status = (F.when(~F.col("configured"), "setup required").when(F.col("failed"), "unavailable")
               .when(F.col("record_count") > 0, "live").otherwise("no data"))
    return counts.select("provider", status.alias("status"), "record_count", "message", collected_at.alias("collected_at"))
