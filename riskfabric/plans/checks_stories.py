"""Queries on matching, clustering, tracking and ranking."""

import uuid

from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions import text
from riskfabric.operators import cluster, match, ranking, refresh, store, tracker
from riskfabric.plans import bindings as B, jobs
from riskfabric.plans.catalog import VIEWS, check, sql_case, sql_tokens, table, text_list
from riskfabric.plans.checks_scoring import anomalies, exposures, risky
from riskfabric.plans.checks_text import key_words_sql
from riskfabric.session import checkpoint_dir, cut

AS_OF = B.AS_OF_SQL
BLOCK, WEEK = ["country", "category"], 7 * 86_400_000_000


def items(spark, folder):
    """Articles in the shape of feed items."""
    a = B.articles(spark, folder)
    return a.select(F.col("article_id").alias("item_id"), "country", "category", "headline", "publisher", "url", F.col("url").alias("source_home"), "published_at",
                    "coverage_scope", F.when(F.col("article_id") % 6 == 0, "Port authority").otherwise("News reporting").alias("source_type"),
                    F.lit(None).cast("string").alias("source_family"), F.col("summary").alias("description"))


_NORM = f"list_sort(list_distinct(list_transform({key_words_sql('headline')}, lambda w: coalesce({sql_case('w', V.EVENT_EQUIVALENTS)}, w))))"
_GENERAL = V.GENERIC_EVENT_WORDS + V.EVENT_ACTORS + V.EVENT_ACTIONS + V.EVENT_TARGETS
VIEWS["m_features"] = f"SELECT article_id, country, category, published_at, url, {_NORM} AS t, contains(lower(headline), 'drone') OR contains(lower(headline), 'missile') AS armed FROM b_articles"
VIEWS["m_pairs"] = """
SELECT a.article_id, s.article_id AS seed_id, a.t AS a_t, s.t AS st, a.armed AND s.armed AS armed, list_intersect(a.t, s.t) AS sh FROM m_features a
JOIN m_features s ON s.country = a.country AND s.category = a.category AND abs(epoch_us(a.published_at) - epoch_us(s.published_at)) <= 604800000000
WHERE (a.published_at, a.url, a.article_id) < (s.published_at, s.url, s.article_id)"""


@check("match_event_pairs", f"""
SELECT * FROM (SELECT article_id, seed_id, round(len(sh) / CAST(len(a_t) + len(st) - len(sh) AS DOUBLE), 9) AS jaccard,
  (len(sp) > 0 AND (list_has_any(sh, {text_list(V.THREAT_TERMS)}) OR (armed AND list_has_any(a_t, ['strike', 'attack']) AND list_has_any(st, ['strike', 'attack']))))
  OR (list_has_any(sh, {text_list(V.EVENT_ACTIONS)}) AND list_has_any(sh, {text_list(V.EVENT_TARGETS)}) AND (list_has_any(sh, {text_list(V.EVENT_ACTORS)}) OR list_has_any(sh, {text_list(V.EVENT_ROUTES)})) AND len(sh) >= 3) AS anchors
FROM (SELECT *, list_filter(sh, lambda w: length(w) >= 5 AND NOT list_contains({text_list(_GENERAL)}, w) AND NOT regexp_full_match(w, '[0-9]+')) AS sp FROM m_pairs)) WHERE jaccard >= 0.48 OR anchors""")
def match_event_pairs(spark, folder):
    """Articles of a country and category with every newer one of the same event (by words or anchors) within a week."""
    rows = cut(match.with_event_features(B.articles(spark, folder).select("article_id", *BLOCK, "published_at", "url", "headline")))
    when, order = F.unix_micros("published_at"), F.struct("published_at", "url", "article_id")
    items = rows.select(*BLOCK, "article_id", F.col("f").alias("a"), when.alias("t_a"), order.alias("o_a"))
    seeds = rows.select(*BLOCK, F.col("article_id").alias("seed_id"), F.col("f").alias("b"), when.alias("t_b"), order.alias("o_b"))
    said = lambda a, b: {"jaccard": F.round(match.jaccard(a["tokens"], b["tokens"]), 9), "anchors": match.anchors_agree(a, b)}
    return match.matches_of_copies(items, seeds, BLOCK, WEEK, ratio=False, where=F.col("o_a") < F.col("o_b"), also=said).select("article_id", "seed_id", "jaccard", "anchors")


@check("match_same_story")
def match_same_story(spark, folder):
    """Articles of a country and category with every newer one of the same story (by its key) within a week."""
    rows = cut(B.articles(spark, folder).select("article_id", *BLOCK, "published_at", "url", match.key_features(text.story_key(F.col("headline"))).alias("f")))
    when, order = F.unix_micros("published_at"), F.struct("published_at", "url", "article_id")
    items = rows.select(*BLOCK, "article_id", F.col("f").alias("a"), when.alias("t_a"), order.alias("o_a"))
    seeds = rows.select(*BLOCK, F.col("article_id").alias("seed_id"), F.col("f").alias("b"), when.alias("t_b"), order.alias("o_b"))
    return match.matches_of_copies(items, seeds, BLOCK, WEEK, native=match.near_tokens, where=F.col("o_a") < F.col("o_b")).select("article_id", "seed_id")


@check("dup_document_leaders", f"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, list_distinct({sql_tokens('text')}) AS t FROM documents),
u AS (SELECT n, len(t) AS size, unnest(t) AS word FROM w),
c AS (SELECT a.n AS x, b.n AS y, count(*) AS shared, max(a.size) AS p, max(b.size) AS q FROM u a JOIN u b ON a.word = b.word AND b.n < a.n GROUP BY a.n, b.n),
e AS (SELECT x, list(y) AS hits FROM (SELECT x, y FROM c WHERE shared / (p + q - shared)::DOUBLE >= 0.48 UNION ALL SELECT a.n, b.n FROM w a JOIN w b ON len(a.t) = 0 AND len(b.t) = 0 AND b.n < a.n) GROUP BY x),
st AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS leaders
  UNION ALL SELECT w.n, CASE WHEN list_has_any(coalesce(e.hits, []), st.leaders) THEN st.leaders ELSE list_append(st.leaders, w.n) END FROM st JOIN w ON w.n = st.n + 1 LEFT JOIN e ON e.x = w.n),
f AS (SELECT max_by(leaders, n) AS leaders FROM st)
SELECT w.doc_id, l.doc_id AS leader FROM w CROSS JOIN f LEFT JOIN e ON e.x = w.n JOIN w l ON l.n = coalesce(list_min(list_intersect(e.hits, f.leaders)), w.n)""")
def dup_document_leaders(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", text.word_set(F.col("text")).alias("tokens"))
    return match.near_duplicate_leaders(docs)


@check("cluster_story_leaders")
def cluster_story_leaders(spark, folder):
    return cluster.leader_clusters(items(spark, folder), ["country", "category"])


def leaders_sql(block, near=""):
    """Greedy leaders without the sequence ratio: items newest first, each joins the first leader it matches."""
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in block.split(", "))
    return f"""
WITH RECURSIVE o AS (SELECT *, list_filter(t, lambda w: length(w) >= 5 AND NOT list_contains({text_list(_GENERAL)}, w) AND NOT regexp_full_match(w, '[0-9]+')) AS sp,
    row_number() OVER (PARTITION BY {block} ORDER BY published_at DESC, url DESC, article_id DESC) AS n FROM m_features),
x AS (SELECT b.article_id, a.n, list_intersect(a.t, b.t) AS sh, a.t AS ta, b.t AS tb, a.armed AND b.armed AS armed, len(list_intersect(a.sp, b.sp)) > 0 AS near
  FROM o b JOIN o a ON {same('a', 'b')} AND a.n < b.n{near}),
e AS (SELECT article_id, list(n ORDER BY n) AS hits FROM x WHERE len(sh) / greatest(1, len(ta) + len(tb) - len(sh))::DOUBLE >= 0.48
  OR (near AND (list_has_any(sh, {text_list(V.THREAT_TERMS)}) OR (armed AND list_has_any(ta, ['strike', 'attack']) AND list_has_any(tb, ['strike', 'attack']))))
  OR (list_has_any(sh, {text_list(V.EVENT_ACTIONS)}) AND list_has_any(sh, {text_list(V.EVENT_TARGETS)}) AND (list_has_any(sh, {text_list(V.EVENT_ACTORS)}) OR list_has_any(sh, {text_list(V.EVENT_ROUTES)})) AND len(sh) >= 3)
  GROUP BY article_id),
st AS (SELECT DISTINCT {block}, 0::BIGINT AS n, []::BIGINT[] AS leaders FROM o
  UNION ALL SELECT {', '.join('o.' + c for c in block.split(', '))}, o.n, CASE WHEN list_has_any(coalesce(e.hits, []), st.leaders) THEN st.leaders ELSE list_append(st.leaders, o.n) END
  FROM st JOIN o ON {same('o', 'st')} AND o.n = st.n + 1 LEFT JOIN e ON e.article_id = o.article_id),
f AS (SELECT {block}, max_by(leaders, n) AS leaders FROM st GROUP BY ALL)
SELECT o.article_id AS item_id, s.article_id AS seed FROM o JOIN f USING ({block}) LEFT JOIN e USING (article_id)
  JOIN o s ON {same('s', 'o')} AND s.n = coalesce(list_min(list_intersect(e.hits, f.leaders)), o.n)"""


VIEWS["c_seeds"] = leaders_sql("country, category", " AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 604800000000")
VIEWS["c_events"] = leaders_sql("country")


@check("cluster_story_leaders_words", "SELECT item_id, seed FROM c_seeds")
def cluster_story_leaders_words(spark, folder):
    """The clustering rule without its sequence ratio."""
    return cluster.leader_clusters(items(spark, folder), ["country", "category"], ratio=False)


@check("cluster_story_rollup_words", r"""
WITH j AS (SELECT s.seed, a.article_id, a.country, a.category, a.headline, a.url, a.published_at, a.coverage_scope, regexp_replace(lower(regexp_extract(a.url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS host,
    CASE WHEN regexp_matches(lower(a.publisher), '\breuters\b') THEN 'reuters' WHEN regexp_matches(lower(a.publisher), '\bagence france-presse\b|\bafp\b') THEN 'afp' END AS wire FROM c_seeds s JOIN b_articles a ON a.article_id = s.item_id),
k AS (SELECT *, coalesce(wire, CASE WHEN contains(host, '.') THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END) AS family FROM j),
l AS (SELECT seed, family, max_by(coverage_scope, (published_at, url)) AS scope FROM k GROUP BY ALL),
n AS (SELECT seed, count(*) AS sources, CASE WHEN count(DISTINCT scope) > 1 THEN 'Local + international' ELSE min(scope) END AS coverage_scope FROM l GROUP BY seed),
m AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY published_at DESC, url DESC) AS rn FROM k)
SELECT m.article_id AS item_id, m.country, m.category, m.headline, n.coverage_scope, CAST(n.sources AS INTEGER) AS sources FROM m JOIN n USING (seed) WHERE m.rn = 1""")
def cluster_story_rollup_words(spark, folder):
    """Stories of the clusters found without the sequence ratio."""
    i = items(spark, folder)
    out = cluster.roll_up(i, cluster.leader_clusters(i, ["country", "category"], ratio=False))
    return out.select("item_id", "country", "category", "headline", "coverage_scope", F.size("sources").alias("sources"))


@check("cluster_story_rollup")
def cluster_story_rollup(spark, folder):
    i = items(spark, folder)
    out = cluster.roll_up(i, cluster.leader_clusters(i, ["country", "category"]))
    return out.select("item_id", "country", "category", "headline", "coverage_scope", F.size("sources").alias("sources"))


@check("cluster_merge_sources_words", f"""
WITH o AS (SELECT *, list_filter(t, lambda w: length(w) >= 5 AND NOT list_contains({text_list(_GENERAL)}, w) AND NOT regexp_full_match(w, '[0-9]+')) AS sp FROM m_features),
c AS (SELECT o.*, b.sources FROM o JOIN b_articles b USING (article_id)),
x AS (SELECT c.article_id, p.publisher || '.test' AS family, list_intersect(c.t, a.t) AS sh, c.t AS ta, a.t AS tb, c.armed AND a.armed AS armed, len(list_intersect(c.sp, a.sp)) > 0 AS near
  FROM c JOIN o a ON a.country = c.country AND abs(epoch_us(a.published_at) - epoch_us(c.published_at)) <= 604800000000 JOIN b_articles p ON p.article_id = a.article_id
  WHERE NOT coalesce(list_contains(list_transform(c.sources, lambda s: s.source_family), p.publisher || '.test'), false)),
h AS (SELECT DISTINCT article_id, family FROM x WHERE len(sh) / greatest(1, len(ta) + len(tb) - len(sh))::DOUBLE >= 0.48
  OR (near AND (list_has_any(sh, {text_list(V.THREAT_TERMS)}) OR (armed AND list_has_any(ta, ['strike', 'attack']) AND list_has_any(tb, ['strike', 'attack']))))
  OR (list_has_any(sh, {text_list(V.EVENT_ACTIONS)}) AND list_has_any(sh, {text_list(V.EVENT_TARGETS)}) AND (list_has_any(sh, {text_list(V.EVENT_ACTORS)}) OR list_has_any(sh, {text_list(V.EVENT_ROUTES)})) AND len(sh) >= 3))
SELECT c.article_id, CAST(len(c.sources) + count(h.family) AS BIGINT) AS sources FROM c LEFT JOIN h USING (article_id) GROUP BY c.article_id, c.sources""")
def cluster_merge_sources_words(spark, folder):
    """Merged sources by the rule without its sequence ratio."""
    return merged_sources(spark, folder, ratio=False).select("article_id", F.size("sources").cast("bigint").alias("sources"))


@check("cluster_merge_sources")
def cluster_merge_sources(spark, folder):
    return merged_sources(spark, folder).select("article_id", F.size("sources").alias("sources"), F.size(F.col("fact_variances")).alias("variances"))


def merged_sources(spark, folder, ratio=True):
    a = B.articles(spark, folder)
    chosen = a.drop("summary")
    additions = a.select("country", "headline", "published_at", "url", "publisher", "coverage_scope", F.lit("GDELT-indexed news").alias("source_type"),
                         F.concat("publisher", F.lit(".test")).alias("source_family"), F.lit("GDELT").alias("indexed_by"))
    return cluster.merge_sources(chosen, additions, ratio=ratio)


@check("cluster_event_wording")
def cluster_event_wording(spark, folder):
    a = B.articles(spark, folder).select(F.col("article_id").alias("item_id"), "country", "category", "headline", "publisher", "url", "published_at", "coverage_scope", "sources", "summary")
    seeds = cluster.leader_clusters(a, BLOCK)
    heads = a.join(seeds, "item_id").groupBy("seed").agg(F.first("country").alias("country"), F.transform(F.sort_array(F.collect_list(F.struct("item_id", "headline"))), lambda h: h["headline"]).alias("headlines"))
    return cluster.synthesize(heads).select("seed", "country", "event_headline", "event_summary")


def stored(spark, folder):
    return B.articles(spark, folder).withColumnRenamed("article_id", "item_id").withColumn("relevance_score", F.lit(60).cast("bigint"))


@check("cluster_consolidated_members_words", """
WITH j AS (SELECT e.seed, a.* FROM c_events e JOIN b_articles a ON a.article_id = e.item_id),
f AS (SELECT seed, count(DISTINCT family) AS sources FROM (SELECT seed, unnest(list_transform(sources, lambda s: coalesce(nullif(s.source_family, ''), s.publisher))) AS family FROM j) WHERE family IS NOT NULL GROUP BY seed),
m AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY published_at DESC, url DESC) AS rn, count(*) OVER (PARTITION BY seed) AS members FROM j)
SELECT article_id AS item_id, country, members, coalesce(f.sources, 0)::BIGINT AS sources FROM m LEFT JOIN f USING (seed) WHERE rn = 1""")
def cluster_consolidated_members_words(spark, folder):
    """Consolidated stories without the sequence ratio: newest row, members and merged sources."""
    out = cluster.consolidate(stored(spark, folder).drop("summary"), ratio=False)
    return out.select("item_id", "country", "members", F.size("sources").cast("bigint").alias("sources"))


@check("cluster_consolidated_stories")
def cluster_consolidated_stories(spark, folder):
    return cluster.consolidate(stored(spark, folder).drop("summary")).select("item_id", "country", "headline", "summary", "members", F.size("sources").alias("sources"))


@check("risk_decision_candidates")
def risk_decision_candidates(spark, folder):
    return jobs.decision_candidates(stored(spark, folder), B.as_of(), 15, max_age_days=30, fill_with_context=True).select("country", "item_id", "headline", "decision", "risk.score")


@check("country_news_job")
def country_news_job(spark, folder):
    i = items(spark, folder)
    s = B.signals(spark, folder).withColumn("summary", F.lit("")).withColumn("source_url", F.lit(""))
    additions = i.select("country", "headline", "published_at", "url", "publisher", "coverage_scope", "source_type", F.concat("publisher", F.lit(".test")).alias("source_family"), F.lit("GDELT").alias("indexed_by"))
    articles, _, _, _ = jobs.country_news([i], additions, s, B.COUNTRIES, B.as_of())
    return articles.select("item_id", "country", "category", "headline", "coverage_scope", "relevance_score", F.size("sources").alias("sources"), "hazard_status")


@check("country_snapshot_job")
def country_snapshot_job(spark, folder):
    s = B.signals(spark, folder).withColumn("summary", F.lit("")).withColumn("source_url", F.lit(""))
    one = items(spark, folder).withColumn("category", F.lit("Infrastructure and supply chains"))
    return jobs.country_snapshot([one], s, B.COUNTRIES, B.as_of(), limit=5)[0].select("item_id", "country", "headline", "relevance_score", F.size("sources").alias("sources"), "hazard_status")


def snapshot_store(spark, folder):
    """Two refreshes of one category, six hours apart; the second one meets the stories and patterns of the first."""
    s = B.signals(spark, folder).withColumn("summary", F.lit("")).withColumn("source_url", F.lit(""))
    one = items(spark, folder).withColumn("category", F.lit("Infrastructure and supply chains"))
    place = f"{checkpoint_dir(spark)}/refreshes-{uuid.uuid4().hex}"
    for run, moment in (("1", B.as_of() - F.expr("INTERVAL 6 HOURS")), ("2", B.as_of())):
        refresh.collect(spark, place, run, lambda known: jobs.country_snapshot([one], s, B.COUNTRIES, moment, stored_patterns=known), moment)
    return place


@check("refresh_patterns")
def refresh_patterns(spark, folder):
    return refresh.patterns(spark, snapshot_store(spark, folder)).select("pattern_id", "country", "active_windows", "observation_count", "status", "change_status", "early_warning_score")


@check("refresh_articles")
def refresh_articles(spark, folder):
    return refresh.current(spark, snapshot_store(spark, folder), "articles").select("item_id", "country", "headline", "relevance_score", F.unix_seconds("collected_at").alias("collected_s"))


@check("general_news_job")
def general_news_job(spark, folder):
    one = items(spark, folder).withColumn("category", F.lit("General news"))
    return jobs.general_news([one], limit=10).select("item_id", "country", "headline", "category")


@check("country_risk_job")
def country_risk_job(spark, folder):
    s = B.signals(spark, folder).withColumn("summary", F.lit(""))
    out = jobs.country_risk(stored(spark, folder), s, exposures(spark, folder), anomalies(spark, folder), B.country(spark, folder), B.COUNTRIES, B.as_of())
    return out.select("country", "level", "score", "confidence", "mode", "sensor_status", "escalation")


def windowed_stories(spark, folder):
    """Articles as stories of six-hour refresh windows."""
    step = 6 * 3600
    return B.articles(spark, folder).withColumn("collected_at", F.timestamp_seconds((F.floor(F.unix_seconds("published_at") / step) + 1) * step))


@check("pattern_tracker")
def pattern_tracker(spark, folder):
    return tracker.track(windowed_stories(spark, folder)).select("country", "category", F.unix_seconds("collected_at").alias("window_s"), "place", "pattern_id", "active_windows", "observation_count", F.col("source_count").alias("sources"))


@check("pattern_scores")
def pattern_scores(spark, folder):
    from riskfabric.operators import volume
    s = windowed_stories(spark, folder)
    windows = volume.record_windows(s, candidate="article_id", story="headline")
    scored = tracker.latest_patterns(tracker.score_patterns(tracker.track(s), windows).drop("sources"))
    return scored.select("pattern_id", "country", "category", "status", "active_windows", "persistence_score", "early_warning_score", "alert_level", "alert_confidence")


# ------------------------------------------------------------------ ranking
@check("rank_feedback_weights", f"""
SELECT profile, rating_id, round(exp(-ln(2.0::DOUBLE) * greatest(0.0, (epoch_us({AS_OF}) - epoch_us(updated_at)) / 1000000.0 / 86400) / 90), 9) AS weight FROM b_feedback""")
def rank_feedback_weights(spark, folder):
    return B.feedback(spark, folder).select("profile", "rating_id", F.round(ranking.feedback_weight(F.col("updated_at"), B.as_of()), 9).alias("weight"))


@check("rank_recency", f"""
SELECT article_id, round(CASE WHEN article_id % 9 = 0 THEN 0.25 ELSE exp(-greatest(0.0, (epoch_us({AS_OF}) - epoch_us(published_at)) / 1000000.0 / 3600) / 72) END, 9) AS recency FROM b_articles""")
def rank_recency(spark, folder):
    return B.articles(spark, folder).select("article_id", F.round(ranking.recency(F.when(F.col("article_id") % 9 != 0, F.col("published_at")), B.as_of()), 9).alias("recency"))


VIEWS["j_terms"] = f"SELECT conv_id * 100 + turn AS doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'), lambda w: NOT list_contains({text_list(V.RANKING_STOPWORDS)}, w)) AS terms FROM conversations"


@check("rank_hashed_features", """
WITH f AS (SELECT doc_id, list_concat(terms, list_transform(range(1, len(terms)), lambda i: terms[i] || '_' || terms[i + 1])) AS f FROM j_terms),
e AS (SELECT doc_id, len(f) AS total, sha1(unnest(f)) AS h FROM f)
SELECT doc_id, CAST(('0x' || h[1:8])::BIGINT % 192 AS BIGINT) AS idx, round(sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / total), 9) AS value FROM e GROUP BY ALL""")
def rank_hashed_features(spark, folder):
    t = table(spark, folder, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), text.ranking_words(F.col("text")).alias("terms"))
    return ranking.hashed_features(t).withColumn("value", F.round("value", 9))


_DOC = "trim(headline || ' ' || category || ' ' || country)"
VIEWS["j_docs"] = f"""
SELECT 'p' || doc_number AS doc_id, pp.profile, NULL::BIGINT AS feedback, NULL::DOUBLE AS weight, doc FROM (SELECT article_id AS doc_number, country, {_DOC} AS doc FROM b_articles) c
  JOIN (SELECT DISTINCT profile, country FROM b_feedback) pp ON pp.country = c.country
UNION ALL SELECT 'f' || rating_id, profile, feedback, exp(-ln(2.0::DOUBLE) * greatest(0.0, (epoch_us({AS_OF}) - epoch_us(updated_at)) / 1000000.0 / 86400) / 90), {_DOC} FROM b_feedback"""


def ranking_documents(spark, folder):
    """Candidates by country, rated stories, and the countries whose candidates a profile is offered."""
    doc = lambda: F.concat_ws(" ", "headline", "category", "country")
    f = B.feedback(spark, folder)
    c = B.articles(spark, folder).select("article_id", "country", "headline", "category")
    candidates = c.select("country", F.concat(F.lit("p"), F.col("article_id").cast("string")).alias("doc_id"), doc().alias("text"))
    rated = f.select("profile", F.concat(F.lit("f"), F.col("rating_id").cast("string")).alias("doc_id"), doc().alias("text"), "feedback", ranking.feedback_weight(F.col("updated_at"), B.as_of()).alias("weight"))
    return candidates, rated, f.select("profile", "country").distinct()


@check("rank_affinity", f"""
WITH t AS (SELECT *, list_filter(regexp_extract_all(lower(doc), '[a-z][a-z0-9-]{{2,}}'), lambda w: NOT list_contains({text_list(V.RANKING_STOPWORDS)}, w)) AS terms FROM j_docs),
c AS (SELECT profile, doc_id, term, count(*) / max(size)::DOUBLE AS tf FROM (SELECT profile, doc_id, len(terms) AS size, unnest(terms) AS term FROM t) GROUP BY ALL),
n AS (SELECT profile, count(*) AS n FROM t GROUP BY profile), d AS (SELECT profile, term, count(*) AS df FROM c GROUP BY ALL),
v AS (SELECT c.profile, c.doc_id, c.term, tf * (ln((1 + n.n) / (1 + d.df)::DOUBLE) + 1) AS x FROM c JOIN d USING (profile, term) JOIN n USING (profile)),
l AS (SELECT profile, doc_id, sqrt(sum(x * x)) AS nrm FROM v GROUP BY ALL),
cs AS (SELECT a.profile, a.doc_id, b.doc_id AS other, sum(a.x * b.x) / (max(la.nrm) * max(lb.nrm)) AS cosine FROM v a JOIN v b ON a.profile = b.profile AND a.term = b.term AND a.doc_id LIKE 'p%' AND b.doc_id LIKE 'f%'
   JOIN l la ON la.profile = a.profile AND la.doc_id = a.doc_id JOIN l lb ON lb.profile = b.profile AND lb.doc_id = b.doc_id GROUP BY ALL),
w AS (SELECT profile, sum(weight) FILTER (WHERE feedback = 1) AS wl, sum(weight) FILTER (WHERE feedback = -1) AS wd FROM t WHERE doc_id LIKE 'f%' GROUP BY profile),
s AS (SELECT cs.profile, cs.doc_id, sum(cosine * f.weight) FILTER (WHERE f.feedback = 1) AS lk, sum(cosine * f.weight) FILTER (WHERE f.feedback = -1) AS dk FROM cs JOIN t f ON f.profile = cs.profile AND f.doc_id = cs.other GROUP BY ALL)
SELECT t.profile, t.doc_id, round(greatest(0.0, least(1.0, 0.5 + 0.5 * coalesce(lk / wl, 0) - 0.5 * coalesce(dk / wd, 0))), 6) AS affinity FROM t JOIN w USING (profile) LEFT JOIN s USING (profile, doc_id) WHERE t.doc_id LIKE 'p%'""")
def rank_affinity(spark, folder):
    candidates, rated, groups = ranking_documents(spark, folder)
    return ranking.lexical_affinity(candidates, rated, cut(groups)).select("profile", "doc_id", F.round("affinity", 6).alias("affinity"))


@check("rank_reason_terms", f"""
WITH t AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(doc), '[a-z][a-z0-9-]{{2,}}'), lambda w: NOT list_contains({text_list(V.RANKING_STOPWORDS)}, w))) AS terms FROM j_docs),
e AS (SELECT profile, doc_id, feedback, unnest(terms) AS term FROM t), lk AS (SELECT profile, term, count(*) AS n FROM e WHERE feedback = 1 GROUP BY ALL), dk AS (SELECT DISTINCT profile, term FROM e WHERE feedback = -1),
r AS (SELECT e.profile, e.doc_id, e.term, row_number() OVER (PARTITION BY e.profile, e.doc_id ORDER BY n DESC, e.term) AS rn FROM e JOIN lk USING (profile, term) ANTI JOIN dk USING (profile, term) WHERE e.doc_id LIKE 'p%')
SELECT profile, doc_id, string_agg(term, ',' ORDER BY rn) AS terms FROM r WHERE rn <= 3 GROUP BY ALL""")
def rank_reason_terms(spark, folder):
    candidates, rated, groups = ranking_documents(spark, folder)
    terms = ranking.ranking_words(F.col("text")).alias("terms")
    out = ranking.reason_terms(candidates.select("country", "doc_id", terms), rated.select("profile", "doc_id", "feedback", terms), cut(groups))
    return out.withColumn("terms", F.array_join("terms", ","))


def preference_rows(spark, folder):
    f = B.feedback(spark, folder).select("profile", F.col("rating_id").alias("doc_id"), "feedback", "updated_at",
                                        text.article_text(F.col("headline"), F.col("summary"), F.col("category"), F.col("country"), F.lit(None).cast("string")).alias("text"))
    features = ranking.packed_features(ranking.hashed_features(f.select("profile", "doc_id", text.ranking_words(F.col("text")).alias("terms")), keys=("profile",)), keys=("profile",))
    return f.join(features, ["profile", "doc_id"]).select("profile", "doc_id", "updated_at", "features", (F.col("feedback") == 1).cast("double").alias("target"),
                                                         ranking.feedback_weight(F.col("updated_at"), B.as_of()).alias("importance"))


@check("rank_preference_model", f"""
WITH RECURSIVE t AS (SELECT profile, rating_id, updated_at, CASE WHEN feedback = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target,
    exp(-ln(2.0::DOUBLE) * greatest(0.0, (epoch_us({AS_OF}) - epoch_us(updated_at)) / 1000000.0 / 86400) / 90) AS importance,
    list_filter(regexp_extract_all(lower(headline || ' ' || summary || ' ' || category || ' ' || country), '[a-z][a-z0-9-]{{2,}}'), lambda w: NOT list_contains({text_list(V.RANKING_STOPWORDS)}, w)) AS terms FROM b_feedback),
e AS (SELECT profile, rating_id, len(f) AS total, sha1(unnest(f)) AS h FROM (SELECT *, list_concat(terms, list_transform(range(1, len(terms)), lambda i: terms[i] || '_' || terms[i + 1])) AS f FROM t)),
x AS (SELECT profile, rating_id, CAST(('0x' || h[1:8])::BIGINT % 192 AS BIGINT) AS idx, sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / total) AS value FROM e GROUP BY ALL),
r AS (SELECT d.profile, d.rating_id, list(coalesce(x.value, 0.0::DOUBLE) ORDER BY i) AS v, list(x.value IS NOT NULL ORDER BY i) AS m
  FROM (SELECT DISTINCT profile, rating_id FROM x) d CROSS JOIN (SELECT unnest(range(192)) AS i) LEFT JOIN x ON x.profile = d.profile AND x.rating_id = d.rating_id AND x.idx = i GROUP BY ALL),
o AS (SELECT r.*, t.target, t.importance, row_number() OVER (PARTITION BY profile ORDER BY updated_at DESC, rating_id DESC) - 1 AS at, count(*) OVER (PARTITION BY profile) AS n FROM r JOIN t USING (profile, rating_id)),
g AS (SELECT profile, max(n) AS n FROM o GROUP BY profile HAVING count(*) >= 4 AND count(DISTINCT target) = 2),
s AS (SELECT profile, n, 0::BIGINT AS k, 0.0::DOUBLE AS bias, list_transform(range(192), lambda i: 0.0::DOUBLE) AS w FROM g
  UNION ALL SELECT z.profile, z.n, z.k + 1, z.bias + z.rate * z.err, list_transform(range(1, 193), lambda i: CASE WHEN z.m[i] THEN z.w[i] * (1.0::DOUBLE - z.rate * 0.001::DOUBLE) + z.rate * z.err * z.v[i] ELSE z.w[i] END)
  FROM (SELECT s.*, o.v, o.m, 0.35::DOUBLE / (1.0::DOUBLE + (s.k // s.n) * 0.12::DOUBLE) AS rate,
      (o.target - 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, s.bias + list_dot_product(s.w, o.v)))))) * o.importance AS err
    FROM s JOIN o ON o.profile = s.profile AND o.at = s.k % s.n WHERE s.k < 18 * s.n) z)
SELECT profile, round(bias, 6) AS bias, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS idx, round(unnest(w), 6) AS w FROM s WHERE k = 18 * n""")
def rank_preference_model(spark, folder):
    m = ranking.train_preferences(preference_rows(spark, folder))
    return m.select("profile", F.round("bias", 6).alias("bias"), F.posexplode("weights").alias("idx", "w")).withColumn("w", F.round("w", 6))


def ranked(spark, folder, pool=None):
    """Every article for every profile that has rated something of its country; summaries of both sides as a story roll-up stores them."""
    rated = B.articles(spark, folder).select("article_id", "publisher")
    short = text.summary_text(F.col("country"), F.col("category"), F.col("headline"), F.col("publisher"), F.col("summary"))
    f = B.feedback(spark, folder).join(rated, "article_id").withColumn("doc_id", -F.col("rating_id") - 1).withColumn("summary", short)
    pairs = f.select("profile", "country").distinct()
    c = (risky(spark, folder, B.articles(spark, folder)).withColumn("relevance_score", F.lit(60))
         .withColumn("transport_mode", F.col("risk.mode")).withColumn("doc_id", F.col("article_id")).withColumn("summary", short)
         .select("country", "doc_id", "url", "headline", "summary", "category", "transport_mode", "published_at", "relevance_score", "risk"))
    return ranking.rank_articles(c, f, B.as_of(), pool=pool, groups=pairs, on=["country"])


@check("rank_articles")
def rank_articles(spark, folder):
    return ranked(spark, folder).select("profile", "country", "doc_id", "rank", "recommendation_score", "interest_similarity", "learned_interest_score", "recommendation_model", "mandatory")


@check("rank_personal_selection")
def rank_personal_selection(spark, folder):
    return ranking.personal_selection(ranked(spark, folder, pool=15), 5).select("profile", "country", "doc_id", "rank", "position")
