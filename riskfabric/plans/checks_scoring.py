"""Queries on relevance, article risk and country risk."""

from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.operators import country, relational, scoring, store, volume
from riskfabric.plans import bindings as B
from riskfabric.plans.catalog import VIEWS, check, sql_any, sql_hits, sql_tokens, text_list
from riskfabric.plans.checks_text import SUFFIX_SQL, key_words_sql, mention_case_sql
from riskfabric.plans.checks_relational import NAMES
from riskfabric.plans.checks_volume import scored_windows

AS_OF = B.AS_OF_SQL


def touch(tokens, *lexicons):
    merged = list(dict.fromkeys(w for lexicon in lexicons for w in lexicon))
    return f"list_has_any({tokens}, {text_list(merged)})"


def count_hits(tokens, lexicon):
    return f"len(list_intersect({tokens}, {text_list(lexicon)}))"


def regex_any(text, patterns):
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(text, p.replace("'", "''")) for p in patterns) + ")"


_ASSETS = "list_filter([" + ", ".join(f"CASE WHEN country = '{c}' AND contains(low, '{a}') THEN '{a}' END" for a, c in V.ASSET_COUNTRY.items()) + "], lambda x: x IS NOT NULL)"
_FOREIGN = "(" + " OR ".join(f"(country <> '{c}' AND contains(low, '{p}'))" for p, c in V.FOREIGN_PLACE_COUNTRY.items()) + ")"
VIEWS["f_text"] = f"""
SELECT *, {SUFFIX_SQL.format(h='headline')} AS bare, headline || ' ' || summary AS txt, lower(headline || ' ' || summary) AS lowered,
  list_distinct({sql_tokens("headline || ' ' || summary")}) AS tokens FROM b_articles"""
VIEWS["f_flags"] = f"""
SELECT *, {regex_any('low', V.METAPHOR_PATTERNS)} AS metaphor, {mention_case_sql('bare', 'country')} AS explicit, {_ASSETS} AS assets, {_FOREIGN} AS foreign_place,
  {regex_any('low', V.STATEMENT_PATTERNS)} AND NOT {touch('bt', V.CONSEQUENCE, V.LITERAL_TRANSPORT)} AS statement, {regex_any('low', V.SUPPORT_PATTERNS)} AS support,
  {sql_any('low', V.STRATEGIC_ROUTES)} AS strategic, {touch('bt', V.LITERAL_TRANSPORT, V.HAZARD_EXPOSURE)} AS transport,
  {touch('bt', V.TRADE_EXPOSURE, V.UTILITY_EXPOSURE)} AS trade, {touch('bt', V.NATURAL_HAZARD)} AND {regex_any('low', V.ACTIVE_HAZARD_PATTERNS)} AS active_hazard,
  {touch('bt', V.CONSEQUENCE, V.ARMED_THREAT)} AS event
FROM (SELECT *, lower(bare || ' ' || summary) AS low, list_distinct({sql_tokens("bare || ' ' || summary")}) AS bt FROM f_text)"""
VIEWS["f_rel"] = f"""
SELECT *, indirect_score AS rel_score, indirect_score >= 60 AND gates AS relevant FROM (
  SELECT *, CAST(CASE WHEN metaphor OR statement OR support THEN least(30, raw) WHEN actor THEN least(40, raw) ELSE least(100, raw) END AS BIGINT) AS indirect_score,
    (explicit OR len(assets) > 0) AND operational AND (transport OR broader OR coverage_scope = 'Primary operational' OR active_hazard) AND NOT (metaphor OR statement OR support OR actor) AS gates
  FROM (SELECT *, CASE WHEN explicit THEN 45 ELSE 0 END + CASE WHEN operational THEN 30 ELSE 0 END + CASE WHEN transport THEN 20 ELSE 0 END + CASE WHEN len(assets) > 0 AND NOT explicit THEN 35 ELSE 0 END
      + CASE WHEN broader AND NOT transport THEN 20 ELSE 0 END + CASE coverage_scope WHEN 'Primary operational' THEN 10 WHEN 'Local / regional' THEN 5 ELSE 0 END + CASE WHEN strategic THEN 5 ELSE 0 END AS raw
    FROM (SELECT *, trade OR strategic AS broader, (event OR active_hazard) AND NOT metaphor AND NOT support AS operational, explicit AND foreign_place AND len(assets) = 0 AS actor FROM f_flags)))"""


def relevant_articles(spark, folder):
    return scoring.with_relevance(scoring.with_tokens(B.articles(spark, folder)))


@check("risk_country_relevance", f"""
SELECT article_id, rel_score AS score, relevant, gates AS evidence_gates, len(assets) > 0 AS country_inferred, metaphor AS metaphorical, actor AS actor_only, statement AS statement_only,
  CASE WHEN r = '' THEN '{V.REASON_NONE}' ELSE r END AS reason FROM (SELECT *, array_to_string(list_filter([CASE WHEN explicit THEN '{V.REASON_COUNTRY}' END,
   CASE WHEN len(assets) > 0 THEN '{V.REASON_ASSET}' || array_to_string(assets, ', ') END, CASE WHEN operational THEN '{V.REASON_OPERATIONAL}' END,
   CASE WHEN transport THEN '{V.REASON_TRANSPORT}' WHEN broader THEN '{V.REASON_BROADER}' END, CASE WHEN coverage_scope = 'Primary operational' THEN '{V.REASON_PRIMARY}' END], lambda x: x IS NOT NULL), '; ') AS r FROM f_rel)""")
def risk_country_relevance(spark, folder):
    return relevant_articles(spark, folder).select("article_id", "relevance.*")


@check("risk_exposure_index", f"""
SELECT country, CAST(round_even({" + ".join(f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {f}::DOUBLE)) * {w}::DOUBLE" for f, w in V.EXPOSURE_WEIGHTS.items())}, 0) AS BIGINT) AS exposure_index FROM b_exposure""")
def risk_exposure_index(spark, folder):
    return B.exposure(spark, folder).select("country", scoring.exposure_index().alias("exposure_index"))


VIEWS["f_exposure"] = f"""
SELECT country, CAST(round_even({" + ".join(f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {f}::DOUBLE)) * {w}::DOUBLE" for f, w in V.EXPOSURE_WEIGHTS.items())}, 0) AS BIGINT) AS exposure_index
FROM b_exposure WHERE supplier_concentration > 20"""


def exposures(spark, folder):
    return B.exposure(spark, folder).filter(F.col("supplier_concentration") > 20).select("country", scoring.exposure_index().alias("exposure_index"))


VIEWS["f_evidence"] = """
SELECT article_id, CAST(count(*) AS BIGINT) AS source_count, CAST(count(*) FILTER (WHERE w > 1) AS BIGINT) AS primary_source_count, CAST(sum(w) AS DOUBLE) AS evidence_weight FROM (
  SELECT article_id, s.source_family, max(CASE WHEN s.source_type = 'Port authority' THEN 1.5 ELSE 1.0 END) AS w FROM (SELECT article_id, unnest(sources) AS s FROM b_articles) GROUP BY ALL) GROUP BY article_id"""
_ROUTES = "list_sort(list_filter([" + ", ".join(f"CASE WHEN contains(lowered, '{r}') THEN '{r}' END" for r in V.STRATEGIC_ROUTES) + "], lambda x: x IS NOT NULL))"
VIEWS["f_conn0"] = f"""
SELECT t.*, e.* EXCLUDE article_id, x.exposure_index AS dep, {count_hits('tokens', V.ASSET)} AS n_assets, {_ROUTES} AS routes, {mention_case_sql('txt', 't.country')} AS here,
  regexp_matches(txt, '{V.NAMED_ASSET_PATTERN.replace("'", "''")}') AS named, {count_hits('tokens', V.CONSEQUENCE)} AS n_cons, {touch('tokens', V.ARMED_THREAT)} AS armed,
  {touch('tokens', V.RESOLUTION)} AS settled, {touch('tokens', V.ACTIVE_STATUS)} AS ongoing, {touch('tokens', V.DEVELOPING_STATUS)} AS pending,
  greatest(0.0, (epoch_us({AS_OF}) - epoch_us(published_at)) / 1000000.0 / 86400) AS age
FROM f_text t JOIN f_evidence e ON e.article_id = t.article_id LEFT JOIN f_exposure x ON x.country = t.country"""
VIEWS["f_conn"] = """
SELECT *, CASE WHEN gate THEN raw_conn ELSE least(raw_conn, 59) END AS conn_score FROM (
 SELECT *, asset_location >= 50 AND consequence >= 50 AND source_support >= 70 AS gate,
  CAST(round_even(CASE WHEN dep IS NULL THEN asset_location * 0.3125::DOUBLE + consequence * 0.375::DOUBLE + source_support * 0.1875::DOUBLE + temporal * 0.125::DOUBLE
    ELSE asset_location * 0.25::DOUBLE + consequence * 0.30::DOUBLE + dep * 0.20::DOUBLE + source_support * 0.15::DOUBLE + temporal * 0.10::DOUBLE END, 0) AS BIGINT) AS raw_conn FROM (
  SELECT *, CASE lifecycle WHEN 'Recovering / resolved' THEN 25 WHEN 'Historical / stale' THEN 10 WHEN 'Active' THEN CASE WHEN age <= 1 THEN 100 ELSE 85 END WHEN 'Developing' THEN 70 WHEN 'Recently reported' THEN 65 ELSE 40 END AS temporal FROM (
   SELECT *, CASE WHEN n_assets > 0 THEN 55 ELSE 0 END + CASE WHEN named THEN 25 ELSE 0 END + CASE WHEN here OR len(routes) > 0 THEN 20 ELSE 0 END AS asset_location,
    CASE WHEN n_cons > 0 THEN least(100, 25 + n_cons * 18) WHEN armed AND (n_assets > 0 OR len(routes) > 0) THEN 35 ELSE 0 END AS consequence,
    CASE WHEN primary_source_count > 0 AND source_count >= 2 THEN 100 WHEN primary_source_count > 0 THEN 80 WHEN source_count >= 2 THEN 70 ELSE 35 END AS source_support,
    CASE WHEN settled THEN 'Recovering / resolved' WHEN age > 30 THEN 'Historical / stale' WHEN ongoing OR age <= 3 THEN 'Active' WHEN pending THEN 'Developing' WHEN age <= 7 THEN 'Recently reported' ELSE 'Status unconfirmed' END AS lifecycle
   FROM f_conn0)))"""


def connected(spark, folder, articles=None):
    a = (B.articles(spark, folder) if articles is None else articles).join(exposures(spark, folder), "country", "left")
    return scoring.with_connection(scoring.with_tokens(a), B.as_of())


@check("risk_operational_connection", """
SELECT article_id, CAST(conn_score AS BIGINT) AS score, raw_conn AS raw_score, gate AS gate_passed, CASE WHEN conn_score >= 70 AND gate THEN 'Strong' WHEN conn_score >= 45 THEN 'Moderate' ELSE 'Weak' END AS strength,
  CAST(asset_location AS BIGINT) AS asset_location, CAST(consequence AS BIGINT) AS consequence, CAST(source_support AS BIGINT) AS source_support, CAST(temporal AS BIGINT) AS temporal_relevance, lifecycle,
  array_to_string(list_concat(CASE WHEN here THEN [country] ELSE [] END, routes), '|') AS locations FROM f_conn""")
def risk_operational_connection(spark, folder):
    c = F.col("connection")
    return connected(spark, folder).select("article_id", *[c[n].alias(n) for n in (
        "score", "raw_score", "gate_passed", "strength", "asset_location", "consequence", "source_support", "temporal_relevance", "lifecycle")],
        F.array_join(c["locations"], "|").alias("locations"))


VIEWS["f_risk0"] = f"""
SELECT *, {count_hits('t3', V.MARITIME)} AS sea, {count_hits('t3', V.AVIATION)} AS air, {count_hits('t3', V.DISRUPTION)} AS dis, {count_hits('t3', V.CRITICAL)} AS crit,
  list_sort(list_intersect(t3, {text_list(V.CONSEQUENCE)})) AS terms, {touch('t3', V.ARMED_THREAT)} AS armed3, {touch('t3', ["shipping", "ship", "vessel", "airspace", "airport"])} AS carrier,
  list_contains(t3, 'sanction') AS sanction, {touch('t3', V.EFFECT_HAZARD_TERMS)} AS haz, {touch('t3', V.EFFECT_SECURITY_TERMS)} AS sec
FROM (SELECT *, list_distinct({sql_tokens("txt || ' ' || category")}) AS t3 FROM f_conn)"""
VIEWS["f_risk"] = f"""
SELECT *, CASE WHEN score >= 70 THEN 'Critical' WHEN score >= 38 THEN 'Moderate' ELSE 'Low' END AS level,
  CASE WHEN sea > 0 AND air > 0 THEN 'Maritime and aviation' WHEN sea > 0 THEN 'Maritime' WHEN air > 0 THEN 'Aviation' ELSE 'Multimodal / indirect' END AS mode,
  list_filter([CASE WHEN sea > 0 THEN '{V.EFFECT_MARITIME}' END, CASE WHEN air > 0 THEN '{V.EFFECT_AVIATION}' END, CASE WHEN sanction THEN '{V.EFFECT_SANCTION}' END,
    CASE WHEN haz THEN '{V.EFFECT_HAZARD}' END, CASE WHEN sec THEN '{V.EFFECT_SECURITY}' END], lambda x: x IS NOT NULL) AS effects0,
  CAST(least(95, round_even(42 + least(30.0, evidence_weight * 7) + least(18, dis * 4), 0)) AS BIGINT) AS confidence,
  CAST(greatest(5, 18 - least(10, round_even(evidence_weight * 2, 0))) AS BIGINT) AS uncertainty,
  (source_count >= 2 OR primary_source_count >= 1) AND (len(terms) > 0 OR inferred) AS credible
FROM (SELECT *, CAST(CASE WHEN capped >= 70 AND source_count < 2 AND primary_source_count = 0 THEN 69 ELSE capped END AS BIGINT) AS score FROM (
 SELECT *, CASE WHEN provisional THEN least(gated, 37) ELSE gated END AS capped FROM (
  SELECT *, CASE WHEN NOT gate AND blend >= 70 THEN 69 ELSE blend END AS gated FROM (
   SELECT *, CAST(round_even(impact * 0.70::DOUBLE + conn_score * 0.30::DOUBLE, 0) AS BIGINT) AS blend FROM (
    SELECT *, CASE WHEN source_count >= 2 AND armed3 AND sea > 0 AND air > 0 AND len(terms) >= 2 THEN greatest(imp0, 78) ELSE imp0 END AS impact FROM (
     SELECT *, CASE WHEN inferred AND len(terms) = 0 THEN greatest(38, least(base, 69)) ELSE base END AS imp0, len(terms) = 0 AND source_count < 2 AND primary_source_count = 0 AND NOT inferred AS provisional FROM (
      SELECT *, least(100, least(100, 12 + dis * 10 + crit * 8 + least(12, (sea + air) * 4)) + CASE WHEN category = 'Infrastructure and supply chains' THEN 12 ELSE 0 END) AS base,
        armed3 AND (sea > 0 OR air > 0) AND (len(routes) > 0 OR carrier) AS inferred FROM f_risk0)))))))"""


def risky(spark, folder, articles=None):
    return scoring.with_risk(connected(spark, folder, articles), B.as_of())


@check("risk_article", f"""
SELECT article_id, score, level, mode, confidence, greatest(0, confidence - uncertainty) AS confidence_low, least(100, confidence + uncertainty) AS confidence_high,
  CASE WHEN len(effects0) > 0 THEN array_to_string(effects0, '|') ELSE '{V.EFFECT_NONE}' END AS effects, source_count, primary_source_count, provisional, array_to_string(terms, ',') AS operational_terms, inferred AS inferred_route_exposure FROM f_risk""")
def risk_article(spark, folder):
    r = F.col("risk")
    return risky(spark, folder).select("article_id", *[r[n].alias(n) for n in (
        "score", "level", "mode", "confidence", "confidence_low", "confidence_high", "source_count", "primary_source_count", "provisional", "inferred_route_exposure")],
        F.array_join(r["effects"], "|").alias("effects"), F.array_join(r["operational_terms"], ",").alias("operational_terms"))


@check("risk_decision_filter", f"""
SELECT article_id, level IN ('Moderate', 'Critical') OR len(terms) > 0 OR inferred OR primary_source_count >= 1 OR ({touch('tokens', V.DECISION_HAZARDS)} AND source_count >= 2 AND NOT {sql_any('lowered', V.METAPHORICAL_HAZARDS)}) AS decision_relevant FROM f_risk""")
def risk_decision_filter(spark, folder):
    return risky(spark, folder).select("article_id", scoring.decision_relevant().alias("decision_relevant"))


@check("risk_historical_brief", f"""
SELECT country, article_id, score FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY published_at DESC, url DESC) AS rn FROM f_risk WHERE published_at < {AS_OF} - INTERVAL 7 DAY AND score >= 22) WHERE rn <= 10""")
def risk_historical_brief(spark, folder):
    old = risky(spark, folder, B.articles(spark, folder).filter(F.col("published_at") < B.as_of() - F.make_dt_interval(F.lit(7))))
    return scoring.historical_brief(old, 10).select("country", "article_id", F.col("risk.score").alias("score"))


# ------------------------------------------------------------------ countries
VIEWS["g_window"] = "SELECT *, power(0.9::DOUBLE, pos - 1) AS w FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY published_at DESC, url DESC) AS pos FROM f_risk) WHERE pos <= 10"
VIEWS["g_signals"] = f"""
SELECT id, event_type, title, severity, confidence, source, observed_at, arg_min(name, (-length(name), name)) AS mc FROM (
  SELECT s.*, n.name FROM b_signals s JOIN {NAMES} n ON {mention_case_sql("(s.country || ' ' || s.location)", 'n.name')}) GROUP BY ALL"""
VIEWS["g_support"] = f"""
SELECT s.id, s.mc, s.severity, s.confidence, s.source, s.title, s.observed_at, CAST(count(*) FILTER (WHERE n >= 2) AS BIGINT) AS support_count, CAST(coalesce(max(n) FILTER (WHERE n >= 2), 0) AS BIGINT) AS best_overlap FROM (
  SELECT s.*, len(list_intersect(list_filter(list_distinct({sql_tokens("s.event_type || ' ' || s.title || ' '")}), lambda x: NOT list_contains({text_list(V.SIGNAL_STOPWORDS)}, x) AND NOT list_contains({sql_tokens('s.mc')}, x)), list_distinct({sql_tokens("a.headline")}))) AS n
  FROM g_signals s LEFT JOIN g_window a ON a.country = s.mc) s GROUP BY ALL"""
VIEWS["g_sensor"] = """
SELECT mc AS country, CAST(count(*) AS BIGINT) AS sensor_count, max_by(severity, (support_count > 0, sv, best_overlap, observed_at, id)) AS severity, max_by(id, (support_count > 0, sv, best_overlap, observed_at, id)) AS id,
  max_by(support_count, (support_count > 0, sv, best_overlap, observed_at, id)) AS support_count, max_by(severity, (sv, observed_at, id)) AS strongest_severity, max_by(title, (sv, observed_at, id)) AS strongest_title, max_by(confidence, (sv, observed_at, id)) AS strongest_confidence
FROM (SELECT *, CASE severity WHEN 'Critical' THEN 85 WHEN 'High' THEN 62 WHEN 'Watch' THEN 34 ELSE 20 END AS sv FROM g_support) GROUP BY mc"""


def window(spark, folder):
    # The window orders by time and url, so it is cut before anything is scored.
    newest = country.newest_events(B.articles(spark, folder))
    return country.scoring_window(risky(spark, folder, newest))


def sensors(spark, folder):
    s = B.signals(spark, folder).withColumn("summary", F.lit(""))
    return relational.locate_signals(s, B.COUNTRIES).filter("matched_country IS NOT NULL")


@check("country_signal_corroboration", """SELECT id, mc AS matched_country, support_count, best_overlap FROM g_support""")
def country_signal_corroboration(spark, folder):
    return country.signal_corroboration(sensors(spark, folder), window(spark, folder)).select("id", "matched_country", "support_count", "best_overlap")


@check("country_sensor_selection", """SELECT country, id, support_count, CASE WHEN support_count > 0 THEN 'Corroborated' ELSE 'Provisional' END AS sensor_status, sensor_count FROM g_sensor""")
def country_sensor_selection(spark, folder):
    chosen = country.select_sensor(country.signal_corroboration(sensors(spark, folder), window(spark, folder)))
    return chosen.select("country", "sensor.id", "sensor.support_count", "sensor_status", "sensor_count")


VIEWS["g_stats"] = """
SELECT country, CAST(count(*) AS BIGINT) AS window_size, CAST(count(*) FILTER (WHERE credible) AS BIGINT) AS credible_count, coalesce(bool_or(credible AND level IN ('Moderate', 'Critical')), false) AS credible_moderate, bool_or(len(terms) > 0) AS any_operational,
  list(mode) AS modes, sum(w) FILTER (WHERE credible) AS cw, sum(w * score) FILTER (WHERE credible) / sum(w) FILTER (WHERE credible) AS cmean,
  CAST(round_even(sum(w * score) / sum(w), 0) AS BIGINT) AS recency_score, CAST(round_even(sum(w * confidence) / sum(w), 0) AS BIGINT) AS event_confidence,
  max_by(score, (credible, score, -pos)) AS s_score, max_by(level, (credible, score, -pos)) AS s_level, max_by(source_count, (credible, score, -pos)) AS s_sources, max_by(primary_source_count, (credible, score, -pos)) AS s_primary,
  max_by(len(terms) > 0 OR inferred, (credible, score, -pos)) AS s_operational, list({'s': score, 'c': credible} ORDER BY score DESC, pos)[1:3] AS top3,
  array_to_string(list(headline ORDER BY pos)[1:3], '; ') AS heads FROM g_window GROUP BY country"""
VIEWS["g_joined"] = """
SELECT c.country, s.* EXCLUDE country, g.sensor_count, g.severity AS sensor_severity, g.support_count, g.strongest_severity, g.strongest_confidence, g.strongest_title, x.exposure_index, coalesce(v.anomaly_index, 0) AS anomaly,
  CASE WHEN g.country IS NULL THEN 'None' WHEN g.support_count > 0 THEN 'Corroborated' ELSE 'Provisional' END AS sensor_status
FROM b_country c LEFT JOIN g_stats s USING (country) LEFT JOIN g_sensor g USING (country) LEFT JOIN f_exposure x USING (country)
LEFT JOIN (SELECT country, CAST(round_even(least(100.0, greatest(0.0, max(anomaly)) / 3 * 100), 0) AS BIGINT) AS anomaly_index FROM v_volume WHERE collected_at >= TIMESTAMP '2024-01-26 00:00:00' GROUP BY country) v USING (country)"""
VIEWS["g_event"] = """
SELECT *, CAST(round_even(likelihood * credible_event / 100.0::DOUBLE, 0) AS BIGINT) AS likelihood_impact FROM (
 SELECT *, CAST(CASE WHEN credible_count > 0 THEN least(100, round_even(0.70::DOUBLE * s_score + 0.30::DOUBLE * cmean + bonus, 0)) ELSE least(37, s_score) END AS BIGINT) AS credible_event FROM (
  SELECT *, CAST(CASE WHEN credible_count > 0 THEN least(12, greatest(0, round_even((cw - 1) * 3, 0))) ELSE 0 END AS BIGINT) AS bonus,
   CAST(CASE WHEN window_size IS NULL THEN NULL ELSE least(100, 15 + CASE WHEN s_operational THEN 35 ELSE 0 END + CASE WHEN s_sources >= 2 THEN 20 ELSE 0 END + CASE WHEN s_primary >= 1 THEN 15 ELSE 0 END
     + least(15, greatest(0, s_sources - 1) * 5) + CASE WHEN sensor_status = 'Corroborated' THEN 10 ELSE 0 END) END AS BIGINT) AS likelihood FROM g_joined))"""
VIEWS["g_final"] = """
SELECT *, CASE WHEN window_size IS NOT NULL THEN greatest(banded, coalesce(floor_score, banded)) WHEN sensor_count IS NOT NULL THEN
    CAST(round_even(CASE strongest_severity WHEN 'Critical' THEN 85 WHEN 'High' THEN 62 WHEN 'Watch' THEN 34 ELSE 20 END * 0.35::DOUBLE, 0) AS BIGINT) ELSE 0 END AS final_score,
  CASE WHEN window_size IS NOT NULL THEN event_confidence WHEN sensor_count IS NOT NULL THEN least(45, strongest_confidence) ELSE 15 END AS final_confidence FROM (
 SELECT *, CASE WHEN s_level = 'Critical' AND s_score >= 70 AND s_sources >= 2 AND s_operational THEN 75 WHEN len(top3) = 3 AND top3_mean >= 65 AND len(list_filter(top3, lambda t: t.c)) = 3 THEN 70
     WHEN sensor_status = 'Corroborated' AND sensor_severity = 'Critical' AND any_operational THEN 72 END AS floor_score FROM (
  SELECT *, CASE WHEN credible_moderate THEN greatest(hybrid, 38) WHEN sensor_status <> 'Corroborated' THEN least(hybrid, 37) ELSE hybrid END AS banded,
    CAST(round_even(list_sum(list_transform(top3, lambda t: t.s)) / CAST(len(top3) AS DOUBLE), 0) AS BIGINT) AS top3_mean FROM (
   SELECT *, CAST(round_even(CASE WHEN exposure_index IS NULL THEN credible_event * 0.50::DOUBLE + likelihood_impact * 0.286::DOUBLE + anomaly * 0.214::DOUBLE
     ELSE credible_event * 0.35::DOUBLE + exposure_index * 0.30::DOUBLE + likelihood_impact * 0.20::DOUBLE + anomaly * 0.15::DOUBLE END, 0) AS BIGINT) AS hybrid FROM g_event)))"""


def anomalies(spark, folder):
    recent = scored_windows(spark, folder).select("country", F.col("anomaly").alias("anomaly_score"), F.col("collected_at").alias("last_seen"))
    return volume.anomaly_index(recent, B.as_of(), 5)


def assessment(spark, folder):
    dim = B.country(spark, folder).select("country")
    return country.assess(dim, window(spark, folder), sensors(spark, folder), exposures(spark, folder), anomalies(spark, folder))


@check("country_event_components", """
SELECT country, credible_count, CAST(bonus AS BIGINT) AS concurrency_bonus, credible_event, likelihood, likelihood_impact, recency_score, coalesce(CAST(round_even(cmean, 0) AS BIGINT), 0) AS credible_mean
FROM g_event WHERE window_size IS NOT NULL""")
def country_event_components(spark, folder):
    a = assessment(spark, folder).filter(F.col("recency_score").isNotNull())
    return a.select("country", "credible_count", "concurrency_bonus", "credible_event", "likelihood", "likelihood_impact", "recency_score", "credible_mean")


@check("country_assessment", f"""
SELECT country, final_score AS score, CASE WHEN final_score >= 70 THEN 'Critical' WHEN final_score >= 38 THEN 'Moderate' ELSE 'Low' END AS level, CAST(final_confidence AS BIGINT) AS confidence,
  CAST(greatest(0, CASE WHEN window_size IS NOT NULL THEN final_confidence - greatest(5, 15 - least(8, window_size)) WHEN sensor_count IS NOT NULL THEN final_confidence - 12 ELSE 5 END) AS BIGINT) AS confidence_low,
  CAST(least(100, CASE WHEN window_size IS NOT NULL THEN final_confidence + greatest(5, 15 - least(8, window_size)) WHEN sensor_count IS NOT NULL THEN final_confidence + 8 ELSE 30 END) AS BIGINT) AS confidence_high,
  CASE WHEN window_size IS NULL AND sensor_count IS NULL THEN 'Insufficient evidence'
    WHEN window_size IS NULL THEN CASE WHEN {sql_hits(sql_tokens('strongest_title'), V.MARITIME)} > 0 AND {sql_hits(sql_tokens('strongest_title'), V.AVIATION)} > 0 THEN 'Maritime and aviation'
      WHEN {sql_hits(sql_tokens('strongest_title'), V.MARITIME)} > 0 THEN 'Maritime' WHEN {sql_hits(sql_tokens('strongest_title'), V.AVIATION)} > 0 THEN 'Aviation' ELSE 'Multimodal / indirect' END
    WHEN list_contains(modes, 'Maritime and aviation') OR (list_contains(modes, 'Maritime') AND list_contains(modes, 'Aviation')) THEN 'Maritime and aviation'
    WHEN list_contains(modes, 'Maritime') THEN 'Maritime' WHEN list_contains(modes, 'Aviation') THEN 'Aviation' ELSE 'Multimodal / indirect' END AS mode,
  sensor_status, CAST(coalesce(window_size, sensor_count, 0) AS BIGINT) AS evidence_count, CASE WHEN window_size IS NULL THEN '' WHEN floor_score = 75 THEN 'severe corroborated event' WHEN floor_score = 70 THEN 'concurrent high-impact events' WHEN floor_score = 72 THEN 'corroborated critical sensor' ELSE '' END AS escalation,
  CASE WHEN window_size IS NULL AND sensor_count IS NOT NULL THEN 'Provisional sensor only' WHEN window_size IS NULL THEN 'Insufficient evidence' WHEN exposure_index IS NULL THEN 'Generic hybrid (company exposure not configured)' ELSE 'Exposure-aware hybrid' END AS model FROM g_final""")
def country_assessment(spark, folder):
    return assessment(spark, folder).select("country", "score", "level", "confidence", "confidence_low", "confidence_high", "mode", "sensor_status", "evidence_count", "escalation", "model")


@check("country_risk_list", """SELECT country, final_score AS score, CAST(final_confidence AS BIGINT) AS confidence FROM g_final WHERE final_score >= 38 AND final_score < 70""")
def country_risk_list(spark, folder):
    return relational.risk_list(assessment(spark, folder), "Moderate").select("country", "score", "confidence")


@check("country_level_counts", """SELECT CASE WHEN final_score >= 70 THEN 'Critical' WHEN final_score >= 38 THEN 'Moderate' ELSE 'Low' END AS level, CAST(count(*) AS BIGINT) AS countries FROM g_final GROUP BY 1""")
def country_level_counts(spark, folder):
    return relational.level_counts(assessment(spark, folder))


@check("country_choropleth", """
SELECT 'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3, country, CAST(CASE WHEN final_score >= 70 THEN 2 WHEN final_score >= 38 THEN 1 ELSE 0 END AS BIGINT) AS level_code, final_score AS score, CAST(final_confidence AS BIGINT) AS confidence FROM g_final JOIN b_country USING (country)""")
def country_choropleth(spark, folder):
    dim = B.country(spark, folder).select("country", F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"))
    return country.choropleth(assessment(spark, folder), dim).select("iso3", "country", "level_code", "score", "confidence")
