"""Relevance of a story to a country, and its operational risk.

Each step adds columns to the article rows; nothing here shuffles. Texts are tokenised once
(``with_tokens``) and every later test works on the token array or the lower-cased text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions import places, provenance, tone
from riskfabric.functions.scoring import risk_band
from riskfabric.functions.text import blank, contains_any, half_even, hits, matches_any, phrase, strip_publisher, touches, word_set
from riskfabric.functions.times import age_days
from riskfabric.session import stage


def exposure_index(fields=V.EXPOSURE_WEIGHTS) -> Column:
    """Weighted index of the six exposure inputs, each clamped to 0-100."""
    total = F.lit(0.0)
    for name, weight in fields.items():
        total = total + F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col(name).cast("double"), F.lit(0.0)))) * weight
    return half_even(total)


def with_tokens(df: DataFrame) -> DataFrame:
    """Token sets and lower-cased texts used by all scores."""
    bare = strip_publisher(F.col("headline"))
    return (df.withColumn("bare_headline", bare)
              .withColumn("head_tokens", word_set(F.col("headline")))
              .withColumn("body_tokens", word_set(F.col("summary")))
              .withColumn("tokens", F.array_union("head_tokens", "body_tokens"))
              .withColumn("bare_tokens", F.array_union(word_set(F.col("bare_headline")), F.col("body_tokens")))
              .withColumn("text", phrase(F.col("headline"), F.col("summary")))
              .withColumn("lowered", F.lower("text")))


TOKEN_COLUMNS = ["bare_headline", "head_tokens", "body_tokens", "tokens", "bare_tokens", "text", "lowered"]


def with_relevance(df: DataFrame, threshold=60) -> DataFrame:
    """Add ``relevance``: score, gate, flags and the reason. Needs ``with_tokens``."""
    low = F.lower(phrase(F.col("bare_headline"), F.col("summary")))
    country, tokens = F.col("country"), F.col("bare_tokens")
    brand = F.lit(False)
    for name, phrase_text in V.AMBIGUOUS_BRANDS.items():
        brand = brand | ((country == name) & F.col("__low").contains(phrase_text))
    scope = blank(F.col("coverage_scope"))
    staged = df.withColumn("__low", low)
    staged = staged.withColumns({
        "__metaphor": matches_any(F.col("__low"), V.METAPHOR_PATTERNS),
        "__explicit": places.country_mentioned(F.col("bare_headline"), country) & ~brand,
        "__assets": places.inferred_assets(F.col("__low"), country),
        "__foreign": places.foreign_places(F.col("__low"), country),
        "__statement": matches_any(F.col("__low"), V.STATEMENT_PATTERNS) & ~touches(tokens, V.CONSEQUENCE, V.LITERAL_TRANSPORT),
        "__support": matches_any(F.col("__low"), V.SUPPORT_PATTERNS),
        "__strategic": contains_any(F.col("__low"), V.STRATEGIC_ROUTES),
        "__transport": touches(tokens, V.LITERAL_TRANSPORT, V.HAZARD_EXPOSURE),
        "__active_hazard": touches(tokens, V.NATURAL_HAZARD) & matches_any(F.col("__low"), V.ACTIVE_HAZARD_PATTERNS),
        "__event": touches(tokens, V.CONSEQUENCE, V.ARMED_THREAT),
        "__primary": scope == "Primary operational",
        "__local": scope == "Local / regional"})
    has_asset = F.size("__assets") > 0
    staged = staged.withColumns({
        "__broader": touches(tokens, V.TRADE_EXPOSURE, V.UTILITY_EXPOSURE) | F.col("__strategic"),
        "__operational": (F.col("__event") | F.col("__active_hazard")) & ~F.col("__metaphor") & ~F.col("__support"),
        "__actor": F.col("__explicit") & F.col("__foreign") & ~has_asset})
    yes = lambda name: F.col(name)
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    raw = (points(yes("__explicit"), 45) + points(yes("__operational"), 30) + points(yes("__transport"), 20)
           + points(has_asset & ~yes("__explicit"), 35) + points(yes("__broader") & ~yes("__transport"), 20)
           + F.when(yes("__primary"), 10).when(yes("__local"), 5).otherwise(0) + points(yes("__strategic"), 5))
    indirect = yes("__metaphor") | yes("__statement") | yes("__support")
    capped = F.when(indirect, F.least(F.lit(30), F.least(F.lit(100), raw))).when(yes("__actor"), F.least(F.lit(40), raw)).otherwise(F.least(F.lit(100), raw))
    exposure = yes("__transport") | yes("__broader") | yes("__primary") | yes("__active_hazard")
    gates = (yes("__explicit") | has_asset) & yes("__operational") & exposure & ~(indirect | yes("__actor"))
    reason = F.array_join(F.array_compact(F.array(
        F.when(yes("__explicit"), V.REASON_COUNTRY),
        F.when(has_asset, F.concat(F.lit(V.REASON_ASSET), F.array_join("__assets", ", "))),
        F.when(yes("__operational"), V.REASON_OPERATIONAL),
        F.when(yes("__transport"), V.REASON_TRANSPORT).when(yes("__broader"), V.REASON_BROADER),
        F.when(yes("__primary"), V.REASON_PRIMARY))), "; ")
    result = F.struct(
        capped.cast("bigint").alias("score"), (gates & (capped >= threshold)).alias("relevant"),
        F.when(reason == "", V.REASON_NONE).otherwise(reason).alias("reason"), gates.alias("evidence_gates"),
        has_asset.alias("country_inferred"), yes("__metaphor").alias("metaphorical"), yes("__actor").alias("actor_only"),
        yes("__statement").alias("statement_only"))
    helper = [c for c in staged.columns if c.startswith("__") and c not in df.columns]
    return stage(staged.withColumn("relevance", result).drop(*helper), "relevance")


def with_connection(df: DataFrame, as_of: Column, time="published_at") -> DataFrame:
    """Add ``connection``: assets, consequences, support and timing with the evidence gate.

    Reads ``exposure_index`` when the column exists (NULL means not configured) and ``evidence``.
    """
    tokens, low = F.col("tokens"), F.col("lowered")
    staged = df if "evidence" in df.columns else df.withColumn("evidence", provenance.source_evidence(F.col("sources")))
    routes = F.array_sort(F.array_compact(F.array(*[F.when(low.contains(r), F.lit(r)) for r in V.STRATEGIC_ROUTES])))
    named = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(V.NAMED_ASSET_PATTERN), F.lit(0))))
    here = F.when(places.country_mentioned(F.col("text"), F.col("country")), F.array("country")).otherwise(F.array().cast("array<string>"))
    age = F.when(F.col(time).isNotNull(), age_days(as_of, F.col(time)))
    dependency = F.col("exposure_index") if "exposure_index" in df.columns else F.lit(None).cast("bigint")
    staged = staged.withColumns({
        "__assets": F.array_sort(hits(tokens, V.ASSET)), "__named": named, "__routes": routes, "__age": age,
        "__terms": F.array_sort(hits(tokens, V.CONSEQUENCE)), "__dep": dependency.cast("double")})
    staged = staged.withColumn("__where", F.concat(here, "__routes"))
    n_terms = F.size("__terms")
    count, primary = F.col("evidence.source_count"), F.col("evidence.primary_source_count")
    armed = touches(tokens, V.ARMED_THREAT) & ((F.size("__assets") > 0) | (F.size("__routes") > 0))
    settled, ongoing, pending = touches(tokens, V.RESOLUTION), touches(tokens, V.ACTIVE_STATUS), touches(tokens, V.DEVELOPING_STATUS)
    known = F.col("__age").isNotNull()
    lifecycle = (F.when(settled, "Recovering / resolved").when(known & (F.col("__age") > 30), "Historical / stale")
                  .when(ongoing | (known & (F.col("__age") <= 3)), "Active").when(pending, "Developing")
                  .when(known & (F.col("__age") <= 7), "Recently reported").otherwise("Status unconfirmed"))
    staged = staged.withColumns({
        "__place": (F.when(F.size("__assets") > 0, 55).otherwise(0) + F.when(F.size("__named") > 0, 25).otherwise(0)
                    + F.when(F.size("__where") > 0, 20).otherwise(0)),
        "__effect": F.when(n_terms > 0, F.least(F.lit(100), 25 + n_terms * 18)).when(armed, 35).otherwise(0),
        "__backing": (F.when((primary > 0) & (count >= 2), 100).when(primary > 0, 80).when(count >= 2, 70).otherwise(35)),
        "__life": lifecycle})
    staged = staged.withColumn("__time", F.when(F.col("__life") == "Recovering / resolved", 25).when(F.col("__life") == "Historical / stale", 10)
                               .when(F.col("__life") == "Active", F.when(~known | (F.col("__age") <= 1), 100).otherwise(85))
                               .when(F.col("__life") == "Developing", 70).when(F.col("__life") == "Recently reported", 65).otherwise(40))
    place, effect, backing, timing, dep = (F.col(c) for c in ("__place", "__effect", "__backing", "__time", "__dep"))
    generic = place * .3125 + effect * .375 + backing * .1875 + timing * .125
    specific = place * .25 + effect * .30 + dep * .20 + backing * .15 + timing * .10
    staged = staged.withColumn("__raw", half_even(F.when(dep.isNull(), generic).otherwise(specific)))
    staged = staged.withColumn("__gate", (place >= 50) & (effect >= 50) & (backing >= 70))
    staged = staged.withColumn("__score", F.when(F.col("__gate"), F.col("__raw")).otherwise(F.least(F.col("__raw"), F.lit(59))))
    missing = F.array_compact(F.array(F.when(place < 50, "identifiable asset, route or location"),
                                      F.when(effect < 50, "concrete operational consequence"),
                                      F.when(backing < 70, "official or independent confirmation")))
    result = F.struct(
        F.col("__score").alias("score"), F.col("__raw").alias("raw_score"), F.col("__gate").alias("gate_passed"),
        F.when((F.col("__score") >= 70) & F.col("__gate"), "Strong").when(F.col("__score") >= 45, "Moderate").otherwise("Weak").alias("strength"),
        F.when(dep.isNull(), "Generic operational connection").otherwise("Company-specific operational connection").alias("model"),
        place.cast("bigint").alias("asset_location"), effect.cast("bigint").alias("consequence"), dep.cast("bigint").alias("company_dependency"),
        backing.cast("bigint").alias("source_support"), timing.cast("bigint").alias("temporal_relevance"),
        F.when(F.size("__named") > 0, F.col("__named")).otherwise(F.col("__assets")).alias("assets"), F.col("__where").alias("locations"),
        F.col("__terms").alias("consequences"), F.col("__life").alias("lifecycle"), F.col("__age").alias("age_days"), missing.alias("missing_evidence"))
    helper = [c for c in staged.columns if c.startswith("__") and c not in df.columns]
    return staged.withColumn("connection", result).drop(*helper)


def semantic_bonus(coverage: Column, disruption: Column, transport: Column, severity: Column) -> Column:
    """Bounded uplift from corpus association; nothing below a quarter of vocabulary coverage."""
    part = lambda value, floor, factor: half_even(F.greatest(F.lit(0.0), value - floor) * factor)
    bonus = F.least(F.lit(12), part(disruption, .12, 18) + part(transport, .12, 10) + part(severity, .15, 8))
    return F.coalesce(F.when(coverage >= .25, bonus), F.lit(0)).cast("bigint")


def transport_mode(sea: Column, air: Column) -> Column:
    """Mode of a text that names maritime or aviation terms."""
    return F.when(sea & air, "Maritime and aviation").when(sea, "Maritime").when(air, "Aviation").otherwise("Multimodal / indirect")


def with_risk(df: DataFrame, as_of: Column, time="published_at") -> DataFrame:
    """Add the ``risk`` struct. Needs ``with_tokens``; uses ``semantic_bonus`` and ``exposure_index`` when present."""
    staged = df if "connection" in df.columns else with_connection(df, as_of, time)
    category = blank(F.col("category"))
    staged = staged.withColumn("__tokens", F.array_union("tokens", word_set(category))).withColumn("__low", F.lower(F.concat_ws(" ", "text", category)))
    t = F.col("__tokens")
    staged = staged.withColumns({
        "__sea": F.size(hits(t, V.MARITIME)), "__air": F.size(hits(t, V.AVIATION)), "__dis": F.size(hits(t, V.DISRUPTION)),
        "__crit": F.size(hits(t, V.CRITICAL)), "__terms": F.array_sort(hits(t, V.CONSEQUENCE)), "__armed": touches(t, V.ARMED_THREAT),
        "__routes": F.array_sort(F.array_compact(F.array(*[F.when(F.col("__low").contains(r), F.lit(r)) for r in V.STRATEGIC_ROUTES]))),
        "__bonus": F.col("semantic_bonus") if "semantic_bonus" in df.columns else F.lit(0).cast("bigint")})
    sea, air = F.col("__sea") > 0, F.col("__air") > 0
    sources, primary, weight = F.col("evidence.source_count"), F.col("evidence.primary_source_count"), F.col("evidence.evidence_weight")
    operational = F.size("__terms") > 0
    base = F.least(F.lit(100), 12 + F.col("__dis") * 10 + F.col("__crit") * 8 + F.least(F.lit(12), (F.col("__sea") + F.col("__air")) * 4))
    base = F.least(F.lit(100), base + F.col("__bonus"))
    base = F.when(category == "Infrastructure and supply chains", F.least(F.lit(100), base + 12)).otherwise(base)
    inferred = F.col("__armed") & (sea | air) & ((F.size("__routes") > 0) | touches(t, ["shipping", "ship", "vessel", "airspace", "airport"]))
    staged = staged.withColumns({"__base": base, "__inferred": inferred, "__corroborated": sources >= 2})
    inferred, corroborated = F.col("__inferred"), F.col("__corroborated")
    staged = staged.withColumns({
        "__provisional": ~operational & ~corroborated & (primary == 0) & ~inferred,
        "__severe": corroborated & F.col("__armed") & sea & air & (F.size("__terms") >= 2),
        "__impact": F.when(inferred & ~operational, F.greatest(F.lit(38), F.least(F.col("__base"), F.lit(69)))).otherwise(F.col("__base"))})
    staged = staged.withColumn("__impact", F.when(F.col("__severe"), F.greatest(F.col("__impact"), F.lit(78))).otherwise(F.col("__impact")))
    staged = staged.withColumn("__blend", half_even(F.col("__impact") * .70 + F.col("connection.score") * .30))
    capped = F.when(~F.col("connection.gate_passed") & (F.col("__blend") >= 70), 69).otherwise(F.col("__blend"))
    staged = staged.withColumn("__capped", F.when(F.col("__provisional"), F.least(capped, F.lit(37))).otherwise(capped))
    withheld = (F.col("__capped") >= 70) & ~corroborated & (primary == 0)
    staged = staged.withColumns({
        "__withheld": withheld, "__score": F.when(withheld, 69).otherwise(F.col("__capped")).cast("bigint"),
        "__conf": F.least(F.lit(95), half_even(42 + F.least(F.lit(30.0), weight * 7) + F.least(F.lit(18), F.col("__dis") * 4))),
        "__unc": F.greatest(F.lit(5), 18 - F.least(F.lit(10), half_even(weight * 2)))})
    basis = (F.when(F.col("__provisional"), "Unconfirmed indirect exposure")
              .when(F.col("__severe"), "Corroborated armed disruption affecting multiple transport modes")
              .when(inferred & ~operational, "Inferred armed-threat exposure to transport operations")
              .when(operational, "Confirmed operational consequence").otherwise(""))
    basis = F.when(F.col("__withheld"), F.concat(F.coalesce(F.nullif(basis, F.lit("")), F.lit("Reported operational disruption")),
                                                 F.lit("; Critical escalation withheld pending independent corroboration"))).otherwise(basis)
    effects = F.array_compact(F.array(
        F.when(sea, V.EFFECT_MARITIME), F.when(air, V.EFFECT_AVIATION), F.when(F.array_contains(t, "sanction"), V.EFFECT_SANCTION),
        F.when(touches(t, V.EFFECT_HAZARD_TERMS), V.EFFECT_HAZARD), F.when(touches(t, V.EFFECT_SECURITY_TERMS), V.EFFECT_SECURITY)))
    result = F.struct(
        F.col("__score").alias("score"), risk_band(F.col("__score")).alias("level"),
        transport_mode(sea, air).alias("mode"),
        F.col("__conf").cast("bigint").alias("confidence"), F.greatest(F.lit(0), F.col("__conf") - F.col("__unc")).cast("bigint").alias("confidence_low"),
        F.least(F.lit(100), F.col("__conf") + F.col("__unc")).cast("bigint").alias("confidence_high"),
        F.when(F.size(effects) > 0, effects).otherwise(F.array(F.lit(V.EFFECT_NONE))).alias("effects"),
        sources.alias("source_count"), primary.alias("primary_source_count"), F.col("__provisional").alias("provisional"),
        F.col("__terms").alias("operational_terms"), basis.alias("exposure_basis"), F.col("__routes").alias("strategic_routes"),
        inferred.alias("inferred_route_exposure"), F.col("__bonus").cast("bigint").alias("semantic_bonus"))
    helper = [c for c in staged.columns if c.startswith("__") and c not in df.columns]
    return stage(staged.withColumn("risk", result).drop(*helper), "risk")


def decision_relevant(tokens="tokens", lowered="lowered") -> Column:
    """Whether a scored story belongs on the decision surface."""
    risk = F.col("risk")
    evidence = (F.size(risk["operational_terms"]) > 0) | risk["inferred_route_exposure"] | (risk["primary_source_count"] >= 1)
    hazard = touches(F.col(tokens), V.DECISION_HAZARDS) & (risk["source_count"] >= 2) & ~contains_any(F.col(lowered), V.METAPHORICAL_HAZARDS)
    return risk["level"].isin("Moderate", "Critical") | evidence | hazard


def historical_brief(stories: DataFrame, limit: int, minimum=22) -> DataFrame:
    """Newest stored stories with a risk of at least ``minimum`` per country."""
    from riskfabric.operators.store import top_per_key
    return top_per_key(stories.filter(F.col("risk.score") >= minimum), ["country"], [F.desc("published_at"), F.desc("url")], limit)
