"""Queries on the semantic model, evaluation and forecast."""

import uuid

from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.operators import evaluate, forecast, scoring, semantic
from riskfabric.plans import bindings as B
from riskfabric.plans.catalog import VIEWS, check, sql_hits, sql_tokens, table, text_list
from riskfabric.plans.checks_scoring import relevant_articles, risky
from riskfabric.plans.checks_text import NEUTRAL_NEGATIVE, NEUTRAL_POSITIVE
from riskfabric.functions import text, tone

SEEDS = {"disruption": ["the", "and", "of"], "severity": ["with", "that"], "transport": ["for", "this", "unknownword"]}
AS_OF = B.AS_OF_SQL

VIEWS["h_words"] = f"SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS idx FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)"
VIEWS["h_vocab"] = "SELECT word, CAST(count(*) AS BIGINT) AS frequency FROM h_words GROUP BY word HAVING count(*) >= 2"
VIEWS["h_kept"] = "SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM h_words WHERE word IN (SELECT word FROM h_vocab)"
VIEWS["h_cooc"] = """
SELECT a.word, b.word AS context, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, word, pos, unnest([-4, -3, -2, -1, 1, 2, 3, 4]) AS d FROM h_kept) a JOIN h_kept b ON b.doc_id = a.doc_id AND b.pos = a.pos + a.d GROUP BY ALL"""
VIEWS["h_totals"] = "SELECT word, sum(n)::DOUBLE AS t FROM h_cooc GROUP BY word"
VIEWS["h_ppmi"] = """
SELECT c.word, c.context, ln(c.n * (SELECT sum(n)::DOUBLE FROM h_cooc) / (r.t * k.t)) AS pmi FROM h_cooc c JOIN h_totals r ON r.word = c.word JOIN h_totals k ON k.word = c.context
WHERE ln(c.n * (SELECT sum(n)::DOUBLE FROM h_cooc) / (r.t * k.t)) > 0"""
_SEED_ROWS = "(VALUES " + ", ".join(f"('{g}', '{w}')" for g, ws in SEEDS.items() for w in ws) + ") s(prototype, word)"
VIEWS["h_proto"] = f"""
SELECT prototype, context, sum(pmi) / (SELECT count(DISTINCT p2.word) FROM h_ppmi p2 JOIN {_SEED_ROWS.replace(' s(', ' s2(')} ON s2.word = p2.word WHERE s2.prototype = x.prototype) AS value FROM (
  SELECT s.prototype, p.context, p.pmi FROM h_ppmi p JOIN {_SEED_ROWS} ON s.word = p.word) x GROUP BY prototype, context"""


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


@check("ppmi_vocabulary", "SELECT word, frequency FROM h_vocab")
def ppmi_vocabulary(spark, folder):
    return semantic.vocabulary(semantic.tokenised(docs(spark, folder)))


@check("ppmi_cooccurrence", "SELECT word, context, n FROM h_cooc")
def ppmi_cooccurrence(spark, folder):
    t = semantic.tokenised(docs(spark, folder))
    return semantic.cooccurrence(semantic.in_vocabulary(t, semantic.vocabulary(t)))


@check("ppmi_vectors", "SELECT word, context, round(pmi, 6) AS pmi FROM h_ppmi WHERE pmi > 1e-9")
def ppmi_vectors(spark, folder):
    return semantic.train(docs(spark, folder)).filter(F.col("pmi") > 1e-9).withColumn("pmi", F.round("pmi", 6))


@check("ppmi_prototypes", "SELECT prototype, context, round(value, 6) AS value FROM h_proto")
def ppmi_prototypes(spark, folder):
    return semantic.prototypes(semantic.train(docs(spark, folder)), SEEDS).withColumn("value", F.round("value", 6))


SCORES_SQL = """
WITH tf AS (SELECT doc_id, word, count(*) AS n FROM h_words GROUP BY ALL), known AS (SELECT * FROM tf WHERE word IN (SELECT word FROM h_ppmi)),
sz AS (SELECT doc_id, sum(n)::DOUBLE AS size FROM known GROUP BY 1),
dv AS (SELECT k.doc_id, p.context, sum(k.n * p.pmi) / max(sz.size) AS v FROM known k JOIN h_ppmi p USING (word) JOIN sz USING (doc_id) GROUP BY ALL),
nd AS (SELECT doc_id, sqrt(sum(v * v)) AS nrm FROM dv GROUP BY 1), np AS (SELECT prototype, sqrt(sum(value * value)) AS nrm FROM h_proto GROUP BY 1),
dots AS (SELECT doc_id, prototype, sum(v * value) AS d FROM dv JOIN h_proto USING (context) GROUP BY ALL),
cs AS (SELECT doc_id, prototype, round(d / (nd.nrm * np.nrm), 4) AS c FROM dots JOIN nd USING (doc_id) JOIN np USING (prototype)),
cov AS (SELECT doc_id, round(count(*) FILTER (WHERE word IN (SELECT word FROM h_ppmi)) / count(*)::DOUBLE, 4) AS coverage FROM tf GROUP BY 1)
SELECT d.doc_id, coalesce(cov.coverage, 0.0) AS coverage, coalesce(max(c) FILTER (WHERE prototype = 'disruption'), 0.0) AS disruption, coalesce(max(c) FILTER (WHERE prototype = 'severity'), 0.0) AS severity,
  coalesce(max(c) FILTER (WHERE prototype = 'transport'), 0.0) AS transport FROM documents d LEFT JOIN cov USING (doc_id) LEFT JOIN cs USING (doc_id) WHERE d.text <> '' GROUP BY d.doc_id, cov.coverage"""


@check("ppmi_document_scores", SCORES_SQL)
def ppmi_document_scores(spark, folder):
    from riskfabric.session import kept
    model = kept(semantic.train(docs(spark, folder)), "model")  # the model table is read by several branches
    return semantic.document_scores(docs(spark, folder), model, semantic.prototypes(model, SEEDS), SEEDS)


@check("ppmi_trained", "SELECT CAST(count(*) FILTER (WHERE text <> '') AS BIGINT) AS documents, count(*) FILTER (WHERE text <> '') >= 20 AND (SELECT count(DISTINCT prototype) FROM h_proto) = 3 AS trained FROM documents")
def ppmi_trained(spark, folder):
    d = docs(spark, folder)
    return semantic.trained(d, semantic.prototypes(semantic.train(d), SEEDS), SEEDS)


@check("risk_corpus_bonus", f"""
SELECT doc_id, CAST(CASE WHEN coverage >= 0.25 THEN least(12, round_even(greatest(0.0, disruption - 0.12::DOUBLE) * 18, 0) + round_even(greatest(0.0, transport - 0.12::DOUBLE) * 10, 0)
  + round_even(greatest(0.0, severity - 0.15::DOUBLE) * 8, 0)) ELSE 0 END AS BIGINT) AS bonus FROM ({SCORES_SQL})""")
def risk_corpus_bonus(spark, folder):
    """The bonus from the scores of a model trained on the documents themselves."""
    scores = ppmi_document_scores(spark, folder)
    return scores.select("doc_id", scoring.semantic_bonus(F.col("coverage"), F.col("disruption"), F.col("transport"), F.col("severity")).alias("bonus"))


@check("risk_semantic_bonus", """
SELECT event_id, CAST(CASE WHEN cov >= 0.25 THEN least(12, round_even(greatest(0.0, d - 0.12::DOUBLE) * 18, 0) + round_even(greatest(0.0, t - 0.12::DOUBLE) * 10, 0) + round_even(greatest(0.0, s - 0.15::DOUBLE) * 8, 0)) ELSE 0 END AS BIGINT) AS bonus
FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS cov, (event_id * 7 % 97) / 100.0::DOUBLE AS d, (event_id * 11 % 89) / 100.0::DOUBLE AS t, (event_id * 13 % 83) / 100.0::DOUBLE AS s FROM events)""")
def risk_semantic_bonus(spark, folder):
    k = F.col("event_id")
    part = lambda a, m: (k * a % m) / 100.0
    return table(spark, folder, "events").select("event_id", scoring.semantic_bonus(part(1, 101), part(7, 97), part(11, 89), part(13, 83)).alias("bonus"))


@check("tfidf_conversations", f"""
WITH t AS (SELECT conv_id * 100 + turn AS doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'), lambda w: NOT list_contains({text_list(V.RANKING_STOPWORDS)}, w)) AS terms FROM conversations),
c AS (SELECT doc_id, term, count(*) AS tf, max(size) AS size FROM (SELECT doc_id, len(terms) AS size, unnest(terms) AS term FROM t) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT doc_id, term, round(tf / size::DOUBLE * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)::DOUBLE) + 1), 9) AS weight FROM c JOIN f USING (term)""")
def tfidf_conversations(spark, folder):
    t = table(spark, folder, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), text.ranking_words(F.col("text")).alias("terms"))
    return semantic.tfidf(t).withColumn("weight", F.round("weight", 9))


# ------------------------------------------------------------------ evaluation
VIEWS["e_rows"] = "SELECT l.doc_id, quality, toxic, (n_chars % 101) / 100.0::DOUBLE AS score, CASE WHEN n_chars % 101 >= 45 THEN 1 ELSE 0 END AS qp, CASE WHEN n_chars % 7 < 2 THEN 1 ELSE 0 END AS tp_ FROM labels l JOIN documents USING (doc_id)"


def eval_rows(spark, folder):
    n = F.col("n_chars")
    return table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select(
        "doc_id", F.col("quality").alias("quality_label"), F.col("toxic").alias("toxic_label"), ((n % 101) / 100.0).alias("score"),
        F.when(n % 101 >= 45, 1).otherwise(0).alias("quality_prediction"), F.when(n % 7 < 2, 1).otherwise(0).alias("toxic_prediction"))


def metric_sql(source, by=""):
    return f"""SELECT {by} tp, fp, tn, fn, round(accuracy, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (
 SELECT *, (tp + tn) / greatest(1, tp + fp + tn + fn)::DOUBLE AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM ({source}))"""


def counts_sql(e, p, source, by=""):
    group = f"GROUP BY {by.rstrip(',')}" if by else ""
    c = lambda cond: f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"
    return f"SELECT {by} {c(f'{e} = 1 AND {p} = 1')} AS tp, {c(f'{e} <> 1 AND {p} = 1')} AS fp, {c(f'{e} <> 1 AND {p} <> 1')} AS tn, {c(f'{e} = 1 AND {p} <> 1')} AS fn FROM {source} {group}"


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@check("eval_binary_metrics", metric_sql(counts_sql("quality", "qp", "e_rows")))
def eval_binary_metrics(spark, folder):
    return rounded(evaluate.binary_metrics(eval_rows(spark, folder), "quality_label", "quality_prediction"))


VIEWS["e_stacked"] = "SELECT 'quality' AS label, quality AS e, qp AS p FROM e_rows UNION ALL SELECT 'toxic', toxic, tp_ FROM e_rows"


@check("eval_multilabel_summary", "SELECT m.*, round((SELECT avg(f1) FROM (" + metric_sql(counts_sql("e", "p", "e_stacked", "label,"), "label,") + ")), 6) AS macro_f1, round((SELECT count(*) FILTER (WHERE quality = qp AND toxic = tp_) / count(*)::DOUBLE FROM e_rows), 9) AS exact_match FROM (" + metric_sql(counts_sql("e", "p", "e_stacked")) + ") m")
def eval_multilabel_summary(spark, folder):
    return rounded(evaluate.multilabel_summary(eval_rows(spark, folder), ["quality", "toxic"])).withColumn("macro_f1", F.round("macro_f1", 6))


VIEWS["e_sweep"] = metric_sql("SELECT threshold, CAST(count(*) FILTER (WHERE quality = 1 AND score >= threshold) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE quality <> 1 AND score >= threshold) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE quality <> 1 AND score < threshold) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE quality = 1 AND score < threshold) AS BIGINT) AS fn FROM e_rows, (SELECT unnest(range(0, 61)) / 100.0::DOUBLE AS threshold) GROUP BY threshold", "threshold,")


@check("eval_threshold_sweep", "SELECT * FROM e_sweep")
def eval_threshold_sweep(spark, folder):
    return rounded(evaluate.threshold_sweep(eval_rows(spark, folder), [i / 100 for i in range(61)], expected="quality_label"))


@check("eval_csv_round_trip", "SELECT source AS country, text, CASE WHEN n_chars % 2 = 0 THEN 'Positive' ELSE 'Negative' END AS label FROM documents")
def eval_csv_round_trip(spark, folder):
    """A benchmark written as CSV files and scanned again."""
    from riskfabric.session import checkpoint_dir
    from riskfabric.sources import landed
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    d = table(spark, folder, "documents")
    landed.write_results(d.select(F.col("source").alias("country"), "text", F.when(F.col("n_chars") % 2 == 0, "Positive").otherwise("Negative").alias("label")), path)
    return landed.benchmark_rows(spark, path)


@check("eval_best_threshold", "SELECT * FROM e_sweep ORDER BY f1 DESC, accuracy DESC, precision DESC, threshold DESC LIMIT 1")
def eval_best_threshold(spark, folder):
    return rounded(evaluate.best_threshold(evaluate.threshold_sweep(eval_rows(spark, folder), [i / 100 for i in range(61)], expected="quality_label")))


@check("eval_three_class_report", f"""
WITH x AS (SELECT CASE n_chars % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' ELSE 'Neutral' END AS e, CASE WHEN s >= 25 THEN 'Positive' WHEN s <= -25 THEN 'Negative' ELSE 'Neutral' END AS p FROM (
  SELECT n_chars, round_even((p - n) / greatest(1, p + n) * 100, 0) AS s FROM (SELECT n_chars, {sql_hits(sql_tokens('text'), NEUTRAL_POSITIVE)} AS p, {sql_hits(sql_tokens('text'), NEUTRAL_NEGATIVE)} AS n FROM documents))),
c AS (SELECT label, count(*) FILTER (WHERE e = label AND p = label) AS tp, count(*) FILTER (WHERE p = label) AS called, count(*) FILTER (WHERE e = label) AS support FROM x, (VALUES ('Positive'), ('Negative'), ('Neutral')) l(label) GROUP BY label),
m AS (SELECT label, CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS r, CAST(support AS BIGINT) AS support FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, support, round((SELECT count(*) FILTER (WHERE e = p) / count(*)::DOUBLE FROM x), 9) AS accuracy, round((SELECT avg(f1) FROM f), 9) AS macro_f1 FROM f""")
def eval_three_class_report(spark, folder):
    n = F.col("n_chars")
    d = table(spark, folder, "documents").select(
        F.when(n % 3 == 0, "Positive").when(n % 3 == 1, "Negative").otherwise("Neutral").alias("expected"),
        tone.tone(F.col("text"), list(NEUTRAL_POSITIVE), list(NEUTRAL_NEGATIVE))["label"].alias("predicted"))
    return rounded(evaluate.multiclass_report(d, labels=["Positive", "Negative", "Neutral"]))


@check("eval_relevance_sweep", metric_sql("SELECT threshold, CAST(count(*) FILTER (WHERE e AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT e AND p) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE NOT e AND NOT p) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE e AND NOT p) AS BIGINT) AS fn FROM (SELECT threshold, coverage_scope <> 'International' AS e, gates AND rel_score >= threshold AS p FROM f_rel, (SELECT unnest(range(45, 91, 5))::DOUBLE AS threshold)) GROUP BY threshold", "threshold,"))
def eval_relevance_sweep(spark, folder):
    r = relevant_articles(spark, folder).select(F.when(F.col("coverage_scope") != "International", 1).otherwise(0).alias("expected"),
                                                F.col("relevance.score").alias("score"), F.col("relevance.evidence_gates").alias("gates"))
    return rounded(evaluate.threshold_sweep(r, range(45, 91, 5), gate=F.col("gates")))


# ------------------------------------------------------------------ forecast
VIEWS["i_rows"] = "SELECT country, url, article_id, published_at, score, confidence, source_count, primary_source_count, effects0, epoch_us(published_at) AS t, min(epoch_us(published_at)) OVER (PARTITION BY country) AS t0, max(epoch_us(published_at)) OVER (PARTITION BY country) AS t1 FROM f_risk"
VIEWS["i_line"] = """
SELECT country, CASE WHEN n < 2 THEN 0.0 ELSE least(5.0, greatest(-5.0, slope)) END AS slope, CASE WHEN n < 2 THEN 18.0 ELSE sqrt(greatest(0.0, yy - 2 * slope * xy + slope * slope * xx) / sw) END AS rmse, n FROM (
 SELECT *, CASE WHEN xx <> 0 THEN xy / xx ELSE 0 END AS slope FROM (
  SELECT country, count(*) AS n, max(sw) AS sw, sum(w * (x - mx) * (x - mx)) AS xx, sum(w * (x - mx) * (y - my)) AS xy, sum(w * (y - my) * (y - my)) AS yy FROM (
   SELECT *, sum(w) OVER (PARTITION BY country) AS sw, sum(w * x) OVER (PARTITION BY country) / sum(w) OVER (PARTITION BY country) AS mx, sum(w * y) OVER (PARTITION BY country) / sum(w) OVER (PARTITION BY country) AS my FROM (
    SELECT country, (t - t0) / 86400000000.0::DOUBLE AS x, score::DOUBLE AS y, exp(-ln(2.0::DOUBLE) * ((t1 - t) / 86400000000.0::DOUBLE) / 7) AS w FROM i_rows)) GROUP BY country))"""


def scored_events(spark, folder):
    return risky(spark, folder).select("country", "url", "article_id", F.col("published_at").alias("observed"), "risk")


@check("forecast_regression", "SELECT country, CAST(n AS BIGINT) AS points, round(slope, 4) AS slope, round(rmse, 4) AS rmse FROM i_line")
def forecast_regression(spark, folder):
    line = forecast.weighted_regression(scored_events(spark, folder).select("country", "observed", F.col("risk.score").alias("score")))
    return line.select("country", "points", F.round("slope", 4).alias("slope"), F.round("rmse", 4).alias("rmse"))


@check("forecast_projection", """
WITH f AS (SELECT country, count(*) AS ev, count(*) FILTER (WHERE source_count >= 2 OR primary_source_count >= 1) AS co, avg(confidence) AS mc, max_by(score, (published_at, url)) AS latest FROM i_rows GROUP BY country),
j AS (SELECT l.*, f.* EXCLUDE country, coalesce(nullif(x.exposure_index, 0), latest)::DOUBLE AS baseline FROM i_line l JOIN f USING (country) LEFT JOIN f_exposure x USING (country)),
u AS (SELECT *, CAST(round_even(greatest(20.0, least(82.0, 0.55::DOUBLE * mc + least(18, ev * 3) + least(12, co * 3) - least(15.0, rmse / 2))), 0) AS BIGINT) AS confidence, round_even(greatest(8.0, least(30.0, 8 + rmse + 12 / sqrt(ev::DOUBLE))), 0) AS unc FROM j),
p AS (SELECT *, CAST(round_even(greatest(0.0, least(100.0, baseline + slope * days)), 0) AS BIGINT) AS score, CAST(least(35, round_even(unc * sqrt(days / 3.0::DOUBLE), 0)) AS BIGINT) AS spread FROM u, (VALUES (3), (7)) h(days))
SELECT country, days, CASE WHEN slope >= 1.5 THEN 'Escalating' WHEN slope <= -1.5 THEN 'Easing' ELSE 'Broadly stable' END AS direction, confidence, CAST(ev AS BIGINT) AS evidence_count, CAST(co AS BIGINT) AS corroborated_count, score,
 CASE WHEN score >= 70 THEN 'Critical' WHEN score >= 38 THEN 'Moderate' ELSE 'Low' END AS level, greatest(0, score - spread) AS low, least(100, score + spread) AS high FROM p""")
def forecast_projection(spark, folder):
    from riskfabric.plans.checks_scoring import exposures
    return forecast.project(scored_events(spark, folder), exposures(spark, folder).withColumnRenamed("exposure_index", "score")).drop("slope", "rmse")


@check("forecast_drivers", "SELECT country, article_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY score DESC, published_at DESC, url DESC) AS rank FROM i_rows) WHERE rank <= 3")
def forecast_drivers(spark, folder):
    return forecast.drivers(scored_events(spark, folder)).select("country", "article_id", F.col("risk.score").alias("score"), "rank")


@check("forecast_scenarios", "SELECT * FROM (SELECT country, outcome, CAST(count(*) AS BIGINT) AS supporting_events, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, outcome) AS rank FROM (SELECT country, unnest(effects0) AS outcome FROM i_rows) GROUP BY country, outcome) WHERE rank <= 4")
def forecast_scenarios(spark, folder):
    return forecast.scenarios(scored_events(spark, folder))
