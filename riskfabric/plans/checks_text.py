"""Queries on text, identity, time and decoding expressions."""

from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions import feeds, places, provenance, scoring, text, times, tone
from riskfabric.operators import taxonomy
from riskfabric.plans import bindings as B
from riskfabric.plans.catalog import VIEWS, check, sql_any, sql_case, sql_hits, sql_tokens, table, text_list, text_rows

# words that occur in the driver documents, used where the domain vocabulary does not occur
NEUTRAL_POSITIVE = {"the": 2, "and": 1, "that": 3, "with": 2}
NEUTRAL_NEGATIVE = {"of": 2, "to": 1, "in": 3, "is": 2}
NEUTRAL_NEGATIONS = ["no", "die", "le"]
NEUTRAL_TAXONOMY = {"Alpha": ["the", "and", "that"], "Beta": ["with", "of", "to"], "Gamma": ["in", "is", "no"], "Delta": ["la", "el", "que"], "Epsilon": ["der", "die", "und"]}
NEUTRAL_PHRASES = {"Alpha": ["and the"], "Beta": ["of the", "to the"], "Gamma": ["in the"], "Delta": ["la el"], "Epsilon": ["und die"]}

SUFFIX_SQL = r"trim(regexp_replace({h}, '\s+[\-–—]\s+[^\-–—]{{2,80}}$', ''))"


def key_words_sql(h):
    return (f"list_filter(regexp_extract_all(lower({SUFFIX_SQL.format(h=h)}), '[a-z0-9]+'), "
            f"lambda w: NOT list_contains({text_list(V.STORY_STOPWORDS)}, w))")


@check("text_tokens", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS words, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_words,
  md5(array_to_string(t, ' ')) AS word_digest, md5(array_to_string(list_sort(list_distinct(t)), ' ')) AS set_digest
FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)""")
def text_tokens(spark, folder):
    t = F.col("t")
    return (table(spark, folder, "documents").select("doc_id", text.words(F.col("text")).alias("t"))
            .select("doc_id", F.size(t).cast("bigint").alias("words"), F.size(F.array_distinct(t)).cast("bigint").alias("distinct_words"),
                    F.md5(F.array_join(t, " ")).alias("word_digest"),
                    F.md5(F.array_join(F.array_sort(F.array_distinct(t)), " ")).alias("set_digest")))


@check("text_ranking_tokens", f"""
SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'),
  lambda w: NOT list_contains({text_list(V.RANKING_STOPWORDS)}, w)), ' ') AS terms FROM conversations""")
def text_ranking_tokens(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(text.ranking_words(F.col("text")), " ").alias("terms"))


@check("text_story_key", f"""
SELECT article_id, {SUFFIX_SQL.format(h='headline')} AS bare, array_to_string({key_words_sql('headline')}, ' ') AS story_key FROM b_articles""")
def text_story_key(spark, folder):
    return B.articles(spark, folder).select("article_id", text.strip_publisher(F.col("headline")).alias("bare"),
                                            text.story_key(F.col("headline")).alias("story_key"))


@check("text_story_key_documents", f"""SELECT doc_id, md5(array_to_string({key_words_sql('text')}, ' ')) AS key_digest FROM documents""")
def text_story_key_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(text.story_key(F.col("text"))).alias("key_digest"))


_NUM = r"list_sort(list_distinct(regexp_extract_all({x}, '\b\d+\b')))"


@check("text_fact_variance", f"""
SELECT page_id, CASE WHEN len(a) > 0 AND len(b) > 0 AND a <> b THEN
  'Numeric details differ (' || array_to_string(a, ', ') || ' vs ' || array_to_string(b, ', ') || ')' ELSE '' END AS variance
FROM (SELECT page_id, {_NUM.format(x='url')} AS a, {_NUM.format(x='html')} AS b FROM pages)""")
def text_fact_variance(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.fact_variance(F.col("url"), F.col("html")).alias("variance"))


def _labels_sql(lowered, markers):
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_any(lowered, m)} THEN '{k}' END" for k, m in markers.items()) + "], lambda x: x IS NOT NULL)"


VIEWS["t_context"] = f"""
SELECT article_id, {_labels_sql('l', V.ROUTE_MARKERS)} AS routes, {_labels_sql('l', V.MODE_MARKERS)} AS modes,
  len(list_intersect(list_distinct(regexp_extract_all(l, '[a-z]+')), {text_list(V.OPERATIONAL_TERMS)})) AS terms,
  list_filter(list_transform(regexp_extract_all(headline, '\\b(?:[A-Z][\\wüÜ’-]+(?:\\s+|$)){{1,4}}'), lambda x: trim(x)),
    lambda n: length(n) > 2 AND NOT list_contains(['the', 'a', 'an'], lower(n))) AS names
FROM (SELECT article_id, headline, lower(headline || ' ' || summary) AS l FROM b_articles)"""


@check("text_entity_context", """
SELECT article_id, array_to_string(routes, ',') AS routes,
  CASE WHEN len(modes) > 0 THEN array_to_string(modes, ',') ELSE 'Multimodal / indirect' END AS modes,
  CAST(least(100, 15 + terms * 14 + len(modes) * 10 + len(routes) * 15) AS BIGINT) AS relevance FROM t_context""")
def text_entity_context(spark, folder):
    c = F.col("c")
    return (B.articles(spark, folder).select("article_id", text.entity_context(F.col("headline"), F.col("summary")).alias("c"))
            .select("article_id", F.array_join(c["routes"], ",").alias("routes"), F.array_join(c["transport_modes"], ",").alias("modes"),
                    c["operational_relevance"].alias("relevance")))


@check("text_entities", f"""
WITH names AS (SELECT article_id, headline, list_filter(list_transform(
    regexp_extract_all(regexp_replace(headline, 'ü', 'u', 'g'), '\\b(?:[A-Z][\\w’-]+(?:\\s+|$)){{1,4}}'), lambda x: trim(x)),
    lambda n: length(n) > 2) AS found, lower(headline) AS l FROM b_articles)
SELECT article_id, array_to_string(list_concat(list_filter(found, lambda x, i: list_position(found, x) = i),
   list_filter({_labels_sql('l', V.ROUTE_MARKERS)}, lambda r: NOT list_contains(found, r)))[1:12], '|') AS entities FROM names""")
def text_entities(spark, folder):
    plain = F.replace(F.col("headline"), F.lit("ü"), F.lit("u"))  # ASCII input keeps both regex dialects comparable
    return B.articles(spark, folder).select("article_id", F.array_join(text.entity_context(plain)["entities"], "|").alias("entities"))


@check("tone_documents", f"""
SELECT doc_id, p AS positive_hits, n AS negative_hits, s AS score, CASE WHEN s >= 25 THEN 'Positive' WHEN s <= -25 THEN 'Negative' ELSE 'Neutral' END AS label
FROM (SELECT *, CAST(round_even((p - n) / greatest(1, p + n) * 100, 0) AS BIGINT) AS s FROM (
  SELECT doc_id, {sql_hits(sql_tokens('text'), NEUTRAL_POSITIVE)} AS p, {sql_hits(sql_tokens('text'), list(NEUTRAL_NEGATIVE) + ['no'])} AS n FROM documents))""")
def tone_documents(spark, folder):
    t = F.col("t")
    return (table(spark, folder, "documents")
            .select("doc_id", tone.tone(F.col("text"), list(NEUTRAL_POSITIVE), list(NEUTRAL_NEGATIVE) + ["no"]).alias("t")).select("doc_id", "t.*"))


@check("tone_headlines", f"""
SELECT article_id, p AS positive_hits, n AS negative_hits, s AS score, CASE WHEN s >= 25 THEN 'Positive' WHEN s <= -25 THEN 'Negative' ELSE 'Neutral' END AS label
FROM (SELECT *, CAST(round_even((p - n) / greatest(1, p + n) * 100, 0) AS BIGINT) AS s FROM (
  SELECT article_id, {sql_hits(sql_tokens('headline'), V.POSITIVE_TONE)} AS p, {sql_hits(sql_tokens('headline'), V.NEGATIVE_TONE)} AS n FROM b_articles))""")
def tone_headlines(spark, folder):
    return B.articles(spark, folder).select("article_id", tone.tone(F.col("headline")).alias("t")).select("article_id", "t.*")


def _alias_test_sql(text_expr, country):
    loose, exact = [], []
    import re
    for alias in V.COUNTRY_ALIASES.get(country, [country]):
        letters = re.sub("[^A-Za-z]", "", alias)
        quoted = re.sub(r"([.'-])", lambda m: "''" if m.group(1) == "'" else "\\" + m.group(1), alias)
        if len(letters) <= 3:
            exact.append(r"\.?".join(letters) + r"\.?")
        elif alias in V.CASE_SENSITIVE_ALIASES:
            exact.append(quoted)
        else:
            loose.append(quoted.lower())
    tests = []
    if loose:
        tests.append(f"regexp_matches(lower({text_expr}), '(^|[^a-z])(?:{'|'.join(loose)})([^a-z]|$)')")
    if exact:
        tests.append(f"regexp_matches({text_expr}, '(^|[^A-Za-z])(?:{'|'.join(exact)})([^A-Za-z]|$)')")
    return "(" + " OR ".join(tests) + ")"


def mention_case_sql(text_expr, country_expr):
    """CASE over the bound countries, one literal pattern each."""
    return f"CASE {country_expr} " + " ".join(
        f"WHEN '{c}' THEN {_alias_test_sql(text_expr, c)}" for c in B.COUNTRIES) + " ELSE FALSE END"


@check("text_country_mention", f"""
SELECT a.article_id, n.country, {mention_case_sql('a.headline', 'n.country')} AS mentioned FROM b_articles a
JOIN b_country n ON n.n_nationkey IN (a.article_id % 25, (a.article_id + 1) % 25)""")
def text_country_mention(spark, folder):
    a = B.articles(spark, folder).select("article_id", "headline", F.explode(F.array(F.col("article_id") % 25, (F.col("article_id") + 1) % 25)).alias("k"))
    n = F.broadcast(B.country(spark, folder).select("n_nationkey", "country"))  # 25 rows by definition
    return (a.join(n, F.col("k") == F.col("n_nationkey"))
             .select("article_id", "country", places.country_mentioned(F.col("headline"), F.col("country")).alias("mentioned")))


_W = {**NEUTRAL_POSITIVE, **{w: -v for w, v in NEUTRAL_NEGATIVE.items()}}


@check("tone_country_sentiment", f"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\s+[–—]\\s+', chr(1), 'g'), chr(1)),
    lambda x: trim(x) <> '') AS sentences FROM documents),
a AS (SELECT doc_id, sentences, list_filter(sentences, lambda x: regexp_matches(lower(x), '(^|[^a-z])the([^a-z]|$)')) AS aimed FROM s),
w AS (SELECT doc_id, len(aimed) > 0 AS target_explicit, {sql_tokens("array_to_string(CASE WHEN len(aimed) > 0 THEN aimed ELSE sentences END, ' ')")} AS w FROM a),
r AS (SELECT doc_id, target_explicit, coalesce(list_sum(list_transform(w, lambda x, i:
   ({sql_case('x', _W, '0')}) * CASE WHEN len(list_intersect(w[greatest(i - 3, 1):i - 1], {text_list(NEUTRAL_NEGATIONS)})) > 0 THEN -1 ELSE 1 END)), 0) AS raw FROM w),
f AS (SELECT doc_id, target_explicit, CAST(round_even(100 * raw / (abs(raw) + 3), 0) AS BIGINT) AS score FROM r)
SELECT doc_id, target_explicit, score, CASE WHEN score >= 15 THEN 'Positive' WHEN score <= -15 THEN 'Negative' ELSE 'Neutral' END AS label FROM f""")
def tone_country_sentiment(spark, folder):
    s = tone.country_sentiment(F.col("text"), F.lit("the"), NEUTRAL_POSITIVE, NEUTRAL_NEGATIVE, NEUTRAL_NEGATIONS)
    return table(spark, folder, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.*")


_TAX_ROWS = "(VALUES " + ", ".join(f"('{k}', '{w}', {i})" for i, (k, ws) in enumerate(NEUTRAL_TAXONOMY.items()) for w in ws) + ") t(label, term, pos)"
_PHRASE_ROWS = "(VALUES " + ", ".join(f"('{k}', '{w}', {i})" for i, (k, ws) in enumerate(NEUTRAL_PHRASES.items()) for w in ws) + ") p(label, phrase, pos)"


@check("taxonomy_documents", f"""
WITH words AS (SELECT doc_id, 2 AS weight, unnest(list_distinct({sql_tokens("source || ' ' || lang || ' the la und'")})) AS term FROM documents
  UNION ALL SELECT doc_id, 1, unnest(list_distinct({sql_tokens('text')})) FROM documents),
points AS (SELECT doc_id, label, pos, sum(weight) AS s FROM words JOIN {_TAX_ROWS} USING (term) GROUP BY ALL
  UNION ALL SELECT doc_id, label, pos, 3 * count(*) FROM documents JOIN {_PHRASE_ROWS} ON contains(lower(source || ' ' || lang || ' the la und ' || text), phrase) GROUP BY ALL),
ranked AS (SELECT doc_id, label, CAST(sum(s) AS BIGINT) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY sum(s) DESC, pos) AS rn FROM points GROUP BY doc_id, label, pos HAVING sum(s) >= 2)
SELECT d.doc_id, coalesce(string_agg(label || '=' || score, '|' ORDER BY rn) FILTER (WHERE rn <= 3), 'General affairs=0') AS labels FROM documents d LEFT JOIN ranked USING (doc_id) GROUP BY d.doc_id""")
def taxonomy_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.concat_ws(" ", "source", "lang", F.lit("the la und")).alias("headline"), F.col("text").alias("summary"))
    c = taxonomy.classify(F.col("headline"), F.col("summary"), NEUTRAL_TAXONOMY, NEUTRAL_PHRASES)
    return docs.select("doc_id", F.array_join(F.transform(c, lambda x: F.concat(x["label"], F.lit("="), x["score"].cast("string"))), "|").alias("labels"))


@check("taxonomy_headlines", None)
def taxonomy_headlines(spark, folder):
    c = taxonomy.classify(F.col("headline"), F.col("summary"))
    return B.articles(spark, folder).select("article_id", F.explode(c).alias("c")).select(
        "article_id", "c.label", "c.score", F.array_join("c.evidence", ",").alias("evidence"))


@check("hazard_kinds", f"""SELECT id, array_to_string({_labels_sql("lower(title || ' ' || location)", V.HAZARD_MARKERS)}, ',') AS kinds FROM b_signals""")
def hazard_kinds(spark, folder):
    return B.signals(spark, folder).select("id", F.array_join(feeds.hazard_kinds(text.phrase(F.col("title"), F.col("location"))), ",").alias("kinds"))


VIEWS["t_links"] = """
SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN 'Reuters report' WHEN 1 THEN 'Daily ' || page_id || ' News!' WHEN 2 THEN 'AFP' WHEN 3 THEN '' WHEN 4 THEN 'The Hindu' ELSE 'Agence France-Presse - World' END AS publisher,
  CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN replace(url, 'example.com', 'example.co.uk') WHEN page_id % 4 = 2 THEN replace(replace(url, 'example.net', 'example.de'), 'example.org', 'example.tv') ELSE url END AS link FROM pages"""


def links(spark, folder):
    k, url = F.col("page_id"), F.col("url")
    rep = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    return table(spark, folder, "pages").select(
        k, url,
        F.when(k % 6 == 0, "Reuters report").when(k % 6 == 1, F.concat(F.lit("Daily "), k.cast("string"), F.lit(" News!"))).when(k % 6 == 2, "AFP")
         .when(k % 6 == 3, "").when(k % 6 == 4, "The Hindu").otherwise("Agence France-Presse - World").alias("publisher"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, rep(url, "example.com", "example.co.uk"))
         .when(k % 4 == 2, rep(rep(url, "example.net", "example.de"), "example.org", "example.tv")).otherwise(url).alias("link"))


VIEWS["t_host"] = r"SELECT page_id, publisher, link, regexp_replace(lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS host FROM t_links"


@check("source_family", r"""
SELECT page_id, coalesce(CASE WHEN regexp_matches(lower(publisher), '\breuters\b') THEN 'reuters' WHEN regexp_matches(lower(publisher), '\bagence france-presse\b|\bafp\b') THEN 'afp' END,
  CASE WHEN host <> '' THEN CASE WHEN contains(host, '.') THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END END,
  regexp_replace(regexp_replace(lower(coalesce(nullif(publisher, ''), 'unknown')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS family FROM t_host""")
def source_family(spark, folder):
    return links(spark, folder).select("page_id", places.source_family(F.col("publisher"), F.col("link")).alias("family"))


@check("source_origin", r"""
SELECT page_id, coalesce(CASE WHEN contains(lower(publisher), 'reuters') THEN 'United Kingdom' WHEN contains(lower(publisher), 'afp') THEN 'France' WHEN contains(lower(publisher), 'the hindu') THEN 'India' END,
  CASE regexp_extract(host, '\.([^.]*)$', 1) WHEN 'uk' THEN 'United Kingdom' WHEN 'de' THEN 'Germany' END, 'Origin unverified') AS origin_country FROM t_host""")
def source_origin(spark, folder):
    df = places.with_source_origin(links(spark, folder), places.country_dimension(spark), url="link")
    return df.select("page_id", "origin_country")


@check("source_evidence", f"""
WITH s AS (SELECT article_id, unnest(sources) AS s FROM b_articles), f AS (
SELECT article_id, s.source_family AS fam, max(CASE WHEN s.source_type IN ('Port authority', 'Carrier advisory') THEN 1.5 ELSE 1.0 END) AS w FROM s GROUP BY ALL)
SELECT article_id, CAST(count(*) AS BIGINT) AS source_count, CAST(count(*) FILTER (WHERE w > 1) AS BIGINT) AS primary_source_count, CAST(sum(w) AS DOUBLE) AS evidence_weight FROM f GROUP BY article_id""")
def source_evidence(spark, folder):
    return B.articles(spark, folder).select("article_id", provenance.source_evidence(F.col("sources")).alias("e")).select("article_id", "e.*")


@check("hazard_evidence_status", """
WITH s AS (SELECT article_id, list_transform(sources, lambda s: {'fam': CASE WHEN s.source_family = 'family1' THEN 'GDACS' ELSE s.source_family END, 'idx': s.indexed_by}) AS src FROM b_articles),
c AS (SELECT article_id, len(list_filter(src, lambda s: s.fam = 'GDACS')) AS o, len(list_distinct(list_transform(list_filter(src, lambda s: s.fam <> 'GDACS'), lambda s: s.fam))) AS n,
  len(list_filter(src, lambda s: coalesce(s.idx, '') = 'GDELT')) > 0 AS indexed FROM s)
SELECT article_id, CASE WHEN o > 0 AND n > 0 THEN 'OFFICIALLY DETECTED + NEWS CORROBORATED' WHEN o > 0 THEN 'OFFICIAL HAZARD DETECTION'
  WHEN n >= 2 THEN 'MULTI-SOURCE NEWS CORROBORATION' ELSE 'UNCONFIRMED HAZARD REPORT' END AS status, CAST(n AS BIGINT) AS news_families, indexed FROM c""")
def hazard_evidence_status(spark, folder):
    swapped = F.transform("sources", lambda s: s.withField("source_family", F.when(s["source_family"] == "family1", "GDACS").otherwise(s["source_family"])))
    return B.articles(spark, folder).select("article_id", provenance.hazard_status(swapped).alias("h")).select("article_id", "h.*")


@check("text_article_summary", """
WITH c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM pages)
SELECT page_id, CASE WHEN length(clean) > 80 THEN regexp_replace(clean[1:360], ' [^ ]*$', '') || CASE WHEN length(clean) > 360 THEN '…' ELSE '' END
  ELSE 'Wire reports that ' || lower(url[1:1]) || url[2:] || '. This item is grouped under general news for France; open the source for full context.' END AS summary FROM c""".replace("\\\\s", "\\s"))
def text_article_summary(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.summary_text(F.lit("France"), F.lit("General News"), F.col("url"), F.lit("Wire"), F.col("html")).alias("summary"))


@check("text_direct_url", """SELECT page_id, url AS target FROM pages UNION ALL SELECT page_id + 1000000, url FROM pages""")
def text_direct_url(spark, folder):
    p = table(spark, folder, "pages")
    wrapped = F.concat(F.lit("https://news.test/r?a=1&url="), F.url_encode("url"), F.lit("&b=2"))
    return (p.select("page_id", text.direct_url(F.col("url")).alias("target"))
             .unionByName(p.select((F.col("page_id") + 1000000).alias("page_id"), text.direct_url(wrapped).alias("target"))))


@check("text_first_time", f"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) WHEN event_id % 3 = 1 THEN epoch_us(TIMESTAMP '2024-01-15 12:00:00') END AS first_us,
  CASE WHEN event_id % 3 < 2 THEN round(greatest(0.0, (epoch_us({B.AS_OF_SQL}) - CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) WHEN event_id % 3 = 1 THEN epoch_us(TIMESTAMP '2024-01-15 12:00:00') END) / 1000000.0 / 86400), 6) END AS age_days FROM events""")
def text_first_time(spark, folder):
    k = F.col("event_id")
    published = F.when(k % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).otherwise("not a date")
    collected = F.when(k % 3 == 1, "2024-01-15T13:00:00+01:00").otherwise("")
    first = times.first_time(times.parse_time(published), times.parse_time(collected))
    return (B.events(spark, folder).select("event_id", first.alias("t"))
            .select("event_id", F.unix_micros("t").alias("first_us"),
                    F.round(F.when(F.col("t").isNotNull(), times.age_days(B.as_of(), F.col("t"))), 6).alias("age_days")))


@check("text_article_key", """
SELECT page_id, sha1(url) AS k1, sha1('France|' || html) AS k2, sha1('Title') AS k3 FROM (SELECT page_id, url, html FROM pages)""".replace("sha1('Title')", "sha1('|' || url)"))
def text_article_key(spark, folder):
    none = F.lit(None).cast("string")
    return table(spark, folder, "pages").select(
        "page_id", text.article_key(F.col("url"), none, none).alias("k1"), text.article_key(F.lit(""), F.lit("France"), F.col("html")).alias("k2"),
        text.article_key(none, none, F.col("url")).alias("k3"))


@check("ais_type_class", f"""
SELECT event_id, CASE WHEN c BETWEEN 60 AND 69 THEN 'Passenger' WHEN c BETWEEN 70 AND 79 THEN 'Cargo' WHEN c BETWEEN 80 AND 89 THEN 'Tanker' WHEN c BETWEEN 90 AND 99 THEN 'Other' WHEN c = 0 THEN ''
  ELSE coalesce({sql_case('c', V.AIS_TYPES)}, 'AIS type ' || c) END AS class FROM (SELECT event_id, event_id % 130 AS c FROM events)""")
def ais_type_class(spark, folder):
    return table(spark, folder, "events").select("event_id", feeds.ais_class((F.col("event_id") % 130).cast("string")).alias("class"))


@check("ais_eta", """
SELECT event_id, CASE WHEN p = 0 THEN '' WHEN (p >> 16) & 15 BETWEEN 1 AND 12 AND (p >> 11) & 31 BETWEEN 1 AND 31 AND (p >> 6) & 31 <= 23 AND p & 63 <= 59
  THEN printf('%02d/%02d %02d:%02d UTC', (p >> 11) & 31, (p >> 16) & 15, (p >> 6) & 31, p & 63) ELSE CAST(p AS VARCHAR) END AS eta
FROM (SELECT event_id, CAST(event_id * 7919 % 1048576 AS BIGINT) AS p FROM events)""")
def ais_eta(spark, folder):
    return table(spark, folder, "events").select("event_id", feeds.ais_eta(F.col("event_id") * 7919 % 1048576).alias("eta"))


@check("hazard_details", f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN (['EQ','TC','FL','VO','DR','WF'])[event_id % 6 + 1] ELSE (['EQ','TC','FL','VO','DR','WF'])[(event_id + 1) % 6 + 1] END AS code,
  CASE WHEN event_id % 5 = 0 THEN CASE severity WHEN 'Critical' THEN 'red' WHEN 'High' THEN 'orange' ELSE 'green' END ELSE 'orange' END AS alert,
  CASE WHEN event_id % 5 = 0 THEN CASE severity WHEN 'Critical' THEN 3.0 WHEN 'High' THEN 1.8 ELSE 0.6 END ELSE 1.8 END::DOUBLE AS alert_score,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE country || ',Norway' END AS affected,
  CASE WHEN event_id % 5 <> 0 AND (event_id + 1) % 6 = 0 THEN CAST(event_id % 9 AS DOUBLE) END AS magnitude,
  CASE WHEN event_id % 5 = 0 THEN 'https://fallback.test' ELSE 'https://report.test/' || event_id END AS report_url
FROM b_signals""")
def hazard_details(spark, folder):
    k = F.col("event_id")
    payload = F.to_json(F.struct(F.struct(
        F.lower(B.pick(list(V.HAZARD_LABELS), (k + 1) % 6)).alias("eventtype"), k.cast("string").alias("eventid"), F.lit("Orange").alias("alertlevel"),
        F.struct((k % 9).cast("double").alias("severity")).alias("severitydata"),
        F.struct(F.concat(F.lit("https://report.test/"), k.cast("string")).alias("report")).alias("url"),
        F.array(F.struct(F.col("country").alias("countryname")), F.struct(F.lit("Norway").alias("countryname"))).alias("affectedcountries")).alias("properties")))
    raw = F.when(k % 5 == 0, "{}").otherwise(payload)
    d = feeds.hazard_details(raw, F.col("event_type"), F.col("severity"), F.col("country"), F.col("location"), F.lit("https://fallback.test"))
    d_ = F.col("d")
    return B.signals(spark, folder).select(k, d.alias("d")).select(
        "event_id", d_["event_type"].alias("code"), d_["alert"].alias("alert"), d_["alert_score"].alias("alert_score"),
        F.array_join(d_["affected_countries"], ",").alias("affected"), d_["magnitude"].alias("magnitude"), d_["report_url"].alias("report_url"))


@check("duration_text", """
SELECT o_orderkey, CASE WHEN m >= 60 THEN printf('%dh %02dm', m // 60, m % 60) ELSE printf('%dm', m) END AS duration FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS m FROM orders)""")
def duration_text(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", times.duration_text(F.floor(F.col("o_totalprice") / 100)).alias("duration"))


@check("bands_and_ordinals", """
SELECT event_id, severity, CASE severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 ELSE 1 END AS severity_rank,
  CASE WHEN confidence >= 70 THEN 'Critical' WHEN confidence >= 38 THEN 'Moderate' ELSE 'Low' END AS risk_band,
  CASE WHEN confidence - 30 >= 70 THEN 'Critical' WHEN confidence - 30 >= 45 THEN 'Elevated' WHEN confidence - 30 >= 25 THEN 'Watch' ELSE 'Informational' END AS alert_band FROM b_signals""")
def bands_and_ordinals(spark, folder):
    c = F.col("confidence")
    return B.signals(spark, folder).select("event_id", "severity", scoring.severity_rank(F.col("severity")).alias("severity_rank"),
                                           scoring.risk_band(c).alias("risk_band"), scoring.alert_band(c - 30).alias("alert_band"))


@check("suggested_actions", f"""
SELECT event_id, CASE WHEN m > 0 THEN 'A similar issue appears in ' || m || ' stored historical report' || CASE WHEN m = 1 THEN '' ELSE 's' END || '. ' ELSE '' END ||
  CASE WHEN confidence >= 70 THEN '{V.ACTION_CRITICAL}' WHEN confidence >= 38 THEN '{V.ACTION_MODERATE}' ELSE '{V.ACTION_LOW}' END AS action,
  'Reported by ' || (1 + m) || ' source' || CASE WHEN m = 0 THEN '' ELSE 's' END || CASE WHEN m > 1 THEN '|Remained active across ' || m || ' monitoring updates' ELSE '' END ||
  CASE WHEN m % 2 = 0 THEN '|Potential exposure: Maritime, Rail' ELSE '|Potential indirect supplier, inventory or transport exposure' END AS why
FROM (SELECT *, event_id % 4 AS m FROM b_signals)""")
def suggested_actions(spark, folder):
    m = F.col("event_id") % 4
    modes = F.when(m % 2 == 0, F.array(F.lit("Maritime"), F.lit("Rail"))).otherwise(F.array().cast("array<string>"))
    return B.signals(spark, folder).select(
        "event_id", scoring.suggested_action(scoring.risk_band(F.col("confidence")), m).alias("action"),
        F.array_join(scoring.alert_explanation(F.lit("Watch"), 1 + m, m, modes)["why"], "|").alias("why"))


@check("text_article_text", """SELECT article_id, md5(headline || ' ' || summary || ' ' || category || ' ' || country || ' ') AS digest FROM b_articles""")
def text_article_text(spark, folder):
    t = text.article_text(F.col("headline"), F.col("summary"), F.col("category"), F.col("country"), F.lit(None).cast("string"))
    return B.articles(spark, folder).select("article_id", F.md5(t).alias("digest"))
