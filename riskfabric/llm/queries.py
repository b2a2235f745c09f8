"""Registered queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.llm import bpe, chat, fingerprint, html, jaccard, licenses, mixing, neardup, quality, resample, shared, tokencount, tokenfile, whitening
from riskfabric.llm.license_texts import LICENSES

MIX_SEED, MIX_TEMPERATURE = 17, 0.5


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations (and conversation -7), read back from their prefix-target examples."""
    extra = spark.sql("SELECT -7L AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    examples = chat.prefix_examples(read(spark, folder, "conversations").unionByName(extra))
    turns = F.when(F.col("whole"), F.array_join(F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    part = F.struct("position", chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text"))
    rows = examples.select("conv_id", F.when(F.col("whole"), F.col("n_turns")).alias("n_turns"), F.sha2(turns, 256).alias("turns"),
                           F.when(F.col("trainable"), part).alias("part"), F.char_length("formatted").cast("long").alias("chars"))
    loss = F.array_join(F.transform(F.array_sort("parts"), lambda p: p["text"]), "")
    return rows.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns").alias("turns_sha256"), F.collect_list("part").alias("parts"),
                                       F.sum("chars").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def _sql_escaped_length(text: str) -> str:
    """Length after escaping: one more for each backslash and each control string."""
    sql = f"length({text}) + length({text}) - length(replace({text}, '\\', ''))"
    for c in chat.CONTROL:
        sql += f" + (length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}"
    return f"({sql})"


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, {len(chat.START + chat.SEPARATOR + chat.END)} + {_sql_escaped_length('role')} + {_sql_escaped_length('text')} AS chars,
    row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR place = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents linked at a Jaccard similarity of 0.9 of their 3-word shingles."""
    return jaccard.ngram_groups(read(spark, folder, "documents"), width=3, share=(90, 100))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade and probability of the top grade of all documents, and whether the document is selected."""
    documents = read(spark, folder, "documents")
    model = quality.fit(documents, quality.grades(read(spark, folder, "labels")))
    rated = quality.rate(documents.select("doc_id", "text"), model)
    return rated.select("doc_id", "expected_grade", F.col("tail").alias("tail_probability"), (F.col("tail") >= corpus_pipeline.LEAST_TAIL).alias("selected"))


def op5_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to shares proportional to the square root of their source's size."""
    return mixing.mix(read(spark, folder, "documents"), seed=MIX_SEED, temperature=MIX_TEMPERATURE)


OP5_SQL = f"""
WITH sources AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
means AS (SELECT source, pow(n, {MIX_TEMPERATURE}) / sum(pow(n, {MIX_TEMPERATURE})) OVER () * sum(n) OVER () / n AS mean FROM sources),
drawn AS (
  SELECT d.*, m.mean, (('0x' || substr(md5('{MIX_SEED}|' || coalesce('=' || doc_id, '~') || '|=1'), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source),
terms AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM means, (SELECT unnest(range(0, 300)) AS k) WHERE mean <= 256),
counted AS (SELECT d.*, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.below < d.u) AS copies FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, copy, md5('{MIX_SEED}|order|' || doc_id || '|' || copy) AS shuffle_key
FROM (SELECT * EXCLUDE (mean, u, copies), unnest(range(0, copies)) AS copy FROM counted)
"""

def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents and the bytes decoded from them, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(read(spark, folder, "documents").select("doc_id", "text"), path, pattern), path, pattern)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as Arrow files of token sequences, and read back."""
    target = shared.shared_folder(spark, "tokens")
    files = tokenfile.write(read(spark, folder, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return tokenfile.read_documents(files).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return neardup.near_duplicates(read(spark, folder, "embeddings"), threshold=0.95)


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]) THEN embedding::DOUBLE[] END AS e FROM embeddings),
u AS (SELECT vec_id, r, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r != b.r AND a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.s = links.a),
low AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.r)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept FROM v JOIN low USING (r)
"""


def op8_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(read(spark, folder, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses whose texts or notices the documents hold, with coverage and place."""
    return licenses.scan(read(spark, folder, "documents"), LICENSES)


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike they and the next document are by what peeling recovers."""
    rows = fingerprint.with_next(read(spark, folder, "documents"))
    changed = fingerprint.edited(F.col("text"), F.col("next_text"))
    digests = rows.withColumn("changed", changed).select(
        "row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), fingerprint.paragraphs(F.col("text")).alias("own"),
        fingerprint.paragraphs(F.col("changed")).alias("edited"), fingerprint.paragraphs(F.col("next_text")).alias("next"))
    digests = shared.written(digests, "digests")
    found = fingerprint.compare(digests, "row", "own", ["edited", "next"])
    texts = fingerprint.sketch_text(digests.repartition(F.col("row")), "row", ["own", "edited"])
    alike = lambda name: fingerprint.likeness(F.size("own"), F.size(name), F.size(f"{name}_alone") + F.size(f"{name}_new")).cast("double")
    return texts.join(found, "row").select("doc_id", "n_chars", "edited_sha256", F.col("own_fingerprint").alias("fingerprint"), F.col("edited_fingerprint"),
                                           alike("edited").alias("near_edited"), alike("next").alias("near_next"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weights, scores and draw of all documents by how they resemble the benchmark texts."""
    rows = resample.importance(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on their first eight principal components, at unit variance."""
    return whitening.whiten(read(spark, folder, "embeddings"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of all documents, and whether they exceed 512 tokens."""
    rows = tokencount.count(read(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")


#: name -> (query, SQL or None)
QUERIES = {
    "op1_chat_formatting": (op1_chat_formatting, OP1_SQL),
    "op2_byte_bpe": (op2_byte_bpe, None),
    "op3_ngram_jaccard": (op3_ngram_jaccard, None),
    "op4_quality": (op4_quality, None),
    "op5_source_mixture": (op5_source_mixture, OP5_SQL),
    "op6_token_files": (op6_token_files, None),
    "op7_embedding_near_duplicates": (op7_embedding_near_duplicates, OP7_SQL),
    "op8_page_text": (op8_page_text, None),
    "op9_license_scan": (op9_license_scan, None),
    "op10_fingerprints": (op10_fingerprints, None),
    "op11_importance_resampling": (op11_importance_resampling, None),
    "op12_embedding_whitening": (op12_embedding_whitening, None),
    "op13_token_counts": (op13_token_counts, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
