"""Multi-label general-news taxonomy."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions.text import blank, hits, let, phrase, word_set


def classify(headline: Column, summary: Column, taxonomy=V.TAXONOMY, phrases=V.TAXONOMY_PHRASES, keep=3, minimum=2,
             fallback=V.TAXONOMY_FALLBACK) -> Column:
    """Up to ``keep`` labels as array of (label, score, evidence), strongest first.

    Headline words count twice, summary words once and phrases three times. The work is one row's
    own tokens against a fixed vocabulary, so it stays an expression and needs no shuffle.
    """
    def score_labels(row):
        scored = []
        for rank, (label, terms) in enumerate(taxonomy.items()):
            found = F.array_compact(F.array(*[F.when(row["lowered"].contains(p), F.lit(p)) for p in phrases.get(label, ["\0"])]))
            scored.append(F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("label"), found.alias("found"),
                                   hits(row["head"], terms).alias("head"), hits(row["body"], terms).alias("body")))
        return F.array(*scored)

    def score_of(s):
        return 2 * F.size(s["head"]) + F.size(s["body"]) + 3 * F.size(s["found"])

    text = F.struct(word_set(blank(headline)).alias("head"), word_set(blank(summary)).alias("body"),
                    F.lower(phrase(headline, summary)).alias("lowered"))
    points = F.transform(let(text, score_labels), lambda s: F.struct(
        (-score_of(s)).alias("order"), s["rank"].alias("rank"), s["label"].alias("label"), score_of(s).cast("bigint").alias("score"),
        F.slice(F.concat(s["found"], F.array_sort(s["head"]), F.array_sort(s["body"])), 1, 5).alias("evidence")))
    nothing = F.array(F.struct(F.lit(fallback).alias("label"), F.lit(0).cast("bigint").alias("score"),
                               F.array().cast("array<string>").alias("evidence")))

    def choose(ranked):
        chosen = F.transform(ranked, lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score"), s["evidence"].alias("evidence")))
        return F.when(F.size(ranked) > 0, chosen).otherwise(nothing)

    return let(F.slice(F.array_sort(F.filter(points, lambda s: s["score"] >= minimum)), 1, keep), choose)
