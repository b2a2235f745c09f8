"""Lexicon tone and country-targeted sentiment."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions.places import country_mentioned
from riskfabric.functions.text import blank, half_even, hit_count, let, lookup, word_set, words


def tone(text: Column, positive=V.POSITIVE_TONE, negative=V.NEGATIVE_TONE, tokens: Column = None) -> Column:
    """Tone from -100 to 100 with a label and the hit counts."""
    tokens = word_set(text) if tokens is None else tokens
    plus, minus = hit_count(tokens, positive), hit_count(tokens, negative)
    score = half_even((plus - minus) / F.greatest(F.lit(1), plus + minus) * 100)
    return F.struct(
        score.alias("score"),
        F.when(score >= 25, "Positive").when(score <= -25, "Negative").otherwise("Neutral").alias("label"),
        plus.cast("bigint").alias("positive_hits"), minus.cast("bigint").alias("negative_hits"))


def sentiment_raw(tokens: Column, weights: dict, negations=V.NEGATIONS) -> Column:
    """Signed sum of word weights; a negation within the three preceding words flips the sign."""
    table = lookup(weights)
    terms = list(weights)

    def weigh(all_words):
        marked = F.filter(F.transform(all_words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                          lambda s: s["w"].isin(terms))

        def signed(s):
            before = F.slice(all_words, F.greatest(s["i"] - 2, F.lit(1)), F.least(s["i"], F.lit(3)))
            return F.when(F.arrays_overlap(before, F.lit(list(negations))), -table[s["w"]]).otherwise(table[s["w"]])

        return F.aggregate(marked, F.lit(0), lambda total, s: total + signed(s))

    return let(tokens, weigh)


def country_sentiment(text: Column, country, positive=V.SENTIMENT_POSITIVE, negative=V.SENTIMENT_NEGATIVE,
                      negations=V.NEGATIONS) -> Column:
    """Sentiment directed at a country: sentences that name it, or all when none does."""
    sentences = F.filter(F.split(blank(text), r"(?<=[.!?;])\s+|\s+[–—]\s+"), lambda s: F.trim(s) != "")
    weights = {**positive, **{w: -v for w, v in negative.items()}}

    def label(scored):
        score = scored["score"]
        return F.struct(
            score.alias("score"),
            F.when(score >= 15, "Positive").when(score <= -15, "Negative").otherwise("Neutral").alias("label"),
            scored["explicit"].alias("target_explicit"))

    def score(split):
        explicit = F.size(split["aimed"]) > 0
        scope = F.when(explicit, split["aimed"]).otherwise(split["sentences"])
        raw = sentiment_raw(words(F.array_join(scope, " ")), weights, negations)
        return let(let(raw, lambda r: F.struct(half_even(100 * r / (F.abs(r) + 3)).alias("score"), explicit.alias("explicit"))), label)

    return let(let(sentences, lambda s: F.struct(
        s.alias("sentences"), F.filter(s, lambda x: country_mentioned(x, country)).alias("aimed"))), score)
