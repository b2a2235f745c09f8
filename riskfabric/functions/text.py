"""Text expressions: tokens, story keys, entity context, summaries, identities."""

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfabric import vocabulary as V

WORD = r"[a-z]+(?:-[a-z]+)?"


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def let(value: Column, body) -> Column:
    """Bind a value once so that lambdas refer to it instead of computing it per element."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def phrase(*parts) -> Column:
    """Join text parts with one blank, NULL counting as empty."""
    return F.concat_ws(" ", *[blank(p) for p in parts])


def words(text: Column, pattern: str = WORD) -> Column:
    """All tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(blank(text)), F.lit(pattern), F.lit(0))


def word_set(text: Column, pattern: str = WORD) -> Column:
    return F.array_distinct(words(text, pattern))


def ranking_words(text: Column, stopwords=V.RANKING_STOPWORDS) -> Column:
    """Tokens of at least three characters without ranking stopwords (with repeats)."""
    found = words(text, r"[a-z][a-z0-9-]{2,}")
    return F.filter(found, lambda w: ~w.isin(list(stopwords)))


def hits(tokens: Column, lexicon) -> Column:
    """Tokens that belong to a lexicon."""
    return F.array_intersect(tokens, F.lit(list(lexicon)))


def hit_count(tokens: Column, lexicon) -> Column:
    return F.size(hits(tokens, lexicon))


def touches(tokens: Column, *lexicons) -> Column:
    """True when a token belongs to any of the lexicons."""
    merged = list(dict.fromkeys(w for lexicon in lexicons for w in lexicon))
    return F.arrays_overlap(tokens, F.lit(merged))


def contains_any(lowered: Column, markers) -> Column:
    """Substring test against several markers."""
    test = F.lit(False)
    for marker in markers:
        test = test | lowered.contains(marker)
    return test


def matches_any(text: Column, patterns) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def labels_present(lowered: Column, markers: dict) -> Column:
    """Labels whose markers occur as substrings, in vocabulary order."""
    return F.array_compact(F.array(*[
        F.when(contains_any(lowered, terms), F.lit(label)) for label, terms in markers.items()
    ]))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even; whole numbers come back as bigint."""
    rounded = F.bround(value, digits)
    return rounded.cast("bigint") if digits == 0 else rounded


def strip_publisher(headline: Column) -> Column:
    return F.trim(F.regexp_replace(blank(headline), V.PUBLISHER_SUFFIX, ""))


def story_words(headline: Column, stopwords=V.STORY_STOPWORDS) -> Column:
    found = words(strip_publisher(headline), r"[a-z0-9]+")
    return F.filter(found, lambda w: ~w.isin(list(stopwords)))


def story_key(headline: Column, stopwords=V.STORY_STOPWORDS) -> Column:
    return F.array_join(story_words(headline, stopwords), " ")


def numbers(text: Column) -> Column:
    """Sorted distinct whole numbers mentioned in a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(blank(text), F.lit(r"\b\d+\b"), F.lit(0))))


def fact_variance(left: Column, right: Column) -> Column:
    """Note on differing numeric details, empty when nothing differs."""
    a, b = numbers(left), numbers(right)
    note = F.concat(F.lit("Numeric details differ ("), F.array_join(a, ", "), F.lit(" vs "),
                    F.array_join(b, ", "), F.lit(")"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (a != b), note).otherwise(F.lit(""))


def entity_context(headline: Column, summary: Column = None, operational=V.OPERATIONAL_TERMS,
                   routes=V.ROUTE_MARKERS, modes=V.MODE_MARKERS) -> Column:
    """Named entities, routes, transport modes and an operational relevance score."""
    text = F.lower(phrase(headline, summary if summary is not None else F.lit("")))
    found_routes = labels_present(text, routes)
    found_modes = labels_present(text, modes)
    names = F.transform(F.regexp_extract_all(blank(headline), F.lit(V.ENTITY_PATTERN), F.lit(0)), lambda n: F.trim(n))
    names = F.filter(names, lambda n: (F.length(n) > 2) & ~F.lower(n).isin("the", "a", "an"))
    terms = F.size(hits(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))), operational))
    relevance = F.least(F.lit(100), 15 + terms * 14 + F.size(found_modes) * 10 + F.size(found_routes) * 15)
    return F.struct(
        F.slice(F.array_union(names, found_routes), 1, 12).alias("entities"),
        found_routes.alias("routes"),
        F.when(F.size(found_modes) > 0, found_modes).otherwise(F.array(F.lit("Multimodal / indirect"))).alias("transport_modes"),
        relevance.cast("bigint").alias("operational_relevance"),
    )


def strip_markup(text: Column) -> Column:
    """Drop tags, collapse white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(text), "<[^>]+>", " "), r"\s+", " "))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+[0-9]*);"


def unescape_markup(text: Column) -> Column:
    """Character references decoded once: numbers by their code point, names by the standard table; unknown ones stay."""
    named = lookup({f"&{name};": chr(point) for name, point in {**name2codepoint, "apos": 39, "nbsp": 32}.items()})
    hexed = lambda e: F.when(F.lower(F.substring(e, 3, 1)) == "x", F.regexp_extract(e, "[xX]([0-9a-fA-F]+)", 1)).otherwise(F.hex(F.regexp_extract(e, "#([0-9]+)", 1).cast("bigint")))
    valid = lambda e: F.conv(hexed(e), 16, 10).cast("bigint").between(1, 0x10FFFF) & ~F.conv(hexed(e), 16, 10).cast("bigint").between(0xD800, 0xDFFF)
    point = lambda e: F.when(valid(e), F.decode(F.unhex(F.lpad(hexed(e), 8, "0")), "UTF-32")).otherwise("\ufffd")
    one = lambda e: F.when(F.substring(e, 2, 1) == "#", point(e)).otherwise(F.coalesce(F.try_element_at(named, e), e))
    between = F.split(text, _ENTITY, -1)
    decoded = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), one)
    whole = F.array_join(F.zip_with(between, decoded, lambda t, e: F.concat(t, F.coalesce(e, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def summary_text(country, category, headline, publisher, description) -> Column:
    """Description cut at a word boundary, or a templated sentence when it is too short."""
    clean = strip_markup(unescape_markup(blank(description)))
    head = F.substring(clean, 1, 360)
    cut_head = F.regexp_replace(head, r"(?s) [^ ]*$", "")
    long_form = F.concat(cut_head, F.when(F.length(clean) > 360, F.lit("…")).otherwise(F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(blank(headline), r"\s+-\s+[^-]+$", ""), r"[.!?]+$", "")
    lead = F.concat(F.lower(F.substring(bare, 1, 1)), F.substring(bare, 2, 1_000_000))
    short_form = F.concat(publisher, F.lit(" reports that "), lead, F.lit(". This item is grouped under "),
                          F.lower(category), F.lit(" for "), country, F.lit("; open the source for full context."))
    return F.when(F.length(clean) > 80, long_form).otherwise(short_form)


def direct_url(raw: Column) -> Column:
    """Target of a redirect link (its ``url`` parameter), else the link itself."""
    target = F.try_parse_url(raw, F.lit("QUERY"), F.lit("url"))
    return F.coalesce(F.nullif(F.try_url_decode(target), F.lit("")), raw)


def article_key(url, country, headline) -> Column:
    fallback = F.concat_ws("|", blank(country), blank(headline))
    return F.sha1(F.coalesce(F.nullif(url, F.lit("")), fallback).cast("binary"))


def article_text(headline, summary, category, country, transport_mode) -> Column:
    return phrase(headline, summary, category, country, transport_mode)


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def plural(count: Column, singular: str) -> Column:
    return F.concat(F.lit(singular), F.when(count == 1, F.lit("")).otherwise(F.lit("s")))


def lookup(mapping: dict) -> Column:
    """A literal map expression."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
