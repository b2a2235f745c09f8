"""Country mention tests by controlled aliases, and publisher origin."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions.text import blank, contains_any, lookup


def alias_patterns(country: str, aliases):
    """(pattern for lower-cased text, pattern for original text) of one country."""
    loose, exact = [], []
    for alias in aliases:
        letters = re.sub(r"[^A-Za-z]", "", alias)
        if len(letters) <= 3:
            exact.append(r"\.?".join(letters) + r"\.?")
        elif alias in V.CASE_SENSITIVE_ALIASES:
            exact.append(rf"\Q{alias}\E")
        else:
            loose.append(rf"\Q{alias.lower()}\E")
    return ("(?<![a-z])(?:" + "|".join(loose) + ")(?![a-z])" if loose else "(?!)",
            "(?<![A-Za-z])(?:" + "|".join(exact) + ")(?![A-Za-z])" if exact else "(?!)")


def country_mentioned(text: Column, country, aliases=V.COUNTRY_ALIASES) -> Column:
    """Whether a text names a country; ``country`` is a name or a column of names."""
    text = blank(text)
    if isinstance(country, str):
        loose, exact = alias_patterns(country, aliases.get(country, [country]))
        test = F.lit(False)
        if loose != "(?!)":
            test = test | F.lower(text).rlike(loose)
        if exact != "(?!)":
            test = test | text.rlike(exact)
        return test
    patterns = {name: alias_patterns(name, names) for name, names in aliases.items()}
    loose = F.coalesce(F.element_at(lookup({k: v[0] for k, v in patterns.items()}), country),
                       F.concat(F.lit(r"(?<![a-z])\Q"), F.lower(country), F.lit(r"\E(?![a-z])")))
    exact = F.element_at(lookup({k: v[1] for k, v in patterns.items() if v[1] != "(?!)"}), country)
    named = F.rlike(F.lower(text), loose) | F.coalesce(F.rlike(text, exact), F.lit(False))
    return F.when(F.coalesce(country, F.lit("")) == "", F.lit(False)).otherwise(named)


def country_dimension(spark: SparkSession, overrides: dict = None) -> DataFrame:
    """ISO country dimension (about 250 rows) derived from the locale data of the JVM."""
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    rows = []
    for code in locale.getISOCountries():
        place = locale.forLanguageTag(f"und-{code}")
        name = (overrides or {}).get(code, place.getDisplayCountry(english))
        rows.append((code, place.getISO3Country(), name))
    return spark.createDataFrame(rows, "iso2 string, iso3 string, country string")


def domain_suffix(url: Column) -> Column:
    """Upper-case last label of the host, UK mapped to GB; NULL when unusable."""
    host = F.lower(F.regexp_extract(blank(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    suffix = F.upper(F.regexp_extract(host, r"\.([^.]*)$", 1))
    suffix = F.when(suffix == "UK", F.lit("GB")).otherwise(suffix)
    usable = (F.length(suffix) == 2) & ~F.lower(suffix).isin(V.GENERIC_DOMAINS)
    return F.when(usable, suffix)


def publisher_country(publisher: Column, markers=V.PUBLISHER_COUNTRY) -> Column:
    """Home country of a known publisher, first marker in vocabulary order wins."""
    name = F.lower(blank(publisher))
    return F.coalesce(*[F.when(name.contains(marker), F.lit(country)) for marker, country in markers.items()])


def with_source_origin(df: DataFrame, countries: DataFrame, publisher="publisher", url="source_home",
                       into="origin_country") -> DataFrame:
    """Publisher marker, else country domain, else ``Origin unverified``.

    ``countries`` (iso2, country) is the ISO dimension: bounded by the standard, so broadcast.
    """
    dim = F.broadcast(countries.select(F.col("iso2").alias("__iso2"), F.col("country").alias("__country")))
    return (df.withColumn("__suffix", domain_suffix(F.col(url)))
              .join(dim, F.col("__suffix") == F.col("__iso2"), "left")
              .withColumn(into, F.coalesce(publisher_country(F.col(publisher)), F.col("__country"),
                                           F.lit("Origin unverified")))
              .drop("__suffix", "__iso2", "__country"))


def source_family(publisher: Column, url: Column) -> Column:
    """Wire service, else registrable part of the host, else a slug of the publisher."""
    from riskfabric.functions.text import strip_publisher
    identity = F.lower(F.concat_ws(" ", blank(publisher), strip_publisher(publisher)))
    wire = F.coalesce(*[F.when(identity.rlike(rf"\b\Q{marker}\E\b"), F.lit(family))
                        for marker, family in V.WIRE_FAMILIES.items()])
    host = F.regexp_replace(F.lower(F.regexp_extract(blank(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.nullif(publisher, F.lit("")), F.lit("unknown"))),
                                             "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(wire, F.nullif(F.substring_index(host, ".", -2), F.lit("")), slug)


def inferred_assets(lowered: Column, country: Column, assets=V.ASSET_COUNTRY) -> Column:
    """Recognised infrastructure of the given country that a text names."""
    return F.array_compact(F.array(*[
        F.when((country == home) & lowered.contains(asset), F.lit(asset)) for asset, home in assets.items()]))


def foreign_places(lowered: Column, country: Column, places=V.FOREIGN_PLACE_COUNTRY) -> Column:
    """True when a place that belongs to another country is named."""
    test = F.lit(False)
    for place, home in places.items():
        test = test | ((country != home) & lowered.contains(place))
    return F.coalesce(test, F.lit(False))
