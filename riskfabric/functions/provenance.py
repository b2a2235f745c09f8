"""Evidence carried by the source list of a story."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions.text import blank


def source_evidence(sources: Column, primary_types=V.PRIMARY_SOURCE_TYPES) -> Column:
    """Distinct families, primary families and evidence weight; (1, 0, 1.0) without sources.

    ``sources`` is the bounded source list of one story (one entry per family after roll-up).
    """
    def family(s):
        return F.coalesce(F.nullif(s["source_family"], F.lit("")),
                          F.lower(F.coalesce(F.nullif(s["publisher"], F.lit("")), F.lit("unknown"))))

    families = F.array_distinct(F.transform(sources, family))
    primary = F.array_distinct(F.transform(F.filter(sources, lambda s: blank(s["source_type"]).isin(list(primary_types))), family))
    empty = sources.isNull() | (F.size(sources) == 0)
    count = F.when(empty, F.lit(1)).otherwise(F.size(families))
    primaries = F.when(empty, F.lit(0)).otherwise(F.size(primary))
    return F.struct(count.cast("bigint").alias("source_count"), primaries.cast("bigint").alias("primary_source_count"),
                    F.when(empty, F.lit(1.0)).otherwise(count + 0.5 * primaries).alias("evidence_weight"))


def hazard_status(sources: Column, official=V.OFFICIAL_DETECTORS) -> Column:
    """Evidence status of a hazard story and whether an indexing service contributed."""
    family = lambda s: F.coalesce(F.nullif(s["source_family"], F.lit("")), s["publisher"])
    detected = F.array_distinct(F.transform(F.filter(sources, lambda s: blank(s["source_family"]).isin(official)), lambda s: s["publisher"]))
    news = F.array_distinct(F.transform(F.filter(sources, lambda s: ~blank(s["source_family"]).isin(official)), family))
    status = (F.when((F.size(detected) > 0) & (F.size(news) > 0), "OFFICIALLY DETECTED + NEWS CORROBORATED")
               .when(F.size(detected) > 0, "OFFICIAL HAZARD DETECTION")
               .when(F.size(news) >= 2, "MULTI-SOURCE NEWS CORROBORATION")
               .otherwise("UNCONFIRMED HAZARD REPORT"))
    indexed = F.exists(sources, lambda s: (blank(s["indexed_by"]) == "GDELT") | (blank(s["source_type"]) == "GDELT-indexed news"))
    return F.struct(status.alias("status"), F.size(news).cast("bigint").alias("news_families"), indexed.alias("indexed"))
