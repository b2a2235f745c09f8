"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More sources than this are joined with salted keys instead of being broadcast (a row is a name and one number).
BROADCAST_SOURCES = 20_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of an MD5 of the seed and the parts; missing parts have a mark of their own."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson(mean: Column, number: Column) -> Column:
    """Inverse Poisson distribution: the smallest k whose cumulative probability reaches `number`.

    As many terms are formed as leave less than 1e-15 of the distribution of that mean, which no hashed number can reach.
    """
    terms = (mean + 12 * F.sqrt(mean) + 40).cast("int")
    none = F.exp(-mean)
    return F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct(none.alias("term"), none.alias("below"), (none < number).cast("long").alias("count")),
        lambda s, k: F.when(s["below"] >= number, s).otherwise(F.struct(
            (s["term"] * mean / k).alias("term"), (s["below"] + s["term"] * mean / k).alias("below"),
            (s["count"] + (s["below"] + s["term"] * mean / k < number).cast("long")).alias("count"))),
        lambda s: s["count"])


def repetitions(mean: Column, seed: int, key: Column) -> Column:
    """Hash-seeded Poisson count of a key. A mean above 256 is the sum of equal parts with a number each, so that exp(-mean) stays exact."""
    parts = F.greatest(F.ceil(mean / 256), F.lit(1)).cast("int")
    drawn = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0).cast("long"), lambda n, i: n + poisson(mean / parts, uniform(seed, key, i)))
    return F.when(F.coalesce(mean, F.lit(0.0)) <= 0, F.lit(0).cast("long")).otherwise(drawn)


def source_means(documents: DataFrame, weights: dict[str, float] | None, source: str = "source", total: float | None = None,
                 temperature: float = 0.5) -> DataFrame:
    """Per source: `rows`, `weight` (share of the result) and `mean` (expected copies of each of its documents).

    `weights` names a target per source (others get 0); None takes rows ** temperature. `total` is the expected size of the mixture, by default
    the number of documents. Sources are counted over all documents before anything else is shuffled; a small source is repeated as often as its
    share asks for.
    """
    counts = documents.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).cast("double").alias("rows"))
    if weights is None:
        raw = F.pow(F.col("rows"), F.lit(temperature))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("_source") == name, F.lit(float(weight))).otherwise(raw)
    counts = counts.withColumn("_raw", raw)
    sums = counts.agg(F.sum("_raw").alias("_all"), F.sum("rows").alias("_rows"))
    size = F.lit(float(total)) if total is not None else F.col("_rows")
    weight = F.when(F.col("_all") > 0, F.col("_raw") / F.col("_all")).otherwise(0.0)
    return counts.crossJoin(F.broadcast(sums)).select("_source", "rows", weight.alias("weight"), (weight * size / F.col("rows")).cast("double").alias("mean"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", total: float | None = None,
        temperature: float = 0.5, seed: int = 17, salts: int = 64) -> DataFrame:
    """Documents repeated so that sources take their target shares, in random order: all columns plus `copy` (0, 1, ...) and `shuffle_key`.

    A document's count is the Poisson inverse of a number hashed from seed and key, so it does not depend on partitions, retries or other rows.
    Rows without a source form one source; without a key they share one number; repeated rows have equal counts. No column but key and source
    is read. An empty table gives no rows. Columns named `copy` or `shuffle_key` are replaced.
    """
    means = source_means(documents, weights, source, total, temperature).select("_source", "mean")
    few = means.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = documents.drop("copy", "shuffle_key").alias("d")
    same = F.col(f"d.{source}").eqNullSafe(F.col("_source"))
    if few:
        joined = rows.join(F.broadcast(means), same)
    else:
        salted = means.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("_own", F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).cast("int")).join(salted, same & (F.col("_own") == F.col("_salt"))).drop("_own", "_salt")
    counted = joined.withColumn("_copies", repetitions(F.col("mean"), seed, F.col(key))).drop("_source", "mean")
    spread = counted.where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).drop("_copies")
    spread = spread.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col(key).cast("string"), F.col("copy").cast("string"))))
    return spread.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
