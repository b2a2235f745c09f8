"""Many names in many texts at once.

Texts and names meet on the first word of a name; what follows is compared in place, in a window as long as the longest name. The cost follows
the words of the texts and the names that begin with them, not names times texts. The rules are those of ``places.country_mentioned``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions.text import blank, let

FIRST_WORDS = 10_000  # more than these are only joined
PIECES = "[A-Za-z]+|[^A-Za-z]+"  # runs of letters and what lies between them


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def country_names(spark: SparkSession, countries, aliases=V.COUNTRY_ALIASES) -> DataFrame:
    """(name, alias) rows of a list of countries; a country without aliases is its own."""
    return spark.createDataFrame([(c, a) for c in countries for a in aliases.get(c, [c])], "name string, alias string")


def spellings(names: DataFrame, cased=tuple(V.CASE_SENSITIVE_ALIASES)) -> DataFrame:
    """Literal spellings of (name, alias) rows: name, literal, run (its first letters), lead (what stands before them), cased.

    Up to three letters are an acronym, in its own case and with or without dots; the aliases of ``cased`` keep their case, all others are compared
    in lower case. An alias that is NULL or has no ASCII letter has no spelling and is never found.
    """
    alias, letters = F.col("alias"), F.regexp_replace("alias", "[^A-Za-z]", "")
    size, letter = F.length(letters), lambda i: F.substring(letters, i, 1)
    dots = [F.lit(""), F.lit(".")]  # a closing dot changes nothing: no letter follows either way
    acronym = (F.when(size == 1, F.array(letters)).when(size == 2, F.array(*[F.concat(letter(1), d, letter(2)) for d in dots]))
               .otherwise(F.array(*[F.concat(letter(1), d, letter(2), e, letter(3)) for d in dots for e in dots])))
    kept = alias.isin(list(cased))
    literals = F.when(size <= 3, acronym).when(kept, F.array(alias)).otherwise(F.array(F.lower(alias)))
    rows = names.where(size > 0).select("name", F.explode(literals).alias("literal"), ((size <= 3) | kept).alias("cased"))
    return rows.distinct().select("name", "literal", "cased", F.regexp_extract("literal", "[A-Za-z]+", 0).alias("run"), F.regexp_extract("literal", "^[^A-Za-z]*", 0).alias("lead"))


def _windows(shown: Column, reach: int, width: int, lead: int, first=None) -> Column:
    """Distinct (run, before, ahead) of runs of letters (those in ``first``, if given): ``ahead`` begins with the run, ``before`` ends in front of it and starts with a blank at the
    text's start."""
    def around(pieces):
        def one(piece, i):
            gap = F.when(i == 0, F.lit(" ")).when(i == 1, F.concat(F.lit(" "), F.get(pieces, i - 1))).otherwise(F.get(pieces, i - 1))
            ahead = F.substring(F.array_join(F.slice(pieces, i + 1, F.lit(reach)), ""), 1, width + 1)
            return F.when(piece.rlike("^[A-Za-z]") if first is None else piece.isin(first), F.struct(piece.alias("run"), F.right(gap, F.lit(lead + 1)).alias("before"), ahead.alias("ahead")))
        return F.array_distinct(F.array_compact(F.transform(pieces, one)))
    return let(_pieces(shown), around)


def mentions(texts: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, name) of every name that a text holds between other characters than letters; ``found`` is the result of ``spellings``.

    A NULL or empty text names nothing. Rows of one key are one text. The names join without a hint: AQE sends a small gazetteer to every task, for a large one
    it splits the windows of a frequent first word. Up to FIRST_WORDS first words are known to every task, which then opens no window at other words.
    """
    bounds = found.agg(F.max(F.size(_pieces(F.col("literal")))).alias("reach"), F.max(F.length("literal")).alias("width"), F.max(F.length("lead")).alias("lead")).first()  # one row
    reach, width, lead = (bounds[0] or 0) + 1, bounds[1] or 0, bounds[2] or 0
    shown = blank(F.col(text))
    begin = found.select("cased", "run").distinct().limit(FIRST_WORDS + 1).collect()
    few = len(begin) <= FIRST_WORDS
    first = {cased: [r["run"] for r in begin if r["cased"] == cased] for cased in (False, True)}
    windows = [texts.select(F.col(key).alias("__key"), F.lit(cased).alias("cased"), F.explode(_windows(value, reach, width, lead, first[cased] if few else None)).alias("w"))
               for cased, value in ((False, F.lower(shown)), (True, shown)) if first[cased] or not few or not cased and not begin]
    rows = reduce(DataFrame.unionByName, windows).select("__key", "cased", "w.*")
    rest = F.substr("literal", F.length("lead") + 1)
    here = F.col("ahead").startswith(rest) & ~F.substr("ahead", F.length(rest) + 1, F.lit(1)).rlike("[A-Za-z]")
    behind = (F.col("lead") == "") | (F.col("before").endswith(F.col("lead")) & (F.length("before") > F.length("lead")))
    return rows.join(found, ["run", "cased"]).where(here & behind).select(F.col("__key").alias(key), "name").distinct()


def locate(df: DataFrame, text: Column, found: DataFrame, into: str) -> DataFrame:
    """The longest name in ``text`` as a new column (equal lengths: the alphabetically first; none: NULL). Every distinct text is searched once."""
    said = df.select(blank(text).alias("__said")).distinct()
    longest = mentions(said, found, "__said", "__said").groupBy("__said").agg(F.min(F.struct(-F.length("name"), F.col("name").alias("name")))["name"].alias(into))
    return df.withColumn("__said", blank(text)).join(longest, "__said", "left").drop("__said")
