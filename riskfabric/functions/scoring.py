"""Bands, ordinals and fixed recommendation wording."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions.text import plural


def risk_band(score: Column) -> Column:
    return F.when(score >= 70, "Critical").when(score >= 38, "Moderate").otherwise("Low")


def alert_band(score: Column) -> Column:
    return (F.when(score >= 70, "Critical").when(score >= 45, "Elevated")
             .when(score >= 25, "Watch").otherwise("Informational"))


def severity_rank(level: Column) -> Column:
    return F.when(level == "Critical", 3).when(level == "High", 2).when(level == "Watch", 1).otherwise(0)


def severity_score(level: Column) -> Column:
    return F.when(level == "Critical", 85).when(level == "High", 62).when(level == "Watch", 34).otherwise(20)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def suggested_action(level: Column, matches: Column) -> Column:
    prefix = F.when(matches > 0, F.concat(F.lit("A similar issue appears in "), matches.cast("string"),
                                          F.lit(" stored historical "), plural(matches, "report"), F.lit(". "))).otherwise("")
    action = (F.when(level == "Critical", V.ACTION_CRITICAL).when(level == "Moderate", V.ACTION_MODERATE)
               .otherwise(V.ACTION_LOW))
    return F.concat(prefix, action)


def alert_explanation(level: Column, source_count: Column, active_windows: Column, modes: Column) -> Column:
    """Why an alert is shown (list of reasons) and what to do."""
    why = F.array_compact(F.array(
        F.concat(F.lit("Reported by "), source_count.cast("string"), F.lit(" "), plural(source_count, "source")),
        F.when(active_windows > 1, F.concat(F.lit("Remained active across "), active_windows.cast("string"),
                                            F.lit(" monitoring updates"))),
        F.when(F.size(modes) > 0, F.concat(F.lit("Potential exposure: "), F.array_join(modes, ", ")))
         .otherwise(F.lit("Potential indirect supplier, inventory or transport exposure"))))
    action = (F.when(level == "Critical", V.ALERT_ACTION_CRITICAL).when(level == "Elevated", V.ALERT_ACTION_ELEVATED)
               .otherwise(V.ALERT_ACTION_WATCH))
    return F.struct(why.alias("why"), action.alias("action"))
