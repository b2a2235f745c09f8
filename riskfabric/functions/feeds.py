"""Field-level decoding of sensor feeds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfabric import vocabulary as V
from riskfabric.functions.text import blank, labels_present, lookup


def ais_class(value: Column) -> Column:
    """Readable ship class of an AIS type code; other text passes through."""
    text = F.trim(blank(value.cast("string")))
    code = F.expr("try_cast(NULL AS INT)") if value is None else text.try_cast("int")
    named = F.element_at(lookup(V.AIS_TYPES), code)
    return (F.when(code.isNull(), text)
             .when(code.between(60, 69), "Passenger").when(code.between(70, 79), "Cargo")
             .when(code.between(80, 89), "Tanker").when(code.between(90, 99), "Other")
             .when(code == 0, "")
             .otherwise(F.coalesce(named, F.concat(F.lit("AIS type "), code.cast("string")))))


def ais_eta(packed: Column) -> Column:
    """Bit-packed arrival time (month 16, day 11, hour 6, minute 0) as ``dd/MM HH:mm UTC``."""
    month, day = F.shiftright(packed, 16).bitwiseAND(15), F.shiftright(packed, 11).bitwiseAND(31)
    hour, minute = F.shiftright(packed, 6).bitwiseAND(31), packed.bitwiseAND(63)
    valid = month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59)
    return (F.when(packed.isNull() | (packed == 0), F.lit(""))
             .when(valid, F.format_string("%02d/%02d %02d:%02d UTC", day, month, hour, minute))
             .otherwise(packed.cast("string")))


def ais_eta_parts(month: Column, day: Column, hour: Column, minute: Column) -> Column:
    return F.when(month.isNotNull() & day.isNotNull() & hour.isNotNull() & minute.isNotNull(),
                  F.format_string("%02d/%02d %02d:%02d UTC", day, month, hour, minute)).otherwise(F.lit(""))


def hazard_kinds(text: Column) -> Column:
    return labels_present(F.lower(blank(text)), V.HAZARD_MARKERS)


HAZARD_PAYLOAD = (
    "properties struct<eventtype:string, eventid:string, episodeid:string, alertlevel:string, country:string,"
    " fromdate:string, todate:string, datemodified:string, iscurrent:string,"
    " severitydata:struct<severity:double, severitytext:string>, url:struct<report:string, geometry:string>,"
    " affectedcountries:array<struct<countryname:string>>>")


def hazard_details(raw_json: Column, event_type: Column, severity: Column, country: Column, location: Column,
                   source_url: Column) -> Column:
    """Flatten a stored hazard payload, falling back to the columns of the signal."""
    p = F.from_json(F.coalesce(raw_json, F.lit("{}")), HAZARD_PAYLOAD)["properties"]
    code = F.upper(F.coalesce(p["eventtype"], F.element_at(lookup(V.HAZARD_CODES), event_type), F.lit("other")))
    alert = F.lower(F.coalesce(p["alertlevel"], F.element_at(lookup(V.SEVERITY_ALERTS), severity), F.lit("green")))
    named = F.filter(F.transform(p["affectedcountries"], lambda c: c["countryname"]), lambda n: blank(n) != "")
    return F.struct(
        code.alias("event_type"),
        F.coalesce(F.element_at(lookup(V.HAZARD_LABELS), code), event_type, F.lit("Other hazard")).alias("event_label"),
        alert.alias("alert"),
        F.coalesce(F.element_at(lookup(V.ALERT_SCORES), alert), F.lit(V.ALERT_SCORES["green"])).alias("alert_score"),
        p["eventid"].alias("event_id"), p["episodeid"].alias("episode_id"),
        F.coalesce(F.nullif(p["country"], F.lit("")), F.nullif(country, F.lit("")), location).alias("country"),
        F.coalesce(named, F.array().cast("array<string>")).alias("affected_countries"),
        p["fromdate"].alias("from_date"), p["todate"].alias("to_date"), p["datemodified"].alias("modified"),
        p["severitydata"]["severitytext"].alias("severity_text"),
        F.when(code == "EQ", p["severitydata"]["severity"]).alias("magnitude"),
        F.coalesce(p["url"]["report"], source_url).alias("report_url"),
        p["url"]["geometry"].alias("geometry_url"), p["iscurrent"].alias("is_current"))
