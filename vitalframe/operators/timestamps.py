"""Timestamps typed in many forms, brought to one UTC instant, or to a plain date where no time of day is given.

A text is rewritten by its form to year-month-day [time] [zone], read once, and converted. A time without zone is wall
time of the declared zone of the row's site. Where no zone is declared, the zone of the row's group (its feed, its
user) is estimated: each candidate zone's offset history is held against what the group's rows tell - no reading may
lie after its ingestion, and rows that do write their offset must agree with the history - and the candidate with the
fewest violations, then the least mean lag, is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.session import rows_of

# Minutes east of UTC of zone abbreviations that name one offset.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "IST": 330, "JST": 540,
}
# The first three letters of month names in English, German and Spanish.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mai": 5, "okt": 10, "dez": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}

_ISO = r"^(\d{4}-\d{1,2}-\d{1,2}(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)?)\s*([A-Za-z]{0,5}|[+-]\d{2}:?\d{2})$"
_NUMERIC = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?![\d./-])(.*)$"
_MONTH_FIRST = r"^([A-Za-zäÄ]{3,})\.?,? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(.*)$"
_DAY_FIRST = r"^(?:[A-Za-z]{2,}\.?, ?)?(\d{1,2})(?:\.|st|nd|rd|th)? ([A-Za-zäÄ]{3,})\.?,? (\d{4})(.*)$"
_MONTH_ONLY = r"^([A-Za-zäÄ]{3,})\.?,? (\d{4})$"


def _fence(df: DataFrame, drop: tuple[str, ...] = (), **cols: Column) -> DataFrame:
    """df with cols, computed once: later filters and projections do not repeat their expressions."""
    return df.select(*[c for c in df.columns if c not in drop], F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _lit_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def parse_timestamps(df: DataFrame, text: str, date_order: Column) -> DataFrame:
    """df with ``_local`` (timestamp_ntz as written, or of the epoch), ``_timed`` (a time of day is given), ``_epoch``
    (seconds or milliseconds since 1970) and ``_offset`` (minutes east of UTC written, null if none). _local is null
    where the text is null, blank or no date. date_order ('mdy' or 'dmy') says how all-numeric dates that do not begin
    with the year are read; if the month so read is above 12, or the order is null, the other reading is taken."""
    t = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    df = df.withColumn("_t", t)
    t = F.col("_t")
    mdy = F.regexp_replace(t, _NUMERIC, "$3-$1-$2$4")
    dmy = F.regexp_replace(t, _NUMERIC, "$3-$2-$1$4")
    first, second = F.regexp_extract(t, _NUMERIC, 1).cast("int"), F.regexp_extract(t, _NUMERIC, 2).cast("int")
    month_is_first = ((date_order == "mdy") & (first <= 12)) | ((F.coalesce(date_order, F.lit("dmy")) != "mdy") & (second > 12))
    numeric = F.when(month_is_first, mdy).otherwise(dmy)
    number_of = lambda name: F.element_at(_lit_map(MONTHS), F.lower(F.substring(name, 1, 3)))
    worded = lambda form, month, day: F.concat(F.regexp_extract(t, form, 3), F.lit("-"), number_of(F.regexp_extract(t, form, month)), F.lit("-"), F.regexp_extract(t, form, day), F.regexp_extract(t, form, 4))
    plain = (
        F.when(t.rlike(r"^\d{4}-\d{1,2}-"), t)
        .when(t.rlike(r"^(\d{10}|\d{13})$"), F.lit(None))
        .when(t.rlike(r"^\d{14}"), F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", "$1-$2-$3 $4:$5:$6"))
        .when(t.rlike(r"^(19|20)\d{6}$"), F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3"))
        .when(t.rlike(r"^(19|20)\d{10}$"), F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5"))
        .when(t.rlike(r"^\d{1,2}[./-]"), F.regexp_replace(numeric, r"^(\d\d)-", "20$1-"))
        .when(t.rlike(r"^\d{4}[./]\d{1,2}[./]\d{1,2}"), F.regexp_replace(t, r"^(\d{4})[./](\d{1,2})[./](\d{1,2})", "$1-$2-$3"))
        .when(t.rlike(r"^(\d{4})-(\d{1,2})$"), F.concat(t, F.lit("-1")))
        .when(t.rlike(r"^(19|20)\d{2}$"), F.concat(t, F.lit("-1-1")))
        .when(t.rlike(_MONTH_FIRST), worded(_MONTH_FIRST, 1, 2))
        .when(t.rlike(_DAY_FIRST), worded(_DAY_FIRST, 2, 1))
        .when(t.rlike(_MONTH_ONLY), F.concat(F.regexp_extract(t, _MONTH_ONLY, 2), F.lit("-"), number_of(F.regexp_extract(t, _MONTH_ONLY, 1)), F.lit("-1")))
    )
    df = _fence(df, _plain=F.trim(plain))
    p = F.col("_plain")
    df = _fence(df, ("_plain",), _wall=F.regexp_replace(F.regexp_extract(p, _ISO, 1), ",", "."), _rest=F.upper(F.regexp_extract(p, _ISO, 2)))
    wall, rest = F.col("_wall"), F.col("_rest")
    stamp = F.expr("try_cast(_wall AS timestamp_ntz)")
    hour = F.hour(stamp)
    shift = F.when((rest == "PM") & (hour < 12), F.lit(12)).when((rest == "AM") & (hour == 12), F.lit(-12)).otherwise(F.lit(0))
    signed = F.when(rest.rlike("^[+-]"), F.concat(F.substring(rest, 1, 1), F.lit("1")).cast("int") * (F.expr("try_cast(substring(_rest, 2, 2) AS int)") * 60 + F.expr("try_cast(right(_rest, 2) AS int)")))
    offset = F.when(rest.isin("", "AM", "PM"), F.lit(None).cast("int")).otherwise(F.coalesce(signed, F.expr("try_element_at(map(" + ", ".join(f"'{k}', {v}" for k, v in ABBREVIATIONS.items()) + "), _rest)")))
    known = rest.isin("", "AM", "PM") | offset.isNotNull()
    halves = ~rest.isin("AM", "PM") | hour.between(1, 12)
    epoch = t.rlike(r"^(\d{10}|\d{13})$")
    micros = F.expr("try_cast(_t AS bigint)") * F.when(F.length(t) == 10, F.lit(1_000_000)).otherwise(F.lit(1000))
    from_epoch = F.expr("timestampadd(MICROSECOND, _us, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    df = df.withColumn("_us", F.when(epoch, micros))
    return _fence(
        df, ("_t", "_wall", "_rest", "_us"),
        _local=F.when(epoch, from_epoch).when(known & halves, F.timestamp_add("HOUR", shift, stamp)),
        _timed=epoch | wall.contains(":"), _epoch=epoch, _offset=F.when(epoch, F.lit(0)).otherwise(offset),
    )


def _utc(zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), F.col("_local"))


def zone_evidence(parsed: DataFrame, group: list[str], ingested: str | None, zones: list[str], sequence: str | None = None, run: int = 4096) -> DataFrame:
    """For each group its best zone: ``_zone``, ``_violations`` and ``_evidence`` (rows that could speak). parsed: from
    parse_timestamps; groups without evidence get no row.

    A zone is violated by a row that would lie after its ingestion, by one that writes another offset than the zone's
    (offset 0, as of times stamped in UTC anywhere, says nothing), and, with a sequence (a number that grows as the records do), by one that would lie before the last known instant
    before it, or after the next one behind it. Neighbours are looked for in runs of ``run`` numbers of the sequence,
    so that a group of any size is spread over tasks. Every row is held against every zone and summed before the
    shuffle, so the number of zones is not bounded.
    """
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")
    told = F.col("_offset").isNotNull() & F.col("_local").isNotNull()
    open_ = F.col("_offset").isNull() & F.col("_timed") & F.col("_local").isNotNull()
    df = parsed.withColumn("_known", F.when(told, us("_local") - F.col("_offset").cast("bigint") * 60_000_000))
    # The wall clock of the ingestion in UTC, whatever the session's time zone.
    taken = F.lit(None).cast("bigint") if not ingested else F.expr(f"unix_micros(`{ingested}`)") if dict(parsed.dtypes)[ingested] == "timestamp" else us(f"CAST(`{ingested}` AS TIMESTAMP_NTZ)")
    after, before = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    if sequence:
        w = Window.partitionBy(*group, "_run").orderBy(sequence)
        df = df.withColumn("_run", F.floor(F.col(sequence) / run))
        after = F.max(F.when(F.col(sequence).isNotNull(), F.col("_known"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        before = F.min(F.when(F.col(sequence).isNotNull(), F.col("_known"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    df = df.select(*group, "_local", "_known", F.when(open_, taken).alias("_taken"), after.alias("_after"), before.alias("_before"), open_.alias("_open"), (told & ~F.col("_epoch") & (F.col("_offset") != 0)).alias("_told"))
    speaks = F.col("_told") | (F.col("_open") & F.coalesce("_taken", "_after", "_before").isNotNull())
    df = df.where(speaks).select("*", F.explode(F.array(*[F.lit(z) for z in zones])).alias("_zone"))
    df = df.select("*", F.inline(F.array(F.struct(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', convert_timezone(_zone, 'UTC', _local))").alias("_at")))))
    at = F.col("_at")
    wrong = F.when(F.col("_told"), at != F.col("_known")).otherwise(F.coalesce(at > F.col("_taken"), F.lit(False)) | F.coalesce(at < F.col("_after"), F.lit(False)) | F.coalesce(at > F.col("_before"), F.lit(False)))
    lag = F.when(F.col("_open") & (F.col("_taken") >= at), (F.col("_taken") - at) / 1e6)
    got = df.groupBy(*group, "_zone").agg(F.count("*").alias("e"), F.count_if(wrong).alias("v"), F.coalesce(F.avg(lag), F.lit(0.0)).alias("lag"))
    best = F.min(F.struct("v", "lag", "_zone", "e")).alias("_b")
    return got.groupBy(*group).agg(best).select(*group, F.col("_b._zone").alias("_zone"), F.col("_b.v").alias("_violations"), F.col("_b.e").alias("_evidence"))


def normalise_timestamps(df: DataFrame, text: str, site: str, sites: DataFrame, ingested: str | None = None, group: list[str] | None = None, sequence: str | None = None) -> DataFrame:
    """df with ``utc_time`` (timestamp_ntz in UTC, null unless a time of day is given), ``utc_date`` (its date, or the
    date written), ``written_date``, ``is_instant``, ``is_epoch`` and ``zone_from`` ('text', 'site', 'estimate' or
    'none').

    sites: (site_id, tz, date_order), at most BROADCAST_ROWS rows, else ValueError. A repeated hour means the earlier
    instant; a skipped time moves forward by the hour skipped. A month or year means its first day. Where the text has a
    time and neither it nor its site names a zone, the zone is estimated by group, with ingested, sequence or both (see
    zone_evidence); without group, or without evidence, the time is taken as UTC and zone_from is 'none'. Null, blank
    and undated texts give null. Existing columns keep their names; new ones replace columns of the same name.
    """
    added = {"utc_time", "utc_date", "written_date", "is_instant", "is_epoch", "zone_from"}
    kept = [c for c in df.columns if c not in added]
    spark = df.sparkSession
    listed = {r[0]: (r[1] or None, r[2]) for r in rows_of(sites.where("site_id IS NOT NULL").select("site_id", "tz", F.lower("date_order")).orderBy(F.desc("site_id"), F.desc("tz")))}
    dim = spark.createDataFrame([(k, *v) for k, v in listed.items()], f"_site {dict(sites.dtypes)['site_id']}, _tz string, _order string")
    joined = df.join(F.broadcast(dim), F.col(site) == F.col("_site"), "left")
    parsed = parse_timestamps(joined, text, F.col("_order"))
    zones = sorted({z for z, _ in listed.values() if z})
    # Only the sites that rows name are looked at for missing zones, not the rows' texts.
    if group and zones and joined.where("_tz IS NULL").select(site).distinct().limit(1).count():
        lost = parse_timestamps(joined.where("_tz IS NULL"), text, F.col("_order"))
        estimate = zone_evidence(lost, group, ingested, zones, sequence).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_zone").alias("_guess"))
        on = F.col("_tz").isNull()
        for i, g in enumerate(group):
            on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        parsed = parsed.join(estimate, on, "left")
    else:
        parsed = parsed.withColumn("_guess", F.lit(None).cast("string"))
    zone = F.coalesce("_tz", "_guess", F.lit("UTC"))
    instant = F.when(~F.col("_timed"), F.lit(None)).when(F.col("_offset").isNotNull(), F.timestamp_add("MINUTE", -F.col("_offset"), F.col("_local"))).otherwise(_utc(zone))
    timed = F.col("_timed") & F.col("_local").isNotNull()
    return _fence(parsed, _instant=instant).select(
        *kept, F.col("_instant").alias("utc_time"), F.coalesce(F.col("_instant"), F.col("_local")).cast("date").alias("utc_date"), F.when(~F.col("_epoch"), F.col("_local").cast("date")).alias("written_date"),
        timed.alias("is_instant"), (F.col("_epoch") & F.col("_local").isNotNull()).alias("is_epoch"),
        F.when(~timed, F.lit("none")).when(F.col("_offset").isNotNull(), F.lit("text")).when(F.col("_tz").isNotNull(), F.lit("site")).when(F.col("_guess").isNotNull(), F.lit("estimate")).otherwise(F.lit("none")).alias("zone_from"),
    )
