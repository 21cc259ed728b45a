"""Queries of the general problems: rolling totals, timestamps, units, spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.operators.rolling import rolling_totals
from vitalframe.operators.spikes import flag_readings
from vitalframe.operators.timestamps import normalise_timestamps, parse_timestamps, zone_evidence
from vitalframe.operators.units import convert_units
from vitalframe.plans import sql
from vitalframe.session import rows_of, small
from vitalframe.tables import Tables

SLEEP_METRICS = ["sleep_duration_min", "recovery_score"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    days = rolling_totals(t.clean_wearable_daily, ["user_id", "provider"], "date", SLEEP_METRICS, (7, 30), ("sum",), "synced_at")
    case = days.where(F.round(60 * F.col("total_7") - 7 * F.col("total_30"), 6) < 0)
    return case.select("user_id", "provider", F.date_format("day", "yyyy-MM-dd").alias("activity_date"), "metric")


def p3_rolling(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    days = rolling_totals(t.clean_wearable_daily, ["user_id", "provider"], "date", SLEEP_METRICS, (7, 30), ("sum", "max"), "synced_at")
    r = lambda c: F.round(c, 6).alias(c)
    return days.select("user_id", "provider", "day", "metric", r("total_7"), r("avg_7"), "max_7", r("total_30"), r("avg_30"), "max_30")


_P3_DAYS = """
counted AS (
  SELECT user_id, provider, date AS day, sleep_duration_min::DOUBLE AS sleep_duration_min, recovery_score
  FROM clean_wearable_daily WHERE date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, provider, date ORDER BY synced_at DESC NULLS LAST, sleep_duration_min DESC NULLS LAST, recovery_score DESC NULLS LAST) = 1),
span AS (SELECT user_id, provider, min(day) AS a, max(day) AS b FROM counted GROUP BY ALL),
grid AS (SELECT user_id, provider, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM span),
long AS (
  SELECT g.user_id, g.provider, g.day, m.metric, CASE m.metric WHEN 'sleep_duration_min' THEN c.sleep_duration_min ELSE c.recovery_score END AS x
  FROM grid g LEFT JOIN counted c ON c.user_id IS NOT DISTINCT FROM g.user_id AND c.provider IS NOT DISTINCT FROM g.provider AND c.day = g.day
  CROSS JOIN (VALUES ('sleep_duration_min'), ('recovery_score')) m(metric)),
rolled AS (
  SELECT user_id, provider, day, metric, sum(coalesce(x, 0)) OVER w7 AS t7, sum(coalesce(x, 0)) OVER w30 AS t30, max(x) OVER w7 AS max_7, max(x) OVER w30 AS max_30
  FROM long WINDOW w7 AS (PARTITION BY user_id, provider, metric ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                   w30 AS (PARTITION BY user_id, provider, metric ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""


def p4_times(spark: SparkSession, folder: str) -> DataFrame:
    """Every dated record of the three tables with its instant or date. Where a site declared no zone, one is estimated
    for the records of the user in each table by their ingestion times and the offsets that other records write;
    documents have no ingestion times, and their ids do not follow their dates, so they have the written offsets."""
    t = Tables(spark, folder)
    rows = (
        t.clean_observations.select(F.lit("clean_observations").alias("record_table"), F.col("obs_id").alias("record_id"), F.col("date_effective").alias("text"), "site_id", "user_id", F.col("created_at").alias("seen"))
        .unionByName(t.clean_medications.select(F.lit("clean_medications").alias("record_table"), F.col("med_id").alias("record_id"), F.col("start_date").alias("text"), "site_id", "user_id", F.col("created_at").alias("seen")))
        .unionByName(t.documents.select(F.lit("documents").alias("record_table"), F.col("doc_id").cast("string").alias("record_id"), F.col("received_at").alias("text"), "site_id", "user_id", F.lit(None).cast("timestamp").alias("seen")))
    )
    got = normalise_timestamps(rows, "text", "site_id", t.dim_sites, "seen", ["record_table", "user_id"])
    return got.select("record_table", "record_id", "utc_time", "utc_date", "written_date", "is_instant", "is_epoch", "zone_from")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    case = F.col("is_epoch") | (F.col("is_instant") & (F.col("utc_date") != F.col("written_date")))
    return p4_times(spark, folder).where(case).select("record_table", "record_id", F.date_format("utc_date", "yyyy-MM-dd").alias("utc_date"))


def p4_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zone that the rows of each site speak for, estimated without looking at the declared one."""
    t = Tables(spark, folder)
    sites = t.dim_sites
    zones = [r[0] for r in rows_of(sites.where("tz IS NOT NULL").select("tz").distinct().orderBy("tz"))]
    order = small(sites.select("site_id", "date_order"))
    parsed = parse_timestamps(t.clean_observations.select("site_id", "date_effective", "created_at").join(order, "site_id"), "date_effective", F.col("date_order"))
    guess = zone_evidence(parsed, ["site_id"], "created_at", zones)
    return guess.join(sites.select("site_id", "tz"), "site_id").select("site_id", F.col("tz").alias("declared_tz"), F.col("_zone").alias("estimated_tz"), F.col("_violations").alias("violations"), F.col("_evidence").alias("evidence"))


def _converted(t: Tables, written: bool = False) -> DataFrame:
    rows = t.clean_observations.select("obs_id", "canonical_name", "value", "value_text", "unit", "reference_low", "reference_high", "reference_text")
    return convert_units(rows, t.dim_tests, t.dim_unit_factors, written=written)


def p6_converted(spark: SparkSession, folder: str) -> DataFrame:
    return _converted(Tables(spark, folder)).select("obs_id", "canonical_name", "recorded", "from_unit", "converted", "common_unit", "unit_known", "posterior", "uncertain")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    # Other spellings of the common unit, and units that convert into it unchanged, leave the number as it is.
    changed = ((F.col("unit_factor") != 1) | (F.col("unit_shift") != 0)) & (F.col("converted") != F.col("recorded"))
    return _converted(Tables(spark, folder)).where(changed).select("obs_id", "from_unit")


def p7_flagged(spark: SparkSession, folder: str) -> DataFrame:
    return flag_readings(Tables(spark, folder).clean_wearable_daily, ["user_id", "provider"], "id", "date", "synced_at")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_flagged(spark, folder).select("id", "metric")


def p6_written(spark: SparkSession, folder: str) -> DataFrame:
    """The results whose unit is written, as p6_converted: what SQL can state of it."""
    return _converted(Tables(spark, folder), True).select("obs_id", "canonical_name", "recorded", "from_unit", F.round("converted", 6).alias("converted"), "common_unit", F.round("common_low", 6).alias("common_low"), F.round("common_high", 6).alias("common_high"))


QUERIES = {"p3_found": p3_found, "p3_rolling": p3_rolling, "p4_found": p4_found, "p4_times": p4_times, "p4_zones": p4_zones, "p6_found": p6_found, "p6_converted": p6_converted, "p6_written": p6_written, "p7_found": p7_found, "p7_flagged": p7_flagged}

_P4 = f"""
given AS (SELECT 'clean_observations' AS record_table, obs_id AS record_id, date_effective AS text, site_id, created_at FROM clean_observations UNION ALL SELECT 'clean_medications', med_id, start_date, site_id, created_at FROM clean_medications
  UNION ALL SELECT 'documents', doc_id::VARCHAR, received_at, site_id, NULL FROM documents),
{sql.stamps('given')}"""
_ZONES = f"""
of_sites AS (SELECT date_effective AS text, site_id, created_at FROM clean_observations JOIN dim_sites USING (site_id)), {sql.stamps('of_sites')},
zones AS (SELECT DISTINCT tz AS zone FROM dim_sites WHERE tz IS NOT NULL),
held AS (SELECT site_id, zone, off, is_epoch, wall_time, timezone('UTC', created_at) AS seen, {sql.wall_to_utc('wall_time', 'zone')} AS moved FROM stamps, zones WHERE wall_time IS NOT NULL AND ((off IS NOT NULL AND NOT is_epoch AND off <> 0) OR (off IS NULL AND is_instant AND created_at IS NOT NULL))),
scored AS (SELECT site_id, zone, count(*) AS e, count(*) FILTER (CASE WHEN off IS NOT NULL THEN moved <> wall_time - to_minutes(off) ELSE moved > seen END) AS v, coalesce(avg(CASE WHEN off IS NULL AND seen >= moved THEN epoch_us(seen - moved) / 1e6 END), 0) AS lag FROM held GROUP BY ALL)"""
# What the checked candidates of the filter amount to: far from the series' ordinary level, impossible, or stuck.
_P7 = """
given AS (SELECT w.*, coalesce(date, DATE '1900-01-01') AS d FROM clean_wearable_daily w),
counted AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY user_id, provider, d ORDER BY synced_at DESC NULLS LAST, id DESC NULLS LAST) = 1),
metrics AS (SELECT * FROM (VALUES ('hrv', 0.5), ('rhr', 0.3), ('spo2', 0.15), ('skin_temp', 0.05)) m(metric, floor)),
long AS (SELECT user_id, provider, d, metric, floor, CASE metric WHEN 'hrv' THEN hrv WHEN 'rhr' THEN rhr WHEN 'spo2' THEN spo2 ELSE skin_temp END AS y FROM counted, metrics),
middle AS (SELECT user_id, provider, metric, floor, median(y) AS m FROM long WHERE y IS NOT NULL GROUP BY ALL),
bounds AS (SELECT *, CASE metric WHEN 'hrv' THEN 1e-9 WHEN 'rhr' THEN 20 WHEN 'spo2' THEN 40 ELSE CASE WHEN m >= 55 THEN 59 WHEN m >= 15 THEN 15 ELSE -12 END END AS low, CASE metric WHEN 'hrv' THEN 400 WHEN 'rhr' THEN 250 WHEN 'spo2' THEN 100 ELSE CASE WHEN m >= 55 THEN 113 WHEN m >= 15 THEN 45 ELSE 12 END END AS high FROM middle),
good AS (SELECT l.user_id, l.provider, l.metric, l.y FROM long l JOIN bounds b ON b.user_id IS NOT DISTINCT FROM l.user_id AND b.provider IS NOT DISTINCT FROM l.provider AND b.metric = l.metric WHERE y BETWEEN low AND high),
level AS (SELECT user_id, provider, metric, median(y) AS level, mad(y) AS mad FROM good GROUP BY ALL),
limits AS (SELECT b.*, level, greatest(1.4826 * mad, floor) AS spread FROM bounds b LEFT JOIN level v ON v.user_id IS NOT DISTINCT FROM b.user_id AND v.provider IS NOT DISTINCT FROM b.provider AND v.metric = b.metric),
runs AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY user_id, provider, metric, y ORDER BY d) AS k FROM long WHERE y IS NOT NULL WINDOW w AS (PARTITION BY user_id, provider, metric ORDER BY d)),
still AS (SELECT user_id, provider, metric, d, y, count(*) OVER (PARTITION BY user_id, provider, metric, y, k) AS n FROM runs),
readings AS (SELECT id, user_id, provider, d, metric, CASE metric WHEN 'hrv' THEN hrv WHEN 'rhr' THEN rhr WHEN 'spo2' THEN spo2 ELSE skin_temp END AS reading FROM given, metrics),
judged AS (SELECT r.id, r.metric, CASE WHEN reading < low OR reading > high THEN 'impossible' WHEN abs(reading - level) > 6.5 * spread THEN 'spike' WHEN s.n >= 6 AND reading = s.y THEN 'stuck' END AS reason, reading FROM readings r
  JOIN limits l ON l.user_id IS NOT DISTINCT FROM r.user_id AND l.provider IS NOT DISTINCT FROM r.provider AND l.metric = r.metric
  LEFT JOIN still s ON s.user_id IS NOT DISTINCT FROM r.user_id AND s.provider IS NOT DISTINCT FROM r.provider AND s.metric = r.metric AND s.d = r.d WHERE reading IS NOT NULL)"""

SQL = {
    "p3_found": f"WITH {_P3_DAYS} SELECT user_id, provider, strftime(day, '%Y-%m-%d') AS activity_date, metric FROM rolled WHERE round(60 * t7 - 7 * t30, 6) < 0",
    "p3_rolling": f"WITH {_P3_DAYS} SELECT user_id, provider, day, metric, round(t7, 6) AS total_7, round(t7 / 7, 6) AS avg_7, max_7, round(t30, 6) AS total_30, round(t30 / 30, 6) AS avg_30, max_30 FROM rolled",
    "p4_times": f"WITH {_P4} SELECT record_table, record_id, utc_time, utc_date, written_date, is_instant, is_epoch, zone_from FROM stamps",
    "p4_found": f"WITH {_P4} SELECT record_table, record_id, strftime(utc_date, '%Y-%m-%d') AS utc_date FROM stamps WHERE is_epoch OR (is_instant AND utc_date <> written_date)",
    "p4_zones": f"WITH {_ZONES} SELECT site_id, tz AS declared_tz, arg_min(zone, (v, lag, zone)) AS estimated_tz, arg_min(v, (v, lag, zone)) AS violations, arg_min(e, (v, lag, zone)) AS evidence FROM scored JOIN dim_sites USING (site_id) GROUP BY ALL",
    "p6_written": f"WITH {sql.converted('clean_observations')} SELECT obs_id, canonical_name, recorded, from_unit, round(converted, 6) AS converted, common_unit, round(common_low, 6) AS common_low, round(common_high, 6) AS common_high FROM converted",
    "p7_flagged": f"WITH {_P7} SELECT * FROM judged WHERE reason IS NOT NULL",
    "p7_found": f"WITH {_P7} SELECT id, metric FROM judged WHERE reason IS NOT NULL",
}
