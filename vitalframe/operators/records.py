"""Scans, predicates and clean forms of the record tables: results of tests, wearables, medications, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe import dims
from vitalframe.operators.rolling import latest_delivery
from vitalframe.operators.timestamps import normalise_timestamps
from vitalframe.operators.units import convert_units
from vitalframe.session import small


def number(text: Column) -> Column:
    """The number of a result as text, its comparison sign and thousands commas left out (a comma before
    one or two last digits is a decimal comma); null for NaN, infinities and texts that are no number."""
    bare = F.regexp_replace(F.trim(text), r"^(<=|>=|[<>=≤≥])\s*", "")
    bare = F.when(bare.rlike(r"^[+-]?\d+,\d{1,2}$"), F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    x = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


#: Columns in which a second delivery differs from the first.
DELIVERY = ("obs_id", "triage_level", "created_at")


def once(observations: DataFrame) -> DataFrame:
    """observations without second deliveries: of rows that agree in all but DELIVERY the first received counts (ties:
    the least obs_id). Counted before the shuffle, so a row delivered without end is one row of each task."""
    rest = [c for c in observations.columns if c not in DELIVERY]
    first = F.min(F.struct("created_at", "obs_id")).alias("_first")
    return observations.groupBy(*rest).agg(first).select(*rest, "_first.obs_id", "_first.created_at")


def fold(name: Column) -> Column:
    """A name by its Latin letters and digits alone; marks as N/A are empty."""
    return F.when(name.rlike(r"(?i)^\W*n\W+a\W*$"), "").otherwise(F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""))


def named(observations: DataFrame, tests: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """observations with the canonical_name of the listed test they are of: as it is where it is listed, else the one
    whose canonical name, display name or alias is folded like canonical_name, else like test_name; then, with names
    (value, entry_key: a mapping of free values, each once), what it maps canonical_name or test_name to; else null."""
    words = F.concat(F.array("canonical_name", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    labels = tests.select("canonical_name", F.explode(words).alias("l")).select("canonical_name", fold(F.col("l")).alias("f")).where("f != ''")
    one = labels.groupBy("f").agg(F.min("canonical_name").alias("e"), F.max("canonical_name").alias("_g")).where("e = _g").select("f", "e")
    listed = tests.where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("f"), F.col("canonical_name").alias("e")).distinct()
    rows = observations
    steps = [(listed, "canonical_name", F.col), (one, "canonical_name", lambda c: fold(F.col(c))), (one, "test_name", lambda c: fold(F.col(c)))]
    if names is not None:
        told = names.select(F.col("value").alias("f"), F.col("entry_key").alias("e"))
        steps += [(told, "canonical_name", F.col), (told, "test_name", F.col)]
    for i, (table, column, of) in enumerate(steps):
        rows = rows.join(small(table.select(F.col("f").alias(f"_f{i}"), F.col("e").alias(f"_e{i}"))), of(column) == F.col(f"_f{i}"), "left")
    found = F.coalesce(*[f"_e{i}" for i in range(len(steps))]).alias("canonical_name")
    return rows.select(*[c for c in observations.columns if c != "canonical_name"], found)


def results(observations: DataFrame, tests: DataFrame, factors: DataFrame, sites: DataFrame, names: DataFrame | None = None, written: bool = False) -> DataFrame:
    """The numeric results of tests that are named readably, second deliveries once, in the common unit of their test
    and by the day of their collection: (user_id, obs_id, canonical_name, test_name, value, low, high, flag, unit,
    common_unit, day, created_at, source_doc_id). low and high are the row's bounds; unit is the code of the recorded
    unit, null where none is written and the likeliest was taken: with ``written`` such rows are left out. day is null
    where the text tells none. names: as in named. Rows without a number are left out."""
    rows = convert_units(named(once(observations), tests, names), tests, factors, written=written)
    rows = rows.select("user_id", "obs_id", "canonical_name", "test_name", F.coalesce("converted", "recorded").alias("value"), F.col("common_low").alias("low"), F.col("common_high").alias("high"), "flag", F.when(F.col("unit_known"), F.col("from_unit")).alias("unit"), "common_unit", "created_at", "source_doc_id", "site_id", "date_effective")
    return collected(rows, sites).drop("site_id", "date_effective")


def collected(df: DataFrame, sites: DataFrame) -> DataFrame:
    """df (date_effective, site_id) with ``day``, the date of the collection as written or of its instant; null where
    none can be read."""
    got = normalise_timestamps(df, "date_effective", "site_id", sites)
    return got.select(*[c for c in df.columns if c != "day"], F.col("utc_date").alias("day"))


def state_of(value: Column, low: Column, high: Column) -> Column:
    """'high', 'low' or 'normal' against the bounds; a bound that is null holds."""
    return F.when(value > high, "high").when(value < low, "low").otherwise("normal")


def triage(df: DataFrame, critical: DataFrame) -> DataFrame:
    """df (canonical_name, value, low, high) with ``level``: critical beyond the critical bounds, else urgent beyond the
    row's bounds, else watch within 10 % of the range of a bound, else normal; unknown without bounds."""
    j = df.join(critical, "canonical_name", "left")
    near = 0.1 * (F.col("high") - F.col("low"))
    level = (
        F.when((F.col("value") <= F.col("critical_low")) | (F.col("value") >= F.col("critical_high")), "critical")
        .when(F.col("low").isNull() & F.col("high").isNull(), "unknown")
        .when((F.col("value") > F.col("high")) | (F.col("value") < F.col("low")), "urgent")
        .when((F.col("value") > F.col("high") - near) | (F.col("value") < F.col("low") + near), "watch")
        .otherwise("normal")
    )
    return j.withColumn("level", level).drop("critical_low", "critical_high")


def counted_days(wearables: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each user, provider and day: its last delivery (ties: the greatest id)."""
    rows = wearables.where("date IS NOT NULL").select("user_id", "provider", "date", "synced_at", "id", *columns)
    return latest_delivery(rows, ["user_id", "provider", "date"], ["synced_at", "id"], ["synced_at", "id", *columns]).drop("synced_at")


def unpivot(days: DataFrame, metrics: tuple[str, ...] = dims.WEARABLE_METRICS) -> DataFrame:
    """(user_id, provider, date, metric, value) of the metrics that have a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias("value")) for m in metrics])).alias("x")
    return days.select("user_id", "provider", "date", pairs).select("user_id", "provider", "date", "x.metric", "x.value").where("value IS NOT NULL")


def classify(text: Column, rules: list[tuple[str, str]], other: str | None) -> Column:
    """The name of the first rule whose pattern the text holds, case ignored."""
    out = None
    for name, pattern in rules:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(other))


def parse_events(events: DataFrame) -> DataFrame:
    """(event_id, user_id, day, category, severity_word, emergency) read from the raw text; a null text gives 'other',
    'unspecified' and null."""
    t = F.coalesce("raw_text", F.lit(""))
    return events.select("event_id", "user_id", F.col("date_effective").alias("day"), classify(t, dims.CATEGORIES, "other").alias("category"), classify(t, dims.SEVERITIES, "unspecified").alias("severity_word"), classify(t, dims.EMERGENCIES, None).alias("emergency"))


def medications(table: DataFrame, sites: DataFrame) -> DataFrame:
    """(user_id, med_id, drug, start_day, end_date, status, dose_mg): names lower-cased and trimmed, the start as a
    date, the dose in milligrams where its unit is a weight."""
    got = normalise_timestamps(table, "start_date", "site_id", sites)
    unit = F.lower(F.trim("unit"))
    dose = number(F.col("dose"))
    mg = F.when(unit.isin("mcg", "ug", "µg"), dose / 1000).when(unit == "mg", dose).when(unit == "g", dose * 1000)
    return got.select("user_id", "med_id", F.lower(F.trim("name")).alias("drug"), F.col("utc_date").alias("start_day"), "end_date", F.lower(F.trim("status")).alias("status"), mg.alias("dose_mg"))


def anti_new(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose keys (null equals null) are not in existing, each key once."""
    a, b = incoming.dropDuplicates(keys).alias("a"), existing.select(*keys).distinct().alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b, cond, "left_anti")


def keep_present(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of target whose key is still in source: what a stale delete leaves."""
    return target.join(source.select(key).distinct(), key, "left_semi")
