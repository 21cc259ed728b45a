"""Queries over the record tables, each with the SQL that gives the same rows.

Results are read once delivered, named by the listed tests, converted to the common unit and dated by their collection.
The queries with SQL take the results whose unit is written; the same analyses named *_whole also take those whose unit
is missing, in the likeliest one, which SQL cannot state. The as-of day is the newest day in the data, never the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe import dims
from vitalframe.operators import records, series
from vitalframe.plans import sql
from vitalframe.session import cut
from vitalframe.tables import Tables


def utc_day(column: str):  # noqa: ANN201
    return F.expr(f"date_from_unix_date(CAST(floor(unix_seconds(`{column}`) / 86400) AS INT))")


class Whole(Tables):
    """Tables whose results are also those without a written unit, in the likeliest one, and those whose day can't be
    read, which come last."""

    def names(self) -> DataFrame | None:
        """A mapping of free values to tests, for tables that have one."""
        return None


def _results(t: Tables) -> DataFrame:
    whole = isinstance(t, Whole)
    got = records.results(t.clean_observations, t.dim_tests, t.dim_unit_factors, t.dim_sites, t.names() if whole else None, not whole)
    return got if whole else got.where("day IS NOT NULL")


def _dated(t: Tables) -> DataFrame:
    return _results(t).where("day IS NOT NULL")


def _long(t: Tables) -> DataFrame:
    return records.unpivot(records.counted_days(t.clean_wearable_daily, list(dims.WEARABLE_METRICS)))


def _meds(t: Tables) -> DataFrame:
    return records.medications(t.clean_medications, t.dim_sites).withColumn("drug", F.regexp_replace("drug", " xr$", ""))


def r4(c: str):  # noqa: ANN201
    return F.round(c, 4).alias(c)


_RES = sql.RESULTS
_DAYS = """
days AS (SELECT * FROM clean_wearable_daily WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, provider, date ORDER BY synced_at DESC NULLS LAST, id DESC NULLS LAST) = 1),
long AS (""" + " UNION ALL ".join(f"SELECT user_id, provider, date, '{m}' AS metric, {m}::DOUBLE AS value FROM days WHERE {m} IS NOT NULL" for m in dims.WEARABLE_METRICS) + ")"
_MEDS = sql.MEDICATIONS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(spark, folder))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if text:
            SQL[f.__name__] = text
        return f

    return add


@query(f"WITH {_RES} SELECT user_id, canonical_name, obs_id, day, value FROM last")
def latest_per_test(t: Tables) -> DataFrame:
    return series.latest(_results(t)).select("user_id", "canonical_name", "obs_id", "day", "value")


_PREV = """lagged AS (SELECT *, lead(value) OVER w AS prev_value, lead(day) OVER w AS prev_day, lead(low) OVER w AS prev_low, lead(high) OVER w AS prev_high, row_number() OVER w AS r
  FROM res WINDOW w AS (PARTITION BY user_id, canonical_name ORDER BY day DESC, obs_id DESC)),
pair AS (SELECT *, CASE WHEN prev_value <> 0 THEN (value - prev_value) / abs(prev_value) * 100 END AS pct_change FROM lagged WHERE r = 1)"""


@query(f"WITH {_RES}, {_PREV} SELECT user_id, canonical_name, day, value, prev_day, prev_value, round(pct_change, 6) AS pct_change FROM pair")
def latest_and_previous(t: Tables) -> DataFrame:
    return series.latest_and_previous(_dated(t)).select("user_id", "canonical_name", "day", "value", "prev_day", "prev_value", F.round("pct_change", 6).alias("pct_change"))


@query(f"WITH {_RES}, {_PREV} SELECT user_id, p.canonical_name, value, prev_value, round(pct_change, 4) AS pct_change FROM pair p JOIN {dims.values(dims.RAPID, 'd', 'canonical_name, bound')} USING (canonical_name) WHERE abs(pct_change) >= bound")
def rapid_changes(t: Tables) -> DataFrame:
    rules = dims.frame(t.spark, dims.RAPID, "canonical_name string, bound double")
    return series.latest_and_previous(_dated(t)).join(rules, "canonical_name").where(F.abs("pct_change") >= F.col("bound")).select("user_id", "canonical_name", "value", "prev_value", r4("pct_change"))


@query(f"""WITH {_RES}, {_PREV} SELECT user_id, canonical_name, value, prev_value, CASE WHEN value > high THEN 'high' ELSE 'low' END AS state FROM pair
WHERE (prev_low IS NOT NULL OR prev_high IS NOT NULL) AND NOT coalesce(prev_value > prev_high, false) AND NOT coalesce(prev_value < prev_low, false) AND prev_value IS NOT NULL AND (value > high OR value < low)""")
def threshold_crossings(t: Tables) -> DataFrame:
    p = series.latest_and_previous(_dated(t))
    was = records.state_of(F.col("prev_value"), F.col("prev_low"), F.col("prev_high"))
    now = records.state_of(F.col("value"), F.col("low"), F.col("high"))
    ok = F.col("prev_value").isNotNull() & (F.col("prev_low").isNotNull() | F.col("prev_high").isNotNull()) & (was == "normal") & (now != "normal")
    return p.where(ok).select("user_id", "canonical_name", "value", "prev_value", now.alias("state"))


_TRIAGE = f"""leveled AS (SELECT r.*, CASE WHEN value <= critical_low OR value >= critical_high THEN 'critical' WHEN low IS NULL AND high IS NULL THEN 'unknown' WHEN value > high OR value < low THEN 'urgent'
  WHEN value > high - 0.1 * (high - low) OR value < low + 0.1 * (high - low) THEN 'watch' ELSE 'normal' END AS level FROM res r LEFT JOIN {dims.values(dims.CRITICAL, 'c', 'canonical_name, critical_low, critical_high')} USING (canonical_name))"""


def _leveled(t: Tables) -> DataFrame:
    return records.triage(_results(t), dims.frame(t.spark, dims.CRITICAL, "canonical_name string, critical_low double, critical_high double"))


@query(f"WITH {_RES}, {_TRIAGE} SELECT canonical_name, level, count(*) AS results, count(DISTINCT user_id) AS users FROM leveled GROUP BY ALL")
def triage_counts(t: Tables) -> DataFrame:
    return _leveled(t).groupBy("canonical_name", "level").agg(F.count("*").alias("results"), F.countDistinct("user_id").alias("users"))


@query(f"WITH {_RES}, {_TRIAGE} SELECT user_id, obs_id, canonical_name, value FROM leveled WHERE level = 'critical'")
def critical_alerts(t: Tables) -> DataFrame:
    return _leveled(t).where("level = 'critical'").select("user_id", "obs_id", "canonical_name", "value")


def _trend_sql(source: str, keys: str, at: str, tie: str, least: int) -> str:
    return f"""agg AS (SELECT {keys}, count(*) AS n, regr_slope(value, ({at} - DATE '1970-01-01')::DOUBLE) AS slope, CASE WHEN var_pop(value) = 0 THEN 0.0 ELSE regr_r2(value, ({at} - DATE '1970-01-01')::DOUBLE) END AS r2,
  arg_min(value, ({at}, {tie})) AS first_value, arg_max(value, ({at}, {tie})) AS last_value, min({at}) AS first_day, max({at}) AS last_day FROM {source} GROUP BY ALL),
trend AS (SELECT *, CASE WHEN first_value <> 0 THEN (last_value - first_value) / abs(first_value) * 100 ELSE last_value - first_value END AS pct_change FROM agg WHERE n >= {least} AND first_day < last_day),
told AS (SELECT *, CASE WHEN abs(pct_change) < 5 OR r2 < 0.1 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM trend)"""


def _told(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", F.round("slope", 6).alias("slope"), r4("r2"), "first_value", "last_value", r4("pct_change"), "direction")


_TOLD = "n, round(slope, 6) AS slope, round(r2, 4) AS r2, first_value, last_value, round(pct_change, 4) AS pct_change, direction FROM told"


@query(f"WITH {_RES}, {_trend_sql('res', 'user_id, canonical_name', 'day', 'obs_id', 3)} SELECT user_id, canonical_name, {_TOLD}")
def lab_trends(t: Tables) -> DataFrame:
    return _told(series.trend(_results(t), ("user_id", "canonical_name"), "day", "value", 3), "user_id", "canonical_name")


@query(f"WITH {_DAYS}, {_trend_sql('long', 'user_id, provider, metric', 'date', '0', 5)} SELECT user_id, provider, metric, {_TOLD}")
def wearable_trends(t: Tables) -> DataFrame:
    return _told(series.trend(_long(t), ("user_id", "provider", "metric"), "date", "value", 5), "user_id", "provider", "metric")


@query(f"""WITH {_DAYS}, based AS (SELECT l.*, rule, bound, severity, avg(value) OVER w AS baseline, count(value) OVER w AS n FROM long l JOIN {dims.values(dims.ANOMALIES, 'd', 'metric, rule, bound, severity')} USING (metric)
  WINDOW w AS (PARTITION BY user_id, provider, metric ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
moved AS (SELECT *, CASE WHEN baseline <> 0 THEN (value - baseline) / abs(baseline) * 100 END AS pct FROM based WHERE n >= 3)
SELECT user_id, provider, date, metric, value, round(baseline, 4) AS baseline, round(pct, 4) AS pct, severity FROM moved
WHERE (rule = 'pct_below' AND pct < -bound) OR (rule = 'pct_above' AND pct > bound) OR (rule = 'below' AND value < bound) OR (rule = 'above' AND value > bound)""")
def rolling_anomalies(t: Tables) -> DataFrame:
    rules = dims.frame(t.spark, dims.ANOMALIES, "metric string, rule string, bound double, severity string")
    return series.rolling_anomalies(_long(t), rules).select("user_id", "provider", "date", "metric", "value", r4("baseline"), r4("pct"), "severity")


@query(f"""WITH {_RES}, {_DAYS}, a AS (SELECT user_id, canonical_name, day, avg(value) AS x FROM res GROUP BY ALL), b AS (SELECT user_id, metric, date AS day, avg(value) AS y FROM long GROUP BY ALL),
g AS (SELECT user_id, canonical_name, metric, count(*) AS n, CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END AS r FROM a JOIN b USING (user_id, day) GROUP BY ALL)
SELECT user_id, canonical_name, metric, n, round(r, 4) AS r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'none' END AS strength FROM g WHERE n >= 5 AND abs(r) > 0.3""")
def lab_wearable_correlations(t: Tables) -> DataFrame:
    return series.correlations(_dated(t), _long(t)).select("user_id", "canonical_name", "metric", "n", r4("r"), "strength")


@query(f"""WITH {_RES}, d AS (SELECT user_id, canonical_name, day, arg_max(value, obs_id) AS value FROM res GROUP BY ALL), k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM d),
n AS (SELECT * FROM k WHERE r = 1 AND user_id IN (SELECT user_id FROM k WHERE r = 2)), p AS (SELECT * FROM k WHERE r = 2),
j AS (SELECT coalesce(n.user_id, p.user_id) AS user_id, coalesce(n.canonical_name, p.canonical_name) AS canonical_name, n.value AS value, p.value AS prev_value FROM n FULL JOIN p ON n.user_id = p.user_id AND n.canonical_name = p.canonical_name),
c AS (SELECT *, CASE WHEN prev_value <> 0 THEN (value - prev_value) / abs(prev_value) * 100 END AS pct FROM j)
SELECT user_id, canonical_name, value, prev_value, round(pct, 4) AS pct, CASE WHEN prev_value IS NULL THEN 'new' WHEN value IS NULL THEN 'resolved' WHEN coalesce(abs(pct), 0) < 3 THEN 'stable' WHEN value > prev_value THEN 'up' ELSE 'down' END AS change FROM c""")
def panel_delta(t: Tables) -> DataFrame:
    return series.panel_delta(cut(_dated(t))).select("user_id", "canonical_name", "value", "prev_value", r4("pct"), "change")


_DRUGS = dims.values(dims.DRUG_TESTS, "d", "drug, canonical_name, wanted")


def _drugs(t: Tables) -> DataFrame:
    return dims.frame(t.spark, dims.DRUG_TESTS, "drug string, canonical_name string, wanted string")


@query(f"""WITH {_RES}, {_MEDS}, m AS (SELECT user_id, med_id, drug, start_day, canonical_name, wanted FROM meds JOIN {_DRUGS} USING (drug) WHERE start_day IS NOT NULL),
g AS (SELECT m.user_id, med_id, drug, m.canonical_name, wanted, arg_max(value, (day, obs_id)) FILTER (day < start_day) AS before, arg_max(value, (day, obs_id)) FILTER (day >= start_day) AS after FROM m JOIN res r ON r.user_id = m.user_id AND r.canonical_name = m.canonical_name GROUP BY ALL),
p AS (SELECT *, (after - before) / abs(before) * 100 AS pct FROM g WHERE before IS NOT NULL AND after IS NOT NULL AND before <> 0)
SELECT user_id, med_id, drug, canonical_name, before, after, round(pct, 4) AS pct, CASE WHEN wanted = 'decrease' THEN pct < 0 ELSE pct > 0 END AS as_wanted FROM p WHERE abs(pct) >= 15""")
def treatment_response(t: Tables) -> DataFrame:
    return series.treatment_response(_meds(t), _dated(t), _drugs(t)).select("user_id", "med_id", "drug", "canonical_name", "before", "after", r4("pct"), "as_wanted")


@query(f"""WITH {_RES}, {_MEDS}, m AS (SELECT user_id, med_id, start_day, canonical_name FROM meds JOIN {_DRUGS} USING (drug) WHERE start_day IS NOT NULL)
SELECT m.user_id, med_id, m.canonical_name, obs_id, day, value FROM m JOIN res r ON r.user_id = m.user_id AND r.canonical_name = m.canonical_name AND day BETWEEN start_day - 90 AND start_day + 7
QUALIFY row_number() OVER (PARTITION BY med_id, m.canonical_name ORDER BY abs(day - start_day), day DESC, obs_id DESC) = 1""")
def treatment_baseline(t: Tables) -> DataFrame:
    return series.baseline_nearest(_meds(t), _dated(t), _drugs(t))


@query(f"""WITH {_MEDS}, a AS (SELECT DISTINCT user_id, drug FROM meds WHERE status = 'active' AND drug IS NOT NULL)
SELECT x.user_id, substance_a, substance_b, severity, mechanism FROM a x JOIN {dims.values(dims.INTERACTIONS, 'd', 'substance_a, substance_b, severity, mechanism')} ON x.drug = substance_a JOIN a y ON y.user_id = x.user_id AND y.drug = substance_b""")
def drug_interactions(t: Tables) -> DataFrame:
    return series.pair_interactions(_meds(t), dims.frame(t.spark, dims.INTERACTIONS, "substance_a string, substance_b string, severity string, mechanism string"))


_STATE = "CASE WHEN value > high THEN 'high' WHEN value < low THEN 'low' ELSE 'normal' END"


@query(f"""WITH {_RES}, s AS (SELECT *, {_STATE} AS state FROM last), p AS (SELECT * FROM {dims.values(dims.PATTERNS, 'd', 'pattern, canonical_name, direction, needed, adds')}),
c AS (SELECT DISTINCT s.user_id, p.pattern FROM s JOIN p ON s.canonical_name = p.canonical_name AND state = direction WHERE needed),
w AS (SELECT c.user_id, p.*, s.state, coalesce(s.state = p.direction, false) AS held FROM c JOIN p USING (pattern) LEFT JOIN s ON s.user_id = c.user_id AND s.canonical_name = p.canonical_name)
SELECT user_id, pattern, round(least(sum(CASE WHEN held THEN adds ELSE 0.0 END), {dims.PATTERN_CAP}), 4) AS confidence, count(*) FILTER (held) AS supporting, count(*) FILTER (state IS NULL) AS missing FROM w GROUP BY user_id, pattern HAVING bool_and(held OR NOT needed)""")
def pattern_scores(t: Tables) -> DataFrame:
    return series.pattern_scores(cut(series.latest(_results(t))), dims.frame(t.spark, dims.PATTERNS, "pattern string, canonical_name string, direction string, needed boolean, adds double"))


_PANEL_ROWS = [(p, x) for p, tests in dims.PANELS.items() for x in tests]


@query(f"""WITH {_RES}, p AS (SELECT * FROM {dims.values(_PANEL_ROWS, 'd', 'panel, canonical_name')}), z AS (SELECT panel, count(*) AS size FROM p GROUP BY panel)
SELECT user_id, panel, count(DISTINCT canonical_name) AS had, size - count(DISTINCT canonical_name) AS missing FROM res JOIN p USING (canonical_name) JOIN z USING (panel) GROUP BY user_id, panel, size HAVING count(DISTINCT canonical_name) < size""")
def panel_gaps(t: Tables) -> DataFrame:
    return series.panel_gaps(_results(t), dims.frame(t.spark, _PANEL_ROWS, "panel string, canonical_name string"))


_CONDITIONAL = [(x, c) for x, many in dims.CONDITIONAL.items() for c in many]


@query(f"""WITH {_RES} SELECT s.user_id, trigger, companion FROM last s JOIN {dims.values(_CONDITIONAL, 'd', 'trigger, companion')} ON s.canonical_name = trigger WHERE (value > high OR value < low)
AND NOT EXISTS (SELECT 1 FROM last l WHERE l.user_id = s.user_id AND l.canonical_name = companion)""")
def conditional_gaps(t: Tables) -> DataFrame:
    return series.conditional_gaps(cut(series.latest(_results(t))), dims.frame(t.spark, _CONDITIONAL, "trigger string, companion string"))


_DOMAIN_ROWS = [(d, x) for d, (_, tests) in dims.DOMAINS.items() for x in tests]
_WEIGHTS = [(d, w) for d, (w, _) in dims.DOMAINS.items()]
_SCORES = f"""dom AS (SELECT * FROM {dims.values(_DOMAIN_ROWS, 'd', 'domain, canonical_name')}), size AS (SELECT domain, count(*) AS size FROM dom GROUP BY domain),
scores AS (SELECT user_id, domain, 100 - count(*) FILTER (value > high OR value < low) * 100 / size AS score, count(*) AS tests_found FROM last JOIN dom USING (canonical_name) JOIN size USING (domain) GROUP BY user_id, domain, size)"""


def _scores(t: Tables) -> DataFrame:
    return series.domain_scores(series.latest(_results(t)), dims.frame(t.spark, _DOMAIN_ROWS, "domain string, canonical_name string"))


@query(f"WITH {_RES}, {_SCORES} SELECT user_id, domain, round(score, 4) AS score, tests_found FROM scores")
def domain_scores(t: Tables) -> DataFrame:
    return _scores(t).select("user_id", "domain", r4("score"), "tests_found")


@query(f"""WITH {_RES}, {_SCORES}, g AS (SELECT user_id, round(sum(score * weight) / sum(weight), 6) AS score, count(*) AS domains FROM scores JOIN {dims.values(_WEIGHTS, 'w', 'domain, weight')} USING (domain) GROUP BY user_id)
SELECT user_id, round(score, 4) AS score, domains, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM g""")
def composite_score(t: Tables) -> DataFrame:
    return series.composite(_scores(t), dims.frame(t.spark, _WEIGHTS, "domain string, weight double")).select("user_id", r4("score"), "domains", "grade")


@query("""WITH d AS (SELECT DISTINCT user_id, provider, date FROM clean_wearable_daily WHERE date IS NOT NULL), g AS (SELECT *, date - row_number() OVER (PARTITION BY user_id, provider ORDER BY date)::INT AS k FROM d)
SELECT user_id, provider, min(date) AS start, max(date) AS "end", count(*) AS days FROM g GROUP BY user_id, provider, k""")
def wearing_streaks(t: Tables) -> DataFrame:
    return series.streaks(t.clean_wearable_daily.where("date IS NOT NULL"))


@query(f"""WITH {_DAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, provider, metric ORDER BY date DESC) AS r FROM long), f AS (SELECT *, count(*) OVER (PARTITION BY user_id, provider, metric) AS c FROM k WHERE r <= 14),
g AS (SELECT user_id, provider, metric, count(*) AS n, avg(value) FILTER (r > c - c // 2) AS older, avg(value) FILTER (r <= c - c // 2) AS newer FROM f WHERE c >= 4 GROUP BY ALL)
SELECT user_id, provider, metric, n, round(older, 4) AS older, round(newer, 4) AS newer, round(CASE WHEN older <> 0 THEN (newer - older) / abs(older) * 100 END, 4) AS pct FROM g""")
def half_split_change(t: Tables) -> DataFrame:
    return series.half_split(_long(t)).select("user_id", "provider", "metric", "n", r4("older"), r4("newer"), r4("pct"))


@query(f"WITH {_DAYS} SELECT user_id, provider, strftime(date, '%Y-%m') AS month, metric, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM long GROUP BY ALL")
def monthly_averages(t: Tables) -> DataFrame:
    return _long(t).groupBy("user_id", "provider", F.date_format("date", "yyyy-MM").alias("month"), "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def _case(rules: list[tuple[str, str]], other: str) -> str:
    cases = " ".join("WHEN regexp_matches(coalesce(raw_text, ''), '(?i)" + p.replace("'", "''") + "') THEN '" + n + "'" for n, p in rules)
    return f"CASE {cases} ELSE {other} END"


_EVENTS = f"""parsed AS (SELECT event_id, user_id, date_effective AS day, {_case(dims.CATEGORIES, "'other'")} AS category, {_case(dims.SEVERITIES, "'unspecified'")} AS severity_word, {_case(dims.EMERGENCIES, 'NULL')} AS emergency FROM parsed_events)"""


@query(f"WITH {_EVENTS} SELECT * FROM parsed")
def parsed_symptoms(t: Tables) -> DataFrame:
    return records.parse_events(t.parsed_events)


@query(f"""WITH {_EVENTS} SELECT user_id, category, count(*) AS events, count(DISTINCT strftime(day, '%G-%V')) AS weeks, count(*) FILTER (severity_word = 'severe') AS severe, max(day) AS latest FROM parsed WHERE day IS NOT NULL GROUP BY ALL""")
def symptom_frequency(t: Tables) -> DataFrame:
    week = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), "day").cast("string"), F.weekofyear("day").cast("string"))
    return records.parse_events(t.parsed_events).where("day IS NOT NULL").groupBy("user_id", "category").agg(F.count("*").alias("events"), F.countDistinct(week).alias("weeks"), F.count_if(F.col("severity_word") == "severe").alias("severe"), F.max("day").alias("latest"))


@query(f"""WITH {_RES}, u AS (SELECT user_id, canonical_name, lower(trim(unit)) AS unit, count(*) AS n, max((day, obs_id)) AS newest FROM res WHERE trim(unit) <> '' GROUP BY ALL)
SELECT user_id, canonical_name, unit, n FROM u QUALIFY row_number() OVER (PARTITION BY user_id, canonical_name ORDER BY n DESC, newest DESC) = 1""")
def usual_units(t: Tables) -> DataFrame:
    """The unit a user's test is mostly recorded in; ties go to the newest."""
    u = _results(t).where(F.trim("unit") != "").groupBy("user_id", "canonical_name", F.lower(F.trim("unit")).alias("unit")).agg(F.count("*").alias("n"), F.max(F.struct("day", "obs_id")).alias("newest"))
    return u.groupBy("user_id", "canonical_name").agg(F.max_by(F.struct("unit", "n"), F.struct("n", "newest")).alias("x")).select("user_id", "canonical_name", "x.unit", "x.n")


@query(f"""WITH {_RES} SELECT user_id, canonical_name, day, count(*) AS results, CASE WHEN max(value) - min(value) < 0.001 THEN 'exact' ELSE 'conflict' END AS kind FROM res GROUP BY user_id, canonical_name, day HAVING count(*) > 1""")
def duplicate_results(t: Tables) -> DataFrame:
    g = _dated(t).groupBy("user_id", "canonical_name", "day").agg(F.count("*").alias("results"), (F.max("value") - F.min("value")).alias("_d")).where("results > 1")
    return g.select("user_id", "canonical_name", "day", "results", F.when(F.col("_d") < 0.001, "exact").otherwise("conflict").alias("kind"))


@query("""SELECT user_id, count(*) AS results, round(avg(((canonical_name IS NOT NULL)::INT + (trim(coalesce(unit, '')) <> '')::INT + (reference_high IS NOT NULL OR reference_low IS NOT NULL)::INT + (trim(coalesce(date_effective, '')) <> '')::INT) / 4), 4) AS completeness FROM clean_observations GROUP BY user_id""")
def completeness(t: Tables) -> DataFrame:
    there = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")
    checks = F.col("canonical_name").isNotNull().cast("int") + there("unit") + (F.col("reference_high").isNotNull() | F.col("reference_low").isNotNull()).cast("int") + there("date_effective")
    return t.clean_observations.groupBy("user_id").agg(F.count("*").alias("results"), F.round(F.avg(checks / 4), 4).alias("completeness"))


@query(f"""WITH {_RES}, o AS (SELECT max(day) AS as_of FROM res) SELECT user_id, l.canonical_name, day AS last_day, day + months * 30 AS due, as_of - (day + months * 30) AS days_overdue FROM last l JOIN {dims.values(dims.INTERVALS, 'd', 'canonical_name, months')} USING (canonical_name), o WHERE day + months * 30 < as_of""")
def overdue_tests(t: Tables) -> DataFrame:
    r = cut(_dated(t))
    as_of = F.lit(r.agg(F.max("day")).first()[0]).cast("date")
    last = series.latest(r).join(dims.frame(t.spark, dims.INTERVALS, "canonical_name string, months int"), "canonical_name").withColumn("due", F.expr("date_add(day, months * 30)"))
    return last.where(F.col("due") < as_of).select("user_id", "canonical_name", F.col("day").alias("last_day"), "due", F.datediff(as_of, "due").alias("days_overdue"))


@query(f"""WITH {_DAYS} SELECT user_id, coalesce(workout_sport_name, 'all') AS sport, count(*) AS days, round(sum(calories), 4) AS calories, round(max(workout_max_hr), 4) AS max_hr FROM days WHERE workout_sport_name IS NOT NULL GROUP BY ROLLUP (user_id, workout_sport_name) HAVING user_id IS NOT NULL""")
def workout_summary(t: Tables) -> DataFrame:
    d = records.counted_days(t.clean_wearable_daily, ["workout_sport_name", "calories", "workout_max_hr"]).where("workout_sport_name IS NOT NULL")
    g = d.rollup("user_id", "workout_sport_name").agg(F.count("*").alias("days"), F.round(F.sum("calories"), 4).alias("calories"), F.round(F.max("workout_max_hr"), 4).alias("max_hr"))
    return g.where("user_id IS NOT NULL").select("user_id", F.coalesce("workout_sport_name", F.lit("all")).alias("sport"), "days", "calories", "max_hr")


@query("SELECT provider, count(*) AS n, count(DISTINCT user_id) AS users, min(date) AS first_day, max(date) AS last_day FROM clean_wearable_daily GROUP BY provider")
def wearable_stats(t: Tables) -> DataFrame:
    return t.clean_wearable_daily.groupBy("provider").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query(f"""WITH {_DAYS}, p AS (SELECT user_id, date, metric, min(value) AS least, max(value) AS most, count(*) AS providers FROM long WHERE metric IN ('hrv', 'rhr', 'resp_rate', 'spo2') GROUP BY ALL)
SELECT user_id, date, metric, least, most, round(200 * (most - least) / (most + least), 4) AS pct FROM p WHERE providers > 1 AND most + least > 0 AND 200 * (most - least) / (most + least) > 15""")
def provider_conflicts(t: Tables) -> DataFrame:
    g = _long(t).where(F.col("metric").isin("hrv", "rhr", "resp_rate", "spo2")).groupBy("user_id", "date", "metric").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("providers"))
    both = F.col("most") + F.col("least")
    return g.where((F.col("providers") > 1) & (both > 0)).withColumn("pct", 200 * (F.col("most") - F.col("least")) / both).where("pct > 15").select("user_id", "date", "metric", "least", "most", r4("pct"))


_SOURCES = "SELECT user_id, utc_date AS day, 'lab' AS kind, obs_id AS id, coalesce(canonical_name, test_name) AS title FROM seen UNION ALL SELECT user_id, date_effective, 'symptom', event_id, symptom_category FROM parsed_events UNION ALL SELECT user_id, start_day, 'medication', med_id, name FROM meds UNION ALL SELECT user_id, date, 'wearable', id, provider FROM clean_wearable_daily"


@query(f"WITH observed AS (SELECT *, date_effective AS text FROM clean_observations), {sql.stamps('observed', 'seen')}, {_MEDS} SELECT user_id, day, kind, id, title FROM ({_SOURCES}) WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, kind, id DESC) <= 20")
def timeline(t: Tables) -> DataFrame:
    """The 20 newest entries of each user over all sources: a top-k report. Labs by their collection, medications by
    their start."""
    from pyspark.sql import Window

    labs = records.collected(t.clean_observations.select("user_id", "obs_id", "canonical_name", "test_name", "site_id", "date_effective"), t.dim_sites)
    meds = records.collected(t.clean_medications.select("user_id", "med_id", "name", "site_id", F.col("start_date").alias("date_effective")), t.dim_sites)
    parts = [
        labs.select("user_id", "day", F.lit("lab").alias("kind"), F.col("obs_id").alias("id"), F.coalesce("canonical_name", "test_name").alias("title")),
        t.parsed_events.select("user_id", F.col("date_effective").alias("day"), F.lit("symptom").alias("kind"), F.col("event_id").alias("id"), F.col("symptom_category").alias("title")),
        meds.select("user_id", "day", F.lit("medication").alias("kind"), F.col("med_id").alias("id"), F.col("name").alias("title")),
        t.clean_wearable_daily.select("user_id", F.col("date").alias("day"), F.lit("wearable").alias("kind"), "id", F.col("provider").alias("title")),
    ]
    w = Window.partitionBy("user_id").orderBy(F.desc("day"), "kind", F.desc("id"))
    return series.union_all(parts).where("day IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r <= 20").drop("_r")


KEYWORD = "glucose"
_LIKE = f"'%{KEYWORD}%'"


@query(f"""SELECT 'observations' AS source, obs_id AS id FROM clean_observations WHERE lower(canonical_name) LIKE {_LIKE} OR lower(test_name) LIKE {_LIKE}
UNION ALL SELECT 'events', event_id FROM parsed_events WHERE lower(raw_text) LIKE {_LIKE} UNION ALL SELECT 'medications', med_id FROM clean_medications WHERE lower(name) LIKE {_LIKE} UNION ALL SELECT 'documents', doc_id::VARCHAR FROM documents WHERE lower(text) LIKE {_LIKE} OR lower(title) LIKE {_LIKE}""")
def keyword_search(t: Tables, word: str = KEYWORD) -> DataFrame:
    """Where a word stands, in any case, in names, texts and titles of all tables."""
    has = lambda *cols: series.reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(word.lower()), F.lit(False)) for c in cols])
    return series.union_all([
        t.clean_observations.where(has("canonical_name", "test_name")).select(F.lit("observations").alias("source"), F.col("obs_id").alias("id")),
        t.parsed_events.where(has("raw_text")).select(F.lit("events").alias("source"), F.col("event_id").alias("id")),
        t.clean_medications.where(has("name")).select(F.lit("medications").alias("source"), F.col("med_id").alias("id")),
        t.documents.where(has("text", "title")).select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id")),
    ])


@query("SELECT DISTINCT source_doc_id FROM clean_observations o WHERE source_doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id::VARCHAR = o.source_doc_id)")
def orphan_documents(t: Tables) -> DataFrame:
    ids = t.documents.select(F.col("doc_id").cast("string").alias("source_doc_id"))
    return t.clean_observations.where("source_doc_id IS NOT NULL").select("source_doc_id").distinct().join(ids, "source_doc_id", "left_anti")


@query("""SELECT user_id, test_name, date_effective, value_text, source_doc_id, count(*) AS deliveries, min(obs_id) AS kept FROM clean_observations GROUP BY ALL HAVING count(*) > 1""")
def second_deliveries(t: Tables) -> DataFrame:
    keys = ["user_id", "test_name", "date_effective", "value_text", "source_doc_id"]
    return t.clean_observations.groupBy(*keys).agg(F.count("*").alias("deliveries"), F.min("obs_id").alias("kept")).where("deliveries > 1")


@query(f"WITH {_MEDS} SELECT user_id, drug, count(*) AS prescriptions, max(start_day) AS newest FROM meds WHERE status = 'active' GROUP BY ALL")
def active_medications(t: Tables) -> DataFrame:
    return _meds(t).where("status = 'active'").groupBy("user_id", "drug").agg(F.count("*").alias("prescriptions"), F.max("start_day").alias("newest"))


_WIDE = ("triglycerides", "hdl", "bun", "creatinine", "cholesterol_total", "sodium", "chloride", "carbon_dioxide", "glucose", "insulin")


@query(f"""WITH {_RES}, w AS (SELECT user_id, {', '.join(f"max(value) FILTER (canonical_name = '{c}') AS {c}" for c in _WIDE)} FROM last WHERE canonical_name IN ({', '.join(f"'{c}'" for c in _WIDE)}) GROUP BY user_id)
SELECT user_id, round(CASE WHEN hdl > 0 THEN triglycerides / hdl END, 4) AS tg_hdl, round(CASE WHEN creatinine > 0 THEN bun / creatinine END, 4) AS bun_creatinine, round(cholesterol_total - hdl, 4) AS non_hdl, round(sodium - chloride - carbon_dioxide, 4) AS anion_gap, round(glucose * insulin / 405, 4) AS homa_ir FROM w""")
def derived_markers(t: Tables) -> DataFrame:
    last = series.latest(_results(t)).where(F.col("canonical_name").isin(*_WIDE))
    w = last.groupBy("user_id").agg(*[F.max(F.when(F.col("canonical_name") == c, F.col("value"))).alias(c) for c in _WIDE])
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return w.select("user_id", F.round(over("triglycerides", "hdl"), 4).alias("tg_hdl"), F.round(over("bun", "creatinine"), 4).alias("bun_creatinine"), F.round(F.col("cholesterol_total") - F.col("hdl"), 4).alias("non_hdl"), F.round(F.col("sodium") - F.col("chloride") - F.col("carbon_dioxide"), 4).alias("anion_gap"), F.round(F.col("glucose") * F.col("insulin") / 405, 4).alias("homa_ir"))


@query(f"""WITH {_RES}, c AS (SELECT l.user_id, value AS creatinine, age, lower(sex) IN ('f', 'female', 'w', 'weiblich', 'woman') AS female FROM last l JOIN clean_demographics d USING (user_id) WHERE canonical_name = 'creatinine' AND common_unit = 'mg/dL' AND age IS NOT NULL AND trim(coalesce(sex, '')) <> '' AND value > 0)
SELECT user_id, round(142 * pow(least(creatinine / CASE WHEN female THEN 0.7 ELSE 0.9 END, 1.0), CASE WHEN female THEN -0.241 ELSE -0.302 END) * pow(greatest(creatinine / CASE WHEN female THEN 0.7 ELSE 0.9 END, 1.0), -1.2) * pow(0.9938, age) * CASE WHEN female THEN 1.012 ELSE 1.0 END, 4) AS egfr FROM c""")
def kidney_filtration(t: Tables) -> DataFrame:
    last = series.latest(_results(t)).where("canonical_name = 'creatinine' AND common_unit = 'mg/dL' AND value > 0")
    d = t.clean_demographics.where("age IS NOT NULL AND trim(coalesce(sex, '')) != ''").select("user_id", "age", F.lower("sex").isin("f", "female", "w", "weiblich", "woman").alias("female"))
    return last.join(d, "user_id").select("user_id", F.round(series.egfr(F.col("value"), F.col("age"), F.col("female")), 4).alias("egfr"))


@query("SELECT 'observations' AS table_name, count(*) AS n FROM clean_observations UNION ALL SELECT 'wearables', count(*) FROM clean_wearable_daily UNION ALL SELECT 'medications', count(*) FROM clean_medications UNION ALL SELECT 'events', count(*) FROM parsed_events UNION ALL SELECT 'documents', count(*) FROM documents")
def category_counts(t: Tables) -> DataFrame:
    pairs = (("observations", t.clean_observations), ("wearables", t.clean_wearable_daily), ("medications", t.clean_medications), ("events", t.parsed_events), ("documents", t.documents))
    return series.union_all([d.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, d in pairs])


_W = " + ".join(f"{k}_part * {w}" for k, w in dims.READINESS.items())
_GRADE = "CASE " + " ".join(f"WHEN score >= {x} THEN '{n}'" for n, x in dims.READINESS_GRADES) + " ELSE 'rest' END"


@query(f"""WITH {_DAYS}, k AS (SELECT *, avg(hrv) OVER b AS hb, avg(rhr) OVER b AS rb, avg(strain) OVER (PARTITION BY user_id, provider ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3, row_number() OVER (PARTITION BY user_id, provider ORDER BY date DESC) AS r
  FROM days WINDOW b AS (PARTITION BY user_id, provider ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
p AS (SELECT user_id, provider, date, CASE WHEN hb <> 0 AND hrv IS NOT NULL THEN least(greatest((hrv / hb - 0.6) / 0.6 * 100, 0.0), 100.0) ELSE 50.0 END AS hrv_part, CASE WHEN rb <> 0 AND rhr IS NOT NULL THEN least(greatest((1.15 - rhr / rb) / 0.25 * 100, 0.0), 100.0) ELSE 50.0 END AS rhr_part,
  coalesce(least(greatest(coalesce(sleep_score, CASE WHEN sleep_duration_min >= 480 THEN 100.0::DOUBLE WHEN sleep_duration_min <= 300 THEN 0.0 WHEN sleep_duration_min <= 420 THEN (sleep_duration_min - 300) / 120.0 * 70 WHEN sleep_duration_min IS NOT NULL THEN 70 + (sleep_duration_min - 420) / 60.0 * 30 END), 0.0), 100.0), 50.0) AS sleep_part,
  CASE WHEN recovery_score IS NULL THEN 50.0 ELSE least(greatest(recovery_score, 0.0), 100.0) END AS recovery_part, CASE WHEN s3 IS NULL THEN 80.0 ELSE least(greatest((18 - s3) / 8 * 100, 0.0), 100.0) END AS strain_part FROM k WHERE r = 1),
z AS (SELECT *, {_W} AS score FROM p) SELECT user_id, provider, date, round(score, 4) AS score, {_GRADE} AS grade FROM z""")
def readiness(t: Tables) -> DataFrame:
    d = records.counted_days(t.clean_wearable_daily, ["hrv", "rhr", "strain", "sleep_score", "sleep_duration_min", "recovery_score"])
    return series.readiness(d).select("user_id", "provider", "date", r4("score"), "grade")


_STATUS = ", ".join(f"CASE WHEN {k}_pct < {lo} THEN 'low' WHEN {k}_pct > {hi} THEN 'high' ELSE 'normal' END AS {k}_status" for k, (lo, hi) in dims.SLEEP_NORMS.items())


@query(f"""WITH {_DAYS}, n AS (SELECT user_id, provider, date, coalesce(rem_min, 0) / sleep_duration_min * 100 AS rem_pct, coalesce(deep_min, 0) / sleep_duration_min * 100 AS deep_pct, coalesce(light_min, 0) / sleep_duration_min * 100 AS light_pct FROM days
  WHERE sleep_duration_min > 0 AND coalesce(rem_min, 0) + coalesce(deep_min, 0) + coalesce(light_min, 0) > 0) SELECT user_id, provider, date, round(rem_pct, 4) AS rem_pct, round(deep_pct, 4) AS deep_pct, round(light_pct, 4) AS light_pct, {_STATUS}, light_pct > {dims.LIGHT_MOST} AS too_light FROM n""")
def sleep_stages(t: Tables) -> DataFrame:
    d = records.counted_days(t.clean_wearable_daily, ["sleep_duration_min", "rem_min", "deep_min", "light_min"])
    return series.sleep_stages(d).select("user_id", "provider", "date", r4("rem_pct"), r4("deep_pct"), r4("light_pct"), "rem_status", "deep_status", "too_light")


@query(f"""WITH {_DAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, provider, metric ORDER BY date DESC) AS r FROM long WHERE metric IN ('rhr', 'hrv', 'strain', 'recovery_score', 'sleep_score')), f AS (SELECT *, avg(value) FILTER (r > 7) OVER (PARTITION BY user_id, provider, metric) AS older FROM k WHERE r <= 30),
g AS (SELECT user_id, provider, metric, count(*) AS n, count(*) FILTER (r <= 7 AND value > older * 1.10) AS raised, avg(value) FILTER (r <= 3) AS new3, avg(value) FILTER (r BETWEEN 5 AND 7) AS old3, avg(value) FILTER (r <= 5) AS mean5, count(*) FILTER (r <= 5 AND value < 40) AS low5, count(*) FILTER (r <= 7 AND value < 60) AS poor7 FROM f GROUP BY ALL),
s AS (SELECT user_id, provider, CASE WHEN metric = 'rhr' AND n >= 10 AND raised >= 5 THEN 'rhr_elevated' WHEN metric = 'hrv' AND n >= 7 AND old3 > 0 AND (old3 - new3) / old3 * 100 > 15 THEN 'hrv_declining' WHEN metric = 'strain' AND n >= 5 AND mean5 > 16 THEN 'high_strain'
  WHEN metric = 'recovery_score' AND n >= 5 AND low5 >= 3 THEN 'low_recovery' WHEN metric = 'sleep_score' AND n >= 5 AND poor7 >= 5 THEN 'poor_sleep' END AS signal FROM g) SELECT * FROM s WHERE signal IS NOT NULL""")
def overtraining_signals(t: Tables) -> DataFrame:
    return series.overtraining(_long(t))


@query("SELECT user_id, event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_daily(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, min(ts) AS started, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, k""")
def event_sessions(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n"), F.collect_set("event_type").alias("_k"))
    return g.select("user_id", "started", "n", F.size("_k").cast("bigint").alias("kinds"))


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) <= 10""")
def nearest_vectors(t: Tables) -> DataFrame:
    """The ten nearest of all rows for each query row (ids divisible by 20)."""
    from vitalframe.operators.search import nearest

    e = t.embeddings
    return nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"))


_TERMS = ("glucose", "thyroid", "fasting", "insulin")


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM w WHERE length(term) > 1 GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), size AS (SELECT count(*) AS docs FROM documents),
wt AS (SELECT doc_id, term, n * (ln((1 + docs) / (1 + d)) + 1) AS x FROM tf JOIN df USING (term), size), nm AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM wt GROUP BY doc_id)
SELECT doc_id, round(sum(x) / any_value(norm), 4) AS score FROM wt JOIN nm USING (doc_id) WHERE term IN ({', '.join(f"'{x}'" for x in _TERMS)}) GROUP BY doc_id""")
def tfidf_search(t: Tables, terms: tuple[str, ...] = _TERMS) -> DataFrame:
    """Scores of all documents that hold a query term (each term counting once), by normalised TF-IDF."""
    from vitalframe.operators.search import tfidf_scores

    return tfidf_scores(t.documents, "doc_id", "text", terms).select("doc_id", F.round("score", 4).alias("score"))


@query()
def text_chunks(t: Tables) -> DataFrame:
    """Whole texts cut into chunks of at most 2,000 characters at paragraph, sentence or word ends."""
    from vitalframe.operators.search import chunks

    return chunks(t.documents, "doc_id", "text", 2000)


def _whole(f):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(Whole(spark, folder))

    run.__name__, run.__doc__ = f"{f.__name__}_whole", f.__doc__
    return run


WHOLE = (critical_alerts, triage_counts, rapid_changes, latest_and_previous, panel_delta, treatment_response, lab_wearable_correlations, derived_markers, latest_per_test, lab_trends, treatment_baseline, overdue_tests, duplicate_results, threshold_crossings, pattern_scores, panel_gaps, conditional_gaps, domain_scores, composite_score, usual_units, kidney_filtration)
QUERIES |= {f"{f.__name__}_whole": _whole(f) for f in WHOLE}
