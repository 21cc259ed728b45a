"""Queries that join results, medications, wearables and variants to rules, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe import dims, knowledge
from vitalframe.operators import records, rules, series
from vitalframe.plans import sql
from vitalframe.plans.records import _DAYS, _MEDS, _RES, _dated, _long, _meds, _results, _trend_sql, query, r4
from vitalframe.session import cut
from vitalframe.tables import Tables

V = dims.values
_STATE = "CASE WHEN value > high THEN 'high' WHEN value < low THEN 'low' ELSE 'normal' END"
_FEMALE = "lower(trim(sex)) IN ('f', 'female', 'w', 'weiblich', 'woman')"
_MALE = "lower(trim(sex)) IN ('m', 'male', 'männlich', 'man')"
_AS_OF = "upto AS (SELECT max(day) AS as_of FROM res)"


def _frame(t: Tables, rows: list, schema: str) -> DataFrame:
    return dims.frame(t.spark, rows, schema)


def _as_of(dated: DataFrame):  # noqa: ANN202
    return F.lit(dated.agg(F.max("day")).first()[0]).cast("date")


def _people(t: Tables) -> DataFrame:
    s = F.lower(F.trim("sex"))
    sex = F.when(s.isin("f", "female", "w", "weiblich", "woman"), "female").when(s.isin("m", "male", "männlich", "man"), "male")
    return t.clean_demographics.select("user_id", "age", sex.alias("sex"), F.coalesce(sex == "female", F.lit(False)).alias("female"), F.lower(F.trim("ethnicity")).alias("ethnicity"))


def _r(schema: str) -> str:
    return "canonical_name string, " + schema


@query(f"""WITH {_RES}, p AS (SELECT user_id, age, coalesce({_FEMALE}, false) AS female, lower(trim(ethnicity)) AS eth FROM clean_demographics),
j AS (SELECT r.*, e.low AS el, e.high AS eh, f.low AS fl, f.high AS fh, a.low AS al, a.high AS ah, w.low AS wl, w.high AS wh, d.typical_low AS dl, d.typical_high AS dh, CASE WHEN e.low IS NOT NULL THEN 'ethnicity' WHEN f.low IS NOT NULL THEN 'female age' WHEN a.low IS NOT NULL THEN 'age' WHEN w.low IS NOT NULL THEN 'female' ELSE 'default' END AS layer
  FROM res r LEFT JOIN p USING (user_id) LEFT JOIN dim_tests d ON d.canonical_name = r.canonical_name LEFT JOIN {V(knowledge.FEMALE_AGE_RANGES, 'f', 'c, a1, a2, low, high')} ON f.c = r.canonical_name AND female AND age BETWEEN f.a1 AND f.a2
  LEFT JOIN {V(knowledge.AGE_RANGES, 'a', 'c, a1, a2, low, high')} ON a.c = r.canonical_name AND age BETWEEN a.a1 AND a.a2 LEFT JOIN {V(knowledge.FEMALE_RANGES, 'w', 'c, low, high')} ON w.c = r.canonical_name AND age IS NULL AND female LEFT JOIN {V(knowledge.ETHNIC_RANGES, 'e', 'x, c, low, high')} ON e.c = r.canonical_name AND e.x = eth),
k AS (SELECT user_id, obs_id, canonical_name, round(value, 6) AS value, coalesce(el, fl, al, wl, dl) AS range_low, coalesce(eh, fh, ah, wh, dh) AS range_high, layer, value AS x FROM j)
SELECT user_id, obs_id, canonical_name, value, range_low, range_high, layer, CASE WHEN x > range_high THEN 'high' WHEN x < range_low THEN 'low' ELSE 'normal' END AS state FROM k""")
def layered_states(t: Tables) -> DataFrame:
    """Each result against the range of its user's ethnicity, age and sex."""
    default = t.dim_tests.select("canonical_name", F.col("typical_low").alias("low"), F.col("typical_high").alias("high"))
    ages = "age_from int, age_to int, low double, high double"
    got = rules.layered_ranges(_dated(t), _people(t), default, _frame(t, knowledge.AGE_RANGES, _r(ages)), _frame(t, knowledge.FEMALE_AGE_RANGES, _r(ages)), _frame(t, knowledge.FEMALE_RANGES, _r("low double, high double")), _frame(t, knowledge.ETHNIC_RANGES, "ethnicity string, canonical_name string, low double, high double"))
    return got.select("user_id", "obs_id", "canonical_name", F.round("value", 6).alias("value"), "range_low", "range_high", "layer", records.state_of(F.col("value"), F.col("range_low"), F.col("range_high")).alias("state"))


_COND = f"cond AS (SELECT DISTINCT user_id, condition FROM (SELECT *, {_STATE} AS state FROM last) s JOIN {V(knowledge.LAB_CONDITIONS, 'k', 'canonical_name, state, condition')} USING (canonical_name, state))"


def _conditions(t: Tables, last: DataFrame) -> DataFrame:
    return rules.stated(last).join(_frame(t, knowledge.LAB_CONDITIONS, _r("state string, condition string")), ["canonical_name", "state"]).select("user_id", "condition").distinct()


@query(f"WITH {_RES}, {_COND} SELECT user_id, condition FROM cond")
def lab_conditions(t: Tables) -> DataFrame:
    """Conditions that the latest results stand for."""
    return _conditions(t, series.latest(_results(t)))


@query(f"WITH {_RES}, {_COND} SELECT x.user_id, a, b, priority FROM cond x JOIN {V(knowledge.COMORBIDITIES, 'k', 'a, b, priority')} ON x.condition = a JOIN cond y ON y.user_id = x.user_id AND y.condition = b")
def comorbidities(t: Tables) -> DataFrame:
    pairs = _frame(t, knowledge.COMORBIDITIES, "a string, b string, priority string")
    return rules.present_pairs(_conditions(t, series.latest(_results(t))), "condition", pairs).select("user_id", "a", "b", "priority")


_CLASS = f"classed AS (SELECT DISTINCT user_id, class FROM meds JOIN {V(knowledge.DRUG_CLASSES, 'k', 'drug, class')} USING (drug) WHERE status = 'active')"


def _classes(t: Tables) -> DataFrame:
    return _meds(t).where("status = 'active'").join(_frame(t, knowledge.DRUG_CLASSES, "drug string, class string"), "drug").select("user_id", "class").distinct()


@query(f"""WITH {_RES}, {_MEDS}, {_COND}, {_CLASS}, {_AS_OF}, reasons AS (SELECT user_id, canonical_name, months, condition AS reason FROM cond JOIN {V(knowledge.CONDITION_LABS, 'k', 'condition, canonical_name, months')} USING (condition)
  UNION ALL SELECT user_id, canonical_name, months, class FROM classed JOIN {V(knowledge.DRUG_LABS, 'k', 'class, canonical_name, months')} USING (class)),
best AS (SELECT user_id, canonical_name, min(months) AS months, arg_min(reason, (months, reason)) AS reason FROM reasons GROUP BY ALL)
SELECT b.user_id, b.canonical_name, months, reason, l.day AS last_day, CASE WHEN l.day IS NULL THEN 'never' ELSE 'overdue' END AS status FROM best b LEFT JOIN last l ON l.user_id = b.user_id AND l.canonical_name = b.canonical_name, upto WHERE l.day IS NULL OR l.day + months * 30 < as_of""")
def labs_due(t: Tables) -> DataFrame:
    """Tests that a user's conditions and drugs ask for, never done or overdue."""
    dated = cut(_dated(t))
    last = series.latest(dated)
    by_condition = _conditions(t, last).join(_frame(t, knowledge.CONDITION_LABS, "condition string, canonical_name string, months int"), "condition").select("user_id", "canonical_name", "months", F.col("condition").alias("reason"))
    by_drug = _classes(t).join(_frame(t, knowledge.DRUG_LABS, "class string, canonical_name string, months int"), "class").select("user_id", "canonical_name", "months", F.col("class").alias("reason"))
    return rules.due_labs(by_condition.unionByName(by_drug), last, _as_of(dated)).select("user_id", "canonical_name", "months", "reason", "last_day", "status")


@query(f"WITH {_RES}, {_MEDS}, {_CLASS} SELECT user_id, class, effect, canonical_name, round(value, 6) AS value FROM classed JOIN {V(knowledge.SIDE_EFFECTS, 'k', 'class, effect, canonical_name, state')} USING (class) JOIN (SELECT *, {_STATE} AS state FROM last) s USING (user_id, canonical_name, state)")
def side_effects(t: Tables) -> DataFrame:
    """Side effects of active drugs that the latest result of their test shows."""
    profiles = _frame(t, knowledge.SIDE_EFFECTS, "class string, effect string, canonical_name string, state string")
    j = _classes(t).join(profiles, "class").join(rules.stated(series.latest(_results(t))), ["user_id", "canonical_name", "state"])
    return j.select("user_id", "class", "effect", "canonical_name", F.round("value", 6).alias("value"))


@query(f"WITH {_RES}, {_MEDS}, {_DAYS} SELECT user_id, m.drug, canonical_name, wanted, round(value, 6) AS value, s.state FROM (SELECT DISTINCT user_id, drug FROM meds WHERE status = 'active') m JOIN {V(dims.DRUG_TESTS, 'd', 'drug, canonical_name, wanted')} ON d.drug = m.drug LEFT JOIN (SELECT *, {_STATE} AS state FROM last) s USING (user_id, canonical_name) WHERE s.state IS NULL OR s.state <> 'normal'")
def drug_lab_watch(t: Tables) -> DataFrame:
    """Tests that active drugs act on whose latest result is abnormal, or missing."""
    acts = _frame(t, dims.DRUG_TESTS, "drug string, canonical_name string, wanted string")
    active = _meds(t).where("status = 'active'").select("user_id", "drug").distinct()
    j = active.join(acts, "drug").join(rules.stated(series.latest(_results(t))), ["user_id", "canonical_name"], "left")
    return j.where("state IS NULL OR state != 'normal'").select("user_id", "drug", "canonical_name", "wanted", F.round("value", 6).alias("value"), "state")


@query(f"WITH {_RES}, {_MEDS} SELECT user_id, canonical_name, round(value, 6) AS value, CASE WHEN value < deficient THEN 'deficient' ELSE 'insufficient' END AS severity FROM last l JOIN {V(knowledge.SUPPLEMENTS, 'k', 'canonical_name, deficient, insufficient')} USING (canonical_name) WHERE value < insufficient AND NOT EXISTS (SELECT 1 FROM meds m JOIN {V(dims.DRUG_TESTS, 'd', 'drug, canonical_name, wanted')} ON d.drug = m.drug WHERE m.user_id = l.user_id AND status = 'active' AND d.canonical_name = l.canonical_name AND wanted = 'increase')")
def supplements(t: Tables) -> DataFrame:
    """Deficiencies of the latest results that no active drug makes up for."""
    bounds = _frame(t, knowledge.SUPPLEMENTS, _r("deficient double, insufficient double"))
    taken = _meds(t).where("status = 'active'").join(_frame(t, dims.DRUG_TESTS, "drug string, canonical_name string, wanted string").where("wanted = 'increase'"), "drug").select("user_id", "canonical_name")
    low = series.latest(_results(t)).join(bounds, "canonical_name").where("value < insufficient").join(taken, ["user_id", "canonical_name"], "left_anti")
    return low.select("user_id", "canonical_name", F.round("value", 6).alias("value"), F.when(F.col("value") < F.col("deficient"), "deficient").otherwise("insufficient").alias("severity"))


@query(f"""WITH {_RES}, {_AS_OF}, recent AS (SELECT res.*, {_STATE} AS state, as_of FROM res, upto WHERE day >= as_of - 365), newest AS (SELECT user_id, canonical_name, max(day) AS newest FROM recent GROUP BY ALL),
hits AS (SELECT user_id, canonical_name, state, max(day) AS day, any_value(wf) AS wf, any_value(wt) AS wt, any_value(urgent) AS urgent, any_value(as_of) AS as_of FROM recent JOIN {V(knowledge.RETESTS, 'k', 'canonical_name, state, wf, wt, urgent')} USING (canonical_name, state) GROUP BY ALL)
SELECT user_id, canonical_name, state, day, day + wf * 7 AS due, CASE WHEN as_of > day + wt * 7 AND as_of >= day + wf * 7 AND urgent THEN 'urgent_overdue' WHEN as_of > day + wt * 7 AND as_of >= day + wf * 7 THEN 'overdue' ELSE 'due_soon' END AS status
FROM hits JOIN newest USING (user_id, canonical_name) WHERE newest <= day AND (day + wf * 7) - as_of <= 14""")
def retests_due(t: Tables) -> DataFrame:
    dated = cut(_dated(t))
    return rules.retests(dated, _frame(t, knowledge.RETESTS, _r("state string, weeks_from int, weeks_to int, urgent boolean")), _as_of(dated))


@query(f"""WITH {_RES}, {_AS_OF}, p AS (SELECT user_id, age, CASE WHEN {_FEMALE} THEN 'female' WHEN {_MALE} THEN 'male' END AS sex FROM clean_demographics)
SELECT p.user_id, screening, l.day AS last_day FROM p JOIN {V(knowledge.SCREENINGS, 'k', 'screening, age_from, age_to, for_sex, months, test')} ON age >= age_from AND (age_to = 0 OR age <= age_to) AND (for_sex = 'any' OR for_sex = p.sex)
LEFT JOIN last l ON l.user_id = p.user_id AND l.canonical_name = k.test, upto WHERE l.day IS NULL OR (months > 0 AND l.day + months * 30 < as_of)""")
def screenings_due(t: Tables) -> DataFrame:
    dated = cut(_dated(t))
    guide = _frame(t, knowledge.SCREENINGS, "screening string, age_from int, age_to int, for_sex string, months int, test string")
    return rules.screenings(_people(t).select("user_id", "age", "sex"), series.latest(dated), guide, _as_of(dated))


_LEVEL = "CASE " + " ".join(f"WHEN score >= {x} THEN '{n}'" for n, x in knowledge.STRESS_LEVELS) + " ELSE 'low' END"
_MOVED = ("hrv", "rhr", "sleep_score", "recovery_score", "skin_temp")


@query(f"""WITH {_DAYS}, l AS ({' UNION ALL '.join(f"SELECT user_id, provider, date, '{m}' AS metric, {m}::DOUBLE AS value FROM days WHERE {m} IS NOT NULL" for m in _MOVED)}), d AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, provider ORDER BY date DESC) AS r FROM l),
i AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, provider, metric) AS n FROM d JOIN {V(knowledge.STRESS, 'k', 'metric, bad, weight, least')} USING (metric) WHERE r <= 7 WINDOW w AS (PARTITION BY user_id, provider, metric ORDER BY date)),
g AS (SELECT user_id, provider, metric, bad, weight, least, avg(value) FILTER (i <= n // 2) AS a, avg(value) FILTER (i > n // 2) AS b FROM i WHERE n >= 3 GROUP BY ALL), h AS (SELECT *, CASE WHEN a <> 0 THEN (b - a) / a * 100 ELSE 0 END * bad > least AS hit FROM g),
s AS (SELECT user_id, provider, round(least(sum(CASE WHEN hit THEN weight ELSE 0.0 END), 1.0), 6) AS score, count(*) FILTER (hit) AS signals FROM h GROUP BY ALL) SELECT user_id, provider, score, {_LEVEL} AS level, signals FROM s""")
def stress_scores(t: Tables) -> DataFrame:
    days = records.unpivot(records.counted_days(t.clean_wearable_daily, list(_MOVED)), _MOVED)
    return rules.stress(days, _frame(t, knowledge.STRESS, "metric string, bad int, weight double, least double"), knowledge.STRESS_LEVELS)


_TEXTS = ", ".join(f"'{x}'" for x in knowledge.ABNORMAL_TEXTS)


@query(f"""WITH {_RES}, texts AS (SELECT *, date_effective AS text FROM named WHERE canonical_name IS NOT NULL AND value IS NULL AND regexp_matches(value_text, '[A-Za-z]') AND NOT regexp_matches(value_text, '\\d')), {sql.stamps('texts', 'told')},
k AS (SELECT *, lower(trim(value_text)) AS now, lead(lower(trim(value_text))) OVER w AS before, row_number() OVER w AS r FROM told WHERE utc_date IS NOT NULL WINDOW w AS (PARTITION BY user_id, canonical_name ORDER BY utc_date DESC, obs_id DESC))
SELECT user_id, canonical_name, utc_date AS day, before, now FROM k WHERE r = 1 AND before IS NOT NULL AND before <> now AND now IN ({_TEXTS})""")
def qualitative_changes(t: Tables) -> DataFrame:
    """Tests whose latest text result turned abnormal."""
    rows = records.named(records.once(t.clean_observations), t.dim_tests).where("canonical_name IS NOT NULL AND value IS NULL").where(F.col("value_text").rlike("[A-Za-z]") & ~F.col("value_text").rlike(r"\d"))
    rows = records.collected(rows, t.dim_sites).where("day IS NOT NULL").withColumn("now", F.lower(F.trim("value_text")))
    w = series.newest_first("user_id", "canonical_name")
    got = rows.withColumn("before", F.lead("now").over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1 AND before != now")
    return got.where(F.col("now").isin(*knowledge.ABNORMAL_TEXTS)).select("user_id", "canonical_name", "day", "before", "now")


@query(f"""WITH {_DAYS}, n AS (SELECT user_id, provider, date, rem_min * 100.0 / sleep_duration_min AS rem_pct, deep_min * 100.0 / sleep_duration_min AS deep_pct FROM days WHERE sleep_duration_min > 0 AND rem_min IS NOT NULL AND deep_min IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, provider ORDER BY date DESC) AS r FROM n),
g AS (SELECT user_id, provider, count(*) AS nights, avg(rem_pct) FILTER (r <= 7) - avg(rem_pct) AS rem_move, avg(deep_pct) FILTER (r <= 7) - avg(deep_pct) AS deep_move FROM k WHERE r <= 30 GROUP BY ALL)
SELECT user_id, provider, nights, round(rem_move, 4) AS rem_move, round(deep_move, 4) AS deep_move, CASE WHEN deep_move > 2 THEN 'improving' WHEN deep_move < -2 THEN 'declining' ELSE 'stable' END AS deep_trend FROM g WHERE nights >= 7""")
def sleep_trends(t: Tables) -> DataFrame:
    """Shares of the stages in the newest 7 of the newest 30 nights that have them, against all 30."""
    from pyspark.sql import Window

    d = records.counted_days(t.clean_wearable_daily, ["sleep_duration_min", "rem_min", "deep_min"]).where("sleep_duration_min > 0 AND rem_min IS NOT NULL AND deep_min IS NOT NULL")
    k = d.withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "provider").orderBy(F.desc("date")))).where("_r <= 30")
    share = lambda c: F.col(c) * 100.0 / F.col("sleep_duration_min")
    move = lambda c: F.avg(F.when(F.col("_r") <= 7, share(c))) - F.avg(share(c))
    g = k.groupBy("user_id", "provider").agg(F.count("*").alias("nights"), move("rem_min").alias("rem_move"), move("deep_min").alias("deep_move")).where("nights >= 7")
    trend = F.when(F.col("deep_move") > 2, "improving").when(F.col("deep_move") < -2, "declining").otherwise("stable")
    return g.select("user_id", "provider", "nights", r4("rem_move"), r4("deep_move"), trend.alias("deep_trend"))


_SLEEP = ("deep_pct", "rem_pct", "sleep_duration_min", "sleep_efficiency_pct", "sleep_latency_min")


@query(f"""WITH {_DAYS}, k AS (SELECT *, CASE WHEN sleep_duration_min > 0 THEN deep_min * 100.0 / sleep_duration_min END AS deep_pct, CASE WHEN sleep_duration_min > 0 THEN rem_min * 100.0 / sleep_duration_min END AS rem_pct, row_number() OVER (PARTITION BY user_id, provider ORDER BY date DESC) AS r FROM days),
g AS (SELECT user_id, provider, {', '.join(f'avg({c}) AS {c}' for c in _SLEEP)} FROM k WHERE r <= 14 GROUP BY ALL HAVING count(*) >= 3), l AS ({' UNION ALL '.join(f"SELECT user_id, provider, '{c}' AS metric, {c}::DOUBLE AS mean FROM g WHERE {c} IS NOT NULL" for c in _SLEEP)})
SELECT user_id, provider, deficit, round(mean, 4) AS mean FROM l JOIN {V(knowledge.SLEEP_DEFICITS, 'd', 'deficit, metric, side, bound')} USING (metric) WHERE CASE side WHEN 'below' THEN mean < bound ELSE mean > bound END""")
def sleep_deficits(t: Tables) -> DataFrame:
    """What is wanting in the newest 14 nights on average."""
    from pyspark.sql import Window

    d = records.counted_days(t.clean_wearable_daily, ["sleep_duration_min", "rem_min", "deep_min", "sleep_efficiency_pct", "sleep_latency_min"])
    k = d.withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "provider").orderBy(F.desc("date")))).where("_r <= 14")
    pct = lambda c: F.when(F.col("sleep_duration_min") > 0, F.col(c) * 100.0 / F.col("sleep_duration_min"))
    k = k.withColumn("deep_pct", pct("deep_min")).withColumn("rem_pct", pct("rem_min"))
    g = k.groupBy("user_id", "provider").agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in _SLEEP]).where("_n >= 3")
    long = g.select("user_id", "provider", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("mean")) for c in _SLEEP]))).where("mean IS NOT NULL")
    hit = F.when(F.col("side") == "below", F.col("mean") < F.col("bound")).otherwise(F.col("mean") > F.col("bound"))
    return long.join(_frame(t, knowledge.SLEEP_DEFICITS, "deficit string, metric string, side string, bound double"), "metric").where(hit).select("user_id", "provider", "deficit", r4("mean"))


@query(f"WITH {_DAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, provider, metric ORDER BY date DESC) AS r FROM long) SELECT user_id, provider, metric, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM k WHERE r <= 14 GROUP BY ALL")
def recent_averages(t: Tables) -> DataFrame:
    """Mean, least and greatest of the newest 14 values of each metric."""
    from pyspark.sql import Window

    k = _long(t).withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "provider", "metric").orderBy(F.desc("date")))).where("_r <= 14")
    return k.groupBy("user_id", "provider", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))


@query(f"WITH {_RES} SELECT user_id, day, count(*) AS results, count(*) FILTER (value > high OR value < low) AS abnormal, count(DISTINCT canonical_name) AS tests FROM res GROUP BY ALL")
def lab_report(t: Tables) -> DataFrame:
    """Results and abnormal ones of each day of collection."""
    return _dated(t).groupBy("user_id", "day").agg(F.count("*").alias("results"), F.count_if((F.col("value") > F.col("high")) | (F.col("value") < F.col("low"))).alias("abnormal"), F.countDistinct("canonical_name").alias("tests"))


_GENES = f"genes AS (SELECT DISTINCT user_id, lower(trim(rsid)) AS rsid, upper(trim(genotype)) AS genotype FROM {V(knowledge.GENOTYPES, 'g', 'user_id, rsid, genotype')}), found AS (SELECT * FROM genes JOIN {V(knowledge.SNP_RULES, 'k', 'rsid, gene, genotype, risk, condition, test, pathway')} USING (rsid, genotype))"
_SNPS = "rsid string, gene string, genotype string, risk string, condition string, test string, pathway string"


def _genes(t: Tables) -> DataFrame:
    return _frame(t, knowledge.GENOTYPES, "user_id bigint, rsid string, genotype string")


def _found(t: Tables) -> DataFrame:
    return rules.variants_at_risk(_genes(t), _frame(t, knowledge.SNP_RULES, _SNPS))


@query(f"WITH {_GENES} SELECT user_id, rsid, gene, genotype, risk, condition, rank FROM found JOIN {V(knowledge.RISK_ORDER, 'o', 'risk, rank')} USING (risk)")
def genetic_risks(t: Tables) -> DataFrame:
    """Variants at risk with their rank, the gravest first being 0."""
    return _found(t).join(_frame(t, knowledge.RISK_ORDER, "risk string, rank int"), "risk").select("user_id", "rsid", "gene", "genotype", "risk", "condition", "rank")


@query(f"WITH {_RES}, {_GENES} SELECT f.user_id, rsid, risk, test, round(value, 6) AS value, state FROM found f JOIN (SELECT *, {_STATE} AS state FROM last) s ON s.user_id = f.user_id AND s.canonical_name = test WHERE state <> 'normal'")
def variant_labs(t: Tables) -> DataFrame:
    """Variants at risk whose test is abnormal too."""
    last = rules.stated(series.latest(_results(t))).where("state != 'normal'").select("user_id", F.col("canonical_name").alias("test"), "value", "state")
    return _found(t).join(last, ["user_id", "test"]).select("user_id", "rsid", "risk", "test", F.round("value", 6).alias("value"), "state")


_PROFILES = f"""prof AS (SELECT user_id, enzyme, max((coalesce(severity, 0), coalesce(status, 'normal')))  AS w, arg_max(coalesce(status, 'normal'), (coalesce(severity, 0), coalesce(status, 'normal'))) AS status, count(DISTINCT rsid) AS variants FROM genes JOIN {V(knowledge.ENZYME_SNPS, 'e', 'enzyme, rsid')} USING (rsid)
  LEFT JOIN (SELECT rsid, genotype, risk FROM {V(knowledge.SNP_RULES, 'k', 'rsid, gene, genotype, risk, condition, test, pathway')}) k USING (rsid, genotype) LEFT JOIN {V(knowledge.RISK_STATUS, 's', 'risk, status, severity')} USING (risk) GROUP BY user_id, enzyme)"""


def _profiles(t: Tables) -> DataFrame:
    return rules.enzyme_profiles(_genes(t), _frame(t, knowledge.SNP_RULES, _SNPS), _frame(t, knowledge.ENZYME_SNPS, "enzyme string, rsid string"), _frame(t, knowledge.RISK_STATUS, "risk string, status string, severity int"))


@query(f"WITH {_GENES}, {_PROFILES} SELECT user_id, enzyme, status, variants FROM prof")
def enzyme_profiles(t: Tables) -> DataFrame:
    return _profiles(t)


@query(f"WITH {_MEDS}, {_GENES}, {_PROFILES} SELECT p.user_id, enzyme, m.drug, p.status, CASE WHEN p.status = 'poor' THEN 'high' ELSE 'medium' END AS severity FROM prof p JOIN {V(knowledge.ENZYME_DRUGS, 'd', 'enzyme, drug')} USING (enzyme) JOIN (SELECT DISTINCT user_id, drug FROM meds WHERE status = 'active') m ON m.user_id = p.user_id AND m.drug = d.drug WHERE p.status <> 'normal'")
def drug_gene_flags(t: Tables) -> DataFrame:
    """Active drugs that an enzyme breaks down which is not normal."""
    active = _meds(t).where("status = 'active'").select("user_id", "drug").distinct()
    j = _profiles(t).where("status != 'normal'").join(_frame(t, knowledge.ENZYME_DRUGS, "enzyme string, drug string"), "enzyme").join(active, ["user_id", "drug"])
    return j.select("user_id", "enzyme", "drug", "status", F.when(F.col("status") == "poor", "high").otherwise("medium").alias("severity"))


@query(f"WITH {_GENES}, g AS (SELECT user_id, pathway, count(*) AS variants, count(*) FILTER (risk = 'elevated') AS e FROM found GROUP BY ALL) SELECT user_id, pathway, variants, least(CASE variants WHEN 1 THEN 3.0 WHEN 2 THEN 5.0 WHEN 3 THEN 7.0 ELSE 10.0 END::DOUBLE + e * 0.5, 10.0) AS score FROM g")
def pathway_impacts(t: Tables) -> DataFrame:
    return rules.pathway_impact(_found(t))


_ACTIVE = "act AS (SELECT DISTINCT user_id, drug FROM meds WHERE status = 'active' AND drug IS NOT NULL)"


@query(f"""WITH {_MEDS}, {_ACTIVE}, r AS (SELECT DISTINCT user_id, enzyme, drug, role FROM act JOIN {V(knowledge.DRUG_ENZYMES, 'k', 'drug, enzyme, role')} USING (drug))
SELECT a.user_id, a.enzyme, a.drug AS drug_a, a.role AS role_a, b.drug AS drug_b, b.role AS role_b, coalesce(severity, 'minor') AS severity FROM r a JOIN r b ON a.user_id = b.user_id AND a.enzyme = b.enzyme AND a.drug < b.drug AND a.role <> b.role LEFT JOIN {V(knowledge.ROLE_CONFLICTS, 'c', 'ra, rb, severity')} ON ra = a.role AND rb = b.role""")
def enzyme_conflicts(t: Tables) -> DataFrame:
    active = _meds(t).where("status = 'active' AND drug IS NOT NULL").select("user_id", "drug").distinct()
    return rules.role_conflicts(active, _frame(t, knowledge.DRUG_ENZYMES, "drug string, enzyme string, role string"), _frame(t, knowledge.ROLE_CONFLICTS, "role_a string, role_b string, severity string"))


_RISKY = ", ".join(f"'{x}'" for x in knowledge.HIGH_RISK_PATHWAYS)


@query(f"WITH {_MEDS}, {_ACTIVE} SELECT user_id, pathway, effect, count(DISTINCT drug) AS drugs, CASE WHEN pathway IN ({_RISKY}) THEN 'major' ELSE 'moderate' END AS severity FROM act JOIN {V(knowledge.DRUG_PATHWAYS, 'k', 'drug, pathway, effect')} USING (drug) GROUP BY user_id, pathway, effect HAVING count(DISTINCT drug) >= 2")
def stacked_pathways(t: Tables) -> DataFrame:
    active = _meds(t).where("status = 'active' AND drug IS NOT NULL").select("user_id", "drug").distinct()
    return rules.stacked_pathways(active, _frame(t, knowledge.DRUG_PATHWAYS, "drug string, pathway string, effect int"), knowledge.HIGH_RISK_PATHWAYS)


@query(f"""WITH {_RES}, f AS (SELECT user_id, canonical_name, arg_min(value, (day, obs_id)) AS baseline FROM res GROUP BY ALL), j AS (SELECT l.user_id, metric, baseline, value, target, direction = 'below' AS below FROM last l JOIN f USING (user_id, canonical_name) JOIN {V(knowledge.GOALS, 'g', 'metric, target, direction')} ON metric = l.canonical_name),
p AS (SELECT *, CASE WHEN below THEN value <= target ELSE value >= target END AS done, CASE WHEN below THEN baseline - target ELSE target - baseline END AS way, CASE WHEN below THEN baseline - value ELSE value - baseline END AS gone FROM j),
q AS (SELECT *, round(CASE WHEN done THEN 100.0 WHEN way > 0 THEN greatest(least(gone / way * 100, 100.0), 0.0) ELSE 0.0 END::DOUBLE, 6) AS pct FROM p) SELECT user_id, metric, round(baseline, 6) AS baseline, round(value, 6) AS value, pct, CASE WHEN done THEN 'achieved' WHEN pct >= 25 THEN 'on_track' ELSE 'off_track' END AS status FROM q""")
def goal_progress(t: Tables) -> DataFrame:
    dated = cut(_dated(t))
    got = rules.goal_progress(dated, series.latest(dated), _frame(t, knowledge.GOALS, "metric string, target double, direction string"))
    return got.select("user_id", "metric", F.round("baseline", 6).alias("baseline"), F.round("value", 6).alias("value"), "pct", "status")


_HALF = f"half AS (SELECT res.* FROM res, upto WHERE day > as_of - 180), {_trend_sql('half', 'user_id, canonical_name', 'day', 'obs_id', 3)}"
_WATCH = f"""{_AS_OF}, {_HALF}, late AS (SELECT user_id, l.canonical_name, as_of - (day + months * 30) AS days FROM last l JOIN {V(dims.INTERVALS, 'd', 'canonical_name, months')} USING (canonical_name), upto),
alerts AS (SELECT user_id, 'overdue' AS kind, canonical_name AS item, 'watch' AS severity FROM late WHERE days > 60 UNION ALL SELECT user_id, 'trend', canonical_name, CASE WHEN abs(pct_change) > 25 THEN 'urgent' ELSE 'watch' END FROM told WHERE direction <> 'stable' AND abs(pct_change) > 10)"""


def _alerts(t: Tables) -> tuple[DataFrame, object]:
    dated = cut(_dated(t))
    as_of = _as_of(dated)
    late = series.latest(dated).join(_frame(t, dims.INTERVALS, _r("months int")), "canonical_name").where(F.datediff(as_of, F.expr("date_add(day, months * 30)")) > 60)
    told = series.trend(dated.where(F.col("day") > F.date_sub(as_of, 180)), ("user_id", "canonical_name"), "day", "value", 3).where("direction != 'stable' AND abs(pct_change) > 10")
    a = late.select("user_id", F.lit("overdue").alias("kind"), F.col("canonical_name").alias("item"), F.lit("watch").alias("severity"))
    b = told.select("user_id", F.lit("trend").alias("kind"), F.col("canonical_name").alias("item"), F.when(F.abs("pct_change") > 25, "urgent").otherwise("watch").alias("severity"))
    return a.unionByName(b), as_of


@query(f"WITH {_RES}, {_WATCH} SELECT user_id, kind, item, severity, substr(sha256(kind || ':' || item || ':' || strftime(as_of, '%G-W%V')), 1, 16) AS alert_key FROM alerts, upto")
def watcher_alerts(t: Tables) -> DataFrame:
    """Tests overdue by more than 60 days and trends of half a year above 10 %, with the key that the week's alerts
    share."""
    alerts, as_of = _alerts(t)
    return alerts.select("user_id", "kind", "item", "severity", rules.alert_key(F.col("kind"), F.col("item"), as_of).alias("alert_key"))


@query(f"""WITH {_RES}, {_MEDS}, {_WATCH}, a AS (SELECT user_id, count(*) FILTER (kind = 'overdue') AS overdue, count(*) FILTER (kind = 'trend') AS trends, count(*) FILTER (severity = 'urgent') AS urgent FROM alerts GROUP BY user_id),
m AS (SELECT user_id, count(DISTINCT drug) AS drugs FROM meds WHERE status = 'active' GROUP BY user_id), l AS (SELECT user_id, count(*) AS tests, count(*) FILTER (value > high OR value < low) AS abnormal, max(day) AS newest FROM last GROUP BY user_id)
SELECT user_id, tests, abnormal, newest, coalesce(overdue, 0) AS overdue, coalesce(trends, 0) AS trends, coalesce(urgent, 0) AS urgent, coalesce(drugs, 0) AS drugs FROM l LEFT JOIN a USING (user_id) LEFT JOIN m USING (user_id)""")
def daily_digest(t: Tables) -> DataFrame:
    """One row a user: what is abnormal, overdue, moving and taken."""
    alerts, _ = _alerts(t)
    a = alerts.groupBy("user_id").agg(F.count_if(F.col("kind") == "overdue").alias("overdue"), F.count_if(F.col("kind") == "trend").alias("trends"), F.count_if(F.col("severity") == "urgent").alias("urgent"))
    m = _meds(t).where("status = 'active'").groupBy("user_id").agg(F.countDistinct("drug").alias("drugs"))
    last = series.latest(_results(t)).groupBy("user_id").agg(F.count("*").alias("tests"), F.count_if((F.col("value") > F.col("high")) | (F.col("value") < F.col("low"))).alias("abnormal"), F.max("day").alias("newest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return last.join(a, "user_id", "left").join(m, "user_id", "left").select("user_id", "tests", "abnormal", "newest", zero("overdue"), zero("trends"), zero("urgent"), zero("drugs"))


_TOLD_TOP = f"WITH {_RES}, {_trend_sql('res', 'user_id, canonical_name', 'day', 'obs_id', 3)} SELECT user_id, canonical_name, direction, round(pct_change, 4) AS pct_change FROM told WHERE direction <> 'stable' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(abs(pct_change), 6) DESC, canonical_name) <= 10"


@query(_TOLD_TOP)
def top_trends(t: Tables) -> DataFrame:
    """The ten trends of each user that moved most: a top-k report."""
    from pyspark.sql import Window

    got = series.trend(_results(t), ("user_id", "canonical_name"), "day", "value", 3).where("direction != 'stable'")
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round(F.abs("pct_change"), 6)), "canonical_name")
    return got.withColumn("_r", F.row_number().over(w)).where("_r <= 10").select("user_id", "canonical_name", "direction", r4("pct_change"))


_SEVERITY_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.SEVERITY.items()) + " END"


@query(f"""WITH {_MEDS}, a AS (SELECT DISTINCT user_id, drug FROM meds WHERE status = 'active' AND drug IS NOT NULL), i AS (SELECT x.user_id, substance_a, substance_b, severity FROM a x JOIN {V(dims.INTERACTIONS, 'd', 'substance_a, substance_b, severity, mechanism')} ON x.drug = substance_a JOIN a y ON y.user_id = x.user_id AND y.drug = substance_b)
SELECT user_id, substance_a, substance_b, severity, row_number() OVER (PARTITION BY user_id ORDER BY {_SEVERITY_SQL}, substance_a, substance_b) AS place FROM i""")
def ranked_interactions(t: Tables) -> DataFrame:
    """A user's interactions from the gravest down."""
    from pyspark.sql import Window

    got = series.pair_interactions(_meds(t), _frame(t, dims.INTERACTIONS, "substance_a string, substance_b string, severity string, mechanism string"))
    rank = F.lit(9)
    for name, place in dims.SEVERITY.items():
        rank = F.when(F.col("severity") == name, place).otherwise(rank)
    w = Window.partitionBy("user_id").orderBy(rank, "substance_a", "substance_b")
    return got.select("user_id", "substance_a", "substance_b", "severity", F.row_number().over(w).alias("place"))


@query(f"""WITH {_RES}, {_MEDS}, {_AS_OF}, {_ACTIVE}, j AS (SELECT DISTINCT l.user_id, act.drug, l.canonical_name, l.day, {_STATE} AS state FROM act JOIN {V(dims.DRUG_TESTS, 'd', 'drug, canonical_name, wanted')} ON d.drug = act.drug JOIN last l ON l.user_id = act.user_id AND l.canonical_name = d.canonical_name),
n AS (SELECT user_id, drug, arg_max(canonical_name, (day, canonical_name)) AS canonical_name, arg_max(state, (day, canonical_name)) AS s FROM j GROUP BY ALL)
SELECT user_id, drug, CASE WHEN s = 'normal' THEN 'paused' ELSE 'active' END AS state, CASE WHEN s = 'normal' THEN as_of + coalesce(weeks, {knowledge.PAUSE_WEEKS_ELSE}) * 7 END AS resume_after FROM n LEFT JOIN {V(knowledge.PAUSE_WEEKS, 'w', 'canonical_name, weeks')} USING (canonical_name), upto""")
def reminder_states(t: Tables) -> DataFrame:
    """Reminders of active drugs, paused while the test they act on is normal."""
    dated = cut(_dated(t))
    active = _meds(t).where("status = 'active' AND drug IS NOT NULL").select("user_id", "drug").distinct()
    acts = _frame(t, dims.DRUG_TESTS, "drug string, canonical_name string, wanted string")
    return rules.reminder_states(active, acts, series.latest(dated), _frame(t, knowledge.PAUSE_WEEKS, _r("weeks int")), knowledge.PAUSE_WEEKS_ELSE, _as_of(dated))
