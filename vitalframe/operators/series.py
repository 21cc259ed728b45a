"""Analyses of series, for all users at once: latest and previous results, trends, anomalies, correlations, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe import dims
from vitalframe.operators.records import state_of


def newest_first(*keys: str, order: tuple[str, ...] = ("day", "obs_id")) -> Window:
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])


def latest(df: DataFrame, keys: tuple[str, ...] = ("user_id", "canonical_name")) -> DataFrame:
    """The newest row of each key (day, then id); no limit before the ranking. The row number of one lets Spark keep
    only one row of a key before the shuffle."""
    return df.withColumn("_r", F.row_number().over(newest_first(*keys))).where("_r = 1").drop("_r")


def latest_and_previous(df: DataFrame) -> DataFrame:
    """(user_id, canonical_name, obs_id, day, value, prev_value, prev_day, pct_change): the newest result of each test
    and the one before it (null where there is none). A zero before gives a null change."""
    w = newest_first("user_id", "canonical_name")
    got = df.withColumn("_r", F.row_number().over(w)).withColumn("prev_value", F.lead("value").over(w)).withColumn("prev_day", F.lead("day").over(w)).withColumn("prev_low", F.lead("low").over(w)).withColumn("prev_high", F.lead("high").over(w))
    pct = F.when(F.col("prev_value") != 0, (F.col("value") - F.col("prev_value")) / F.abs("prev_value") * 100)
    return got.where("_r = 1").withColumn("pct_change", pct).drop("_r")


def trend(df: DataFrame, keys: tuple[str, ...], at: str, value: str, least: int, flat_pct: float = 5.0, flat_r2: float = 0.1) -> DataFrame:
    """Least-squares trend of each key over days: n, slope (per day), r2 (0 for a constant series), first and last
    value, pct_change and direction. Fewer than ``least`` points, or all on one day, give no row; a zero start is
    compared by the absolute change."""
    x = F.datediff(F.col(at), F.lit("1970-01-01").cast("date")).cast("double")
    tie = [c for c in ("obs_id", "id") if c in df.columns]
    order = F.struct(F.col(at), *tie)
    g = df.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(F.col(value), x).alias("slope"), F.when(F.var_pop(value) == 0, 0.0).otherwise(F.regr_r2(F.col(value), x)).alias("r2"),
        F.min_by(F.col(value), order).alias("first_value"), F.max_by(F.col(value), order).alias("last_value"), F.min(at).alias("first_day"), F.max(at).alias("last_day"),
    )
    change = F.col("last_value") - F.col("first_value")
    pct = F.when(F.col("first_value") != 0, change / F.abs("first_value") * 100).otherwise(change)
    got = g.where((F.col("n") >= least) & (F.col("first_day") < F.col("last_day"))).withColumn("pct_change", pct)
    flat = (F.abs("pct_change") < flat_pct) | (F.col("r2") < flat_r2)
    return got.withColumn("direction", F.when(flat, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing"))


def rolling_anomalies(long: DataFrame, rules: DataFrame) -> DataFrame:
    """Days on which a metric breaks its rule against the mean of the up to 7 days with a value before it (3 at
    least): (user_id, provider, date, metric, value, baseline, pct, severity)."""
    w = Window.partitionBy("user_id", "provider", "metric").orderBy("date").rowsBetween(-7, -1)
    got = long.join(rules, "metric").withColumn("baseline", F.avg("value").over(w)).withColumn("_n", F.count("value").over(w)).where("_n >= 3")
    got = got.withColumn("pct", F.when(F.col("baseline") != 0, (F.col("value") - F.col("baseline")) / F.abs("baseline") * 100))
    hit = ((F.col("rule") == "pct_below") & (F.col("pct") < -F.col("bound"))) | ((F.col("rule") == "pct_above") & (F.col("pct") > F.col("bound"))) | ((F.col("rule") == "below") & (F.col("value") < F.col("bound"))) | ((F.col("rule") == "above") & (F.col("value") > F.col("bound")))
    return got.where(hit).select("user_id", "provider", "date", "metric", "value", "baseline", "pct", "severity")


def correlations(labs: DataFrame, wear: DataFrame, least: int = 5, least_r: float = 0.3) -> DataFrame:
    """Pearson correlation of each user's tests with the wearable metrics of the same day, for all pairs in one join:
    (user_id, canonical_name, metric, n, r, strength). Several results of a test and day, and several providers'
    values of a day, are averaged first; constant series have no correlation."""
    a = labs.groupBy("user_id", "canonical_name", "day").agg(F.avg("value").alias("x"))
    b = wear.groupBy("user_id", "metric", F.col("date").alias("day")).agg(F.avg("value").alias("y"))
    g = a.join(b, ["user_id", "day"]).groupBy("user_id", "canonical_name", "metric").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("_c"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"))
    g = g.withColumn("r", F.when((F.col("_vx") > 1e-12) & (F.col("_vy") > 1e-12), F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy")))).drop("_c")
    got = g.where((F.col("n") >= least) & (F.col("_vx") > 1e-12) & (F.col("_vy") > 1e-12) & (F.abs("r") > least_r)).drop("_vx", "_vy")
    r = F.abs("r")
    return got.withColumn("strength", F.when(r >= 0.7, "strong").when(r >= 0.4, "moderate").when(r >= 0.2, "weak").otherwise("none"))


def panel_delta(df: DataFrame) -> DataFrame:
    """The user's tests on the newest day against the day before it that has tests: new, resolved, or the change.
    Of several results of a test and day the greatest id counts."""
    w = Window.partitionBy("user_id").orderBy(F.desc("day"))
    per_day = df.groupBy("user_id", "canonical_name", "day").agg(F.max_by("value", "obs_id").alias("value"))
    ranked = per_day.withColumn("_d", F.dense_rank().over(w)).where("_d <= 2")
    now = ranked.where("_d = 1").select("user_id", "canonical_name", F.col("value").alias("value"))
    then = ranked.where("_d = 2").select("user_id", "canonical_name", F.col("value").alias("prev_value"))
    had = then.select("user_id").distinct()
    j = now.join(had, "user_id", "left_semi").join(then, ["user_id", "canonical_name"], "full_outer")
    pct = F.when(F.col("prev_value") != 0, (F.col("value") - F.col("prev_value")) / F.abs("prev_value") * 100)
    change = F.when(F.col("prev_value").isNull(), "new").when(F.col("value").isNull(), "resolved").when(F.coalesce(F.abs(pct), F.lit(0.0)) < 3, "stable").when(F.col("value") > F.col("prev_value"), "up").otherwise("down")
    return j.withColumn("pct", pct).withColumn("change", change)


def treatment_response(meds: DataFrame, labs: DataFrame, rules: DataFrame) -> DataFrame:
    """For each medication and the test it acts on: the last value before its start and the latest at or after it; a
    change of 15 % at least in either direction, said to be as wanted or not."""
    m = meds.where("start_day IS NOT NULL").join(rules, "drug").select("user_id", "med_id", "drug", "start_day", "canonical_name", "wanted")
    j = m.join(labs.select("user_id", "canonical_name", "day", "obs_id", "value"), ["user_id", "canonical_name"])
    at = F.struct("day", "obs_id")
    before, after = F.col("day") < F.col("start_day"), F.col("day") >= F.col("start_day")
    g = j.groupBy("user_id", "med_id", "drug", "canonical_name", "wanted").agg(F.max_by(F.when(before, F.col("value")), F.when(before, at)).alias("before"), F.max_by(F.when(after, F.col("value")), F.when(after, at)).alias("after"))
    pct = (F.col("after") - F.col("before")) / F.abs("before") * 100
    got = g.where("before IS NOT NULL AND after IS NOT NULL AND before != 0").withColumn("pct", pct).where("abs(pct) >= 15")
    return got.withColumn("as_wanted", F.when(F.col("wanted") == "decrease", F.col("pct") < 0).otherwise(F.col("pct") > 0))


def baseline_nearest(meds: DataFrame, labs: DataFrame, rules: DataFrame, before: int = 90, after: int = 7) -> DataFrame:
    """The value nearest to a medication's start within [start - before, start + after] (ties: the later day, then the
    greater id) of each test it acts on."""
    m = meds.where("start_day IS NOT NULL").join(rules, "drug").select("user_id", "med_id", "start_day", "canonical_name")
    j = m.join(labs.select("user_id", "canonical_name", "day", "obs_id", "value"), ["user_id", "canonical_name"]).where(F.col("day").between(F.date_sub("start_day", before), F.date_add("start_day", after)))
    w = Window.partitionBy("med_id", "canonical_name").orderBy(F.abs(F.datediff("day", "start_day")), F.desc("day"), F.desc("obs_id"))
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("user_id", "med_id", "canonical_name", "obs_id", "day", "value")


def pair_interactions(meds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of a user's active drugs that interact: the pair table is joined from both of its sides, so no pair of
    drugs is formed that isn't listed."""
    active = meds.where("status = 'active' AND drug IS NOT NULL").select("user_id", "drug").distinct()
    a = active.withColumnRenamed("drug", "substance_a").join(pairs, "substance_a")
    return a.join(active.withColumnRenamed("drug", "substance_b"), ["user_id", "substance_b"]).select("user_id", "substance_a", "substance_b", "severity", "mechanism")


def pattern_scores(last: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns of abnormal latest results: every trigger must hold, each other that holds adds to the confidence:
    (user_id, pattern, confidence, supporting, missing)."""
    counted = last.withColumn("state", state_of(F.col("value"), F.col("low"), F.col("high")))
    # Users with a trigger are found first, so that the rules are spread over no more users than need be.
    first = patterns.where("needed")
    candidates = counted.join(first, "canonical_name").where("state = direction").select("user_id", "pattern").distinct()
    wanted = candidates.join(patterns, "pattern").join(counted.select("user_id", "canonical_name", "state"), ["user_id", "canonical_name"], "left")
    held = F.coalesce(F.col("state") == F.col("direction"), F.lit(False))
    g = wanted.groupBy("user_id", "pattern").agg(F.bool_and(held | ~F.col("needed")).alias("_all"), F.sum(F.when(held, F.col("adds")).otherwise(0.0)).alias("c"), F.count_if(held).alias("supporting"), F.count_if(F.col("state").isNull()).alias("missing"))
    return g.where("_all").select("user_id", "pattern", F.round(F.least("c", F.lit(dims.PATTERN_CAP)), 4).alias("confidence"), "supporting", "missing")


def panel_gaps(tests_done: DataFrame, panels: DataFrame) -> DataFrame:
    """Panels of which a user has had some tests and not others: (user_id, panel, had, missing)."""
    size = panels.groupBy("panel").agg(F.count("*").alias("size"))
    had = tests_done.select("user_id", "canonical_name").distinct().join(panels, "canonical_name").groupBy("user_id", "panel").agg(F.count("*").alias("had"))
    return had.join(F.broadcast(size), "panel").where("had < size").select("user_id", "panel", "had", (F.col("size") - F.col("had")).alias("missing"))


def conditional_gaps(last: DataFrame, rules: DataFrame) -> DataFrame:
    """Companion tests never done although the trigger's latest result is abnormal."""
    hit = last.withColumn("state", state_of(F.col("value"), F.col("low"), F.col("high"))).where("state != 'normal'").join(rules, F.col("canonical_name") == F.col("trigger")).select("user_id", "trigger", "companion")
    done = last.select("user_id", F.col("canonical_name").alias("companion"))
    return hit.join(done, ["user_id", "companion"], "left_anti").select("user_id", "trigger", "companion")


def domain_scores(last: DataFrame, domains: DataFrame) -> DataFrame:
    """100 less 100 / (tests in the domain) for each abnormal latest result: (user_id, domain, score, tests_found)."""
    size = domains.groupBy("domain").agg(F.count("*").alias("size"))
    bad = (F.col("value") > F.col("high")) | (F.col("value") < F.col("low"))
    g = last.join(domains.select("domain", "canonical_name"), "canonical_name").groupBy("user_id", "domain").agg(F.count("*").alias("tests_found"), F.count_if(bad).alias("bad"))
    return g.join(F.broadcast(size), "domain").select("user_id", "domain", (100 - F.col("bad") * 100 / F.col("size")).alias("score"), "tests_found")


def composite(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean of a user's domain scores, weights scaled to the domains that are there, and its grade."""
    g = scores.join(weights, "domain").groupBy("user_id").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("score"), F.count("*").alias("domains"))
    s = F.col("score")
    return g.withColumn("grade", F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F"))


def streaks(days: DataFrame, keys: tuple[str, ...] = ("user_id", "provider")) -> DataFrame:
    """Runs of consecutive days: (keys, start, end, days)."""
    w = Window.partitionBy(*keys).orderBy("date")
    island = days.select(*keys, "date").distinct().withColumn("_g", F.date_sub("date", F.row_number().over(w)))
    return island.groupBy(*keys, "_g").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")).drop("_g")


def half_split(long: DataFrame, rows: int = 14) -> DataFrame:
    """Change of the mean from the older to the newer half of the newest rows of each metric, in percent."""
    keys = ("user_id", "provider", "metric")
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    got = long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
    n = F.count("*").over(Window.partitionBy(*keys))
    got = got.withColumn("_n", n).where("_n >= 4")
    half = F.floor(F.col("_n") / 2)
    newer = F.col("_r") <= F.col("_n") - half
    g = got.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(~newer, F.col("value"))).alias("older"), F.avg(F.when(newer, F.col("value"))).alias("newer"))
    return g.withColumn("pct", F.when(F.col("older") != 0, (F.col("newer") - F.col("older")) / F.abs("older") * 100))


def egfr(creatinine: Column, age: Column, female: Column) -> Column:
    """CKD-EPI 2021 of creatinine in mg/dL."""
    k, a = F.when(female, 0.7).otherwise(0.9), F.when(female, -0.241).otherwise(-0.302)
    r = creatinine / k
    return 142 * F.pow(F.least(r, F.lit(1.0)), a) * F.pow(F.greatest(r, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def readiness(days: DataFrame) -> DataFrame:
    """Readiness of each user and provider on the newest day: five parts of 0 to 100 against the mean of the 30 days
    before it (hrv, rhr) and the last three rows (strain). A part without data is 50, strain 80:
    (user_id, provider, date, hrv_part, rhr_part, sleep_part, recovery_part, strain_part, score, grade)."""
    key = Window.partitionBy("user_id", "provider").orderBy("_d")
    before, three = key.rangeBetween(-30, -1), key.rowsBetween(-2, 0)
    got = days.withColumn("_d", F.datediff("date", F.lit("1970-01-01").cast("date"))).select("*", F.avg("hrv").over(before).alias("_hrv"), F.avg("rhr").over(before).alias("_rhr"), F.avg("strain").over(three).alias("_strain"), F.row_number().over(Window.partitionBy("user_id", "provider").orderBy(F.desc("date"))).alias("_r")).where("_r = 1")
    clamp = lambda x, none: F.when(x.isNull(), none).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)))
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    m = F.col("sleep_duration_min").cast("double")
    slept = F.when(m >= 480, 100.0).when(m <= 300, 0.0).when(m <= 420, (m - 300) / 120 * 70).otherwise(70 + (m - 420) / 60 * 30)
    got = got.select("user_id", "provider", "date", clamp((over("hrv", "_hrv") - 0.6) / 0.6 * 100, 50.0).alias("hrv_part"), clamp((1.15 - over("rhr", "_rhr")) / 0.25 * 100, 50.0).alias("rhr_part"), clamp(F.coalesce(F.col("sleep_score"), F.when(m.isNotNull(), slept)), 50.0).alias("sleep_part"), clamp(F.col("recovery_score"), 50.0).alias("recovery_part"), clamp((18 - F.col("_strain")) / 8 * 100, 80.0).alias("strain_part"))
    got = got.withColumn("score", reduce(lambda a, b: a + b, [F.col(f"{k}_part") * w for k, w in dims.READINESS.items()]))
    grade = F.lit("rest")
    for name, least in reversed(dims.READINESS_GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return got.withColumn("grade", grade)


def sleep_stages(days: DataFrame) -> DataFrame:
    """Shares of the sleep stages of each night and whether they are low or high; nights without total or without any
    stage are left out, a missing stage counts 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.col("sleep_duration_min")
    ok = (total > 0) & (zero("rem_min") + zero("deep_min") + zero("light_min") > 0)
    got = days.where(ok).select("user_id", "provider", "date", *[(zero(f"{s}_min") / total * 100).alias(f"{s}_pct") for s in ("rem", "deep", "light")])
    for s, (low, high) in dims.SLEEP_NORMS.items():
        got = got.withColumn(f"{s}_status", F.when(F.col(f"{s}_pct") < low, "low").when(F.col(f"{s}_pct") > high, "high").otherwise("normal"))
    return got.withColumn("too_light", F.col("light_pct") > dims.LIGHT_MOST)


def overtraining(long: DataFrame, rows: int = 30) -> DataFrame:
    """Signals of overtraining in the newest rows with a value of each metric: resting rate raised above 110 % of the
    older mean on five of seven days, variability down by 15 % from the last three to the first three of seven, mean
    strain of five above 16, recovery below 40 on three of five, sleep score below 60 on five of seven:
    (user_id, provider, signal)."""
    w = Window.partitionBy("user_id", "provider", "metric").orderBy(F.desc("date"))
    k = long.where(F.col("metric").isin("rhr", "hrv", "strain", "recovery_score", "sleep_score")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
    among = Window.partitionBy("user_id", "provider", "metric")
    r, v = F.col("_r"), F.col("value")
    k = k.withColumn("_older", F.avg(F.when(r > 7, v)).over(among))
    g = k.groupBy("user_id", "provider", "metric").agg(
        F.count("*").alias("n"), F.count_if((r <= 7) & (v > F.col("_older") * 1.10)).alias("raised"), F.avg(F.when(r <= 3, v)).alias("new3"), F.avg(F.when(r.between(5, 7), v)).alias("old3"),
        F.avg(F.when(r <= 5, v)).alias("mean5"), F.count_if((r <= 5) & (v < 40)).alias("low5"), F.count_if((r <= 7) & (v < 60)).alias("poor7"),
    )
    m, n = F.col("metric"), F.col("n")
    signal = (
        F.when((m == "rhr") & (n >= 10) & (F.col("raised") >= 5), "rhr_elevated")
        .when((m == "hrv") & (n >= 7) & (F.col("old3") > 0) & ((F.col("old3") - F.col("new3")) / F.col("old3") * 100 > 15), "hrv_declining")
        .when((m == "strain") & (n >= 5) & (F.col("mean5") > 16), "high_strain").when((m == "recovery_score") & (n >= 5) & (F.col("low5") >= 3), "low_recovery").when((m == "sleep_score") & (n >= 5) & (F.col("poor7") >= 5), "poor_sleep")
    )
    return g.select("user_id", "provider", signal.alias("signal")).where("signal IS NOT NULL")
