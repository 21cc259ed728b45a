"""Joins of results, medications and variants to rules, for all users at once. Rules are small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.operators.records import state_of


def stated(last: DataFrame) -> DataFrame:
    return last.withColumn("state", state_of(F.col("value"), F.col("low"), F.col("high")))


def layered_ranges(results: DataFrame, people: DataFrame, default: DataFrame, ages: DataFrame, female_ages: DataFrame, female: DataFrame, ethnic: DataFrame) -> DataFrame:
    """results with ``range_low``, ``range_high`` and ``layer``: that of the ethnicity, else of the age (of women first),
    else, where the age is not known, of women, else the default. Each layer is one join: those of age by the test and
    a range of ages. people: (user_id, age, female, ethnicity), each user once."""
    r = results.join(people, "user_id", "left").join(default.select("canonical_name", F.col("low").alias("_dl"), F.col("high").alias("_dh")), "canonical_name", "left")
    r = r.withColumn("_row", F.struct("obs_id"))
    for name, table, who in (("_f", female_ages, F.col("female")), ("_a", ages, F.lit(True))):
        t = table.select(F.col("canonical_name").alias(f"{name}c"), F.col("age_from").alias(f"{name}1"), F.col("age_to").alias(f"{name}2"), F.col("low").alias(f"{name}l"), F.col("high").alias(f"{name}h"))
        r = r.join(t, (F.col("canonical_name") == F.col(f"{name}c")) & F.col("age").between(F.col(f"{name}1"), F.col(f"{name}2")) & who, "left")
    w = female.select(F.col("canonical_name").alias("_wc"), F.col("low").alias("_wl"), F.col("high").alias("_wh"))
    r = r.join(w, (F.col("canonical_name") == F.col("_wc")) & F.col("age").isNull() & F.col("female"), "left")
    e = ethnic.select(F.col("ethnicity").alias("_ee"), F.col("canonical_name").alias("_ec"), F.col("low").alias("_el"), F.col("high").alias("_eh"))
    r = r.join(e, (F.col("canonical_name") == F.col("_ec")) & (F.col("ethnicity") == F.col("_ee")), "left")
    layer = F.when(F.col("_ec").isNotNull(), "ethnicity").when(F.col("_fc").isNotNull(), "female age").when(F.col("_ac").isNotNull(), "age").when(F.col("_wc").isNotNull(), "female").when(F.col("_dl").isNotNull() | F.col("_dh").isNotNull(), "default")
    pick = lambda c: F.coalesce(*[F.when(F.col(f"{n}c").isNotNull(), F.col(f"{n}{c}")) for n in ("_e", "_f", "_a", "_w")], F.col(f"_d{c}"))
    return r.select(*results.columns, pick("l").alias("range_low"), pick("h").alias("range_high"), layer.alias("layer")).where("layer IS NOT NULL")


def present_pairs(have: DataFrame, item: str, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, and what else pairs has) of which a user has both; no pair is formed that isn't listed."""
    rows = have.select("user_id", item).distinct()
    return rows.withColumnRenamed(item, "a").join(pairs, "a").join(rows.withColumnRenamed(item, "b"), ["user_id", "b"])


def due_labs(reasons: DataFrame, last: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, canonical_name, months, reason, last_day, status): tests that a reason asks for and that were never done
    or are overdue. Of several reasons the one that asks most often counts (ties: the first by name)."""
    best = reasons.groupBy("user_id", "canonical_name").agg(F.min(F.struct("months", "reason")).alias("r")).select("user_id", "canonical_name", "r.months", "r.reason")
    j = best.join(last.select("user_id", "canonical_name", F.col("day").alias("last_day")), ["user_id", "canonical_name"], "left")
    late = F.expr("date_add(last_day, months * 30)") < as_of
    return j.withColumn("status", F.when(F.col("last_day").isNull(), "never").when(late, "overdue")).where("status IS NOT NULL")


def retests(dated: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Abnormal results of the year up to as_of that a rule wants repeated and no later result of the test followed, from
    two weeks before the repetition is due: (user_id, canonical_name, state, day, due, status)."""
    recent = stated(dated.where(F.col("day") >= F.date_sub(as_of, 365)))
    newest = recent.groupBy("user_id", "canonical_name").agg(F.max("day").alias("newest"))
    hits = recent.join(rules, ["canonical_name", "state"]).groupBy("user_id", "canonical_name", "state").agg(F.max("day").alias("day"), F.first("weeks_from").alias("weeks_from"), F.first("weeks_to").alias("weeks_to"), F.first("urgent").alias("urgent"))
    # Followed: the newest result of the test lies behind the abnormal one.
    open_ = hits.join(newest, ["user_id", "canonical_name"]).where("newest <= day")
    open_ = open_.withColumn("due", F.expr("date_add(day, weeks_from * 7)")).where(F.datediff("due", as_of) <= 14)
    over = F.datediff(as_of, F.expr("date_add(day, weeks_to * 7)")) > 0
    status = F.when(over & (F.col("due") <= as_of) & F.col("urgent"), "urgent_overdue").when(over & (F.col("due") <= as_of), "overdue").otherwise("due_soon")
    return open_.select("user_id", "canonical_name", "state", "day", "due", status.alias("status"))


def screenings(people: DataFrame, last: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, screening, last_day) of the screenings that a person's age and sex ask for and that are due: never done,
    or longer ago than their months. A screening that no test stands for counts as never done. people: (user_id, age,
    sex 'female', 'male' or null); an unknown age or sex asks for nothing that needs it."""
    fits = (F.col("age") >= F.col("age_from")) & ((F.col("age_to") == 0) | (F.col("age") <= F.col("age_to"))) & ((F.col("for_sex") == "any") | (F.col("for_sex") == F.col("sex")))
    j = people.join(rules, fits).join(last.select(F.col("user_id").alias("_u"), F.col("canonical_name").alias("_c"), F.col("day").alias("last_day")), (F.col("user_id") == F.col("_u")) & (F.col("test") == F.col("_c")), "left")
    due = F.col("last_day").isNull() | ((F.col("months") > 0) & (F.expr("date_add(last_day, months * 30)") < as_of))
    return j.where(due).select("user_id", "screening", "last_day")


def stress(days: DataFrame, signals: DataFrame, levels: list[tuple[str, float]], rows: int = 7) -> DataFrame:
    """(user_id, provider, score, level, signals): the weights of the metrics whose mean moved the bad way from the older
    to the newer half of the newest ``rows`` days' values (three at least, the middle one being newer). days: long."""
    w = Window.partitionBy("user_id", "provider").orderBy(F.desc("date"))
    newest = days.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= rows)
    k = Window.partitionBy("user_id", "provider", "metric")
    v = newest.join(signals, "metric").withColumn("_i", F.row_number().over(k.orderBy("date"))).withColumn("_n", F.count("*").over(k))
    older = F.col("_i") <= F.floor(F.col("_n") / 2)
    g = v.where("_n >= 3").groupBy("user_id", "provider", "metric", "bad", "weight", "least").agg(F.avg(F.when(older, F.col("value"))).alias("a"), F.avg(F.when(~older, F.col("value"))).alias("b"))
    pct = F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a") * 100).otherwise(0.0)
    hit = pct * F.col("bad") > F.col("least")
    s = g.groupBy("user_id", "provider").agg(F.round(F.least(F.sum(F.when(hit, F.col("weight")).otherwise(0.0)), F.lit(1.0)), 6).alias("score"), F.count_if(hit).alias("signals"))
    level = F.lit("low")
    for name, least in reversed(levels):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return s.select("user_id", "provider", "score", level.alias("level"), "signals")


def goal_progress(dated: DataFrame, last: DataFrame, goals: DataFrame) -> DataFrame:
    """(user_id, metric, baseline, value, pct, status): how far from the first value to the target the latest one is."""
    order = F.struct("day", "obs_id")
    first = dated.groupBy("user_id", "canonical_name").agg(F.min_by("value", order).alias("baseline"))
    j = last.select("user_id", "canonical_name", "value").join(first, ["user_id", "canonical_name"]).join(goals, F.col("canonical_name") == F.col("metric"))
    below = F.col("direction") == "below"
    done = F.when(below, F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    way = F.when(below, F.col("baseline") - F.col("target")).otherwise(F.col("target") - F.col("baseline"))
    gone = F.when(below, F.col("baseline") - F.col("value")).otherwise(F.col("value") - F.col("baseline"))
    pct = F.when(done, 100.0).when(way > 0, F.greatest(F.least(gone / way * 100, F.lit(100.0)), F.lit(0.0))).otherwise(0.0)
    j = j.withColumn("pct", F.round(pct, 6)).withColumn("_done", done)
    return j.select("user_id", "metric", "baseline", "value", "pct", F.when(F.col("_done"), "achieved").when(F.col("pct") >= 25, "on_track").otherwise("off_track").alias("status"))


def variants_at_risk(genotypes: DataFrame, rules: DataFrame) -> DataFrame:
    """Variants whose genotype, in any case, is one that a rule names; other genotypes are normal."""
    g = genotypes.select("user_id", F.lower(F.trim("rsid")).alias("rsid"), F.upper(F.trim("genotype")).alias("genotype")).distinct()
    return g.join(rules, ["rsid", "genotype"])


def enzyme_profiles(genotypes: DataFrame, rules: DataFrame, enzymes: DataFrame, statuses: DataFrame) -> DataFrame:
    """(user_id, enzyme, status, variants) for every enzyme of which a user has a genotype: the worst status that one of
    its variants means, else normal."""
    g = genotypes.select("user_id", F.lower(F.trim("rsid")).alias("rsid"), F.upper(F.trim("genotype")).alias("genotype")).distinct()
    j = g.join(enzymes, "rsid").join(rules.select("rsid", "genotype", "risk"), ["rsid", "genotype"], "left").join(statuses, "risk", "left")
    worst = F.max(F.struct(F.coalesce("severity", F.lit(0)).alias("severity"), F.coalesce("status", F.lit("normal")).alias("status")))
    return j.groupBy("user_id", "enzyme").agg(worst.alias("w"), F.countDistinct("rsid").alias("variants")).select("user_id", "enzyme", "w.status", "variants")


def pathway_impact(found: DataFrame) -> DataFrame:
    """(user_id, pathway, variants, score): 3, 5, 7 or 10 by the number of variants at risk, half a point more for each
    elevated one, 10 at most."""
    n = F.col("variants")
    base = F.when(n == 1, 3.0).when(n == 2, 5.0).when(n == 3, 7.0).otherwise(10.0)
    g = found.groupBy("user_id", "pathway").agg(F.count("*").alias("variants"), F.count_if(F.col("risk") == "elevated").alias("_e"))
    return g.select("user_id", "pathway", "variants", F.least(base + F.col("_e") * 0.5, F.lit(10.0)).alias("score"))


def role_conflicts(active: DataFrame, enzymes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Pairs of a user's drugs (the lesser name first) with different roles at one enzyme, and how severe that is."""
    rows = active.join(enzymes, "drug").select("user_id", "enzyme", "drug", "role").distinct()
    b = rows.select("user_id", "enzyme", F.col("drug").alias("drug_b"), F.col("role").alias("role_b"))
    j = rows.withColumnRenamed("drug", "drug_a").withColumnRenamed("role", "role_a").join(b, ["user_id", "enzyme"]).where("drug_a < drug_b AND role_a != role_b")
    return j.join(conflicts, ["role_a", "role_b"], "left").select("user_id", "enzyme", "drug_a", "role_a", "drug_b", "role_b", F.coalesce("severity", F.lit("minor")).alias("severity"))


def stacked_pathways(active: DataFrame, pathways: DataFrame, risky: tuple[str, ...]) -> DataFrame:
    """(user_id, pathway, effect, drugs, severity): two or more of a user's drugs that push a pathway the same way."""
    g = active.join(pathways, "drug").groupBy("user_id", "pathway", "effect").agg(F.countDistinct("drug").alias("drugs")).where("drugs >= 2")
    return g.withColumn("severity", F.when(F.col("pathway").isin(*risky), "major").otherwise("moderate"))


def confidence(value: Column, age_days: Column, inferred: Column) -> Column:
    """What an inferred row is still worth: 0.8 of it behind 90 days, 0.6 behind 180."""
    return F.when(~inferred, value).when(age_days > 180, value * 0.6).when(age_days > 90, value * 0.8).otherwise(value)


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def alert_key(kind: Column, key: Column, as_of: Column) -> Column:
    """The same alert has the same key all week."""
    return F.substring(F.sha2(F.concat_ws(":", kind, key, iso_week(as_of)), 256), 1, 16)


def retained(files: DataFrame, newest: int, weeks: int) -> DataFrame:
    """Rows (name, day) that a retention keeps: the newest, and of the others the oldest of each of the newest weeks."""
    r = files.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("day"), F.desc("name")))).withColumn("_w", iso_week(F.col("day")))
    rest = r.where(F.col("_r") > newest)
    first = rest.withColumn("_o", F.row_number().over(Window.partitionBy("_w").orderBy("day", "name"))).where("_o = 1").withColumn("_k", F.row_number().over(Window.orderBy(F.desc("_w")))).where(F.col("_k") <= weeks)
    return r.where(F.col("_r") <= newest).select("name", "day").unionByName(first.select("name", "day"))


def reminder_states(active: DataFrame, acts: DataFrame, last: DataFrame, weeks: DataFrame, otherwise: int, as_of: Column) -> DataFrame:
    """(user_id, drug, state, resume_after) of the reminders of active drugs: paused while the newest result of a test that
    the drug acts on is normal, until that test is due again (the last of them); else active."""
    j = active.join(acts.select("drug", "canonical_name").distinct(), "drug").join(stated(last).select("user_id", "canonical_name", "day", "state"), ["user_id", "canonical_name"])
    newest = j.groupBy("user_id", "drug").agg(F.max(F.struct("day", "canonical_name", "state")).alias("n"))
    j = newest.select("user_id", "drug", "n.canonical_name", F.col("n.state").alias("_s")).join(weeks, "canonical_name", "left")
    paused = F.col("_s") == "normal"
    return j.select("user_id", "drug", F.when(paused, "paused").otherwise("active").alias("state"), F.when(paused, F.date_add(as_of, F.coalesce("weeks", F.lit(otherwise)) * 7)).alias("resume_after"))
