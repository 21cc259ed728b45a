"""Rule joins, texts, changes of tables, search fusion and readers on small fixtures with planted rows, nulls, ties and
empty tables."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vitalframe import knowledge
from vitalframe.operators import maintenance, rules, search, text
from vitalframe.sources import readers

RES = "user_id long, obs_id string, canonical_name string, value double, low double, high double, day date"
D = dt.date


def test_ranges_of_age_sex_and_ethnicity(spark):
    res = spark.createDataFrame([(i, f"o{i}", "hemoglobin", 12.5, None, None, D(2024, 1, 1)) for i in range(1, 7)] + [(1, "x", "unknown", 1.0, None, None, D(2024, 1, 1))], RES)
    people = spark.createDataFrame([(1, 40, False, None), (2, 40, True, None), (3, None, True, None), (4, 12, False, None), (5, 40, False, "black"), (6, None, False, None)], "user_id long, age int, female boolean, ethnicity string")
    ages = "canonical_name string, age_from int, age_to int, low double, high double"
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.user_id: (r.layer, r.range_low, r.range_high) for r in rules.layered_ranges(res, people, make([("hemoglobin", 13.0, 17.0)], "canonical_name string, low double, high double"), make(knowledge.AGE_RANGES, ages), make(knowledge.FEMALE_AGE_RANGES, ages), make(knowledge.FEMALE_RANGES, "canonical_name string, low double, high double"), make(knowledge.ETHNIC_RANGES, "ethnicity string, canonical_name string, low double, high double")).collect()}
    assert got == {1: ("age", 13.5, 17.5), 2: ("female age", 12.0, 16.0), 3: ("female", 12.0, 16.0), 4: ("age", 11.5, 15.5), 5: ("ethnicity", 12.0, 17.0), 6: ("default", 13.0, 17.0)}


def test_retests_follow_ups_and_pairs(spark):
    as_of = F.lit("2024-06-01").cast("date")
    rows = [(1, "a", "potassium", 6.0, 3.5, 5.1, D(2024, 5, 1)), (2, "b", "potassium", 6.0, 3.5, 5.1, D(2024, 4, 1)), (2, "c", "potassium", 4.0, 3.5, 5.1, D(2024, 5, 1)), (3, "d", "tsh", 9.0, 0.4, 4.0, D(2024, 5, 25)), (4, "e", "alt", 90.0, 7.0, 45.0, D(2022, 1, 1)), (5, "f", "alt", 90.0, 7.0, 45.0, D(2024, 4, 25))]
    frame = spark.createDataFrame(knowledge.RETESTS, "canonical_name string, state string, weeks_from int, weeks_to int, urgent boolean")
    got = {r.user_id: r.status for r in rules.retests(spark.createDataFrame(rows, RES), frame, as_of).collect()}
    assert got == {1: "urgent_overdue", 5: "due_soon"}
    have = spark.createDataFrame([(1, "diabetes"), (1, "liver disease"), (1, "diabetes"), (2, "anemia"), (None, "diabetes")], "user_id long, condition string")
    pairs = spark.createDataFrame(knowledge.COMORBIDITIES, "a string, b string, priority string")
    assert [(r.user_id, r.a, r.b) for r in rules.present_pairs(have, "condition", pairs).collect()] == [(1, "diabetes", "liver disease")]
    reasons = spark.createDataFrame([(1, "alt", 6, "statin"), (1, "alt", 3, "liver disease"), (1, "tsh", 6, "x"), (2, "alt", 6, "statin")], "user_id long, canonical_name string, months int, reason string")
    last = spark.createDataFrame([(1, "alt", D(2024, 1, 1)), (2, "alt", D(2024, 5, 1))], "user_id long, canonical_name string, day date")
    assert {(r.user_id, r.canonical_name, r.reason, r.status) for r in rules.due_labs(reasons, last, as_of).collect()} == {(1, "alt", "liver disease", "overdue"), (1, "tsh", "x", "never")}
    people = spark.createDataFrame([(1, 50, "female"), (2, 50, None), (3, None, "male")], "user_id long, age int, sex string")
    guide = spark.createDataFrame(knowledge.SCREENINGS, "screening string, age_from int, age_to int, for_sex string, months int, test string")
    due = {(r.user_id, r.screening) for r in rules.screenings(people, last, guide, as_of).collect()}
    assert (1, "mammogram") in due and (2, "mammogram") not in due and (2, "colonoscopy") in due and not any(u == 3 for u, _ in due)


def test_variants_enzymes_and_pathways(spark):
    genes = spark.createDataFrame([(1, "RS3892097", "aa"), (1, "rs1801133", "TT"), (1, "rs4680", "AA"), (1, "rs1", "CC"), (2, "rs3892097", "GG"), (2, "rs4244285", None)], "user_id long, rsid string, genotype string")
    snps = spark.createDataFrame(knowledge.SNP_RULES, "rsid string, gene string, genotype string, risk string, condition string, test string, pathway string")
    found = rules.variants_at_risk(genes, snps)
    assert {(r.user_id, r.rsid, r.risk) for r in found.collect()} == {(1, "rs3892097", "elevated"), (1, "rs1801133", "elevated"), (1, "rs4680", "moderate")}
    assert {(r.pathway, r.variants, r.score) for r in rules.pathway_impact(found).collect()} == {("pharmacogenomics", 1, 3.5), ("methylation", 2, 5.5)}
    profiles = rules.enzyme_profiles(genes, snps, spark.createDataFrame(knowledge.ENZYME_SNPS, "enzyme string, rsid string"), spark.createDataFrame(knowledge.RISK_STATUS, "risk string, status string, severity int"))
    assert {(r.user_id, r.enzyme, r.status) for r in profiles.collect()} == {(1, "CYP2D6", "poor"), (2, "CYP2D6", "normal"), (2, "CYP2C19", "normal")}
    active = spark.createDataFrame([(1, "omevastat"), (1, "cardexine"), (1, "pressolol"), (2, "omevastat")], "user_id long, drug string")
    got = rules.role_conflicts(active, spark.createDataFrame(knowledge.DRUG_ENZYMES, "drug string, enzyme string, role string"), spark.createDataFrame(knowledge.ROLE_CONFLICTS, "role_a string, role_b string, severity string")).collect()
    assert [(r.user_id, r.drug_a, r.drug_b, r.severity) for r in got] == [(1, "cardexine", "omevastat", "major")]
    stacked = rules.stacked_pathways(active, spark.createDataFrame(knowledge.DRUG_PATHWAYS, "drug string, pathway string, effect int"), knowledge.HIGH_RISK_PATHWAYS).collect()
    assert [(r.user_id, r.pathway, r.drugs, r.severity) for r in stacked] == [(1, "heart_rate", 2, "major")]


def test_stress_goals_confidence_and_keys(spark):
    days = [(1, "p", D(2024, 1, 1) + dt.timedelta(i), "hrv", 60.0 if i < 4 else 40.0) for i in range(8)] + [(1, "p", D(2024, 1, 8), "rhr", 50.0), (2, "p", D(2024, 1, 1), "hrv", 50.0)]
    frame = spark.createDataFrame(knowledge.STRESS, "metric string, bad int, weight double, least double")
    got = rules.stress(spark.createDataFrame(days, "user_id long, provider string, date date, metric string, value double"), frame, knowledge.STRESS_LEVELS).collect()
    assert [(r.user_id, r.score, r.level, r.signals) for r in got] == [(1, 0.3, "moderate", 1)]
    dated = spark.createDataFrame([(1, "a", "ldl", 160.0, None, None, D(2024, 1, 1)), (1, "b", "ldl", 130.0, None, None, D(2024, 2, 1)), (2, "c", "ldl", 90.0, None, None, D(2024, 1, 1))], RES)
    goals = spark.createDataFrame(knowledge.GOALS, "metric string, target double, direction string")
    last = dated.where("obs_id IN ('b', 'c')")
    assert {(r.user_id, r.pct, r.status) for r in rules.goal_progress(dated, last, goals).collect()} == {(1, 50.0, "on_track"), (2, 100.0, "achieved")}
    c = spark.createDataFrame([(1.0, 10, True), (1.0, 100, True), (1.0, 200, True), (1.0, 200, False)], "c double, d int, i boolean").select(rules.confidence(F.col("c"), F.col("d"), F.col("i")).alias("x")).collect()
    assert [r.x for r in c] == [1.0, 0.8, 0.6, 1.0]
    files = spark.createDataFrame([(f"f{i}", D(2024, 1, 1) + dt.timedelta(i)) for i in range(30)], "name string, day date")
    assert sorted(r.name for r in rules.retained(files, 3, 2).collect()) == ["f14", "f21", "f27", "f28", "f29"]


def test_words_for_days_periods_doses_and_sizes(spark):
    today = F.lit("2024-03-13").cast("date")  # a Wednesday
    days = {"felt dizzy yesterday": D(2024, 3, 12), "3 weeks ago": D(2024, 2, 21), "since last Tuesday": D(2024, 3, 12), "last wednesday": D(2024, 3, 6), "2 months ago": D(2024, 1, 13), "day before yesterday": D(2024, 3, 11), "today": D(2024, 3, 13), "nothing": None, "": None, None: None}
    for r in spark.createDataFrame(list(days.items()), "t string, want date").select("*", text.said_day(F.col("t"), today).alias("got")).collect():
        assert r.got == r.want, r.t
    spans = {"labs of the last 3 months": (D(2023, 12, 13), D(2024, 3, 13)), "past week": (D(2024, 3, 6), D(2024, 3, 13)), "2 weeks ago": (D(2024, 2, 25), D(2024, 3, 2)), "since November": (D(2023, 11, 1), D(2024, 3, 13)), "since May 2022": (D(2022, 5, 1), D(2024, 3, 13)), "recently": (D(2024, 2, 28), D(2024, 3, 13)), "ever": None, None: None}
    for r in spark.createDataFrame([(k,) for k in spans], "t string").select("*", text.said_range(F.col("t"), today).alias("got")).collect():
        assert (tuple(r.got) if r.got else None) == spans[r.t], r.t
    doses = {"took half of the 50 mg tablet": (50.0, "mg", "half", 25.0, 25.0), "500 mcg daily": (500.0, "mcg", "", 500.0, 0.5), "ate half a cake": None, "2 g doubled": (2.0, "g", "double", 4.0, 4000.0), None: None}
    for r in spark.createDataFrame([(k,) for k in doses], "t string").select("*", text.dose_of(F.col("t")).alias("got")).collect():
        assert (tuple(r.got) if r.got else None) == doses[r.t], r.t
    sizes = {"5'10\"": 1.778, "6ft": 1.8288, "183cm": 1.83, "72in": 1.8288, "1.78 m": 1.78, "9'0": None, "tall": None, None: None}
    for r in spark.createDataFrame(list(sizes.items()), "t string, want double").select("*", F.round(text.metres(F.col("t")), 4).alias("got")).collect():
        assert r.got == r.want, r.t
    weights = {"170 lbs": 77.11064, "77 kg": 77.0, "180": 81.64656, "80": 80.0, "3 kg": None, None: None}
    for r in spark.createDataFrame(list(weights.items()), "t string, want double").select("*", F.round(text.kilograms(F.col("t")), 5).alias("got")).collect():
        assert r.got == r.want, r.t
    r = spark.range(1).select(text.days_of(F.lit("2 weeks")).alias("a"), text.days_of(F.lit("soon")).alias("b"), text.age_at(F.lit("2000-03-14").cast("date"), today).alias("c"), text.age_at(F.lit("2000-03-13").cast("date"), today).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (14, None, 23, 24)


def test_conditions_in_texts_and_reminders(spark):
    docs = spark.createDataFrame([(1, "My mother has hypertension. I have high blood pressure and anemia!\nAnemia again."), (2, None), (3, ""), (4, "no condition"), (5, "x " * 50_000 + "gout and diabetes")], "doc_id long, t string")
    got = {(r.doc_id, r.condition, r.sentences, r.of_family) for r in text.condition_mentions(docs, "doc_id", "t", knowledge.CONDITION_WORDS, knowledge.RELATIVES).collect()}
    assert got == {(1, "hypertension", 2, 1), (1, "anemia", 2, 0), (5, "diabetes", 1, 0)}
    active = spark.createDataFrame([(1, "d"), (2, "d"), (3, "e")], "user_id long, drug string")
    acts = spark.createDataFrame([("d", "tsh"), ("d", "alt"), ("e", "zzz")], "drug string, canonical_name string")
    last = spark.createDataFrame([(1, "a", "tsh", 2.0, 0.4, 4.0, D(2024, 1, 2)), (1, "b", "alt", 90.0, 7.0, 45.0, D(2024, 1, 1)), (2, "c", "tsh", 9.0, 0.4, 4.0, D(2024, 1, 1))], RES)
    weeks = spark.createDataFrame(knowledge.PAUSE_WEEKS, "canonical_name string, weeks int")
    states = rules.reminder_states(active, acts, last, weeks, 26, F.lit("2024-02-01").cast("date")).collect()
    assert {(r.user_id, r.state, r.resume_after) for r in states} == {(1, "paused", D(2024, 8, 1)), (2, "active", None)}


def test_lab_lines_and_merged_extractions(spark):
    page = "WBC 8.2 x10E3/uL 3.4 - 10.8 01\nCreatinine 0.67 Low mg/dL 0.76 - 1.27 01\nTroponin I   <0.01 ng/mL\nNeutrophils 55 % 01\nCRP 3.1 mg/L <5\nDate 12 pages\nPatient 4 mg\nThe patient took 4 mg of it and slept\n1,200 only\nPlatelets 1,050 H k/uL (150-400)"
    got = {r.name: (r.sign, r.value, r.flag, r.unit, r.low, r.high, r.line_no) for r in text.lab_lines(spark.createDataFrame([("p", page), ("n", None), ("e", "")], "page_id string, text string"), "page_id", "text").collect()}
    assert got == {
        "WBC": ("", 8.2, None, "x10E3/uL", 3.4, 10.8, 0), "Creatinine": ("", 0.67, "L", "mg/dL", 0.76, 1.27, 1), "Troponin I": ("<", 0.01, None, "ng/mL", None, None, 2), "Neutrophils": ("", 55.0, None, "%", None, None, 3),
        "CRP": ("", 3.1, None, "mg/L", None, 5.0, 4), "Platelets": ("", 1050.0, "H", "k/uL", 150.0, 400.0, 9),
    }
    make = lambda rows: spark.createDataFrame(rows, "test string, value double")
    merged = {r.test: (r.value, r.confidence, r.conflict) for r in text.merge_extractions([(make([("a", 10.0), ("b", 5.0)]), 0.95), (make([("a", 10.2), ("b", 50.0), ("c", 1.0)]), 0.85), (make([("d", 2.0), ("c", 9.0)]), 0.60)], ["test"], "value").collect()}
    assert merged == {"a": (10.0, 0.99, False), "b": (5.0, 0.8, True), "c": (1.0, 0.7, True), "d": (2.0, 0.6, False)}


def test_changes_of_tables(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 2), (4, "z", 0), (None, "n", 1), (None, "m", 1)], "id int, v string, at int")
    rows = lambda df: sorted(((r.id, r.v) for r in df.collect()), key=str)
    assert rows(maintenance.appended(t, new, ["id"])) == sorted([(1, "a"), (2, None), (3, "c"), (4, "z"), (None, "m")], key=str)
    assert rows(maintenance.upserted(t, new, ["id"], "at")) == sorted([(1, "a"), (2, "y"), (3, "c"), (4, "z"), (None, "n")], key=str)
    assert rows(maintenance.synced(t, new.where("id IS NOT NULL"), ["id"], "at", True)) == [(2, "y"), (4, "z")]
    assert rows(maintenance.corrected(t, new.where("id = 2 AND v = 'x'"), "id", ["v"], "at")) == [(1, "a"), (2, "x"), (3, "c")]
    day = spark.createDataFrame([("d", None), ("d", D(2024, 1, 2)), ("d", D(2024, 1, 1)), (None, None), ("e", None)], "g string, day date")
    assert sorted((r.g or "", str(r.day)) for r in maintenance.stamped(day, "g", "day").collect()) == [("", "None"), ("d", "2024-01-01"), ("d", "2024-01-01"), ("d", "2024-01-02"), ("e", "None")]
    left = maintenance.without({"t": (t, "id"), "u": (new, "id")}, spark.createDataFrame([(2,), (2,)], "x int"))
    assert left["t"].count() == 2 and left["u"].count() == 3
    kept, count = maintenance.without_category(t, "v", "a")
    assert kept.count() == 2 and count.first().removed == 1
    cache = spark.createDataFrame([("q", "old", None, 1), ("q", "new", D(2024, 1, 1), 2), ("r", "gone", D(2023, 1, 1), 1)], "k string, v string, expires date, created int")
    as_of = F.lit("2023-06-01").cast("date")
    assert [(r.k, r.v) for r in maintenance.newest_valid(cache, "k", "expires", "created", as_of).collect()] == [("q", "new")]
    assert maintenance.fresh(spark.createDataFrame([(D(2023, 5, 1), None), (D(2020, 1, 1), True), (D(2020, 1, 1), False)], "made date, ok boolean"), "made", "ok", 90, as_of).count() == 2
    stamp = lambda h: dt.datetime(2024, 1, 2, h)
    alerts = spark.createDataFrame([("a", stamp(12)), ("a", stamp(11)), ("b", stamp(12)), ("c", stamp(12))], "key string, at timestamp")
    log = spark.createDataFrame([("a", stamp(1)), ("b", dt.datetime(2024, 1, 1, 1))], "key string, at timestamp")
    assert sorted(r.key for r in maintenance.unseen_alerts(alerts, log, "key", "at").collect()) == ["b", "c"]
    h = spark.createDataFrame([("h1", 1, "tsh", "high", 0.9, "active"), ("h2", 1, "alt", "high", 0.2, "active"), ("h3", 2, "tsh", "high", 0.5, "active")], "id string, user_id long, canonical_name string, direction string, confidence double, status string")
    s = spark.createDataFrame([(1, "tsh", "high"), (1, "alt", "normal")], "user_id long, canonical_name string, state string")
    assert {(r.id, r.confidence, r.status) for r in maintenance.revalued(h, s).collect()} == {("h1", 0.95, "active"), ("h2", 0.05, "ruled_out"), ("h3", 0.5, "active")}
    old = spark.createDataFrame([("x", ["a", "b"], 0.5), ("y", None, 0.4)], "id string, evidence array<string>, confidence double")
    more = spark.createDataFrame([("x", ["b", "c"], 1.0)], "id string, evidence array<string>, confidence double")
    assert {(r.id, tuple(r.evidence), r.confidence) for r in maintenance.merged_evidence(old, more, "id", ["evidence"]).collect()} == {("x", ("a", "b", "c"), 0.65), ("y", (), 0.4)}
    assert maintenance.upserted(t.limit(0), new.limit(0), ["id"], "at").count() == 0


def test_fused_scores(spark):
    s = "id long, score double"
    a, b = spark.createDataFrame([(1, 0.2), (2, 0.6)], s), spark.createDataFrame([(2, 0.0), (3, 0.8)], s)
    assert {(r.id, round(r.score, 6)) for r in search.fused(a, b, "id").collect()} == {(1, 0.0), (2, 0.6), (3, 0.4)}
    assert [(r.id, r.score) for r in search.fused(a.limit(0), b, "id").collect()] == [(3, 0.8)]
    assert [r.id for r in search.top(spark.createDataFrame([(2, 0.5), (1, 0.5), (3, 0.0)], s), "id", 5).collect()] == [1, 2]
    assert search.expanded(("sugar", "x"), {"sugar": ("glucose", "x")}) == ("sugar", "x", "glucose")


def test_clinical_documents_archives_and_exports(spark, tmp_path):
    doc = """<ClinicalDocument xmlns="urn:hl7-org:v3"><component><structuredBody><component><section><code code="30954-2"/><entry><organizer><effectiveTime value="20240105"/><component><observation><code code="2345-7" displayName="Glucose"/><effectiveTime value="202401061030"/><value value="92" unit="mg/dL"/><referenceRange><observationRange><value><low value="70"/><high value="99"/></value></observationRange></referenceRange></observation></component></organizer></entry></section></component>
    <component><section><code code="10160-0"/><entry><substanceAdministration><effectiveTime><low value="2023"/></effectiveTime><consumable><manufacturedProduct><manufacturedMaterial><code displayName="Metformin"/></manufacturedMaterial></manufacturedProduct></consumable></substanceAdministration></entry></section></component></structuredBody></component></ClinicalDocument>"""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(doc)
    (tmp_path / "in" / "b.xml").write_text("no xml")
    got = {r.kind: r for r in readers.read_clinical_documents(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"lab", "medication"} and (got["lab"].value, got["lab"].low, got["lab"].day) == (92.0, 70.0, D(2024, 1, 6)) and (got["medication"]["name"], got["medication"].day) == ("Metformin", D(2023, 1, 1))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for n, c in (("x/ccda.xml", doc), ("export.xml", "<HealthData/>"), ("r.json", '{"resourceType": "Bundle"}'), ("s.pdf", "%PDF-"), ("t.csv", "a"), ("z.bin", "0")):
            z.writestr(n, c)
    (tmp_path / "zip").mkdir()
    (tmp_path / "zip" / "a.zip").write_bytes(buffer.getvalue())
    (tmp_path / "zip" / "b.zip").write_bytes(b"broken")
    assert {r.member: r.kind for r in readers.archive_members(spark, str(tmp_path / "zip")).collect()} == {"x/ccda.xml": "clinical_xml", "export.xml": "health_xml", "r.json": "fhir", "s.pdf": "pdf", "t.csv": "table", "z.bin": "other"}
    facts = spark.createDataFrame([(1, "a", "x"), (1, None, "y"), (2, "b", "z")], "user_id long, topic string, fact string")
    lines = readers.to_knowledge({"facts": facts, "goals": facts.limit(1)})
    back = readers.from_knowledge(lines, "facts", facts.where("user_id = 2"), ["topic"])
    assert sorted(r.fact for r in back.collect()) == ["x", "y"]
    md = {r.user_id: r.markdown for r in readers.to_markdown([("Facts", facts, ["fact"]), ("Topics", facts.where("topic IS NOT NULL"), ["topic"])]).collect()}
    assert md == {1: "## Facts\n- x\n- y\n\n## Topics\n- a", 2: "## Facts\n- z\n\n## Topics\n- b"}


@pytest.mark.parametrize("name", ["comorbidities", "qualitative_changes", "suspect_results"])
def test_queries_of_rare_cases_find_planted_rows(spark, tmp_path, name):
    from test_records import _folder, _obs

    from vitalframe import plans

    obs = [_obs("a", "glucose", "150", "mg/dL", 70.0, 99.0), _obs("b", "alt", "900", "U/L", 7.0, 45.0), _obs("c", "alt", "Negative", date="2023-01-01"), _obs("d", "alt", "Detected", date="2024-02-01")]
    folder = _folder(spark, tmp_path, obs)
    want = {"comorbidities": [("diabetes", "liver disease")], "qualitative_changes": [("negative", "detected")], "suspect_results": [("alt", 900.0)]}
    got = plans.QUERIES[name](spark, folder).collect()
    columns = {"comorbidities": ("a", "b"), "qualitative_changes": ("before", "now"), "suspect_results": ("canonical_name", "value")}[name]
    assert [tuple(r[c] for c in columns) for r in got] == want[name]
