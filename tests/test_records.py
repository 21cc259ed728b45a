"""Record, search, source and stream operators on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vitalframe import plans
from vitalframe.operators import records, search, series
from vitalframe.sources import readers
from vitalframe.streaming import incremental

RES = "user_id long, obs_id string, canonical_name string, value double, low double, high double, day date"


def _series(spark, values, step=60):  # noqa: ANN001
    day0 = dt.date(2023, 1, 1)
    return spark.createDataFrame([(1, f"o{i}", "ldl", float(v), 40.0, 130.0, day0 + dt.timedelta(i * step)) for i, v in enumerate(values)], RES)


@pytest.mark.parametrize(("values", "want"), [([100, 120, 140, 160], "increasing"), ([200, 180, 160, 140], "decreasing"), ([100, 101, 99, 100], "stable"), ([5, 5, 5], "stable"), ([1, 2], None)])
def test_trend_directions(spark, values, want):
    got = series.trend(_series(spark, values), ("user_id", "canonical_name"), "day", "value", 3).collect()
    assert [r.direction for r in got] == ([want] if want else [])
    if values == [5, 5, 5]:
        assert got[0].r2 == 0.0


def test_latest_has_no_limit_before_grouping(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, f"o{i}", f"t{i % 250}", float(i), None, None, day) for i in range(1000)] + [(1, "old", "rare", 1.0, None, None, dt.date(1990, 1, 1))]
    got = {r.canonical_name: r for r in series.latest(spark.createDataFrame(rows, RES)).collect()}
    assert len(got) == 251 and got["rare"].obs_id == "old" and got["t7"].obs_id == max(f"o{i}" for i in range(7, 1000, 250))


def test_correlation_and_change(spark):
    day0 = dt.date(2024, 1, 1)
    labs = spark.createDataFrame([(1, f"o{i}", "glucose", 90.0 + 2 * i, None, None, day0 + dt.timedelta(7 * i)) for i in range(10)], RES)
    wear = spark.createDataFrame([(1, "p", day0 + dt.timedelta(7 * i), "hrv", 50 - 1.5 * i) for i in range(10)] + [(1, "p", day0 + dt.timedelta(7 * i), "rhr", 60.0) for i in range(10)], "user_id long, provider string, date date, metric string, value double")
    got = series.correlations(labs, wear).collect()
    assert [(r.metric, round(r.r, 9), r.strength) for r in got] == [("hrv", -1.0, "strong")]
    last = series.latest_and_previous(_series(spark, [0, 10])).first()
    assert last.value == 10 and last.prev_value == 0 and last.pct_change is None


def test_numbers(spark):
    want = {"<0.5": 0.5, "1,200": 1200.0, "37,1": 37.1, "nan": None, "inf": None, "1_0": None, "Detected": None, "": None, None: None, "≥ 3": 3.0, "1e3": 1000.0}
    for r in spark.createDataFrame(list(want.items()), "t string, n double").select("*", records.number(F.col("t")).alias("got")).collect():
        assert r.got == r.n, r.t


def test_chunks_together_are_the_text(spark):
    texts = ["", "short", "para one. " * 500 + "\n\n" + "x" * 5000 + " end"]
    for t in texts:
        parts = search.cut_text(t, 300)
        assert "".join(c for _, c in parts) == t and all(len(c) <= 300 and t[a : a + len(c)] == c for a, c in parts)
    got = search.chunks(spark.createDataFrame([(1, None), (2, ""), (3, texts[2])], "id long, t string"), "id", "t", 300)
    assert {r.id for r in got.collect()} == {3}


def test_nearest_equals_brute_force(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) - 5 for j in range(4)]) for i in range(60)] + [(100, None), (101, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = search.nearest(df.where("id % 20 = 0"), df, "id", "v", 3).collect()

    def cos(a, b):  # noqa: ANN001, ANN202
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / (na * nb)

    by = {i: v for i, v in rows if v and any(v)}
    for q in (0, 20, 40):
        want = sorted((-round(cos(by[q], v), 9), i) for i, v in by.items() if i != q)[:3]
        assert sorted((-round(r.cosine, 9), r.id) for r in got if r.query_id == q) == want


def test_import_keys_treat_nulls_as_equal(spark):
    new = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("c", 2)], "k string, t int")
    old = spark.createDataFrame([("b", 1), ("a", None)], "k string, t int")
    assert [r.k for r in records.anti_new(new, old, ["k", "t"]).collect()] == ["c"]
    assert records.keep_present(new, old, "k").count() == 3


def test_fhir_and_genotype_files(spark, tmp_path):
    lab = {"resourceType": "Observation", "id": "1", "subject": {"reference": "Patient/x"}, "code": {"text": "Glucose"}, "category": [{"coding": [{"code": "laboratory"}]}], "effectiveDateTime": "2024-03", "valueQuantity": {"value": 90.5, "unit": "mg/dL"}, "referenceRange": [{"low": {"value": 70}, "high": {"value": 99}}]}
    med = {"resourceType": "MedicationRequest", "id": "2", "medicationCodeableConcept": {"coding": [{"display": "Metformin"}]}, "authoredOn": "2023-05-06T10:00:00Z"}
    other = {"resourceType": "Practitioner", "id": "3", "name": [{"text": "Dr"}]}
    (tmp_path / "a.ndjson").write_text("\n".join([json.dumps(lab), json.dumps(med), json.dumps(other), "{bad"]))
    good, bad = readers.read_fhir_ndjson(spark, str(tmp_path / "a.ndjson"))
    rows = {r.resource_id: r for r in good.collect()}
    assert set(rows) == {"1", "2"} and bad.count() == 1
    assert (rows["1"].kind, rows["1"]["name"], rows["1"].value, rows["1"].low, str(rows["1"].day)) == ("lab", "Glucose", 90.5, 70.0, "2024-03-01") and rows["2"]["name"] == "Metformin"
    (tmp_path / "b.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": lab}, {"resource": med}]}, indent=1))
    assert {r.resource_id for r in readers.read_fhir_bundles(spark, str(tmp_path / "b.json")).collect()} == {"1", "2"}
    (tmp_path / "g.txt").write_text("# c\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tAG\nrs2\tX\t5\t--\nrs3\t2\tz\tAA\nrs4,MT,7,C,\n")
    variants, malformed = readers.read_genotypes(spark, str(tmp_path / "g.txt"))
    assert {(r.rsid, r.genotype) for r in variants.collect()} == {("rs1", "AG"), ("rs4", "C")} and malformed.count() == 2
    flipped = spark.createDataFrame([("rs1", "GA"), ("rs4", "T")], "rsid string, genotype string")
    assert [r.rsid for r in readers.genotype_conflicts(variants, flipped).collect()] == ["rs4"]


def test_health_exports(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<HealthData><Record type="HKQuantityTypeIdentifierHeartRate" sourceName="w" unit="count/min" startDate="2024-01-01 08:00:00 +0100" endDate="2024-01-01 08:01:00 +0100" value="61"/></HealthData>')
    r = readers.read_health_xml(spark, str(tmp_path / "e.xml")).first()
    assert (r.type, r.value) == ("HeartRate", 61.0) and r.started is not None
    (tmp_path / "m.json").write_text(json.dumps({"data": {"metrics": [{"name": "hrv", "units": "ms", "data": [{"date": "2024-01-01 08:00:00 +0000", "qty": 50}, {"date": "2024-01-02", "Avg": 51}, {"date": "x", "qty": 1}]}]}}))
    assert sorted(x.value for x in readers.read_metric_json(spark, str(tmp_path / "m.json")).collect()) == [50.0, 51.0]
    assert readers.read_metric_json(spark, str(tmp_path / "m.json"), "2024-01-01 12:00:00").count() == 1


def test_exported_resources_read_back(spark, tmp_path):
    df = _series(spark, [100, 120]).withColumn("unit", F.lit("mg/dL"))
    readers.to_fhir(df).select("resource").write.text(str(tmp_path / "out"))
    good, bad = readers.read_fhir_ndjson(spark, str(tmp_path / "out"))
    assert sorted(r.value for r in good.collect()) == [100.0, 120.0] and bad.count() == 0
    readers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string", 1)
    q = incremental.daily_totals(stream, "ts", "event_type", "value", "60 days").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.event_type, r.day, r.n) for r in spark.sql("SELECT * FROM daily").collect()}
    assert got == {(r.event_type, r.day, r.n) for r in incremental.daily_totals(events, "ts", "event_type", "value").collect()}
    once = incremental.upsert_batches(stream, str(tmp_path / "out"), ["user_id"], "event_id", str(tmp_path / "c2"))
    once.awaitTermination()
    want = {r.m for r in events.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert {r.event_id for r in incremental.read_upserted(spark, str(tmp_path / "out")).collect()} == want
    assert all(len(list(b.iterdir())) <= 3 for b in (tmp_path / "out").iterdir() if b.is_dir())
    top = events.agg(F.max("ts")).first()[0]
    late = incremental.late_rows(events, "ts", F.lit(top), "60 days").count()
    assert late == events.where(F.col("ts") < F.lit(top - dt.timedelta(60))).count()


def test_every_query_has_a_stable_schema(spark, sf):
    for name, query in plans.QUERIES.items():
        assert query(spark, sf).schema.fieldNames(), name
    assert set(plans.SQL) <= set(plans.QUERIES)


OBS = "user_id long, obs_id string, canonical_name string, test_name string, value double, value_text string, unit string, reference_low double, reference_high double, reference_text string, flag string, date_effective string, site_id int, source_doc_id string, created_at timestamp"


def _obs(obs_id, name, text, unit=None, low=None, high=None, date="2024-01-01", test=None, seen=dt.datetime(2024, 3, 1), user=1):  # noqa: ANN001, ANN202
    return (user, obs_id, name, test or name, None, text, unit, low, high, None, None, date, 1, None, seen)


def _folder(spark, path, obs, **more):  # noqa: ANN001, ANN003, ANN202
    spark.createDataFrame(obs, OBS).write.parquet(f"{path}/clean_observations.parquet")
    for name in ("dim_tests", "dim_unit_factors"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    for name, (rows, schema) in ({"dim_sites": ([(1, "UTC", "mdy")], "site_id int, tz string, date_order string")} | more).items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_critical_bounds_hold_in_the_common_unit(spark, tmp_path):
    obs = [_obs("a", "glucose", "5.0", "mmol/L", 3.9, 5.5), _obs("b", "glucose", "30", "mmol/l", 3.9, 5.5), _obs("c", "glucose", "30", "mg/dL"), _obs("d", "glucose", "0.9", "g/L"), _obs("e", "glucose", "100 mg/dL"), _obs("f", "sodium", "1.4e2", "mEq/L")]
    folder = _folder(spark, tmp_path, obs)
    assert {r.obs_id for r in plans.QUERIES["critical_alerts_whole"](spark, folder).collect()} == {"b", "c"} and {r.obs_id for r in plans.QUERIES["critical_alerts"](spark, folder).collect()} == {"b", "c"}
    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    got = {r.obs_id: r for r in records.results(table("clean_observations"), table("dim_tests"), table("dim_unit_factors"), table("dim_sites")).collect()}
    assert round(got["a"].value, 2) == 90.08 and round(got["a"].high, 2) == 99.09 and got["e"].value == 100 and got["f"].value == 140


MEDS = "user_id long, med_id string, name string, dose string, unit string, frequency string, status string, start_date string, end_date string, site_id int, created_at timestamp"


def test_days_are_those_of_the_collection_and_of_the_start(spark, tmp_path):
    day0, seen = dt.date(2024, 1, 1), dt.datetime(2024, 6, 1)
    days = [day0 + dt.timedelta(9 * i) for i in range(8)]
    obs = [_obs(f"o{i}", "glucose", str(90 + 4 * i), "mg/dL", date=d.strftime("%m/%d/%Y"), seen=seen - dt.timedelta(i)) for i, d in enumerate(days)]
    obs += [_obs("u", "glucose", "300", "mg/dL", date=None, seen=seen), _obs("v", "alt", "20", "U/L", date="", seen=seen)]
    wear = [(1, "p", d, 90.0 - i, seen, f"w{i}") for i, d in enumerate(days)]
    schema = "user_id long, provider string, date date, hrv double, synced_at timestamp, id string, " + ", ".join(f"{m} double" for m in ("rhr", "resp_rate", "sleep_score", "recovery_score", "strain", "sleep_duration_min", "spo2"))
    meds = [(1, "m", "Glucanorm XR ", "5", "mg", None, "Active", str(days[3]), None, 1, seen)]
    folder = _folder(spark, tmp_path, obs, clean_wearable_daily=([w + (None,) * 7 for w in wear], schema), clean_medications=(meds, MEDS))
    run = lambda name: plans.QUERIES[f"{name}_whole"](spark, folder).collect()
    assert [(r.metric, r.n, r.r) for r in run("lab_wearable_correlations")] == [("hrv", 8, -1.0)]
    assert [(r.before, r.after, r.pct) for r in run("treatment_response")] == [(98.0, 118.0, 20.4082)]
    assert [(r.obs_id, r.day) for r in run("treatment_baseline")] == [("o3", days[3])]
    assert [(r.drug, r.newest) for r in plans.QUERIES["active_medications"](spark, folder).collect()] == [("glucanorm", days[3])]
    assert {(r.canonical_name, r.obs_id, r.day) for r in run("latest_per_test")} == {("glucose", "o7", days[7]), ("alt", "v", None)}  # undated results come last, none is lost
    assert [(r.value, r.prev_value) for r in run("panel_delta")] == [(118.0, 114.0)]
    assert [(r.n, r.first_value, r.last_value) for r in run("lab_trends")] == [(8, 90.0, 118.0)]


def test_results_by_any_spelling_of_a_name_with_units_behind_and_delivered_once(spark, tmp_path):
    obs = [_obs("a", "Blood-sugar", "92 mg/dL"), _obs("b", None, "0,902", "g/L", 0.70, 0.99, test="BLOOD SUGAR"), _obs("c", "misc", "4.8 10*3/uL", test="Leukocytes"), _obs("d", "alt", "170 U/L", test="SGPT"), _obs("e", None, "7", test="zzz qqq"), _obs("f", "misc", "TNP", test="Sodium"), _obs("g", None, "87", "mg/dL", test="N/A")]
    rows = [(i, *r[1:]) for i, r in enumerate(obs)]
    again = [(*rows[0][:1], "a2", *rows[0][2:-1], dt.datetime(2024, 5, 1)), (*rows[0][:1], "a3", *rows[0][2:-1], dt.datetime(2024, 2, 1))]
    folder = _folder(spark, tmp_path, rows + again)
    got = {r.obs_id: (r.canonical_name, round(r.value, 6)) for r in plans.QUERIES["latest_per_test_whole"](spark, folder).collect()}
    assert got == {"a3": ("glucose", 92.0), "b": ("glucose", 90.2), "c": ("wbc", 4.8), "d": ("alt", 170.0)}
    # A mapping of free values names what folding does not.
    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    mapped = spark.createDataFrame([("zzz qqq", "alt")], "value string, entry_key string")
    assert {r.obs_id: r.canonical_name for r in records.named(table("clean_observations"), table("dim_tests"), mapped).collect()}["e"] == "alt"
    assert records.results(table("clean_observations").limit(0), table("dim_tests"), table("dim_unit_factors"), table("dim_sites")).count() == 0


def test_filtration_is_of_creatinine_in_any_unit(spark, tmp_path):
    units = [("1.0", "mg/dL"), ("1.0", "MG/DL"), ("1.0", "mgs / dl"), ("10", "mg/L"), ("88.417", "umol/L"), ("1.0 mg/dL", None)]
    folder = _folder(spark, tmp_path, [_obs(f"o{i}", "creatinine", text, unit, user=i) for i, (text, unit) in enumerate(units)], clean_demographics=([(i, 40, "F") for i in range(len(units))], "user_id long, age int, sex string"))
    got = {r.user_id: r.egfr for r in plans.QUERIES["kidney_filtration_whole"](spark, folder).collect()}
    assert set(got) == set(range(len(units))) and max(got.values()) - min(got.values()) < 0.01
