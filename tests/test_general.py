"""Rolling totals, timestamps, units and spikes against brute force, with nulls, ties, repeats and empty tables."""

import datetime as dt
import random
import re
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.operators.rolling import MONOIDS, rolling_totals, trailing
from vitalframe.operators.spikes import VITALS, flag_readings, limits, noise, stuck_readings
from vitalframe.operators.timestamps import normalise_timestamps, parse_timestamps, zone_evidence
from vitalframe.operators.units import convert_units, fold_text, fold_unit, read_number

WEAR = "user_id long, provider string, date date, a double, synced_at timestamp, `_day` int"
SITES = "site_id int, tz string, date_order string"


@pytest.mark.parametrize("monoid", sorted(MONOIDS))
def test_two_stack_queue_equals_brute_force(monoid):
    rng = random.Random(3)
    fold = {"sum": sum, "max": max, "min": min}[monoid]
    for window in (1, 2, 7, 30):
        x = [rng.randint(-50, 50) * 1.0 for _ in range(200)]
        assert trailing(x, window, monoid) == [fold(x[max(0, i - window + 1) : i + 1]) for i in range(len(x))]


@pytest.mark.parametrize("block", [31, 40, 512])
def test_rolling_totals_blocks_gaps_and_redeliveries(spark, block):
    rng, day0 = random.Random(1), dt.date(2023, 1, 1)
    truth, rows = {}, []
    for p in ("x", None):
        for i in sorted(rng.sample(range(300), 60)):
            v = rng.choice([None, float(rng.randint(0, 99))])
            rows.append((1, p, day0 + dt.timedelta(i), v, dt.datetime(2024, 1, 1), 0))
            truth[p, i] = v
            if rng.random() < 0.2:  # a later delivery, perhaps of a null
                w = rng.choice([None, 7.0])
                rows.append((1, p, day0 + dt.timedelta(i), w, dt.datetime(2024, 2, 1), 0))
                truth[p, i] = w
    rows.append((1, "x", None, 5.0, None, 0))
    got = rolling_totals(spark.createDataFrame(rows, WEAR), ["user_id", "provider"], "date", ["a"], (7, 30), ("sum", "max"), "synced_at", block).collect()
    for p in ("x", None):
        days = [i for q, i in truth if q == p]
        mine = {r.day: r for r in got if r.provider == p}
        assert len(mine) == max(days) - min(days) + 1
        for i in range(min(days), max(days) + 1):
            r = mine[day0 + dt.timedelta(i)]
            for w in (7, 30):
                x = [v for j in range(i - w + 1, i + 1) if (v := truth.get((p, j))) is not None]
                assert r[f"total_{w}"] == sum(x) and r[f"max_{w}"] == (max(x) if x else None) and abs(r[f"avg_{w}"] - sum(x) / w) < 1e-9


def test_rolling_totals_of_nothing(spark):
    assert rolling_totals(spark.createDataFrame([], WEAR), ["user_id"], "date", ["a"]).count() == 0


CASES = [
    # text, site, instant in UTC or None, date
    ("2021-06-20T05:30:00Z", 1, "2021-06-20 05:30:00", "2021-06-20"), ("2024-11-23T20:10:00.399975-08:00", 1, "2024-11-24 04:10:00.399975", "2024-11-24"), ("2020-01-05", 1, None, "2020-01-05"),
    ("05/06/2021 09:46", 1, "2021-05-06 13:46:00", "2021-05-06"), ("05/06/2021 09:46", 2, "2021-06-05 07:46:00", "2021-06-05"), ("13/05/2021", 1, None, "2021-05-13"), ("5/6/21", 2, None, "2021-06-05"),
    ("20191117234955", 1, "2019-11-18 04:49:55", "2019-11-18"), ("20230321164200-0500", 2, "2023-03-21 21:42:00", "2023-03-21"), ("1645797929862", 1, "2022-02-25 14:05:29.862000", "2022-02-25"), ("1733965500", 2, "2024-12-12 01:05:00", "2024-12-12"),
    ("Fri, 06 Jun 2025 22:11:00 -0400", 1, "2025-06-07 02:11:00", "2025-06-07"), ("2025-03-22 23:35:00 CDT", 1, "2025-03-23 04:35:00", "2025-03-23"), ("April 25, 2025", 1, None, "2025-04-25"), ("Apr 11, 2020 12:17 AM", 1, "2020-04-11 04:17:00", "2020-04-11"),
    ("3/28/2022 12:29pm", 1, "2022-03-28 16:29:00", "2022-03-28"), ("20 November 2024 21:11", 2, "2024-11-20 20:11:00", "2024-11-20"), ("December 2023", 1, None, "2023-12-01"), ("2021-04", 1, None, "2021-04-01"), ("2025", 1, None, "2025-01-01"), ("24.03.2021 21:07", 2, "2021-03-24 20:07:00", "2021-03-24"),
    ("2024-11-03 01:30:00", 1, "2024-11-03 05:30:00", "2024-11-03"), ("2024-03-10 02:30:00", 1, "2024-03-10 07:30:00", "2024-03-10"), ("  7  March 2019   10:43 ", 2, "2019-03-07 09:43:00", "2019-03-07"),
    *[(t, 1, None, None) for t in (None, "", "  ", "--", "unknown", "see report", "2023-13-45", "0000-00-00", "31/02/2022 10:00", "n/a", "2021-06-20 25:00:00", "x" * 100_000, "13:00 PM", "99999999999")],
]


def test_timestamps_of_every_form(spark):
    sites = spark.createDataFrame([(1, "America/New_York", "mdy"), (2, "Europe/Berlin", "dmy")], SITES)
    rows = spark.createDataFrame([(i, t, s, "clash") for i, (t, s, _, _) in enumerate(CASES)], "id int, text string, site_id int, tz string")
    got = {r.id: r for r in normalise_timestamps(rows, "text", "site_id", sites).collect()}
    for i, (text, _, instant, date) in enumerate(CASES):
        r = got[i]
        assert (None if r.utc_time is None else str(r.utc_time), None if r.utc_date is None else str(r.utc_date)) == (instant, date), text
        assert r.tz == "clash"
    assert normalise_timestamps(rows.limit(0), "text", "site_id", sites).count() == 0


def test_wall_times_follow_the_zone_rules(spark):
    zone, rng = ZoneInfo("Australia/Sydney"), random.Random(5)
    sites = spark.createDataFrame([(8, "Australia/Sydney", "dmy")], SITES)
    at = [dt.datetime(2019, 1, 1) + dt.timedelta(minutes=rng.randrange(3_000_000)) for _ in range(500)]
    rows = spark.createDataFrame([(i, f"{a:%Y-%m-%d %H:%M}", 8) for i, a in enumerate(at)], "id int, text string, site_id int")
    for r in normalise_timestamps(rows, "text", "site_id", sites).collect():
        assert r.utc_time == at[r.id].replace(tzinfo=zone, fold=0).astimezone(dt.timezone.utc).replace(tzinfo=None)


def test_missing_zone_is_estimated_from_ingestion(spark):
    sites = spark.createDataFrame([(1, "America/New_York", "mdy"), (2, "Europe/Berlin", "dmy"), (3, "Australia/Sydney", "dmy")], SITES)
    zone, rng, rows = ZoneInfo("Europe/Berlin"), random.Random(2), []
    for i in range(60):
        local = dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randrange(8000))
        seen = local.replace(tzinfo=zone).astimezone(dt.timezone.utc) + dt.timedelta(minutes=rng.randrange(5, 120))
        rows.append((i, f"{local:%Y-%m-%d %H:%M}", None, "feed", seen))
    df = spark.createDataFrame(rows, "id int, text string, site_id int, feed string, seen timestamp")
    out = normalise_timestamps(df, "text", "site_id", sites, "seen", ["feed"]).collect()
    assert {r.zone_from for r in out} == {"estimate"}
    assert all(r.utc_time == dt.datetime.fromisoformat(rows[r.id][1]).replace(tzinfo=zone).astimezone(dt.timezone.utc).replace(tzinfo=None) for r in out)
    assert zone_evidence(parse_timestamps(df.limit(0), "text", F.lit("dmy")), ["feed"], "seen", ["Europe/Berlin"]).count() == 0


def test_missing_zone_is_estimated_from_the_order_of_records(spark):
    """No ingestion times: records of known instants before and behind bound those without zone. Ties and nulls in the
    sequence, and a group of nothing but unknown zones, say nothing."""
    zone, rows, t = ZoneInfo("America/Denver"), [], dt.datetime(2024, 2, 25, tzinfo=dt.timezone.utc)
    truth = {}
    for i in range(400):
        t += dt.timedelta(minutes=37)
        known = i % 2 == 0
        rows.append((i, t.strftime("%Y-%m-%dT%H:%M:%SZ") if known else t.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), 1, "a", i if i % 50 else None))
        truth[i] = t.replace(tzinfo=None)
    rows += [(1000, "2024-03-01 08:00", 1, "b", 3), (1001, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, site_id int, feed string, place int")
    sites = spark.createDataFrame([(1, None, "mdy"), (2, "America/Denver", "mdy"), (3, "America/New_York", "mdy"), (4, "Europe/Berlin", "dmy")], "site_id int, tz string, date_order string")
    out = {r.id: r for r in normalise_timestamps(df, "text", "site_id", sites, None, ["feed"], "place").collect()}
    assert all(out[i].utc_time.replace(microsecond=0) == x.replace(microsecond=0) for i, x in truth.items())
    assert {out[i].zone_from for i in range(1, 400, 2)} == {"estimate"} and out[1000].zone_from == "none" and out[1001].utc_date is None
    parsed = parse_timestamps(df, "text", F.lit("mdy"))
    cut_up = zone_evidence(parsed, ["feed"], None, ["America/Denver", "America/New_York", "Europe/Berlin"], "place", run=16).collect()
    assert [(r.feed, r["_zone"], r["_violations"]) for r in cut_up] == [("a", "America/Denver", 0)]


def test_numbers_and_units_as_written(spark):
    rows = [("1,020", 800.0, 1020.0, None), ("0,902", None, 0.902, None), ("6,574", 6.5, 6.574, None), ("1,234,567", None, 1234567.0, None), ("<0.5", None, 0.5, None), ("37,1 deg C", None, 37.1, "deg C"), ("7.9 10*3/uL", None, 7.9, "10*3/uL"), ("10 412", None, 10412.0, None), ("TNP", None, None, None), ("", None, None, None), (None, None, None, None), ("1.234,5", None, 1234.5, None), ("1.4e2", None, 140.0, None), ("< .5", None, 0.5, None), ("7.", None, 7.0, None)]
    number, behind = read_number(F.col("t"), F.col("near"))
    for r in spark.createDataFrame(rows, "t string, near double, n double, b string").select("*", number.alias("got"), behind.alias("unit")).collect():
        assert (r.got, r.unit) == (r.n, r.b), r.t
    spelled = {"mgs/dl": "mg/dl", "MG/DL": "mg/dl", "mg per dL": "mg/dl", "µkat/L": "ukat/l", "μmol/l": "umol/l", "x10E3/uL": "10*3/ul", "10^9/l": "10*9/l", "mmol per litre": "mmol/l", "percent": "percent", "°C": "degc", "mL/min/1.73 m²": "ml/min/1.73m2", "": None, None: None, "nanog/mL": "ng/ml"}
    for r in spark.createDataFrame(list(spelled.items()), "u string, want string").select("*", fold_unit(F.col("u")).alias("got")).collect():
        assert r.got == r.want, r.u


OBS = "obs_id string, canonical_name string, value double, value_text string, unit string, reference_low double, reference_high double, reference_text string, factor int"


def test_missing_units_take_the_posterior(spark):
    kinds = spark.createDataFrame([("glucose", "mg/dL", 70.0, 99.0), ("temp", "Cel", 36.1, 37.6)], "canonical_name string, unit string, typical_low double, typical_high double")
    factors = spark.createDataFrame([("glucose", "mmol/L", "mg/dL", 18.016, 0.0), ("glucose", "mEq/L", "mg/dL", 1.0, None), ("temp", "degF", "Cel", 0.55556, -17.7778)], "canonical_name string, from_unit string, to_unit string, factor double, shift double")
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for i in range(400):
        mg = float(rng.lognormal(4.5, 0.2))
        molar, hidden = i % 2 == 0, i % 5 == 0
        rows.append((f"g{i}", "glucose", mg / 18.016 if molar else mg, None, None if hidden else ("MMOL/l" if molar else "mg per dL"), None, None, None, 1))
        truth[f"g{i}"] = (mg, "mmol/L" if molar else "mg/dL")
    rows += [("t1", "temp", None, "98,6", "°F", None, None, None, 1), ("t2", "temp", 36.9, None, " ", None, None, None, 1), ("r", "glucose", None, "5.5", None, None, None, "(3.9-5.5) mmol/L", 1), ("x", "unlisted", 1.0, None, "mg/dL", None, None, None, 1), ("n", None, 1.0, None, None, None, None, None, 1), ("q", "glucose", None, "pending", None, None, None, None, 1)]
    df = spark.createDataFrame(rows, OBS)
    got = {r.obs_id: r for r in convert_units(df, kinds, factors).collect()}
    assert set(got) == set(truth) | {"t1", "t2", "r"}
    for k, (mg, unit) in truth.items():
        assert got[k].from_unit == unit and abs(got[k].converted - mg) < 1e-6 * mg
    assert abs(got["t1"].converted - 37.0) < 0.01 and got["t2"].converted == 36.9 and got["r"].from_unit == "mmol/L" and got["r"].unit_known
    assert got["g0"].factor == 1
    told = {r.obs_id: (r.from_unit, r.converted) for r in convert_units(df, kinds, factors, written=True).collect()}
    assert told == {k: (r.from_unit, r.converted) for k, r in got.items() if r.unit_known}
    assert convert_units(df.limit(0), kinds, factors).count() == 0


def test_units_of_tiny_and_huge_numbers_are_fitted(spark):
    """No number is too small or too large for the fit; folded texts are those of the expression."""
    kinds = spark.createDataFrame([("trace", "pmol/L", 1e-9, 4e-9), ("cells", "/uL", 1e11, 4e11)], "canonical_name string, unit string, typical_low double, typical_high double")
    factors = spark.createDataFrame([("trace", "nmol/L", "pmol/L", 1000.0, 0.0), ("cells", "10*3/uL", "/uL", 1000.0, 0.0)], "canonical_name string, from_unit string, to_unit string, factor double, shift double")
    rng = np.random.default_rng(1)
    rows = [(f"{k}{i}{u}", k, float(rng.lognormal(np.log(m), 0.2)) / f, None, None if i % 3 == 0 else u, None, None, None, 1) for k, m, units in (("trace", 2e-9, (("pmol/L", 1), ("nmol/L", 1000))), ("cells", 2e11, (("/uL", 1), ("10*3/uL", 1000)))) for u, f in units for i in range(90)]
    got = convert_units(spark.createDataFrame(rows, OBS), kinds, factors).collect()
    assert len(got) == len(rows) and all(r.obs_id.endswith(r.from_unit) for r in got)
    texts = ["mg per dL", " X10E3/uL", "µkat/L", "°C", "MM/1h", "Gms/dl"]
    folded = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_unit(F.col("t")).alias("f")).collect()
    assert all(fold_text(r.t) == r.f for r in folded)


def test_spikes_stuck_values_and_redeliveries(spark):
    rng, day0, at = np.random.default_rng(4), dt.date(2024, 1, 1), dt.datetime(2024, 6, 1)
    rows = []
    for i in range(80):
        spo2 = float(np.round(97 + rng.normal(0, 0.4), 1))
        hrv = float(np.round(60 + rng.normal(0, 3) + (9 if 30 <= i < 36 else 0), 1))  # a change of state over six days stays
        if i == 20:
            spo2 = 127.0
        if i == 50:
            hrv = 140.0
        rows.append((f"d{i}", 1, "p", day0 + dt.timedelta(i), None if i == 5 else hrv, float("nan") if i == 6 else 55.0 + float(np.round(rng.normal(0, 2), 2)), spo2, 52.0 if 60 <= i < 66 else float(np.round(92 + rng.normal(0, 0.5), 2)), at))
    rows[60:66] = [(*r[:7], 92.3, r[8]) for r in rows[60:66]]
    rows.append(("again", 1, "p", day0 + dt.timedelta(50), None, 55.0, 97.0, 92.0, at + dt.timedelta(1)))
    df = spark.createDataFrame(rows, "id string, user_id long, provider string, date date, hrv double, rhr double, spo2 double, skin_temp double, synced_at timestamp")
    got = {(r.id, r.metric, r.reason) for r in flag_readings(df, ["user_id", "provider"], "id", "date", "synced_at").collect()}
    assert got == {("d20", "spo2", "impossible"), ("d50", "hrv", "spike"), *[(f"d{i}", "skin_temp", "stuck") for i in range(60, 66)]}
    assert flag_readings(df.limit(0), ["user_id", "provider"], "id", "date", "synced_at").count() == 0
    assert limits(np.arange(3), np.full(3, np.nan), VITALS[0], 5, 6.5, 6) is None
    # A source of nulls with many deliveries of the same days: its days are held once, its rows are all judged.
    hot = [(f"h{i}", None, None, None if i % 7 == 0 else day0 + dt.timedelta(i % 60), 40.0 + i % 5 if i != 1205 else 900.0, None, None, None, at + dt.timedelta(seconds=i)) for i in range(3000)]
    got = flag_readings(spark.createDataFrame(hot, df.schema), ["user_id", "provider"], "id", "date", "synced_at").collect()
    assert [(r.id, r.metric, r.reason) for r in got] == [("h1205", "hrv", "impossible")]


def test_noise_and_stuck_values_equal_brute_force():
    rng = np.random.default_rng(2)
    state = np.cumsum(rng.normal(0, 0.5, 20_000))
    r, q = noise(state + rng.normal(0, 2.0, 20_000), 0.01)
    assert abs(r - 4.0) < 0.4 and abs(q - 0.25) < 0.25
    for _ in range(200):
        y = rng.integers(0, 2, rng.integers(0, 30)).astype(float)
        want = np.zeros(len(y), bool)
        for a in range(len(y) - 3):
            if len(set(y[a : a + 4])) == 1:
                want[a : a + 4] = True
        assert (stuck_readings(y, 4) == want).all()


def test_p7_equals_robust_distances(spark, sf):
    """The filter's candidates, checked, are the readings that lie seven robust spreads away: none is lost."""
    from vitalframe.plans.general import p7_flagged

    got = {(r.id, r.metric) for r in p7_flagged(spark, sf).where("reason != 'stuck'").collect()}
    pdf = spark.read.parquet(f"{sf}/clean_wearable_daily.parquet").toPandas()
    want = set()
    for m in VITALS:
        for _, g in pdf.groupby(["user_id", "provider"], dropna=False):
            g = g.dropna(subset=[m.name]).sort_values(["date", "synced_at"])
            base = g.drop_duplicates("date", keep="last")[m.name]
            middle = base.median()
            low, high = next((a, b) for x, a, b in reversed(m.scales) if middle >= x)
            good = base[(base >= low) & (base <= high)]
            spread = max(1.4826 * (good - good.median()).abs().median(), m.floor)
            bad = (g[m.name] < low) | (g[m.name] > high) | ((g[m.name] - good.median()).abs() > 6.5 * spread)
            want |= {(i, m.name) for i in g["id"][bad]}
    assert got == want and re
