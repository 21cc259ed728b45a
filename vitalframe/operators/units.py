"""Quantities recorded in different units, converted to the common unit of their kind.

The unit is the one recorded, in its column or behind the number, under any usual spelling. Where it is missing, each
kind's values follow a mixture on the log scale whose components are one distribution moved by the known conversion
factors: its centre, spread and weights are fitted by expectation-maximisation to the histogram of all rows of the
kind, and each row takes the unit of greatest posterior, its reference bounds being further evidence. Posteriors below
a bound are flagged as uncertain.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.session import rows_of

# Spellings of unit codes, both sides written as fold_unit leaves them.
SPELLINGS = {
    "10*3/ul": ("k/ul", "thou/ul", "th/ul", "tsd/ul", "10*3/mm3"), "10*6/ul": ("m/ul", "mil/ul", "mio/ul", "mill/ul", "10*6/mm3"),
    "10*9/l": ("giga/l", "g/l", "gpt/l"), "10*12/l": ("tera/l", "t/l", "tpt/l"), "/ul": ("/mm3", "cells/ul", "cells/mm3", "cells/cumm", "/cumm", "cells/cmm"),
    "mg/dl": ("mg%",), "g/dl": ("g%",), "%": ("percent", "pct", "%oftotal", "vol%", "prozent"), "l/l": ("ratiol/l", "ratio"),
    "cel": ("c", "degc", "celsius"), "degf": ("f", "fahrenheit"), "miu/l": ("mu/l", "uiu/ml", "uu/ml"), "uiu/ml": ("uu/ml", "miu/l", "mu/l"),
    "lb": ("lbs", "pound", "pounds"), "kg": ("kgs", "kilogram", "kilograms", "kilo"), "u/l": ("iu/l", "units/l", "unit/l"), "mm/h": ("mm/hr", "mm/1h", "mm/hour"),
    "ml/min/1.73m2": ("ml/min", "ml/min/1.73", "ml/min/1.73m*2", "ml/min/1.73sqm"), "mmol/l": ("mm",), "umol/l": ("um",), "nmol/l": ("nm",), "pmol/l": ("pm",), "meq/l": ("meq",),
}
#: Folded forms that need no folding.
PLAIN = sorted({x for k, alts in SPELLINGS.items() for x in (k, *alts)} | {"ng/dl", "ng/ml", "pg/ml", "ug/dl", "ug/l", "g/l", "mg/l", "fl", "ukat/l", "ng/l", "ug/ml"})
# Ways of writing parts of units, replaced in this order after lower-casing and removing blanks.
PARTS = (
    (r"[µμ]", "u"), ("°", "deg"), ("²", "2"), ("³", "3"), ("lit(er|re)s?", "l"), (r"^x?10(e|\^|\*\*)", "10*"), (r"^x10\*", "10*"), ("^(mcg|microg(ram)?s?)/", "ug/"), ("^(mcmol|micromol)", "umol"),
    ("^mciu", "uiu"), ("^microkat", "ukat"), ("^nanog(ram)?s?/", "ng/"), ("^(gms?|grams?)/", "g/"), ("^(mgs|milligrams?)/", "mg/"), ("^millimol", "mmol"), ("^nanomol", "nmol"), ("^picomol", "pmol"), (r"[.\[\]]+$", ""),
)

_NUMBER = r"^(?:[<>≤≥=~≈]+\s*)?([+-]?\d[\d.,'’]*(?:[  ]\d{3}(?![\d*^]))*)(.*)$"
#: Numbers with an exponent, or without digits before or behind the point.
SCIENTIFIC = r"^[+-]?(\d+(\.\d*)?[eE][+-]?\d+|\.\d+([eE][+-]?\d+)?|\d+\.)$"
BIN = 0.01  # width of the log-scale histogram's bins; the fit is exact up to it
SPREAD_LIMITS = (0.03, 0.5)  # of ln(reference bound / typical bound), which is measured on rows with a unit


def fold_unit(unit: Column) -> Column:
    """One spelling for the usual ways of writing a unit; null where it is null or blank. Most units are written as
    they are folded, so the chain of patterns runs for the others only."""
    bare = F.lower(F.translate(unit, " \t\u00a0", ""))
    out = F.regexp_replace(F.regexp_replace(F.lower(unit), r"\s+per\s+", "/"), r"\s+", "")
    for pattern, by in PARTS:
        out = F.regexp_replace(out, pattern, by)
    return F.when(unit.isNull() | (bare == ""), F.lit(None)).when(bare.isin(*PLAIN), bare).otherwise(out)


def fold_text(unit: str) -> str:
    """fold_unit of a text that is not blank."""
    out = re.sub(r"\s+", "", re.sub(r"\s+per\s+", "/", unit.lower()))
    for pattern, by in PARTS:
        out = re.sub(pattern, by, out)
    return out


def read_number(text: Column, near: Column) -> tuple[Column, Column]:
    """(number, what is written behind it) of a result as text: comparison signs, thousands separators and decimal
    commas are understood; a single separator before exactly three digits is read in the way that is nearer to near
    (on the log scale; as thousands where near is null). Null where the text is no number."""
    raw = F.regexp_replace(F.trim(F.regexp_extract(text, _NUMBER, 1)), r"['’  ]", "")
    behind = F.trim(F.regexp_extract(text, _NUMBER, 2))
    cast = lambda c: c.try_cast("double")
    decimal_comma = cast(F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", "."))
    thousands = cast(F.regexp_replace(raw, ",", ""))
    distance = lambda v: F.abs(F.ln(v / near))
    either = F.when(raw.rlike("^[+-]?0"), decimal_comma).when(near.isNotNull() & (near > 0) & (distance(decimal_comma) < distance(thousands)), decimal_comma).otherwise(thousands)
    number = (
        F.when(raw.rlike(r"^[+-]?\d+(\.\d+)?$"), cast(raw))
        .when(raw.rlike(r"^[+-]?\d{1,3},\d{3}$"), either)
        .when(raw.rlike(r"^[+-]?\d+,\d+$"), decimal_comma)
        .when(raw.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), thousands)
        .when(raw.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,\d+)?$"), decimal_comma)
    )
    bare = F.regexp_replace(F.trim(text), r"^[<>≤≥=~≈]+\s*", "")
    scientific = bare.rlike(SCIENTIFIC)
    return F.when(scientific, cast(bare)).otherwise(number), F.when(~scientific & (behind != ""), behind)


@dataclass
class Kind:
    """A kind of quantity: its common unit, typical bounds and the units that convert into the common one."""

    unit: str | None
    low: float | None
    high: float | None
    units: list[tuple[str, float, float]] = field(default_factory=list)  # code, factor, shift

    def components(self) -> list[tuple[str, float, float]]:
        """One of each set of units that convert alike, the common unit standing for its equals."""
        ordered = sorted(self.units, key=lambda u: (u[0] != self.unit, u[0]))
        return [u for i, u in enumerate(ordered) if u[1:] not in [v[1:] for v in ordered[:i]]]

    def stands(self, code: str | None) -> str | None:
        moved = next((u[1:] for u in self.units if u[0] == code), None)
        return next((c for c, *by in self.components() if tuple(by) == moved), code)

    def spelled(self) -> dict[str, tuple[str, float, float]]:
        """Every spelling of every unit; one that would mean two of them means the one written like it, else the first
        by code."""
        out: dict[str, tuple] = {}
        for code, factor, shift in self.units:
            base = fold_text(code)
            for rank, keys in ((0, (base,)), (1, (base, *SPELLINGS.get(base, ())))):
                for key in keys:
                    out[key] = min(out.get(key, (9, "")), (rank, code, factor, shift))
        return {k: v[1:] for k, v in out.items()}


def kinds_of(kinds: DataFrame, factors: DataFrame) -> dict[str, Kind]:
    """The kinds by name, of kinds (canonical_name, unit, typical_low, typical_high) and factors (canonical_name,
    from_unit, to_unit, factor, shift): dimension tables, of which one with more than BROADCAST_ROWS rows raises
    ValueError. Of repeated kinds the one first by unit counts."""
    out: dict[str, Kind] = {}
    listed = kinds.where("canonical_name IS NOT NULL").select("canonical_name", "unit", F.col("typical_low").cast("double"), F.col("typical_high").cast("double")).distinct()
    for name, unit, low, high in sorted(rows_of(listed), key=lambda r: (r[0], r[1] or "", r[2] or 0.0, r[3] or 0.0)):
        out.setdefault(name, Kind(unit, low, high, [(unit, 1.0, 0.0)] if unit else []))
    moves = factors.where("from_unit IS NOT NULL AND factor IS NOT NULL").select("canonical_name", "to_unit", "from_unit", F.col("factor").cast("double"), F.coalesce(F.col("shift").cast("double"), F.lit(0.0))).distinct()
    for name, to, code, factor, shift in sorted(rows_of(moves), key=lambda r: tuple(x if isinstance(x, float) else x or "" for x in r)):
        if name in out and to == out[name].unit and code not in [u[0] for u in out[name].units]:
            out[name].units.append((code, factor, shift))
    return out


_UNIT = "struct<code: string, factor: double, shift: double>"


def _readings(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """The numeric rows of known kinds beside their dims, with _number, _written (the unit written, as _UNIT, null if
    none of its kind's is), _low and _high (the bounds where above 0), _from and _to (the bounds)."""
    df = rows.join(F.broadcast(dims), F.col("canonical_name") == F.col("_kind"), "inner")
    ref = F.col("reference_text")
    num = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    low = F.coalesce("reference_low", F.when(ref.rlike(r"\d\s*(?:-|–|—|to)\s*\d"), num(F.regexp_extract(ref, r"([\d.,]+)\s*(?:-|–|—|to)\s*([\d.,]+)", 1))))
    high = F.coalesce("reference_high", F.when(ref.rlike(r"\d\s*(?:-|–|—|to)\s*\d"), num(F.regexp_extract(ref, r"([\d.,]+)\s*(?:-|–|—|to)\s*([\d.,]+)", 2))).when(ref.rlike(r"^\s*[<≤]"), num(F.regexp_extract(ref, r"[<≤]=?\s*([\d.,]+)", 1))))
    df = df.withColumn("_from", low).withColumn("_to", high).withColumn("_low", F.when(F.col("_from") > 0, F.col("_from"))).withColumn("_high", F.when(F.col("_to") > 0, F.col("_to")))
    middle = F.coalesce(F.sqrt(F.col("_low") * F.col("_high")), F.col("_high"))
    number, behind = read_number(F.col("value_text"), middle)
    plain = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    plain = F.when(F.abs(plain) < float("inf"), plain)
    beside = F.regexp_extract(ref, r"(?:-|–|—|to|<|≤)\s*[\d.,]+\)?\s*((?:x?10[*^eE]|/|[A-Za-z%°µμ]).*)$", 1)
    written = F.coalesce(F.when(F.trim("unit") != "", F.col("unit")), F.when(plain.isNull(), behind), F.when(F.trim(beside) != "", beside))
    read = df.select("*", F.inline(F.array(F.struct(F.coalesce(plain, number).alias("_number"), fold_unit(written).alias("_key"))))).where("_number IS NOT NULL")
    return read.withColumn("_written", F.try_element_at("_spelled", F.coalesce("_key", F.lit("")))).drop("_spelled", "_key")


def fit_mixtures(histogram: list[tuple], choices: dict[str, list[tuple[str, float, float]]], typical: dict[str, tuple[float, float]], rounds: int = 50) -> dict[str, tuple[float, float, dict[str, float]]]:
    """kind -> (centre and spread of ln(value in the common unit), weight of each unit), fitted by EM. histogram:
    (kind, code or None, bin of ln(value as recorded), rows); a row with a code is known to be of that component."""
    by_kind = defaultdict(list)
    for kind, code, b, n in histogram:
        by_kind[kind].append((code, b, n))
    out = {}
    for kind, units in choices.items():
        lo, hi = typical.get(kind, (None, None))
        mu = (math.log(lo) + math.log(hi)) / 2 if lo and hi and lo > 0 and hi > 0 else 0.0
        sd = max((math.log(hi) - math.log(lo)) / 4, 0.02) if lo and hi and lo > 0 and hi > lo else 1.0
        w = np.full(len(units), 1 / len(units))
        rows = by_kind.get(kind, [])
        if rows:
            x = np.exp(np.array([b for _, b, _ in rows]) * BIN)
            n = np.array([c for _, _, c in rows], float)
            y = x[:, None] * np.array([f for _, f, _ in units]) + np.array([s for _, _, s in units])
            ly = np.log(np.where(y > 0, y, np.nan))
            jac = np.log(np.abs(np.array([f for _, f, _ in units])) * x[:, None]) - ly
            known = np.array([[code is None or code == u for u, _, _ in units] for code, _, _ in rows])
            for _ in range(rounds):
                with np.errstate(divide="ignore", invalid="ignore"):
                    lp = np.where(known & np.isfinite(ly), np.log(w) - np.log(sd) - (ly - mu) ** 2 / (2 * sd * sd) + jac, -np.inf)
                top = lp.max(axis=1, keepdims=True)
                ok = np.isfinite(top[:, 0])
                r = np.zeros_like(lp)
                r[ok] = np.exp(lp[ok] - top[ok])
                r[ok] /= r[ok].sum(axis=1, keepdims=True)
                # Readings far outside weigh little, so that faulty ones don't widen the spread.
                far = np.nan_to_num(np.abs(ly - mu) / sd, nan=99.0)
                h = r * n[:, None] * np.where(far < 4, 1.0, 4.0 / np.maximum(far, 1e-9)) ** 2
                total = h.sum()
                if not total > 0:
                    break
                before = mu, sd
                mu = float((h * np.nan_to_num(ly)).sum() / total)
                sd = max(float(math.sqrt((h * np.nan_to_num(ly - mu) ** 2).sum() / total)), 0.01)
                w = (h.sum(axis=0) + 0.5) / (total + 0.5 * len(units))
                if abs(mu - before[0]) < 1e-6 and abs(sd - before[1]) < 1e-6:
                    break
        out[kind] = (mu, sd, {u: float(v) for (u, _, _), v in zip(units, w)})
    return out


def _weighted_median(pairs: list[tuple[float, int]], none: float = 0.17) -> float:
    pairs, half, seen = sorted(pairs), sum(n for _, n in pairs) / 2, 0.0
    for x, n in pairs:
        seen += n
        if seen >= half:
            return x
    return none


def convert_units(rows: DataFrame, kinds: DataFrame, factors: DataFrame, sure: float = 0.95, written: bool = False) -> DataFrame:
    """rows of a known canonical_name with a numeric result, with ``recorded`` (the number), ``from_unit`` (code),
    ``converted`` (in the common unit), ``common_unit``, ``common_low`` and ``common_high`` (the row's bounds, of its
    text where the columns have none, in the common unit), ``unit_factor``, ``unit_shift``, ``unit_known`` (it was written),
    ``posterior`` and ``uncertain``.

    rows: canonical_name, value, value_text, unit, reference_low, reference_high, reference_text and any others. Rows
    of other kinds (a null or unlisted canonical_name) and rows without a number are left out, repeated rows kept. A
    unit that is written but none of its kind's is taken as missing. A number not above 0 has no logarithm: it is no
    part of the fit, and takes its unit by the bounds and the weights of the units. kinds, factors: as in kinds_of,
    made one literal table that is sent to all executors. The histogram brought to the driver has at most one row for
    each kind, unit and bin of the logarithm of a double, whatever the number of rows. With ``written``, rows without a
    written unit are left out and nothing is fitted, so the rows are read once. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    known = kinds_of(kinds, factors)
    added = ["recorded", "from_unit", "converted", "common_unit", "common_low", "common_high", "unit_factor", "unit_shift", "unit_known", "posterior", "uncertain"]
    kept = [c for c in rows.columns if c not in added]
    if written:
        told = _readings(rows, spark.createDataFrame([(k, x.unit, x.spelled()) for k, x in known.items()], "_kind string, _unit string, _spelled map<string, " + _UNIT + ">")).where("_written IS NOT NULL")
        factor, shift = F.col("_written.factor"), F.col("_written.shift")
        moved = lambda c: F.col(c) * factor + shift
        return told.select(*kept, F.col("_number").alias("recorded"), F.col("_written.code").alias("from_unit"), moved("_number").alias("converted"), F.col("_unit").alias("common_unit"), moved("_from").alias("common_low"), moved("_to").alias("common_high"), factor.alias("unit_factor"), shift.alias("unit_shift"), F.lit(True).alias("unit_known"), F.lit(1.0).alias("posterior"), F.lit(False).alias("uncertain"))
    kind = "_kind string, _th double, _spelled map<string, " + _UNIT + ">"
    read = _readings(rows, spark.createDataFrame([(k, x.high, x.spelled()) for k, x in known.items()], kind))
    bins = F.round(F.ln("_number") / BIN).cast("int")
    off = F.ln((F.col("_high") * F.col("_written.factor") + F.col("_written.shift")) / F.col("_th"))
    got = read.where("_number > 0").groupBy("canonical_name", F.col("_written.code").alias("code"), bins.alias("b")).agg(F.count("*").alias("n"), F.count(off).alias("m"), F.percentile_approx(F.abs(off), 0.5, 50).alias("d")).collect()
    histogram = [(r[0], known[r[0]].stands(r[1]), r[2], r[3]) for r in got]
    spread = min(max(1.5 * _weighted_median([(r["d"], r["m"]) for r in got if r["m"]]), SPREAD_LIMITS[0]), SPREAD_LIMITS[1])
    components = {k: x.components() for k, x in known.items()}
    fitted = fit_mixtures(histogram, components, {k: (x.low, x.high) for k, x in known.items()})
    cells = []
    for k, x in known.items():
        mu, sd, w = fitted[k]
        cells.append((k, x.low, x.high, x.unit, x.spelled(), float(mu), float(sd), [(u, f, s, math.log(w[u])) for u, f, s in components[k]]))
    schema = "_kind string, _tl double, _th double, _unit string, _spelled map<string, " + _UNIT + ">, _mu double, _sd double, _units array<struct<code: string, factor: double, shift: double, lw: double>>"
    read = _readings(rows, spark.createDataFrame(cells, schema))

    def fit_of(u: Column) -> Column:
        y = lambda c: c * u["factor"] + u["shift"]
        log = lambda c: F.ln(F.greatest(y(c), F.lit(1e-300)))
        by_value = F.when(F.col("_number") > 0, u["lw"] - F.pow(log(F.col("_number")) - F.col("_mu"), 2) / (2 * F.col("_sd") * F.col("_sd")) + F.ln(F.abs(u["factor"])) - log(F.col("_number")))
        bound = lambda c, t: F.when(F.col(c).isNotNull() & (F.col(t) > 0), -F.pow(log(F.col(c)) - F.ln(t), 2) / (2 * spread**2))
        return F.coalesce(by_value, u["lw"]) + F.coalesce(bound("_low", "_tl"), F.lit(0.0)) + F.coalesce(bound("_high", "_th"), F.lit(0.0))

    scored = F.when(F.col("_written").isNull(), F.transform("_units", lambda u: F.struct(fit_of(u).alias("_fit"), u["code"].alias("_bcode"), u["factor"].alias("_bfactor"), u["shift"].alias("_bshift"))))
    read = read.select("*", F.inline(F.array(F.struct(scored.alias("_scored")))))
    read = read.select("*", F.inline(F.array(F.array_max("_scored"))))
    share = 1 / F.aggregate("_scored", F.lit(0.0), lambda a, s: a + F.exp(s["_fit"] - F.col("_fit")))
    factor, shift = F.coalesce("_written.factor", "_bfactor"), F.coalesce("_written.shift", "_bshift")
    moved = lambda c: F.coalesce(F.col(c) * factor + shift, F.col(c))
    out = read.select(
        *kept, F.col("_number").alias("recorded"), F.coalesce("_written.code", "_bcode").alias("from_unit"), (F.col("_number") * factor + shift).alias("converted"), F.col("_unit").alias("common_unit"), moved("_from").alias("common_low"), moved("_to").alias("common_high"),
        factor.alias("unit_factor"), shift.alias("unit_shift"), F.col("_written").isNotNull().alias("unit_known"), F.when(F.col("_written").isNotNull(), 1.0).otherwise(share).alias("posterior"),
    )
    return out.withColumn("uncertain", F.col("posterior") < sure)
