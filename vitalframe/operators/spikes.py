"""Implausible readings of sensors: spikes, stuck values and physically impossible values, per source.

Each source's readings of a metric are forecast by a local-level state-space model with a Kalman filter, whose noise is
estimated from the series. A reading whose standardised innovation exceeds the gate is a candidate and is withheld from
the update; a candidate is a spike if it also lies far from the source's ordinary level. A stuck sensor shows as
vanishing variance of the innovations. Values that no body or sensor of the source's scale can give are impossible.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.operators.partitions import over_keys
from vitalframe.operators.rolling import latest_delivery


@dataclass(frozen=True)
class Metric:
    """Limits of a metric for each scale a source may use: (least median, low, high), low and high still possible; a
    source's scale is the last one whose least median it reaches. floor: least spread, the sensor's own noise."""

    name: str
    scales: tuple[tuple[float, float, float], ...]
    floor: float


#: skin_temp: difference from a baseline, Celsius, Fahrenheit.
VITALS = (
    Metric("hrv", ((-math.inf, 1e-9, 400.0),), 0.5),
    Metric("rhr", ((-math.inf, 20.0, 250.0),), 0.3),
    Metric("spo2", ((-math.inf, 40.0, 100.0),), 0.15),
    Metric("skin_temp", ((-math.inf, -12.0, 12.0), (15.0, 15.0, 45.0), (55.0, 59.0, 113.0)), 0.05),
)


def noise(y: np.ndarray, floor: float) -> tuple[float, float]:
    """(variance of an observation, variance of the state's step) of a local-level model, estimated from the series'
    own changes: over one reading they have the variance 2 r + q, over two 2 r + 2 q. Robust spreads are taken, so that
    faulty readings do not count; floor is the sensor's least spread."""

    def spread(d: np.ndarray) -> float:
        return (1.4826 * float(np.median(np.abs(d)))) ** 2 if len(d) else 0.0

    one, two = spread(np.diff(y)), spread(y[2:] - y[:-2])
    q = max(two - one, 0.0)
    return max((one - q) / 2, floor * floor), q


def kalman_bounds(y: np.ndarray, gap: np.ndarray, level: float, spread: float, r: float, q: float, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """(forecast of each reading, standard deviation of its innovation) under a local-level model. Readings whose
    standardised innovation is above the gate do not update the state, nor do missing ones (NaN)."""
    most = max(spread * spread, r)
    x, p = level, most
    forecast, deviation = np.empty(len(y)), np.empty(len(y))
    for i, (v, g) in enumerate(zip(y.tolist(), gap.tolist())):
        p = min(p + q * max(g, 1.0), most)
        s = math.sqrt(p + r)
        forecast[i], deviation[i] = x, s
        if abs(v - x) <= gate * s:  # false for NaN
            k = p / (p + r)
            x += k * (v - x)
            p *= 1 - k
    return forecast, deviation


def stuck_readings(y: np.ndarray, least: int) -> np.ndarray:
    """Which of the readings (without missing ones) are stuck: the innovations of a filter that trusts the sensor
    wholly, which are the changes from one reading to the next, vanish over ``least`` readings, as does their
    variance."""
    out = np.zeros(len(y), bool)
    if len(y) < least:
        return out
    moved = np.concatenate([[0], np.cumsum(np.diff(y) != 0)])
    for i in np.flatnonzero(moved[least - 1 :] == moved[: len(y) - least + 1]):
        out[i : i + least] = True
    return out


@dataclass
class Limits:
    """Of each day of one source and metric: beyond low and high a reading is impossible, beyond near_low and near_high
    it is a spike, and equal to stuck (NaN: none) it is stuck."""

    low: float
    high: float
    near_low: np.ndarray
    near_high: np.ndarray
    stuck: np.ndarray


def limits(day: np.ndarray, y: np.ndarray, metric: Metric, gate: float, far: float, stuck: int) -> Limits | None:
    """From the counted readings of one source in day order (NaN: none); None if there are none."""
    have = np.isfinite(y)
    if not have.any():
        return None
    low, high = next((a, b) for m, a, b in reversed(metric.scales) if float(np.median(y[have])) >= m)
    possible = have & (y >= low) & (y <= high)
    near_low, near_high = np.full(len(y), -np.inf), np.full(len(y), np.inf)
    if possible.any():
        good = y[possible]
        level = float(np.median(good))
        spread = max(1.4826 * float(np.median(np.abs(good - level))), metric.floor)
        r, q = noise(good, metric.floor)
        forecast, deviation = kalman_bounds(np.where(possible, y, np.nan), np.diff(day, prepend=day[0]), level, spread, r, q, gate)
        near_low = np.minimum(forecast - gate * deviation, level - far * spread)
        near_high = np.maximum(forecast + gate * deviation, level + far * spread)
    held = np.full(len(y), np.nan)
    at = np.flatnonzero(have)
    still = at[stuck_readings(y[at], stuck)]
    held[still] = y[still]
    return Limits(low, high, near_low, near_high, held)


def flag_readings(df: DataFrame, source: list[str], row_id: str, day: str, delivered: str, metrics: tuple[Metric, ...] = VITALS, gate: float = 5.0, far: float = 6.5, stuck: int = 6) -> DataFrame:
    """One row (row_id, metric, reason, reading) for each reading that cannot be right: beyond the gate of the Kalman
    filter (in standard deviations) and, which is checked then, more than ``far`` ordinary spreads from the source's
    ordinary level, or physically impossible, or one of ``stuck`` or more recorded days with the same value.

    Of several rows of a source and day the one delivered last counts (ties: the greatest id), also where its reading
    is null; it alone makes the limits of that day, against which all rows of the day are held. So what a task holds of
    a source is one row a day, which the calendar bounds, however often its days were delivered; rows themselves are
    joined to the limits of their day. Rows without a day are judged as before the first day, null sources are one
    source, null ids are kept as null, NaN is no reading, an empty table gives an empty result.
    """
    keys = [f"_s{i}" for i in range(len(source))]
    kinds = dict(df.dtypes)
    names = [f"_m{i}" for i in range(len(metrics))]
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(source, keys)], F.coalesce(F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")), F.lit(-(10**6))).alias("_day"), F.col(delivered).alias("_at"), F.col(row_id).alias("_id"),
        *[F.nanvl(F.col(m.name).cast("double"), F.lit(None).cast("double")).alias(n) for m, n in zip(metrics, names)],
    )
    days = latest_delivery(rows, [*keys, "_day"], ["_at", "_id"], ["_at", "_id", *names]).drop("_at", "_id")
    columns = [f"{n}_{x}" for n in names for x in ("low", "high", "near_low", "near_high", "stuck")]

    def step(groups: list[pd.DataFrame]) -> pd.DataFrame:
        parts = []
        for g in groups:
            d = g["_day"].to_numpy(np.int64)
            part = {k: g[k] for k in [*keys, "_day"]}
            for m, n in zip(metrics, names):
                x = limits(d, g[n].to_numpy(float), m, gate, far, stuck)
                if x is None:
                    x = Limits(*[np.nan] * 5)
                part |= {f"{n}_{c}": v for c, v in vars(x).items()}
            parts.append(pd.DataFrame(part, index=g.index))
        return pd.concat(parts, ignore_index=True)[[*keys, "_day", *columns]]

    schema = ", ".join([*[f"{k} {kinds[c]}" for c, k in zip(source, keys)], "_day int", *[f"{c} double" for c in columns]])
    of_day = over_keys(days, keys, ["_day"], step, schema).select(*[F.col(c).alias(f"_l{c}") for c in [*keys, "_day"]], *columns)
    on = F.lit(True)
    for k in [*keys, "_day"]:
        on = on & F.col(k).eqNullSafe(F.col(f"_l{k}"))
    judged = []
    for m, n in zip(metrics, names):
        y = F.col(n)
        # A day without limits has a reading only where another delivery of it counts and no day has one.
        reason = F.when((y < F.col(f"{n}_low")) | (y > F.col(f"{n}_high")), "impossible").when((y < F.col(f"{n}_near_low")) | (y > F.col(f"{n}_near_high")), "spike").when(y == F.col(f"{n}_stuck"), "stuck")
        judged.append(F.struct(F.lit(m.name).alias("metric"), F.when(~F.isnan(f"{n}_low"), reason).alias("reason"), y.alias("reading")))
    found = rows.join(of_day, on).select("_id", F.explode(F.array(*judged)).alias("_j")).where("_j.reason IS NOT NULL")
    return found.select(F.col("_id").alias(row_id), "_j.metric", "_j.reason", "_j.reading")
