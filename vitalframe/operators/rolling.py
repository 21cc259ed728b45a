"""Totals and averages over trailing calendar periods, for every entity and day.

A two-stack queue holds the active window of an entity: values are pushed on the back stack with a running aggregate,
and moved to the front stack, as suffix aggregates, when the front runs empty. Each value is combined at most twice,
and no value is ever subtracted, so minimum and maximum work as sums do. The entities' days are cut into blocks, each
of which also gets the days before it that its first windows reach, so that an entity with very many days is spread
over tasks and the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.operators.partitions import over_keys

#: name: (identity, combine). Any associative combine with an identity will do; none needs an inverse.
MONOIDS: dict[str, tuple[float, Callable[[float, float], float]]] = {
    "sum": (0.0, lambda a, b: a + b),
    "max": (float("-inf"), lambda a, b: a if a >= b else b),
    "min": (float("inf"), lambda a, b: a if a <= b else b),
}


class TwoStackQueue:
    """First-in-first-out window with its aggregate at hand in constant amortised time."""

    __slots__ = ("back", "back_total", "combine", "front", "none")

    def __init__(self, none: float, combine: Callable[[float, float], float]):
        self.none, self.combine = none, combine
        self.front: list[float] = []  # suffix aggregates; the oldest value's is last
        self.back: list[float] = []
        self.back_total = none

    def __len__(self) -> int:
        return len(self.front) + len(self.back)

    def push(self, value: float) -> None:
        self.back.append(value)
        self.back_total = self.combine(self.back_total, value)

    def pop(self) -> None:
        if not self.front:
            total = self.none
            while self.back:
                total = self.combine(self.back.pop(), total)
                self.front.append(total)
            self.back_total = self.none
        self.front.pop()

    def total(self) -> float:
        return self.combine(self.front[-1], self.back_total) if self.front else self.back_total


def trailing(values: list[float], window: int, monoid: str) -> list[float]:
    """The aggregate of each value and the window - 1 before it."""
    none, combine = MONOIDS[monoid]
    queue, out = TwoStackQueue(none, combine), []
    for v in values:
        queue.push(v)
        if len(queue) > window:
            queue.pop()
        out.append(queue.total())
    return out


def latest_delivery(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: that with the greatest order columns (null least; ties by all columns in turn)."""
    best = F.max(F.struct(*order, *[F.col(c) for c in columns if c not in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in columns])


def rolling_totals(df: DataFrame, entity: list[str], day: str, metrics: list[str], windows: tuple[int, ...] = (7, 30), aggregates: tuple[str, ...] = ("sum",), delivered: str | None = None, block_days: int = 512) -> DataFrame:
    """For every entity and calendar day from its first to its last day, one row for each metric with, for each window
    w, ``total_w`` (days without value count 0), ``avg_w`` (total / w) and, if asked for, ``max_w`` / ``min_w`` (null
    where no day of the window has a value).

    delivered: of several rows of an entity and day the one with the greatest value counts, also where its metric is
    null; ties go to the greatest metrics. Rows without a day are no day of the entity and are left out; a null in an
    entity column is an entity of its own; NaN counts as null. An empty table gives an empty result. Columns that are
    not named are ignored, whatever their names.
    """
    keys = [f"_e{i}" for i in range(len(entity))]
    vals = [f"_m{i}" for i in range(len(metrics))]
    rows = df.where(F.col(day).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys)], F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).alias("_day"),
        (F.col(delivered) if delivered else F.lit(None).cast("timestamp")).alias("_at"), *[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(v) for m, v in zip(metrics, vals)],
    )
    days = latest_delivery(rows, [*keys, "_day"], ["_at"], ["_at", *vals]).drop("_at")
    halo = max(windows) - 1
    block = F.floor(F.col("_day") / block_days).cast("int")
    # A block's own rows, and those of its last days once more for the block after it.
    own = days.select(*keys, F.explode(F.when(F.pmod(F.col("_day"), F.lit(block_days)) >= block_days - halo, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"), "_day", F.lit(None).cast("int").alias("_last"), *vals)
    span = days.groupBy(*keys).agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    heads = span.select(*keys, F.explode(F.sequence(F.floor(F.col("_first") / block_days).cast("int"), F.floor(F.col("_last") / block_days).cast("int"))).alias("_block"), F.col("_first").alias("_day"), "_last", *[F.lit(None).cast("double").alias(v) for v in vals])
    kinds = {c: t for c, t in df.dtypes if c in entity}
    named = [(f"{a}_{w}", a, w) for w in windows for a in aggregates]
    schema = ", ".join([*[f"{k} {kinds[c]}" for c, k in zip(entity, keys)], "_day int", "metric string", *[f"`{n}` double" for n, _, _ in named]])
    n_out = len(named)

    def step(groups: list[pd.DataFrame]) -> pd.DataFrame:
        parts = []
        for g in groups:
            head = g["_last"].notna().to_numpy()
            if not head.any():  # the days before a block that the entity doesn't reach
                continue
            b = int(g["_block"].iloc[0])
            first, last = int(g["_day"][head].iloc[0]), int(g["_last"][head].iloc[0])
            start, end = max(first, b * block_days), min(last, (b + 1) * block_days - 1)
            begin = max(first, start - halo)
            at = g["_day"].to_numpy()[~head].astype(np.int64) - begin
            keep = (at >= 0) & (at <= end - begin)
            for m, v in zip(metrics, vals):
                x = np.full(end - begin + 1, np.nan)
                x[at[keep]] = g[v].to_numpy(dtype=float)[~head][keep]
                part = {"_day": np.arange(start, end + 1, dtype=np.int32), "metric": m}
                for name, a, w in named:
                    filled = np.where(np.isnan(x), MONOIDS[a][0], x).tolist()
                    got = np.array(trailing(filled, w, a)[start - begin :])
                    part[name] = got if a == "sum" else np.where(np.isfinite(got), got, np.nan)
                part = pd.DataFrame(part)
                for k in keys:
                    part.insert(0, k, [g[k].iloc[0]] * len(part))
                parts.append(part)
        if not parts:
            return pd.DataFrame({c: pd.Series(dtype=object if c in keys or c == "metric" else float) for c in [*keys, "_day", "metric", *[n for n, _, _ in named]]})
        return pd.concat(parts, ignore_index=True)[[*keys, "_day", "metric", *[n for n, _, _ in named]]]

    assert n_out
    out = over_keys(own.unionByName(heads), [*keys, "_block"], ["_day"], step, schema)
    cols = []
    for w in windows:
        for a in aggregates:
            cols.append(F.col(f"sum_{w}").alias(f"total_{w}") if a == "sum" else F.nanvl(F.col(f"{a}_{w}"), F.lit(None).cast("double")).alias(f"{a}_{w}"))
        if "sum" in aggregates:
            cols.append((F.col(f"sum_{w}") / w).alias(f"avg_{w}"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(entity, keys)], F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day")).alias("day"), "metric", *cols)
