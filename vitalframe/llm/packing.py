"""Items of varying length packed into containers of a fixed capacity.

All planning is done on the histogram of lengths, never on the items. Items far smaller than a container are first run
together into bundles, so that rounding costs little; lengths are then rounded up to a few hundred classes. Patterns
of up to three items that fill a container are all enumerated, and patterns of more items are added where they lower
the misfit most (a knapsack over the classes finds the best one); the number of times each pattern is repeated is fitted
to the histogram by non-negative least squares and rounded down; what is left is packed by filling containers from the
longest class downwards, each filling repeated as often as its classes allow. Items then find their container by
their rank in their class, which is counted in salted groups, so no class is ever sorted or gathered in one task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.session import cut, small

CLASSES = 256  # length classes of a container, at most
SMALL = 32  # items below this part of a container are bundled
BUNDLE = 8  # into bundles of about this part of it
GROUP = 20_000  # items that one salted group holds on average


def few_item_patterns(classes: int, present: np.ndarray, items: int = 3) -> list[tuple[int, ...]]:
    """Patterns of at most ``items`` present classes (descending) that fill a container of ``classes`` exactly."""
    have = set(present.tolist())
    out: list[tuple[int, ...]] = []

    def extend(left: int, top: int, chosen: tuple[int, ...]) -> None:
        if left in have and left <= top:
            out.append((*chosen, left))
        more = items - len(chosen)
        if more >= 2:
            for k in range(min(top, left - 1), -(-left // more) - 1, -1):
                if k in have:
                    extend(left - k, k, (*chosen, k))

    extend(classes, classes, ())
    return out


def best_pattern(price: np.ndarray, classes: int) -> tuple[float, tuple[int, ...]]:
    """The fill of a container with the greatest sum of prices (price[k] for one item of class k)."""
    best, last = np.zeros(classes + 1), np.zeros(classes + 1, int)
    items = np.flatnonzero(price > 0)
    items = items[items > 0]
    for c in range(1, classes + 1):
        best[c], last[c] = best[c - 1], 0
        fit = items[items <= c]
        if len(fit):
            v = best[c - fit] + price[fit]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], last[c] = v[j], fit[j]
    chosen, c = [], classes
    while c > 0:
        if last[c]:
            chosen.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return float(best[classes]), tuple(sorted(chosen, reverse=True))


@dataclass
class Patterns:
    """The matrix of patterns (columns) by classes (rows, weighted), kept by its few entries."""

    items: list[tuple[int, ...]]  # row numbers of each pattern
    weight: np.ndarray

    def __post_init__(self) -> None:
        self.lens = np.array([len(p) for p in self.items], np.int64)
        self.rows = np.array([k for p in self.items for k in p], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=np.repeat(x, self.lens), minlength=len(self.weight)) * self.weight

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.add.reduceat((r * self.weight)[self.rows], self.starts) if len(self.rows) else np.zeros(0)


def non_negative_least_squares(a: Patterns, b: np.ndarray, x: np.ndarray, rounds: int = 200) -> np.ndarray:
    """argmin |a x - b| over x >= 0 from the start x, by accelerated projected gradients."""
    v = np.ones(len(x))
    for _ in range(30):  # the greatest singular value, by power iteration
        v = a.transposed_times(a.times(v))
        v /= max(float(np.linalg.norm(v)), 1e-300)
    step = 1 / max(1.05 * float(np.linalg.norm(a.times(v))) ** 2, 1e-12)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * a.transposed_times(a.times(y) - b), 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], classes: int = CLASSES, rounds: int = 60) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): fills that use every item of the histogram (class -> items, classes 1 to ``classes``)."""
    left = np.zeros(classes + 1, np.int64)
    for k, n in histogram.items():
        left[k] += n
    out: list[tuple[tuple[int, ...], int]] = []
    present = np.flatnonzero(left)
    if len(present):
        # Rare classes weigh as much as frequent ones, so that their items find partners.
        weight = 1 / np.sqrt(np.maximum(left[present], 1.0))
        where = {int(k): i for i, k in enumerate(present)}

        def columns(patterns: list[tuple[int, ...]]) -> Patterns:
            return Patterns([tuple(where[k] for k in p) for p in patterns], weight)

        target = left[present] * weight
        chosen = few_item_patterns(classes, present)
        x = np.zeros(len(chosen))
        if chosen:  # all of them are fitted; those of no use are left, and come back below if they are of use
            x = non_negative_least_squares(columns(chosen), target, x)
            chosen, x = [p for p, n in zip(chosen, x) if n > 0.5], x[x > 0.5]
        for _ in range(rounds):
            a = columns(chosen)
            if len(chosen):
                x = non_negative_least_squares(a, target, x)
            misfit = target - a.times(x)
            price = np.zeros(classes + 1)
            price[present] = misfit * weight
            gain, p = best_pattern(price, classes)
            if gain <= 1e-9 or p in chosen:
                break
            chosen.append(p)
            x = np.append(x, 0.0)
        for p, n in sorted(zip(chosen, np.floor(x + 1e-9).astype(np.int64)), key=lambda t: -t[1]):
            need = np.bincount(p, minlength=classes + 1)
            n = int(min(n, *(left[k] // need[k] for k in set(p))))
            if n > 0:
                left -= n * need
                out.append((p, n))
    while left.any():
        fill, room = [], classes
        k = int(np.flatnonzero(left).max())
        while room and k > 0:
            n = min(int(left[k]), room // k)
            fill += [k] * n
            room -= n * k
            lower = np.flatnonzero(left[1 : min(k, room + 1)]) if room else np.array([], int)
            k = int(lower.max()) + 1 if len(lower) else 0
        need = np.bincount(fill, minlength=classes + 1)
        n = int(min(left[k] // need[k] for k in set(fill)))
        left -= n * need
        out.append((tuple(fill), n))
    return out


def rank_in_class(items: DataFrame, kind: str, row: list[str], total: int, group: int = GROUP) -> DataFrame:
    """items with ``_rank``, counted from 0 in each kind: kinds are split by a hash of the row into groups of about
    ``group`` items, which are ranked by themselves and moved by the sizes of the groups before them."""
    salts = max(1, math.ceil(total / group))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(kind, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(kind).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(kind, "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy(kind, "_salt").orderBy(*row)) - 1)
    return ranked.join(small(offsets), [kind, "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_salt", "_in", "_before")


def bundles(pieces: DataFrame, capacity: int, total: int) -> DataFrame:
    """pieces (_id, _piece, _start, _n) with ``_group`` and ``_bundle``, which name a bundle: pieces of less than capacity / SMALL are run
    together, in the order of a hash, into bundles of about capacity / BUNDLE."""
    salts = max(1, math.ceil(total / GROUP))
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", "_piece"), F.lit(salts)).cast("int"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_id", "_piece", "_n").rowsBetween(Window.unboundedPreceding, -1))
    return salted.select("_id", "_piece", "_start", "_n", "_group", F.floor(F.coalesce(before, F.lit(0)) / max(capacity // BUNDLE, 1)).cast("bigint").alias("_bundle"))


def pack(sizes: DataFrame, row_id: str, size: str, capacity: int) -> DataFrame:
    """(row_id, piece_no, start, n, container_id): where each item lies. Items longer than the capacity are split into
    full containers and a rest; no other item is split. Items without size (0 or null) take no room and no container;
    repeated rows are packed each for itself (their pieces' order is by the other rows' hash, so give unique ids if
    that matters). sizes is read several times: give one that is cheap to read, such as a checkpoint."""
    if capacity < 1:
        raise ValueError("a container must hold something")
    # Classes are ranges of lengths, each counted as its longest; a length beyond the last class fills a container.
    width = -(-capacity // CLASSES)
    classes = capacity // width
    full = F.floor(F.col(size) / capacity).cast("bigint")
    whole = sizes.where(F.col(size) > 0).select(F.col(row_id).alias("_id"), F.col(size).cast("bigint").alias("_size"), full.alias("_full"))
    rest = F.col("_size") - F.col("_full") * capacity
    least = capacity // SMALL
    pieces = whole.where(rest > 0).select("_id", F.col("_full").alias("_piece"), (F.col("_full") * capacity).alias("_start"), rest.alias("_n"))
    # Bundles and items are written once, as they are read several times.
    tiny = cut(bundles(pieces.where(F.col("_n") <= least), capacity, pieces.where(F.col("_n") <= least).count())) if least else bundles(pieces.limit(0), capacity, 0)
    bundled = tiny.groupBy("_group", "_bundle").agg(F.sum("_n").alias("_n")).select("_group", "_bundle", F.lit(None).cast(dict(pieces.dtypes)["_id"]).alias("_id"), F.lit(0).cast("bigint").alias("_piece"), F.lit(0).cast("bigint").alias("_start"), "_n")
    none = [F.lit(None).cast("int").alias("_group"), F.lit(None).cast("bigint").alias("_bundle")]
    k = F.ceil(F.col("_n") / width).cast("int")
    pieces = pieces.where(F.col("_n") > least).select(*none, "_id", "_piece", "_start", "_n").unionByName(bundled).withColumn("_class", F.when(k <= classes, k).otherwise(0))
    top = whole.where("_full > 0").select("_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)).alias("_piece")).select(*none, "_id", "_piece", (F.col("_piece") * capacity).alias("_start"), F.lit(capacity).cast("bigint").alias("_n"), F.lit(0).alias("_class"))
    items = cut(pieces.unionByName(top))
    histogram = {r[0]: r[1] for r in items.groupBy("_class").count().collect()}  # at most CLASSES + 1 rows
    singles = histogram.pop(0, 0)
    # class -> first rank, last rank + 1, first container, items of the class in each
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = singles
    for pattern, n in plan(histogram, classes):
        for k in set(pattern):
            m = pattern.count(k)
            slots[k].append((used[k], used[k] + n * m, base, m))
            used[k] += n * m
        base += n
    slots[0].append((0, singles, 0, 1))
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}
    shared = sizes.sparkSession.sparkContext.broadcast(tables)  # at most one entry for each pattern and class

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kind, rank = f["_class"].to_numpy(), f["_rank"].to_numpy(np.int64)
            at = np.empty(len(f), np.int64)
            for k in np.unique(kind):
                first, _, container, m = shared.value[int(k)]
                here = kind == k
                seg = np.searchsorted(first, rank[here], side="right") - 1
                at[here] = container[seg] + (rank[here] - first[seg]) // m[seg]
            yield f[["_group", "_bundle", "_id", "_piece", "_start", "_n"]].assign(container_id=at)

    ranked = rank_in_class(items, "_class", ["_group", "_bundle", "_id", "_piece"], sum(histogram.values()) + singles)
    kind = dict(sizes.dtypes)[row_id]
    columns = ["_group", "_bundle", "_id", "_piece", "_start", "_n"]
    placed = ranked.select(*columns, "_class", "_rank").mapInPandas(place, f"_group int, _bundle bigint, _id {kind}, _piece bigint, _start bigint, _n bigint, container_id bigint")
    named = [F.col("_id").alias(row_id), F.col("_piece").alias("piece_no"), F.col("_start").alias("start"), F.col("_n").alias("n"), "container_id"]
    alone = placed.where("_bundle IS NULL").select(*named)
    if not least:
        return alone
    return alone.unionByName(tiny.join(placed.where("_bundle IS NOT NULL").select("_group", "_bundle", "container_id"), ["_group", "_bundle"]).select(*named))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, and the share of the containers that is filled."""
    got = packed.agg(F.countDistinct("container_id").alias("containers"), F.count("*").alias("pieces"), F.sum("n").alias("tokens"))
    return got.withColumn("filled", F.col("tokens") / (F.col("containers") * capacity))


__all__ = ["cut", "fill_report", "pack", "plan", "rank_in_class"]
