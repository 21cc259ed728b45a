"""Per-key streaming over sorted partitions, for operators that SQL expressions cannot state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def runs(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Positions at which a new key begins in a frame sorted by keys (null equals null)."""
    new = np.zeros(len(frame), bool)
    if len(frame):
        new[0] = True
    for k in keys:
        codes = pd.factorize(frame[k], use_na_sentinel=True)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def keyed(frames: Iterator[pd.DataFrame], keys: list[str], step: Callable[[list[pd.DataFrame]], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hands complete key groups of a sorted partition to step, a batch of groups at a time; only the group that
    the batch's end cuts is carried over to the next batch."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        starts = runs(frame, keys)
        if rest:
            edge = pd.concat([rest[-1].iloc[-1:], frame.iloc[:1]])
            same = len(runs(edge, keys)) == 1
            head_end = (starts[1] if len(starts) > 1 else len(frame)) if same else 0
            if same:
                rest.append(frame.iloc[:head_end])
                frame = frame.iloc[head_end:]
            if not len(frame):
                continue
            yield step([pd.concat(rest, ignore_index=True)])
            rest, starts = [], runs(frame, keys)
        last = starts[-1]
        if last:
            cuts = [*starts[:-1], last]
            yield step([frame.iloc[a:b].reset_index(drop=True) for a, b in zip(cuts, cuts[1:])])
        rest = [frame.iloc[last:]]
    if rest:
        yield step([pd.concat(rest, ignore_index=True)])


def over_keys(df: DataFrame, keys: list[str], order: list[str], step: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """df hash-partitioned by keys, sorted in each partition by keys and order, and mapped by step group by group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return keyed(frames, keys, step)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
