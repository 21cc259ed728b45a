"""Sources mixed to target shares of the total size, without sorting.

A document's place is its hash. Sizes are summed by source and hash bucket; the bucket in which a source's budget runs
out is found from the sums, and only that bucket is split further, until it holds one document. The documents below the
threshold so found are taken once more than the others; a filter does that. Thresholds are nested: a larger budget
takes a superset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalframe.session import rows_of

BITS = 12  # of the hash, told apart at each level
LEVELS = 5  # 60 of the hash's bits; documents that agree in all of them are taken or left together


def place(*key: str) -> Column:
    """60 bits of a document's hash, not negative."""
    return F.shiftrightunsigned(F.xxhash64(*key), 4)


@dataclass
class Budget:
    source: str
    target: float
    most: int  # times a document may be used
    available: int
    wanted: float = 0.0
    every: int = 0  # times each document is used
    left: float = 0.0  # size still wanted beyond that
    prefix: int = 0  # of the boundary bucket
    done: bool = False
    below: int = 0  # documents whose place is below this are used once more


def budgets(sizes: DataFrame, targets: DataFrame, source: str, size: str) -> list[Budget]:
    """The greatest budgets in the targets' proportion that the sources can give. A source without documents gets
    none, and the others' shares are in proportion to their targets."""
    rows = rows_of(targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("m")).orderBy("source"))
    named = [r["source"] for r in rows]
    have = {r[0]: r[1] for r in sizes.where(F.col(source).isin(named)).groupBy(source).agg(F.sum(size)).collect()} if named else {}
    out = [Budget(r["source"], float(r["t"]), int(r["m"]), int(have.get(r["source"]) or 0)) for r in rows]
    live = [b for b in out if b.available > 0]
    whole = min((b.available * b.most / b.target for b in live), default=0.0)
    for b in live:
        b.wanted = whole * b.target
        b.every = min(int(b.wanted // b.available + 1e-12), b.most)
        b.left = b.wanted - b.every * b.available if b.every < b.most else 0.0
        b.done = b.left < 1
    return out


def find_thresholds(sizes: DataFrame, row_id: str, source: str, size: str, open_: list[Budget]) -> None:
    """Sets ``below`` of each budget. Each level reads only the rows of the buckets that are still split; the sums
    brought to the driver are at most 2 ** BITS for each source."""
    for level in range(LEVELS):
        todo = [b for b in open_ if not b.done]
        if not todo:
            return
        shift = BITS * (LEVELS - 1 - level)
        inside = F.lit(False)
        for b in todo:
            inside = inside | ((F.col(source) == b.source) & (F.shiftrightunsigned(place(row_id), shift + BITS) == b.prefix))
        bucket = F.shiftrightunsigned(place(row_id), shift).alias("bucket")
        sums = sizes.where(inside & (F.col(size) > 0)).groupBy(F.col(source).alias("source"), bucket).agg(F.sum(size).alias("s"), F.count("*").alias("n"))
        by: dict[str, list[tuple[int, int, int]]] = {}
        for r in sums.collect():
            by.setdefault(r["source"], []).append((r["bucket"], r["s"], r["n"]))
        for b in todo:
            b.below = (b.prefix << (shift + BITS)) if level else 0
            b.done = True
            for k, s, n in sorted(by.get(b.source, [])):
                if s <= b.left:
                    b.left -= s
                    b.below = (k + 1) << shift
                elif n == 1 or level == LEVELS - 1:
                    if s - b.left < b.left:  # nearer with the document than without
                        b.left -= s
                        b.below = (k + 1) << shift
                    break
                else:
                    b.prefix, b.done = k, False
                    break


def mix(sizes: DataFrame, targets: DataFrame, row_id: str, source: str, size: str) -> DataFrame:
    """(row_id, source, size, copies) of the documents used, copies at least 1 and at most the source's max_repeats.

    Every source's total is its target share of the whole up to half a document (or a group of equal hashes). Rows of
    other or null sources, and without size, are not used. targets: (source, target_share, max_repeats), a few rows
    (of repeated ones the greatest counts). sizes is read a few times: give a checkpoint.
    """
    plan = budgets(sizes, targets, source, size)
    find_thresholds(sizes, row_id, source, size, plan)
    spark = sizes.sparkSession
    rows = [(b.source, b.every, b.below) for b in plan if b.available > 0]
    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_every", T.IntegerType()), T.StructField("_below", T.LongType())])
    rules = F.broadcast(spark.createDataFrame(rows, schema))
    copies = F.col("_every") + (place(row_id) < F.col("_below")).cast("int")
    return sizes.where(F.col(size) > 0).join(rules, F.col(source) == F.col("_source")).select(row_id, F.col(source).alias("source"), F.col(size).alias("n_tokens"), copies.alias("copies")).where("copies > 0")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, share, most_copies) for each target source."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = F.lit(got.agg(F.sum("tokens")).first()[0]).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))).join(got, "source", "left").select("source", "target_share", zero("documents"), zero("tokens"), (F.coalesce("tokens", F.lit(0)) / whole).alias("share"), zero("most_copies"))
