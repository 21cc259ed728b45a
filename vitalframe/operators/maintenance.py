"""Changes of tables as plans: each gives the table as it is afterwards. Rows are kept or left by joins on keys, so a
change of any size is spread over tasks; what is written, and where, is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def appended(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows of new whose keys (null equals null) it has not; of new's repeated keys the first by all
    columns counts: the first writer wins."""
    rest = [c for c in target.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.select(*keys).distinct()
    a, b = once.alias("a"), target.select(*keys).distinct().alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return target.unionByName(a.join(b, same, "left_anti").select(*target.columns))


def upserted(target: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the newest by order, new's before target's at a tie: the last writer wins."""
    rest = [c for c in target.columns if c not in keys]
    both = target.withColumn("_n", F.lit(0)).unionByName(new.select(*target.columns).withColumn("_n", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_n", *[c for c in rest if c != order])).alias("_r")).select(*keys, "_r.*").select(*target.columns)


def corrected(target: DataFrame, corrections: DataFrame, key: str, columns: list[str], at: str) -> DataFrame:
    """target with the corrections' values (key, columns, at), the newest of each key, and when they were made."""
    new = corrections.groupBy(key).agg(F.max_by(F.struct(*columns, at), F.col(at)).alias("_c"))
    j = target.join(new, key, "left")
    return j.select(*[F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) if c in (*columns, at) else F.col(c) for c in target.columns])


def stamped(rows: DataFrame, group: str, day: str) -> DataFrame:
    """rows with the missing days of a group filled with the earliest day the group has."""
    first = rows.where(F.col(day).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.min(day).alias("_first"))
    j = rows.join(first, F.col(group) == F.col("_g"), "left")
    return j.select(*[F.coalesce(day, "_first").alias(day) if c == day else F.col(c) for c in rows.columns])


def without(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without what belongs to the ids (one column): a cascade. tables: name -> (table, column that names
    what it belongs to). Rows that belong to nothing stay."""
    gone = ids.select(F.col(ids.columns[0]).cast("string").alias("_gone")).distinct()
    return {name: df.join(gone, F.col(column).cast("string") == F.col("_gone"), "left_anti") for name, (df, column) in tables.items()}


def without_category(table: DataFrame, column: str, category: str) -> tuple[DataFrame, DataFrame]:
    """(the table without a category, how many rows that took)."""
    hit = F.coalesce(F.col(column) == category, F.lit(False))
    return table.where(~hit), table.agg(F.count_if(hit).alias("removed"))


def unexpired(table: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows that never expire or do so after as_of."""
    return table.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def newest_valid(cache: DataFrame, key: str, expires: str, created: str, as_of: Column) -> DataFrame:
    """One row a key: the newest of those still valid."""
    return unexpired(cache, expires, as_of).groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), F.col(created)).alias("_r")).select(key, "_r.*")


def fresh(table: DataFrame, created: str, confirmed: str, days: int, as_of: Column) -> DataFrame:
    """Rows that are confirmed, or younger than ``days``."""
    return table.where(F.coalesce(F.col(confirmed), F.lit(False)) | (F.datediff(as_of, F.col(created)) <= days))


def page_of(rows: DataFrame, key: str, order: list[Column], size: int, page: int) -> DataFrame:
    """The page, counted from 0, of each key's rows in the order given."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_r", r).where((F.col("_r") > page * size) & (F.col("_r") <= (page + 1) * size)).drop("_r")


def changed(table: DataFrame, since: Column, *stamps: str) -> DataFrame:
    """Rows made or corrected after a watermark."""
    hit = F.lit(False)
    for s in stamps:
        hit = hit | F.coalesce(F.col(s) > since, F.lit(False))
    return table.where(hit)


def watermark(table: DataFrame, *stamps: str) -> DataFrame:
    """One row: the newest stamp and the rows, to be compared with those of the last run."""
    return table.agg(F.greatest(*[F.max(s) for s in stamps]).alias("watermark"), F.count("*").alias("rows"))


def synced(target: DataFrame, source: DataFrame, keys: list[str], order: str, whole: bool) -> DataFrame:
    """target brought up to source: upserts, and, where source is whole, without the rows that it no longer has."""
    out = upserted(target, source, keys, order)
    return out.join(source.select(*keys).distinct(), keys, "left_semi") if whole else out


def unseen_alerts(alerts: DataFrame, log: DataFrame, key: str, at: str, hours: int = 24) -> DataFrame:
    """Alerts, each key once (the earliest), that the log has not told within the hours before."""
    first = alerts.groupBy(key).agg(F.min_by(F.struct(*[c for c in alerts.columns if c != key]), F.col(at)).alias("_r")).select(key, "_r.*")
    told = log.select(F.col(key).alias("_k"), F.col(at).alias("_at"))
    near = (F.col(key) == F.col("_k")) & (F.col("_at") <= F.col(at)) & (F.col("_at") > F.col(at) - F.expr(f"INTERVAL {hours} HOURS"))
    return first.join(told, near, "left_anti")


def revalued(hypotheses: DataFrame, states: DataFrame) -> DataFrame:
    """hypotheses (id, user_id, canonical_name, direction, confidence, status) after new states (user_id,
    canonical_name, state): 0.10 more where the state is as expected, 0.15 less where it is normal, within 0 and 0.95;
    ruled out below 0.10. Others stay."""
    j = hypotheses.join(states, ["user_id", "canonical_name"], "left")
    moved = F.when(F.col("state") == F.col("direction"), F.col("confidence") + 0.10).when(F.col("state") == "normal", F.col("confidence") - 0.15).otherwise(F.col("confidence"))
    c = F.round(F.greatest(F.least(moved, F.lit(0.95)), F.lit(0.0)), 6)
    return j.withColumn("confidence", c).withColumn("status", F.when(F.col("confidence") < 0.10, "ruled_out").otherwise(F.col("status"))).select(*hypotheses.columns)


def merged_evidence(old: DataFrame, new: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """old with new's lists united in order and 0.7 of its confidence with 0.3 of new's; unmatched rows stay."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in [*lists, "confidence"]])
    j = old.join(n, key, "left")
    united = [F.array_distinct(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"_{c}", F.array().cast("array<string>")))).alias(c) for c in lists]
    weight = F.when(F.col("_confidence").isNotNull(), F.round(F.col("confidence") * 0.7 + F.col("_confidence") * 0.3, 6)).otherwise(F.col("confidence")).alias("confidence")
    return j.select(*[c for c in old.columns if c not in (*lists, "confidence")], *united, weight)
