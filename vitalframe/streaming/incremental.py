"""Incremental forms: streams of new files with watermarks, deduplication and upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def daily_totals(events: DataFrame, at: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """Tumbling days of a stream or a table: (key, day, n, total). What comes later than the watermark is what late_rows
    gives of each batch."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, "1 day").alias("_w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.to_date("_w.start").alias("day"), "n", "total")


def first_deliveries(events: DataFrame, at: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once within the watermark, so that the state stays bounded."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def dedup_key(*parts: str) -> Column:
    """First 16 hex digits of the hash of the parts: the name of an alert."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def late_rows(batch: DataFrame, at: str, newest_seen: Column, late: str = "2 days") -> DataFrame:
    """The rows of a micro-batch that lie further than ``late`` behind the newest time seen before it: those that the
    watermark drops, to be written beside."""
    return batch.where(F.col(at) < newest_seen - F.expr(f"INTERVAL {late}"))


def upsert_batches(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, buckets: int = 16):  # noqa: ANN201
    """Runs a stream to its end, keeping the newest row (by order) of each key. The target is cut by a hash of the keys
    into buckets, and a micro-batch writes only those it has rows of, each under ``bucket=b/version=n``; a batch run
    again after a failure writes the same rows to the same place, and versions older than the last but one are
    removed. Read it with read_upserted."""
    spark = stream.sparkSession
    fs, base = _filesystem(spark, target)

    def apply(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets``
        newest = {b: [v for v in _versions(spark, fs, base, b) if v < n] for b in touched}
        had = [f"{target}/bucket={b}/version={max(v)}" for b, v in newest.items() if v]
        old = spark.read.schema(batch.schema).parquet(*had) if had else batch.limit(0)
        best = old.unionByName(batch).groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        best = best.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("version", F.lit(n))
        best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        for b, v in newest.items():
            for gone in sorted(v)[:-1]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket={b}/version={gone}"), True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _filesystem(spark: SparkSession, folder: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, fs, base, bucket: int) -> list[int]:  # noqa: ANN001
    path = spark._jvm.org.apache.hadoop.fs.Path(base, f"bucket={bucket}")
    return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")] if fs.exists(path) else []


def read_upserted(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of each bucket of an upserted target."""
    fs, base = _filesystem(spark, target)
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(base) if s.getPath().getName().startswith("bucket=")]
    return spark.read.parquet(*[f"{target}/bucket={b}/version={max(_versions(spark, fs, base, b))}" for b in sorted(found)])
