"""Incremental ingest: a file stream of events, deduplicated by key, windowed by week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.research import MAX_AGE_DAYS, max_age


def stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_by_key(events: DataFrame, key: str, ts: str, late: str = "14 days") -> DataFrame:
    """Each key once: replays of an item within the watermark insert nothing."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def first_within_limits(events: DataFrame, key: str, ts: str, relation: str) -> DataFrame:
    """Each key once, as long as its relation allows: 730, 548 or 365 days behind the newest event, 365 for any other.

    State is kept by Spark's watermark. One watermark serves all relations, since an event's clock is
    put back by what its relation has less than the longest limit; events beyond their limit are
    late and left out, state goes when no event can be on time any more. A restart goes on with
    the state of its checkpoint, so a replayed event inserts nothing then either.
    """
    longest = max(MAX_AGE_DAYS.values())
    clock = F.col(ts).cast("timestamp") - F.make_dt_interval(F.lit(longest) - max_age(F.col(relation)))
    return events.withColumn("clock_", clock).withWatermark("clock_", f"{longest} days").dropDuplicatesWithinWatermark([key]).drop("clock_")


def weekly(events: DataFrame, ts: str, kind: str, late: str = "14 days") -> DataFrame:
    """Counts by Monday week (UTC+8) and kind; a week is emitted when the watermark has passed it."""
    weeks = F.window(F.col(ts), "7 days", "7 days", "3 days 16 hours")  # the epoch was a Thursday
    return events.withWatermark(ts, late).groupBy(weeks.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week_start"), kind, "n")


def upsert_into(path: str, keys: list[str], by: str | None = None, order: str | None = None):
    """A foreachBatch sink: rows whose keys the Parquet table at path has already are left out, so a replayed batch inserts nothing.

    order: a column by which the first of a batch's rows of equal keys is taken; without it, any one is.
    by: a column that keys determine, such as a week. The table is then partitioned by it, and only
    the partitions that a batch touches are read (their values, a few for each batch, are collected).
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if order:
            rest = [c for c in batch.columns if c not in keys]
            new = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("first_")).select(*keys, "first_.*").select(*batch.columns)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            old = spark.read.schema(batch.schema).parquet(path)
            if by:
                old = old.filter(F.col(by).isin([r[0] for r in new.select(by).distinct().collect()]))
            new = new.join(old.select(*keys), keys, "left_anti")
        out = new.write.mode("append")
        (out.partitionBy(by) if by else out).parquet(path)

    return put
