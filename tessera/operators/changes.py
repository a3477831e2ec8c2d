"""Merges as functions of an old and a new frame, and differences between two states.

Parquet has no MERGE: each function gives the new state, which the caller writes as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("turn_", F.lit(0)).unionByName(new.withColumn("turn_", F.lit(1)))


def grade_merge(old: DataFrame, new: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """By key the new row, unless its grade is lower than the old one's."""
    w = Window.partitionBy(*keys).orderBy(F.desc("rank_"), F.desc("turn_"))
    return _both(old, new).withColumn("rank_", rank).withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("turn_", "rank_", "k_")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("turn_"))
    return _both(old, new).withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("turn_", "k_")


def first_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("turn_")
    return _both(old, new).withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("turn_", "k_")


def insert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(inserted, existing): what first_wins would do with the new rows."""
    had = old.select(*keys).distinct().withColumn("had_", F.lit(True))
    return new.select(*keys).distinct().join(had, keys, "left").agg(F.count_if(F.col("had_").isNull()).alias("inserted"), F.count_if(F.col("had_").isNotNull()).alias("existing"))


def coalesce_upsert(old: DataFrame, new: DataFrame, keys: list[str], blank: bool = True) -> DataFrame:
    """By key and column the new value, or the old one where the new is null (or, with blank, an empty string)."""
    names = [c for c in old.columns if c not in keys]
    kinds = dict(old.dtypes)
    value = lambda c: F.nullif(F.col(c), F.lit("")) if blank and kinds[c] == "string" else F.col(c)
    return _both(old, new).groupBy(*keys).agg(*(F.max_by(value(c), F.when(value(c).isNotNull(), F.col("turn_"))).alias(c) for c in names))


def longest_text(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, text, seen_count, last_seen): the longest text, of equal ones the earliest."""
    return rows.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), -F.col(order))).alias("kept"), F.count("*").alias("seen_count"), F.max(order).alias("last_seen"))


def union_last(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Concatenation in which later frames win by key."""
    tagged = [f.withColumn("turn_", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy(*keys).orderBy(F.desc("turn_"))
    return out.withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("turn_", "k_")


def unpivoted(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, field, value): a row for each field, values as strings."""
    cells = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names))
    return rows.select(*keys, F.explode(cells).alias("cell_")).select(*keys, "cell_.field", "cell_.value")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, field, kind, before, after): changed fields; an added or removed row is one line with field '*'."""
    old = before.select(*keys, F.struct(*(F.col(n).cast("string").alias(n) for n in names)).alias("o"))
    new = after.select(*keys, F.struct(*(F.col(n).cast("string").alias(n) for n in names)).alias("n"))
    both = old.join(new, keys, "full_outer")
    cells = F.filter(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").alias("before"), F.col(f"n.{c}").alias("after")) for c in names)), lambda x: ~x["before"].eqNullSafe(x["after"]))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit("*").alias("field"), none.alias("before"), none.alias("after")))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return both.select(*keys, kind.alias("kind"), F.explode(F.when(kind == "changed", cells).otherwise(whole)).alias("c")).select(*keys, "kind", "c.field", "c.before", "c.after")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int")


def bucket_sums(rows: DataFrame, keys: list[str], names: list[str], buckets: int) -> DataFrame:
    """(bucket, n, sum): how many rows a bucket of keys holds, and a sum over hashes of their fields in any order."""
    whole = F.xxhash64(F.to_json(F.struct(*keys, *(F.col(n).cast("string").alias(n) for n in names))))
    return rows.groupBy(bucket_of(keys, buckets).alias("bucket")).agg(F.count("*").alias("n"), F.sum(whole.cast("decimal(38,0)")).alias("sum"))


def changed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket): the buckets of which two bucket_sums() say different things; equal sums of unequal rows are as likely as equal 64-bit hashes."""
    same = F.col("o.n").eqNullSafe(F.col("p.n")) & F.col("o.sum").eqNullSafe(F.col("p.sum"))
    return before.alias("o").join(after.alias("p"), "bucket", "full_outer").filter(~same).select("bucket")


def keep_snapshot(rows: DataFrame, path: str, keys: list[str], names: list[str], buckets: int = 4096) -> None:
    """A snapshot by buckets of its keys (a folder for each), and beside it what bucket_sums() says of them."""
    rows.withColumn("bucket_", bucket_of(keys, buckets)).repartition("bucket_").sortWithinPartitions("bucket_").write.partitionBy("bucket_").parquet(f"{path}/rows")
    bucket_sums(rows, keys, names, buckets).coalesce(1).write.parquet(f"{path}/sums")


def kept_rows(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The rows of a kept snapshot, of some buckets alone if they are named: no other folder is read."""
    rows = spark.read.parquet(f"{path}/rows")
    return (rows if only is None else rows.filter(F.col("bucket_").isin(only))).drop("bucket_")


def kept_diff(spark: SparkSession, before: str, after: str, keys: list[str], names: list[str]) -> DataFrame:
    """snapshot_diff() of two kept snapshots with as many buckets each, reading those buckets alone that differ.

    The numbers of these buckets reach the driver: at most as many as there are buckets.
    """
    sums = [spark.read.parquet(f"{p}/sums") for p in (before, after)]
    differ = [r["bucket"] for r in changed_buckets(*sums).collect()]
    return snapshot_diff(kept_rows(spark, before, differ), kept_rows(spark, after, differ), keys, names)


def pruned(before: DataFrame, after: DataFrame, keys: list[str], names: list[str], buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The rows of two tables in buckets of keys whose sums differ: what a diff by these keys, or by more of them, needs.

    Rows that agree stay out of the diff's join, and so out of its shuffle.
    """
    differ = changed_buckets(bucket_sums(before, keys, names, buckets), bucket_sums(after, keys, names, buckets)).select(F.col("bucket").alias("bucket_"))
    own = lambda df: df.withColumn("bucket_", bucket_of(keys, buckets)).join(F.broadcast(differ), "bucket_", "left_semi").drop("bucket_")  # noqa: E731  `buckets` numbers at most
    return own(before), own(after)


def profile_diff(before: DataFrame, after: DataFrame, rank: Column) -> DataFrame:
    """(company, field, change) of facts (company, field, value, grade).

    new_company and dropped_company come as one line; otherwise filled, emptied, changed, and
    upgraded or downgraded where only the grade moved.
    """
    old = before.withColumn("r", rank).select("company", "field", F.col("value").alias("v0"), F.col("r").alias("r0"))
    new = after.withColumn("r", rank).select("company", "field", F.col("value").alias("v1"), F.col("r").alias("r1"))
    was, now = old.select("company").distinct().withColumn("was", F.lit(True)), new.select("company").distinct().withColumn("now", F.lit(True))
    both = was.join(now, "company", "full_outer")
    lines = both.filter("was is null or now is null").select("company", F.lit("*").alias("field"), F.when(F.col("was").isNull(), "new_company").otherwise("dropped_company").alias("change"))
    stay = both.filter("was and now").select("company")
    cells = old.join(new, ["company", "field"], "full_outer").join(stay, "company", "left_semi")
    change = F.when(F.col("r0").isNull(), "filled").when(F.col("r1").isNull(), "emptied").when(~F.col("v0").eqNullSafe(F.col("v1")), "changed").when(F.col("r1") > F.col("r0"), "upgraded").when(F.col("r1") < F.col("r0"), "downgraded")
    return lines.union(cells.withColumn("change", change).filter("change is not null").select("company", "field", "change"))


def missing_sources(cells: DataFrame, sourced: DataFrame, keys: list[str]) -> DataFrame:
    """The non-blank cells (keys, value) without a source: sourced has the keys that have one."""
    return cells.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(sourced.select(*keys).distinct(), keys, "left_anti")


def assert_sourced(cells: DataFrame, sourced: DataFrame, keys: list[str]) -> None:
    """Raises, naming one of them, if a cell has no source."""
    bad = missing_sources(cells, sourced, keys).limit(1).collect()
    if bad:
        raise ValueError(f"no source for {bad[0].asDict()}")
