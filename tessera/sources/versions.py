"""Tables whose rows are replaced by key, each replacement at once: readers see all of it or nothing.

A table is a folder of replacements. Each wrote its rows and the keys that it replaces to a folder of
its own, and then an empty file whose name gives its number and that folder. Until that file is there
nothing has changed, so a writer that dies leaves the table as it was; a reader lists the files once
and takes each key's rows from the last replacement that names it. A key that is replaced by no rows
has none. Nothing is overwritten, so readers at work go on with what they began with.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"(\d{12})-([0-9a-f]{32})(-whole)?$")


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *parts)))


def replacements(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the replacements that count, oldest first: from the last one that holds the whole table on."""
    fs, at = _files(spark, path)
    if not fs.exists(at("log")):
        return []
    found = sorted(m.groups() for m in (_NAME.match(f.getPath().getName()) for f in fs.listStatus(at("log"))) if m)
    first = max((k for k, f in enumerate(found) if f[2]), default=0)
    return [(int(n), folder) for n, folder, _ in found[first:]]


def replace(rows: DataFrame, keys: DataFrame, path: str, key: str, whole: bool = False) -> None:
    """Replaces the rows of `keys` (a table with the column `key`) by `rows`; a row of another key fails the write.

    Two replacements at once both count, in the order of their numbers and folders. whole: rows are
    all that the table then holds.
    """
    spark = rows.sparkSession
    fs, at = _files(spark, path)
    folder = uuid.uuid4().hex
    own = keys.select(key).distinct()
    named = rows.join(own.withColumn("named_", F.lit(True)), key, "left").filter(F.assert_true("named_", F.lit(f"a row of another {key}")).isNull())
    named.select(*rows.columns).write.parquet(str(at("data", folder, "rows")))
    own.write.parquet(str(at("data", folder, "keys")))
    number = max((n for n, _ in replacements(spark, path)), default=0) + 1
    fs.mkdirs(at("log"))
    fs.create(at("log", f"{number:012d}-{folder}{'-whole' if whole else ''}"), False).close()


def current(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The table as it stands; None before the first replacement."""
    _, at = _files(spark, path)
    found = replacements(spark, path)
    if not found:
        return None
    part = lambda place, folder, what: spark.read.parquet(str(at("data", folder, what))).withColumn("place_", F.lit(place))
    rows, keys = None, None
    for place, (_, folder) in enumerate(found):
        r, k = part(place, folder, "rows"), part(place, folder, "keys")
        rows = r if rows is None else rows.unionByName(r, allowMissingColumns=True)
        keys = k if keys is None else keys.union(k)
    if len(found) == 1:
        return rows.drop("place_")
    last = keys.groupBy(F.col(key).alias("key_")).agg(F.max("place_").alias("last_"))
    held = rows.join(last, F.col(key).eqNullSafe(F.col("key_")) & (F.col("place_") == F.col("last_")), "left_semi")
    return held.drop("place_")


def compact(spark: SparkSession, path: str, key: str) -> None:
    """Writes the table as one replacement, after which earlier ones are not read any more. Not beside other writers."""
    rows = current(spark, path, key)
    if rows is not None:
        replace(rows, rows.select(key), path, key, whole=True)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the folders of replacements that do not count (any more), such as those of dead writers; how many. Not beside readers or writers."""
    fs, at = _files(spark, path)
    keep = {folder for _, folder in replacements(spark, path)}
    gone = [f.getPath() for f in fs.listStatus(at("data")) if f.getPath().getName() not in keep] if fs.exists(at("data")) else []
    logs = [f.getPath() for f in fs.listStatus(at("log")) if (m := _NAME.match(f.getPath().getName())) and m[2] not in keep] if fs.exists(at("log")) else []
    for p in logs + gone:
        fs.delete(p, True)
    return len(gone)
