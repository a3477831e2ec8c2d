"""Operators whose outcome for a row depends on what happened to the rows before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.gates import direction, next_weights
from tessera.operators.evidence import checkpoint_dir


def admissions(rows: DataFrame, most: int, edges: int) -> DataFrame:
    """rows with novel (items of a row that no row admitted before it has) and verdict.

    rows: (grp, key, by, source, items, room); by orders a group's rows, no two alike. A row whose
    source (null: none) was admitted is "known-source"; without a novel item it is "nothing-novel";
    one that `most` rows, or `edges` or its `room` items, leave no room for is "capacity", which
    stops nothing; else it is "accepted" and makes its source and items known.

    A group has at most `most` admitted rows, so there are as many rounds: each takes every group's
    first row that can still be admitted, which is a join with the few rows taken so far and a
    grouped minimum. No group meets in one task. Each verdict then follows from the rows taken
    before it. rows are read in each round and should be checkpointed; what was taken is.
    """
    taken = None
    novel = lambda df: F.filter("items", lambda x: ~F.array_contains(df, x))
    gone = F.flatten(F.transform("taken", lambda t: t["novel"]))
    for round_ in range(min(most, edges)):
        if taken is None:
            open_ = rows.withColumn("novel", F.col("items")).withColumn("used", F.lit(0))
        else:
            open_ = rows.join(taken, "grp").filter((F.col("by") > F.element_at("taken", -1)["by"]) & ~F.coalesce(F.exists("taken", lambda t: t["source"] == F.col("source")), F.lit(False)))
            open_ = open_.withColumn("used", F.size(gone)).withColumn("novel", novel(gone))
        fits = open_.filter((F.size("novel") > 0) & (F.col("used") + F.size("novel") <= F.least(F.lit(edges), "room")))
        best = fits.groupBy("grp").agg(F.min_by(F.struct("by", "source", "novel"), "by").alias("next"))
        taken = best.select("grp", F.array("next").alias("taken")) if taken is None else taken.join(best, "grp", "left").select("grp", F.when(F.col("next").isNull(), F.col("taken")).otherwise(F.array_append("taken", F.col("next"))).alias("taken"))
        if round_ % 3 == 2:
            taken = taken.checkpoint()
    taken = taken.checkpoint()  # a row for each group
    judged = rows.join(taken, "grp", "left").withColumn("before", F.filter("taken", lambda t: t["by"] < F.col("by")))
    have = F.coalesce(F.flatten(F.transform("before", lambda t: t["novel"])), F.expr("cast(array() as array<string>)"))
    judged = judged.withColumn("have", have).withColumn("novel", novel(F.col("have")))
    own = F.coalesce(F.exists("taken", lambda t: t["by"] == F.col("by")), F.lit(False))
    seen = F.coalesce(F.exists("before", lambda t: t["source"] == F.col("source")), F.lit(False))
    verdict = F.when(own, "accepted").when(seen, "known-source").when(F.size("novel") == 0, "nothing-novel").otherwise("capacity")
    return judged.withColumn("verdict", verdict).drop("taken", "before", "have")


def greedy_admission(rows: DataFrame, group: str, key: str, edge: str, order: list[str], most: int = 4, edges: int = 6) -> DataFrame:
    """(group, key, verdict) of candidates taken in order, under caps on signals and edges.

    A candidate is a key with the rows of its edges; it stands where its first row does. One without
    an edge that is new to the group is "no-novel-edge"; one beyond the caps "capacity", which does
    not stop the scan; an accepted one makes its novel edges known.
    """
    checkpoint_dir(rows.sparkSession)
    by = F.min(F.struct(*dict.fromkeys([*order, key]))).alias("by")
    own = rows.groupBy(F.col(group).alias("grp"), F.col(key).alias("key")).agg(by, F.array_sort(F.collect_set(F.col(edge).cast("string"))).alias("items"))
    own = own.select("grp", "key", "by", F.lit(None).cast("string").alias("source"), "items", F.lit(edges).alias("room")).checkpoint()
    verdict = F.when(F.col("verdict") == "nothing-novel", "no-novel-edge").otherwise(F.col("verdict"))
    return admissions(own, most, edges).select(F.col("grp").alias(group), F.col("key").alias(key), verdict.alias("verdict"))


def weight_replay(outcomes: DataFrame, group: str, order: str, verdict: str, quality: str, scores: str, start: list[float]) -> DataFrame:
    """(group, n, weights): the weights after all of a group's outcomes in order.

    A fold over the group's ordered array, inside the JVM.
    """
    event = F.struct(F.col(order).alias("o"), F.col(verdict).alias("v"), F.col(quality).alias("q"), F.col(scores).cast("array<double>").alias("s"))
    rows = outcomes.groupBy(group).agg(F.array_sort(F.collect_list(event)).alias("events_"))
    begin = F.array(*(F.lit(float(w)) for w in start))
    folded = F.aggregate("events_", begin, lambda w, e: next_weights(w, e["s"], direction(e["v"], e["q"])))
    return rows.select(group, F.size("events_").cast("long").alias("n"), folded.alias("weights"))
