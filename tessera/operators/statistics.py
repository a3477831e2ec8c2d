"""Cross-tabs with baselines and lift, findings, coverage, holders and weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crosstab(rows: DataFrame, row: str, col: str) -> DataFrame:
    """(row_label, col_label, n, row_n, col_n, total) over rows that have both labels."""
    own = rows.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = own.groupBy(F.col(row).alias("row_label"), F.col(col).alias("col_label")).agg(F.count("*").alias("n"))
    rows_n, cols_n = Window.partitionBy("row_label"), Window.partitionBy("col_label")
    # the last window is over one row for each pair of labels
    return cells.withColumns({"row_n": F.sum("n").over(rows_n), "col_n": F.sum("n").over(cols_n), "total": F.sum("n").over(Window.partitionBy(F.lit(0)))})


def spread(rows: DataFrame, group: str, target: Column, least_group: int = 5, least_groups: int = 3, least: float = 0.40) -> DataFrame:
    """One row or none: the groups with the highest and the lowest share of target, if they lie `least` apart."""
    shares = rows.filter(F.col(group).isNotNull() & target.isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.count_if(target).alias("hits")).filter(F.col("n") >= least_group).withColumn("share", F.col("hits") / F.col("n"))
    best, worst = F.struct(-F.col("share"), -F.col("n"), F.col("g")), F.struct(F.col("share"), F.col("n"), F.col("g"))
    out = shares.agg(F.count("*").alias("groups"), F.min_by("g", best).alias("high_group"), F.max("share").alias("high"), F.min_by("g", worst).alias("low_group"), F.min("share").alias("low"))
    out = out.withColumn("spread", F.round(F.col("high") - F.col("low"), 6)).filter((F.col("groups") >= least_groups) & (F.col("spread") >= least))
    return out.select("groups", "high_group", F.round("high", 6).alias("high"), "low_group", F.round("low", 6).alias("low"), "spread")


def sweep(rows: DataFrame, axes: list[str], least_group: int = 8, least_groups: int = 3, least_column: int = 8, lift: float = 0.35, least: float = 0.45, seen: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """All ordered pairs of axes: the column with the largest spread of shares over row groups.

    (row_axis, col_axis, col_label, groups, baseline, high, low, lift, spread), the largest spread
    first. A pair that is emitted suppresses its transpose; pairs come in the order of axes, those
    of `seen` not at all. rows are read once: each gives its labels for all pairs.
    """
    pairs = [(i, j) for i in range(len(axes)) for j in range(len(axes)) if i != j and (axes[i], axes[j]) not in seen]
    labels = [F.col(a).cast("string") for a in axes]
    cells = F.array(*(F.struct(F.lit(i * len(axes) + j).alias("at"), labels[i].alias("r"), labels[j].alias("c")) for i, j in pairs))
    n = rows.select(F.explode(cells).alias("x")).select("x.*").filter("r is not null and c is not null").groupBy("at", "r", "c").agg(F.count("*").alias("n"))
    kept = n.withColumn("rn", F.sum("n").over(Window.partitionBy("at", "r"))).filter(F.col("rn") >= least_group)
    total = kept.groupBy("at", "r").agg(F.first("rn").alias("rn")).groupBy("at").agg(F.count("*").alias("groups"), F.sum("rn").alias("total"))
    share = F.col("n") / F.col("rn")
    full = kept.groupBy("at", "c").agg(F.sum("n").alias("cn"), F.max(share).alias("high"), F.min(share).alias("low_"), F.count("*").alias("k")).join(total, "at")
    full = full.withColumn("low", F.when(F.col("k") < F.col("groups"), 0.0).otherwise(F.col("low_"))).withColumn("baseline", F.col("cn") / F.col("total")).withColumn("spread", F.col("high") - F.col("low"))
    full = full.filter((F.col("groups") >= least_groups) & (F.col("cn") >= least_column) & (F.col("high") - F.col("baseline") >= lift) & (F.col("spread") >= least))
    best = full.groupBy("at").agg(F.min_by(F.struct("c", "groups", "baseline", "high", "low", "spread"), F.struct(-F.col("spread"), F.col("c"))).alias("b"))
    # a pair stands unless its transpose came before it; of two transposes the earlier one does
    i, j = F.floor(F.col("at") / len(axes)).cast("int"), (F.col("at") % len(axes)).cast("int")
    first = Window.partitionBy(F.least(i, j), F.greatest(i, j)).orderBy("at")
    name = F.array(*map(F.lit, axes))
    out = best.withColumn("k_", F.row_number().over(first)).filter("k_ = 1").select(F.get(name, i).alias("row_axis"), F.get(name, j).alias("col_axis"), "b.*")
    r6 = lambda c: F.round(c, 6)
    out = out.select("row_axis", "col_axis", F.col("c").alias("col_label"), "groups", r6("baseline").alias("baseline"), r6("high").alias("high"), r6("low").alias("low"), r6(F.col("high") - F.col("baseline")).alias("lift"), r6("spread").alias("spread"))
    return out.orderBy(F.desc("spread"), "row_axis", "col_axis")


def concentration(rows: DataFrame, value: str, least: float = 0.5, sample: int = 8) -> DataFrame:
    """The commonest value's share among non-blank ones, if it reaches `least` of at least `sample`."""
    n = rows.filter(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(F.col(value).alias("top_value")).agg(F.count("*").alias("n"))
    top = n.agg(F.min_by("top_value", F.struct(-F.col("n"), F.col("top_value"))).alias("top_value"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.withColumn("share", F.round(F.col("n") / F.col("total"), 6)).filter((F.col("total") >= sample) & (F.col("share") >= least))


def visibility_gap(rows: DataFrame, listed: Column, filled: str, ratio: float = 1.5, sample: int = 3) -> DataFrame:
    out = rows.agg(F.avg(F.when(listed, F.col(filled))).alias("listed_mean"), F.avg(F.when(~listed, F.col(filled))).alias("private_mean"), F.count_if(listed).alias("n_listed"), F.count_if(~listed).alias("n_private"))
    out = out.withColumn("ratio", F.round(F.col("listed_mean") / F.col("private_mean"), 6)).filter((F.col("n_listed") >= sample) & (F.col("n_private") >= sample) & (F.col("ratio") >= ratio))
    return out.select(F.round("listed_mean", 6).alias("listed_mean"), F.round("private_mean", 6).alias("private_mean"), "n_listed", "n_private", "ratio")


def outliers(rows: DataFrame, key: str, filled: str, times: float = 3.0, least: int = 6, top: int = 5) -> DataFrame:
    mean = rows.agg(F.avg(filled).alias("mean_"))
    out = rows.join(F.broadcast(mean), F.lit(True)).filter((F.col(filled) >= times * F.col("mean_")) & (F.col(filled) >= least))  # one row of totals
    return out.select(key, filled, F.round(F.col(filled) / F.col("mean_"), 6).alias("times")).orderBy(F.desc(filled), key).limit(top)


def coverage(facts: DataFrame, spec: DataFrame, company: str) -> DataFrame:
    """(company, filled, with_unverified, total, coverage): facts are (company, field, grade); spec has the fields."""
    total = spec.select(F.count_distinct("field").alias("total"))
    own = facts.join(F.broadcast(spec.select("field").distinct()), "field")
    n = own.groupBy(company).agg(F.countDistinct(F.when(F.col("grade") != "unverified", F.col("field"))).alias("filled"), F.countDistinct("field").alias("with_unverified"))
    return n.join(F.broadcast(total), F.lit(True)).withColumn("coverage", F.round(F.col("filled") / F.col("total"), 6))  # one row of totals


def coverage_matrix(facts: DataFrame) -> DataFrame:
    """Facts by dimension and field with subtotals: (dimension, field, n, verified); null stands for all."""
    return facts.rollup("dimension", "field").agg(F.count("*").alias("n"), F.count_if(F.col("grade") != "unverified").alias("verified"))


def latest_period(rows: DataFrame, key: str, period: str, rank: str, top: int = 10) -> DataFrame:
    """The rows of each key's latest period, by rank (missing ranks last), at most `top`."""
    now = rows.withColumn("last_", F.max(period).over(Window.partitionBy(key))).filter(F.col(period) == F.col("last_"))
    return now.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(rank).asc_nulls_last()))).filter(F.col("place") <= top).drop("last_")


def all_or_null_sum(value: Column, digits: int = 4) -> Column:
    """The sum if no value is missing, else null."""
    return F.when(F.count(value) == F.count("*"), F.round(F.sum(value), digits))


def holder_concentration(rows: DataFrame, key: str, rank: str, ratio: str, top: int = 10, digits: int = 4) -> DataFrame:
    """(key, n, top1, top_sum): the first holder's ratio and the sum of the first `top`; keys of which one of these is missing are left out.

    rows: those of a key's latest period.
    """
    w = Window.partitionBy(key).orderBy(F.col(rank).asc_nulls_last())
    first = rows.withColumn("k_", F.row_number().over(w))
    near = F.col("k_") <= top
    out = first.groupBy(key).agg(F.count("*").alias("n"), F.max(F.when(F.col("k_") == 1, F.col(ratio))).alias("top1"), F.count_if(near & F.col(ratio).isNull()).alias("gaps_"), F.round(F.sum(F.when(near, F.col(ratio))), digits).alias("top_sum"))
    return out.filter("gaps_ = 0 and top1 is not null").drop("gaps_")


def pivot_table(rows: DataFrame, row: str, col: str, columns: list[str]) -> DataFrame:
    """(row, total, and a count for each of the columns): rows with both labels, the largest first; name the columns in the order of their totals."""
    own = rows.filter(F.trim(F.coalesce(row, F.lit(""))) != "").filter(F.trim(F.coalesce(col, F.lit(""))) != "")
    counts = [F.count_if(F.col(col) == c).alias(c) for c in columns]
    return own.groupBy(row).agg(F.count("*").alias("total"), *counts).orderBy(F.desc("total"), row)


def column_order(rows: DataFrame, col: str) -> list[str]:
    """The labels of a column, the commonest first: a table's headings, few by nature."""
    return [r[0] for r in rows.filter(F.trim(F.coalesce(col, F.lit(""))) != "").groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).collect()]


def week_counts(rows: DataFrame, key: str, ts: str, hours: int = 8) -> DataFrame:
    from tessera.functions.dates import monday_of

    return rows.filter(F.col(ts).isNotNull()).groupBy(key, monday_of(F.col(ts), hours).alias("week")).agg(F.count("*").alias("n"))


def week_streak(counts: DataFrame, key: str, least: int = 3, wanted: int = 4) -> DataFrame:
    """(key, longest, accepted_at): runs of Mondays with at least `least`; the first week that completes `wanted`."""
    good = counts.filter(F.col("n") >= least).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("week")))
    runs = good.withColumn("island", F.expr("date_sub(week, cast(7 * k as int))"))
    runs = runs.withColumn("run", F.row_number().over(Window.partitionBy(key, "island").orderBy("week")))
    found = runs.groupBy(key).agg(F.max("run").alias("longest"), F.min(F.when(F.col("run") == wanted, F.col("week"))).alias("accepted_at"))
    return counts.select(key).distinct().join(found, key, "left").na.fill(0, ["longest"])


def gap_round_robin(gaps: DataFrame, company: str, company_rank: str, field_rank: str, each: int = 4, limit: int = 200) -> DataFrame:
    """The gaps in rounds: the first of every company in rank order, then the second, ..."""
    own = gaps.withColumn("round", F.row_number().over(Window.partitionBy(company).orderBy(field_rank))).filter(F.col("round") <= each)
    return own.orderBy("round", company_rank, company).limit(limit)
