"""Findings about a set of profiles: blind spots, progress, stalled patterns, origins, and how far each may be trusted.

Labels come as rows (company, axis, label, grade), facts as rows (company, dimension, field, value, grade).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages that are early or late, and what counts as billing by project.
EARLY = "无公开融资|种子|天使|Pre-A|^A 轮$"
LATE = "B 轮|C 轮|挂牌|准上市|战略|产业投资"
PROJECT_BILLING = "项目制"
GRADES = ("independent", "related", "self", "statutory", "unverified")


def confidence(grades: Column) -> Column:
    """By the softest of an array of grades: public, internal for what is self-told, lead for what is not verified or not there."""
    return F.when((F.size(grades) == 0) | F.array_contains(grades, "unverified"), "lead").when(F.array_contains(grades, "self"), "internal").otherwise("public")


def buckets(rows: DataFrame, value: str, grade: str) -> DataFrame:
    """(value, n, grades) of the values that are not blank, the commonest first; grades: which of GRADES their rows have."""
    own = rows.filter(F.trim(F.coalesce(value, F.lit(""))) != "")
    have = [F.bool_or(F.col(grade) == g).alias(f"has_{g}") for g in GRADES]
    out = own.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), *have)
    grades = F.filter(F.array(*(F.when(F.col(f"has_{g}"), g) for g in GRADES)), lambda g: g.isNotNull())
    return out.select("value", "n", grades.alias("grades")).orderBy(F.desc("n"), "value")


def bars(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n): the counts of each group, the largest first."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def blind_spots(facts: DataFrame, spec: DataFrame, companies: DataFrame, thin: float = 0.05, sample: int = 8) -> DataFrame:
    """(dimension, field, filled, companies, kind): fields of spec (dimension, field) with no fact at all (empty) or with few (thin).

    No rows for fewer than `sample` companies (company).
    """
    n = facts.join(companies, "company", "left_semi").groupBy("dimension", "field").agg(F.countDistinct("company").alias("filled"))
    total = companies.agg(F.countDistinct("company").alias("companies"))
    rows = spec.join(n, ["dimension", "field"], "left").na.fill(0, ["filled"]).join(F.broadcast(total), F.lit(True))  # one row of totals
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("filled") / F.col("companies") < thin, "thin")
    return rows.withColumn("kind", kind).filter((F.col("companies") >= sample) & F.col("kind").isNotNull())


def relevance_progress(profiles: DataFrame, relevance: str = "relevance", least: float = 0.5, sample: int = 8) -> DataFrame:
    """One row or none: companies, unclear, judged, share, if at least `least` of them are not judged yet."""
    out = profiles.agg(F.count("*").alias("companies"), F.count_if(F.col(relevance) == "unclear").alias("unclear"))
    out = out.withColumns({"judged": F.col("companies") - F.col("unclear"), "share": F.when(F.col("companies") > 0, F.round(F.col("unclear") / F.col("companies"), 6))})
    return out.filter((F.col("companies") >= sample) & (F.col("unclear") >= least * F.col("companies")))


def tabled(labels: DataFrame, row_axis: str, col_axis: str, least_group: int) -> DataFrame:
    """(company, row, col, row_grade, col_grade) of companies with both labels, in row groups of `least_group` and more."""
    side = lambda axis, name: labels.filter((F.col("axis") == axis) & (F.trim(F.coalesce("label", F.lit(""))) != "")).select("company", F.col("label").alias(name), F.col("grade").alias(f"{name}_grade"))
    both = side(row_axis, "row").join(side(col_axis, "col"), "company")
    return both.withColumn("row_n", F.count("*").over(Window.partitionBy("row"))).filter(F.col("row_n") >= least_group)


def stalled(labels: DataFrame, row_axis: str = "billing", col_axis: str = "stage", least_group: int = 5, early: str = EARLY, late: str = LATE) -> DataFrame:
    """(row, total, early, late, stalled): groups none of which has come late, against those that have.

    stalled: no late one and at least `least_group` early ones. No rows with fewer than two groups,
    nor if nothing is stalled.
    """
    own = tabled(labels, row_axis, col_axis, least_group)
    n = own.groupBy("row").agg(F.count("*").alias("total"), F.count_if(F.col("col").rlike(early) & ~F.col("col").rlike(late)).alias("early"), F.count_if(F.col("col").rlike(late)).alias("late"))
    n = n.withColumn("stalled", (F.col("late") == 0) & (F.col("early") >= least_group))
    sums = n.agg(F.count("*").alias("groups_"), F.count_if("stalled").alias("any_"))
    rows = n.join(F.broadcast(sums), F.lit(True)).filter((F.col("groups_") >= 2) & (F.col("any_") > 0))  # one row of totals
    return rows.filter("stalled or late > 0").select("row", "total", "early", "late", "stalled")


def origin_path(labels: DataFrame, row_axis: str = "founder", col_axis: str = "billing", target: str = PROJECT_BILLING, least_group: int = 5, least: float = 0.25) -> DataFrame:
    """One row or none: groups, judged, labelled, high_group, high, low_group, low, spread, confidence of the groups' shares of `target`.

    judged: companies in the groups; labelled: those with a row label at all.
    """
    own = tabled(labels, row_axis, col_axis, least_group)
    n = own.groupBy("row").agg(F.count("*").alias("n"), (F.count_if(F.col("col").rlike(target)) / F.count("*")).alias("share"), F.array_distinct(F.flatten(F.collect_list(F.array("row_grade", "col_grade")))).alias("grades"))
    high, low = F.struct(-F.col("share"), -F.col("n"), F.col("row")), F.struct(F.col("share"), F.col("n"), F.col("row"))
    pick = F.struct("row", "share", "grades")
    out = n.agg(F.count("*").alias("groups"), F.sum("n").alias("judged"), F.min_by(pick, high).alias("h"), F.min_by(pick, low).alias("l"))
    labelled = labels.filter((F.col("axis") == row_axis) & (F.trim(F.coalesce("label", F.lit(""))) != "")).agg(F.countDistinct("company").alias("n"))
    out = out.withColumn("spread", F.round(F.col("h.share") - F.col("l.share"), 6)).filter((F.col("groups") >= 2) & (F.col("spread") >= least))
    return out.select("groups", "judged", labelled.scalar().alias("labelled"), F.col("h.row").alias("high_group"), F.round("h.share", 6).alias("high"), F.col("l.row").alias("low_group"), F.round("l.share", 6).alias("low"), "spread", confidence(F.array_union("h.grades", "l.grades")).alias("confidence"))


def assembled(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(place, kind, scope, claim) of findings in the order of importance; parts: (kind, scope, rows of one column claim).

    scope is companies for what speaks of them and corpus for what speaks of the data.
    """
    tagged = [df.select(F.lit(i).alias("part"), F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), "claim") for i, (kind, scope, df) in enumerate(parts)]
    rows = reduce(DataFrame.union, tagged)
    return rows.withColumn("place", F.struct("part", "claim")).orderBy(F.col("scope") != "companies", "part", "claim").drop("place")
