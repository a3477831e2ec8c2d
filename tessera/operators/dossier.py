"""A company's dossier: rows with their sources, snapshots, opportunities, the weekly list and what is promoted from it.

Facts tie a field of a row to a source: (source_id, table, row_id, field); sources are (id, url, type, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import coverage_text, stable_id
from tessera.sources import versions

# The order of each section, and the fields that a promoted event takes its sources for.
SECTION_ORDER = {
    "industry_term": ("term",),
    "business_line": ("name",),
    "process_step": ("business_line", "seq"),
    "org_unit": ("name",),
    "position": ("name",),
    "system_in_use": ("category", "product"),
    "event": ("-occurred_at",),
    "financial_snapshot": ("year",),
    "relationship": ("kind", "counterparty"),
}
EVENT_FIELDS = ("company_id", "occurred_at", "kind", "summary")
OPPORTUNITY_FIELDS = ("company_id", "process_step_id", "pain_point", "ai_scenario", "data_prerequisite", "owner_org_unit", "confidence")


def section(rows: DataFrame, table: str) -> DataFrame:
    """The rows of a section in its order."""
    return rows.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in SECTION_ORDER[table]))


def row_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(table, row_id, urls): the distinct addresses behind each row, in order; one join for all rows."""
    return facts.join(sources.select(F.col("id").alias("source_id"), "url"), "source_id").groupBy("table", "row_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def company_steps(steps: DataFrame, lines: DataFrame) -> DataFrame:
    """Process steps with the company and the name of their business line."""
    own = lines.select(F.col("id").alias("business_line_id"), "company_id", F.col("name").alias("business_line"))
    return steps.join(own, "business_line_id")


def company_people(positions: DataFrame, people: DataFrame) -> DataFrame:
    """Positions with the person who holds them: (company_id, position_id, title, person_id, and the person's columns)."""
    own = people.withColumnRenamed("id", "person_id")
    return positions.select("company_id", F.col("id").alias("position_id"), "person_id", "title").join(own, "person_id")


def weekly_rows(updates: DataFrame, facts: DataFrame, sources: DataFrame, first: str, last: str) -> DataFrame:
    """The updates found from `first` to `last` whose summary has a source, with the least of its addresses; the latest first."""
    own = facts.filter("table = 'industry_update' and field = 'summary'").select(F.col("row_id").alias("id"), "source_id")
    urls = own.join(sources.select(F.col("id").alias("source_id"), "url"), "source_id").groupBy("id").agg(F.min("url").alias("url"))
    return updates.filter(F.col("found_at").between(first, last)).join(urls, "id").orderBy(F.desc("found_at"), "kind", "id")


def records(rows: DataFrame, table: str, company: Column, skip: tuple[str, ...] = ()) -> DataFrame:
    """(company_id, table, row_id, fields): each row as a map of its fields as text; id is no field."""
    names = [c for c in rows.columns if c != "id" and c not in skip]
    fields = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("string") for n in names)))
    return rows.select(company.cast("string").alias("company_id"), F.lit(table).alias("table"), F.col("id").cast("string").alias("row_id"), fields.alias("fields"))


def captured(tables: dict[str, DataFrame], facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(company_id, table, row_id, fields, urls): the snapshot of all companies at once.

    tables: company, and any of the tables with a company_id; process_step goes by its business
    line, person by the positions, industry and industry_term by the company's industry.
    """
    parts = [records(tables["company"], "company", F.col("id"))]
    parts += [records(df, name, F.col("company_id")) for name, df in tables.items() if "company_id" in df.columns]
    if "process_step" in tables:
        own = tables["process_step"].join(tables["business_line"].select(F.col("id").alias("business_line_id"), F.col("company_id").alias("own_")), "business_line_id")
        parts.append(records(own, "process_step", F.col("own_"), ("own_",)))
    if "person" in tables:
        own = tables["person"].join(tables["position"].select(F.col("person_id").alias("id"), F.col("company_id").alias("own_")).distinct(), "id")
        parts.append(records(own, "person", F.col("own_"), ("own_",)))
    members = tables["company"].select(F.col("id").alias("own_"), "industry_id").filter("industry_id is not null")
    if "industry" in tables:
        parts.append(records(tables["industry"].join(members.withColumnRenamed("industry_id", "id"), "id"), "industry", F.col("own_"), ("own_",)))
    if "industry_term" in tables:
        parts.append(records(tables["industry_term"].join(members, "industry_id"), "industry_term", F.col("own_"), ("own_",)))
    rows = reduce(DataFrame.unionByName, parts)
    urls = row_sources(facts.withColumns({"row_id": F.col("row_id").cast("string")}), sources)
    none = F.expr("cast(array() as array<string>)")
    return rows.join(urls, ["table", "row_id"], "left").select("company_id", "table", "row_id", "fields", F.coalesce("urls", none).alias("urls"))


def opportunities(rules: DataFrame, steps: DataFrame, systems: DataFrame, facts: DataFrame) -> DataFrame:
    """For each company and rule the first process step and the first system that fit, where both have sources.

    rules: (rule, process, system) with patterns, a table of the caller's own of a few rows; steps:
    company_steps(); systems: (id, company_id, category, product, covers). The result has rule,
    company_id, id, process_step_id, system_id, step_sources and system_sources.
    """
    table = rules.agg(F.collect_list(F.struct("rule", "process", "system")).alias("r"))

    def first(rows: DataFrame, text: Column, pattern: str, order: list[str], name: str) -> DataFrame:
        hits = rows.withColumn("t_", text).withColumn("r_", F.explode(table.scalar())).filter(F.expr(f"t_ rlike r_.{pattern}"))
        return hits.groupBy("company_id", F.col("r_.rule").alias("rule")).agg(F.min_by("id", F.struct(*order, "id")).alias(name))

    blank = lambda c: F.coalesce(c, F.lit(""))
    step = first(steps, F.concat_ws(" ", "business_line", "name", blank("pain_point")), "process", ["business_line", "seq"], "process_step_id")
    system = first(systems, F.concat_ws(" ", "category", "product", blank("covers")), "system", ["category", "product"], "system_id")
    behind = facts.groupBy("table", "row_id").agg(F.array_sort(F.collect_set("source_id")).alias("s"))
    of = lambda t, key, name: behind.filter(F.col("table") == t).select(F.col("row_id").alias(key), F.col("s").alias(name))
    both = step.join(system, ["company_id", "rule"]).join(of("process_step", "process_step_id", "step_sources"), "process_step_id").join(of("system_in_use", "system_id", "system_sources"), "system_id")
    return both.select("company_id", "rule", stable_id("opportunity", *map(F.col, ("company_id", "process_step_id", "system_id", "rule"))).alias("id"), "process_step_id", "system_id", "step_sources", "system_sources")


def opportunity_facts(found: DataFrame) -> DataFrame:
    """(id, source_id, table, row_id, field): every source of an opportunity stands behind each of its fields and behind its system."""
    fields = F.array(*map(F.lit, OPPORTUNITY_FIELDS), F.concat(F.lit("system_in_use:"), F.col("system_id").cast("string")))
    rows = found.select(F.col("id").alias("row_id"), F.explode(F.array_union("step_sources", "system_sources")).alias("source_id"), fields.alias("f")).withColumn("field", F.explode("f"))
    key = stable_id("fact", F.col("source_id"), F.lit("opportunity"), F.col("row_id"), F.col("field"))
    return rows.select(key.alias("id"), "source_id", F.lit("opportunity").alias("table"), "row_id", "field")


def replaced(old: DataFrame, new: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """old without the rows of `companies`, and all of new: a company that yields nothing now has nothing left."""
    return old.join(companies.select(key).distinct(), key, "left_anti").unionByName(new)


def promoted(updates: DataFrame, picks: DataFrame, companies: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(updates, events, facts, refused) after picks (id, company, promoted_at) of updates.

    A pick's company, or else the update's own, must be of the update's industry. What was promoted
    keeps its event; a missing time is filled in. events: (id, company_id, occurred_at, kind,
    summary); facts: the new ones, each source of the update for the event's fields; refused: (id, why).
    """
    one = picks.groupBy("id").agg(F.min_by("company", "promoted_at").alias("pick_"), F.min("promoted_at").alias("at_"))
    rows = updates.join(one, "id").withColumn("company_", F.coalesce("pick_", "company_id"))
    rows = rows.join(companies.select(F.col("id").alias("company_"), F.col("industry_id").alias("own_")), "company_", "left")
    done = F.col("promoted_to_event_id").isNotNull()
    why = F.when(done, F.lit(None)).when(F.col("company_").isNull(), "no company").when(F.col("own_").isNull(), "unknown company").when(F.col("own_") != F.col("industry_id"), "other industry")
    rows = rows.withColumn("why", why)
    refused = picks.join(updates.select("id"), "id", "left_anti").select("id", F.lit("unknown update").alias("why")).union(rows.filter("why is not null").select("id", "why"))
    good = rows.filter("why is null").withColumn("event_", F.coalesce("promoted_to_event_id", stable_id("event", F.col("company_"), F.col("found_at"), F.col("summary"))))
    kind = F.when(F.col("kind") == "procurement", "procurement").when(F.col("kind") == "target_action", "strategy").otherwise("statement")
    new = good.filter("promoted_to_event_id is null")
    events = new.select(F.col("event_").alias("id"), F.col("company_").alias("company_id"), F.col("found_at").alias("occurred_at"), kind.alias("kind"), "summary").dropDuplicates(["id"])
    behind = facts.filter("table = 'industry_update'").select(F.col("row_id").alias("id"), "source_id").distinct()
    cells = new.select("id", "event_").join(behind, "id").select("source_id", F.lit("event").alias("table"), F.col("event_").alias("row_id"), F.explode(F.array(*map(F.lit, EVENT_FIELDS))).alias("field")).distinct()
    cells = cells.join(facts.select("source_id", "table", "row_id", "field"), ["source_id", "table", "row_id", "field"], "left_anti")
    cells = cells.select(stable_id("fact", *map(F.col, ("source_id", "table", "row_id", "field"))).alias("id"), "source_id", "table", "row_id", "field")
    after = updates.join(good.select("id", "event_", "at_"), "id", "left")
    after = after.withColumns({"promoted_to_event_id": F.coalesce("promoted_to_event_id", "event_"), "promoted_at": F.coalesce("promoted_at", F.when(F.col("event_").isNotNull(), F.col("at_")))}).select(*updates.columns)
    return after, events, cells, refused


def evidence_gaps(cells: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The filled cells (keys, value) without a non-blank excerpt in evidence (keys, excerpt): a write with any of them is refused as a whole."""
    good = evidence.filter(F.trim(F.coalesce("excerpt", F.lit(""))) != "").select(*keys).distinct()
    return cells.filter(F.coalesce("value", F.lit("")) != "").join(good, keys, "left_anti")


def accepted_writes(cells: DataFrame, evidence: DataFrame, keys: list[str], write: str) -> DataFrame:
    """The cells of those writes (a column of both) that have evidence for all of their filled fields."""
    return cells.join(evidence_gaps(cells, evidence, keys).select(write).distinct(), write, "left_anti")


def field_hits(fields: DataFrame, reference: Column) -> DataFrame:
    """fields (field, value, terms) with `hit`: whether the reference text holds each term, NFKC, case and blanks aside.

    Fields without a value are left out; without terms the value is the term.
    """
    terms = F.filter(F.transform(F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array("value")), lambda t: F.trim(t)), lambda t: t != "")
    rows = fields.filter(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("terms_", terms)
    joined = coverage_text(F.array_join("terms_", "\u0001"))
    rows = rows.withColumns({"text_": coverage_text(reference), "parts_": F.split(joined, "\u0001")})
    return rows.withColumn("hit", (F.size("terms_") > 0) & F.forall("parts_", lambda t: F.contains(F.col("text_"), t))).drop("terms_", "text_", "parts_")


def hit_rate(hits: DataFrame, *by: str) -> DataFrame:
    """(by, total, hits, rate) of field_hits()."""
    out = hits.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 6)).otherwise(0.0))


def acceptance_weeks(counts: DataFrame, key: str, now: str, weeks: int = 4, least: int = 3) -> DataFrame:
    """(key, week, selected, passed, is_current): each key's last `weeks` Mondays up to now's, zero where nothing was selected."""
    current = F.date_trunc("week", F.lit(now).cast("timestamp")).cast("date")
    grid = counts.select(key).distinct().withColumn("week", F.explode(F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda k: F.date_sub(current, 7 * k))))
    own = grid.join(counts.select(key, "week", "n"), [key, "week"], "left").withColumn("selected", F.coalesce("n", F.lit(0)))
    return own.select(key, "week", "selected", (F.col("selected") >= least).alias("passed"), (F.col("week") == current).alias("is_current"))


def joined_workspace(signals: DataFrame, constraints: DataFrame, feedback: DataFrame, evaluations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals with their constraints, feedback with its evaluation): what is missing is blank, 50 percent, or 0."""
    s = signals.join(constraints, "signal_id", "left")
    f = feedback.join(evaluations, "feedback_id", "left").na.fill({"execution_quality": 0, "predicted_probability": 50, "brier_score": 0})
    return s, f


def managed_merge(old: DataFrame, new: DataFrame, drop: DataFrame, managed: Column, key: str = "id", replace: bool = True) -> DataFrame:
    """old without dropped and (with replace) managed rows, overlaid by new, by id."""
    keep = old.filter(~F.coalesce(managed, F.lit(False))) if replace else old
    return keep.join(drop.select(key), key, "left_anti").join(new.select(key), key, "left_anti").unionByName(new)


def with_filings(roster: DataFrame, filings: DataFrame) -> DataFrame:
    """A roster (id, ..., reason) with what was filed (id, title, date, fetched_at), if anything was: reason says so, updated_at follows."""
    rows = roster.join(filings.select("id", F.col("title").alias("t_"), F.col("date").alias("d_"), F.col("fetched_at").alias("f_")), "id", "left")
    said = F.concat("reason", F.lit("｜已取到："), "t_", F.lit("（"), "d_", F.lit("）"))
    return rows.withColumns({"reason": F.coalesce(said, "reason"), "updated_at": F.coalesce("f_", "updated_at"), "has_filing": F.col("t_").isNotNull()}).drop("t_", "d_", "f_")


def feed_summary(updates: DataFrame) -> DataFrame:
    """One row: updates, date_from, date_to, kinds and sources (name:count, in order), assigned, unassigned, ready."""
    each = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(F.map_from_entries(F.collect_list(F.struct(c, "n")))), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    kinds = updates.groupBy("kind").agg(F.count("*").alias("n")).agg(each("kind").alias("v"))
    types = updates.groupBy("source_type").agg(F.count("*").alias("n")).agg(each("source_type").alias("v"))
    has = F.coalesce("company_id", F.lit("")) != ""
    rows = updates.agg(F.count("*").alias("updates"), F.min("found_at").alias("date_from"), F.max("found_at").alias("date_to"), F.count_if(has).alias("assigned"), F.count_if(~has).alias("unassigned"))
    return rows.withColumns({"kinds": kinds.scalar(), "sources": types.scalar(), "ready": F.col("updates") >= 3})


def last_rows(rows: DataFrame, seq: str, most: int = 50) -> DataFrame:
    """The latest rows by their explicit number."""
    return rows.orderBy(F.desc(seq)).limit(most)


def workspace_rows(rows: DataFrame, caps: dict[str, int], workspace: str, most: int = 500) -> DataFrame:
    """Rows to be saved for a workspace: texts cut to their limits; more than `most` rows fail as a whole when they are read."""
    cut = rows.withColumns({c: F.substring(F.col(c), 1, n) for c, n in caps.items()})
    total = rows.agg(F.count("*").alias("n"))
    ok = F.assert_true(total.scalar() <= most, F.lit(f"more than {most} records"))
    return cut.withColumn("workspace_id", F.when(ok.isNull(), F.lit(workspace)))


def write_workspace(rows: DataFrame, path: str, workspaces: DataFrame) -> None:
    """Replaces workspaces (workspace_id), each as a whole and all at once; others stay, and one without rows is empty then."""
    versions.replace(rows, workspaces, path, "workspace_id")


def read_workspaces(spark: SparkSession, path: str) -> DataFrame | None:
    return versions.current(spark, path, "workspace_id")


def latest_by_rank(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_")
