"""Queries over dossiers, research runs, schedulers, presets and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import dossier, evidence, findings, research, signals, statistics
from tessera.plans.registry import query
from tessera.sources import pages as sinks
from tessera.sources.tables import latest_before, table

AS_OF = "2024-06-30"

# A dossier's tables from the test tables: customers are companies, orders their business lines, line items process steps,
# parts systems; suppliers are sources, and every line item with tax is a fact that one of them stands behind.


def _facts(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").filter("l_tax > 0.02")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return line.select(F.col("l_suppkey").alias("source_id"), F.lit("process_step").alias("table"), key.alias("row_id"), F.when(F.col("l_returnflag") == "R", "name").otherwise("pain_point").alias("field"))


def _sources(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://s.org/"), F.col("s_nationkey").cast("string")).alias("url"))


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("name"))


def _steps(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").alias("business_line_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("step "), (F.col("l_partkey") % 50).cast("string")).alias("name"), F.when(F.col("l_discount") > 0.05, "slow").alias("pain_point"))


_FACT = "select l_suppkey as source_id, 'process_step' as tab, l_orderkey || '-' || l_linenumber as row_id, case when l_returnflag = 'R' then 'name' else 'pain_point' end as field from lineitem where l_tax > 0.02"


@query(f"with f as ({_FACT}) select row_id, array_to_string(list_sort(list(distinct 'https://s.org/' || s_nationkey)), ' ') as urls from f join supplier on s_suppkey = source_id group by 1")
def row_sources(spark, sf_dir):
    return dossier.row_sources(_facts(spark, sf_dir), _sources(spark, sf_dir)).select("row_id", F.array_join("urls", " ").alias("urls"))


@query("select o_custkey as company_id, o_orderpriority as business_line, cast(l_linenumber as bigint) as seq, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by all")
def company_steps(spark, sf_dir):
    rows = dossier.company_steps(_steps(spark, sf_dir), _lines(spark, sf_dir))
    return rows.groupBy("company_id", "business_line", F.col("seq").cast("long").alias("seq")).agg(F.count("*").alias("n"))


@query("select c_custkey as company_id, c_custkey * 2 as position_id, c_mktsegment as title, n_name as name from customer join nation on n_nationkey = c_nationkey")
def company_people(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), (F.col("c_custkey") * 2).alias("id"), F.col("c_nationkey").alias("person_id"), F.col("c_mktsegment").alias("title"))
    who = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return dossier.company_people(c, who).drop("person_id")


_UPDATES = "select event_id as id, user_id % 5 as industry_id, case when user_id % 3 > 0 then user_id % 40 end as company_id, strftime(ts, '%Y-%m-%d') as found_at, case event_type when 'purchase' then 'procurement' when 'click' then 'target_action' else 'policy' end as kind, 'about ' || user_id as summary, case when event_id % 6 = 0 then 'event_old' end as promoted_to_event_id, case when event_id % 12 = 0 then '2024-01-05' end as promoted_at from events"


def _updates(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "procurement").when(F.col("event_type") == "click", "target_action").otherwise("policy")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("industry_id"), F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 40).alias("company_id"), F.date_format("ts", "yyyy-MM-dd").alias("found_at"), kind.alias("kind"), F.concat(F.lit("about "), F.col("user_id").cast("string")).alias("summary"), F.when(F.col("event_id") % 6 == 0, "event_old").alias("promoted_to_event_id"), F.when(F.col("event_id") % 12 == 0, "2024-01-05").alias("promoted_at"))


def _update_facts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_id % 4 > 0")
    return e.select(F.explode(F.array((F.col("event_id") % 7 + 1).alias("a"), (F.col("event_id") % 3 + 1).alias("b"))).alias("source_id"), F.lit("industry_update").alias("table"), F.col("event_id").alias("row_id"), F.lit("summary").alias("field")).distinct()


@query(f"""with u as ({_UPDATES}), f as (select distinct event_id as id, unnest([event_id % 7 + 1, event_id % 3 + 1]) as source_id from events where event_id % 4 > 0), x as (select id, min('https://s.org/' || s_nationkey) as url from f join supplier on s_suppkey = source_id group by 1)
 select id, found_at, kind, url from u join x using (id) where found_at between '2024-01-03' and '2024-01-20'""")
def weekly_list(spark, sf_dir):
    rows = dossier.weekly_rows(_updates(spark, sf_dir), _update_facts(spark, sf_dir), _sources(spark, sf_dir), "2024-01-03", "2024-01-20")
    return rows.select("id", "found_at", "kind", "url")


_STABLE = lambda prefix, *parts: f"'{prefix}_' || substr(sha256({' || chr(31) || '.join(f'lower(trim(cast({p} as varchar)))' for p in parts)}), 1, 20)"


def _promoted(spark, sf_dir):
    u = _updates(spark, sf_dir)
    picks = u.filter("id % 3 = 0").select("id", F.when(F.col("id") % 9 == 0, F.col("id") % 45).alias("company"), F.lit("2024-02-01").alias("promoted_at"))
    companies = spark.range(40).select(F.col("id"), (F.col("id") % 5).alias("industry_id"))
    return dossier.promoted(u, picks, companies, _update_facts(spark, sf_dir))


_PICKED = f"""u as ({_UPDATES}), p as (select *, coalesce(case when id % 9 = 0 then id % 45 end, company_id) as target from u where id % 3 = 0),
 w as (select *, case when promoted_to_event_id is not null then null when target is null then 'no company' when target >= 40 then 'unknown company' when target % 5 <> industry_id then 'other industry' end as why from p)"""


@query(f"with {_PICKED} select {_STABLE('event', 'target', 'found_at', 'summary')} as id, any_value(target) as company_id, any_value(found_at) as occurred_at, any_value(case kind when 'procurement' then 'procurement' when 'target_action' then 'strategy' else 'statement' end) as kind from w where why is null and promoted_to_event_id is null group by 1 having count(distinct kind) = 1")
def promoted_events(spark, sf_dir):
    """Events promoted from the weekly list; where several updates make one event, its kind is any of theirs and is not compared."""
    u = _updates(spark, sf_dir)
    events = _promoted(spark, sf_dir)[1]
    many = u.filter("id % 3 = 0 and promoted_to_event_id is null").withColumn("target", F.coalesce(F.when(F.col("id") % 9 == 0, F.col("id") % 45), "company_id")).filter("target < 40 and target % 5 = industry_id")
    mixed = many.groupBy(text.stable_id("event", F.col("target"), F.col("found_at"), F.col("summary")).alias("id")).agg(F.countDistinct("kind").alias("k")).filter("k > 1")
    return events.drop("summary").join(mixed, "id", "left_anti")


@query(f"with {_PICKED} select why, count(*) as n from w where why is not null group by 1")
def promotion_refusals(spark, sf_dir):
    return _promoted(spark, sf_dir)[3].groupBy("why").agg(F.count("*").alias("n"))


@query(f"with {_PICKED} select count(*) as n, count(*) filter (where coalesce(u.promoted_to_event_id, case when w.why is null and w.id is not null then 'new' end) is not null) as promoted, count(*) filter (where coalesce(u.promoted_at, case when w.why is null and w.id is not null then 'new' end) is not null) as timed from u left join w using (id)")
def promotion_state(spark, sf_dir):
    after = _promoted(spark, sf_dir)[0]
    return after.agg(F.count("*").alias("n"), F.count("promoted_to_event_id").alias("promoted"), F.count("promoted_at").alias("timed"))


@query(f"""with {_PICKED}, f as (select distinct event_id as id, unnest([event_id % 7 + 1, event_id % 3 + 1]) as source_id from events where event_id % 4 > 0)
 select distinct source_id, {_STABLE('event', 'target', 'found_at', 'summary')} as row_id, unnest(['company_id', 'occurred_at', 'kind', 'summary']) as field from w join f using (id) where why is null and promoted_to_event_id is null""")
def promoted_facts(spark, sf_dir):
    return _promoted(spark, sf_dir)[2].select("source_id", "row_id", "field")


@query("""with r as (select c_custkey as company_id, 'company' as tab, cast(c_custkey as varchar) as row_id, 3 as fields from customer union all select o_custkey, 'business_line', cast(o_orderkey as varchar), 2 from orders union all select o_custkey, 'process_step', l_orderkey || '-' || l_linenumber, 4 from lineitem join orders on l_orderkey = o_orderkey
  union all select c_custkey, 'industry', cast(c_nationkey as varchar), 1 from customer), f as (select l_orderkey || '-' || l_linenumber as row_id from lineitem where l_tax > 0.02)
 select cast(company_id as varchar) as company_id, tab, count(*) as n, cast(sum(fields) as bigint) as fields, count(*) filter (where tab = 'process_step' and row_id in (from f)) as sourced from r group by 1, 2""")
def dossier_snapshot(spark, sf_dir):
    """The snapshot of all companies' dossiers, summed up by table."""
    company = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("industry_id"), F.col("c_acctbal").alias("balance"))
    industry = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    tables = {"company": company, "business_line": _lines(spark, sf_dir), "process_step": _steps(spark, sf_dir), "industry": industry}
    out = dossier.captured(tables, _facts(spark, sf_dir), _sources(spark, sf_dir))
    return out.groupBy("company_id", F.col("table").alias("tab")).agg(F.count("*").alias("n"), F.sum(F.size("fields")).alias("fields"), F.count_if(F.size("urls") > 0).alias("sourced"))


_RULES = [("pricing", "step [1-3]$|URGENT", "PROMO"), ("delivery", "slow", "^Brand#1"), ("never", "nothing", ".")]


@query(f"""with r(rule, process, system) as (values {", ".join(str(r) for r in _RULES)}), s as (select o_custkey as company_id, l_orderkey || '-' || l_linenumber as id, o_orderpriority as bl, l_linenumber as seq, o_orderpriority || ' step ' || (l_partkey % 50) || case when l_discount > 0.05 then ' slow' else ' ' end as t from lineitem join orders on l_orderkey = o_orderkey),
 a as (select company_id, rule, arg_min(s.id, (bl, seq, s.id)) as step from s join r on regexp_matches(t, process) group by all),
 y as (select p_partkey % 200 as company_id, 'y' || p_partkey as id, p_brand as category, p_type as product from part), b as (select company_id, rule, arg_min(y.id, (category, product, y.id)) as system from y join r on regexp_matches(category || ' ' || product || ' ', system) group by all),
 f as (select distinct l_orderkey || '-' || l_linenumber as row_id, l_suppkey as src from lineitem where l_tax > 0.02) select company_id, rule, step as process_step_id, system as system_id, count(distinct src) as n_sources from a join b using (company_id, rule) join f on row_id = step where cast(substr(system, 2) as bigint) % 3 > 0 group by all""")
def opportunities(spark, sf_dir):
    """For each company and rule the first step and the first system that fit, where both have sources."""
    rules = spark.createDataFrame(_RULES, "rule string, process string, system string")
    part = table(spark, sf_dir, "part")
    systems = part.select(F.concat(F.lit("y"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") % 200).alias("company_id"), F.col("p_brand").alias("category"), F.col("p_type").alias("product"), F.lit("").alias("covers"))
    behind = part.filter("p_partkey % 3 > 0").select(F.lit(1).cast("long").alias("source_id"), F.lit("system_in_use").alias("table"), F.concat(F.lit("y"), F.col("p_partkey").cast("string")).alias("row_id"), F.lit("product").alias("field"))
    out = dossier.opportunities(rules, dossier.company_steps(_steps(spark, sf_dir), _lines(spark, sf_dir)), systems, _facts(spark, sf_dir).union(behind))
    return out.select("company_id", "rule", "process_step_id", "system_id", F.size("step_sources").cast("long").alias("n_sources"))


@query("select o_orderkey, o_custkey as company_id from orders where o_orderdate < '1995-01-01' and o_custkey % 5 > 0 union all select o_orderkey, o_custkey from orders where o_orderdate >= '1995-01-01' and o_custkey % 5 = 0")
def replaced_companies(spark, sf_dir):
    """What is regenerated for some companies takes the place of what they had."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("company_id"), "o_orderdate")
    old, new = (o.filter(x).drop("o_orderdate") for x in ("o_orderdate < '1995-01-01'", "o_orderdate >= '1995-01-01' and company_id % 5 = 0"))
    return dossier.replaced(old, new, table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("company_id")))


@query("with c as (select l_orderkey, l_linenumber, case when l_tax = 0 then '' else l_returnflag end as value from lineitem), e as (select l_orderkey, l_linenumber from lineitem where l_discount > 0.01), g as (select distinct l_orderkey from c anti join e using (l_orderkey, l_linenumber) where value <> '') select l_orderkey, count(*) as n from c where l_orderkey not in (from g) group by 1")
def accepted_writes(spark, sf_dir):
    """Writes of which every filled field has evidence; one gap refuses the whole write."""
    line = table(spark, sf_dir, "lineitem")
    cells = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") == 0, "").otherwise(F.col("l_returnflag")).alias("value"))
    said = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.01, "seen").otherwise(" ").alias("excerpt"))
    return dossier.accepted_writes(cells, said, ["l_orderkey", "l_linenumber"], "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""with d as (select doc_id, lang, lower(regexp_replace(text, '\\s+', '', 'g')) as t from documents), h as (select doc_id, lang, t, unnest(['license', 'Tion', 'der und', 'x']) as value, unnest([['license'], ['Tion', ' q'], ['der', 'und'], []]) as terms from d)
 select lang, count(*) as total, count(*) filter (where (len(terms) = 0 and contains(t, 'x')) or (len(terms) > 0 and len(list_filter(terms, lambda k: not contains(t, lower(trim(k))))) = 0)) as hits from h group by 1""")
def field_hit_rate(spark, sf_dir):
    """The share of fields whose terms a reference text holds."""
    none = F.expr("cast(array() as array<string>)")
    cells = F.array(*(F.struct(F.lit(v).alias("value"), t.alias("terms")) for v, t in (("license", F.array(F.lit("license"))), ("Tion", F.array(F.lit("Ｔion"), F.lit(" q"))), ("der und", F.array(F.lit("der"), F.lit("und"))), ("x", none))))
    rows = table(spark, sf_dir, "documents").select("lang", "text", F.explode(cells).alias("c")).select("lang", "text", "c.*")
    return dossier.hit_rate(dossier.field_hits(rows, F.col("text")), "lang").drop("rate")


@query("with r as (select 'business_line' as part, o_custkey as company, o_orderpriority as a, cast(o_orderkey as varchar) as b from orders) select part, company, min(a) as first_name, count(*) as n from r group by 1, 2")
def dossier_sections(spark, sf_dir):
    """A section's rows in their order: each company's first row is the one that comes first."""
    rows = dossier.section(_lines(spark, sf_dir), "business_line").select("company_id", "name", F.monotonically_increasing_id().alias("at"))
    return rows.groupBy(F.lit("business_line").alias("part"), F.col("company_id").alias("company")).agg(F.min_by("name", "at").alias("first_name"), F.count("*").alias("n"))


@query("select case l_suppkey % 4 when 0 then 'statutory' when 1 then 'independent' when 2 then 'self' else 'unverified' end as grade, count(*) as n from lineitem group by 1")
def graded_facts(spark, sf_dir):
    g = F.element_at(F.array(*map(F.lit, ("statutory", "independent", "self", "unverified"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return signals.count_by_grade(table(spark, sf_dir, "lineitem").select(g.alias("grade")))


_WEEK_N = "select user_id, cast(date_trunc('week', ts + interval 8 hours) as date) as week, count(*) as n from events group by all"


@query(f"with w as ({_WEEK_N}), g as (select distinct user_id, cast(date '2024-01-29' - 7 * unnest([0, 1, 2, 3]) as date) as week from w) select user_id, week, coalesce(n, 0) as selected, coalesce(n, 0) >= 3 as passed, week = date '2024-01-29' as is_current from g left join w using (user_id, week)")
def recent_weeks(spark, sf_dir):
    counts = statistics.week_counts(table(spark, sf_dir, "events"), "user_id", "ts")
    return dossier.acceptance_weeks(counts, "user_id", "2024-02-01")


@query("select o_orderkey as id, coalesce(l_quantity, 0) as v from orders left join lineitem on l_orderkey = o_orderkey and l_linenumber = 2 where (o_orderkey % 4 = 0 and o_orderkey % 3 > 0 and o_orderkey % 10 > 1) or o_orderkey % 5 = 1")
def managed_signals(spark, sf_dir):
    """Unmanaged signals stay, incoming ones are laid over by id, dropped ones go."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(2).alias("line"))
    old, new, drop = o.filter("id % 4 = 0"), o.filter("id % 5 = 1"), o.filter("id % 10 < 2")
    kept = dossier.managed_merge(old, new, drop, F.col("id") % 3 == 0)
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_quantity")
    return kept.join(line, ["id", "line"], "left").select("id", F.coalesce("l_quantity", F.lit(0.0)).alias("v"))


@query("select o_orderkey as signal_id, q as bound, case when q is null then 0 else 30 end as execution_quality, case when q is null then 50 else p % 100 end as predicted_probability, 0 as brier_score from orders left join (select l_orderkey, min(l_quantity) as q, min(l_partkey) as p from lineitem group by 1) on l_orderkey = o_orderkey")
def joined_workspace(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p"))
    bounds = line.select(F.col("l_orderkey").alias("signal_id"), F.col("q").alias("bound"))
    told = line.select(F.col("l_orderkey").alias("feedback_id"), F.lit(30).alias("execution_quality"), (F.col("p") % 100).alias("predicted_probability"), F.lit(0).alias("brier_score"))
    s, f = dossier.joined_workspace(o.select(F.col("o_orderkey").alias("signal_id")), bounds, o.select(F.col("o_orderkey").alias("feedback_id")), told)
    return s.join(f.withColumnRenamed("feedback_id", "signal_id"), "signal_id")


@query("select c_custkey as id, case when o is null then 'guess' else 'guess｜已取到：' || o || '（' || d || '）' end as reason, o is not null as has_filing from customer left join (select o_custkey, arg_max(cast(o_orderkey as varchar), o_orderkey) as o, strftime(arg_max(o_orderdate, o_orderkey), '%Y-%m-%d') as d from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey")
def roster_filings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("guess").alias("reason"), F.lit("2024-01-01").alias("updated_at"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").cast("string").alias("title"), F.date_format(F.max_by("o_orderdate", "o_orderkey"), "yyyy-MM-dd").alias("date"))
    return dossier.with_filings(c, o.withColumn("fetched_at", F.lit("2024-02-02"))).select("id", "reason", "has_filing")


@query(f"with u as ({_UPDATES}) select count(*) as updates, min(found_at) as date_from, max(found_at) as date_to, count(company_id) as assigned, count(*) - count(company_id) as unassigned, (select string_agg(kind || ':' || n, ',' order by kind || ':' || n) from (select kind, count(*) as n from u group by 1)) as kinds, count(*) >= 3 as ready from u")
def feed_summary(spark, sf_dir):
    rows = _updates(spark, sf_dir).withColumns({"source_type": F.lit("official"), "company_id": F.col("company_id").cast("string")})
    return dossier.feed_summary(rows).drop("sources")


@query("select event_id, user_id, substr(props, 1, 5) as props from events order by event_id desc limit 50")
def last_rows(spark, sf_dir):
    """The latest fifty, cut to what may be stored: the limit is the feature."""
    rows = dossier.workspace_rows(dossier.last_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "event_id"), {"props": 5}, "w")
    return rows.drop("workspace_id")


@query("select c_custkey, c_name || '<a href=\"https://s.org/' || c_nationkey || '\">' || c_mktsegment || '</a>' as cell, n from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def dossier_pages(spark, sf_dir):
    """A page for each customer with orders; the heading, a linked cell and the number of rows are read back from the HTML."""
    c = table(spark, sf_dir, "customer").withColumn("urls", F.array(F.concat(F.lit("https://s.org/"), F.col("c_nationkey").cast("string"))))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    head = sinks.section(c, "c_custkey", 1, "Profile", ["segment"], [sinks.linked(F.col("c_mktsegment"), F.col("urls"))], [F.col("c_custkey")])
    body = sinks.section(o, "c_custkey", 2, "Orders", ["key", "priority"], [sinks.escaped(F.col("o_orderkey")), sinks.escaped(F.col("o_orderpriority"))], [F.col("o_orderkey")])
    html = sinks.documents(c, "c_custkey", "c_name", [head, body]).filter(F.contains("html", F.lit("chapter-2")))
    return html.select("c_custkey", F.concat(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.regexp_extract("html", "<td>(<a.*?</a>)</td>", 1)).alias("cell"), (F.regexp_count("html", F.lit("<tr><td>")) - 1).cast("long").alias("n"))


@query("""with r as (select o_orderkey as run from orders), s as (select l_orderkey as run, count(distinct l_suppkey) as sources from lineitem group by 1), c as (select l_orderkey as run, count(*) as claims, count(*) filter (where p_size % 3 = 0) as corroborated from (select distinct l_orderkey, l_partkey from lineitem) join part on p_partkey = l_partkey group by 1)
 select run, coalesce(sources, 0) as sources, coalesce(claims, 0) as claims, coalesce(corroborated, 0) as corroborated from r left join s using (run) left join c using (run)""")
def run_completion(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    claims = part.select(F.col("p_partkey").alias("claim"), F.when(F.col("p_size") % 3 == 0, "corroborated").otherwise("single-source").alias("status"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"))
    return research.run_completion(runs, line.select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("source")), line.select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("claim")), claims)


@query("select 'runs' as name, (select count(*) from orders) as n union all select 'sources', (select count(*) from supplier) union all select 'claims', (select count(*) from part) union all select 'corroborated', (select count(*) from part where p_size % 3 = 0) union all select 'linked', (select count(*) from lineitem)")
def research_overview(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("status", F.when(F.col("p_size") % 3 == 0, "corroborated").otherwise("single-source"))
    return research.overview(table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier"), part, table(spark, sf_dir, "lineitem"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 8")
def recent_runs(spark, sf_dir):
    """The latest eight: the limit is the feature."""
    return research.recent(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


_ONE = 777


@query(f"""with r as (select o_orderkey as run, 'Firm, ' || (o_custkey % 4) as entity, [o_orderpriority, o_orderstatus] as dims, o_orderstatus as st, o_orderdate as at_ from orders), o as (select * from r where run = {_ONE}), b as (select * from r where run <> {_ONE} and st <> 'P' order by at_ desc, run limit 80),
 s as (select l_orderkey as run, count(distinct l_suppkey) as n from lineitem where l_suppkey in (select l_suppkey from lineitem where l_orderkey = {_ONE}) group by 1), c as (select l_orderkey as run, count(distinct l_partkey) as n from lineitem where l_partkey in (select l_partkey from lineitem where l_orderkey = {_ONE}) group by 1),
 n as (select b.run, case when b.entity = o.entity then o.entity else '跨主体' end as entity, len(list_intersect(b.dims, o.dims)) as n_dims, coalesce(s.n, 0) as n_sources, coalesce(c.n, 0) as n_claims, b.entity = o.entity as same from b cross join o left join s on s.run = b.run left join c on c.run = b.run)
 select run, entity, cast(n_dims as bigint) as n_dims, n_sources, n_claims, cast(least(100, case when same then 42 else 0 end + 9 * n_dims + 14 * n_sources + 20 * n_claims) as bigint) as strength from n where least(100, case when same then 42 else 0 end + 9 * n_dims + 14 * n_sources + 20 * n_claims) >= 20""")
def query_links(spark, sf_dir):
    """Links of one run to the eighty done before it: the number is the feature."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("Firm, "), (F.col("o_custkey") % 4).cast("string")).alias("entity"), F.array("o_orderpriority", "o_orderstatus").alias("dims"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("done").alias("status"), F.col("o_orderdate").alias("completed_at"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("claim"))
    out = research.query_links(runs, line.select("run", "source"), line.select("run", "claim"), _ONE)
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_dims", "strength")})


@query("select count(*) filter (where g = 0) as statutory, count(*) filter (where g = 1) as independent, count(*) filter (where g = 2) as self, count(*) filter (where g = 3) as unverified, count(*) filter (where o_orderstatus = 'F') as corroborated, count(*) filter (where o_orderstatus = 'O') as single_source, count(*) filter (where o_orderstatus = 'P') as repeated_copy from (select o_orderkey % 5 as g, o_orderstatus from orders)")
def candidate_grades(spark, sf_dir):
    g = F.element_at(F.array(*map(F.lit, ("statutory", "independent", "self", "unverified", "odd"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    v = F.when(F.col("o_orderstatus") == "F", "corroborated").when(F.col("o_orderstatus") == "O", "single-source").otherwise("repeated-copy")
    return research.grade_summary(table(spark, sf_dir, "orders").select(g.alias("g"), v.alias("v")), "g", "v")


@query("with o as (select user_id as id, 'old' as name, 7 as n from events where user_id % 2 = 0 group by 1), a as (select user_id as id, arg_min(event_type, ts) as name, min(ts) as first_seen, count(*) as n from events where user_id % 3 = 0 group by 1) select coalesce(o.id, a.id) as id, coalesce(o.name, a.name) as name, coalesce(o.n, 0) + coalesce(a.n, 0) as query_count from o full join a on o.id = a.id")
def counted_entities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("id")).distinct().select("id", F.lit("old").alias("name"), F.lit("2024-01-01").cast("timestamp_ntz").alias("first_seen"), F.lit(7).cast("long").alias("query_count"))
    return research.counted_entities(old, e.filter("user_id % 3 = 0").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("ts").alias("asked_at"))).drop("first_seen")


@query("select c_custkey as id, 5 + coalesce(n, 0) as candidates_count, coalesce(s, 'pending') as status, last as last_searched_at from customer left join (select o_custkey, sum(o_orderkey % 9) as n, arg_max(o_orderstatus, o_orderkey) as s, max(o_orderkey) as last from orders group by 1) on o_custkey = c_custkey")
def preset_searches(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("last_searched_at"), F.lit(5).cast("long").alias("candidates_count"), F.lit("pending").alias("status"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 9).alias("count"), F.col("o_orderstatus").alias("status"))
    return research.preset_searches(c, o)


@query("with p as (select c_custkey as id, c_name as name, c_acctbal > 5000 as watch, c_nationkey % 4 as rel from customer where (c_acctbal > 5000 or c_nationkey % 4 = 1) and contains(lower(c_name || '  ' || c_mktsegment || ' x'), 'building')) select id, row_number() over (order by watch desc, rel, name, id) as place from p order by place limit 200")
def preset_listing(spark, sf_dir):
    """The first two hundred of a scope that hold a text: the limit is the feature."""
    rel = F.element_at(F.array(*map(F.lit, ("practitioner", "adjacent", "vendor", "unclear"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("legal_name"), F.col("c_mktsegment").alias("sector"), F.lit("x").alias("city"), (F.col("c_acctbal") > 5000).alias("watchlist"), F.lit(False).alias("has_fde_facts"), rel.alias("relevance"))
    out = research.preset_listing(rows, "focus", " Building ")
    return out.select("id", F.monotonically_increasing_id().alias("m")).groupBy().agg(F.array_sort(F.collect_list(F.struct("m", "id"))).alias("x")).select(F.posexplode("x").alias("k", "v")).select("v.id", (F.col("k") + 1).cast("long").alias("place"))


# A scheduler's candidates: orders by the customer's nation as one run each; relations, dates and grades from the columns.
_KIND = "['equity', 'supply', 'compete', 'odd', 'license'][cast(l_partkey % 5 + 1 as int)]"
_TITLE = "concat('Order ', cast(o_orderkey as string))"
_EVID = "concat('evidence that is long enough to count as such for order ', cast(o_custkey as string), case when o_orderkey % 13 = 0 then '' else concat(' 2024-0', cast(o_orderkey % 6 + 1 as string), '-1', cast(o_orderkey % 9 as string)) end)"


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    g = F.element_at(F.array(*map(F.lit, ("statutory", "independent", "self", "unverified"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    url = F.when(F.col("o_orderkey") % 17 == 0, "https://www.bing.com/x").otherwise(F.concat(F.lit("https://s.org/"), (F.col("o_orderkey") % 700).cast("string")))
    c = o.select(F.col("c_nationkey").alias("grp"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 19 == 0, "short").otherwise(F.expr(_TITLE)).alias("title"), F.expr(_EVID).alias("evidence"), url.alias("url"), g.alias("grade"), (F.col("o_orderkey") % 23 == 0).alias("duplicate"))
    c = c.withColumn("dated", dates.latest_observed_date(F.concat_ws(" ", "title", "evidence", "url"), AS_OF))
    kind = F.element_at(F.array(*map(F.lit, ("equity", "supply", "compete", "odd", "license"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("at"), F.concat(F.lit("Ｆirm "), (F.col("l_suppkey") % 9).cast("string")).alias("from_node"), F.concat(F.lit("part "), (F.col("l_partkey") % 11).cast("string")).alias("to_node"), kind.alias("relation"), F.lit("equity").alias("suggested"), F.lit("forward").alias("direction"))
    known = e.filter("key % 50 = 1").join(c.select("key", "grp"), "key")
    return c, e, research.scheduled_edges(known, "key").join(c.select("key", "grp"), "key").select("grp", "edge_key")


def _known(spark, sf_dir) -> tuple[DataFrame, ...]:
    c, e, keys = _candidates(spark, sf_dir)
    return research.screened(c, e, AS_OF), c.filter("key % 40 = 3").select("grp", "url"), keys, keys.groupBy("grp").agg(F.count("*").alias("n_edges"))


def _admitted(spark, sf_dir) -> DataFrame:
    return research.admitted(*_known(spark, sf_dir))


_EARLY = f"""c as (select c_nationkey as grp, o_orderkey as key, case when o_orderkey % 19 = 0 then 'short' else {_TITLE} end as title, case when o_orderkey % 17 = 0 then 'bing' else 'https://s.org/' || (o_orderkey % 700) end as url, o_orderkey % 4 as g, o_orderkey % 23 = 0 as dup, case when o_orderkey % 13 = 0 then null else make_date(2024, cast(o_orderkey % 6 + 1 as int), cast(10 + o_orderkey % 9 as int)) end as dated from orders join customer on c_custkey = o_custkey),
 e as (select l_orderkey as key, case l_partkey % 5 when 0 then 730 when 1 then 548 when 2 then 365 when 4 then 730 end as days, case l_partkey % 5 when 0 then 'equity|firm' || (l_suppkey % 9) || '|part' || (l_partkey % 11) when 1 then 'supply|firm' || (l_suppkey % 9) || '|part' || (l_partkey % 11) when 2 then 'compete|firm' || (l_suppkey % 9) || '|part' || (l_partkey % 11) when 4 then 'license|firm' || (l_suppkey % 9) || '|part' || (l_partkey % 11) end as k from lineitem where l_partkey % 5 <> 3),
 n as (select key, count(*) as n, min(days) as days from e group by 1), ku as (select distinct grp, url from c where key % 40 = 3), kk as (select distinct grp, k from e join c using (key) where key % 50 = 1),
 f as (select e.key, count(*) as fresh from e join c using (key) where (c.grp, e.k) not in (select (grp, k) from kk) group by 1),
 v as (select c.*, case when dup then 'extractorDuplicate' when url = 'bing' then 'weakSource' when g = 3 then 'unverifiedSource' when title = 'short' then 'thinEvidence' when (grp, url) in (select (grp, url) from ku) then 'duplicateSource' when coalesce(n, 0) not between 1 and 3 then 'invalidEdges'
  when dated is null or date '{AS_OF}' - dated > days then 'staleOrUndated' when coalesce(fresh, 0) = 0 then 'duplicateRelation' else 'open' end as verdict from c left join n using (key) left join f using (key))"""


@query(f"with {_EARLY} select case when verdict = 'open' then 'open' else verdict end as reason, count(*) as n from v group by 1")
def scheduler_screening(spark, sf_dir):
    """Every reason that does not hang on the order of candidates; what is left open goes through the fold."""
    own = research.judged(*_known(spark, sf_dir))
    return own.groupBy(F.coalesce("verdict", F.lit("open")).alias("reason")).agg(F.count("*").alias("n"))


_ORDER = "case g when 0 then 4 when 1 then 3 when 2 then 2 else 0 end desc, dated desc nulls last, title, key"
#: The scan over what is left open, a turn each, with the addresses and relations known so far; then the rest against the addresses taken.
_ADMITTED = f"""{_EARLY}, i as (select e.key, list(e.k order by l) as items from (select l_orderkey as key, l_linenumber as l, l_partkey, 'x' as x, case l_partkey % 5 when 0 then 'equity|firm' || (l_suppkey % 9) || '|part' || (l_partkey % 11) when 1 then 'supply|firm' || (l_suppkey % 9) || '|part' || (l_partkey % 11) when 2 then 'compete|firm' || (l_suppkey % 9) || '|part' || (l_partkey % 11) when 4 then 'license|firm' || (l_suppkey % 9) || '|part' || (l_partkey % 11) end as k from lineitem) e join c using (key) where k is not null and (c.grp, e.k) not in (select (grp, k) from kk) group by 1),
 w as materialized (select *, row_number() over (partition by grp order by {_ORDER}) as rank from v), o as materialized (select w.*, items, row_number() over (partition by grp order by rank) as place from w join i using (key) where verdict = 'open'),
 rooms as materialized (select grp, greatest(0, 48 - coalesce(n, 0)) as room from (select distinct grp from c) left join (select grp, count(*) as n from e join c using (key) where key % 50 = 1 group by 1) using (grp)),
 r as (select grp, cast(0 as bigint) as place, cast(null as bigint) as key, '' as verdict, cast([] as varchar[]) as novel, 0 as taken, 0 as used, cast([] as varchar[]) as urls, cast([] as varchar[]) as known from rooms union all
  select grp, place, key, verdict, novel, taken + cast(verdict = 'accepted' as int), used + case when verdict = 'accepted' then len(novel) else 0 end, case when verdict = 'accepted' then list_append(urls, url) else urls end, case when verdict = 'accepted' then list_concat(known, novel) else known end
  from (select *, case when list_contains(urls, url) then 'duplicateSource' when len(novel) = 0 then 'duplicateRelation' when taken >= 4 or used + len(novel) > 6 or used + len(novel) > room then 'capacity' else 'accepted' end as verdict
   from (select o.grp, o.place, o.key, o.url, r.taken, r.used, r.urls, r.known, room, list_filter(o.items, lambda x: not list_contains(r.known, x)) as novel from r join o on o.grp = r.grp and o.place = r.place + 1 join rooms on rooms.grp = o.grp))),
 taken as (select w.grp, w.url, min(w.rank) as rank from r join w on w.grp = r.grp and w.key = r.key where r.verdict = 'accepted' group by 1, 2),
 told as (select grp, key, place, verdict, case when verdict = 'accepted' then len(novel) else 0 end as n_novel from r where place > 0 union all
  select w.grp, key, null, case when w.verdict in ('invalidEdges', 'staleOrUndated', 'duplicateRelation') and t.rank < w.rank then 'duplicateSource' else w.verdict end, 0 from w left join taken t on t.grp = w.grp and t.url = w.url where w.verdict <> 'open')"""


@query(f"with recursive {_ADMITTED} select grp, key, place, verdict, n_novel from told")
def scheduler_admission(spark, sf_dir):
    """The verdict on each candidate, in the order of its run."""
    return _admitted(spark, sf_dir).select("grp", "key", "place", "verdict", F.size("novel").alias("n_novel"))


@query(f"with recursive {_ADMITTED} select verdict as reason, count(*) as n from told where verdict <> 'accepted' group by 1")
def scheduler_rejections(spark, sf_dir):
    return research.rejections(_admitted(spark, sf_dir))


_CAND = "select o_orderkey as doc, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey as place, l_quantity as q, l_partkey as p, l_suppkey as s from lineitem join orders on l_orderkey = o_orderkey"


@query(f"""with c as ({_CAND}), k as (select *, row_number() over (partition by doc order by place) as r from c) select doc, cast(place as bigint) as place, case p % 4 when 0 then 'supply' when 1 then 'equity' else 'unclustered' end as relation, case when p % 7 = s % 7 then 1 else 2 end as n_edges from k where r <= 12 and q > 10 and not (p % 7 = s % 7 and s % 5 = 0)""")
def extracted_candidates(spark, sf_dir):
    """Extracted candidates that may stay, with the edges that may."""
    line = table(spark, sf_dir, "lineitem")
    a, b = F.concat(F.lit("n"), (F.col("l_partkey") % 7).cast("string")), F.concat(F.lit(" n"), (F.col("l_suppkey") % 7).cast("string"))
    none = F.lit(None).cast("string")
    edge = lambda x, y: F.struct(x.alias("src"), y.alias("dst"), none.alias("relation"), F.lit("mutual").alias("direction"), F.lit("q").alias("quote"), none.alias("src_kind"), none.alias("dst_kind"))
    edges = F.array(edge(a, b), F.when(F.col("l_suppkey") % 5 == 0, edge(a, F.lit(" "))).otherwise(edge(a, F.lit("x"))), edge(F.lit("y"), F.when((F.col("l_suppkey") % 5 == 0) & (F.col("l_partkey") % 7 != F.col("l_suppkey") % 7), F.lit("z")).otherwise(F.lit("y"))))
    rows = line.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("place"), F.lit("t").alias("title"), F.when(F.col("l_quantity") > 10, "evidence of twenty characters").otherwise("thin").alias("evidence"), F.when(F.col("l_partkey") % 4 == 0, "supply").when(F.col("l_partkey") % 4 == 1, "equity").otherwise("odd").alias("relation"), edges.alias("edges"))
    return signals.extracted(rows).select("doc", F.col("place").cast("long").alias("place"), "relation", F.size("edges").alias("n_edges"))


@query("""with s as (select o_custkey as company, row_number() over (order by o_custkey) as place, ['甲' || o_custkey, '乙', '丙'] as names from (select distinct o_custkey from orders)), x as (select place, company, unnest([0, 1]) as spot, unnest(names[1:2]) as other from s), i as (select * from x order by place, spot limit 14),
 h as (select * from x where company % 2 = 0 order by place, spot limit 10), a as (select 0 as part, 'investor' as kind, * from i union all select 1, 'holder', * from h) select kind, company, other from (select *, row_number() over (partition by company, other order by part, spot) as r from a) where r = 1 order by part, company, spot limit 48""")
def seed_signals(spark, sf_dir):
    """The first signals of a workspace from facts, a quota of each kind: the limits are the feature."""
    base = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company")).distinct().select(F.col("company").alias("place"), "company")
    names = F.array(F.concat(F.lit("甲"), F.col("company").cast("string")), F.lit("乙"), F.lit("丙"))
    parts = [signals.seeds(base, names, "investor", signals.QUOTAS["investor"]), signals.seeds(base.filter("company % 2 = 0"), names, "holder", signals.QUOTAS["holder"])]
    return signals.merged_seeds(parts, F.concat_ws("·", F.col("company").cast("string"), "other"), F.lit("s")).select("kind", "company", "other")


@query(f"""with s as (select o_orderkey, case when o_orderkey % 3 = 0 then null else make_date(2024, cast(o_orderkey % 6 + 1 as int), cast(10 + o_orderkey % 9 as int)) end as event_date from orders) select o_orderkey, event_date from s order by event_date desc nulls last, o_orderkey""")
def event_order(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 3 == 0, "no date, 2099-01-01").otherwise(F.concat(F.lit("on 2024/"), (F.col("o_orderkey") % 6 + 1).cast("string"), F.lit("/1"), (F.col("o_orderkey") % 9).cast("string")))
    return signals.by_event_date(table(spark, sf_dir, "orders").select("o_orderkey"), t, AS_OF, "o_orderkey")


@query("""with s as (select o_orderkey as signal, o_orderpriority as relation, o_orderstatus = 'F' as adm, o_custkey % 90 as p from orders), f as (select l_orderkey as signal, l_returnflag as v, l_partkey % 100 as q from lineitem where l_partkey % 100 >= 60), t as (select relation, count(*) filter (where v = 'A') as confirmed, count(*) filter (where v = 'R') as counter from f join s using (signal) group by 1)
 select relation, count(*) as admitted, round(avg(p), 6) as mean, coalesce(any_value(confirmed), 0) as confirmed, coalesce(any_value(counter), 0) as counter, cast(greatest(0, least(99, floor(avg(p) + 0.5) + 3 * coalesce(any_value(confirmed), 0) - 5 * coalesce(any_value(counter), 0))) as bigint) as confidence from s left join t using (relation) where adm group by 1""")
def relation_summary(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signal"), F.col("o_orderpriority").alias("relation"), (F.col("o_orderstatus") == "F").alias("admitted"), (F.col("o_custkey") % 90).alias("probability"))
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("signal"), F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "counter").otherwise("watching").alias("verdict"), (F.col("l_partkey") % 100).alias("quality"))
    return signals.relation_summary(s, f).withColumn("confidence", F.col("confidence").cast("long"))


@query("select count(*) as n, cast(floor(avg(l_suppkey % 50) + 0.5) as bigint) as mean_brier from lineitem where l_partkey % 100 >= 60 and l_returnflag <> 'N'")
def calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "N", "watching").otherwise("confirmed").alias("verdict"), (F.col("l_partkey") % 100).alias("quality"), (F.col("l_suppkey") % 50).alias("brier"))
    return signals.calibration(rows)


_STARS = "select case when p_size % 6 = 0 then null else p_size % 6 end as stars, p_partkey % 4 > 0 as ev, case p_partkey % 3 when 0 then 'independent' when 1 then 'related' else 'unknown' end as kind, p_brand as channel from part"


def _starred(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 6 != 0, F.col("p_size") % 6).cast("long").alias("stars"), (F.col("p_partkey") % 4 > 0).alias("has_evidence"), F.element_at(F.array(*map(F.lit, ("independent", "related", "unknown"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("source_kind"), F.col("p_brand").alias("channel"))


@query(f"with s as ({_STARS}) select cast(stars as bigint) as stars, count(*) as n, count(*) filter (where ev and kind <> 'unknown') as salvageable, round(count(*) filter (where ev and kind <> 'unknown') / count(*), 6) as rate, count(*) filter (where kind = 'independent') as independent from s group by 1")
def salvage_table(spark, sf_dir):
    return signals.salvage_table(_starred(spark, sf_dir))


@query(f"with s as ({_STARS}) select channel, count(*) as cards, count(*) filter (where kind = 'independent') as independent, count(*) filter (where kind = 'related') as related, count(*) filter (where kind = 'unknown') as unknown, round(count(*) filter (where kind = 'independent') / count(*), 6) as rate from s where ev group by 1")
def channel_table(spark, sf_dir):
    return signals.channel_table(_starred(spark, sf_dir))


@query("""with a as (select o_custkey as company, max(o_orderkey) as f, min(o_orderkey) as place from orders where o_orderdate < '1995-01-01' group by 1), b as (select o_custkey as company, min(o_orderkey) as f, min(o_orderkey) as place from orders where o_orderdate >= '1995-01-01' group by 1)
 select company, case when b.f is null then 'old' else 'new' end as name, coalesce(case when b.f % 2 = 0 then 'n' end, case when a.f is not null then 'o' end) as ticker, case when a.f is not null and (b.f is null or b.f % 3 = 0) then a.f else b.f end as filing from a full join b using (company)""")
def merged_filings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderdate < '1995-01-01'").groupBy(F.col("o_custkey").alias("company")).agg(F.min("o_orderkey").alias("place"), F.max("o_orderkey").alias("filing")).select("company", "place", F.lit("old").alias("name"), F.lit("o").alias("ticker"), "filing", F.lit(False).alias("keep_filing"))
    new = o.filter("o_orderdate >= '1995-01-01'").groupBy(F.col("o_custkey").alias("company")).agg(F.min("o_orderkey").alias("place"), F.min("o_orderkey").alias("filing")).select("company", "place", F.lit("new").alias("name"), F.when(F.col("filing") % 2 == 0, "n").alias("ticker"), "filing", (F.col("filing") % 3 == 0).alias("keep_filing"))
    return signals.merged_filings(old, new).select("company", "name", "ticker", "filing")


@query("""with x as (select l_orderkey as company, l_returnflag as dimension, l_linestatus as field, l_partkey as value, case l_suppkey % 4 when 0 then 'statutory' when 1 then 'independent' when 2 then 'self' else 'unverified' end as grade, case l_suppkey % 4 when 0 then 4 when 1 then 3 when 2 then 2 else 1 end as r, (l_linenumber, l_partkey, l_suppkey) as n, l_linenumber as ln from lineitem),
 o as (select company, dimension, field, arg_min(value, n) as value, arg_min(grade, n) as grade, arg_min(r, n) as r from x where ln <= 3 group by all), w as (select company, dimension, field, arg_min(value, n) as value, arg_min(grade, n) as grade, arg_min(r, n) as r from x where ln > 3 group by all)
 select grade, count(*) as n, cast(sum(value) as bigint) as v from (select coalesce(case when w.r is null or o.r > w.r then o.grade end, w.grade) as grade, coalesce(case when w.r is null or o.r > w.r then o.value end, w.value) as value from o full join w using (company, dimension, field)) group by 1""")
def merged_facts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    g = F.element_at(F.array(*map(F.lit, ("statutory", "independent", "self", "unverified"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    n = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    pick = lambda df: df.groupBy(F.col("l_orderkey").alias("company"), F.col("l_returnflag").alias("dimension"), F.col("l_linestatus").alias("field")).agg(F.min_by("l_partkey", n).alias("value"), F.min_by(g, n).alias("grade"))
    out = signals.merged_facts(pick(line.filter("l_linenumber <= 3")), pick(line.filter("l_linenumber > 3")))
    return out.groupBy("grade").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query("select o_orderstatus as why, count(*) as n from orders where (o_orderdate < '1995-01-01' and (o_custkey % 5 = 0 or o_custkey % 3 > 0)) or o_orderdate >= '1998-01-01' group by 1")
def kept_failures(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey").cast("string")).alias("id"), F.lit("n").alias("name"), F.col("o_orderstatus").alias("why"), "o_orderdate")
    touched = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    out = signals.kept_failures(o.filter("o_orderdate < '1995-01-01'").drop("o_orderdate"), o.filter("o_orderdate >= '1998-01-01'").drop("o_orderdate"), touched)
    return out.groupBy("why").agg(F.count("*").alias("n"))


@query("with b as (select coalesce(nullif(c_mktsegment, 'BUILDING'), '未归类') as sector, case when c_nationkey % 3 = 0 then 'label' else 'plan ' || (c_nationkey % 5) end as billing from customer) select coalesce(sector, '*') as sector, coalesce(billing, '*') as billing, count(*) as n from b group by grouping sets ((sector), (billing), (sector, billing))")
def billing_network(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("sector"), F.when(F.col("c_nationkey") % 3 == 0, "label").alias("label"), F.concat(F.lit("plan "), (F.col("c_nationkey") % 5).cast("string"), F.lit(" （by year）")).alias("value"))
    out = signals.billing_network(rows)
    return out.select(F.coalesce("sector", F.lit("*")).alias("sector"), F.coalesce("billing", F.lit("*")).alias("billing"), "n")


@query()
def graph_layout(spark, sf_dir):
    """Places for the nodes of a graph: beyond SQL; tested for determinism, bounds and rows."""
    line = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 97).alias("src"), (F.col("l_partkey") % 97 + F.col("l_suppkey") % 2 * 100).alias("dst")).distinct()
    parts = evidence.components(line, "src", "dst")
    degree = evidence.node_degree(line.select(F.col("src").cast("string"), F.col("dst").cast("string")), "src", "dst").select(F.col("node").cast("long").alias("node"), "degree")
    return signals.layout(degree, line, parts)


_LABELS = "select c_custkey as company, 'billing' as axis, case c_nationkey % 5 when 0 then '项目制' else 'plan ' || (c_nationkey % 4) end as label, 'self' as grade from customer union all select c_custkey, 'stage', case when c_nationkey % 4 = 1 and c_nationkey % 5 > 0 then '天使' when c_custkey % 3 = 0 then 'B 轮' else 'Pre-A' end, 'independent' from customer union all select c_custkey, 'founder', case when c_custkey % 7 > 0 then c_mktsegment end, 'independent' from customer"


def _labels(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    plan = F.when(F.col("c_nationkey") % 5 == 0, "项目制").otherwise(F.concat(F.lit("plan "), (F.col("c_nationkey") % 4).cast("string")))
    stage = F.when((F.col("c_nationkey") % 4 == 1) & (F.col("c_nationkey") % 5 > 0), "天使").when(F.col("c_custkey") % 3 == 0, "B 轮").otherwise("Pre-A")
    cells = F.array(*(F.struct(F.lit(a).alias("axis"), v.alias("label"), F.lit(g).alias("grade")) for a, v, g in (("billing", plan, "self"), ("stage", stage, "independent"), ("founder", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")), "independent"))))
    return c.select(F.col("c_custkey").alias("company"), F.explode(cells).alias("c")).select("company", "c.*")


@query(f"""with l as ({_LABELS}), t as (select b.label as row, s.label as st from l b join l s using (company) where b.axis = 'billing' and s.axis = 'stage'), n as (select row, count(*) as total, count(*) filter (where st in ('天使', 'Pre-A')) as early, count(*) filter (where st = 'B 轮') as late from t group by 1 having count(*) >= 5)
 select *, late = 0 and early >= 5 as stalled from n where (select count(*) from n) >= 2 and (select count(*) from n where late = 0 and early >= 5) > 0 and (late > 0 or early >= 5)""")
def stalled_pattern(spark, sf_dir):
    return findings.stalled(_labels(spark, sf_dir))


@query(f"""with l as ({_LABELS}), t as (select f.label as row, b.label = '项目制' as hit from l f join l b using (company) where f.axis = 'founder' and b.axis = 'billing' and f.label is not null), n as (select row, count(*) as n, count(*) filter (where hit) / count(*) as share from t group by 1 having count(*) >= 5)
 select count(*) as groups, cast(sum(n) as bigint) as judged, (select count(*) from l where axis = 'founder' and label is not null) as labelled, arg_min(row, (-share, -n, row)) as high_group, round(max(share), 6) as high, arg_min(row, (share, n, row)) as low_group, round(min(share), 6) as low, round(max(share) - min(share), 6) as spread, 'internal' as confidence from n having count(*) >= 2""")
def origin_path(spark, sf_dir):
    """The spread of project billing by founders' origin; the threshold is taken off, as the test table has none so large."""
    return findings.origin_path(_labels(spark, sf_dir), least=0.0)


_SPEC = (("identity", "c_mktsegment"), ("activity", "low"), ("activity", "never"))


@query("with f as (select 'identity' as dimension, 'c_mktsegment' as field, count(distinct c_custkey) as filled from customer union all select 'activity', 'low', count(distinct c_custkey) from customer where c_acctbal < -800 union all select 'activity', 'never', 0), t as (select count(*) as companies from customer) select dimension, field, filled, companies, case when filled = 0 then 'empty' else 'thin' end as kind from f, t where filled / companies < 0.05")
def blind_spots(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cells = F.filter(F.array(F.struct(F.lit("identity").alias("dimension"), F.lit("c_mktsegment").alias("field"), F.lit(True).alias("on")), F.struct(F.lit("activity").alias("dimension"), F.lit("low").alias("field"), (F.col("c_acctbal") < -800).alias("on"))), lambda x: x["on"])
    facts = c.select(F.col("c_custkey").alias("company"), F.explode(cells).alias("x")).select("company", "x.dimension", "x.field")
    return findings.blind_spots(facts, spark.createDataFrame(list(_SPEC), "dimension string, field string"), c.select(F.col("c_custkey").alias("company")))


@query("select count(*) as companies, count(*) filter (where c_nationkey % 3 > 0) as unclear, count(*) filter (where c_nationkey % 3 = 0) as judged, round(count(*) filter (where c_nationkey % 3 > 0) / count(*), 6) as share from customer having count(*) filter (where c_nationkey % 3 > 0) / count(*) >= 0.5")
def relevance_progress(spark, sf_dir):
    return findings.relevance_progress(table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 3 > 0, "unclear").otherwise("vendor").alias("relevance")))


@query("select c_mktsegment as value, count(*) as n, case when count(*) filter (where c_nationkey = 3) > 0 then 'lead' when count(*) filter (where c_nationkey % 2 = 0) > 0 then 'internal' else 'public' end as confidence from customer where c_mktsegment <> '' group by 1")
def label_buckets(spark, sf_dir):
    g = F.when(F.col("c_nationkey") == 3, "unverified").when(F.col("c_nationkey") % 2 == 0, "self").otherwise("statutory")
    out = findings.buckets(table(spark, sf_dir, "customer").select("c_mktsegment", g.alias("g")), "c_mktsegment", "g")
    return out.select("value", "n", findings.confidence(F.col("grades")).alias("confidence"))


@query("select c_mktsegment, c_nationkey % 3 as k, count(*) as n from customer group by all")
def field_bars(spark, sf_dir):
    return findings.bars(table(spark, sf_dir, "customer").select("c_mktsegment", (F.col("c_nationkey") % 3).alias("k")), "c_mktsegment", "k")


@query(f"""with l as ({_LABELS}), s as (select label as claim from l where axis = 'billing' group by 1 having count(*) >= 5) select 'buckets' as kind, 'companies' as scope, claim, 0 as part from s union all select 'progress', 'corpus', 'unclear ' || count(*) filter (where c_nationkey % 3 > 0), 1 from customer""")
def assembled_findings(spark, sf_dir):
    b = findings.buckets(_labels(spark, sf_dir).filter("axis = 'billing'"), "label", "grade").filter("n >= 5").select(F.col("value").alias("claim"))
    p = relevance_progress(spark, sf_dir).select(F.concat(F.lit("unclear "), F.col("unclear").cast("string")).alias("claim"))
    return findings.assembled([("buckets", "companies", b), ("progress", "corpus", p)])


@query("with e as (select s_suppkey as source, s_nationkey + 100 as target from supplier union all select c_custkey + 10000, c_nationkey + 100 from customer), d as (select target as hub, count(*) as degree from e group by 1 having count(*) >= 2), t as (select * from d order by degree desc, hub limit 8) select hub, degree, count(distinct case when source >= 10000 then source end) as companies from t join e on target = hub group by 1, 2")
def hub_companies(spark, sf_dir):
    """The eight best connected nodes and the companies they tie together: the number is the feature."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    told = s.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("nation")).union(c.select(F.col("c_custkey") + 10000, "c_nationkey"))
    links = told.select((F.col("source") * 2).alias("source"), ((F.col("nation") + 100).cast("long") * 2 + 1).alias("target"))  # even: who links, odd: tags
    who = links.select(F.col("source").alias("id"), F.when(F.col("source") >= 20000, "company").otherwise("investor").alias("type"))
    nodes = who.union(links.select("target", F.lit("tag"))).distinct()
    out = evidence.hubs(nodes, links.union(spark.createDataFrame([(-1, -2)], links.schema)), kind="tag").withColumn("hub", F.expr("(hub - 1) div 2"))
    return out.select("hub", "degree", F.coalesce(F.size("companies"), F.lit(0)).cast("long").alias("companies"))


_EDGE = "select row_number() over () as seq, l_orderkey as signal, case l_linenumber % 4 when 0 then 'person-person' when 1 then 'person-org' else null end as kind, ' Firm ' || (l_suppkey % 30) as f, case when l_partkey % 9 = 0 then '' else 'FIRM  ' || (l_partkey % 40) end as t, case l_partkey % 6 when 0 then 'odd' when 1 then 'equity' when 2 then 'supply' when 3 then 'compete' when 4 then 'personnel' else 'license' end as relation from lineitem"
_PLACED = f"""e as ({_EDGE}), x as (select signal, relation, unnest(case when kind = 'person-org' then [t] else [f, t] end) as name from e where coalesce(kind, '') <> 'person-person' and relation <> 'odd'), m as (select signal, relation, lower(trim(regexp_replace(name, ' +', ' ', 'g'))) as org from x where trim(name) <> ''), p as (select * from m where org not in ('firm 3', 'firm 7'))"""


def _placed(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 4 == 0, "person-person").when(F.col("l_linenumber") % 4 == 1, "person-org")
    relation = F.element_at(F.array(*map(F.lit, ("odd", "equity", "supply", "compete", "personnel", "license"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    edges = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("signal"), kind.alias("kind"), F.concat(F.lit(" Firm "), (F.col("l_suppkey") % 30).cast("string")).alias("from_node"), F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("FIRM  "), (F.col("l_partkey") % 40).cast("string"))).alias("to_node"), relation.alias("relation"))
    return evidence.market_mentions(edges, spark.createDataFrame([("Ｆirm 3",), (" FIRM 7",), ("",)], "name string"), list(signals.RELATIONS))


_MATERIAL = "lower(o_orderpriority) || (o_custkey % 3)"


@query(f"""with {_PLACED}, o as (select o_orderkey as signal, {_MATERIAL} as mat, o_orderstatus = 'F' as ind, o_custkey % 2 = 0 as adm from orders), c as (select org, relation, count(distinct signal) as signals, count(distinct signal) filter (where adm) as admitted, count(distinct mat) as materials, count(distinct mat) filter (where ind) as heat from p join o using (signal) group by all),
 g as (select distinct org, unnest(['equity', 'supply', 'compete', 'personnel', 'license']) as relation from p), z as (select org, relation, coalesce(signals, 0) as signals, coalesce(admitted, 0) as admitted, coalesce(materials, 0) as materials, coalesce(heat, 0) as heat from g left join c using (org, relation))
 select count(distinct org) as orgs, cast(sum(heat) as bigint) as total_heat, count(*) as cells, count(*) filter (where signals = 0) as unchecked, cast(sum(signals) as bigint) as signals, cast(sum(admitted) as bigint) as admitted, (select count(*) from orders where o_orderkey not in (select signal from p)) as off_map from z""")
def signal_map(spark, sf_dir):
    """The market map from edges of signals, rosters of people aside, and what stands off it."""
    p = _placed(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signal"), evidence.material(F.concat("o_orderpriority", (F.col("o_custkey") % 3).cast("string"))).alias("mat"), (F.col("o_orderstatus") == "F").alias("ind"), (F.col("o_custkey") % 2 == 0).alias("adm"))
    cells = evidence.market_map(p.join(o, "signal"), "org", "relation", "signal", "mat", F.col("ind"), F.col("adm"), list(signals.RELATIONS))
    sums = cells.agg(F.sum("signals").alias("signals"), F.sum("admitted").alias("admitted"))
    off = evidence.off_map(o.select("signal"), p).agg(F.count("*").alias("n"))
    return evidence.market_totals(cells).withColumns({"signals": sums.select("signals").scalar(), "admitted": sums.select("admitted").scalar(), "off_map": off.scalar()})


@query("with m as (select l_suppkey, max(date_trunc('month', l_shipdate)) over (partition by l_suppkey) as last, date_trunc('month', l_shipdate) as m, l_orderkey, l_linenumber, nullif(l_discount, 0.09) as r from lineitem), t as (select *, row_number() over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber) as k from m where m = last) select l_suppkey, count(*) as n, max(r) filter (where k = 1) as top1, round(sum(r) filter (where k <= 10), 4) as top_sum from t group by 1 having count(*) filter (where k <= 10 and r is null) = 0")
def holder_concentration(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumns({"m": F.date_trunc("month", "l_shipdate"), "rank": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "r": F.nullif("l_discount", F.lit(0.09))})
    return statistics.holder_concentration(statistics.latest_period(line, "l_suppkey", "m", "rank", top=1 << 30), "l_suppkey", "rank", "r")


@query("select p_partkey, case when p_size % 4 = 0 then '' else p_name end as name, p_size % 4 = 0 or p_size % 4 = 1 as breach from part")
def page_limits(spark, sf_dir):
    """Chapters that go beyond their limits of characters or sentences."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "汉字汉字汉").when(F.col("p_size") % 4 == 1, "一。二！").otherwise("一。").alias("bio"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")).alias("name"))
    bad = text.limit_breaches(rows.withColumn("intro", F.col("bio")), {"bio": ("characters", 4), "intro": ("sentences", 1)}).select("p_partkey").distinct().withColumn("breach", F.lit(True))
    return rows.select("p_partkey", "name").join(bad, "p_partkey", "left").na.fill(False, ["breach"])


@query("select user_id, max(cast(ts as date)) as as_of from events where ts < timestamp '2024-01-20' group by 1")
def latest_report_before(spark, sf_dir):
    """Each key's latest snapshot older than a day, as a report is compared with."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("as_of")).distinct()
    return latest_before(e, "user_id", "as_of", "2024-01-20")


