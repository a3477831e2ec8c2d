"""Queries over merges, upserts, differences, provenance and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes
from tessera.plans.registry import query
from tessera.sources.tables import latest_before, table, valid_items

_NAMES = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders before and after a fixed disturbance."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *_NAMES)
    k = F.col("o_orderkey")
    old = o.filter(k % 11 != 3)
    new = o.filter(k % 13 != 5).withColumn("o_orderstatus", F.when(k % 5 == 0, "P").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(k % 7 == 0, "").otherwise(F.col("o_orderpriority"))).withColumn("o_totalprice", F.when(k % 9 != 0, F.col("o_totalprice")))
    return old, new


_OLD = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, 0 as turn from orders where o_orderkey % 11 <> 3"
_NEW = "select o_orderkey, o_custkey, case when o_orderkey % 5 = 0 then 'P' else o_orderstatus end as o_orderstatus, case when o_orderkey % 9 <> 0 then o_totalprice end as o_totalprice, case when o_orderkey % 7 = 0 then '' else o_orderpriority end as o_orderpriority, 1 as turn from orders where o_orderkey % 13 <> 5"
_ALL = f"({_OLD} union all {_NEW})"
_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_RANK = "case o_orderstatus when 'F' then 3 when 'O' then 2 when 'P' then 1 else 0 end"


def _rank():
    return F.expr(_RANK)


@query(f"select {_COLS} from (select *, row_number() over (partition by o_orderkey order by {_RANK} desc, turn desc) as k from {_ALL}) where k = 1")
def grade_merge(spark, sf_dir):
    return changes.grade_merge(*_states(spark, sf_dir), ["o_orderkey"], _rank())


@query(f"select {_COLS} from (select *, row_number() over (partition by o_orderkey order by turn desc) as k from {_ALL}) where k = 1")
def upsert_last_wins(spark, sf_dir):
    return changes.last_wins(*_states(spark, sf_dir), ["o_orderkey"])


@query(f"select {_COLS} from (select *, row_number() over (partition by o_orderkey order by turn) as k from {_ALL}) where k = 1")
def upsert_first_wins(spark, sf_dir):
    return changes.first_wins(*_states(spark, sf_dir), ["o_orderkey"])


@query(f"select o_orderkey, arg_max(o_custkey, turn) as o_custkey, arg_max(nullif(o_orderstatus, ''), turn) filter (where nullif(o_orderstatus, '') is not null) as o_orderstatus, arg_max(o_totalprice, turn) filter (where o_totalprice is not null) as o_totalprice, arg_max(nullif(o_orderpriority, ''), turn) filter (where nullif(o_orderpriority, '') is not null) as o_orderpriority from {_ALL} group by 1")
def upsert_coalesce(spark, sf_dir):
    return changes.coalesce_upsert(*_states(spark, sf_dir), ["o_orderkey"])


@query(f"with o as ({_OLD}), n as ({_NEW}) select count(*) filter (where o.o_orderkey is null) as inserted, count(*) filter (where o.o_orderkey is not null) as existing from n left join o using (o_orderkey)")
def insert_counts(spark, sf_dir):
    return changes.insert_counts(*_states(spark, sf_dir), ["o_orderkey"])


@query("select source, arg_max(text, (length(text), -doc_id)) as kept, count(*) as seen_count, max(doc_id) as last_seen from documents group by 1")
def longest_text(spark, sf_dir):
    return changes.longest_text(table(spark, sf_dir, "documents"), "source", "text", "doc_id")


_CELL = "".join(f"{' union all ' if i else ''}select o_orderkey, kind, '{c}' as field, cast(o.{c} as varchar) as b, cast(n.{c} as varchar) as a, o.{c} is not distinct from n.{c} as same from j" for i, c in enumerate(("o_orderstatus", "o_orderpriority")))
_DIFF = f"with o as ({_OLD}), n as ({_NEW}), j as (select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, o, n, case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' else 'changed' end as kind from o full join n on o.o_orderkey = n.o_orderkey), c as ({_CELL})"


@query(f"{_DIFF} select o_orderkey, kind, field, b as before, a as after from c where kind = 'changed' and not same union all select o_orderkey, kind, '*', null, null from j where kind <> 'changed'")
def snapshot_diff(spark, sf_dir):
    old, new = _states(spark, sf_dir)
    return changes.snapshot_diff(old, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(f"{_DIFF} select o_orderkey, kind, field, b as before, a as after from c where kind = 'changed' and not same union all select o_orderkey, kind, '*', null, null from j where kind <> 'changed'")
def pruned_snapshot_diff(spark, sf_dir):
    """The same lines from those buckets of orders alone whose sums differ."""
    names = ["o_orderstatus", "o_orderpriority"]
    return changes.snapshot_diff(*changes.pruned(*_states(spark, sf_dir), ["o_orderkey"], names), ["o_orderkey"], names)


def _as_facts(df: DataFrame) -> DataFrame:
    """A customer's facts: for each priority the largest order's price band, graded by status."""
    best = F.max_by(F.struct(F.floor(F.col("o_orderkey") / 100).cast("string").alias("value"), F.col("o_orderstatus").alias("grade")), "o_orderkey")
    rows = df.filter("o_orderpriority <> ''").groupBy(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("field")).agg(best.alias("b"))
    return rows.select("company", "field", "b.value", "b.grade")


_FACT = "select o_custkey as company, o_orderpriority as field, cast(cast(floor(max(o_orderkey) / 100) as bigint) as varchar) as v, arg_max(case o_orderstatus when 'F' then 3 when 'O' then 2 when 'P' then 1 else 0 end, o_orderkey) as r from {} where o_orderpriority <> '' group by 1, 2"


@query(f"""with o as ({_FACT.format(f"({_OLD})")}), n as ({_FACT.format(f"({_NEW})")}), co as (select distinct company from o), cn as (select distinct company from n)
 select company, '*' as field, 'new_company' as change from cn where company not in (from co) union all select company, '*', 'dropped_company' from co where company not in (from cn) union all
 select * from (select coalesce(o.company, n.company) as company, coalesce(o.field, n.field) as field, case when o.r is null then 'filled' when n.r is null then 'emptied' when o.v is distinct from n.v then 'changed' when n.r > o.r then 'upgraded' when n.r < o.r then 'downgraded' end as change
 from o full join n on o.company = n.company and o.field = n.field) where change is not null and company in (from co) and company in (from cn)""")
def profile_diff(spark, sf_dir):
    old, new = changes.pruned(*(_as_facts(x) for x in _states(spark, sf_dir)), ["company"], ["field", "value", "grade"])
    return changes.profile_diff(old, new, F.expr("case grade when 'F' then 3 when 'O' then 2 when 'P' then 1 else 0 end"))


@query("with c as (select l_orderkey, l_linenumber, 'l_returnflag' as field, nullif(l_returnflag, 'N') as v from lineitem union all select l_orderkey, l_linenumber, 'l_linestatus', l_linestatus from lineitem) select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, field, v as value from c where trim(coalesce(v, '')) <> '' and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def missing_source(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    cells = changes.unpivoted(line, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])
    sourced = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return changes.missing_sources(cells, sourced, ["l_orderkey"]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "field", "value")


@query("with o as (select c_custkey as id, c_name as n, 0 as turn from customer union all select s_suppkey, s_name, 1 from supplier union all select p_partkey, p_name, 2 from part) select id, n as name from (select *, row_number() over (partition by id order by turn desc) as k from o) where k = 1")
def union_last(spark, sf_dir):
    frames = [table(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))]
    return changes.union_last(frames, ["id"])


@query("with o as (select o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders where strftime(o_orderdate, '%Y-%m-%d') < '1997-01-01') select o_custkey, o_orderkey, d from o where (o_custkey, d) in (select o_custkey, max(d) from o group by 1)")
def latest_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return latest_before(o, "o_custkey", "d", "1997-01-01").select("o_custkey", "o_orderkey", "d")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, strftime(ts, '%Y-%m-%d') as \"date\" from events where event_type <> 'error'")
def feed_ingest(spark, sf_dir):
    """The events as a feed: nested JSON parsed against a schema, invalid items dropped."""
    e = table(spark, sf_dir, "events")
    items = e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("title"), F.lit("s").alias("summary"), F.when(F.col("event_type") == "error", "ftp://x").otherwise("https://x").alias("url"))
    return valid_items(items).select("event_id", "k", "date")


@query("select count(*) as dependent from lineitem where l_partkey in (select p_partkey from part where p_size <= 10) and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)")
def referential_checks(spark, sf_dir):
    """Semi and anti joins as existence checks."""
    line, part, supp = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    good = line.join(part.filter("p_size <= 10"), line["l_partkey"] == part["p_partkey"], "left_semi").join(supp.filter("s_acctbal < 0"), line["l_suppkey"] == supp["s_suppkey"], "left_anti")
    return good.agg(F.count("*").alias("dependent"))
