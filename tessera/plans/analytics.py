"""Queries over maps, graphs, cross-tabs, coverage, rankings and weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import gates, text
from tessera.operators import evidence, folds, statistics
from tessera.plans.registry import query
from tessera.sources.tables import table

RELATIONS = ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.element_at(F.split("p_type", " "), 1)).alias("relation"))
    return line.join(part, line["l_partkey"] == part["p_partkey"])


_MAP = f"""with m as (select l_suppkey as org, upper(string_split(p_type, ' ')[1]) as relation, l_orderkey, l_partkey, l_returnflag = 'R' as ind, l_linestatus = 'F' as adm from lineitem join part on l_partkey = p_partkey),
 k as (select * from m where relation in ({", ".join(f"'{r}'" for r in RELATIONS)})),
 c as (select org, relation, count(distinct l_orderkey) as signals, count(distinct case when adm then l_orderkey end) as admitted, count(distinct l_partkey) as materials, count(distinct case when ind then l_partkey end) as heat from k group by all),
 g as (select org, unnest([{", ".join(f"'{r}'" for r in RELATIONS)}]) as relation from (select distinct org from k)),
 cells as (select org, relation, coalesce(signals, 0) as signals, coalesce(admitted, 0) as admitted, coalesce(materials, 0) as materials, coalesce(heat, 0) as heat from g left join c using (org, relation))"""
_CELLS = "select *, signals - materials as reprints, case when signals = 0 then 'unchecked' when heat = 0 then 'no-independent' else 'backed' end as state from cells"


def _cells(spark, sf_dir) -> DataFrame:
    return evidence.market_map(_mentions(spark, sf_dir), "l_suppkey", "relation", "l_orderkey", "l_partkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", RELATIONS)


@query(f"{_MAP} {_CELLS}")
def market_map(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"{_MAP} select org, cast(sum(heat) as bigint) as heat, cast(sum(signals) as bigint) as signals, count(*) filter (where signals > 0) as checked from cells group by org")
def market_rows(spark, sf_dir):
    return evidence.market_rows(_cells(spark, sf_dir))


def _trade(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust, supp, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    seller = supp.join(nation, supp["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("seller"))
    buyer = cust.join(nation, cust["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", F.col("n_name").alias("buyer"))
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(seller, F.col("l_suppkey") == seller["s_suppkey"]).join(buyer, F.col("o_custkey") == buyer["c_custkey"])
    return rows.select("seller", "buyer", "l_returnflag", "l_orderkey", F.col("l_quantity").cast("long").alias("gate"), (F.col("l_linestatus") == "F").alias("executable"))


_TRADE = "select s.n_name as seller, b.n_name as buyer, l_returnflag, l_orderkey, cast(l_quantity as bigint) as gate, l_linestatus = 'F' as executable from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation s on s_nationkey = s.n_nationkey join customer on o_custkey = c_custkey join nation b on c_nationkey = b.n_nationkey"


@query(f"with t as ({_TRADE}) select seller as from_node, buyer as to_node, l_returnflag as relation, count(*) as mentions, count(distinct l_orderkey) as signals, list_sum(list(l_orderkey)) as id_sum, max(gate) as best_gate, bool_or(executable) as executable from t group by all")
def edge_aggregate(spark, sf_dir):
    members = evidence.edge_members(_trade(spark, sf_dir), "seller", "buyer", "l_returnflag", "l_orderkey", "gate", "executable")
    return evidence.edge_aggregate(members, F.sum(F.col("signal") * F.col("times")).alias("id_sum"))


@query(f"with t as ({_TRADE}) select seller as from_node, count(distinct l_orderkey + 1) as members from t group by 1")
def seller_signals(spark, sf_dir):
    """Distinct signals of each seller, from the bitmaps of its edges."""
    members = evidence.edge_members(_trade(spark, sf_dir), "seller", "buyer", "l_returnflag", "l_orderkey", "gate", "executable")
    bits = evidence.member_bitmaps(members.withColumn("signal", F.col("signal") + 1), "from_node", "to_node", "relation", member="signal")
    return evidence.bitmap_counts(bits, "from_node")


@query(f"with t as ({_TRADE}) select node, count(*) as degree from (select seller as node from t union all select buyer from t) group by node")
def node_degree(spark, sf_dir):
    return evidence.node_degree(_trade(spark, sf_dir), "seller", "buyer")


def _shared_parts(spark, sf_dir) -> DataFrame:
    """Suppliers that shipped the same part in the same month, each linked to the next by number.

    The chain through a part and month joins the same suppliers as all their pairs would.
    """
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), "l_partkey", "l_shipdate", "l_returnflag")
    w = Window.partitionBy("l_partkey", F.date_trunc("month", "l_shipdate")).orderBy("s", "l_returnflag")
    return line.withColumn("t", F.lead("s").over(w)).filter("t is not null and s <> t").select("s", "t", "l_returnflag")


# A closure in SQL spells out every pair of a component; tests hold the queries against a union-find.
@query()
def components(spark, sf_dir):
    return evidence.components(_shared_parts(spark, sf_dir), "s", "t")


@query()
def cluster_summary(spark, sf_dir):
    e = _shared_parts(spark, sf_dir)
    return evidence.cluster_summary(evidence.components(e, "s", "t"), e, "s", "t", "l_returnflag")


@query(f"with e as (select distinct seller, buyer, l_returnflag from ({_TRADE})) select seller, buyer, l_returnflag, round((row_number() over p - 1 - (count(*) over (partition by least(seller, buyer), greatest(seller, buyer)) - 1) / 2.0) * 0.72, 4) as \"offset\" from e window p as (partition by least(seller, buyer), greatest(seller, buyer) order by seller, buyer, l_returnflag)")
def parallel_offsets(spark, sf_dir):
    return evidence.parallel_offsets(_trade(spark, sf_dir).select("seller", "buyer", "l_returnflag").distinct(), "seller", "buyer", ["seller", "buyer", "l_returnflag"])


_ONE = 777


@query(f"with b as (select distinct l_orderkey from lineitem where l_orderkey < {_ONE} order by 1 desc limit 80) select l_orderkey, count(distinct l_suppkey) as shared from lineitem where l_orderkey in (from b) and l_suppkey in (select l_suppkey from lineitem where l_orderkey = {_ONE}) group by 1")
def run_overlap(spark, sf_dir):
    return evidence.run_overlap(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", _ONE)


_GRAMS = r"list_distinct(list_transform(range(1, length(n)), lambda i: substr(n, i, 2)))"


@query(rf"""with p as (select distinct p_name || ' ' || right(p_brand, 1) as name, lower(regexp_replace(p_name || ' ' || right(p_brand, 1), '[\s\-_]', '', 'g')) as n from part), g as (select name, {_GRAMS} as grams from p),
 s as (select a.name as left_name, b.name as right_name, len(list_intersect(a.grams, b.grams)) as n, len(a.grams) as x, len(b.grams) as y from g a, g b),
 k as (select left_name, right_name, round(n / (x + y - n), 4) as score from s where n > 0 and n >= 0.3 * (x + y - n))
 select * from (select *, row_number() over (partition by left_name order by score desc, right_name) as place from k) where place <= 5""")
def entity_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.right("p_brand", F.lit(1))).alias("name")).distinct().withColumn("grams", text.bigrams(F.col("name")))
    out = evidence.entity_match(names, names)
    return out.withColumn("place", F.col("place").cast("long"))


def _profiles(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return o.join(c, o["o_custkey"] == c["c_custkey"])


_PROF = "select * from orders join customer on o_custkey = c_custkey"


@query(f"with c as (select c_mktsegment as row_label, o_orderpriority as col_label, count(*) as n from ({_PROF}) group by all) select *, cast(sum(n) over (partition by row_label) as bigint) as row_n, cast(sum(n) over (partition by col_label) as bigint) as col_n, cast(sum(n) over () as bigint) as total from c")
def crosstab_segment_priority(spark, sf_dir):
    return statistics.crosstab(_profiles(spark, sf_dir), "c_mktsegment", "o_orderpriority")


@query(f"""with s as (select c_nationkey as g, count(*) as n, count(*) filter (where o_orderpriority = '1-URGENT') as hits from ({_PROF}) group by 1 having count(*) >= 5), t as (select *, hits / n as share from s)
 select count(*) as groups, cast(arg_min(g, (-share, -n, g)) as bigint) as high_group, round(max(share), 6) as high, cast(arg_min(g, (share, n, g)) as bigint) as low_group, round(min(share), 6) as low, round(max(share) - min(share), 6) as spread from t having count(*) >= 3 and max(share) - min(share) >= 0.01""")
def spread(spark, sf_dir):
    out = statistics.spread(_profiles(spark, sf_dir), "c_nationkey", F.col("o_orderpriority") == "1-URGENT", least=0.01)
    return out.withColumns({c: F.col(c).cast("long") for c in ("high_group", "low_group")})


_AXES = ["c_mktsegment", "o_orderpriority", "o_orderstatus"]


def _sweep_sql(axes: list[str], lift: float, least: float) -> str:
    parts = []
    for i, r in enumerate(axes):
        for j, c in enumerate(axes):
            if r != c:
                parts.append(f"""select * from (with x as (select {r} as r, {c} as c, count(*) as n from ({_PROF}) group by all), k as (select *, sum(n) over (partition by r) as rn from x), kk as (select * from k where rn >= 8),
 g as (select count(*) as groups, sum(rn) as total from (select distinct r, rn from kk)), b as (select c, sum(n) as cn, max(n / rn) as high, min(n / rn) as low_, count(*) as k from kk group by c),
 f as (select c, groups, cn / total as baseline, high, case when k < groups then 0 else low_ end as low from b, g where groups >= 3 and cn >= 8)
 select '{r}' as row_axis, '{c}' as col_axis, {i * len(axes) + j} as at, {j * len(axes) + i} as back, c as col_label, groups, baseline, high, low from f where high - baseline >= {lift} and high - low >= {least} order by high - low desc, c limit 1)""")
    return f"""with found as ({" union all ".join(parts)}) select row_axis, col_axis, col_label, groups, round(baseline, 6) as baseline, round(high, 6) as high, round(low, 6) as low, round(high - baseline, 6) as lift, round(high - low, 6) as spread
 from found f where not exists (select 1 from found g where g.at = f.back and g.at < f.at)"""


@query(_sweep_sql(_AXES, 0.0, 0.001))
def sweep(spark, sf_dir):
    return statistics.sweep(_profiles(spark, sf_dir), _AXES, lift=0.0, least=0.001)


@query("with n as (select c_mktsegment as v, count(*) as n from customer group by 1) select arg_min(v, (-n, v)) as top_value, max(n) as n, cast(sum(n) as bigint) as total, round(max(n) / sum(n), 6) as share from n having max(n) / sum(n) >= 0.2 and sum(n) >= 8")
def concentration(spark, sf_dir):
    return statistics.concentration(table(spark, sf_dir, "customer"), "c_mktsegment", least=0.2)


def _order_counts(spark, sf_dir) -> DataFrame:
    return _profiles(spark, sf_dir).groupBy("c_custkey", "c_mktsegment").agg(F.count("*").alias("filled"))


_COUNTS = f"select c_custkey, c_mktsegment, count(*) as filled from ({_PROF}) group by all"


@query(f"with c as ({_COUNTS}) select round(avg(filled) filter (where c_mktsegment = 'BUILDING'), 6) as listed_mean, round(avg(filled) filter (where c_mktsegment <> 'BUILDING'), 6) as private_mean, count(*) filter (where c_mktsegment = 'BUILDING') as n_listed, count(*) filter (where c_mktsegment <> 'BUILDING') as n_private, round(avg(filled) filter (where c_mktsegment = 'BUILDING') / avg(filled) filter (where c_mktsegment <> 'BUILDING'), 6) as ratio from c")
def visibility_gap(spark, sf_dir):
    return statistics.visibility_gap(_order_counts(spark, sf_dir), F.col("c_mktsegment") == "BUILDING", "filled", ratio=0.1)


@query(f"with c as ({_COUNTS}) select c_custkey, filled, round(filled / (select avg(filled) from c), 6) as times from c where filled >= 1.5 * (select avg(filled) from c) and filled >= 6 order by filled desc, c_custkey limit 5")
def outliers(spark, sf_dir):
    return statistics.outliers(_order_counts(spark, sf_dir).select("c_custkey", "filled"), "c_custkey", "filled", times=1.5)


_SPEC = (("identity", "c_mktsegment"), ("identity", "o_orderstatus"), ("activity", "o_orderpriority"), ("activity", "o_totalprice"), ("activity", "never"))


def _facts(spark, sf_dir) -> DataFrame:
    cells = [F.struct(F.lit(d).alias("dimension"), F.lit(n).alias("field"), (F.nullif(F.col(n).cast("string"), F.lit("5-LOW")) if n != "never" else F.lit(None).cast("string")).alias("value")) for d, n in _SPEC]
    rows = _profiles(spark, sf_dir).select(F.col("c_custkey").alias("company"), F.when(F.col("o_orderstatus") == "P", "unverified").when(F.col("o_orderstatus") == "F", "statutory").otherwise("self").alias("grade"), F.explode(F.array(*cells)).alias("cell"))
    return rows.select("company", "grade", "cell.*").filter("value is not null")


_FACTS = f"""select c_custkey as company, case o_orderstatus when 'P' then 'unverified' when 'F' then 'statutory' else 'self' end as grade, d.dimension, d.field, case d.field when 'c_mktsegment' then c_mktsegment when 'o_orderstatus' then o_orderstatus when 'o_orderpriority' then nullif(o_orderpriority, '5-LOW') when 'o_totalprice' then cast(o_totalprice as varchar) end as value
 from ({_PROF}), (values {", ".join(f"('{d}', '{n}')" for d, n in _SPEC)}) d(dimension, field)"""


@query(f"with f as (select * from ({_FACTS}) where value is not null) select company, count(distinct field) filter (where grade <> 'unverified') as filled, count(distinct field) as with_unverified, 5 as total, round(count(distinct field) filter (where grade <> 'unverified') / 5, 6) as coverage from f group by company")
def coverage(spark, sf_dir):
    spec = spark.createDataFrame(list(_SPEC), "dimension string, field string")
    return statistics.coverage(_facts(spark, sf_dir), spec, "company")


@query(f"with f as (select * from ({_FACTS}) where value is not null) select dimension, field, count(*) as n, count(*) filter (where grade <> 'unverified') as verified from f group by rollup (dimension, field)")
def coverage_matrix(spark, sf_dir):
    return statistics.coverage_matrix(_facts(spark, sf_dir))


_SCORES = f"select c_custkey, case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end as tier, sum(case o_orderstatus when 'F' then 5 when 'O' then 3 else 0 end) as score from ({_PROF}) group by all"


def _ranked(spark, sf_dir) -> DataFrame:
    tier = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    score = F.sum(F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 3).otherwise(0))
    return _profiles(spark, sf_dir).groupBy("c_custkey", tier.alias("tier")).agg(score.alias("score"))


@query(f"with s as ({_SCORES}) select c_custkey, cast(tier as bigint) as tier, cast(score as bigint) as score from s order by tier, score desc, c_custkey limit 100")
def rank_profiles(spark, sf_dir):
    """A report of the first hundred: the limit is the feature."""
    return _ranked(spark, sf_dir).orderBy("tier", F.desc("score"), "c_custkey").limit(100).select("c_custkey", F.col("tier").cast("long").alias("tier"), "score")


@query(f"""with s as ({_SCORES}), g as (select distinct company, field from ({_FACTS}) where value is null), r as (select c_custkey, row_number() over (order by tier, score desc, c_custkey) as rk from s),
 x as (select company, field, rk, row_number() over (partition by company order by field) as round from g join r on company = c_custkey) select company, field, round from x where round <= 4 order by round, rk, company limit 200""")
def gap_round_robin(spark, sf_dir):
    """A work list of at most 200 gaps: the limit is the feature."""
    r = _ranked(spark, sf_dir)
    all_fields = _profiles(spark, sf_dir).select(F.col("c_custkey").alias("company"), F.explode(F.array(*(F.struct(F.lit(n).alias("field"), (F.nullif(F.col(n).cast("string"), F.lit("5-LOW")) if n != "never" else F.lit(None).cast("string")).alias("value")) for _, n in _SPEC))).alias("c"))
    gaps = all_fields.filter("c.value is null").select("company", "c.field").distinct()
    order = F.struct("tier", -F.col("score"), F.col("c_custkey")).alias("rk")
    out = statistics.gap_round_robin(gaps.join(r.select(F.col("c_custkey").alias("company"), order), "company"), "company", "rk", "field")
    return out.select("company", "field", F.col("round").cast("long").alias("round"))


@query("with m as (select *, max(date_trunc('month', l_shipdate)) over (partition by l_suppkey) as last from lineitem), t as (select l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as place from m where date_trunc('month', l_shipdate) = last) select l_suppkey, l_orderkey, cast(l_linenumber as bigint) as l_linenumber, place from t where place <= 10")
def latest_period_top10(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("m", F.date_trunc("month", "l_shipdate")).withColumn("rank", F.struct(-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")))
    out = statistics.latest_period(line, "l_suppkey", "m", "rank")
    return out.select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("place").cast("long").alias("place"))


@query("select l_suppkey, count(*) as seats, case when count(nullif(l_tax, 0.08)) = count(*) then round(sum(l_tax), 4) end as tax_sum, round(sum(l_discount), 4) as discount_sum from lineitem group by 1")
def all_or_null_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("seats"), statistics.all_or_null_sum(F.nullif("l_tax", F.lit(0.08))).alias("tax_sum"), statistics.all_or_null_sum(F.col("l_discount")).alias("discount_sum"))


_WEEKS = "select user_id, cast(date_trunc('week', ts + interval 8 hours) as date) as week, count(*) as n from events group by all"


def _weeks(spark, sf_dir) -> DataFrame:
    return statistics.week_counts(table(spark, sf_dir, "events"), "user_id", "ts")


@query(_WEEKS)
def weekly_counts(spark, sf_dir):
    return _weeks(spark, sf_dir)


@query(f"""with w as ({_WEEKS}), g as (select *, row_number() over (partition by user_id order by week) as k from w where n >= 3), i as (select *, week - cast(7 * k as int) as island from g), r as (select *, row_number() over (partition by user_id, island order by week) as run from i),
 f as (select user_id, max(run) as longest, min(case when run = 4 then week end) as accepted_at from r group by 1) select user_id, coalesce(longest, 0) as longest, accepted_at from (select distinct user_id from w) left join f using (user_id)""")
def week_streak(spark, sf_dir):
    return statistics.week_streak(_weeks(spark, sf_dir), "user_id").withColumn("longest", F.col("longest").cast("long"))


@query("select c_custkey, max(o_orderdate) as last_order from customer left join orders on o_custkey = c_custkey group by 1, c_mktsegment order by 2 asc nulls first, c_mktsegment = 'BUILDING' desc, 1 limit 20")
def next_batch(spark, sf_dir):
    """The next twenty to look at: never searched first, then the oldest. The limit is the feature."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey", "c_mktsegment").agg(F.max("o_orderdate").alias("last_order"))
    return rows.orderBy(F.col("last_order").asc_nulls_first(), (F.col("c_mktsegment") == "BUILDING").desc(), "c_custkey").limit(20).select("c_custkey", "last_order")


@query(f"with e as (select distinct seller, buyer, l_returnflag from ({_TRADE})), m as (select l_returnflag, count(*) as n, round(avg(gate), 6) as mean from ({_TRADE}) group by 1) select l_returnflag, n, cast(greatest(0, least(99, floor(mean + 0.5) + 3 * (n % 7) - 5 * (n % 3))) as bigint) as confidence from m")
def relation_confidence(spark, sf_dir):
    m = _trade(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("gate"), 6).alias("mean"))
    return m.select("l_returnflag", "n", gates.relation_confidence(F.col("mean"), F.col("n") % 7, F.col("n") % 3).cast("long").alias("confidence"))


@query("select o_orderpriority, count(*) as total, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by 1")
def pivot_status(spark, sf_dir):
    """Counts by two labels, rows and columns in the order of their totals."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    out = statistics.pivot_table(o, "o_orderpriority", "o_orderstatus", statistics.column_order(o, "o_orderstatus"))
    return out.select("o_orderpriority", "total", *(F.col(c).alias(c.lower()) for c in "FOP"))


@query("with g as (select coalesce(o_orderstatus, '*') as s, coalesce(o_orderpriority, '*') as p, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))) select * from g")
def grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    out = rows.groupingSets([["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("o_orderstatus", F.lit("*")).alias("s"), F.coalesce("o_orderpriority", F.lit("*")).alias("p"), "n")


@query("""with recursive e as (select user_id, event_id, json_extract_string(props, '$.k') as edge, row_number() over (partition by user_id order by -value, event_id) as k from events),
 r as (select user_id, cast(0 as bigint) as k, cast(null as bigint) as event_id, '' as verdict, 0 as taken, 0 as used, cast([] as varchar[]) as known from (select distinct user_id from events) union all
  select user_id, k, event_id, verdict, taken + cast(verdict = 'accepted' as int), used + cast(verdict = 'accepted' as int), case when verdict = 'accepted' then list_append(known, edge) else known end
  from (select e.user_id, e.k, e.event_id, e.edge, r.taken, r.used, r.known, case when e.edge is null or list_contains(r.known, e.edge) then 'no-novel-edge' when r.taken + 1 > 4 or r.used + 1 > 6 then 'capacity' else 'accepted' end as verdict from r join e on e.user_id = r.user_id and e.k = r.k + 1))
 select user_id, event_id, verdict from r where k > 0""")
def greedy_admission(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("edge"), (-F.col("value")).alias("rank"))
    return folds.greedy_admission(rows, "user_id", "event_id", "edge", ["rank", "event_id"])


_HELD = "greatest(12, least(40, r.w{0} + e.way * (e.s{0} - (e.s1 + e.s2 + e.s3 + e.s4) / 4) * 0.08))"
_NEXT = ", ".join(f"case when e.way = 0 then r.w{k} else floor({_HELD.format(k)} / ({' + '.join(_HELD.format(j) for j in range(1, 5))}) * 100 + 0.5) end" for k in range(1, 5))


@query(f"""with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as k, case when event_id % 100 < 60 then 0 when event_type = 'purchase' then 1 when event_type = 'error' then -1 else 0 end as way, {", ".join(f"cast(event_id * {k} % 60 + 35 as double) as s{k}" for k in range(1, 5))} from events),
 r as (select user_id, cast(0 as bigint) as k, cast(30 as double) as w1, cast(25 as double) as w2, cast(25 as double) as w3, cast(20 as double) as w4 from (select distinct user_id from events) union all select r.user_id, r.k + 1, {_NEXT} from r join e on e.user_id = r.user_id and e.k = r.k + 1)
 select user_id, max(k) as n, {", ".join(f"arg_max(w{k}, k) as w{k}" for k in range(1, 5))} from r group by 1""")
def weight_replay(spark, sf_dir):
    """A fold over each user's outcomes."""
    e = table(spark, sf_dir, "events")
    scores = F.array(*(F.pmod(F.col("event_id") * (k + 1), F.lit(60)).cast("double") + 35 for k in range(4)))
    rows = e.select("user_id", "event_id", F.expr("case event_type when 'purchase' then 'confirmed' when 'error' then 'counter' else 'watching' end").alias("verdict"), (F.col("event_id") % 100).alias("quality"), scores.alias("scores"))
    out = folds.weight_replay(rows, "user_id", "event_id", "verdict", "quality", "scores", [30, 25, 25, 20])
    return out.select("user_id", "n", *(F.get("weights", F.lit(k)).alias(f"w{k + 1}") for k in range(4)))
