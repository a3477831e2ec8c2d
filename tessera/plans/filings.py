"""Queries over the text of filings: pages, labels, key figures, holders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import filings as G
from tessera.functions import holders, text
from tessera.operators import filings
from tessera.plans.registry import query
from tessera.sources.tables import paged, table

#: A page's HTML with scripts, numbered entities and runs of blanks. Both dialects read these texts.
_HTML = "concat('<script>x', cast(page_id as string), '</script>', html, '<p>caf&#233; &#x41;&nbsp;&amp; ', cast(page_id as string), '</p>', chr(10), chr(10), chr(10), chr(10), 'end  ')"


@query(rf"""with a as (select page_id, regexp_replace({_HTML}, '(?is)<script[^>]*>.*?</script>', ' ', 'g') as t from pages), a2 as (select page_id, regexp_replace(t, '(?is)<style[^>]*>.*?</style>', ' ', 'g') as t from a), b as (select page_id, regexp_replace(t, '<[^>]+>', ' ', 'g') as t from a2),
 c as (select page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#233;', 'é'), '&#x41;', 'A') as t from b)
 select page_id, length(trim(regexp_replace(regexp_replace(t, '[ \t\x{{A0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) as n, regexp_extract(t, '(caf. A. . \d+)', 1) as said from c where not regexp_matches(t, '&#')""")
def filing_plain(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", G.filing_plain(F.expr(_HTML)).alias("t"))
    rows = rows.filter(~F.col("t").contains("&#"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.regexp_extract("t", r"(caf. A. . \d+)", 1).alias("said")).filter("said <> ''").unionByName(rows.filter(F.regexp_extract("t", r"(caf. A. . \d+)", 1) == "").select("page_id", F.length("t").cast("long").alias("n"), F.lit("").alias("said")))


#: An annual report's pages: business lines, key figures, careers and passages, some of them missing or split.
_REPORT = "concat('封面', chr(10), '1', chr(12), '数字成本业务 ', repeat('文', cast(o_custkey % 300 as int)), '营业收入 ', cast(o_orderkey as string), '.5 亿元，同比', case when o_orderkey % 2 = 0 then '下降' else '增长' end, ' 3.', cast(o_custkey % 9 as string), '%', chr(10), '海外业务营业收入 7 亿元同比增长1%', chr(12), '主要会计数据和财务指标 营业收入（元） 1,', lpad(cast(o_custkey % 1000 as string), 3, '0'), ' 2,000  -3.1% 3,', lpad(cast(o_orderkey % 1000 as string), 3, '0'), chr(10), '7', chr(12), '数字成本业务营业收入 9 亿元同比增长9% 公司研发投入情况 研发投入金额（元） ', cast(o_custkey as string), ' 12', chr(12), '王小明先生：历任工程师。', repeat('曾任经理', cast(o_custkey % 3 as int)), '。现任本公司董事', cast(o_orderkey % 5 as string), '。')"
_PAGES = rf"p as (select o_orderkey as doc_id, unnest(list_filter(list_transform(string_split({_REPORT}, chr(12)), lambda v: trim(v)), lambda v: v <> '')) as text, unnest(range(1, 6)) as seq from orders), n as (select doc_id, seq, cast(coalesce(nullif(regexp_extract(text, '(?:^|\n)\s*(\d{{1,4}})\s*$', 1), ''), cast(seq as varchar)) as bigint) as page_no, text, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from p)"


def _pages(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(paged(F.expr(_REPORT))).alias("seq", "p"))
    return rows.select("doc_id", "seq", F.col("p.page_no").cast("long").alias("page_no"), "p.text")


_COST = r"数字成本业务[\s\S]{0,260}?营业收入\s*([\d,.]+)\s*亿元[\s\S]{0,50}?同比(下降|增长)\s*([\d.]+)%"
_SEA = r"海外业务[\s\S]{0,180}?营业收入\s*([\d,.]+)\s*亿元[\s\S]{0,50}?同比(下降|增长)\s*([\d.]+)%"


@query(rf"""with {_PAGES}, x as (select doc_id, seq, page_no, '数字成本' as name, regexp_extract(text, '{_COST}', ['r', 'w', 'b']) as m from n where regexp_matches(text, '{_COST}') union all select doc_id, seq, page_no, '海外', regexp_extract(text, '{_SEA}', ['r', 'w', 'b']) from n where regexp_matches(text, '{_SEA}')),
 f as (select doc_id, name, arg_min(page_no, seq) as page_no, arg_min(m, seq) as m from x group by 1, 2) select doc_id, name, page_no, m.r as revenue, case when m.w = '下降' then '-' else '+' end || m.b || '%' as change from f""")
def business_lines(spark, sf_dir):
    return filings.business_lines(_pages(spark, sf_dir)).drop("excerpt")


_REV = r"营业收入（元）\s*([\d,.]+)\s+([\d,.]+)\s+[+-]?[\d.]+%\s+([\d,.]+)"
_RND = r"研发投入金额（元）\s*([\d,.]+)\s+([\d,.]+)"


@query(rf"""with {_PAGES}, x as (select doc_id, page_no, 'revenue' as measure, unnest([0, 1, 2]) as k, unnest([regexp_extract(flat, '{_REV}', 1), regexp_extract(flat, '{_REV}', 2), regexp_extract(flat, '{_REV}', 3)]) as v from n where contains(text, '主要会计数据和财务指标') union all
 select doc_id, page_no, 'rnd_expense', unnest([0, 1]), unnest([regexp_extract(flat, '{_RND}', 1), regexp_extract(flat, '{_RND}', 2)]) from n where contains(text, '公司研发投入情况')) select doc_id, cast(2025 - k as bigint) as year, measure, page_no, cast(replace(v, ',', '') as double) as value from x where v <> ''""")
def financial_years(spark, sf_dir):
    return filings.financial_years(_pages(spark, sf_dir), F.lit(2025)).drop("excerpt").withColumn("year", F.col("year").cast("long"))


@query("select o_orderkey as doc_id, '王小明' as name, '董事' || (o_orderkey % 5) as title, case when o_custkey % 3 = 0 then '历任工程师' else repeat('曾任经理', cast(o_custkey % 3 as int)) end as bio from orders")
def careers(spark, sf_dir):
    return filings.careers(_pages(spark, sf_dir)).select("doc_id", "name", "title", "bio")


@query(rf"""with {_PAGES}, c as (select distinct doc_id, page_no from n where contains(text, '海外业务') or contains(text, '先生：')), t as (select doc_id, page_no, arg_min(text, seq) as text from n group by 1, 2) select doc_id, page_no, 'https://f.org/' || doc_id || '#page=' || page_no as url, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as fingerprint from t join c using (doc_id, page_no)""")
def page_sources(spark, sf_dir):
    """One source for each page that a fact cites."""
    pages = _pages(spark, sf_dir)
    cited = filings.business_lines(pages).filter("name = '海外'").select("doc_id", "page_no").union(filings.careers(pages).select("doc_id", "page_no"))
    origin = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("https://f.org/"), F.col("o_orderkey").cast("string")).alias("url"), F.lit("2026-03-01").alias("published_at"))
    return filings.page_sources(cited, pages, origin).select("doc_id", "page_no", "url", "fingerprint")


#: Pages that tell of products, steps and systems, some of them in part, and a glossary. Both dialects read them.
_TOLD = "concat('封面', chr(12), case when c_custkey % 3 = 0 then '见 CDE 数据集成环境、下文 AI 清标、AI 编标、AI 评标' else concat('CDE 数据 集成环境，GDE 与 ECS 数据', repeat(' ', cast(c_custkey % 4 as int)), '转换环境 AECOS 产业业务平台', repeat('文', cast(c_custkey % 300 as int)), '柔性数据标准体系') end, chr(12), 'AecGPT 建筑产业大模型', repeat('述', cast(c_custkey % 210 as int)), '七大领域 AI 算量', repeat('与', cast(c_custkey % 130 as int)), 'AI 评标 STL 组织模式', case when c_custkey % 4 = 0 then '（三级）' else '' end, ' 工程算量、工程计价、工程数据、工程成本等产品', chr(12), '数字施工业务包括企业级管理软件以及项目级管理软件', chr(10), '项目综合决策、物料管理、劳务管理、安全管理、智能塔机 数字设计业务含数维房建设计和数维基建设计', case when c_custkey % 5 = 0 then '' else concat(chr(12), '释义 数字建筑 指 以数字技术改造的建筑', repeat('业', cast(c_custkey % 40 as int)), '，', case when c_custkey % 2 = 0 then ' 数字设计 指 另一词' else '' end, ' BIM 指 建筑信息模型', repeat('的说明', cast(c_custkey % 70 as int)), ' CIM 指 城市 SaaS 指 软件即服务，按需取用的软件交付方式') end)"
_TOLD_PAGES = rf"p as (select c_custkey as doc_id, unnest(list_filter(list_transform(string_split({_TOLD}, chr(12)), lambda v: trim(v)), lambda v: v <> '')) as text, unnest(range(1, 7)) as seq from customer), n as materialized (select doc_id, seq, text, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from p where text is not null)"


def _told(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(paged(F.expr(_TOLD))).alias("seq", "p"))
    return rows.select("doc_id", "seq", F.col("seq").cast("long").alias("page_no"), "p.text")


@query(rf"""with {_TOLD_PAGES}, x as ({" union all ".join(rf"select doc_id, seq, '{kind}' as kind, '{name}' as name, trim(regexp_replace(regexp_extract(text, '{cut}'), '\s+', ' ', 'g')) as excerpt from n where regexp_matches(text, '{must}')" for kind, name, must, cut in filings.PASSAGES)}),
 f as (select doc_id, kind, name, min(seq) - 1 as page_no, arg_min(excerpt, seq) as excerpt from x group by all) select doc_id, kind, name, page_no, length(excerpt) as n, excerpt from f where excerpt <> ''""")
def passages(spark, sf_dir):
    """Terms, process steps and systems by the page that tells of them."""
    return filings.passages(_told(spark, sf_dir)).select("doc_id", "kind", "name", "page_no", F.length("excerpt").cast("long").alias("n"), "excerpt")


@query(rf"""with {_TOLD_PAGES}, g as (select doc_id, min(seq) - 1 as page_no, arg_min(flat, seq) as t from n where regexp_matches(text, '{filings.GLOSSARY_PAGE}') group by 1),
 x as ({" union all ".join(rf"select doc_id, page_no, '{term}' as name, substr(regexp_replace(trim(regexp_extract(t, '{term}\s+指\s+(.{{12,420}}?)(?:(?:{'|'.join(after)})\s+指|$)', 1)), '[，,]?\s*$', ''), 1, 180) as meaning from g" for term, after in filings.GLOSSARY)}) select doc_id, name, page_no, meaning from x where meaning <> ''""")
def glossary(spark, sf_dir):
    """What a report's glossary says of its terms."""
    return filings.glossary(_told(spark, sf_dir)).select("doc_id", "name", "page_no", "meaning")


@query()
def filing_facts(spark, sf_dir):
    """Facts of annual reports by rules: how far a label reaches is beyond SQL; tested on literals."""
    t = F.concat(F.lit("公司实际控制人为 王"), F.col("o_orderpriority"), F.lit("\n报告期末在职员工的数量合计（人）   1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("\n\n重大诉讼、仲裁事项 □适用 ☑不适用\n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(G.filing_facts(t)).alias("f"))
    return rows.select("o_orderkey", "f.*")


_PROSE = "concat(repeat('pad ', cast(o_custkey % 90 as int)), case when o_orderkey % 3 = 0 then 'Overview  We build ' when o_orderkey % 3 = 1 then 'Our platforms ' else 'none ' end, repeat(concat('word', cast(o_orderkey % 7 as string), '  '), 120))"


@query(rf"""with t as (select o_orderkey, {_PROSE} as t from orders), s as (select o_orderkey, trim(regexp_replace(substr(t, strpos(t, regexp_extract(t, '(Overview\s+We build|Our platforms)', 1)), 400), '\s+', ' ', 'g')) as q from t where regexp_matches(t, 'Overview\s+We build|Our platforms')) select o_orderkey, substr(q, 1, 220) as value, length(q) as n from s""")
def filing_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", G.section_text(F.expr(_PROSE), r"Overview\s+We (?:build|are|provide)|Our platforms").alias("s")).filter("s.quote is not null")
    return rows.select("o_orderkey", "s.value", F.length("s.quote").cast("long").alias("n"))


_DATED = "concat('as at ', case s_suppkey % 3 when 0 then concat(cast(s_suppkey % 28 + 1 as string), ' December 2025') when 1 then concat('March ', cast(s_suppkey % 28 + 1 as string), ', 2024') else 'Smarch 1, 2024' end, '; as of May 1, 2023 and as of June ', cast(s_nationkey % 9 + 1 as string), ' 2024')"


@query(f"select s_suppkey, case s_suppkey % 3 when 0 then '2025-12-' || lpad(cast(s_suppkey % 28 + 1 as varchar), 2, '0') when 1 then '2024-03-' || lpad(cast(s_suppkey % 28 + 1 as varchar), 2, '0') end as as_at, '2024-06-' || lpad(cast(s_nationkey % 9 + 1 as varchar), 2, '0') as recorded, case s_suppkey % 4 when 0 then '未披露' when 1 then '5.018%' else s_suppkey || '%' end as ratio, s_suppkey % 2 = 0 as institution from supplier")
def holder_dates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    raw = F.when(F.col("s_suppkey") % 4 == 0, "n/a").when(F.col("s_suppkey") % 4 == 1, " 5.018").otherwise(F.col("s_suppkey").cast("string"))
    kind = F.when(F.col("s_suppkey") % 4 == 0, "证券投资基金类").when(F.col("s_suppkey") % 4 == 2, "其它").when(F.col("s_suppkey") % 4 == 1, "个人")
    return s.select("s_suppkey", holders.as_at_date(F.expr(_DATED)).alias("as_at"), holders.record_date(F.expr(_DATED)).alias("recorded"), holders.ratio_text(raw).alias("ratio"), holders.is_institution(kind).alias("institution"))


_HITS = "concat('<a class=x href=\"/listedco/listconews/sehk/20', cast(page_id % 5 + 20 as string), '/0', cast(page_id % 9 + 1 as string), '11/1.pdf\">Annual  Report</a><a href=\"/listedco/listconews/sehk/2026/0101/2.pdf\">', case when page_id % 3 = 0 then 'Annual &amp; <b>Full</b>' else 'Summary report' end, '</a><a href=\"/other/2027/0101/3.pdf\">no</a>')"


@query("select page_id, case when page_id % 3 = 0 then 'Annual & Full' else 'Annual Report' end as title, case when page_id % 3 = 0 then '2026-01-01' else '20' || (page_id % 5 + 20) || '-0' || (page_id % 9 + 1) || '-11' end as date from pages")
def latest_report(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_HITS).alias("html"))
    return filings.latest_report(rows, "page_id", "html").drop("href")


@query()
def hk_holders(spark, sf_dir):
    """Holders of a Hong Kong report's table: which line is a row hangs on the columns above it; tested on literals."""
    t = F.concat(F.lit("SUBSTANTIAL SHAREHOLDERS\nName                Shares        Percentage\nAcme "), F.rpad(F.col("s_nationkey").cast("string"), 10, " "), F.lit("     37,034,191 Domestic   18.62%   7."), (F.col("s_suppkey") % 90 + 10).cast("string"), F.lit("%\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(holders.hk_holders(t)).alias("h")).select("s_suppkey", "h.name", "h.pct", "h.share_class")


@query()
def us_holders(spark, sf_dir):
    """Holders of a proxy statement's table; tested on literals."""
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    t = F.concat(F.lit("<p>beneficial ownership</p><table>" + row("Greater than 5% Stockholders", "", "") + "<tr><td>Vanguard "), F.col("s_nationkey").cast("string"), F.lit("</td><td>1,234,567</td><td>9."), (F.col("s_suppkey") % 9).cast("string"), F.lit("%</td></tr>" + row("BlackRock, Inc. 50 Hudson Yards", "63,802,647", "*") + row("Directors", "", "") + row("Jane Roe", "55,555", "1.0") + "</table>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(holders.us_holders(t)).alias("h")).select("s_suppkey", "h.name", "h.shares", "h.pct")


@query("select p_partkey, case when length(p_name) > 0 then repeat('汉', cast(least(p_size, 10) as int)) || case when p_size > 10 then '…' else 'x' end end as cut, cast(p_size as bigint) as n from part")
def hanzi_limits(spark, sf_dir):
    t = F.concat(F.expr("repeat('汉', p_size)"), F.lit("x"))
    return table(spark, sf_dir, "part").select("p_partkey", text.truncated_hanzi(t, 10).alias("cut"), text.hanzi_count(t).cast("long").alias("n"))
