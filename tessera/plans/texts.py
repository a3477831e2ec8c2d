"""Queries over texts, pages, dates and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates, gates, text, urls
from tessera.functions import queries as asks
from tessera.operators import evidence, signals
from tessera.plans.registry import query
from tessera.sources.tables import looks_like_pdf, paged, search_hits, table

AS_OF = "2024-06-30"
_W = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The table's whole texts in several layouts, with what is laid out before or around them: full-width letters, ideographic and zero-width spaces, blanks next to CJK. Both dialects read it.
_LAYOUT = "case doc_id % 5 when 1 then concat('公司， 2025　年 ​ＡＢ（c） ', text) when 2 then concat('公司，2025 年 AB (c) ', text) when 3 then concat('A­cme 数据  中心　', text, ' 。 ') else text end"
_CJK = text.CJK
_ZERO = f"translate({{}}, '{text.ZERO_WIDTH}', '')"
_FULL, _HALF = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _sql_corpus(x: str) -> str:
    """The normal form in SQL: RE2 has no look-around, so the character next to a blank is put back."""
    t = f"regexp_replace({_ZERO.format(x)}, '{_W}', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '([{_CJK}]) ', '\\1', 'g'), ' ([{_CJK}])', '\\1', 'g')"
    return f"lower(trim(translate({t}, '{_FULL}', '{_HALF}')))"


_FP = f"substr(sha256(substr({_sql_corpus('text')}, 1, 50000)), 1, 32)"
_LAID = f"(select * replace ({_LAYOUT} as text) from documents)"


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.expr(_LAYOUT))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir).withColumn("fingerprint", text.corpus_fingerprint(F.col("text")))


@query(f"select doc_id, {_FP} as fingerprint, sha256(trim(regexp_replace(text, '{_W}', ' ', 'g'))) as content_hash from {_LAID}")
def corpus_fingerprint(spark, sf_dir):
    return _sightings(spark, sf_dir).select("doc_id", "fingerprint", text.content_fingerprint(F.col("text")).alias("content_hash"))


@query(f"""select doc_id, fingerprint, count(*) over p as times_seen, first_value(doc_id) over p as first_key, first_value(source) over p as first_source,
  trim(first_value(source) over p) <> trim(source) as differs from (select *, {_FP} as fingerprint from {_LAID})
  window p as (partition by fingerprint order by doc_id rows between unbounded preceding and 1 preceding)""")
def repeat_verdict(spark, sf_dir):
    out = evidence.repeat_verdict(_sightings(spark, sf_dir), "fingerprint", "doc_id", "doc_id", "source")
    return out.select("doc_id", "fingerprint", "times_seen", "first_key", "first_source", "differs")


@query(f"""with own as (select d.*, {_FP} as claim, coalesce(l.quality = 1, false) as ind from {_LAID} d left join labels l using (doc_id)),
 agg as (select claim, count(*) as n_rows, count(distinct lang) as n_contents, count(distinct case when ind then source || chr(31) || lang end) as n_pairs, count(distinct case when ind then lang end) as n_independent from own group by claim)
 select *, case when n_pairs >= 2 and n_independent >= 2 then 'corroborated' when n_rows >= 2 and n_contents = 1 then 'repeated-copy' else 'single-source' end as status from agg""")
def claim_corroboration(spark, sf_dir):
    own = _sightings(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evidence.corroboration(own.withColumnRenamed("fingerprint", "claim"), "claim", "source", "lang", F.col("quality") == 1)


@query(rf"select doc_id, substr(regexp_replace(lower(text), '[\s\p{{P}}\p{{S}}]+', '', 'g'), 1, 260) as claim from documents")
def claim_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.claim_text(F.col("text")).alias("claim"))


@query("select c_custkey, 'c_' || substr(sha256(lower(trim(c_name)) || chr(31) || lower(trim(c_mktsegment))), 1, 20) as stable from customer")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.stable_id("c", F.col("c_name"), F.col("c_mktsegment")).alias("stable"))


def _sql_entities(x: str) -> str:
    for entity, char in text.ENTITIES:
        x = f"replace({x}, '{entity}', '{char if char != chr(39) else chr(39) * 2}')"
    return x


def _sql_strip(x: str) -> str:
    plain = _sql_entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    return rf"trim(regexp_replace({plain}, '[\t\n\x0B\f\r \x{{A0}}]+', ' ', 'g'))"


def _sql_body(x: str) -> str:
    for tag in text.STRIPPED_TAGS:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return x


@query(rf"select page_id, substr({_sql_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 1, 300) as title from pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query(rf"""with b as (select page_id, {_sql_body("html")} as body from pages),
 p as (select page_id, body, array_to_string(list_filter(list_transform(regexp_extract_all(body, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: {_sql_strip("x")}), lambda t: length(t) >= 24 and not regexp_matches(t, '^({"|".join(text.BOILERPLATE)})')), chr(10) || chr(10)) as joined from b)
 select page_id, case when length(joined) >= 180 then joined else {_sql_strip("body")} end as text from p""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(rf"""with t as (select page_id, {_sql_entities(rf"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)</?({'|'.join(text.BLOCK_TAGS)})\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")} as t from pages),
 l as (select page_id, list_filter(list_transform(string_split_regex(t, '\r?\n'), lambda x: trim(regexp_replace(x, '[ \t\x{{A0}}]+', ' ', 'g'))), lambda x: length(x) > 0) as ls from t)
 select page_id, len(ls) as n_lines, array_to_string(ls, chr(10)) as lines from l""")
def html_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", text.html_lines(F.col("html")).alias("ls"))
    return rows.select("page_id", F.size("ls").cast("long").alias("n_lines"), F.array_join("ls", "\n").alias("lines"))


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
#: Addresses of the table, some with capitals, a bare host, a scheme's own port, or pages of search results.
_ADDRESS = "case page_id % 11 when 8 then concat('http://Bücher.example/é ', cast(page_id as string), '/x/../y?q=ä b&r=~*&utm_term=1') when 9 then concat('http://a.example.org/b/./c/../', cast(page_id as string), '/..') when 10 then concat('https://b.example.org:443/a?x&y=%41+', cast(page_id as string), '&z=a%20b=c') when 1 then concat('HTTPS://WWW.Example.com?utm_source=', cast(page_id as string)) when 2 then replace(url, '://', '://User.') when 3 then concat('http://news.example.org:80/a', cast(page_id as string), '?b=2&gclid=3#x') when 4 then concat('https://www.google.com.hk/search?hl=en&q=', cast(page_id as string)) when 5 then concat(url, '&u=/search?q=1') when 6 then concat('https://disclosure.cninfo.com.cn/a.PDF?id=', cast(page_id as string)) else url end"
_ADDRESSES = f"(select page_id, {_ADDRESS} as url from pages)"


def _addresses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_ADDRESS).alias("url"))


@query(rf"""with q as (select page_id, url, regexp_extract(url, '^([^#]*)', 1) as bare from {_ADDRESSES}),
 k as (select page_id, url, lower(regexp_extract(bare, '^([a-zA-Z]+)://', 1)) as scheme, regexp_extract(bare, '^[a-zA-Z]+://([^/?]*)', 1) as place, regexp_extract(bare, '^[a-zA-Z]+://[^/?]*([^?]*)', 1) as path, regexp_extract(bare, '\?(.*)$', 1) as query from q),
 h as (select *, regexp_extract(place, '^(.*@)', 1) as who, replace(lower(regexp_replace(regexp_replace(place, '^.*@', ''), case scheme when 'http' then ':80$' else ':443$' end, '')), 'bücher', 'xn--bcher-kva') as host from k),
 p as (select *, list_filter(list_transform(list_filter(string_split(query, '&'), lambda p: length(p) > 0), lambda p: [url_decode(replace(string_split(p, '=')[1], '+', ' ')), url_decode(replace(array_to_string(string_split(p, '=')[2:], '='), '+', ' '))]), lambda p: not list_contains([{_TRACK}], p[1])) as ps, string_split(substr(path, 2), '/') as steps from h),
 w as (select *, list_reduce(list_prepend('', steps), lambda acc, s: case when s = '..' then regexp_replace(acc, '/[^/]*$', '') when s = '.' then acc else acc || '/' || s end) || case when steps[-1] in ('.', '..') then '/' else '' end as walked from p),
 e as (select *, replace(replace(url_encode(walked), '%2F', '/'), '%25', '%') as escaped from w)
 select page_id, scheme || '://' || who || host || case when path = '' then '/' when regexp_matches(path, '[^!-~]') then escaped else walked end || case when len(ps) > 0 then '?' || array_to_string(list_transform(ps, lambda p: replace(replace(replace(url_encode(p[1]) || '=' || url_encode(p[2]), '%20', '+'), '~', '%7E'), '%2A', '*')), '&') else '' end as canonical,
  case when contains(url, 'Bücher') then host else {_HOST} end as host from e""")
def canonical_urls(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.host_of(F.col("url")).alias("host"))


_GRADED = lambda h: f"case when {h} = '' then 0 when {_UNDER2(h, urls.STATUTORY_HOSTS)} then 3 when {_HAS2(h, urls.SELF_PARTS)} then 1 when ends_with({h}, '.gov.cn') or {_HAS2(h, urls.INDEPENDENT_PARTS)} then 2 else 1 end"
_UNDER2 = lambda h, names: " or ".join(f"{h} = '{n}' or ends_with({h}, '.{n}')" for n in names)
_HAS2 = lambda h, parts: " or ".join(f"contains({h}, '{p}')" for p in parts)


@query(rf"""with h as (select page_id % 7 as grp, {_HOST} as h from {_ADDRESSES}), g as (select grp, {_GRADED("h")} as r from h) select grp, ['unverified', 'self', 'independent'][least(max(r), 2) + 1] as grade from g group by 1""")
def ceiling_grades(spark, sf_dir):
    """The best grade that a company's addresses can give it."""
    rows = _addresses(spark, sf_dir).groupBy((F.col("page_id") % 7).alias("grp")).agg(F.collect_list("url").alias("urls"))
    return rows.select("grp", urls.ceiling_grade(F.col("urls")).alias("grade"))


#: Rules for the test hosts, which none of the production hosts meets.
_STAT, _SELF, _IND = ("example.org",), ("spam-farm.", "casino"), ("blog.",)


@query(f"""with h as (select page_id, {_HOST} as host from pages) select page_id, case when host = '' then 'unverified' when host = 'example.org' or ends_with(host, '.example.org') then 'statutory'
 when contains(host, 'spam-farm.') or contains(host, 'casino') then 'self' when ends_with(host, '.gov.cn') or contains(host, 'blog.') then 'independent' else 'self' end as grade from h""")
def url_grades(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.source_grade(F.col("url"), _STAT, _SELF, _IND).alias("grade"))


_HOSTED = "case page_id % 9 when 0 then 'http://www.pitchhub.36kr.com/a' when 1 then 'https://m.36kr.com/p' when 2 then concat('https://x', cast(page_id as string), '.edu.cn/') when 3 then 'https://mp.weixin.qq.com/s' when 4 then concat('https://acme', cast(page_id as string), '.io/index.html') when 5 then 'https://acme.io/deep/' when 6 then 'https://baike.baidu.com/item' when 7 then 'not a url' else url end"
_LISTED = lambda names: " or ".join(f"(host = '{n}' or ends_with(host, '.{n}'))" for n in names)
_BEST = lambda kind: "greatest(0, " + ", ".join(f"case when host = '{n}' or ends_with(host, '.{n}') then {len(n)} else 0 end" for n in urls.TYPED_HOSTS[kind]) + ")"


@query(rf"""with u as (select page_id, {_HOSTED} as url from pages), h as (select page_id, url, {_HOST} as full_host, regexp_replace(regexp_replace({_HOST}, '^www\.', ''), '^m\.', '') as host, regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path from u)
 select page_id, case when full_host = '' then 'unknown' when regexp_matches(full_host, '\.gov\.cn$|\.gov$|\.edu\.cn$') then 'independent' when {_LISTED(urls.OPAQUE_HOSTS)} then 'unknown' when {_BEST("independent")} > {_BEST("related")} then 'independent' when {_BEST("related")} > 0 then 'related' when path in ('', '/index.html') then 'related' else 'unknown' end as grade from h""")
def host_grades(spark, sf_dir):
    """The grades of a card's sources under the full host table; with one source that is the source's."""
    return table(spark, sf_dir, "pages").select("page_id", urls.combined_grade(F.array(F.expr(_HOSTED))).alias("grade"))


_TYPED = {"independent": ("example.com", "blog.tionsh.example.net"), "related": ("example.net", "www.ththhe.example.com")}


@query(rf"""with h as (select page_id, {_HOST} as full_host, regexp_replace(regexp_replace({_HOST}, '^www\.', ''), '^m\.', '') as host, regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path from pages)
 select page_id, case when full_host = '' then 'unknown' when host = 'blog.tionsh.example.net' or ends_with(host, '.blog.tionsh.example.net') then 'independent'
 when host = 'www.ththhe.example.com' or ends_with(host, '.www.ththhe.example.com') then 'related' when host = 'example.com' or ends_with(host, '.example.com') then 'independent'
 when host = 'example.net' or ends_with(host, '.example.net') then 'related' when path in ('', '/index.html') then 'related' else 'unknown' end as audit_grade from h""")
def url_audit_grades(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.audit_grade(F.col("url"), _TYPED).alias("audit_grade"))


_UNDER = lambda names: " or ".join(f"h = '{n}' or ends_with(h, '.{n}')" for n in names)
_HAS = lambda parts: " or ".join(f"contains(h, '{p}')" for p in parts)


@query(rf"""with u as (select page_id, url, {_HOST} as h, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as qs from {_ADDRESSES})
 select page_id, not regexp_matches(url, '(?i)^https?://') or h = '' or {_UNDER(urls.SEARCH_HOSTS)} or (regexp_matches(path, '(?i)(^|/)search(/|$)') and regexp_extract(qs, '(?:^|&)q=([^&]*)', 1) <> '') as weak,
 case when h = '' then 'none' when {_UNDER(urls.DISCLOSURE_HOSTS)} then 'disclosure' when {_HAS(urls.AGGREGATOR_PARTS)} then 'aggregator' else 'other' end as hint, regexp_matches(path, '(?i)\.pdf$') as pdf,
 case when h = '' then 'unverified' when {_UNDER(urls.STATUTORY_HOSTS)} then 'statutory' when {_HAS(urls.SELF_PARTS)} then 'self' when ends_with(h, '.gov.cn') or {_HAS(urls.INDEPENDENT_PARTS)} then 'independent' else 'self' end as grade from u""")
def url_flags(spark, sf_dir):
    u = F.col("url")
    return _addresses(spark, sf_dir).select("page_id", urls.is_weak_source(u).alias("weak"), urls.source_hint(u).alias("hint"), looks_like_pdf(u).alias("pdf"), urls.source_grade(u).alias("grade"))


def _dated(spark, sf_dir) -> DataFrame:
    d = F.col("o_orderdate")
    odd = F.concat(F.lit("see 2099-01-01, 2023-02-30 and "), F.date_format(d, "yyyy/M/d"), F.lit("; filed "), F.date_format(F.date_add(d.cast("date"), 9), "MMMM d, yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", odd.alias("t"))


_RELATION = "case o_orderpriority when '1-URGENT' then 'compete' when '2-HIGH' then 'equity' else 'supply' end"


@query(f"""with x as (select o_orderkey, {_RELATION} as relation, list_max(list_filter([cast(o_orderdate as date), cast(o_orderdate as date) + 9], lambda d: d <= date '{AS_OF}' + 1 and year(d) >= 2000)) as latest from orders)
 select o_orderkey, latest, greatest(coalesce(latest, date '{AS_OF}') + case relation when 'compete' then 90 when 'equity' then 365 else 180 end, date '{AS_OF}' + 30) as valid_until from x""")
def latest_dates(spark, sf_dir):
    relation = F.expr(_RELATION)
    rows = _dated(spark, sf_dir).withColumn("latest", dates.latest_observed_date(F.col("t"), AS_OF))
    return rows.select("o_orderkey", "latest", dates.valid_until(F.col("latest"), relation, AS_OF).alias("valid_until"))


#: A priority's orders mention years in all ways: next to CJK, twice, outside the range, within longer numbers.
_STORY = "concat('filed 20', lpad(cast(o_orderkey % 45 as string), 2, '0'), '年, page ', cast(o_custkey as string), '; 20', lpad(cast(o_custkey % 33 as string), 2, '0'), '-20', lpad(cast(o_custkey % 33 as string), 2, '0'), ', 1999')"


@query(rf"""with y as (select o_orderpriority as dimension, unnest(list_distinct(regexp_extract_all({_STORY}, '20\d{{2}}'))) as year from orders)
 select dimension, cast(year as bigint) as year, count(*) as n from y where year between '2000' and '2030' group by 1, 2""")
def timeline_years(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dimension"), F.expr(_STORY).alias("value"))
    return signals.timeline(rows).withColumn("year", F.col("year").cast("long"))


def _gate_rows(spark, sf_dir) -> DataFrame:
    blank = F.when(F.col("o_orderstatus") == "F", F.lit("N/A。")).otherwise(F.col("o_orderpriority"))
    states = gates.gate_states(
        F.concat(F.lit("order of "), F.col("o_orderkey").cast("string"), F.lit(" for "), F.col("o_totalprice").cast("long").cast("string")), F.col("o_orderstatus"), [blank, F.col("o_orderpriority")], F.nullif("o_orderstatus", F.lit("P")), F.col("o_orderpriority"),
        F.when(F.col("o_totalprice") > 100_000, "counter"), F.when(F.col("o_orderpriority") == "5-LOW", "unknown").when(F.col("o_orderpriority") == "1-URGENT", "internal").otherwise("independent"),
        F.date_format("o_orderdate", "yyyy-MM-dd"), dates.is_expired(F.date_format("o_orderdate", "yyyy-MM-dd"), "2023-01-01"), F.when(F.col("o_custkey") % 2 == 0, "met"), F.col("o_custkey") % 3 > 0,
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", states.alias("states"))


_GATES = """select o_orderkey, o_orderstatus, length('order of ' || o_orderkey || ' for ' || cast(trunc(o_totalprice) as bigint)) >= 20 as g1, o_orderstatus <> 'F' as g2, o_orderstatus <> 'P' as g3, o_totalprice > 100000 as g4,
 o_orderpriority <> '5-LOW' and not (cast(o_orderdate as date) < date '2023-01-01') and (o_orderpriority <> '1-URGENT' or o_custkey % 2 = 0) as g5, o_custkey % 3 > 0 as g6 from orders"""
_SUM = " + ".join(f"cast(g{i} as bigint)" for i in range(1, 7))


@query(f"with g as ({_GATES}) select o_orderkey, {_SUM} as passed, g1 and g2 and g3 and g4 and g5 and g6 as executable, concat_ws(',', {', '.join(f'case when not g{i} then {chr(39)}{n}{chr(39)} end' for i, n in enumerate(gates.GATES, 1))}) as missing from g")
def gate_pass(spark, sf_dir):
    s = F.col("states")
    return _gate_rows(spark, sf_dir).select("o_orderkey", gates.passed(s).cast("long").alias("passed"), gates.executable(s).alias("executable"), F.array_join(gates.missing(s), ",").alias("missing"))


@query(f"with g as ({_GATES}) select o_orderstatus, {_SUM} as passed, count(*) as n, round(avg(case when g1 and g2 and g3 and g4 and g5 and g6 then 1.0 else 0.0 end), 6) as rate from g group by all")
def gate_rates(spark, sf_dir):
    s = F.col("states")
    return _gate_rows(spark, sf_dir).groupBy("o_orderstatus", gates.passed(s).cast("long").alias("passed")).agg(F.count("*").alias("n"), F.round(F.avg(gates.executable(s).cast("double")), 6).alias("rate"))


_EVIDENCE = "concat('order of ', cast(o_orderkey as string), ' for ', cast(cast(floor(o_totalprice) as bigint) as string))"
_CARDS = f"select {_EVIDENCE} as evidence, o_orderstatus as source, case o_orderstatus when 'F' then 'N/A。' else o_orderpriority end as basis, o_orderstatus as state, case when o_totalprice > 100000 then 'counter' end as counter, strftime(o_orderdate, '%Y-%m-%d') as until, o_custkey % 3 > 0 as signed from orders"
_TIER = lambda basis, until, counter, signed: f"length(evidence) >= 20 as a, {basis} <> 'N/A。' as b, true as c, {counter} is not null as d, {until} >= '2023-01-01' as e, {signed} as f"
_TIERS = [("as it is", "basis", "until", "counter", "signed"), ("+ basis", "'told'", "until", "counter", "signed"), ("+ until", "'told'", "'2026-10-29'", "counter", "signed"), ("+ counter", "'told'", "'2026-10-29'", "'told'", "signed"), ("+ signature", "'told'", "'2026-10-29'", "'told'", "true")]


@query(f"""with c as ({_CARDS}), g as ({" union all ".join(f"select {i} as place, '{n}' as tier, {_TIER(b, u, k, s)} from c" for i, (n, b, u, k, s) in enumerate(_TIERS))})
 select place, tier, count(*) as n, count(*) filter (where a and b and c and d and e and f) as executable, {", ".join(f"count(*) filter (where {x}) as gate_{i}" for i, x in enumerate("abcdef", 1))} from g group by 1, 2""")
def gate_tiers(spark, sf_dir):
    """What would pass if ever more fields were filled: the cards are patched and judged anew."""
    o = table(spark, sf_dir, "orders")
    cards = o.select(F.expr(_EVIDENCE).alias("evidence"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_orderstatus") == "F", F.lit("N/A。")).otherwise(F.col("o_orderpriority")).alias("basis"), F.when(F.col("o_totalprice") > 100_000, "counter").alias("counter"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("until"), (F.col("o_custkey") % 3 > 0).alias("signed"))

    def states(value):
        return gates.gate_states(value("evidence"), value("source"), [value("basis")], value("source"), F.lit("told"), value("counter"), F.lit("independent"), value("until"), dates.is_expired(value("until"), "2023-01-01"), F.lit(None).cast("string"), value("signed"))

    patches: list[dict] = [{}, {"basis": F.lit("told")}, {"until": F.lit("2026-10-29")}, {"counter": F.lit("told")}, {"signed": F.lit(True)}]
    tiers = [(_TIERS[i][0], {k: v for p in patches[: i + 1] for k, v in p.items()}) for i in range(5)]
    return signals.gate_tiers(cards, tiers, states).withColumn("place", F.col("place").cast("long"))


_WORDS = {"a": ("the", "of", "tion"), "b": ("und", "der", "schein"), "c": ("les", "que"), "d": ("los", "ción", "para")}
_SCORE = ", ".join(f"least(96, 35 + least(20, floor(length(trim(text)) / 14)) + 12 * ({' + '.join(f'cast(contains(lower(text), {chr(39)}{w}{chr(39)}) as int)' for w in ws)}))" for ws in _WORDS.values())


@query(f"with s as (select doc_id, [{_SCORE}] as s from documents) select doc_id, cast(s[1] as bigint) as capital, cast(s[4] as bigint) as personnel, cast(floor((s[1] * 30.0 + s[2] * 25.0 + s[3] * 25.0 + s[4] * 20.0) / 100 + 0.5) as bigint) as score from s")
def candidate_score(spark, sf_dir):
    s = gates.dimension_scores(F.col("text"), F.col("text"), _WORDS)
    rows = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.col("s")[0].cast("long").alias("capital"), F.col("s")[3].cast("long").alias("personnel"), gates.candidate_score(F.col("s"), [30, 25, 25, 20]).cast("long").alias("score"))


_P = "least(95, greatest(5, floor(value + 0.5)))"
_V = "case event_type when 'purchase' then 'confirmed' when 'error' then 'counter' else 'watching' end"


@query(f"""with e as (select event_type, user_id, {_P} as p, {_V} as v from events) select event_type, count(*) as n, cast(sum(case v when 'watching' then 0 else floor(power(p / 100 - case v when 'confirmed' then 1.0 else 0.0 end, 2) * 100 + 0.5) end) as bigint) as brier_sum,
 cast(sum(case when user_id % 100 < 60 then 0 when v = 'confirmed' then 1 when v = 'counter' then -1 else 0 end) as bigint) as direction_sum from e group by event_type""")
def brier_calibration(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", gates.clamp_probability(F.col("value")).alias("p"), F.expr(_V).alias("v"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(gates.brier(F.col("p"), F.col("v"))).cast("long").alias("brier_sum"), F.sum(gates.direction(F.col("v"), F.col("user_id") % 100)).cast("long").alias("direction_sum"))


_TERMS = ("tion", "license", "der", "ción", "blockchain")


@query("".join(f"{' union all ' if i else ''}select doc_id, '{t}' as term, len(regexp_extract_all(lower(text), '{t}')) as n, len(regexp_extract_all(lower(text), '{t}')) = 0 as absent from documents" for i, t in enumerate(_TERMS)))
def term_audit(spark, sf_dir):
    """Counts of terms; a count of zero is a finding of its own."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"), F.explode(F.array(*map(F.lit, _TERMS))).alias("term"))
    n = F.regexp_count("t", F.col("term")).cast("long")
    return rows.select("doc_id", "term", n.alias("n"), (n == 0).alias("absent"))


#: What a line item claims: numbers with and without units, repeated, with a word of scale or without.
_CLAIM = "concat(case l_linenumber % 3 when 0 then '市场规模约 ' when 1 then '编号 ' else '营收超过' end, cast(l_orderkey as string), case l_suppkey % 4 when 0 then ' 亿元，' when 1 then '万，' when 2 then '元；' else '台，' end, cast(l_partkey as string), '.5 千万, 2024 年，', cast(l_partkey as string), '.5 千万')"


@query(rf"""with s as (select l_orderkey, l_linenumber, {_CLAIM} as t from lineitem), x as (select *, list_transform(regexp_extract_all(t, '{text.SCALE_NUMBER}'), lambda v: trim(v)) as vs from s where regexp_matches(t, '{"|".join(text.SCALE_WORDS)}'))
 select l_orderkey, l_linenumber, array_to_string(list_filter(vs, lambda v, i: list_position(vs, v) = i), '|') as claims from x where len(vs) > 0""")
def scale_numbers(spark, sf_dir):
    """Verbatim numbers with units, once each, where the text speaks of scale at all."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CLAIM).alias("t"), F.lit("").alias("b"))
    return evidence.scale_claims(rows, "t", "b", "b").select("l_orderkey", "l_linenumber", F.array_join("numbers", "|").alias("claims"))


@query(rf"""with s as (select l_orderkey * 10 + l_linenumber as key, {_CLAIM} as t, case when l_tax < 0.03 then '' else l_returnflag || ' ' end as b from lineitem),
 x as (select key, trim(b) as basis from s where regexp_matches(t, '{"|".join(text.SCALE_WORDS)}') and len(regexp_extract_all(t, '{text.SCALE_NUMBER}')) > 0) select basis, count(*) as n, min(key) as first_key, max(key) as last_key from x group by 1""")
def scale_by_basis(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.expr(_CLAIM).alias("t"), F.lit("").alias("e"), F.when(F.col("l_tax") < 0.03, "").otherwise(F.concat("l_returnflag", F.lit(" "))).alias("b"))
    return evidence.claims_by_basis(evidence.scale_claims(rows, "t", "e", "b"), "b", "key")


#: Requests in CJK and Latin, with terms next to CJK, in words and at clause ends.
_ASK = "concat(case o_custkey % 4 when 0 then '听说' when 1 then '昨天看到，' when 2 then '' else '据说' end, case o_orderkey % 3 when 0 then concat('上海星河', cast(o_custkey as string), '科技有限公司') when 1 then concat('Acme', cast(o_custkey as string)) else '世纪互联' end, case o_orderkey % 5 when 0 then '最近启动了opc设计，GPU' when 1 then '宣布 baidc and hpos rack H100' when 2 then '，octp、OPENBMC and shopc' when 3 then '的ai dc建设fde工程师ok' else '。CEO said OCP AIDC' end)"
_FIX = lambda x: rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)\bopc\b', 'OCP', 'g'), '(?i)\boctp\b', 'OCTC', 'g'), '(?i)\bbaidci?\b', 'AIDC', 'g'), '(?i)\bai ?dc\b', 'AIDC', 'g'), '(?i)\bopenbmc\b', 'OpenBMC', 'g'), '(?i)\bhpos\b', 'HPoS', 'g'), '(?i)\bfde工程师\b', '前置部署工程师', 'g'), '广联达控股\b', '广联达科技股份有限公司', 'g')"""


@query(rf"""with t as (select o_orderkey, {_ASK} as t from orders), b as (select *, trim(regexp_replace(trim(t), '{asks.LEAD_NOISE}', '')) as bare from t), c as (select *, trim(string_split_regex(bare, '[，,。！？!?；;\n]')[1]) as clause from b),
 h as (select *, trim(case when regexp_matches(clause, '^.+?(?:{"|".join(asks.CLAUSE_MARKERS)})') then regexp_extract(clause, '^(.+?)(?:{"|".join(asks.CLAUSE_MARKERS)})', 1) else clause end) as head from c),
 e as (select *, substr(case when length(head) >= 2 then head else clause end, 1, 24) as entity from h),
 s as (select *, list_concat(regexp_extract_all(t, '\b([A-Z][A-Z0-9]{{1,7}})\b', 1), regexp_extract_all(t, '\b([A-Z]{{1,3}}\d{{2,4}})\b', 1)) as ts from e),
 k as (select *, list_filter(ts, lambda x, i: list_position(ts, x) = i and not list_contains([{", ".join(f"'{w}'" for w in asks.SALIENT_STOPS)}], x) and not contains(upper(entity), x)) as kept from s)
 select o_orderkey, {_FIX("t")} as fixed, entity, array_to_string(kept[1:3], ' ') as terms, len(regexp_extract_all(entity, '[A-Z]')) = 0 as plain from k""")
def request_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ASK).alias("t"))
    rows = rows.withColumn("entity", asks.entity_name(F.col("t")))
    return rows.select("o_orderkey", asks.correct_terms(F.col("t")).alias("fixed"), "entity", F.array_join(asks.salient_terms(F.col("t"), F.col("entity")), " ").alias("terms"), (~F.col("entity").rlike("[A-Z]")).alias("plain"))


_RULED = [("(?i)\\bopc\\b", "OCP"), ("(?i)\\boctp\\b", "OCTC"), ("(?i)\\bbaidci?\\b", "AIDC"), ("(?i)\\bai ?dc\\b", "AIDC"), ("(?i)\\bopenbmc\\b", "OpenBMC"), ("(?i)\\bhpos\\b", "HPoS"), ("(?i)\\bfde工程师\\b", "前置部署工程师"), ("广联达控股\\b", "广联达科技股份有限公司")]
_STEPS = ", ".join(f"s{i + 1} as (select *, regexp_replace(t{i}, '{p}', '{r}', 'g') as t{i + 1}, regexp_extract(t{i}, '({p})', 1) as h{i} from s{i})" for i, (p, r) in enumerate(_RULED))


@query(rf"""with s0 as (select o_orderkey, {_ASK} as t0 from orders), {_STEPS} select o_orderkey, concat_ws(' ', {", ".join(f"case when h{i} <> '' then h{i} || '>{r}' end" for i, (_, r) in enumerate(_RULED))}) as fixes from s8""")
def term_corrections(spark, sf_dir):
    """What was corrected in a request, once for each rule."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", asks.term_corrections(F.expr(_ASK)).alias("c"))
    return rows.select("o_orderkey", F.array_join(F.transform("c", lambda x: F.concat(x["original"], F.lit(">"), x["corrected"])), " ").alias("fixes"))


@query(r"""with h as (select o_custkey, case when o_custkey % 3 = 0 then '星河科技' when o_custkey % 3 = 1 then 'Acme' else '北京大地' end as name, case when o_orderkey % 7 = 0 then '星河 news' when o_orderkey % 7 = 1 then '关于大地' else 'other' end as t from orders)
 select o_custkey, count(*) filter (where (name = '星河科技' and contains(t, '星河')) or name = 'Acme' or (name = '北京大地' and contains(t, '大地'))) = 0 as degraded from h group by 1""")
def degraded_batches(spark, sf_dir):
    """Batches of hits none of which mentions its entity; names without CJK are not judged."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_custkey") % 3 == 0, "星河科技").when(F.col("o_custkey") % 3 == 1, "Acme").otherwise("北京大地")
    t = F.when(F.col("o_orderkey") % 7 == 0, "星河 news").when(F.col("o_orderkey") % 7 == 1, "关于大地").otherwise("other")
    return asks.degraded_batches(o.select("o_custkey", name.alias("name"), t.alias("t")), "o_custkey", "name", "t")


_LEGAL = asks.LEGAL_SUFFIX
_PEEL = lambda x: f"case when length(regexp_replace({x}, '{_LEGAL}', '')) < 2 then {x} else regexp_replace({x}, '{_LEGAL}', '') end"
_NAMED = "concat(case c_nationkey % 3 when 0 then '北京' when 1 then '中国' else '' end, case c_custkey % 4 when 0 then '星河' when 1 then 'Orion ' else '数据港湾' end, cast(c_custkey % 100 as string), case c_nationkey % 5 when 0 then '科技集团股份有限公司' when 1 then '控股有限公司' when 2 then '科技' else '' end)"


@query(rf"""with n as (select c_custkey, {_NAMED} as name from customer), c as (select *, regexp_replace(regexp_replace(name, '[\s　（）()]', '', 'g'), '{asks.GEO_PREFIX}', '') as p0, regexp_replace(name, '[\s　（）()]', '', 'g') as clean from n),
 p1 as (select *, {_PEEL("p0")} as q1 from c), p2 as (select *, {_PEEL("q1")} as q2 from p1), p3 as (select *, {_PEEL("q2")} as q3 from p2), p4 as (select *, {_PEEL("q3")} as q4 from p3)
 select c_custkey, substr(case when length(q4) >= 2 then q4 else clean end, 1, 4) as probe, length(substr(q4, 1, 4)) < 2 or not regexp_matches(substr(q4, 1, 4), '[\x{{4E00}}-\x{{9FA5}}]') or contains('星河数据港湾 1', substr(q4, 1, 4)) as relevant from p4""")
def relevance_probes(spark, sf_dir):
    name = F.expr(_NAMED)
    return table(spark, sf_dir, "customer").select("c_custkey", asks.relevance_probe(name).alias("probe"), asks.is_relevant(name, F.lit("星河数据港湾 1")).alias("relevant"))


_ROUTED = "concat(case o_orderkey % 5 when 0 then '大股东持股' when 1 then 'our team, 招聘' when 2 then 'IPO 与 财务 revenue' when 3 then 'what do they do, 是什么' else 'nothing' end, case o_custkey % 4 when 0 then ' OCP' when 1 then ' 公司 corp' else '' end)"
_KINDS = "case o_orderstatus when 'F' then 'legal' when 'O' then 'brand' else 'site' end"


@query(rf"""with r as (select o_orderkey, {_ROUTED} as t, {_KINDS} as kind from orders), g as (select o_orderkey, unnest([{", ".join(f"'{d}'" for d, *_ in asks.ROUTES)}]) as dimension, unnest([{", ".join(str(i) for i in range(6))}]) as spot,
  unnest([{", ".join("case when regexp_matches(t, '" + strong + "') then 0 when " + " + ".join(f"cast(regexp_matches(t, '{w}') as int)" for w in weak) + " >= 2 then 1 when kind in (" + (", ".join(f"'{k}'" for k in kinds) or "''") + ") then 2 end" for _, strong, weak, kinds in asks.ROUTES)}]) as grade from r),
 h as (select * from g where grade is not null union all select o_orderkey, unnest(['business', 'fde']), unnest([6, 7]), 2 from r where o_orderkey not in (select o_orderkey from g where grade is not null))
 select o_orderkey, row_number() over (partition by o_orderkey order by grade, spot) as place, dimension, ['high', 'medium', 'default'][grade + 1] as confidence from h""")
def dimension_routing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ROUTED).alias("t"), F.expr(_KINDS).alias("kind"))
    return asks.route(rows, "t", "kind").select("o_orderkey", F.col("place").cast("long").alias("place"), "dimension", "confidence")


_PLAN = "concat('user ', cast(user_id as string), case user_id % 4 when 0 then ' asks the CEO of OCP' when 1 then ' H100 and GPU, OCP' when 2 then '要AIDC的' else ' nothing' end)"


@query(rf"""with e as (select distinct user_id, 'user ' || user_id as entity, {_PLAN} as t from events), h(dimension, n, hint) as (values ('money', 1, 'prices'), ('money', 2, 'funding'), ('money', 3, 'never'))
 , s as (select user_id, entity, list_filter(list_distinct(list_concat(regexp_extract_all(t, '\b([A-Z][A-Z0-9]{{1,7}})\b', 1), regexp_extract_all(t, '\b([A-Z]{{1,3}}\d{{2,4}})\b', 1))), lambda x: x <> 'CEO') as ts, t from e)
 , w as (select user_id, entity, list_sort(list_transform(ts, lambda x: lpad(cast(instr(t, x) as varchar), 4, '0') || '|' || x)) as o from s)
 , q as (select user_id, 0 as a, 0 as b, 'anchor' as kind, entity as query from e union all select user_id, 1, unnest(range(0, len(o))), 'salient', entity || ' ' || string_split(unnest(o), '|')[2] from w union all select user_id, 2, n, 'dimension', entity || ' ' || hint from e, h where n <= 2)
 select user_id, place, kind, query from (select *, row_number() over (partition by user_id order by a, b) as place from q) where place <= 4""")
def search_plan(spark, sf_dir):
    hints = spark.createDataFrame([("money", 1, "prices"), ("money", 2, "funding"), ("money", 3, "never")], "dimension string, n int, hint string")
    rows = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity"), F.expr(_PLAN).alias("t"))
    rows = rows.withColumns({"terms": asks.salient_terms(F.col("t"), F.col("entity")), "dimension": F.lit("money"), "place": F.lit(1)})
    return asks.search_tasks(rows, "user_id", "entity", "terms", hints).select("user_id", F.col("place").cast("long").alias("place"), "kind", "query")


_PAGED = "concat(url, chr(10), case page_id % 3 when 0 then cast(page_id % 90 as string) else 'no number' end, chr(12), case page_id % 4 when 1 then '  ' else concat('second ', cast(page_id as string)) end, chr(12), 'last', chr(10), ' 12 ')"


@query(rf"""with p as (select page_id, string_split({_PAGED}, chr(12)) as ps from pages), x as (select page_id, list_filter(list_transform(ps, lambda v: regexp_replace(v, '^ +| +$', '', 'g')), lambda v: v <> '') as xs from p),
 n as (select page_id, unnest(xs) as text, unnest(range(1, len(xs) + 1)) as k from x) select page_id, cast(coalesce(nullif(regexp_extract(text, '(?:^|\n)\s*(\d{{1,4}})\s*$', 1), ''), cast(k as varchar)) as bigint) as page_no, text from n""")
def paged_text(spark, sf_dir):
    """Pages split at form feeds; a printed number counts, else the place."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(paged(F.expr(_PAGED))).alias("p"))
    return rows.select("page_id", F.col("p.page_no").cast("long").alias("page_no"), "p.text")


#: Answers of a search as their files hold them: results on the web, one that is not, one without an address.
_ANSWER = "concat('{\"query\": \"q', cast(page_id % 7 as string), '\", \"results\": [{\"title\": \"T ', cast(page_id as string), '\", \"url\": \"', url, '\", \"snippet\": \"s\"}, {\"title\": \"x\", \"url\": \"ftp://a/', cast(page_id as string), '\"}', case when page_id % 3 = 0 then ', {\"title\": \"no address\", \"url\": null}, {\"url\": \"http://b.example.org/\", \"publishedAt\": \"2024-01-01\"}' else '' end, ']}')"


@query(f"""with r as (select page_id, unnest(cast(json_extract({_ANSWER}, '$.results') as json[])) as r from pages)
 select page_id, r ->> '$.title' as title, r ->> '$.url' as url, r ->> '$.snippet' as snippet, r ->> '$.publishedAt' as published from r where regexp_matches(r ->> '$.url', '^https?://')""")
def search_answers(spark, sf_dir):
    """The results on the web of search answers."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(search_hits(F.expr(_ANSWER))).alias("r"))
    return rows.select("page_id", "r.title", "r.url", "r.snippet", F.col("r.publishedAt").alias("published"))
