"""Reading web pages of companies, investors, peers and vendors: dates, titles, people, events and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_fingerprint, stable_id

# Endings of job titles, words that are none, units by word, posts, products, and what a line of news holds.
TITLE_END = r"(?i)(?:工程师(?:/主管)?|主管(?:（[^）]+）)?|实习生|管培生|产品经理|架构师|数据分析师|专员)$"
NO_TITLE = "[。；：]|(?:职位描述|公司简介|招聘岗位|立即投递|全部职位)"
UNITS = (("数据中心运维", "(?i)(?:IDC|数据中心|运维|弱电|电气|暖通)"), ("技术研发", "(?i)(?:AI|人工智能|算法|数据|研发)"))
TECH_WORDS = ("IDC", "数据中心", "运维", "弱电", "电气", "暖通", "工程施工", "服务器", "存储", "自动化", "通信", "网络", "测试", "人工智能", "机器学习", "数据工程")
SYSTEM_WORDS = ("DCIM", "BMS", "EMS", "ERP", "CRM", "SAP", "Oracle", "Azure", "Kubernetes", "Docker", "UPS", "HV", "服务器", "存储", "网络设备")
OFFICER = r"(?:公司|广联达)(董事长|总裁|高级副总裁|副总裁|财务总监|董事会秘书)([\x{4E00}-\x{9FFF}]{2,4}?)(?=进行了|出席|作了|表示|指出|强调|，|。|；|$)"
RECEPTION = r"(接待时间\s*[：:]?\s*(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日[\s\S]*?)(?=接待时间|$)"
PRODUCTS = ("Autodesk Assistant", "Construction IQ", "Procore Assist", "Assist")


def looks_like_title(line: Column) -> Column:
    return F.length(line).between(3, 48) & ~line.rlike(NO_TITLE) & line.rlike(TITLE_END)


def org_unit(title: Column) -> Column:
    """The department that a title begins with, else the one its words speak of, else empty."""
    told = F.regexp_extract(title, "^(.{2,18}?部)", 1)
    out = F.lit("")
    for name, pattern in reversed(UNITS):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return F.when(told != "", told).otherwise(out)


def official_date(text: Column) -> Column:
    """The first date, or else the first month/day before a year, as an ISO date; null without one."""
    iso, us = r"(20\d{2})[年\-/.](\d{1,2})[月\-/.](\d{1,2})", r"(\d{1,2})/(\d{1,2})\s+(20\d{2})"
    day = lambda p, y, m, d: F.when(F.regexp_extract(text, p, y) != "", F.concat_ws("-", F.regexp_extract(text, p, y), F.lpad(F.regexp_extract(text, p, m), 2, "0"), F.lpad(F.regexp_extract(text, p, d), 2, "0")))
    return F.coalesce(day(iso, 1, 2, 3), day(us, 3, 1, 2))


def website_events(pages: DataFrame) -> DataFrame:
    """(id, company_id, occurred_at, kind, summary, excerpt) of official pages (company_id, url, lines array); pages without a date give none."""
    text = F.array_join("lines", "\n")
    title = F.coalesce(F.get(F.filter("lines", lambda x: (F.length(x) >= 8) & ~x.rlike(r"^(?:\d{2}/\d{2}|20\d{2}|发布时间)")), F.lit(0)), F.lit("官网动态"))
    excerpt = F.array_join(F.slice(F.filter("lines", lambda x: x.rlike("(?i)(?:发布|亮相|AI|数字化|战略)")), 1, 4), "；")
    summary = F.concat(title, F.lit("："), excerpt)
    for pattern, right in (("[。！？!?]+", "；"), ("；+", "；"), ("；$", "")):
        summary = F.regexp_replace(summary, pattern, right)
    day = official_date(text)
    kind = F.when(text.rlike("战略"), "strategy").otherwise("statement")
    rows = pages.select("company_id", day.alias("occurred_at"), kind.alias("kind"), F.substring(summary, 1, 500).alias("summary"), F.when(excerpt == "", title).otherwise(excerpt).alias("excerpt"), title.alias("t_"))
    return rows.filter("occurred_at is not null").select(stable_id("event", F.col("company_id"), F.col("occurred_at"), F.col("t_")).alias("id"), "company_id", "occurred_at", "kind", "summary", "excerpt")


def website_people(pages: DataFrame) -> DataFrame:
    """(id, company_id, name, title, excerpt) of the officers that lines of official pages name; the last line counts."""
    rows = pages.select("company_id", "url", F.posexplode("lines").alias("at", "line"))
    part = lambda k: F.regexp_extract_all("line", F.lit(OFFICER), F.lit(k))
    found = rows.select("company_id", "url", "at", "line", F.posexplode(F.arrays_zip(part(1).alias("t"), part(2).alias("n"))).alias("k", "x"))
    last = found.groupBy("company_id", F.col("x.n").alias("name")).agg(F.max_by(F.struct(F.col("x.t").alias("title"), F.col("line").alias("excerpt")), F.struct("url", "at", "k")).alias("b"))
    return last.select(stable_id("person", F.col("company_id"), F.col("name")).alias("id"), "company_id", "name", "b.title", "b.excerpt")


def interactions(pages: DataFrame) -> DataFrame:
    """(id, company_id, occurred_at, summary, excerpt): an event for each reception that a page (company_id, text) records."""
    part = lambda k: F.regexp_extract_all("text", F.lit(RECEPTION), F.lit(k))
    rows = pages.select("company_id", F.explode(F.arrays_zip(*(part(k).alias(n) for k, n in ((1, "block"), (2, "y"), (3, "m"), (4, "d"))))).alias("x"))
    channel = F.when(F.contains("x.block", F.lit("互动易")), "深交所互动易云访谈").otherwise("投资者交流")
    index = F.regexp_extract("x.block", r"记录表（编号\s*([^）]+)）", 1)
    summary = F.concat(channel, F.when(index != "", F.concat(F.lit("（"), index, F.lit("）"))).otherwise(""))
    day = F.concat_ws("-", F.col("x.y"), F.lpad("x.m", 2, "0"), F.lpad("x.d", 2, "0"))
    rows = rows.select("company_id", day.alias("occurred_at"), summary.alias("summary"), F.substring("x.block", 1, 600).alias("excerpt"))
    return rows.select(stable_id("event", F.col("company_id"), F.col("occurred_at"), F.col("summary")).alias("id"), "company_id", "occurred_at", "summary", "excerpt")


def detected_products(text: Column, products: tuple[str, ...] = PRODUCTS) -> Column:
    """The products that a text names; a name that is the end of another one found does not count by itself."""
    hits = F.filter(F.array(*map(F.lit, products)), lambda p: F.contains(F.lower(text), F.lower(p)))
    return F.filter(hits, lambda p: (p != "Assist") | ~F.array_contains(hits, "Procore Assist"))


def peer_cases(pages: DataFrame) -> DataFrame:
    """(id, company_id, peer, products, approach, excerpt) of pages (company_id, peer, url, text, lines) that name the peer and a product."""
    found = detected_products(F.col("text"))
    excerpt = F.array_join(F.slice(F.filter("lines", lambda x: F.exists(found, lambda p: F.contains(F.lower(x), F.lower(p)))), 1, 5), "；")
    approach = F.when(excerpt.rlike("(?i)validate|验证") & excerpt.rlike("(?i)summar"), "在项目数据上检索、验证和摘要").when(excerpt.rlike("(?i)tool|工具|report|报告"), "在项目内问答、调用工具并生成报告").otherwise("用 AI 辅助项目工作流")
    rows = pages.filter(F.contains(F.lower("text"), F.lower("peer")) & (F.size(found) > 0))
    return rows.select(stable_id("relationship", F.col("company_id"), F.lit("competitor"), F.col("peer")).alias("id"), "company_id", "peer", F.array_join(found, "、").alias("products"), approach.alias("approach"), excerpt.alias("excerpt"))


def vendor_cases(pages: DataFrame) -> DataFrame:
    """(id, company_id, vendor, source_id, excerpt) of pages (company_id, company, vendor, url, text, lines) that name both."""
    rows = pages.filter(F.contains("text", "company") & F.contains("text", "vendor"))
    excerpt = F.array_join(F.slice(F.filter("lines", lambda x: F.contains(x, F.col("company")) | F.contains(x, F.col("vendor"))), 1, 5), "；")
    return rows.select(stable_id("relationship", F.col("company_id"), F.lit("it_vendor"), F.col("vendor")).alias("id"), "company_id", "vendor", stable_id("src", F.col("url"), content_fingerprint(F.col("text"))).alias("source_id"), excerpt.alias("excerpt"))
