"""Facts of paged filings with the page each stands on, and one source for each page that is cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.discovery import flat
from tessera.functions.filings import filing_plain
from tessera.functions.text import content_fingerprint, stable_id

# Business lines with their turnover and its change, the rows of the table of key figures, and how a career is told.
LINES = (
    ("数字成本", "数字成本业务", r"[\s\S]{0,260}?营业收入\s*([\d,.]+)\s*亿元[\s\S]{0,50}?同比(下降|增长)\s*([\d.]+)%"),
    ("数字施工", "数字施工业务", r"[\s\S]{0,260}?营业收入\s*([\d,.]+)\s*亿元[\s\S]{0,50}?同比(下降|增长)\s*([\d.]+)%"),
    ("数字设计", "数字设计业务", r"[\s\S]{0,260}?营业收入\s*([\d,.]+)\s*万元[\s\S]{0,50}?同比(下降|增长)\s*([\d.]+)%"),
    ("海外", "海外业务", r"[\s\S]{0,180}?营业收入\s*([\d,.]+)\s*亿元[\s\S]{0,50}?同比(下降|增长)\s*([\d.]+)%"),
)
FIGURES = (
    ("revenue", "主要会计数据和财务指标", r"营业收入（元）\s*([\d,.]+)\s+([\d,.]+)\s+[+-]?[\d.]+%\s+([\d,.]+)", 3),
    ("net_profit", "主要会计数据和财务指标", r"归属于上市公司股东的净利润\s*([\d,.]+)\s+([\d,.]+)\s+[+-]?[\d.]+%\s+([\d,.]+)", 3),
    ("rnd_expense", "公司研发投入情况", r"研发投入金额（元）\s*([\d,.]+)\s+([\d,.]+)", 2),
)
CAREER = r"([\x{4E00}-\x{9FFF}]{2,4})先生：([\s\S]{0,500}?)现任本公司([^。]+)。"
#: Fixed values: (kind, name, what a page must hold, the excerpt): terms, process steps and systems by the page that tells of them.
PASSAGES = (
    ("term", "CDE / GDE / ECS", r"CDE\s*数据\s*集成环境[、，]", r"CDE\s*数据\s*集成环境[\s\S]{0,100}ECS\s*数据\s*转换环境"),
    ("term", "AecGPT", r"AecGPT\s*建筑产业大模型", r"AecGPT\s*建筑产业大模型[\s\S]{0,180}?七大领域"),
    ("term", "STL 组织", r"STL\s*组织模式", r"STL\s*组织模式（[^）]+）"),
    ("term", "工程算量", "工程算量、工程计价、工程数据、工程成本", r"工程算量、工程计价、工程数据、工程成本[\s\S]{0,80}?产品"),
    ("term", "清标 / 评标", r"AI\s*清标、AI\s*编标、AI\s*评标", r"AI\s*算量[\s\S]{0,120}?AI\s*评标"),
    ("business_line", "平台与生态", "AECOS 产业业务平台", r"AECOS 产业业务平台[\s\S]{0,260}?柔性数据标准体系"),
    ("process_step", "图纸/模型 → 算量 → 组价 → 投标/清标/评标", r"AI\s*算量[\s\S]{0,160}?AI\s*评标", r"AI\s*算量[\s\S]{0,160}?AI\s*评标"),
    ("process_step", "数据接入/转换 → 统一标准 → 组件复用 → 产品/伙伴应用", r"CDE\s*数据\s*集成环境[\s\S]{0,180}?柔性数据标准体系", r"CDE\s*数据\s*集成环境[\s\S]{0,180}?柔性数据标准体系"),
    ("process_step", "项目立项 → 人机料采集 → 进度/安全/成本分析 → 项目决策", "数字施工业务包括企业级管理软件以及项目级管理软件", r"数字施工业务包括[\s\S]{0,180}?智能塔机"),
    ("process_step", "多专业设计 → 构件协同 → 算量/成本校核 → BIM 交付", "数维房建设计和数维基建设计", r"数字设计业务[\s\S]{0,180}?数维基建设计"),
    ("system", "AECOS", "AECOS 产业业务平台", r"AECOS 产业业务平台[\s\S]{0,300}?柔性数据标准体系"),
    ("system", "AecGPT", r"AecGPT\s*建筑产业大模型", r"AecGPT\s*建筑产业大模型[\s\S]{0,360}?AI\s*评标"),
    ("system", "项目综合决策 / 物料管理 / 劳务管理 / 安全管理 / 智能塔机", "项目综合决策、物料管理、劳务管理、安全管理、智能塔机", r"企业级管理软件[\s\S]{0,180}?智能塔机"),
)

# What a glossary's page holds, and its terms with those that may come next.
GLOSSARY_PAGE = r"数字建筑\s+指"
GLOSSARY = (("数字建筑", ("数字设计", "BIM", "CIM", "SaaS", "PaaS", "人工智能/AI")), ("BIM", ("CIM", "SaaS", "PaaS", "人工智能/AI")), ("SaaS", ("PaaS", "人工智能/AI")))


def _first_page(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """The earliest page's row for each document and key."""
    return rows.groupBy("doc_id", *keys).agg(F.min_by(F.struct("page_no", *values), F.struct("seq")).alias("b")).select("doc_id", *keys, "b.*")


def business_lines(pages: DataFrame, lines: tuple = LINES) -> DataFrame:
    """(doc_id, name, page_no, revenue, change, excerpt): pages are (doc_id, seq, page_no, text); the first page that tells of a line counts.

    lines: (name, opening, pattern of what follows). A page is searched once for a line, and only if
    it holds the line's opening; the numbers are then read from the passage found.
    """
    found = [F.when(F.contains("text", F.lit(opening)), F.struct(F.lit(name).alias("name"), F.regexp_extract("text", f"({opening}{rest})", 1).alias("whole"), F.lit(k).alias("k"))) for k, (name, opening, rest) in enumerate(lines)]
    rows = pages.select("doc_id", "seq", "page_no", F.explode(F.filter(F.array(*found), lambda x: x["whole"] != "")).alias("x")).select("doc_id", "seq", "page_no", "x.*")
    first = _first_page(rows, ["name"], "whole", "k")
    part = lambda n: F.coalesce(*(F.when(F.col("k") == k, F.regexp_extract("whole", opening + rest, n)) for k, (_, opening, rest) in enumerate(lines)))
    change = F.concat(F.when(part(2) == "下降", "-").otherwise("+"), part(3), F.lit("%"))
    return first.select("doc_id", "name", "page_no", part(1).alias("revenue"), change.alias("change"), flat(F.col("whole")).alias("excerpt"))


def passages(pages: DataFrame, rules: tuple = PASSAGES) -> DataFrame:
    """(doc_id, kind, name, page_no, excerpt): the first page that holds what a rule asks for, and the passage there, if it is whole."""
    found = [F.when(F.col("text").rlike(must), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), flat(F.regexp_extract("text", f"({cut})", 1)).alias("excerpt"))) for kind, name, must, cut in rules]
    rows = pages.select("doc_id", "seq", "page_no", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("doc_id", "seq", "page_no", "x.*")
    return _first_page(rows, ["kind", "name"], "excerpt").filter("excerpt <> ''")


def glossary(pages: DataFrame, terms: tuple = GLOSSARY, opens: str = GLOSSARY_PAGE) -> DataFrame:
    """(doc_id, name, page_no, meaning): terms that the first page with a glossary explains, up to the next term it explains."""
    own = pages.filter(F.col("text").rlike(opens)).groupBy("doc_id").agg(F.min_by(F.struct("page_no", "text"), "seq").alias("b")).select("doc_id", "b.page_no", flat(F.col("b.text")).alias("t"))
    cells = [F.struct(F.lit(term).alias("name"), F.substring(F.regexp_replace(F.trim(F.regexp_extract("t", rf"{term}\s+指\s+(.{{12,420}}?)(?=(?:{'|'.join(after)})\s+指|$)", 1)), r"[，,]?\s*$", ""), 1, 180).alias("meaning")) for term, after in terms]
    return own.select("doc_id", "page_no", F.explode(F.array(*cells)).alias("x")).select("doc_id", "x.name", "page_no", "x.meaning").filter("meaning <> ''")


def financial_years(pages: DataFrame, year: Column, figures: tuple = FIGURES) -> DataFrame:
    """(doc_id, year, measure, page_no, value, excerpt): key figures of the report's year and those before it, where disclosed."""
    rows = pages.withColumns({"year_": year, "flat_": flat(F.col("text"))})
    cells = []
    for measure, must, pattern, n in figures:
        whole = F.regexp_extract("flat_", f"({pattern})", 1)
        for k in range(n):
            value = F.regexp_replace(F.regexp_extract("flat_", pattern, k + 1), ",", "").try_cast("double")
            cells.append(F.when(F.col("text").rlike(must), F.struct((F.col("year_") - k).alias("year"), F.lit(measure).alias("measure"), value.alias("value"), whole.alias("excerpt"))))
    out = rows.select("doc_id", "seq", "page_no", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("doc_id", "seq", "page_no", "x.*")
    return _first_page(out, ["year", "measure"], "value", "excerpt").filter("value is not null")


def careers(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, name, title, bio, excerpt): who holds which post, with the last sentence of what came before."""
    part = lambda k: F.regexp_extract_all("text", F.lit(f"({CAREER})"), F.lit(k))
    rows = pages.select("doc_id", "page_no", F.explode(F.arrays_zip(part(1).alias("w"), part(2).alias("n"), part(3).alias("b"), part(4).alias("t"))).alias("x"))
    past = F.filter(F.transform(F.split(flat(F.col("x.b")), "。"), lambda s: F.trim(s)), lambda s: s != "")
    bio = F.coalesce(F.try_element_at(past, F.lit(-1)), F.lit(""))
    return rows.select("doc_id", "page_no", F.col("x.n").alias("name"), flat(F.col("x.t")).alias("title"), F.substring(bio, 1, 180).alias("bio"), flat(F.col("x.w")).alias("excerpt"))


def page_sources(facts: DataFrame, pages: DataFrame, filings: DataFrame) -> DataFrame:
    """(id, doc_id, page_no, url, published_at, fingerprint, excerpt): a source for each page that facts (doc_id, page_no) cite.

    filings: (doc_id, url, published_at). The address points to the page.
    """
    cited = facts.select("doc_id", "page_no").distinct()
    rows = pages.groupBy("doc_id", "page_no").agg(F.min_by("text", "seq").alias("text")).join(cited, ["doc_id", "page_no"], "left_semi").join(filings, "doc_id")
    url, print_ = F.concat("url", F.lit("#page="), F.col("page_no").cast("string")), content_fingerprint(F.col("text"))
    return rows.select(stable_id("src", F.col("url"), F.col("page_no"), print_).alias("id"), "doc_id", "page_no", url.alias("url"), "published_at", print_.alias("fingerprint"), F.substring("text", 1, 4000).alias("excerpt"))


def latest_report(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, date, href): the latest full report that a page of results links to.

    Links to a .pdf below /listedco/listconews/ with a date in their path; summaries, supplements
    and corrections only where there is nothing else. Ties go by the place on the page.
    """
    pattern = r'(?is)<a[^>]+href="([^"]*/listedco/listconews/[^"]*\.pdf)"[^>]*>(.*?)</a>'
    part = lambda k: F.regexp_extract_all(html, F.lit(pattern), F.lit(k))
    rows = pages.select(key, F.posexplode(F.arrays_zip(part(1).alias("h"), part(2).alias("t"))).alias("at", "x"))
    href, title = F.replace("x.h", F.lit("&amp;"), F.lit("&")), flat(filing_plain(F.col("x.t")))
    stamp = lambda k: F.regexp_extract(href, r"/(\d{4})/(\d{2})(\d{2})/", k)
    rows = rows.select(key, "at", title.alias("title"), F.concat_ws("-", stamp(1), stamp(2), stamp(3)).alias("date"), href.alias("href")).filter("date <> '--' and title <> ''")
    lesser = F.col("title").rlike("(?i)summary|supplement|errat|amend|corrigend")
    w = Window.partitionBy(key).orderBy(lesser, F.desc("date"), "at")
    return rows.withColumn("k_", F.row_number().over(w)).filter("k_ = 1").select(key, "title", "date", "href")
