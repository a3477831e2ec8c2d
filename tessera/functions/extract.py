"""Rule-based readers of notices, postings and company cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import keyword_hits, stable_id

# Words that sort a founder's past, in order of what weighs more, and signs of delivery on site.
FOUNDER_BUCKETS = (
    ("institute", "高校|科研院所|央国企|产业老兵"),
    ("platform", "阿里|钉钉|蚂蚁|字节|火山|剪映|飞书|百度|腾讯|华为|大模型公司系"),
    ("foreign", "外企|跨国"),
    ("consulting", "咨询"),
    ("finance", "金融机构"),
)
SYSTEMS = [("数据平台", "数据平台|数据资源|数据治理|数据仓库|大数据"), ("ERP", "(?i)ERP"), ("CRM", "(?i)CRM"), ("BI", "(?i)BI|商业智能"), ("OA", "(?i)OA|协同办公"), ("MES", "(?i)MES")]
PROJECT, BUYER = ("项目名称", "采购项目名称"), ("采购单位", "采购人名称", "采购人")
ON_SITE = "驻场|派驻|现场交付|交付中心|驻厂"


def founder_bucket(tags: Column) -> Column:
    """The first bucket that any of the tags falls into; null without one."""
    joined = F.array_join(tags, "、")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FOUNDER_BUCKETS):
        out = F.when(joined.rlike(pattern), name).otherwise(out)
    return out


def initial_relevance(narrative: Column, deliverable: Column, *more: Column) -> Column:
    """adjacent with signs of delivery on site, unclear without any text, else vendor."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    whole = F.concat_ws(" ", *(blank(c) for c in (narrative, deliverable, *more)))
    return F.when(whole.rlike(ON_SITE), "adjacent").when((blank(narrative) == "") & (blank(deliverable) == ""), "unclear").otherwise("vendor")


def first_iso_date(text: Column) -> Column:
    """The first date in the text as an ISO string; null without one."""
    at = r"(\d{4})\s*[年\-/.]\s*(\d{1,2})\s*[月\-/.]\s*(\d{1,2})"
    part = lambda g: F.regexp_extract(text, at, g)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def label_value(lines: Column, labels) -> Column:
    """The value behind the first label on the first line that has one of them, wherever it stands; null without one."""
    behind = lambda x: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(x, rf"{n}\s*[：:]?\s*(.+)$", 1)), F.lit("")) for n in labels))
    return F.get(F.filter(F.transform(lines, behind), lambda v: v.isNotNull()), F.lit(0))


def vendors(lines: Column) -> Column:
    """The suppliers that won, each once; lines that go on with an address name none."""
    found = F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"中标(?:成交)?供应商名称\s*[：:]\s*(.+)$", 1)))
    return F.array_distinct(F.filter(found, lambda v: (v != "") & ~v.rlike("[、，]地址")))


def procurements(notices: DataFrame) -> DataFrame:
    """(company_id, system_id, org_id, category, product, buyer, vendors, requirements, published_at) of notices (company_id, lines).

    Notices without a project, a buyer or a date give none.
    """
    need = F.array_join(F.slice(F.filter("lines", lambda x: x.rlike("采购需求|用途|简要技术|服务要求")), 1, 5), "；")
    rows = notices.withColumns({"product": label_value(F.col("lines"), PROJECT), "buyer": label_value(F.col("lines"), BUYER), "requirements": need, "published_at": first_iso_date(F.array_join("lines", "\n"))})
    rows = rows.filter("product is not null and buyer is not null and published_at is not null").withColumn("category", first_category(F.concat_ws("\n", "product", "requirements"), SYSTEMS, "其他"))
    ids = {"system_id": stable_id("sys", F.col("company_id"), F.col("category"), F.col("product")), "org_id": stable_id("org", F.col("company_id"), F.col("buyer"))}
    return rows.withColumns(ids).select("company_id", "system_id", "org_id", "category", "product", "buyer", F.array_join(vendors(F.col("lines")), "、").alias("vendors"), "requirements", "published_at")


def keyword_tags(text: Column, words) -> Column:
    return F.array_join(keyword_hits(text, words), "、")


def first_category(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule (name, pattern) that fits."""
    out = F.lit(otherwise).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def postings(lines: DataFrame, doc: str, place: str, line: str, is_title: Column, most: int = 7) -> DataFrame:
    """(doc, posting, title, excerpt): a title line and up to `most` - 1 lines after it, until the next title."""
    w = Window.partitionBy(doc).orderBy(place)
    numbered = lines.withColumn("posting", F.sum(is_title.cast("int")).over(w)).filter("posting > 0")
    own = numbered.withColumn("k", F.row_number().over(Window.partitionBy(doc, "posting").orderBy(place))).filter(F.col("k") <= most)
    parts = F.array_sort(F.collect_list(F.struct("k", F.col(line).alias("line"))))
    return own.groupBy(doc, "posting").agg(F.min_by(line, "k").alias("title"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("excerpt"))


def org_tree(people: DataFrame, person: str, reports_to: str) -> DataFrame:
    """(person, parent, is_root, reports): who has no known superior is a root."""
    known = people.select(F.col(person).alias("parent"))
    links = people.join(known, people[reports_to] == known["parent"], "left").select(person, "parent")
    below = links.filter("parent is not null").groupBy(F.col("parent").alias("boss")).agg(F.count("*").alias("reports"))
    out = links.join(below, links[person] == below["boss"], "left")
    return out.select(person, "parent", F.col("parent").isNull().alias("is_root"), F.coalesce("reports", F.lit(0)).alias("reports"))


def first_matches(rules: DataFrame, rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """For each rule (rule, pattern) the first row, by `order`, whose text fits it.

    rules is a small table of the caller's own (a few dozen rows); it reaches the scan of rows as
    an array of one scalar, so rows are neither shuffled nor paired up before they are filtered.
    """
    table = rules.agg(F.collect_list(F.struct("rule", "pattern")).alias("r"))
    hits = rows.withColumn("r_", table.scalar()).withColumn("hit_", F.explode("r_")).filter(F.expr(f"{text} rlike hit_.pattern"))
    names = rows.columns
    best = hits.groupBy(F.col("hit_.rule").alias("rule")).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("b"))
    return best.select("rule", "b.*")
