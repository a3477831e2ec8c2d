"""Reading a free-form request: term correction, entity, probe, salient terms, routing, search tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Corrections (word, its right form), noise before an entity, clause markers, suffixes and stop words.
TERM_RULES = (
    ("(?i)(?<![A-Za-z0-9_])opc(?![A-Za-z0-9_])", "OCP", "Open Compute Project（开放计算项目）"),
    ("(?i)(?<![A-Za-z0-9_])octp(?![A-Za-z0-9_])", "OCTC", "开放数据中心标准推进委员会"),
    ("(?i)(?<![A-Za-z0-9_])baidci?(?![A-Za-z0-9_])", "AIDC", "AI Data Center（人工智能数据中心）"),
    ("(?i)(?<![A-Za-z0-9_])ai ?dc(?![A-Za-z0-9_])", "AIDC", "AI Data Center（人工智能数据中心）"),
    ("(?i)(?<![A-Za-z0-9_])openbmc(?![A-Za-z0-9_])", "OpenBMC", "开放基板管理控制器固件项目"),
    ("(?i)(?<![A-Za-z0-9_])hpos(?![A-Za-z0-9_])", "HPoS", "High Power over Silicon（高功率供电架构）"),
    ("(?i)(?<![A-Za-z0-9_])fde工程师(?=[A-Za-z0-9_])", "前置部署工程师", "Forward Deployed Engineer 的中文说法"),
    ("广联达控股(?=[A-Za-z0-9_])", "广联达科技股份有限公司", "全称；上市主体是广联达科技，不是广联达控股"),
)
LEAD_NOISE = r"^(我)?(刚才?|昨天|今天|前几天|之前)?(听说|听到|看到|据说|据传|传闻|好像|似乎|了解到)?[，,、：:\s]*"
CLAUSE_MARKERS = (
    "最近|近期|目前|正在|已经|刚刚|日前|今年|去年|上个?月|本周",
    "启动|宣布|发布|推出|完成|签[约下]|中标|收购|投资|融资|上市|建设|落地|开工|交付|部署|计划|拟|将要?|要做|开始",
    "的|了|在|把|被|和|与|跟|对|向|从|给",
)
GEO_PREFIX = "^(北京|上海|深圳|广州|杭州|成都|天津|重庆|南京|武汉|西安|苏州|中国)"
LEGAL_SUFFIX = "(股份有限公司|有限责任公司|有限公司|集团股份|集团|控股|股份|科技)$"
SALIENT_STOPS = ("CEO", "CTO", "CFO", "COO", "IPO", "VC", "PE", "AI", "IT", "CN", "US", "PDF", "URL")
# Fixed values: (dimension, strong words, weak words, kinds it is the default of), and what is asked where nothing fits.
ROUTES = [
    ("shareholders", "股东|持股|股权|控股|实际控制人|大股东|股份|出资|注册资本|(?i:shareholder|ownership|equity stake|controller)", ("上市|融资|投资人", "(?i)IPO|listing"), ()),
    ("team", "创始人|CEO|CTO|CFO|高管|管理层|负责人|总裁|董事|联创|(?i:founder|executive|leadership|headcount)", ("团队|人员|招聘", "(?i)team|hiring"), ()),
    ("funding", "融资|估值|投资方|VC|PE|轮次|A轮|B轮|C轮|上市|IPO|并购|收购|(?i:funding|valuation|investor|series [a-z]|acquisition|M&A)", ("资金|财务", "(?i)revenue|ARR"), ()),
    ("business", "产品|方案|服务|卖|收入|客户|商业模式|营收|主营|(?i:product|solution|customer|revenue|business model)", ("做什么|干什么|是什么", "(?i)what.*do|how.*work"), ("brand", "unknown")),
    ("fde", "(?i:前置部署|驻场|交付|FDE|forward deploy|OCP|OCTC|开放计算|数据中心|AIDC|算力|GPU集群)|工程师组织|交付工程|解决方案工程", ("部署|实施|现场", "(?i)deploy|on-?site"), ()),
    ("background", "成立|创办|历史|背景|诉讼|合规|监管|处罚|IPO招股书|(?i:founded|history|litigation|compliance|regulatory)", ("公司|企业", "(?i)company|corp"), ("legal",)),
]
FALLBACK = ("business", "fde")
ENTITY_LIMIT, PROBE, TASKS = 24, 4, 4


def correct_terms(text: Column, rules=TERM_RULES) -> Column:
    """Every rule in order. The edges of words are ASCII ones, so that a term next to CJK is found as well.

    A term that itself ends in CJK has its edge where a letter or digit follows.
    """
    for pattern, right, _ in rules:
        text = F.regexp_replace(text, pattern, right)
    return text


def term_corrections(text: Column, rules=TERM_RULES) -> Column:
    """array<struct<original, corrected, note>>: the first hit of each rule that applies."""
    out = []
    for pattern, right, note in rules:
        hit = F.regexp_extract(text, f"({pattern})", 1)
        out.append(F.when(hit != "", F.struct(hit.alias("original"), F.lit(right).alias("corrected"), F.lit(note).alias("note"))))
        text = F.regexp_replace(text, pattern, right)
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def entity_name(text: Column, limit: int = ENTITY_LIMIT) -> Column:
    """The noun phrase that a request begins with: noise dropped, cut at the first clause marker."""
    def once(value: Column, use) -> Column:
        """use(value) with value computed once, however often it is named."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def cut(clause: Column) -> Column:
        at = F.length(clause) + 1
        places = F.array(at, *(F.regexp_instr(clause, F.lit(m)) for m in CLAUSE_MARKERS))
        end = F.array_min(F.filter(places, lambda x: x > 1))
        head = F.trim(F.substring(clause, F.lit(1), (F.coalesce(end, at) - 1).cast("int")))
        return once(head, lambda h: F.when(F.length(h) >= 2, h).otherwise(clause))

    def first(bare: Column) -> Column:
        clause = F.trim(F.element_at(F.split(bare, r"[，,。！？!?；;\n]"), 1))
        return F.when(bare == "", F.trim(text)).otherwise(once(once(clause, lambda c: F.when(c == "", bare).otherwise(c)), cut))

    return F.substring(once(F.trim(F.regexp_replace(F.trim(text), LEAD_NOISE, "")), first), 1, limit)


def relevance_probe(name: Column, size: int = PROBE) -> Column:
    """The telling beginning of a company's name: place and legal suffixes peeled off."""
    clean = F.regexp_replace(name, r"[\s　（）()]", "")
    core = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.regexp_replace(clean, GEO_PREFIX, ""), lambda c, _: F.when(F.length(F.regexp_replace(c, LEGAL_SUFFIX, "")) < 2, c).otherwise(F.regexp_replace(c, LEGAL_SUFFIX, "")))
    chosen = F.transform(F.array(core), lambda c: F.when(F.length(c) >= 2, c).otherwise(clean))
    return F.substring(F.element_at(chosen, 1), 1, size)


def is_relevant(name: Column, text: Column) -> Column:
    """Whether a hit mentions the entity; names without CJK are not judged."""
    probe = relevance_probe(name)
    return (F.length(probe) < 2) | ~probe.rlike(r"[\x{4E00}-\x{9FA5}]") | F.contains(text, probe)


def degraded_batches(hits: DataFrame, batch: str, name: str, text: str) -> DataFrame:
    """batch, degraded: whether no hit of the batch mentions its entity."""
    return hits.groupBy(batch).agg((~F.max(is_relevant(F.col(name), F.col(text)))).alias("degraded"))


def salient_terms(text: Column, entity: Column, most: int = 3) -> Column:
    """Acronyms and model numbers of the text that the entity's name does not hold; ASCII word edges."""
    patterns = (r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9]{1,7})(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])([A-Z]{1,3}\d{2,4})(?![A-Za-z0-9_])")
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))
    kept = F.filter(F.array_distinct(found), lambda t: ~t.isin(*SALIENT_STOPS) & ~F.contains(F.upper(entity), t))
    return F.slice(kept, 1, most)


def route(requests: DataFrame, text: str, kind: str, rules: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]] = ROUTES, fallback: tuple[str, ...] = FALLBACK) -> DataFrame:
    """Rows (all columns of requests, dimension, confidence, place), best first by place.

    rules: (dimension, pattern of strong words, patterns of weak words, kinds it is the default
    of). One strong word gives high, two weak patterns medium, the kind default; a request that
    nothing fits gets the fallback dimensions.
    """
    fits = []
    for i, (dimension, strong, weak, kinds) in enumerate(rules):
        weak_hits = sum((F.col(text).rlike(w).cast("int") for w in weak), F.lit(0))
        grade = F.when(F.col(text).rlike(strong), 0).when(weak_hits >= 2, 1).when(F.col(kind).isin(*kinds) if kinds else F.lit(False), 2)
        fits.append(F.when(grade.isNotNull(), F.struct(grade.alias("grade"), F.lit(i).alias("at"), F.lit(dimension).alias("dimension"))))
    found = F.array_sort(F.filter(F.array(*fits), lambda x: x.isNotNull()))
    spare = F.array(*(F.struct(F.lit(2).alias("grade"), F.lit(len(rules) + i).alias("at"), F.lit(d).alias("dimension")) for i, d in enumerate(fallback)))
    rows = requests.select("*", F.posexplode(F.when(F.size(found) > 0, found).otherwise(spare)).alias("place", "hit_"))
    names = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("default")), F.col("hit_.grade") + 1)
    return rows.withColumns({"dimension": F.col("hit_.dimension"), "confidence": names, "place": F.col("place") + 1}).drop("hit_")


def search_tasks(routed: DataFrame, key: str, entity: str, terms: str, hints: DataFrame, most: int = TASKS) -> DataFrame:
    """(key, place, kind, dimension, query): the bare entity, the salient terms, then hints by dimension.

    routed: rows of route() with an entity and an array of salient terms; hints: (dimension, n, hint).
    """
    first = routed.filter("place = 1")
    anchor = first.select(key, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("anchor").alias("kind"), "dimension", F.col(entity).alias("query"))
    salient = first.select(key, F.lit(1).alias("a"), F.posexplode(terms).alias("b", "t"), "dimension", entity).select(key, "a", "b", F.lit("salient").alias("kind"), "dimension", F.concat_ws(" ", entity, "t").alias("query"))
    hinted = routed.join(hints.filter("n <= 2"), "dimension").select(key, (F.col("place") + 1).alias("a"), F.col("n").alias("b"), F.lit("dimension").alias("kind"), "dimension", F.concat_ws(" ", entity, "hint").alias("query"))
    rows = anchor.union(salient).union(hinted)
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy(key, "query").orderBy("a", "b"))).filter("r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("a", "b"))).filter(F.col("place") <= most).select(key, "place", "kind", "dimension", "query")
