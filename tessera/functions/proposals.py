"""What may be proposed for a candidate from its text alone: scope, time, kind of entity, state of knowledge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dates import latest_past_date

# Words of legal persons, regions, provinces, measures, and suffixes that tell the kind of an entity.
LEGAL = "有限公司|股份公司|有限责任公司|合伙企业|事务所|研究院|大学|银行|支行|分行|集团"
REGIONS = ("全国", "华东", "华南", "华北", "华中", "西南", "西北", "东北", "长三角", "珠三角", "京津冀", "粤港澳", "海外", "全球")
PROVINCES = ("北京", "上海", "天津", "重庆", "广东", "江苏", "浙江", "山东", "河南", "河北", "四川", "湖北", "湖南", "福建", "安徽", "陕西", "江西", "辽宁", "山西", "云南", "贵州", "广西", "内蒙古", "新疆", "西藏", "宁夏", "青海", "甘肃", "海南", "吉林", "黑龙江", "香港", "澳门", "台湾")
MEASURES = ("营业收入", "营收", "净利润", "毛利率", "出货量", "产能", "装机", "中标金额", "合同金额", "持股比例", "股权比例", "注册资本", "市场份额", "交易金额", "采购金额")
KINDS = (
    ("legal", "有限公司|股份公司|集团有限公司|有限责任公司|合伙企业|事务所|研究院|大学|银行$|支行$|分行$"),
    ("project", "(基地|工程|项目|中心建设)$"),
    ("site", "(园区|产业园|众创城|集群|开发区|厂区|车间)$"),
)
DECLARED = ("legal", "brand", "project", "site", "asset", "unknown")
HYPOTHESIS, INTERPRETATION = "【待核实?】|待核", "【推测】"


def entity_kind(name: Column, declared: Column) -> Column:
    """By the name's suffix, else as declared if that is a kind, else unknown."""
    out = F.when(F.lower(F.trim(declared)).isin(*DECLARED), F.lower(F.trim(declared))).otherwise("unknown")
    for kind, pattern in reversed(KINDS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def epistemic_state(*texts: Column) -> Column:
    whole = F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))
    return F.when(whole.rlike(HYPOTHESIS), "hypothesis").when(whole.rlike(INTERPRETATION), "interpretation").otherwise("observation")


def joined_evidence(*texts: Column) -> Column:
    """The parts that are not blank, trimmed, in order."""
    return F.array_join(F.filter(F.array(*(F.trim(F.coalesce(t, F.lit(""))) for t in texts)), lambda x: x != ""), "；")


def words_in(text: Column, words: tuple[str, ...], most: int = 4) -> Column:
    return F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), 1, most)


def entity_scope(names: Column) -> Column:
    """An array of names as one text: legal persons first, then those that still need their full name."""
    own = F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""))
    legal, loose = F.filter(own, lambda n: n.rlike(LEGAL)), F.filter(own, lambda n: ~n.rlike(LEGAL))
    told = F.when(F.size(loose) > 0, F.concat(F.lit("（以下还不是法人全称，需补："), F.array_join(loose, " / "), F.lit("）")))
    return F.concat_ws(" ", F.nullif(F.array_join(legal, " / "), F.lit("")), told)


def market_region(text: Column) -> Column:
    return F.array_join(words_in(text, REGIONS + PROVINCES), " / ")


def data_basis(text: Column) -> Column:
    hits = words_in(text, MEASURES)
    return F.when(F.size(hits) > 0, F.concat(F.array_join(hits, " / "), F.lit("（口径以原文为准）"))).otherwise("")


def time_window(text: Column, as_of: str) -> Column:
    day = latest_past_date(text, as_of)
    return F.when(day.isNotNull(), F.concat(F.lit("材料时点 "), F.date_format(day, "yyyy-MM-dd"), F.lit(" 起"))).otherwise("")


def proposed_scope(title: Column, evidence: Column, names: Column, as_of: str) -> Column:
    """struct<entity_scope, market_region, data_basis, time_window>, blank where the text says nothing. What we can do with it is for people to say."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(evidence, F.lit("")))
    return F.struct(entity_scope(names).alias("entity_scope"), market_region(text).alias("market_region"), data_basis(text).alias("data_basis"), time_window(text, as_of).alias("time_window"))
