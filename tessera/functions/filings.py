"""Facts in the text of filings: values behind labels, ticked boxes, sections; annual reports and 10-Ks as rules.

Rules are data; readers run as pandas functions over batches of documents, as a value's place depends on where its label ended.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import WHITE

#: Characters that a value may reach beyond the window in which it begins.
TAIL = 40
NUMBER, PERCENT = r"-?[\d,]+(?:\.\d+)?", r"-?[\d.]+%"
HIT = "struct<value: string, quote: string>"
FACTS = "array<struct<dimension: string, key: string, value: string, quote: string>>"
# Tables of staff by occupation begin and end with these; the kinds of staff, the closest to delivery first.
STAFF_TABLE, STAFF_END, STAFF_SPAN = "专业构成类别", "教育程度", 600
STAFF = ("现场实施", "交付人员", "实施人员", "技术人员", "产品技术")
HEADCOUNT = ("报告期末在职员工的数量合计（人）", "在职员工的数量合计")
# Fixed values: (dimension, key, how, what): labels with the form of their value and the window, boxes with their two readings, sections.
REPORT_RULES = (
    ("shareholders", "controller", "value", (("公司实际控制人为", r"^[ \t]*[一-龥]{2,8}(?=[，。、（(\n]|及其|$)", 60), ("本企业最终控制方是", r"^[ \t]*[一-龥]{2,8}(?=[，。、（(\n]|$)", 60), ("实际控制人性质：", r"^[ \t]*[^\s]{2,20}", 80))),
    ("shareholders", "majorHolders", "value", (("控股股东性质[：:]", r"[^\s]{2,24}", 80),)),
    ("shareholders", "capTable", "box", ("控股股东报告期内变更", "报告期内控股股东发生变更", "报告期内控股股东未发生变更", 200)),
    ("team", "headcount", "staff", ()),
    ("team", "fdeLeads", "value", (("研发人员数量（人）", NUMBER, 120, "研发人员 {} 人（年报口径为研发，非交付岗口径）"),)),
    ("business", "customers", "value", (("前五名客户合计销售金额占年度销售总额比例", PERCENT, 160),)),
    ("business", "whatTheySell", "section", ("公司从事的主要业务|报告期内公司所处行业情况|主要业务及经营模式", 500)),
    ("fde", "productization", "value", (("研发人员数量占比", PERCENT, 120, "研发人员占全体员工 {}（年报口径，用于观察研发/交付人力结构）"),)),
    ("background", "litigation", "box", ("重大诉讼、仲裁事项", "报告期内有重大诉讼或仲裁", "报告期内无重大诉讼、仲裁事项", 260)),
    ("background", "partnerships", "box", ("与日常经营相关的关联交易", "报告期内有日常经营关联交易", "报告期内无日常经营关联交易", 200)),
)
TEN_K_RULES = (
    ("team", "headcount", "value", (("we had ", r"[\d,]+ full-time employees", 80),)),
    ("business", "whatTheySell", "section", (r"Overview\s+We (?:build|are|provide)|Our platforms", 500)),
    ("background", "competitors", "section", (r"Competition\s+(?:We|The market)", 400)),
    ("background", "litigation", "section", (r"Legal Proceedings\s+(?:From time to time|We are|For a discussion)", 300)),
)
Hit = tuple[str, str] | None


def _flat(s: str) -> str:
    return " ".join(s.split())


def _after(text: str, label: str, value: str, window: int) -> Hit:
    """The first value that begins within the window behind any place of the label; a blank line ends the window."""
    for m in re.finditer(label, text):
        part = text[m.start() : m.start() + window + TAIL]
        end = re.search(r"\n[ \t]*\n", part)
        if end and end.start():
            part = part[: end.start()]
        size = len(m[0])
        found = re.search(value, part[size:])
        if found and size + found.start() <= window:
            return found[0].strip(), _flat(part[: size + found.end()])
    return None


def _box(text: str, label: str, yes: str, no: str, window: int) -> Hit:
    for m in re.finditer(label, text):
        part = text[m.start() : m.start() + window]
        box = re.search(r"([□☑])\s*适用\s*([□☑])\s*不适用", part)
        if box:
            note = re.search(r"[。\n]\s*([^\n。]{6,60}。)", part[box.end() :])
            told = note[1].strip() if note else ""
            value = (yes if box[1] == "☑" else no) + (f"——{told}" if told else "")
            return value, _flat(part[: box.end() + (len(told) + 2 if told else 0)])
    return None


def _section(text: str, start: str, most: int) -> Hit:
    m = re.search(start, text)
    raw = _flat(text[m.start() : m.start() + most]) if m else ""
    return (raw[:220], raw) if raw else None


def _staff(text: str) -> Hit:
    """Staff close to delivery with all staff beside them, if the numbers can be true; else all staff alone."""
    whole = next((h for label in HEADCOUNT if (h := _after(text, re.escape(label), NUMBER, 120))), None)
    if not whole:
        return None
    at = text.find(STAFF_TABLE)
    end = text.find(STAFF_END, at) if at >= 0 else -1
    table = text[at : end if end > 0 else at + STAFF_SPAN] if at >= 0 else ""
    own = next(((name, h) for name in STAFF if (h := _after(table, name, NUMBER, 60))), None)
    number = lambda s: float(s.replace(",", "") or "nan")
    if own and 0 < number(own[1][0]) <= number(whole[0]):
        name = next(n for n in STAFF if n in own[1][1])
        return f"{name} {own[1][0]} 人 / 全员 {whole[0]} 人（年报「专业构成」口径）", f"{own[1][1]}｜{whole[1]}"
    return f"全员 {whole[0]} 人（年报未披露专业构成，非交付口径）", whole[1]


def _read(text: str, how: str, what: tuple) -> Hit:
    if how == "value":
        for label, form, window, *shape in what:
            if hit := _after(text, label, form, window):
                return (shape[0].format(hit[0]) if shape else hit[0]), hit[1]
        return None
    return {"box": _box, "section": _section, "staff": _staff}[how](text, *what)


def _each(read: Callable[[str], Hit], text: Column) -> Column:
    @F.pandas_udf(HIT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(t or "") or (None, None) for t in texts], columns=["value", "quote"])

    return run(text)


def after_label(text: Column, label: str, value: str, window: int = 160) -> Column:
    """struct<value, quote>: the value behind a label, nulls without one. Every place of the label is tried."""
    return _each(lambda t: _after(t, label, value, window), text)


def checkbox(text: Column, label: str, yes: str, no: str, window: int = 220) -> Column:
    """struct<value, quote>: what a ticked "applies / does not apply" box behind the label says, with the note that follows."""
    return _each(lambda t: _box(t, label, yes, no, window), text)


def section_text(text: Column, start: str, most: int = 400) -> Column:
    """struct<value, quote>: `most` characters from a heading on, white space collapsed; the value is their beginning."""
    found = F.regexp_instr(text, F.lit(start))
    raw = F.trim(F.regexp_replace(F.substring(text, found, F.lit(most)), f"[{WHITE}]+", " "))
    quote = F.when((found > 0) & (raw != ""), raw)
    return F.struct(F.substring(quote, 1, 220).alias("value"), quote.alias("quote"))


def filing_facts(text: Column, rules: tuple = REPORT_RULES) -> Column:
    """array<struct<dimension, key, value, quote>>: what the rules find, in their order."""

    @F.pandas_udf(FACTS)
    def run(texts: pd.Series) -> pd.Series:
        hits = [[(d, k, _read(t or "", how, what)) for d, k, how, what in rules] for t in texts]
        return pd.Series([[{"dimension": d, "key": k, "value": h[0].strip(), "quote": h[1]} for d, k, h in row if h and h[0].strip()] for row in hits])

    return run(text)


def filing_plain(html: Column) -> Column:
    """A filing's HTML as text: no scripts and tags, entities decoded, blanks collapsed, at most one empty line."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(char))
    number = re.compile("&#(?:([0-9]+)|[xX]([0-9a-fA-F]+));")

    @F.pandas_udf("string")
    def numbered(texts: pd.Series) -> pd.Series:
        def char(m: re.Match) -> str:
            code = (int(m[1]) if m[1] else int(m[2], 16)) & 0xFFFF
            return m[0] if 0xD800 <= code <= 0xDFFF else chr(code)

        return texts.map(lambda s: None if s is None else number.sub(char, s))

    t = F.regexp_replace(F.regexp_replace(numbered(t), r"[ \t\x{A0}]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^[{WHITE}]+|[{WHITE}]+$", "")
