"""Text normalisation, identifiers and rule-based readers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of no width, white space beyond ASCII, and the CJK ranges next to which a space says nothing.
ZERO_WIDTH = "​‌‍⁠﻿­"
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CJK = r"\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FFEF}"
FINGERPRINT_LIMIT, FINGERPRINT_SIZE, MATERIAL_LIMIT = 50_000, 32, 4_000
PLACEHOLDERS = ("未知", "不详", "不明", "待补充", "待确认", "待定", "无法判断", "判断不了", "没写", "n/a", "na", "null", "-", "—", "?", "？")
STRIPPED_TAGS = ("script", "style", "noscript", "head", "nav", "footer", "header", "aside", "iframe", "figure", "svg")
BOILERPLATE = ("上一页", "下一页", "返回", "分享", "责编", "编辑", "来源")
BLOCK_TAGS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SCALE_WORDS = ("规模", "市场", "份额", "营收", "收入", "盘子", "预估", "客单", "总量", "产值", "出货", "存量", "空间")
SCALE_NUMBER = r"(?:人民币|约|超过|逾|近|已达|达)?\s*\d[\d,.]*\s*(?:亿美元|万美元|亿元|万元|亿|万|千万|百万|美元|元)"
LEGAL_WORDS = ("inc", "corp", "corporation", "co", "ltd", "limited", "llc", "lp", "plc", "holding", "holdings", "technologies", "technology", "group", "acquisition", "sa", "se", "nv", "ag", "holdco")


def normalize_corpus(text: Column) -> Column:
    """One form for all layouts of the same text; the order of the steps matters.

    Zero-width characters go; runs of white space become one space; a space next to CJK goes,
    while full-width punctuation still counts as CJK; only then full-width ASCII is narrowed.
    """
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    half = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))  # ASCII needs no more than that
    t = F.translate(text, ZERO_WIDTH, "")
    t = F.regexp_replace(t, f"[{WHITE}]+", " ")
    t = F.regexp_replace(t, f"(?<=[{CJK}]) | (?=[{CJK}])", "")
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.lower(F.trim(F.translate(t, full, half))))


def corpus_fingerprint(text: Column, limit: int = FINGERPRINT_LIMIT, size: int = FINGERPRINT_SIZE) -> Column:
    return F.substring(F.sha2(F.substring(normalize_corpus(text), 1, limit), 256), 1, size)


def content_fingerprint(text: Column) -> Column:
    """The whole hash of the text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(text, f"[{WHITE}]+", " ")), 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_hash of the trimmed, lower-cased parts."""
    joined = F.concat_ws("\u001f", *(F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 20))


def claim_text(text: Column, limit: int = 260) -> Column:
    """Lower-cased, without white space, punctuation and symbols."""
    return F.substring(F.regexp_replace(F.lower(text), rf"[\s\p{{P}}\p{{S}}]+", ""), 1, limit)


def clean_company_name(name: Column) -> Column:
    """Without brackets, what stands in parentheses, addresses of pages and closing punctuation."""
    t = F.regexp_replace(F.regexp_replace(name, r"[\[\]]", ""), r"\([^)]*\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, rf"https?://[^{WHITE}]+", " "), f"[{WHITE}]+", " ")
    return F.trim(F.regexp_replace(t, r"[-–—,.;:|]+$", ""))


def company_key(name: Column) -> Column:
    """A cleaned company name as a key: no legal words, no punctuation, & as a word."""
    low = F.replace(F.lower(clean_company_name(name)), F.lit("&"), F.lit(" and "))
    low = F.regexp_replace(low, rf"(?<![a-z0-9_])({'|'.join(LEGAL_WORDS)})(?![a-z0-9_])", " ")
    return F.regexp_replace(low, r"[^a-z0-9\x{4E00}-\x{9FFF}]+", "")


def is_placeholder(value: Column) -> Column:
    """Blank, or nothing but a word that says that the value is not known."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[。.、,，;；!！]+$", "")
    return (F.length(text) == 0) | text.isin(*PLACEHOLDERS)


def nfkc(text: Column) -> Column:
    """Normalisation form KC, by the ICU library that comes with Spark, inside the JVM; ASCII is in it already."""
    form = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(form)


def entity_key(name: Column) -> Column:
    """NFKC, lower-cased, letters and digits only."""
    return F.regexp_replace(F.lower(nfkc(name)), r"[^\p{L}\p{N}]+", "")


def coverage_text(text: Column) -> Column:
    """NFKC, lower-cased, without white space: the form in which terms are looked for in a reference."""
    return F.regexp_replace(F.lower(nfkc(text)), rf"[{WHITE}\x1C-\x1F\x85]+", "")


def hanzi_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\x{3400}-\x{9FFF}]"))


def truncated_hanzi(text: Column, most: int) -> Column:
    """The text up to its first `most` Chinese characters, with an ellipsis if one more follows."""
    kept = F.regexp_extract(text, rf"(?s)^((?:[^\x{{3400}}-\x{{9FFF}}]*[\x{{3400}}-\x{{9FFF}}]){{0,{most}}}[^\x{{3400}}-\x{{9FFF}}]*)", 1)
    return F.when(F.length(kept) < F.length(text), F.concat(kept, F.lit("…"))).otherwise(text)


def sentence_count(text: Column) -> Column:
    """Parts between full stops, question and exclamation marks that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[。！？!?]+"), lambda x: F.trim(x) != ""))


def limit_breaches(rows: DataFrame, limits: dict[str, tuple[str, int]]) -> DataFrame:
    """(all columns of rows, field, kind, found, most): limits name for a column "characters" or "sentences" and the most of them."""
    cells = [F.struct(F.lit(c).alias("field"), F.lit(kind).alias("kind"), (hanzi_count if kind == "characters" else sentence_count)(F.col(c)).alias("found"), F.lit(most).alias("most")) for c, (kind, most) in limits.items()]
    return rows.select("*", F.explode(F.array(*cells)).alias("l_")).filter("l_.found > l_.most").select(*rows.columns, "l_.*")


def bracketed_label(value: Column, limit: int = 16) -> Column:
    """What stands before the first bracket, `limit` characters at most."""
    return F.substring(F.trim(F.regexp_extract(value, "^([^（(]*)", 1)), 1, limit)


def mentioned_years(text: Column, first: int = 2000, last: int = 2030) -> Column:
    """The distinct years 20dd in a text, wherever they stand."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"20\d{2}"), F.lit(0))), lambda y: (y >= str(first)) & (y <= str(last)))


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_html(fragment: Column) -> Column:
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(fragment, "<[^>]+>", " ")), r"[\t\n\x0B\f\r \x{A0}]+", " "))


def html_body(html: Column) -> Column:
    for tag in STRIPPED_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return html


def page_title(html: Column, limit: int = 300) -> Column:
    return F.substring(strip_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, limit)


def html_to_text(html: Column, least: int = 24, whole: int = 180) -> Column:
    """The paragraphs of a page; the stripped body where they are too short together."""
    body = html_body(html)
    found = F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    kept = F.filter(F.transform(found, strip_html), lambda t: (F.length(t) >= least) & ~t.rlike("^(" + "|".join(BOILERPLATE) + ")"))
    joined = F.array_join(kept, "\n\n")
    return F.when(F.length(joined) >= whole, joined).otherwise(strip_html(body))


def html_lines(html: Column) -> Column:
    """Non-blank lines: scripts and styles removed, block tags as line ends, entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, rf"(?i)</?({'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n")
    t = decode_entities(F.regexp_replace(t, "<[^>]+>", " "))
    lines = F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x{A0}]+", " ")))
    return F.filter(lines, lambda x: F.length(x) > 0)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, white space and punctuation aside."""
    t = F.lower(F.regexp_replace(text, r"[\s　（）()【】《》「」、，。！？\-_]", ""))
    n = F.length(t)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))))


def keyword_hits(text: Column, words) -> Column:
    """The words that the text contains, case aside."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), F.lower(w)))


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + 0.5)


def scale_numbers(text: Column, words=SCALE_WORDS, number: str = SCALE_NUMBER) -> Column:
    """The numbers with units of a text that speaks of scale at all, verbatim, each once; an empty array for others."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(number), F.lit(0)), lambda x: F.trim(x)))
    return F.when(text.rlike("|".join(words)), found).otherwise(F.expr("cast(array() as array<string>)"))
