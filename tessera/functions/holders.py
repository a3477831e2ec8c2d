"""Shareholders in filings: tables of a Hong Kong report, of a US proxy statement, and lists written as text.

The tables are read by pandas functions: which line is a row depends on the columns of the lines before it.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dates import MONTHS

ROWS = "array<struct<name: string, pct: string, share_class: string, shares: string, quote: string>>"
# Where a table of holders is announced, how its parts are written, and how far to look.
HK_ANCHOR = "SUBSTANTIAL SHAREHOLDER|Substantial Shareholders['’]\\s*Interests|主要股東及其他人士|主要股東"
HK_DENSITY, HK_SPAN = 3500, 12_000
HK_PERCENT, HK_SHARES = r"(\d+\.\d+)\s*%\s*(\((?:L|S|P)\))?", r"([\d,]{7,})(?!\s*%)"
HK_CLASS, HK_CLASS_WHOLE = r"\s*(Domestic|H|Class\s+[AB])\b", r"(Domestic|H|Class\s+[AB])\s+Shares"
US_HEADING = r"greater than\s*5|more than\s*5|5%\s*(or greater\s*)?(stock|share|holder|owner)|five percent|principal (stockholders|shareholders)|substantial shareholder"
US_PROSE = r"(more than|greater than|exceeding)\s*5\s*%"
US_SHARES, US_PERCENT = r"\(?[\d,]{5,}\)?", r"\(?(\d{1,2}(?:\.\d+)?)\s*%?\)?"
US_GROUP = "as a group|all directors|total"
US_CLASS = r"Class\s+[A-Z]\s+(?:Ordinary Shares|Common Stock|ordinary shares|common stock)"
STATES = frozenset("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split())
INSTITUTIONS = ("证券投资基金", "私募基金", "投资公司", "信托", "保险", "券商", "证券账户", "QFII", "社保")


def hk_section(text: str, span: int = HK_SPAN) -> str:
    """The text from the announcement on that most digits follow; empty without one."""
    starts = [m.start() for m in re.finditer(HK_ANCHOR, text)]
    return max((text[s : s + span] for s in starts), key=lambda t: sum(c in "0123456789" for c in t[:HK_DENSITY]), default="")


def hk_rows(text: str) -> list[dict]:
    """The holders' long positions as shares of the whole company (the last percentage of a line).

    A row begins at the column of the heading Name; a line without a name belongs to the row above
    if its percentage ends in the same column. Short positions are none.
    """
    lines = hk_section(text).split("\n")
    head = next((m for line in lines if (m := re.match(r"(\s*)(Name of Shareholder|Name of shareholder|Name)(\s|$)", line))), None)
    if head is None:
        return []
    column, above, seen, out = len(head[1]), None, set(), []
    for k, line in enumerate(lines):
        shares, percents = re.search(HK_SHARES, line), [*re.finditer(HK_PERCENT, line)]
        if not shares or not percents or percents[-1][2] == "(S)":
            continue
        right = percents[-1].start() + len(percents[-1][0].rstrip())
        cells = [c for c in re.split(r"\s{2,}", line.strip()) if c]
        name = re.sub(r"\s+", " ", re.sub(r"\s*\(\d+\)", "", re.sub(r"(?i)\s*\((?:Note|附註|附注)\s*\d+\)", "", cells[0]))).strip()
        indent = len(line) - len(line.lstrip())
        if abs(indent - column) <= 1 and len(cells) >= 3 and len(re.findall("[A-Za-z一-鿿]", name)) >= 3:
            above = (name, right)
        elif above is None or abs(right - above[1]) > 3:
            continue
        end = shares.end(1)
        kind = re.match(HK_CLASS, line[end:]) or next((m for later in lines[k + 1 : k + 3] if (m := re.search(HK_CLASS_WHOLE, later[max(0, end - 40) : end + 40], re.I))), None)
        share_class = re.sub(r"\s+", " ", kind[1]).strip() + " Shares" if kind else None
        key = (above[0], percents[-1][1], share_class)
        if key not in seen:
            seen.add(key)
            out.append({"name": above[0], "pct": key[1], "share_class": share_class, "shares": shares[1], "quote": re.sub(r"\s{2,}", " ", line.strip())})
    return out


def _cell(raw: str) -> str:
    t = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", raw)
    return " ".join(entities.unescape(re.sub("<[^>]+>", " ", t)).split())


def _table(html: str) -> list[list[str]]:
    rows = [[_cell(c) for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", row)] for row in re.findall(r"(?is)<tr.*?</tr>", html)]
    return [r for r in rows if any(r)]


def _letters(s: str) -> bool:
    return len(re.findall("[A-Za-z]", s)) >= 3


def _score(cells: list[list[str]]) -> int:
    """How many rows look like holders: a name, then a large number."""
    return sum(len(r) > 1 and _letters(r[0]) and any(re.fullmatch(US_SHARES, c) for c in r[1:]) for r in cells)


def _five_percent(cells: list[list[str]]) -> list[list[str]] | None:
    """The rows below the heading of five per cent holders, up to the next heading: a row with a single filled cell."""
    alone = [(i, *f) for i, r in enumerate(cells) if len(f := [c for c in r if c]) == 1]
    start = next((i for i, t in alone if re.search(US_HEADING, t, re.I)), None)
    if start is None:
        return None
    return cells[start + 1 : next((i for i, _ in alone if i > start), len(cells))]


def _holder_name(raw: str) -> str:
    """Without footnotes and without the address that may follow: from a house number or a PO box on."""
    name = " ".join(re.sub(r"[†‡§¶*]+", " ", re.sub(r"\[\d+\]", " ", re.sub(r"\((\d{1,2}|[a-z])\)", " ", raw))).split())
    name = re.split(r"\s(?=\d{1,5}\s+[A-Z])|\sP\.?O\.?\s+Box\s", name)[0]
    state = re.search(r",\s*([A-Z]{2})\s*$", name)
    if state and state[1] in STATES:
        name = name[: state.start()]
    return re.sub(r"[,\s]+$", "", name).strip()


def _us_holders(rows: list[list[str]], share_class: str | None) -> list[dict]:
    """The first large number and the first percentage behind it (later ones are votes); groups are no holders."""
    out = []
    for row in rows:
        filled = [c for c in row if c]
        name = _holder_name(filled[0]) if len(filled) > 1 else ""
        at = next((i for i, c in enumerate(filled) if i and re.fullmatch(US_SHARES, c)), None)
        if not _letters(name) or re.search(US_GROUP, name, re.I) or at is None:
            continue
        told = next((c for c in filled[at + 1 :] if re.fullmatch(r"\*+", c) or re.fullmatch(US_PERCENT, c)), "")
        percent = re.fullmatch(US_PERCENT, told)
        out.append({"name": name, "pct": percent[1] if percent else None, "share_class": share_class, "shares": re.sub("[()]", "", filled[at]), "quote": " | ".join(filled)})
    return out


def us_rows(html: str) -> list[dict]:
    """The five per cent holders of a proxy statement: of its best table of owners, or of a small table announced in the text before it."""
    tables = [(m.start(), _table(m[0]), _cell(m[0])) for m in re.finditer(r"(?is)<table.*?</table>", html)]
    near = lambda at, n: _cell(html[max(0, at - n) : at])

    def class_of(at: int, cells: list[list[str]]) -> str | None:
        m = re.search(US_CLASS, " ".join(c for r in cells[:4] for c in r) + " " + near(at, 1200))
        return " ".join(m[0].split()) if m else None

    owners = [(at, cells) for at, cells, own in tables if _score(cells) >= 3 and "beneficial" in (own + near(at, 3000)).lower()]
    for at, cells in sorted(owners, key=lambda x: -_score(x[1])):
        if (rows := _five_percent(cells)) is not None and (found := _us_holders(rows, class_of(at, cells))):
            return found
    small = [(at, cells) for at, cells, _ in tables if 0 < _score(cells) and len(cells) <= 12 and re.search(US_PROSE, near(at, 2000), re.I)]
    if not small:
        return []
    at, cells = max(small, key=lambda x: _score(x[1]))
    return _us_holders(cells, class_of(at, cells))


def _reader(read, text: Column) -> Column:
    @F.pandas_udf(ROWS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([read(t or "") for t in texts])

    return run(text)


def hk_holders(text: Column) -> Column:
    """array<struct<name, pct, share_class, shares, quote>> of a Hong Kong annual report's text."""
    return _reader(hk_rows, text)


def us_holders(html: Column) -> Column:
    """The same of a US proxy statement's HTML; pct is null for less than one per cent."""
    return _reader(us_rows, html)


def _iso(text: Column, pattern: str, month: int, day: int, year: int, last: bool) -> Column:
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    hit = F.try_element_at(hits, F.lit(-1 if last else 1))
    name, number = F.lower(F.regexp_extract(hit, pattern, month)), F.lit(None).cast("string")
    for i, m in enumerate(MONTHS, 1):
        number = F.when(name == m.lower(), f"{i:02d}").otherwise(number)
    return F.when(number.isNotNull(), F.concat(F.regexp_extract(hit, pattern, year), F.lit("-"), number, F.lit("-"), F.lpad(F.regexp_extract(hit, pattern, day), 2, "0")))


def as_at_date(section: Column) -> Column:
    """The first "as at 31 December 2025" or "as at December 31, 2025" of a section, as an ISO date; null without one."""
    day_first = r"(?i)as at\s+(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
    month_first = r"(?i)as at\s+([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    a, b = F.regexp_instr(section, F.lit(day_first)), F.regexp_instr(section, F.lit(month_first))
    one, two = _iso(section, day_first, 2, 1, 3, False), _iso(section, month_first, 1, 2, 3, False)
    return F.when((a > 0) & ((b == 0) | (a < b)), one).otherwise(two)


def record_date(text: Column) -> Column:
    """The last "as of April 6, 2026" of a text, the one closest to the table behind it."""
    return _iso(text, r"(?i)as of\s+([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})", 1, 2, 3, True)


def holder_list(value: Column) -> Column:
    """struct<preamble, rows: array<struct<name, pct, note>>, notes, basis> of a list of holders in a text; null if it is none.

    Of its sentences the one with most semicolons is the list; every part of it must read
    "name (note) 12.3%" or "name 12.3% (note)", and there must be two of them. One part that does
    not fit makes the whole text prose.
    """
    once = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))
    text = F.trim(F.coalesce(value, F.lit("")))
    basis = F.trim(F.regexp_replace(F.regexp_extract(text, "(?s)((?:口径：|数据来源：).*)$", 1), "[。；]+$", ""))
    body = F.trim(F.regexp_extract(text, "(?s)^(.*?)(?:口径：.*|数据来源：.*)?$", 1))
    sentences = F.filter(F.transform(F.split(body, "。"), lambda s: F.trim(s)), lambda s: s != "")
    ranked = F.array_sort(F.transform(sentences, lambda s, i: F.struct((-F.regexp_count(s, F.lit("；"))).alias("n"), i.alias("i"), s.alias("s"))))

    def row(part: Column) -> Column:
        item = F.trim(F.regexp_replace(part, r"^\d{1,2}\.\s+", ""))
        mid, tail = r"^(.+?)（([^（）]+)）\s*(\d+(?:\.\d+)?)%$", r"^(.+?)\s+(\d+(?:\.\d+)?)%(?:\s*（([^（）]+)）)?$"
        is_mid = item.rlike(mid)
        name = F.trim(F.when(is_mid, F.regexp_extract(item, mid, 1)).otherwise(F.regexp_extract(item, tail, 1)))
        pct = F.when(is_mid, F.regexp_extract(item, mid, 3)).otherwise(F.regexp_extract(item, tail, 2))
        note = F.trim(F.when(is_mid, F.regexp_extract(item, mid, 2)).otherwise(F.coalesce(F.regexp_extract(item, tail, 3), F.lit(""))))
        ok = (is_mid | item.rlike(tail)) & (name != "") & (F.length(name) <= 64) & ~name.rlike("[，。：；]")
        return F.when(ok, F.struct(name.alias("name"), pct.alias("pct"), F.nullif(note, F.lit("")).alias("note")))

    def table(best: Column) -> Column:
        led = best["s"].rlike("^[^；：]*：")
        preamble = F.when(led, F.trim(F.regexp_extract(best["s"], "^([^：]*)：", 1)))
        listed = F.when(led, F.regexp_replace(best["s"], "^[^：]*：", "")).otherwise(best["s"])
        parts = F.filter(F.transform(F.split(listed, "；"), lambda s: F.trim(s)), lambda s: s != "")
        rows = F.transform(parts, row)
        notes = F.array_join(F.filter(sentences, lambda s, i: i != best["i"]), "。")
        whole = F.struct(preamble.alias("preamble"), rows.alias("rows"), F.nullif(notes, F.lit("")).alias("notes"), F.nullif(basis, F.lit("")).alias("basis"))
        return F.when((F.size(parts) >= 2) & F.forall(rows, lambda r: r.isNotNull()), whole)

    return once(F.get(ranked, F.lit(0)), table)


def number(raw: Column) -> Column:
    return F.trim(raw.cast("string")).try_cast("double")


def ratio_text(raw: Column) -> Column:
    """A ratio as it was given, or that it was not disclosed."""
    n = number(raw)
    return F.when(n.isNull(), "未披露").otherwise(F.concat(F.regexp_replace(n.cast("string"), r"\.0$", ""), F.lit("%")))


def period_of(raw: Column) -> Column:
    """The date that a moment's text begins with; empty without one."""
    return F.regexp_extract(F.trim(F.coalesce(raw.cast("string"), F.lit(""))), r"^(\d{4}-\d{2}-\d{2})", 1)


def is_institution(kind: Column) -> Column:
    told = F.trim(F.coalesce(kind, F.lit("")))
    return (told != "") & (told != "个人") & (told.rlike("|".join(INSTITUTIONS)) | (told == "其它"))
