"""Reading hits of a company search: role words, quotes, headers of job posts, filer names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import WHITE, clean_company_name

# The phrase that names a role, what opens a post that names no company, and entities.
ROLE = r"(?i)forward[\s\x{2010}-\x{2015}-]*deploy(?:ed|ment)\s+(?:senior\s+|staff\s+|principal\s+|software\s+|solutions?\s+|ai\s+|silicon\s+|full[\s-]?stack\s+){0,2}(?:engineer|engineering|architect|technologist)"
SEEKER = "(?i)^(seeking|looking|location|remote|i'm|i am|hi(?![A-Za-z0-9_]))"
PITCH = "(?i)^(we|our|join|hiring|now hiring)(?![A-Za-z0-9_])"
SIGNAL_RANK = {"role-title": 3, "first-person-org": 2, "org-description": 1}
POST_ENTITIES = (("&#x2F;", "/"), ("&#47;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def passes_role_gate(quote: Column) -> Column:
    return F.coalesce(quote, F.lit("")).rlike(ROLE)


def has_first_person(quote: Column, reach: int = 120) -> Column:
    """Whether "we", "our" or "us" stands within `reach` characters of the role phrase."""
    found = F.regexp_extract(quote, f"({ROLE})", 1)
    at = F.instr(quote, found)
    around = F.substring(quote, F.greatest(F.lit(1), at - reach), F.least(at - 1, F.lit(reach)) + F.length(found) + reach)
    return (found != "") & around.rlike("(?i)(?<![A-Za-z0-9_])(we|our|us)(?![A-Za-z0-9_])")


def signal_class(quote: Column, title: Column) -> Column:
    """role-title if the title names the role, first-person-org if the quote speaks of "us", else org-description."""
    return F.when(passes_role_gate(title), "role-title").when(has_first_person(quote), "first-person-org").otherwise("org-description")


def signal_rank(signal: Column) -> Column:
    out = F.lit(0)
    for name, rank in SIGNAL_RANK.items():
        out = F.when(signal == name, rank).otherwise(out)
    return out


def suggested_relevance(signal: Column) -> Column:
    """adjacent at most: who practises the role is for a reader to say."""
    return F.when(signal.isin("role-title", "first-person-org"), "adjacent").otherwise("unclear")


def quote_around(text: Column, term: str, window: int = 240) -> Column:
    """The term with half a window on either side, dots where the text goes on; null without the term.

    White space and hyphens between the term's words are all the same.
    """
    plain = flat(text)
    pattern = "(?i)(" + r"[\s\x{2010}-\x{2015}-]+".join(re.escape(w) for w in term.split()) + ")"
    found = F.regexp_extract(plain, pattern, 1)
    at = F.regexp_instr(plain, F.lit(pattern))
    start, end = F.greatest(at - 1 - window // 2, F.lit(0)), F.least(F.length(plain), at - 1 + F.length(found) + window // 2)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(plain, start + 1, end - start), F.when(end < F.length(plain), "…").otherwise(""))
    return F.when(at > 0, cut)


def decode_post(text: Column) -> Column:
    """A post's HTML as text: paragraphs as lines, tags as blanks, entities decoded, numbered ones too."""
    t = F.regexp_replace(F.regexp_replace(text, "<p>", "\n"), "<[^>]+>", " ")

    @F.pandas_udf("string")
    def numbered(texts: pd.Series) -> pd.Series:
        named, entity = dict(POST_ENTITIES), re.compile("|".join(re.escape(e) for e, _ in POST_ENTITIES))
        number = re.compile("&#(?:x([0-9a-fA-F]+)|([0-9]+));")

        def char(m: re.Match) -> str:
            code = int(m[1], 16) if m[1] else int(m[2])
            return chr(code & 0xFFFF) if not 0xD800 <= code & 0xFFFF <= 0xDFFF else m[0]

        return texts.map(lambda s: None if s is None else number.sub(char, entity.sub(lambda m: named[m[0]], s)))

    return numbered(t)


def post_header(text: Column) -> Column:
    """The first line that is not blank."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def post_company(header: Column) -> Column:
    """struct<name, why>: the company that a post's header names first, or why none can be read from it."""
    name = clean_company_name(F.get(F.split(header, r"\|"), F.lit(0)))
    why = (
        F.when(header == "", "empty")
        .when(~F.contains(header, F.lit("|")), "no pipe")
        .when(name == "", "blank before pipe")
        .when(F.length(name) > 60, "too long")
        .when(name.rlike(r"[.!?]\s"), "sentence")
        .when(name.rlike(SEEKER), "seeker")
        .when(name.rlike(ROLE), "role title")
        .when(name.rlike(PITCH), "pitch")
    )
    return F.struct(F.when(why.isNull(), name).alias("name"), why.alias("why"))


def post_role(header: Column) -> Column:
    """The part of a header that names the role; null without one."""
    return F.get(F.filter(F.transform(F.split(header, r"\|"), lambda x: F.trim(x)), lambda x: x.rlike(ROLE)), F.lit(0))


def filer(display: Column) -> Column:
    """struct<name, ticker, cik> of "Name (TICK, TICKW) (CIK 0001)"; the first ticker counts."""
    rest = F.regexp_replace(display, r"(?i)\(CIK\s+\d+\)", "")
    ticker = F.trim(F.get(F.split(F.regexp_extract(rest, r"\(([A-Z0-9.,\s-]+)\)", 1), ","), F.lit(0)))
    cik = F.regexp_extract(display, r"(?i)\(CIK\s+(\d+)\)", 1)
    return F.struct(clean_company_name(rest).alias("name"), F.nullif(ticker, F.lit("")).alias("ticker"), F.nullif(cik, F.lit("")).alias("cik"))


def filing_url(cik: Column, accession: Column, document: Column, base: str = "https://www.sec.gov/Archives/edgar/data/") -> Column:
    """Where a filing's document lies; null if a part is missing. document: "<accession>:<file>"."""
    number, folder, file = F.regexp_replace(cik, "^0+", ""), F.replace(accession, F.lit("-"), F.lit("")), F.get(F.split(document, ":"), F.lit(1))
    return F.when((number != "") & (folder != "") & (file != ""), F.concat(F.lit(base), number, F.lit("/"), folder, F.lit("/"), file))
