"""Self-contained HTML pages: one document a company or an industry, built from rows, written as a table of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLE = "body{max-width:1180px;margin:48px auto;font:14px/1.6 system-ui}table{width:100%;border-collapse:collapse}th,td{padding:10px;border:1px solid #999;text-align:left;vertical-align:top}"


def escaped(value: Column) -> Column:
    t = F.coalesce(value.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


def linked(value: Column, urls: Column) -> Column:
    """A value that leads to its first source, with marks for the others; the value alone without a source."""
    first = F.concat(F.lit('<a href="'), escaped(F.get(urls, F.lit(0))), F.lit('">'), escaped(value), F.lit("</a>"))
    more = F.array_join(F.transform(F.slice(urls, F.lit(2), F.greatest(F.size(urls) - 1, F.lit(0))), lambda u, i: F.concat(F.lit('<a href="'), escaped(u), F.lit('">+'), (i + 1).cast("string"), F.lit("</a>"))), "")
    return F.when(F.coalesce(F.size(urls), F.lit(0)) > 0, F.concat(first, more)).otherwise(escaped(value))


def section(rows: DataFrame, key: str, number: int, title: str, headers: list[str], cells: list[Column], order: list) -> DataFrame:
    """(key, number, html): a chapter with a table, for each key that has rows; cells hold HTML."""
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    own = rows.select(key, F.struct(*order).alias("o"), row.alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "row"))), lambda x: x["row"]), "")
    head = f'<section id="chapter-{number}"><h2>{title}</h2><table><thead><tr>{"".join(f"<th>{h}</th>" for h in headers)}</tr></thead><tbody>'
    return own.groupBy(key).agg(body.alias("b")).select(key, F.lit(number).alias("number"), F.concat(F.lit(head), "b", F.lit("</tbody></table></section>")).alias("html"))


def documents(subjects: DataFrame, key: str, title: str, sections: list[DataFrame]) -> DataFrame:
    """(key, html): a whole page for each subject, its chapters in the order of their numbers."""
    parts = reduce(DataFrame.unionByName, sections)
    body = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "html"))), lambda x: x["html"]), "").alias("b"))
    name = escaped(F.col(title))
    head = F.concat(F.lit(f'<!doctype html><html lang="zh-CN"><head><meta charset="utf-8"><title>'), name, F.lit(f"</title><style>{STYLE}</style></head><body><h1>"), name, F.lit("</h1>"))
    return subjects.select(key, title).join(body, key, "left").select(key, F.concat(head, F.coalesce("b", F.lit("")), F.lit("</body></html>")).alias("html"))


def write_pages(pages: DataFrame, path: str) -> None:
    """One text file's line a page would break at line ends: pages go to Parquet, keyed, for a server to read."""
    pages.write.mode("overwrite").parquet(path)
