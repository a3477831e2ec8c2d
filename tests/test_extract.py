from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from tessera.functions import extract, text


def test_cards(spark):
    df = spark.createDataFrame([(["百度", "高校"], "n", None), (["外企"], None, "派驻团队"), ([], None, None)], "tags array<string>, n string, d string")
    got = df.select(extract.founder_bucket(F.col("tags")).alias("b"), extract.initial_relevance(F.col("n"), F.col("d")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("institute", "vendor"), ("foreign", "adjacent"), (None, "unclear")]


def test_notices(spark):
    df = spark.createDataFrame([("项目名称： 数据平台 \n采购人:某局\n时间 2025年3月7日",), ("none",)], "t string").withColumn("ls", F.split("t", "\n"))
    got = df.select(extract.label_value(F.col("ls"), ("采购人", "项目名称")).alias("v"), extract.first_iso_date(F.col("t")).alias("d"), extract.keyword_tags(F.col("t"), ("数据", "平台", "x")).alias("k"), extract.first_category(F.col("t"), [("a", "平台"), ("b", "数据")], "z").alias("c")).collect()
    assert [tuple(r) for r in got] == [("数据平台", "2025-03-07", "数据、平台", "a"), (None, None, "", "z")]


def test_postings(spark):
    made = ["intro", "Title A", "a1", "a2", "Title B", *(f"b{k}" for k in range(9))]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(made)], "d int, i int, x string")
    got = {r["title"]: r["excerpt"] for r in extract.postings(df, "d", "i", "x", F.startswith(F.col("x"), F.lit("Title"))).collect()}
    assert got == {"Title A": "Title A\na1\na2", "Title B": "\n".join(["Title B", *(f"b{k}" for k in range(6))])}


def test_tree_and_first_matches(spark):
    people = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "gone")], "p string, up string")
    assert {tuple(r) for r in extract.org_tree(people, "p", "up").collect()} == {("a", None, True, 2), ("b", "a", False, 0), ("c", "a", False, 0), ("d", None, True, 0)}
    rules = spark.createDataFrame([("r1", "x+"), ("r2", "y")], "rule string, pattern string")
    rows = spark.createDataFrame([(3, "xx"), (1, "ax"), (2, "y"), (0, "q")], "i int, t string")
    assert {tuple(r) for r in extract.first_matches(rules, rows, "t", ["i"]).collect()} == {("r1", 1, "ax"), ("r2", 2, "y")}


def test_nfkc_of_every_character(spark):
    """Each assigned character, alone and with marks, as Python's tables have it."""
    marks = ["", "\u0301", "\u0323\u0307", "\u3099"]
    rows = [(k, chr(k) + marks[k % 4]) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    got = spark.createDataFrame(rows, "k int, t string").repartition(4).select("k", text.nfkc(F.col("t")).alias("n"), text.entity_key(F.col("t")).alias("e")).collect()
    told = dict(rows)
    assert [r["k"] for r in got if r["n"] != unicodedata.normalize("NFKC", told[r["k"]])] == []
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum())
    odd = [r["k"] for r in got if r["e"] != plain(told[r["k"]])]
    assert len(odd) < 0.05 * len(rows) and all(k > 0x7FF for k in odd)  # characters newer than Java's tables
    assert spark.range(1).select(text.entity_key(F.lit(None).cast("string")).alias("e"), text.coverage_text(F.lit("Ａ ①\u3000b\u0085")).alias("c")).first() == (None, "a1b")
