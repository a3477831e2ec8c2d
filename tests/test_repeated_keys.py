"""Queries on tables as larger copies have them: more keys than the test tables, whatever their numbers."""

from __future__ import annotations

import pytest

from tessera.plans import catalog

duckdb = pytest.importorskip("duckdb")


def plain(rows):
    return sorted(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r) for r in rows)


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as SELECTs, columns in the order of their names."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    return plain(df.select(*cols).collect()), plain(con.execute(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("nations", [25, 9])
def test_hubs_when_numbers_meet(spark, tmp_path, nations):
    """Suppliers whose keys are the numbers of tags or of companies, some twice, and nations that no table tells of."""
    supplier = f"select k as s_suppkey, cast(k * 7 % {nations} as int) as s_nationkey from (select unnest(range(90, 130)) as k union all select unnest(range(9990, 10040)) union all values (90), (105), (10001))"
    customer = f"select k as c_custkey, cast(k % {nations} as int) as c_nationkey from (select unnest(range(0, 60)) as k)"
    got, want = both(spark, tmp_path, "hub_companies", supplier=supplier, customer=customer, nation="select 1 as n_nationkey")
    assert got == want and len(got) == 8


def recalled(asked, index, least, top):
    """(ask, id, score, n_clues, place) by a plain loop over all pairs."""
    import re

    from tessera.functions import resolver as R

    bare = lambda n: re.sub(r"[\s（）()]", "", n)
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    grams = lambda n: pairs(re.sub(r"[\s　（）()【】《》「」、，。！？\-_]", "", n).lower())

    def tokens(x):
        v = re.sub(r"[\s，。！？、：；\x22'（）()【】《》…—\-_/\\|,.]", "", x).lower()
        return ((pairs(v) if len(v) > 1 else {v} - {""}) - set(R.STOPS)) | set(re.findall("[a-z0-9]{2,}", x.lower()))

    known = [(i, [(grams(n), bare(n)) for n in names or [] if n], tokens(text or "")) for i, names, text in index]
    out = []
    for ask, name, clues in asked:
        g, p = grams(name or ""), bare(name or "")
        told = [(R.WEIGHTS[k], tokens(t)) for k, t in clues if k != "name"]
        rows = []
        for i, names, text in known:
            alike = [max(len(g & h) / len(g | h), R.CONTAINED if p and q and (p in q or q in p) else 0) for h, q in names if g & h]
            hits = [(w, len(t), len(t & text)) for w, t in told if t & text]
            part = min(1, sum(w * (0.35 + 0.65 * h / n) for w, n, h in hits) / (len(told) * R.CLUE_SCALE)) if told else 0
            raw = round(max(alike, default=0) * R.NAME_SHARE + part * R.CLUE_SHARE, 9)
            if raw >= least:
                rows.append((-int(raw * 100 + 0.5), i, len(hits)))
        out += [(ask, i, -minus / 100, n, place) for place, (minus, i, n) in enumerate(sorted(rows)[:top], 1)]
    return plain(out)


@pytest.mark.parametrize("block,part,pairs,n", [(1 << 22, 1 << 14, 10**11, 40), (300, 7, 10**11, 40), (300, 7, 0, 40), (1500, 50, 10**11, 400), (900, 50, 10**11, 400)])
def test_recall_of_many_alike(spark, monkeypatch, block, part, pairs, n):
    """Asks and companies that nothing tells apart but their keys, in one block and in several, all pairs scored or those that lists leave."""
    import random

    from tessera.functions import resolver

    monkeypatch.setattr(resolver, "BLOCK", block)
    monkeypatch.setattr(resolver, "PART", part)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("星河工业软件大模型x1") for _ in range(rng.randint(1, 4)))
    kinds = [([word() + rng.choice(["", "科技", " (x)"]), rng.choice(["", word()])][: rng.randint(0, 2)], rng.choice([None, "", word() + " " + word() + f" {k % 5}号楼"])) for k in range(n)]
    index = [(k, *kinds[0 if k % 3 and n < 100 else k % n]) for k in range(500)]
    asks = [(rng.choice([None, "", kinds[k][0][0] if kinds[k][0] else word(), word() + "科技有限"]), [(rng.choice(list(resolver.WEIGHTS)), word() + f"{k % 6}号楼"[: rng.randint(0, 4)]) for _ in range(rng.randint(0, 3))]) for k in range(30)]
    asked = [(k, *asks[0 if k % 2 else k % 30]) for k in range(120)]
    a = spark.createDataFrame(asked, "ask int, name string, clues array<struct<kind: string, text: string>>").repartition(3)
    i = spark.createDataFrame(index, "id int, names array<string>, text string").repartition(3)
    got = plain(tuple(r) for r in resolver.recall(a, i, bound=4, longest=9, pairs=pairs).collect())
    assert got == recalled(asked, index, resolver.LEAST, resolver.TOP) and len(got) > 200
    assert resolver._profiles(i, 8).count() <= n


def test_recall_of_one_large_group(spark):
    """Ten million pairs of equal asks and equal companies are one pair to score."""
    from tessera.functions import resolver

    a = spark.range(2000).selectExpr("id as ask", "'星河科技' as name", "array(named_struct('kind', 'business', 'text', '工业软件')) as clues")
    i = spark.range(5000).selectExpr("id", "array('星河科技有限公司', '') as names", "'工业软件 上海' as text")
    assert resolver._profiles(i, 8).selectExpr("size(ids)").collect() == [(8,)]
    rows = resolver.recall(a, i).collect()
    assert len(rows) == 16000 and {r["id"] for r in rows} == set(range(8)) and {r["score"] for r in rows} == {0.98}


def test_recalled_companies_of_a_longer_index(spark, tmp_path, monkeypatch):
    """Every list is longer than the 200 that the query first looked at, companies have the same names and text as others, their ids settle ties; no pair of ask and company is a row."""
    from tessera.functions import resolver

    seen, scored = [], resolver._scored
    monkeypatch.setattr(resolver, "_scored", lambda pairs, *more: seen.append(pairs.count()) or scored(pairs, *more))
    part = "select k as p_partkey, ['red bolt', 'hot ring', 'part 7'][k % 3 + 1] as p_name, 'Brand#' || (k % 2 + 11) as p_brand, 'PROMO' as p_type, cast(k % 5 as int) as p_size from (select unnest(range(0, 3600)) as k)"
    supplier = "select k as s_suppkey, 'Supplier#' || lpad(cast(k as varchar), 9, '0') as s_name from (select unnest(range(0, 60)) as k)"
    got, want = both(spark, tmp_path, "recalled_companies", part=part, supplier=supplier)
    assert got == want and len(got) > 400
    assert sum(seen) < 60 * 3600 / 10


@pytest.mark.parametrize("prefixes,twice", [(1 << 17, False), (20, False), (1, False), (1 << 17, True)])
def test_names_of_a_large_dictionary(spark, monkeypatch, prefixes, twice):
    """Names that an automaton doesn't hold, of one and of several aliases, against a plain loop: texts are read a fixed number of times."""
    import random
    import re

    from pyspark.sql import functions as F

    from tessera.operators import people

    monkeypatch.setattr(people, "PREFIXES", prefixes)
    rng = random.Random(prefixes)
    word = lambda a, b: "".join(rng.choice("李全德A]^-\\.") for _ in range(rng.randint(a, b)))
    names = sorted({word(2, 6) + rng.choice(["", "", f"（{word(2, 3)}）({word(2, 7)})"]) for _ in range(300)})
    texts = [(k // 2 if twice else k, "".join(rng.choice("李全德A]^-\\. 在说,") for _ in range(rng.randint(0, 20))), rng.choice("xy")) for k in range(400)] + [(900, None, "x"), (901, "", "x")]
    alias = {n: [a for a in (re.sub(r"[（(][^）)]*[）)]", "", n).strip(), *re.findall(r"[（(]([^）)]+)[）)]", n)) if len(a.strip()) >= 2] for n in names}
    hanzi = "[一-龥]"
    alone = lambda a, t: bool(t) and re.search(f"(?<!{hanzi}){re.escape(a)}" + (f"(?:(?!{hanzi})|(?=[{people.PARTICLES}]))" if len(a) <= 2 else ""), t)
    want = {(s, n) for s, t, _ in texts for n in names if any(alone(a.strip(), t) for a in alias[n])}
    df = spark.createDataFrame(texts, "s long, t string, c string").repartition(3)
    who = spark.createDataFrame([(n,) for n in [*names, names[0]]] + [(None,)], "n string")
    found = people.mentioned_names(df, who, "s", "t", "n", block=40, carry=("c",))
    rows = [tuple(r) for r in found.select("signal", "name", "c").collect()]
    assert sorted(rows) == sorted((s, n, c) for s, n in want for k, _, c in texts if k == s) and len(want) > 300
    assert {tuple(r) for r in people.mentioned_names(df, who, "s", "t", "n", block=40).collect()} == want
    assert {tuple(r) for r in people.mentioned_names(df, who, "s", "t", "n").collect()} == want
    hits = people.alias_hits(df.select(F.col("s").alias("signal"), F.col("t").alias("text")), who.select(F.col("n").alias("alias")).distinct(), 40)
    assert hits._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["people_mentions", "entry_points", "people_orgs"])
def test_people_beyond_an_automaton(spark, tmp_path, monkeypatch, name):
    """The queries' SQL with names in more bytes than an automaton holds."""
    from tessera.operators import people

    monkeypatch.setattr(people.mentioned_names, "__defaults__", (100, ()))
    customer = "select k as c_custkey, ['BUILDING', 'FURNITURE'][k % 2 + 1] as c_mktsegment, cast(k % 7 - 3 as double) as c_acctbal from (select unnest(range(0, 400)) as k)"
    orders = "select k as o_orderkey, k * 7 % 450 as o_custkey, ['F', 'O', 'P'][k % 3 + 1] as o_orderstatus, (k % 5) || '-LOW' as o_orderpriority from (select unnest(range(0, 1500)) as k)"
    got, want = both(spark, tmp_path, name, customer=customer, orders=orders)
    assert got == want and len(got) > 100
