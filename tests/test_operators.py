"""Edge cases on literals, and the order-dependent operators against plain loops."""

from __future__ import annotations

import datetime
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, gates, queries, text, urls
from tessera.operators import changes, evidence, folds, statistics
from tessera.sources import tables
from tessera.streaming import ingest


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()) or "z string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], kinds).select(column.alias("x")).first()["x"]


def test_layouts_of_one_text_share_a_fingerprint(spark):
    made = ["公司， 2025 年收入", "公司，2025年收入", "公司，​2025　年收入"]
    got = {one(spark, text.corpus_fingerprint(F.col("t")), t=t) for t in made}
    assert len(got) == 1 and len(got.pop()) == 32
    assert one(spark, text.normalize_corpus(F.col("t")), t="ＡＢ Ｃ  d") == "ab c d"
    assert one(spark, text.normalize_corpus(F.col("t")), t="A B") != one(spark, text.normalize_corpus(F.col("t")), t="AB")


def test_placeholders(spark):
    for t, want in (("未知。", True), (" N/A ", True), ("", True), (None, True), ("无", False), ("share unknown, but held", False)):
        assert one(spark, text.is_placeholder(F.col("t")), t=t) is want


def test_entity_key_is_nfkc(spark):
    assert one(spark, text.entity_key(F.col("t")), t="Ａcme（集团） №1") == "acme集团no1"


def test_company_key(spark):
    assert one(spark, text.company_key(F.col("t")), t=" Foo & Bar, Inc. ") == "fooandbar"


def test_round_half_up(spark):
    assert one(spark, text.round_half_up(F.col("v") / 2), v=-5) == -2
    assert one(spark, text.round_half_up(F.col("v") / 2), v=5) == 3


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.canonical_url(u), u="http://a.com/x?utm_source=1&b=2&gclid=3#f") == "http://a.com/x?b=2"
    assert one(spark, urls.canonical_url(u), u="http://a.com/x?utm_term=1") == "http://a.com/x"
    for told, want in (
        ("HTTP://EXAMPLE.com/a/../%7Eb", "http://example.com/%7Eb"), (" https://Bücher.Example:0443/ä b?q=a%20b&c&ü=~*#x\n", "https://xn--bcher-kva.example/%C3%A4%20b?q=a+b&c=&%C3%BC=%7E*"),
        ("http://例え.テスト:8080", "http://xn--r8jz45g.xn--zckzah:8080/"), ("http:\\\\a.com\\b\\..\\c", "http://a.com/c"), ("http://a.com/b/%2E%2e/c/.", "http://a.com/c/"), ("http://a.com/../..", "http://a.com/"), ("http://a.com/b/..;/c//d", "http://a.com/b/..;/c//d"),
        ("http://a.com?%75tm_source=1&x=%zz&y=%41", "http://a.com/?x=%25zz&y=A"), ("http://Us:Pw@A.com:80/<\"x>`{}|^'", "http://Us:Pw@a.com/%3C%22x%3E%60%7B%7D|^'"), ("ht\ttp://a.com/\U0001F600?\U0001F600", "http://a.com/%F0%9F%98%80?%F0%9F%98%80="), ("mailto:a@b.c#d", "mailto:a@b.c"), ("", ""), ("http://", "http://"),
    ):
        assert one(spark, urls.canonical_url(u), u=told) == want, told
    assert one(spark, urls.host_of(u), u="https://u@Bücher.example:8/x") == "xn--bcher-kva.example"
    assert [one(spark, urls.host_of(u), u=x) for x in ("http://a b.com/é", "é", "http://A.com/é")] == ["", "", "a.com"]
    assert one(spark, urls.host_of(u), u="not a url") == ""
    for url, grade in (("http://www.sse.com.cn/x", "statutory"), ("https://x.gov.cn", "independent"), ("http://pitchhub.36kr.com/a", "self"), ("http://acme.io", "self"), ("", "unverified")):
        assert one(spark, urls.source_grade(u), u=url) == grade
    assert one(spark, urls.ceiling_grade(F.array(u, F.lit("http://x.sec.gov"))), u="http://acme.io") == "independent"
    assert one(spark, urls.ceiling_grade(F.expr("cast(array() as array<string>)"))) == "unverified"
    typed = {"independent": ("36kr.com",), "related": ("pitchhub.36kr.com",)}
    for url, grade in (("http://pitchhub.36kr.com/a", "related"), ("http://m.36kr.com/a", "independent"), ("http://x.edu.cn/a", "independent"), ("http://acme.io/", "related"), ("http://acme.io/deep", "unknown"), ("http://mp.weixin.qq.com/s", "unknown"), ("ftp://x", "unknown")):
        assert one(spark, urls.audit_grade(u, typed), u=url) == grade
    assert one(spark, urls.source_hint(u), u="http://www.szse.cn/a") == "disclosure"


def test_dates(spark):
    t = F.col("t")
    latest = lambda s: str(one(spark, dates.latest_observed_date(t, "2025-03-01"), t=s))
    assert latest("2024年2月30日 and 2024-01-05, then March 2, 2025; later 2026.1.1") == "2025-03-02"
    assert latest("1999-12-31 only") == "None"
    assert latest("签于2023年 7 月 9 日") == "2023-07-09"
    assert one(spark, dates.is_expired(t, "2025-03-01"), t="2025-03-01") is False
    assert one(spark, dates.is_expired(t, "2025-03-01"), t="2025-02-28") is True
    assert str(one(spark, dates.valid_until(F.lit(None).cast("date"), F.lit("compete"), "2025-01-01"))) == "2025-04-01"
    assert str(one(spark, dates.valid_until(F.lit("2020-01-01").cast("date"), F.lit("equity"), "2025-01-01"))) == "2025-01-31"
    assert str(one(spark, dates.monday_of(F.lit("2024-01-07 17:00:00").cast("timestamp_ntz")))) == "2024-01-08"


def test_requests(spark):
    t = F.col("t")
    assert one(spark, queries.correct_terms(t), t="启动了opc设计") == "启动了OCP设计"
    assert one(spark, queries.entity_name(t), t="听说广联达最近启动了新项目") == "广联达"
    assert one(spark, queries.entity_name(t), t="的") == "的"
    assert one(spark, queries.relevance_probe(t), t="北京世纪互联数据中心有限公司") == "世纪互联"
    assert one(spark, queries.relevance_probe(t), t="广联达科技股份有限公司") == "广联达"
    assert one(spark, queries.is_relevant(F.lit("广联达"), t), t="别家") is False
    assert one(spark, queries.salient_terms(t, F.lit("OCP Inc")), t="OCP AIDC H100 CEO GPU X1") == ["AIDC", "H100", "GPU"]
    hits = spark.createDataFrame([(1, "广联达", "x"), (1, "广联达", "广联达 y"), (2, "世纪互联", "世纪佳缘")], "b int, n string, t string")
    assert {r["b"]: r["degraded"] for r in queries.degraded_batches(hits, "b", "n", "t").collect()} == {1: False, 2: True}


def test_corroboration(spark):
    rows = [("a", "x", "1", True), ("a", "y", "2", True), ("b", "x", "1", True), ("b", "y", "1", True), ("c", "x", "1", True), ("c", "y", "2", False), ("d", "x", "1", True), ("d", "x", "2", True)]
    df = spark.createDataFrame(rows, "claim string, dom string, content string, ind boolean")
    got = {r["claim"]: r["status"] for r in evidence.corroboration(df, "claim", "dom", "content", F.col("ind")).collect()}
    assert got == {"a": "corroborated", "b": "repeated-copy", "c": "single-source", "d": "corroborated"}


def test_market_map_counts_materials(spark):
    rows = [("o", "supply", s, m, True, True) for s, m in ((1, "m"), (2, "m"), (3, "m"))] + [("o", "odd", 4, "n", True, True)]
    df = spark.createDataFrame(rows, "org string, rel string, s int, m string, i boolean, a boolean")
    got = {r["relation"]: r for r in evidence.market_map(df, "org", "rel", "s", "m", F.col("i"), F.col("a"), ["supply", "equity"]).collect()}
    assert (got["supply"]["heat"], got["supply"]["reprints"], got["supply"]["state"]) == (1, 2, "backed")
    assert got["equity"]["state"] == "unchecked" and set(got) == {"supply", "equity"}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in evidence.components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_components_of_all_line_items(spark, tmp_path):
    """Against a union-find over all pairs; half of the links hang on small quantities."""
    from tessera.plans import catalog

    rng = random.Random(5)
    rows = [(rng.randint(1, 60), rng.randint(1, 40), datetime.date(1995, rng.randint(1, 6), rng.randint(1, 28)), rng.choice("ANR"), float(rng.choice([1, 20, 48, 49, 50]))) for _ in range(90)]
    rows += [(201, 900, datetime.date(1996, 1, 1), "R", 1.0), (202, 900, datetime.date(1996, 1, 31), "A", 2.0), (203, 900, datetime.date(1996, 2, 1), "A", 50.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_shipdate date, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    meet = {}
    for s, p, d, f, _ in rows:
        meet.setdefault((p, d.year, d.month), []).append((s, f))
    links = [(a, b, f) for own in meet.values() for (a, f), (b, _) in zip(sorted(own), sorted(own)[1:]) if a != b]
    for own in meet.values():
        for a in own:
            for b in own:
                if a[0] != b[0]:
                    x, y = sorted((find(a[0]), find(b[0])))
                    root[y] = x
    want = {n: find(n) for n in {n for a, b, _ in links for n in (a, b)}}
    got = {r["node"]: r["component"] for r in catalog.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == want and got[202] == 201 and 203 not in got
    summary = {r["component"]: (r["members"], r["links"], r["dominant"]) for r in catalog.QUERIES["cluster_summary"](spark, str(tmp_path)).collect()}
    for c in set(want.values()):
        flags = [f for a, _, f in links if want[a] == c]
        assert summary.pop(c) == (sum(x == c for x in want.values()), len(flags), min(set(flags), key=lambda f: (-flags.count(f), f)))
    assert not summary


def test_spread_needs_groups(spark):
    rows = [(g, k < h) for g, h in ((0, 5), (1, 2), (2, 0)) for k in range(5)]
    df = spark.createDataFrame(rows, "g int, t boolean")
    got = statistics.spread(df, "g", F.col("t")).collect()
    assert [(r["high_group"], r["low_group"], r["spread"]) for r in got] == [(0, 2, 1.0)]
    assert statistics.spread(df.filter("g < 2"), "g", F.col("t")).count() == 0
    assert statistics.spread(df.limit(14), "g", F.col("t")).count() == 0


def test_merges(spark):
    kind = "k int, g string, v string"
    old = spark.createDataFrame([(1, "statutory", "a"), (2, "self", "b"), (3, "self", "c")], kind)
    new = spark.createDataFrame([(1, "independent", "x"), (2, "self", "y"), (4, "self", "")], kind)
    rows = lambda df: {r["k"]: r["v"] for r in df.collect()}
    assert rows(changes.grade_merge(old, new, ["k"], urls.grade_rank(F.col("g")))) == {1: "a", 2: "y", 3: "c", 4: ""}
    assert rows(changes.last_wins(old, new, ["k"])) == {1: "x", 2: "y", 3: "c", 4: ""}
    assert rows(changes.first_wins(old, new, ["k"])) == {1: "a", 2: "b", 3: "c", 4: ""}
    assert rows(changes.coalesce_upsert(old, new, ["k"])) == {1: "x", 2: "y", 3: "c", 4: None}
    assert rows(changes.union_last([old, new, old], ["k"])) == {1: "a", 2: "b", 3: "c", 4: ""}
    diff = {(r["k"], r["kind"], r["field"]) for r in changes.snapshot_diff(old, new, ["k"], ["g", "v"]).collect()}
    assert diff == {(1, "changed", "g"), (1, "changed", "v"), (2, "changed", "v"), (3, "removed", "*"), (4, "added", "*")}


def test_provenance(spark):
    cells = spark.createDataFrame([(1, "a"), (2, " "), (3, "b")], "k int, value string")
    sourced = spark.createDataFrame([(1,)], "k int")
    assert [r["k"] for r in changes.missing_sources(cells, sourced, ["k"]).collect()] == [3]
    with pytest.raises(ValueError):
        changes.assert_sourced(cells, sourced, ["k"])


def test_greedy_admission(spark):
    rows = [(g, k, f"e{(k * 7 + j * 3 + g) % 11}", -(k * 13 % 10)) for g in range(5) for k in range(12) for j in range(1 + k % 3)]
    got = {(r["g"], r["k"]): r["verdict"] for r in folds.greedy_admission(spark.createDataFrame(rows, "g int, k int, e string, r int"), "g", "k", "e", ["r", "k"]).collect()}
    by = defaultdict(lambda: defaultdict(set))
    for g, k, e, r in rows:
        by[g][r, k].add(e)
    for g, keys in by.items():
        known, taken, used = set(), 0, 0
        for (_, k), es in sorted(keys.items()):
            novel = es - known
            if not novel:
                want = "no-novel-edge"
            elif taken == 4 or used + len(novel) > 6:
                want = "capacity"
            else:
                want, taken, used = "accepted", taken + 1, used + len(novel)
                known |= novel
            assert got[g, k] == want


def test_weight_replay(spark):
    rows = [(g, i, ("confirmed", "counter", "watching")[(i + g) % 3], 40 + (i * 17) % 60, [float(35 + (i * k * 7) % 60) for k in range(1, 5)]) for g in range(4) for i in range(9)]
    df = spark.createDataFrame(rows, "g int, i int, v string, q int, s array<double>")
    got = {r["g"]: r["weights"] for r in folds.weight_replay(df, "g", "i", "v", "q", "s", [30, 25, 25, 20]).collect()}
    for g in range(4):
        w = [30.0, 25.0, 25.0, 20.0]
        for _, _, v, q, s in [r for r in rows if r[0] == g]:
            d = 0 if q < 60 else {"confirmed": 1, "counter": -1}.get(v, 0)
            if d:
                m = sum(s) / 4
                held = [max(12.0, min(40.0, x + d * (y - m) * 0.08)) for x, y in zip(w, s)]
                w = [float(math.floor(x / sum(held) * 100 + 0.5)) for x in held]
        assert got[g] == w
    assert gates.GATES[0] == "evidence"


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text('name,place\n"Foo ""X"" Ltd","a, b"\n')
    assert [tuple(r) for r in tables.read_registry(spark, str(tmp_path / "r.csv")).collect()] == [('Foo "X" Ltd', "a, b")]
    (tmp_path / "f.json").write_text('{"items": [{"date": "2026-07-01", "title": "t", "summary": "s", "url": "https://x", "kind": "k"}, {"date": "2026-13-01", "title": "t", "summary": "s", "url": "https://x"}, {"date": "2026-07-01", "title": "t", "summary": "s", "url": "x"}]}')
    assert tables.read_feed(spark, str(tmp_path / "f.json")).count() == 1
    assert [r["url"] for r in one(spark, tables.search_hits(F.col("t")), t='{"results": [{"url": "ftp://a"}, {"url": "https://b"}]}')] == ["https://b"]
    assert [tuple(p) for p in one(spark, tables.paged(F.col("t")), t="a\n 7 \f\fb")] == [(7, "a\n 7"), (2, "b")]


def test_stream_replay_inserts_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 7) for i in range(20)], "id int, v int")
    for k in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put, out = ingest.upsert_into(str(tmp_path / "out"), ["id"]), str(tmp_path / "out")
    for k in range(2):  # the second run is a replay from the start
        q = ingest.stream(spark, str(tmp_path / "in"), rows.schema, files=1).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(out).count() == 20


def test_partitioned_replay_reads_what_it_touches(spark, tmp_path):
    rows = spark.createDataFrame([(i, i // 10) for i in range(40)], "id int, week int")
    put = ingest.upsert_into(str(tmp_path / "out"), ["id"], "week")
    for part in ("week < 3", "week > 1", "week = 2"):
        put(rows.filter(part), 0)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 40 and got.distinct().count() == 40
    assert sorted(p.name for p in (tmp_path / "out").glob("week=*")) == [f"week={k}" for k in range(4)]


def test_weekly_stream(spark, tmp_path):
    from pyspark.sql.types import StructType

    made = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, i) as ts, 'a' as kind, i as id from (select explode(sequence(0, 27)) as i)")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = ingest.stream(spark, str(tmp_path / "in"), StructType.fromJson(made.schema.jsonValue()))
    q = ingest.weekly(events, "ts", "kind", "1 day").writeStream.format("memory").queryName("weekly_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["week_start"])[:10]: r["n"] for r in spark.table("weekly_test").collect()}
    assert got == {"2023-12-31": 7, "2024-01-07": 7, "2024-01-14": 7, "2024-01-21": 7}
