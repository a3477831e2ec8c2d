"""The scheduler's fold and other operators against plain loops and literals."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dossier, evidence, findings, research, signals, statistics


def test_admission_against_a_loop(spark):
    rng = random.Random(7)
    as_of = datetime.date(2024, 6, 30)
    rows, edges = [], []
    for g in range(6):
        for k in range(40):
            key = g * 100 + k
            dated = rng.choice([None, *(as_of - datetime.timedelta(days=d) for d in (3, 200, 400, 600, 900))])
            rows.append((g, key, rng.choice(["Title of it", "Other title", "x"]), "e" * rng.choice([48, 60, 10]), rng.choice(["https://a.org/1", f"https://a.org/{key}", f"https://b.org/{key}", "https://bing.com/x", ""]), rng.choice(["statutory", "independent", "self", "related", "unverified", None]), rng.random() < 0.1, dated))
            for at in range(rng.choice([0, 1, 2, 3, 4])):
                edges.append((key, at, f"F{rng.randrange(6)}", rng.choice(["G1", "G2", "", "f1"]), rng.choice(["equity", "supply", "compete", "odd", ""]), "license", rng.choice(["mutual", "forward", None])))
    c = spark.createDataFrame(rows, "grp int, key int, title string, evidence string, url string, grade string, duplicate boolean, dated date")
    e = spark.createDataFrame(edges, "key int, at int, from_node string, to_node string, relation string, suggested string, direction string")
    age = {"equity": 730, "license": 730, "supply": 548, "personnel": 548, "compete": 365}
    own: dict = {}
    for key, _, a, b, rel, sug, way in edges:
        rel = rel or sug
        if a and b and rel in age:
            x, y = a.lower(), b.lower()
            if rel == "compete" or way == "mutual":
                x, y = sorted((x, y))
            own.setdefault(key, []).append((rel, f"{rel}|{x}|{y}"))
    known_keys = [(0, "equity|f1|g1"), (1, "compete|f1|f2"), *((4, k) for key in range(400, 430) for _, k in own.get(key, []))]
    got = {r["key"]: r for r in research.admitted(research.screened(c, e, "2024-06-30"), spark.createDataFrame([(2, " https://a.org/1 ")], "grp int, url string"), spark.createDataFrame(known_keys, "grp int, edge_key string"), spark.createDataFrame([(3, 46)], "grp int, n_edges int")).collect()}
    rank = {"statutory": 4, "independent": 3, "self": 2, "related": 2}
    for g in range(6):
        urls, keys = ({"https://a.org/1"} if g == 2 else set()), {k for h, k in known_keys if h == g}
        room, taken, used = 48 - (46 if g == 3 else 0), 0, 0
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-rank.get(r[5], 0), -(r[7].toordinal() if r[7] else 0), r[2], r[1]))
        for _, key, title, ev, url, grade, dup, dated in order:
            mine = own.get(key, [])
            novel = [k for _, k in mine if k not in keys]
            if dup:
                want = "extractorDuplicate"
            elif not url or "bing" in url:
                want = "weakSource"
            elif rank.get(grade, 0) < 2:
                want = "unverifiedSource"
            elif len(title) < 6 or len(ev) < 48:
                want = "thinEvidence"
            elif url in urls:
                want = "duplicateSource"
            elif not 1 <= len(mine) <= 3:
                want = "invalidEdges"
            elif dated is None or (as_of - dated).days > min(age[r] for r, _ in mine):
                want = "staleOrUndated"
            elif not novel:
                want = "duplicateRelation"
            elif taken >= 4 or used + len(novel) > min(6, room):
                want = "capacity"
            else:
                want, taken, used = "accepted", taken + 1, used + len(novel)
                urls.add(url)
                keys.update(novel)
                assert got[key]["novel"] == novel
            assert got[key]["verdict"] == want, (g, key, want)
    reasons = {r["reason"] for r in research.rejections(spark.createDataFrame([(v["verdict"],) for v in got.values()], "verdict string")).collect()}
    assert reasons == set(research.REASONS)


def test_query_links(spark):
    runs = spark.createDataFrame([(i, e, d, s, i) for i, e, d, s in ((1, "Acme, Inc", ["a", "b"], "done"), (2, "acme inc", [], "done"), (3, "Other", ["a"], "done"), (4, "Other", ["a", "b"], "done"), (5, "Acme Inc", [], "error"), (6, "Other", [], "done"))], "run int, entity string, dims array<string>, status string, completed_at int")
    src = spark.createDataFrame([(1, 10), (1, 11), (4, 10), (6, 10), (6, 11)], "run int, source int")
    claims = spark.createDataFrame([(1, 1), (3, 2)], "run int, claim int")
    got = {r["run"]: (r["strength"], r["entity"]) for r in research.query_links(runs, src, claims, 1).collect()}
    assert got == {2: (42, "Acme, Inc"), 4: (32, "跨主体"), 6: (28, "跨主体")}  # one shared dimension alone, 9, is under the cut


def test_signal_map_edges(spark):
    edges = spark.createDataFrame([(1, 1, None, "甲 公司", "乙", "supply"), (2, 1, "person-org", "张三", "甲公司", "supply"), (3, 2, "person-person", "张三", "李四", "personnel"), (4, 3, None, "丙", "丁", "odd"), (5, 4, None, "李四", " ", "equity")], "seq int, signal int, kind string, from_node string, to_node string, relation string")
    people = spark.createDataFrame([("李四",)], "name string")
    placed = evidence.market_mentions(edges, people, list(signals.RELATIONS))
    assert {(r["signal"], r["org"]) for r in placed.collect()} == {(1, "甲公司"), (1, "乙")}
    assert {r["signal"] for r in evidence.off_map(spark.createDataFrame([(i,) for i in range(1, 6)], "signal int"), placed).collect()} == {2, 3, 4, 5}


def test_findings_need_groups(spark):
    rows = [(i, a, v, g) for i in range(12) for a, v, g in (("billing", "x" if i < 6 else "y", "self"), ("stage", "天使" if i < 6 else "B 轮", "public"))]
    labels = spark.createDataFrame(rows, "company int, axis string, label string, grade string")
    assert {(r["row"], r["stalled"]) for r in findings.stalled(labels).collect()} == {("x", True), ("y", False)}
    assert findings.stalled(labels.filter("company < 6")).count() == 0
    assert findings.stalled(labels.filter("company < 10")).count() == 0
    for grades, want in ((["statutory"], "public"), (["statutory", "self"], "internal"), (["self", "unverified"], "lead"), ([], "lead")):
        assert spark.createDataFrame([(grades,)], "g array<string>").select(findings.confidence(F.col("g")).alias("c")).first()["c"] == want


def test_sweep_suppresses_the_transpose(spark):
    rows = [(("a", "b", "c")[i % 3], ("p", "q", "q")[i % 3], "z") for i in range(60)]
    got = statistics.sweep(spark.createDataFrame(rows, "r string, s string, t string"), ["r", "s", "t"]).collect()
    assert [(r["row_axis"], r["col_axis"], r["col_label"], r["spread"]) for r in got] == [("r", "s", "p", 1.0)]
    assert statistics.sweep(spark.createDataFrame(rows, "r string, s string, t string"), ["r", "s", "t"], seen=(("r", "s"), ("s", "r"))).count() == 0


def test_layout(spark):
    nodes = spark.createDataFrame([(f"n{i}", 1 + i % 3) for i in range(15)], "node string, degree int")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)] + [("n10", "n11")], "src string, dst string")
    parts = spark.createDataFrame([(f"n{i}", "n0" if i < 9 else "n10" if i in (10, 11) else f"n{i}") for i in range(15)], "node string, component string")
    one, two = ({r["node"]: (r["x"], r["y"]) for r in signals.layout(nodes.repartition(k), edges, parts).collect()} for k in (1, 3))
    assert one == two and len(one) == 15 and len(set(one.values())) == 15
    assert all(0.025 <= v <= 0.975 for p in one.values() for v in p)
    assert max(one[f"n{i}"][1] for i in range(9)) < min(one[f"n{i}"][1] for i in range(9, 15))  # the large component has the first row


def test_workspaces(spark, tmp_path):
    rows = spark.createDataFrame([(1, "abcdef"), (2, None)], "id int, t string")
    got = dossier.workspace_rows(rows, {"t": 3}, "w1")
    path, names = str(tmp_path / "w"), lambda *w: spark.createDataFrame([(x,) for x in w], "workspace_id string")
    held = lambda: {(r["workspace_id"], r["id"], r["t"]) for r in dossier.read_workspaces(spark, path).collect()}
    assert dossier.read_workspaces(spark, path) is None
    dossier.write_workspace(got, path, names("w1"))
    dossier.write_workspace(dossier.workspace_rows(rows.limit(1), {"t": 2}, "w2"), path, names("w2"))
    dossier.write_workspace(dossier.workspace_rows(rows.filter("id = 2"), {"t": 2}, "w1"), path, names("w1"))
    assert held() == {("w1", 2, None), ("w2", 1, "ab")}
    dossier.write_workspace(got.limit(0), path, names("w1"))
    assert held() == {("w2", 1, "ab")}
    with pytest.raises(Exception, match="more than 1 records"):
        dossier.workspace_rows(rows, {}, "w", most=1).collect()


def test_promotion_keeps_what_was(spark):
    updates = spark.createDataFrame([(1, 5, 7, "2026-01-01", "policy", "s", None, None), (2, 5, 7, "2026-01-01", "target_action", "t", "event_x", None), (3, 5, None, "2026-01-01", "policy", "u", None, None), (4, 6, 7, "2026-01-01", "policy", "v", None, None)], "id int, industry_id int, company_id int, found_at string, kind string, summary string, promoted_to_event_id string, promoted_at string")
    picks = spark.createDataFrame([(i, None, "2026-02-02") for i in (1, 2, 3, 4, 9)], "id int, company int, promoted_at string")
    facts = spark.createDataFrame([("s1", "industry_update", "1", "summary")], "source_id string, table string, row_id string, field string")
    after, events, cells, refused = dossier.promoted(updates, picks, spark.createDataFrame([(7, 5)], "id int, industry_id int"), facts)
    assert {(r["id"], r["promoted_to_event_id"] is not None, r["promoted_at"]) for r in after.collect()} == {(1, True, "2026-02-02"), (2, True, "2026-02-02"), (3, False, None), (4, False, None)}
    assert [(r["company_id"], r["kind"]) for r in events.collect()] == [(7, "statement")]
    assert {r["field"] for r in cells.collect()} == set(dossier.EVENT_FIELDS)
    assert {(r["id"], r["why"]) for r in refused.collect()} == {(3, "no company"), (4, "other industry"), (9, "unknown update")}
    again = dossier.promoted(after, picks.withColumn("promoted_at", F.lit("2026-03-03")), spark.createDataFrame([(7, 5)], "id int, industry_id int"), facts)
    assert again[1].count() == 0 and {r["promoted_at"] for r in again[0].filter("id < 3").collect()} == {"2026-02-02"}


def test_filed_facts(spark):
    kind = "company string, dimension string, field string, value string, grade string"
    old = spark.createDataFrame([("a", "d", "x", "1", "statutory"), ("a", "d", "y", "2", "self")], kind)
    new = spark.createDataFrame([("a", "d", "x", "3", "independent"), ("a", "d", "y", "4", "self"), ("b", "d", "x", "5", None)], kind)
    assert {(r["company"], r["field"]): r["value"] for r in signals.merged_facts(old, new).collect()} == {("a", "x"): "1", ("a", "y"): "4", ("b", "x"): "5"}
    assert signals.newest("2026-01-02", "2026-01-01") == "2026-01-02"
