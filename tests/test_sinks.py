"""Sinks: replacement by key at once, snapshots, streams over restarts."""

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import holders
from tessera.operators import changes, dossier, evidence, research
from tessera.sources import pages, tables, versions
from tessera.streaming import ingest


def test_replacement_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    held = lambda: sorted(tuple(r) for r in versions.current(spark, path, "k").collect())
    assert versions.current(spark, path, "k") is None and versions.vacuum(spark, path) == 0
    versions.replace(rows(("a", 1), ("a", 2), ("b", 3)), keys("a", "b"), path, "k")
    before = versions.current(spark, path, "k")
    versions.replace(rows(("a", 4)), keys("a", "c"), path, "k")
    assert held() == [("a", 4), ("b", 3)] and before.count() == 3  # a reader goes on with what it began with
    versions.replace(rows(), keys("b"), path, "k")
    assert held() == [("a", 4)]
    with pytest.raises(Exception, match="a row of another k"):
        versions.replace(rows(("z", 1)), keys("a"), path, "k")
    broken = rows(("a", 9)).withColumn("v", F.raise_error(F.lit("dies")).cast("int"))
    with pytest.raises(Exception, match="dies"):
        versions.replace(broken, keys("a"), path, "k")
    assert held() == [("a", 4)]
    assert versions.vacuum(spark, path) >= 1 and held() == [("a", 4)]  # what dead writers left
    versions.compact(spark, path, "k")
    assert held() == [("a", 4)] and len(versions.replacements(spark, path)) == 1
    assert versions.vacuum(spark, path) == 3 and held() == [("a", 4)]
    versions.replace(rows(("c", 5)), keys("c"), path, "k")
    assert held() == [("a", 4), ("c", 5)]


def test_a_killed_write_changes_nothing(spark, tmp_path):
    """Everything is written but the file that makes it count."""
    path = str(tmp_path / "t")
    tables.write_snapshot(spark.createDataFrame([(1,)], "v int"), path, "2026-01-01")
    tables.write_snapshot(spark.createDataFrame([(2,), (3,)], "v int"), path, "2026-01-02")
    last = max((tmp_path / "t" / "log").glob("0*"))
    last.unlink()
    assert [tuple(r) for r in tables.read_snapshots(spark, path).collect()] == [(1, "2026-01-01")]
    tables.write_snapshot(spark.createDataFrame([], "v int"), path, "2026-01-01")
    assert tables.read_snapshots(spark, path).count() == 0


def test_first_within_limits_over_restarts(spark, tmp_path):
    day = lambda n: datetime.datetime(2026, 1, 1) - datetime.timedelta(days=n)
    kind = "id string, ts timestamp, relation string"

    def put(*rows):
        spark.createDataFrame([(i, day(n), r) for i, n, r in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        events = ingest.stream(spark, str(tmp_path / "in"), kind)
        out = ingest.first_within_limits(events, "id", "ts", "relation")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["id"] for r in spark.read.schema(kind).parquet(str(tmp_path / "out")).collect())

    put(("a", 0, "equity"), ("b", 300, "compete"), ("a", 0, "equity"))
    assert run() == ["a", "b"]
    put(("a", 0, "equity"), ("b", 300, "compete"), ("c", 364, "compete"), ("d", 366, "compete"), ("e", 547, "supply"), ("f", 549, "supply"), ("g", 729, "license"), ("h", 731, "license"), ("i", 366, "odd"))
    assert run() == ["a", "b", "c", "e", "g"]
    put(("c", 364, "compete"), ("j", -800, "equity"))
    assert run() == ["a", "b", "c", "e", "g", "j"]
    put(("a", 0, "equity"), ("k", -100, "equity"))
    assert run() == ["a", "b", "c", "e", "g", "j", "k"]


def test_first_of_a_batch(spark, tmp_path):
    put, out = ingest.upsert_into(str(tmp_path / "o"), ["id"], order="seq"), str(tmp_path / "o")
    put(spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (2, 1, None)], "id int, seq int, v string").repartition(3), 0)
    put(spark.createDataFrame([(1, 0, "again"), (3, 1, "new")], "id int, seq int, v string"), 1)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, 2, "first"), (2, 1, None), (3, 1, "new")}


def test_diffs_read_what_differs(spark, tmp_path):
    """Two snapshots of 64 buckets that differ in a few rows: the same lines, from the folders of those rows alone."""
    kind, names = "k int, v string, w int, x int", ["v", "w"]
    old = [(k, f"v{k}" if k % 5 else None, k % 3, k) for k in range(400)]
    new = [(k, "other" if k == 7 else v, w, x + 1) for k, v, w, x in old if k != 9] + [(1000, None, None, 0)]
    a, b = spark.createDataFrame(old, kind).repartition(3), spark.createDataFrame(new, kind)
    want = sorted(map(tuple, changes.snapshot_diff(a, b, ["k"], names).collect()))
    assert [(r[0], r[1]) for r in want] == [(7, "changed"), (9, "removed"), (1000, "added")]
    assert sorted(map(tuple, changes.snapshot_diff(*changes.pruned(a, b, ["k"], names, 64), ["k"], names).collect())) == want
    paths = [str(tmp_path / n) for n in "ab"]
    for df, path in zip((a, b), paths):
        changes.keep_snapshot(df, path, ["k"], names, 64)
    got = changes.kept_diff(spark, *paths, ["k"], names)
    assert sorted(map(tuple, got.collect())) == want
    differ = [r["bucket"] for r in changes.changed_buckets(*(spark.read.parquet(f"{p}/sums") for p in paths)).collect()]
    assert 1 <= len(differ) <= 3
    plan = changes.kept_rows(spark, paths[0], differ)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket_", plan) and changes.kept_rows(spark, paths[0]).count() == 400
    assert changes.kept_diff(spark, paths[0], paths[0], ["k"], names).count() == 0


def test_what_no_query_reaches(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, 1), ("a", 2, 1), ("c", 3, 0), ("d", 2, 4)], "org string, heat int, checked int")
    assert [r["org"] for r in evidence.ordered_rows(rows).collect()] == ["c", "d", "a", "b"]
    old, new = rows.limit(1), rows
    assert research.import_if_new(old, new, "v1", "v1") is old and research.import_if_new(old, new, "v1", "v2") is new and research.import_if_new(old, new, None, "v1") is new
    times = spark.createDataFrame([(" 2026-01-02 10:00:00",), ("x 2026-01-02",), (None,)], "t string")
    assert [r["p"] for r in times.select(holders.period_of(F.col("t")).alias("p")).collect()] == ["2026-01-02", "", ""]
    found = spark.createDataFrame([("o1", ["s1", "s2"], ["s2", "s3"], 7), ("o2", [], [], None)], "id string, step_sources array<string>, system_sources array<string>, system_id int")
    facts = dossier.opportunity_facts(found).collect()
    assert len(facts) == 3 * (len(dossier.OPPORTUNITY_FIELDS) + 1) and len({r["id"] for r in facts}) == len(facts)
    assert {r["source_id"] for r in facts if r["field"] == "system_in_use:7"} == {"s1", "s2", "s3"}
    assert [(r["org"], r["heat"]) for r in dossier.latest_by_rank(rows, "heat", F.desc("checked"), F.col("org")).orderBy("heat").collect()] == [("d", 2), ("c", 3)]
    page = spark.createDataFrame([("k", "<p>\n</p>")], "key string, html string")
    pages.write_pages(page, str(tmp_path / "p"))
    pages.write_pages(page, str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [("k", "<p>\n</p>")]
