from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substrings, suffixes
from tessera.llm import textkit as K
from fixture_corpus import SCHEMA, prose


def brute(rows, length=50):
    first, out = {}, {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        mark = bytearray(len(b))
        windows = [b[i : i + length] for i in range(len(b) - length + 1)]
        for i, w in enumerate(windows):
            if first.get(w, doc_id) < doc_id:
                mark[i : i + length] = b"\1" * length
        for w in windows:
            first.setdefault(w, doc_id)
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out[doc_id] = (len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())
    return out


def check(spark, rows, **options):
    got = substrings.substring_dedup(spark, spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(300):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 26])
        d = np.array([rng.randrange(k) for _ in range(n)], np.uint8)
        b = d.tobytes()
        sa = suffixes.suffix_array(d)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: b[i:])
        plcp = suffixes.permuted_common_prefixes(d, sa, 20)
        for r in range(1, n + 1):
            i, j, m = sa[r], sa[r - 1], 0
            while m < 20 and max(i, j) + m < n and b[i + m] == b[j + m]:
                m += 1
            assert plcp[i] == m


@pytest.mark.parametrize("made", ["periodic", "random", "words", "runs"])
def test_suffix_array_recursion(monkeypatch, made):
    """Long strings whose names repeat: sorted by levels of names, with and without a depth."""
    rng = np.random.default_rng(4)
    d = {
        "periodic": np.tile(rng.integers(97, 100, 37), 120),
        "random": rng.integers(0, 256, 30_000),
        "words": np.frombuffer(prose(random.Random(1), 4000).encode(), np.uint8),
        "runs": np.repeat(rng.integers(97, 99, 900), rng.integers(1, 9, 900)),
    }[made].astype(np.uint8)
    levels = []
    real = suffixes._sorted
    monkeypatch.setattr(suffixes, "_sorted", lambda t, depth: levels.append((len(t), int(t.max()))) or real(t, depth))
    b, sa = d.tobytes(), suffixes.suffix_array(d)
    assert all(b[i:] < b[j:] for i, j in zip(sa[:-1].tolist(), sa[1:].tolist()))
    assert sorted(sa.tolist()) == list(range(len(b) + 1))
    assert len(levels) > 1 and all(2 * n <= m + 1 for (m, _), (n, _) in zip(levels, levels[1:]))
    assert made == "periodic" or made == "runs" or max(k for _, k in levels) > 1 << 10  # both ways to induce
    sa = suffixes.suffix_array(d, 50)
    cut = [b[i : i + 50] for i in sa.tolist()]
    assert all(x <= y for x, y in zip(cut, cut[1:]))


def test_fixture(spark, rows):
    check(spark, rows)


def test_common_passages(spark, monkeypatch):
    """A passage that all documents hold: its windows go by their own hashes."""
    monkeypatch.setattr(substrings, "COMMON", 0.0)
    rng = random.Random(5)
    passage = prose(rng, 40)
    rows = [(i, prose(rng, 10) + passage[rng.randrange(20) :] + prose(rng, 10), "en", "s", 1) for i in range(150)]
    found = []
    real = substrings._pieces

    def spy(length, gram, shards, common, docs_buckets):
        found.append(len(common))
        return real(length, gram, shards, common, docs_buckets)

    monkeypatch.setattr(substrings, "_pieces", spy)
    check(spark, rows)
    assert found[0] > 0


def test_periodic_texts(spark):
    check(spark, [(1, "ab" * 200, "en", "s", 1), (2, "x" + "ab" * 90 + "y", "en", "s", 1), (3, "b" * 49 + "ab" * 30, "en", "s", 1), (4, "b" * 60, "en", "s", 1), (5, "b" * 61 + "é" * 40, "en", "s", 1)])


def test_odd_rows(spark, odd, empty):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in substrings.substring_dedup(spark, odd).collect())
    assert got == [(-1, 0, 0), (-1, 41, 0), (5, 41, 0), (5, 41, 0), (7, 0, 0), (9, 0, 0)]
    assert substrings.substring_dedup(spark, empty).count() == 0


@pytest.mark.parametrize("runs", [([0, 3], [2, 5]), ([0, 1], [4, 9])])
def test_merged(runs):
    a, b = (np.array(x, np.int64).tobytes() for x in runs)
    assert substrings.merged(a, b, 6) == ([(0, 2), (3, 5)] if runs[0] == [0, 3] else [(0, 6)])


def test_rows_to_shards():
    """F1 of round 3: buckets and shards get a row for each 16 MB of text; with one for each 2 MB, rows grew with the square of the input."""
    rng = random.Random(6)
    passage = prose(rng, 400)
    texts = [prose(rng, 2000) + passage for _ in range(300)]
    assert sum(map(len, texts)) > 3 << 20
    ids = np.arange(len(texts), dtype=np.int64)
    batches = pa.Table.from_pydict({"doc_id": ids, "text": texts}).to_batches(max_chunksize=50)
    out = [r for b in substrings._anchors(50, 24, 8)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["bucket"] for r in out if not r["kind"]) == [*range(8)]
    both = [(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.int64)) for r in out if r["kind"]]
    assert len(both) == 1 and set(both[0][1].tolist()) == set(ids.tolist())
    marks = [{"bucket": 0, "kind": 1, "doc_id": None, "text": None, "a": both[0][0].tobytes(), "b": both[0][1].tobytes()}]
    rows = marks + [{"bucket": 0, "kind": 0, "doc_id": i, "text": t, "a": None, "b": None} for i, t in enumerate(texts)]
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("a", pa.binary()), ("b", pa.binary())])
    pieces = [r for b in substrings._pieces(50, 24, 8, np.zeros(0, np.uint64), 1)(iter(pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=50))) for r in b.to_pylist()]
    assert sorted(r["bucket"] for r in pieces if not r["kind"]) == [*range(8)]
    assert sum(r["kind"] for r in pieces) == 1


def test_anchors_shared_by_chance(monkeypatch):
    """F1 of round 3: pieces that share 30 bytes but no window stay out of the suffix array, others go in."""
    sizes = []
    real = substrings.suffix_array
    monkeypatch.setattr(substrings, "suffix_array", lambda text, depth: sizes.append(len(text)) or real(text, depth))
    rng = random.Random(7)
    some = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    core, passage = some(30), some(60)

    def lost(pieces):
        size = np.array([len(p) for p in pieces])
        return [x.tolist() for x in substrings.repeats(np.arange(len(pieces)), np.zeros(len(pieces), np.int64), size, np.frombuffer(b"".join(pieces), np.uint8), 50)]

    apart = [some(25) + core + some(25) for _ in range(20)]
    assert lost(apart) == [[], [], []] and not sizes
    assert lost([*apart, some(10) + passage, passage + some(10)]) == [[21], [0], [60]] and sizes == [140]


def test_rows_of_a_task():
    """F1 of round 3: what the shards of a task take from the documents of a bucket leaves it in one row."""
    rng = random.Random(8)
    passages = [prose(rng, 12).encode() for _ in range(4)]
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
    docs = np.array([1, 2], np.int64).tobytes()
    shard = lambda k, p: {"bucket": k, "kind": 0, "a": docs, "b": np.array([0, 100 * k, len(p), len(p)], np.int32).tobytes(), "c": K.packed(p + p)}
    settled = {"bucket": 0, "kind": 1, "a": np.array([2], np.int64).tobytes(), "b": np.array([900], np.int64).tobytes(), "c": np.array([950], np.int64).tobytes()}
    table = pa.Table.from_pylist([*(shard(k, p) for k, p in enumerate(passages)), settled], schema)
    found = pa.Table.from_batches(substrings._shards(50, 1)(iter(table.to_batches())))
    assert found.num_rows == 1
    got = [r for b in substrings._by_document(iter(found.to_batches())) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == [2]
    assert np.frombuffer(got[0]["begins"], np.int64).tolist() == [0, 100, 200, 300, 900]
    assert np.frombuffer(got[0]["ends"], np.int64).tolist() == [*(100 * k + len(p) for k, p in enumerate(passages)), 950]


def test_rows_of_marked_documents():
    """F1 of round 3: a document with anchors in many buckets gives one row, not one for each of these."""
    docs = np.arange(1000, dtype=np.int64)
    own = substrings.spread(docs, 4)
    rows = [{"bucket": k, "b": np.repeat(docs[own == k], 2).tobytes()} for _ in range(32) for k in range(4)]
    table = pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("b", pa.binary())]))
    found = pa.Table.from_batches(substrings._ids(iter(table.sort_by("bucket").to_batches(max_chunksize=10))))
    assert sorted(found["doc_id"].to_pylist()) == docs.tolist()
    sent = pa.Table.from_batches(substrings._marked(4)(iter(table.to_batches(max_chunksize=10))))
    assert sent["bucket"].to_pylist() == [0, 1, 2, 3]
    assert [np.frombuffer(b, np.int64).tolist() for b in sent["b"].to_pylist()] == [docs[own == k].tolist() for k in range(4)]
    none = substrings._marked(4)(iter(table.slice(0, 0).to_batches()))
    assert sum(b.num_rows for b in none) == 0
