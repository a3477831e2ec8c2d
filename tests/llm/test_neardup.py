from __future__ import annotations

import random
import re

import pytest

from tessera.llm import neardup
from fixture_corpus import SCHEMA, changed, prose

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, percent=75, width=5):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: (len(s), least[find(i)], least[find(i)] == r[0]) for i, (r, s) in enumerate(zip(rows, sets))}


def check(spark, rows):
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_fixture(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("share", [0.01, 0.03, 0.05])
def test_groups_of_near_copies(spark, share):
    rng = random.Random(share)
    base = [prose(rng, 200) for _ in range(4)]
    texts = [changed(rng, b, share) for b in base for _ in range(25)] + base
    rng.shuffle(texts)
    check(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])


def test_blocks_and_stars(spark, monkeypatch):
    """Clusters larger than a block, and keys larger than two, take the other ways."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(9)
    base = prose(rng, 150)
    check(spark, [(i, changed(rng, base, 0.02), "en", "s", 1) for i in range(60)])


def test_recall_of_the_signatures():
    """Of pairs at the threshold at least 99 in 100 lie within ERRORS, and of all these each shares a key."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, size = 4000, 70
    values = rng.integers(1, 2**63, (n, size), dtype=np.uint64)
    own = rng.integers(1, 2**63, (n, 10), dtype=np.uint64)
    a, b = values, np.concatenate((values[:, :60], own), 1)  # 60 of 80: similarity 0.75
    sig = [neardup.signatures(np.arange(n + 1) * size, np.sort(x, 1).reshape(-1)) for x in (a, b)]
    apart = sig[0] != sig[1]
    within = apart.sum(1) <= neardup.ERRORS
    assert within.mean() >= 0.99
    chunks = apart.reshape(n, neardup.CHUNKS, -1).sum(2)
    assert (chunks[within].min(1) <= 1).all()


def test_odd_rows(spark, odd, empty):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in neardup.near_duplicates(spark, odd).collect())
    assert got == [(-1, 0, -1, True), (-1, 5, -1, True), (5, 5, 5, True), (5, 5, 5, True), (7, 0, 7, True), (9, 0, 9, True)]
    assert neardup.near_duplicates(spark, empty).count() == 0
