from __future__ import annotations

import hashlib
import random

import pytest

from tessera.llm import lines
from fixture_corpus import SCHEMA

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def brute(rows, least):
    seen, out = [], {}
    for doc_id, text, *_ in sorted(rows):
        kept, own = [], (text or "").split("\n")
        for k, line in enumerate(own):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOW)
            if len(key) < least or not any(abs(len(key) - len(s)) <= 1 and distance(key, s) <= 1 for s in seen):
                kept.append(line)
            if len(key) >= least:
                seen.append(key)
        out[doc_id] = (0 if text is None else len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def edits(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé fgh") for _ in range(rng.randint(18, 40))) for _ in range(12)]
    rows = []
    for d in range(40):
        made = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(x))
                how = rng.random()
                if how < 0.35:
                    del x[p]
                elif how < 0.65:
                    x.insert(p, rng.choice("xyz"))
                else:
                    x[p] = rng.choice("XYZ")
            made.append("".join(x))
        rows.append((d, "\n".join(made), "en", "s", 1))
    return rows


@pytest.mark.parametrize("group", [lines.GROUP, 1])
def test_edits(spark, group):
    """Both ways: in a task, and by a shuffle of the variants (any shared half counts as common)."""
    rows = edits(4)
    got = lines.deduplicated(spark, spark.createDataFrame(rows, SCHEMA), 20, group).collect()
    want = brute(rows, 20)
    assert {r["doc_id"]: (r["lines_removed_"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got} == {d: w[1:] for d, w in want.items()}
    assert sum(w[1] for w in want.values()) > 20


def test_fixture(spark, docs, rows):
    small = [r for r in rows if len(r[1] or "") < 4000]
    got = lines.line_dedup(spark, spark.createDataFrame(small, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in got} == brute(small, lines.LEAST)
    assert lines.line_dedup(spark, docs).count() == len(rows)


@pytest.mark.parametrize("shortest", [1, 5])
def test_short_lines(spark, shortest):
    """Short lines go if an equal one stands earlier, and only then; one edit is not enough."""
    rng = random.Random(9)
    short = ["a", "é", "Yes.", " yes. ", "yes!", "Chapter", "chapter", "chapters", "", "  ", "nineteen characters", "twenty characters ok", "twenty characters o"]
    rows = [(d, "\n".join(rng.choice(short) for _ in range(rng.randint(1, 4))), "en", "s", 1) for d in range(30)]
    seen, far, want = set(), [], {}
    for d, text, *_ in rows:
        kept = []
        for line in text.split("\n"):
            key = line.strip(" \t").translate(LOW)
            near = len(key) >= 20 and any(distance(key, s) <= 1 for s in far)
            if not near and (key not in seen or len(key) < shortest or not key):
                kept.append(line)
            seen.add(key)
            far += [key] * (len(key) >= 20)
        want[d] = "\n".join(kept)
    got = lines.deduplicated(spark, spark.createDataFrame(rows, SCHEMA), shortest=shortest).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


def test_within_one():
    rng = random.Random(2)
    for _ in range(3000):
        x, y = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert lines.within_one(x, y) == (distance(x, y) <= 1)


def test_clashing_names_and_long_lines(spark):
    """Columns with the operator's own names stay; a very long line among groups of short ones."""
    long = "abcdefghij klm" * 40_000
    rows = [(1, long, 7, "x"), (2, long + "!", 8, "y"), (3, "z" * 30 + "\n" + long[:-1], 9, "z"), (4, "z" * 31, 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lost_doc_ int, Lost_Lines_ string")
    got = {r["doc_id"]: r for r in lines.deduplicated(spark, docs, removed="gone").collect()}
    assert {d: (r["gone"], len(r["text"]), r["lost_doc_"], r["Lost_Lines_"]) for d, r in got.items()} == {1: (0, len(long), 7, "x"), 2: (1, 0, 8, "y"), 3: (1, 30, 9, "z"), 4: (1, 0, 1, "w")}
    again = lines.deduplicated(spark, docs.withColumnRenamed("lost_doc_", "lines_removed_"))
    assert again.columns == ["doc_id", "text", "Lost_Lines_", "lines_removed_"]


def test_odd_rows(spark, odd, empty):
    out = lines.deduplicated(spark, odd)
    assert out.columns == [*odd.columns, "lines_removed_"]
    got = sorted((r["doc_id"] or -1, r["text"], r["lines_removed_"]) for r in out.collect() if r["text"])
    same = "same text here, and quite some more of it"
    assert got == [(-1, same, 0), (5, same, 0), (5, same, 0)]
    assert out.count() == 6
    assert lines.line_dedup(spark, empty).count() == 0
