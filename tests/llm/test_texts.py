"""Fingerprints, language-model scores, decontamination and the URL filter."""

from __future__ import annotations

import hashlib
import math
import pathlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixture_corpus import SCHEMA, prose
from pyspark.sql import functions as F

from tessera.llm import decontamination, fingerprints, lm, urls
from tessera.llm import textkit as K

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parse(text):
    known, at, out = set(), 0, []
    while at < len(text):
        j = at + 1
        while j <= len(text) and text[at:j] in known:
            j += 1
        j = min(j, len(text))
        known.add(text[at:j])
        out.append(j)
        at = j
    return out


def test_parse_is_lempel_ziv(rows):
    for _, t, *_ in rows:
        assert fingerprints.parse(t or "") == parse(t or "")


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints(spark, docs, rows, parts):
    got = {r["doc_id"]: r for r in fingerprints.document_fingerprints(spark, docs, parts).collect()}
    texts = [t or "" for _, t, *_ in sorted(rows, key=lambda r: r[0])]
    assert len(got) == len(rows)
    for i, (doc_id, *_) in enumerate(sorted(rows, key=lambda r: r[0])):
        t, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, nxt = fingerprints.symbols([fingerprints.phrase_hashes(x, parse(x)) for x in (t, edited, after)])
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == ((own == other).mean(), (own == nxt).mean())


def test_fingerprints_of_odd_rows(spark, odd, empty):
    got = fingerprints.document_fingerprints(spark, odd).collect()
    assert len(got) == 6
    assert len({r["fingerprint"] for r in got if r["n_chars"]}) == 1
    assert all(0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.document_fingerprints(spark, empty).count() == 0


@pytest.mark.parametrize("order,size", [(2, lm.SLICE), (3, lm.SLICE), (3, 3000), (4, 3000)])
def test_backoff_scores(spark, docs, rows, order, size):
    """Against the recursive definition, in few slices and in many."""
    words = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOW)) for r in rows}
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    counts = Counter()
    for w in words.values():
        counts.update(grams(w))
    total, deep = sum(map(len, words.values())), 0
    got = {r["doc_id"]: r for r in lm.backoff_scores(spark, docs, order=order, slice_bytes=size, range_bytes=size).collect()}
    assert len(got) == len(rows)
    for doc_id, w in words.items():
        own = grams(w)
        c = lambda g: counts[g] - own[g]  # noqa: B023,E731
        s, back, unseen = 0.0, 0, 0
        for i in range(len(w)):
            g, dropped = tuple(w[max(0, i - order + 1) : i + 1]), 0
            while len(g) > 1 and c(g) <= 0:
                g, dropped = g[1:], dropped + 1
            deep += len(g) == order
            back += dropped > 0
            unseen += len(g) == 1 and c(g) <= 0
            s += dropped * math.log(lm.ALPHA) + math.log(c(g) / c(g[:-1]) if len(g) > 1 else max(c(g), lm.ALPHA) / max(1, total - len(w)))
        r = got[doc_id]
        assert (r["n_words"], r["n_backoff"], r["n_unseen"]) == (len(w), back, unseen)
        assert abs(r["log_sum"] - s) < 2e-3
    assert deep > 100


def test_backoff_sql(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    documents = docs.toArrow()  # noqa: F841  read by name
    want = {r[0]: r[1:] for r in duckdb.sql(lm.sql(order=3)).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in lm.backoff_scores(spark, docs, order=3).collect()}
    assert got == want


def test_scores_of_odd_rows(spark, odd, empty):
    """Repeated rows count for each other; without doc_id or words there is no score."""
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_backoff"], r["log_sum"], r["score"]) for r in lm.backoff_scores(spark, odd).collect()), key=str)
    same = "same text here, and quite some more of it".split()
    s = math.log(1 / len(same))
    assert got == [(0, 0, 0, 0.0, None), (0, 9, 0, 0.0, None), *[(5, 9, 0, round(s, 3), round(s / 9, 6))] * 2, (7, 0, 0, 0.0, None), (9, 0, 0, 0.0, None)]
    assert lm.backoff_scores(spark, empty).count() == 0


def edited(rng, text, k):
    x = list(text)
    for _ in range(k):
        p, how = rng.randrange(len(x)), rng.random()
        if how < 0.3:
            del x[p]
        elif how < 0.6:
            x.insert(p, "q")
        else:
            x[p] = "z"
    return "".join(x)


def test_contamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 25 + 3 * i).replace("ß", "s")) for i in range(12)] + [(90, "short"), (91, None), (92, "")]
    texts, want = [], []
    for k in range(60):
        own = set()
        t = prose(rng, 40)
        if k % 3 == 0:
            i, x = items[k % 12]
            t += "\n" + (edited(rng, x, len(x) // 50) if k % 2 else x.replace("ß", "s").upper().replace(" ", "  ")) + " " + prose(rng, 30)
            own = {i}
        texts.append(t)
        want.append(own)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(spark, docs, bench).collect()}
    assert {k: set(r["item_ids"]) for k, r in got.items()} == dict(enumerate(want))
    for k, r in got.items():
        for s in r["spans"]:
            part = re.sub(r"\s+", " ", texts[k][s["begin"] : s["end"]]).lower()
            item = re.sub(r"\s+", " ", dict(items)[s["item_id"]]).lower()
            assert part[20:40] in item or k % 2
    assert {r["doc_id"] for r in decontamination.clean(spark, docs, bench).collect()} == {k for k, w in enumerate(want) if not w}


def test_excerpts_of_an_item(spark):
    """124 bytes of a longer item are found wherever they begin."""
    rng = random.Random(12)
    item = re.sub(r"\s+", " ", prose(rng, 80)).lower().replace("ß", "s").replace("é", "e")[:300]
    texts = [prose(rng, 30) + " " + item[a : a + 124] + " " + prose(rng, 30) for a in range(0, 176, 5)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontamination.contamination(spark, docs, bench).filter("not contaminated").count() == 0


def test_blocks_of_the_benchmark(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, 40)) for i in range(9)]
    docs = spark.createDataFrame([(i, "start " + t, "en", "s", 1) for i, t in items], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: r["item_ids"] for r in decontamination.contamination(spark, docs, bench).collect()}
    n, parts = decontamination.blocks(bench, 600)
    assert n > 3 and sorted(i for p in parts for i in p) == sorted((r["item_id"], r["text"]) for r in bench.collect())
    tables = pathlib.Path(K.shared_dir(spark).removeprefix("file:")) / "tables"
    before = {*tables.glob("*")} if tables.exists() else set()
    more = docs.select("doc_id", "text").union(docs.select(F.lit(100).cast("long"), "text")).union(docs.select(F.lit(None).cast("long"), F.lit(None).cast("string")))
    one, many = (sorted(decontamination.contamination(spark, more, bench, b).collect(), key=str) for b in (1 << 23, 600))
    assert one == many and sum(r["contaminated"] for r in many) == 18
    left = {*tables.glob("*")} - before
    assert [p.name.split("-")[0] for p in left] == ["leaks"]  # hits alone, and no text
    assert {r["doc_id"]: r["item_ids"] for r in decontamination.contamination(spark, docs, bench, 600).collect()} == whole == {i: [i] for i in range(9)}


def test_aligned():
    rng = random.Random(4)
    for _ in range(200):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(5, 25)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 10))) + edited(rng, w, rng.randint(0, 4)) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 10)))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(w, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
            row = new
        whole = decontamination.aligned(w.encode(), t.encode(), 3)
        assert (whole is not None) == (min(row) <= 3)
        if whole:  # the band that holds the alignment finds it, one beside it does not
            assert decontamination.aligned(w.encode(), t.encode(), 3, whole[0] - 3, 6) == whole
            if w not in t:
                assert decontamination.aligned(w.encode(), t.encode(), 0, len(t) + 1, 2) is None


def test_clean_keeps_clashing_columns(spark):
    """A caller's own columns with the operator's names stay as they are."""
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, "x " + item, 7, "a"), (2, "nothing here", 8, "b"), (2, "nothing here", 8, "b"), (None, None, None, None)], "doc_id long, text string, leaks_ int, LEAKS__ string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontamination.clean(spark, docs, bench)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.filter("doc_id is not null").collect()) == [(2, "nothing here", 8, "b")] * 2 and got.count() == 3


def test_contamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text here, and quite some more of it")], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["contaminated"]) for r in decontamination.contamination(spark, odd, bench).collect())
    assert got == [(-1, False), (-1, True), (5, True), (5, True), (7, False), (9, False)]
    assert decontamination.clean(spark, odd, bench).columns == odd.columns
    assert decontamination.contamination(spark, odd, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(spark, empty, bench).count() == 0


def test_rules(spark):
    made = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://x.net/es/1?q", "http://net/fr/", "http://notcom/", "http://com", "http://h?x=/y", None, "no scheme", "http://a.org/en#z", "x://a.net/es", ""]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(made)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.filtered(spark, pages).collect()}
    assert [got[i]["rule"] for i in range(len(made))] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None, None, None]
    assert [(got[i]["host"], got[i]["path"]) for i in (1, 7, 8, 9, 10)] == [("example.com", "/en/1"), ("h", ""), ("", ""), ("", ""), ("a.org", "/en")]
    assert [got[i]["verdict"] for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert urls.filtered(spark, pages.limit(0)).count() == 0


def test_model_blocks_what_looks_unwanted(spark):
    rng = random.Random(3)
    good = [f"http://{rng.choice(['news', 'blog', 'wiki'])}{rng.randrange(99)}.com/{rng.choice('abcdef')}/{i}" for i in range(300)]
    bad = [f"http://casino-win{rng.randrange(99)}.com/play/{i}" for i in range(100)]
    probe = ["http://cas1no-winner7.org/play/3", "http://wiki5.org/b/77"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + probe)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filtered(spark, pages).collect()}
    assert (got[400], got[401]) == ("block", "allow")


def test_no_python_in_the_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = urls.filtered(spark, pages)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_normalised():
    data = np.frombuffer("A\t\n b é".encode(), np.uint8)
    out, off, at = decontamination.normalised(data, np.array([0, len(data)]))
    assert out.tobytes().decode() == "a b é"
    assert decontamination.found(pa.array(["", None], pa.string()).fill_null(""), decontamination.indexed([(1, "x" * 40)])) == [{}, {}]
