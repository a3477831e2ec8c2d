"""The pipeline's stages against what they must keep and drop on a small corpus."""

from __future__ import annotations

import random

import pytest
from fixture_corpus import SCHEMA, changed, prose

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    out = tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    for i in range(400):
        t = prose(rng, rng.randint(60, 120))
        bad = i % 5 == 4
        if bad:
            t = " ".join(x + rng.choice(["###", "$$$"]) for x in t.split(" "))
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not bad), 0))
    items = [(k, prose(rng, 40)) for k in range(5)]
    docs += [(1000 + k, changed(rng, docs[k][1], 0.02).replace("\n", " "), "en", "s", 1) for k in (0, 1, 2)]  # near copies
    docs += [(1100 + k, docs[k][1], "en", "s", 1) for k in (5, 6, 7)]  # copies
    docs += [(1200 + k, prose(rng, 50) + " " + x + " " + prose(rng, 50), "en", "s", 1) for k, x in items]
    docs += [(1300, None, "en", "s", None), (1301, "", "en", "s", 0)]
    docs[0:3] = [(i, t.replace("\n", " "), a, b, c) for i, t, a, b, c in docs[0:3]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from tessera.llm import textkit as K

    docs = K.documents(spark, sf_dir)
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = K.stored(spark, stage(spark, docs, sf_dir), f"test-{name}")
        assert new.columns == docs.columns
        ids[name] = {r["doc_id"] for r in new.select("doc_id").collect()}
        docs = new
    bad = {i for i in range(400) if i % 5 == 4}
    assert len(ids["quality_classifier"] & bad) <= 8
    clean = set(range(400)) - bad
    assert len(clean - ids["quality_classifier"]) <= 5
    assert not ids["line_dedup"] & {1105, 1106, 1107}
    assert clean & ids["quality_classifier"] <= ids["decontamination"] | {1000, 1001, 1002}
    assert not ids["near_dedup"] & {1000, 1001, 1002}
    assert not ids["decontamination"] & {1200 + k for k in range(5)}


def test_run(spark, sf_dir):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 250
    assert got.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_stages_survive_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, repeated rows, ties, a very long text and clashing names; then an empty table."""
    import corpus_pipeline
    from tessera.llm import textkit as K

    kind = SCHEMA + ", lines_removed_ int, leaks_ string, lost_doc_ int, cluster int"
    words = "some words that make up a plain and honest line of text here"
    made = [(None, words, "en", "s", 1), (5, words, "en", "s", 1), (5, words, "en", "s", 1), (6, None, None, None, None), (7, "", "en", "s", 0), (8, "x" * 200_000 + "\n" + words, "en", "s", 1), (9, words + " and more of it than before, so that it is another text", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, "l", 2, 3) for r in made], kind)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = K.settled(spark, lambda: stage(spark, docs, sf_dir), f"odd-{name}")  # noqa: B023
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.collect()}
        assert None in ids and {6, 7} <= ids, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, sf_dir).collect()}
    assert kept[8] == "x" * 200_000 and kept[5] == words
    assert corpus_pipeline.quality_stage(spark, docs, sf_dir).columns == docs.columns
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), sf_dir).count() == 0


def brute(rows, items):
    """Line dedup, near dedup and decontamination by the plain definitions: {doc_id: text} of what stays."""
    from test_lines import LOW, distance
    from test_neardup import brute as components

    seen, far, left = set(), [], []
    for doc_id, text, *rest in sorted(rows):
        kept, own = [], text.split("\n")
        for line in own:
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOW)
            again = key in seen or (len(key) >= 20 and any(abs(len(key) - len(x)) <= 1 and distance(key, x) <= 1 for x in far))
            if not (key and again):
                kept.append(line)
            seen.add(key)
            far += [key] * (len(key) >= 20)
        new = "\n".join(kept)
        if len(kept) == len(own) or new.split():
            left.append((doc_id, new, *rest))
    near = components(left)
    left = [r for r in left if near[r[0]][2]]

    def within(item, text):
        x, y = (" ".join(t.split()).translate(LOW) for t in (item, text))
        k, row = int(0.06 * len(x)), [0] * (len(y) + 1)
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row) <= k

    return {r[0]: r[1] for r in left if not any(within(x, r[1]) for _, x in items)}


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import textkit as K

    rng = random.Random(12)
    plain = lambda n: prose(rng, n).replace("é", "e").replace("ß", "s")
    base = [plain(70) for _ in range(14)]
    items = [(k, plain(14).replace("\n", " ")[:90].strip()) for k in range(4)]
    texts = base + [changed(rng, b.replace("\n", " "), 0.03) for b in base[:5]] + base[5:8]
    texts += [f"A line that stands in several of the texts.\n{plain(12)}\nshort {k % 2}" for k in range(6)] + ["Short 1\nA line that stands in several of the text."]
    texts += [plain(25) + " " + x + " " + plain(25) for _, x in items] + [plain(25) + " " + x[:30] + "zz" + x[31:] + " end" for _, x in items[:2]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = K.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, str(tmp_path)), f"brute-{name}")
    got, want = {r["doc_id"]: r["text"] for r in docs.collect()}, brute(rows, items)
    assert got == want
    assert len(want) < len(rows) - 12 and any(want[i] != rows[i][1] for i in want)


def test_line_stage_keeps_words(spark):
    """Under a long line that many share, a short line that stands nowhere earlier keeps its document."""
    import corpus_pipeline

    licence = "This licence stands at the head of very many documents. " * 3
    texts = [licence + "\nfirst line", licence + "\nred\nblue", licence + "\nRED\n blue ", licence + "\nred\ngreen", licence, "red", "pink"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("red\nblue", 8), 3: ("green", 5), 6: ("pink", 4)}
