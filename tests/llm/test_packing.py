from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def reference_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer(rows):
    texts = [t or "" for _, t, *_ in rows] + ["  a b", "a\n \nb", "a  b", "tab\t b é ñ。", "don't we're I'll", "x<|endoftext|> y", "12 345 a1b2", " ", "\x1c x"]
    got = [x.tolist() for x in packing.encoder(PATH).batch(pa.array(texts))]
    assert got == reference_ids(texts)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack_is_whole_and_tight(spark, docs, rows, capacity):
    got = packing.pack(spark, docs, PATH, capacity).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    ids = dict(zip([r[0] for r in rows], reference_ids([r[1] or "" for r in rows])))
    for doc_id, pieces in by_doc.items():
        whole = np.array([*ids[doc_id], 0], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert sum(r["length"] for r in pieces) == len(whole)
        for r in pieces:
            assert zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert all(r["length"] == capacity for r in pieces[1:])
    assert len(by_doc) == len(rows)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.12 * -(-total // capacity) + 1


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 513, 5000).tolist())
    rows, n = packing.plan(counts, 512)
    used, seen = np.zeros(n, int), defaultdict(list)
    for length, rank, count, lo, offset in rows:
        assert (used[lo : lo + count] == offset).all()
        used[lo : lo + count] += length
        seen[length].append((rank, count))
    for length, runs in seen.items():
        at = 0
        for rank, count in sorted(runs):
            assert rank == at
            at += count
        assert at == counts[length]
    assert used.max() <= 512
    assert n <= 1.02 * sum(k * c for k, c in counts.items()) / 512


def test_cost_does_not_grow_with_the_counts():
    counts = {k: 3 + k % 7 for k in range(1, 513)}
    few, many = packing.plan(counts, 512)[0], packing.plan({k: 10**6 * c for k, c in counts.items()}, 512)[0]
    assert len(many) < 4 * len(few)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": "unigram"}, {"model": "turned"}])
def test_other_tokenizers_are_refused(tmp_path, change):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    if change.get("model") == "unigram":
        change = {"model": spec["model"] | {"type": "Unigram"}}
    elif change.get("model") == "turned":
        change = {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}
    (tmp_path / "t.json").write_text(json.dumps(spec | change), encoding="utf-8")
    with pytest.raises(ValueError, match=next(iter(change)) if "model" not in change else "model|merges"):
        packing.Encoder(str(tmp_path / "t.json"))


def test_odd_rows(spark, odd, empty):
    got = packing.pack(spark, odd, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["length"] > 1) for r in got) == [(-1, False), (-1, True), (5, True), (5, True), (7, False), (9, False)]
    assert packing.pack(spark, empty, PATH).count() == 0


def test_sequences_hold_the_ids(spark, docs, rows):
    packed = packing.pack(spark, docs, PATH, 128)
    made = packing.sequences(docs, packed, PATH, 128).collect()
    assert all(len(r["ids"]) <= 128 for r in made)
    assert sum(len(r["ids"]) for r in made) == sum(len(x) + 1 for x in reference_ids([t or "" for _, t, *_ in rows]))
