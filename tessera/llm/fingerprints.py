"""Lempel-Ziv phrase fingerprints: a text's dictionary phrases, hashed, under MinHash.

Each text is parsed incrementally: a phrase is the longest one known so far and one more
character. The set of phrases is hashed and SYMBOLS minima of 16 bits make the fingerprint;
the share of equal symbols estimates how much of two texts' dictionaries is shared, as a
compressor primed with the one would find in the other.

The known phrases contain each beginning of each phrase, so the length of the next phrase is
searched around the last one's length instead of from one character on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K

SYMBOLS = 64
_rng = np.random.default_rng(19)
_A = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def parse(text: str, known: set[str] | None = None, at: int = 0) -> list[int]:
    """The ends of the phrases from place `at` on, with `known` phrases before; known grows."""
    known = set() if known is None else known
    ends, n, size = [], len(text), 1
    add = known.add
    while at < n:
        if text[at : at + size] in known:
            while at + size < n and text[at : at + size] in known:
                size += 1
        else:
            while size > 1 and text[at : at + size - 1] not in known:
                size -= 1
        at += size
        if at > n:
            at = n
        add(text[at - size : at])
        ends.append(at)
    return ends


def phrase_hashes(text: str, ends: list[int], start: int = 0) -> np.ndarray:
    """The hashes of the phrases that end at `ends`, the first of which begins at `start`."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    cuts = np.array([start, *ends])
    if len(data) != len(text):
        cuts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[cuts]
    return K.substring_hash(K.prefix(data), cuts[:-1], cuts[1:])


def symbols(hashes: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit minima for each set; 0xFFFF throughout for an empty set."""
    out = np.full((len(hashes), SYMBOLS), 0xFFFF, np.uint16)
    size = np.array([len(h) for h in hashes])
    full = np.flatnonzero(size)
    if len(full):
        value, at = np.concatenate(hashes), (np.cumsum(size) - size)[full]
        for k in range(SYMBOLS):
            out[full, k] = (K.mix(np.minimum.reduceat(value * _A[k] + _B[k], at)) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def edited_text(text: str, after: str) -> str:
    """text with its last floor(n/2) characters replaced by the first as many (or all) of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts as rows of symbols."""
    return symbols([phrase_hashes(t, parse(t)) for t in texts])


def digest(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all texts but the last, which is only looked at: their fingerprints (the last one's too),
    those of the texts as edited with their successors, and the edited texts.

    The edited text begins like the text, so the phrases that end in the part kept are taken over.
    """
    own, other, edits = [], [], []
    for k, text in enumerate(texts):
        ends = parse(text)
        h = phrase_hashes(text, ends)
        own.append(h)
        if k + 1 < len(texts):
            new = edited_text(text, texts[k + 1])
            keep = len(text) - len(text) // 2
            m = int(np.searchsorted(ends, keep, "right")) if ends else 0
            start = ends[m - 1] if m else 0
            known = {text[i:j] for i, j in zip([0, *ends[: m - 1]], ends[:m])} if m else set()
            other.append(np.concatenate((h[:m], phrase_hashes(new, parse(new, known, start), start))))
            edits.append(new)
    return symbols(own), symbols(other), edits


def neighbours(spark: SparkSession, docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, str]:
    """docs (doc_id, text) dealt into ranges of doc_id, sorted, and the first text of all.

    Columns: bucket, doc_id, text, guest. Each range is followed by the rows that begin the next
    one, marked as guests, so that every row but the last of all stands before its successor.
    The bounds are ids of the table: as many as there are ranges, and nothing else reaches the
    driver but the one first row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / parts for k in range(1, parts)] or [0.5]
    bounds = docs.agg(F.percentile_approx("doc_id", steps, 20 * parts)).first()[0] or []
    first = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1).collect()
    edge = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        missing = ids.isna().to_numpy()
        d = ids.fillna(0).astype("int64").to_numpy()
        k = np.where(missing, 0, np.searchsorted(edge, d, "right"))
        begins = np.where(missing | (k == 0), False, edge[np.maximum(k - 1, 0)] == d) if len(edge) else np.zeros(len(d), bool)
        return pd.Series([[a, -a] if b else [a] for a, b in zip(k.tolist(), begins.tolist())])

    dealt = docs.withColumn("place", F.explode(places("doc_id")))
    dealt = dealt.select(F.when(F.col("place") < 0, -F.col("place") - 1).otherwise(F.col("place")).alias("bucket"), "doc_id", "text", (F.col("place") < 0).alias("guest"))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text"), first[0]["text"] if first else ""


def document_fingerprints(spark: SparkSession, docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, and their likenesses.

    A null text is empty; an empty text has no phrases and is like empty texts only. Rows of one
    doc_id stand in the order of their texts; rows without doc_id come first. Further columns are
    not read. In a table of one row, the row is its own successor; an empty table gives no rows.
    """
    sorted_, first = neighbours(spark, docs, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple], after: str) -> pa.RecordBatch:
            own, other, edits = digest([r[2] for r in rows] + [after])
            here = [k for k, r in enumerate(rows) if not r[3]]
            near = likeness(own[:-1], other), likeness(own[:-1], own[1:])
            sha = [hashlib.sha256(edits[k].encode("utf-8", "surrogatepass")).hexdigest() for k in here]
            cols = ([rows[k][1] for k in here], [len(rows[k][2]) for k in here], sha, [own[k].astype(">u2").tobytes().hex() for k in here], [other[k].astype(">u2").tobytes().hex() for k in here], near[0][here], near[1][here])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=names)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0]:  # the range is over; its last row is a guest, or the last of all
                    yield emit(held, first)
                    held, size = [], 0
                elif size > 2_000_000:
                    yield emit(held, row[2])
                    held, size = [], 0
                if not (row[3] and held and held[-1][3]):  # one guest is enough
                    held.append(row)
                    size += len(row[2])
        if held:
            yield emit(held, first)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted_.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
