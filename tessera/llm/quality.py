"""Text quality by a factorisation machine over hashed words and structure statistics.

A text's features are its words (hashed into BUCKETS; each occurrence weighs 1/n of n words)
and its statistics: shares of kinds of characters, lengths, repetition, lines, each cut at the
quantiles of the training sample into BINS one-hot features. Metadata columns that the caller
names are cut in the same way: numbers as they are, anything else by a hash.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all
pairwise interactions at a cost linear in the number of features.

The model is fitted on a bounded sample and scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.toxicity import sampled

BUCKETS, BINS, RANK = 1 << 13, 10, 6
STATS = ("bytes", "words", "lines", "upper", "digit", "punctuation", "symbol", "space", "non_ascii", "word_length", "long_words", "distinct", "repeated", "short_lines", "stops", "spread")


def described(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every word and the matrix of statistics, a column for each of STATS."""
    data, off = K.buffers(col)
    n, size = len(col), np.diff(off).astype(float)
    row_of = lambda at: np.searchsorted(off, at, "right") - 1

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row_of(np.flatnonzero(mask)), minlength=n) / np.maximum(size, 1)

    low = K.ascii_lower(data)
    starts, ends, row = K.words(data, off)
    h = K.substring_hash(K.prefix(low), starts, ends)
    words = np.bincount(row, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, n) / some
    group, _ = K.sorted_unique(row, h)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    begins, stops = K.spans_of(data != 10, off)
    line_row = row_of(begins)
    lines = np.bincount(line_row, minlength=n).astype(float)
    punctuation = np.isin(data, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    symbol = np.isin(data, np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8))
    end_stop = punctuation[stops - 1] if len(stops) else np.zeros(0, bool)
    table = (
        np.log1p(size), np.log1p(words), np.log1p(lines), share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(punctuation), share(symbol),
        share((data == 32) | (data == 10)), share(data >= 128), mean, np.bincount(row, length > 12, n) / some, np.bincount(group, minlength=n) / some, np.bincount(row, same, n) / some,
        np.bincount(line_row, stops - begins < 30, n) / np.maximum(lines, 1), np.bincount(line_row, end_stop, n) / np.maximum(lines, 1), np.sqrt(np.maximum(np.bincount(row, length**2, n) / some - mean**2, 0)),
    )
    return row, (h >> np.uint64(51)).astype(np.int64), np.stack(table, 1) if n else np.zeros((0, len(STATS)))


def _side(metadata: tuple[str, ...], docs: DataFrame) -> dict[str, Column]:
    """Metadata columns as numbers, by names that docs does not have; null is -1."""
    base = "side_"
    while any(c.lower().startswith(base) for c in docs.columns):
        base += "_"
    kinds = dict(docs.dtypes)
    numeric = lambda c: kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")
    hashed = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 20)) / (1 << 20)
    value = lambda c: F.coalesce(F.col(c).cast("double") if numeric(c) else F.when(F.col(c).isNotNull(), hashed(c)), F.lit(-1.0))
    return {f"{base}{k}": value(c) for k, c in enumerate(metadata)}


@dataclass(frozen=True)
class Model:
    """cuts: a row of bin edges for each statistic and metadata column; w0, w (linear) and v (factors) by feature."""

    cuts: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """For each row, the feature numbers of its statistics' bins; they follow the words' buckets."""
        out = np.empty(stats.shape, np.int64)
        for k in range(stats.shape[1]):
            out[:, k] = BUCKETS + k * BINS + np.searchsorted(self.cuts[k], stats[:, k], "right")
        return out

    def __call__(self, col: pa.Array, side: np.ndarray | None = None) -> np.ndarray:
        row, bucket, stats = described(col)
        stats = stats if side is None else np.concatenate((stats, side), 1)
        z, _ = self.parts(row, bucket, self.features(stats), len(col))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def parts(self, row: np.ndarray, bucket: np.ndarray, bins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = 1 / np.maximum(np.bincount(row, minlength=n), 1)
        total = np.empty((n, self.v.shape[1]))
        squares = (self.v**2).sum(1)
        alone = np.bincount(row, squares[bucket], n) * x * x + squares[bins].sum(1)
        for f in range(self.v.shape[1]):
            total[:, f] = np.bincount(row, self.v[bucket, f], n) * x + self.v[bins, f].sum(1)
        z = self.w0 + np.bincount(row, self.w[bucket], n) * x + self.w[bins].sum(1) + 0.5 * ((total**2).sum(1) - alone)
        return z, total


def _sample(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """described() of many texts, a slice at a time to bound the memory."""
    out, base = [described(texts[:0])], 0
    for part in K.pieces_of(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20):
        row, bucket, stats = described(part.column(0))
        out.append(((row + base).astype(np.int32), bucket.astype(np.int32), stats))
        base += part.num_rows
    row, bucket, stats = (np.concatenate(x) for x in zip(*out))
    return row.astype(np.int32), bucket.astype(np.int32), stats


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, side: np.ndarray | None = None, epochs: int = 30, batch: int = 256, rate: float = 0.03, ridge: float = 2e-4, seed: int = 5) -> Model:
    """Adagrad over shuffled mini-batches of the sample; the factors' gradients use the same sums as the score."""
    rng = np.random.default_rng(seed)
    row, bucket, stats = _sample(texts)
    stats = stats if side is None else np.concatenate((stats, side), 1)
    n, d = len(texts), BUCKETS + BINS * stats.shape[1]
    cuts = np.stack([np.quantile(stats[:, k], np.arange(1, BINS) / BINS) if n else np.zeros(BINS - 1) for k in range(stats.shape[1])])
    prior = np.clip((weight @ y / weight.sum()) if n else 0.5, 0.01, 0.99)
    model = Model(cuts, float(np.log(prior / (1 - prior))), np.zeros(d), rng.normal(0, 0.05, (d, RANK)))
    bins, bounds = model.features(stats), np.searchsorted(row, np.arange(n + 1))
    weight = weight / max(weight.mean(), 1e-9) if n else weight
    gw, gv, g0, w0 = np.full(d, 1e-2), np.full((d, RANK), 1e-2), 1e-2, model.w0
    steps = -(-n // batch) or 1
    for _ in range(min(300, max(epochs, 800 // steps))):  # small samples are gone through more often
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            own = order[lo : lo + batch]
            m = len(own)
            size = bounds[own + 1] - bounds[own]
            at = np.repeat(bounds[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            r, b = np.repeat(np.arange(m), size), bucket[at]
            now = Model(cuts, w0, model.w, model.v)
            z, total = now.parts(r, b, bins[own], m)
            e = weight[own] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / m
            x = 1 / np.maximum(size, 1)
            full, ex = bins[own].reshape(-1), (e * x)[r]
            ebin, rb = np.repeat(e, bins.shape[1]), np.repeat(np.arange(m), bins.shape[1])
            dw = np.bincount(b, ex, d) + np.bincount(full, ebin, d)
            self2 = np.bincount(b, (e * x * x)[r], d) + np.bincount(full, ebin, d)
            touched = np.flatnonzero(self2)
            dw = dw[touched] + ridge * model.w[touched]
            gw[touched] += dw**2
            model.w[touched] -= rate * dw / np.sqrt(gw[touched])
            dv = np.stack([np.bincount(b, ex * total[r, f], d) + np.bincount(full, ebin * total[rb, f], d) for f in range(RANK)], 1)[touched]
            dv = dv - model.v[touched] * self2[touched, None] + ridge * model.v[touched]
            gv[touched] += dv**2
            model.v[touched] -= rate * dv / np.sqrt(gv[touched])
            g0 += e.sum() ** 2
            w0 -= rate * e.sum() / np.sqrt(g0)
    return Model(cuts, float(w0), model.w, model.v)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 2000, metadata: tuple[str, ...] = ()) -> Model:
    """Learns from at most `rows` texts of each class; labels holds the rows to learn from only."""
    more = _side(metadata, docs)
    return train(*sampled(docs.select("doc_id", "text", *(c.alias(n) for n, c in more.items())), labels, label, rows, tuple(more)))


def _scores(model: Model, part: pa.RecordBatch, more: tuple[str, ...]) -> np.ndarray:
    side = np.stack([np.asarray(part.column(part.schema.get_field_index(n)), float) for n in more], 1) if more else None
    return model(K.column(part, "text"), side)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3, rows: int = 2000, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Labels are read only for rows whose crc32(doc_id as text) mod `folds` is not `held`; of each
    class at most `rows` of them train the model. Null and empty texts get the score of a text
    without words; null metadata is a value of its own; a null doc_id is not held out; repeated
    rows are scored each; without labels every score is near one half; an empty table gives no
    rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model, more = fit(docs, labels.filter(fold != held), "quality", rows, metadata), _side(metadata, docs)
    names = tuple(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(model, part, names), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(n) for n, c in more.items())).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3, rows: int = 2000, metadata: tuple[str, ...] = ()) -> DataFrame:
    """The rows of docs, all columns, that are not rejected; each row is judged by itself."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model, more = fit(docs, labels.filter(fold != held), "quality", rows, metadata), _side(metadata, docs)
    columns, names = docs.columns, tuple(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                yield part.select(columns).filter(pa.array(_scores(model, part, names) >= cut))

    return docs.select("*", *(c.alias(n) for n, c in more.items())).mapInArrow(run, docs.schema)
