"""Whitening of embeddings from exact moments: a digit-slice product of integers.

Entries become integers. With n distinct vectors of per-dimension sums S, n x - S is an integer
vector centred without rounding. Its digits to base 2**DIGIT are small limbs: a product of two limb
matrices over a block of rows stays below 2**53, so BLAS computes it in float64 without error. The
products of all pairs of limbs of equal weight are added up as integers in each task, then by a
grouped sum, and the driver recombines the d * d sums of each weight as big integers: n**3 times the
covariance, exactly. Only then are there rounded numbers: each entry is rounded once and the matrix
decomposed in double precision.

Tasks return sums of d * d entries a weight, however many rows they read, and no vector leaves the
executors but to meet its copies (pre-aggregated) in the fit list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K

#: Bits of a limb and rows of a block: 2**(2 * 20) * 2**12 is within 2**52.
DIGIT, BLOCK = 20, 1 << 12
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this (64 * c would leave the longs) count as this.
FAR = 2.0**56


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with x, the integers floor(64 * c) + 1000000 of each entry c, for the rows that have them.

    Rows whose vector is null or empty or holds a null, NaN or infinite entry are left out.
    """
    c = F.col(column)
    fine = F.coalesce(F.size(c) > 0, F.lit(False)) & F.coalesce(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf")))), F.lit(False))
    bound = lambda e: F.least(F.greatest(e.cast("double"), F.lit(-FAR)), F.lit(FAR))
    whole = F.transform(c, lambda e: F.floor(bound(e) * SCALE).cast("long") + F.lit(OFFSET))
    return vectors.filter(fine).withColumn("x", whole)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int], bits: int) -> np.ndarray:
    """n x - S, as longs if they hold it, else as Python's integers."""
    kind = np.int64 if bits < 62 else object
    middle = [s // n for s in sums]
    if kind is object:
        return (x.astype(object) - np.array(middle, object)) * n - np.array([s - n * m for s, m in zip(sums, middle)], object)
    return (x - np.array(middle, np.int64)) * np.int64(n) - np.array([s - n * m for s, m in zip(sums, middle)], np.int64)


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """Digits of y to base 2**DIGIT, least first, as float64; the last one carries the sign."""
    out = []
    for k in range(count):
        digit = y >> (DIGIT * k) if k == count - 1 else (y >> (DIGIT * k)) & ((1 << DIGIT) - 1)
        out.append(digit.astype(np.float64))
    return out


def products(y: np.ndarray, count: int) -> list[np.ndarray]:
    """For each weight w, the sum over pairs of limbs i + j = w of their products' matrices; exact longs."""
    d = y.shape[1]
    out = [np.zeros((d, d), np.int64) for _ in range(2 * count - 1)]
    for at in range(0, len(y), BLOCK):
        part = limbs(y[at : at + BLOCK], count)
        for i in range(count):
            for j in range(i, count):
                product = (part[i].T @ part[j]).astype(np.int64)
                out[i + j] += product if i == j else product + product.T
    return out


class Model:
    """n, the sums S, and the components: unit vectors (as columns), eigenvalues, shares of the trace."""

    def __init__(self, n: int, sums: list[int], moments: list[list[int]], components: int):
        d = len(sums)
        self.n, self.sums, self.bits = n, sums, 0
        cube = n**3  # a quotient of two integers is rounded once
        v = np.array([[moments[min(i, j)][max(i, j)] / cube for j in range(d)] for i in range(d)])
        values, vectors = np.linalg.eigh(v)
        keep = np.arange(d)[::-1][:components]
        self.vectors, trace = vectors[:, keep], sum(moments[i][i] for i in range(d)) / cube
        least = values[-1] * d * np.finfo(float).eps
        self.values = np.where(values[keep] > least, values[keep], 0.0)
        self.explained = self.values / trace if trace else np.zeros(len(keep))

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """The components of n x - S over n and the eigenvalues' roots; NaN where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values), np.nan)


def _moments(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """n, S and the bits that n x - S can take; a task adds up the halves of its longs apart."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts = 0, [np.zeros(d, np.int64), np.zeros(d, np.int64), np.full(d, 2**63 - 1, np.int64), np.full(d, -(2**63), np.int64)]
        for batch in batches:
            x = _matrix(batch.column(0))
            rows += len(x)
            parts = [parts[0] + (x >> 32).sum(0), parts[1] + (x & (2**32 - 1)).sum(0), np.minimum(parts[2], x.min(0, initial=2**63 - 1)), np.maximum(parts[3], x.max(0, initial=-(2**63)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, rows), pa.int64()), *(pa.array(p, pa.int64()) for p in parts)], names=["i", "n", "high", "low", "a", "b"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    seen = fit.select("x").mapInArrow(partial, "i int, n long, high long, low long, a long, b long")
    rows = seen.groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.min("a").alias("a"), F.max("b").alias("b")).orderBy("i").collect()  # one for each dimension
    n, span = rows[0]["n"], max(int(r["b"]) - int(r["a"]) + 1 for r in rows)
    return n, [(int(r["high"]) << 32) + int(r["low"]) for r in rows], (n * span).bit_length() + 1


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a list of distinct x vectors of one dimension; None if it is empty."""
    d = fit.select(F.max(F.size("x"))).first()[0]
    if not d:
        return None
    n, sums, bits = _moments(fit, d)
    count = bits // DIGIT + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        rows = 0
        i, j = np.triu_indices(d)

        def emit() -> Iterator[pa.RecordBatch]:
            for w, m in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), w), pa.int32()), pa.array(m[i, j], pa.int64())], names=["i", "j", "w", "v"])

        for batch in batches:
            got = products(_centred(_matrix(batch.column(0)), n, sums, bits), count)
            held = got if held is None else [a + b for a, b in zip(held, got)]
            rows += batch.num_rows
            if rows >= 1 << 18:  # 2**18 rows of 2 * count products of 2**40: within a long
                yield from emit()
                held, rows = None, 0
        if held is not None:
            yield from emit()

    parts = fit.select("x").mapInArrow(partial, "i int, j int, w int, v long")
    moments = [[0] * d for _ in range(d)]
    for r in parts.groupBy("i", "j", "w").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toLocalIterator():
        moments[r["i"]][r["j"]] += int(r["v"]) << (DIGIT * r["w"])
    model = Model(n, sums, moments, components)
    model.bits = bits
    return model


def identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest entry of the whitened fit list's covariance less the identity; None without variance.

    Whitened values are centred on their own means (a first pass) before they are multiplied.
    """
    k = int((model.values > 0).sum())
    if not k:
        return None

    def tally(centre: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k) if centre is None else np.zeros((k, k))
            for batch in batches:
                w = model.whitened(_centred(_matrix(batch.column(0)), model.n, model.sums, model.bits))[:, :k]
                total = total + (w.sum(0) if centre is None else (w - centre).T @ (w - centre))
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["i", "v"])

        rows = fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(k if centre is None else k * k)
        for r in rows:
            out[r["i"]] = r["v"]
        return out / model.n

    covariance = tally(tally(None)).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(spark: SparkSession, vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row of vectors and component: key, component, n, deviation,
    whitened, explained, identity_error (see fitted and identity_error).

    Rows whose vector is null, empty or holds a null or non-finite entry are left out; so are, where
    vectors differ in dimension, those of another dimension than most (the larger one of ties).
    Entries beyond 2**56 count as 2**56. There are as many components as dimensions, 16 at most; a
    component without variance (one distinct vector, equal entries throughout) has whitened null and
    explained 0. deviation is null where it leaves the longs. Ties of eigenvalues come in any order,
    the same for all rows. Repeated rows and null keys stay; further columns are not read. Without
    any vector there are no rows.
    """
    ready = integers(vectors.select(F.col(key).alias("key"), F.col(column).alias("embedding"))).select("key", "x")
    sizes = ready.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    ready = ready.filter(F.size("x") == d)
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with K.passing(spark):
        fit = K.stored(spark, ready.select("x").distinct(), "whitening")
        model = fitted(fit, components)
        error = identity_error(fit, model) if model else None
    if model is None:
        return spark.createDataFrame([], schema)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                m = batch.num_rows
                y = _centred(_matrix(batch.column(1)), model.n, model.sums, model.bits)
                wide = 2 * model.bits + math.ceil(math.log2(y.shape[1] + 1)) > 62
                square = [v if v < 2**63 else None for v in (y.astype(object) ** 2).sum(1)] if wide else (y**2).sum(1)
                rows = np.repeat(np.arange(m), k)
                columns = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()),
                    pa.array(square, pa.int64()).take(pa.array(rows)),
                    pa.array(model.whitened(y).ravel(), pa.float64(), from_pandas=True),
                    pa.array(np.tile(model.explained, m), pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return ready.mapInArrow(run, schema)
