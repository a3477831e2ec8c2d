"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets.

A document's set holds the 64-bit hashes of its distinct word shingles. Its signature holds
SYMBOLS minima, of which 16 bits each are kept. For two sets of similarity 0.75 the number of
differing symbols is binomial with mean SYMBOLS/4; ERRORS lies more than four standard
deviations above it. The join finds every pair of signatures within ERRORS: cut into CHUNKS
chunks, two such signatures have a chunk with at most ERRORS // CHUNKS = 1 differing symbol,
so one key for each way to leave a symbol of a chunk out meets them in some key.

1. Equal sets are one class, named by its least doc_id; from here on only classes are searched.
2. Keys with the same members are kept once (their counts, least members and checksums agree). In each
   key a forest of the pairs within ERRORS is kept, never all pairs. Very large keys are kept as
   a star, which can only widen the search.
3. Connected candidates are a cluster. Only clusters read their texts again; in each, pairs are
   confirmed on full sets, nearest first, and pairs that are connected already are passed over.
   A cluster over BLOCK classes is compared block with block, so memory stays bounded.
4. Confirmed links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.graph import components

SYMBOLS, CHUNKS, ERRORS = 64, 16, 30
#: Classes that a task compares at once at most: about 2 * BLOCK sets lie in its memory.
BLOCK = 2048
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def shingles(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the sorted distinct shingles of row i are hashes[bounds[i]:bounds[i + 1]]."""
    data, off = K.buffers(col)
    data = K.ascii_lower(data)
    starts, ends, row = K.words(data, off)
    h = K.substring_hash(K.prefix(data), starts, ends)
    n = np.bincount(row, minlength=len(col))
    first = np.cumsum(n) - n
    if len(h) >= width:
        roll = K.combine([h[k : len(h) - width + 1 + k] for k in range(width)])
        whole = row[: len(roll)] == row[width - 1 :]
        group, value = row[: len(roll)][whole], roll[whole]
    else:
        group, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        own = np.array([K.combine([h[i : i + 1] for i in range(first[r], first[r] + n[r])])[0] ^ np.uint64(n[r]) for r in short], np.uint64)
        group, value = np.concatenate((group, short)), np.concatenate((value, own))
        order = np.argsort(group, kind="stable")
        group, value = group[order], value[order]
    group, value = K.sorted_unique(group, value)
    return np.searchsorted(group, np.arange(len(col) + 1)), value


def set_hash(bounds: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set, which together name it."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        c = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(K.mix(value ^ np.uint64(salt)), out=c[1:])
        out.append((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(bounds: np.ndarray, value: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols for each set; zeros for an empty one."""
    out = np.zeros((len(bounds) - 1, SYMBOLS), np.uint16)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        at = bounds[:-1][full]
        for k in range(SYMBOLS):
            out[full, k] = (K.mix(np.minimum.reduceat(value * _A[k] + _B[k], at)) >> np.uint64(48)).astype(np.uint16)
    return out


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (the set's name) and sig of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                bounds, value = shingles(K.column(part, "text"), width)
                h1, h2 = set_hash(bounds, value)
                sig = signatures(bounds, value)
                blob = K.binaries(sig.reshape(-1), np.arange(len(sig) + 1) * SYMBOLS)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2), blob], names=["doc_id", "n", "h1", "h2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each chunk and each symbol of it that may differ: the other symbols, and which they are."""
    each = SYMBOLS // CHUNKS
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            part = batch.slice(lo, 20_000)
            sig = _matrix(part.column("sig")).astype(np.int64)
            cls = np.asarray(part.column("cls"))
            for c in range(CHUNKS):
                for j in range(each):
                    key = np.full(len(sig), c * each + j, np.int64)
                    for k in range(each):
                        if k != j:
                            key = key << 16 | sig[:, c * each + k]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls)], names=["key", "cls"])


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _pairs_within(sig: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All i < j whose signatures differ in at most `errors` symbols, with that number."""
    out = []
    step = max(1, 4_000_000 // (len(sig) * SYMBOLS))
    for lo in range(0, len(sig), step):
        diff = (sig[lo : lo + step, None, :] != sig[None, lo:, :]).sum(2, dtype=np.uint8)
        i, j = np.nonzero(diff <= errors)
        keep = j > i
        i, j = i[keep], j[keep]
        out.append((i + lo, j + lo, diff[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, cls, sig) sorted by key: the edges of a forest of the pairs within ERRORS."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        key, cls = np.asarray(table["key"].combine_chunks()), np.asarray(table["cls"].combine_chunks())
        sig = _matrix(table["sig"].combine_chunks())
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size, us, vs = np.diff(cuts), [], []
        two = cuts[:-1][size == 2]
        near = (sig[two] != sig[two + 1]).sum(1) <= ERRORS
        us.append(cls[two[near]])
        vs.append(cls[two[near] + 1])
        for k in np.flatnonzero(size > 2).tolist():
            lo, hi = cuts[k], cuts[k + 1]
            i, j, d = _pairs_within(sig[lo:hi], ERRORS)
            order = np.argsort(d, kind="stable")
            parent = np.arange(hi - lo)
            for a, b in zip(i[order].tolist(), j[order].tolist()):
                ra, rb = _find(parent, a), _find(parent, b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
            root = np.array([_find(parent, x) for x in range(hi - lo)])
            own = np.flatnonzero(root != np.arange(hi - lo))
            us.append(cls[lo + own])
            vs.append(cls[lo + root[own]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    for table in _runs(batches, ["key"]):
        yield emit(table)


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows: at least `least` rows, if there are so many."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            cols = [np.asarray(table[c].combine_chunks()) for c in by]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
            if len(change):
                at = int(change[-1]) + 1
                yield table.slice(0, at).combine_chunks()
                held = table.slice(at).to_batches()
                rows = table.num_rows - at
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _confirm(percent: int):
    """For rows (cluster, i, j, cls, sig, set) sorted by group: links within each group, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["cluster", "i", "j"], 512):
            cols = [np.asarray(table[c].combine_chunks()) for c in ("cluster", "i", "j")]
            cls = np.asarray(table["cls"].combine_chunks())
            change = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            cuts = np.flatnonzero(np.concatenate(([True], change, [True])))
            sig = _matrix(table["sig"].combine_chunks())
            sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
            us, vs = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ids, first = np.unique(cls[lo:hi], return_index=True)
                first = first + lo
                i, j, d = _pairs_within(sig[first], ERRORS)
                order = np.argsort(d, kind="stable")
                i, j = i[order], j[order]
                label = np.arange(len(ids))
                step = 64
                while len(i):
                    for a, b in zip(i[:step].tolist(), j[:step].tolist()):
                        if label[a] != label[b]:
                            x, y = sets[first[a]], sets[first[b]]
                            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                                if 100 * both >= percent * (len(x) + len(y) - both):
                                    low, high = sorted((label[a], label[b]))
                                    label[label == high] = low
                    i, j = i[step:], j[step:]
                    open_ = label[i] != label[j]
                    i, j, step = i[open_], j[open_], min(4096, 2 * step)
                own = np.flatnonzero(label != np.arange(len(ids)))
                us.append(ids[own])
                vs.append(ids[label[own]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _sets(width: int):
    """The full sets of rows (cls, cluster, h1, h2, sig, text) whose text is the class's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                bounds, value = shingles(K.column(part, "text"), width)
                h1, h2 = set_hash(bounds, value)
                own = pa.array((h1 == np.asarray(part.column("h1"))) & (h2 == np.asarray(part.column("h2"))))
                cols = [part.column(c) for c in ("cls", "cluster", "size", "sig")]
                yield pa.RecordBatch.from_arrays([*cols, K.binaries(value, bounds)], names=["cls", "cluster", "size", "sig", "set"]).filter(own)

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document (further columns are not read).

    Null and empty texts, and texts without words, have the empty set and are linked with
    nothing. Rows of one doc_id are told apart by their texts. Repeated rows stay, each with the
    same component. A null doc_id can name no component: its row is linked with nothing, has a null component_id and is
    kept. An empty table gives no rows.
    """
    table = K.stored(spark, described(docs, width), "described")
    with_set = table.filter("n > 0 and doc_id is not null")
    classes = with_set.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    classes = K.stored(spark, classes.withColumn("cls", F.xxhash64("h1", "h2")), "classes")
    links = K.settled(spark, lambda: _links(spark, docs, classes, width, percent), "links")
    parts = K.settled(spark, lambda: components(spark, links), "parts")
    linked = parts.join(classes.select(F.col("cls").alias("node"), "h1", "h2", "doc_id"), "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = linked.join(least, "component").select("h1", "h2", "least")
    own = classes.select("h1", "h2", F.col("doc_id").alias("own")).join(named, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("least", "own").alias("component_id"))
    full = with_set.select("doc_id", "n", "h1", "h2").join(own, ["h1", "h2"]).select("doc_id", "n", "component_id")
    rest = table.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = full.union(rest).withColumnRenamed("n", "n_shingles")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(spark: SparkSession, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): confirmed links that join each component of classes (cls, doc_id, h1, h2, sig).

    Joins that grow with the corpus are sort-merge ones at every size.
    """
    keys = classes.select("cls", "sig").mapInArrow(_keys, "key long, cls long")
    groups = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("cls").alias("lo"), F.sum(F.shiftright("cls", 8)).alias("s")).filter("c > 1")
    groups = K.stored(spark, groups.groupBy("c", "lo", "s").agg(F.min("key").alias("key")), "groups")
    maybe = K.sieve(groups, "key")
    member = keys.filter(maybe("key")).join(groups.select("key", "c", "lo").hint("merge"), "key")
    star = member.filter(F.col("c") > 2 * BLOCK).filter("cls <> lo").select(F.col("cls").alias("u"), F.col("lo").alias("v"))
    small = member.filter(F.col("c") <= 2 * BLOCK).select("key", "cls").join(classes.select("cls", "sig").hint("merge"), "cls").select("key", "cls", "sig")
    forest = small.repartition("key").sortWithinPartitions("key").mapInArrow(_forest, "u long, v long")
    clusters = components(spark, star.union(forest)).withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    found = K.stored(spark, clusters.withColumnRenamed("node", "cls").join(classes, "cls").join(sizes, "cluster"), "clustered")
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.coalesce(K.sieve(found, "doc_id")(F.col("doc_id").cast("long")), F.lit(False)))
    texts = asked.join(found.hint("merge"), "doc_id").select("cls", "cluster", "size", "h1", "h2", "sig", "text")
    dealt = texts.mapInArrow(_sets(width), "cls long, cluster long, size long, sig binary, set binary")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "sig", "set")
    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_confirm(percent), "u long, v long")
