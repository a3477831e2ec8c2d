"""Line dedup by a deletion-neighbourhood join: a line goes if an earlier one lies within one edit.

Lines are compared without outer white space and with A-Z lower-cased; lines of fewer than
LEAST characters then are compared for equality only, and only down to the length `shortest`
that the caller names (none without it; blank lines never). Documents stand in the order of doc_id, lines in that of
the text. A line is removed if an equal line, or one at edit distance 1 (a character inserted,
deleted or substituted), stands earlier in the corpus; what comes earlier is judged on the
input, not on what is left.

1. Every line's hash and place, written once. Equal lines are one class with its first place.
2. Two lines at distance 1 share their first or last h characters, h half the shorter length.
   Classes none of whose halves stands in another class are done; most lines are.
3. What is left meets by its shared half. There each line emits its deletion variants as hashed
   keys, of the other half only: with the place left out (equal keys: a substitution there) and
   without (equal to a whole shorter line: an insertion or deletion). Equal keys are joined to
   the earliest line of the key, and the edit distance is verified. Halves that very many lines
   share emit their variants into a shuffle instead of one task.
4. The earliest neighbour of a class decides over each of its occurrences. Documents that lose
   no line pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.neardup import _runs

LEAST = 20
#: Characters of lines with a common half that one task compares; more go by a shuffle of their variants.
GROUP = 2_000_000


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """All lines of a batch: row, number in the row, start, end, and start and end without outer white space."""
    n = len(off) - 1
    at = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((off[:-1], at + 1)))
    row = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(at, off)))
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    ends = np.where(last, off[row + 1], np.append(starts[1:], 0) - 1)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    solid = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = j > i
    if len(solid):
        a = np.where(some, solid[np.minimum(i, len(solid) - 1)], starts)
        b = np.where(some, solid[np.maximum(j - 1, 0)] + 1, starts)
    else:
        a = b = starts
    return row, number, starts, ends, a, b


class Lines:
    """The lines of a batch of `shortest` characters or more with their hashes."""

    def __init__(self, col: pa.Array, shortest: int):
        data, off = K.buffers(col)
        self.low = K.ascii_lower(data)
        row, number, _, _, a, b = split(data, off)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        ca, cb = np.searchsorted(lead, a), np.searchsorted(lead, b)  # in characters
        use = cb - ca >= max(1, shortest)
        self.row, self.number, self.a, self.b, ca, cb = (x[use] for x in (row, number, a, b, ca, cb))
        self.n = cb - ca
        self.h = K.prefix(self.low)
        self.h1 = K.substring_hash(self.h, self.a, self.b)
        self.h2 = K.mix(self.h1 * np.uint64(3) + K.substring_hash(self.h, lead[ca + self.n // 3], self.b))
        keys = []
        for half in (self.n // 2, (self.n - 1) // 2):
            keys.append(K.substring_hash(self.h, self.a, lead[ca + half]) ^ np.uint64(1))
            keys.append(K.substring_hash(self.h, lead[cb - half], self.b) ^ np.uint64(2))
        self.keys = np.stack(keys, 1) if len(self.n) else np.zeros((0, 4), np.uint64)


def described(docs: DataFrame, least: int, shortest: int) -> DataFrame:
    """A row for each comparable line: doc_id, line, size (characters), h1, h2 and keys (of its halves; none under `least` characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                own = Lines(K.column(part, "text"), shortest)
                ids = part.column(0).take(pa.array(own.row))
                odd = own.n % 2 == 1  # both halves have the same length
                flat = own.keys.view(np.int64).reshape(-1)
                near = own.n >= least
                count = np.where(near, np.where(odd, 2, 4), 0)
                off = np.concatenate(([0], np.cumsum(count)))
                pick = np.ones((len(odd), 4), bool)
                pick[odd, 2:] = False
                pick[~near] = False
                keys = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat[pick.reshape(-1)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.number, pa.int32()), pa.array(own.n, pa.int32()), pa.array(own.h1.view(np.int64)), pa.array(own.h2.view(np.int64)), keys], names=["doc_id", "line", "size", "h1", "h2", "keys"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line int, size int, h1 long, h2 long, keys array<long>")


def within_one(x: str, y: str) -> bool:
    """Whether one edit at most leads from x to y."""
    if abs(len(x) - len(y)) > 1:
        return False
    i, m = 0, min(len(x), len(y))
    while i < m and x[i] == y[i]:
        i += 1
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def variants(text: str, head: bool) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """(keys with the place left out, keys without it, key of the whole) of the half that is not shared."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    up, down = K.powers(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(K.mix(codes + np.uint64(1)) * up[:n], out=h[1:])
    places = np.arange((n - 1) // 2, n) if head else np.arange(0, n - (n - 1) // 2)
    left_out = h[places] + (h[n] - h[places + 1]) * down[1]
    without = K.mix(left_out + np.uint64(n - 1))
    return K.mix(without ^ (places.astype(np.uint64) << np.uint64(32) | np.uint64(n))), without, K.mix(h[n] + np.uint64(n))


def _joined(texts: list[str], heads: np.ndarray, doc: np.ndarray, line: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier) numbers of lines within one edit, each line with the earliest of each key."""
    keys, owner, kind = [], [], []
    for k, (text, head) in enumerate(zip(texts, heads.tolist())):
        swap, cut, whole = variants(text, head)
        salt = np.uint64(group[k])
        keys += [swap ^ salt, cut + salt, np.array([whole]) + salt]
        owner.append(np.full(len(swap) + len(cut) + 1, k))
        kind.append(np.repeat(np.array([0, 1, 2], np.int8), [len(swap), len(cut), 1]))
    key, own, kind = np.concatenate(keys), np.concatenate(owner), np.concatenate(kind)
    order = np.lexsort((line[own], doc[own], key))
    key, own, kind = key[order], own[order], kind[order]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    out = []
    for mine, other in ((0, 0), (1, 2), (2, 1)):  # the earliest line with a key of the other kind
        at = np.flatnonzero(kind == other)
        first = np.full(len(cuts) - 1, -1)
        first[run[at[::-1]]] = own[at[::-1]]
        me = np.flatnonzero(kind == mine)
        them = first[run[me]]
        ok = (them >= 0) & (them != own[me])
        out.append(np.stack((own[me[ok]], them[ok]), 1))
    pairs = np.unique(np.concatenate(out), axis=0)
    later = (doc[pairs[:, 1]] < doc[pairs[:, 0]]) | ((doc[pairs[:, 1]] == doc[pairs[:, 0]]) & (line[pairs[:, 1]] < line[pairs[:, 0]]))
    pairs = pairs[later]
    ok = np.fromiter((within_one(texts[a], texts[b]) for a, b in pairs.tolist()), bool, len(pairs))
    return pairs[ok, 0], pairs[ok, 1]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, head, doc_id, line, text) sorted by key: each line's earliest neighbour in its group.

    Groups are compared together until they hold GROUP characters, the bound of a single one.
    """
    for table in _runs(batches, ["key"], 2048):
        key = np.asarray(table["key"].combine_chunks()).view(np.uint64)
        whole = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True]))) + 1
        size = np.cumsum(pc.utf8_length(table["text"].combine_chunks()).to_numpy(zero_copy_only=False))[whole - 1]
        lo = 0
        while lo < len(key):
            base = size[np.searchsorted(whole, lo)] if lo else 0
            hi = int(whole[max(np.searchsorted(whole, lo, "right"), int(np.searchsorted(size, base + GROUP, "right")) - 1)])
            part = table.slice(lo, hi - lo)
            doc, line = np.asarray(part["doc_id"].combine_chunks()), np.asarray(part["line"].combine_chunks()).astype(np.int64)
            heads = np.asarray(part["head"].combine_chunks().cast(pa.int8())).astype(bool)
            a, b = _joined(part["text"].to_pylist(), heads, doc, line, key[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(line[a], pa.int32()), pa.array(doc[b]), pa.array(line[b], pa.int32())], names=["doc_id", "line", "by_doc", "by_line"])
            lo = hi


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The variants of lines of very common halves as rows: code (the hashed key), kind, doc_id, line."""
    for batch in batches:
        for k, (text, head, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "head", "key")))):
            swap, cut, whole = variants(text, head)
            salt = np.array([key]).view(np.uint64)[0]
            codes = np.concatenate((swap ^ salt, cut + salt, np.array([whole]) + salt))
            kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(swap), len(cut), 1])
            at = pa.array(np.full(len(codes), k))
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(kinds), *(batch.column(c).take(at) for c in ("doc_id", "line"))], names=["code", "kind", "doc_id", "line"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = pa.array([within_one(x, y) for x, y in zip(batch.column("text").to_pylist(), batch.column("by_text").to_pylist())], pa.bool_())
        yield batch.select(["doc_id", "line", "by_doc", "by_line"]).filter(ok)


def _by_shuffle(common: DataFrame) -> DataFrame:
    """The same join on rows of hashes, for halves shared by more text than one task takes; the texts follow for what is left."""
    rows = common.mapInArrow(_emitted, "code long, kind int, doc_id long, line int")
    first = rows.groupBy("code", "kind").agg(F.min(F.struct("doc_id", "line")).alias("by"))
    meets = F.when(F.col("kind") == 0, 0).otherwise(3 - F.col("kind"))
    pairs = rows.join(first.select("code", meets.alias("kind"), "by"), ["code", "kind"]).filter("by < struct(doc_id, line)")
    pairs = pairs.select("doc_id", "line", F.col("by.doc_id").alias("by_doc"), F.col("by.line").alias("by_line")).distinct()
    texts = common.groupBy("doc_id", "line").agg(F.first("text").alias("text"))
    by = texts.select(F.col("doc_id").alias("by_doc"), F.col("line").alias("by_line"), F.col("text").alias("by_text"))
    return pairs.join(texts, ["doc_id", "line"]).join(by, ["by_doc", "by_line"]).select("doc_id", "line", "by_doc", "by_line", "text", "by_text").mapInArrow(_verified, "doc_id long, line int, by_doc long, by_line int")


def dropped(spark: SparkSession, docs: DataFrame, least: int = LEAST, group: int = GROUP, shortest: int | None = None) -> DataFrame:
    """(doc_id, lines): for each document that loses lines, their numbers in order.

    Joins are sort-merge ones at every size, so that small corpora cost what large ones do.
    """
    table = K.stored(spark, described(docs, least, least if shortest is None else min(least, shortest)), "lines")
    place = F.struct("doc_id", "line")
    classes = table.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = K.stored(spark, classes, "line_classes")
    halves = classes.select(F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"), "size", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("many"), F.sum("size").alias("total")).filter("many > 1").select("key", (F.col("total") > group).alias("common"))
    shared = K.stored(spark, shared, "shared_halves")
    halves = halves.filter(K.sieve(shared, "key")("key"))
    wanted = K.stored(spark, halves.join(shared.hint("merge"), "key").groupBy("doc_id").agg(F.collect_list(F.struct("line", "key", "common")).alias("wanted")), "wanted")
    maybe = K.sieve(wanted, "doc_id")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                own = Lines(K.column(part, "text"), least)
                at = {(r, n): k for k, (r, n) in enumerate(zip(own.row.tolist(), own.number.tolist()))}
                rows = []
                for r, (doc, wanted) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("wanted").to_pylist())):
                    for w in wanted:
                        k = at.get((r, w["line"]))
                        if k is not None:
                            for side in np.flatnonzero(own.keys[k].view(np.int64) == w["key"])[:1].tolist():
                                rows.append((w["key"], side % 2 == 0, doc, w["line"], own.low[own.a[k] : own.b[k]].tobytes().decode("utf-8", "replace"), w["common"]))
                cols = [*zip(*rows)] or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.bool_()))], names=["key", "head", "doc_id", "line", "text", "common"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(maybe("doc_id")).join(wanted.hint("merge"), "doc_id")
    meeting = source.mapInArrow(texts, "key long, head boolean, doc_id long, line int, text string, common boolean").dropDuplicates(["key", "doc_id", "line"])
    meeting = K.stored(spark, meeting, "meeting")
    local = meeting.filter("not common").repartition("key").sortWithinPartitions("key").mapInArrow(_neighbours, "doc_id long, line int, by_doc long, by_line int")
    near = local.union(_by_shuffle(meeting.filter("common")))
    earliest = near.groupBy("doc_id", "line").agg(F.min(F.struct(F.col("by_doc").alias("doc_id"), F.col("by_line").alias("line"))).alias("by"))
    earliest = K.stored(spark, earliest, "earliest")
    some = classes.filter((F.col("last") > F.col("first")) | K.sieve(earliest, "doc_id")("first.doc_id"))
    bounds = some.select("h1", "h2", "first", "last", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line")).join(earliest.hint("merge"), ["doc_id", "line"], "left")
    bounds = K.stored(spark, bounds.filter("last > first or by is not null").select("h1", "h2", F.coalesce(F.least("first", "by"), "first").alias("from")), "bounds")
    gone = table.select("doc_id", "line", "h1", "h2").filter(K.sieve(bounds, "h1")("h1")).join(bounds.hint("merge"), ["h1", "h2"]).filter("struct(doc_id, line) > from")
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def deduplicated(spark: SparkSession, docs: DataFrame, least: int = LEAST, group: int = GROUP, shortest: int | None = None, removed: str = "lines_removed_") -> DataFrame:
    """docs, all rows and columns, with text rid of its repeated lines and the column `removed` (int).

    A null text stays null, an empty one empty; rows without doc_id are left as they are and not
    compared. Repeated rows of one doc_id count as one document: its lines are compared as places
    (doc_id, line), so equal rows keep equal texts. A column of docs named as `removed` is
    replaced; any other name may occur.
    """
    lost = K.settled(spark, lambda: dropped(spark, docs, least, group, shortest), "dropped")
    maybe = F.coalesce(K.sieve(lost, "doc_id")(F.col("doc_id").cast("long")), F.lit(False))
    names = [c for c in docs.columns if c.lower() != removed.lower()]
    doc, gone = K.unused("lost_doc_", docs.columns), K.unused("lost_lines_", docs.columns)
    joined = docs.filter(maybe).join(lost.select(F.col("doc_id").alias(doc), F.col("lines").alias(gone)).hint("merge"), F.col("doc_id").cast("long") == F.col(doc), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains(F.col(gone), k.cast("int"))), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    touched = joined.select(*(text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names), F.coalesce(F.size(gone), F.lit(0)).alias(removed))
    return touched.withColumn(removed, F.greatest(removed, F.lit(0))).union(docs.filter(~maybe).select(*(f"`{c}`" for c in names), F.lit(0).alias(removed)))


def line_dedup(spark: SparkSession, docs: DataFrame, least: int = LEAST, shortest: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the remaining text, UTF-8) for every document."""
    slim = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
    out = deduplicated(spark, slim, least, shortest=shortest)
    return out.select("doc_id", "n_lines", F.col("lines_removed_").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


__all__ = ["LEAST", "deduplicated", "dropped", "line_dedup", "variants", "within_one"]
