"""Stupid-backoff language-model scores of all documents, each under the counts of all others.

At order k a word's score given the words before it is c(b_j..b_1, word) / c(b_j..b_1) for the
longest context b_j..b_1 of at most k - 1 words with which it stands in another document, times
ALPHA for each word of the context that had to be dropped; without context it is c(word) / N. A
word that stands in no other document counts as ALPHA / N. The first words of a document have less
context or none. All counts leave the document's own out. The document's score is the mean of the
logarithms.

1. Documents are gathered into slices of about SLICE bytes, stored as one row each.
2. A slice's n-grams of all orders are counted before anything is shuffled. Its (n-gram, count)
   rows go to the count tables, which are partitioned by ranges of the n-gram's 64-bit hash. They
   travel in columns, a row for each slice and range: as single rows they would be several times
   the text.
3. Each range adds up its counts and answers every slice, for each n-gram that it named, with the
   count in all other slices. An n-gram comes once from a slice at most, however common it is, so
   no range is hot.
4. A slice joins the answers to its exploded n-grams and sums the logarithms per document.

The rows of step 2 are as many as slices times ranges; on machines with more memory take larger
ones (parameters of backoff_scores). Of a hash, as many bits count as leave an n-gram a chance of
2**-CLEAR at most to share them with any other one; they grow with the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.textkit import U64

ALPHA = 0.4
#: Bits of an n-gram's hash beyond those that number all n-grams.
CLEAR = 22
#: Bytes of text in a slice, and bytes of text whose n-grams meet in a range of hashes.
SLICE, RANGE = 6 << 20, 8 << 20
_ROW = "slice long, part int, a binary, b binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = [*zip(*rows)] or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["slice", "part", "a", "b"])


def _planes(x: np.ndarray, width: int) -> bytes:
    """Whole numbers of `width` bytes as planes of their bytes, which compress where the high ones repeat."""
    return K.packed(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), width).T.tobytes())


def _unplaned(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(K.unpacked(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(flat.T).view(kind).reshape(-1)


def _sliced(size: int):
    """Slices of a task's documents. a: their ids and the ends of their texts; b: the texts. part: -1, before all answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number = [], [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            return _rows([(number, -1, np.stack((np.array(ids, np.int64), ends)).tobytes(), K.packed(b"".join(texts), 6))])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), K.column(batch, "text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if texts and held + len(raw) > size:
                    yield row()
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(doc)
                texts.append(raw)
                held += len(raw)
        if texts:
            yield row()
        K.trim()

    return run


class Grams:
    """The words of a slice and its n-grams: of each word those that end in it, by order; `bits` of their hashes count."""

    def __init__(self, a: bytes, b: bytes, order: int, bits: int):
        self.ids, ends = np.frombuffer(a, np.int64).reshape(2, -1)
        data = K.ascii_lower(np.frombuffer(K.unpacked(b), np.uint8))
        starts, stops, self.row = K.words(data, np.concatenate(([0], ends)))
        word = K.substring_hash(K.prefix(data), starts, stops)
        self.n = np.bincount(self.row, minlength=len(self.ids))
        self.since = np.arange(len(word)) - np.searchsorted(self.row, self.row)  # words before it in its text
        del data, starts, stops
        mask, grams = U64((1 << 64) - (1 << 64 - bits)), [K.mix(word + U64(1))]
        for j in range(1, order):  # the longer n-gram: the shorter one a word before, then the word
            g = np.zeros(len(word), U64)
            g[1:] = K.mix(grams[-1][:-1] * U64(0xD6E8FEB86659FD93) + word[1:] + U64(j))
            grams.append(g)
        self.known, at, self.count = np.unique(np.concatenate([g[self.since >= j] & mask for j, g in enumerate(grams)]), return_inverse=True, return_counts=True)
        del grams
        self.at, lo = [], 0  # of each order and word: which n-gram; -1 where the text begins
        for j in range(order):
            whole = self.since >= j
            own = np.full(len(word), -1, np.int32)
            own[whole] = at[lo : lo + int(whole.sum())]
            lo += int(whole.sum())
            self.at.append(own)

    def own(self, j: int) -> np.ndarray:
        """How often each word's n-gram stands in its own document."""
        out = np.ones(len(self.row), np.int64)
        some = np.flatnonzero((self.at[j] >= 0) & (self.count[self.at[j]] > 1))
        if len(some):
            order = some[np.lexsort((self.at[j][some], self.row[some]))]
            g, r = self.at[j][order], self.row[order]
            cut = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1]), [True])))
            out[order] = np.repeat(np.diff(cut), np.diff(cut))
        return out


def _part(gram: np.ndarray, parts: int) -> np.ndarray:
    """The range that a hash falls into; ranges ascend with the hashes."""
    return ((gram >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _exploded(parts: int, order: int, bits: int):
    """The n-grams of slices and how often they stand there. a: hashes, as differences; b: counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, a, b in zip(*(batch.column(c).to_pylist() for c in ("slice", "a", "b"))):
                own = Grams(a, b, order, bits)
                cut = np.searchsorted(_part(own.known, parts), np.arange(parts + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    gram, count = own.known[cut[k] : cut[k + 1]], own.count[cut[k] : cut[k + 1]]
                    yield _rows([(number, k, _planes(np.diff(gram, prepend=U64(0)), 8), _planes(count.astype(np.int32), 4))])
                del own
        K.trim()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by part: the count of each n-gram in all slices but the one that asks. a: these, in its order."""

    def whole(part: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        gram = [np.cumsum(_unplaned(a, np.uint64)) for _, a, _ in held]
        count = [_unplaned(b, np.int32) for _, _, b in held]
        known, at = np.unique(np.concatenate(gram), return_inverse=True)
        total = np.bincount(at, np.concatenate(count), len(known)).astype(np.int64)
        lo = 0
        for (number, _, _), own in zip(held, count):
            yield _rows([(number, part, _planes(total[at[lo : lo + len(own)]] - own, 8), b"")])
            lo += len(own)

    now, held = None, []
    for batch in batches:
        for number, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("slice", "part", "a", "b"))):
            if part != now and held:
                yield from whole(now, held)
                held = []
            now = part
            held.append((number, a, b))
    if held:
        yield from whole(now, held)
    K.trim()


def _scored(order: int, alpha: float, total: int, bits: int):
    """For rows sorted by slice, the slice before its answers: the sums of each document, logarithms in whole millionths."""

    def whole(a: bytes, b: bytes, answers: list[bytes]) -> pa.RecordBatch:
        own = Grams(a, b, order, bits)
        rows, words = len(own.ids), len(own.row)
        others = np.concatenate([_unplaned(x, np.int64) for x in answers]) + own.count if answers else own.count
        n = np.maximum(total - own.n, 1)[own.row]
        free = np.where(words > 0, others[own.at[0]] - own.own(0), 0) if words else np.zeros(0, np.int64)
        unseen, level = free <= 0, np.zeros(words, np.int64)
        log = np.log(np.where(unseen, alpha, free) / n)
        for j in range(1, order):
            before = free  # of the n-grams a word shorter
            free = np.where(own.at[j] >= 0, others[own.at[j]] - own.own(j), 0)
            seen = np.flatnonzero(free > 0)
            level[seen] = j
            log[seen] = np.log(free[seen] / before[seen - 1])
        context = np.minimum(own.since, order - 1)
        log += (context - level) * np.log(alpha)
        add = lambda x: np.bincount(own.row, x, rows).astype(np.int64)
        cols = (own.ids, own.n, add(level < context), add(unseen & (level == 0)), add(np.rint(log * 1e6)))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["doc_id", "n_words", "n_backoff", "n_unseen", "log"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b"))):
                if part < 0:
                    if now:
                        yield whole(*now, held)
                    now, held = (a, b), []
                else:
                    held.append(a)
        if now:
            yield whole(*now, held)
        K.trim()

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.pieces_of(batch, "text"):
            data, off = K.buffers(K.column(part, "text"))
            _, _, row = K.words(data, off)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(row, minlength=part.num_rows))], names=["doc_id", "n_words"])


def backoff_scores(spark: SparkSession, docs: DataFrame, alpha: float = ALPHA, order: int = 3, slice_bytes: int = SLICE, range_bytes: int = RANGE) -> DataFrame:
    """doc_id, n_words, n_backoff, n_unseen, log_sum and score (mean log) for every document.

    order, 2 or more, is the length of the longest grams; n_backoff counts the words that drop a
    word of their context of order - 1 words (or of fewer, where the document begins).

    Every row is a document of its own: rows of one doc_id, repeated ones too, count for each
    other. A null or empty text, or one without words, has a null score and a log_sum of 0; so
    has a row without doc_id, whose words count for nobody. Further columns are not read; an
    empty table gives no rows. A text longer than a slice is a slice of its own. Each logarithm is rounded to
    millionths, log_sum to 3 decimals, score to 6.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = F.col("doc_id").isNotNull() & (F.coalesce("text", F.lit("")) != "")
    sums = K.settled(spark, lambda: _sums(spark, docs.filter(scored), alpha, order, slice_bytes, range_bytes), "scores")
    rest = docs.filter(~scored).mapInArrow(_lengths, "doc_id long, n_words long").select("doc_id", "n_words", F.lit(0).alias("n_backoff"), F.lit(0).alias("n_unseen"), F.lit(None).cast("long").alias("log"))
    log = F.col("log") / F.lit(1e6)
    return sums.union(rest).select("doc_id", "n_words", F.col("n_backoff").cast("long").alias("n_backoff"), F.col("n_unseen").cast("long").alias("n_unseen"), F.round(F.coalesce(log, F.lit(0.0)), 3).alias("log_sum"), F.when(F.col("n_words") > 0, F.round(log / F.col("n_words"), 6)).alias("score"))


def _sums(spark: SparkSession, table: DataFrame, alpha: float, order: int, slice_bytes: int, range_bytes: int) -> DataFrame:
    size = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-size // range_bytes))
    slices = K.stored(spark, table.mapInArrow(_sliced(slice_bytes), _ROW), "slices")
    total = slices.select("a", "b").mapInArrow(_words, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(64, (total * order).bit_length() + CLEAR)
    asked = slices.mapInArrow(_exploded(parts, order, bits), _ROW)
    answers = asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answered, _ROW)
    both = slices.union(answers).repartition(max(least, -(-size // (4 * slice_bytes))), "slice").sortWithinPartitions("slice", "part")
    return both.mapInArrow(_scored(order, alpha, total, bits), "doc_id long, n_words long, n_backoff long, n_unseen long, log long")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            ends = np.frombuffer(a, np.int64).reshape(2, -1)[1]
            starts, _, _ = K.words(np.frombuffer(K.unpacked(b), np.uint8), np.concatenate(([0], ends)))
            yield pa.RecordBatch.from_arrays([pa.array([len(starts)])], names=["n"])


def sql(order: int = 3, alpha: float = ALPHA) -> str:
    """The same scores in DuckDB SQL: counts of n-grams joined to the exploded n-grams of each document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ctes = [rf"d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as ws from documents)"]
    ctes.append("w as (select doc_id, unnest(ws) as g1, unnest(range(1, len(ws) + 1)) as spot, len(ws) as n from d)")
    ctes.append("t as (select count(*) as total from w)")
    grams = ["g1", *(f"case when spot > {j} then lag(g{j}) over (partition by doc_id order by spot) || ' ' || g1 end as g{j + 1}" for j in range(1, order))]
    for j in range(1, order):
        ctes.append(f"w{j + 1} as (select *, {grams[j]} from {'w' if j == 1 else f'w{j}'})")
    last = f"w{order}"
    for j in range(1, order + 1):
        ctes.append(f"c{j} as (select g{j}, count(*) as c from {last} where g{j} is not null group by 1)")
        ctes.append(f"o{j} as (select doc_id, g{j}, count(*) as c from {last} where g{j} is not null group by 1, 2)")
        ctes.append(f"f{j} as (select o.doc_id, o.g{j}, c.c - o.c as f{j} from o{j} o join c{j} c using (g{j}))")
    joins = " ".join(f"left join f{j} using (doc_id, g{j})" for j in range(1, order + 1))
    ctes.append(f"s as (select doc_id, spot, n, {', '.join(f'coalesce(f{j}, 0) as f{j}' for j in range(1, order + 1))} from {last} {joins})")
    before = ", ".join(f"lag(f{j}) over (partition by doc_id order by spot) as b{j}" for j in range(1, order))
    ctes.append(f"b as (select *, {before}, greatest(total - n, 1) as others, least(spot, {order}) as whole from s, t)")
    level = "case " + " ".join(f"when f{j} > 0 then {j}" for j in range(order, 1, -1)) + " else 1 end"
    value = "case " + " ".join(f"when f{j} > 0 then ln(f{j} / b{j - 1})" for j in range(order, 1, -1)) + f" when f1 > 0 then ln(f1 / others) else ln({alpha} / others) end"
    ctes.append(f"l as (select *, {level} as level, {value} as v from b)")
    ctes.append(f"x as (select doc_id, cast(sum(case when level < whole then 1 else 0 end) as bigint) as n_backoff, cast(sum(case when level = 1 and f1 <= 0 then 1 else 0 end) as bigint) as n_unseen, cast(sum(cast(round_even((v + (whole - level) * ln({alpha})) * 1e6, 0) as bigint)) as bigint) as log from l group by doc_id)")
    return f"with {', '.join(ctes)} select doc_id, len(ws) as n_words, coalesce(n_backoff, 0) as n_backoff, coalesce(n_unseen, 0) as n_unseen, round(coalesce(log / 1e6, 0), 3) as log_sum, round(log / 1e6 / len(ws), 6) as score from d left join x using (doc_id)"
