"""Exact-substring dedup with sharded suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
doc_id. Documents are judged as they are in the input; matches never cross documents.

0. Copies. Of documents with equal texts (by SHA-256) all but the least lose everything, and only
   that one goes on, so a text that very many documents have as a whole costs what one costs.
1. Anchors. Each window of LENGTH bytes has as its anchor the least hash among its GRAM-byte
   grams, so equal windows have equal anchors, and neighbouring windows mostly share theirs.
   Anchors are counted over documents in hash buckets; those of two documents or more are
   shared. The few that stand in more than a share COMMON of all documents (so their number is
   bounded by anchors per document / COMMON) are called common.
2. Pieces. Only windows with a shared anchor can repeat. A maximal run of windows with the same
   anchor is a piece of text; pieces go to shards by anchor, so equal windows meet. With a
   common anchor each window is a piece of its own and goes by its own hash, which spreads the
   edges of a passage that very many documents hold. Within BUCKET bytes of text, a piece that
   a smaller document holds as a whole, byte by byte, is settled at once and not sent, so that a
   passage costs a shard one copy for each of these, not for each document.
3. Shards. A shard's suffix array over its distinct pieces (suffixes.py: classified, induced,
   leftmost-S substrings sorted recursively) and the permuted common prefixes give the classes
   of equal windows; the least document of each class decides.
4. The removed runs meet by buckets of documents, then their documents; documents that lose nothing pass without a shuffle.

Grams and pieces are found by 64-bit hashes, but bytes are removed only where bytes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K
from tessera.llm.suffixes import permuted_common_prefixes, suffix_array

LENGTH, GRAM, COMMON = 50, 24, 0.001
#: Bytes of pieces that a shard gets about, before those settled in their tasks are left out. An
#: array takes some sixty times as much memory as its text, so shards are small and many.
SHARD = 2 << 20
#: Bytes of text whose anchors meet in a bucket: some 75 bytes of memory for each 13 bytes of text.
BUCKET = 16 << 20
#: Bytes of text whose windows are hashed at once.
STEP = 2 << 20
#: Pieces that a task deals to the shards at once, if they are not those of BUCKET bytes of text.
PIECES = 1 << 20
#: Runs that a task of shards holds before it gives them away.
RUNS = 1 << 20
#: Windows whose hashes are made at once, in the processor's caches.
BLOCK = 1 << 15
_M48 = np.uint64(0xFFFFFFFFFFFF)
_ROW = "bucket int, kind int, a binary, b binary, c binary"


def _row(rows: list[tuple]) -> pa.RecordBatch:
    cols = [*zip(*rows)] or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "kind", "a", "b", "c"])


def spread(ids, n: int):
    """The bucket of a document; numpy and column arguments give the same."""
    if isinstance(ids, np.ndarray):
        return ((ids ^ (ids >> 15)) % n).astype(np.int64)
    return F.pmod(ids.bitwiseXOR(F.shiftright(ids, 15)), F.lit(n)).cast("int")


def anchored(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: row, first window, last window + 1, anchor (48 bits); and H."""
    h = K.prefix(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64), h
    _, down = K.powers(len(h))
    width = length - gram + 1
    m = np.empty(len(data) - length + 1, np.uint64)
    for lo in range(0, len(m), BLOCK):
        hi = min(lo + BLOCK, len(m))
        x = h[lo + gram : hi + width - 1 + gram] - h[lo : hi + width - 1]  # as K.substring_hash
        x *= down[lo : hi + width - 1]
        x += np.uint64(gram)
        x = K.mix(x) >> np.uint64(16)
        span = 1
        while 2 * span <= width:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        if span < width:
            x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
        m[lo:hi] = x
    size = np.diff(off)
    inside = np.maximum(size - length + 1, 0)
    ok = np.repeat(np.tile([True, False], len(size)), np.stack((inside, size - inside), 1).ravel())[: len(m)]
    new = np.ones(len(m) + 1, bool)
    np.not_equal(m[1:], m[:-1], out=new[1:-1])
    new[off[off < len(m)]] = True
    new[1:-1] |= ok[1:] != ok[:-1]
    starts, last = np.flatnonzero(ok & new[:-1]), np.flatnonzero(ok & new[1:])
    return np.searchsorted(off, starts, "right") - 1, starts, last + 1, m[starts], h


def _anchors(length: int, gram: int, buckets: int):
    """Kind 0: a bucket's anchors of some BUCKET bytes; kind 1: anchors that two documents of these share.

    Rows are few, as every one is a small table of its own: their number is that of buckets times
    that of BUCKETs of text.
    """

    def counted(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, anchor = np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
        before = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
        row = np.concatenate([x[1] + k for x, k in zip(held, before.tolist())])
        order = np.argsort(anchor, kind="stable")  # rows ascend
        row, anchor = row[order], anchor[order]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
        row, anchor = row[new], anchor[new]
        cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
        count = np.diff(cut)
        rows = []
        both = np.repeat(count > 1, count)
        rows.append((int(anchor[0] % np.uint64(buckets)), 1, anchor[both].tobytes(), ids[row[both]].tobytes(), b""))
        one, who = anchor[cut[:-1]], np.where(count > 1, -count, row[cut[:-1]] + 1).astype(np.int32)
        bucket = (one % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        one, who, bucket = one[order], who[order], bucket[order]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            a = one[lo:hi]
            mine = np.unique(who[lo:hi][who[lo:hi] > 0])
            small = np.uint16 if len(mine) < 30_000 else np.int32
            slot = np.where(who[lo:hi] > 0, np.searchsorted(mine, who[lo:hi]), 0).astype(small)
            planes = (a >> np.uint64(32)).astype(np.uint16).tobytes() + (a & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
            # c: how many stand for several documents, where and how many; then the others' documents
            many = np.flatnonzero(who[lo:hi] < 0).astype(np.int32)
            head = np.array([len(many)], np.int32).tobytes() + many.tobytes() + (-who[lo:hi][many]).astype(np.int32).tobytes()
            rows.append((int(bucket[lo]), 0, planes, slot.tobytes(), head + ids[mine - 1].astype(np.int64).tobytes()))
        return _row(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in K.pieces_of(batch, "text", STEP):
                data, off = K.buffers(K.column(part, "text"))
                row, _, _, anchor, _ = anchored(data, off, length, gram)
                if not len(row):
                    continue
                held.append((np.array(part.column("doc_id")), row, anchor))
                size += len(data)
                if size >= BUCKET:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def _shared(docs_buckets: int, common: int):
    """Anchors of two documents or more. Kind 1: (anchors, documents) by documents' bucket; kind 2: common anchors."""

    def marks(anchor: np.ndarray, doc: np.ndarray) -> list[tuple]:
        bucket = spread(doc, docs_buckets)
        order = np.argsort(bucket, kind="stable")
        anchor, doc, bucket = anchor[order], doc[order], bucket[order]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
        return [(int(bucket[lo]), 1, anchor[lo:hi].tobytes(), doc[lo:hi].tobytes(), b"") for lo, hi in zip(edge[:-1], edge[1:])]

    def whole(blobs: list[tuple]) -> list[tuple]:
        anchors, docs, many = [], [], []
        for a, b, c in blobs:
            n = len(a) // 6
            own = np.frombuffer(a, np.uint16, n).astype(np.uint64) << np.uint64(32) | np.frombuffer(a, np.uint32, n, 2 * n)
            k = int(np.frombuffer(c, np.int32, 1)[0])
            at, count = np.frombuffer(c, np.int32, k, 4), np.frombuffer(c, np.int32, k, 4 + 4 * k)
            ids = np.frombuffer(c, np.int64, -1, 4 + 8 * k) if len(c) > 4 + 8 * k else np.zeros(1, np.int64)
            slot = np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.int32)
            times = np.ones(n, np.int64)
            times[at] = count
            anchors.append(own)
            docs.append(ids[slot])
            many.append(times)
        anchor, doc, times = np.concatenate(anchors), np.concatenate(docs), np.concatenate(many)
        order = np.argsort(anchor, kind="stable")
        anchor, doc, times = anchor[order], doc[order], times[order]
        cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
        size = np.diff(cut)
        total = np.add.reduceat(times, cut[:-1])
        out = np.repeat((total > 1), size) & (times == 1)
        rows = marks(anchor[out], doc[out])
        often = anchor[cut[:-1]][total > common]
        if len(often):
            rows.append((0, 2, often.tobytes(), b"", b""))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                if kind:
                    yield _row(marks(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)))
                    continue
                if bucket != now and held:
                    yield _row(whole(held))
                    held = []
                now = bucket
                held.append((a, b, c))
        if held:
            yield _row(whole(held))

    return run


def _runs_of(flags: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True in a concatenation of segments that begin at `begin`."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[begin] = True
    before = np.concatenate(([False], flags[:-1]))
    after = np.concatenate((flags[1:], [False]))
    return np.flatnonzero(flags & (~before | edge[:-1])), np.flatnonzero(flags & (~after | edge[1:])) + 1


def _pieces(length: int, gram: int, shards: int, common: np.ndarray, docs_buckets: int):
    """For rows sorted by bucket, marks before texts. Kind 0: pieces by shard; kind 1: settled runs."""

    def settled(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple]:
        return [(int(doc[0] % shards) if len(doc) else 0, 1, doc.astype(np.int64).tobytes(), begin.astype(np.int64).tobytes(), end.astype(np.int64).tobytes())] if len(doc) else []

    def cut(texts: list[bytes], ids: np.ndarray, marks: np.ndarray) -> tuple | None:
        """Of the pieces: document, place, size, shard, hash of the bytes; and the bytes."""
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        data = np.frombuffer(b"".join(texts), np.uint8)
        row, lo, hi, anchor, h = anchored(data, off, length, gram)
        key = K.mix(anchor ^ K.mix(ids[row].view(np.uint64)))
        at = np.minimum(np.searchsorted(marks, key), len(marks) - 1)
        use = marks[at] == key
        row, lo, hi, anchor = row[use], lo[use], hi[use], anchor[use]
        if not len(row):
            return None
        often = np.isin(anchor, common)
        if often.any():  # each window by itself, dealt by its own hash
            n = (hi - lo)[often]
            w = np.repeat(lo[often] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            own = K.substring_hash(h, w, w + length) >> np.uint64(16)
            row, lo, hi, anchor = (np.concatenate((x[~often], y)) for x, y in ((row, np.repeat(row[often], n)), (lo, w), (hi, w + 1), (anchor, own)))
        end = hi + length - 1
        shard = (K.mix(anchor) % np.uint64(shards)).astype(np.int32)
        return ids[row], (lo - off[row]).astype(np.int32), (end - lo).astype(np.int32), shard, K.substring_hash(h, lo, end), lo, data

    def dealt(held: list[tuple]) -> list[tuple]:
        doc, at, size, shard, content = (np.concatenate([x[k] for x in held]) for k in range(5))
        before = np.cumsum([0, *(len(x[6]) for x in held[:-1])])
        lo, data = np.concatenate([x[5] + k for x, k in zip(held, before.tolist())]), np.concatenate([x[6] for x in held])
        order = np.lexsort((doc, content))
        found = content[order]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        kin = np.diff(np.append(first, len(doc)))
        least = np.empty(len(doc), np.int64)
        least[order] = np.repeat(order[first], kin)
        raw, gone = data.tobytes(), np.zeros(len(doc), bool)
        maybe = np.flatnonzero(doc > doc[least])
        for some in np.split(maybe, range(1 << 16, len(maybe), 1 << 16)):
            other = least[some]
            gone[some] = [raw[a : a + n] == raw[b : b + m] for a, n, b, m in zip(*(x.tolist() for x in (lo[some], size[some], lo[other], size[other])))]
        del raw
        rows = settled(doc[gone], at[gone], at[gone] + size[gone])
        order = np.flatnonzero(~gone)
        order = order[np.lexsort((lo[order], shard[order]))]
        doc, at, size, shard, lo = (x[order] for x in (doc, at, size, shard, lo))
        edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            n = size[a:b].astype(np.int64)
            flat = np.repeat(lo[a:b] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            rows.append((int(shard[a]), 0, doc[a:b].astype(np.int64).tobytes(), np.concatenate((at[a:b], n)).astype(np.int32).tobytes(), K.packed(data[flat].tobytes())))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, marks, ready = None, [], None
        texts, ids, size = [], [], 0
        held = []

        def flush() -> None:
            nonlocal texts, ids, size
            if texts and ready is not None and len(ready) and (found := cut(texts, np.array(ids, np.int64), ready)):
                held.append(found)
            texts, ids, size = [], [], 0

        def full() -> bool:
            return sum(len(x[6]) for x in held) >= BUCKET or sum(len(x[0]) for x in held) >= PIECES

        def sent() -> pa.RecordBatch:
            out = dealt(held) if held else []
            held.clear()
            return _row(out)

        for batch in batches:
            names = ("bucket", "kind", "doc_id", "text", "a", "b")
            for bucket, kind, doc, text, a, b in zip(*(batch.column(c).to_pylist() for c in names)):
                if bucket != now:
                    flush()
                    now, marks, ready = bucket, [], None
                if kind:
                    marks.append(K.mix(np.frombuffer(a, np.uint64) ^ K.mix(np.frombuffer(b, np.int64).view(np.uint64))))
                    continue
                if ready is None:
                    ready = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
                raw = text.encode("utf-8", "surrogatepass")
                if size and size + len(raw) > STEP:
                    flush()
                    if full():
                        yield sent()
                texts.append(raw)
                ids.append(doc)
                size += len(raw)
        flush()
        yield sent()

    return run


def repeats(doc: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, begin, end) of the runs that smaller documents hold, for pieces (doc, place, size) of `data`.

    The pieces' windows have anchors of longer grams here, which fewer share by chance. A piece none
    of whose anchors another one has repeats as a whole or not at all; the suffix array is over
    all other distinct pieces.
    """
    start = np.cumsum(size) - size
    raw, known = data.tobytes(), {}
    order = np.argsort(doc, kind="stable")
    kind = np.empty(len(doc), np.int64)  # of each piece: which distinct piece
    for k in order.tolist():
        kind[k] = known.setdefault(raw[start[k] : start[k] + size[k]], len(known))
    first = np.empty(len(known), np.int64)  # of each distinct piece: the least document's
    first[kind[order[::-1]]] = order[::-1]
    del raw, known, order
    n = size[first]
    begin = np.cumsum(n) - n
    text = data[np.repeat(start[first] - begin, n) + np.arange(int(n.sum()))]
    row, _, _, anchor, _ = anchored(text, np.append(begin, len(text)), length, max(gram, 4 * length // 5))
    order = np.argsort(anchor, kind="stable")  # rows ascend
    row, anchor = row[order], anchor[order]
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(cut[1:], len(row)) - 1
    shared = np.zeros(len(first), bool)
    shared[row[np.repeat(row[cut] != row[last], last - cut + 1)]] = True
    least = doc[first]  # of each distinct piece; of its windows where it is alone with its anchor
    m = size - length + 1
    base = np.cumsum(m) - m
    flags = np.repeat(least[kind] < doc, m)
    if shared.any():
        slot = np.cumsum(shared) - 1
        n = n[shared]
        begin, kept = np.cumsum(n) - n, begin[shared]
        text = text[np.repeat(kept - begin, n) + np.arange(int(n.sum()))]
        sa = suffix_array(text, length)
        plcp = permuted_common_prefixes(text, sa, length)
        piece = np.repeat(np.arange(len(n)), n)
        window = np.arange(len(text)) + length <= (begin + n)[piece]  # windows inside a piece
        suffix = sa[1:]
        suffix_class = np.cumsum(plcp[suffix] < length)  # equal in their first `length` bytes
        suffix, suffix_class = suffix[window[suffix]], suffix_class[window[suffix]]
        holder = least[shared][piece[suffix]]
        cut = np.flatnonzero(np.concatenate(([True], suffix_class[1:] != suffix_class[:-1])))
        who = np.full(len(text), np.iinfo(np.int64).max)
        who[suffix] = np.repeat(np.minimum.reduceat(holder, cut), np.diff(np.append(cut, len(suffix))))
        some = np.flatnonzero(shared[kind])
        owner = np.repeat(some, m[some])
        at_ = np.repeat(base[some] - np.cumsum(m[some]) + m[some], m[some]) + np.arange(int(m[some].sum()))
        flags[at_] = who[begin[slot[kind[owner]]] + at_ - base[owner]] < doc[owner]
    a, b = _runs_of(flags, np.append(base, len(flags)))
    k = np.searchsorted(base, a, "right") - 1
    return doc[k], at[k] + a - base[k], at[k] + b - 1 - base[k] + length


def _shards(length: int, docs_buckets: int):
    """The runs that shards and settled pieces remove: a row for each task (for RUNS runs of it at least) and documents' bucket."""

    def out(found: list[tuple]) -> pa.RecordBatch:
        doc, begin, end = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in range(3))
        bucket = spread(doc, docs_buckets)
        order = np.argsort(bucket, kind="stable")
        doc, begin, end, bucket = doc[order], begin[order], end[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(doc) else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), *(K.binaries(x, cut) for x in (doc, begin, end))], names=["bucket", "docs", "begins", "ends"])

    def whole(held: list[tuple]) -> tuple:
        doc = np.concatenate([np.frombuffer(a, np.int64) for a, _, _ in held])
        both = [np.frombuffer(b, np.int32).reshape(2, -1) for _, b, _ in held]
        at, size = (np.concatenate([x[k] for x in both]).astype(np.int64) for k in range(2))
        return repeats(doc, at, size, np.frombuffer(b"".join(K.unpacked(c) for _, _, c in held), np.uint8), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []
        for batch in batches:
            for bucket, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                if bucket != now and held:
                    found.append(whole(held))
                    held = []
                now = bucket
                if kind:
                    found.append(tuple(np.frombuffer(x, np.int64) for x in (a, b, c)))
                else:
                    held.append((a, b, c))
                if sum(len(x[0]) for x in found) >= RUNS:
                    yield out(found)
                    found = []
        if held:
            found.append(whole(held))
        yield out(found)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of _shards sorted by bucket: a row for each document."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        doc, begin, end = (np.concatenate([np.frombuffer(x[k], np.int64) for x in held]) for k in range(3))
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
        return pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]]), K.binaries(begin, cut), K.binaries(end, cut)], names=["doc_id", "begins", "ends"])

    now, held = None, []
    for batch in batches:
        for bucket, *runs in zip(*(x.to_pylist() for x in batch.columns)):
            if bucket != now and held:
                yield out(held)
                held = []
            now = bucket
            held.append(runs)
    if held:
        yield out(held)


def removed(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, common: float = COMMON) -> DataFrame:
    """(doc_id, begins, ends): for documents that lose bytes, runs to remove, packed int64; runs may overlap.

    Buckets and shards are as many as the bytes of text ask for. Joins are sort-merge ones at every size.
    """
    table = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= length)
    table, copies = _without_copies(spark, table)
    total, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    found = table.mapInArrow(_anchors(length, gram, n), _ROW)
    marks = found.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_shared(n, max(64, int(common * total))), _ROW)
    marks = K.stored(spark, marks, "marks")
    often = [np.frombuffer(r["a"], np.uint64) for r in marks.filter("kind = 2").select("a").collect()]
    often = np.unique(np.concatenate(often)) if often else np.zeros(0, np.uint64)
    shared = marks.filter("kind = 1").agg(F.sum(F.octet_length("a"))).first()[0] or 0
    shards = max(n, int(shared / 8 * 1.4 * length / SHARD))
    ids = marks.filter("kind = 1").select("b").mapInArrow(_marked(n), "bucket int, b binary").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_ids, "doc_id long")
    maybe = K.sieve(K.stored(spark, ids, "marked"), "doc_id")
    texts = table.filter(maybe("doc_id")).select(spread(F.col("doc_id"), n).alias("bucket"), F.lit(0).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    both = marks.filter("kind = 1").select("bucket", "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "a", "b").union(texts)
    pieces = both.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("kind").desc()).mapInArrow(_pieces(length, gram, shards, often, n), _ROW)
    lost = pieces.repartition(max(n, -(-shards // 4)), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_shards(length, n), "bucket int, docs binary, begins binary, ends binary")
    lost = lost.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_document, "doc_id long, begins binary, ends binary")
    return lost.union(copies.select("doc_id", "n").mapInArrow(_whole_texts, "doc_id long, begins binary, ends binary"))


def _without_copies(spark: SparkSession, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of table (doc_id, text) but for copies of a smaller document; and those: (doc_id, m, n)."""
    named = table.select("doc_id", F.unhex(F.sha2("text", 256)).alias("m"), F.octet_length("text").cast("long").alias("n"))
    least = named.groupBy("m").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least").select("m", "least")
    copies = K.stored(spark, named.join(least.hint("merge"), "m").filter("doc_id > least").select("doc_id", "m", "n").distinct(), "copies")
    maybe = K.sieve(copies, "doc_id")("doc_id")
    known = copies.select(F.col("doc_id").alias("d_"), F.col("m").alias("m_")).hint("merge")
    some = table.filter(maybe).join(known, (F.col("doc_id") == F.col("d_")) & (F.unhex(F.sha2("text", 256)) == F.col("m_")), "left_anti")
    return table.filter(~maybe).union(some), copies


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.asarray(batch.column("n"), np.int64)
        at = np.arange(len(n) + 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), K.binaries(np.zeros_like(n), at), K.binaries(n, at)], names=["doc_id", "begins", "ends"])


def _marked(docs_buckets: int):
    """The documents of marks, once each: a row for each task (for RUNS marks of it at least) and documents' bucket."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        doc = np.unique(np.concatenate([np.zeros(0, np.int64), *held]))
        bucket = spread(doc, docs_buckets)
        order = np.argsort(bucket, kind="stable")
        doc, bucket = doc[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(doc) else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), K.binaries(doc, cut)], names=["bucket", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b in batch.column("b").to_pylist():
                held.append(np.frombuffer(b, np.int64))
                size += len(held[-1])
                if size >= RUNS:
                    yield out(held)
                    held, size = [], 0
        yield out(held)

    return run


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of _marked sorted by bucket: a row for each document, as a document has one bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, b in zip(batch.column("bucket").to_pylist(), batch.column("b").to_pylist()):
            if bucket != now and held:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["doc_id"])
                held = []
            now = bucket
            held.append(np.frombuffer(b, np.int64))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["doc_id"])


def merged(begins: bytes, ends: bytes, n: int) -> list[tuple[int, int]]:
    """The maximal removed runs of a text of n bytes."""
    a, b = np.minimum(np.frombuffer(begins, np.int64), n), np.minimum(np.frombuffer(ends, np.int64), n)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, a, 1)
    np.add.at(delta, b, -1)
    s, e = K.spans_of(np.cumsum(delta[:-1]) > 0, np.array([0, n]))
    return [*zip(s.tolist(), e.tolist())]


def deduplicated(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text, spans (begin, end in bytes) and kept (the remaining bytes) for every row of docs.

    A null text is empty. Rows without doc_id lose nothing and count for nobody. Rows of one
    doc_id are one document as far as "smaller" goes: they do not remove each other's bytes; what
    is found for the id is removed where it stands in the row's own text. Repeated rows stay.
    Further columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lost = K.settled(spark, lambda: removed(spark, docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("begins", "ends")).alias("runs")), "removed")
    maybe = F.coalesce(K.sieve(lost, "doc_id")("doc_id"), F.lit(False))

    @F.pandas_udf("struct<spans: array<struct<begin: bigint, end: bigint>>, kept: binary>")
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for t, r in zip(text, runs):
            raw = t.encode("utf-8", "surrogatepass")
            own = merged(b"".join(x["begins"] for x in r), b"".join(x["ends"] for x in r), len(raw)) if r is not None and len(r) else []
            at = [0, *(y for s in own for y in s), len(raw)]
            spans.append([{"begin": a, "end": b} for a, b in own])
            kept.append(b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2])))
        return pd.DataFrame({"spans": spans, "kept": kept})

    joined = docs.filter(maybe).join(lost.hint("merge"), "doc_id", "left").withColumn("x", cut("text", "runs")).select("doc_id", "text", "x.spans", "x.kept")
    rest = docs.filter(~maybe).select("doc_id", "text", F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)").alias("spans"), F.encode("text", "utf-8").alias("kept"))
    return joined.union(rest)


def substring_dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document."""
    out = deduplicated(spark, docs, length)
    n = F.octet_length("text").cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
