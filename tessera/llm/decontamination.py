"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment.

Texts and items are compared lower-cased (Latin letters), with each run of white space as one space. An item
longer than WINDOW bytes is sought as overlapping windows of that length (every quarter window,
and the last one), a shorter one as a whole, so that part of an item counts as well: a verbatim
excerpt of WINDOW + WINDOW / 4 - 1 bytes holds a window wherever it begins. A window
of w bytes may differ in k = floor(share * w) edits; by the q-gram lemma a passage within that
budget shares at least w + 1 - q * (k + 1) of its q-grams with the window, all of them within k
diagonals. Hits are counted in bands of 2k diagonals that overlap by k; what reaches the bound
is aligned in a band of the same width.

The benchmark goes to the scan in blocks of bounded size, however large it is; documents are
not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K

Q, WINDOW, SHARE = 12, 100, 0.06
#: Items with fewer normalised bytes are no evidence and are not sought.
LEAST = 24
#: Bytes of benchmark text in a block.
BLOCK = 8 << 20


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, places): lower-cased, runs of white space as one space; places point into data."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    again = np.zeros(len(data), bool)
    again[1:] = white[1:] & white[:-1]
    inner = off[(off > 0) & (off < len(data))]
    again[inner] = False
    at = np.flatnonzero(~again)
    out = K.ascii_lower(np.where(white, np.uint8(32), data))
    accented = np.zeros(len(data), bool)  # the second byte of a Latin-1 capital
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out = (out + accented.astype(np.uint8) * np.uint8(32))[at]
    return out, np.searchsorted(at, off), at


@dataclass(frozen=True)
class Index:
    """The windows of a block of items and the sorted q-grams of the items."""

    item: np.ndarray  # of each window
    start: np.ndarray
    text: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    gram_item: np.ndarray  # number of the item's first window
    gram_at: np.ndarray
    first: np.ndarray  # of each window: the first window of its item


def indexed(items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, share: float = SHARE) -> Index:
    ids, starts, texts, budgets, bounds, firsts, grams, owner, places = [], [], [], [], [], [], [], [], []
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        data, _, _ = normalised(raw, np.array([0, len(raw)]))
        data = np.frombuffer(data.tobytes().strip(), np.uint8)
        n = len(data)
        if n < LEAST:
            continue
        first = len(ids)
        w = min(n, window)
        for a in sorted({*range(0, n - w + 1, max(1, window // 4)), n - w}):
            k = max(0, min(int(share * w), (w - q) // q))
            ids.append(item)
            starts.append(a)
            texts.append(data[a : a + w].tobytes())
            budgets.append(k)
            bounds.append(w + 1 - q * (k + 1))
            firsts.append(first)
        h = K.prefix(data)
        at = np.arange(n - q + 1)
        grams.append(K.substring_hash(h, at, at + q))
        owner.append(np.full(len(at), first))
        places.append(at)
    if not ids:
        none = np.zeros(0, np.int64)
        return Index(none, none, [], none, none, np.zeros(0, np.uint64), none, none, none)
    g, o, p = np.concatenate(grams), np.concatenate(owner), np.concatenate(places)
    order = np.lexsort((p, o, g))
    return Index(np.array(ids), np.array(starts), texts, np.array(budgets), np.array(bounds), g[order], o[order], p[order], np.array(firsts))


def aligned(window: bytes, text: bytes, budget: int, first: int | None = None, width: int = 0) -> tuple[int, int] | None:
    """(begin, end) of a part of text within `budget` edits of the whole window, the leftmost best, or None.

    Begin and end of the part are free. Only the diagonals (place in text less place in window)
    from `first` to `first` + `width` are filled, all of them without `first`.
    """
    at = text.find(window)
    if at >= 0:
        return at, at + len(window)
    n, m = len(window), len(text)
    if first is None:
        first, width = -n, n + m
    far = np.int64(1 << 40)
    steps = np.arange(width + 1)
    d = first + steps
    t = np.frombuffer(text + b"\0", np.uint8)
    cost, begin = np.where((d >= 0) & (d <= m), 0, far), np.clip(d, 0, m)
    for i, c in enumerate(window, 1):
        j = d + i
        up, slant = np.append(cost[1:], far) + 1, np.where(j >= 1, cost + (t[np.clip(j - 1, 0, m)] != c), far)
        take = slant <= up
        best, from_ = np.where(take, slant, up), np.where(take, begin, np.append(begin[1:], 0))
        best = np.where((j >= 0) & (j <= m), np.minimum(best, far), far)
        lead = np.minimum.accumulate((best - steps) * (width + 2) + steps)  # the cheapest cell to the left
        source = lead % (width + 2)
        source = np.where(best[source] + steps - source < best, source, steps)
        cost, begin = np.where((j >= 0) & (j <= m), best[source] + steps - source, far), from_[source]
        if cost.min() > budget:
            return None
    end = int(cost.argmin())
    return (int(begin[end]), int(d[end] + n)) if cost[end] <= budget else None


def found(col: pa.Array, index: Index, q: int = Q, window: int = WINDOW) -> list[dict[int, tuple[int, int]]]:
    """For each text, the items found in it: {item: (begin, end)} in characters, the earliest part of each."""
    out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(col))]
    raw, roff = K.buffers(col)
    data, off, places = normalised(raw, roff)
    if len(data) < q or not len(index.grams):
        return out
    at = np.arange(len(data) - q + 1)
    grams = K.substring_hash(K.prefix(data), at, at + q)
    maybe = np.zeros(1 << 20, bool)
    maybe[(index.grams >> np.uint64(44)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(grams >> np.uint64(44)).astype(np.int64)])
    lo = np.searchsorted(index.grams, grams[hit], "left")
    many = np.searchsorted(index.grams, grams[hit], "right") - lo
    hit, lo, many = hit[many > 0], lo[many > 0], many[many > 0]
    row = np.searchsorted(off, hit, "right") - 1
    whole = hit + q <= off[row + 1]
    hit, lo, many, row = hit[whole], lo[whole], many[whole], row[whole]
    least = int(index.bound.min())
    reach = window + int(index.budget.max()) - q
    if len(hit) < least:
        return out
    # a passage within budget holds `least` hits within `reach` places: drop hits without such company
    dense = np.zeros(len(hit) + 1, np.int64)
    run = np.flatnonzero((hit[least - 1 :] - hit[: len(hit) - least + 1] <= reach) & (row[least - 1 :] == row[: len(hit) - least + 1]))
    np.add.at(dense, run, 1)
    np.add.at(dense, run + least, -1)
    keep = np.cumsum(dense[:-1]) > 0
    hit, lo, many, row = hit[keep], lo[keep], many[keep], row[keep]
    if not len(hit):
        return out
    each = np.repeat(np.arange(len(hit)), many)
    entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    first, place, pos, doc = index.gram_item[entry], index.gram_at[entry], hit[each], row[each]
    per = np.bincount(index.first, minlength=len(index.item))  # windows of the item that starts at each window
    cand: list[tuple[int, int, int]] = []
    for j in range(int(per.max())):
        w = first + j
        ok = per[first] > j
        w = np.where(ok, w, 0)
        size = np.array([len(t) for t in index.text])
        ok &= (place >= index.start[w]) & (place + q <= index.start[w] + size[w])
        if not ok.any():
            continue
        ww, dd, diagonal = w[ok], doc[ok], (pos - place)[ok] - off[doc[ok]]
        step = np.maximum(index.budget[ww], 1)
        for shift in (0, 1):
            band = (diagonal + shift * step) // (2 * step)
            order = np.lexsort((band, ww, dd))
            d, x, b = dd[order], ww[order], band[order]
            cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (b[1:] != b[:-1]), [True])))
            full = np.flatnonzero(np.diff(cut) >= index.bound[x[cut[:-1]]])
            g = cut[full]
            low = b[g] * 2 * step[order][g] - shift * step[order][g]
            cand += zip(d[g].tolist(), x[g].tolist(), low.tolist())
    for d, x, low in sorted(set(cand)):
        item, k = int(index.item[x]), int(index.budget[x])
        if item in out[d]:
            continue
        base, size = int(off[d]), len(index.text[x])
        lead = low + int(index.start[x]) - k  # where the lowest diagonal of the band begins
        a = max(0, lead)
        b = min(int(off[d + 1]) - base, low + int(index.start[x]) + size + 3 * max(k, 1) + 1)
        part = aligned(index.text[x], data[base + a : base + b].tobytes(), k, min(0, lead), 4 * max(k, 1))
        if part:
            i, j = int(places[base + a + part[0]]), int(places[base + a + part[1] - 1]) + 1
            text = raw[roff[d] :]
            i, j = i - int(roff[d]), j - int(roff[d])
            lead = (text[:j] & 0xC0) != 0x80
            out[d][item] = (int(lead[:i].sum()), int(lead.sum()))
    return out


LEAKS = "array<struct<item_id: bigint, begin: bigint, end: bigint>>"


def blocks(benchmark: DataFrame, block: int = BLOCK) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks the items (item_id, text) make, and the blocks; each holds about `block` bytes at most.

    An item's text larger than that makes a block of its own size; nothing else is unbounded.
    """
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block)

    def each() -> Iterator[list[tuple[int, str]]]:
        for k in range(n):
            own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
            yield sorted((r["item_id"], r["text"]) for r in own)

    return n, each()


def _leaks(hits: list[dict[int, tuple[int, int]]]) -> list[list[dict[str, int]]]:
    return [[{"item_id": i, "begin": a, "end": b} for i, (a, b) in sorted(h.items())] for h in hits]


def _texts_hit(index: Index):
    """For rows (h, m, text): h, m and the items found, of those texts alone in which there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                hits = found(K.column(part, "text"), index)
                rows = pa.array([k for k, h in enumerate(hits) if h], pa.int64())
                if len(rows):
                    col = pa.array(_leaks([h for h in hits if h]), pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), col], names=["h", "m", "leaks"])

    return run


def _block_by_block(spark: SparkSession, docs: DataFrame, parts: Iterator[list[tuple[int, str]]]) -> DataFrame:
    """(h, m, leaks): for texts, by 64-bit hash and SHA-256, all items found; a table of hits for each block, then one of all."""

    def build() -> DataFrame:
        out = None
        texts = docs.filter("text is not null").select(F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("m"), "text")
        for items in parts:
            one = K.stored(spark, texts.mapInArrow(_texts_hit(indexed(items)), f"h long, m binary, leaks {LEAKS}"), "hits")
            out = one if out is None else out.union(one)
        rows = out.select("h", "m", F.explode("leaks").alias("l")).select("h", "m", "l.*").groupBy("h", "m", "item_id").agg(F.min(F.struct("begin", "end")).alias("s"))
        return rows.groupBy("h", "m").agg(F.array_sort(F.collect_list(F.struct("item_id", "s.begin", "s.end"))).alias("leaks"))  # the items within one text

    return K.settled(spark, build, "leaks")


def marked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, into: str = "leaks_", block: int = BLOCK) -> DataFrame:
    """docs, all rows and columns, with the column `into`: an array of (item_id, begin, end) in characters.

    A null or empty text has none. Items that are null, or shorter than LEAST normalised bytes,
    are not sought; items of one id count as one. Repeated rows are each marked; a column of docs
    named as `into` is replaced. A benchmark of one block is sought in one pass over docs. One of
    several blocks is sought block by block, so that a task holds one block's index: each pass
    leaves the hits of its block, and rows whose texts were hit are joined with them at the end.
    """
    names = [c for c in docs.columns if c.lower() != into.lower()]
    none = F.expr(f"cast(array() as {LEAKS})")
    rows = docs.select(*(f"`{c}`" for c in names))
    n, parts = blocks(benchmark, block)
    if not n:
        return rows.withColumn(into, none)
    if n > 1:
        hits = _block_by_block(spark, rows, parts)
        maybe = F.coalesce(K.sieve(hits, "h")(F.xxhash64("text")), F.lit(False)) & F.col("text").isNotNull()
        key, leaks = K.unused("m_", names), K.unused("hit_", names)
        met = rows.filter(maybe).withColumn(key, F.unhex(F.sha2("text", 256))).join(hits.select(F.col("m").alias(key), F.col("leaks").alias(leaks)).hint("merge"), key, "left")
        met = met.select(*(f"`{c}`" for c in names), F.coalesce(leaks, none).alias(into))
        return rows.filter(~maybe).withColumn(into, none).union(met)
    index = indexed(next(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                hits = found(K.column(part, "text"), index)
                k = part.schema.get_field_index(into)
                if any(hits):
                    part = part.set_column(k, part.schema.field(k), pa.array(_leaks(hits), part.schema.field(k).type))
                yield part

    out = rows.withColumn(into, none)
    return out.mapInArrow(run, out.schema)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and spans (item_id, begin, end) for every document."""
    rows = marked(spark, docs.select("doc_id", "text"), benchmark, block=block)
    return rows.select("doc_id", (F.size("leaks_") > 0).alias("contaminated"), F.size("leaks_").cast("long").alias("n_items"), F.col("leaks_.item_id").alias("item_ids"), F.col("leaks_").alias("spans"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item was found."""
    into = K.unused("leaks_", docs.columns)
    return marked(spark, docs, benchmark, into).filter(F.size(into) == 0).drop(into)
