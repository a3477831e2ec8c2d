"""Best-fit packing of documents into fixed-length sequences by linear grouping.

1. Executors tokenise each document, append the separator and cut what is longer than the
   capacity: whole pieces of the capacity at the end, a shorter first piece.
2. Only the histogram of piece lengths (one row for each length up to the capacity, however
   large the corpus) reaches the driver. There, linear grouping puts the large lengths, in
   descending order, into groups of equal cardinality and rounds each up to its group's
   largest; the few rounded sizes are combined into configurations by bounded knapsacks; the
   actual lengths are then substituted for the rounded ones; small lengths go best-fit into
   what is left. All of this runs on runs of equal bins, so its cost depends on the capacity
   and not on the number of documents.
3. Each piece finds its place from its rank among the pieces of its length. The rank is made
   from counts by (length, salt), so that no length, however common, is ranked by one task.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textkit as K

#: Distinct chunks of text whose ids a Python worker keeps at most.
CACHE = 300_000


class Encoder:
    """Ids of whole texts under a byte-level BPE given as a tokenizers JSON file.

    The file's own merges are applied chunk by chunk: between a non-space character and a
    single space followed by a non-space character the pre-tokenizer always cuts, so a chunk's
    ids do not depend on its neighbours and can be remembered. Texts with longer or odd white
    space take the plain way as a whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _fits(spec)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        decode = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(decode[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = [*special]
        self.apart = self.special[0] if self.special else None
        self.inner: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.marks = {c: self.plain(c) for c in ".,"}

    def plain(self, text: str) -> bytes:
        return np.array(self.codec.encode(text, allowed_special="all"), np.uint16).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """plain() of each, in one call: the texts are joined by a special token, which stands apart."""
        if self.apart is None or any(s in t for s in self.special for t in texts):
            return [*map(self.plain, texts)]
        ids = np.array(self.codec.encode(self.apart.join(texts), allowed_special="all"), np.uint16)
        ends = 2 * np.append(np.flatnonzero(ids == self.codec._special_tokens[self.apart]), len(ids))
        raw, starts = ids.tobytes(), np.concatenate(([0], ends[:-1] + 2))
        return [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]

    def learn(self, chunks: list[str]) -> None:
        """Remembers the ids of a space and each chunk; a chunk that is not clean gets the mark b"?"."""
        if len(self.inner) + len(chunks) > CACHE:
            self.inner.clear()
        split, new = [], {}
        for c in chunks:
            if not c or c[0].isspace() or c[-1].isspace():
                self.inner[c] = b"?"
            elif c[-1] in self.marks and c[:-1].isalpha():
                split.append(c)
                if c[:-1] not in self.inner:
                    new[c[:-1]] = None
            else:
                new[c] = None
        if new:
            self.inner.update(zip(new, self.many([" " + c for c in new])))
        for c in split:
            self.inner[c] = self.inner[c[:-1]] + self.marks[c[-1]]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids for each text, without special tokens added."""
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        off = np.asarray(parts.offsets, np.int64)
        coded = parts.flatten().dictionary_encode()
        at, known = np.asarray(coded.indices, np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [known[i] for i in at[off[:-1]].tolist()]
        if new := {c: None for c in heads if c not in self.first}:
            if len(self.first) + len(new) > CACHE // 8:
                self.first.clear()
                new = dict.fromkeys(heads)
            self.first.update(zip(new, self.many([*new])))
        ids = [*map(self.inner.get, known)]
        if None in ids:
            self.learn([c for c, x in zip(known, ids) if x is None])
            ids = [*map(self.inner.get, known)]
            if None in ids:  # the memory was cleared
                self.learn([c for c, x in zip(known, ids) if x is None])
                ids = [x if x is not None else self.inner[c] for c, x in zip(known, ids)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        odd, size = size == 1, size // 2
        flat = np.frombuffer(b"".join(x for x in ids if len(x) > 1), np.uint16)
        begin = np.cumsum(size) - size
        mine = size[at]
        mine[off[:-1]] = 0
        ends = np.cumsum(mine)
        where = np.repeat(begin[at] - (ends - mine), mine) + np.arange(int(ends[-1]))
        tokens = flat[where]
        strange = (np.add.reduceat(odd[at], off[:-1]) > 0).tolist()
        bound = np.concatenate(([0], ends))[off].tolist()
        return [np.frombuffer(self.plain(texts[i].as_py()), np.uint16) if strange[i] else np.concatenate((np.frombuffer(self.first[c], np.uint16), tokens[bound[i] : bound[i + 1]])) for i, c in enumerate(heads)]


def _fits(spec: dict) -> None:
    """Refuses a tokenizer whose ids the encoder could not give: it must be a plain byte-level BPE with ids in the order of its merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    ok = {
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "normalizer": spec.get("normalizer") is None,
        "pre_tokenizer": before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True),
        "merges": all(i < j for i, j in zip(ids, ids[1:])) and -1 not in ids,
        "vocab": max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))], default=0) < 1 << 16,
        "added_tokens": all(t.get("special") and not any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) for t in spec.get("added_tokens", [])),
    }
    if bad := [k for k, v in ok.items() if not v]:
        raise ValueError(f"the tokenizer's {', '.join(bad)} is not of the kind that can be read")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: np.ndarray, capacity: int, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces: the separator appended, the first piece shorter if need be."""
    whole = np.append(ids, end_id).astype("<u4")
    first = len(whole) % capacity or capacity
    yield 0, whole[:first]
    for start in range(first, len(whole), capacity):
        yield start, whole[start : start + capacity]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in K.pieces_of(batch, "text", 4 << 20):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.batch(K.column(part, "text"))):
                    for k, (start, own) in enumerate(cut(ids, capacity, end_id)):
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own), own.tolist() if with_ids else None))
                cols = [*zip(*rows)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in [*zip(cols, kinds)][: 5 + with_ids]], names=names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Bins:
    """Runs of equal bins by free space, and the placements made so far.

    A placement (length, rank, count, bin, offset) puts the pieces of that length with ranks
    rank..rank+count into the bins bin..bin+count, one each, at that offset.
    """

    def __init__(self, capacity: int):
        self.capacity, self.n, self.placed = capacity, 0, []
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.kinds: list[int] = []

    def put(self, space: int, lo: int, count: int) -> None:
        if space and count:
            if space not in self.free:
                insort(self.kinds, space)
                self.free[space] = []
            self.free[space].append((lo, count))

    def take(self, space: int, most: int) -> tuple[int, int]:
        lo, count = self.free[space].pop()
        if count > most:
            self.free[space].append((lo + most, count - most))
            count = most
        if not self.free[space]:
            del self.free[space]
            self.kinds.remove(space)
        return lo, count

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Places pieces into the fullest bins that hold them; opens new ones when there are none."""
        while count:
            at = bisect_left(self.kinds, length)
            if at == len(self.kinds):
                need = -(-count // (self.capacity // length))
                self.put(self.capacity, self.n, need)
                self.n += need
                continue
            space = self.kinds[at]
            layers = min(space // length, count)
            lo, bins = self.take(space, max(1, count // layers))
            for k in range(layers):
                self.placed.append((length, rank, bins, lo, self.capacity - space + k * length))
                rank, count = rank + bins, count - bins
            self.put(space - layers * length, lo, bins)


def grouped(counts: dict[int, int], groups: int) -> list[list]:
    """Linear grouping: [rounded size, pieces left, [[length, rank, count], ...]] in descending size."""
    total = sum(counts.values())
    each, out = -(-total // groups) if total else 1, []
    room = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if not room:
                if out and out[-1][0] == length:
                    room = each  # equal sizes make one group
                else:
                    out.append([length, 0, []])
                    room = each
            n = min(room, left)
            out[-1][2].append([length, rank, n])
            out[-1][1] += n
            rank, left, room = rank + n, left - n, room - n
    return out


def configuration(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size fill the room best: a bounded knapsack over the few sizes."""
    made: list[tuple[int, int] | None] = [None] * (room + 1)
    made[0] = (-1, 0)
    for g, size in enumerate(sizes):
        if not left[g] or size > room:
            continue
        used = [0] * (room + 1)
        for w in range(size, room + 1):
            if made[w] is None and made[w - size] is not None and used[w - size] < left[g]:
                made[w] = (g, w - size)
                used[w] = used[w - size] + 1
    best = max(w for w in range(room + 1) if made[w] is not None)
    out = [0] * len(sizes)
    while best:
        g, best = made[best]
        out[g] += 1
    return out


def plan(counts: dict[int, int], capacity: int, groups: int = 256, small: float = 0.25) -> tuple[list[tuple], int]:
    """All placements, and the number of bins, from the histogram of lengths."""
    bins = Bins(capacity)
    limit = int(capacity * small)
    sets = grouped({n: c for n, c in counts.items() if n > limit and c}, groups)
    sizes, left = [g[0] for g in sets], [g[1] for g in sets]
    for g in range(len(sets)):
        while left[g]:
            left[g] -= 1
            config = configuration(sizes, left, capacity - sizes[g])
            left[g] += 1
            config[g] += 1
            times = min(left[h] // k for h, k in enumerate(config) if k)
            slots = [h for h, k in enumerate(config) for _ in range(k)]
            parts = []
            for h in slots:  # the actual lengths, longest first
                need, got = times, []
                while need:
                    length, rank, n = run = sets[h][2][0]
                    m = min(n, need)
                    got.append((length, rank, m))
                    run[1], run[2], need = rank + m, n - m, need - m
                    if not run[2]:
                        sets[h][2].pop(0)
                left[h] -= times
                parts.append(got)
            edges = sorted({0, *(int(e) for got in parts for e in np.cumsum([m for _, _, m in got]))})
            at = [(0, 0)] * len(parts)
            for lo, hi in zip(edges, edges[1:]):
                offset = 0
                for s, got in enumerate(parts):
                    k, base = at[s]
                    while base + got[k][2] <= lo:
                        base, k = base + got[k][2], k + 1
                    at[s] = (k, base)
                    length, rank, _ = got[k]
                    bins.placed.append((length, rank + lo - base, hi - lo, bins.n + lo, offset))
                    offset += length
                bins.put(capacity - offset, bins.n + lo, hi - lo)
            bins.n += times
    for length in sorted((n for n, c in counts.items() if n <= limit and c), reverse=True):
        bins.best_fit(length, 0, counts[length])
    return bins.placed, bins.n


def placed(cuts: DataFrame, capacity: int = 2048, groups: int = 256, salts: int | None = None) -> DataFrame:
    """cuts (a stored table of pieces) with the columns sequence_id and offset."""
    found = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}  # at most `capacity` rows
    rows, _ = plan(found, capacity, groups)
    salts = salts or max(8, min(4096, sum(found.values()) // 2_000_000))
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    key = table[:, 0] << 40 | table[:, 1]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            seq = table[at, 3] + rank - table[at, 1] if len(at) else at
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq, pa.int64()), pa.array(table[at, 4] if len(at) else at, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank")).mapInArrow(seek, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, groups: int = 256) -> DataFrame:
    """Packs documents (doc_id, text; further columns are not read) into sequences of `capacity` ids.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is its separator alone; a null doc_id is kept as null; repeated rows
    are packed each; an empty table gives no rows.
    """
    return placed(K.stored(spark, pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, groups)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The ids of every sequence: sequence_id, ids (at most `capacity`), doc_ids in order of place.

    doc_id must be unique here. A sequence holds at most `capacity` pieces, so groups are bounded.
    """
    own = pieces(docs, tokenizer, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    parts = packed.join(own, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
