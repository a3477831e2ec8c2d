"""Toxicity by weak supervision: a generative label model over many voters, then a linear classifier.

Voters are the words of a fixed lexicon and the patterns (beginnings of words, whole words)
that a bounded sample of labelled texts shows to go with toxicity. Each voter fires or
abstains; no voter is right for sure, and neither is a given label, which is one voter among
the others. The label model is generative: given the class, each voter fires at its own rate
(its accuracy), and voters' residuals correlate, so voters that fire together do not count
twice. Expectation-maximisation gives a posterior for every sampled text. A logistic
regression over counts of the selected patterns is trained on these posteriors; it alone
scores texts, and reads nothing but the text.

Scoring is one pass without a shuffle. The model is a few thousand hashes and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K

#: Fixed lexicon of the word voters.
LEXICON = ("clown disgusting dumb filthy fool garbage hate idiot idiotic imbecile jerk kill loser moron pathetic pig scum shut stupid trash ugly vermin worthless "
           "dumm idiota imbécile idiote dreck abschaum basura estúpido asqueroso ordure stupide dégoûtant").split()
#: Lengths in bytes of the beginnings of words that serve as patterns, besides whole words.
HEADS = (4, 5, 6, 7, 8, 9)


def patterns(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of all patterns, one kind after the other; first the whole words."""
    data = K.ascii_lower(data)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    starts, ends = K.spans_of(letter, off)
    row = np.searchsorted(off, starts, "right") - 1
    h = K.prefix(data)
    yield row, K.substring_hash(h, starts, ends)
    for n in HEADS:
        long = ends - starts > n
        yield row[long], K.substring_hash(h, starts[long], starts[long] + n) ^ np.uint64(n)


@dataclass(frozen=True)
class Model:
    """Sorted pattern hashes with their weights, the weight of a word, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    per_word: float
    bias: float

    def __call__(self, col: pa.Array) -> np.ndarray:
        """Scores from 0 to 1."""
        data, off = K.buffers(col)
        total, words = np.zeros(len(col)), np.zeros(len(col))
        maybe = np.zeros(1 << 16, bool)
        maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        for kind, (row, h) in enumerate(patterns(data, off)):
            if not kind:
                words = np.bincount(row, minlength=len(col)).astype(float)
            hit = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
            same = self.keys[at] == h[hit]
            total += np.bincount(row[hit[same]], weights=self.weights[at[same]], minlength=len(col))
        z = total + self.per_word * words + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def label_model(votes: np.ndarray, given: np.ndarray, prior: float, rounds: int = 15) -> np.ndarray:
    """The posterior of label 1 for each row of 0/1 votes; given: the labels, a voter of unknown accuracy.

    M-step: how often each voter fires under either class, how the voters' residuals correlate
    within the classes, and how accurate the given labels are. E-step: a vote, or its absence,
    counts with its log-likelihood ratio divided by the number of voters it effectively moves
    with (one and its positive correlations).
    """
    x = votes.astype(float)
    n = len(x)
    q = np.where(given > 0, 0.95, 0.2 * prior)
    for t in range(rounds):
        s1, s0 = q.sum() + 1e-9, (1 - q).sum() + 1e-9
        p1, p0 = (q @ x + 0.05) / (s1 + 0.1), ((1 - q) @ x + 0.05) / (s0 + 0.1)
        r = x - np.outer(q, p1) - np.outer(1 - q, p0)
        sd = np.sqrt((r * r).mean(0)) + 1e-6
        moves = np.maximum((r / sd).T @ (r / sd) / n, 0)
        if t < 2:  # wrong labels look like correlation until the posteriors have settled
            moves[:] = 0
        np.fill_diagonal(moves, 1)
        fires, rests = (np.clip(np.log(u / v), -4, 8) / moves.sum(1) for u, v in ((p1, p0), (1 - p1, 1 - p0)))
        hit1 = np.clip((q @ (given > 0) + 1) / (s1 + 2), 0.6, 0.98)
        hit0 = np.clip(((1 - q) @ (given > 0) + 1) / (s0 + 2), 0.002, 0.3)
        said = np.where(given > 0, np.log(hit1 / hit0), np.log((1 - hit1) / (1 - hit0)))
        share = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        q = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + np.clip(x @ (fires - rests) + rests.sum(), -12, 12) + said, -30, 30)))
    return q


def train(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, voters: int = 128, features: int = 3000, support: int = 6) -> Model:
    """The classifier from a sample; weight restores each row's share in the whole."""
    n, toxic, words = len(texts), toxic > 0, np.zeros(len(texts))
    found: list[list[tuple]] = [[] for _ in range(1 + len(HEADS))]
    base = 0
    for part in K.pieces_of(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20):
        for kind, (row, h) in enumerate(patterns(*K.buffers(part.column(0)))):
            found[kind].append(((row + base).astype(np.int32), h))
        base += part.num_rows
    lexicon = np.unique(np.array([K.substring_hash(K.prefix(b), np.array([0]), np.array([len(b)]))[0] for b in (np.frombuffer(w.encode(), np.uint8) for w in LEXICON)], np.uint64))
    keys, gains, entries = [], [], []
    for kind in range(len(found)):  # one kind at a time bounds the memory
        row, h = (np.concatenate(x) for x in zip(*found[kind])) if found[kind] else (np.zeros(0, np.int32), np.zeros(0, np.uint64))
        found[kind] = []
        if not kind:
            words = np.bincount(row, minlength=n).astype(float)
        order = np.lexsort((row, h))
        row, h = row[order], h[order]
        at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(h)))
        row, h = row[at], h[at]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else at
        code = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        pos = np.bincount(code, toxic[row], len(first))
        rate1 = np.bincount(code, toxic[row] * count, len(first)) + 0.5
        rate0 = np.bincount(code, ~toxic[row] * count, len(first)) + 0.5
        ratio = np.log(rate1 / max(1.0, words[toxic].sum())) - np.log(rate0 / max(1.0, words[~toxic].sum()))
        gain = np.where(pos >= support, np.maximum(ratio, 0) * pos, 0)
        use = ((gain > 0) | np.isin(h[first], lexicon))[code]
        keys.append(h[first][gain > 0])
        gains.append(gain[gain > 0])
        entries.append((row[use], h[use], count[use]))
    keys, gains = np.concatenate(keys), np.concatenate(gains)
    row, h, count = (np.concatenate(x) for x in zip(*entries))
    best = np.argsort(-gains, kind="stable")[:features]
    chosen = np.unique(np.concatenate((keys[best], lexicon)))
    slot = np.searchsorted(chosen, h)
    slot[slot == len(chosen)] = 0
    use = chosen[slot] == h
    r, c, v = row[use].astype(np.int64), slot[use], count[use].astype(float)
    lead = np.unique(np.concatenate((keys[best[:voters]], lexicon)))
    votes = np.zeros((n, len(lead)), bool)
    place = np.searchsorted(lead, chosen)
    place[place == len(lead)] = 0
    is_voter = lead[place] == chosen
    dense = np.array(v >= 1) & is_voter[c]
    votes[r[dense], place[c[dense]]] = True
    fired = votes.any(0)
    prior = float((weight * toxic).sum() / max(weight.sum(), 1e-9))
    q = label_model(votes[:, fired], toxic.astype(int), max(prior, 1e-3)) if n else np.zeros(0)
    return _logistic(chosen, r, c, v, words, q, weight)


def _logistic(chosen: np.ndarray, r: np.ndarray, c: np.ndarray, v: np.ndarray, words: np.ndarray, q: np.ndarray, weight: np.ndarray, rounds: int = 800) -> Model:
    """Full-batch Adam on posterior labels; counts enter as they are, since evidence adds up with each word."""
    n, d = len(q), len(chosen)
    w, g1, g2 = np.zeros(d + 2), np.zeros(d + 2), np.zeros(d + 2)
    scale = max(words.mean(), 1.0) if n else 1.0
    length, weight = words / scale, weight / max(weight.mean(), 1e-9) if n else weight
    for t in range(1, rounds + 1 if n else 1):
        z = np.bincount(r, w[c] * v, n) + w[d] * length + w[d + 1]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q)
        g = np.append(np.bincount(c, e[r] * v, d), [e @ length, e.sum()]) / n
        g[:d] += 2e-5 * w[:d]
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        w -= 0.05 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-9)
        w[:d] = np.maximum(w[:d], 0)  # a pattern chosen as a sign of toxicity never speaks against it
        w[d] = min(w[d], 0.0)
    return Model(chosen, w[:d], w[d] / scale, float(w[d + 1]) if n else -3.0)


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, more: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, labels, weights, more) of at most `rows` labelled texts of each class, drawn by a hash of doc_id.

    The drawn ids (at most 2 * rows, each once) are broadcast to the scan of docs, of whose rows
    with one doc_id the one with the least text counts, so that no repeats bring more to the
    driver: 2 * rows texts, and of these `more` columns (numbers). Weights restore the classes' shares.
    """
    known = labels.filter(f"{label} in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows) for y in (0, 1)]
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    got = own.groupBy("doc_id").agg(F.min(F.struct("text", *more, "label")).alias("b")).select("doc_id", "b.*").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    y = np.asarray(got["label"].combine_chunks(), np.int64) if got.num_rows else np.zeros(0, np.int64)
    seen = np.bincount(y, minlength=2)
    weight = np.array([total.get(k, 0) / max(1, seen[k]) for k in (0, 1)])[y]
    text = got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string())
    side = np.stack([np.asarray(got[c].combine_chunks(), float) for c in more], 1) if more and got.num_rows else np.zeros((got.num_rows, len(more)))
    return (text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text if isinstance(text, pa.Array) else pa.array([], pa.string())), y, weight, side


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 2000) -> Model:
    """Learns from at most `rows` texts of each class; labels (doc_id, <label>) holds the rows to learn from only."""
    return train(*sampled(docs, labels, label, rows)[:3])


def scored(docs: DataFrame, model) -> DataFrame:
    """docs' doc_id with a score for every row. A null text scores like an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces_of(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model(K.column(part, "text")), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = 0.7, rows: int = 2000) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Labels are read only for rows whose crc32(doc_id as text) mod `folds` is not `held`; of each
    class at most `rows` of them train the model. Null and empty texts get the score of a text
    without words; a null doc_id is not held out; repeated rows are scored each; without labels
    the score is that of the prior; an empty table gives no rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs, labels.filter(fold != held), "toxic", rows)
    return scored(docs, model).select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
