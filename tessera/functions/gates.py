"""Admission gates, candidate scores and outcome attribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import is_placeholder, keyword_hits, round_half_up

LEAST_EVIDENCE, LEAST_QUALITY, RATE = 20, 60, 0.08
WEIGHT_MIN, WEIGHT_MAX = 12.0, 40.0
# The words of the four dimensions, and what each open gate asks for.
DIMENSION_WORDS = {
    "capital": ("持股", "股权", "投资", "增资", "认购", "并购", "收购", "控股", "基金", "融资"),
    "supply": ("供应", "采购", "订单", "代工", "产能", "交付", "物料", "中标", "合同", "独家"),
    "compete": ("竞争", "替代", "抢单", "降价", "同类", "对标", "份额", "挖角", "转单", "平替"),
    "personnel": ("任职", "兼任", "董事", "高管", "离职", "专利", "授权", "研发", "联合", "团队"),
}
GATES = ("evidence", "scope", "epistemic", "falsifier", "source", "signature")


def gate_states(evidence: Column, source: Column, scope: list[Column], state: Column, falsifier: Column, counter: Column, source_type: Column, until: Column, expired: Column, human: Column, signed: Column) -> Column:
    """array<boolean> of the six gates, in the order of GATES. Nulls count as blank."""

    def full(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) != ""

    inside = F.lit(True)
    for c in scope:
        inside = inside & ~is_placeholder(c)
    told = F.coalesce(source_type, F.lit("unknown"))
    return F.array(
        (F.length(F.trim(F.coalesce(evidence, F.lit("")))) >= LEAST_EVIDENCE) & full(source),
        inside,
        full(state),
        full(falsifier) & full(counter),
        (told != "unknown") & full(until) & ~expired & ((told != "internal") | full(human)),
        F.coalesce(signed, F.lit(False)),
    )


def passed(states: Column) -> Column:
    return F.size(F.filter(states, lambda x: x))


def executable(states: Column) -> Column:
    return F.forall(states, lambda x: x)


def missing(states: Column) -> Column:
    """The names of the gates that are open, in order."""
    return F.filter(F.transform(states, lambda x, i: F.when(~x, F.element_at(F.array(*map(F.lit, GATES)), i + 1))), lambda x: x.isNotNull())


def dimension_scores(text: Column, evidence: Column, words=DIMENSION_WORDS) -> Column:
    """35, up to 20 for the length of the evidence and 12 for each word of the dimension; 96 at most."""
    depth = F.least(F.lit(20), F.floor(F.length(F.trim(evidence)) / 14))
    return F.array(*(F.least(F.lit(96), 35 + depth + 12 * F.size(keyword_hits(text, w))).cast("int") for w in words.values()))


def candidate_score(scores: Column, weights: list[float]) -> Column:
    total = sum((F.element_at(scores, i + 1) * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))
    return round_half_up(total / 100).cast("int")


def normalize_weights(weights: Column) -> Column:
    """Each between WEIGHT_MIN and WEIGHT_MAX, then to 100 in all, rounded (so 99 to 101 in sum)."""
    held = F.transform(weights, lambda w: F.greatest(F.lit(WEIGHT_MIN), F.least(F.lit(WEIGHT_MAX), w)))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    return F.transform(held, lambda w: round_half_up(w / total * 100).cast("double"))


def direction(verdict: Column, quality: Column) -> Column:
    return F.when(quality < LEAST_QUALITY, 0).when(verdict == "confirmed", 1).when(verdict == "counter", -1).otherwise(0)


def next_weights(weights: Column, scores: Column, way: Column) -> Column:
    """The weights after an outcome: away from, or towards, the dimensions that stood out."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    moved = F.zip_with(weights, scores, lambda w, s: w + way * (s - mean) * RATE)
    return F.when(way == 0, weights).otherwise(normalize_weights(moved))


def brier(probability: Column, verdict: Column) -> Column:
    """The squared error in percent; a case still watched has none."""
    actual = F.when(verdict == "confirmed", 1.0).when(verdict == "counter", 0.0).otherwise(probability / 100)
    return round_half_up(F.pow(probability / 100 - actual, 2) * 100).cast("int")


def relation_confidence(mean: Column, confirmed: Column, counter: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(99), round_half_up(mean) + 3 * confirmed - 5 * counter)).cast("int")


def clamp_probability(p: Column) -> Column:
    return F.greatest(F.lit(5), F.least(F.lit(95), round_half_up(p))).cast("int")
