"""Signals: extracted candidates that may stay, signals from a profile's facts, their order, tables about them, and merges of filed facts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import gates
from tessera.functions.dates import latest_observed_date
from tessera.functions.proposals import entity_kind
from tessera.functions.text import bracketed_label, mentioned_years, round_half_up

# Relations, what an extraction may hold at most, and how many signals of a kind are made from facts.
RELATIONS = ("equity", "supply", "compete", "personnel", "license")
MOST_CANDIDATES, LEAST_EVIDENCE, NAME, QUOTE, TITLE, EVIDENCE = 12, 20, 120, 600, 200, 4000
QUOTAS, SEEDS, EACH = {"investor": 14, "holder": 10, "customer": 12, "fde": 6}, 48, 2
FILED_RANK = {"statutory": 4, "independent": 3, "self": 2, "unverified": 1}
HOLDER = r"([A-Za-z][A-Za-z0-9,.&()\- ]{2,60}?|[\x{4E00}-\x{9FA5}（）()]{2,20})\s*(\d+(?:\.\d+)?)\s*%"


def known_relation(told: Column) -> Column:
    return F.when(told.isin(*RELATIONS), told).otherwise("unclustered")


def extracted(candidates: DataFrame) -> DataFrame:
    """What may stay of extracted candidates (doc, place, title, evidence, relation, edges array<struct<src, dst, relation, direction, quote, src_kind, dst_kind>>).

    The first MOST_CANDIDATES of a document; texts cut to their limits; edges without an end or
    onto themselves go, candidates without title, with thin evidence or without edges too.
    """
    cut = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    rows = candidates.withColumn("k_", F.row_number().over(Window.partitionBy("doc").orderBy("place"))).filter(F.col("k_") <= MOST_CANDIDATES)

    def edge(e: Column) -> Column:
        src, dst = cut(e["src"], NAME), cut(e["dst"], NAME)
        told = known_relation(F.coalesce(e["relation"], F.col("relation")))
        return F.struct(src.alias("src"), dst.alias("dst"), told.alias("relation"), F.when(e["direction"] == "mutual", "mutual").otherwise("forward").alias("direction"), cut(e["quote"], QUOTE).alias("quote"), entity_kind(src, e["src_kind"]).alias("src_kind"), entity_kind(dst, e["dst_kind"]).alias("dst_kind"))

    kept = F.filter(F.transform("edges", edge), lambda e: (e["src"] != "") & (e["dst"] != "") & (e["src"] != e["dst"]))
    rows = rows.select("doc", "place", cut("title", TITLE).alias("title"), cut("evidence", EVIDENCE).alias("evidence"), known_relation(F.coalesce("relation", F.get(F.col("edges"), F.lit(0))["relation"])).alias("relation"), kept.alias("edges"))
    return rows.filter((F.col("title") != "") & (F.length("evidence") >= LEAST_EVIDENCE) & (F.size("edges") > 0))


def by_event_date(signals: DataFrame, text: Column, as_of: str, key: str) -> DataFrame:
    """Signals with event_date, the latest first, those without a date last, ties by key."""
    return signals.withColumn("event_date", latest_observed_date(text, as_of)).orderBy(F.col("event_date").desc_nulls_last(), key)


def holder_names(value: Column, most: int = 4, least: float = 5.0) -> Column:
    """The names before percentages of `least` and more, in order; a text of holders can not be split at commas."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), "截至[^：:]*[：:]\\s*", "")
    part = lambda k: F.regexp_extract_all(text, F.lit(HOLDER), F.lit(k))
    rows = F.transform(F.arrays_zip(part(1).alias("n"), part(2).alias("p")), lambda x: F.struct(F.trim(x["n"]).alias("n"), x["p"].cast("double").alias("p")))
    good = F.filter(rows, lambda x: (x["p"] >= least) & (F.length(x["n"]) >= 2) & ~x["n"].rlike(r"^(\d|股份|口径|截至)"))
    return F.slice(F.transform(good, lambda x: x["n"]), 1, most)


def seeds(facts: DataFrame, names: Column, kind: str, quota: int, each: int = EACH) -> DataFrame:
    """(kind, company, at, other) for the first names of each company in order, `each` at most and `quota` in all.

    facts: (place, company, value) of one field from usable sources; place is the companies' order.
    The quota is a feature: a workspace starts with a handful of each kind.
    """
    rows = facts.select("place", "company", F.posexplode(F.slice(names, 1, each)).alias("at", "other"))
    return rows.orderBy("place", "at").limit(quota).select(F.lit(kind).alias("kind"), "company", "at", "other")


def merged_seeds(parts: list[DataFrame], titles: Column, source: Column, most: int = SEEDS) -> DataFrame:
    """The parts in order without repeats of (title, source), `most` at most."""
    rows = parts[0].withColumn("part_", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("part_", F.lit(i)))
    rows = rows.withColumns({"title": titles, "source_": source})
    first = rows.withColumn("r_", F.row_number().over(Window.partitionBy("title", "source_").orderBy("part_", "company", "at"))).filter("r_ = 1")
    return first.orderBy("part_", "company", "at").limit(most).drop("r_", "part_", "source_")


def relation_summary(signals: DataFrame, feedback: DataFrame) -> DataFrame:
    """(relation, admitted, mean, confirmed, counter, confidence): signals (signal, relation, admitted, probability), feedback (signal, verdict, quality).

    Only feedback of LEAST_QUALITY and more counts.
    """
    base = signals.filter("admitted").groupBy("relation").agg(F.count("*").alias("admitted"), F.avg("probability").alias("mean"))
    told = feedback.filter(F.col("quality") >= gates.LEAST_QUALITY).join(signals.select("signal", "relation"), "signal").groupBy("relation").agg(F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") == "counter").alias("counter"))
    out = base.join(told, "relation", "left").na.fill(0, ["confirmed", "counter"])
    return out.select("relation", "admitted", F.round("mean", 6).alias("mean"), "confirmed", "counter", gates.relation_confidence(F.col("mean"), F.col("confirmed"), F.col("counter")).alias("confidence"))


def calibration(outcomes: DataFrame) -> DataFrame:
    """One row: n and the rounded mean Brier score of outcomes (verdict, quality, brier) that can be attributed and are decided."""
    own = outcomes.filter((F.col("quality") >= gates.LEAST_QUALITY) & (F.col("verdict") != "watching"))
    return own.agg(F.count("*").alias("n"), round_half_up(F.avg("brier")).alias("mean_brier"))


def salvage_table(rows: DataFrame) -> DataFrame:
    """(stars, n, salvageable, rate, independent): how many cards of each star have evidence and a source of a known kind; rows (stars, has_evidence, source_kind)."""
    saved = F.col("has_evidence") & (F.col("source_kind") != "unknown")
    out = rows.groupBy("stars").agg(F.count("*").alias("n"), F.count_if(saved).alias("salvageable"), F.count_if(F.col("source_kind") == "independent").alias("independent"))
    return out.withColumn("rate", F.round(F.col("salvageable") / F.col("n"), 6)).orderBy(F.col("stars").desc_nulls_last())


def channel_table(rows: DataFrame) -> DataFrame:
    """(channel, cards, independent, related, unknown, rate) of the cards with evidence, the best share of independent sources first."""
    kind = lambda k: F.count_if(F.col("source_kind") == k).alias(k)
    other = F.count_if(~F.col("source_kind").isin("independent", "related")).alias("unknown")
    out = rows.filter("has_evidence").groupBy("channel").agg(F.count("*").alias("cards"), kind("independent"), kind("related"), other)
    return out.withColumn("rate", F.round(F.col("independent") / F.col("cards"), 6)).orderBy(F.desc("rate"), "channel")


def gate_tiers(cards: DataFrame, tiers: list[tuple[str, dict[str, Column]]], states) -> DataFrame:
    """(tier, place, n, executable, gate_1 .. gate_6): what would pass with ever more fields filled.

    tiers: (name, values by column) as they add up; each tier's values replace the card's own, and
    the gates are judged anew by states, a function of a column lookup. Cards are read once.
    """
    cells = []
    for i, (name, patch) in enumerate(tiers):
        value = lambda c, patch=patch: patch.get(c, F.col(c))
        cells.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("tier"), states(value).alias("states")))
    rows = cards.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    each = [F.count_if(F.get("states", F.lit(k))).alias(f"gate_{k + 1}") for k in range(6)]
    return rows.groupBy("place", "tier").agg(F.count("*").alias("n"), F.count_if(gates.executable(F.col("states"))).alias("executable"), *each)


def merged_filings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(company, name, ticker, filing, place): companies after a run; both sides are (company, place, name, ticker, filing, keep_filing).

    The new name; the old ticker where the new one is missing; the new filing unless the run says
    to keep the old one. The old order stays, what is new comes behind.
    """
    a = old.select("company", F.struct("place", "name", "ticker", "filing").alias("o"))
    b = new.select("company", F.struct("place", "name", "ticker", "filing", "keep_filing").alias("n"))
    rows = a.join(b, "company", "full_outer")
    keep = F.col("o").isNotNull() & (F.col("n").isNull() | F.coalesce("n.keep_filing", F.lit(False)))
    order = F.struct(F.col("o").isNull(), F.coalesce("o.place", "n.place"), "company")
    rows = rows.select("company", F.when(F.col("n").isNull(), F.col("o.name")).otherwise(F.col("n.name")).alias("name"), F.coalesce("n.ticker", "o.ticker").alias("ticker"), F.when(keep, F.col("o.filing")).otherwise(F.col("n.filing")).alias("filing"), order.alias("place"))
    return rows


def merged_facts(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("company", "dimension", "field"), grade: str = "grade") -> DataFrame:
    """By company, dimension and field the new fact, unless its grade is lower than the old one's; in the order of the keys."""
    rank = F.lit(0)
    for name, r in FILED_RANK.items():
        rank = F.when(F.col(grade) == name, r).otherwise(rank)
    both = old.withColumn("turn_", F.lit(0)).unionByName(new.withColumn("turn_", F.lit(1)))
    names = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(rank, "turn_")).alias("b")).select(*keys, "b.*")


def kept_failures(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Failures (id, name, why) after a run: old ones of companies that it did not touch, or without an id, and all new ones."""
    return old.filter("id is null or id = ''").unionByName(old.filter("id <> ''").join(touched.select("id").distinct(), "id", "left_anti")).unionByName(new)


def newest(old: str | None, new: str) -> str:
    return max(old or "", new)


def count_by_grade(facts: DataFrame, grade: str = "grade") -> DataFrame:
    return facts.groupBy(F.col(grade).alias("grade")).agg(F.count("*").alias("n"))


def timeline(facts: DataFrame) -> DataFrame:
    """(dimension, year, n): in how many facts (dimension, value) of a dimension each year from 2000 to 2030 is mentioned."""
    rows = facts.select("dimension", F.explode(mentioned_years(F.col("value").cast("string"))).alias("year"))
    return rows.groupBy("dimension", F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"))


def billing_network(profiles: DataFrame) -> DataFrame:
    """(sector, billing, n): counts of sectors, of ways of billing, and of both together; null stands for all.

    profiles: (sector, label, value). The label counts, else what stands before a bracket; profiles without a value are left out.
    """
    own = profiles.filter(F.coalesce("value", F.lit("")) != "").select(F.coalesce(F.nullif("sector", F.lit("")), F.lit("未归类")).alias("sector"), F.substring(F.coalesce(F.nullif("label", F.lit("")), bracketed_label(F.col("value"), 1000)), 1, 16).alias("billing"))
    return own.groupingSets([["sector"], ["billing"], ["sector", "billing"]], "sector", "billing").agg(F.count("*").alias("n"))


def layout(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, component, x, y): a place within 0..1 for every node, each component laid out by itself, then set into rows.

    nodes: (node, degree), edges: (src, dst), parts: (node, component). Connected nodes draw
    together, others push apart, from places that a hash of the name gives, so that equal input
    gives equal places. A component meets in one task: a drawing is for components of a few
    hundred nodes. Components go into rows by size, whole, half or quarter width; only their sizes reach the driver.
    """
    ends = edges.join(parts, edges["src"] == parts["node"]).groupBy("component").agg(F.collect_set(F.struct("src", "dst")).alias("edges"))
    own = parts.join(nodes, "node").groupBy("component").agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "node"))).alias("nodes")).join(ends, "component", "left")

    def unit(s: str) -> float:
        v = 2166136261
        for c in s.encode("utf-16-le")[::2] if s.isascii() else [ord(c) for c in s]:
            v = ((v ^ c) * 16777619) & 0xFFFFFFFF
        return v / 4294967295

    def place(batch: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        for component, listed, links in zip(batch["component"], batch["nodes"], batch["edges"]):
            ids = [n["node"] for n in listed]
            n, at = len(ids), {x: i for i, x in enumerate(ids)}
            turn = np.array([unit(str(x)) for x in ids]) * 2 * math.pi
            p = 0.5 + 0.22 * np.stack((np.cos(turn), np.sin(turn)), 1)
            area, rest = 0.42 / math.sqrt(n), 0.2 if n <= 3 else 0.16
            pairs = np.array([(at[e["src"]], at[e["dst"]]) for e in (links if links is not None else []) if e["src"] != e["dst"]], int).reshape(-1, 2)
            for _ in range(0 if n < 2 else 90 if n < 12 else 130):
                gap = p[:, None] - p[None]
                far = np.maximum(np.hypot(gap[..., 0], gap[..., 1]), 1e-4)
                move = (gap / far[..., None] * np.minimum(0.04, area * area / far * 0.045)[..., None]).sum(1)
                pull = p[pairs[:, 1]] - p[pairs[:, 0]]
                size = np.maximum(np.hypot(pull[:, 0], pull[:, 1]), 1e-4)
                step = pull / size[:, None] * ((size - rest) * 0.055)[:, None]
                np.add.at(move, pairs[:, 0], step)
                np.add.at(move, pairs[:, 1], -step)
                move += (0.5 - p) * 0.02
                size = np.hypot(move[:, 0], move[:, 1])
                p += move * np.minimum(1, 0.045 / np.maximum(size, 1e-9))[:, None]
            low, span = p.min(0), np.maximum(0.001, p.max(0) - p.min(0))
            p = 0.08 + (p - low) / span * 0.84 if n > 1 else np.array([[0.5, 0.5]])
            out += [(x, component, *map(float, q)) for x, q in zip(ids, p)]
        return pd.DataFrame(out, columns=["node", "component", "lx", "ly"])

    kinds = dict(parts.dtypes)
    local = own.mapInPandas(lambda it: (place(b) for b in it), f"node {kinds['node']}, component {kinds['component']}, lx double, ly double")
    bins: list[list] = []
    for r in parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").collect():
        slot = 1.0 if r["n"] >= 7 else 0.5 if r["n"] >= 4 else 0.25
        row = next((b for b in bins if b[0] + slot <= 1.0001), None)
        if row is None:
            bins.append(row := [0.0, 0, []])
        row[2].append((r["component"], row[0], slot))
        row[0], row[1] = row[0] + slot, max(row[1], r["n"])
    height = [280 if b[1] >= 10 else 235 if b[1] >= 7 else 185 if b[1] >= 4 else 150 for b in bins]
    total, top, slots = max(1, sum(height)), 0.0, []
    for b, h in zip(bins, height):
        slots += [(c, left, slot, top, h / total) for c, left, slot in b[2]]
        top += h / total
    table = edges.sparkSession.createDataFrame(slots, f"component {kinds['component']}, left_ double, slot double, top_ double, height double")
    inside = lambda c: F.least(F.lit(0.975), F.greatest(F.lit(0.025), c))
    x, y = F.col("left_") + F.col("slot") * (F.col("lx") * 0.84 + 0.08), F.col("top_") + F.col("height") * (F.col("ly") * 0.76 + 0.12)
    return local.join(table, "component").select("node", "component", inside(x).alias("x"), inside(y).alias("y"))
