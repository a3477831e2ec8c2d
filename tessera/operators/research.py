"""Runs of research: what they found, how they hang together, and which candidates a scheduler takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import claim_text, entity_key
from tessera.functions.urls import is_weak_source
from tessera.operators.evidence import checkpoint_dir, group_ranks
from tessera.operators.folds import admissions

# What a scheduler's relations may be, how old their sources, and how grades rank for it.
MAX_AGE_DAYS = {"equity": 730, "license": 730, "supply": 548, "personnel": 548, "compete": 365}
SOURCE_RANK = {"statutory": 4, "independent": 3, "self": 2, "related": 2, "unverified": 0}
REASONS = ("extractorDuplicate", "weakSource", "unverifiedSource", "thinEvidence", "duplicateSource", "invalidEdges", "staleOrUndated", "duplicateRelation", "capacity")
MAX_SIGNALS, MAX_EDGES, MAX_GRAPH, EDGES_EACH, LEAST_TITLE, LEAST_EVIDENCE = 4, 6, 48, 3, 6, 48


def run_completion(runs: DataFrame, run_sources: DataFrame, run_claims: DataFrame, claims: DataFrame) -> DataFrame:
    """(run, sources, claims, corroborated): distinct counts of each run; (run), (run, source), (run, claim), (claim, status)."""
    s = run_sources.groupBy("run").agg(F.countDistinct("source").alias("sources"))
    c = run_claims.distinct().join(claims.select("claim", (F.col("status") == "corroborated").alias("own_")), "claim", "left")
    c = c.groupBy("run").agg(F.count("*").alias("claims"), F.count_if("own_").alias("corroborated"))
    return runs.select("run").join(s, "run", "left").join(c, "run", "left").na.fill(0)


def overview(runs: DataFrame, sources: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """(name, n): the five totals of a research memory."""
    count = lambda df, name, keep=None: (df if keep is None else df.filter(keep)).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count(runs, "runs").union(count(sources, "sources")).union(count(claims, "claims")).union(count(claims, "corroborated", F.col("status") == "corroborated")).union(count(links, "linked"))


def recent(rows: DataFrame, *order: str, most: int = 8) -> DataFrame:
    """The latest rows by the columns of `order`, each descending, ties by the last one ascending."""
    return rows.orderBy(*(F.desc(c) for c in order[:-1]), order[-1]).limit(most)


def query_links(runs: DataFrame, run_sources: DataFrame, run_claims: DataFrame, one: object, last: int = 80, cut: int = 20) -> DataFrame:
    """(run, entity, n_dims, n_sources, n_claims, strength): links from run `one` to the `last` done runs before it.

    runs: (run, entity, dims array, status, completed_at). 42 for the same entity, 9 for each shared
    dimension, 14 for each source, 20 for each claim; 100 at most, from `cut` on. Ties of
    completed_at go by run.
    """
    mine = runs.filter(F.col("run") == one).select(claim_text(F.col("entity")).alias("e_"), F.col("entity").alias("own_"), F.col("dims").alias("d_")).limit(1)
    before = runs.filter((F.col("run") != one) & (F.col("status") == "done")).orderBy(F.desc("completed_at"), "run").limit(last)

    def shared(pairs: DataFrame, item: str) -> DataFrame:
        own = pairs.filter(F.col("run") == one).select(item).distinct()
        return pairs.join(F.broadcast(before.select("run")), "run").join(own, item).groupBy("run").agg(F.countDistinct(item).alias(f"n_{item}s"))  # `last` runs at most

    rows = before.join(F.broadcast(mine), F.lit(True)).join(shared(run_sources, "source"), "run", "left").join(shared(run_claims, "claim"), "run", "left").na.fill(0, ["n_sources", "n_claims"])  # one row against `last`
    same, n_dims = claim_text(F.col("entity")) == F.col("e_"), F.size(F.array_intersect("d_", "dims"))
    strength = F.least(F.lit(100), F.when(same, 42).otherwise(0) + 9 * n_dims + 14 * F.col("n_sources") + 20 * F.col("n_claims"))
    return rows.select("run", F.when(same, F.col("own_")).otherwise("跨主体").alias("entity"), n_dims.alias("n_dims"), "n_sources", "n_claims", strength.alias("strength")).filter(F.col("strength") >= cut)


def grade_summary(candidates: DataFrame, grade: str, status: str) -> DataFrame:
    """One row: how many candidates there are of each grade and each validation status."""
    grades = ("statutory", "independent", "self", "unverified")
    names = (("corroborated", "corroborated"), ("single-source", "single_source"), ("repeated-copy", "repeated_copy"))
    return candidates.agg(*(F.count_if(F.col(grade) == g).alias(g) for g in grades), *(F.count_if(F.col(status) == v).alias(n) for v, n in names))


def counted_entities(old: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, name, first_seen, query_count) after queries (id, name, asked_at): counters go up, name and first sight stay."""
    new = asked.groupBy("id").agg(F.min_by("name", "asked_at").alias("name_"), F.min("asked_at").alias("at_"), F.count("*").alias("n_"))
    both = old.join(new, "id", "full_outer")
    return both.select("id", F.coalesce("name", "name_").alias("name"), F.coalesce("first_seen", "at_").alias("first_seen"), (F.coalesce("query_count", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("query_count"))


def preset_searches(presets: DataFrame, searches: DataFrame) -> DataFrame:
    """Presets (id, last_searched_at, candidates_count, status) after searches (id, at, count, status): counts add up, the last one's time and status stand."""
    new = searches.groupBy("id").agg(F.max("at").alias("at_"), F.sum("count").alias("n_"), F.max_by("status", "at").alias("s_"))
    rows = presets.join(new, "id", "left")
    own = {"last_searched_at": F.coalesce("at_", "last_searched_at"), "candidates_count": F.col("candidates_count") + F.coalesce("n_", F.lit(0)), "status": F.coalesce("s_", "status")}
    return rows.withColumns(own).drop("at_", "n_", "s_")


def preset_listing(presets: DataFrame, scope: str = "all", text: str = "", limit: int = 200) -> DataFrame:
    """Presets of a scope (watchlist, fde, focus or all) that hold a text, watched ones first, then by relevance and name."""
    keep = {"watchlist": F.col("watchlist"), "fde": F.col("has_fde_facts"), "focus": F.col("watchlist") | F.col("has_fde_facts") | (F.col("relevance") == "adjacent")}.get(scope, F.lit(True))
    rows = presets.filter(keep)
    if text.strip():
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "name", F.coalesce("legal_name", F.lit("")), "sector", "city")), F.lit(text.strip().lower())))
    order = F.when(F.col("relevance") == "practitioner", 0).when(F.col("relevance") == "adjacent", 1).when(F.col("relevance") == "vendor", 2).when(F.col("relevance") == "unclear", 3).otherwise(9)
    return rows.orderBy(F.desc("watchlist"), order, F.collate("name", "zh"), "id").limit(limit)


def import_if_new(old: DataFrame, new: DataFrame, have: str | None, version: str) -> DataFrame:
    """The new table if its version differs from the one at hand, else the old one."""
    return old if have == version else new


def edge_key(src: Column, dst: Column, relation: Column, direction: Column) -> Column:
    """relation|from|to, endpoints normalised; in order for relations that have no direction."""
    a, b = entity_key(src), entity_key(dst)
    both = (relation == "compete") | (direction == "mutual")
    return F.concat_ws("|", F.trim(F.coalesce(relation, F.lit(""))), F.when(both, F.least(a, b)).otherwise(a), F.when(both, F.greatest(a, b)).otherwise(b))


def source_rank(grade: Column) -> Column:
    out = F.lit(0)
    for name, rank in SOURCE_RANK.items():
        out = F.when(grade == name, rank).otherwise(out)
    return out


def max_age(relation: Column) -> Column:
    out = F.lit(365)
    for name, days in MAX_AGE_DAYS.items():
        out = F.when(relation == name, days).otherwise(out)
    return out


def scheduled_edges(edges: DataFrame, key: str) -> DataFrame:
    """Edges (key, at, from_node, to_node, relation, suggested, direction) as a scheduler takes them, with edge_key and max_age."""
    clean = lambda c: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, 120)
    told = F.trim(F.coalesce(F.nullif("relation", F.lit("")), "suggested", F.lit("")))
    rows = edges.select(key, "at", clean("from_node").alias("from_node"), clean("to_node").alias("to_node"), told.alias("relation"), F.when(F.col("direction") == "mutual", "mutual").otherwise("forward").alias("direction"))
    rows = rows.filter((F.col("from_node") != "") & (F.col("to_node") != "") & F.col("relation").isin(*MAX_AGE_DAYS))
    return rows.withColumns({"edge_key": edge_key(F.col("from_node"), F.col("to_node"), F.col("relation"), F.col("direction")), "max_age": max_age(F.col("relation"))})


def screened(candidates: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """candidates (grp, key, title, evidence, url, grade, duplicate, dated) with rank, keys and the reason that needs no order.

    Everything but known addresses, known relations and capacity is judged here, row by row;
    late: the reasons that come after those on known addresses. dated: the candidate's latest date.
    """
    own = scheduled_edges(edges, "key").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "edge_key"))), lambda x: x["edge_key"]).alias("keys"), F.min("max_age").alias("days"))
    rows = candidates.join(own, "key", "left").withColumn("keys", F.coalesce("keys", F.expr("cast(array() as array<string>)")))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = rows.withColumns({"url": text("url"), "title": text("title"), "rank": source_rank(F.coalesce("grade", F.lit("unverified")))})
    early = F.when(F.coalesce("duplicate", F.lit(False)), "extractorDuplicate").when((F.col("url") == "") | is_weak_source(F.col("url")), "weakSource").when(F.col("rank") < 2, "unverifiedSource").when((F.length("title") < LEAST_TITLE) | (F.length(text("evidence")) < LEAST_EVIDENCE), "thinEvidence")
    old = F.col("dated").isNull() | (F.date_diff(F.lit(as_of).cast("date"), F.col("dated")) > F.col("days"))
    late = F.when((F.size("keys") == 0) | (F.size("keys") > EDGES_EACH), "invalidEdges").when(old, "staleOrUndated")
    return rows.withColumns({"early": early, "late": late})


def judged(rows: DataFrame, known_urls: DataFrame, known_keys: DataFrame, graph: DataFrame, room: int = MAX_GRAPH) -> DataFrame:
    """screened() rows held against what is known beforehand: verdict (null while open), the fresh keys of their edges and the room left.

    known_urls: (grp, url), known_keys: (grp, edge_key), graph: (grp, n_edges).
    """
    urls = known_urls.filter("trim(url) <> ''").select("grp", F.trim("url").alias("url")).distinct().withColumn("known_", F.lit(True))
    had = rows.join(urls, ["grp", "url"], "left")
    old = had.select("grp", "key", F.posexplode("keys").alias("at", "edge_key")).join(known_keys.select("grp", "edge_key").distinct().withColumn("old_", F.lit(True)), ["grp", "edge_key"], "left")
    fresh = old.filter("old_ is null").groupBy("grp", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "edge_key"))), lambda x: x["edge_key"]).alias("fresh"))
    had = had.join(fresh, ["grp", "key"], "left").withColumn("fresh", F.coalesce("fresh", F.expr("cast(array() as array<string>)")))
    had = had.join(graph.select("grp", F.col("n_edges")), "grp", "left").withColumn("room", F.greatest(F.lit(0), F.lit(room) - F.coalesce("n_edges", F.lit(0))))
    return had.withColumn("verdict", F.coalesce("early", F.when(F.col("known_"), "duplicateSource"), "late", F.when(F.size("fresh") == 0, "duplicateRelation")))


def admitted(rows: DataFrame, known_urls: DataFrame, known_keys: DataFrame, graph: DataFrame, most: int = MAX_SIGNALS, edges: int = MAX_EDGES, room: int = MAX_GRAPH) -> DataFrame:
    """(grp, key, place, verdict, novel) of screened() rows taken in order within each group.

    The best source first, then the latest, then by title. A candidate whose address, or whose
    relations, are known by then is a duplicate; caps do not stop the scan. Only rows that judged()
    leaves open go through the rounds of admissions() and have a place; the others are held against
    the addresses of the few accepted before them. What is judged is kept by a checkpoint, so the
    inputs are read once.
    """
    checkpoint_dir(rows.sparkSession)
    had = judged(rows, known_urls, known_keys, graph, room)
    none = F.expr("cast(array() as array<string>)")
    by = F.struct(-F.col("rank"), F.coalesce(-F.unix_date("dated"), F.lit(1 << 30)).alias("days"), "title", "key")
    had = had.select("grp", "key", "url", "early", "verdict", by.alias("by"), F.col("fresh").alias("items"), "room").checkpoint()
    open_ = had.filter("verdict is null").select("grp", "key", "by", F.col("url").alias("source"), "items", "room")
    names = {"known-source": "duplicateSource", "nothing-novel": "duplicateRelation"}
    taken = admissions(open_, most, edges)
    verdict = F.col("verdict")
    for old, new in names.items():
        verdict = F.when(F.col("verdict") == old, new).otherwise(verdict)
    placed = group_ranks(open_.select("grp", "key", "by"), "grp", "by", "place").select("grp", "key", "place")
    told = taken.select("grp", "key", verdict.alias("verdict"), F.when(F.col("verdict") == "accepted", F.col("novel")).otherwise(none).alias("novel"))
    folded = told.join(placed, ["grp", "key"]).select("grp", "key", "place", "verdict", "novel")
    first = taken.filter("verdict = 'accepted'").groupBy("grp", F.col("source").alias("url")).agg(F.min("by").alias("by_"))
    rest = had.filter("verdict is not null").join(first, ["grp", "url"], "left")
    late = F.col("early").isNull() & F.coalesce(F.col("by_") < F.col("by"), F.lit(False))
    return folded.union(rest.select("grp", "key", F.lit(None).cast("long"), F.when(late, "duplicateSource").otherwise(F.col("verdict")), none))


def rejections(verdicts: DataFrame) -> DataFrame:
    """(reason, n): how often each reason turned a candidate down."""
    return verdicts.filter("verdict <> 'accepted'").groupBy(F.col("verdict").alias("reason")).agg(F.count("*").alias("n"))
