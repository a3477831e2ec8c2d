"""Repeats, corroboration, the market map and the relation graph."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import MATERIAL_LIMIT, normalize_corpus, scale_numbers


def with_ranges(rows: DataFrame, name: str, *order: str, ranges: int | None = None) -> DataFrame:
    """rows with `name`, the number of the range of the columns' order that a row falls into.

    Ranges hold about equally many rows. The bounds come from a sample of 20 rows or so for each
    range, those whose order has small hashes: the same ones however often Spark looks for them,
    and all that moves. Rows of equal order share a range.
    """
    order = tuple(dict.fromkeys(order))
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, steps = rows.agg(F.count("*").alias("n")), 1 << 40
    sample = rows.select(*order).filter(F.pmod(F.xxhash64(*order), F.lit(steps)).cast("double") * total.scalar() < float(20 * ranges * steps)).distinct()
    bounds = sample.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("k")).select(F.filter("k", lambda _, i: i % 20 == 19))
    own = rows.withColumn("bounds_", bounds.scalar())
    return own.withColumn(name, F.size(F.filter("bounds_", lambda b: b <= F.struct(*order)))).drop("bounds_")


def group_ranks(rows: DataFrame, group: str, order: str, name: str, ranges: int | None = None) -> DataFrame:
    """rows with `name`, their place (from 1) in the order of their group, which no two of its rows share.

    Places count within ranges of the order, and the sizes of earlier ranges are added, so that a
    group of any size is spread over all tasks.
    """
    own = with_ranges(rows, "range_", order, ranges=ranges).repartition(F.col(group), F.col("range_"))
    ranked = own.withColumn("rank_", F.row_number().over(Window.partitionBy(group, "range_").orderBy(order)))
    parts = own.groupBy(F.col(group).alias("f_"), F.col("range_").alias("g_")).agg(F.count("*").alias("n_"))
    earlier = Window.partitionBy("f_").orderBy("g_").rowsBetween(Window.unboundedPreceding, -1)
    known = parts.select("f_", "g_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("prior_"))
    out = ranked.join(known, F.col(group).eqNullSafe(F.col("f_")) & (F.col("range_") == F.col("g_")))
    return out.withColumn(name, F.col("prior_") + F.col("rank_")).drop("range_", "rank_", "f_", "g_", "prior_")


def repeat_verdict(sightings: DataFrame, fingerprint: str, seen_at: str, key: str, source: str, ranges: int | None = None) -> DataFrame:
    """For each sighting: how often its text was seen before, and whether first elsewhere.

    Ties of seen_at go by key. first_key, first_source and differs are null without a prior
    sighting; sources are compared trimmed, and with the first one only. A fingerprint's sightings
    are ranked range by range of (seen_at, key), and the counts of earlier ranges are added, so a
    text that stands in a third of all rows is spread over all tasks.
    """
    own = with_ranges(sightings, "range_", seen_at, key, ranges=ranges).repartition(F.col(fingerprint), F.col("range_"))
    ranked = own.withColumn("rank_", F.row_number().over(Window.partitionBy(fingerprint, "range_").orderBy(seen_at, key)))
    parts = own.groupBy(F.col(fingerprint).alias("f_"), F.col("range_").alias("g_")).agg(F.count("*").alias("n_"), F.min(F.struct(F.col(seen_at).alias("t"), F.col(key).alias("k"), F.col(source).alias("s"))).alias("first_"))
    earlier = Window.partitionBy("f_").orderBy("g_").rowsBetween(Window.unboundedPreceding, -1)
    known = parts.select("f_", "g_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("prior_"), F.min("first_").over(Window.partitionBy("f_")).alias("first_"))
    out = ranked.join(known, F.col(fingerprint).eqNullSafe(F.col("f_")) & (F.col("range_") == F.col("g_"))).withColumn("times_seen", F.col("prior_") + F.col("rank_") - 1)
    first = lambda c: F.when(F.col("times_seen") > 0, F.col(f"first_.{c}"))
    out = out.withColumns({"first_key": first("k"), "first_source": first("s")}).withColumn("differs", F.trim("first_source") != F.trim(source))
    return out.drop("range_", "rank_", "f_", "g_", "prior_", "first_")


def corroboration(rows: DataFrame, claim: str, domain: str, content: str, independent: Column) -> DataFrame:
    """(claim, n_rows, n_contents, n_pairs, n_independent, status) from a claim's distinct sources."""
    own = rows.withColumn("own_", F.coalesce(independent, F.lit(False)))
    agg = own.groupBy(claim).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(content).alias("n_contents"),
        F.countDistinct(F.when(F.col("own_"), F.struct(domain, content))).alias("n_pairs"),
        F.countDistinct(F.when(F.col("own_"), F.col(content))).alias("n_independent"),
    )
    status = F.when((F.col("n_pairs") >= 2) & (F.col("n_independent") >= 2), "corroborated").when((F.col("n_rows") >= 2) & (F.col("n_contents") == 1), "repeated-copy").otherwise("single-source")
    return agg.withColumn("status", status)


def material(text: Column, limit: int = MATERIAL_LIMIT) -> Column:
    """The fingerprint of a text as material: the beginning of its normal form."""
    return F.substring(normalize_corpus(text), 1, limit)


def market_mentions(edges: DataFrame, people: DataFrame, relations: list[str]) -> DataFrame:
    """(seq, signal, org, display, relation) for each end of a signal's edges that may be a row of the map.

    edges: (seq, signal, kind, from_node, to_node, relation); people: (name). An edge between
    people is none, of one between a person and an organisation only the latter counts; unknown
    relations and the people of the roster are left out. org is the normal form of the name.
    """
    own = edges.filter((F.coalesce("kind", F.lit("")) != "person-person") & F.col("relation").isin(*relations))
    ends = F.when(F.coalesce("kind", F.lit("")) == "person-org", F.array("to_node")).otherwise(F.array("from_node", "to_node"))
    rows = own.select("seq", "signal", "relation", F.posexplode(ends).alias("side", "name")).select(F.struct("seq", "side").alias("seq"), "signal", "relation", F.trim(F.coalesce("name", F.lit(""))).alias("display"))
    rows = rows.withColumn("org", normalize_corpus(F.col("display"))).filter("display <> ''")
    return rows.join(people.select(normalize_corpus(F.col("name")).alias("org")).filter("org <> ''").distinct(), "org", "left_anti")


def off_map(signals: DataFrame, mentions: DataFrame) -> DataFrame:
    """The signals (signal) that stand nowhere on the map."""
    return signals.join(mentions.select("signal").distinct(), "signal", "left_anti")


def market_map(mentions: DataFrame, org: str, relation: str, signal: str, material: str, independent: Column, admitted: Column, relations: list[str]) -> DataFrame:
    """A cell for each org and each relation: signals, admitted, materials, heat, reprints, state.

    A signal counts once for each org and relation; heat counts distinct independent materials.
    Signals and materials are counted apart, each first made distinct and then added up, so that
    no shuffle carries a row several times.
    """
    own = mentions.filter(F.col(relation).isin(*relations)).select(F.col(org).alias("org"), F.col(relation).alias("relation"), F.col(signal).alias("s_"), F.col(material).alias("m_"), F.coalesce(independent, F.lit(False)).alias("own_"), F.coalesce(admitted, F.lit(False)).alias("in_"))
    told = own.groupBy("org", "relation", "s_").agg(F.bool_or("in_").alias("in_")).groupBy("org", "relation").agg(F.count("s_").alias("signals"), F.count_if(F.col("in_") & F.col("s_").isNotNull()).alias("admitted"))
    made = own.groupBy("org", "relation", "m_").agg(F.bool_or("own_").alias("own_")).groupBy("org", "relation").agg(F.count("m_").alias("materials"), F.count_if(F.col("own_") & F.col("m_").isNotNull()).alias("heat"))
    cells = told.join(made, ["org", "relation"])
    grid = told.select("org").distinct().withColumn("relation", F.explode(F.array(*map(F.lit, relations))))
    out = grid.join(cells, ["org", "relation"], "left").na.fill(0)
    state = F.when(F.col("signals") == 0, "unchecked").when(F.col("heat") == 0, "no-independent").otherwise("backed")
    return out.withColumn("reprints", F.col("signals") - F.col("materials")).withColumn("state", state)


def market_rows(cells: DataFrame) -> DataFrame:
    """Totals by org: heat, signals and the number of cells that were checked."""
    return cells.groupBy("org").agg(F.sum("heat").alias("heat"), F.sum("signals").alias("signals"), F.count_if(F.col("state") != "unchecked").alias("checked"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """The rows of the map: most independent material first, then most cells checked, then by name."""
    return rows.orderBy(F.desc("heat"), F.desc("checked"), "org")


def market_totals(cells: DataFrame) -> DataFrame:
    """One row: orgs, total_heat, cells and how many of them are unchecked."""
    return cells.agg(F.countDistinct("org").alias("orgs"), F.coalesce(F.sum("heat"), F.lit(0)).alias("total_heat"), F.count("*").alias("cells"), F.count_if(F.col("state") == "unchecked").alias("unchecked"))


def scale_claims(signals: DataFrame, title: str, evidence: str, basis: str) -> DataFrame:
    """All columns of the signals that speak of scale, with numbers (array, verbatim) and the trimmed basis."""
    found = scale_numbers(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(evidence, F.lit(""))))
    return signals.withColumn("numbers", found).filter(F.size("numbers") > 0).withColumn(basis, F.trim(F.coalesce(basis, F.lit(""))))


def claims_by_basis(claims: DataFrame, basis: str, key: str) -> DataFrame:
    """(basis, n, first_key, last_key) by basis, those without one last; the claims themselves are the members.

    There is no sum: amounts of different bases do not add up.
    """
    rows = claims.groupBy(F.col(basis).alias("basis")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    return rows.orderBy(F.col("basis") == "", "basis")


def edge_members(edges: DataFrame, src: str, dst: str, relation: str, signal: str, gate: str, executable: str) -> DataFrame:
    """(from_node, to_node, relation, signal, times, best_gate, executable): which signals name an edge, and how often.

    The membership stands in rows, so an edge that every signal names is spread like any other.
    """
    own = edges.select(F.trim(src).alias("from_node"), F.trim(dst).alias("to_node"), F.col(relation).alias("relation"), F.col(signal).alias("signal"), F.col(gate).alias("gate"), F.col(executable).alias("executable")).filter("from_node <> '' and to_node <> ''")
    return own.groupBy("from_node", "to_node", "relation", "signal").agg(F.count("*").alias("times"), F.max("gate").alias("best_gate"), F.bool_or("executable").alias("executable"))


def edge_aggregate(members: DataFrame, *more: Column) -> DataFrame:
    """One row for each from, to and relation of edge_members(): mentions, signals, best gate, whether any is executable, and more aggregates of signal and times."""
    return members.groupBy("from_node", "to_node", "relation").agg(F.sum("times").alias("mentions"), F.count("signal").alias("signals"), F.max("best_gate").alias("best_gate"), F.bool_or("executable").alias("executable"), *more)


def member_bitmaps(members: DataFrame, *group: str, member: str) -> DataFrame:
    """(group, bucket, bits): a group's distinct members (numbers from 1) as bitmaps of 32,768 numbers each.

    A group of any size takes as many rows of 4 KB as its numbers span; bitmap_or_agg() joins groups,
    bitmap_count() counts them. Numbers below 1 and nulls are left out.
    """
    own = members.filter(F.col(member) > 0)
    return own.groupBy(*group, F.bitmap_bucket_number(member).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(member)).alias("bits"))


def bitmap_counts(bitmaps: DataFrame, *group: str) -> DataFrame:
    """(group, members): distinct members of the groups of member_bitmaps(), or of coarser ones."""
    whole = bitmaps.groupBy(*group, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*group).agg(F.sum(F.bitmap_count("bits")).alias("members"))


def node_degree(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, degree): degrees count every mention; the best connected first, ties by name."""
    ends = edges.select(F.trim(src).alias("node")).union(edges.select(F.trim(dst).alias("node"))).filter("node <> ''")
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node")


def valid_links(links: DataFrame, nodes: DataFrame, src: str = "source", dst: str = "target", key: str = "id") -> DataFrame:
    """The links both of whose ends are nodes."""
    ids = nodes.select(key).distinct()
    return links.join(ids.withColumnRenamed(key, src), src, "left_semi").join(ids.withColumnRenamed(key, dst), dst, "left_semi")


def hubs(nodes: DataFrame, links: DataFrame, least: int = 2, top: int = 8, kind: str | None = None) -> DataFrame:
    """(hub, degree, companies): the `top` best connected nodes that are no companies, with the companies they tie together.

    nodes: (id, type), ids once each, links: (source, target). Degrees count links between known
    nodes; hubs are of one type alone if it is given (`kind`). Links meet the types of their ends once; a hub's distinct partners are counted before
    its degree is, and looked at again for the best ones only.
    """
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type"))
    own = links.join(end("source"), "source").join(end("target"), "target")
    both = F.array(F.struct(F.col("source").alias("hub"), F.col("source_type").alias("type"), F.col("target").alias("other"), (F.col("target_type") == "company").alias("company")), F.struct(F.col("target").alias("hub"), F.col("target_type").alias("type"), F.col("source").alias("other"), (F.col("source_type") == "company").alias("company")))
    near = own.select(F.explode(both).alias("e")).select("e.*").filter((F.col("type") != "company") if kind is None else (F.col("type") == kind)).groupBy("hub", "other", "company").agg(F.count("*").alias("n"))
    checkpoint_dir(nodes.sparkSession)
    near = near.checkpoint()
    best = near.groupBy("hub").agg(F.sum("n").alias("degree")).filter(F.col("degree") >= least).orderBy(F.desc("degree"), "hub").limit(top)
    tied = near.filter("company").join(F.broadcast(best.select("hub")), "hub").groupBy("hub").agg(F.array_sort(F.collect_list("other")).alias("companies"))  # `top` hubs
    return best.join(tied, "hub", "left")


def components(edges: DataFrame, src: str, dst: str, rounds: int = 100, salts: int | None = None) -> DataFrame:
    """(node, component): the least node reachable, by alternating large and small stars.

    A large star links a node's greater neighbours to its least one, a small star its lesser
    neighbours; the edges end as stars around the least nodes, after a logarithmic number of rounds.
    A node's least neighbour is a grouped minimum, pre-aggregated before it moves, and goes back to
    the node's edges by a join that is salted: the edges of a node are dealt to `salts` parts by
    their other end, and each part gets a copy of the minimum of the nodes that have many edges. So
    a node that a third of all edges touch is no task's burden. Each round is cut off by
    checkpoint(), in the folder that the session names (on a local master without one, a temporary
    folder); only a count and a checksum of it reach the driver.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    salts = salts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heavy = 8 * salts  # edges from which a node's part is split

    def met(pairs: DataFrame, own: DataFrame) -> DataFrame:
        """pairs with m, the least v that u has in `own`."""
        least = own.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        split = F.when(F.col("n") > heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))
        dealt = least.withColumn("s", F.explode(split)).drop("n")
        many = least.filter(F.col("n") > heavy).select("u", F.lit(True).alias("many"))
        marked = pairs.join(F.broadcast(many) if few(many) else many, "u", "left")
        salted = marked.withColumn("s", F.when(F.col("many"), F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).otherwise(-1)).drop("many")
        return salted.join(dealt, ["u", "s"]).drop("s")

    def few(many: DataFrame) -> bool:
        return many.limit(10_001).count() <= 10_000  # nodes, so a broadcast of 160 KB

    def large(now: DataFrame) -> DataFrame:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return met(both.filter("v > u"), both).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()

    def small(now: DataFrame) -> DataFrame:
        down = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        moved = met(down, down)
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    alone = ends.filter("u = v").select(F.col("u").alias("node")).distinct()
    now = ends.filter("u <> v").distinct().checkpoint()
    before = mark(now)
    for _ in range(rounds if before["n"] else 0):
        now = small(large(now).checkpoint()).checkpoint()
        after = mark(now)
        if after == before:
            break
        before = after
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    return found.union(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cluster_summary(parts: DataFrame, edges: DataFrame, src: str, dst: str, relation: str, places: DataFrame | None = None) -> DataFrame:
    """(component, members, links, dominant): the commonest relation, ties by name.

    With places (node, x, y) also the box around the members: left, right, top and bottom.
    """
    members = parts.groupBy("component").agg(F.count("*").alias("members"))
    if places is not None:
        box = parts.join(places, "node").groupBy("component").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
        members = members.join(box, "component", "left")
    inner = edges.join(parts, edges[src] == parts["node"]).groupBy("component", relation).agg(F.count("*").alias("n"))
    top = inner.groupBy("component").agg(F.sum("n").alias("links"), F.min_by(relation, F.struct(-F.col("n"), F.col(relation))).alias("dominant"))
    return members.join(top, "component", "left").na.fill(0, ["links"])


def parallel_offsets(edges: DataFrame, src: str, dst: str, order: list[str], step: float = 0.72) -> DataFrame:
    """A centred offset for each edge among those of its unordered pair."""
    pair = [F.least(src, dst), F.greatest(src, dst)]
    n, k = F.count("*").over(Window.partitionBy(*pair)), F.row_number().over(Window.partitionBy(*pair).orderBy(*order))
    return edges.withColumn("offset", F.round((k - 1 - (n - 1) / 2) * step, 4))


def run_overlap(pairs: DataFrame, run: str, item: str, one: int, last: int = 80) -> DataFrame:
    """Runs among the `last` before run `one` that share items with it: (run, shared)."""
    mine = pairs.filter(F.col(run) == one).select(item).distinct()
    before = pairs.filter(F.col(run) < one).select(run).distinct().orderBy(F.desc(run)).limit(last)
    return pairs.join(before, run).join(mine, item).groupBy(run).agg(F.countDistinct(item).alias("shared"))


def entity_match(left: DataFrame, right: DataFrame, least: float = 0.3, top: int = 5) -> DataFrame:
    """(left_name, right_name, score, place): Jaccard similarity of bigrams from `least` on, the best `top` of each.

    left and right have the columns name and grams (distinct bigrams); several rows of a name are
    its spellings, of which the best counts. Names whose similarity reaches `least` share one of
    their n - ceil(least * n) + 1 rarest bigrams, so only these are joined, and a bigram that very
    many names hold brings hardly any of them together; the ratio itself is taken over all bigrams.
    """
    both = left.select("name", "grams").union(right.select("name", "grams"))
    often = both.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def rare(names: DataFrame, name: str) -> DataFrame:
        own = names.select("name", "grams").distinct().select(F.col("name").alias(name), F.col("grams").alias(f"{name}_grams"), F.explode("grams").alias("g")).join(often, "g")
        own = own.groupBy(name, f"{name}_grams").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("r"))
        keep = F.size("r") - F.ceil(F.size("r") * F.lit(least)).cast("int") + 1
        return own.select(name, f"{name}_grams", F.explode(F.slice("r", F.lit(1), keep)).alias("x")).select(name, f"{name}_grams", "x.g")

    met = rare(left, "left_name").join(rare(right, "right_name"), "g").drop("g").distinct()
    n, total = F.size(F.array_intersect("left_name_grams", "right_name_grams")), F.size(F.array_union("left_name_grams", "right_name_grams"))
    scored = met.withColumns({"n": n, "t": total}).filter(F.col("n") >= least * F.col("t")).groupBy("left_name", "right_name").agg(F.round(F.max(F.col("n") / F.col("t")), 4).alias("score"))
    w = Window.partitionBy("left_name").orderBy(F.desc("score"), "right_name")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("left_name", "right_name", "score", "place")


def company_merge(found: DataFrame, key: str, name: str, ticker: str, signal: str, rank: str, evidence: str) -> DataFrame:
    """Two passes: by normalised key, then by ticker onto the least key; evidence without repeats.

    (key, name, ticker, strongest, n_evidence); name is that of the least key's first row.
    """
    once = found.dropDuplicates([key, evidence, signal])
    first = once.groupBy(key).agg(F.min(ticker).alias("t_")).withColumn("head_", F.when(F.col("t_").isNotNull(), F.min(key).over(Window.partitionBy("t_"))).otherwise(F.col(key)))
    rows = once.join(first.select(key, "head_"), key)
    return rows.groupBy(F.col("head_").alias("merged_key")).agg(F.min_by(name, F.struct(F.col(key), F.col(name))).alias("name"), F.min(ticker).alias("ticker"), F.max_by(signal, F.struct(F.col(rank), F.col(signal))).alias("strongest"), F.countDistinct(evidence).alias("n_evidence"))
