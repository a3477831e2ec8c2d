"""People in texts: their names, where they are mentioned, whom they lead to and whom they report to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.evidence import checkpoint_dir

# Chinese characters, and those after which a name of two characters has ended.
HANZI = r"\x{4E00}-\x{9FA5}"
PARTICLES = "在是的和与对给由从把被为向就也都还将已曾说表示主导负责分管兼任出任担任牵头拍"
#: Bytes of names that an automaton holds; the names of a larger dictionary are joined.
DICTIONARY = 1 << 20
#: Beginnings of names that a task knows.
PREFIXES = 1 << 17


def norm(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def aliases(name: Column) -> Column:
    """A person's names of two characters or more: the one outside parentheses and those inside."""
    plain = F.trim(name)
    inside = F.regexp_extract_all(plain, F.lit("[（(]([^）)]+)[）)]"), F.lit(1))
    bare = F.transform(F.concat(F.array(F.regexp_replace(plain, "[（(][^）)]*[）)]", "")), inside), lambda x: F.trim(x))
    return F.filter(bare, lambda x: F.length(x) >= 2)


def stands_alone(text: Column, name: Column) -> Column:
    """Whether a text holds a name as a whole: no Chinese character before it, nor, after two characters, one that may carry the name on."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    after = F.when(F.length(name) <= 2, F.lit(rf"(?![{HANZI}])")).otherwise("")
    loose = F.concat(F.lit(rf"(?<![{HANZI}])"), quoted, after)
    led = F.concat(F.lit(rf"(?<![{HANZI}])"), quoted, F.lit(f"[{PARTICLES}]"))
    return F.regexp_like(text, loose) | F.regexp_like(text, led)


def alias_hits(texts: DataFrame, names: DataFrame, block: int = DICTIONARY) -> DataFrame:
    """(signal, alias): each of the names (alias, distinct) that stands alone in a text of (signal, text), once a text.

    Up to `block` bytes of names are an Aho-Corasick automaton: a text is read once, whatever their
    number, rows come of matches only, and texts do not move. Boundaries are looked at once for each
    place where a name ends. More names than that meet what may be one of them (_spelt()).
    """
    told = names.select("alias").filter("alias <> ''")
    if _octets(told) > block:
        return _spelt(texts.select("signal", "text"), told).join(told.hint("shuffle_hash"), "alias").select("signal", "alias")
    schema = texts.select("signal", F.lit("").alias("alias")).schema
    words = [r["alias"] for r in told.collect()]  # `block` bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for w in words:
            known.add_word(w, w)
        known.make_automaton()
        hanzi = lambda c: "\u4e00" <= c <= "\u9fa5"
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                seen = set()
                for last, w in known.iter(text) if text else ():
                    first, after = last + 1 - len(w), last + 1
                    if w in seen or (first and hanzi(text[first - 1])):
                        continue
                    if len(w) > 2 or after == len(text) or not hanzi(text[after]) or text[after] in PARTICLES:
                        seen.add(w)
                        rows.append(k)
                        found.append(w)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["signal", "alias"])

    return texts.select("signal", "text").mapInArrow(run, schema) if words else texts.sparkSession.createDataFrame([], schema)


def _octets(names: DataFrame) -> int:
    return names.agg(F.sum(F.octet_length("alias"))).first()[0] or 0


def _spelt(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts, `alias` in place of `text`: what stands alone in a text, begins like one of the names (alias) and is as long as one that does; each once a text.

    Rows grow with the texts and the lengths of names, whatever their number: a join on alias says
    which ones are names. Beginnings are of up to four characters, as many as leave PREFIXES or so.
    """
    counts = names.agg(*(F.approx_count_distinct(F.substring("alias", 1, q)) for q in (1, 2, 3, 4))).first()
    size = max(q for q in (1, 2, 3, 4) if q == 1 or counts[q - 1] <= PREFIXES)
    lengths = names.select(F.substring("alias", 1, size).alias("k"), F.length("alias").alias("n")).groupBy("k").agg(F.array_sort(F.collect_set("n")).alias("n"))
    known = {r["k"]: tuple(r["n"]) for r in lengths.collect()}  # beginnings, or whole names that are shorter
    first, hanzi, particles = "".join(re.escape(c) for c in sorted({k[0] for k in known})), "一-龥", PARTICLES
    kept = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = re.compile(f"(?<![{hanzi}])[{first}]").finditer
        ends = re.compile(f"(?![{hanzi}])|(?=[{particles}])").match
        sizes = range(1, size + 1)

        def out(batch: pa.RecordBatch, rows: list[int], found: list[str]) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), pa.array(found, pa.string())], names=[*kept, "alias"])

        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                seen = set()
                for m in begins(text) if text else ():
                    i = m.start()
                    room = len(text) - i
                    for q in sizes:
                        for n in known.get(text[i : i + q], ()) if q <= room else ():
                            if n <= room and (n > 2 or ends(text, i + n)):
                                seen.add(text[i : i + n])
                rows += [k] * len(seen)
                found += seen
                if len(found) > 1 << 17:
                    yield out(batch, rows, found)
                    rows, found = [], []
            yield out(batch, rows, found)

    return texts.mapInArrow(run, texts.select(*kept, F.lit("").alias("alias")).schema) if known else texts.select(*kept, F.lit("").alias("alias")).filter("false")


def mentioned_names(signals: DataFrame, people: DataFrame, signal: str, text: str, name: str, block: int = DICTIONARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(signal, name): the distinct names of people under any of whose aliases a text mentions somebody.

    People who share a name are mentioned together: count by name first, and join people after that.
    With `carry` also these columns of the signals, a row for each row of the signal. Of more than
    `block` bytes of names, those with one alias need not be made distinct where each signal is one
    row; they come by alias, so that counts by name move little.
    """
    spelt = people.select(F.col(name).alias("name")).distinct().select("name", F.array_distinct(aliases(F.col("name"))).alias("a"))
    checkpoint_dir(people.sparkSession)
    names = spelt.select("name", (F.size("a") > 1).alias("many"), F.explode("a").alias("alias")).checkpoint()  # read several times
    texts = signals.select(F.col(signal).alias("signal"), F.col(text).alias("text"), *carry)
    if _octets(names) > block and texts.groupBy("signal").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        met = _spelt(texts, names).join(names.hint("shuffle_hash"), "alias")
        one, more = (met.filter(c).select("signal", "name", *carry) for c in (~F.col("many"), F.col("many")))
        return one.union(more.distinct())
    hits = alias_hits(texts.select("signal", "text"), names.select("alias").distinct(), block)
    found = hits.join(names, "alias").select("signal", "name").distinct()
    return found.join(texts.drop("text"), "signal") if carry else found


def mentions(signals: DataFrame, people: DataFrame, signal: str, text: str, person: str, name: str) -> DataFrame:
    """(signal, person): who is mentioned where, under any of his or her names."""
    found = mentioned_names(signals, people, signal, text, name)
    return found.join(people.select(F.col(person).alias("person"), F.col(name).alias("name")), "name").select("signal", "person").distinct()


def mention_counts(people: DataFrame, found: DataFrame, person: str, name: str) -> DataFrame:
    """(person, n, signals): how many signals mention a person, and the sum of their numbers; found: mentioned_names()."""
    n = found.groupBy("name").agg(F.count("*").alias("n"), F.sum("signal").alias("signals"))
    return people.select(F.col(person).alias("person"), F.col(name).alias("name")).join(n, "name").select("person", "n", "signals")


def entry_points(people: DataFrame, found: DataFrame, signals: DataFrame | None, person: str, name: str, path: str) -> DataFrame:
    """(person, name, signed, open, has_path, priority, place) of people: whom to talk to first.

    found: mentioned_names(); signals: (signal, executable), or None if found carries executable. 10 for each signed judgement, 4 for a
    path of our own, 1 for each open one, 5 at most; ties by name.
    """
    n = (found if signals is None else found.join(signals, "signal")).groupBy("name").agg(F.count_if("executable").alias("signed"), F.count_if(~F.col("executable")).alias("open"))
    rows = people.select(F.col(person).alias("person"), F.col(name).alias("name"), (F.trim(F.coalesce(path, F.lit(""))) != "").alias("has_path"))
    rows = rows.join(n, "name", "left").na.fill(0, ["signed", "open"])
    rows = rows.withColumn("priority", F.col("signed") * 10 + F.col("has_path").cast("int") * 4 + F.least("open", F.lit(5)))
    return rows.select("person", "name", "has_path", "signed", "open", "priority").orderBy(F.desc("priority"), "name")


def employed_by(people: DataFrame, employer: str, target: str) -> DataFrame:
    """The people of one employer, case and outer blanks aside; all of them for a blank one."""
    return people.filter(norm(F.col(employer)) == target.strip().lower()) if target.strip() else people


def orgs_of_people(people: DataFrame, found: DataFrame, edges: DataFrame | None, person: str, name: str, employer: str) -> DataFrame:
    """(person, org, best_gate, signals): the organisations of the signals that mention a person, and the employer as told (gate 0).

    found: mentioned_names(); edges: (signal, from_node, to_node, gate), or None if found carries
    these of one edge a signal: then they come by name, and counts move little. Signals are counted
    by name before people come in. The person's own names are none of them.
    """
    met = found if edges is None else found.join(edges, "signal")
    ends = met.select("name", "gate", F.explode(F.array("from_node", "to_node")).alias("org"))
    by_name = ends.select("name", F.trim("org").alias("org"), "gate").filter("org <> ''").groupBy("name", "org").agg(F.max("gate").alias("gate"), F.count("*").alias("signals"))
    who = people.select(F.col(person).alias("person"), F.col(name).alias("name"), F.trim(employer).alias("org"), F.transform(aliases(F.col(name)), norm).alias("own"))
    told = who.filter("org <> ''").select("person", "own", "org", F.lit(0).alias("gate"), F.lit(0).cast("long").alias("signals"))
    rows = who.drop("org").join(by_name, "name").select("person", "own", "org", "gate", "signals").union(told)
    rows = rows.filter(~F.array_contains("own", norm(F.col("org"))))
    return rows.groupBy("person", "org").agg(F.max("gate").alias("best_gate"), F.sum("signals").alias("signals"))


def reporting_tree(people: DataFrame, links: DataFrame, name: str, relation: str = "reports_to") -> DataFrame:
    """(name, parent, is_root, reports) from links (seq, from_node, to_node, relation): the last known superior counts.

    Names are compared normalised; links that name nobody in people are left out.
    """
    known = people.select(norm(F.col(name)).alias("k")).distinct()
    own = links.filter(F.col("relation") == relation).select("seq", norm(F.col("from_node")).alias("k"), norm(F.col("to_node")).alias("up"))
    own = own.join(known, "k", "left_semi").join(known.withColumnRenamed("k", "up"), "up", "left_semi")
    parent = own.groupBy("k").agg(F.max_by("up", "seq").alias("up"))
    below = people.select(norm(F.col(name)).alias("k")).join(parent, "k").groupBy("up").agg(F.count("*").alias("reports")).withColumnRenamed("up", "k")
    rows = people.select(F.col(name).alias("name"), norm(F.col(name)).alias("k")).join(parent, "k", "left").join(below, "k", "left")
    return rows.select("name", F.col("up").alias("parent"), F.col("up").isNull().alias("is_root"), F.coalesce("reports", F.lit(0)).alias("reports"))


def profiles_by_name(profiles: DataFrame, seq: str, key: str, name: str, legal: str, alias: str) -> DataFrame:
    """(label, key): which profile a name, legal name or alias stands for; of several the last in order."""
    names = F.array_append(F.concat(F.array(name), F.when(F.coalesce(legal, F.lit("")) != "", F.array(legal)).otherwise(F.expr("cast(array() as array<string>)"))), F.lit(None).cast("string"))
    rows = profiles.select(seq, key, F.posexplode(F.concat(names, F.coalesce(alias, F.expr("cast(array() as array<string>)")))).alias("k", "label")).filter("label is not null")
    w = Window.partitionBy("label").orderBy(F.desc(seq), F.desc("k"))
    return rows.withColumn("r_", F.row_number().over(w)).filter("r_ = 1").select("label", key)
