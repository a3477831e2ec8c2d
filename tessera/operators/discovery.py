"""Companies found by searching: posts, job boards and filings as findings, merged into ranked candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import discovery as D
from tessera.functions.text import clean_company_name, company_key

FINDING = "name string, listing string, ticker string, cik string, channel string, term string, quote string, source_url string, source_title string"


def post_findings(hits: DataFrame, term: str) -> tuple[DataFrame, DataFrame]:
    """(findings, rejected) of posts (object_id, story_title, comment_text); only threads of who is hiring count.

    rejected: (name, channel, why).
    """
    asked = hits.filter(F.col("story_title").rlike("(?i)who is hiring") & ~F.col("story_title").rlike("(?i)who wants to be hired"))
    rows = asked.withColumn("plain", D.decode_post(F.coalesce("comment_text", F.lit("")))).withColumn("header", D.post_header(F.col("plain")))
    rows = rows.withColumn("company", D.post_company(F.col("header"))).withColumn("quote", D.quote_around(F.col("plain"), term))
    good = F.col("company.name").isNotNull() & F.col("quote").isNotNull()
    none = F.lit(None).cast("string")
    found = rows.filter(good).select(F.col("company.name").alias("name"), F.lit("private").alias("listing"), none.alias("ticker"), none.alias("cik"), F.lit("hn-hiring").alias("channel"), F.lit(term).alias("term"), "quote", F.concat(F.lit("https://news.ycombinator.com/item?id="), F.coalesce(F.col("object_id").cast("string"), F.lit(""))).alias("source_url"), F.coalesce(D.post_role(F.col("header")), F.col("story_title")).alias("source_title"))
    why = F.coalesce(F.col("company.why"), F.lit("no quote"))
    name = F.coalesce(F.col("company.name"), F.concat(F.lit("HN#"), F.coalesce(F.col("object_id").cast("string"), F.lit("?"))))
    return found, rows.filter(~good).select(name.alias("name"), F.lit("hn-hiring").alias("channel"), why.alias("why"))


def board_findings(jobs: DataFrame) -> DataFrame:
    """Findings of a job board (company, title, url, location): titles that name the role, each once a company."""
    w = Window.partitionBy("company", "title").orderBy("url")
    rows = jobs.filter(D.passes_role_gate(F.col("title")) & (F.coalesce("url", F.lit("")) != "")).withColumn("k_", F.row_number().over(w)).filter("k_ = 1")
    place = F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit("（"), F.col("location"), F.lit("）"))).otherwise("")
    none = F.lit(None).cast("string")
    return rows.select(F.col("company").alias("name"), F.lit("private").alias("listing"), none.alias("ticker"), none.alias("cik"), F.lit("greenhouse-jd").alias("channel"), F.lit("job title").alias("term"), F.concat("title", place).alias("quote"), F.col("url").alias("source_url"), F.col("title").alias("source_title"))


def filing_plan(hits: DataFrame) -> DataFrame:
    """(key, name, ticker, cik, url, title): one document for each company among hits (seq, id, cik, accession, display, form, filed)."""
    rows = hits.withColumn("f_", D.filer(F.col("display"))).withColumn("url", D.filing_url(F.col("cik"), F.col("accession"), F.col("id")))
    rows = rows.filter("url is not null and f_.name <> ''").withColumn("key", company_key(F.col("f_.name")))
    title = F.concat(F.col("f_.name"), F.lit(" "), F.coalesce("form", F.lit("filing")), F.lit("（"), F.coalesce("filed", F.lit("日期未知")), F.lit("）"))
    return rows.groupBy("key").agg(F.min_by(F.struct(F.col("f_.name").alias("name"), F.col("f_.ticker").alias("ticker"), F.col("f_.cik").alias("cik"), "url", title.alias("title")), "seq").alias("b")).select("key", "b.*")


def roster_keys(roster: DataFrame) -> DataFrame:
    """(key): the keys of all names of a roster (name, legal_name, aliases)."""
    names = F.concat(F.array("name", "legal_name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))
    return roster.select(F.explode(names).alias("n")).filter("n <> ''").select(company_key(F.col("n")).alias("key")).distinct()


def merged_findings(findings: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejected) of findings (FINDING and an order `seq`).

    candidates: key, name, listing, ticker, cik, strongest, guess, n_evidence, in_roster and place,
    the best first. By key, then by ticker onto the least key that has it; the first ticker, filer
    number and listing other than private count. Evidence with equal channel, address and quote
    counts once. rejected: (name, channel, why).
    """
    rows = findings.withColumn("quote", D.flat(F.coalesce("quote", F.lit("")))).withColumn("key", company_key(F.col("name")))
    why = F.when(F.col("quote") == "", "no quote").when(F.coalesce("source_url", F.lit("")) == "", "no source").when(~D.passes_role_gate(F.col("quote")), "no role").when(F.col("key") == "", "no name")
    rows = rows.withColumn("why", why)
    own = rows.filter("why is null").withColumn("signal", D.signal_class(F.col("quote"), F.col("source_title")))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    listing = F.coalesce(F.min_by("listing", F.when(F.col("listing") != "private", F.col("seq"))), F.lit("private")).alias("listing")
    named = F.min_by(F.coalesce(F.nullif(clean_company_name(F.col("name")), F.lit("")), F.col("name")), "seq").alias("name")
    heads = own.groupBy("key").agg(named, listing, first("ticker"), first("cik"))
    heads = heads.withColumn("head", F.when(F.col("ticker").isNotNull(), F.min("key").over(Window.partitionBy("ticker"))).otherwise(F.col("key")))
    of = F.struct(F.col("key") != F.col("head"), F.col("key"))  # the head's own row first
    whole = heads.groupBy("head").agg(F.min_by("name", of).alias("name"), F.min_by("listing", of).alias("listing"), F.min("ticker").alias("ticker"), F.min_by("cik", F.when(F.col("cik").isNotNull(), of)).alias("cik"))
    evidence = own.join(heads.select("key", "head"), "key").groupBy("head", "channel", "source_url", "quote").agg(F.min_by("signal", "seq").alias("signal"))
    counted = evidence.groupBy("head").agg(F.count("*").alias("n_evidence"), F.max(D.signal_rank(F.col("signal"))).alias("rank"), F.max_by("signal", D.signal_rank(F.col("signal"))).alias("strongest"))
    out = whole.join(counted, "head").withColumnRenamed("head", "key").withColumn("guess", D.suggested_relevance(F.col("strongest")))
    if known is None:
        out = out.withColumn("in_roster", F.lit(False))
    else:
        out = out.join(known.select("key", F.lit(True).alias("in_roster")), "key", "left").na.fill(False, ["in_roster"])
    return out.drop("rank"), rows.filter("why is not null").select("name", "channel", "why")


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """The strongest signal first, then the most evidence, then by key."""
    return candidates.orderBy(F.desc(D.signal_rank(F.col("strongest"))), F.desc("n_evidence"), "key")
