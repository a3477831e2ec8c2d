"""Readers and sinks: tables, CSV registries, JSON feeds, paged text, dated snapshots, incremental ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import stable_id
from tessera.sources import versions

FEED = "date string, kind string, companyId string, title string, summary string, url string, sourceType string"
FEED_KINDS = ("policy", "market", "technology", "company", "procurement")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A CSV registry with a header; quotes are doubled inside quotes. All columns are strings."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def registered(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, controller, listing, representative, person_id, position_id) of the companies (id, name) that a registry (read_registry) holds."""
    own = rows.select(F.col("企业名称").alias("name"), *(F.coalesce(c, F.lit("")).alias(a) for c, a in (("实际控制人", "controller"), ("法定代表人", "representative"))), F.trim(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("上市地", "股票代码")))).alias("listing"))
    person = F.when(F.col("representative") != "", stable_id("person", F.col("id"), F.col("representative")))
    out = names.join(own.dropDuplicates(["name"]), "name").withColumn("person_id", person)
    return out.withColumn("position_id", F.when(F.col("person_id").isNotNull(), stable_id("position", F.col("id"), F.col("person_id"), F.lit("法定代表人")))).select("id", "name", "controller", "listing", "representative", "person_id", "position_id")


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, url, snippet, publishedAt): the http(s) results of files of search answers."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.explode(search_hits(F.col("value"))).alias("r")).select("path", "r.*")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON feed {"items": [...]} with its invalid items dropped."""
    items = spark.read.schema(f"items array<struct<{FEED.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return valid_items(items.select(F.explode("items").alias("i")).select("i.*"))


def valid_items(items: DataFrame) -> DataFrame:
    """Items with an ISO date, a title, a summary and an http(s) address."""
    return items.filter(F.try_to_date("date", "yyyy-MM-dd").isNotNull() & (F.trim("title") != "") & (F.trim("summary") != "") & F.col("url").rlike("^https?://"))


def search_hits(text: Column) -> Column:
    """The http(s) results of a search answer {"results": [...]}: array<struct<title, url, snippet, publishedAt>>."""
    parsed = F.from_json(text, "struct<query: string, results: array<struct<title: string, url: string, snippet: string, publishedAt: string>>>")
    return F.filter(parsed["results"], lambda r: r["url"].rlike("^https?://"))


def paged(text: Column) -> Column:
    """array<struct<page_no, text>>: split at form feeds; the number printed last on a page, else its place."""
    pages = F.filter(F.transform(F.split(text, "\f"), lambda p, i: F.struct(F.trim(p).alias("text"), i.alias("i"))), lambda p: p["text"] != "")
    printed = lambda t: F.regexp_extract(t, r"(?:^|\n)\s*(\d{1,4})\s*$", 1)
    return F.transform(pages, lambda p, i: F.struct(F.coalesce(F.nullif(printed(p["text"]), F.lit("")).cast("int"), i + 1).alias("page_no"), p["text"].alias("text")))


def looks_like_pdf(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")).rlike(r"(?i)\.pdf$"), F.lit(False))


def latest_before(rows: DataFrame, key: str, as_of: str, today: str) -> DataFrame:
    """Each key's latest snapshot older than today."""
    old = rows.filter(F.col(as_of) < F.lit(today))
    return old.join(old.groupBy(key).agg(F.max(as_of).alias(as_of)), [key, as_of], "left_semi")


def write_snapshot(rows: DataFrame, path: str, as_of: str) -> None:
    """The snapshot of a date, replaced as a whole and at once; no rows leave an empty one."""
    spark = rows.sparkSession
    versions.replace(rows.withColumn("as_of", F.lit(as_of)), spark.createDataFrame([(as_of,)], "as_of string"), path, "as_of")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """All snapshots with their dates (as_of)."""
    return versions.current(spark, path, "as_of")
